"""Training-data operators over a ``documents`` table: dedup, mixing, fingerprints, token files,
classifiers, scans, packing.  Nothing outside this subpackage (and corpus_pipeline.py) imports it."""
