"""The pipeline's stages on the small table and on tables that hold next to nothing."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def staged(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages_agree_with_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang, exact, near, mixed, packed = staged(spark, docs)
    for stage in (lang, exact, near, mixed):
        assert stage.columns == docs.columns
    assert 0.98 * docs.count() <= lang.count() <= docs.count()
    texts = [r.text for r in exact.collect()]
    assert len(texts) == len({" ".join(t.split()) for t in texts}) <= docs.count()
    assert near.count() < exact.count()
    assert {r.doc_id for r in mixed.select("doc_id").distinct().collect()} <= {r.doc_id for r in near.collect()}
    size = mixed.agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    before = near.agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert abs(size - 1.5 * before) < 0.02 * before
    whole = corpus_pipeline.run(spark, SF)
    key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(packed)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [s.count() for s in staged(spark, docs.limit(0))] == [0] * 5


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated ids and rows, junk, other columns with clashing names."""
    known = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"digest": F.lit("x"), "rows": F.lit(1)})
    prose = known.filter("length(text) > 400").first()
    odd = [
        (None, None, None, None, None, None, None),
        (None, prose.text, "en", "src1", 1, "y", 2),
        (None, prose.text, "en", "src1", 1, "y", 2),
        (10**9, "", "en", None, 0, None, 0),
        (10**9 + 1, "0f3a" * 300, "en", "src1", 0, "a", 1),
        (10**9 + 2, prose.text, None, None, 0, "a", 1),
        (10**9 + 3, f"{prose.text} and so on", "en", "src2", 0, "a", 1),
        (10**9 + 3, prose.text[::-1], "en", "src2", 0, "a", 1),
        (10**9 + 4, prose.text[:300] + " word" * 40000, "en", "src3", 0, "a", 1),
    ]
    docs = known.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, digest string, rows int"))
    lang, exact, near, mixed, packed = staged(spark, docs)
    for stage in (lang, exact, near, mixed):
        assert stage.columns == docs.columns
    kept = Counter(r.doc_id for r in lang.collect())
    assert kept[None] == 2 and not kept[10**9] and not kept[10**9 + 1] and kept[10**9 + 2]
    left = Counter(r.doc_id for r in exact.collect())
    assert left[None] == 2 and not left[10**9 + 2] and left[10**9 + 3] == kept[10**9 + 3]
    assert not Counter(r.doc_id for r in near.collect()) - left
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
