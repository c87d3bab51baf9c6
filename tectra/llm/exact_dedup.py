"""Exact deduplication with a log-structured merge index of text digests.

Every scan task is a memtable: it flushes its (digest, doc_id) entries as one run sorted by digest,
a Parquet file with min/max statistics and a Bloom filter on the digest.  Compaction merges runs by
digest, keeps the smallest identifier and sums the counts.  Digests that were hit more than once go
into one Bloom filter of bounded size; only rows that pass it move their text, and their bytes are
compared in full before they count as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tectra.llm.bloom import may_hold
from tectra.llm.common import fresh, materialize, prepare, remove, scratch_path


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


class DigestIndex:
    """Runs of (digest, keep_id, size) under one folder of the shared store.

    flush() adds a batch of documents as level-0 runs, compact() merges all runs into one level-1
    run per task, entries() reads the merged view.  Batches may arrive at any time: the result
    equals that of a single batch with all rows."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.runs, self.made = spark, path or scratch_path(spark, "lsm"), [], 0

    def _write(self, entries: DataFrame, level: int) -> str:
        self.made += 1
        run = f"{self.path}/L{level}-{self.made:06d}"
        options = {"compression": "zstd", "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        entries.sortWithinPartitions("digest", "keep_id").write.options(**options).parquet(run)
        return run

    def flush(self, keyed: DataFrame) -> None:
        """keyed has digest (binary) and doc_id."""
        self.runs.append(self._write(keyed.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size")), 0))

    def compact(self) -> None:
        old, merged = self.runs, self.entries()
        self.runs = [self._write(merged, 1)]
        for run in old:
            remove(self.spark, run)

    def entries(self) -> DataFrame:
        return self.spark.read.schema("digest binary, keep_id long, size long").parquet(*self.runs).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("size").alias("size"))

    def probe(self, digest: bytes) -> list:
        """The entries of one digest; Parquet's statistics and Bloom filters skip the other runs."""
        return self.spark.read.schema("digest binary, keep_id long, size long").parquet(*self.runs).filter(F.col("digest") == F.lit(digest)).collect()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normalised(); null text counts as empty and forms a group
    with the empty texts.  Of equal texts the smallest doc_id stays.  A null doc_id never wins over
    another; where a group has only null ids, keep_id is null and kept is true.  Rows that repeat a
    doc_id and its text are marked alike.  An empty table gives an empty result.  Other columns of
    docs, whatever their names, are not read."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"))
    keyed = materialize(rows.select("doc_id", "digest", F.xxhash64("norm").alias("check")), "digests")
    index = DigestIndex(spark)
    index.flush(keyed)
    index.compact()
    entries = index.entries()
    hits = entries.filter("size > 1")
    # Grouping by the bytes themselves is the verification; map-side aggregation folds copies first.
    verified = rows.filter(may_hold(hits.select("digest"), F.col("digest"))).groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    classes = verified.filter("size > 1").select("digest", F.xxhash64("norm").alias("check"), "keep_id", "size")
    classes = classes.groupBy("digest", "check").agg(F.min("keep_id").alias("keep_id"), F.max("size").alias("size"), F.count(F.lit(1)).alias("texts"))
    clash = F.when(F.col("texts") > 1, F.raise_error("two texts agree in both digests")).otherwise(F.col("keep_id"))
    classes = materialize(classes.select("digest", "check", clash.cast("long").alias("keep_id"), "size"), "classes")
    out = keyed.join(classes, ["digest", "check"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text equals that of a smaller doc_id; of rows that repeat a
    doc_id and its text one stays; rows with a null doc_id stay.  Columns are unchanged."""
    marks = exact_duplicates(docs, id_col, text_col).filter("doc_id is not null").select("doc_id", "kept", "group_size", "text_sha256")
    digest, may, id_key, digest_key = (fresh(docs, x) for x in ("__digest", "__may", "__doc", "__sha"))
    pairs = lambda rows: rows.select(F.col("doc_id").alias(id_key), F.col("text_sha256").alias(digest_key)).distinct()
    gone = materialize(pairs(marks.filter("not kept")), "gone")
    repeated = marks.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    twice = materialize(pairs(repeated), "twice")
    marked = docs.withColumn(digest, F.sha2(normalised(docs[text_col]), 256))
    marked = marked.withColumn(may, may_hold(gone, docs[id_col].cast("long"), F.col(digest)))
    same = lambda rows: (rows[id_col].cast("long") == F.col(id_key)) & (rows[digest] == F.col(digest_key))
    rest = marked.filter(F.col(may))
    kept = marked.filter(~F.col(may)).unionByName(rest.join(gone, same(rest), "left_anti"))
    if not twice.isEmpty():
        once = kept.join(twice, same(kept), "left_semi").dropDuplicates([id_col, digest])
        kept = kept.join(twice, same(kept), "left_anti").unionByName(once)
    return kept.drop(may, digest)
