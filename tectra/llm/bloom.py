"""Bloom filters of bounded size, broadcast to keep rows that cannot match out of a shuffle.

They only ever save work: an exact join follows.  Their size is bounded by MAX_BITS whatever the
input; more keys than that serves make them less selective, not wrong."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.llm.common import fresh

#: 16 bits a key within these bounds (8 kB to 64 MB).
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
_PROBES, _BLOCK = 6, 1 << 16
#: Ids that may be broadcast instead (8 bytes each).
BROADCAST = 500_000


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(_PROBES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) % np.uint64(bits)).astype(np.int64)


def build(keys: DataFrame) -> np.ndarray:
    """keys has one column of any type; gives packed bits."""
    hashes = keys.select(F.xxhash64(*keys.columns).alias("h"))
    bits = min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(16 * keys.count() + 1))))

    def partial(batches):
        packed = np.zeros(bits // 8, np.uint8)
        for pdf in batches:
            at = np.unique(_positions(pdf["h"].to_numpy(), bits))
            np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        packed = packed.reshape(-1, _BLOCK // 8)
        some = np.flatnonzero(packed.any(axis=1))
        yield pd.DataFrame({"block": some.astype("int64"), "bits": [packed[i].tobytes() for i in some]})

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in pdf["bits"]]))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bits": [held.tobytes()]})

    blocks = hashes.mapInPandas(partial, "block long, bits binary").groupBy("block").applyInPandas(union, "block long, bits binary")
    packed = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():  # at most MAX_BITS in all
        packed[row["block"] * _BLOCK // 8 :][: _BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return packed


def may_hold(keys: DataFrame, *cols: Column) -> Column:
    """True for all rows whose cols are in keys, and for few others."""
    packed = keys.sparkSession.sparkContext.broadcast(build(keys))

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        held = packed.value
        at = _positions(h.to_numpy(), len(held) * 8)
        return pd.Series(((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1))

    return test(F.xxhash64(*cols))


def _few(ids: DataFrame) -> bool:
    """Whether ids (materialized, one long column) are few enough to be broadcast: 8 bytes each."""
    return ids.count() <= BROADCAST


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is in gone (one long column).  Rows with a null id stay.  Up to
    BROADCAST ids go to all executors; beyond that only rows that a filter lets through are shuffled."""
    may, key = fresh(docs, "__may"), fresh(docs, "__gone")
    gone = gone.select(F.col(gone.columns[0]).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct()
    if _few(gone):
        return docs.join(F.broadcast(gone), docs[id_col].cast("long") == F.col(key), "left_anti")
    marked = docs.withColumn(may, may_hold(gone, docs[id_col].cast("long")))
    rest = marked.filter(F.col(may))
    rest = rest.join(gone, rest[id_col].cast("long") == F.col(key), "left_anti")
    return marked.filter(~F.col(may)).unionByName(rest).drop(may)


def only(docs: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """docs' rows whose id is in wanted (one long column); as without()."""
    key = fresh(docs, "__wanted")
    wanted = wanted.select(F.col(wanted.columns[0]).cast("long").alias(key)).distinct()
    if _few(wanted):
        return docs.join(F.broadcast(wanted), docs[id_col].cast("long") == F.col(key), "left_semi")
    some = docs.filter(may_hold(wanted, docs[id_col].cast("long")))
    return some.join(wanted, some[id_col].cast("long") == F.col(key), "left_semi")
