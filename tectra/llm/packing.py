"""Best-fit packing of token sequences with certified repacking.

Documents are tokenized once; those longer than a sequence are cut, the first piece taking the
rest.  Full pieces are sequences by themselves.  The others are dealt to groups of bounded size and
packed there best fit, longest first.  Dual-feasible functions give a lower bound of each group's
number of bins: at the bound, the group is certified.  Groups release what could still be better,
all bins with room where there is a gap, the emptiest bin where there is none, and what is released
is dealt to fewer groups and packed again, until one group holds it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tectra.llm.common import materialize, prepare
from tectra.llm.tokens import encoder

#: Tokens of a sequence; pieces of a group, on average.
CAPACITY, GROUP = 2048, 40_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
_PACKED = _PIECES + ", g long, bin long, offset long, released boolean, gap long"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and each bin's remaining room.  Open bins are held by room; a
    bit set of the rooms that occur finds the tightest fit."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room_of = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(room_of)
            room_of.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room_of[b] = room - size
        if not open_[room - size]:
            rooms |= 1 << (room - size)
        open_[room - size].append(b)
    return bins, offsets, np.array(room_of, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of three families of dual-feasible functions: the sum itself; sizes above
    capacity - t count as whole bins and those below t as nothing, for every t up to half; and the
    rounding functions of (k + 1) * size / capacity for k up to 24."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    value = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * value).sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(count * value)
    t = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = total[capacity - t] - total[t - 1]
    best = max(best, int((large - (-middle // capacity)).max(initial=0)))
    for k in range(1, 25):
        x = (k + 1) * value
        worth = np.where(x % capacity == 0, value * k, x // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((count * worth).sum()) // (k * capacity)))
    return best


def pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer_path: str | None) -> DataFrame:
    def run(batches):
        enc = encoder(tokenizer_path)
        wide, end, number = np.dtype("<u4"), np.array([end_id], "<u4"), 0
        part = (TaskContext.get().partitionId() + 1) << 36
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.concatenate([np.frombuffer(x, enc.dtype).astype(wide), end])
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    number += 1
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part + number))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def packed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap.

    gap is the number of bins above the certified lower bound in the group that placed the piece (0:
    certified; full pieces have 0).  Null text is the end id alone; rows that repeat a doc_id are
    packed one by one; null doc_ids are ordinary rows; an empty table gives an empty result; other
    columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    every = materialize(pieces(docs, capacity, end_id, tokenizer_path), "pieces")
    out = [every.filter(F.col("length") == capacity).select("*", (-F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"))]
    left, n, turn = every.filter(F.col("length") < capacity), None, 0
    while True:
        before, n = n, left.count()
        groups = max(1, -(-n // group))
        last_turn = groups == 1 or (before is not None and n > 0.7 * before)

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("uid", ignore_index=True)
            sizes = pdf["length"].to_numpy()
            bins, offsets, room = best_fit_decreasing(sizes, capacity)
            gap = len(room) - lower_bound(sizes, capacity)
            free = np.zeros(len(room), bool)
            if not last_turn:
                free = room > 0 if gap else room == max(1, room.max())
            return pdf.assign(bin=bins, offset=offsets, released=free[bins], gap=gap)

        dealt = left.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
        done = materialize(dealt.groupBy("g").applyInPandas(pack, _PACKED), "packed")
        number = F.lit(turn << 58) + F.shiftleft(F.col("g"), 26) + F.col("bin")
        out.append(done.filter("not released").select(*every.columns, number.alias("sequence_id"), "offset", "gap"))
        if last_turn:
            break
        left, turn = done.filter("released").select(*every.columns), turn + 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long"), "gap")
