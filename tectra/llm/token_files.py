"""Token-id files: canonical, length-limited Huffman codes of ids.

Code lengths come from the counts of all ids (package-merge, at most MAX_LENGTH bits) and are all
that the code book stores; codes are canonical.  A segment of the format holds whole documents in
ascending doc_id:

    magic 'THF1', documents n (u32), blocks m (u32), tokens t (u64), start within its part (u64),
    first row's flags: n x u8 (1: the doc_id is known), doc_ids n x i64, token counts n x u32,
    bit offset of each block m x u64, then the bit stream, most significant bit first.

A block is BLOCK ids; the offsets are checkpoints from which every block decodes by itself, by
looking up the next MAX_LENGTH bits in one table.  Segments are stored as rows of a Parquet table,
since Spark's writers alone reach every shared store; parts are its files, in order of doc_id.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tectra.llm.common import drop_scratch, materialize, prepare, scratch_path
from tectra.llm.tokens import encoder, id_type

MAX_LENGTH, BLOCK, SEGMENT = 16, 256, 1 << 16
#: Ids of a part: at least this many, and so many more that parts stay below MAX_PARTS.
PART, MAX_PARTS = 1 << 24, 20_000
_HEAD = struct.Struct("<4sIIQQ")
_SEGMENTS = "part int, segment int, n_docs long, n_tokens long, payload binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most limit bits, 0 for ids that don't occur (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    leaf_flags, level = [], weights
    leaf_flags.append(np.ones(len(weights), bool))
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaf_flags.append(at < len(weights))
    need, given = 2 * len(weights) - 2, np.zeros(len(weights), np.uint8)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:need].sum())
        given[:leaves] += 1
        need = 2 * (need - leaves)
    lengths[order] = given
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by rising length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == length)
        code <<= length - last
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code, last = code + len(ids), length
    return codes


@dataclass
class Code:
    lengths: np.ndarray

    def __post_init__(self):
        self.codes = canonical_codes(self.lengths)
        self._table = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every possible next MAX_LENGTH bits: the id and its length."""
        if self._table is None:
            ids, lens = np.zeros(1 << MAX_LENGTH, np.uint32), np.ones(1 << MAX_LENGTH, np.uint8)
            for i in np.flatnonzero(self.lengths):
                n = int(self.lengths[i])
                first = int(self.codes[i]) << (MAX_LENGTH - n)
                ids[first : first + (1 << (MAX_LENGTH - n))] = i
                lens[first : first + (1 << (MAX_LENGTH - n))] = n
            self._table = ids, lens
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks, and the bit stream."""
        n = self.lengths[ids].astype(np.uint64)
        ends = np.cumsum(n, dtype=np.uint64)
        at = ends - n
        value = self.codes[ids] << (np.uint64(64) - n - (at & np.uint64(31)))
        word = (at >> np.uint64(5)).astype(np.int64)
        out = np.zeros(int(ends[-1] >> np.uint64(5)) + 2 if len(ids) else 0, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return at[::BLOCK], out.astype(">u4").tobytes()

    def decode(self, streams: list[tuple[np.ndarray, int, bytes]]) -> list[np.ndarray]:
        """streams: (block offsets, number of ids, bits).  All blocks of all streams advance side by
        side, one id a step."""
        ids_of, len_of = self.table()
        base, bits, left, sizes = 0, [], [], []
        starts = []
        for offsets, n, data in streams:
            starts.append(offsets.astype(np.int64) + 8 * base)
            data = data + b"\0" * 8
            bits.append(data)
            base += len(data)
            sizes.append(n)
            left.append(np.minimum(BLOCK, n - BLOCK * np.arange(len(offsets))))
        if not base or not sum(sizes):
            return [np.zeros(0, np.uint32) for _ in streams]
        raw = np.frombuffer(b"".join(bits), np.uint8).astype(np.uint32)
        window = np.zeros(len(raw), np.uint32)  # the 24 bits that begin at each byte
        window[: len(raw) - 2] = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        at, left = np.concatenate(starts), np.concatenate(left)
        out = np.zeros((BLOCK, len(at)), np.uint32)
        mask = (1 << MAX_LENGTH) - 1
        live = np.arange(len(at))
        for step in range(BLOCK):
            if step and (full := left[live] > step).sum() < len(live):
                live = live[full]
            if not len(live):
                break
            here = at[live]
            peek = (window[here >> 3] >> (24 - MAX_LENGTH - (here & 7)).astype(np.uint32)) & mask
            out[step, live] = ids_of[peek]
            at[live] = here + len_of[peek]
        flat, result, block = out.T, [], 0
        for (offsets, n, _), _n in zip(streams, sizes, strict=True):
            result.append(flat[block : block + len(offsets)].reshape(-1)[:n])
            block += len(offsets)
        return result


def pack_segment(code: Code, doc_ids: list, parts: list[np.ndarray], start: int) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    offsets, bits = code.encode(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = _HEAD.pack(b"THF1", len(doc_ids), len(offsets), len(ids), start)
    return b"".join([head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(p) for p in parts], "<u4").tobytes(), offsets.astype("<u8").tobytes(), bits])


def unpack_segments(code: Code, payloads: list[bytes]) -> list[tuple[list, np.ndarray, int, np.ndarray]]:
    """Of each segment: doc_ids, token counts, start within its part, ids."""
    heads, streams = [], []
    for data in payloads:
        magic, n, m, tokens, start = _HEAD.unpack_from(data)
        if magic != b"THF1":
            raise ValueError("not a segment of token ids")
        at = _HEAD.size
        known = np.frombuffer(data, np.uint8, n, at)
        ids = np.frombuffer(data, "<i8", n, at + n)
        counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        offsets = np.frombuffer(data, "<u8", m, at + 13 * n)
        heads.append(([int(i) if k else None for i, k in zip(ids, known, strict=True)], counts, start))
        streams.append((offsets, tokens, data[at + 13 * n + 8 * m :]))
    return [(*h, ids) for h, ids in zip(heads, code.decode(streams), strict=True)]


def tokenized(docs: DataFrame, end_id: int, tokenizer_path: str | None) -> DataFrame:
    """doc_id, n_tokens, ids (bytes of the encoder's dtype) with end_id appended; null text: empty."""

    def run(batches):
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in enc.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 0, tokenizer_path: str | None = None) -> str:
    """Writes all documents' ids to path (a folder of the shared store), in ascending doc_id, null
    ids last, rows of one id by the hash of their ids; gives the path.  It holds tables segments and book."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or scratch_path(spark, "tokens")
    dtype = id_type(tokenizer_path)
    ids = materialize(tokenized(docs, end_id, tokenizer_path), "ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    # At most one row for each id of the vocabulary.
    counted = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts)
    code = spark.sparkContext.broadcast(lengths)
    some = np.flatnonzero(lengths)
    book = pd.DataFrame({"id": some.astype("int64"), "length": lengths[some].astype("int32")})
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/book")
    total = int(counts.sum())
    parts = max(1, min(MAX_PARTS, -(-total // PART)))

    def encode(batches):
        held = Code(code.value)
        part = TaskContext.get().partitionId()
        doc_ids, parts_, size, start, number = [], [], 0, 0, 0

        def segment():
            data = pack_segment(held, doc_ids, parts_, start)
            cols = [[part], [number], [len(doc_ids)], [size], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(d)
                parts_.append(np.frombuffer(x, dtype))
                size += len(parts_[-1])
                if size >= SEGMENT:
                    yield segment()
                    start, number, size, doc_ids, parts_ = start + size, number + 1, 0, [], []
        if doc_ids:
            yield segment()

    # Null ids go last: a range over (is null, id); many rows of one id are parted by their hashes.
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("ids")]
    sorted_ = ids.select("doc_id", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_.mapInArrow(encode, _SEGMENTS).write.options(compression="uncompressed").parquet(f"{path}/segments")
    drop_scratch(ids)
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document of the files at path."""
    prepare(spark)
    book = spark.read.parquet(f"{path}/book").toPandas()  # one row an id of the vocabulary at most
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"]] = book["length"]
    code = spark.sparkContext.broadcast(lengths)
    schema = "part int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches):
        held = Code(code.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 16):
                some = batch.slice(low, 16)
                out = {k: [] for k in ("part", "doc_id", "inner", "n_tokens", "ids_crc32", "ids")}
                segments = unpack_segments(held, some.column(1).to_pylist())
                for part, (doc_ids, counts, start, ids) in zip(some.column(0).to_pylist(), segments, strict=True):
                    ends = np.cumsum(counts, dtype=np.int64)
                    wide = ids.astype("<u4").tobytes()
                    out["part"] += [part] * len(doc_ids)
                    out["doc_id"] += doc_ids
                    out["inner"] += (start + ends - counts).tolist()
                    out["n_tokens"] += counts.tolist()
                    view = memoryview(wide)
                    spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
                    out["ids_crc32"] += [zlib.crc32(view[4 * a : 4 * b]) for a, b in spans]
                    if with_ids:
                        out["ids"] += [ids[a:b].tolist() for a, b in spans]
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                cols = [pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True) if k != "ids" or with_ids]
                yield pa.RecordBatch.from_arrays(cols, [k for k in out if k != "ids" or with_ids])

    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    # One row a part, MAX_PARTS at most: bounded, so it may be broadcast and summed in one task.
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before.alias("base"))
    rows = segments.select("part", "payload").mapInArrow(decode, schema)
    out = rows.join(F.broadcast(bases), "part")
    return out.select("doc_id", (F.col("base") + F.col("inner")).cast("long").alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the token files of docs and reads them back.  Null text is encoded as empty (the end
    id alone); an empty table gives empty files and an empty result; rows that repeat a doc_id are
    all written, next to each other; null doc_ids come last; a very long text is one document of its
    segment, whatever its length; other columns, whatever their names, are not read."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, **options))
