"""Near-duplicate documents with an LSH forest.

Documents with equal shingle sets are one class; classes are what follows.  Each tree of the forest
is a sorted order of the classes by its own sequence of min-hashes, made by a range partition; rows
are then read in order, and the longest common prefix of each with the one before it is computed.
A run of rows whose common prefixes are at least DEPTH_LEAST hashes long is a region: all its
classes are candidates of each other.  A region of more than REGION classes is cut where its common
prefixes are shortest, one hash deeper at a time, until the parts fit: dense places get deeper prefixes,
others do not.  Within a region, estimates from whole signatures give a spanning forest of likely
links, a linear number of candidates.  What they connect is a block: every likely pair of every
region lies within one.  Blocks are linked exactly, on full shingle sets: each text moves to its
block once, an inverted index of the block gives all intersections, and only one link a document
leaves.  A block of more than BLOCK * REGION classes or WEIGHT shingles is linked region by region first.

What a cut could lose is made good: where a region that was cut, or a block too large for one
task, is not yet one component, all classes outside its largest component are compared with all
of its classes, by parts of bounded size.  Components come from alternating large and small stars.

A pair of similarity s shares no region of any tree with probability (1 - s ** 3) ** 12: 1e-5 at 0.85,
2e-4 at 0.8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.llm.bloom import only, without
from tectra.llm.common import materialize, prepare

#: Trees; min-hashes of a sequence; least common prefix of a region, in hashes.
TREES, DEPTH, DEPTH_LEAST = 12, 9, 3
HASHES = TREES * DEPTH
#: Classes of a region that is not cut any further, and of a group that is compared at once.
REGION = 2048
#: A block is linked in one task up to BLOCK * REGION classes with WEIGHT shingles (8 bytes each) in all.
BLOCK, WEIGHT = 8, 4_000_000
#: A pair is likely if its estimate is below the similarity by no more than this (over 4.5 standard
#: deviations of the estimate at 0.8 and above).
SLACK = 0.18
_rng = np.random.Generator(np.random.PCG64(20))
_PERMUTE = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of width words; with fewer words, of the
    whole sequence; empty without words.  bytes.lower and bytes.split know ASCII alone, as the
    definition of words does."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        x = h[j : len(h) - width + 1 + j]
        out = (out ^ (out >> np.uint64(29))) * _PLACE[0] + x * _PLACE[j % 62 + 1]
    out ^= out >> np.uint64(32)
    out *= _PLACE[63]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES min-hashes, 16 bits of each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[low : low + 1024, None] * _PERMUTE).min(axis=0), out=least)
    return ((least ^ (least >> np.uint64(23))) >> np.uint64(20)).astype("<u2")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature."""

    def run(batches):
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text, width)
                n.append(len(hashes))
                digest.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sig.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def regions(classes: DataFrame, region: int = REGION) -> DataFrame:
    """(key, rep, uncut): the classes of every region with two at least, of every tree; and, with uncut
    true, those of the regions that had to be cut, as they were before.

    Each tree's order is a range partition by its sequence, so a common prefix is dealt to as many
    tasks as its rows need.  Keys are hashes of the prefix: parts of a region in neighbouring tasks
    have the same key."""
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    sequence = lambda t: F.substring(F.col("sig"), t * (2 * DEPTH) + 1, F.lit(2 * DEPTH))
    rows = classes.select("rep", F.explode(F.transform(trees, lambda t: F.struct(t.alias("tree"), sequence(t).alias("seq")))).alias("k")).select("k.tree", "k.seq", "rep")
    ordered = rows.repartitionByRange("tree", "seq", "rep").sortWithinPartitions("tree", "seq", "rep")

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = np.array(batch.column(0).to_pylist(), np.uint16)
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, DEPTH)
            new = np.column_stack([tree, words]), np.array(batch.column(2).to_pylist(), np.int64)
            words, reps = (np.concatenate(x) for x in zip(held, new, strict=True)) if held else new
            lcp = common_prefixes(words)
            start = int(np.flatnonzero(lcp < DEPTH_LEAST)[-1])  # the run that is still open begins here
            yield _region_rows(words[:start], reps[:start], lcp[:start], region)
            held = words[start:], reps[start:]
        if held:
            yield _region_rows(*held, common_prefixes(held[0]), region)

    return ordered.mapInArrow(run, "key long, rep long, uncut boolean")


def common_prefixes(words: np.ndarray) -> np.ndarray:
    """Hashes that each row (tree, hash, hash ...) has in common with the row before, -1 in another tree
    and for the first row."""
    same = words[1:] == words[:-1]
    depth = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1)) - 1
    return np.concatenate([[-1], depth]) if len(words) else np.zeros(0, np.int64)


def _region_rows(words: np.ndarray, reps: np.ndarray, lcp: np.ndarray, region: int) -> pa.RecordBatch:
    keys, found, uncut = [], [], []

    def put(key: int, members: np.ndarray, whole: bool) -> None:
        keys.append(np.full(len(members), key, np.int64))
        found.append(members)
        uncut.append(np.full(len(members), whole))

    todo = [(0, len(reps), DEPTH_LEAST - 1)]  # runs, and the depth at which they hold together
    while todo:
        a, b, depth = todo.pop()
        starts = np.append(np.flatnonzero(lcp[a + 1 : b] <= depth) + a + 1, b)
        for low, high in zip([a, *starts[:-1].tolist()], starts.tolist(), strict=True):
            if high - low < 2:
                continue
            key = lambda n: xxhash.xxh64_intdigest(words[low, : n + 1].tobytes(), n) - (1 << 63)  # noqa: B023, E731
            if high - low <= region:
                put(key(depth + 1), reps[low:high], False)
                continue
            if depth + 1 == DEPTH_LEAST:
                put(key(DEPTH_LEAST), reps[low:high], True)
            if depth + 1 < DEPTH:
                todo.append((low, high, depth + 1))
            else:  # all hashes agree: parts with one class in common
                for at in range(low + 1, high, region - 1):
                    put(key(DEPTH) ^ at, np.append(reps[low], reps[at : at + region - 1]), False)
    if not keys:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())], ["key", "rep", "uncut"])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, found, uncut)], ["key", "rep", "uncut"])


def crossed(groups: DataFrame, region: int = REGION) -> DataFrame:
    """groups: key, rep, weight (shingles that move, or 0), own (the component so far).  Gives (key, rep,
    own, minor): every class that is outside the largest component of its group meets, marked minor,
    each other class of the group under one key.  A key has about region rows, and WEIGHT shingles;
    groups of one component have none."""
    sizes = groups.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("size"), F.sum("w").alias("w"), F.max(F.struct("n", "own", "w")).alias("main"))
    sizes = sizes.select("key", "size", "w", F.col("main.own").alias("main"), (F.col("size") - F.col("main.n")).alias("rest"), (F.col("w") - F.col("main.w")).alias("rest_w"))
    parts = lambda n, w: F.greatest(F.lit(1), F.ceil(F.col(n) * 2 / region), F.ceil(F.col(w) * 2 / WEIGHT)).cast("long")
    sizes = sizes.filter("rest > 0").select("key", "main", parts("size", "w").alias("columns"), parts("rest", "rest_w").alias("rows"))
    inside = groups.join(sizes, "key")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n))
    every = inside.select("key", "rep", "own", F.lit(False).alias("minor"), upto("rows").alias("i"), dealt("columns", 1).alias("j"))
    minor = inside.filter("own != main").select("key", "rep", "own", F.lit(True).alias("minor"), dealt("rows", 2).alias("i"), upto("columns").alias("j"))
    return every.unionByName(minor).select(F.xxhash64("key", "i", "j").alias("key"), "rep", "own", "minor")


def with_own(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """groups with the component of each rep by labels (rep, component), by default the rep itself."""
    labels = labels.select("rep", F.col("component").alias("own"))
    return groups.join(labels, "rep", "left").select("key", "rep", "weight", F.coalesce("own", "rep").alias("own"))


def _alike(sigs: np.ndarray, sizes: np.ndarray, i: int, similarity: float) -> np.ndarray:
    """Estimates of i with all others, 0 where sizes rule a link out."""
    estimate = (sigs == sigs[i]).sum(axis=1) / HASHES
    fits = np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9
    return np.where(fits, estimate, 0.0)


def spanning_links(reps: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that span each component of the likely links of a region.  A class is compared with those
    that no link has reached yet, so a region of one family costs about one comparison a class."""
    links, left = [], np.arange(len(reps))
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            estimate = (sigs[left] == sigs[i]).sum(axis=1) / HASHES
            fits = np.minimum(sizes[left], sizes[i]) >= similarity * np.maximum(sizes[left], sizes[i]) - 1e-9
            near = fits & (estimate >= similarity - SLACK)
            found, left = left[near].tolist(), left[~near]
            links += [(int(reps[i]), int(reps[j])) for j in found]
            todo += found
    return links


def candidates(members: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: likely links that span each region of members (key, rep)."""

    def links(held):
        sigs = np.frombuffer(b"".join(held[2]), "<u2").reshape(-1, HASHES)
        found = spanning_links(np.array(held[0]), np.array(held[1]), sigs, similarity)
        return [(min(x), max(x)) for x in found]

    rows = members.join(classes, "rep").select("key", "rep", "n_shingles", "sig")
    return _by_group(rows, "rep", links, "a long, b long").distinct()


def crossed_candidates(members: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: links that join all components with a likely link in a group of crossed()."""

    def links(held):
        reps, sizes = np.array(held[0]), np.array(held[3])
        sigs = np.frombuffer(b"".join(held[4]), "<u2").reshape(-1, HASHES)
        near = lambda i: _alike(sigs, sizes, i, similarity) >= similarity - SLACK
        return joins(reps, np.array(held[1]), np.flatnonzero(held[2]), near)

    rows = members.join(classes, "rep").select("key", "rep", "own", "minor", "n_shingles", "sig")
    return _by_group(rows, "rep", links, "a long, b long").distinct()


def joins(reps: np.ndarray, own: np.ndarray, minor: np.ndarray, near) -> list[tuple[int, int]]:
    """Links (a, b), a < b, that join the components own of all that near(i) gives for i of minor; no
    more of them than components."""
    component, out = own.copy(), []
    for i in minor.tolist():
        if (component == component[i]).all():
            break
        found = np.flatnonzero(near(i) & (component != component[i]))
        if not len(found):
            continue
        joined, first = np.unique(component[found], return_index=True)
        out += [(int(min(reps[i], reps[j])), int(max(reps[i], reps[j]))) for j in found[first]]
        component[np.isin(component, joined)] = component[i]
    return out


def _by_group(rows: DataFrame, order: str, work, schema: str) -> DataFrame:
    """work(columns) for every group of equal first columns; gives pairs of longs.  Groups are streamed
    from sorted partitions: small ones cost no call of their own, each is bounded by REGION."""
    key, names = rows.columns[0], [x.split()[0] for x in schema.split(", ")]
    width = len(rows.columns) - 1

    def run(batches):
        held: list[list] = [[] for _ in range(width)]
        last = None

        def frame(out):
            x, y = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names)

        def end():
            return work(held) if len(held[0]) > 1 else []

        for batch in batches:
            out = []
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != last:
                    out += end()
                    held = [[] for _ in range(width)]
                    last = k
                for h, x in zip(held, rest, strict=True):
                    h.append(x)
            yield frame(out)
        yield frame(end())

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def linked_blocks(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """blocks: block, rep, text.  Gives (a, b): each document with the smallest one of its component
    within the block, by exact intersections."""

    def links(held):
        reps = np.array(held[0])
        root = block_components([shingles(t, width) for t in held[1]], percent)
        return [(int(reps[r]), int(reps[i])) for i, r in enumerate(root.tolist()) if r != i]

    return _by_group(blocks, "rep", links, "a long, b long")


def crossed_links(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """blocks: key, rep, own, minor, text, of crossed().  Gives (a, b), a < b: links that join all
    components with a link in a group, by exact intersections."""

    def links(held):
        sets = [shingles(t, width) for t in held[3]]
        return joins(np.array(held[0]), np.array(held[1]), np.flatnonzero(held[2]), _linked(sets, percent))

    return _by_group(blocks, "rep", links, "a long, b long").distinct()


def _linked(sets: list[np.ndarray], percent: int):
    """A function that gives for the number of a set which sets are linked with it."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings = np.repeat(np.arange(n), sizes)[np.argsort(place, kind="stable")]
    starts, cuts = np.cumsum(times) - times, np.cumsum(sizes)

    def linked(i: int) -> np.ndarray:
        own = place[cuts[i] - sizes[i] : cuts[i]]
        own = own[times[own] > 1]
        if not len(own):
            return np.zeros(n, bool)
        reach = np.cumsum(times[own])
        at = np.repeat(starts[own] - reach + times[own], times[own]) + np.arange(reach[-1])
        both = np.bincount(postings[at], minlength=n)
        return (both > 0) & (100 * both >= percent * (sizes + sizes[i] - both))

    return linked


def _prefix_partners(sets: list[np.ndarray], percent: int):
    """A function that gives for the number of a set all sets that could be linked with it: two sets with
    a link have one of their rarest members in common, of as many as the link lets them differ in,
    and one more."""
    sizes = np.array([len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((place, times[place], owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = rank < (sizes - -(-percent * sizes // 100) + 1)[owner]
    place, owner = place[order][kept], owner[kept]
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
    by_place = np.argsort(place, kind="stable")
    sorted_place, holders = place[by_place], owner[by_place]

    def partners(i: int) -> np.ndarray:
        own = place[cuts[i] : cuts[i + 1]]
        low, high = np.searchsorted(sorted_place, own), np.searchsorted(sorted_place, own, "right")
        return np.unique(np.concatenate([holders[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]))

    return partners


def block_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one of its component; links are 100 * intersection >= percent * union."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    component = np.arange(n)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        component[1] = 0 if both and 100 * both >= percent * (sizes.sum() - both) else 1
        return component
    linked, partners = _linked(sets, percent), _prefix_partners(sets, percent)
    for i in range(n - 1):
        if (component[i:] == component[i]).all():
            continue
        others = partners(i)
        if (component[others] == component[i]).all():
            continue
        joined = np.unique(component[linked(i)])
        if len(joined) > 1:
            component[np.isin(component, joined)] = joined[0]
    return component


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(rep, component) of every node of edges (a, b): the smallest node reachable."""
    now = materialize(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x != y").distinct(), label)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x")
        small = small.filter("y != m").select(F.greatest("y", "m").alias("x"), F.least("y", "m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))
        now = materialize(small.distinct(), label)
        found = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    every = now.select(F.col("x").alias("rep"), F.col("y").alias("component"))
    return every.unionByName(now.select(F.col("y").alias("rep"), F.col("y").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, region: int = REGION) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links join documents whose sets of width-word shingles have at least percent hundredths of their
    union in common; component_id is the smallest doc_id reachable, kept is doc_id = component_id.
    Null, empty and wordless texts have no shingles and are linked with nothing.  Null doc_ids are
    linked with nothing: component_id null, kept true.  Rows that repeat a doc_id count as one
    document.  An empty table gives an empty result.  Other columns are not read."""
    prepare(docs.sparkSession)
    similarity = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = materialize(sketches(rows, width), "sketches")
    usable = sketched.filter("n_shingles > 0 and doc_id is not null")
    reps = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    reps = materialize(reps, "classes")
    classes = reps.select("rep", "n_shingles", "sig")
    found = materialize(regions(classes, region), "members")
    members = found.filter("not uncut").select("key", "rep").distinct()
    likely = materialize(candidates(members, classes, similarity), "likely")
    cut = found.filter("uncut").select("key").distinct()
    if not cut.isEmpty():
        # The ends of a region that was cut in some tasks only count as its members too.
        whole = found.join(cut, "key", "left_semi").select("key", "rep").distinct()
        across = crossed(with_own(whole.withColumn("weight", F.lit(0).cast("long")), components(likely)), region)
        likely = likely.unionByName(materialize(crossed_candidates(across, classes, similarity), "likely"))
    blocks = materialize(components(likely).select("rep", F.col("component").alias("block")).join(classes.select("rep", F.col("n_shingles").alias("weight")), "rep"), "blocks")
    sizes = materialize(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("all")), "sizes")
    fits = (F.col("size") <= BLOCK * region) & ((F.col("all") <= WEIGHT) | (F.col("size") == 2))
    parts = blocks.join(sizes.filter(fits), "block").select("block", "rep")
    large = sizes.filter(~fits)
    split = not large.isEmpty()
    if split:
        inside = blocks.join(large, "block").select("rep")
        parts = parts.unionByName(members.join(inside, "rep").select(F.xxhash64("key", F.lit(1)).alias("block"), "rep"))
    texts = only(rows, "doc_id", blocks.select("rep")).select(F.col("doc_id").alias("rep"), "text")
    links = materialize(linked_blocks(parts.join(texts, "rep").select("block", "rep", "text"), width, percent), "links")
    # Blocks that were not split share no document: their links are their components already.
    labels = components(links) if split else links.select(F.col("b").alias("rep"), F.col("a").alias("component"))
    if split:
        whole = blocks.join(large, "block").select(F.col("block").alias("key"), "rep", "weight")
        across = crossed(with_own(whole, labels), region).join(texts, "rep").select("key", "rep", "own", "minor", "text")
        more = materialize(crossed_links(across, width, percent), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    named = reps.select("digest", "rep").join(labels, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, the smallest doc_id; columns unchanged."""
    marks = near_duplicates(docs, id_col, text_col, **options)
    return without(docs, id_col, materialize(marks.filter(~F.col("kept")).select("doc_id"), "dropped"))
