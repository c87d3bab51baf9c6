"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions only.

A paragraph is a line of the text; its node is the SHA-256 of its bytes.  A section is a run of
paragraphs; a new one starts, besides at the first, at every paragraph whose digest begins with the
hex digit 0 (about one in 16), so that an insertion shifts no later section.  A section's node is
the SHA-256 of its paragraphs' digests, the root that of the sections' digests: equal roots mean
equal texts.  Below a paragraph are its leaves, runs of words that end after every word whose hash
has enough zero bits, and after MOST times their usual number of words at the latest.  Each level
doubles the words of a leaf; a text keeps the leaves of the level at which it has about LEAVES of
them, and those of the next one, so that texts of unlike length still have a level in common.

Fingerprint: root|level|section;section... with section = node.paragraph,paragraph... and
paragraph = node:length:marks:marks of the next level (all hex but the level; the root in full, nodes 6
digits, marks 4; paragraphs of one leaf have no marks).

Two fingerprints are compared from the top: sections that agree are passed over, then paragraphs
of the rest, then leaves of what is still left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tectra.llm.common import let

#: Leaves of a text at its level, about; a leaf's words are cut after MOST times their usual number.
LEAVES, MOST = 64, 2
#: Characters of a leaf of level 0, about (two words).
LEAF = 12
#: Signs of scripts without spaces, and a word: up to 32 signs with the spaces after them, or spaces.
#: In a paragraph with signs of the former, each of those is a word.
_NO_SPACES = "[぀-ヿ㐀-鿿가-힯]"
WORD = r"\S{1,32}\s*|\s+"
_SIGNS = rf"{_NO_SPACES}|(?:(?!{_NO_SPACES})\S){{1,32}}\s*|\s+"
#: Rows of a bucket of neighbouring doc_ids, and buckets at most (their bounds are one literal).
BUCKET, MAX_BUCKETS = 1024, 1 << 19
#: Sampled doc_ids from which the bounds of the buckets are taken, at most about.
SAMPLE = 1 << 20


def _hex(number: Column, digits: int) -> Column:
    return F.right(F.lpad(F.lower(F.hex(number)), 16, "0"), F.lit(digits))


def level_of(text: Column) -> Column:
    """The level at which a text of this length has LEAVES leaves at most, about."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.length(text), F.lit(1)) / F.lit(float(LEAF * LEAVES))))).cast("int")


def _marks(hashes: Column, last: Column, ends: Column, longest: Column) -> Column:
    """The marks of the leaves that end at the words ends; empty where there is only one leaf."""

    def starts(e: Column) -> Column:
        """First words of the leaves: after each end, and every longest words of a longer run."""
        first = lambda j: F.coalesce(F.get(e, j - 1), F.lit(0)) + 1
        return F.flatten(F.transform(e, lambda end, j: F.sequence(first(j), end, longest)))

    def cut(s: Column) -> Column:
        leaf = lambda a, j: F.slice(hashes, a, F.coalesce(F.get(s, j + 1), last + 1) - a)
        return F.when(F.size(s) > 1, F.array_join(F.transform(s, lambda a, j: _hex(F.xxhash64(leaf(a, j)), 4)), "")).otherwise("")

    return F.when(last == 0, F.lit("")).otherwise(let(starts(ends), cut))


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text; null counts as empty.  Very long texts are held as one array of
    paragraphs, and each paragraph as one of word hashes: work is linear in the length."""
    text = F.coalesce(text, F.lit(""))

    def leaves(h: Column, n: Column, t: Column) -> Column:
        ends = lambda places, mask: F.filter(places, lambda i: (i == n) | (F.get(h, i - 1).bitwiseAND(mask) == 0))
        marks = lambda e, mask: _marks(h, n, e, (mask + 1).cast("int") * MOST)
        return let(ends(F.sequence(F.lit(1), n), t["mask"]), lambda e: F.concat_ws(":", marks(e, t["mask"]), marks(ends(e, t["coarse"]), t["coarse"])))

    def paragraph(p: Column, t: Column) -> Column:
        words = F.when(p.rlike(_NO_SPACES), F.regexp_extract_all(p, F.lit(_SIGNS), F.lit(0))).otherwise(F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        both = let(hashes, lambda h: let(F.size(h), lambda n: leaves(h, n, t)))
        return F.struct(F.sha2(p, 256).alias("digest"), F.concat_ws(":", F.lower(F.hex(F.length(p))), both).alias("rest"))

    def sections(nodes: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(nodes))
        starts = F.filter(places, lambda i: (i == 1) | F.get(nodes, i - 1)["digest"].startswith("0"))
        return let(starts, lambda s: F.transform(s, lambda a, j: F.slice(nodes, a, F.coalesce(F.get(s, j + 1), F.size(nodes) + 1) - a)))

    def section(part: Column) -> Column:
        digest = F.sha2(F.array_join(F.transform(part, lambda n: n["digest"]), ""), 256)
        body = F.array_join(F.transform(part, lambda n: F.concat_ws(":", n["digest"].substr(1, 6), n["rest"])), ",")
        return F.struct(digest.alias("digest"), F.concat_ws(".", digest.substr(1, 6), body).alias("body"))

    def whole(parts: Column, level: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(parts, lambda s: s["digest"]), ""), 256)
        return F.concat_ws("|", root, level.cast("string"), F.array_join(F.transform(parts, lambda s: s["body"]), ";"))

    def tree(t: Column) -> Column:
        nodes = F.transform(F.split(t["text"], "\n", -1), lambda p: paragraph(p, t))
        return let(nodes, lambda n: let(F.transform(sections(n), section), lambda s: whole(s, t["level"])))

    def masks(t: Column) -> Column:
        words = lambda level: (F.call_function("shiftleft", F.lit(2), level) - 1).cast("long")
        return F.struct(t["text"].alias("text"), t["level"].alias("level"), words(t["level"]).alias("mask"), words(t["level"] + 1).alias("coarse"))

    return let(let(F.struct(text.alias("text"), level_of(text).alias("level")), masks), tree)


def root(mark: Column) -> Column:
    return F.substring(mark, 1, 64)


def _opened(print_: Column) -> Column:
    parts = F.split(print_, r"\|", -1)
    return F.struct(F.get(parts, F.lit(1)).cast("int").alias("level"), F.split(F.get(parts, F.lit(2)), ";", -1).alias("sections"))


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, ".", -1), ",", -1)))


def _length(paragraphs: Column) -> Column:
    """Characters of paragraphs."""
    number = lambda p: F.conv(F.get(F.split(p, ":"), F.lit(1)), 16, 10).cast("long")
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda acc, p: acc + number(p))


def _leaves(paragraphs: Column, which: Column) -> Column:
    """Marks, with repeats, that paragraphs have at the first (2) or second (3) level of their text."""
    held = lambda p: F.regexp_extract_all(F.get(F.split(p, ":", -1), which), F.lit("[0-9a-f]{4}"), F.lit(0))
    return F.flatten(F.transform(paragraphs, held))


def _section_node(s: Column) -> Column:
    return F.substring_index(s, ".", 1)


def _paragraph_node(p: Column) -> Column:
    return F.substring_index(p, ":", 2)


def _parted(x: Column, y: Column, node, same_level: Column) -> Column:
    """struct(both, x, y): what of x has its node in y too, and the rest of both.  On the same level equal
    nodes have equal marks and whole entries are compared, by hashing; else nodes alone."""

    def by_node(both: Column) -> Column:
        held = lambda u, there: F.filter(u, lambda s: F.array_contains(both, node(s)) == there)
        return F.struct(held(x, True).alias("both"), held(x, False).alias("x"), held(y, False).alias("y"))

    whole = F.struct(F.array_intersect(x, y).alias("both"), F.array_except(x, y).alias("x"), F.array_except(y, x).alias("y"))
    return F.when(same_level, whole).otherwise(let(F.array_intersect(F.transform(x, node), F.transform(y, node)), by_node))


def likeness(a: Column, b: Column) -> Column:
    """1 where the roots agree, else the characters that agree over all characters of both texts, each
    distinct section and paragraph counted once.

    Sections with the same node agree as a whole; of the others, paragraphs with the same node; of
    what is left, so much of its characters as of its leaves, on the finest level that both have, are
    the other's too."""

    def below(x: Column, y: Column) -> Column:
        """The share of agreeing characters, given what is left of a (x) and b (y), and what agrees."""
        step = y["level"] - x["level"]  # levels kept are level and level + 1
        mine = _leaves(x["rest"], F.when(step == 1, 3).otherwise(2))
        theirs = _leaves(y["rest"], F.when(step == -1, 3).otherwise(2))
        # A text has some LEAVES marks, whatever its length.
        share = lambda m, t: F.when(F.size(m) > 0, F.size(F.filter(m, lambda z: F.array_contains(t, z))) / F.size(m)).otherwise(0.0)
        left = F.struct(mine.alias("m"), theirs.alias("t"), _length(x["rest"]).alias("x"), _length(y["rest"]).alias("y"))

        def total(s: Column) -> Column:
            leaves = s["x"] * share(s["m"], s["t"]) + s["y"] * share(s["t"], s["m"])
            agreed = 2 * x["same"] + F.when(F.abs(step) <= 1, leaves).otherwise(0.0)
            every = 2 * x["same"] + s["x"] + s["y"]
            return F.when(every == 0, F.lit(0.0)).otherwise(agreed / every)

        return let(left, total)

    def paragraphs(s: Column) -> Column:
        p = F.struct(F.array_distinct(_paragraphs(s["x"])).alias("x"), F.array_distinct(_paragraphs(s["y"])).alias("y"))

        def below_them(p: Column) -> Column:
            same = s["same"] + _length(p["both"])
            x = F.struct(s["lx"].alias("level"), p["x"].alias("rest"), same.alias("same"))
            y = F.struct(s["ly"].alias("level"), p["y"].alias("rest"))
            return let(x, lambda x: let(y, lambda y: below(x, y)))

        return let(p, lambda p: let(_parted(p["x"], p["y"], _paragraph_node, s["lx"] == s["ly"]), below_them))

    def top(x: Column, y: Column) -> Column:
        parted = _parted(F.array_distinct(x["sections"]), F.array_distinct(y["sections"]), _section_node, x["level"] == y["level"])
        return let(parted, lambda p: let(F.struct(_length(_paragraphs(p["both"])).alias("same"), p["x"].alias("x"), p["y"].alias("y"), x["level"].alias("lx"), y["level"].alias("ly")), paragraphs))

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(let(_opened(a), lambda x: let(_opened(b), lambda y: top(x, y))))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of b's paragraphs that a lacks: sections that a also has are passed over whole,
    only differing branches are opened."""

    def walk(x: Column, y: Column) -> Column:
        nodes = F.array_distinct(F.transform(x["sections"], _section_node))
        held = F.array_distinct(F.transform(_paragraphs(x["sections"]), _paragraph_node))
        paragraphs = F.transform(y["sections"], lambda s: F.split(F.substring_index(s, ".", -1), ",", -1))
        known = F.transform(y["sections"], lambda s: F.array_contains(nodes, _section_node(s)))
        lacks = lambda p: ~F.array_contains(held, _paragraph_node(p))
        flags = F.flatten(F.zip_with(paragraphs, known, lambda p, k: F.when(k, F.transform(p, lambda _: F.lit(False))).otherwise(F.transform(p, lacks))))
        return F.filter(F.transform(flags, lambda changed, i: F.when(changed, i)), lambda i: i.isNotNull())

    empty = F.array().cast("array<int>")
    return F.when(root(a) == root(b), empty).otherwise(let(_opened(a), lambda x: let(_opened(b), lambda y: walk(x, y))))


def first_edit(a: Column, b: Column) -> Column:
    """The number (from 0) of the first paragraph at which the texts part, found in the first section
    at which they part; null where the roots agree."""

    def parting(x: Column, y: Column, node) -> Column:
        """Place of the first difference of two arrays, or the shorter one's length."""
        n = F.least(F.size(x), F.size(y))
        places = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (node(F.get(x, i)) != node(F.get(y, i))))
        return F.get(places, F.lit(0))

    def inside(s: Column) -> Column:
        before = F.size(_paragraphs(F.slice(s["x"], F.lit(1), s["at"])))
        here = lambda u: F.split(F.substring_index(F.coalesce(F.get(u, s["at"]), F.lit("")), ".", -1), ",", -1)
        return before + let(here(s["x"]), lambda x: let(here(s["y"]), lambda y: parting(x, y, _paragraph_node)))

    def walk(x: Column, y: Column) -> Column:
        at = parting(x["sections"], y["sections"], _section_node)
        return let(F.struct(x["sections"].alias("x"), y["sections"].alias("y"), at.alias("at")), inside)

    return F.when(root(a) != root(b), let(_opened(a), lambda x: let(_opened(b), lambda y: walk(x, y))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, fingerprint of every row: the plain operator."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), fingerprint(F.col(text_col)).alias("fingerprint"))


def _bounds(rows: DataFrame, rows_per_bucket: int) -> tuple[list[tuple], bool]:
    """Places that part the rows, in order, into even buckets, and whether rows of one doc_id have to be
    told apart for that (by the hash of their text).  The places come from a sample of bounded size."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    kept = F.rand(7) < share if share < 1 else F.lit(True)
    sample = sorted(tuple(r) for r in rows.select("last", "id").filter(kept).collect())  # about SAMPLE rows of two numbers
    buckets = max(1, min(MAX_BUCKETS, n // rows_per_bucket, len(sample)))
    cuts = [sample[len(sample) * k // buckets] for k in range(1, buckets)]
    # A doc_id (or null) that fills more than a bucket: its rows are parted by the hashes of their texts.
    distinct = sorted(set(cuts))
    if len(distinct) == len(cuts):
        return [(*c, -(1 << 63)) for c in distinct], False
    held = {c: cuts.count(c) for c in distinct}
    parted = []
    for c, times in held.items():
        step = (1 << 64) // times
        parted += [(*c, -(1 << 63) + step * k) for k in range(times)]
    return parted, True


def with_next(docs: DataFrame, rows_per_bucket: int = BUCKET) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint; next is the row after this one by
    falling doc_id (null ids last, rows of one doc_id by the hash of their text, then by text), and the
    first after the last.

    Rows are dealt to buckets of neighbours, parted at quantiles of doc_id, so outliers, clustered and
    null ids still give even buckets, and each text is shuffled once.  A copy of the first row of the
    bucket that follows ends each bucket.  The bucket table has at most MAX_BUCKETS rows of a few
    numbers, hence its broadcast."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"last": F.col("doc_id").isNull().cast("int"), "id": F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))})
    bounds, by_text = _bounds(rows, rows_per_bucket)
    part = F.xxhash64("text") if by_text else F.lit(-(1 << 63)).cast("long")
    place = F.struct("last", "id", part.alias("part"))
    text = "[" + ",".join(f'{{"last":{a},"id":{b},"part":{c}}}' for a, b, c in bounds) + "]"
    cuts = F.from_json(F.lit(text), "array<struct<last:int,id:bigint,part:bigint>>")
    # Binary search: the number of bounds at or below the row's place.
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    found = F.lit(0)
    if bounds:
        walk = lambda p: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(cuts, at + s - 1) <= p), at + s).otherwise(at))
        found = let(place, walk)
    rows = rows.withColumn("place", place).withColumn("bucket", found.cast("int"))
    tops = rows.groupBy("bucket").agg(F.min("place").alias("top"))
    order = W.orderBy("bucket")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    back = lambda c: F.coalesce(F.lag(c).over(order), F.last(c).over(whole))  # noqa: E731  the bucket before, cyclic
    tops = tops.select(F.col("bucket").alias("from"), "top", back("bucket").alias("to"))
    ghosts = rows.join(F.broadcast(tops), (F.col("bucket") == F.col("from")) & (F.col("place") == F.col("top")))
    ghosts = ghosts.groupBy("to").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("g"))
    rows = rows.select("doc_id", "text", "last", "id", "bucket", F.lit(False).alias("ghost"))
    ghosts = ghosts.select(F.lit(None).cast("long").alias("doc_id"), F.col("g.text").alias("text"), F.lit(0).alias("last"), F.lit(0).cast("long").alias("id"), F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    every = rows.unionByName(ghosts).repartition("bucket").withColumn("fingerprint", fingerprint(F.col("text")))
    near = W.partitionBy("bucket").orderBy("ghost", "last", "id", F.xxhash64("text"), "text")
    every = every.withColumns({"next_text": F.lead("text").over(near), "next_fingerprint": F.lead("fingerprint").over(near)})
    return every.filter("not ghost").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def edited_fingerprints(docs: DataFrame, rows_per_bucket: int = BUCKET) -> DataFrame:
    """For every row of docs (doc_id, text): n_chars, edited_sha256, its fingerprint, that of its edited
    text (the last half replaced by the start of the next document), near_edited and near_next (both
    likenesses), and first_edit, the number of the paragraph at which the edit starts by the trees.

    Null text counts as empty, and an empty text is like no other but an empty one; a single row is its
    own next; an empty table gives an empty result; rows that repeat a doc_id follow one another by
    their texts; null doc_ids come last; very long texts are whole rows of a window and cost time and
    memory in proportion; other columns are not read."""
    rows = with_next(docs, rows_per_bucket)
    half = F.shiftright(F.length("text"), 1)
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
    both = let(F.struct("fingerprint", "edited_fingerprint"), lambda f: F.struct(likeness(f["fingerprint"], f["edited_fingerprint"]).alias("near_edited"), first_edit(f["fingerprint"], f["edited_fingerprint"]).alias("first_edit")))
    return rows.withColumn("both", both).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "both.near_edited", "near_next", "both.first_edit")
