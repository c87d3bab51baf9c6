"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is the number of copies of each of its documents; the whole part is
taken, the rest is a probability.  Documents of a source are dealt to small chunks.  Within a chunk
pairs trade mass, counted in words, at random until one of the two is taken or left; the one still
undecided goes on to the next pair.  What a chunk leaves undecided, one document at most, moves up a
tree of chunks of chunks, so that a source ends with one undecided document.  Every trade keeps the
words of the source and, in expectation, each document's probability.

A trade decides the smaller of two documents first, so the last one may be long.  It is taken or left
at random, and what that is too much or too little is made up by shorter documents of its chunk, the
longest that fits first; some documents of every source wait for that chunk.  A source misses its target
by less than a short document.

Rows that repeat a doc_id, text and source are one item with a number of rows: they need no pairing
among themselves, as so many of them as their probabilities sum up to are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tectra.llm.common import WORD, fresh, let, materialize, unit

#: Documents (or residuals) of a chunk, on average; the fan-in of the reduction tree.
FAN_IN = 64
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
_ITEM = "struct<rank:double,tie:long,doc_id:long,size:long,base:int,p:double>"
_DONE = "struct<doc_id:long,tie:long,size:long,copies:int>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, size) rows: key, source_size, n_docs, target.  One row per source: the windows
    here run over sources, not documents.

    Sources in code-point order, null last, take the weights in turn.  Targets are the water level
    at which sum(min(most * size, level * weight)) is share * all sizes."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    at = F.pmod(place, F.lit(len(weights)))
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    every = W.partitionBy(F.lit(1))
    before = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source, by cap over weight, that the level of its turn does not fill sets the level.
    total = total.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)
    target = F.coalesce(F.least(F.col("cap"), fits["level"] * F.col("weight")), F.col("cap"))
    return total.select(source_key(F.col("source")).alias("key"), "source_size", "n_docs", target.alias("target"))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def _trade(c: Column, x: Column, seed: int) -> Column:
    """struct(done, carry): c and x trade words until one of them is integral."""

    def decide(t: Column) -> Column:
        up = t["u"] * (t["a"] + t["b"]) < t["b"]  # c gains a words, or loses b; no change expected
        c_done = F.when(up, (1 - c["p"]) * c["size"] <= x["p"] * x["size"]).otherwise(c["p"] * c["size"] <= (1 - x["p"]) * x["size"])
        moved = F.when(up, t["a"]).otherwise(-t["b"])
        return F.struct(up.alias("up"), c_done.alias("c_done"), moved.alias("moved"))

    def apply(d: Column) -> Column:
        done = F.when(d["c_done"], _done(c, d["up"].cast("int"))).otherwise(_done(x, (~d["up"]).cast("int")))
        kept = F.when(d["c_done"], _with_p(x, x["p"] - d["moved"] / x["size"])).otherwise(_with_p(c, c["p"] + d["moved"] / c["size"]))
        return F.struct(done.alias("done"), kept.alias("carry"))

    a = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])
    b = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])
    terms = F.struct(a.alias("a"), b.alias("b"), unit(c["tie"], x["tie"], c["doc_id"], x["doc_id"], F.lit(seed)).alias("u"))
    return let(terms, lambda t: let(decide(t), apply))


def _done(x: Column, extra: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["tie"].alias("tie"), x["size"].alias("size"), (x["base"] + extra).cast("int").alias("copies")).cast(_DONE)


def _with_p(x: Column, p: Column) -> Column:
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    return F.struct(*(x[f].alias(f) for f in ("rank", "tie", "doc_id", "size", "base")), inside.alias("p")).cast(_ITEM)


def _reduce(items: Column, seed: int) -> Column:
    """struct(carry, done) after all trades within one chunk, by falling size."""
    start = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.array().cast(f"array<{_DONE}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        first = F.struct(x.cast(_ITEM).alias("carry"), acc["done"].alias("done"))
        more = let(_trade(acc["carry"], x, seed), lambda t: F.struct(t["carry"].alias("carry"), F.concat(acc["done"], F.array(t["done"])).alias("done")))
        return F.when(acc["carry"].isNull(), first).otherwise(more)

    return F.aggregate(F.sort_array(items), start, step)


def _settle(r: Column, base: Column, seed: int) -> Column:
    """All items of a source's last chunk, decided: r is what _reduce() gave for it."""
    c = r["carry"]
    up = unit(c["tie"], c["doc_id"], F.lit(seed)) < c["p"]
    # Words that are still to be taken (or given back, below 0) once c is decided.
    short = F.when(c.isNull(), F.lit(0.0)).when(up, -(1 - c["p"]) * c["size"]).otherwise(c["p"] * c["size"])
    order = F.array_sort(r["done"], lambda x, y: F.when(x["size"] > y["size"], -1).when(x["size"] < y["size"], 1).when(x["doc_id"] < y["doc_id"], -1).when(x["doc_id"] > y["doc_id"], 1).otherwise(0))

    def step(acc: Column, d: Column) -> Column:
        n = d["size"].cast("double")
        more = (d["copies"] == base) & (n <= acc["short"])
        less = (d["copies"] > base) & (n <= -acc["short"])
        by = F.when(more, 1).when(less, -1).otherwise(0)
        item = F.struct(d["doc_id"].alias("doc_id"), d["tie"].alias("tie"), d["size"].alias("size"), (d["copies"] + by).cast("int").alias("copies")).cast(_DONE)
        return F.struct((acc["short"] - by * n).alias("short"), F.concat(acc["done"], F.array(item)).alias("done"))

    start = F.struct(short.alias("short"), F.array().cast(f"array<{_DONE}>").alias("done"))
    last = F.when(c.isNull(), F.array().cast(f"array<{_DONE}>")).otherwise(F.array(_done(c, up.cast("int"))))
    return F.concat(F.aggregate(order, start, step)["done"], last)


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sized rows (doc_id, source, size, tie), and for every distinct one of them its number of rows,
    base (copies of each), extra (rows that are taken once more), source_size and target."""
    tie = F.xxhash64(F.col(text_col).cast("string"), F.col(source_col).cast("string"))
    sized = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), tie.alias("tie")), "sizes")
    targets = materialize(source_targets(sized, weights, share, most), "targets")  # one row a source
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    base = F.floor(ratio + F.lit(1e-12))
    items = sized.groupBy("source", "doc_id", "size", "tie").agg(F.count(F.lit(1)).alias("rows"))
    items = items.withColumn("key", source_key(F.col("source"))).join(targets, "key")
    items = items.withColumn("base", base.cast("int")).withColumn("mass", F.greatest(F.lit(0.0), ratio - base) * F.col("rows"))
    # Of equal rows the whole part of their mass is taken at once; the rest is one document's probability.
    items = items.withColumn("sure", F.floor(F.col("mass") + F.lit(1e-12)).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("mass") - F.col("sure")))
    keys = ["key", "base"]
    apart = (F.col("size") == 0) | (F.col("p") <= 1e-12)
    lucky = (unit(F.col("tie"), F.col("doc_id"), F.lit(seed)) < F.col("p")).cast("int")
    name = ["key", "doc_id", "tie"]
    done = [items.filter(apart).select(*name, lucky.alias("more"))]
    item = F.struct((-F.col("size")).cast("double").alias("rank"), "tie", "doc_id", "size", "base", "p").cast(_ITEM)
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / FAN_IN)).cast("long")
    widest = targets.agg(F.max("n_docs")).first()[0] or 0
    left = max(1, -(-widest // FAN_IN))
    # Some FAN_IN documents of a source wait for its last chunk, where short ones are wanted.
    late = (unit(F.col("tie"), F.col("doc_id"), F.lit(seed + 2)) * F.col("n_docs") < FAN_IN) & F.lit(left > 1)
    level = items.filter(~apart).select(*keys, n_chunks.alias("chunks"), F.pmod(F.xxhash64("tie", "doc_id", F.lit(seed)), n_chunks).alias("chunk"), item.alias("item"), late.alias("late"))
    waiting = level.filter("late").select(*keys, F.lit(1).cast("long").alias("chunks"), F.lit(0).cast("long").alias("chunk"), "item")
    level = level.filter("not late").drop("late")
    while True:
        if left == 1:
            level = level.unionByName(waiting)
        chunked = level.groupBy(*keys, "chunks", "chunk").agg(F.collect_list("item").alias("items"))
        reduced = _reduce(F.col("items"), seed)
        if left == 1:
            settled = let(reduced, lambda r: _settle(r, F.col("base"), seed + 1))
            last = materialize(chunked.select(*keys, F.explode(settled).alias("d")).select("key", "base", "d.*"), "pivots")
            done.append(last.select(*name, (F.col("copies") - F.col("base")).alias("more")))
            break
        chunked = materialize(chunked.select(*keys, "chunks", "chunk", reduced.alias("r")), "pivots")
        done.append(chunked.select(*keys, F.explode("r.done").alias("d")).select(*keys, "d.*").select(*name, (F.col("copies") - F.col("base")).alias("more")))
        left = -(-left // FAN_IN)
        level = chunked.filter("r.carry is not null").select(*keys, F.ceil(F.col("chunks") / FAN_IN).cast("long").alias("chunks"), F.floor(F.col("chunk") / FAN_IN).cast("long").alias("chunk"), F.col("r.carry").alias("item"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # An item is decided once; its rows, its size and its source come from items (one join of numbers).
    match = lambda c: F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}"))
    whole = items.alias("i").join(out.alias("o"), match("key") & match("doc_id") & match("tie"))
    return sized, whole.select("i.key", "i.source", "i.doc_id", "i.tie", "i.size", "i.rows", "i.base", (F.col("i.sure") + F.col("o.more")).cast("long").alias("extra"), "i.source_size", "i.target")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    size is the number of words of the text (null: 0); taken = copies * size.  Copies are the floor
    or the ceiling of target over source_size.  Rows without words count no words and take copies by
    a hash.  Null sources form one source; null doc_ids are ordinary rows; of rows that repeat a
    doc_id, text and source, so many are taken once more as their probabilities sum up to.  An empty
    table gives an empty result; texts of any length are only counted.  Other columns, whatever their
    names, are not read.  The random choices come from hashes of the rows, so reruns agree."""
    _, plan = _plan(docs, id_col, text_col, source_col, weights, share, most, seed)
    more = F.transform(F.sequence(F.lit(1).cast("long"), F.col("rows")), lambda i: F.col("base") + (i <= F.col("extra")).cast("int"))
    out = plan.withColumn("copies", F.explode(more))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """docs with each row as often as mixed() takes it (never, once, twice ...); columns unchanged.

    Nulls, empty texts and repeated rows are as in mixed(); an empty table stays empty; clashing names
    of other columns do no harm.  Of rows that repeat a doc_id, text and source but differ in other
    columns, those with the smallest hashes of these are taken once more first."""
    _, plan = _plan(docs, id_col, text_col, source_col, weights, share, most, seed)
    names = {x: fresh(docs, f"__{x}") for x in ("doc", "tie", "rows", "base", "extra", "n", "copy", "hash")}
    doc, tie, rows, base, extra, n, copy, mark = names.values()
    plan = materialize(plan.select(F.col("doc_id").alias(doc), F.col("tie").alias(tie), F.col("rows").alias(rows), F.col("base").alias(base), F.col("extra").alias(extra)), "copies")
    marked = docs.withColumn(mark, F.xxhash64(docs[text_col].cast("string"), docs[source_col].cast("string")))
    same = marked[id_col].cast("long").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(tie))
    # The plan has a row per document, so it is never broadcast: one plan at every size.
    once = marked.join(plan.filter(F.col(rows) == 1).hint("merge"), same).withColumn(n, (F.col(base) + F.col(extra)).cast("long"))
    once = once.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    again = plan.filter(F.col(rows) > 1)
    once = once.select(*docs.columns)
    if again.isEmpty():
        return once
    # Equal rows are counted before they meet: a partial aggregation, then a turn for each distinct row.
    held = marked.join(again, same, "left_semi").groupBy(*docs.columns, mark).agg(F.count(F.lit(1)).alias(n))
    held = held.join(again, held[id_col].cast("long").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(tie)))
    turn = F.sum(n).over(W.partitionBy(doc, tie).orderBy(F.xxhash64(*docs.columns)).rowsBetween(W.unboundedPreceding, 0))
    upto = lambda k: F.greatest(F.lit(0).cast("long"), F.least(F.col(extra), k))
    held = held.withColumn(copy, turn).withColumn(copy, F.col(n) * F.col(base) + upto(F.col(copy)) - upto(F.col(copy) - F.col(n)))
    held = held.filter(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))))
    return once.unionByName(held.select(*docs.columns))
