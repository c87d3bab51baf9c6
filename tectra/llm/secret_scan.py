"""Secret scan with a random forest against false positives, in DataFrame functions only.

Candidates are runs of at least SHORTEST key characters with a digit, and of any length and make what
follows a key word with = or : and what begins with a known head.  The forest is trained with
Spark's MLlib on labelled findings and turned into SQL expressions, so that scoring is a projection.
Its features: length, shares of character classes, changes between classes, distinct characters, how
much of the candidate dictionary words cover, path and URL signs, and words before and after."""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tectra.llm.common import SPACE, let

SHORTEST = 16
TREES, TREE_DEPTH, FINDINGS = 24, 6, 6000
_RUN = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
_HAS = rf"(?=[A-Za-z+/_=-]*[0-9]){_RUN}"
# Words of ordinary text and code, for dictionary coverage.
DICTIONARY = (
    "about after again also and any are back been before build but cache can client code come commit config could data date day default do each even "
    "example file first for from get give go good has have her here him his home how if image in index into is it its just key know lib like line "
    "log long look main make many me more most my new no not now number of on one only or order other our out over page path people release request "
    "road run said same sample say see server service session she so some src such take test than that the their them then there these they thing "
    "think this time to two up us use user value version very was way we well were what when which who will with word work would year you your"
)
_DICTIONARY = "|".join(sorted({w for w in DICTIONARY.split() if len(w) > 2}, key=lambda w: (-len(w), w)))
# Words beside secrets, words beside examples, and heads of well-known keys.
KEY_WORDS = r"(?i)(key|token|secret|passw|pwd|auth|credential|bearer|api|private)"
SAMPLE_WORDS = r"(?i)(example|sample|test|dummy|placeholder|commit|sha1|sha256|md5|checksum|digest|uuid|build|version|order|invoice|isbn|serial)"
KEY_HEADS = r"^(AKIA|ASIA|ghp_|gho_|ghs_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-)"
# A key word's name with = or :, and the value up to a quote or separator; the same at the end of a word; heads within one.
_NAME = r"(?i:key|token|secret|passw(?:or)?d|passwd|pwd|auth|credential|bearer|api|private)[A-Za-z0-9_-]*[\"']?"
_ASSIGNED = _NAME + r"(?:=|:(?!//))+[\"']?([^\"',;]+)"
_ASSIGNS = _NAME + r"\x20?[=:]+$"
_HEADED = r"(?<![A-Za-z0-9])(" + KEY_HEADS[2:-1] + r")[A-Za-z0-9+/_=-]+"
FEATURES = ("length", "digits", "uppers", "lowers", "signs", "changes", "distinct", "hex", "covered", "slashes", "address", "key_near", "sample_near", "head", "assigned")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word_no, word, before, after, candidate: one row per candidate, of every word of every
    text; words are split at ASCII white space and counted from 0."""

    def found(words: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
        at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
        # The cheap tests first: a value in the next word needs a word that ends with = or : before it.
        ends = lambda x: at(x["i"] - 1).rlike("[=:]$") & F.concat_ws(" ", at(x["i"] - 2), at(x["i"] - 1)).rlike(_ASSIGNS)
        some = F.filter(numbered, lambda x: ((F.length(x["w"]) >= SHORTEST) & x["w"].rlike(_HAS)) | x["w"].rlike(_ASSIGNED) | x["w"].rlike(_HEADED) | ends(x))
        bare = lambda w: F.regexp_replace(w, "^[\"'(]+|[\"',;)]+$", "")
        value = lambda x: F.when(ends(x), F.array(bare(x["w"]))).otherwise(F.array().cast("array<string>"))
        named = lambda x: F.concat(F.regexp_extract_all(x["w"], F.lit(_ASSIGNED), F.lit(1)), F.regexp_extract_all(x["w"], F.lit(_HEADED), F.lit(0)), value(x))
        return F.transform(some, lambda x: F.struct(x["i"].alias("word_no"), x["w"].alias("word"), F.concat_ws(" ", at(x["i"] - 2), at(x["i"] - 1)).alias("before"), at(x["i"] + 1).alias("after"), F.regexp_extract_all(x["w"], F.lit(_HAS), F.lit(0)).alias("runs"), F.array_distinct(named(x)).alias("named")))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(let(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), found)).alias("f")).select("doc_id", "f.*")
    runs = F.transform("runs", lambda c: F.regexp_replace(c, "^(?i)([a-z_-]*(?:key|token|secret|passw(?:or)?d|pwd|auth))=+", ""))
    runs = F.filter(runs, lambda c: F.length(c) >= SHORTEST)
    every = let(runs, lambda r: F.concat(r, F.array_except(F.filter("named", lambda c: c != ""), r)))
    return rows.withColumn("candidate", F.explode(every)).drop("runs", "named")


def with_features(found: DataFrame) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    values = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        "changes": share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), _DICTIONARY, "")) / n,
        "slashes": F.regexp_count(F.col("word"), F.lit("/")),
        "address": F.col("word").rlike("://|@|^/|\\.[a-z]{2,4}$"),
        "key_near": F.concat_ws(" ", "before", "word").rlike(KEY_WORDS),
        "sample_near": F.concat_ws(" ", "before", "word", "after").rlike(SAMPLE_WORDS),
        "head": c.rlike(KEY_HEADS),
        "assigned": F.concat_ws(" ", "before", "word").rlike("[=:]"),
    }
    return found.withColumns({f: values[f].cast("double") for f in FEATURES})


def generated_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 1) -> DataFrame:
    """Labelled findings (word, before, after, candidate, label) made by rule from hashes, for use
    where no reviewed findings are at hand: keys in key-like contexts, bare keys of known make, and
    as negatives identifiers, checksums, paths, numbers, addresses and long words."""
    rows = spark.range(n).select("id", F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{seed}")), 256).alias("h"))
    pick = lambda k, *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(k + seed)), F.lit(len(values))) + 1).cast("int"))
    h = F.col("h")
    mixed = F.regexp_replace(F.base64(F.unhex(h)), "[+/=]", "")
    upper = F.translate(F.upper(h), "0123456", "GHJKLMN")
    word = F.regexp_replace(F.translate(h, "0123456789abcdef", "aeioustnrlthedmi"), "(.{5})", "$1")
    kind = F.pmod(F.col("id"), F.lit(14))
    size = pick(2, 16, 18, 20, 24, 32, 40).cast("int")
    key_word = pick(3, "token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret")
    plain = pick(4, "the", "and", "near", "of", "with", "was", "that", "into")
    cand = (
        F.when(kind.isin(0, 1), F.substring(h, F.lit(1), size))
        .when(kind.isin(2, 3), F.substring(mixed, F.lit(1), size))
        .when(kind == 4, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)))
        .when(kind == 5, F.concat(pick(5, "ghp_", "sk_live_", "xoxb-", "glpat-"), F.substring(mixed, 1, 30)))
        .when(kind == 6, F.concat(pick(6, "AKIA", "AIza", "eyJ"), F.substring(mixed, 1, 32)))
        .when(kind.isin(7, 8), F.concat(F.lit("4"), F.substring(F.translate(h, "abcdef", "012345"), F.lit(1), size - 1)))
        .when(kind == 9, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))
        .when(kind == 10, F.substring(h, 1, 40))
        .when(kind == 11, F.concat(pick(7, "/usr/lib/", "/home/user/data/", "/src/main/"), F.substring(word, 1, 10), F.lit("/"), F.substring(word, 11, 8), F.substring(h, 1, 1)))
        .when(kind == 12, F.concat(F.substring(word, F.lit(1), size), pick(8, "1", "22", "2024", "7")))
        .otherwise(F.rpad(pick(9, "0000000000000001", "1234567890123456", "abcd1234abcd1234"), 20, "0"))
    )
    rows = rows.select("id", cand.alias("candidate"), kind.alias("kind"), key_word.alias("key_word"), plain.alias("plain"))
    secret = F.col("kind") <= 6
    assigned = F.pmod(F.xxhash64("id", F.lit(21 + seed)), F.lit(2)) == 0
    keyed = F.col("kind").isin(0, 1, 2, 3)
    word_ = F.when(keyed & assigned, F.concat("key_word", F.lit("="), "candidate")).when(keyed, F.concat(F.lit('"'), "candidate", F.lit('"'))).otherwise(F.col("candidate"))
    before = F.when(keyed & assigned, F.col("plain")).when(keyed, F.concat("key_word", F.lit(" ="))).when(F.col("kind") == 10, F.concat(pick(10, "commit", "sha1", "checksum", "md5"), F.lit(" "))).otherwise(F.concat(F.col("plain"), F.lit(" "), F.col("plain")))
    return rows.select("candidate", word_.alias("word"), before.alias("before"), F.col("plain").alias("after"), secret.cast("double").alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = TREE_DEPTH, seed: int = 5) -> list[str]:
    """findings: word, before, after, candidate, label (0.0 or 1.0); a bounded table of reviewed rows.
    Gives one SQL expression per tree, 1 for a secret."""
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(with_features(findings))
    model = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled)
    return [_as_sql(t.toDebugString) for t in model.trees]


def _as_sql(tree: str) -> str:
    """A printed tree (If (feature i <= x) ... Else (...) ... Predict: y) as nested CASE."""
    lines = [x.strip() for x in tree.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node() -> str:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return str(int(float(line.split(":")[1])))
        i, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        lines.pop(0)
        return f"CASE WHEN {FEATURES[int(i)]} <= {float(bound)!r}D THEN {low} ELSE {node()} END"

    return node()


def secrets(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, word_no, shown (its first four characters), length, sha256 (of the
    candidate), score (share of trees for a secret), is_secret (half of them at least).

    Null and empty texts have no candidates; null or repeated doc_ids are ordinary rows; an empty
    table gives an empty result; other columns are not read.  The secrets themselves are not put out."""
    trees = train(findings)
    found = with_features(candidates(docs, id_col, text_col)).withColumn("score", F.expr("(" + " + ".join(trees) + f") / {len(trees)}D"))
    return found.select("doc_id", "word_no", F.substring("candidate", 1, 4).alias("shown"), F.col("length").cast("int").alias("length"), F.sha2("candidate", 256).alias("sha256"), "score", (F.col("score") >= 0.5).alias("is_secret"))
