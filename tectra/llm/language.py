"""Language identification by the nearest of several centroids per language.

A text's vector holds its letter n-grams (1 to 3 letters, hashed) with sublinear counts times inverse
document frequency, scaled to length one.  Each language's sample is clustered by spherical k-means;
its centroids are compared with a text by cosine.

A text is rejected by its distance: where its cosine is below a share of what nearly all texts of the
language with as many distinct n-grams reach.  That is measured on rows that the clusters have not
seen, and on pieces of them of all lengths, since short texts are further from their language."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tectra.llm.bloom import may_hold
from tectra.llm.common import materialize, prepare
from tectra.llm.toxicity import in_fold

#: Hashed n-grams; centroids of a language; rows of a language's sample, at most about; languages that are
#: learned, the most frequent ones (4 * DIM * CENTROIDS bytes each go to all workers).
DIM, CENTROIDS, SAMPLE, LANGUAGES = 1 << 13, 3, 800, 1000
#: A text is rejected where its cosine is below REJECT times the quantile LOW of those of the rows held
#: apart (one in APART of the sample) and their pieces, among texts with about as many distinct
#: n-grams: one quantile for each power of two up to DIM.  PIECE characters are the shortest piece.
REJECT, LOW, APART, PIECE = 0.4, 0.1, 4, 20
#: Least share of a language's rows that a centroid stands for.
MEMBERS = 0.05
STEPS = DIM.bit_length()
UNKNOWN = "und"
#: Whether a code point is a letter, for the planes that hold other signs too; the next two hold letters.
_LETTER = np.array([chr(i).isalpha() for i in range(0x20000)])


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(c.isalpha() for c in text))


def counts(text: str | None) -> np.ndarray:
    """Counts of n-grams; runs of other characters than letters count as one space."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(code, 0x1FFFF)] | (code >= 0x20000)
    code = np.where(letter, code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1]
    a = code[keep].astype(np.uint32)
    one = a * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (a[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (a[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    return np.bincount(np.concatenate([one, two, three]) >> shift, minlength=DIM)


def vectors(texts: list, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts (those without n-grams stay zero), and their numbers of distinct n-grams."""
    x = np.stack([counts(t) for t in texts]).astype(np.float32)
    distinct = (x > 0).sum(axis=1)
    x = np.log1p(x, out=x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), distinct


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means from spread-out rows; clusters of few members (stray rows) are no centroids."""
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(k, len(x)):
        far = (x @ centres.T).max(axis=1).argmin()
        centres = np.vstack([centres, x[far]])
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    members = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
    return centres[members >= min(members.max(), MEMBERS * len(x))]


def pieces(text: str) -> list[str]:
    """The text and parts of it, each half as long as the one before, from places spread by a rule."""
    out, size = [text], len(text) // 2
    while size >= PIECE:
        at = (len(text) * 7919 + size * 104729) % (len(text) - size + 1)
        out.append(text[at : at + size])
        size //= 2
    return out


def least_cosines(cosines: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The quantile LOW of the cosines for each power of two of distinct n-grams; where there are too few
    texts, that of the nearest smaller power, or of the nearest larger one."""
    out, step = np.full(STEPS, np.nan), np.log2(np.maximum(distinct, 1))
    for i in range(STEPS):
        near = cosines[np.abs(step - i) <= 0.5]
        if len(near) >= 20:
            out[i] = np.quantile(near, LOW)
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.zeros(STEPS)
    at = np.searchsorted(known, np.arange(STEPS), "right") - 1
    return out[known[np.maximum(at, 0)]]


def too_far(cosine: float, distinct: int, least: np.ndarray) -> bool:
    """Whether a cosine is below what least (of least_cosines) allows, between the powers in proportion."""
    return cosine < REJECT * float(np.interp(np.log2(max(distinct, 1)), np.arange(STEPS), least))


Model = tuple[np.ndarray, list[str], np.ndarray, np.ndarray]


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """labelled has doc_id, text, lang.  Gives idf, and of each centroid its language, vector and the
    least cosines of its language.  The sample of a language is its rows with the smallest hashes."""
    spark = labelled.sparkSession
    per = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30))
    # Ids first: a common language's texts never meet, only those of the sample move.
    picked = labelled.select("doc_id", "lang").join(F.broadcast(per), "lang").filter(dealt * F.col("count") < F.lit(float(sample * (1 << 30))))
    picked = materialize(picked.select("doc_id").distinct(), "picked")
    rows = labelled.filter(may_hold(picked, F.col("doc_id"))).join(picked, "doc_id", "left_semi").select("lang", "doc_id", "text")
    rows = materialize(rows, "languages")

    def frequency(batches):
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.tolist()], pa.list_(pa.int64()))], ["n", "seen"])

    partial = rows.select("text").mapInArrow(frequency, "n long, seen array<long>")
    summed = partial.select("n", F.posexplode("seen")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("seen")).toPandas()  # DIM rows
    idf = np.ones(DIM, np.float32)
    if len(summed):
        idf[summed["pos"]] = np.log((1 + summed["n"]) / (1 + summed["seen"])) + 0.05
    spread = spark.sparkContext.broadcast(idf)

    def fit(key, pdf):
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        texts = [t for t in pdf["text"] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "vector": [], "least": []})
        apart = [t for i, t in enumerate(texts) if i % APART == APART - 1]
        c = cluster(vectors([t for i, t in enumerate(texts) if i % APART < APART - 1], spread.value)[0], centroids)
        cosines, distinct = [], []
        for t in apart:
            x, n = vectors(pieces(t), spread.value)
            cosines.append((x @ c.T).max(axis=1))
            distinct.append(n)
        least = least_cosines(np.concatenate(cosines), np.concatenate(distinct)) if apart else np.zeros(STEPS)
        return pd.DataFrame({"lang": [key[0]] * len(c), "vector": [v.astype("<f4").tobytes() for v in c], "least": [least.tolist()] * len(c)})

    # A few rows a language, LANGUAGES at most.
    model = rows.groupBy("lang").applyInPandas(fit, "lang string, vector binary, least array<double>").toPandas().sort_values("lang", kind="stable")
    centres = np.frombuffer(b"".join(model["vector"]), "<f4").reshape(-1, DIM)
    return idf, model["lang"].tolist(), centres, np.array(model["least"].tolist(), float).reshape(-1, STEPS)


def learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, **options) -> Model:
    """The model of the labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return train(known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("doc_id"))), **options)


def judged(texts: list, model: Model) -> tuple[list[str], list[float], list[bool]]:
    """Languages, scores, and whether rejected, of texts; 64 at a time, whatever their number."""
    idf, langs, centres, least = model
    lang, score, rejected = [], [], []
    for low in range(0, len(texts), 64):
        some = texts[low : low + 64]
        x, distinct = vectors(some, idf)
        near = x @ centres.T if langs else np.zeros((len(some), 0))
        for text, row, n in zip(some, near, distinct.tolist(), strict=True):
            ok = len(row) and has_letter(text)
            best = int(row.argmax()) if ok else -1
            lang.append(langs[best] if ok else UNKNOWN)
            score.append(float(np.clip(row[best], 0, 1)) if ok else 0.0)
            rejected.append(not ok or too_far(row[best], n, least[best]))
    return lang, score, rejected


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs.

    score is the cosine with the nearest centroid.  lang_pred is `und` where the text is null, has
    no letter, or nothing was learned; those rows and those too far from all centroids are rejected.
    Null doc_ids and null langs teach nothing; rows that repeat a doc_id are judged one by one.  Ties go
    to the language that sorts first.  An empty table gives an empty result.  Very long texts are counted
    whole.  Other columns, whatever their names, are not read."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learned(docs, id_col, text_col, lang_col, **options))

    def predict(batches):
        for batch in batches:
            lang, score, rejected = judged(batch.column(1).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", F.coalesce(in_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """docs without the rows whose text identified() rejects; columns unchanged.  Every row is judged by
    its own text: null and empty texts go, rows with null or repeated doc_ids stay if their text does.
    An empty table stays empty; names of other columns don't matter."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, id_col, text_col, lang_col, **options))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return ~pd.Series(judged(texts.tolist(), model.value)[2], dtype=bool)

    return docs.filter(known(docs[text_col].cast("string")))
