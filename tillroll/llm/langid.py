"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three characters over lower-case letters (runs of anything else
are one blank) are hashed into a fixed number of buckets; document frequencies
come from every document that may be learned from.  The weights are fitted with
follow-the-regularised-leader and elastic-net penalties on a bounded sample,
and a temperature fitted on a part of it that the weights have not seen turns
the scores into calibrated probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import map_texts

BUCKETS = 1 << 13
UNDETERMINED = "und"
# Odd multipliers that spread characters by their place in a gram.
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed grams of a whole text; None if it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.concatenate([[0], np.where(letter, code, 0)[keep], [0]]).astype(np.uint64)
    a, b, c = (x * m for m in _SPREAD)
    out = np.zeros(BUCKETS)
    pair = a[:-1] + b[1:]
    for size, g in ((1, a), (2, pair), (3, pair[:-1] + c[2:])):
        h = (g + np.uint64(size)) * _SPREAD[1]
        out += np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    return out


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row of BUCKETS weights for each language, mostly zeros
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / max(np.linalg.norm(v), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for t in texts:
            counts = gram_counts(t) if self.langs else None
            if counts is None:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            p = softmax(self.weights @ self.vector(counts) / self.temperature)
            k = int(p.argmax())
            langs.append(self.langs[k])
            scores.append(min(1.0, float(p[k])))
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3,
             alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02
             ) -> np.ndarray:
    """Follow the regularised leader, one step a row: (buckets, values, class)."""
    z, n = np.zeros((classes, BUCKETS)), np.zeros((classes, BUCKETS))

    def weights(z, n):
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    for epoch in range(epochs):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            idx, x, y = rows[at]
            zi, ni = z[:, idx], n[:, idx]
            w = weights(zi, ni)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[:, idx] = zi + g - sigma * w
            n[:, idx] = ni + g * g
    return weights(z, n)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss among a geometric grid."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 120)
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean()
            for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 1 by 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", sample_docs: int = 2400) -> LanguageModel:
    """Learn from the text and language of documents that are not held out.

    Document frequencies cover all of them.  The weights see ``sample_docs`` of
    them at most, about as many of each language where there are enough, chosen
    by a hash of the id; one in five of these fits the temperature instead.  Of
    rows with one id the least by language, then grams teaches.  With more than
    ``sample_docs`` languages the rarest are not learned and never predicted.
    Documents without id, language or letter teach nothing; very long texts are
    read whole.  An empty table
    gives a model without languages, which answers ``und``.
    """
    known = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"),
                         F.col(lang_col).alias("_lang"))
             .where(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & ~held_out(F.col("_id"))))
    df, n = document_frequencies(known.select("_t"))
    idf = np.log((1 + n) / (1 + df)) + 1
    held = (known.groupBy("_lang").agg(F.count("*").alias("_n"))
            .orderBy(F.desc("_n"), "_lang").limit(sample_docs).collect())
    langs = [r["_lang"] for r in held]
    if not langs:
        return LanguageModel([], idf, np.zeros((0, BUCKETS)))
    # A document is chosen by the hash of its id, at the rate that its language needs.
    each, steps = max(1, sample_docs // len(langs)), 1 << 30
    rates = docs.sparkSession.createDataFrame(
        [(r["_lang"], min(steps, -(-each * steps // r["_n"]))) for r in held], "_lang string, _rate long")
    drawn = F.pmod(F.xxhash64("_id"), F.lit(steps))
    chosen = (known.select("_id", "_lang").join(F.broadcast(rates), "_lang")
              .where(drawn < F.col("_rate")).orderBy(drawn, "_id").limit(sample_docs).select("_id").distinct())

    def make():
        def f(texts):
            rows = [gram_counts(t) for t in texts]
            idx = [np.flatnonzero(c) if c is not None else [] for c in rows]
            return [pa.array(idx, pa.list_(pa.int32())),
                    pa.array([c[i] if c is not None else [] for c, i in zip(rows, idx, strict=True)],
                             pa.list_(pa.float32()))]
        return f

    counted = map_texts(known.join(F.broadcast(chosen), "_id"), [F.col("_id"), F.col("_lang")],
                        F.col("_t"), make, "idx array<int>, n array<float>")
    # Of an id that repeats, however often, one row teaches.
    got = counted.groupBy("_id").agg(F.min(F.struct("_lang", "idx", "n")).alias("x")).select("_id", "x.*").toPandas()
    code = {x: i for i, x in enumerate(langs)}
    model = LanguageModel(langs, idf, np.zeros((len(langs), BUCKETS)))
    fit, check = [], []
    for at, (_, lang, idx, cnt) in enumerate(
            got.sort_values(["_id", "_lang"], kind="stable").itertuples(index=False)):
        if len(idx):
            v = np.log1p(np.asarray(cnt, dtype=float)) * idf[idx]
            (check if at % 5 == 4 else fit).append((np.asarray(idx), v / np.linalg.norm(v), code[lang]))
    model = LanguageModel(langs, idf, fit_ftrl(fit, len(langs)))
    scores = np.array([model.weights[:, i] @ x for i, x, _ in check]).reshape(len(check), len(langs))
    return LanguageModel(langs, idf, model.weights,
                         fit_temperature(scores, np.array([y for *_, y in check], dtype=int)))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents with a letter: summed in
    each task first, so a task sends BUCKETS rows at most."""
    def run(batches):
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                c = gram_counts(t.as_py())
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())],
            names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for bucket, n in (texts.mapInArrow(run, "bucket long, n long").groupBy("bucket")
                      .agg(F.sum("n")).collect()):
        out[bucket] = n
    return out[:BUCKETS], int(out[-1])


def language_id(docs: DataFrame, carry: list[Column], text: Column, model: LanguageModel
                ) -> DataFrame:
    """``carry`` columns, ``lang_pred`` (``und`` if the text is null or has no
    letter) and ``score`` (calibrated probability, 0 for ``und``) of every whole
    text.  Ties go to the more frequent language.  Repeated rows give a row each;
    nothing is shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def make():
        m = shared.value

        def f(texts):
            langs, scores = m.predict(texts)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return f

    return map_texts(docs, carry, text, make, "lang_pred string, score double")
