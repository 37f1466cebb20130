"""Substring dedup with difference-cover anchors.

Only windows at cover positions are hashed: places whose remainder by the period
is in a difference cover, a set in which every remainder occurs as a difference
of two members.  Two equal passages at any two places then have an anchor at the
same offset within the first ``period`` places, so passages of ``window`` words
always share an aligned anchor of ``window - period + 1`` words.

Anchors that lie in two documents are extended: the windows of full length
around them are hashed, and a window falls if its hash also occurs in a document
with a smaller id.  Both steps reduce rows to one least id for each hash before
anything is joined, and no step puts the documents of a hash together, so
passages shared by many documents cost no more than others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.text import borrowed, byte_slices, int64, words_of, written

#: Perfect difference covers by period.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
REMEMBERED = 500_000
NO_ID = (1 << 63) - 1
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def period_for(window: int) -> int:
    """The longest period whose anchors still have a third of the window."""
    fit = [p for p in COVERS if window - p + 1 >= max(1, window // 3)]
    return max(fit, default=0)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _known() -> _WordHashes:
    return _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _known()
    if len(known) > REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(h: np.ndarray, width: int, multiplier: int = _MULTIPLIERS[0]) -> np.ndarray:
    """A 64-bit polynomial hash of each run of ``width`` word hashes, by differences
    of prefix sums, then mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    bits = len(h).bit_length()
    up = _powers(multiplier, bits)[:len(h)]
    down = _powers(pow(multiplier, -1, 1 << 64), bits)[:n]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    x = (total[width:] - total[:-width]) * down
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def at_cover(n: int, period: int) -> np.ndarray:
    """Places 0..n-1 at cover positions (every place without a period)."""
    if not period:
        return np.arange(n)
    mask = np.zeros(period, bool)
    mask[list(COVERS[period])] = True
    return np.flatnonzero(np.resize(mask, n))


def anchors(words: list[bytes], window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover places and the hashes of the anchors that begin there."""
    width = window - period + 1 if period else window
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = window_hashes(word_hashes(words), width)
    at = at_cover(len(h), period)
    return at, h[at]


def _anchor_rows(keyed: DataFrame, window: int, period: int) -> DataFrame:
    """(hash, id), once for each text."""
    def run(batches):
        for b in batches:
            for start, length in byte_slices(b.column(1), 8 << 20):
                part = b.slice(start, length)
                ids = part.column(0).to_numpy()
                each = [np.unique(anchors(words_of(t), window, period)[1])
                        for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(each).view(np.int64)),
                     pa.array(np.repeat(ids, [len(x) for x in each]))], names=["hash", "id"])

    return keyed.mapInArrow(run, "hash long, id long")


def _window_rows(found: DataFrame, window: int, period: int) -> DataFrame:
    """(hash, check, id, later): the windows around shared anchors, once for each
    text; later if an anchor inside occurs in a document with a smaller id."""
    reach = period - 1 if period else 0

    def touched(at: np.ndarray, n: int) -> np.ndarray:
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, np.maximum(at - reach, 0), 1)
        np.add.at(step, np.minimum(at + 1, n), -1)
        return np.cumsum(step[:-1]) > 0

    def one(text, shared, late):
        words = words_of(text)
        n = len(words) - window + 1
        at, hs = anchors(words, window, period)
        near = touched(at[np.isin(hs, shared)], n) if n > 0 else np.empty(0, bool)
        places = np.flatnonzero(near)
        if not len(places):
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, bool),)
        w = word_hashes(words)
        h = window_hashes(w, window)[places]
        check = window_hashes(w, window, _MULTIPLIERS[1])[places]
        later = touched(at[np.isin(hs, late)], n)[places]
        # Equal windows of a text are alike in hash, not always in ``later``.
        order = np.lexsort((~later, check, h))
        h, check, later = h[order], check[order], later[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        return h[first], check[first], later[first]

    def run(batches):
        for b in batches:
            for start, length in byte_slices(b.column(1), 8 << 20):
                part = b.slice(start, length)
                ids, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
                each = [one(t, s.values.to_numpy().view(np.uint64), x.values.to_numpy().view(np.uint64))
                        for t, s, x in zip(texts, part.column(2), part.column(3), strict=True)]
                h, check, later = (np.concatenate([e[i] for e in each]) for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     pa.array(np.repeat(ids, [len(e[0]) for e in each])), pa.array(later)],
                    names=["hash", "check", "id", "later"])

    return found.mapInArrow(run, "hash long, check int, id long, later boolean")


def covered_words(words: list[bytes], fallen: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words inside a window whose hash is in ``fallen``."""
    n = len(words) - window + 1
    step = np.zeros(len(words) + 1, np.int64)
    if n > 0:
        at = np.flatnonzero(np.isin(window_hashes(word_hashes(words), window), fallen))
        step[at] += 1
        step[at + window] -= 1
    return np.cumsum(step[:-1]) > 0


def repeated_passages(docs: DataFrame, doc_id: Column, text: Column, window: int = 50) -> DataFrame:
    """(id, fallen): for each id with a window of ``window`` words that also starts
    in a document with a smaller id, the hashes of these windows."""
    period = period_for(window)
    keyed = docs.select(F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    with borrowed(_anchor_rows(keyed.where("text is not null"), window, period), "anchors") as rows:
        shared = rows.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most"))
        found = written(
            rows.join(shared.where("least < most"), "hash")
            .groupBy("id").agg(F.collect_list("hash").alias("shared"),
                               F.collect_list(F.when(F.col("id") > F.col("least"), F.col("hash"))).alias("late")),
            "shared-anchors")
    around = _window_rows(keyed.where("text is not null").join(found, "id"), window, period)
    with borrowed(around, "windows") as windows:
        least = windows.groupBy("hash", "check").agg(F.min("id").alias("least"), F.max("id").alias("most"))
        return written(
            windows.where("later").join(least.where("least < most"), ["hash", "check"])
            .where("id > least").groupBy("id").agg(F.collect_list("hash").alias("fallen")),
            "repeated-passages")


def without_repeats(docs: DataFrame, carry: list[Column], doc_id: Column, text: Column,
                    window: int = 50) -> DataFrame:
    """``carry`` columns, ``kept_text`` (the words that stay, joined by one blank),
    ``n_words`` and ``n_removed`` of every whole text.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts, word for word, in a document with a smaller id; windows are judged on
    the input.  Hashes of 96 bits stand for the words of a window.  Null and empty
    texts have no words.  A null id counts as larger than any other.  Rows with
    the same id never remove from each other; repeated rows give a row each.
    """
    fallen = repeated_passages(docs, doc_id, text, window)
    src = (docs.select(F.struct(*carry).alias("row"), F.coalesce(text, F.lit("")).alias("_t"),
                       F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("id"))
           .join(fallen, "id", "left")
           .select("row", F.coalesce("fallen", F.array().cast("array<long>")).alias("fallen"), "_t"))
    out = T.StructType([src.schema["row"], *T.StructType.fromDDL(
        "kept_text string, n_words long, n_removed long").fields])

    def run(batches):
        for b in batches:
            for start, length in byte_slices(b.column(2), 8 << 20):
                part = b.slice(start, length)
                kept, total, gone = [], [], []
                for t, x in zip(part.column(2).to_pylist(), part.column(1), strict=True):
                    words = words_of(t)
                    bad = x.values.to_numpy().view(np.uint64)
                    mask = covered_words(words, bad, window) if len(bad) else None
                    stay = words if mask is None else [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    kept.append(b" ".join(stay).decode())
                    total.append(len(words))
                    gone.append(len(words) - len(stay))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.string()), int64(total), int64(gone)],
                    names=["row", "kept_text", "n_words", "n_removed"])

    return src.mapInArrow(run, out).select("row.*", "kept_text", "n_words", "n_removed")
