"""Runs of repeated words, found tile by tile.

A run is a stretch of words with smallest period q, four periods long at least, that
no neighbour extends.  Its matches, the places i with word i equal to word i + q, are
one interval, three periods long at least.  Periods are taken by octaves, B to 2B - 1.
Boundaries stand every B words; an interval of matches then holds two whole cells
between boundaries.  At a boundary the Z-function of the octave (how far the words
from there on match those q later, for each q) is needed only where it reaches the next
boundary: a comparison of hashes of B words, one matrix a tile.  Where a chain of cells
ends, the Z-functions to either side, cut at B words, give the exact ends.

Texts of more than ``TILE`` words are exploded into overlapping tiles for each octave;
small octaves share their tiles.  A tile is solved by itself.  Its fragments of
intervals are shuffled by document and period and stitched where they touch: tiles
overlap by four boundaries, so that no long interval has a gap.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.text import byte_slices, n_words, words_of, written

#: Words of a tile without its overlap; shorter texts are a tile of their own.
TILE = 16384
#: Boundaries of an octave in a tile, at least.
CELLS = 16
#: A run has four periods and six words at least.
TIMES, LEAST = 4, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_MASK = (1 << 64) - 1


@lru_cache(maxsize=64)
def _multiplier(level: int) -> np.uint64:
    """A fixed odd factor for each length of hashed windows."""
    return np.uint64((0x9E3779B97F4A7C15 * (2 * level + 3) ^ 0xD6E8FEB86659FD93 << level % 7) & _MASK | 1)


@lru_cache(maxsize=1 << 16)
def divisors(q: int) -> tuple[int, ...]:
    """Divisors of ``q`` below it."""
    small = [d for d in range(1, int(q ** 0.5) + 1) if q % d == 0]
    return tuple(sorted({d for s in small for d in (s, q // s)} - {q}))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def stretches(equal: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def z_right(w: np.ndarray, at: int, q: int, cap: int) -> int:
    """How many words from ``at`` on equal those ``q`` later, ``cap`` at most."""
    a, b = w[at:at + cap], w[at + q:at + q + cap]
    k = min(len(a), len(b))
    differ = a[:k] != b[:k]
    first = int(differ.argmax()) if k else 0
    return first if k and differ[first] else k


def z_left(w: np.ndarray, at: int, q: int, cap: int) -> int:
    """The same to the left of ``at``."""
    cap = min(cap, at)
    differ = (w[at - cap:at] != w[at - cap + q:at + q])[::-1]
    first = int(differ.argmax()) if cap else 0
    return first if cap and differ[first] else cap


def solve(w: np.ndarray, low: int, high: int, most: int) -> list[tuple[int, int, int]]:
    """(q, from, to): the intervals of matches of every smallest period in the octaves
    ``low`` to ``high``, ``most`` at most, that hold two cells of their octave.  Octaves
    below ``low`` are solved too: they show which periods are multiples."""
    found: dict[int, list[tuple[int, int]]] = {}
    out = []
    h = (w.astype(np.uint64) + np.uint64(1)) * _multiplier(0)
    h ^= h >> np.uint64(29)
    h *= _multiplier(1)
    for k in range(high + 1):
        size = 1 << k
        if size > most:
            break
        # h[i] is the hash of the ``size`` words from i on.
        cells = len(w) // size - 1
        if cells >= 2:
            later = np.zeros(cells * size, np.uint64)
            later[:len(h) - size] = h[size:size + cells * size]
            equal = later.reshape(cells, size) == h[:cells * size:size, None]
            equal.reshape(-1)[len(h) - size:] = False  # windows that would end beyond the words
            both = equal[:-1] & equal[1:]
            if both.any():
                q_at, cell = np.nonzero(both.T)
                for q, first, last in _chains(q_at + size, cell):
                    if q <= most:
                        out += _primitive(w, q, first * size, (last + 2) * size, size, found, k >= low)
        half = h[:max(0, len(h) - size)]
        h = half * _multiplier(k + 2) + h[size:]
        h ^= h >> np.uint64(31)
    return out


def _chains(q: np.ndarray, cell: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of consecutive cells of one period; sorted by period, then cell."""
    new = np.flatnonzero((np.diff(q) != 0) | (np.diff(cell) != 1)) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new, [len(q)])) - 1
    return list(zip(q[first].tolist(), cell[first].tolist(), cell[last].tolist(), strict=True))


def _is_multiple(q, s, t, found) -> bool:
    """Whether a smaller period, of which ``q`` is a multiple, holds around [s, t)."""
    return any(a <= s and t + q <= b + d for d in divisors(q) for a, b in found.get(d, ()))


def _primitive(w, q, a, b, size, found, wanted) -> list[tuple[int, int, int]]:
    """Exact intervals of matches around the chain [a, b) of period ``q``; none if a
    smaller period holds there.  ``found`` collects intervals by period."""
    if _is_multiple(q, a, b, found):
        return []
    start, stop = a - z_left(w, a, q, size), b + z_right(w, b, q, size)
    exact = [(start, stop)]
    if not np.array_equal(w[a:b], w[a + q:b + q]):  # equal hashes of unequal words
        exact = [(start + s, start + t) for s, t in stretches(w[start:stop] == w[start + q:stop + q])]
        exact = [(s, t) for s, t in exact if t - s >= 2 * size and not _is_multiple(q, s, t, found)]
    found.setdefault(q, []).extend(exact)
    return [(q, s, t) for s, t in exact] if wanted else []


def is_run(q: int, start: int, stop: int) -> bool:
    """Whether an interval of matches is long enough for a run."""
    return stop - start + q >= max(LEAST, TIMES * q)


def last_octave(n: int) -> int:
    return max(0, (n // TIMES).bit_length() - 1)


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    found = solve(word_numbers(words), 0, last_octave(n), n // TIMES)
    return sorted((s, t - s + q, q) for q, s, t in found if is_run(q, s, t))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words).decode()
    step = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()


def tiles(n: int, tile: int = TILE) -> list[tuple[int, int, int, int]]:
    """(first octave, last octave, first word, words) of the tiles of a text of ``n``
    words: octaves of up to tile / CELLS words share tiles, longer ones have their own."""
    shared = max(0, (tile // CELLS).bit_length() - 1)
    last = last_octave(n)
    out = []
    for low, high in [(0, min(shared, last)), *((k, k) for k in range(shared + 1, last + 1))]:
        core, size = max(tile, CELLS << high), 1 << high
        out += [(low, high, at, core + 4 * size + 2 * size) for at in range(0, max(1, n - 4 * size), core)]
    return out


def _tile_rows(long_texts: DataFrame, tile: int) -> DataFrame:
    """(key, low, high, at, words, text): a row for each tile of each text."""
    names = ["key", "low", "high", "at", "n", "text"]

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for low, high, at, size in tiles(len(words), tile):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([low], pa.int32()), pa.array([high], pa.int32()),
                         pa.array([at], pa.int64()), pa.array([len(words)], pa.int64()),
                         pa.array([b" ".join(words[at:at + size]).decode()], pa.string())], names=names)

    return long_texts.select("key", "_t").mapInArrow(
        run, "key long, low int, high int, at long, n long, text string")


def _fragments(tile_rows: DataFrame) -> DataFrame:
    """(key, period, from, to): intervals of matches of each tile."""
    def run(batches):
        for b in batches:
            key, low, high, at, n, text = (c.to_pylist() for c in b.columns)
            for i in range(len(key)):
                found = solve(word_numbers(words_of(text[i])), low[i], high[i], n[i] // TIMES)
                if found:
                    q, s, t = (np.array(x, np.int64) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), key[i], np.int64)), pa.array(q), pa.array(s + at[i]),
                         pa.array(t + at[i])], names=["key", "period", "from", "to"])

    return tile_rows.mapInArrow(run, "key long, period long, from long, to long")


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (key, start, length, period) from fragments: those of one document and period
    that touch or overlap are one interval; short ones fall."""
    order = Window.partitionBy("key", "period").orderBy("from", "to")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("from") <= before, 0).otherwise(1)
    whole = (fragments.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
             .groupBy("key", "period", "_island").agg(F.min("from").alias("start"), F.max("to").alias("stop")))
    length = F.col("stop") - F.col("start") + F.col("period")
    return whole.where(length >= F.greatest(F.lit(LEAST), TIMES * F.col("period"))).select(
        "key", "start", length.alias("length"), "period")


def _result(rows: DataFrame, known: bool) -> DataFrame:
    """``row``, ``n_words``, ``runs`` and ``kept_text`` from (row, _t) or, where the runs are
    known, (row, _t, runs)."""
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(
        f"n_words long, runs {RUNS}, kept_text string").fields])
    runs_type = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))

    def run(batches):
        for b in batches:
            for first, count in byte_slices(b.column(1), 8 << 20):
                part = b.slice(first, count)
                all_words = [words_of(t) for t in part.column(1).to_pylist()]
                if known:
                    all_runs = [[(r["start"], r["length"], r["period"]) for r in x or ()]
                                for x in part.column(2).to_pylist()]
                else:
                    all_runs = [runs_of(w) for w in all_words]
                pairs = list(zip(all_words, all_runs, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(w) for w in all_words], pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x]
                               for x in all_runs], runs_type),
                     pa.array([collapsed(w, r) for w, r in pairs], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, carry: list[Column], text: Column, tile: int = TILE) -> DataFrame:
    """``carry`` columns, ``n_words``, ``runs`` (start, length and period in words, by start,
    then period) and ``kept_text`` (the words that no run holds after its first period,
    joined by one blank) of every whole text.

    Words are separated by ASCII white space.  A run has a smallest period q, max(6, 4 q)
    words at least, and no neighbouring word extends it.  Runs may overlap.  Null and empty
    texts have no words and no runs.  Texts of more than ``tile`` words are solved in tiles
    by different tasks, with the same result.  Repeated rows give a row each; an empty
    table gives an empty one; extra columns, whatever their names, play no part.
    """
    rows = docs.select(F.struct(*carry).alias("row"), F.coalesce(text, F.lit("")).alias("_t"))
    # A text has fewer words than half its characters, and one: short ones need no count.
    is_long = F.when(F.length("_t") > 2 * tile, n_words(F.col("_t")) > tile).otherwise(F.lit(False))
    short = _result(rows.where(~is_long), known=False)
    long_texts = written(rows.where(is_long).withColumn("key", F.monotonically_increasing_id()), "runs-long-texts")
    fragments = _fragments(_tile_rows(long_texts, tile).repartition("key", "low", "at"))
    found = stitched(fragments).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    joined = long_texts.join(found, "key", "left").select("row", "_t", "runs")
    return short.unionByName(_result(joined, known=True)).select("row.*", "n_words", "runs", "kept_text")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: least start, then period."""
    def better(a, b):
        left, right = b["length"] * a["period"], a["length"] * b["period"]
        before = (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))
        return F.when((left > right) | ((left == right) & before), b).otherwise(a)

    return F.when(F.size(runs) > 0, F.reduce(runs, F.element_at(runs, 1), better))
