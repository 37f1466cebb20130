"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case tokens of letters and digits.  A mask selects some of a
few consecutive token positions and ignores the others, so that a window hashes
alike whatever stands at an ignored place.  Hashes of benchmark items and of
documents are joined; around each hit the item is laid over the document, and
the best stretch of sufficient length decides, in which substituted tokens are
tolerated.

Benchmark items are the query set: they are sent to the tasks in blocks of
bounded size, and every block sees every document.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillroll.llm.text import byte_slices, map_texts, written

#: Seven of ten places count.  Together the masks hit any stretch of 13 tokens with
#: one substitution, of 15 with two, of 25 with four.
MASKS = ("1110010111", "1011011101", "1101101011", "1111001101")
SPAN = len(MASKS[0])
#: Tokens of the shortest item whose overlap removes a document.
LEAST_ITEM = 3
_TOKEN_BYTES = bytes(c if chr(c).isalnum() and c < 0x80 or c >= 0x80 else 0x20 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits; ASCII signs separate."""
    return text.lower().encode().translate(_TOKEN_BYTES).split() if text else []


def _window_hashes(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start places whose selected tokens are all known (not 0), and their hashes."""
    n = len(x) - int(offsets[-1])
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k, o in enumerate(offsets.tolist()):
        part = x[o:o + n]
        known &= part != 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(known)
    return at, h[at]


@dataclass
class SeedIndex:
    """One block of benchmark items: token ids, and places of each seed hash.
    Items shorter than a mask are found by a mask of their whole length."""

    vocabulary: dict[bytes, int]
    items: list[tuple[object, np.ndarray]]
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # offsets, hashes, item, place

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]], masks: tuple[str, ...] = MASKS):
        vocabulary: dict[bytes, int] = defaultdict(lambda: len(vocabulary) + 1)
        items = [(i, np.array([vocabulary[w] for w in ws], np.int64))
                 for i, t in rows if (ws := tokens(t))]
        offsets = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in masks]
        span = max(map(len, masks))
        short = sorted({len(x) for _, x in items if len(x) < span})
        seeds = []
        for off, only in [(o, None) for o in offsets] + [(np.arange(n), n) for n in short]:
            found = [(h, np.full(len(h), k), at) for k, (_, x) in enumerate(items)
                     if (len(x) == only if only else len(x) >= span)
                     for at, h in [_window_hashes(x, off)]]
            if found:
                h, item, at = map(np.concatenate, zip(*found, strict=True))
                order = np.argsort(h, kind="stable")
                seeds.append((off, h[order], item[order], at[order]))
        return cls(dict(vocabulary), items, seeds)

    def filters(self) -> list[np.ndarray]:
        """A bit table for each seed: hashes whose low bits are not in it miss."""
        out = []
        for _, h, _, _ in self.seeds:
            bits = np.zeros(1 << 22, bool)
            bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            out.append(bits)
        return out

    def _hits(self, x: np.ndarray, filters: list[np.ndarray]) -> dict[int, list[tuple[np.ndarray, int]]]:
        """For each item that a seed of the document hits: (document places, item place) of
        each of its seeds that does."""
        out: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for (off, hashes, item, place), bits in zip(self.seeds, filters, strict=True):
            at, h = _window_hashes(x, off)
            some = bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
            at, h = at[some], h[some]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            at, h = at[hi > lo], h[hi > lo]
            if not len(at):
                continue
            order = np.argsort(h, kind="stable")
            kinds, first, count = np.unique(h[order], return_index=True, return_counts=True)
            lo, hi = np.searchsorted(hashes, kinds, "left"), np.searchsorted(hashes, kinds, "right")
            for u in range(len(kinds)):
                places = at[order[first[u]:first[u] + count[u]]]
                for k in range(lo[u], hi[u]):
                    out[int(item[k])].append((places, int(place[k])))
        return out

    def overlaps(self, text: str | None, filters: list[np.ndarray], min_overlap: int,
                 max_substituted: float) -> list[tuple]:
        """(item id, matched tokens, compared tokens, item tokens, first document
        token, first item token) of the best stretch with each item that is long
        enough.  Item by item: its diagonals, then the stretches of many at a time."""
        ws = tokens(text)
        x = np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int64, len(ws))
        out = []
        for k, hits in sorted(self._hits(x, filters).items()):
            ident, y = self.items[k]
            found = best_diagonal(x, y, diagonals(hits, len(x), len(y)), max_substituted, min(min_overlap, len(y)))
            if found:
                same, d, i, j = found
                out.append((ident, same, j - i, len(y), d + i, i))
        return out


def diagonals(hits: list[tuple[np.ndarray, int]], n: int, m: int) -> np.ndarray:
    """The distinct differences of document and item place, ascending; marked in an array
    where seeds repeat, so that memory follows the lengths, not the hits."""
    if sum(len(p) for p, _ in hits) < n + m:
        return np.unique(np.concatenate([p - place for p, place in hits]))
    marks = np.zeros(n + m + 1, bool)
    for places, place in hits:
        marks[places - place + m] = True
    return np.flatnonzero(marks) - m


def best_diagonal(x: np.ndarray, y: np.ndarray, ds: np.ndarray, max_substituted: float,
                  least: int) -> tuple[int, int, int, int] | None:
    """(equal tokens, diagonal, item start, item end) of the first diagonal whose best stretch
    has the most equal tokens.  Diagonals on which the item lies wholly inside the document
    are laid out as the rows of a matrix, some at a time."""
    best = None
    inside = (ds >= 0) & (ds + len(y) <= len(x))
    step = max(1, (1 << 20) // len(y))
    for at in range(0, len(ds), step):
        part, whole = ds[at:at + step], inside[at:at + step]
        found = []
        if whole.any():
            rows = part[whole]
            equal = np.lib.stride_tricks.sliding_window_view(x, len(y))[rows] == y
            found += [(int(equal[r, i:j].sum()), int(rows[r]), i, j)
                      for r, i, j in best_stretches(equal, max_substituted, least)]
        for d in part[~whole].tolist():
            start, stop = max(0, -d), min(len(y), len(x) - d)
            equal = x[start + d:stop + d] == y[start:stop]
            if stretch := best_stretch(equal, max_substituted, least):
                found.append((int(equal[slice(*stretch)].sum()), d, start + stretch[0], start + stretch[1]))
        for f in found:
            if best is None or (f[0], -f[1]) > (best[0], -best[1]):
                best = f
        if best and best[0] == len(y):
            break  # no later diagonal has more
    return best


def best_stretches(equal: np.ndarray, max_substituted: float, least: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of ``best_stretch`` of each row that has one."""
    rows = np.flatnonzero(equal.sum(1) >= (1 - max_substituted) * least - 1e-9)
    n = equal.shape[1]
    if n < least or not len(rows):
        return []
    lost = np.cumsum(~equal[rows], 1)
    score = max_substituted * np.arange(n + 1) - np.concatenate([np.zeros((len(rows), 1)), lost], 1)
    low = np.minimum.accumulate(score[:, :n + 1 - least], 1)
    gain = score[:, least:] - low
    top = (gain >= gain.max(1, keepdims=True) - 1e-9).argmax(1)
    each = np.arange(len(rows))
    kept = np.flatnonzero(gain[each, top] >= -1e-9)
    ends = (score[:, :n + 1 - least] <= low[each, top][:, None] + 1e-9) & (np.arange(n + 1 - least) <= top[:, None])
    start = n - least - ends[:, ::-1].argmax(1)
    return [(int(rows[k]), int(start[k]), int(top[k]) + least) for k in kept.tolist()]


def best_stretch(equal: np.ndarray, max_substituted: float, least: int = 0) -> tuple[int, int] | None:
    """The stretch of greatest score among those of ``least`` tokens or more, where
    an equal token gives the share of substitutions allowed and another takes the
    rest; None if each of them holds more substitutions than allowed.  A stretch of
    greater score that is too short hides no longer one."""
    n = len(equal)
    if n < least or equal.sum() < (1 - max_substituted) * least - 1e-9:
        return None
    score = max_substituted * np.arange(n + 1) - np.concatenate([[0], np.cumsum(~equal)])
    low = np.minimum.accumulate(score[:n + 1 - least])
    gain = score[least:] - low
    top = int((gain >= gain.max() - 1e-9).argmax())
    if gain[top] < -1e-9:
        return None
    start = int(np.flatnonzero(score[:top + 1] <= low[top] + 1e-9)[-1])
    return start, top + least


def benchmark_blocks(benchmark: DataFrame, item_id: Column, item_text: Column,
                     block_bytes: int) -> list[DataFrame]:
    """Items (item_id, _text) in blocks of about ``block_bytes`` of text, dealt by row: an
    item that repeats is spread like others."""
    items = benchmark.select(item_id.alias("item_id"), item_text.alias("_text")).where("_text is not null")
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    if blocks == 1:
        return [items]
    dealt = written(items.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "benchmark")
    return [dealt.where(F.col("_block") == b).drop("_block") for b in range(blocks)]


def _shared_index(block: DataFrame, least_item: int = 1):
    rows = sorted(map(tuple, block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return block.sparkSession.sparkContext.broadcast(
        SeedIndex.build([r for r in rows if len(tokens(r[1])) >= least_item]))


def contaminated(docs: DataFrame, doc_id: Column, text: Column, benchmark: DataFrame,
                 item_id: Column, item_text: Column, min_overlap: int = 13,
                 max_substituted: float = 0.2, block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each pair of document row and item that overlap: ``doc_id``,
    ``item_id``, ``matched`` and ``compared`` tokens of the best stretch,
    ``item_tokens``, ``doc_start`` and ``item_start`` (token places).

    A pair overlaps if, with the item laid over the document at some place, a
    stretch of ``min_overlap`` tokens or more (the whole item, if it is shorter)
    has a share of ``max_substituted`` substitutions at most, and a mask hits
    there; items shorter than a mask are found only where all their tokens stand.
    Of stretches with equally many matches the first diagonal's counts, and on it the
    last.  Null and empty texts overlap nothing; very long and repetitive texts are
    read whole, in memory that follows their length; repeated rows and repeated items
    give rows each; ids may be null.  Every item is reported, a single word too.
    ``block_bytes`` bounds the benchmark text sent to the tasks at once; each block
    reads the documents.
    """
    src = docs.select(doc_id.alias("doc_id"), text.alias("_text"))

    def hits(block: DataFrame) -> DataFrame:
        shared = _shared_index(block)
        fields = [T.StructField(n, T.LongType()) for n in (
            "matched", "compared", "item_tokens", "doc_start", "item_start")]
        schema = T.StructType([src.schema["doc_id"], block.schema["item_id"], *fields])
        item_type = to_arrow_type(block.schema["item_id"].dataType)

        def run(batches):
            index = shared.value
            filters = index.filters()
            for b in batches:
                for start, length in byte_slices(b.column(1), 8 << 20):
                    part = b.slice(start, length)
                    found = [(i, *row) for i, t in enumerate(part.column(1).to_pylist())
                             for row in index.overlaps(t, filters, min_overlap, max_substituted)]
                    at, ids, *numbers = list(zip(*found, strict=True)) or [()] * 7
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at, pa.int64())), pa.array(ids, item_type),
                         *(pa.array(n, pa.int64()) for n in numbers)], names=schema.names)

        return src.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, map(hits, benchmark_blocks(benchmark, item_id, item_text, block_bytes)))


def without_contaminated(docs: DataFrame, text: Column, benchmark: DataFrame, item_id: Column,
                         item_text: Column, min_overlap: int = 13, max_substituted: float = 0.2,
                         block_bytes: int = 8 << 20, least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows of ``docs`` that ``contaminated`` pairs with no item of ``least_item``
    tokens or more (a short answer such as a single word stands in too many texts 
    show a leak); no shuffle.  Between blocks the rows that are left are written."""
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    for block in blocks:
        shared = _shared_index(block, least_item)

        def make(shared=shared):
            index = shared.value
            filters = index.filters()
            return lambda texts: [pa.array([
                bool(index.overlaps(t, filters, min_overlap, max_substituted)) for t in texts], pa.bool_())]

        marked = map_texts(docs, [F.struct("*").alias("row")], text, make, "found boolean")
        docs = marked.where("not found").select("row.*")
        if len(blocks) > 1:
            docs = written(docs, "decontaminated")
    return docs
