"""Exact dedup, runs of repeated words and hard negatives against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import exact_dedup, hard_negatives, periodic_runs
from tillroll.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, row string, key string, bytes string, group_size string"


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, None, "r", "k", "b", "g") for r in rows], SCHEMA)


# Exact dedup ----------------------------------------------------------------

def brute_groups(rows):
    group = {}
    for i, t in rows:
        group.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = group[t or ""]
        known = [x for x in ids if x is not None]
        out.append((i, max(known) if known else None, len(ids)))
    return sorted(out, key=str)


def dedup(spark, rows, **kw):
    out = exact_dedup.exact_duplicates(frame(spark, rows), [F.col("doc_id"), F.col("text").alias("t")], F.col("doc_id"),
                                       F.col("text"), **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=str) == brute_groups(rows)
    stays = [r for r in out if r.kept]
    assert len(stays) == len({r[1] or "" for r in rows}) == len({r.t or "" for r in stays})
    assert all(r.doc_id == r.keep_id for r in stays)


EDGE_ROWS = [(3, "same"), (9, "same"), (9, "same"), (5, "same "), (None, "same"), (None, None), (None, ""), (4, None),
             (None, "lone"), (8, "\x00\x00"), (7, "\x00"), (6, "\x00\x00"), (10, "é" * 50), (11, "é" * 50),
             (12, "ab" * 5000), (13, "ab" * 5000), (14, "ab" * 4999 + "ba"), (15, "ab" * 5000 + "a")]


def test_groups_match_brute_force(spark):
    dedup(spark, EDGE_ROWS)


def test_huge_texts_in_small_chunks(spark):
    dedup(spark, EDGE_ROWS, chunk_bytes=64)


def test_equal_fingerprints_of_unlike_texts(spark):
    # Primes so small that most texts share a fingerprint: comparison tells them apart.
    rows = [(i, f"{i % 17:04d}") for i in range(120)] + [(500 + i, "x" * 100 + f"{i % 5}") for i in range(20)]
    dedup(spark, rows, moduli=(2, 3), chunk_bytes=16)


def test_fingerprints_compose():
    rng = random.Random(3)
    text = bytes(rng.randrange(256) for _ in range(1000))
    for r, m in zip(exact_dedup.BASES, exact_dedup.MODULI):
        plain = 0
        for b in text:
            plain = (plain * r + b) % m
        for size in (7, 64, 1000):
            parts = [(text[i:i + size], max(0, 1000 - i - size)) for i in range(0, 1000, size)]
            assert sum(exact_dedup.shifted(exact_dedup.chunk_value(c, r, m, size), a, r, m)
                       for c, a in parts) % m == plain


def test_a_third_of_the_rows_is_one_text(spark):
    dedup(spark, [(i, "hot" if i % 3 == 0 else f"t{i % 700}") for i in range(3000)])


def test_no_rows_no_groups(spark):
    dedup(spark, [])


def test_dedup_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r.doc_id: r for r in QUERIES["op11_exact_dedup"](spark, SF).collect()}
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out.values()), key=str) == brute_groups(
        [(d.doc_id, d.text) for d in docs])
    assert all(out[d.doc_id].text_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest() for d in docs)


# Runs of repeated words -----------------------------------------------------

def brute_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                seg = words[i:j + q]
                if not any(seg[d:] == seg[:-d] for d in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_collapsed(words, runs):
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    n = rng.randrange(0, 160)
    words = [f"{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(n)]
    for _ in range(rng.randrange(0, 4) if n > 8 else 0):
        p, a = rng.randrange(1, 1 + n // 4), rng.randrange(n)
        for i in range(a + p, min(n, a + rng.randrange(1, n))):
            words[i] = words[i - p]
    return words


def test_runs_match_brute_force():
    rng = random.Random(11)
    seen = 0
    for _ in range(600):
        words = repetitive(rng)
        got = periodic_runs.runs_of([w.encode() for w in words])
        assert got == brute_runs(words)
        seen += len(got)
    assert seen > 300


@pytest.mark.parametrize("tile", [16, 64])
def test_tiled_runs_match_brute_force(spark, tile):
    rng = random.Random(tile)
    rows = [(i, " ".join(repetitive(rng))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a b " * 30), (102, "x " * 300), (102, "x " * 300), (103, " \n\t "),
             (104, "\n".join("abcdefg" * 40))]
    out = periodic_runs.periodic_runs(frame(spark, rows), [F.col("doc_id")], F.col("text"), tile=tile)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in out.collect()), key=str)
    want = []
    for i, t in rows:
        words = (t or "").split()
        runs = brute_runs(words)
        want.append((i, len(words), runs, brute_collapsed(words, runs)))
    assert got == sorted(want, key=str)


def test_equal_hashes_of_unlike_words(monkeypatch):
    # A factor of zero makes all long windows look alike: comparison of words decides.
    monkeypatch.setattr(periodic_runs, "_multiplier", lambda level: np.uint64(0 if level > 1 else 1))
    rng = random.Random(2)
    for _ in range(60):
        words = repetitive(rng)
        got = periodic_runs.runs_of([w.encode() for w in words])
        assert got == brute_runs(words)


def test_very_long_text(spark):
    text = "w " * 300_000 + " ".join(f"u{i}" for i in range(20_000)) + " a b c" * 20_000
    out = periodic_runs.periodic_runs(frame(spark, [(1, text)]), [F.col("doc_id")], F.col("text")).first()
    assert [tuple(r) for r in out.runs] == [(0, 300_000, 1), (320_000, 60_000, 3)]
    assert out.n_words == 380_000 and len(out.kept_text.split()) == 1 + 20_000 + 3


def test_no_rows_no_runs(spark):
    assert periodic_runs.periodic_runs(frame(spark, []), [F.col("doc_id")], F.col("text")).collect() == []


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return [w.decode() for w in words]


def test_runs_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(out) == len(docs)
    found = 0
    for d in docs:
        words, r = planted(d.doc_id, d.text), out[d.doc_id]
        runs = brute_runs(words) if len(words) < 3000 else periodic_runs.runs_of([w.encode() for w in words])
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
        found += len(runs)
    assert found > 10


# Hard negatives -------------------------------------------------------------

def brute_negatives(rows, is_anchor, positives=5, negatives=3, band=(50, 95)):
    ok = [(i, v_id, [math.floor(256 * float(x)) for x in v], label) for i, (v_id, v, label) in enumerate(rows)
          if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []

    def tie(r):
        return (r[1] is None, r[1] or 0, r[0])

    for a in ok:
        if not is_anchor(a[1]):
            continue
        score = {r[0]: sum(x * y for x, y in zip(a[2], r[2])) for r in ok}
        ranked = sorted((r for r in ok if r[0] != a[0]), key=lambda r: (-score[r[0]], *tie(r)))
        for p in [r for r in ranked if r[3] == a[3]][:positives]:
            ps = score[p[0]]
            near = [r for r in ranked if r[3] != a[3] and band[0] * ps <= 100 * score[r[0]] <= band[1] * ps]
            out += [(a[1], p[1], k, r[1], ps, score[r[0]]) for k, r in enumerate(near[:negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "k", "p") for i, v, label in rows],
                               "vec_id long, embedding array<float>, label int, key string, planes string")
    out = hard_negatives.hard_negatives(df, F.col("vec_id"), F.col("embedding"), F.col("label"),
                                        F.col("vec_id") % 5 == 0, **kw)
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_vectors(seed, n, width=11, grid=8):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.randrange(-grid, 2 * grid) / grid)) for _ in range(width)], rng.randrange(3))
            for i in range(n)]


@pytest.mark.parametrize("blocks", [(8192, 256), (16, 3)])
def test_negatives_match_brute_force(spark, blocks):
    rows = some_vectors(1, 120)
    rows += [(1000, None, 1), (1005, rows[0][1], None), (1010, [1.0, None], 1), (1015, [float("nan")], 1),
             (1020, [float("inf")] * 11, 0), (1025, [], 2), (1030, [1.0, 0.5], 1), (None, rows[3][1], 1),
             (None, rows[4][1], 2), (10, rows[10][1], rows[10][2]), (11, rows[11][1], rows[11][2])]
    got = mined(spark, rows, candidates_a_block=blocks[0], anchors_a_block=blocks[1])
    assert got == brute_negatives(rows, lambda i: i is not None and i % 5 == 0)
    assert len(got) > 100


def test_many_ties(spark):
    rows = [(i, [0.5, 0.25] if i % 2 else [0.5, 0.375], i % 2 + i % 3) for i in range(60)]
    assert mined(spark, rows, candidates_a_block=7) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_few_positives_and_negative_scores(spark):
    rows = [(0, [1.0], 1), (5, [-1.0], 1), (7, [0.75], 2), (10, [0.5], 2), (15, [2.0], 3)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_no_vectors_no_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_lookups_are_exact():
    rng = np.random.default_rng(4)
    for top in (1, 300, 10 ** 6):
        anchors, rows = (rng.integers(-top, top + 1, (n, 24)) for n in (5, 700))
        planes = int(top).bit_length() + 1
        kind = hard_negatives.score_type(planes, 24)
        packed = hard_negatives.bit_planes(rows, planes)
        assert (hard_negatives.values_of(packed) == rows).all()
        got = hard_negatives.scores(hard_negatives.subset_sums(anchors, kind), packed)
        assert (got == rows @ anchors.T).all()
    with pytest.raises(ValueError):
        hard_negatives.score_type(40, 64)
