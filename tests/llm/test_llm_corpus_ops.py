"""Operators over the whole corpus: repeats, copies, benchmark leaks, licences, mixing, pipeline."""

import hashlib
import random
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import components, decontaminate, license_scan, mixing, simhash, substring_dedup
from tillroll.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, copy string"


def frame(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with extra columns that clash."""
    full = [(*r, *[None] * (4 - len(r)), 1, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def prose(seed, n, words=2000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(words)}" for _ in range(n)]


# Substring dedup ----------------------------------------------------------

def brute_repeats(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (1 << 62 if i is None else i):
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), kept.decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [5, 50])
def test_repeats_match_brute_force(spark, window):
    passage, tail = prose(1, 70), prose(2, 64)
    rows = [(5, " ".join(passage)), (9, " ".join(prose(3, 17) + passage + prose(4, 9))),
            (2, " ".join(passage[3:60]) + "\n" + " ".join(tail)), (7, "\t".join(tail[1:])),
            (8, " ".join(tail[:49])), (11, "a " * 200), (12, "a " * 60), (12, "a " * 60), (3, None), (4, ""),
            (None, " ".join(passage)), (None, " ".join(prose(9, 55))), (13, " ".join(prose(5, 120)))]
    out = substring_dedup.without_repeats(frame(spark, rows), [F.col("doc_id")], F.col("doc_id"), F.col("text"), window)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    assert got == brute_repeats(rows, window)


def test_repeats_of_whole_table(spark, sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_repeats(rows, 50)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op4_substring_dedup"](spark, SF).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 0


def test_covers_hold_every_difference():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
        assert list(substring_dedup.at_cover(3 * period, period)[:len(cover)]) == list(cover)


def test_no_repeats_in_nothing(spark):
    out = substring_dedup.without_repeats(frame(spark, []), [F.col("doc_id")], F.col("doc_id"), F.col("text"))
    assert out.collect() == []


# SimHash ------------------------------------------------------------------

def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, max_bits):
    """doc id (null last) -> least id reachable; pairs of (id, fingerprint)."""
    group = list(range(len(pairs)))
    for i, j in ((i, j) for i in range(len(pairs)) for j in range(i)):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= max_bits:
            a, b = group[i], group[j]
            group = [b if g == a else g for g in group]
    least = {}
    for (i, _), g in zip(pairs, group):
        least[g] = min(least.get(g, 1 << 62), 1 << 62 if i is None else i)
    return sorted(((i, f"{f:016x}", None if least[g] == 1 << 62 else least[g])
                   for (i, f), g in zip(pairs, group)), key=str)


def test_near_duplicates_of_whole_table(spark, sf_docs):
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in sf_docs.collect()]
    got = QUERIES["op9_simhash_near_dup"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(pairs, 4)


def test_near_duplicate_edges(spark):
    text = " ".join(prose(1, 300))
    rows = [(3, None), (4, ""), (8, text), (6, text + " x"), (6, text + " x"), (None, text), (None, "only me and you"),
            (9, "Short"), (10, "short"), (11, "É é")]
    out = simhash.near_duplicates(frame(spark, rows), F.col("doc_id"), F.col("text"))
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out.collect()), key=str)
    assert got == brute_components([(i, brute_fingerprint(t)) for i, t, *_ in rows], 4)
    stay = simhash.one_of_each(frame(spark, rows), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in stay if r.doc_id is not None) == [
        (3, None), (6, text + " x"), (9, "Short"), (11, "É é")]
    assert [r.text for r in stay if r.doc_id is None] == ["only me and you"]
    assert simhash.near_duplicates(frame(spark, []), F.col("doc_id"), F.col("text")).collect() == []


def test_one_of_each_with_repeated_ids(spark):
    """Different texts under one id: each component is judged for itself."""
    a, b, c = (" ".join(prose(i, 300)) for i in (1, 2, 3))
    rows = [(1, a), (1, b), (2, b), (0, c), (1, c), (1, a), (None, a)]
    stay = simhash.one_of_each(frame(spark, rows), "doc_id", "text")
    assert stay.columns == frame(spark, rows).columns
    assert sorted((r.doc_id, r.text) for r in stay.collect()) == sorted([(1, a), (1, b), (0, c)])


@pytest.mark.parametrize("max_bits,list_size", [(4, 4096), (4, 3), (3, 2), (1, 2), (0, 4096)])
def test_links_join_every_linked_pair(spark, max_bits, list_size):
    rng = random.Random(max_bits)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for s in seeds for _ in range(15)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df, max_bits, list_size).collect()]
    assert all((a ^ b).bit_count() <= 2 * max_bits for a, b in found)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    want = brute_components(list(enumerate(fps)), max_bits)
    label = {f"{f:016x}": root(f) for f in fps}
    for (_, fa, ca), (_, fb, cb) in zip(want, want[1:]):
        assert (ca == cb) == (label[fa] == label[fb])


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)] + [(300, 300 + i) for i in range(1, 40)]
    random.Random(0).shuffle(edges)
    got = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100, **{300 + i: 300 for i in range(1, 40)}}


# Decontamination ----------------------------------------------------------

def brute_overlap(doc, item, least=13, share=0.2):
    x, y = decontaminate.tokens(doc), decontaminate.tokens(item)
    for d in range(-len(y) + 1, len(x)):
        eq = [x[d + i] == w if 0 <= d + i < len(x) else None for i, w in enumerate(y)]
        for i in range(len(y)):
            for j in range(i + min(least, len(y)), len(y) + 1):
                part = eq[i:j]
                if None not in part and part.count(False) <= share * len(part) and part[0] and part[-1]:
                    return True
    return False


def test_overlaps_tolerate_substitutions(spark):
    item = prose(1, 30)
    swapped = [w if i % 9 else "zz" for i, w in enumerate(item)]
    rows = [(1, " ".join(prose(2, 40) + item + prose(3, 10))), (2, " ".join(swapped).upper()),
            (3, ", ".join(item[4:18])), (4, " ".join(item[:9])), (5, " ".join(prose(4, 500))), (6, None), (7, ""),
            (8, "short one"), (8, "A short, one!"), (None, " ".join(item)), (9, " ".join(item[::-1]))]
    bench = [(10, " ".join(item)), (11, None), (12, ""), (13, "a short one"), (13, " ".join(prose(6, 25)))]
    docs = frame(spark, rows)
    items = spark.createDataFrame(bench, "item_id long, text string")
    for block in (8 << 20, 100):
        hits = decontaminate.contaminated(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"),
                                          F.col("text"), block_bytes=block).collect()
        want = sorted(((i, k) for i, t, *_ in rows for k, b in bench
                       if decontaminate.tokens(b) and brute_overlap(t, b)), key=str)
        assert sorted(((r.doc_id, r.item_id) for r in hits), key=str) == want
        clean = decontaminate.without_contaminated(docs, F.col("text"), items, F.col("item_id"), F.col("text"),
                                                   block_bytes=block)
        assert clean.columns == docs.columns
        assert sorted((r.doc_id for r in clean.collect()), key=str) == [4, 5, 6, 7, 8, 9]
    none = decontaminate.contaminated(docs, F.col("doc_id"), F.col("text"), items.limit(0), F.col("item_id"), F.col("text"))
    assert none.collect() == []


def test_whole_table_against_plain_containment(spark, sf_docs):
    bench = {r.item_id: decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    inside = set()
    for r in sf_docs.collect():
        t = b" " + b" ".join(decontaminate.tokens(r.text)) + b" "
        inside |= {(r.doc_id, k) for k, w in bench.items() if b" " + b" ".join(w) + b" " in t}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op8_benchmark_decontamination"](spark, SF).collect()}
    assert inside and inside <= set(got)
    assert all(got[k].matched == len(bench[k[1]]) for k in inside)


def test_masks_hit_what_they_promise():
    def hit(n, gone):
        return any(all(s + i not in gone for i, c in enumerate(m) if c == "1")
                   for m in decontaminate.MASKS for s in range(n - len(m) + 1))
    assert all(hit(13, {i}) for i in range(13))
    assert all(hit(15, {i, j}) for i in range(15) for j in range(i))


def test_best_stretch_is_the_greatest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        eq = rng.random(rng.integers(1, 20)) < 0.7
        score = np.where(eq, 0.2, -0.8)
        i, j = decontaminate.best_stretch(eq, 0.2)
        best = max([0, *(score[a:b].sum() for a in range(len(eq)) for b in range(a + 1, len(eq) + 1))])
        assert score[i:j].sum() == pytest.approx(best)


def planted(rng, n, subs):
    """An item, and a document with ``n`` of its tokens, ``subs`` of them substituted."""
    item = [f"i{k}" for k in range(n + 6)]
    at = rng.randrange(7)
    part = item[at:at + n]
    for k in rng.sample(range(n), subs):
        part[k] = f"s{k}"
    doc = [f"d{k}" for k in range(30)] + part + [f"e{k}" for k in range(30)]
    return " ".join(doc), " ".join(item)


@pytest.mark.parametrize("n,subs", [(13, 1), (15, 2), (25, 4), (30, 4)])
def test_no_overlap_hides_behind_a_shorter_one(n, subs):
    rng = random.Random(n)
    for _ in range(100):
        doc, item = planted(rng, n, subs)
        index = decontaminate.SeedIndex.build([(1, item)])
        found = index.overlaps(doc, index.filters(), 13, 0.2)
        assert len(found) == 1 and found[0][2] >= 13 and found[0][1] >= 0.8 * found[0][2]


def test_random_overlaps_match_brute_force():
    rng = random.Random(3)
    answers = set()
    for _ in range(1000):
        n = rng.randrange(8, 31)
        equal = np.array([rng.random() < 0.75 for _ in range(n)])
        x = [f"i{k}" if e else f"s{k}" for k, e in enumerate(equal)]
        item = " ".join(f"i{k}" for k in range(n))
        want = any(5 * (~equal[i:j]).sum() <= j - i for i in range(n) for j in range(i + 13, n + 1))
        got = decontaminate.best_stretch(equal, 0.2, 13)
        assert (got is not None) == want
        assert got or not (n >= 13 and brute_overlap(" ".join(x), item))
        if got:
            i, j = got
            assert j - i >= 13 and 5 * (~equal[i:j]).sum() <= j - i
        answers.add(want)
    assert answers == {True, False}


# Licences -----------------------------------------------------------------

def test_licences_are_found_and_inherited(spark):
    apache, mit = license_scan.TEMPLATES["Apache-2.0"], license_scan.TEMPLATES["MIT"]
    filler = "lorem ipsum dolor sit amet consectetur " * 5
    rows = [(1, "a/LICENSE", apache), (2, "a/x.py", filler), (3, "a/b/y.py", filler + "\n" + mit), (4, "a/b/z.py", None),
            (5, "c/w.py", ""), (6, None, mit), (7, "a/b/c/d.py", filler), (8, "top.py", filler), (1, "a/LICENSE", apache),
            (9, "a/bc/v.py", "licensed"), (10, "a/b/COPYING", mit.upper())]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    out = license_scan.licences(df, F.col("id"), F.col("path"), F.col("text")).collect()
    assert len(out) == len(rows)
    got = {r.id: (r.header, r.covers, r.inherited, r.inherited_from, r.licence) for r in out}
    assert got[1] == ("Apache-2.0", "Apache-2.0", "Apache-2.0", "a", "Apache-2.0")
    assert got[2] == (None, None, "Apache-2.0", "a", "Apache-2.0")
    assert got[3] == ("MIT", None, "MIT", "a/b", "MIT")
    assert got[4] == got[7] == (None, None, "MIT", "a/b", "MIT")
    assert got[5] == got[8] == (None, None, None, None, None)
    assert got[6] == ("MIT", "MIT", None, None, "MIT")
    assert got[9] == (None, None, "Apache-2.0", "a", "Apache-2.0")
    assert license_scan.licences(df.limit(0), F.col("id"), F.col("path"), F.col("text")).collect() == []


# Mixing -------------------------------------------------------------------

def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50), ("é", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert all(got[s] <= 2 * n for s, n in [("a", 10), ("b", 100), ("c", 1000), (None, 50), ("é", 0)])
    assert sum(got.values()) == pytest.approx(1.5 * 1160)
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 100 and got["é"] == 0
    assert got["c"] == pytest.approx(1740 - 320)


def test_mix_edges(spark):
    rows = [(i, "w " * (i % 7), None, "s" if i % 3 else None) for i in range(60)] + [(1, "w", None, "s")] * 2 + [
        (None, "w w", None, "s"), (70, None, None, "empty"), (71, "", None, "empty")]
    docs = frame(spark, rows)
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).cast("long")
    out = mixing.mix(docs, F.col("doc_id"), F.col("source"), size).collect()
    again = mixing.mix(docs.repartition(7), F.col("doc_id"), F.col("source"), size).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    assert len(out) == len(rows) and all(0 <= r.copies <= 2 and r.taken == r.size * r.copies for r in out)
    for s in ("s", None, "empty"):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * max(r.size for r in mine)
    mixed = mixing.mixed(docs, "doc_id", "source", size)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(docs.limit(0), F.col("doc_id"), F.col("source"), size).collect() == []
    assert mixing.mixed(docs.limit(0), "doc_id", "source", size).collect() == []


# Pipeline -----------------------------------------------------------------

def test_pipeline_stages_take_effect(spark, sf_docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "secrets", "source_mix"]
    docs, ids = sf_docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns == [*sf_docs.columns, *(["copy"] if k == 4 else [])]
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    near = {r.doc_id: r.component_id for r in QUERIES["op9_simhash_near_dup"](spark, SF).collect()}
    assert {i for i in ids[0] if near[i] == i} <= ids[1]
    assert len({near[i] for i in ids[1]}) == len({near[i] for i in ids[0]})
    leaks = {r.doc_id for r in QUERIES["op8_benchmark_decontamination"](spark, SF).collect()}
    assert ids[2] == ids[1] - leaks
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op3_secret_scan']}) WHERE spans <> ''").fetchall()}
    assert ids[3] == ids[2] - found
    total = sum(len(r.text.split()) for r in docs.collect())
    base = spark.read.parquet(str(tmp_path / "secrets"))
    assert total == pytest.approx(1.5 * sum(len(r.text.split()) for r in base.collect()), rel=0.1)


def test_pipeline_on_odd_tables(spark):
    odd = frame(spark, [(1, "the cat and the dog", None, None), (1, "the cat and the dog"), (2, None), (None, "a cat sat"),
                        (3, "token = abcdef123456", "en", "s"), (4, "the long " * 500, "en", "s")])
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns  # the last replaces the column called copy
            out.collect()


# Repetitive texts and short items of the benchmark ------------------------------


def test_a_million_equal_tokens_take_seconds():
    item = " ".join(["na"] * 20 + ["bat", "man"] + ["na"] * 8)
    index = decontaminate.SeedIndex.build([(1, item), (2, " ".join(["na"] * 30)), (3, " ".join(prose(1, 30)))])
    filters = index.filters()
    began = time.monotonic()
    found = index.overlaps("na " * 1_000_000, filters, 13, 0.2)
    assert time.monotonic() - began < 30
    assert [(f[0], f[1], f[4]) for f in found] == [(1, 20, 0), (2, 30, 0)]


def test_stretches_of_rows_match_single_ones():
    rng = np.random.default_rng(3)
    for n in (5, 13, 14, 40):
        equal = rng.random((200, n)) < rng.random((200, 1))
        want = [(r, *s) for r, row in enumerate(equal) if (s := decontaminate.best_stretch(row, 0.2, min(13, n)))]
        assert decontaminate.best_stretches(equal, 0.2, min(13, n)) == want


def test_repetitive_texts_match_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        words = [f"v{rng.randrange(3)}" for _ in range(6)]
        item = [rng.choice(words) for _ in range(rng.randrange(10, 30))]
        doc = [rng.choice(words) for _ in range(rng.randrange(0, 20))] + item * rng.randrange(0, 3)
        doc += [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        index = decontaminate.SeedIndex.build([(1, " ".join(item))])
        x = np.array([index.vocabulary.get(w.encode(), 0) for w in doc], np.int64)
        y = index.items[0][1]
        hits = index._hits(x, index.filters())
        places = {a - p for at, p in hits.get(0, []) for a in at.tolist()}
        best = None
        for d in sorted(places):
            start, stop = max(0, -d), min(len(y), len(x) - d)
            equal = x[start + d:stop + d] == y[start:stop]
            if s := decontaminate.best_stretch(equal, 0.2, min(13, len(y))):
                same = int(equal[s[0]:s[1]].sum())
                if best is None or same > best[0]:
                    best = (same, s[1] - s[0], start + d + s[0], start + s[0])
        got = index.overlaps(" ".join(doc), index.filters(), 13, 0.2)
        assert [(f[1], f[2], f[4], f[5]) for f in got] == ([best] if best else [])


def test_short_items_are_reported_and_remove_nothing(spark):
    rows = [(1, "Yes, it was so."), (2, "no"), (3, " ".join(prose(7, 20)))]
    items = spark.createDataFrame([(1, "yes"), (2, "no no"), (3, "it was so"), (4, "x " * 400_000)], "item_id long, text string")
    docs = frame(spark, rows)
    hits = decontaminate.contaminated(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))
    assert sorted((r.doc_id, r.item_id) for r in hits.collect()) == [(1, 1), (1, 3)]
    kept = decontaminate.without_contaminated(docs, F.col("text"), items, F.col("item_id"), F.col("text"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    same = spark.createDataFrame([(9, " ".join(prose(8, 40)))] * 50, "item_id long, text string")
    blocks = decontaminate.benchmark_blocks(same, F.col("item_id"), F.col("text"), 1000)
    sizes = [b.count() for b in blocks]
    assert len(blocks) > 5 and sum(sizes) == 50 and max(sizes) < 20


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_broadcast_no_table_of_the_rows(spark, monkeypatch):
    """70 keys a fingerprint were counted as large as the fingerprints and sent to the driver."""
    plans = []

    def seen(df, name, real=simhash.written):
        plans.append(plan_of(df))
        return real(df, name)

    for module in (simhash, components):
        monkeypatch.setattr(module, "written", seen)
    docs = frame(spark, [(i, " ".join(prose(i % 7, 40)), "en", "web") for i in range(12)])
    plans.append(plan_of(simhash.near_duplicates(docs, F.col("doc_id"), F.col("text"))))
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == set(range(7))
    plans.append(plan_of(kept))
    assert any("Generate explode" in p and "SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_mix_broadcasts_no_table_of_the_rows(spark, monkeypatch):
    """The ranked rows and the copies of each row were small enough by the planner's count."""
    plans = []

    def seen(df, name, real=mixing.written):
        plans.append(plan_of(df))
        return real(df, name)

    monkeypatch.setattr(mixing, "written", seen)
    docs = frame(spark, [(i, " ".join(prose(i, 9)), "en", f"s{i % 3}") for i in range(9)])
    plans.append(plan_of(corpus_pipeline.source_mix(spark, docs, SF)))
    assert not [p for p in plans if "BuildLeft" in p]
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in plans[-1]
