"""The three churn models: fits against brute force, layouts of the work that must not
change a fit, models as tables, and the leaderboard."""

import math
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.operators import boosting, churn, forest, logistic, models
from tillroll.operators.clean import clean_transactions
from tillroll.session import durable_checkpoint, scratch_path
from tillroll.sources.retail import load_retail


@pytest.fixture(scope="module")
def matrix(spark):
    feats = churn.churn_features(clean_transactions(load_retail(spark, "/root/testdata/sf0.01")),
                                 home="NATION_0")
    return durable_checkpoint(churn.feature_matrix(churn.stratified_split(feats)))


def small_matrix(spark, n=240, seed=5, hot=False):
    """Two features; ``hot``: a third of the rows are alike."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = (1.0, 2.0) if hot and i % 3 == 0 else (float(rng.integers(0, 40)), round(float(rng.normal()), 3))
        y = int(a + 8 * b + rng.normal() * 8 > 20)
        rows.append((i, a, b, y, float(y), int(i % 5 == 0), i % 5))
    return spark.createDataFrame(rows, "CustomerID long, a double, b double, Churned int, label double, is_test int, fold int")


AB = ["a", "b"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Forest ---------------------------------------------------------------------


def brute_gini(rows):
    """Greatest value of the split criterion over all features and cuts; rows of (bins,
    label, weight)."""
    best = None
    for f in range(len(rows[0][0])):
        for cut in sorted({r[0][f] for r in rows}):
            sides = [[r for r in rows if (r[0][f] <= cut) == left] for left in (True, False)]
            if not all(sides):
                continue
            value = 0.0
            for side in sides:
                n, pos = sum(r[2] for r in side), sum(r[1] * r[2] for r in side)
                value += (pos * pos + (n - pos) ** 2) / n
            if best is None or value > best[0]:
                best = (value, f, cut)
    return best


def test_splits_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 30))
        bins = rng.integers(0, 6, (n, 3)).astype(np.uint8)
        label, weight = rng.integers(0, 2, n), rng.integers(1, 4, n)
        out = forest.grow(1, 0, np.arange(n), label, weight, bins, tried=3, seed=7)
        rows = {1: [(tuple(b), int(y), int(w)) for b, y, w in zip(bins.tolist(), label, weight)]}
        for i, node in enumerate(out["node"].tolist()):
            here = rows[node]
            assert out["weight"][i] == sum(r[2] for r in here)
            assert out["positive"][i] == sum(r[1] * r[2] for r in here)
            want = brute_gini(here) if len({r[1] for r in here}) == 2 else None
            f, cut = int(out["feature"][i]), int(out["bin"][i])
            assert (f >= 0) == (want is not None)
            if f < 0:
                continue
            sides = [[r for r in here if (r[0][f] <= cut) == left] for left in (True, False)]
            value = sum((p * p + (w - p) ** 2) / w for w, p in
                        ((sum(r[2] for r in s), sum(r[1] * r[2] for r in s)) for s in sides))
            assert value == pytest.approx(want[0], rel=1e-12)
            rows[int(out["left"][i])], rows[int(out["right"][i])] = sides


@pytest.mark.parametrize("hot", [False, True])
def test_forest_is_the_same_by_levels_and_in_one_task(spark, hot):
    m = small_matrix(spark, hot=hot)
    found = [models.fit(models.FOREST, m, columns=AB, trees=2, local_rows=n) for n in (100_000, 30)]
    tables, scores = zip(*[(rows_of(f.table), rows_of(f.scores)) for f in found])
    assert tables[0] == tables[1] and len(tables[0]) > 50
    assert scores[0] == scores[1] and len(scores[0]) == 240


def test_rows_are_dealt_once_for_several_trees(spark):
    rng = np.random.default_rng(5)
    rows = [(f, i, int(y), bytes(b), (i + f) % 5 > 0) for f in (0, 1) for i, (y, b) in enumerate(
        zip(rng.integers(0, 2, 90), rng.integers(0, 9, (90, 3)).tolist()))]
    df = spark.createDataFrame(rows, "fit int, id long, label int, bins binary, is_train boolean").repartition(3)
    trees = 2 * forest.TASK_TREES + 2
    nodes, leaves = forest.grow_forests(df, trees, 3, 1, 7, node_fits=[0])
    by_level, one_by_one = forest.grow_forests(df, trees, 3, 1, 7, local_rows=20)
    assert leaves.count() == 3 * 36 and one_by_one.count() == trees * 36
    assert rows_of(nodes) == rows_of(by_level.where("fit = 0"))
    assert {r.tree for r in nodes.select("tree").distinct().collect()} == set(range(trees))
    assert rows_of(forest.forest_probability(leaves, trees)) == rows_of(forest.forest_probability(one_by_one, trees))


def test_bytes_of_rows_are_read_in_place():
    want = np.random.default_rng(9).integers(0, 256, (50, 4)).astype(np.uint8)
    column = pa.chunked_array([[bytes(x) for x in want[:20].tolist()], pa.array([], pa.binary()),
                               [bytes(x) for x in want[15:].tolist()]], pa.binary())
    column = pa.chunked_array([column.chunk(0), column.chunk(1), column.chunk(2).slice(5)])
    assert (forest.byte_rows(column) == want).all()
    assert (forest.byte_rows(pa.chunked_array([column.chunk(2)])) == want[20:]).all()


def test_planned_size_of_a_forest_does_not_multiply_by_level(spark):
    table = models.fit(models.FOREST, small_matrix(spark), columns=AB, trees=2, local_rows=20).table
    assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 40
    assert table.count() > 50


def test_class_sums_are_a_row_a_node_and_task(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), int(t), int(n), int(y), int(w), bytes(b)) for f, t, n, y, w, b in zip(
        rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.choice([1, -(1 << 62), 1 << 61], 400),
        rng.integers(0, 2, 400), rng.integers(0, 3, 400), rng.integers(0, 256, (400, 2)).tolist())]
    df = spark.createDataFrame(rows, "fit int, tree int, node long, label int, weight int, bins binary").repartition(3)
    found = forest._class_sums(df, 2).collect()
    want = {}
    for f, t, n, y, w, b in rows:
        if w:
            sums = want.setdefault((f, t, n), np.zeros((2, 2, 256), np.int64))
            sums[:, [0, 1], list(b)] += np.array([[w], [w * y]])
    assert len(want) <= len(found) <= 3 * len(want)
    got = {k: sum(np.frombuffer(r.weight + r.positive, np.int64) for r in found if (r.fit, r.tree, r.node) == k)
           for k in want}
    assert all((got[k].reshape(2, 2, 256) == want[k]).all() for k in want)


def test_features_after_those_tried_are_not_counted(monkeypatch):
    rng = np.random.default_rng(4)
    n, nodes, plain = 400, [], forest.best_cut
    bins, label = rng.integers(0, 256, (n, 10)).astype(np.uint8), rng.integers(0, 2, n)
    bins[:, 0] = 7  # splits no node, so that a node which meets it looks at one more

    def counted(slot, bin_, weight, positive, count):
        nodes.append(count)
        return plain(slot, bin_, weight, positive, count)

    monkeypatch.setattr(forest, "best_cut", counted)
    first = forest.priority(np.array([1]), 0, 7, 10)[0].tolist()
    forest.grow(1, 0, np.arange(n), label, np.ones(n, np.int64), bins, tried=3, seed=7)
    looked = 4 if 0 in first[:3] else 3
    assert nodes[:looked] == [1] * looked and nodes[looked] == 2


def test_cells_are_summed_alike_however_many_they_are():
    rng = np.random.default_rng(8)
    key, weight, label = rng.integers(0, 60, 300), rng.integers(1, 5, 300).astype(float), rng.integers(0, 2, 300)
    want = {}
    for k, w, y in zip(key.tolist(), weight, label):
        total, positive = want.get(k, (0, 0))
        want[k] = total + w, positive + w * y
    for size in (60, 1 << 40):  # the second is far more than an array could hold
        cell, total, positive = forest._cells(key, weight, label, size)
        assert cell.tolist() == sorted(want)
        assert dict(zip(cell.tolist(), zip(total, positive))) == want


def test_depth_has_no_ceiling():
    # Weights that fall by powers favour cutting off the ends: a deep chain.
    n = 250
    bins = np.arange(n, dtype=np.uint8)[:, None]
    label = np.arange(n) % 2
    weight = np.array([2.0 ** (50 - 50 * i / n) if i % 2 else 1.0 for i in range(n)]).astype(np.int64) + 1
    out = forest.grow(1, 0, np.arange(n), label, weight, bins, tried=1, seed=1)
    depth = {1: 0}
    for node, left, right in zip(out["node"].tolist(), out["left"].tolist(), out["right"].tolist()):
        if left:
            depth[left] = depth[right] = depth[node] + 1
    assert max(depth.values()) > 30


def test_draws_are_poisson(spark):
    d = spark.range(20_000).select(forest.poisson_draw("id", F.lit(3), 42).alias("w")).agg(
        F.avg("w"), F.var_samp("w"), F.max("w")).first()
    assert d[0] == pytest.approx(1, abs=0.03) and d[1] == pytest.approx(1, abs=0.05) and d[2] >= 5


def test_tasks_draw_as_spark_does(spark):
    ids = np.array([0, 1, -5, 1 << 40, -(1 << 63), (1 << 63) - 1, *range(100, 400)], np.int64)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long")
    for tree, seed in ((0, 42), (99, 7), (3, -1)):
        want = {r.id: r.w for r in df.select("id", forest.poisson_draw("id", F.lit(tree), seed).alias("w")).collect()}
        assert dict(zip(ids.tolist(), forest.draws(forest.hashed_ids(ids), tree, seed).tolist())) == want


def test_a_tree_is_the_same_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    n = 700
    bins, label = rng.integers(0, 20, (n, 4)).astype(np.uint8), rng.integers(0, 2, n).astype(np.uint8)
    bins[:, 1] = 3  # splits no node
    train = rng.random(n) < 0.8
    weight = np.where(train, rng.integers(0, 4, n), 0).astype(np.uint8)

    def rows():
        parts = list(forest.grow_tree(2, label, weight, train, bins, 2, 9))
        return len(parts), sorted(zip(*[np.concatenate([x[c] for x in parts]).tolist() for c in parts[0]]))

    whole = rows()
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 60)
    monkeypatch.setattr(forest, "SUM_ROWS", 50)
    parts = rows()
    assert whole[0] == 1 and parts[0] > 10 and parts[1] == whole[1]
    assert {r[7] for r in whole[1] if r[1] == -2} == set(np.flatnonzero(~train).tolist())


def test_fits_of_six_gigabytes_grow_without_a_table_of_rows_by_tree(spark, monkeypatch):
    """5.4 million customers grew by levels: every row written for every tree at every level."""
    made = []
    monkeypatch.setattr(forest, "written", lambda df: made.append(df) or df)
    rows = spark.createDataFrame([(0, 1, 1, b"\x01", True), (0, 2, 0, b"\x02", False)],
                                 "fit int, id long, label int, bins binary, is_train boolean")
    sizes = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2_700_000)))).drop("copy")
    forest.grow_forests(sizes, 100, 1, 1, 7)
    assert len(made) == 1
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("MapInArrow")  # blocks are dealt, not rows


def test_forest_scores_by_joins(spark):
    m = small_matrix(spark)
    fits = models.fit(models.FOREST, m, columns=AB, trees=8)
    joined = models.score_forest(fits.table, m.select("CustomerID", "a", "b", "is_test").where("is_test = 1"))
    want = {r.id: r.score for r in fits.scores.where("fit = 0").collect()}
    got = {r.CustomerID: r.ChurnProbability for r in joined.collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


# Boosted trees ----------------------------------------------------------------


def brute_round(values, label, margin, p):
    """The first tree of exact second-order boosting by recursion: leaf value of each row."""
    grad = [round((1 / (1 + math.exp(-m)) - y) * 2 ** 30) / 2 ** 30 for m, y in zip(margin, label)]
    hess = [round((1 / (1 + math.exp(-m))) * (1 - 1 / (1 + math.exp(-m))) * 2 ** 30) / 2 ** 30 for m in margin]
    out = [0.0] * len(label)

    def score(rows):
        return sum(grad[i] for i in rows) ** 2 / (sum(hess[i] for i in rows) + p.penalty)

    def grow(rows, depth):
        best = None
        for f in range(len(values[0])):
            for cut in sorted({values[i][f] for i in rows}):
                left = [i for i in rows if values[i][f] <= cut]
                right = [i for i in rows if values[i][f] > cut]
                if min(sum(hess[i] for i in left), sum(hess[i] for i in right)) < p.least_hessian:
                    continue
                gain = score(left) + score(right) - score(rows)
                if gain > p.least_gain and (best is None or gain > best[0] + 1e-12):
                    best = (gain, left, right)
        if best is None or depth == p.depth:
            for i in rows:
                out[i] = -p.step * sum(grad[j] for j in rows) / (sum(hess[j] for j in rows) + p.penalty)
            return
        grow(best[1], depth + 1)
        grow(best[2], depth + 1)

    grow(list(range(len(label))), 0)
    return out


def test_one_round_matches_brute_force(spark):
    m = small_matrix(spark)
    fits = models.fit(models.BOOSTED, m, columns=AB, rounds=1)
    train = [r for r in m.orderBy("CustomerID").collect() if not r.is_test]
    edges = models.bin_edges(m.where("is_test = 0"), AB)
    values = [[int(np.searchsorted(e, v)) for e, v in zip(edges, (r.a, r.b))] for r in train]
    leaves = brute_round(values, [r.Churned for r in train], [0.0] * len(train), boosting.BoostParams())
    got = {r.id: r.score for r in fits.all_scores.collect()}
    for r, leaf in zip(train, leaves):
        assert got[r.CustomerID] == pytest.approx(1 / (1 + math.exp(-leaf)), abs=1e-9)


def test_boosting_is_the_same_by_levels_and_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN_EVERY", 2)
    m = small_matrix(spark, hot=True)
    found = [models.fit(models.BOOSTED, m, columns=AB, rounds=5, local_rows=n, partitions=p)
             for n, p in ((100_000, 8), (10, 3), (10, 40))]
    tables, scores, every = zip(*[map(rows_of, (f.table, f.scores, f.all_scores)) for f in found])
    assert tables[0] == tables[1] == tables[2]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 240
    assert every[0] == every[1] == every[2]


def test_boosting_by_levels_sends_a_row_a_node_to_the_driver(spark, monkeypatch):
    m, sent = small_matrix(spark), []
    for name in ("collect", "toArrow", "toPandas"):
        def counted(self, f=getattr(type(m), name)):
            out = f(self)
            sent.append(len(out))
            return out
        monkeypatch.setattr(type(m), name, counted)
    fits = models.fit(models.BOOSTED, m, columns=AB, rounds=2, local_rows=10)
    assert 0 < sum(sent) <= 2 * 6 * 63 and max(sent) <= 6 * 32
    monkeypatch.undo()
    assert fits.all_scores.count() == 240


def test_a_task_chooses_the_splits_of_many_nodes(spark, monkeypatch):
    m, tasks, plain = small_matrix(spark), [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(m), "repartition", lambda self, n, *by: (
        all(isinstance(x, str) for x in by) and by == ("fit", "node") and tasks.append(n)) or plain(self, n, *by))
    models.fit(models.BOOSTED, m, columns=AB, rounds=1, local_rows=10, partitions=200)
    assert tasks[0] == 1 and max(tasks) <= 12


@pytest.mark.parametrize("layout", ["C", "F"])
def test_rows_find_their_nodes(layout):
    rng = np.random.default_rng(6)
    bins = np.array(rng.integers(0, 256, (200, 3)), np.uint8, order=layout)
    tree = boosting.Trees.empty(2, 3)
    tree.feature[1] = [2, -1, 0, -2, -2, 1, -1, -2, -2, -2, -2, -1, -1, -2, -2]
    tree.cut[1] = rng.integers(60, 200, 15)
    tree.level = 3
    want = []
    for row in bins.tolist():
        at = 0
        while tree.feature[1, at] >= 0:
            at = 2 * at + 1 + (row[tree.feature[1, at]] > tree.cut[1, at])
        want.append(at)
    assert tree.nodes_of(1, bins).tolist() == want and set(want) == {1, 6, 11, 12}


def test_rows_go_down_a_level():
    rng = np.random.default_rng(7)
    bins = np.array(rng.integers(0, 256, (200, 3)), np.uint8, order="F")
    tree, at = boosting.Trees.empty(1, 3), np.zeros(200, np.int64)
    splits = ([0], 2, 100), ([1, 2], 0, 90), ([4, 5], 1, 150)
    for nodes, feature, cut in splits:
        tree.feature[0, nodes], tree.cut[0, nodes] = feature, cut
        tree.level += 1
        at = tree.next_of(0, bins, at)
        assert at.tolist() == tree.nodes_of(0, bins).tolist()
    assert set(at.tolist()) == {3, 9, 10, 11, 12, 6}


def test_rows_that_a_task_can_hold_need_no_job_a_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_boost_by_levels", lambda *a: pytest.fail("a job a level"))
    rows = spark.range(150_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.expr(
        "unhex(lpad(hex(id % 251), 2, '0'))").alias("bins"), F.lit(b"\x01\x01").alias("train"))
    nodes, every = boosting.boost(rows, 2, 1, 8, boosting.BoostParams(rounds=2, depth=2))
    assert {(r.fit, r.tree) for r in nodes.collect()} == {(f, t) for f in (0, 1) for t in (0, 1)}
    assert every.count() == 300_000


def test_boosting_by_levels_counts_rows_once(spark, monkeypatch):
    m, counted, plain = small_matrix(spark), [], type(spark.range(1)).count
    monkeypatch.setattr(type(m), "count", lambda self: counted.append(1) or plain(self))
    fits = models.fit(models.BOOSTED, m, columns=AB, rounds=3, local_rows=10)
    assert len(counted) == 1
    assert plain(fits.all_scores) == 240


def test_model_table_roundtrip_scores_alike(spark, matrix):
    fits = models.fit(models.BOOSTED, matrix, rounds=6)
    path = models.save_model(fits.table, scratch_path(spark, "test_models", uuid.uuid4().hex))
    loaded = models.score_customers(models.load_model(spark, path), matrix)
    both = loaded.select(F.col("CustomerID").cast("long").alias("id"), "ChurnProbability").join(fits.all_scores, "id")
    assert both.count() == matrix.count()
    assert both.where("ChurnProbability <> score").count() == 0


def test_importances_are_mean_gains(spark, matrix):
    fits = models.fit(models.BOOSTED, matrix, rounds=3)
    imp = {r.Feature: r.Importance for r in models.feature_importances(fits.table, top=None).collect()}
    assert set(imp) == set(churn.FEATURE_COLUMNS) and sum(imp.values()) == pytest.approx(1.0)
    nodes = [r for r in fits.table.collect() if r.feature]
    mean = {f: np.mean([r.gain for r in nodes if r.feature == f]) for f in {r.feature for r in nodes}}
    for f in imp:
        assert imp[f] == pytest.approx(mean.get(f, 0.0) / sum(mean.values()))
    top = [r.Feature for r in models.feature_importances(fits.table).collect()]
    assert top == sorted(imp, key=lambda f: (-imp[f], f))[:5]


# Logistic regression ------------------------------------------------------------


def test_logistic_is_at_its_minimum(spark, matrix):
    fits = models.fit(models.LOGISTIC, matrix)
    train = matrix.where("is_test = 0").toPandas()
    x = train[churn.FEATURE_COLUMNS].to_numpy(float)
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    table = fits.table.toPandas()
    for fit in range(6):
        rows = slice(None) if fit == 0 else (train["fold"] != fit - 1).to_numpy()
        w = table[table["fit"] == fit]["coefficient"].to_numpy()
        p = 1 / (1 + np.exp(-x[rows] @ w))
        gradient = x[rows].T @ (p - train["label"].to_numpy()[rows]) + np.append(0, w[1:])
        assert np.abs(gradient).max() < 1e-6


def test_newton_step_reads_a_row_once_for_all_fits(spark, monkeypatch):
    read = []
    plain = logistic.fit_logistic
    monkeypatch.setattr(logistic, "fit_logistic", lambda rows, *a: read.append(rows.count()) or plain(rows, *a))
    models.fit(models.LOGISTIC, small_matrix(spark), columns=AB, steps=2)
    assert read == [240]


def test_newton_sums_match_rows_one_by_one():
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(30, 3)), rng.normal(size=(2, 3))
    y, train = rng.integers(0, 2, 30), rng.random((30, 2)) < 0.5
    found = logistic.newton_sums(x, y, train, w)
    for k in range(2):
        want = np.zeros((3, 4))
        for i in np.flatnonzero(train[:, k]):
            p = 1 / (1 + math.exp(-sum(x[i] * w[k])))
            want += np.column_stack([np.outer(x[i], x[i]) * p * (1 - p), x[i] * (p - y[i])])
        assert found[k] == pytest.approx(want)


def test_constant_columns_and_one_step(spark):
    m = small_matrix(spark).withColumn("c", F.lit(4.0))
    fits = models.fit(models.LOGISTIC, m, columns=["a", "c"], steps=1)
    w = {r.feature: r.coefficient for r in fits.table.where("fit = 0").collect()}
    train = [r for r in m.collect() if not r.is_test]
    a = np.array([r.a for r in train])
    x = np.column_stack([np.ones(len(a)), (a - a.mean()) / a.std(), np.zeros(len(a))])
    y = np.array([r.Churned for r in train])
    want = -np.linalg.solve(x.T @ x / 4 + np.diag([0, 1, 1]), x.T @ (0.5 - y))
    assert [w[None], w["a"], w["c"]] == pytest.approx(want.tolist())


# Leaderboard --------------------------------------------------------------------


def roc_auc(pairs):
    pos, neg = ([s for s, y in pairs if y == v] for v in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_leaderboard_of_fits(spark):
    m = small_matrix(spark)
    small = {models.LOGISTIC: {}, models.FOREST: {"trees": 5}, models.BOOSTED: {"rounds": 3}}
    scores = None
    for name, kw in small.items():
        each = models.fit(name, m, columns=AB, **kw).scores.withColumn("model", F.lit(name))
        scores = each if scores is None else scores.unionByName(each)
    scores = durable_checkpoint(scores)
    board = {r.model: r for r in models.leaderboard(scores).collect()}
    assert set(board) == set(models.MODEL_NAMES) and sum(r.is_best for r in board.values()) == 1
    fold_of = {r.CustomerID: 0 if r.is_test else r.fold + 1 for r in m.collect()}
    rows = scores.collect()
    assert all(r.fit == fold_of[r.id] for r in rows) and len(rows) == 3 * 240
    for name, r in board.items():
        each = [roc_auc([(x.score, x.label) for x in rows if x.model == name and x.fit == f]) for f in range(6)
                if any(x.fit == f for x in rows)]
        assert r.test_auc == pytest.approx(each[0])
        assert r.cv_mean == pytest.approx(np.mean(each[1:])) and r.cv_std == pytest.approx(np.std(each[1:]))
    assert board[max(board, key=lambda n: (board[n].test_auc, n))].is_best


def test_models_on_the_sales_beat_chance(spark, matrix):
    for name, kw in ((models.LOGISTIC, {}), (models.FOREST, {"trees": 20}), (models.BOOSTED, {"rounds": 5})):
        fits = models.fit(name, matrix, **kw)
        aucs = models.fit_aucs(fits.scores.withColumn("model", F.lit(name))).collect()
        assert len(aucs) == 6 and all(0.5 < r.auc <= 1 for r in aucs), name


def test_fit_does_not_depend_on_input_partitions(matrix):
    found = []
    for parts in (1, 7):
        fits = models.fit(models.FOREST, matrix.repartition(parts), trees=4)
        found.append(rows_of(fits.scores))
    assert found[0] == found[1]
    assert logistic.STEPS == 12
