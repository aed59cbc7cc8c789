"""Model files, boosting, bootstraps, capacity splits and exact laws against brute force."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgrain.operators import boosting, graph, nulls, predictors, ranking, resampling, stats, trees
from siftgrain.operators import dataset as ds
from siftgrain.plans import inference

RNG = np.random.default_rng(23)


# ---- model files


def one_by_one(text, row):
    """A plain reading of a model file: one row, node by node."""
    total, leaves = 0.0, []
    for part in text.split("\nTree=")[1:]:
        t = dict(x.split("=", 1) for x in part.split("end of trees")[0].split("\n") if "=" in x)
        nums = lambda k, t=t: [float(x) for x in t.get(k, "").split()]
        node = 0 if nums("split_feature") else -1
        while node >= 0:
            v, kind, cut = row[int(nums("split_feature")[node])], int(nums("decision_type")[node]), nums("threshold")[node]
            missing = kind >> 2
            if kind & 1:
                a, b = (int(nums("cat_boundaries")[int(cut) + i]) for i in (0, 1))
                words = [int(x) for x in nums("cat_threshold")][a:b]
                left = not math.isnan(v) and v >= 0 and int(v) // 32 < len(words) and bool(words[int(v) // 32] >> int(v) % 32 & 1)
            elif math.isnan(v) and missing == 2 or missing == 1 and (math.isnan(v) or abs(v) <= 1e-35):
                left = bool(kind & 2)
            else:
                left = (0.0 if math.isnan(v) else v) <= cut
            node = int(nums("left_child" if left else "right_child")[node])
        leaves.append(~node)
        total += nums("leaf_value")[~node]
    return total, leaves


def test_model_files(spark):
    model = trees.parsed(inference.MODEL)
    rows = []
    for _ in range(400):
        x = RNG.normal(0, 0.1, 66)
        x[63], x[64], x[65] = RNG.choice([0.01, 0.02, np.nan]), RNG.choice([np.nan, -1, 0, 1, 3, 5, 32, 33, 64, 3.9]), RNG.choice([0, 1e-36, 1, 2, np.nan])
        x[RNG.integers(0, 3)] = RNG.choice([np.nan, 0.0, 0.05, -0.1])
        rows.append(x)
    x = np.array(rows)
    assert model.predict(x)[:, 0].tolist() == [one_by_one(inference.MODEL, r)[0] for r in rows]
    data = [(i, [None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(rows)] + [(900, None), (901, []), (902, [*map(float, np.nan_to_num(rows[0])), 7.0])]
    df = spark.createDataFrame(data, "i int, features array<double>").repartition(3)
    got = {r.i: r.score for r in trees.predictor(model)(df).collect()}
    assert [got[i] for i in range(400)] == [one_by_one(inference.MODEL, r)[0] for r in rows]
    assert got[900] is None and got[901] == one_by_one(inference.MODEL, [math.nan] * 66)[0]
    assert trees.predictor(model)(df.limit(0)).count() == 0


def test_links_and_wrong_files(spark, tmp_path):
    text = inference.MODEL
    x = np.zeros((1, 66))
    raw = trees.parsed(text).predict(x)[0, 0]
    assert trees.parsed(text.replace("=regression", "=binary sigmoid:2")).predict(x)[0, 0] == pytest.approx(1 / (1 + math.exp(-2 * raw)))
    assert trees.parsed(text.replace("=regression", "=poisson")).predict(x)[0, 0] == pytest.approx(math.exp(raw))
    assert trees.parsed(text.replace("feature_names=none", "feature_names=none\naverage_output")).predict(x)[0, 0] == pytest.approx(raw / 4)
    two = trees.parsed(text.replace("num_tree_per_iteration=1", "num_tree_per_iteration=2").replace("=regression", "=multiclass num_class:2"))
    assert two.predict(x).sum() == pytest.approx(1) and two.raw(x)[0].sum() == pytest.approx(raw)
    df = spark.createDataFrame([([0.0] * 66,), (None,)], "features array<double>")
    assert [r.score and round(sum(r.score), 9) for r in trees.predictor(two)(df).collect()] == [1.0, None]
    for bad in ("forest", text.replace("is_linear=0", "is_linear=1"), text.replace("leaf_value=10", "leaf_value=1 2")):
        with pytest.raises(ValueError):
            trees.parsed(bad)
    (tmp_path / "m.txt").write_text(text)
    assert trees.load(spark, f"{tmp_path}/m.txt").root.tolist() == [0, 3, -8, 5]
    with pytest.raises(ValueError):
        trees.load(spark, f"{tmp_path}/m.txt", "0" * 64)


# ---- boosting


def test_lambdas():
    for _ in range(4):
        sizes = RNG.integers(1, 50, 30)
        n = int(sizes.sum())
        y, score = RNG.integers(0, 4, n).astype(float), RNG.integers(-3, 3, n) / 2.0
        g, h = boosting.lambdas(score, y, sizes)
        wanted_g, wanted_h, at = np.zeros(n), np.zeros(n), 0
        for m in sizes:
            rows = sorted(range(at, at + m), key=lambda i: (-score[i], i))
            best = sum((2 ** v - 1) / math.log2(i + 2) for i, v in enumerate(sorted(y[at : at + m], reverse=True)))
            for i, j in itertools.combinations(range(m), 2):
                a, b = rows[i], rows[j]
                if i >= boosting.TRUNCATION or y[a] == y[b]:
                    continue
                worth = abs(2 ** y[a] - 2 ** y[b]) * abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2)) / best
                up, down = (a, b) if y[a] > y[b] else (b, a)
                p = 1 / (1 + math.exp(score[up] - score[down]))
                wanted_g[up] -= p * worth
                wanted_g[down] += p * worth
                wanted_h[[a, b]] += p * (1 - p) * worth
            at += m
        assert np.allclose(g, wanted_g) and np.allclose(h, wanted_h)


def ranked_rows(spark, n=400):
    rows = []
    for g in range(n):
        for i in range(int(RNG.integers(1, 7))):
            x = RNG.normal(size=3)
            rows.append((g, i, [None if RNG.random() < 0.05 else float(v) for v in x], float(min(3, abs(x[0]) * 2 // 1)), g % 4 == 0))
    rows += [(0, 99, None, 1.0, False), (1, 99, [1.0, 2.0, 3.0], None, False)]
    return spark.createDataFrame(rows, "id int, i int, features array<double>, y double, valid boolean")


def held_accuracy(df):
    return ranking.intra_summary(df, "id", "i", "y", "score").first().mean_accuracy


def test_orders_beat_a_line(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 3)
    rows = ranked_rows(spark).cache()
    fitted = boosting.Booster(rows.repartition(5), group="id", valid="valid", settings=boosting.Settings("order", rate=0.3, depth=3)).train(8)
    again = boosting.Booster(rows.repartition(2), group="id", valid="valid", settings=boosting.Settings("order", rate=0.3, depth=3)).train(8)
    assert trees.written(fitted.ensemble(8)) == trees.written(again.ensemble(8))
    model = fitted.ensemble()
    fine = rows.filter("y is not null and features is not null")
    held = fine.filter("valid")
    mine = trees.predictor(model)(held)
    line = predictors.fit_pairwise(fine.filter("not valid").withColumn("features", F.transform("features", lambda x: F.coalesce(x, F.lit(0.0)))))
    theirs = line(held.withColumn("features", F.transform("features", lambda x: F.coalesce(x, F.lit(0.0)))))
    assert held_accuracy(mine) > 0.8 > held_accuracy(theirs) + 0.1
    # What it noted is what a count of pairs gives.
    pairs = ranking.pairs(mine, "id", "i", "y", "score").agg(F.avg(ranking.right())).first()[0]
    assert fitted.history[fitted.best()] == pytest.approx(pairs)


def test_numbers_and_written_models(spark):
    rows = ranked_rows(spark).filter("y is not null and features is not null")
    fitted = boosting.Booster(rows, valid="valid", settings=boosting.Settings(rate=0.5, depth=3, rows=0.8, features=0.7)).train(60, patience=4)
    assert len(fitted.trees) < 60 and len(fitted.history) == len(fitted.trees) + 1
    assert fitted.history[fitted.best()] == max(fitted.history) and len(fitted.trees) - fitted.best() >= 3
    model = fitted.ensemble()
    read = trees.parsed(trees.written(model))
    x = np.where(RNG.random((200, 3)) < 0.1, np.nan, RNG.normal(size=(200, 3)))
    assert read.predict(x).tolist() == model.predict(x).tolist()
    errors = trees.predictor(model)(rows.filter("valid")).agg(F.sqrt(F.avg((F.col("score") - F.col("y")) ** 2))).first()[0]
    assert -errors == pytest.approx(fitted.history[fitted.best()])
    assert errors < 0.6 * rows.filter("valid").agg(F.stddev_pop("y")).first()[0]


def test_halving(spark):
    rows = ranked_rows(spark).filter("y is not null and features is not null")
    trials = [boosting.Settings(rate=r, depth=2) for r in (0.01, 0.4, 0.2)]
    found, winner = boosting.halving(rows, trials, first=2, rounds=12, eta=2)
    assert [f["trial"] for f in found] == [0, 1, 2] and found[0]["trees"] == 2 and max(f["trees"] for f in found) == 12
    assert winner.settings == trials[max(found, key=lambda f: f["measure"])["trial"]]


def test_equal_rows_are_one_with_a_weight(spark):
    rows = ranked_rows(spark, 60).filter("y is not null and features is not null").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30)))).cache()
    setting = boosting.Settings(rate=0.5, depth=3, least_rows=40)
    mine = boosting.Booster(rows, valid="valid", settings=setting).train(3)
    kept = mine.table.collect()
    assert sum(r.n for r in kept) <= rows.count() / 30
    assert sum(int(np.frombuffer(r.weight, np.int64).sum()) for r in kept) == rows.count()
    # In groups rows stay as they are; trees and measures are the same.
    plain = boosting.Booster(rows, group="id", valid="valid", settings=setting).train(3)
    assert trees.written(mine.ensemble(3)) == trees.written(plain.ensemble(3)) and mine.history == pytest.approx(plain.history, rel=1e-12)
    # A draw of rows is a draw from weights.
    some = boosting.Booster(rows, valid="valid", settings=boosting.Settings(rate=0.5, depth=3, rows=0.5), data=mine.data).train(6)
    assert some.history[6] > some.history[0]


def test_sums_beyond_a_double():
    a = np.array([(1 << 54) + 1, 3, -(1 << 55) - 5, 7], np.int64)
    assert boosting.totals(np.array([0, 0, 2, 2]), a, 3).tolist() == [(1 << 54) + 4, 0, -(1 << 55) + 2]


def test_large_groups_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "GROUP_ROWS", 20)
    rows = ranked_rows(spark, 60).filter("y is not null and features is not null").withColumn("id", F.when(F.col("id") < 30, 0).otherwise(F.col("id")))
    fitted = boosting.Booster(rows, group="id", settings=boosting.Settings("order", depth=2, least_rows=5)).train(2)
    sizes = [s for r in fitted.table.collect() for s in np.frombuffer(r.sizes, np.int64)]
    assert sum(sizes) == rows.count() and max(sizes) < 45
    none = boosting.Booster(rows.limit(0), valid="valid", settings=boosting.Settings()).train(2).ensemble()
    assert none.predict(np.zeros((2, 0))).tolist() == [[0.0], [0.0]]


# ---- bootstraps


def test_weights_are_poisson():
    w = resampling.weights(np.arange(-50, 20_000), np.arange(60), 5)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    shares = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    assert np.allclose(shares, [math.exp(-1) / math.factorial(k) for k in range(5)], atol=0.003)
    for c in (np.corrcoef(w.T[:30]), np.corrcoef(w[:60])):
        assert np.abs(c - np.eye(len(c))).max() < (0.05 if len(c) == 30 else 0.6)
    assert not (w == resampling.weights(np.arange(-50, 20_000), np.arange(60), 6)).all()
    # Deviations of means are those of the law of large numbers.
    x = RNG.normal(size=20_050)
    means = (w * x[:, None]).sum(axis=0) / w.sum(axis=0)
    assert means.std() == pytest.approx(x.std() / math.sqrt(len(x)), rel=0.3)


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_poisson_means(spark, monkeypatch, cells):
    monkeypatch.setattr(resampling, "CELLS", cells)
    rows = [(i, float(RNG.normal()), None if i % 9 == 0 else float(i % 5), [None, "a", "b"][i % 3]) for i in range(90)] + [(5, 1.0, 2.0, "a"), (None, 1.0, 1.0, "a"), (91, math.nan, 1.0, "c")]
    df = spark.createDataFrame(rows, "k int, x double, y double, g string").repartition(4)
    fit = [r for r in rows if r[0] is not None and r[2] is not None and not math.isnan(r[1])]
    w = resampling.weights(np.array([r[0] for r in fit]), np.arange(17), 3)
    for r in resampling.poisson_means(df, "k", ["x", "y"], 17, 3).collect():
        mine = w[:, r.resample]
        assert r.n == mine.sum() and r.mean_x == pytest.approx(mine @ [f[1] for f in fit] / mine.sum()) and r.mean_y == pytest.approx(mine @ [f[2] for f in fit] / mine.sum())
    for r in resampling.poisson_means(df, "k", ["x", "y"], 17, 3, "g").collect():
        mine = w[:, r.resample] * np.array([f[3] == r.g for f in fit])
        assert r.n == mine.sum() and r.mean_y == pytest.approx(mine @ [f[2] for f in fit] / mine.sum())
    got = resampling.mean_difference(df, "k", "x", "y", 50, alternative="two-sided").first()
    assert got.n == len(fit) and got.low <= got.difference <= got.high and 0 <= got.p <= 1
    assert resampling.mean_difference(df.limit(0), "k", "x", "y", 5).first().n == 0


@pytest.mark.parametrize("parts, cells, together", [(1, 1 << 20, 256), (7, 60, 4), (40, 9, 256)])
def test_resampled_accuracy(spark, monkeypatch, parts, cells, together):
    monkeypatch.setattr(resampling, "CELLS", cells)
    monkeypatch.setattr(resampling, "TOGETHER", together)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, float(RNG.choice([0, 1, 1, 1, 2.5, 7, -3])), float(RNG.integers(0, 4)) if i % 3 else 2.0, float(RNG.normal())) for i in range(150)] + [(3, 1.0, 2.0, 2.0), (200, None, 1.0, 1.0), (201, 1.0, math.nan, 1.0), (202, 1.0, -0.0, 1.0), (203, 2.5, 0.0, 1.0)]
        df = spark.createDataFrame(rows, "k int, y double, a double, b double").repartition(3)
        got = resampling.resampled_accuracy(df, "k", "y", ["a", "b"], 9, 1).collect()
        fit = [r for r in rows if r[1] is not None and not math.isnan(r[2])]
        w = resampling.weights(np.array([r[0] for r in fit]), np.arange(9), 1)
        assert len(got) == 9
        for r in got:
            n, won = 0, [0, 0]
            for i, j in itertools.combinations(range(len(fit)), 2):
                if fit[i][1] != fit[j][1]:
                    m = int(w[i, r.resample] * w[j, r.resample])
                    n += m
                    for c in (0, 1):
                        won[c] += m * ((fit[i][2 + c] - fit[j][2 + c]) * (fit[i][1] - fit[j][1]) > 0)
            assert (r.n_pairs, round(r.accuracy_a * n), round(r.accuracy_b * n)) == (n, *won)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert resampling.resampled_accuracy(df.filter("y = 1"), "k", "y", ["a"], 3).count() == 0


def test_accuracy_tests(spark):
    rows = [(i, i // 4, i % 4, float(i % 4), float(i % 4 + RNG.normal(0, 0.3)), float(RNG.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, g int, o int, y double, a double, b double")
    got = {r.scope: r for r in resampling.accuracy_tests(df, "k", "g", "o", "y", "a", "b", 100).collect()}
    assert set(got) == {"intra", "global"} and all(r.p == 0 and 0.2 < r.low < r.difference < r.high < 0.7 for r in got.values())
    same = resampling.accuracy_tests(df.withColumn("b", F.col("a")), "k", "g", "o", "y", "a", "b", 20).collect()
    assert all(r.difference == 0 and r.p == 1 for r in same)


# ---- splits


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    links = [(int(a), int(b)) for a, b in RNG.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 640)] + [(700, i) for i in range(701, 760)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == union_find(links, linked)
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_capacity_split(spark):
    edges = [(i, f"a{int(RNG.integers(0, 600))}") for i in range(1000) for _ in range(2) if i % 5] + [(i, None) for i in range(0, 1000, 5)] + [(1, "a1"), (1, "a1")]
    df = spark.createDataFrame(edges, "id int, answer string").repartition(3)
    got = ds.leakage_free_split(df).collect()
    by_answer = defaultdict(list)
    for i, a in edges:
        if a:
            by_answer[a].append(i)
    wanted = union_find([(v[0], x) for v in by_answer.values() for x in v], {i for i, _ in edges})
    assert {r.id: r.component for r in got} == wanted
    split = {r.id: r.split for r in got}
    assert all(len({split[i] for i in v}) == 1 for v in by_answer.values())
    assert ds.disjoint(df.join(spark.createDataFrame(list(split.items()), "id int, split string"), "id"))


@pytest.mark.parametrize("sizes", [[1] * 200, [*range(1, 40)], [300, 20, 20, 5, 1, 1], []])
def test_packing(spark, sizes):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "component int, n int, other string")
    rows = ds.packed(df, {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
    full = Counter()
    for r in rows:
        full[r.split] += r.n
    total, end = sum(sizes), 0.0
    assert len(rows) == len(sizes) and sum(full.values()) == total
    for share, name in ((0.8, "train"), (0.1, "val")):
        end += share
        got = sum(full[n] for n in ("train", "val")[: 1 if name == "train" else 2])
        assert abs(got - end * total) <= max([0, *sizes]) / 2


# ---- exact laws


def test_signed_rank_law():
    for n in (1, 2, 5, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=n)]
        assert np.allclose(nulls.signed_rank_cdf(n), [np.mean([x <= w for x in sums]) for w in range(n * (n + 1) // 2 + 1)])
    assert nulls.signed_rank(0, 5, -2.02, 0, 0, "less") == pytest.approx(1 / 32) and nulls.signed_rank(15, 5, 2.02, 0, 0) == pytest.approx(2 / 32)
    assert nulls.signed_rank(20, 60, -1.0, 0, 0, "less") == pytest.approx(0.15865525)


def test_rank_sum_law():
    for n1, n0 in ((1, 4), (3, 5), (4, 4)):
        us = [sum(x) - n1 * (n1 + 1) // 2 for x in itertools.combinations(range(1, n1 + n0 + 1), n1)]
        wanted = [np.mean([x <= u for x in us]) for u in range(n1 * n0 + 1)]
        assert np.allclose(nulls.rank_sum_cdf(n1, n0), wanted) and np.allclose(nulls.rank_sum_cdf(n0, n1), wanted)
    assert nulls.rank_sum(0, 3, 5, 0) == pytest.approx(2 / 56) and nulls.rank_sum(15, 3, 5, 0, "less") == 1
    assert nulls.rank_sum(200, 20, 20, 0) == 1 and nulls.rank_sum(8, 4, 4, 504.0) == 1.0
    assert nulls.rank_sum(0, 3, 200_000, 0) < 0.01


def test_p_columns(spark):
    rows = [(1, 1.0), (1, 2.0), (1, -3.0), (2, 1.0), (2, -1.0), (2, 4.0), (3, 0.0), (3, 0.0), (4, 0.0), (4, 5.0), (5, None)]
    got = {r.g: r for r in stats.wilcoxon(spark.createDataFrame(rows, "g int, d double"), F.col("d"), ["g"], "less").collect()}
    assert set(got) == {1, 2, 4} and got[1].p == pytest.approx(5 / 8)
    assert got[2].p == pytest.approx(1 - nulls.normal_sf(got[2].z)) and got[4].p == pytest.approx(1 - nulls.normal_sf(1.0))
    flags = [(1, 1.0), (1, 2.0), (0, 3.0), (0, 4.0), (0, 5.0)]
    assert stats.mann_whitney(spark.createDataFrame(flags, "f int, v double"), "f", "v").first().p == pytest.approx(0.2)
    assert stats.mann_whitney(spark.createDataFrame(flags[:2], "f int, v double"), "f", "v").first().p is None


# ---- additive models


def test_gam_against_a_dense_hat_matrix(spark):
    from siftgrain.operators import gam

    x = RNG.uniform(-2, 3, (300, 2))
    y = np.sin(2 * x[:, 0]) + RNG.normal(0, 0.2, 300)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0), (1.0, math.nan, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    s = gam.sums(df, ["a", "b"], "y", 8)
    z = gam.basis(x, s.spans, 8)
    bend = np.diff(np.eye(8), 2, axis=0)
    p = np.eye(17) * gam.RIDGE * 300
    p[1:9, 1:9] += 0.6 * bend.T @ bend
    p[9:, 9:] += 0.6 * bend.T @ bend
    hat = z @ np.linalg.solve(z.T @ z + p, z.T)
    fit = gam.fit(s, 0.6)
    rss = ((y - hat @ y) ** 2).sum()
    assert fit.edf == pytest.approx(np.trace(hat), rel=1e-4) and fit.rss == pytest.approx(rss, rel=1e-6)
    assert fit.gcv == pytest.approx(300 * rss / (300 - np.trace(hat)) ** 2, rel=1e-4)
    assert fit.explained_deviance == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum(), rel=1e-6)
    best, alone = gam.fit(s), gam.fit(s.of(["b"]))
    assert best.gcv <= fit.gcv and best.p[0] < 1e-6 < 0.01 < best.p[1] and sum(best.term_edf) == pytest.approx(best.edf - 1, abs=0.2)
    assert gam.compared(alone, best)[1] < 1e-6 and gam.compared(gam.fit(s.of(["a"])), best)[1] > 0.01
    assert abs(math.sin(2 * best.curve("a")["peak"]) - 1) < 0.1
    assert gam.f_sf(4.0, 3, 20) == pytest.approx(0.02220, abs=2e-4) and gam.f_sf(0, 3, 20) == 1
    with pytest.raises(ValueError):
        gam.sums(df.limit(0), ["a"], "y")


# ---- cache and files


def test_cache_stays_where_it_is(spark, tmp_path):
    from siftgrain.operators.cache import ScoreCache, fingerprint

    cache = ScoreCache(spark, str(tmp_path), fingerprint(model="a"), 4)
    units = spark.createDataFrame([(f"u{i % 50}",) for i in range(80)], "unit string")
    for length in (30, 50):
        some = units.filter(F.col("unit").substr(2, 3).cast("int") < length)
        assert {r.unit: r.score for r in cache.score(some, predictors.length).collect()} == {f"u{i}": float(len(f"u{i}")) for i in range(length)}
    cache.upsert(spark.createDataFrame([("u1", 7.0), ("new", 8.0)], "unit string, score double"))
    again = ScoreCache(spark, str(tmp_path), fingerprint(model="a"), 4)
    assert {r.unit: r.score for r in again.read().collect()}["u1"] == 7.0 and again.rows().count() == 52
    again.compact()
    assert again.versions() == [1, 2] and again.rows().count() == 51 and {r.unit: r.score for r in again.read().collect()}["u1"] == 7.0
    assert again.misses(units.union(spark.createDataFrame([("other",)], "unit string"))).first().unit == "other"
    assert ScoreCache(spark, str(tmp_path), fingerprint(model="b"), 4).misses(units).count() == 50
    # Neither joins nor the latest rows move the cache.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for plan in (again.misses(spark.createDataFrame([(f"u{i}",) for i in range(5)], "unit string")), again.read()):
            lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
            scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
            above, depth = [], re.search(r"\w", lines[scan]).start()
            for x in reversed(lines[:scan]):
                if (at := re.search(r"\w", x).start()) < depth:
                    above, depth = [*above, x], at
            assert not any("Exchange" in x for x in above), lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows", [7, 1000])
def test_npy_files(spark, tmp_path, rows):
    from siftgrain.sources import arrays

    x = RNG.normal(size=(53, 3))
    np.save(tmp_path / "a.npy", x.astype(np.float32))
    np.save(tmp_path / "b.npy", (x * 100).astype(np.int16))
    (tmp_path / "c.txt").write_text("no")
    got = arrays.read_npy(spark, str(tmp_path), rows).collect()
    assert {(r.file, r.row): r.vector for r in got} == {**{("a.npy", i): v for i, v in enumerate(x.astype(np.float32).astype(float).tolist())}, **{("b.npy", i): v for i, v in enumerate((x * 100).astype(np.int16).astype(float).tolist())}}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i int, v array<double>").repartition(2)
    names = arrays.write_npy(df, "v", f"{tmp_path}/out", rows)
    back = arrays.read_npy(spark, f"{tmp_path}/out", 5).join(names, ["file", "row"]).collect()
    assert sorted((r.i, r.vector) for r in back) == list(enumerate(x.tolist()))
    assert names.select("file").distinct().count() == (2 if rows == 1000 else sum(-(-n // 7) for n in [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]))
    for raw in (b"nothing", (tmp_path / "a.npy").read_bytes()[:300]):
        (tmp_path / "d.npy").write_bytes(raw)
        with pytest.raises(Exception):
            arrays.read_npy(spark, f"{tmp_path}/d.npy").count()


def test_gzip_lines(spark, tmp_path):
    import gzip

    from siftgrain.sources import arrays

    with gzip.open(tmp_path / "a.jsonl.gz", "wb") as f:
        f.write(b'{"a": 1, "t": "x\xffy"}\n{"a": 2, "t": "\xc3\xa9\xc3"}\n{"a": 3\n\n\xfe\n{"a": "no", "t": "z"}\n{"t": null}\n')
    got = arrays.read_gzip_lines(spark, f"{tmp_path}/a.jsonl.gz", "a int, t string").collect()
    assert sorted(((r.a, r.t) for r in got), key=str) == [(1, "xy"), (2, "é"), (None, None)]


def test_draws_and_reports(spark):
    from siftgrain.operators import qa
    from siftgrain.operators import vectors as vc

    index = spark.createDataFrame([(i, 10 + i, [float(i), 1.0]) for i in range(3)], "position long, vec_id long, embedding array<double>")
    got = vc.drawn_anchors(index, 30).collect()
    assert sorted(r.j for r in got) == list(range(30)) and {r.vec_id for r in got} == {10, 11, 12}
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "k string, v int")
    assert [r.v for r in qa.in_order(rows, "k", ["c", "b"]).collect()] == [3, 1]
    with pytest.raises(KeyError):
        qa.in_order(rows, "k", ["z"])
    lines = spark.createDataFrame([("d", None, 1.0), ("d", None, 2.0)], "d string, answer_granularity double, question_granularity double")
    assert qa.overview_line(lines, "d").first().line == "d: Answer N/A - Question 1.5000" == qa.overview_lines(lines, "d").first().line
    x, a = RNG.normal(size=(5, 4)), RNG.normal(size=(6, 4))
    sims, order = vc.nearest_anchors(x, a, 3)
    assert (np.diff(sims) <= 0).all() and np.allclose(sims[0], (a[order[0]] @ x[0]) / np.linalg.norm(a[order[0]], axis=1) / np.linalg.norm(x[0]))
    vectors = spark.createDataFrame([(1, x[0].tolist()), (2, None)], "vec_id int, embedding array<double>")
    out = {r.vec_id: r.features for r in vc.features(vectors, spark.createDataFrame([(v,) for v in a.tolist()], "embedding array<double>"), "similarity", k=3).collect()}
    assert out[2] is None and np.allclose(out[1], sims[0])


# ---- regressions on rows that were held out


def newton(x, y):
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (y - p))
    return w


def test_logistic_regression(spark):
    x = RNG.normal(size=(400, 2))
    y = (RNG.random(400) < 1 / (1 + np.exp(-(0.5 + 1.2 * x[:, 0] - 0.7 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0, 1)], "k int, a double, b double, y int")
    coefficients, odds, _ = stats.logistic(df, ["a", "b"], "y")
    assert np.allclose(coefficients, newton(x, y)[1:], atol=1e-3) and np.allclose(odds, np.exp(coefficients))
    folds = {r.k: r.fold for r in stats.stratified_folds(df.filter("k < 900"), "y", "k", 4).collect()}
    fold, aucs = np.array([folds[i] for i in range(400)]), []
    for f in range(4):
        w = newton(x[fold != f], y[fold != f])
        score, t = x[fold == f] @ w[1:], y[fold == f]
        aucs.append(np.mean([(p > q) + (p == q) / 2 for p in score[t == 1] for q in score[t == 0]]))
        assert abs((fold == f).sum() - 100) <= 2 and abs(t.sum() - y.sum() / 4) <= 1
    got = stats.cross_validated_auc(df, ["a", "b"], "y", "k", 4)
    assert got == (pytest.approx(np.mean(aucs), abs=2e-3), pytest.approx(np.std(aucs), abs=2e-3))


def test_boosted_numbers_on_held_out_rows(spark):
    x = RNG.uniform(-1, 1, (600, 3))
    rows = [(i, v.tolist(), float(np.sign(v[0]) + (v[1] > 0.3))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, features array<double>, y double")
    scored = predictors.gbt(predictors.fit_gbt(df.filter("i < 400"), iterations=10, depth=3))(df.filter("i >= 400"))
    error, spread = scored.agg(F.sqrt(F.avg((F.col("score") - F.col("y")) ** 2)), F.stddev_pop("y")).first()
    assert error < 0.5 * spread


def test_files_are_resolved(spark, tmp_path):
    import hashlib

    from siftgrain.sources import files

    for place, text in (("a", "wrong"), ("b", "right")):
        (tmp_path / place).mkdir()
        (tmp_path / place / "m.txt").write_text(text)
    places, wanted = [f"{tmp_path}/{x}" for x in ("none", "a", "b")], hashlib.sha256(b"right").hexdigest()
    assert files.resolved(spark, "m.txt", places) == f"{tmp_path}/a/m.txt"
    assert files.resolved(spark, "m.txt", places, wanted) == f"{tmp_path}/b/m.txt"
    for name, sha in (("m.txt", "0" * 64), ("n.txt", None)):
        with pytest.raises(FileNotFoundError):
            files.resolved(spark, name, places, sha)


def test_a_batch_gives_its_chunks_one_at_a_time():
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"a", b"b", b"c"])], names=["chunk", "y"])
    held = boosting.chunk_rows(b)
    assert next(held) == {"chunk": 1, "y": b"a"} and list(held) == b.to_pylist()[1:]


def test_search_without_rounds_ends_by_patience(spark, monkeypatch):
    asked, real = [], boosting.halving
    monkeypatch.setattr(boosting, "halving", lambda *a, **b: asked.append(b) or real(*a, **b))
    rows = ranked_rows(spark, 60).filter("y is not null and features is not null").select("features", "y", "valid")
    monkeypatch.setattr(inference, "orders_to_rank", lambda *_: rows)
    found = {r.trial: r for r in inference.tree_search(spark, "").collect()}
    winner = min(found.values(), key=lambda r: r.place)
    # The winner's measure had stopped growing: no number of trees ended the search.
    assert asked[0]["rounds"] is None and winner.trees - winner.rounds >= asked[0]["patience"] and len(found) == 4
