"""Evaluation, associations, importance, classifiers."""

from __future__ import annotations

import math
import random
import statistics
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from fleetcast.functions.significance import chi2_tail
from fleetcast.operators import evaluate, explain, models
from fleetcast.operators.association import chi2_cramer, kruskal
from fleetcast.operators.conform import column_roles
from tests.helpers import by

# 30 alarms in 10 steps of score; the higher the step, the more of its three are real
ALARMS = [(int(k < step // 3), step / 20) for step in range(10) for k in range(3)]


def scored(spark):
    return spark.createDataFrame(ALARMS, "y int, score double")


def test_curve_equals_direct_metrics(spark, chunks):
    curve = by(evaluate.pr_curve(scored(spark), "y", "score"), "threshold")
    assert [r["threshold"] for r in curve] == [step / 20 for step in range(10)]
    real = [step // 3 for step in range(10)]  # per step
    for step, r in enumerate(curve):
        hit, shown, all_real = sum(real[step:]), 3 * (10 - step), sum(real)
        assert (r["precision"], r["recall"]) == pytest.approx((hit / shown, hit / all_real))
        for beta, name in ((1, "f1"), (2, "f2")):
            assert r[name] == pytest.approx((1 + beta**2) * hit / (beta**2 * all_real + shown))


def test_best_threshold_takes_the_lowest_on_ties(spark):
    curve = spark.createDataFrame(
        [(0.81, 1.0, 0.1, 0.18, 0.12), (0.33, 0.4, 0.7, 0.51, 0.61), (0.12, 0.3, 1.0, 0.46, 0.68), (0.47, 0.5, 0.52, 0.51, 0.52), (0.05, 0.3, 1.0, 0.46, 0.68)],
        "threshold double, precision double, recall double, f1 double, f2 double",
    )
    assert [evaluate.best_threshold(curve, m).first()["threshold"] for m in ("f1", "f2", "precision")] == [0.33, 0.05, 0.81]


def test_average_precision_and_auc_with_ties(spark, chunks):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), rng.randrange(6) / 5) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, score double")
    pos = sum(y for y, _ in rows)
    ap = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(y for y, s in rows if s >= t)
        ap += sum(y for y, s in rows if s == t) / pos * tp / sum(s >= t for _, s in rows)
    assert evaluate.average_precision(df, "y", "score").first()[0] == pytest.approx(ap)
    wins = sum(
        1.0 if a > b else 0.5 if a == b else 0.0 for y, a in rows if y for z, b in rows if not z
    )
    assert evaluate.roc_auc(df, "y", "score").first()[0] == pytest.approx(wins / (pos * (200 - pos)))


def test_confusion_and_degenerate_cases(spark):
    # from 0.3 on: steps 6 to 9 with 2, 2, 2 and 3 real of 3; before: 1, 1, 1 in steps 3 to 5
    r = evaluate.confusion(scored(spark), "y", "score", 0.3).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (9, 3, 3, 15)
    none = evaluate.confusion(scored(spark), "y", "score").first()  # 0.5 is above all scores
    assert (none["precision"], none["recall"], none["f1"], none["tn"], none["fn"]) == (0.0, 0.0, 0.0, 18, 12)
    one_class = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, score double")
    assert evaluate.roc_auc(one_class, "y", "score").first()[0] is None
    assert evaluate.class_weights(one_class, "y").first()["scale_pos_weight"] == 1.0
    table = by(evaluate.threshold_table(scored(spark), "y", "score", [0.45, 0.0, 0.15]), "threshold")
    assert [(r["tp"], r["fp"]) for r in table] == [(12, 18), (12, 9), (3, 0)]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    r = evaluate.class_weights(df, "y").first()
    assert (r["scale_pos_weight"], r["weight_pos"]) == (3.0, 2.0)
    assert r["weight_neg"] == pytest.approx(8 / 12)


# --- association --------------------------------------------------------------------------------


def test_chi2_tail_against_published_values():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert chi2_tail(0.0, 3) == 1.0 and math.isnan(chi2_tail(1.0, 0))
    assert chi2_tail(200.0, 2) == pytest.approx(math.exp(-100), rel=1e-9)


def test_chi2_on_a_known_table(spark, chunks):
    cells = {("a", "x"): 10, ("a", "y"): 10, ("a", "z"): 20, ("b", "x"): 20, ("b", "y"): 20, ("b", "z"): 20}
    rows = [k for k, n in cells.items() for _ in range(n)]
    r = chi2_cramer(spark.createDataFrame(rows, "g string, h string"), "g", "h").first()
    assert r["chi2"] == pytest.approx(2.7777777777777777) and r["dof"] == 2
    assert r["p_chi2"] == pytest.approx(0.24935220877729622)
    assert 0 <= r["cramers_v"] <= 1 and r["n_low_expected"] == 0


def test_chi2_two_by_two_uses_the_continuity_correction(spark):
    cells = {("a", "x"): 12, ("a", "y"): 5, ("b", "x"): 3, ("b", "y"): 9}
    rows = [k for k, n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, h string")
    n, expect = 29, {}
    for g, h in cells:
        expect[g, h] = sum(v for k, v in cells.items() if k[0] == g) * sum(v for k, v in cells.items() if k[1] == h) / n
    want = sum((abs(cells[k] - expect[k]) - 0.5) ** 2 / expect[k] for k in cells)
    assert chi2_cramer(df, "g", "h").first()["chi2"] == pytest.approx(want)
    plain = sum((cells[k] - expect[k]) ** 2 / expect[k] for k in cells)
    assert chi2_cramer(df, "g", "h", yates=False).first()["chi2"] == pytest.approx(plain)


def test_chi2_counts_empty_and_low_cells(spark, chunks):
    rows = [("a", "x")] * 30 + [("b", "y")] * 4 + [("c", "x")] * 2
    r = chi2_cramer(spark.createDataFrame(rows, "g string, h string"), "g", "h").first()
    n, gs, hs = 36, {"a": 30, "b": 4, "c": 2}, {"x": 32, "y": 4}
    obs = {("a", "x"): 30, ("b", "y"): 4, ("c", "x"): 2}
    e = {(g, h): gs[g] * hs[h] / n for g in gs for h in hs}
    assert r["chi2"] == pytest.approx(sum((obs.get(k, 0) - v) ** 2 / v for k, v in e.items()))
    assert r["n_low_expected"] == sum(v < 5 for v in e.values())


def test_kruskal_with_ties(spark, chunks):
    groups = {"a": [1, 3, 5, 7, 9], "b": [2, 4, 6, 8, 10], "c": [1, 1, 2, 2, 2]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    r = kruskal(spark.createDataFrame(rows, "g string, v int"), "g", "v").first()
    values = sorted(v for _, v in rows)
    rank = {v: (2 * values.index(v) + values.count(v) + 1) / 2 for v in values}
    n = len(values)
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    h /= 1 - sum(values.count(v) ** 3 - values.count(v) for v in set(values)) / (n**3 - n)
    assert r["kruskal_h"] == pytest.approx(h) and 0 <= r["p_kruskal"] <= 1
    assert r["epsilon2"] == pytest.approx((h - 2) / (n - 3))


# --- importance ----------------------------------------------------------------------------------


def table(spark, rows):
    return spark.createDataFrame(rows, "feature string, mean_abs double, importance_share double")


def test_importance_shares(spark):
    rows = [("a", 1.0), ("a", -3.0), ("b", 1.0), ("b", 1.0)]
    out = explain.importance_table(spark.createDataFrame(rows, "feature string, attribution double")).collect()
    assert [r["feature"] for r in out] == ["a", "b"]
    assert sum(r["importance_share"] for r in out) == pytest.approx(1)
    zero = explain.importance_table(spark.createDataFrame([("a", 0.0)], "feature string, attribution double"))
    assert zero.first()["importance_share"] == 0.0


def test_importance_comparison(spark):
    first = table(spark, [("age", 0.9, 0.45), ("load", 0.6, 0.3), ("heat", 0.4, 0.2), ("noise", 0.1, 0.05)])
    second = table(spark, [("noise", 8.0, 0.4), ("load", 6.0, 0.3), ("dust", 4.0, 0.2), ("age", 2.0, 0.1)])
    out = {r["feature"]: r for r in explain.compare_importance(first, second, 4).collect()}
    assert {f: r["delta_rank"] for f, r in out.items() if f in ("age", "load", "noise")} == {"age": -3, "load": 0, "noise": 3}
    # who is missing on a side ranks one past its last and has no share
    assert (out["heat"]["rank_second"], out["heat"]["share_second"]) == (5, 0.0)
    assert (out["dust"]["rank_first"], out["dust"]["share_first"]) == (5, 0.0)
    top = explain.compare_importance(first, second, 1).collect()
    assert {r["feature"] for r in top} == {"age", "noise"}


# --- classifiers ---------------------------------------------------------------------------------


LEAKS = ["id", "well", "part", "us", "days_left"]


def wells(spark):
    """Three wells for thirty days: one runs dry where much is drawn from a low level; two readings are missing."""
    rng = random.Random(23)
    rows = []
    for day in range(30):
        for number, lining in enumerate(("clay", "brick", "clay")):
            drawn = None if day % 11 == 5 and number == 1 else round(rng.uniform(1, 9), 2)
            level = rng.gauss(20, 4) - day / 6
            dry = int(2 * (drawn or 5.0) - level + 9 + rng.gauss(0, 2) > 0)
            part = "train" if day < 18 else "val" if day < 24 else "test"
            rows.append((100 * day + number, f"W{number}", lining, drawn, level, 30.0 - day, dry, part, day * 86_400_000_000 + number))
    return spark.createDataFrame(rows, "id int, well string, lining string, drawn_7d double, level double, days_left double, dry int, part string, us long")


def features(df):
    numeric, categorical = column_roles(df, "dry", LEAKS, ["lining", "shift"])
    return models.Features(tuple(numeric), tuple(categorical), "dry")


def parts(spark):
    df = wells(spark)
    return df.filter("part = 'train'"), df.filter("part <> 'train'"), features(df)


def test_no_leak_among_features(spark):
    f = features(wells(spark))
    assert f.numeric == ("drawn_7d", "level") and f.categorical == ("lining",)


def test_imputation_is_fitted_on_train_only(spark):
    train, rest, f = parts(spark)
    fitted = models.fit_imputation(train, f)
    known = [r.drawn_7d for r in train.collect() if r.drawn_7d is not None]
    assert len(known) == 52 and fitted.medians["drawn_7d"] == pytest.approx(statistics.median(known))
    filled = fitted.apply(rest.unionByName(train))
    assert filled.filter("drawn_7d is null").isEmpty() and filled.count() == 90
    assert fitted.levels == {"lining": "clay"}


def test_a_feature_without_training_values_is_refused(spark):
    train, _, f = parts(spark)
    with pytest.raises(ValueError, match="drawn_7d"):
        models.fit_imputation(train.withColumn("drawn_7d", F.lit(None).cast("double")), f)


SMALL = {"logreg_iter": 5, "trees": 3, "boost_rounds": 2, "boost_depth": 2}


def test_fit_score_compare(spark):
    train, test, f = parts(spark)
    out = models.compare_models(train, test, f, **SMALL).collect()
    assert {r["model"] for r in out} == set(models.MODELS)
    assert [r["pr_auc_test"] for r in out] == sorted([r["pr_auc_test"] for r in out], reverse=True)
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == 36 for r in out)
    for name in models.MODELS:
        fitted = models.fit_classifier(train, f, name, **SMALL)
        unseen = fitted.score(test.withColumn("lining", F.lit("steel")))
        assert unseen.columns == [*test.columns, models.SCORE] and unseen.filter("score between 0 and 1").count() == 36
        # a model fitted alone scores as in the comparison of all
        told = {r["model"]: (r["pr_auc_test"], r["roc_auc_test"]) for r in out}[name]
        row = models.evaluate(fitted, test).first()
        assert (row["pr_auc_test"], row["roc_auc_test"]) == pytest.approx(told, abs=0.15 if name != "logreg" else 1e-9)
    drops = explain.permutation_importance(models.fit_classifier(train, f, "logreg", **SMALL), test, ["id"]).collect()
    assert {r["feature"] for r in drops} == {"drawn_7d", "level", "lining"}


def test_models_find_the_signal(spark):
    train, test, f = parts(spark)
    out = {r["model"]: r["roc_auc_test"] for r in models.compare_models(train, test, f, trees=60, boost_rounds=30, boost_depth=2).collect()}
    assert min(out.values()) > 0.7


def test_comparison_of_horizons(spark):
    train, test, f = parts(spark)
    extra = lambda df: df.withColumn("wet", 1 - F.col("dry"))
    table = models.compare_horizons(extra(train), extra(test), f, {6: "dry", 12: "wet"}, **SMALL)
    rows = {(r["horizon_h"], r["model"]): r for r in table.collect()}
    assert len(rows) == 6 and all(rows[6, m]["tp"] + rows[6, m]["fn"] == 36 - rows[12, m]["tp"] - rows[12, m]["fn"] for m in models.MODELS)
    best = {r["horizon_h"]: r["pr_auc_test"] for r in models.best_by_horizon(table).collect()}
    assert best == {h: max(rows[h, m]["pr_auc_test"] for m in models.MODELS) for h in (6, 12)}


def test_cross_validation_does_not_depend_on_row_order(spark):
    df = wells(spark)
    f = features(df)
    fit = lambda part: models.fit_classifier(part, f, "logreg", logreg_iter=5)
    a = models.cross_validate(df, f, "us", ["id"], fit, 2)
    b = models.cross_validate(df.orderBy(F.desc("level")).repartition(3), f, "us", ["id"], fit, 2)
    assert a == pytest.approx(b)


def test_search_space_and_params(spark, tmp_path):
    assert len(models.SEARCH_SPACE) == 9
    for p in models.suggest(20):
        assert 100 <= p["rounds"] <= 800 and (p["rounds"] - 100) % 50 == 0
        assert 3 <= p["depth"] <= 10 and 0.01 <= p["rate"] <= 0.3 and 1 <= p["min_child_weight"] <= 10
        assert 0.5 <= p["subsample"] <= 1.0 and 0.5 <= p["columns"] <= 1.0
        assert 0.0 <= p["gamma"] <= 5.0 and 1e-3 <= min(p["alpha"], p["lam"]) <= max(p["alpha"], p["lam"]) <= 10
    assert models.suggest(3) == models.suggest(3)
    models.save_params(spark, models.suggest(1)[0], str(tmp_path / "p"))
    assert models.load_params(spark, str(tmp_path / "p")) == models.suggest(1)[0]


def test_search_orders_rows_once_and_refits_the_best(spark, monkeypatch):
    train, test, f = parts(spark)
    ordered = []
    index = models.chronological_index
    monkeypatch.setattr(models, "chronological_index", lambda *a: ordered.append(a) or index(*a))
    trials = [{"rounds": n, "depth": 2, "rate": 0.1} for n in (1, 3, 3)]
    found = models.search(train, f, "us", ["id"], trials, 2)
    rows = found.rows
    assert found.passes == 0 and len(ordered) == 1 and sorted(r["trial"] for r in rows) == [0, 1, 2]
    same = {r["trial"]: r["pr_auc_cv_mean"] for r in rows}
    assert same[1] == same[2] and rows == sorted(rows, key=lambda r: (-r["pr_auc_cv_mean"], r["trial"]))
    # in step: all trials of all folds share the passes, one a level of the longest
    together = models.search(train, f, "us", ["id"], trials, 2, alone=False)
    assert together.rows == rows and together.passes <= 3 * 2
    equal = {**asdict(models.BOOST), "rounds": 2, "depth": 2}
    out = [r.asDict() for r in models.refit_best(train, test, f, equal, boost_rounds=2, boost_depth=2).orderBy("model").collect()]
    names = [r.pop("model") for r in out]
    assert names == ["baseline", "tuned"] and out[0] == out[1]


def test_winner_and_best_by_horizon(spark):
    train, test, f = parts(spark)
    kind = "model string, pr_auc_test double"
    told = spark.createDataFrame([("boosting", 0.2), ("logreg", 0.9), ("random_forest", 0.9)], kind)
    assert models.fit_winner(train, f, told, logreg_iter=5).name == "logreg"
    other = spark.createDataFrame([("boosting", 0.7)], kind)
    best = {r["horizon_h"]: (r["model"], r["pr_auc_test"]) for r in models.best_by_horizon({6: told, 12: other}).collect()}
    assert best == {6: ("logreg", 0.9), 12: ("boosting", 0.7)}
    assert models.fit_winner(train, f, other, **SMALL).name == "boosting"


def test_full_size_comparison(spark):
    """The registered comparison at its declared sizes on the smallest tables."""
    from fleetcast.queries import learning, registered

    assert (models.BOOST.rounds, models.FOREST_TREES, learning.TRIALS) == (300, 300, 50)
    sf = "/root/testdata/sf0.001"
    rows = registered()["ml_compare"](spark, sf).collect()
    test = learning.split_part(learning.matrix(spark, sf), "test")
    want = {h: (test.count(), test.filter(f"{y} = 1").count()) for h, y in learning.HORIZON_LABELS.items()}
    assert {(r["horizon_h"], r["model"]) for r in rows} == {(h, m) for h in want for m in models.MODELS}
    assert all((r["tn"] + r["fp"] + r["fn"] + r["tp"], r["fn"] + r["tp"]) == want[r["horizon_h"]] for r in rows)
    assert all(0 <= r["pr_auc_test"] <= 1 for r in rows)


def test_search_and_refit_queries(spark, monkeypatch):
    """The registered queries with two trials instead of fifty."""
    from fleetcast.queries import learning, registered

    monkeypatch.setattr(learning, "TRIALS", 2)
    sf = "/root/testdata/sf0.001"
    rows = registered()["ml_search"](spark, sf).collect()
    assert sorted(r["trial"] for r in rows) == [0, 1] and all(0 <= r["pr_auc_cv_mean"] <= 1 for r in rows)
    assert {r["model"] for r in registered()["ml_refit"](spark, sf).collect()} == {"baseline", "tuned"}


def test_saved_contract_has_counts(spark, monkeypatch):
    from fleetcast.queries import governance

    saved, save = [], governance.save_contract
    monkeypatch.setattr(governance, "save_contract", lambda contract, path: (saved.append(path), save(contract, path)))
    sf = "/root/testdata/sf0.001"
    assert governance.schema_drift(spark, sf).count() > 0
    got = {(r.source, r.column): (r.non_null, r.n_unique) for r in governance.load_contract(spark, saved[0]).collect()}
    for name in ("events", "nation"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        for c in df.columns:
            assert got.pop((name, c)) == (df.filter(df[c].isNotNull()).count(), df.select(c).distinct().dropna().count())
    assert not got
