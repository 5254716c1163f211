import json
import os

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from evenkeel.operators import contracts as C
from evenkeel.plans import reports as P
from evenkeel.session import cut_lineage, shared_dir
from evenkeel.sources import results, samples
from evenkeel.streaming.scores import drain_groups, drain_rows, read_stream, stream_scores
from evenkeel.operators.metrics import score


@pytest.fixture
def wide(spark):
    return spark.createDataFrame(
        [("a", 0, 0.8, 0.5, 0.6, 0.2), ("a", 1, 0.6, 0.4, 0.5, 0.6), ("b", 0, 0.1, None, -0.2, 0.05)],
        "dataset string, trial int, a_total double, a_minus_dir double, a_minus_con double, a_none double")


def test_ood_scores_and_zero_denominator(wide):
    got = {(r.dataset, r.trial): r for r in P.ood_scores(wide).collect()}
    assert got[("a", 0)].a_dir == pytest.approx(0.5) and got[("a", 0)].a_con == pytest.approx(1 / 3)
    assert got[("a", 1)].a_dir is None and got[("b", 0)].a_dir is None
    assert rows(P.identifiable(wide), "dataset", "trial") == [("a", 0)]


def test_percent_of_null_and_truncation(spark):
    df = spark.createDataFrame([(0.299,), (-0.299,), (None,)], "s double").withColumn("p", P.to_percent(F.col("s")))
    assert sorted(r.p for r in df.collect()) == [-29, -1, 29]


def test_drops_by_metric_kind(wide):
    plain = P.score_drop(wide, ["a_minus_dir", "a_none"], "d2").where("dataset = 'a' and trial = 0").first()
    assert plain.a_minus_dir == pytest.approx(0.3)
    rel = P.score_drop(wide, ["a_minus_dir", "a_none"], "logodds_mse").where("dataset = 'a' and trial = 0").first()
    assert rel.a_minus_dir == pytest.approx(0.3 / 0.8) and rel.a_none == pytest.approx(0.6)
    acc = P.score_drop(wide, ["a_minus_dir"], "balanced_accuracy").where("dataset = 'a' and trial = 0").first()
    assert acc.a_minus_dir == pytest.approx(50.3)


def test_sums_centres_and_parts(wide):
    s = P.score_sum(wide, ["a_minus_dir", "a_minus_con"], "d2").where("dataset = 'b'").first()
    assert s.a_sum == pytest.approx(-0.2)
    c = P.center_scores(wide, ["a_minus_con"], "logodds_r2").where("dataset = 'b'").first()
    assert c.a_minus_con == 0
    pct = P.center_scores(wide.withColumn("a_total", F.col("a_total") * 100), ["a_total"], "balanced_accuracy")
    assert pct.where("dataset = 'b'").first().a_total == pytest.approx(-40)
    assert P.center_scores(wide, ["a_total"], "loglikelihood_ratio") is wide
    parts = P.part_means(wide, ["dataset"], ["a_minus_dir", "a_none"])
    assert rows(parts, "dataset", "part") == [("a", "a_minus_dir"), ("a", "a_none"), ("b", "a_none")]
    m = P.mean_two_std(wide.where("dataset = 'a'"), ["dataset"], "a_total").first()
    assert m.mean == pytest.approx(0.7) and m.two_std == pytest.approx(2 * np.std([0.8, 0.6], ddof=1))


def test_contrib_table_groups_and_filters(spark):
    df = spark.createDataFrame(
        [("x/d1/train/", "y", "all", 0, "LR", "C1", "baseline", 0.5), ("x/d1/train/", "y", "all", 1, "LR", "C1", "baseline", 0.7),
         (None, "y", "all", 0, "LR", "C1", "baseline", 0.1), ("d2/", "y", "all", 0, "LR", None, "baseline", None)],
        "dataset string, out string, inp string, trial int, model string, model_params string, type string, score_test_d2 double")
    got = P.contrib_table(df, percentages=True)
    assert rows(got, "dataset", "score_test_d2") == [("d1", 60), ("d2", -1)]
    assert P.contrib_table(df, avg_over_trials=False, filter_rows={"trial": [1]}).count() == 1


def test_best_checkpoint_first_wins_ties(spark):
    df = spark.createDataFrame([("r", "c2", 0.5), ("r", "c1", 0.5), ("r", "c3", 0.9), ("r", "c0", None)], "run string, ckpt string, loss double")
    assert rows(P.best_checkpoint(df, ["run"], "loss", "ckpt")) == [("r", "c1", 0.5)]
    assert rows(P.best_checkpoint(df, ["run"], "loss", "ckpt", "max")) == [("r", "c3", 0.9)]


def test_coefficient_gates_labels_shares(spark):
    df = spark.createDataFrame([("x", 1.0, 0.1, 0.01), ("c", 2.0, 0.5, 0.2), ("q", None, None, None)],
                               "feature string, coef double, stderr double, p double")
    assert rows(P.gate_coefs(df), "feature", "coef") == [("c", 0.0), ("q", 0.0), ("x", 1.0)]
    roles = spark.createDataFrame([("x", "direct"), ("c", "confounder")], "var string, role string")
    assert rows(P.label_coefs(df, roles, " from 1"), "label") == [("$\\beta$ from 1 (x)",), ("$\\gamma$ from 1 (c)",)]
    assert rows(P.label_coefs(df, roles, hat=True, append_name=False), "label") == [("$\\hat{\\beta}$",), ("$\\hat{\\gamma}$",)]
    s = spark.createDataFrame([(3.0, 1.0)], "b double, g double")
    r = P.effect_share(s, "b", "g").first()
    assert r.beta_share + r.gamma_share == pytest.approx(1, abs=1e-5)
    assert P.effect_share(s, "b", "g", compat=True).first().gamma_share == pytest.approx(1 / (0.75 + 1), abs=1e-5)


def test_spearman_equals_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 200).astype(float), "b": rng.normal(size=200)})
    pdf["c"] = pdf.a + pdf.b
    pdf.loc[3, "b"] = None
    got = P.spearman(spark.createDataFrame(pdf), ["a", "b"], ["c"]).collect()
    want = pdf.dropna().corr("spearman").abs()
    assert {r.column: round(r.rho, 9) for r in got} == {k: round(want.loc[k, "c"], 9) for k in "ab"}


def test_density_integrates_to_one_per_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["a"] * 500 + ["b"] * 100, "v": np.r_[rng.normal(size=500), rng.normal(5, 1, 100)]})
    df = spark.createDataFrame(pdf)
    d = P.conditional_density(df, "v", ["g"], points=200, adjust=1.0).toPandas()
    for g, part in d.groupby("g"):
        x = part.sort_values("x")
        assert np.trapezoid(x.density, x.x) == pytest.approx(1, abs=0.05)
    const = P.conditional_density(df.withColumn("v", F.lit(1.0)), "v", ["g"])
    assert const.count() == const.where("density is null").count() == 20
    assert P.conditional_density(df.where("v > 1e9"), "v", ["g"]).count() == 0
    odd = df.withColumn("v", F.when(F.col("v") > 6, float("nan")).otherwise(F.col("v")))
    same = P.conditional_density(df.where("v <= 6"), "v", ["g"])
    assert rows(P.conditional_density(odd, "v", ["g"])) == rows(same)


def test_histogram_and_profile(spark):
    df = spark.range(100).select((F.col("id") / 10.0).alias("v"), (F.col("id") % 2).alias("two"),
                                 F.col("id").cast("string").alias("s"))
    h = P.histogram(df, "v").collect()
    assert sum(r.n for r in h) == 100 and len(h) == 20
    assert P.histogram(df.where("v < 0"), "v").count() == 0
    prof = {r.column: (r.n_distinct, r.numeric, r.chart) for r in P.column_profile(df, df.columns).collect()}
    assert prof == {"v": (100, True, "hist"), "two": (2, True, "pie"), "s": (100, False, "bar")}
    assert rows(P.value_counts(df, "two")) == [(0, 50), (1, 50)]


def test_top_features_and_rows(spark):
    df = spark.createDataFrame([("d", 1, {"a": 3.0, "b": 1.0}), ("d", 2, {"a": 1.0, "c": 1.0}), ("d", 3, {"z": 0.0})],
                               "dataset string, run int, importance map<string,double>")
    got = {r.feature: r.share for r in P.top_features(df, ["dataset"], ["run"], 2).collect()}
    assert got == {"a": pytest.approx(0.625), "c": pytest.approx(0.5)}
    mm = P.minmax_row(spark.createDataFrame([(1.0, 3.0, 2.0), (4.0, 4.0, 4.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert rows(mm) == sorted([(0.0, 1.0, 0.5), (None, None, None)], key=repr)


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(500).select("id", (F.col("id") % 10).cast("double").alias("v"), F.lit("g").alias("g"))
    r = P.bootstrap_ci(df, ["g"], "v", "id", 60).first()
    assert r.lower < r.mean == 4.5 < r.upper and 0.3 < r.upper - r.lower < 0.8


def test_bootstrap_intervals_cover_as_often_as_they_should(spark):
    """150 groups of normal values: the true mean lies in about 95 % of the intervals, whose width is
    that of the normal interval; also where cells hold many rows each."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"id": np.arange(60_000), "g": np.arange(60_000) % 150, "v": rng.normal(3, 2, 60_000)})
    df = spark.createDataFrame(pdf)
    got = P.bootstrap_ci(df, ["g"], "v", "id").toPandas()
    assert 0.88 <= ((got.lower < 3) & (got.upper > 3)).mean() <= 0.99
    assert (got.upper - got.lower).mean() == pytest.approx(2 * 1.96 * 2 / 20, rel=0.06)
    whole = P.bootstrap_ci(df.withColumn("g", F.lit(None).cast("string")), ["g"], "v", "id").first()
    assert whole.upper - whole.lower == pytest.approx(2 * 1.96 * 2 / np.sqrt(60_000), rel=0.25)


def test_bootstrap_weighs_every_row(spark):
    """Each row has its own weight in each replicate, from the md5 of its id."""
    from hashlib import md5

    data = [(i, float((i * 37) % 101)) for i in range(300)]
    means = []
    for k in range(30):
        n = total = 0.0
        for i, v in data:
            u = int(md5(f"{i}:boot{k // 4}:42".encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8], 16) / 2**32
            w = sum(u > c for c in P.POISSON_CDF)
            n, total = n + w, total + w * v
        means.append(total / n)
    got = P.bootstrap_ci(spark.createDataFrame(data, "id long, v double"), [], "v", "id", 30).first()
    means.sort()
    assert (got.lower, got.upper) == (pytest.approx(means[0]), pytest.approx(means[29]))


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(0.0, None, "a"), (-0.0, None, "b"), (float("nan"), None, None), (0.04, None, "a")], "x double, none string, s string")
    prof = {r.column: (r.n_distinct, r.chart) for r in P.column_profile(df, df.columns).collect()}
    assert prof == {"x": (3, "bar"), "none": (0, "bar"), "s": (2, "pie")}
    plan = P.column_profile(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("FileScan") <= 1


def test_change_points(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 2), (4, "b", None)], "pos int, x string, v int")
    got = rows(P.change_points(df, "pos", ["x", "v"]), "pos", "x_changed", "v_changed")
    assert got == [(1, True, True), (2, False, True), (3, True, False), (4, False, True)]


def test_zip_and_gap(spark):
    df = spark.createDataFrame([("r", [1, 2], [0.5, 0.7])], "run string, y array<int>, p array<double>")
    assert rows(P.zip_predictions(df, ["run"], ["y", "p"], ["y", "p"])) == [("r", 0, 1, 0.5), ("r", 1, 2, 0.7)]
    s = spark.createDataFrame([(1, "base", 0.5), (1, "cf", 0.8), (2, "base", 0.5)], "id int, eval_set string, p double")
    got = P.counterfactual_gap(s, "id", "base", "cf").collect()
    assert len(got) == 1 and got[0].effect == pytest.approx(-np.log(4))


def test_write_replaces_one_split_only(spark, tmp_path):
    out = str(tmp_path / "t")
    a = spark.createDataFrame([(1,), (2,)], "id int")
    samples.write_samples(a, out, "train")
    samples.write_samples(a, out, "test_all")
    samples.write_samples(a.where("id = 1"), out, "train")
    got = spark.read.parquet(out).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 1, "test_all": 2}
    one = samples.read_samples(spark, out, "test_all")
    assert one.count() == 2 and "split" in one.columns
    with pytest.raises(C.ContractError):
        samples.read_samples(spark, out, "test_none")


def test_write_if_absent(spark, tmp_path):
    out, df = str(tmp_path / "w"), spark.createDataFrame([(1,)], "id int")
    assert rows(samples.write_if_absent(df, out)) == [(1,)]
    two = spark.createDataFrame([(2,)], "id int")
    assert rows(samples.write_if_absent(two, out)) == [(1,)]
    assert rows(samples.write_if_absent(two, out, overwrite=True)) == [(2,)]


def test_text_tables_need_a_schema_and_keep_lists(spark, tmp_path):
    for i in range(2):
        pd.DataFrame({"dataset": ["d"], "out": ["y"], "inp": ["x"], "trial": [1 - i], "model": ["LR"], "type": ["b"],
                      "probas": ["[0.1, 0.9]"]}).to_csv(tmp_path / f"run-{i}.csv", index=False)
    with pytest.raises(C.ContractError):
        samples.read_table(spark, str(tmp_path / "run-0.csv"))
    schema = "dataset string, out string, inp string, trial int, model string, type string, probas string"
    got = results.collect_runs(spark, str(tmp_path / "run-*.csv"), schema=schema)
    assert [r.trial for r in got.collect()] == [0, 1]
    from evenkeel.functions.text import parse_list

    assert got.select(parse_list(F.col("probas")).alias("p")).first().p == [0.1, 0.9]


def test_split_folders_and_effect_tables(spark, tmp_path):
    for split in ("test_all", "test_none", "train"):
        os.makedirs(tmp_path / split)
        pd.DataFrame({"id": [1, 2], "probas_lbl_y": ["[0.1, 0.9]", "[0.5, 0.5]"]}).to_csv(
            tmp_path / split / "con1_shape-vol_cov-1-cat2_cX092_c1y081_Xy067.csv", index=False)
    schema = "id int, probas_lbl_y string"
    got = samples.read_split_folders(spark, str(tmp_path), schema=schema)
    assert rows(got.groupBy("eval_set").count()) == [("test_all", 2), ("test_none", 2)]
    eff = results.read_effect_tables(spark, str(tmp_path / "train" / "*.csv"), schema)
    assert rows(eff, "con_name", "cX", "cy", "Xy", "proba") == [
        ("cov_1_cat2", 92.0, 81.0, 67.0, 0.5), ("cov_1_cat2", 92.0, 81.0, 67.0, 0.9)]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("d", 1, 0.5)], "dataset string, trial int, s1 double")
    b = spark.createDataFrame([(0.7, "d", 2)], "s2 double, dataset string, trial int")
    got = results.union_runs([a, b])
    assert got.columns == ["dataset", "trial", "s1", "s2"] and got.where("s1 is null").first().s2 == 0.7


def test_checkpoint_logs(spark, tmp_path):
    for run, loss in (("a", 0.5), ("b", 0.2)):
        d = tmp_path / "v0" / run
        os.makedirs(d)
        pd.DataFrame({"IDs": [1, 2], "labels": [0, 1]}).to_csv(d / "metadata.tsv", sep="\t", index=False)
        (d / "metametadata.json").write_text(json.dumps({"metrics": {"loss": loss}, "other": 1}, indent=1))
    got = results.read_checkpoint_logs(spark, str(tmp_path), "IDs int, labels int")
    assert got.count() == 4
    best = P.best_checkpoint(got.withColumn("loss", F.col("metrics")["loss"]).withColumn("all", F.lit(1)), ["all"], "loss", "checkpoint")
    assert best.first().checkpoint.endswith("/v0/b")


def test_feature_arrays(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    f = spark.createDataFrame([(1, [0.5, 0.25])], "id int, v array<float>")
    got = samples.attach_features(df, f, "id", "v", 3)
    assert rows(got) == sorted([(1, 0.5, 0.25, None), (2, None, None, None)], key=repr)
    assert samples.explode_features(f, "v").count() == 2


def test_contracts(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.7])], "id int, p array<double>")
    assert rows(C.proba_sum_violations(df, "id", "p"), "subject") == [("2",)]
    with pytest.raises(Exception, match="sum to one"):
        df.select(C.proba_guard(F.col("p"))).collect()
    with pytest.raises(C.ContractError):
        C.require_rows(df.where("id > 5"))


def test_shared_folder_follows_the_session(spark):
    path = shared_dir(spark)
    assert path == spark.conf.get("spark.checkpoint.dir")
    df = cut_lineage(spark.range(5), "t")
    assert df.count() == 5 and path.split(":")[-1] in df.inputFiles()[0]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(400).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).cast("int").alias("y"),
                                 ((F.col("id") % 97 + 1) / 99.0).alias("p"))
    df.repartition(3).write.parquet(src)
    names = ["d2", "accuracy", "logodds_mse"]
    want = score(df, "y", "p", ["g"], names)
    got = drain_groups(stream_scores(read_stream(spark, src), "y", "p", ["g"], names), "t_scores")
    rnd = ["g", *[F.round(n, 9) for n in names]]
    assert rows(got, *rnd) == rows(want, *rnd)
    assert drain_rows(read_stream(spark, src), "t_rows").count() == 400
