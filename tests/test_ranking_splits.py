from collections import Counter, defaultdict

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash52
from evenkeel.operators import sizing
from evenkeel.operators.balance import (
    control_confounds,
    counterbalance_down,
    counterbalance_mixed,
    counterbalance_up,
    group_code,
)
from evenkeel.operators import balance
from evenkeel.operators.contracts import ContractError
from evenkeel.operators.ranking import (
    average_ranks,
    rank_in_strata,
    take_per_stratum,
    top_n,
    value_ranks,
)
from evenkeel.operators.splits import (
    capped_sample,
    check_assigned,
    group_sample,
    repeated_shuffle_split,
    split_long,
    stratified_holdout,
    stratified_kfold,
)


def brute_rank(df, keys, seed):
    w = Window.partitionBy(*keys).orderBy(hash52(F.col("id"), seed), "id")
    return df.withColumn("rank", F.row_number().over(w))


@pytest.mark.parametrize("buckets", [1, 16, 501])
def test_bucketed_rank_equals_plain_row_number(skewed, buckets):
    got = rank_in_strata(skewed, ["g", "y"], "id", 3, size="n", buckets=buckets)
    assert rows(got, "id", "rank") == rows(brute_rank(skewed, ["g", "y"], 3), "id", "rank")
    assert got.count() == skewed.count()  # null keys included
    sizes = {(r.g, r.y): r["count"] for r in skewed.groupBy("g", "y").count().collect()}
    assert all(r.n == sizes[(r.g, r.y)] for r in got.select("g", "y", "n").collect())


@pytest.mark.parametrize("buckets", [1, 64])
def test_selection_equals_rank_filter(skewed, buckets):
    quota = lambda: F.round(F.lit(0.3) * F.col("n")).cast("bigint")
    got = take_per_stratum(skewed, ["g"], "id", [3, 4], quota, ["a", "b"], buckets)
    n = F.count(F.lit(1)).over(Window.partitionBy("g"))
    for seed, flag in ((3, "a"), (4, "b")):
        want = brute_rank(skewed, ["g"], seed).withColumn(flag, F.col("rank") <= F.round(0.3 * n))
        assert rows(got, "id", flag) == rows(want, "id", flag)


def test_quota_of_zero_selects_nothing(skewed):
    got = take_per_stratum(skewed, ["g"], "id", [1], lambda: F.lit(0).cast("bigint"), ["a"])
    assert got.where("a").count() == 0 and got.count() == 3000


@pytest.mark.parametrize("quantiles, target", [(1023, 200), (3, 20)])
def test_average_ranks_in_many_buckets(skewed, monkeypatch, quantiles, target):
    """Buckets from quantiles alone, and few quantiles whose buckets are cut again."""
    monkeypatch.setattr(sizing, "QUANTILES", quantiles)
    for f in (sizing.ValueStats.splits, sizing.ValueStats.parts):
        monkeypatch.setattr(f, "__defaults__", (target,))
    stats = sizing.value_stats(skewed, ["x"])["x"]
    assert (len(stats.splits()) > 5) == (quantiles == 1023) and (stats.parts() > 9) == (quantiles == 3)
    cut = sizing.range_bucket(skewed, "x", stats, "b").select("x", "b").distinct().orderBy("x").collect()
    assert [r.b for r in cut] == sorted(r.b for r in cut) and len({r.b for r in cut}) > 10
    got = average_ranks(skewed, {"x": "rx", "c": "rc"}, ["g"]).select("id", "rx", "rc").toPandas()
    pdf = skewed.toPandas()
    grp = pdf.groupby(pdf.g.fillna("?"))
    want = pd.DataFrame({"id": pdf.id, "rx": grp.x.rank(), "rc": grp.c.rank()})
    merged = got.merge(want, on="id")
    assert len(merged) == 3000
    assert (merged.rx_x == merged.rx_y).all() and (merged.rc_x == merged.rc_y).all()


@pytest.mark.parametrize("hot", [1, 10**9])
def test_average_ranks_of_cold_and_of_hot_values(skewed, monkeypatch, hot):
    """All values joined by a shuffle, or all broadcast."""
    monkeypatch.setattr("evenkeel.operators.ranking.HOT", hot)
    got = {r.id: r.r for r in average_ranks(skewed, {"x": "r"}).collect()}
    want = skewed.toPandas().set_index("id").x.rank().to_dict()
    assert got == want


def test_rank_shuffles_do_not_follow_the_columns(spark, skewed):
    """The plan that brings ranks back to rows has as many exchanges for two columns as for six."""
    exchanges = lambda n: average_ranks(skewed.select("id", *[(F.col("x") + i).alias(f"x{i}") for i in range(n)]), {f"x{i}": f"r{i}" for i in range(n)})._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(2) == exchanges(6)


def test_value_ranks_counts_rows_below(skewed):
    got = sorted((r.v, r.n, r.below) for r in value_ranks(skewed, [], "x").collect())
    counts, below = Counter(r.x for r in skewed.collect()), 0
    for (v, n, b), key in zip(got, sorted(counts)):
        assert (v, n, b) == (key, counts[key], below)
        below += n


def test_top_n_limits_before_the_shuffle(skewed):
    df = top_n(skewed, ["g"], [F.col("x"), F.col("id")], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial and final
    assert max(Counter(r.g for r in df.collect()).values()) == 2


def test_materialize_small_refuses_large(skewed):
    assert sizing.materialize_small(skewed, 100) is None
    assert sizing.materialize_small(skewed, 3000).count() == 3000
    plan = skewed.join(sizing.broadcast_if_small(skewed.select("id"), 10), "id")
    assert "ResolvedHint" not in plan._jdf.queryExecution().analyzed().toString()


def test_holdout_sizes_per_class(skewed):
    got = stratified_holdout(skewed, "y", "id", 0.2, 1).groupBy("y", "part").count().collect()
    n = {(r.y, r.part): r["count"] for r in got}
    for y in (0, 1):
        total = n[(y, "test")] + n[(y, "train")]
        assert n[(y, "test")] == int(0.2 * total + 0.5)


def test_folds_partition_rows_and_are_balanced(skewed):
    got = stratified_kfold(skewed, "y", "id", 5, 1)
    assert got.count() == 3000 and got.select("id").distinct().count() == 3000
    per = defaultdict(list)
    for r in got.groupBy("y", "fold").count().collect():
        per[r.y].append(r["count"])
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in per.values())


def test_repeated_splits_are_complete_and_differ(skewed):
    wide = check_assigned(repeated_shuffle_split(skewed, "y", "id", 3, 0.1, 1), ["trial_0", "trial_1", "trial_2"])
    val = [{r.id for r in wide.where(f"trial_{i} = 'val'").collect()} for i in range(3)]
    assert all(len(v) == 300 for v in val) and val[0] != val[1] != val[2]
    assert split_long(wide, "id", 3).count() == 9000


def test_missing_assignment_is_an_error(skewed):
    bad = skewed.withColumn("trial_0", F.when(F.col("id") > 5, "train"))
    with pytest.raises(ContractError):
        check_assigned(bad, ["trial_0"])


def test_samples_are_reproducible_and_exact(skewed):
    a, b = capped_sample(skewed, "id", 100, 1), capped_sample(skewed.repartition(7), "id", 100, 1)
    assert rows(a, "id") == rows(b, "id") and a.count() == 100
    per = Counter(r.g for r in group_sample(skewed, ["g"], "id", 15, 1).collect())
    assert set(per.values()) == {15}


def clean(skewed):
    return skewed.where("g is not null")


def class_counts(df):
    out = defaultdict(dict)
    for r in df.groupBy("g", "y").count().collect():
        out[r.g][r.y] = r["count"]
    return out


def test_downsampling_equalises_and_keeps_the_minority(skewed):
    df = clean(skewed)
    before, after = class_counts(df), class_counts(counterbalance_down(df, "y", "id", ["g"], 1))
    for g, c in before.items():
        assert after[g] == {0: min(c.values()), 1: min(c.values())}
    kept = counterbalance_down(df, "y", "id", ["g"], 1)
    assert kept.select("id").distinct().count() == kept.count()


def test_upsampling_keeps_all_rows_and_reaches_the_maximum(skewed, monkeypatch):
    monkeypatch.setattr(balance, "DRAW_CHUNK", 7)  # many chunks
    df = clean(skewed)
    up = counterbalance_up(df, "y", "id", ["g"], 1)
    before, after = class_counts(df), class_counts(up)
    for g, c in before.items():
        assert after[g] == {0: max(c.values()), 1: max(c.values())}
    assert {r.id for r in df.collect()} == {r.id for r in up.collect()}


def test_upsampling_result_does_not_depend_on_chunking(skewed, monkeypatch):
    df = clean(skewed)
    want = rows(counterbalance_up(df, "y", "id", ["g"], 1))
    monkeypatch.setattr(balance, "DRAW_CHUNK", 3)
    assert rows(counterbalance_up(df, "y", "id", ["g"], 1)) == want


def test_mixed_direction_goes_both_ways(skewed):
    df = clean(skewed)
    before, after = class_counts(df), class_counts(counterbalance_mixed(df, "y", "id", ["g"], 1))
    ups = [after[g] == {0: max(c.values()), 1: max(c.values())} for g, c in before.items()]
    downs = [after[g] == {0: min(c.values()), 1: min(c.values())} for g, c in before.items()]
    assert all(u or d for u, d in zip(ups, downs)) and any(ups) and any(downs)


def test_no_groups_and_other_balance_column(skewed):
    kept, ok = control_confounds(skewed, "downsample", "y", "id")
    n = {r.y: r["count"] for r in kept.groupBy("y").count().collect()}
    assert ok and n[0] == n[1]
    df = skewed.withColumn("half", F.col("id") % 2)
    kept, ok = control_confounds(df, "downsample", "y", "id", balance_by="half")
    assert ok and kept.count() == 3000


def test_unbalanceable_groups_leave_data_unchanged(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b", int(i == 6)) for i in range(10)], "id int, g string, y int")
    kept, ok = control_confounds(df, "downsample", "y", "id", ["g"])
    assert not ok and kept.count() == 10
    assert control_confounds(df, None, "y", "id", ["g"])[1]


def test_control_contract_errors(spark, skewed):
    with pytest.raises(ContractError):
        control_confounds(skewed, "residualize", "y", "id", ["g"])
    with pytest.raises(ContractError):
        control_confounds(skewed, "downsample", "y", "id", ["missing"])
    with pytest.raises(ContractError):
        control_confounds(skewed.withColumn("many", F.col("id") % 11), "downsample", "y", "id", ["many"])
    with pytest.raises(ContractError):
        group_code(skewed.withColumn("one", F.lit(1)), ["one"])


def test_keys_with_nulls_have_texts_of_their_own(spark):
    from evenkeel.operators.contracts import key_text

    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), (None, None)], "x string, y string")
    assert df.select(key_text(["x", "y"])).distinct().count() == 4
