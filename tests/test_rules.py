import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from evenkeel.operators import rules as R
from evenkeel.operators.contracts import ContractError

RULES = [("seg", "A", "attr", [1.0, 0.0, -1.0]), ("seg", "B", "attr", [0.0, 2.0, 0.0]),
         ("seg", "A", "lbl_y", [0.0, 1.5]), ("dir", "d0", "lbl_y", [0.0, -1.0]), ("dir", "d1", "lbl_y", [0.0, 1.0])]
STATES = [("seg", 0, "A"), ("seg", 1, "B"), ("dir", 0, "d0"), ("dir", 1, "d1"), ("attr", 0, "x"), ("attr", 1, "y"),
          ("attr", 2, "z"), ("lbl_y", 0, "s0"), ("lbl_y", 1, "s1")]


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "parent string, state string, child string, w array<double>")


@pytest.fixture
def states(spark):
    return spark.createDataFrame(STATES, "var string, ix int, state string")


@pytest.fixture
def people(spark):
    return spark.range(2000).select(
        "id", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("seg"),
        F.concat(F.lit("d"), (F.col("id") % 3 % 2).cast("string")).alias("dir"))


def test_weights_sum_over_matching_parents(people, rules):
    got = {(r.seg, r.dir): r.w for r in R.rule_weights(people, rules, "lbl_y", ["seg", "dir"], 2).collect()}
    assert got[("A", "d1")] == [0.0, 2.5] and got[("B", "d0")] == [0.0, -1.0] and got[(None, "d1")] == [0.0, 1.0]


def test_rules_of_one_state_and_child_add_up(spark, people):
    cells = [("seg", "A", "lbl_y", [0.0, 2.0]), ("seg", "A", "lbl_y", [1.0, 3.0]), ("seg", "B", "lbl_y", [0.5, 0.0])]
    rules = spark.createDataFrame(cells, "parent string, state string, child string, w array<double>")
    got = {r.seg: r.w for r in R.rule_weights(people, rules, "lbl_y", ["seg"], 2).collect()}
    assert got["A"] == [1.0, 5.0] and got["B"] == [0.5, 0.0]
    p = {r.seg: r.p for r in R.rule_probas(people, rules, "lbl_y", ["seg"], 2).collect()}
    assert abs(p["A"][1] - 1 / (1 + math.exp(-4))) < 1e-12


def test_no_cap_on_sources_or_subsets(spark, people, rules, states):
    many = spark.createDataFrame([(f"s{i:02d}",) for i in range(17)], "source string")
    assert R.counterfactual_subsets(many).count() == 2**17
    subsets = spark.createDataFrame([(f"t{i}", ["dir"] if i % 2 else []) for i in range(300)], "split string, keep array<string>")
    few = people.where("id < 3").select("id", "seg", "dir")
    got = R.counterfactual_tables(few, states, rules, subsets, "id", ["dir"], [])
    assert got.select("split").distinct().count() == 300 and got.count() == 900


def test_effect_grid_takes_any_number_of_levels(spark):
    levels = spark.range(1500).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).alias("b"))
    assert R.effect_grid(levels, ["a", "b"]).distinct().count() == 4500


def test_no_parents_is_uniform(people, rules):
    p = R.rule_probas(people, rules, "attr", [], 3).first()["p"]
    assert p == [1 / 3] * 3


def test_layers_recover_frequencies(people, rules, states):
    got = R.layered_assign(people, states, rules, "id", 5)
    assert {c for c in got.columns} == {"id", "seg", "dir", "attr", "lbl_y", "probas_attr", "probas_lbl_y"}
    share = got.where("dir = 'd1' and seg = 'A'").agg(F.avg((F.col("lbl_y") == "s1").cast("int"))).first()[0]
    assert abs(share - 1 / (1 + math.exp(-2.5))) < 0.06


def test_roots_without_a_column_are_drawn_uniformly(people, rules, states):
    got = R.layered_assign(people.select("id"), states, rules, "id", 5)
    n = {r["seg"]: r["count"] for r in got.groupBy("seg").count().collect()}
    assert set(n) == {"A", "B"} and abs(n["A"] - 1000) < 120


def test_cycles_and_unknown_variables_are_errors(spark, people, states):
    cyc = spark.createDataFrame([("a", "1", "b", [0.0]), ("b", "1", "a", [0.0])],
                                "parent string, state string, child string, w array<double>")
    with pytest.raises(ContractError, match="cycle"):
        R.layered_assign(people, states, cyc, "id")
    with pytest.raises(ContractError, match="no states"):
        R.layered_assign(people, states.where("var <> 'attr'"),
                         spark.createDataFrame(RULES, cyc.schema), "id")


def test_order_puts_parents_first():
    graph = {"c": ["b"], "b": ["a"], "d": ["a", "c"]}
    assert R.draw_order(graph, []) == ["a", "b", "c", "d"]
    assert R.draw_order(graph, ["a", "b"]) == ["c", "d"]


def test_counterfactuals_switch_effects_off(people, rules, states):
    known = people.where("seg in ('A', 'B')")
    subsets = R.counterfactual_subsets(rules.select(F.col("parent").alias("source")))
    assert {r.split for r in subsets.collect()} == {"test_none", "test_all", "test_with_seg", "test_with_dir"}
    cf = R.counterfactual_tables(known, states, rules, subsets, "id", ["dir"], ["seg"], 5)
    assert cf.count() == 4 * known.count()
    off = cf.where("split in ('test_none', 'test_with_dir')").select("probas_attr").distinct().collect()
    assert [r[0] for r in off] == [[1 / 3] * 3]  # no weights: uniform
    all_ = cf.where("split = 'test_all'").select("id", "attr", "lbl_y")
    plain = R.layered_assign(known, states, rules, "id", 5).select("id", "attr", "lbl_y")
    assert rows(all_) == rows(plain)
    # The label keeps the confounder's effect; the direct source acts through a dummy.
    none = cf.where("split = 'test_none' and seg = 'A'")
    assert {round(r[0][1], 4) for r in none.select("probas_lbl_y").distinct().collect()} == {
        round(1 / (1 + math.exp(-w)), 4) for w in (0.5, 2.5)}


def test_disabled_rules_and_dummy_states(rules):
    off = R.disable_edges(rules, ["seg"], ["dir"], ["seg"])
    assert {r.parent for r in off.collect()} == {"seg", "cov_dummy_dir"}
    muted = R.disable_edges(rules, ["dir"], ["dir"], ["seg"])
    assert [r.w for r in muted.where("child = 'attr'").collect()] == [[0.0] * 3] * 2
    assert [r.w for r in muted.where("parent = 'seg' and child = 'lbl_y'").collect()] == [[0.0, 1.5]]
    assert rows(R.dummy_states(off)) == [("cov_dummy_dir", 0, "d0"), ("cov_dummy_dir", 1, "d1")]


def test_lookup_policies(people, rules):
    assert R.lookup_rules(people, rules, "seg").select("id").distinct().count() == 1000
    with pytest.raises(ContractError):
        R.lookup_rules(people, rules, "seg", on_missing="error")
    assert R.lookup_rules(people.withColumn("other", F.lit("q")), rules, "other", "error").count() == 0


def test_exact_state_beats_a_list(spark):
    raw = spark.createDataFrame(
        [("p", ["a", "b"], "c", [1.0]), ("p", ["b"], "d", [2.0]), ("p", ["c"], "c", [3.0])],
        "parent string, states array<string>, child string, w array<double>")
    assert rows(R.explode_state_lists(raw), "state", "child") == [("a", "c"), ("b", "d"), ("c", "c")]


def test_invalid_rules_are_reported(spark, rules, states):
    bad = rules.unionByName(spark.createDataFrame(
        [("ghost", "1", "attr", [0.0]), ("seg", "Z", "attr", [0.0])], rules.schema))
    assert rows(R.invalid_rules(bad, states)) == [("ghost", "1", "unknown_parent"), ("seg", "Z", "unknown_state")]


def test_override_replaces_whole_states(spark, rules):
    tweak = spark.createDataFrame([("seg", "A", "attr", [9.0, 9.0, 9.0])], rules.schema)
    got = R.override_rules(rules, tweak).where("parent = 'seg'")
    assert rows(got, "state", "child") == [("A", "attr"), ("B", "attr")]


@pytest.mark.parametrize("k_src, k_dst", [(2, 2), (5, 2), (2, 5), (16, 6), (3, 16), (6, 16)])
def test_state_bins_match_interval_edges(spark, k_src, k_dst):
    import numpy as np

    i = F.col("id").cast("int")
    got = {r.id: r.t for r in spark.range(k_src).select(
        "id", R.target_indexes(i, F.lit(k_src), F.lit(k_dst)).alias("t")).collect()}
    if k_src >= k_dst:
        ix = np.digitize(np.arange(k_src), np.linspace(0, k_src, k_dst + 1)) - 1
        want = {a: [int(ix[a])] for a in range(k_src)}
    else:
        ix = np.digitize(np.arange(k_dst), np.linspace(0, k_dst, k_src + 1)) - 1
        want = {a: [b for b in range(k_dst) if ix[b] == a] for a in range(k_src)}
    assert got == want


def test_effect_rules_give_sigmoid_probability(spark):
    states = spark.createDataFrame([("cov_1_cat2", 0, "s0"), ("cov_1_cat2", 1, "s1")], "var string, ix int, state string")
    for r in R.rules_from_effect(states, "attr", 5, 1.2).collect():
        e = [math.exp(x) for x in r.w]
        hit = sum(e[:3]) if r.state == "s0" else sum(e[3:])
        assert hit / sum(e) == pytest.approx(1 / (1 + math.exp(-3.0)), abs=0.01)
    with pytest.raises(ContractError):
        R.rules_from_effect(states, "attr", 5, 6)


def test_numeric_parents_weigh_the_z_score(spark):
    states = spark.createDataFrame([("c", i, str(v)) for i, v in enumerate((0.0, 0.5, 1.0))], "var string, ix int, state string")
    got = {r.state: r.w for r in R.rules_from_effect(states, "attr", 3, 2.0).collect()}
    assert got["0.5"] == [pytest.approx(-0.69), 0.0, pytest.approx(-0.69)]
    assert got["0.0"][0] == pytest.approx(round(2 * math.sqrt(1.5), 2))


def test_grid_of_a_frame(spark):
    df = spark.range(5).select("id", (F.col("id") % 2).alias("b"))
    assert R.effect_grid(df, ["id", "b"]).count() == 10



def test_node_roles_and_confounders(spark):
    e = spark.createDataFrame([("cov_a", "attr_x"), ("cov_a", "lbl_y"), ("attr_x", "lbl_y"), ("cov_b", "lbl_y")],
                              "parent string, child string")
    assert dict((r.node, r.role) for r in R.node_roles(e).collect()) == {
        "cov_a": "source", "cov_b": "source", "attr_x": "bridge", "lbl_y": "sink"}
    assert rows(R.confounders(e, "lbl_y")) == [("cov_a",)]
    assert R.graph_nodes(e).count() == 4


def test_conditional_table_sums_to_hundred(rules, states):
    got = R.conditional_table(rules, states, "seg").groupBy("parent_state", "child").agg(F.sum("percent").alias("s"))
    assert all(r.s == pytest.approx(100) for r in got.collect())


def test_grid_of_many_levels_without_value_lists(spark):
    """More combinations than could be listed; the plan holds no array of values."""
    levels = spark.range(2500).select(F.col("id").alias("a"), F.concat(F.lit("v"), F.col("id")).alias("b"))
    grid = R.effect_grid(levels, ["a", "b"])
    assert grid.count() == 2500 * 2500 and grid.where("a = 7").select("b").distinct().count() == 2500
    small = R.effect_grid(levels.where("id < 3").select("a", "b", F.when(F.col("a") < 2, F.col("a")).alias("c")), ["a", "b", "c"])
    assert small.distinct().count() == small.count() == 18
    assert R.effect_grid(levels.where("a < 0"), ["a", "b"]).count() == 0


def test_duplicate_rules_are_summed_once_for_all_lookups(spark):
    rules = spark.createDataFrame([("p", "s", "c", [1.0, 2.0]), ("p", "s", "c", [0.5, 0.0]), ("p", "t", "c", [3.0, 3.0]), ("q", "s", "c", [7.0, 7.0])], "parent string, state string, child string, w array<double>")
    maps = R.rule_maps(rules)
    assert R.rule_maps(maps) is maps
    rows_ = spark.createDataFrame([(1, "s", "s"), (2, "t", None), (3, None, "x")], "id int, p string, q string")
    got = {r.id: r.w for r in R.rule_weights(rows_, maps, "c", ["p", "q"], 2).collect()}
    assert got == {1: [8.5, 9.0], 2: [3.0, 3.0], 3: [0.0, 0.0]}
