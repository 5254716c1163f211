"""Conditional rules: score a row's category distribution and draw from it.

Tables: ``rules(parent, state, child, w array<double>)``, ``states(var, ix, state)``,
``edges(parent, child)``. Rules are looked up by size-checked broadcast joins, so the
data rows are never shuffled; every draw is a function of the row id and a seed."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.hashing import unit_hash
from evenkeel.functions.vectors import (
    cdf,
    draw_from_cdf,
    draw_index,
    link_probas,
    state_at,
    vadd,
    zeros,
)
from evenkeel.operators.contracts import ContractError, require_no_rows
from evenkeel.operators.features import dense_codes
from evenkeel.operators.frames import LABEL_PREFIX
from evenkeel.operators.sizing import broadcast_if_small, materialize_small
from evenkeel.session import cut_lineage

DUMMY_PREFIX = "cov_dummy_"
CATEGORICAL_SCALE = 2.5  # effect multiplier of categorical parents (fixed value)
MAX_EFFECT = 5


# --- building and checking rule tables -------------------------------------------------

def rules_from_map(df: DataFrame, nested: str) -> DataFrame:
    """Flatten map<parent, map<state, map<child, array<double>>>> into a rules table."""
    a = df.select(F.explode(nested).alias("parent", "by_state"))
    b = a.select("parent", F.explode("by_state").alias("state", "by_child"))
    return b.select("parent", "state", F.explode("by_child").alias("child", "w"))


def explode_state_lists(raw: DataFrame) -> DataFrame:
    """Rules keyed by a list of states, one row per state. A rule written for exactly one
    state wins over lists that contain it."""
    one = F.size("states") == 1
    flat = raw.select(
        "parent", F.explode("states").alias("state"), "child", "w", one.alias("exact")
    )
    best = flat.groupBy("parent", "state", "child").agg(
        F.max_by("w", "exact").alias("w"), F.max("exact").alias("exact")
    )
    exact = best.groupBy("parent", "state").agg(F.max("exact").alias("any_exact"))
    return (
        best.join(exact, ["parent", "state"])
        .where(F.col("exact") | ~F.col("any_exact"))
        .select("parent", "state", "child", "w")
    )


def scalar_amount(amount: Column, k: Column | int) -> Column:
    """One amount for every index."""
    return F.array_repeat(amount.cast("double"), k if isinstance(k, Column) else F.lit(k))


def invalid_rules(rules: DataFrame, states: DataFrame) -> DataFrame:
    """Rules whose parent is not declared, or whose state the parent does not have."""
    keyed = rules.select("parent", "state").distinct()
    declared = states.select(F.col("var").alias("parent"), "state").distinct()
    bad = keyed.join(declared, ["parent", "state"], "left_anti")
    known = declared.select("parent").distinct().withColumn("known", F.lit(True))
    return bad.join(known, "parent", "left").select(
        "parent", "state",
        F.when(F.col("known"), "unknown_state").otherwise("unknown_parent").alias("reason"),
    )


def rule_edges(rules: DataFrame) -> DataFrame:
    return rules.select("parent", "child").distinct()


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()


def node_roles(edges: DataFrame) -> DataFrame:
    """Every node with its role (source, bridge, sink) and group (text before '_')."""
    ends = edges.select(F.col("parent").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(
        edges.select(F.col("child").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    sides = ends.groupBy("node").agg(F.max("out").alias("out"), F.max("in").alias("in"))
    role = F.when((F.col("out") == 1) & (F.col("in") == 1), "bridge").when(
        F.col("out") == 1, "source"
    )
    return sides.select(
        "node", role.otherwise("sink").alias("role"), F.split("node", "_")[0].alias("group")
    )


def confounders(edges: DataFrame, label: str) -> DataFrame:
    """Parents shared by the label and any non-label child."""
    of_label = edges.where(F.col("child") == label).select("parent")
    of_attr = edges.where(~F.col("child").startswith(LABEL_PREFIX)).select("parent")
    return of_label.intersect(of_attr).select(F.col("parent").alias("confounder"))


def override_rules(rules: DataFrame, tweaks: DataFrame) -> DataFrame:
    """Replace whole (parent, state) entries."""
    return rules.join(
        tweaks.select("parent", "state").distinct(), ["parent", "state"], "left_anti"
    ).unionByName(tweaks)


def disable_edges(
    rules: DataFrame, keep: Sequence[str], direct: Sequence[str], indirect: Sequence[str]
) -> DataFrame:
    """Counterfactual rules: sources outside ``keep`` lose their effect on attributes.

    A direct source is replaced by an independent dummy with the same rules; confounders
    and mediators get zero weights to every child that is not a label."""
    off = ~F.col("parent").isin(list(keep)) if keep else F.lit(True)
    gone = off & F.col("parent").isin(list(direct))
    mute = (
        off & F.col("parent").isin(list(indirect)) & ~F.col("child").startswith(LABEL_PREFIX)
    )
    return rules.select(
        F.when(gone, F.concat(F.lit(DUMMY_PREFIX), "parent")).otherwise(F.col("parent"))
        .alias("parent"),
        "state", "child",
        F.when(mute, zeros(F.size("w"))).otherwise(F.col("w")).alias("w"),
    )


def dummy_states(rules: DataFrame) -> DataFrame:
    """States rows of the dummies that :func:`disable_edges` introduced."""
    keys = rules.where(F.col("parent").startswith(DUMMY_PREFIX)).select("parent", "state").distinct()
    w = Window.partitionBy("parent").orderBy("state")
    return keys.select(F.col("parent").alias("var"), (F.row_number().over(w) - 1).alias("ix"), "state")


# --- rules from effect sizes -----------------------------------------------------------

def target_indexes(i: Column, k_src: Column, k_dst: Column) -> Column:
    """0-based child states that parent state ``i`` points to: identity, bins when the
    parent has more states, one-to-many when it has fewer."""
    down = F.array(F.floor(i * k_dst / k_src).cast("int"))
    up = F.filter(
        F.sequence(F.lit(0), (k_dst - 1).cast("int")),
        lambda j: F.floor(j * k_src / k_dst).cast("int") == i,
    )
    return F.when(k_src >= k_dst, down).otherwise(up)


def rules_from_effect(
    states: DataFrame, child: str, child_k: int, effect: float
) -> DataFrame:
    """Weights giving the target states a total probability of sigmoid(weight).

    Numeric parents weigh |z| of the state value (population z-score over its states)
    times the effect, categorical ones 2.5 times the effect; rounded to 2 digits."""
    if not 0 <= effect <= MAX_EFFECT:
        raise ContractError(f"effect must lie in 0..{MAX_EFFECT}, not {effect}")
    w = Window.partitionBy("var")
    value = F.col("state").try_cast("double")
    numeric = F.bool_and(value.isNotNull()).over(w)
    z = (value - F.avg(value).over(w)) / F.stddev_pop(value).over(w)
    weight = F.when(numeric, F.abs(z) * effect).otherwise(F.lit(CATEGORICAL_SCALE * effect))
    k_src = F.count(F.lit(1)).over(w).cast("int")
    k = F.lit(child_k)
    t = states.select(
        "var", "ix", "state", weight.alias("wt"),
        target_indexes(F.col("ix").cast("int"), k_src, k).alias("hit"),
    )
    m = F.size("hit")
    vec = F.transform(
        F.sequence(F.lit(0), F.lit(child_k - 1)),
        lambda j: F.when(
            F.array_contains("hit", j), F.log(F.lit(1.0) / m) + F.col("wt")
        ).otherwise(F.log(F.lit(1.0) / (k - m))),
    )
    return t.select(
        F.col("var").alias("parent"), "state", F.lit(child).alias("child"),
        F.transform(vec, lambda x: F.bround(x, 2)).alias("w"),
    )


def effect_grid(levels: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All combinations of the distinct values of each column.

    A combination's number is written in the mixed radix of the columns' sizes, and each digit
    is the place of a value in its column's stored dictionary. Values neither pass through the driver
    nor into the plan; the driver counts them."""
    known = [cut_lineage(dense_codes(levels, c, f"__at{i}"), "levels") for i, c in enumerate(cols)]
    sizes = [k.count() for k in known]
    grid, below = levels.sparkSession.range(math.prod(sizes)).withColumnRenamed("id", "__n"), math.prod(sizes)
    for i, (c, n) in enumerate(zip(cols, sizes)):
        below //= max(n, 1)
        place = F.floor(F.col("__n") / below) % max(n, 1)
        values = known[i].select(F.col(c), F.col(f"__at{i}"))
        grid = grid.join(broadcast_if_small(values), place == F.col(f"__at{i}")).drop(f"__at{i}")
    return grid.select(*cols)


def counterfactual_subsets(sources: DataFrame, name: str = "source") -> DataFrame:
    """(split, keep): every non-empty proper subset, plus ``test_none`` and ``test_all``.

    The names are a scalar subquery; only their number is counted on the driver."""
    names = sources.select(name).where(F.col(name).isNotNull()).distinct()
    n = names.count()
    arr = names.agg(F.array_sort(F.collect_list(name))).scalar()
    masks = sources.sparkSession.range(0, 2**n).withColumn("all", arr).withColumn(
        "keep",
        F.filter("all", lambda _, i: F.call_function("shiftright", F.col("id"), i) % 2 == 1),
    )
    split = (
        F.when(F.size("keep") == 0, "test_none")
        .when(F.size("keep") == n, "test_all")
        .otherwise(F.concat(F.lit("test_with_"), F.array_join("keep", "--")))
    )
    return masks.select(split.alias("split"), "keep")


# --- applying rules to rows ------------------------------------------------------------

def lookup_rules(
    df: DataFrame, rules: DataFrame, parent: str, on_missing: str = "skip"
) -> DataFrame:
    """Rows with the rules that match their ``parent`` state (columns state, child, w).

    ``on_missing='error'`` raises for a state without rules; a parent without any rules
    matches nothing."""
    mine = rules.where(F.col("parent") == parent).select("parent", "state", "child", "w")
    small = broadcast_if_small(mine)
    key = F.col(parent).cast("string")
    if on_missing == "error":
        lost = df.select(key.alias("state")).distinct().join(small, "state", "left_anti")
        if mine.take(1):
            require_no_rows(lost, f"states of {parent} without rules")
    return df.withColumn("state", key).join(small, "state")


def rule_maps(rules: DataFrame) -> DataFrame:
    """(parent, state, m): all weights of a parent's state as one map<child, w>. Several rules for one
    parent, state and child add up, once for all lookups.

    A table that proves small is a local one, whose filters and joins cost no job; others are
    stored. The result may be passed wherever rules are looked up in rows."""
    if "m" in rules.columns:
        return rules
    cells = rules.select("parent", "state", "child", F.posexplode("w").alias("i", "x"))
    sums = cells.groupBy("parent", "state", "child", "i").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("parent", "state", "child").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("w"))
    whole = vectors.select("parent", "state", "child", F.transform("w", lambda c: c["x"]).alias("w"))
    maps = whole.groupBy("parent", "state").agg(F.map_from_entries(F.collect_list(F.struct("child", "w"))).alias("m"))
    local = materialize_small(maps)
    return cut_lineage(maps, "rule-maps") if local is None else F.broadcast(local)


def attach_rules(df: DataFrame, rules: DataFrame, parent: str, out: str, key: str | None = None) -> DataFrame:
    """One map<child, w> column per parent, null where no rule matches; row count kept.
    ``key`` is the column that holds the parent's state, by default its own."""
    by_state = rule_maps(rules).where(F.col("parent") == parent).select(F.col("state").alias("__state"), F.col("m").alias(out))
    return df.join(by_state, F.col(key or parent).cast("string") == F.col("__state"), "left").drop("__state")


def rule_weights(
    df: DataFrame, rules: DataFrame, child: str, parents: Sequence[str], k: int, out: str = "w"
) -> DataFrame:
    """Sum of the weight vectors of every matching parent; zeros when none matches."""
    cols, rules = {p: f"__r_{i}" for i, p in enumerate(parents)}, rule_maps(rules)
    for p, c in cols.items():
        df = attach_rules(df, rules, p, c)
    found = [F.try_element_at(c, F.lit(child)) for c in cols.values()]
    return df.withColumn(out, _total(found, k)).drop(*cols.values())


def _total(vectors: Sequence[Column], k: int) -> Column:
    return F.coalesce(vadd(*vectors), zeros(k)) if vectors else zeros(k)


def _attach_probas(
    df: DataFrame, rules: DataFrame, child: str, actors: Mapping[str, Column], k: int,
    link: str = "softmax",
) -> DataFrame:
    """Add ``__p`` (probabilities) and ``__cdf`` of ``child``; ``actors`` gives the state
    that acts for each parent in a row, null for none.

    The weights are looked up per parent and summed in the row."""
    cols, rules = [], rule_maps(rules)
    for i, (p, actor) in enumerate(actors.items()):
        df = df.withColumn(f"__a{i}", actor)
        df = attach_rules(df, rules, p, f"__r{i}", f"__a{i}")
        cols.append(F.try_element_at(f"__r{i}", F.lit(child)))
    df = df.withColumn("__p", link_probas(_total(cols, k), link))
    used = [c for i in range(len(actors)) for c in (f"__a{i}", f"__r{i}")]
    return df.withColumn("__cdf", cdf(F.col("__p"))).drop(*used)


def rule_probas(
    df: DataFrame, rules: DataFrame, child: str, parents: Sequence[str], k: int,
    out: str = "p", link: str = "softmax",
) -> DataFrame:
    """P(child | parents) as an array."""
    actors = {p: F.col(p) for p in parents}
    scored = _attach_probas(df, rules, child, actors, k, link)
    return scored.drop("__cdf").withColumnRenamed("__p", out)


def draw_category(
    df: DataFrame, probas: str, id_col: str, var: str, seed: str | int,
    states: Sequence[str] | None = None, out: str | None = None,
) -> DataFrame:
    """Draw a state (or its index) from a probability column."""
    ix = draw_index(F.col(probas), unit_hash(F.col(id_col), var, seed))
    return df.withColumn(out or var, state_at(states, ix) if states else ix.cast("bigint"))


def collect_graph(rules: DataFrame) -> dict[str, list[str]]:
    """child -> sorted parents; the graph is bounded by the number of variables."""
    graph: dict[str, list[str]] = {}
    for r in sorted(rule_edges(rules).collect()):
        graph.setdefault(r["child"], []).append(r["parent"])
    return graph


def collect_states(states: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[tuple]] = {}
    for r in states.collect():
        out.setdefault(r["var"], []).append((r["ix"], r["state"]))
    return {v: [s for _, s in sorted(pairs)] for v, pairs in out.items()}


def draw_order(graph: Mapping[str, Sequence[str]], given: Sequence[str]) -> list[str]:
    """Children in an order where parents come first; a cycle is an error."""
    done, order, waiting = set(given), [], dict(graph)
    roots = {p for ps in graph.values() for p in ps} - set(graph) - done
    order.extend(sorted(roots))
    done |= roots
    while waiting:
        ready = sorted(c for c, ps in waiting.items() if all(p in done for p in ps))
        if not ready:
            raise ContractError(f"cycle among {sorted(waiting)}")
        for c in ready:
            waiting.pop(c)
            if c not in done:
                order.append(c)
                done.add(c)
    return order


def layered_assign(
    df: DataFrame, states: DataFrame, rules: DataFrame, id_col: str, seed: str | int = 42,
    with_probas: bool = True,
) -> DataFrame:
    """Draw every rule variable that is not already a column, parents first.

    Roots without a column are drawn uniformly. All layers are projections and broadcast
    lookups in one stage. ``probas_<var>`` holds the distribution, rounded to 2."""
    graph, domain = collect_graph(rules), collect_states(states)
    rules = rule_maps(rules)
    for var in draw_order(graph, df.columns):
        vals = domain.get(var)
        if not vals:
            raise ContractError(f"no states declared for {var}")
        actors = {p: F.col(p) for p in graph.get(var, [])}
        df = _draw(_attach_probas(df, rules, var, actors, len(vals)), var, vals, id_col, seed)
        if with_probas:
            rounded = F.transform("__p", lambda x: F.bround(x, 2))
            df = df.withColumn(f"probas_{var}", rounded)
        df = df.drop("__p", "__cdf")
    return df


def _draw(df: DataFrame, var: str, vals: Sequence[str], id_col: str, seed: str | int) -> DataFrame:
    ix = draw_from_cdf(F.col("__cdf"), unit_hash(F.col(id_col), var, seed), len(vals))
    return df.withColumn(var, state_at(vals, ix))


def counterfactual_tables(
    df: DataFrame, states: DataFrame, rules: DataFrame, subsets: DataFrame, id_col: str,
    direct: Sequence[str], indirect: Sequence[str], seed: str | int = 42,
) -> DataFrame:
    """The table under every counterfactual rule set, tagged by ``split``, in one pass.

    Each row is repeated once per subset; a disabled direct source acts through an
    independent uniform draw of its states, a disabled confounder adds no weight to
    attributes. The same uniforms are used in every subset, so a
    row and its counterfactual differ by the disabled effects only."""
    graph, domain = collect_graph(rules), collect_states(states)
    rules = rule_maps(rules)
    given = set(df.columns)
    choices = subsets.agg(F.array_sort(F.collect_list(F.struct("split", "keep")))).scalar()
    for p in direct:  # the stand-in's state and rules are shared by all subsets
        vals = domain[p]
        ix = F.floor(unit_hash(F.col(id_col), DUMMY_PREFIX + p, seed) * len(vals))
        df = df.withColumn(DUMMY_PREFIX + p, state_at(vals, ix))
    df = df.withColumn("__cf", F.explode(choices))
    df = df.withColumn("split", F.col("__cf.split")).withColumn("__keep", F.col("__cf.keep"))
    for var in draw_order(graph, [*given]):
        vals, actors = domain[var], {}
        for p in graph.get(var, []):
            on = F.array_contains("__keep", p)
            actors[p] = F.col(p)
            if p in direct:
                actors[p] = F.when(on, F.col(p)).otherwise(F.col(DUMMY_PREFIX + p))
            elif p in indirect and not var.startswith(LABEL_PREFIX):
                actors[p] = F.when(on, F.col(p))  # without a rule a parent adds zeros
        df = _draw(_attach_probas(df, rules, var, actors, len(vals)), var, vals, id_col, seed)
        df = df.withColumn(f"probas_{var}", F.col("__p")).drop("__p", "__cdf")
    return df.drop("__cf", "__keep")


def conditional_table(rules: DataFrame, states: DataFrame, parent: str) -> DataFrame:
    """Percent probability of every child state when only one parent state is active."""
    probs = rules.where(F.col("parent") == parent).select(
        F.col("state").alias("parent_state"), "child",
        F.posexplode(link_probas(F.col("w"))).alias("ix", "p"),
    )
    child_states = states.select(F.col("var").alias("child"), "ix", F.col("state").alias("child_state"))
    return probs.join(child_states, ["child", "ix"]).select(
        "parent_state", "child", "child_state", (F.col("p") * 100).alias("percent")
    )
