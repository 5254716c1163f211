"""Queries over rule tables, rule scoring and counterfactual tables.

Rules, states and edges are learned from the samples, so the work grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, rnd, u
from evenkeel.catalog.views import edges_v, rules_v, samples, states_v, table, with_ctes
from evenkeel.functions.vectors import link_probas, vsum
from evenkeel.operators import rules as R

SEED = 11


def vec_rows(df, keys, vec, digits=6):
    """Vector elements as rounded rows."""
    return df.select(*keys, F.posexplode(vec).alias("ix", "v")).select(
        *keys, F.col("ix").cast("bigint").alias("ix"), rnd("v", digits).alias("v"))


def softmax_sql(w: str) -> str:
    e = f"list_transform({w}, lambda x: exp(x - list_max({w})))"
    return f"list_transform({e}, lambda e: e / list_sum({e}))"


def probas_sql(w: str) -> str:
    """Softmax, snapping and the uniform fallback."""
    snap = (f"list_transform({softmax_sql(w)}, lambda q: CASE WHEN q < 1e-5::DOUBLE THEN 0.0::DOUBLE"
            f" WHEN q > (1 - 1e-5::DOUBLE) THEN 1.0::DOUBLE ELSE q END)")
    return (f"CASE WHEN len(list_filter({w}, lambda x: x <> 0)) = 0 THEN list_transform({w}, lambda x: 1.0::DOUBLE / len({w}))"
            f" ELSE list_transform({snap}, lambda q: q / list_sum({snap})) END")


def add_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda t: t[1] + t[2])"


def draw_sql(p: str, unit: str) -> str:
    """0-based index of the drawn category."""
    cdf = f"list_transform(range(1, len({p}) + 1), lambda i: list_sum({p}[1:i]))"
    return f"least(len({p}) - 1, len(list_filter({cdf}, lambda c: c <= {unit})))::BIGINT"


BY_STATE = """,
 ra AS (SELECT state, w FROM rules_v WHERE parent = 'segment' AND child = 'attr'),
 rs AS (SELECT state, w FROM rules_v WHERE parent = 'segment' AND child = 'lbl_y'),
 rp AS (SELECT state, w FROM rules_v WHERE parent = 'priority' AND child = 'lbl_y')"""
ATTRS = with_ctes("samples", "rules_v").rstrip() + BY_STATE


@query("rules_invalid", with_ctes("rules_v", "states_v").rstrip() + """,
 declared AS (SELECT var, state FROM states_v WHERE var = 'segment' AND state < 'G')
 SELECT DISTINCT parent, state, CASE WHEN parent IN (SELECT var FROM declared) THEN 'unknown_state' ELSE 'unknown_parent' END AS reason
 FROM rules_v WHERE (parent, state) NOT IN (SELECT (var, state) FROM declared)""")
def rules_invalid(spark, d):
    # Only some states are declared, so undeclared parents and states both occur.
    declared = states_v(spark, d).where((F.col("var") == "segment") & (F.col("state") < "G"))
    return R.invalid_rules(rules_v(spark, d), declared)


@query("rule_edges", with_ctes("rules_v") + """SELECT DISTINCT parent, child FROM rules_v""")
def rule_edges(spark, d):
    return R.rule_edges(rules_v(spark, d))


@query("rule_map_flatten", with_ctes("rules_v") + f"""
 SELECT parent, state, child, (ix - 1)::BIGINT AS ix, {r('w[ix]')} AS v
 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS ix FROM rules_v)""")
def rule_map_flatten(spark, d):
    flat = rules_v(spark, d)
    by_child = flat.groupBy("parent", "state").agg(
        F.map_from_entries(F.collect_list(F.struct("child", "w"))).alias("m"))
    nested = by_child.groupBy("parent").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "m"))).alias("m")).select(
        F.create_map("parent", "m").alias("rules"))
    return vec_rows(R.rules_from_map(nested, "rules"), ["parent", "state", "child"], "w")


@query("rule_state_lists", with_ctes("rules_v") + f""", lists AS (
  SELECT parent, list(state) AS states, child, [count(*)::DOUBLE, sum(list_sum(w))] AS w FROM rules_v GROUP BY parent, child, length(state)
  UNION ALL SELECT parent, [min(state)], child, [99.0::DOUBLE, -1.0::DOUBLE] FROM rules_v GROUP BY parent, child),
 flat AS (SELECT parent, unnest(states) AS state, child, w, len(states) = 1 AS exact FROM lists),
 best AS (SELECT parent, state, child, max(w[1]) FILTER (exact) AS e1, max(w[1]) FILTER (NOT exact) AS l1, arg_max(w[2], w[1]) FILTER (exact) AS e2,
  arg_max(w[2], w[1]) FILTER (NOT exact) AS l2 FROM flat GROUP BY 1, 2, 3),
 known AS (SELECT *, bool_or(e1 IS NOT NULL) OVER (PARTITION BY parent, state) AS hit FROM best)
 SELECT parent, state, child, {r('coalesce(e1, l1)')} AS w0, {r('CASE WHEN e1 IS NOT NULL THEN e2 ELSE l2 END')} AS w1 FROM known WHERE e1 IS NOT NULL OR NOT hit""")
def rule_state_lists(spark, d):
    """Lists of the states of one length, and one state by itself. Of two rules for exactly one state
    the table has the one of greater weight only, as which of them wins is not defined."""
    flat = rules_v(spark, d)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    lists = flat.groupBy("parent", "child", F.length("state").alias("n")).agg(
        F.sort_array(F.collect_list("state")).alias("states"), F.array(F.count(F.lit(1)).cast("double"), F.sum(total)).alias("w"))
    exact = flat.groupBy("parent", "child").agg(F.array(F.min("state")).alias("states")).select(
        "parent", "states", "child", F.array(F.lit(99.0), F.lit(-1.0)).alias("w"))
    raw = lists.select("parent", "states", "child", "w").unionByName(exact)
    raw = raw.groupBy("parent", "states", "child").agg(F.max("w").alias("w"))
    out = R.explode_state_lists(raw)
    return out.select("parent", "state", "child", rnd(F.col("w")[0]).alias("w0"), rnd(F.col("w")[1]).alias("w1"))


@query("node_roles", with_ctes("edges_v") + """
 SELECT node, CASE WHEN o = 1 AND i = 1 THEN 'bridge' WHEN o = 1 THEN 'source' ELSE 'sink' END AS role, split_part(node, '_', 1) AS "group"
 FROM (SELECT node, max(o) AS o, max(i) AS i FROM (SELECT parent AS node, 1 AS o, 0 AS i FROM edges_v UNION ALL SELECT child, 0, 1 FROM edges_v) GROUP BY node)""")
def node_roles(spark, d):
    return R.node_roles(edges_v(spark, d))


@query("confounders", with_ctes("edges_v") + """
 SELECT parent AS confounder FROM edges_v WHERE child = 'lbl_O' INTERSECT SELECT parent FROM edges_v WHERE NOT starts_with(child, 'lbl_')""")
def confounders(spark, d):
    return R.confounders(edges_v(spark, d), "lbl_O")


@query("lookup_rules", ATTRS + f"""
 SELECT id, state, 'attr' AS child, {r('w[1]')} AS w0, {r('list_sum(w)')} AS total FROM samples JOIN ra ON segment = state
 UNION ALL SELECT id, state, 'lbl_y', {r('w[1]')}, {r('list_sum(w)')} FROM samples JOIN rs ON segment = state""")
def lookup_rules(spark, d):
    df = R.lookup_rules(samples(spark, d).select("id", "segment"), rules_v(spark, d), "segment", "error")
    return df.select("id", "state", "child", rnd(F.col("w")[0]).alias("w0"), rnd(vsum(F.col("w"))).alias("total"))


@query("rule_weights", ATTRS + f"""
 SELECT id, {r('rs.w[1] + rp.w[1]')} AS w0, {r('rs.w[2] + rp.w[2]')} AS w1
 FROM samples JOIN rs ON segment = rs.state JOIN rp ON priority = rp.state""")
def rule_weights(spark, d):
    df = samples(spark, d).select("id", "segment", "priority")
    out = R.rule_weights(df, rules_v(spark, d), "lbl_y", ["segment", "priority"], 2)
    return out.select("id", rnd(F.col("w")[0]).alias("w0"), rnd(F.col("w")[1]).alias("w1"))


@query("rule_probas", ATTRS + f""", pr AS (SELECT id, {probas_sql('w')} AS p FROM samples JOIN ra ON segment = state)
 SELECT id, (ix - 1)::BIGINT AS ix, {r('p[ix]')} AS v FROM (SELECT *, unnest(range(1, len(p) + 1)) AS ix FROM pr)""")
def rule_probas(spark, d):
    df = samples(spark, d).select("id", "segment")
    return vec_rows(R.rule_probas(df, rules_v(spark, d), "attr", ["segment"], 5), ["id"], "p")


@query("draw_category", ATTRS + f""", pr AS (SELECT id, {probas_sql('w')} AS p FROM samples JOIN ra ON segment = state)
 SELECT id, {draw_sql('p', u('id', "'attr'", str(SEED)))} AS attr FROM pr""")
def draw_category(spark, d):
    df = samples(spark, d).select("id", "segment")
    p = R.rule_probas(df, rules_v(spark, d), "attr", ["segment"], 5)
    return R.draw_category(p, "p", "id", "attr", SEED).select("id", "attr")


LAYERS = with_ctes("rules_v", "states_v").rstrip() + BY_STATE + f""", doms AS (SELECT list(state ORDER BY ix) FILTER (var = 'segment') AS segs,
  list(state ORDER BY ix) FILTER (var = 'priority') AS prios FROM states_v),
 roots AS (SELECT o_orderkey AS id, prios, prios[(floor({u('o_orderkey', "'priority'", str(SEED))} * len(prios)))::BIGINT + 1] AS priority,
  segs[(floor({u('o_orderkey', "'segment'", str(SEED))} * len(segs)))::BIGINT + 1] AS segment FROM orders, doms),
 kids AS (SELECT id, segment, priority, prios, {probas_sql('ra.w')} AS pa, {probas_sql(add_sql('rp.w', 'rs.w'))} AS pl FROM roots
  JOIN ra ON segment = ra.state JOIN rs ON segment = rs.state JOIN rp ON priority = rp.state)
 SELECT id, segment, priority, prios[{draw_sql('pa', u('id', "'attr'", str(SEED)))} + 1] AS attr,
  's' || {draw_sql('pl', u('id', "'lbl_y'", str(SEED)))} AS lbl_y, {r('round_even(pl[2], 2)')} AS p1 FROM kids"""


@query("layered_assign", LAYERS)
def layered_assign(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    out = R.layered_assign(ids, states_v(spark, d), rules_v(spark, d), "id", SEED)
    return out.select("id", "segment", "priority", "attr", "lbl_y", rnd(F.col("probas_lbl_y")[1]).alias("p1"))


@query("override_rules", with_ctes("rules_v") + f"""
 SELECT parent, state, child, {r('list_sum(w)', 4)} AS total FROM rules_v WHERE NOT (parent = 'segment' AND state < 'C')
 UNION ALL SELECT parent, state, 'attr', 5.0 FROM rules_v WHERE parent = 'segment' AND state < 'C' AND child = 'attr'""")
def override_rules(spark, d):
    rules = rules_v(spark, d)
    tweaks = rules.where((F.col("parent") == "segment") & (F.col("state") < "C") & (F.col("child") == "attr"))
    tweaks = tweaks.withColumn("w", R.scalar_amount(F.lit(1), 5))
    out = R.override_rules(rules, tweaks)
    return out.select("parent", "state", "child", rnd(vsum(F.col("w")), 4).alias("total"))


@query("disable_edges", with_ctes("rules_v") + f"""
 SELECT CASE WHEN parent = 'priority' THEN 'cov_dummy_priority' ELSE parent END AS parent, state, child, len(w)::BIGINT AS k,
 {r("CASE WHEN parent = 'segment' AND child = 'attr' THEN 0 ELSE list_sum(list_transform(w, lambda x: abs(x))) END", 4)} AS total FROM rules_v""")
def disable_edges(spark, d):
    out = R.disable_edges(rules_v(spark, d), [], ["priority"], ["segment"])
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + F.abs(x))
    return out.select("parent", "state", "child", F.size("w").cast("bigint").alias("k"), rnd(total, 4).alias("total"))


@query("dummy_states", with_ctes("rules_v") + """
 SELECT 'cov_dummy_priority' AS var, row_number() OVER (ORDER BY state) - 1 AS ix, state FROM (SELECT DISTINCT state FROM rules_v WHERE parent = 'priority')""")
def dummy_states(spark, d):
    out = R.dummy_states(R.disable_edges(rules_v(spark, d), [], ["priority"], ["segment"]))
    return out.withColumn("ix", F.col("ix").cast("bigint"))


@query("cf_subsets", """WITH e AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS s FROM events),
 m AS (SELECT s, mask, list_filter(s, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS keep FROM (SELECT s, unnest(range(0, 1 << len(s))) AS mask FROM e))
 SELECT CASE WHEN len(keep) = 0 THEN 'test_none' WHEN len(keep) = len(s) THEN 'test_all' ELSE 'test_with_' || array_to_string(keep, '--') END AS split,
 len(keep)::BIGINT AS n FROM m""")
def cf_subsets(spark, d):
    subsets = R.counterfactual_subsets(table(spark, d, "events").select(F.col("event_type").alias("source")))
    return subsets.select("split", F.size("keep").cast("bigint").alias("n"))


SUBSETS = "(VALUES ('test_all', true, true), ('test_none', false, false), ('test_with_priority', true, false), ('test_with_segment', false, true)) AS c(split, kp, ks)"


@query("cf_tables", ATTRS + f""",
 dom AS (SELECT list(DISTINCT priority ORDER BY priority) AS prios FROM samples),
 base AS (SELECT id, segment, priority, prios, prios[(floor({u('id', "'cov_dummy_priority'", str(SEED))} * len(prios)))::BIGINT + 1] AS dummy, split, kp, ks
  FROM samples, dom, {SUBSETS}),
 w AS (SELECT id, split, prios, list_transform(ra.w, lambda x: x * ks::INT) AS wa, {add_sql('rp.w', 'rs.w')} AS wl FROM base
  JOIN ra ON segment = ra.state JOIN rs ON segment = rs.state JOIN rp ON (CASE WHEN kp THEN priority ELSE dummy END) = rp.state),
 p AS (SELECT id, split, prios, {probas_sql('wa')} AS pa, {probas_sql('wl')} AS pl FROM w)
 SELECT id, split, prios[{draw_sql('pa', u('id', "'attr'", str(SEED)))} + 1] AS attr, {r('pa[1]')} AS p_attr0,
  's' || {draw_sql('pl', u('id', "'lbl_y'", str(SEED)))} AS lbl_y, {r('pl[2]')} AS p1 FROM p""")
def cf_tables(spark, d):
    sources = rules_v(spark, d).select(F.col("parent").alias("source"))
    out = R.counterfactual_tables(
        samples(spark, d).select("id", "segment", "priority"), states_v(spark, d), rules_v(spark, d),
        R.counterfactual_subsets(sources), "id", ["priority"], ["segment"], SEED)
    return out.select("id", "split", "attr", rnd(F.col("probas_attr")[0]).alias("p_attr0"), "lbl_y",
                      rnd(F.col("probas_lbl_y")[1]).alias("p1"))


@query("effect_grid", """SELECT a.v AS "cX", b.v AS cy, c.v AS "Xy" FROM (SELECT DISTINCT round(l_discount * 100)::BIGINT AS v FROM lineitem) a,
 (SELECT DISTINCT round(l_tax * 100)::BIGINT AS v FROM lineitem) b, (SELECT DISTINCT l_quantity::BIGINT AS v FROM lineitem) c""")
def effect_grid(spark, d):
    li = table(spark, d, "lineitem").select(
        F.round(F.col("l_discount") * 100).cast("bigint").alias("cX"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("cy"), F.col("l_quantity").cast("bigint").alias("Xy"))
    return R.effect_grid(li, ["cX", "cy", "Xy"])


@query("state_bins", """SELECT p_partkey AS id, p_size::BIGINT AS k_src, k_dst, i, list_min(t)::BIGINT AS lo, list_max(t)::BIGINT AS hi, len(t)::BIGINT AS n FROM (
 SELECT p_partkey, p_size, k_dst, i, CASE WHEN p_size >= k_dst THEN [i * k_dst // p_size] ELSE list_filter(range(0, k_dst), lambda j: j * p_size // k_dst = i) END AS t
 FROM (SELECT p_partkey, p_size, 2 + p_partkey % 16 AS k_dst, p_partkey % p_size AS i FROM part))""")
def state_bins(spark, d):
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("k_src"),
        (2 + F.col("p_partkey") % 16).cast("bigint").alias("k_dst"), (F.col("p_partkey") % F.col("p_size")).alias("i"))
    t = part.withColumn("t", R.target_indexes(F.col("i"), F.col("k_src"), F.col("k_dst")))
    return t.select("id", "k_src", "k_dst", "i", F.array_min("t").cast("bigint").alias("lo"),
                    F.array_max("t").cast("bigint").alias("hi"), F.size("t").cast("bigint").alias("n"))


@query("rule_from_effect", f"""WITH st AS (SELECT 'cov_1_cont' AS var, v::VARCHAR AS state, row_number() OVER (ORDER BY v) - 1 AS ix FROM (SELECT DISTINCT l_discount AS v FROM lineitem)
  UNION ALL SELECT 'cov_2_cat', v, row_number() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)),
 nums AS (SELECT *, try_cast(state AS DOUBLE) AS x, count(*) OVER (PARTITION BY var) AS k FROM st),
 wt AS (SELECT *, CASE WHEN bool_and(x IS NOT NULL) OVER (PARTITION BY var) THEN abs((x - avg(x) OVER (PARTITION BY var)) / stddev_pop(x) OVER (PARTITION BY var)) * 1.5::DOUBLE
   ELSE 2.5::DOUBLE * 1.5::DOUBLE END AS wt, CASE WHEN k >= 7 THEN [ix * 7 // k] ELSE list_filter(range(0, 7), lambda j: j * k // 7 = ix) END AS t FROM nums)
 SELECT var AS parent, state, 'attr' AS child, j AS ix,
 {r("round_even(CASE WHEN list_contains(t, j) THEN ln(1.0::DOUBLE / len(t)) + wt ELSE ln(1.0::DOUBLE / (7 - len(t))) END, 2)")} AS v FROM (SELECT *, unnest(range(0, 7)) AS j FROM wt)""")
def rule_from_effect(spark, d):
    from pyspark.sql import Window

    disc = table(spark, d, "lineitem").select(F.lit("cov_1_cont").alias("var"), F.col("l_discount").alias("x")).distinct()
    prio = table(spark, d, "orders").select(F.lit("cov_2_cat").alias("var"), F.col("o_orderpriority").alias("state")).distinct()
    states = disc.select("var", F.col("x").cast("string").alias("state")).unionByName(prio)
    ix = F.row_number().over(Window.partitionBy("var").orderBy("state")) - 1  # a few states per variable
    return vec_rows(R.rules_from_effect(states.withColumn("ix", ix), "attr", 7, 1.5), ["parent", "state", "child"], "w")


@query("conditional_table", with_ctes("rules_v", "states_v").rstrip() + f""", pr AS (SELECT state, child, {probas_sql('w')} AS p FROM rules_v WHERE parent = 'segment')
 SELECT pr.state AS parent_state, child, s.state AS child_state, {r('100 * p[s.ix + 1]')} AS percent FROM pr JOIN states_v s ON s.var = child""")
def conditional_table(spark, d):
    out = R.conditional_table(rules_v(spark, d), states_v(spark, d), "segment")
    return out.withColumn("percent", rnd("percent"))


@query("link_functions", f"""SELECT id, {r('p[1]')} AS softmax0, {r('1 / (1 + exp(-z))')} AS sigmoid0, {r('(sqrt(z) + 30) / (2 * sqrt(z) + 70)')} AS identity0 FROM (
 SELECT event_id AS id, value / 100 AS z, {softmax_sql('[value / 100, 0.0, 1.0]')} AS p FROM events)""")
def link_functions(spark, d):
    z = F.col("value") / 100
    root = F.sqrt(z)
    lin = F.array(root / 100 + 0.3, root / 100 + 0.4)
    three, two = F.array(z, F.lit(0.0), F.lit(1.0)), F.array(z, -z)
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), rnd(link_probas(three)[0]).alias("softmax0"),
        rnd(link_probas(two, "sigmoid")[0]).alias("sigmoid0"), rnd(link_probas(lin, "identity")[0]).alias("identity0"))
