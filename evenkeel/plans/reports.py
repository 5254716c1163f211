"""Reductions of score, coefficient and importance tables to effect reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.hashing import unit_hash
from evenkeel.functions.names import effect_position, family
from evenkeel.functions.stats import clip, logit, percent_log_odds
from evenkeel.functions.text import basename
from evenkeel.operators.features import ordinal_encode
from evenkeel.operators.frames import filter_allowed
from evenkeel.operators.ranking import average_ranks, top_n
from evenkeel.operators.sizing import broadcast_if_small

# Significance level, width of a 95 % band, guard of the share denominators,
# margin of an identifiable data set, chance level of a percent accuracy.
ALPHA = 0.05
Z95 = 1.96
SHARE_EPS = 1e-6
MARGIN = 0.1
CHANCE = 50
RUN_ORDER = ("dataset", "out", "inp", "trial", "model", "type")


# --- run tables ------------------------------------------------------------------------

def short_dataset(col: Column) -> Column:
    return basename(F.replace(col, F.lit("/train/"), F.lit("")))


def contrib_table(
    runs: DataFrame, avg_over_trials: bool = True,
    filter_rows: Mapping[str, Sequence] | None = None, percentages: bool = False,
) -> DataFrame:
    """Mean of every ``score_*``/``shap__*`` column per output, input, model and data set."""
    keys = ["out", "inp", "model", "type", "dataset"] + ([] if avg_over_trials else ["trial"])
    df = runs.where(F.col("dataset").isNotNull()).withColumns({
        "dataset": short_dataset(F.col("dataset")),
        "model": F.format_string("%s(%s)", "model", "model_params"),
    })
    if filter_rows:
        df = filter_allowed(df, filter_rows)
    vals = [c for c in df.columns if c.startswith(("score_", "shap__"))]
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in vals])
    return out.withColumns({c: to_percent(F.col(c)) for c in vals}) if percentages else out


def to_percent(s: Column) -> Column:
    """Truncated percentage; null becomes -1."""
    return F.coalesce((s * 100).cast("bigint"), F.lit(-1).cast("bigint"))


def rename_scores(
    wide: DataFrame, metric: str, true_names: Sequence[str], con_names: Sequence[str]
) -> DataFrame:
    """``score_holdout_*`` columns to A_total, A_none, A_true<i>, A_con<i>(type)."""
    m = metric.replace("_", "-")
    dash = lambda s: s.replace("_", "-")
    names = {f"score_holdout_test-all_{m}": "A_total", f"score_holdout_test-none_{m}": "A_none"}
    for i, t in enumerate(true_names, 1):
        names[f"score_holdout_test-with-{dash(t)}_{m}"] = f"A_true{i}"
    for i, c in enumerate(con_names, 1):
        names[f"score_holdout_test-with-{dash(c)}_{m}"] = f"A_con{i}({c.split('_')[-1]})"
    return wide.withColumnsRenamed(names)


def pivot_sets(
    scores: DataFrame, keys: Sequence[str], names: Mapping[str, str], value: str = "value"
) -> DataFrame:
    """One column per evaluation set by conditional aggregation (one shuffle)."""
    return scores.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("eval_set") == s, F.col(value))).alias(n) for s, n in names.items()
    ])


def ood_scores(
    df: DataFrame, total: str = "a_total", no_dir: str = "a_minus_dir",
    no_con: str = "a_minus_con", none: str = "a_none",
) -> DataFrame:
    """Normalised out-of-distribution scores; a zero denominator gives null."""
    den = F.col(total) - F.col(none)
    return df.withColumns({
        "a_dir": F.try_divide(F.col(total) - F.col(no_dir), den),
        "a_con": F.try_divide(F.col(total) - F.col(no_con), den),
    })


def identifiable(df: DataFrame, total: str = "a_total", none: str = "a_none",
                 margin: float = MARGIN) -> DataFrame:
    return df.where(F.col(total) > F.col(none) + margin)


def score_drop(df: DataFrame, cols: Sequence[str], metric: str, total: str = "a_total") -> DataFrame:
    """|total - score|; accuracies are re-centred at 50, log-odds MSE is relative.

    The untouched ``a_none`` of a log-odds MSE is not divided."""
    def drop(c: str) -> Column:
        v = F.abs(F.col(total) - F.col(c))
        if "accuracy" in metric:
            v = v + CHANCE
        if "logodds_mse" in metric and not c.endswith("none"):
            v = F.try_divide(v, F.col(total))
        return v

    return df.withColumns({c: drop(c) for c in cols})


def score_sum(df: DataFrame, parts: Sequence[str], metric: str, out: str = "a_sum") -> DataFrame:
    """Row-wise sum of decomposed parts, chance counted once for accuracies."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in parts])
    if "accuracy" in metric:
        total = total - CHANCE * (len(parts) - 1)
    return df.withColumn(out, total)


def mean_two_std(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (2 * F.stddev_samp(value)).alias("two_std")
    )


def part_means(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Mean of every part over the trials as rows, parts without any value dropped."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in parts])
    return means.unpivot(list(keys), list(parts), "part", "mean").where(F.col("mean").isNotNull())


def center_scores(df: DataFrame, cols: Sequence[str], metric: str) -> DataFrame:
    """Scale to percent when the whole table is within 1, then centre by metric kind:
    accuracies at 50, explained-variance scores clipped at 0."""
    kind = metric.lower()
    if "accuracy" not in kind and "r2" not in kind and "d2" not in kind:
        return df
    top = df.agg(F.greatest(*[F.max(c) for c in cols]) if len(cols) > 1 else F.max(cols[0]))
    scale = F.when(top.scalar() <= 1.0, 100.0).otherwise(1.0)
    out = df.withColumns({c: F.col(c) * scale for c in cols})
    if "accuracy" in kind:
        return out.withColumns({c: F.col(c) - CHANCE for c in cols})
    return out.withColumns({c: clip(F.col(c), lo=0.0) for c in cols})


def unpivot_scores(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(cols), "score", "value")


# --- dataset names ---------------------------------------------------------------------

def true_effects(df: DataFrame, cX: str = "cX", cy: str = "cy", Xy: str = "Xy") -> DataFrame:
    return df.withColumns({
        "alpha_true": percent_log_odds(F.col(cX)),
        "gamma_true": percent_log_odds(F.col(cy)),
        "beta_true": percent_log_odds(F.col(Xy)),
    })


def dataset_families(df: DataFrame, name: str = "name") -> DataFrame:
    return df.select(family(F.col(name)).alias("family")).distinct()


def effect_order(df: DataFrame, cX: str, cy: str, Xy: str, out: str = "position") -> DataFrame:
    """1-based position of each effect combination ordered by Xy, then cy, then cX
    (whole percents)."""
    parts = [F.lpad(F.col(c).cast("int").cast("string"), 3, "0") for c in (Xy, cy, cX)]
    keyed = ordinal_encode(df.withColumn("__key", F.concat(*parts)), "__key", "__pos")
    return keyed.withColumns({
        out: F.col("__pos") + 1,
        "sort_value": effect_position(F.col(cX), F.col(cy), F.col(Xy)),
    }).drop("__key", "__pos")


def change_points(df: DataFrame, position: str, cols: Sequence[str]) -> DataFrame:
    """Flag every column whose value differs from the row one position earlier.

    Positions are dense, so the previous row is found by an equi-join instead of a
    window over the whole table; the first row counts as changed."""
    prev = df.select(
        (F.col(position) + 1).alias(position), *[F.col(c).alias(f"__{c}") for c in cols],
        F.lit(True).alias("__any"),
    )
    joined = df.join(prev, position, "left")
    flags = {
        f"{c}_changed": F.col("__any").isNull() | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        for c in cols
    }
    return joined.withColumns(flags).drop("__any", *[f"__{c}" for c in cols])


# --- coefficients ----------------------------------------------------------------------

def average_coefs(coefs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean coefficient and standard error of each feature over the folds."""
    return coefs.groupBy(*keys, "feature").agg(
        F.avg("coef").alias("coef"), F.avg("stderr").alias("stderr")
    )


def gate_coefs(coefs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Coefficients that are not significant, or whose fit failed, become 0."""
    gated = F.when(F.col("p") > alpha, F.lit(0.0)).otherwise(F.col("coef"))
    return coefs.withColumns({
        "coef": F.coalesce(gated, F.lit(0.0)), "stderr": F.coalesce("stderr", F.lit(0.0))
    })


# Symbols of the coefficient roles (fixed values).
ROLE_SYMBOLS = {
    "direct": ("$\\beta$", "$\\hat{\\beta}$"),
    "confounder": ("$\\gamma$", "$\\hat{\\gamma}$"),
    "indirect": ("$\\theta$", "$\\hat{\\theta}$"),
}


def label_coefs(
    coefs: DataFrame, roles: DataFrame, suffix: str = "", hat: bool = False,
    append_name: bool = True,
) -> DataFrame:
    """Display name per coefficient from its variable's role; unknown variables drop out."""
    pairs = [F.lit(v) for r, sym in ROLE_SYMBOLS.items() for v in (r, sym[int(hat)])]
    symbol = F.try_element_at(F.create_map(*pairs), F.col("role"))
    tail = F.concat(F.lit(suffix + " ("), "feature", F.lit(")")) if append_name else F.lit(suffix)
    joined = coefs.join(
        broadcast_if_small(roles.select(F.col("var").alias("feature"), "role")), "feature"
    )
    return joined.withColumn("label", F.concat(symbol, tail)).where(F.col("label").isNotNull())


def coef_band(coefs: DataFrame) -> DataFrame:
    half = F.lit(Z95) * F.col("stderr")
    return coefs.withColumns({"lower": F.col("coef") - half, "upper": F.col("coef") + half})


def effect_share(df: DataFrame, beta: str, gamma: str, compat: bool = False) -> DataFrame:
    """beta / (beta + gamma + eps) and gamma / (..). ``compat`` uses the already scaled
    beta in the second denominator."""
    b = F.col(beta) / (F.col(beta) + F.col(gamma) + SHARE_EPS)
    first = b if compat else F.col(beta)
    g = F.col(gamma) / (first + F.col(gamma) + SHARE_EPS)
    return df.withColumns({"beta_share": b, "gamma_share": g})


def effect_deviation(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "dev_dir": F.abs(F.col("a_dir") - F.col("beta_share")),
        "dev_con": F.abs(F.col("a_con") - F.col("gamma_share")),
    })


def spearman(df: DataFrame, cols: Sequence[str], against: Sequence[str]) -> DataFrame:
    """|Spearman correlation| of every column with every ``against`` column.

    Average ranks per column, then one aggregation with all the pairwise correlations."""
    every = list(dict.fromkeys([*cols, *against]))
    at = {c: f"__rank_{i}" for i, c in enumerate(every)}
    ranked = average_ranks(df.select(*every).dropna(), at)
    pairs = [(a, b) for a in cols for b in against]
    row = ranked.agg(*[
        F.abs(F.corr(at[a], at[b])).alias(f"c{i}") for i, (a, b) in enumerate(pairs)
    ])
    entries = F.array(*[
        F.struct(F.lit(a).alias("column"), F.lit(b).alias("against"), F.col(f"c{i}").alias("rho"))
        for i, (a, b) in enumerate(pairs)
    ])
    return row.select(F.inline(entries))


# --- importances, profiles, densities ---------------------------------------------------

def top_features(
    importances: DataFrame, keys: Sequence[str], run: Sequence[str], n: int = 4
) -> DataFrame:
    """Normalise every run's importance map to sum 1, average per feature, keep the n
    largest, absolute value."""
    total = F.aggregate(F.map_values("importance"), F.lit(0.0), lambda a, x: a + x)
    long = importances.select(
        *keys, *run, total.alias("total"), F.explode("importance").alias("feature", "value")
    )
    means = long.groupBy(*keys, "feature").agg(
        F.avg(F.try_divide("value", "total")).alias("share")
    )
    best = top_n(means, keys, [F.desc("share"), F.col("feature")], n)
    return best.withColumn("share", F.abs("share"))


def column_profile(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """(column, n_distinct, numeric, chart) per column; numbers are rounded to 1 digit
    before counting. ``exact=False`` counts with a mergeable sketch.

    All columns share one scan and one shuffle: each task sends on each (column, value) it has met
    once."""
    types = dict(df.dtypes)
    num = {c: types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")
           or types[c].startswith("decimal") for c in cols}
    floats = [c for c in cols if types[c] in ("float", "double")]
    shown = {f"raw_{c}": F.col(f"`{c}`") for c in cols} | {f"rnd_{c}": F.bround(F.col(f"`{c}`"), 1) for c in floats}
    if exact:
        # one zero, not two
        text = {k: (v + 0.0 if k[4:] in floats else v).cast("string") for k, v in shown.items()}
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in text.items()]))
        values = df.select(cells.alias("x")).select("x.k", "x.v").where("v is not null").distinct()
        counts = values.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k) for k in shown])
    else:
        row = df.agg(*[F.approx_count_distinct(v).alias(k) for k, v in shown.items()])
    entries = []
    for c in cols:
        raw = F.col(f"raw_{c}")
        shown = F.col(f"rnd_{c}") if types[c] in ("float", "double") else raw
        chart = F.when(raw == 2, "pie")
        if num[c]:
            chart = chart.when(shown < 10, "bar").otherwise("hist")
        else:
            chart = chart.otherwise("bar")
        entries.append(F.struct(
            F.lit(c).alias("column"), raw.alias("n_distinct"), F.lit(num[c]).alias("numeric"),
            chart.alias("chart"),
        ))
    return row.select(F.inline(F.array(*entries)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value")


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Counts in equal-width bins; by default a fifth as many bins as distinct values
    (rounded to 1 digit). The last bin is closed on the right."""
    v = F.bround(F.col(col).cast("double"), 1)
    per_value = df.where(F.col(col).isNotNull()).groupBy(v.alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    row = per_value.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    lo, hi, n = row.first()
    if not n:
        return per_value.select(F.lit(0).cast("bigint").alias("bin"), F.col("c").alias("n")).limit(0)
    k = bins or max(1, n // 5)
    width = (hi - lo) / k or 1.0
    b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(k - 1).cast("bigint"))
    return per_value.groupBy(b.alias("bin")).agg(F.sum("c").alias("n")).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left"), "n"
    )


def conditional_density(
    df: DataFrame, value: str, by: Sequence[str], points: int = 10, adjust: float = 3.0
) -> DataFrame:
    """Gaussian density of ``value`` per group on a shared grid, each group integrating
    to one. Bandwidth: Scott's rule times ``adjust``. A group without spread has null
    densities; a null group is one like others. Null and NaN values count nowhere; without
    any other the result is empty.

    Every grid point is one aggregate expression, so rows are scanned once for the
    bandwidths and once for the sums, and never multiplied."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return df.select(*by, F.lit(0).cast("bigint").alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    grid = [lo + i * step for i in range(points)]
    n = F.count(v)
    bw = df.groupBy(*by).agg(
        n.alias("__n"), (F.stddev_samp(v) * F.pow(n.cast("double"), F.lit(-0.2)) * adjust).alias("__h")
    )
    named = bw.select(*[F.col(b).alias(f"__by_{b}") for b in by], "__n", F.nullif("__h", F.lit(0.0)).alias("__h"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by], F.lit(True))
    rows = df.join(broadcast_if_small(named), same)
    norm = F.sqrt(F.lit(2 * 3.141592653589793))
    sums = rows.groupBy(*by).agg(
        F.first("__n").alias("__n"), F.first("__h").alias("__h"),
        F.array(*[F.sum(F.exp(-F.pow((F.lit(g) - v) / F.col("__h"), 2) / 2)) for g in grid])
        .alias("__k"),
    )
    xs = F.array(*[F.lit(g) for g in grid])
    return sums.select(*by, "__n", "__h", F.posexplode(F.arrays_zip(xs.alias("x"), "__k"))).select(
        *by, F.col("pos").cast("bigint").alias("point"), F.col("col.x").alias("x"),
        (F.col("col.__k") / (F.col("__n") * F.col("__h") * norm)).alias("density"),
    )


def pivot_metrics(
    df: DataFrame, keys: Sequence[str], nested: str, attrs: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """map<attr, map<metric, value>> to columns ``<metric> | <attr>`` in sorted order."""
    names = sorted((f"{m} | {a}", a, m) for a in attrs for m in metrics)
    cells = [
        F.try_element_at(F.try_element_at(nested, F.lit(a)), F.lit(m)).alias(n)
        for n, a, m in names
    ]
    return df.select(*keys, *cells)


def minmax_row(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Scale the given columns (or those whose name matches a pattern) of every row to
    0..1; a constant row gives null."""
    if isinstance(cols, str):
        rx = re.compile(cols)
        cols = [c for c in df.columns if rx.search(c)]
    arr = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    out = df.withColumns({"__lo": F.array_min(arr), "__hi": F.array_max(arr)})
    span = F.col("__hi") - F.col("__lo")
    return out.withColumns({c: F.try_divide(F.col(f"`{c}`") - F.col("__lo"), span) for c in cols}).drop(
        "__lo", "__hi"
    )


def best_checkpoint(
    df: DataFrame, keys: Sequence[str], metric: str, name: str, mode: str = "min"
) -> DataFrame:
    """The checkpoint with the best metric per run; the first name wins a tie."""
    m = F.col(metric).cast("double")
    score_ = m if mode == "min" else -m
    best = df.where(m.isNotNull()).groupBy(*keys).agg(
        F.min(F.struct(score_.alias("s"), F.col(name).alias("n"))).alias("b")
    )
    value = F.col("b.s") if mode == "min" else -F.col("b.s")
    return best.select(*keys, F.col("b.n").alias(name), value.alias(metric))


def mean_ci(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean with a normal 95 % interval."""
    half = F.lit(Z95) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (F.avg(value) - half).alias("lower"),
        (F.avg(value) + half).alias("upper"),
    )


# Cumulative Poisson(1) probabilities turning a uniform into a bootstrap weight (fixed values).
POISSON_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
               0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def bootstrap_ci(
    df: DataFrame, keys: Sequence[str], value: str, id_col: str, replicates: int = 200,
    seed: str | int = 42,
) -> DataFrame:
    """Mean with a percentile bootstrap interval.

    Every row gets a Poisson(1) weight of its own in every replicate, which is a pair of weighted
    sums. One hash gives a row's weights of four replicates; rows are repeated per block of four
    inside the task that reads them, and only sums are shuffled. The digits of a hash are compared
    as text: eight digits exceed a share of 2**32 where their text exceeds that of its whole part."""
    v = F.col(value).cast("double")
    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))
    each = df.where(v.isNotNull()).select(*keys, v.alias("__v"), F.col(id_col).cast("string").alias("__id"), F.explode(blocks).alias("__k"))
    each = each.withColumn("__h", F.md5(F.concat_ws(":", "__id", F.concat(F.lit("boot"), F.col("__k").cast("string")), F.lit(str(seed)))))
    limits = [f"{int(c * (1 << 32)):08x}" for c in POISSON_CDF]
    each = each.select(*keys, "__v", "__k", *[F.substring("__h", 8 * i + 1, 8).alias(f"__u{i}") for i in range(4)])
    # few digits exceed the later limits, so they are compared one after another
    over = lambda u, i=0: F.when(u <= limits[i], i).otherwise(over(u, i + 1) if i + 1 < len(limits) else len(limits))
    each = each.select(*keys, "__v", "__k", *[over(F.col(f"__u{i}")).alias(f"__w{i}") for i in range(4)])
    sums = [F.try_divide(F.sum(F.col(f"__w{i}") * F.col("__v")), F.sum(f"__w{i}")) for i in range(4)]
    cells = each.groupBy(*keys, "__k").agg(F.array(*sums).alias("__m"), F.avg("__v").alias("__mean"))
    wanted = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.when(F.col("__k") * 4 + i < replicates, F.get("__m", i)))
    found = cells.groupBy(*keys).agg(
        F.array_sort(F.filter(F.flatten(F.collect_list(wanted)), lambda x: x.isNotNull())).alias("__m"),
        F.max(F.when(F.col("__k") == 0, F.col("__mean"))).alias("mean"),
    )

    def at(q: float) -> Column:
        return F.element_at("__m", F.greatest(F.lit(1), F.ceil(F.size("__m") * q).cast("int")))

    return found.select(*keys, "mean", F.when(F.size("__m") > 0, at(0.025)).alias("lower"), F.when(F.size("__m") > 0, at(0.975)).alias("upper"))


def metrics_todo(wanted: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return wanted.join(done.select(*on).distinct(), list(on), "left_anti")


def counterfactual_gap(
    df: DataFrame, id_col: str, base: str, other: str, p: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """logit(p) - logit(p_cf) of the rows found in both sets (one shuffle on the id)."""
    sides = df.where(F.col("eval_set").isin(base, other)).groupBy(*by, id_col).agg(
        F.max(F.when(F.col("eval_set") == base, F.col(p))).alias("p"),
        F.max(F.when(F.col("eval_set") == other, F.col(p))).alias("p_cf"),
    )
    both = sides.where(F.col("p").isNotNull() & F.col("p_cf").isNotNull())
    return both.withColumn("effect", logit(F.col("p")) - logit(F.col("p_cf")))


def zip_predictions(
    df: DataFrame, keys: Sequence[str], arrays: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Parallel arrays (ids, truths, predictions) to one row per position."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for a, n in zip(arrays, names)])
    rows = df.select(*keys, F.posexplode(zipped).alias("pos", "__z"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"),
                       *[F.col(f"__z.{n}").alias(n) for n in names])


def join_predictions(truth: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The long form of :func:`zip_predictions`: truth and prediction share (run, id)."""
    return truth.join(predicted, list(keys))


def effect_pair(a: Column, b: Column) -> Column:
    """Order-free label of two effect levels, e.g. ``[5, 90]``."""
    lo, hi = F.least(a, b).cast("string"), F.greatest(a, b).cast("string")
    return F.concat(F.lit("["), lo, F.lit(", "), hi, F.lit("]"))
