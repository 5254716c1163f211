import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import names, stats, text, vectors
from evenkeel.functions.hashing import hash52, hash_bucket, unit_hash


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_hash_matches_md5(spark):
    got = spark.range(20).select("id", hash52(F.col("id"), "a", 7).alias("h")).collect()
    for r in got:
        assert r["h"] == int(hashlib.md5(f"{r['id']}:a:7".encode()).hexdigest()[:13], 16)


def test_hash_bucket_keeps_order_and_covers(spark):
    df = spark.range(2000).select(hash52(F.col("id")).alias("h"))
    got = df.select("h", hash_bucket(F.col("h"), 37).alias("b")).orderBy("h").collect()
    buckets = [r["b"] for r in got]
    assert buckets == sorted(buckets) and set(buckets) == set(range(37))


def test_unit_hash_is_uniform(spark):
    r = spark.range(5000).select(unit_hash(F.col("id"), 1).alias("u")).agg(
        F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(r[0] - 0.5) < 0.02 and r[1] >= 0 and r[2] < 1


@pytest.mark.parametrize("w", [(1.0, 2.0, -3.0), (0.5,), (700.0, -700.0), (1.0, -1.0)])
def test_link_probas_is_softmax(spark, w):
    got = one(spark, vectors.link_probas(vec(*w)))
    e = np.exp(np.array(w) - max(w))
    p = e / e.sum()
    p[p < 1e-5], p[p > 1 - 1e-5] = 0.0, 1.0
    assert np.allclose(got, p / p.sum())


def test_zero_weights_are_uniform_and_sum_test_is_optional(spark):
    assert one(spark, vectors.link_probas(vec(0, 0, 0, 0))) == [0.25] * 4
    assert one(spark, vectors.link_probas(vec(1, -1))) != [0.5, 0.5]
    assert one(spark, vectors.link_probas(vec(1, -1), uniform_on_zero_sum=True)) == [0.5, 0.5]


def test_basis_and_custom_link(spark):
    got = one(spark, vectors.link_probas(vec(0.1, 0.3), link=lambda z: z, basis=lambda x: x * 2))
    assert np.allclose(got, [0.25, 0.75])


@pytest.mark.parametrize("u, want", [(0.0, 0), (0.19, 0), (0.2, 1), (0.69, 1), (0.7, 2), (0.999999, 2)])
def test_draws_follow_the_cdf(spark, u, want):
    p = vec(0.2, 0.5, 0.3)
    assert one(spark, vectors.draw_index(p, F.lit(u))) == want
    assert one(spark, vectors.draw_from_cdf(vectors.cdf(p), F.lit(u), 3)) == want


def test_draw_never_picks_an_impossible_first_state(spark):
    assert one(spark, vectors.draw_index(vec(0, 1), F.lit(0.0))) == 1


def test_vector_sums_and_rounding(spark):
    assert one(spark, vectors.vadd(vec(1, 2), F.lit(None).cast("array<double>"), vec(3, 4))) == [4.0, 6.0]
    assert one(spark, vectors.round_vector(vec(0.125, 0.375))) == [0.12, 0.38]


def test_log_odds_clips_and_scales(spark):
    assert one(spark, stats.log_odds(F.lit(50.0), F.lit(80.0))) == pytest.approx(0)
    assert one(spark, stats.log_odds(F.lit(0.0), F.lit(1.0))) == pytest.approx(math.log(1e-6 / (1 - 1e-6)))
    assert one(spark, stats.expit(stats.logit(F.lit(0.3)))) == pytest.approx(0.3)


@pytest.mark.parametrize("value, want", [(7, "00007"), (12345, "12345"), (1234567, "1234567")])
def test_format_id_keeps_long_ids(spark, value, want):
    assert one(spark, text.format_id(F.lit(value))) == want


def test_text_helpers(spark):
    assert one(spark, text.parse_list(F.lit("[0.1, 2, -3.5]"))) == [0.1, 2.0, -3.5]
    assert one(spark, text.parse_list(F.lit("__import__('os')"))) is None
    assert one(spark, text.tag_ordinal(F.lit("2-light-salmon"))) == 2
    assert one(spark, text.tag_name(F.lit("2-light-salmon"))) == "light-salmon"
    assert one(spark, text.basename(F.lit("a/b/run_1//"))) == "run_1"
    assert one(spark, text.symbol_label(F.lit("cov_site"))) == "$C_{site}$"


@pytest.mark.parametrize("cons, suffix", [([], ""), (["cov_1_cat2"], ""), (["cov_1_cat2", "cov_2_cont"], "v2"),
                                          (["c_1", "c_2", "c_3"], "x")])
def test_names_round_trip(spark, cons, suffix):
    cys = [50 + i for i in range(len(cons))]
    arr = F.array(*[F.lit(c) for c in cons]).cast("array<string>")
    ys = F.array(*[F.lit(v) for v in cys]).cast("array<int>")
    name = names.pack_name(F.lit("shape-midr_vol"), arr, F.lit(92), ys, F.lit(7), F.lit(suffix))
    packed = one(spark, name)
    assert packed.startswith(f"con{len(cons)}_shape-midr-vol") and "_cX092" in packed and "_Xy007" in packed
    got = one(spark, names.unpack_name(F.lit("set_n5000_" + packed), prefix=r"set_n\d+_"))
    assert (got.n, got.direct, got.cons, got.cX, got.cys, got.Xy, got.suffix, got.valid) == (
        len(cons), "shape-midr_vol", cons, 92.0, [float(c) for c in cys], 7.0, suffix, True)


def test_name_with_leftover_parts_is_invalid(spark):
    assert one(spark, names.unpack_name(F.lit("con1_d_c_cX001_c1y002_Xy003_a_b")))["valid"] is False


def test_effect_scale_and_family(spark):
    got = one(spark, names.unpack_name(F.lit("con1_d-v_c-1_cX050_c1y025_Xy010"), effect_mul=100))
    assert (got.cX, got.cys, got.Xy) == (0.5, [0.25], 0.1)
    fam = one(spark, names.family(F.lit("con1_d_c_cX050_c1y025_Xy010")))
    assert fam == "con1_d_c_cX***_c1y***_Xy***"
    assert one(spark, names.effects_only(F.lit("con1_d_c_cX050_c1y025_Xy010"))) == "cX050_c1y025_Xy010"
