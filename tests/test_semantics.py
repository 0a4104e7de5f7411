"""Fixed rules of single operators on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from stratafold.functions import clock_text, floor_div, floor_mod, half_even, label_code, parse_number, ratio
from stratafold.operators import clean, encode, metrics
from stratafold.operators import population as pop
from stratafold.operators import rowwise as row
from stratafold.operators.prefix import exact_quantiles
from stratafold.plans.runs import next_run_number


def column(df, name="x"):
    return [r[name] for r in df.collect()]


def test_number_texts(spark):
    texts = [" ", "", "1d", "1_000", " 12 ", "1e3", "nan", "inf", "-Infinity", "x", None, "5.", ".5", "+7", "0x10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = column(df.select(parse_number(F.col("t")).alias("x")))
    inf = math.inf
    assert found == [None, None, None, None, 12.0, 1000.0, None, inf, -inf, None, None, 5.0, 0.5, 7.0, None]


def test_nan_number_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double").coalesce(1)
    assert column(df.select(clean.number(df, "x").alias("x"))) == [None, 1.0, None]


def test_floor_arithmetic_of_negatives(spark):
    df = spark.createDataFrame([(-3,), (3,), (-12,), (25,)], "v bigint").coalesce(1)
    assert column(df.select(floor_mod(F.col("v"), 12).alias("x"))) == [9, 3, 0, 1]
    assert column(df.select(floor_div(F.col("v"), 12).alias("x"))) == [-1, 0, -1, 2]


def test_halves_round_to_even(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.5,), (2.5,)], "v double").coalesce(1)
    assert [abs(v) for v in column(df.select(half_even(F.col("v"), 1).alias("x")))] == [0, 0, 2, 2]
    tens = spark.createDataFrame([(15.0,), (25.0,), (-3.0,)], "v double").coalesce(1)
    assert [abs(v) for v in column(tens.select(half_even(F.col("v"), 10).alias("x")))] == [20, 20, 0]


def test_zero_denominator_is_missing(spark):
    df = spark.createDataFrame([(-1, 5.0, "-1")], "tenure int, MonthlyCharges double, TotalCharges string")
    df = df.withColumn("TotalCharges", clean.number(df, "TotalCharges"))
    got = row.per_tenure_features(row.ratio_features(df)).first()
    assert got["monthly_to_total_ratio"] is None and got["avg_monthly_charges"] is None
    assert got["monthly_per_tenure"] is None and got["total_per_tenure"] is None
    assert got["charges_deviation"] == 4.0
    assert df.select(ratio(F.lit(1.0), F.lit(4.0)).alias("x")).first()["x"] == 0.25


def test_label_codes(spark):
    texts = [" Yes ", "No", "yes", "Yes\n", "Maybe", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert column(df.select(label_code(F.col("t")).alias("x"))) == [1, 0, None, 1, None, None]


def test_bad_labels_and_missing_columns_are_refused(spark):
    df = spark.createDataFrame([(0,), (None,)], "Churn int")
    with pytest.raises(ValueError, match="1 rows"):
        clean.require_labels(df, "Churn")
    with pytest.raises(ValueError, match="id"):
        clean.require_columns(df, ["id"])
    clean.require_labels(df.where("Churn IS NOT NULL"), "Churn")


def test_median_is_the_tables_own(spark):
    df = spark.createDataFrame([("1",), ("2",), ("10",), ("4",), (" ",)], "TotalCharges string")
    assert sorted(column(clean.impute_median(df, "TotalCharges"), "TotalCharges")) == [1, 2, 3, 4, 10]
    empty = spark.createDataFrame([("x",)], "TotalCharges string")
    both = clean.impute_medians({"a": df, "b": empty}, "TotalCharges")
    assert sorted(column(both["a"], "TotalCharges")) == [1, 2, 3, 4, 10]
    assert column(both["b"], "TotalCharges") == [None]


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(v), v % 2) for v in (1, 2, 3, 4, 10, 10, 10)], "v double, g int")
    got = exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 1.0}).first()
    assert (got["a"], got["b"], got["c"]) == (2.5, 4.0, 10.0)
    per = {r["g"]: r["m"] for r in exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert per == {0: 10.0, 1: 2.0}


def test_missing_service_is_not_taken(spark):
    names = row.SERVICES + ["InternetService"]
    df = spark.createDataFrame([(None,) * 9, ("Yes",) * 8 + ("No",)], ", ".join(f"{n} string" for n in names))
    got = row.service_features(df).select("service_count", "has_internet", "has_phone").collect()
    assert sorted(map(tuple, got)) == [(0.0, 1.0, 0.0), (8.0, 0.0, 1.0)]


def test_digits_of_a_negative_amount(spark):
    df = spark.createDataFrame([(-12.25,), (None,)], "MonthlyCharges double").coalesce(1)
    got = row.digit_features(df, row.MONTHLY_DIGITS).collect()
    first = got[0].asDict()
    assert first["monthly_mod_10"] == 7 and first["monthly_tens_digit"] == 8 and first["monthly_mod_100"] == 87
    assert first["monthly_fractional"] == 0.75 and first["monthly_digit_count"] == 3
    assert first["monthly_rounded_10"] == -10 and first["monthly_dev_from_round10"] == 2.25
    assert got[1]["monthly_is_multiple_50"] == 1 and got[1]["monthly_digit_count"] == 1


def test_key_texts_collide_and_keep_missing(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c"), (None, "c")], "p string, q string").coalesce(1)
    assert column(row.ngram_keys(df, {"x": ("p", "q")})) == ["a_b_c", "a_b_c", "nan_c"]


def test_ranks_are_strict_and_default_to_zero(spark):
    ref = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (2.0, "a"), (5.0, "b")], "v double, g string")
    df = spark.createDataFrame(
        [(1, 0.0, "a"), (2, 2.0, "a"), (3, 3.0, "b"), (4, 9.0, "z"), (5, 9.0, None), (6, None, "a")],
        "id int, v double, g string",
    )
    subsets = {"r": F.lit(True), "none": F.lit(False), "b": F.col("g") == "b"}
    got = {r["id"]: (r["r"], r["none"], r["b"]) for r in pop.ecdf_against(df, ref, "v", subsets).collect()}
    assert got == {1: (0, 0, 0), 2: (0.25, 0, 0), 3: (0.75, 0, 0), 4: (1, 0, 1), 5: (1, 0, 1), 6: (0, 0, 0)}
    grouped = pop.ecdf_against(df, ref, "v", {"r": F.lit(True)}, group="g").collect()
    third = pytest.approx(1 / 3)
    assert {r["id"]: r["r"] for r in grouped} == {1: 0, 2: third, 3: 0, 4: 0, 5: 0, 6: 0}


def test_ranks_against_nothing_are_zero(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    assert pop.ecdf_against(df, df.where("false"), "v", {"r": F.lit(True)}).first()["r"] == 0


def test_z_score_of_a_constant_sample_is_zero(spark):
    df = spark.createDataFrame([(3.0, 1), (3.0, 1), (1.0, 0), (5.0, 0)], "v double, y int")
    moments = pop.class_moments(df, "v", "y").first().asDict()
    assert moments == {"ch_mean": 3.0, "ch_std": 0.0, "nc_mean": 3.0, "nc_std": 2.0}
    got = pop.z_score_gap(df.where("v = 5"), "v", moments).first()
    assert (got["zscore_nonchurner_TC"], got["zscore_churn_gap_TC"]) == (1.0, -1.0)


def test_reference_rate_compares_numbers_by_value(spark):
    ref = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.0, 1), (None, 1)], "k double, y int")
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 7), (4, None)], "id int, k int")
    profile = pop.category_profile(ref, ["k"], "y")
    got = {r["id"]: r["ORIG_proba_k"] for r in pop.reference_rates(df, profile, ["k"]).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 0.5, 4: 0.5}


def test_frequency_ignores_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, None)], "id int, x double")
    other = spark.createDataFrame([(1,), (1,)], "x int")
    got = {r["id"]: r["FREQ_x"] for r in pop.frequency_encode(df, [df, other], "x").collect()}
    assert got == {1: pytest.approx(0.8), 2: pytest.approx(0.8), 3: pytest.approx(0.2), 4: 0.0}


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame(
        [("t", 0.5, 1), ("t", 0.5, 0), ("u", 0.9, 1), ("u", 0.1, 0), ("u", 0.9, 0), ("one", 0.3, 0)],
        "g string, p double, y int",
    )
    got = {r["g"]: r["auc"] for r in metrics.roc_auc(df, "p", "y", ["g"]).collect()}
    assert got == {"t": 0.5, "u": 0.75, "one": None}


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1)], "p double, y int")
    assert metrics.log_loss(df, "p", "y").first()["log_loss"] == pytest.approx(0.0, abs=1e-12)


def test_histogram_keeps_empty_bins_and_widens_constants(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "p double")
    assert [r["n_rows"] for r in metrics.histogram(df, "p", 4).orderBy("bin").collect()] == [1, 0, 0, 2]
    flat = metrics.histogram(df.where("p = 1"), "p", 4).orderBy("bin").collect()
    assert [r["n_rows"] for r in flat] == [0, 0, 2, 0] and (flat[0]["low"], flat[-1]["high"]) == (0.5, 1.5)


def test_top_scores_and_placeholder(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.0)], "feature string, s double")
    assert [r["feature"] for r in metrics.top_scores(df, "feature", "s", 2).orderBy(F.desc("s")).collect()] == ["c", "a"]
    assert [tuple(r) for r in metrics.top_scores(df.where("false"), "feature", "s").collect()] == [("no_feature_importance", 0.0)]


def test_run_numbers(spark):
    names = spark.createDataFrame([("submission_2.csv",), ("submission_10.csv",), ("submission_99.csvx",), ("xsubmission_77.csv",)], "n string")
    assert next_run_number(names, "n", "submission", ".csv").first()["next_run"] == 11
    assert next_run_number(names.where("false"), "n", "submission", ".csv").first()["next_run"] == 1


def test_clock(spark):
    df = spark.createDataFrame([(701.19,), (3661.5,)], "s double").coalesce(1)
    assert column(df.select(clock_text(F.col("s")).alias("x"))) == ["00:11:41.19", "01:01:01.50"]


def test_smoothed_means(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 0)] + [(None, 0)], "k string, y int")
    model = encode.SmoothedTargetEncoder(["k"], 1.0, 1.0).fit(df, "y")
    rows = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string").coalesce(1)
    weight = 1 / (1 + math.exp(-2))
    wanted = [weight + (1 - weight) * 0.6, 0.3, 0.6, 0.6]
    assert column(model.transform(rows), "k") == pytest.approx(wanted)
    learned, other = encode.smoothed_pair(df, rows, ["k"], "y", min_samples_leaf=1.0, smoothing=1.0)
    assert column(other, "k") == pytest.approx(wanted) and learned.count() == 5


def test_schema_profile(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), (None, 2)], "t string, n int")
    got = {tuple(r) for r in clean.schema_profile(df).collect()}
    assert got == {("t", "categorical", 2), ("n", "numeric", 2)}
