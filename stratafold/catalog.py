"""Registered queries over the test tables, each running an operator on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratafold.functions import clock_text, label_code
from stratafold.operators import clean, encode, ensemble, folds, metrics
from stratafold.operators import population as pop
from stratafold.operators import rowwise as row
from stratafold.operators.ranks import RankIndex
from stratafold.plans.fold_matrix import encode_all_folds, key_cells, wanted_stats
from stratafold.plans.matrix import build_feature_matrices, matrix_columns
from stratafold.plans.runs import next_run_number
from stratafold.plans.training import CrossValidation, boosted_trees, cross_validated_fit
from stratafold.schema import CATEGORICAL, ENCODED_STATS, ID, LABEL, NGRAM_SOURCES, NUMERIC, SERVICES, table_schema
from stratafold.session import apart, shared_dir, stage
from stratafold.sources.subjects import subjects

Query = Callable[[SparkSession, str], DataFrame]
FOLDS, INNER, SEED = 5, 5, 42
WIDE = 16  # columns beyond which a projection is better compiled apart
NUMERIC_KEYS = ["CAT_tenure", "Contract", "PaymentMethod"]


def rounded(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Keys and numbers at six decimals, so that engines can be compared."""
    six = [f"floor(double(`{n}`) * 1000000D + 0.5D) / 1000000D AS `{n}`" for n in names]
    if len(names) > WIDE:
        keys = [apart(F.col(keys[0])).alias(keys[0]), *keys[1:]]
    return df.select(*keys, *[F.expr(text) for text in six])


def cleaned(spark: SparkSession, sf_dir: str, columns: list[str]) -> dict[str, DataFrame]:
    """The chosen columns per split, with codes for labels and imputed ``TotalCharges``."""
    view = subjects(spark, sf_dir, sorted({ID, "split", *columns}))
    if LABEL in columns:
        view = clean.map_label(view, LABEL)
    if set(columns) & set(SERVICES):
        view = stage(view, "subjects")  # joined and aggregated once, read several times
    parts = {s: view.where(F.col("split") == s) for s in ("train", "test", "orig")}
    return clean.impute_medians(parts, "TotalCharges") if "TotalCharges" in columns else parts


def _probes(parts: dict[str, DataFrame]) -> DataFrame:
    return parts["train"].unionByName(parts["test"])


# cleaning and profiles ---------------------------------------------------------------------------


def clean_impute(spark, sf_dir):
    parts = cleaned(spark, sf_dir, ["TotalCharges"])
    return rounded(ensemble.union_all(list(parts.values())), [ID, "split"], ["TotalCharges"])


def label_map(spark, sf_dir):
    view = subjects(spark, sf_dir, [ID, LABEL])
    return view.select(ID, F.length(LABEL).cast("bigint").alias("raw_length"), label_code(F.col(LABEL)).cast("bigint").alias("churn"))


def label_null_check(spark, sf_dir):
    statuses = subjects(spark, sf_dir, [ID, "gender"]).select(ID, F.col("gender").alias(LABEL))
    labels = subjects(spark, sf_dir, [ID, LABEL]).unionByName(statuses)
    return clean.unmapped_labels(clean.map_label(labels, LABEL), LABEL)


def class_profile(spark, sf_dir):
    rows = clean.map_label(subjects(spark, sf_dir, [LABEL]), LABEL)
    profile = clean.class_profile(rows, LABEL).withColumn(LABEL, F.col(LABEL).cast("bigint"))
    return rounded(profile, [LABEL, "n_rows"], ["share"])


def table_shape(spark, sf_dir):
    names = {True: table_schema(True).names, False: table_schema(False).names}
    view = subjects(spark, sf_dir)
    return ensemble.union_all(
        [
            clean.table_shape(view.where(F.col("split") == s).select(*names[s != "test"]), s)
            for s in ("train", "test", "orig")
        ]
    )


def schema_profile(spark, sf_dir):
    return clean.schema_profile(subjects(spark, sf_dir).select(*table_schema(True).names))


def constant_fill(spark, sf_dir):
    view = subjects(spark, sf_dir, [ID, "MonthlyCharges", "TotalCharges"])
    parsed = view.withColumn("TotalCharges", clean.number(view, "TotalCharges"))
    return rounded(clean.fill_constants(parsed, {"TotalCharges": -1.0}), [ID], ["MonthlyCharges", "TotalCharges"])


# folds -------------------------------------------------------------------------------------------


def _labelled(spark, sf_dir, columns=(), label="churn_planted") -> DataFrame:
    return subjects(spark, sf_dir, [*dict.fromkeys([ID, label, *columns])])


def stratified_folds(spark, sf_dir):
    train = clean.map_label(_labelled(spark, sf_dir, label=LABEL), LABEL)
    return folds.stratified_folds(train, LABEL, ID, FOLDS, SEED).select(ID, F.col("fold").cast("bigint").alias("fold"))


def _nested(spark, sf_dir, columns=()) -> DataFrame:
    train = _labelled(spark, sf_dir, columns)
    return folds.nested_folds(train, "churn_planted", ID, FOLDS, INNER, SEED)


def nested_folds(spark, sf_dir):
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("fold", "inner_fold")]
    return _nested(spark, sf_dir).select(ID, *numbers)


def fold_sizes(spark, sf_dir):
    return _nested(spark, sf_dir).groupBy(
        F.col("churn_planted").cast("bigint").alias("label"),
        F.col("fold").cast("bigint").alias("fold"),
        F.col("inner_fold").cast("bigint").alias("inner_fold"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


# metrics -----------------------------------------------------------------------------------------


def roc_auc_exact(spark, sf_dir):
    view = subjects(spark, sf_dir, ["tenure", "Contract", "churn_planted"])
    return rounded(metrics.roc_auc(view, "tenure", "churn_planted", ["Contract"]), ["Contract"], ["auc"])


def roc_auc_pooled(spark, sf_dir):
    view = subjects(spark, sf_dir, ["MonthlyCharges", "churn_planted"])
    return rounded(metrics.roc_auc(view, "MonthlyCharges", "churn_planted"), [], ["auc"])


def log_loss(spark, sf_dir):
    view = subjects(spark, sf_dir, ["tenure", "Contract", "churn_planted"])
    scored = view.withColumn("p", 1 - F.col("tenure") / 79)
    return rounded(metrics.log_loss(scored, "p", "churn_planted", ["Contract"]), ["Contract"], ["log_loss"])


def _oof_means(spark, sf_dir) -> DataFrame:
    """Rows scored by the label mean of their contract in the other folds."""
    train = _labelled(spark, sf_dir, ["Contract"])
    rows = stage(folds.stratified_folds(train, "churn_planted", ID, FOLDS, SEED), "folded")
    cells = encode.target_cells(rows, ["Contract"], "churn_planted", ["fold"])
    prior = rows.agg(F.avg("churn_planted")).first()[0]
    stats = encode.out_of_fold_stats(cells, "fold", FOLDS, prior, ["mean"])
    return encode.apply_target_stats(rows, stats, {"Contract": ["mean"]}, F.col("fold"))


def fold_auc_range(spark, sf_dir):
    found = metrics.fold_auc_range(fold_auc_summary(spark, sf_dir))
    return rounded(found, ["folds"], ["lowest", "highest", "mean"])


def oof_target_mean_auc(spark, sf_dir):
    scored = _oof_means(spark, sf_dir)
    return rounded(metrics.fold_auc_summary(scored, "TE_Contract_mean", "churn_planted", "fold"), ["label"], ["auc"])


def fold_auc_summary(spark, sf_dir):
    rows = folds.stratified_folds(
        _labelled(spark, sf_dir, ["MonthlyCharges"]), "churn_planted", ID, FOLDS, SEED
    )
    return rounded(metrics.fold_auc_summary(rows, "MonthlyCharges", "churn_planted", "fold"), ["label"], ["auc"])


def prediction_histogram(spark, sf_dir):
    view = subjects(spark, sf_dir, ["MonthlyCharges"])
    return rounded(metrics.histogram(view, "MonthlyCharges"), ["bin", "n_rows"], ["low", "high"])


def topk_scores(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    named = part.select(
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("feature"),
        F.col("p_retailprice").alias("importance"),
    )
    return metrics.top_scores(named, "feature", "importance", 20)


# row features ------------------------------------------------------------------------------------


def ratio_features(spark, sf_dir):
    df = row.ratio_features(_probes(cleaned(spark, sf_dir, NUMERIC)))
    return rounded(df, [ID], ["charges_deviation", "monthly_to_total_ratio", "avg_monthly_charges"])


def service_flags(spark, sf_dir):
    df = row.service_features(subjects(spark, sf_dir, [ID, "InternetService", *SERVICES]))
    return rounded(df, [ID], ["service_count", "has_internet", "has_phone"])


def _digits(plan: row.DigitPlan) -> Query:
    def query(spark, sf_dir):
        if plan.column == "TotalCharges":
            base = _probes(cleaned(spark, sf_dir, [plan.column])).drop("split")
        else:
            base = subjects(spark, sf_dir, [ID, plan.column])
        df = row.digit_features(base, plan)
        return rounded(df, [ID], [c for c in df.columns if c.startswith(f"{plan.prefix}_")])

    return query


def per_tenure_ratios(spark, sf_dir):
    df = row.per_tenure_features(_probes(cleaned(spark, sf_dir, NUMERIC)))
    return rounded(df, [ID], ["monthly_per_tenure", "total_per_tenure"])


def numeric_keys(spark, sf_dir):
    """Rows per category of every number key; the key is shown as the number it stands for."""
    view = subjects(spark, sf_dir, NUMERIC)
    keys = row.numeric_keys(view.withColumn("TotalCharges", clean.number(view, "TotalCharges")))
    names = [f"CAT_{c}" for c in NUMERIC]
    counts = keys.select(names).unpivot([], names, "key", "value").groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    shown = counts.withColumn("number", F.when(F.col("value") != "nan", F.col("value").try_cast("double")))
    return rounded(shown, ["key", "n_rows"], ["number"])


def _ngrams(size: int) -> Query:
    sources = NGRAM_SOURCES if size == 2 else NGRAM_SOURCES[:4]

    def query(spark, sf_dir):
        groups = row.ngram_groups(size, sources)
        return row.ngram_keys(subjects(spark, sf_dir, [ID, *sources]), groups).select(ID, *groups)

    return query


# population features -----------------------------------------------------------------------------


def frequency_encode(spark, sf_dir):
    parts = cleaned(spark, sf_dir, NUMERIC)
    profiles = pop.value_profiles(ensemble.union_all(list(parts.values())), NUMERIC, {"all": F.lit(True)}, {})
    df = _probes(parts)
    for column in NUMERIC:
        df = pop.value_shares(df, profiles[column])
    return rounded(df, [ID], [f"FREQ_{c}" for c in NUMERIC])


def bag_union(spark, sf_dir):
    parts = cleaned(spark, sf_dir, ["tenure"])
    counts = pop.frequencies(list(parts.values()), "tenure")
    return rounded(counts, [F.col("value").cast("bigint").alias("tenure")], ["share"])


def reference_target_rate(spark, sf_dir):
    columns = CATEGORICAL + NUMERIC
    parts = cleaned(spark, sf_dir, [*columns, LABEL])
    labelled = {"labelled": F.col(LABEL).isNotNull(), "positive": F.col(LABEL) == 1}
    profiles = pop.value_profiles(parts["orig"], NUMERIC, labelled, {})
    df = pop.reference_rates(_probes(parts), pop.category_profile(parts["orig"], CATEGORICAL, LABEL), CATEGORICAL)
    for column in NUMERIC:
        df = pop.value_rates(df, profiles[column], "positive", "labelled")
    return rounded(df, [ID], [f"ORIG_proba_{c}" for c in columns])


def group_residual(spark, sf_dir):
    parts = cleaned(spark, sf_dir, ["InternetService", "MonthlyCharges", LABEL])
    profile = pop.category_profile(parts["orig"], ["InternetService"], LABEL, ["MonthlyCharges"])
    df = pop.group_residual(_probes(parts), profile, "InternetService", "MonthlyCharges", "resid_IS_MC")
    return rounded(df, [ID], ["resid_IS_MC"])


def zscore_gap(spark, sf_dir):
    parts = cleaned(spark, sf_dir, ["TotalCharges", LABEL])
    moments = pop.class_moments(parts["orig"], "TotalCharges", LABEL).first().asDict()
    df = pop.z_score_gap(_probes(parts), "TotalCharges", moments)
    return rounded(df, [ID], ["zscore_churn_gap_TC", "zscore_nonchurner_TC"])


def quantile_distance(spark, sf_dir):
    parts = cleaned(spark, sf_dir, ["TotalCharges", LABEL])
    classes = {"ch": F.col(LABEL) == 1, "nc": F.col(LABEL) == 0}
    ranked = {"TotalCharges": list(classes)}
    profile = pop.value_profiles(parts["orig"], ["TotalCharges"], classes, ranked)["TotalCharges"]
    quartiles = pop.reference_quantiles(profile, {c: c for c in classes}).first().asDict()
    df = pop.quantile_distances(_probes(parts), "TotalCharges", quartiles)
    return rounded(df, [ID], [c for c in df.columns if c.startswith(("dist_To", "qdist"))])


def ecdf_rank(spark, sf_dir):
    parts = cleaned(spark, sf_dir, ["TotalCharges", LABEL])
    subsets = {
        "pctrank_nonchurner_TC": F.col(LABEL) == 0,
        "pctrank_churner_TC": F.col(LABEL) == 1,
        "pctrank_orig_TC": F.lit(True),
    }
    df = pop.ecdf_against(_probes(parts), parts["orig"], "TotalCharges", subsets)
    gap = F.col("pctrank_churner_TC") - F.col("pctrank_nonchurner_TC")
    return rounded(df.withColumn("pctrank_churn_gap_TC", gap), [ID], [*subsets, "pctrank_churn_gap_TC"])


def _ecdf_by(group: str, name: str) -> Query:
    def query(spark, sf_dir):
        parts = cleaned(spark, sf_dir, ["TotalCharges", group])
        df = pop.ecdf_against(
            _probes(parts), parts["orig"], "TotalCharges", {name: F.lit(True)}, group=group
        )
        return rounded(df, [ID], [name])

    return query


def ecdf_apply(spark, sf_dir):
    """Ranks of values that the reference does not hold, by an index that was stored and read again."""
    parts = cleaned(spark, sf_dir, ["TotalCharges", "Contract", LABEL])
    probes = _probes(parts).withColumn("TotalCharges", F.col("TotalCharges") * 1.0001 + 0.005)
    subsets = {"rank_nonchurner": F.col(LABEL) == 0, "rank_churner": F.col(LABEL) == 1}
    for name, tests, group in (("all", subsets, None), ("contract", {"rank_contract": F.lit(True)}, "Contract")):
        path = f"{shared_dir(spark)}/rank-index-{name}-{uuid.uuid4().hex}"
        RankIndex.fit(parts["orig"], "TotalCharges", tests, group).save(path)
        probes = RankIndex.load(spark, path).apply(probes, "TotalCharges")
    return rounded(probes, [ID], [*subsets, "rank_contract"])


# target encoding ---------------------------------------------------------------------------------


def _te(spark, sf_dir, part: str) -> DataFrame:
    """Encodings of all keys and outer folds for their training, held-out or test rows, from one lookup per key."""
    columns = matrix_columns()
    sources = [*CATEGORICAL, *NUMERIC]

    def keyed(split: str, *others: str) -> DataFrame:
        view = subjects(spark, sf_dir, [ID, "split", *sources, *others]).where(F.col("split") == split)
        return view.withColumn("TotalCharges", clean.number(view, "TotalCharges"))

    train = clean.impute_median(keyed("train", "churn_planted"), "TotalCharges")
    rows = stage(folds.nested_folds(train, "churn_planted", ID, FOLDS, INNER, SEED), "folded")
    rows = row.ngram_keys(row.numeric_keys(rows), row.all_ngram_groups())
    cells = key_cells(rows, columns, "churn_planted", "inner_fold", INNER, "fold")
    stats = cells.all_stats(rows, "churn_planted", FOLDS)
    wanted = wanted_stats(columns)
    names = [f"TE_{c}_{s}" for c, found in wanted.items() for s in found]
    if part == "test":
        test = clean.impute_median(keyed("test"), "TotalCharges")
        test = row.ngram_keys(row.numeric_keys(test), row.all_ngram_groups())
        coded = encode.apply_all_folds(test, stats, wanted, "held_out")
    else:
        coded = encode.apply_all_folds(rows, stats, wanted, "held_out", "fold", "inner_fold")
        own = F.col("held_out") == F.col("fold")
        coded = coded.where(own if part == "valid" else ~own)
    return rounded(coded.withColumn("held_out", F.col("held_out").cast("bigint")), [ID, "held_out"], names)


def nested_te_numeric(spark, sf_dir):
    """Encodings of a label of any numbers, for the training and held-out rows of all outer folds."""
    train = _labelled(spark, sf_dir, ["split", "tenure", "Contract", "PaymentMethod", "MonthlyCharges", "TotalCharges"]).where("split = 'train'")
    rows = stage(folds.nested_folds(train, "churn_planted", ID, FOLDS, INNER, SEED), "folded")
    rows = row.numeric_keys(rows.withColumn("TotalCharges", clean.number(rows, "TotalCharges")))
    cells = encode.numeric_cells(rows, NUMERIC_KEYS, "MonthlyCharges", ["fold", "inner_fold"])
    priors = {r["fold"]: r["prior"] for r in encode.fold_priors(rows, "MonthlyCharges", "fold").collect()}
    stats = encode.numeric_out_of_fold_stats(cells, "fold", "inner_fold", INNER, [priors[k] for k in range(FOLDS)], ENCODED_STATS)
    coded = encode.apply_all_folds(rows, stats, {c: ENCODED_STATS for c in NUMERIC_KEYS}, "held_out", "fold", "inner_fold")
    names = [f"TE_{c}_{s}" for c in NUMERIC_KEYS for s in ENCODED_STATS]
    return rounded(coded.withColumn("held_out", F.col("held_out").cast("bigint")), [ID, "held_out"], names)


def fold_prior(spark, sf_dir):
    priors = encode.fold_priors(_nested(spark, sf_dir), "churn_planted", "fold")
    return rounded(priors.withColumn("fold", F.col("fold").cast("bigint")), ["fold", "n_train"], ["prior"])


def smoothed_te(spark, sf_dir):
    columns = ["Contract", "PaymentMethod", "tenure"]
    view = subjects(spark, sf_dir, [ID, "split", "churn_planted", *columns])
    model = encode.SmoothedTargetEncoder(columns).fit(view.where("split = 'train'"), "churn_planted")
    return rounded(model.transform(view), [ID, "split"], columns)


# matrices ----------------------------------------------------------------------------------------


def _matrices(spark, sf_dir, fold: Callable[[DataFrame], DataFrame] | None = None):
    """Feature matrices of the stored subjects. With ``fold``, on the planted label and folded rows."""
    view = subjects(spark, sf_dir)
    view = view.withColumn(LABEL, F.col("churn_planted")) if fold else clean.map_label(view, LABEL)
    view = stage(view.drop("churn_planted"), "subjects")
    parts = {s: view.where(F.col("split") == s).drop("split") for s in ("train", "test", "orig")}
    train = stage(fold(parts["train"]), "folded") if fold else parts["train"]
    return build_feature_matrices(train, parts["test"].drop(LABEL), parts["orig"], LABEL)


def feature_matrix(spark, sf_dir):
    train, test, columns = _matrices(spark, sf_dir)
    features = [c for c in test.columns if c not in {ID, *columns.keys}]
    return rounded(
        train.drop(LABEL).withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test"))),
        [ID, "split"],
        features,
    )


def fold_encoded_matrix(spark, sf_dir):
    """All features of the training, held-out and test rows of every outer fold."""
    train, test, columns = _matrices(
        spark, sf_dir, lambda df: folds.nested_folds(df, LABEL, ID, FOLDS, INNER, SEED)
    )
    fitted, tested, features, _ = encode_all_folds(stage(train, "train-features"), test, columns, FOLDS, INNER, LABEL, ID)
    place = F.when(F.col("fold") == F.col("held_out"), "valid").otherwise("train")
    whole = ensemble.union_all([
        df.select(ID, F.col("held_out").cast("bigint").alias("held_out"), part.alias("part"), *features)
        for df, part in ((fitted, place), (tested, F.lit("test")))
    ])
    return rounded(whole, [ID, "held_out", "part"], features)


# ensembles and runs ------------------------------------------------------------------------------


def _fold_predictions(spark, sf_dir) -> list[DataFrame]:
    rows = stage(folds.stratified_folds(
        _labelled(spark, sf_dir, ["tenure"]), "churn_planted", ID, FOLDS, SEED
    ))
    return [
        rows.where(F.col("fold") == k).select(ID, "fold", (F.col("tenure") / (80.0 + k)).alias("oof_pred"))
        for k in range(FOLDS)
    ]


def oof_union(spark, sf_dir):
    whole = ensemble.union_all(_fold_predictions(spark, sf_dir))
    return rounded(whole.withColumn("fold", F.col("fold").cast("bigint")), [ID, "fold"], ["oof_pred"])


def oof_coverage(spark, sf_dir):
    return ensemble.coverage(ensemble.union_all(_fold_predictions(spark, sf_dir)), ID)


def ensemble_mean(spark, sf_dir):
    test = subjects(spark, sf_dir, [ID, "split", "tenure"]).where("split = 'test'")
    scored = [test.select(ID, F.lit(k).alias("fold"), (F.col("tenure") / (80.0 + k)).alias("p")) for k in range(FOLDS)]
    return rounded(ensemble.ensemble_mean(ensemble.union_all(scored), ID, "p", LABEL), [ID], [LABEL])


def submission_counted(spark, sf_dir):
    """The run number that follows stored names, with names made of the order keys."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    names = orders.select(
        F.concat(
            F.when(F.col("o_orderkey") % 3 == 0, "submission_").otherwise("oof_predictions_"),
            F.col("o_orderkey").cast("string"),
            F.when(F.col("o_orderkey") % 2 == 0, ".csv").otherwise(".txt"),
        ).alias("name")
    )
    return next_run_number(names, "name", "submission", ".csv")


def run_clock(spark, sf_dir):
    """Durations in clock format: a minute and a quarter second for every unit of an order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    total = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("seconds"))
    return total.select("l_orderkey", "seconds", clock_text(F.col("seconds") * 60.25).alias("clock"))


# models ------------------------------------------------------------------------------------------

_FITTED: dict[tuple[str, str], CrossValidation] = {}


def _fitted(spark: SparkSession, sf_dir: str) -> CrossValidation:
    """One cross-validation per session and data folder, shared by the model queries."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _FITTED:
        train, test, columns = _matrices(
            spark, sf_dir, lambda df: folds.nested_folds(df, LABEL, ID, FOLDS, INNER, SEED)
        )
        _FITTED[place] = cross_validated_fit(train, test, columns)
    return _FITTED[place]


def gbt_cv_oof(spark, sf_dir):
    return _fitted(spark, sf_dir).oof.select(ID, LABEL, "fold", F.col("oof_pred").cast("float").alias("oof_pred"))


def gbt_test_ensemble(spark, sf_dir):
    return _fitted(spark, sf_dir).submission()


def gbt_fold_scores(spark, sf_dir):
    return _fitted(spark, sf_dir).scores()


def gbt_importance(spark, sf_dir):
    return metrics.top_scores(_fitted(spark, sf_dir).importance(), "feature", "importance", 20)


def gbt_eval_history(spark, sf_dir):
    return _fitted(spark, sf_dir).history()


def gbt_oof_rows(spark, sf_dir):
    """Who is predicted in which fold: every training row once, with a probability."""
    found = _fitted(spark, sf_dir).oof
    return found.select(ID, F.col(LABEL).cast("bigint").alias(LABEL), F.col("fold").cast("bigint").alias("fold"), F.col("oof_pred").between(0, 1).alias("in_range"))


def gbt_test_rows(spark, sf_dir):
    return _fitted(spark, sf_dir).submission().select(ID, F.col(LABEL).between(0, 1).alias("in_range"))


def gbt_importance_rows(spark, sf_dir):
    """Per fold: whether features split, with a positive gain that is the total over the splits."""
    gains = _fitted(spark, sf_dir).gains().groupBy(F.col("fold").cast("bigint").alias("fold"))
    mean = F.abs(F.col("gain") * F.col("n_splits") - F.col("total_gain")) <= 1e-9 * F.col("total_gain")
    return gains.agg(
        (F.count_distinct("feature") == F.count("feature")).alias("distinct"), F.every((F.col("n_splits") > 0) & (F.col("gain") > 0) & mean).alias("positive")
    )


def gbt_history_rows(spark, sf_dir):
    """Per fold and split: the first round, whether losses and areas of all rounds are there, and whether the kept
    round is the best one seen."""
    found = _fitted(spark, sf_dir)
    rows = found.history().withColumn("kept", F.get(F.array([F.lit(rounds - 1) for rounds in found.rounds]), F.col("fold")))
    last, first = F.max("iteration"), F.min("iteration").cast("bigint")
    best = F.max(F.when(F.col("iteration") == F.col("kept"), F.col("auc"))) >= F.max(F.when(F.col("iteration") <= F.col("kept") + 9, F.col("auc")))
    return rows.groupBy(F.col("fold").cast("bigint").alias("fold"), "split").agg(
        first.alias("first_round"), ((F.min("loss") > 0) & (F.count("loss") == last + 1) & (F.count("auc") == last + 1)).alias("complete"),
        F.when(F.col("split") == "valid", best).otherwise(True).alias("best_kept"),
    )


def registered() -> dict[str, Query]:
    named = [
        clean_impute, label_map, label_null_check, class_profile, table_shape, schema_profile, constant_fill,
        stratified_folds, nested_folds, fold_sizes,
        roc_auc_exact, roc_auc_pooled, log_loss, oof_target_mean_auc, fold_auc_summary, fold_auc_range,
        prediction_histogram, topk_scores,
        ratio_features, service_flags, per_tenure_ratios, numeric_keys,
        frequency_encode, bag_union, reference_target_rate, group_residual, zscore_gap, quantile_distance,
        ecdf_rank, ecdf_apply, nested_te_numeric, fold_prior, smoothed_te, feature_matrix, fold_encoded_matrix,
        oof_union, oof_coverage, ensemble_mean, run_clock,
        gbt_cv_oof, gbt_test_ensemble, gbt_fold_scores, gbt_importance, gbt_eval_history,
        gbt_oof_rows, gbt_test_rows, gbt_importance_rows, gbt_history_rows,
    ]
    queries: dict[str, Query] = {q.__name__: q for q in named}
    queries |= {
        "digit_tenure": _digits(row.TENURE_DIGITS),
        "digit_monthly": _digits(row.MONTHLY_DIGITS),
        "digit_total": _digits(row.TOTAL_DIGITS),
        "ngram_bigrams": _ngrams(2),
        "ngram_trigrams": _ngrams(3),
        "ecdf_rank_by_internet": _ecdf_by("InternetService", "cond_pctrank_IS_TC"),
        "ecdf_rank_by_contract": _ecdf_by("Contract", "cond_pctrank_C_TC"),
        "nested_te_train": lambda spark, sf_dir: _te(spark, sf_dir, "train"),
        "te_validation": lambda spark, sf_dir: _te(spark, sf_dir, "valid"),
        "te_test": lambda spark, sf_dir: _te(spark, sf_dir, "test"),
        "next_run_number": submission_counted,
    }
    return queries
