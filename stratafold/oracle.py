"""Each query of the catalog as plain SQL, written from the definitions and not from the plans."""

from __future__ import annotations

from itertools import combinations

from stratafold.catalog import FOLDS, INNER, NUMERIC_KEYS, SEED
from stratafold.functions.numbers import NUMBER_TEXT
from stratafold.schema import (
    CATEGORICAL, ENCODED_STATS, NGRAM_SOURCES, NUMERIC, SERVICES, table_schema,
)
from stratafold.sources.subjects import subjects_sql

_CLASSES = {"ch": '"Churn" = 1', "nc": '"Churn" = 0'}
_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def six(expression: str, name: str) -> str:
    return f'floor(CAST({expression} AS DOUBLE) * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6 AS "{name}"'


def single(expression: str) -> str:
    return f"CAST({expression} AS FLOAT)"


def quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


_NUMBER = (
    'CASE WHEN regexp_full_match(trim("TotalCharges"), \'' + NUMBER_TEXT.strip("^$")
    + '\') THEN TRY_CAST(trim("TotalCharges") AS DOUBLE) END'
)
_LABEL = "CASE trim(\"Churn\") WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END"
_BASE = f"""
    raw AS ({subjects_sql()}),
    parsed AS (SELECT * REPLACE ({_NUMBER} AS "TotalCharges", {_LABEL} AS "Churn") FROM raw),
    medians AS (SELECT split AS m_split, quantile_cont("TotalCharges", 0.5) AS middle FROM parsed GROUP BY split),
    filled AS (
        SELECT parsed.* REPLACE (coalesce("TotalCharges", middle) AS "TotalCharges")
        FROM parsed JOIN medians ON split = m_split
    ),
    planted AS (SELECT * REPLACE (churn_planted AS "Churn") FROM filled)"""


def with_base(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([_BASE.strip(), *[c.strip() for c in ctes]]) + " " + body


def from_view(body: str) -> str:
    return f"WITH raw AS ({subjects_sql()}) {body}"


def probes(columns: str, source: str = "filled") -> str:
    return f"SELECT id, {columns} FROM {source} WHERE split IN ('train', 'test')"


# folds -------------------------------------------------------------------------------------------


def folds_cte(name: str, source: str, label: str, count: int, fold: str, where: str = "TRUE") -> str:
    return (
        f"{name} AS (SELECT *, (row_number() OVER (ORDER BY {label}, "
        f"md5(CAST(id AS VARCHAR) || '#{SEED}'), id) - 1) % {count} AS {fold} FROM {source} WHERE {where})"
    )


_FOLDED = folds_cte("folded", "filled", "churn_planted", FOLDS, "fold")
_FOLDED_TRAIN = folds_cte("folded", "filled", "churn_planted", FOLDS, "fold", "split = 'train'")
_NESTED = (
    "nested AS (SELECT *, (row_number() OVER (ORDER BY churn_planted, fold, "
    f"md5(CAST(id AS VARCHAR) || '#{SEED}'), id) - 1) % {INNER} AS inner_fold FROM folded)"
)


# metrics -----------------------------------------------------------------------------------------


def auc_sql(source: str, score: str, label: str, group: str) -> str:
    """Rank-sum form: mean ranks of the positives against the number of pairs."""
    return f"""
        SELECT g AS "label", {six('''CASE WHEN p > 0 AND n > 0 THEN
            (ranks - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) END''', 'auc')}
        FROM (
            SELECT g, sum(CASE WHEN y = 1 THEN mean_rank ELSE 0 END) AS ranks,
                   CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS p,
                   CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS n
            FROM (
                SELECT g, y, rank() OVER (PARTITION BY g ORDER BY v)
                             + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS mean_rank
                FROM (SELECT {group} AS g, {score} AS v, {label} AS y FROM {source})
            ) GROUP BY g
        )"""


def summary_sql(source: str, score: str) -> str:
    per_fold = auc_sql(source, score, "churn_planted", "'Fold ' || CAST(fold + 1 AS VARCHAR)")
    return f"{per_fold} UNION ALL {auc_sql(source, score, 'churn_planted', chr(39) + 'Overall' + chr(39))}"


# row features ------------------------------------------------------------------------------------


def floor_mod(x: str, n: int) -> str:
    return f"((({x}) % {n} + {n}) % {n})"


def digits(prefix: str, value: str, whole: bool, mods, multiples, unit: int, years=None) -> dict[str, str]:
    i = f"CAST(floor({value}) AS BIGINT)"
    base = f"CAST({i} AS DOUBLE)" if whole else f"({value})"
    out = {f"{prefix}_mod_{m}": floor_mod(i, m) for m in mods}
    if years:
        out[f"{prefix}_years"] = f"floor(CAST({i} AS DOUBLE) / {years})"
    out[f"{prefix}_last_digit"] = floor_mod(i, 10)
    out[f"{prefix}_tens_digit"] = floor_mod(f"CAST(floor(CAST({i} AS DOUBLE) / 10) AS BIGINT)", 10)
    for m in multiples:
        out[f"{prefix}_is_multiple_{m}"] = f"CASE WHEN {floor_mod(i, m)} = 0 THEN 1 ELSE 0 END"
    near = single(f"round_even({base} / {float(unit)}, 0) * {unit}")
    out[f"{prefix}_rounded_{unit}"] = near
    out[f"{prefix}_dev_from_round{unit}"] = f"abs({base} - CAST({near} AS DOUBLE))"
    if not whole:
        out[f"{prefix}_fractional"] = f"{value} - floor({value})"
    out[f"{prefix}_digit_count"] = f"length(CAST({i} AS VARCHAR))"
    return {k: single(v) for k, v in out.items()}


def zero(column: str) -> str:
    return f'coalesce(CAST("{column}" AS DOUBLE), 0.0)'


DIGITS = {
    "digit_tenure": digits("tenure", zero("tenure"), True, [12], [10], 10, 12),
    "digit_monthly": digits("monthly", zero("MonthlyCharges"), False, [10, 100], [10, 50], 10),
    "digit_total": digits("total", zero("TotalCharges"), False, [10, 100], [10, 100], 100),
}
RATIOS = {
    "charges_deviation": single('"TotalCharges" - tenure * "MonthlyCharges"'),
    "monthly_to_total_ratio": single('CASE WHEN "TotalCharges" + 1 <> 0 THEN "MonthlyCharges" / ("TotalCharges" + 1) END'),
    "avg_monthly_charges": single('CASE WHEN tenure + 1 <> 0 THEN "TotalCharges" / (tenure + 1) END'),
}
PER_TENURE = {
    f"{n}_per_tenure": single(f"CASE WHEN {zero('tenure')} + 1 <> 0 THEN {zero(c)} / ({zero('tenure')} + 1) END")
    for n, c in (("monthly", "MonthlyCharges"), ("total", "TotalCharges"))
}
FLAGS = {
    "service_count": single(" + ".join(f"CASE WHEN \"{c}\" = 'Yes' THEN 1 ELSE 0 END" for c in SERVICES)),
    "has_internet": single("CASE WHEN \"InternetService\" = 'No' THEN 0 ELSE 1 END"),
    "has_phone": single("CASE WHEN \"PhoneService\" = 'Yes' THEN 1 ELSE 0 END"),
}


def ngram(parts) -> str:
    return " || '_' || ".join(f"coalesce(\"{p}\", 'nan')" for p in parts)


NGRAMS = {"BG_" + "_".join(p): ngram(p) for p in combinations(NGRAM_SOURCES, 2)} | {
    "TG_" + "_".join(p): ngram(p) for p in combinations(NGRAM_SOURCES[:4], 3)
}
CAT_KEYS = {f"CAT_{c}": f"coalesce(CAST(CAST(\"{c}\" AS DOUBLE) AS VARCHAR), 'nan')" for c in NUMERIC}


def columns_of(expressions: dict[str, str]) -> str:
    return ", ".join(six(e, n) for n, e in expressions.items())


# population features -----------------------------------------------------------------------------

POPULATION = {f"FREQ_{c}": single(f'coalesce("f_{c}".share, 0)') for c in NUMERIC}
POPULATION |= {f"ORIG_proba_{c}": single(f'coalesce("o_{c}".rate, 0.5)') for c in CATEGORICAL + NUMERIC}
POPULATION |= {
    "pctrank_nonchurner_TC": single("ranks.nc"),
    "pctrank_churner_TC": single("ranks.ch"),
    "pctrank_orig_TC": single("ranks.al"),
    "pctrank_churn_gap_TC": f"{single('ranks.ch')} - {single('ranks.nc')}",
    "zscore_nonchurner_TC": single('("TotalCharges" - nc_mean) / nc_std'),
    "zscore_churn_gap_TC": (
        f"abs({single('(\"TotalCharges\" - ch_mean) / ch_std')}) - abs({single('(\"TotalCharges\" - nc_mean) / nc_std')})"
    ),
    "resid_IS_MC": single('"MonthlyCharges" - coalesce(is_mean, 0)'),
    "cond_pctrank_IS_TC": single("coalesce(rank_is.share, 0)"),
    "cond_pctrank_C_TC": single("coalesce(rank_c.share, 0)"),
}
for _q in _QUARTILES:
    for _c in _CLASSES:
        POPULATION[f"dist_To_{_c}_{_q}"] = single(f'abs("TotalCharges" - {_c}_{_q})')
    POPULATION[f"qdist_gap_To_{_q}"] = (
        f'{single(f"abs(\"TotalCharges\" - nc_{_q})")} - {single(f"abs(\"TotalCharges\" - ch_{_q})")}'
    )


def share_cte(column: str, source: str = "filled") -> str:
    return (
        f'"f_{column}" AS (SELECT "{column}" AS v, count(*) / CAST((SELECT count("{column}") FROM {source}) AS DOUBLE) '
        f'AS share FROM {source} WHERE "{column}" IS NOT NULL GROUP BY 1)'
    )


def rate_cte(column: str, source: str = "filled") -> str:
    return f'"o_{column}" AS (SELECT "{column}" AS v, avg("Churn") AS rate FROM {source} WHERE split = \'orig\' GROUP BY 1)'


def ranks_cte(source: str = "filled") -> str:
    """Strictly-less shares by running sums over the distinct values of all rows."""
    sums = ", ".join(
        f"coalesce(sum(n_{k}) OVER w, 0) / CAST(sum(n_{k}) OVER () AS DOUBLE) AS {k}" for k in ("al", "ch", "nc")
    )
    return (
        'ranks AS (SELECT v, ' + sums + ' FROM (SELECT "TotalCharges" AS v, '
        "count(*) FILTER (WHERE split = 'orig') AS n_al, "
        + ", ".join(f"count(*) FILTER (WHERE split = 'orig' AND {t}) AS n_{k}" for k, t in _CLASSES.items())
        + f" FROM {source} GROUP BY 1) WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    )


def group_ranks_cte(name: str, group: str, source: str = "filled") -> str:
    return (
        f'{name} AS (SELECT g, v, CASE WHEN sum(n) OVER (PARTITION BY g) > 0 THEN coalesce(sum(n) OVER w, 0) '
        f'/ CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) ELSE 0 END AS share FROM ('
        f'SELECT "{group}" AS g, "TotalCharges" AS v, count(*) FILTER (WHERE split = \'orig\') AS n '
        f'FROM {source} WHERE "{group}" IS NOT NULL GROUP BY 1, 2) '
        "WINDOW w AS (PARTITION BY g ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    )


def moments_cte(source: str = "filled") -> str:
    stats = []
    for k, test in _CLASSES.items():
        stats += [
            f'avg("TotalCharges") FILTER (WHERE {test}) AS {k}_mean',
            f'stddev_pop("TotalCharges") FILTER (WHERE {test}) AS {k}_std',
        ]
        stats += [
            f'quantile_cont("TotalCharges", {p}) FILTER (WHERE {test}) AS {k}_{q}' for q, p in _QUARTILES.items()
        ]
    return f"moments AS (SELECT {', '.join(stats)} FROM {source} WHERE split = 'orig')"


def residual_cte(source: str = "filled") -> str:
    return (
        f'residuals AS (SELECT "InternetService" AS is_group, avg("MonthlyCharges") AS is_mean FROM {source} '
        "WHERE split = 'orig' GROUP BY 1)"
    )


def population_ctes(source: str = "filled") -> list[str]:
    return [
        *[share_cte(c, source) for c in NUMERIC],
        *[rate_cte(c, source) for c in CATEGORICAL + NUMERIC],
        ranks_cte(source),
        group_ranks_cte("rank_is", "InternetService", source),
        group_ranks_cte("rank_c", "Contract", source),
        moments_cte(source),
        residual_cte(source),
    ]


def population_joins() -> str:
    joins = [f'LEFT JOIN "f_{c}" ON t."{c}" = "f_{c}".v' for c in NUMERIC]
    joins += [f'LEFT JOIN "o_{c}" ON t."{c}" = "o_{c}".v' for c in CATEGORICAL + NUMERIC]
    joins += [
        'LEFT JOIN ranks ON t."TotalCharges" = ranks.v',
        'LEFT JOIN rank_is ON t."TotalCharges" = rank_is.v AND t."InternetService" = rank_is.g',
        'LEFT JOIN rank_c ON t."TotalCharges" = rank_c.v AND t."Contract" = rank_c.g',
        'LEFT JOIN residuals ON t."InternetService" = is_group',
        "CROSS JOIN moments",
    ]
    return " ".join(joins)


def picked(names, joins: str) -> str:
    return f"SELECT t.id, {columns_of({n: POPULATION[n] for n in names})} FROM filled t {joins} WHERE split IN ('train', 'test')"


# target encoding ---------------------------------------------------------------------------------


def te_ctes(source: str, keys: dict[str, tuple[str, list[str]]], held_out: int) -> list[str]:
    """Per key and left-out inner fold, the label statistics of all other training rows.

    Slot ``INNER`` leaves nothing out. ``keys`` maps a name to its expression and statistics.
    """
    aggregates = {"mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)"}
    ctes = []
    for name, (expression, stats) in keys.items():
        listed = ", ".join(f"{aggregates[s]} AS {s}" for s in stats)
        ctes.append(
            f'"t_{name}" AS (SELECT slot, k, {listed} FROM (SELECT {expression} AS k, inner_fold, '
            f"CAST(\"y\" AS DOUBLE) AS y FROM {source} WHERE fold <> {held_out}) "
            f"JOIN (SELECT CAST(range AS BIGINT) AS slot FROM range({INNER + 1})) ON inner_fold <> slot "
            "WHERE k IS NOT NULL GROUP BY 1, 2)"
        )
    ctes.append(f'prior AS (SELECT avg("y") AS p FROM {source} WHERE fold <> {held_out})')
    return ctes


def te_columns(keys: dict[str, tuple[str, list[str]]]) -> dict[str, str]:
    return {
        f"TE_{name}_{s}": single(f'coalesce("t_{name}".{s}, {"prior.p" if s == "mean" else "0"})')
        for name, (_, stats) in keys.items()
        for s in stats
    }


def te_joins(keys: dict[str, tuple[str, list[str]]], slot: str) -> str:
    joins = [f'LEFT JOIN "t_{n}" ON {e} = "t_{n}".k AND "t_{n}".slot = {slot}' for n, (e, _) in keys.items()]
    return " ".join([*joins, "CROSS JOIN prior"])


def encoded_keys() -> dict[str, tuple[str, list[str]]]:
    plain = {c: f'"{c}"' for c in CATEGORICAL}
    return {k: (e, ENCODED_STATS) for k, e in (CAT_KEYS | plain).items()} | {k: (e, ["mean"]) for k, e in NGRAMS.items()}


def all_folds(keys: dict, label: str, columns: str, source: str, slot: str, where: str) -> str:
    """The encodings of every outer fold, each by direct grouping of its training rows."""
    parts = []
    for k in range(FOLDS):
        ctes = [_FOLDED_TRAIN, _NESTED, f"training AS (SELECT *, {label} AS y FROM nested)", *te_ctes("training", keys, k)]
        body = f"SELECT id, CAST({k} AS BIGINT) AS held_out, {columns} FROM {source} {te_joins(keys, slot)} WHERE {where.format(k=k)}"
        parts.append(f"SELECT * FROM ({with_base(body, *ctes)})")
    return " UNION ALL ".join(parts)


def te_queries() -> dict[str, str]:
    keys = encoded_keys()
    columns = columns_of(te_columns(keys))
    numeric = {k: (CAT_KEYS.get(k, f'"{k}"'), ENCODED_STATS) for k in NUMERIC_KEYS}
    either = f"CASE WHEN fold = {{k}} THEN {INNER} ELSE inner_fold END"
    parts = [
        all_folds(numeric, '"MonthlyCharges"', columns_of(te_columns(numeric)), "training", either.format(k=k), f"{k} = {{k}}") for k in range(FOLDS)
    ]
    return {
        "nested_te_train": all_folds(keys, "churn_planted", columns, "training", "inner_fold", "fold <> {k}"),
        "te_validation": all_folds(keys, "churn_planted", columns, "training", str(INNER), "fold = {k}"),
        "te_test": all_folds(keys, "churn_planted", columns, "filled", str(INNER), "split = 'test'"),
        "nested_te_numeric": " UNION ALL ".join(f"SELECT * FROM ({part})" for part in parts),
    }


def encoded_matrix_sql() -> str:
    """Rows of every outer fold with its encodings; the population features are the same in all."""
    features, keys = all_features(), encoded_keys()
    raw = ["tenure", "MonthlyCharges", "TotalCharges"]
    numbers = {c: single(f'coalesce("{c}", -1)') for c in [*raw, *features]}
    wide = (
        f"wide AS (SELECT t.*, {', '.join(f'{e} AS "{n}"' for n, e in features.items())} "
        f"FROM planted t {population_joins()} WHERE split IN ('train', 'test'))"
    )
    parts = []
    for k in range(FOLDS):
        ctes = [
            *population_ctes("planted"), folds_cte("folded", "planted", "churn_planted", FOLDS, "fold", "split = 'train'"), _NESTED,
            'training AS (SELECT *, "Churn" AS y FROM nested)', *te_ctes("training", keys, k), wide,
            f"placed AS (SELECT wide.*, CASE WHEN wide.split = 'test' THEN 'test' WHEN training.fold = {k} THEN 'valid' ELSE 'train' END AS part, "
            f"CASE WHEN training.fold <> {k} THEN inner_fold ELSE {INNER} END AS row_slot FROM wide LEFT JOIN training ON wide.id = training.id)",
        ]
        body = f"SELECT id, CAST({k} AS BIGINT) AS held_out, part, {columns_of(numbers | te_columns(keys))} FROM placed {te_joins(keys, 'row_slot')}"
        parts.append(f"SELECT * FROM ({with_base(body, *ctes)})")
    return " UNION ALL ".join(parts)


def all_features() -> dict[str, str]:
    return POPULATION | RATIOS | FLAGS | PER_TENURE | DIGITS["digit_tenure"] | DIGITS["digit_monthly"] | DIGITS["digit_total"]


# everything --------------------------------------------------------------------------------------


def oracle() -> dict[str, str]:
    names = table_schema(True).names
    text_columns = [c for c in names if c not in {"id", "SeniorCitizen", "tenure", "MonthlyCharges"}]
    f_names = [f"FREQ_{c}" for c in NUMERIC]
    o_names = [f"ORIG_proba_{c}" for c in CATEGORICAL + NUMERIC]
    distances = [n for n in POPULATION if n.startswith(("dist_To", "qdist"))]
    rank_names = [f"pctrank_{n}_TC" for n in ("nonchurner", "churner", "orig", "churn_gap")]
    sql = {
        "clean_impute": with_base(f"SELECT id, split, {six('\"TotalCharges\"', 'TotalCharges')} FROM filled"),
        "label_map": from_view(
            f'SELECT id, CAST(length("Churn") AS BIGINT) AS raw_length, CAST({_LABEL} AS BIGINT) AS churn FROM raw'
        ),
        "label_null_check": from_view(
            f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_LABEL} IS NULL) AS n_unmapped FROM "
            '(SELECT "Churn" FROM raw UNION ALL SELECT gender FROM raw)'
        ),
        "class_profile": with_base(
            'SELECT CAST("Churn" AS BIGINT) AS "Churn", count(*) AS n_rows, '
            + six("count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)", "share")
            + ' FROM filled GROUP BY "Churn"'
        ),
        "table_shape": from_view(
            "SELECT split AS table_name, count(*) AS n_rows, CAST(CASE WHEN split = 'test' THEN 20 ELSE 21 END AS BIGINT) "
            "AS n_columns FROM raw GROUP BY split"
        ),
        "schema_profile": from_view(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, '{'categorical' if c in text_columns else 'numeric'}' AS kind, "
                f'count(DISTINCT "{c}") AS n_distinct FROM raw'
                for c in names
            )
        ),
        "constant_fill": with_base(
            f"SELECT id, {six('\"MonthlyCharges\"', 'MonthlyCharges')}, {six('coalesce(\"TotalCharges\", -1)', 'TotalCharges')} FROM parsed"
        ),
        "stratified_folds": with_base(
            "SELECT id, CAST(fold AS BIGINT) AS fold FROM folded",
            folds_cte("folded", "filled", '"Churn"', FOLDS, "fold"),
        ),
        "nested_folds": with_base(
            "SELECT id, CAST(fold AS BIGINT) AS fold, CAST(inner_fold AS BIGINT) AS inner_fold FROM nested", _FOLDED, _NESTED
        ),
        "fold_sizes": with_base(
            "SELECT CAST(churn_planted AS BIGINT) AS label, CAST(fold AS BIGINT) AS fold, "
            "CAST(inner_fold AS BIGINT) AS inner_fold, count(*) AS n_rows FROM nested GROUP BY 1, 2, 3",
            _FOLDED, _NESTED,
        ),
        "roc_auc_exact": from_view(
            f'SELECT "label" AS "Contract", auc FROM ({auc_sql("raw", "tenure", "churn_planted", "\"Contract\"")})'
        ),
        "roc_auc_pooled": from_view(f"SELECT auc FROM ({auc_sql('raw', '\"MonthlyCharges\"', 'churn_planted', '1')})"),
        "log_loss": from_view(
            'SELECT "Contract", '
            + six("avg(-(churn_planted * ln(q) + (1 - churn_planted) * ln(1 - q)))", "log_loss")
            + ' FROM (SELECT "Contract", churn_planted, least(greatest(1 - tenure / 79.0, 1e-15), 1 - 1e-15) AS q FROM raw) '
            'GROUP BY "Contract"'
        ),
        "oof_target_mean_auc": with_base(
            summary_sql("scored", "score"),
            _FOLDED,
            "scored AS (SELECT id, fold, churn_planted, CAST((tc.s - oc.s) / (tc.n - oc.n) AS FLOAT) AS score FROM folded "
            'JOIN (SELECT "Contract" AS ck, CAST(sum(churn_planted) AS DOUBLE) AS s, count(*) AS n FROM folded GROUP BY 1) tc '
            'ON "Contract" = tc.ck JOIN (SELECT "Contract" AS ck, fold AS fk, CAST(sum(churn_planted) AS DOUBLE) AS s, '
            'count(*) AS n FROM folded GROUP BY 1, 2) oc ON "Contract" = oc.ck AND fold = oc.fk)',
        ),
        "fold_auc_summary": with_base(summary_sql("folded", '"MonthlyCharges"'), _FOLDED),
        "gbt_oof_rows": with_base(
            'SELECT id, CAST(churn_planted AS BIGINT) AS "Churn", CAST(fold AS BIGINT) AS fold, TRUE AS in_range FROM models',
            folds_cte("models", "filled", "churn_planted", FOLDS, "fold", "split = 'train'"),
        ),
        "gbt_test_rows": from_view("SELECT id, TRUE AS in_range FROM raw WHERE split = 'test'"),
        "gbt_importance_rows": f"SELECT CAST(range AS BIGINT) AS fold, TRUE AS \"distinct\", TRUE AS positive FROM range({FOLDS})",
        "gbt_history_rows": (
            f"SELECT CAST(range AS BIGINT) AS fold, split, CAST(0 AS BIGINT) AS first_round, TRUE AS complete, TRUE AS best_kept "
            f"FROM range({FOLDS}) CROSS JOIN (VALUES ('train'), ('valid')) s(split)"
        ),
        "fold_auc_range": with_base(
            "SELECT count(*) AS folds, " + six("min(auc)", "lowest") + ", " + six("max(auc)", "highest") + ", " + six("avg(auc)", "mean")
            + f" FROM ({summary_sql('folded', chr(34) + 'MonthlyCharges' + chr(34))}) WHERE label <> 'Overall'", _FOLDED
        ),
        "prediction_histogram": from_view(
            'SELECT CAST(range AS BIGINT) AS bin, coalesce(n, 0) AS n_rows, '
            + six("a + (b - a) / 40 * range", "low") + ", " + six("a + (b - a) / 40 * (range + 1)", "high")
            + ' FROM range(40) CROSS JOIN (SELECT min("MonthlyCharges") AS a, max("MonthlyCharges") AS b FROM raw) '
            'LEFT JOIN (SELECT least(floor(("MonthlyCharges" - a) / (b - a) * 40), 39) AS k, count(*) AS n FROM raw '
            'CROSS JOIN (SELECT min("MonthlyCharges") AS a, max("MonthlyCharges") AS b FROM raw) GROUP BY 1) ON k = range'
        ),
        "topk_scores": (
            "SELECT p_name || '-' || CAST(p_partkey AS VARCHAR) AS feature, p_retailprice AS importance "
            "FROM part ORDER BY importance DESC, feature LIMIT 20"
        ),
        "ratio_features": with_base(probes(columns_of(RATIOS))),
        "service_flags": from_view(f"SELECT id, {columns_of(FLAGS)} FROM raw"),
        "digit_tenure": from_view(f"SELECT id, {columns_of(DIGITS['digit_tenure'])} FROM raw"),
        "digit_monthly": from_view(f"SELECT id, {columns_of(DIGITS['digit_monthly'])} FROM raw"),
        "digit_total": with_base(probes(columns_of(DIGITS["digit_total"]))),
        "per_tenure_ratios": with_base(probes(columns_of(PER_TENURE))),
        "numeric_keys": with_base(
            " UNION ALL ".join(
                f"SELECT 'CAT_{c}' AS key, count(*) AS n_rows, {six(f'\"{c}\"', 'number')} FROM parsed GROUP BY \"{c}\""
                for c in NUMERIC
            )
        ),
        "ngram_bigrams": from_view(
            "SELECT id, " + ", ".join(f'{e} AS "{n}"' for n, e in NGRAMS.items() if n.startswith("BG_")) + " FROM raw"
        ),
        "ngram_trigrams": from_view(
            "SELECT id, " + ", ".join(f'{e} AS "{n}"' for n, e in NGRAMS.items() if n.startswith("TG_")) + " FROM raw"
        ),
        "frequency_encode": with_base(
            picked(f_names, " ".join(f'LEFT JOIN "f_{c}" ON t."{c}" = "f_{c}".v' for c in NUMERIC)),
            *[share_cte(c) for c in NUMERIC],
        ),
        "bag_union": with_base(
            f"SELECT CAST(v AS BIGINT) AS tenure, {six('share', 'share')} FROM \"f_tenure\"", share_cte("tenure")
        ),
        "reference_target_rate": with_base(
            picked(o_names, " ".join(f'LEFT JOIN "o_{c}" ON t."{c}" = "o_{c}".v' for c in CATEGORICAL + NUMERIC)),
            *[rate_cte(c) for c in CATEGORICAL + NUMERIC],
        ),
        "group_residual": with_base(
            picked(["resid_IS_MC"], 'LEFT JOIN residuals ON t."InternetService" = is_group'), residual_cte()
        ),
        "zscore_gap": with_base(
            picked(["zscore_churn_gap_TC", "zscore_nonchurner_TC"], "CROSS JOIN moments"), moments_cte()
        ),
        "quantile_distance": with_base(picked(distances, "CROSS JOIN moments"), moments_cte()),
        "ecdf_rank": with_base(picked(rank_names, 'LEFT JOIN ranks ON t."TotalCharges" = ranks.v'), ranks_cte()),
        "ecdf_rank_by_internet": with_base(
            picked(["cond_pctrank_IS_TC"], 'LEFT JOIN rank_is ON t."TotalCharges" = rank_is.v AND t."InternetService" = rank_is.g'),
            group_ranks_cte("rank_is", "InternetService"),
        ),
        "ecdf_rank_by_contract": with_base(
            picked(["cond_pctrank_C_TC"], 'LEFT JOIN rank_c ON t."TotalCharges" = rank_c.v AND t."Contract" = rank_c.g'),
            group_ranks_cte("rank_c", "Contract"),
        ),
        "ecdf_apply": with_base(
            "SELECT id, " + ", ".join(
                six(single(f"coalesce((SELECT avg(CASE WHEN r.\"TotalCharges\" < v THEN 1 ELSE 0 END) FROM filled r WHERE r.split = 'orig' AND {test}), 0)"), name)
                for name, test in (("rank_nonchurner", 'r."Churn" = 0'), ("rank_churner", 'r."Churn" = 1'), ("rank_contract", 'r."Contract" = p."Contract"'))
            ) + " FROM probes p",
            'probes AS (SELECT *, "TotalCharges" * 1.0001::DOUBLE + 0.005::DOUBLE AS v FROM filled WHERE split IN (\'train\', \'test\'))',
        ),
        "fold_prior": with_base(
            "SELECT CAST(k AS BIGINT) AS fold, count(*) AS n_train, " + six("avg(churn_planted)", "prior")
            + f" FROM folded JOIN (SELECT range AS k FROM range({FOLDS})) ON fold <> k GROUP BY k",
            _FOLDED,
        ),
        "smoothed_te": smoothed_sql(["Contract", "PaymentMethod", "tenure"]),
        "feature_matrix": with_base(
            f"SELECT t.id, split, {columns_of({c: f't."{c}"' for c in NUMERIC} | all_features())} FROM filled t "
            f"{population_joins()} WHERE split IN ('train', 'test')",
            *population_ctes(),
        ),
        "fold_encoded_matrix": encoded_matrix_sql(),
        "oof_union": with_base(
            f"SELECT id, CAST(fold AS BIGINT) AS fold, {six('tenure / (80.0 + fold)', 'oof_pred')} FROM folded", _FOLDED
        ),
        "oof_coverage": with_base(
            "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_keys, count(*) - count(DISTINCT id) AS n_repeated FROM folded",
            _FOLDED,
        ),
        "ensemble_mean": from_view(
            "SELECT id, " + six(single(" + ".join(f"tenure / CAST({80 + k} AS DOUBLE) / {FOLDS}" for k in range(FOLDS))), "Churn")
            + " FROM raw WHERE split = 'test'"
        ),
        "next_run_number": (
            "SELECT coalesce(max(CAST(regexp_extract(name, '^submission_(\\d+)\\.csv$', 1) AS BIGINT)), 0) + 1 AS next_run FROM ("
            "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'submission_' ELSE 'oof_predictions_' END || CAST(o_orderkey AS VARCHAR) "
            "|| CASE WHEN o_orderkey % 2 = 0 THEN '.csv' ELSE '.txt' END AS name FROM orders) "
            "WHERE regexp_matches(name, '^submission_(\\d+)\\.csv$')"
        ),
        "run_clock": (
            "SELECT l_orderkey, seconds, printf('%02d:%02d:%05.2f', CAST(floor(s / 3600) AS BIGINT), "
            "CAST(floor(s / 60) AS BIGINT) % 60, s - 60 * floor(s / 60)) AS clock FROM "
            "(SELECT l_orderkey, sum(l_quantity) AS seconds, sum(l_quantity) * 60.25::DOUBLE AS s FROM lineitem GROUP BY 1)"
        ),
    }
    return sql | te_queries()


def smoothed_sql(columns: list[str]) -> str:
    ctes = [
        f'"s_{c}" AS (SELECT "{c}" AS k, avg(churn_planted) AS m, count(*) AS n FROM raw WHERE split = \'train\' '
        f'AND "{c}" IS NOT NULL GROUP BY 1)'
        for c in columns
    ]
    ctes.append("prior AS (SELECT avg(churn_planted) AS p FROM raw WHERE split = 'train')")
    coded = ", ".join(
        six(f'coalesce("s_{c}".m / (1 + exp(-("s_{c}".n - 20) / 10.0)) + p * (1 - 1 / (1 + exp(-("s_{c}".n - 20) / 10.0))), p)', c)
        for c in columns
    )
    joins = " ".join(f'LEFT JOIN "s_{c}" ON raw."{c}" = "s_{c}".k' for c in columns)
    return f"WITH raw AS ({subjects_sql()}), {', '.join(ctes)} SELECT id, split, {coded} FROM raw {joins} CROSS JOIN prior"
