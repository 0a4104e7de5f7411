"""The test tables seen as one row per order with the columns of an input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratafold.schema import CATEGORICAL, ID, LABEL, NUMERIC

_LINE_FLAGS = {
    "PhoneService": "l_returnflag = 'R'",
    "OnlineSecurity": "l_returnflag = 'A'",
    "OnlineBackup": "l_returnflag = 'N'",
    "DeviceProtection": "l_linestatus = 'O'",
    "TechSupport": "l_linestatus = 'F'",
    "StreamingTV": "l_discount >= 0.09",
    "StreamingMovies": "l_tax >= 0.07",
    "PaperlessBilling": "l_quantity >= 45",
}
_COLUMNS = [ID, *CATEGORICAL, *NUMERIC, LABEL, "churn_planted", "split"]

_TENURE = "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1"
_EXPRESSIONS = {
    "id": "o_orderkey",
    "gender": "CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END",
    "SeniorCitizen": "CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END",
    "Partner": "CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END",
    "Dependents": "CASE WHEN o_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END",
    "MultipleLines": (
        "CASE WHEN coalesce(flag_PhoneService, 0) = 0 THEN 'No phone service' "
        "WHEN n_lines > 3 THEN 'Yes' ELSE 'No' END"
    ),
    "InternetService": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'No' ELSE c_mktsegment END",
    "Contract": "o_orderpriority",
    "PaymentMethod": "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE r_name END",
    "tenure": _TENURE,
    "MonthlyCharges": "c_acctbal",
    "TotalCharges": "CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE cast(o_totalprice AS varchar(32)) END",
    "Churn": (
        "CASE WHEN o_orderkey % 11 = 0 THEN "
        "CASE WHEN o_orderstatus = 'F' THEN ' Yes ' ELSE ' No ' END "
        "WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END"
    ),
    "churn_planted": (
        f"CASE WHEN (o_orderpriority IN ('1-URGENT', '2-HIGH') AND {_TENURE} < 40) "
        "OR o_orderkey % 13 = 0 THEN 1 ELSE 0 END"
    ),
    "split": (
        "CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'test' "
        "ELSE 'orig' END"
    ),
} | {
    name: f"CASE WHEN flag_{name} = 1 THEN 'Yes' ELSE 'No' END" for name in _LINE_FLAGS
}
_FROM_LINES = {*_LINE_FLAGS, "MultipleLines"}
_FROM_CUSTOMER = {"InternetService", "MonthlyCharges", "PaymentMethod"}


def subjects(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The chosen subject columns; a table that none of them needs is not read."""
    chosen = columns or _COLUMNS

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    joined = table("orders")
    if _FROM_CUSTOMER & set(chosen):
        joined = joined.join(table("customer"), F.expr("o_custkey = c_custkey"), "left")
    if "PaymentMethod" in chosen:
        joined = joined.join(table("nation"), F.expr("c_nationkey = n_nationkey"), "left").join(
            table("region"), F.expr("n_regionkey = r_regionkey"), "left"
        )
    if _FROM_LINES & set(chosen):
        lines = table("lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("n_lines"),
            *[
                F.max(F.when(F.expr(test), 1).otherwise(0)).alias(f"flag_{name}")
                for name, test in _LINE_FLAGS.items()
            ],
        )
        joined = joined.join(lines, F.expr("o_orderkey = l_orderkey"), "left")
    return joined.select(*[F.expr(_EXPRESSIONS[name]).alias(name) for name in chosen])


def subjects_sql() -> str:
    """The same view as SQL text over the test tables."""
    flags = ", ".join(
        f"max(CASE WHEN {test} THEN 1 ELSE 0 END) AS flag_{name}" for name, test in _LINE_FLAGS.items()
    )
    selected = ", ".join(f'{_EXPRESSIONS[name]} AS "{name}"' for name in _COLUMNS)
    return (
        f"SELECT {selected} FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
        "LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey "
        f"LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, {flags} FROM lineitem GROUP BY l_orderkey) "
        "ON o_orderkey = l_orderkey"
    )
