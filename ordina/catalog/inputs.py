"""The study tables, derived from the TPC-H-like tables.

Subjects are the customers with measures from their orders and line items, the
sensor series are the events of the users, and scored rows are the labelled
documents. Each input exists twice, as a Spark frame and as a SQL text; column
formulas that mean the same in both dialects are written once.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.config import (
    CODES,
    NON_WEAR,
    NUMERIC,
    REL_DAY,
    SEASONS,
    TARGET,
    TARGET_ITEMS,
    TARGET_SEASON,
    ColumnRoles,
)

SEASON_CODES = {"Spring": 0, "Summer": 1, "Fall": 2, "Winter": 3}
ROLES = ColumnRoles(label_maps={c: SEASON_CODES for c in SEASONS})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- rounding that both engines do alike -------------------------------------


def r6(x: Column | str) -> Column:
    """Six decimals. The odd offset keeps decimal ties away from the edge."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1e6 + 0.53) / 1e6


def sql_r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.53) / 1e6)"


def rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    """All columns but `keep` as doubles with six decimals."""
    exact = set(keep)
    return df.selectExpr(
        *[
            f"`{c}`"
            if c in exact
            else f"floor(CAST(`{c}` AS DOUBLE) * 1e6D + 0.53D) / 1e6D AS `{c}`"
            for c in df.columns
        ]
    )


# --- subjects ----------------------------------------------------------------

MEASURES = ("bal", "sum_price", "max_price", "sum_qty", "sum_ext", "max_ext", "sum_disc", "sum_tax")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with order and line totals, nulls where there are none."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    by_order = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n_ord"),
        F.round(F.sum("o_totalprice"), 2).alias("sum_price"),
        F.max("o_totalprice").alias("max_price"),
    )
    by_line = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("k"))
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_ext"),
            F.max("l_extendedprice").alias("max_ext"),
            F.round(F.sum("l_discount"), 2).alias("sum_disc"),
            F.round(F.sum("l_tax"), 2).alias("sum_tax"),
        )
    )
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("k"),
            F.col("c_nationkey").cast("bigint").alias("nat"),
            F.col("c_acctbal").alias("bal"),
        )
        .join(by_order, "k", "left")
        .join(by_line, "k", "left")
    )


CUSTOMERS_SQL = """(
  SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS nat, c_acctbal AS bal,
         n_ord, sum_price, max_price, n_lines, sum_qty, sum_ext, max_ext, sum_disc, sum_tax
  FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n_ord, round(sum(o_totalprice), 2) AS sum_price,
                    max(o_totalprice) AS max_price
             FROM orders GROUP BY o_custkey) bo ON bo.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey AS line_cust, count(*) AS n_lines, sum(l_quantity) AS sum_qty,
                    round(sum(l_extendedprice), 2) AS sum_ext, max(l_extendedprice) AS max_ext,
                    round(sum(l_discount), 2) AS sum_disc, round(sum(l_tax), 2) AS sum_tax
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             GROUP BY o_custkey) bl ON bl.line_cust = c_custkey
)"""


def _gap(i: int, value: str) -> str:
    """`value`, missing for some customers."""
    return f"CASE WHEN (k * {i + 3} + {i}) % {7 + i % 5} = 0 THEN NULL ELSE {value} END"


def _numeric_formula(i: int) -> str:
    if i % 2:
        return _gap(i, f"{MEASURES[i % len(MEASURES)]} / {10 + i}.0")
    return _gap(i, f"CAST((k * {2 * i + 5} + nat * {i + 1}) % {11 + 4 * i} AS DOUBLE)")


def _season_formula(i: int) -> str:
    arms = " ".join(f"WHEN {code} THEN '{s}'" for s, code in SEASON_CODES.items())
    return f"CASE (k * {i + 2} + nat) % 5 {arms} END"


SUBJECT_FORMULAS: dict[str, str] = {
    "id": "CAST(k AS STRING)",
    **{c: _numeric_formula(i) for i, c in enumerate(NUMERIC)},
    "Basic_Demos-Age": _gap(40, "CAST(5 + (k * 7 + nat) % 14 AS DOUBLE)"),
    **{c: _season_formula(i) for i, c in enumerate(SEASONS)},
    **{
        c: f"CAST({_gap(i + 50, f'(k * {i + 1} + nat) % {2 + i % 3}')} AS INT)"
        for i, c in enumerate(CODES)
    },
    TARGET_SEASON: _season_formula(17),
    **{c: f"CAST((k + {i}) % 6 AS DOUBLE)" for i, c in enumerate(TARGET_ITEMS)},
    # Driven by the order volume, so that the other columns can predict it.
    TARGET: "CAST(CASE WHEN (k * 13 + nat) % 9 = 0 OR n_lines IS NULL THEN NULL"
    " WHEN n_lines + (k % 7) < 36 THEN 0 WHEN n_lines + (k % 7) < 45 THEN 1"
    " WHEN n_lines + (k % 7) < 54 THEN 2 ELSE 3 END AS INT)",
}
TARGET_COLUMNS = (TARGET_SEASON, *TARGET_ITEMS, TARGET)


def subject_columns(with_target: bool = True) -> list[str]:
    return [c for c in SUBJECT_FORMULAS if with_target or c not in TARGET_COLUMNS]


def subjects(spark: SparkSession, sf_dir: str, with_target: bool = True) -> DataFrame:
    exprs = [f"{SUBJECT_FORMULAS[c]} AS `{c}`" for c in subject_columns(with_target)]
    return customers(spark, sf_dir).selectExpr(*exprs)


def subjects_sql() -> str:
    exprs = ", ".join(f'{f} AS "{c}"' for c, f in SUBJECT_FORMULAS.items())
    return f"(SELECT {exprs} FROM {CUSTOMERS_SQL} c)"


# --- series ------------------------------------------------------------------

READING = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"
SERIES_FORMULAS: dict[str, str] = {
    "id": "CAST(user_id AS STRING)",
    "X": "value",
    "Y": READING,
    "Z": f"value * 0.5 - {READING}",
    "enmo": "value / 64.0",
    "anglez": f"{READING} - 50.0",
    "light": "CAST(event_id % 997 AS DOUBLE)",
    "battery_voltage": "3000.0 + CAST((event_id * 17) % 1200 AS DOUBLE)",
    NON_WEAR: "CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END",
    REL_DAY: "CAST((extract(doy FROM ts) - 16) * 3 AS DOUBLE)",
    "time_of_day": "CAST(extract(hour FROM ts) AS BIGINT) * 3600000000000",
    "weekday": "CAST({weekday} AS TINYINT)",
    "quarter": "CAST(quarter(ts) AS TINYINT)",
}


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekday = "extract(dow_iso FROM ts)"
    exprs = [f"{f.format(weekday=weekday)} AS `{c}`" for c, f in SERIES_FORMULAS.items()]
    return table(spark, sf_dir, "events").selectExpr(*exprs)


def series_sql() -> str:
    weekday = "isodow(ts)"
    exprs = ", ".join(f'{f.format(weekday=weekday)} AS "{c}"' for c, f in SERIES_FORMULAS.items())
    return f"(SELECT {exprs} FROM events)"


# --- scored rows -------------------------------------------------------------

# y, the fold and three model scores per labelled document
SCORES = (
    "((doc_id * 37) % 100) / 100e0 * 3e0",
    "((doc_id * 53 + n_chars) % 128) / 128e0 * 2e0 + 0.4e0 * quality",
    "((doc_id * 11 + n_chars * 7) % 64) / 64e0 * 3e0 - 0.25e0 * toxic",
)


def _scored_formulas() -> dict[str, str]:
    return {
        "id": "doc_id",
        "fold": "CAST(doc_id % 5 AS INT)",
        "y": "CAST(2 * quality + toxic AS INT)",
        **{f"pred_{i}": f"CAST({s} AS DOUBLE)" for i, s in enumerate(SCORES)},
    }


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id"
    )
    return rows.selectExpr(*[f"{f} AS {c}" for c, f in _scored_formulas().items()])


def scored_sql() -> str:
    exprs = ", ".join(f"{f} AS {c}" for c, f in _scored_formulas().items())
    return f"(SELECT {exprs} FROM documents JOIN labels USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(id, fold, y, model, pred)`: three models side by side."""
    models = F.explode(
        F.array(
            *[
                F.struct(F.lit(f"m{i}").alias("model"), F.col(f"pred_{i}").alias("pred"))
                for i in range(len(SCORES))
            ]
        )
    )
    return scored(spark, sf_dir).select("id", "fold", "y", models.alias("m")).select(
        "id", "fold", "y", "m.*"
    )


def predictions_sql() -> str:
    parts = [
        f"SELECT id, fold, y, 'm{i}' AS model, pred_{i} AS pred FROM {scored_sql()} s{i}"
        for i in range(len(SCORES))
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their target where they have one and a fold string."""
    labels = table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "CAST(2 * quality + toxic AS INT) AS y"
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang", "source", "n_chars")
        .join(labels, "doc_id", "left")
    )


DOCUMENTS_SQL = """(
  SELECT doc_id, lang, source, n_chars, CAST(2 * quality + toxic AS INT) AS y
  FROM documents LEFT JOIN labels USING (doc_id)
)"""


@lru_cache(maxsize=None)
def _memo(app: str, sf_dir: str, name: str) -> dict:
    return {}


def input_path(spark: SparkSession, sf_dir: str, name: str, make):
    """Where input files lie that are written once per session and data folder.

    Paths are kept: of raw inputs in the layouts that readers want, of the gold,
    unlabelled and test tables, and of fitted members with their result tables. Later
    queries of a session read those files instead of making them again.
    """
    slot = _memo(spark.sparkContext.applicationId, sf_dir, name)
    if "path" not in slot:
        slot["path"] = make()
    return slot["path"]
