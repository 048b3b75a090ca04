"""Queries on sources, encoders, row features, the series and folds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.catalog import inputs as I
from ordina.catalog.inputs import ROLES, r6, rounded, sql_r6
from ordina.catalog.registry import query
from ordina.config import (
    ANCHOR_DAYS,
    CODES,
    NON_WEAR,
    NUMERIC,
    PLANAR_NORM,
    REL_DAY,
    SAMPLES_PER_DAY,
    SEASONS,
    SERIES_PREFIX,
    SIGNALS,
    TARGET,
)
from ordina.functions import classes as fc
from ordina.functions import features as ff
from ordina.operators import encode, folds, pseudo, quality, series
from ordina.operators.ensemble import union_lists as union_lists_of
from ordina.plans import preprocess
from ordina.plans.row_features import FGC, HOURS, MISSING, PAQ, ROW_FEATURES, ZONES, row_features
from ordina.session import fresh_path, written
from ordina.sources import tables

AGE, SEX = "Basic_Demos-Age", "Basic_Demos-Sex"
SEED = 7


# --- written inputs ----------------------------------------------------------


def subject_file(spark: SparkSession, sf_dir: str) -> str:
    def make():
        path = fresh_path(spark, "subjects-csv")
        I.subjects(spark, sf_dir).write.option("header", True).csv(path)
        return path

    return I.input_path(spark, sf_dir, "subject_file", make)


def series_root(spark: SparkSession, sf_dir: str) -> str:
    def make():
        path = fresh_path(spark, "series")
        tables.write_series(I.series(spark, sf_dir), path)
        return path

    return I.input_path(spark, sf_dir, "series_root", make)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series summary, which the training and the test tables share."""

    def make():
        path = fresh_path(spark, "summary")
        tables.sink_table(preprocess.summarise_series(I.series(spark, sf_dir), ROLES), path)
        return path

    return spark.read.parquet(I.input_path(spark, sf_dir, "summary", make))


def gold_paths(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Gold and unlabelled tables made by the preprocessing plan."""

    def make():
        paths = {n: fresh_path(spark, n) for n in ("gold", "unlabelled")}
        preprocess.prepare_training(
            I.subjects(spark, sf_dir),
            I.series(spark, sf_dir),
            ROLES,
            paths["gold"],
            paths["unlabelled"],
            SEED,
            summary=summary(spark, sf_dir),
        )
        return paths

    return I.input_path(spark, sf_dir, "gold_paths", make)


def test_path(spark: SparkSession, sf_dir: str) -> str:
    """The test table made by the preprocessing plan; only what reads it waits for it."""

    def make():
        path = fresh_path(spark, "test")
        preprocess.prepare_test(
            I.subjects(spark, sf_dir, False), I.series(spark, sf_dir), ROLES, path, summary=summary(spark, sf_dir)
        )
        return path

    return I.input_path(spark, sf_dir, "test_path", make)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_gold(spark, gold_paths(spark, sf_dir)["gold"])


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_unlabelled(spark, gold_paths(spark, sf_dir)["unlabelled"])


def test_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_test(spark, test_path(spark, sf_dir))


# --- SQL counterparts --------------------------------------------------------


def q(name: str) -> str:
    return f'"{name}"'


def season_code_sql(column: str) -> str:
    arms = " ".join(f"WHEN '{s}' THEN {code}" for s, code in I.SEASON_CODES.items())
    return f"CAST(CASE {q(column)} {arms} END AS SMALLINT)"


def encoded_sql(with_target: bool = True) -> str:
    new = {c: f"CAST({q(c)} AS SMALLINT)" for c in (*CODES, TARGET)}
    new |= {c: season_code_sql(c) for c in SEASONS}
    kept = I.subject_columns(with_target)
    exprs = ", ".join(f"{new.get(c, q(c))} AS {q(c)}" for c in kept)
    return f"(SELECT {exprs} FROM {I.subjects_sql()} s)"


def _feature_sql(family: str, inputs: tuple[str, ...]) -> str:
    a, b = q(inputs[0]), q(inputs[1])
    as_double = f"CAST({a} AS DOUBLE)"
    return {
        "product": f"{a} * {b}",
        "ratio": f"{as_double} / nullif({b}, 0)",
        "ratio_plus1": f"{as_double} / nullif(1 + {b}, 0)",
        "guarded_ratio": f"CASE WHEN {b} = 0 THEN NULL ELSE {as_double} / {b} END",
        "pressure": f"CASE WHEN {b} <> {a} THEN {a} / nullif(({b} - {a}) / 3.0, 0) END",
        "diff": f"{a} - {b}",
        "min_sec": f"{a} * 60 + {b}",
        "sum": " + ".join(q(c) for c in inputs),
        "row_mean": f"list_avg([{', '.join(q(c) for c in inputs)}])",
        "code_sum": " + ".join(q(c) for c in inputs),
        "achievements": " + ".join(
            [f"CAST({q(c)} >= 2 AS INT)" for c in inputs[:2]] + [q(c) for c in inputs[2:]]
        ),
    }[family]


def features_sql(with_target: bool = True) -> str:
    """Encoded subjects with all row features, unrounded."""
    missing = " + ".join(f"CAST({q(c)} IS NULL AS INT)" for c in ROLES.inputs)
    first = (
        f'(SELECT *, coalesce("PAQ_C-PAQ_C_Total", "PAQ_A-PAQ_A_Total") AS {q(PAQ)},'
        f" CAST({missing} AS INT) AS {q(MISSING)} FROM {encoded_sql(with_target)} e)"
    )
    exprs = ", ".join(f"{_feature_sql(f, i)} AS {q(n)}" for n, f, i in ROW_FEATURES)
    return f"(SELECT *, {exprs} FROM {first} f)"


ALL_SIGNALS = (*SIGNALS, PLANAR_NORM)


def near_sql() -> str:
    return (
        f"(SELECT *, sqrt(X * X + Y * Y) AS {q(PLANAR_NORM)} FROM {I.series_sql()} s"
        f" WHERE abs({q(REL_DAY)}) <= {ANCHOR_DAYS})"
    )


def summary_expressions() -> dict[str, str]:
    worn = f"{q(NON_WEAR)} = 0"
    aggregates = {
        "min": "min",
        "max": "max",
        "mean": "avg",
        "std": "stddev_samp",
        "median": "median",
    }
    out = {
        f"{SERIES_PREFIX}{s}_{name}": f"{agg}(CASE WHEN {worn} THEN {q(s)} END)"
        for name, agg in aggregates.items()
        for s in ALL_SIGNALS
    }
    out[f"{SERIES_PREFIX}total_day_registered"] = (
        f"count(DISTINCT CASE WHEN {worn} THEN {q(REL_DAY)} END)"
    )
    out[f"{SERIES_PREFIX}{NON_WEAR}_mean"] = f"avg({q(NON_WEAR)})"
    out[f"{SERIES_PREFIX}missing_data_mean"] = (
        f"count({q(NON_WEAR)}) / ({SAMPLES_PER_DAY}e0 * count(DISTINCT {q(REL_DAY)}))"
    )
    out[f"{SERIES_PREFIX}weekday_mean"] = "avg(weekday)"
    out[f"{SERIES_PREFIX}quarter_mean"] = "avg(quarter)"
    return out


SUMMARY = summary_expressions()
DAYS = f"{SERIES_PREFIX}total_day_registered"


def summary_sql() -> str:
    exprs = ", ".join(f"{e} AS {q(n)}" for n, e in SUMMARY.items())
    return f"(SELECT id, {exprs} FROM {near_sql()} n GROUP BY id)"


def wide_sql(with_target: bool = True) -> str:
    names = ", ".join(f"m.{q(n)}" for n in SUMMARY)
    return f"(SELECT f.*, {names} FROM {features_sql(with_target)} f LEFT JOIN {summary_sql()} m ON f.id = m.id)"


EXACT = ["id", "fold_info", *SEASONS, *CODES, *I.TARGET_COLUMNS, MISSING, DAYS]


def rounded_sql(columns: list[str], source: str, where: str = "", keep=EXACT) -> str:
    exprs = ", ".join(
        f"{q(c)}" if c in keep else f"{sql_r6(f'CAST({q(c)} AS DOUBLE)')} AS {q(c)}"
        for c in columns
    )
    return f"SELECT {exprs} FROM {source} t {where}"


FEATURE_NAMES = [PAQ, MISSING, *[n for n, _, _ in ROW_FEATURES]]
WIDE = [*I.subject_columns(), *FEATURE_NAMES, *SUMMARY]
WIDE_TEST = [*I.subject_columns(False), *FEATURE_NAMES, *SUMMARY]
AGE_BIN_SQL = (
    f"CASE WHEN {q(AGE)} <= 7 THEN 0 WHEN {q(AGE)} <= 8 THEN 1 WHEN {q(AGE)} <= 9 THEN 2"
    f" WHEN {q(AGE)} <= 10 THEN 3 WHEN {q(AGE)} <= 12 THEN 4 WHEN {q(AGE)} <= 14 THEN 5 ELSE 6 END"
)


def with_folds_sql(source: str) -> str:
    """Rows with a target, numbered along the strata and dealt to five folds."""
    number = (
        f"row_number() OVER (ORDER BY CAST({AGE_BIN_SQL} AS VARCHAR) || CAST(sii AS VARCHAR),"
        f" md5('{SEED}' || id), id)"
    )
    return f"(SELECT *, CAST(({number} - 1) % 5 AS INT) AS fold FROM {source} w WHERE sii IS NOT NULL)"


FOLD_INFO_SQL = " || ', ' || ".join(f"CASE WHEN fold = {i} THEN 'v' ELSE 't' END" for i in range(5))


def gold_sql() -> str:
    return f"(SELECT *, {FOLD_INFO_SQL} AS fold_info FROM {with_folds_sql(wide_sql())} g)"


def small_gold_sql() -> str:
    """Gold without row features and series, for queries on codes and folds."""
    return f"(SELECT *, {FOLD_INFO_SQL} AS fold_info FROM {with_folds_sql(encoded_sql())} g)"


# --- sources and sinks -------------------------------------------------------


@query("scan_subjects", rounded_sql(I.subject_columns(), I.subjects_sql()))
def scan_subjects(spark, sf_dir):
    found = tables.scan_subjects(spark, subject_file(spark, sf_dir))
    whole = {c: F.col(c).cast("int") for c in (*CODES, TARGET)}
    return rounded(found.withColumns(whole), EXACT)


SERIES_COLUMNS = list(I.SERIES_FORMULAS)
SERIES_EXACT = ["id", "time_of_day", "weekday", "quarter"]


@query("scan_series", rounded_sql(SERIES_COLUMNS, I.series_sql(), keep=SERIES_EXACT))
def scan_series(spark, sf_dir):
    found = tables.scan_series(spark, series_root(spark, sf_dir))
    return rounded(found, SERIES_EXACT).select(*SERIES_COLUMNS)


@query("lookup_mapper", f"SELECT id, {', '.join(f'{season_code_sql(c)} AS {q(c)}' for c in SEASONS)} FROM {I.subjects_sql()} s")
def lookup_mapper(spark, sf_dir):
    """Label maps read from a file and applied to the season columns."""

    def make():
        path = fresh_path(spark, "mapper")
        text = json.dumps({"main": ROLES.label_maps})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        return path

    maps = tables.lookup_mapper(spark, I.input_path(spark, sf_dir, "mapper", make))
    return I.subjects(spark, sf_dir).select(
        "id", *[fc.encode_label(c, maps[c]).alias(c) for c in SEASONS]
    )


@query("scan_gold", rounded_sql([*WIDE, "fold_info"], gold_sql()))
def scan_gold(spark, sf_dir):
    """The gold table as the preprocessing plan wrote it."""
    return rounded(gold(spark, sf_dir), EXACT)


@query("prepare_training", f"SELECT 'gold' AS part, id, fold_info FROM {small_gold_sql()} g UNION ALL SELECT 'unlabelled', id, NULL FROM {encoded_sql()} e WHERE sii IS NULL")
def prepare_training(spark, sf_dir):
    """Both tables as the plan writes them: ids and folds."""
    gold_path, rest_path = fresh_path(spark, "prepared-gold"), fresh_path(spark, "prepared-rest")
    preprocess.prepare_training(
        I.subjects(spark, sf_dir), I.series(spark, sf_dir), ROLES, gold_path, rest_path, SEED
    )
    read = [
        tables.scan_table(spark, gold_path).select(F.lit("gold").alias("part"), "id", "fold_info"),
        tables.scan_table(spark, rest_path).select(
            F.lit("unlabelled").alias("part"), "id", F.lit(None).cast("string").alias("fold_info")
        ),
    ]
    return read[0].unionByName(read[1])


SUNK = ["id", *SEASONS, *CODES, TARGET]


@query("sink_gold", f"SELECT CASE WHEN sii IS NULL THEN 'unlabelled' ELSE 'gold' END AS part, {', '.join(q(c) for c in SUNK)} FROM {encoded_sql()} e")
def sink_gold(spark, sf_dir):
    """The rows of both tables read back after one `sink_gold`."""
    gold_path, rest_path = fresh_path(spark, "sink-gold"), fresh_path(spark, "sink-rest")
    encoded = encode.encode_categories(I.subjects(spark, sf_dir), ROLES)
    tables.sink_gold(encoded, TARGET, gold_path, rest_path)
    parts = [("gold", gold_path), ("unlabelled", rest_path)]
    read = [
        spark.read.parquet(p).select(F.lit(name).alias("part"), *[f"`{c}`" for c in SUNK])
        for name, p in parts
    ]
    return read[0].unionByName(read[1])


@query("publish_gold", f"SELECT CASE WHEN sii IS NULL THEN 'unlabelled' ELSE 'gold' END AS part, {', '.join(q(c) for c in SUNK)} FROM {encoded_sql()} e WHERE sii IS NULL OR sii > 0")
def publish_gold(spark, sf_dir):
    """The rows of both tables read back after a second commit has replaced the first."""
    gold_path, rest_path = fresh_path(spark, "publish-gold"), fresh_path(spark, "publish-rest")
    # Published twice, made once.
    encoded = written(encode.encode_categories(I.subjects(spark, sf_dir), ROLES), "encoded")
    tables.publish_gold(encoded, TARGET, gold_path, rest_path)
    tables.publish_gold(encoded.where(f"{TARGET} IS NULL OR {TARGET} > 0"), TARGET, gold_path, rest_path)
    read = [
        tables.scan_table(spark, p).select(F.lit(name).alias("part"), *[f"`{c}`" for c in SUNK])
        for name, p in (("gold", gold_path), ("unlabelled", rest_path))
    ]
    return read[0].unionByName(read[1])


@query("scan_unlabelled", rounded_sql(WIDE, wide_sql(), "WHERE sii IS NULL"))
def scan_unlabelled(spark, sf_dir):
    return rounded(unlabelled(spark, sf_dir), EXACT)


@query("scan_test", rounded_sql(WIDE_TEST, wide_sql(False)))
def scan_test(spark, sf_dir):
    return rounded(test_features(spark, sf_dir), EXACT)


@query("sink_test", rounded_sql([*I.subject_columns(False), *FEATURE_NAMES], features_sql(False)))
def sink_test(spark, sf_dir):
    path = fresh_path(spark, "sink-test")
    encoded = encode.encode_categories(I.subjects(spark, sf_dir, False), ROLES, False)
    tables.sink_test(row_features(encoded, ROLES), path)
    return rounded(tables.scan_test(spark, path), EXACT)


# --- projections and filters -------------------------------------------------


def near(spark, sf_dir) -> DataFrame:
    return series.with_planar_norm(series.filter_near_anchor(I.series(spark, sf_dir)))


NEAR_COLUMNS = [*SERIES_COLUMNS, PLANAR_NORM]


@query("filter_near_anchor", rounded_sql(NEAR_COLUMNS, near_sql(), keep=SERIES_EXACT))
def filter_near_anchor(spark, sf_dir):
    return rounded(near(spark, sf_dir), SERIES_EXACT)


@query("filter_worn", f'SELECT id, count(*) AS n, {sql_r6("avg(X)")} AS x_mean FROM {I.series_sql()} s WHERE {q(NON_WEAR)} = 0 GROUP BY id')
def filter_worn(spark, sf_dir):
    worn = series.filter_worn(I.series(spark, sf_dir))
    return worn.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("X")).alias("x_mean")
    )


@query("split_labelled", f"SELECT doc_id, y, y IS NOT NULL AS labelled FROM {I.DOCUMENTS_SQL} d")
def split_labelled(spark, sf_dir):
    have, lack = folds.split_labelled(I.documents(spark, sf_dir), "y")
    parts = [d.select("doc_id", "y", F.lit(flag).alias("labelled")) for d, flag in ((have, True), (lack, False))]
    return parts[0].unionByName(parts[1])


def small_gold(spark, sf_dir) -> DataFrame:
    encoded = encode.encode_categories(I.subjects(spark, sf_dir), ROLES)
    return preprocess.assign_folds(encoded.where(F.col(TARGET).isNotNull()), ROLES, SEED)


@query("fold_view", f"SELECT id, sii, split_part(fold_info, ', ', 3) AS current_fold FROM {small_gold_sql()} g")
def fold_view(spark, sf_dir):
    train, valid = folds.fold_view(small_gold(spark, sf_dir), 2)
    return train.unionByName(valid).select("id", "sii", "current_fold")


NOT_FEATURES = {*I.TARGET_COLUMNS, "id", "fold_info"}
FEATURE_COLUMNS = [c for c in WIDE if c not in NOT_FEATURES]


@query("select_features", rounded_sql(FEATURE_COLUMNS, gold_sql()))
def select_features(spark, sf_dir):
    table = gold(spark, sf_dir)
    return rounded(table.select(*ROLES.feature_columns(table)), EXACT)


@query("select_type", f"SELECT {', '.join(q(c) for c in ('id', TARGET, *SEASONS, *CODES))} FROM {encoded_sql()} e")
def select_type(spark, sf_dir):
    """The id and all short columns."""
    from pyspark.sql import types as T

    encoded = encode.encode_categories(I.subjects(spark, sf_dir), ROLES)
    return encoded.select("id", *quality.columns_of_type(encoded, T.ShortType))


@query("drop_cols", rounded_sql([c for c in I.subject_columns() if c not in I.TARGET_COLUMNS], I.subjects_sql()))
def drop_cols(spark, sf_dir):
    return rounded(I.subjects(spark, sf_dir).drop(*I.TARGET_COLUMNS), EXACT)


@query("series_subset", rounded_sql(["id", *SUMMARY], f"(SELECT * FROM {wide_sql()} w WHERE coalesce({', '.join(q(c) for c in SUMMARY)}) IS NOT NULL)"))
def series_subset(spark, sf_dir):
    wide = series.join_series(
        I.subjects(spark, sf_dir), preprocess.summarise_series(I.series(spark, sf_dir), ROLES)
    )
    return rounded(series.series_subset(wide).select("id", *SUMMARY), EXACT)


@query("common_columns", rounded_sql(WIDE_TEST, wide_sql()))
def common_columns(spark, sf_dir):
    """Train columns cut to those the test table has."""
    train = preprocess.build_features(I.subjects(spark, sf_dir), I.series(spark, sf_dir), ROLES)
    keep = pseudo.common_columns(train.columns, test_features(spark, sf_dir).columns)
    return rounded(train.select(*keep), EXACT)


# --- encoders and row features -----------------------------------------------


@query("encode_categories", rounded_sql(I.subject_columns(), encoded_sql()))
def encode_categories(spark, sf_dir):
    return rounded(encode.encode_categories(I.subjects(spark, sf_dir), ROLES), EXACT)


@query("row_features", rounded_sql(["id", *FEATURE_NAMES], features_sql()))
def row_features_query(spark, sf_dir):
    encoded = encode.encode_categories(I.subjects(spark, sf_dir), ROLES)
    return rounded(row_features(encoded, ROLES).select("id", *FEATURE_NAMES), EXACT)


def _family(name: str, column, sql: str) -> None:
    """One query per formula: a column over the subject table and its SQL."""

    @query(name, f"SELECT id, {sql_r6(f'CAST({sql} AS DOUBLE)')} AS value FROM {I.subjects_sql()} s")
    def run(spark, sf_dir):
        value = column().cast("double")
        return I.subjects(spark, sf_dir).select("id", r6(value).alias("value"))


_family("feat_coalesce", lambda: ff.feat_coalesce("PAQ_C-PAQ_C_Total", "PAQ_A-PAQ_A_Total"), 'coalesce("PAQ_C-PAQ_C_Total", "PAQ_A-PAQ_A_Total")')
_family("feat_null_count", lambda: ff.feat_null_count(*ROLES.inputs), "(" + " + ".join(f"CAST({q(c)} IS NULL AS INT)" for c in ROLES.inputs) + ")")
_family("feat_product", lambda: ff.feat_product("Physical-BMI", AGE), _feature_sql("product", ("Physical-BMI", AGE)))
_family("feat_ratio", lambda: ff.feat_ratio("Physical-BMI", "CGAS-CGAS_Score"), _feature_sql("ratio", ("Physical-BMI", "CGAS-CGAS_Score")))
_family("feat_ratio_plus1", lambda: ff.feat_ratio_plus1("Physical-BMI", HOURS), _feature_sql("ratio_plus1", ("Physical-BMI", HOURS)))
_family("feat_guarded_ratio", lambda: ff.feat_guarded_ratio("BIA-BIA_SMM", "BIA-BIA_FMI"), _feature_sql("guarded_ratio", ("BIA-BIA_SMM", "BIA-BIA_FMI")))
_family("feat_pressure", lambda: ff.feat_pressure("Physical-Diastolic_BP", "Physical-Systolic_BP"), _feature_sql("pressure", ("Physical-Diastolic_BP", "Physical-Systolic_BP")))
_family("feat_diff", lambda: ff.feat_diff("Physical-Systolic_BP", "Physical-Diastolic_BP"), _feature_sql("diff", ("Physical-Systolic_BP", "Physical-Diastolic_BP")))
_family("feat_min_sec", lambda: ff.feat_min_sec("Fitness_Endurance-Time_Mins", "Fitness_Endurance-Time_Sec"), _feature_sql("min_sec", ("Fitness_Endurance-Time_Mins", "Fitness_Endurance-Time_Sec")))
_family("feat_sum", lambda: ff.feat_sum(*FGC), f"({_feature_sql('sum', FGC)})")
_family("feat_row_mean", lambda: ff.feat_row_mean(*FGC), _feature_sql("row_mean", FGC))
_family("feat_threshold_sum", lambda: ff.feat_threshold_sum(["FGC-FGC_GSD_Zone", "FGC-FGC_GSND_Zone"], ZONES), f"({_feature_sql('achievements', ('FGC-FGC_GSD_Zone', 'FGC-FGC_GSND_Zone', *ZONES))})")
_family("sum_horizontal", lambda: ff.sum_ignoring_nulls(*FGC), f"coalesce(list_sum([{', '.join(q(c) for c in FGC)}]), 0)")
_family("score_to_level", lambda: fc.score_to_level(NUMERIC[3]), f"CASE WHEN {q(NUMERIC[3])} <= 30 THEN 0 WHEN {q(NUMERIC[3])} <= 49 THEN 1 WHEN {q(NUMERIC[3])} <= 79 THEN 2 ELSE 3 END")
_family("bin_age", lambda: fc.bin_age(AGE), AGE_BIN_SQL)


@query("feat_ratio_ieee", f'SELECT id, CASE WHEN "CGAS-CGAS_Score" = 0 AND "Physical-BMI" <> 0 THEN \'inf\' WHEN "CGAS-CGAS_Score" = 0 AND "Physical-BMI" = 0 THEN \'nan\' WHEN "Physical-BMI" / "CGAS-CGAS_Score" IS NULL THEN \'missing\' ELSE \'finite\' END AS kind FROM {I.subjects_sql()} s')
def feat_ratio_ieee(spark, sf_dir):
    """Kind of each ratio under floating-point division."""
    value = ff.feat_ratio("Physical-BMI", "CGAS-CGAS_Score", zero="ieee")
    kind = (
        F.when(value.isNull(), "missing")
        .when(F.isnan(value), "nan")
        .when(F.abs(value) == float("inf"), "inf")
        .otherwise("finite")
    )
    return I.subjects(spark, sf_dir).select("id", kind.alias("kind"))


@query("feat_norm2d", f"SELECT id, {sql_r6('sqrt(X * X + Y * Y)')} AS value FROM {I.series_sql()} s")
def feat_norm2d(spark, sf_dir):
    return I.series(spark, sf_dir).select("id", r6(ff.feat_norm2d("X", "Y")).alias("value"))


@query("linspace", f"SELECT id, {', '.join(f'{sql_r6(f'lo + {i} * (hi - lo) / 4')} AS v{i}' for i in range(5))} FROM (SELECT id, min(X) AS lo, max(X) AS hi FROM {I.series_sql()} s GROUP BY id) g")
def linspace(spark, sf_dir):
    """Five points between the smallest and the largest X of each id."""
    edges = I.series(spark, sf_dir).groupBy("id").agg(F.min("X").alias("lo"), F.max("X").alias("hi"))
    points = edges.select("id", ff.linspace_column("lo", "hi", 5).alias("v"))
    return points.select("id", *[r6(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(5)])


@query("map_values", f"SELECT id, CAST(CASE \"CGAS-Season\" WHEN 'Spring' THEN 0 WHEN 'Summer' THEN 1 ELSE -1 END AS INT) AS code FROM {I.subjects_sql()} s")
def map_values(spark, sf_dir):
    code = fc.map_values(F.col("CGAS-Season"), {"Spring": 0, "Summer": 1}, default=-1)
    known = F.when(F.col("CGAS-Season").isNull(), F.lit(-1)).otherwise(code)
    return I.subjects(spark, sf_dir).select("id", known.alias("code"))


# --- series ------------------------------------------------------------------


@query("series_summary", rounded_sql(["id", *SUMMARY], summary_sql()))
def series_summary(spark, sf_dir):
    return rounded(preprocess.summarise_series(I.series(spark, sf_dir), ROLES), EXACT)


@query("series_summary_bracketed", rounded_sql(["id", *SUMMARY], summary_sql()))
def series_summary_bracketed(spark, sf_dir):
    """The same summary of samples that lie in many partitions."""
    series = I.series(spark, sf_dir).repartition(64)
    return rounded(preprocess.summarise_series(series, ROLES), EXACT)


@query("join_series", rounded_sql(["id", *SUMMARY], wide_sql()))
def join_series(spark, sf_dir):
    summary = preprocess.summarise_series(I.series(spark, sf_dir), ROLES)
    wide = series.join_series(I.subjects(spark, sf_dir).select("id"), summary)
    return rounded(wide, EXACT)


@query("build_features", rounded_sql(WIDE, wide_sql()))
def build_features(spark, sf_dir):
    """Raw tables to the full feature table in one plan."""
    wide = preprocess.build_features(I.subjects(spark, sf_dir), I.series(spark, sf_dir), ROLES)
    return rounded(wide, EXACT)


# --- folds -------------------------------------------------------------------


@query("strata_key", f"SELECT id, CAST({AGE_BIN_SQL} AS VARCHAR) || CAST(sii AS VARCHAR) AS stratum FROM {I.subjects_sql()} s")
def strata_key(spark, sf_dir):
    key = fc.strata_key(fc.bin_age(AGE), F.col(TARGET))
    return I.subjects(spark, sf_dir).select("id", key.alias("stratum"))


@query("stratified_folds", f"SELECT id, sii, fold FROM {with_folds_sql(I.subjects_sql())} f")
def stratified_folds(spark, sf_dir):
    labelled = folds.split_labelled(I.subjects(spark, sf_dir), TARGET)[0]
    key = fc.strata_key(fc.bin_age(AGE), F.col(TARGET))
    return folds.stratified_folds(labelled, "id", key, 5, SEED).select("id", "sii", "fold")


@query("fold_info", f"SELECT id, fold_info FROM {small_gold_sql()} g")
def fold_info(spark, sf_dir):
    return small_gold(spark, sf_dir).select("id", "fold_info")


@query("fold_report", f"SELECT sii, fold_info, count(*) AS n FROM {small_gold_sql()} g GROUP BY sii, fold_info")
def fold_report(spark, sf_dir):
    return folds.fold_report(small_gold(spark, sf_dir), "sii")


@query("sort_report", f"SELECT {q(SEX)}, fold_info, count(*) AS n FROM {small_gold_sql()} g GROUP BY {q(SEX)}, fold_info ORDER BY {q(SEX)}, fold_info")
def sort_report(spark, sf_dir):
    return folds.fold_report(small_gold(spark, sf_dir), SEX)


@query("first_value", f"SELECT min(fold_info) AS fold_info, replace(replace(min(fold_info), 't', 'n'), 'v', 't') AS pseudo_info FROM {small_gold_sql()} g WHERE split_part(fold_info, ', ', 2) = 'v'")
def first_value(spark, sf_dir):
    first = folds.first_validation_info(small_gold(spark, sf_dir), 1)
    return first.withColumn("pseudo_info", fc.swap_fold_flags("fold_info"))


@query("leak_check", "SELECT user_id AS id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def leak_check(spark, sf_dir):
    """Users with both a purchase and a signup: ids on two sides of a split."""
    events = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type")
    sides = [events.where(F.col("event_type") == t) for t in ("purchase", "signup")]
    return quality.leak_check(*sides, "id")


@query("leaks_found", "SELECT " + ", ".join(f"count(DISTINCT user_id) FILTER (WHERE user_id % 5 = {k} AND user_id % 3 = 0) AS fold_{k}" for k in range(5)) + " FROM events")
def leaks_found(spark, sf_dir):
    """Ids that every third user has in its validation rows and, once more, in the train rows."""
    users = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    fold = (F.col("id") % 5).cast("int")
    valid = folds.fold_info(users.withColumn("fold", fold), "fold", 5).drop("fold")
    again = valid.where("id % 3 = 0").withColumn("fold_info", F.lit(", ".join(["t"] * 5)))
    return quality.leaks_by_fold(valid.unionByName(again), "id", 5)


@query("leaks_by_fold", "SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS fold_{k}" for k in range(5)) + f" FROM {small_gold_sql()} g HAVING count(*) > 0")
def leaks_by_fold(spark, sf_dir):
    """Leaking ids per fold of the gold table; there are none."""
    return quality.leaks_by_fold(small_gold(spark, sf_dir), "id", 5)


@query("intersect_ids", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def intersect_ids(spark, sf_dir):
    customers = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    users = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return quality.intersect_ids(customers, users, "id")


@query("distinct_ids", "SELECT DISTINCT user_id FROM events")
def distinct_ids(spark, sf_dir):
    return quality.distinct_ids(I.table(spark, sf_dir, "events"), "user_id")


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return quality.row_count(I.table(spark, sf_dir, "lineitem"))


RATIO_NAMES = [(n, i) for n, f, i in ROW_FEATURES if f == "ratio"]


@query("inf_count", "SELECT CAST(" + " + ".join(f"count(*) FILTER (WHERE {q(i[0])} <> 0 AND {q(i[1])} = 0)" for _, i in RATIO_NAMES) + f" AS BIGINT) AS any_infinite FROM (SELECT *, coalesce(\"PAQ_C-PAQ_C_Total\", \"PAQ_A-PAQ_A_Total\") AS {q(PAQ)} FROM {I.subjects_sql()} s) t")
def inf_count(spark, sf_dir):
    """Infinite ratios of the row features under floating-point division."""
    encoded = encode.encode_categories(I.subjects(spark, sf_dir), ROLES)
    wide = row_features(encoded, ROLES, zero="ieee")
    return quality.inf_count(wide, [n for n, _ in RATIO_NAMES])


# --- statistics and imputers -------------------------------------------------

IMPUTED = list(NUMERIC)
CODED = list(CODES)


@query("column_means", f"SELECT {', '.join(f'{sql_r6(f'avg({q(c)})')} AS {q(c)}' for c in NUMERIC)} FROM {I.subjects_sql()} s")
def column_means(spark, sf_dir):
    return rounded(encode.column_means(I.subjects(spark, sf_dir), NUMERIC), [])


@query("column_max_plus_one", f"SELECT {', '.join(f'max({q(c)}) + 1 AS {q(c)}' for c in CODES)} FROM {I.subjects_sql()} s")
def column_max_plus_one(spark, sf_dir):
    return encode.column_max_plus_one(I.subjects(spark, sf_dir), CODES)


def _both_views(spark, sf_dir, fn) -> DataFrame:
    """Train and validation rows of fold 0 after `fn(train, [valid])`."""
    train, valid = folds.fold_view(small_gold(spark, sf_dir), 0)
    done = fn(train, [valid])
    return done[0].unionByName(done[1])


CURRENT_SQL = f"(SELECT *, split_part(fold_info, ', ', 1) AS current_fold FROM {small_gold_sql()} g)"


@query("impute_train_mean", f"WITH g AS {CURRENT_SQL}, m AS (SELECT {', '.join(f'avg({q(c)}) AS {q(c)}' for c in IMPUTED)} FROM g WHERE current_fold = 't') SELECT g.id, g.current_fold, {', '.join(f'{sql_r6(f'coalesce(g.{q(c)}, m.{q(c)})')} AS {q(c)}' for c in IMPUTED)} FROM g, m")
def impute_train_mean(spark, sf_dir):
    done = _both_views(spark, sf_dir, lambda t, o: encode.impute_train_mean(t, o, IMPUTED))
    return rounded(done.select("id", "current_fold", *IMPUTED), ["id", "current_fold"])


@query("impute_max_plus_one", f"WITH g AS {CURRENT_SQL} SELECT id, current_fold, {', '.join(f'CAST(coalesce({q(c)}, max({q(c)}) OVER (PARTITION BY current_fold) + 1) AS INT) AS {q(c)}' for c in CODED)} FROM g")
def impute_max_plus_one(spark, sf_dir):
    done = _both_views(spark, sf_dir, lambda t, o: encode.impute_max_plus_one(t, o, CODED))
    return done.select("id", "current_fold", *[F.col(c).cast("int").alias(c) for c in CODED])


@query("fill_none", f"SELECT id, {', '.join(f'coalesce(CAST({q(c)} AS VARCHAR), \'none\') AS {q(c)}' for c in ROLES.categorical)} FROM {encoded_sql()} e")
def fill_none(spark, sf_dir):
    encoded = encode.encode_categories(I.subjects(spark, sf_dir), ROLES)
    return encode.fill_none_columns(encoded, ROLES.categorical).select("id", *ROLES.categorical)


def _one_hot_sql() -> str:
    labels = {c: sorted(I.SEASON_CODES) for c in SEASONS}
    labels |= {c: [str(v) for v in range(2 + i % 3)] for i, c in enumerate(CODES)}
    parts = []
    for c, values in labels.items():
        text = f"CAST({q(c)} AS VARCHAR)"
        if len(values) == 2:
            parts.append(f"CASE {text} WHEN '{values[0]}' THEN 1e0 WHEN '{values[1]}' THEN -1e0 ELSE 0e0 END AS {q(c)}")
        else:
            parts += [f"CAST(coalesce({text} = '{v}', false) AS DOUBLE) AS {q(f'{c}={v}')}" for v in values]
    return f"SELECT id, {', '.join(parts)} FROM {I.subjects_sql()} s"


@query("one_hot_missing_zero", _one_hot_sql())
def one_hot_missing_zero(spark, sf_dir):
    """Every categorical column: many labels as many columns, two as one signed column."""
    rows = I.subjects(spark, sf_dir).select("id", *SEASONS, *CODES)
    return encode.one_hot_missing_zero(rows, [], [*SEASONS, *CODES])[0]


SLOTTED = ["o_orderstatus", "o_custkey", "o_orderpriority"]
_LABELS_SQL = " UNION ".join(
    f"SELECT {i} AS place, {'CAST(o_custkey AS DOUBLE)' if c == 'o_custkey' else 'NULL'} AS number, CAST({c} AS VARCHAR) AS value FROM orders WHERE o_orderkey % 7 <> 0"
    for i, c in enumerate(SLOTTED)
)
_DICTIONARY_SQL = f"(SELECT place, value, row_number() OVER (ORDER BY place, number, value) - 1 AS slot FROM ({_LABELS_SQL}) l)"


@query("one_hot_slots", f"WITH d AS {_DICTIONARY_SQL} SELECT o_orderkey, {', '.join(f'd{i}.slot AS {c}_slot' for i, c in enumerate(SLOTTED))} FROM orders " + " ".join(f"LEFT JOIN d d{i} ON d{i}.place = {i} AND d{i}.value = CAST({c} AS VARCHAR)" for i, c in enumerate(SLOTTED)))
def one_hot_slots(spark, sf_dir):
    """Places of the labels of orders, one of them the customer; those that are not in the train rows have none."""
    rows = I.table(spark, sf_dir, "orders").select("o_orderkey", *SLOTTED)
    train, rest = rows.where("o_orderkey % 7 <> 0"), rows.where("o_orderkey % 7 = 0")
    done = encode.one_hot_slots(train, [rest], SLOTTED)
    return done[0].unionByName(done[1])


MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _robust_sql() -> str:
    parts = [
        f"quantile_cont({c}, 0.25) AS {c}_q25, median({c}) AS {c}_median,"
        f" quantile_cont({c}, 0.75) AS {c}_q75, min({c}) AS {c}_min, max({c}) AS {c}_max"
        for c in MEASURED
    ]
    return f"SELECT {', '.join(parts)} FROM lineitem"


ROBUST_NAMES = [f"{c}_{f}" for c in MEASURED for f in ("q25", "median", "q75", "min", "max")]


@query("robust_stats", rounded_sql(ROBUST_NAMES, f"({_robust_sql()})"))
def robust_stats(spark, sf_dir):
    return rounded(encode.robust_stats(I.table(spark, sf_dir, "lineitem"), MEASURED), [])


@query("robust_stats_bracketed", rounded_sql(ROBUST_NAMES, f"({_robust_sql()})"))
def robust_stats_bracketed(spark, sf_dir):
    """The same statistics from coarse sketches, with more values left to rank."""
    lineitem = I.table(spark, sf_dir, "lineitem")
    return rounded(encode.robust_stats(lineitem, MEASURED, accuracy=25), [])


def _clip_sql() -> str:
    columns = []
    for c in MEASURED:
        spread = (
            f"CASE WHEN {c}_q75 = {c}_q25 THEN 0.5 * ({c}_max - {c}_min) ELSE {c}_q75 - {c}_q25 END"
        )
        z = f"(({c} - {c}_median) / nullif({spread}, 0))"
        columns.append(f"{sql_r6(f'coalesce({z} / sqrt(1 + pow({z} / 3, 2)), 0)')} AS {c}")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(columns)} FROM lineitem, ({_robust_sql()}) r"


@query("robust_smooth_clip", _clip_sql())
def robust_smooth_clip(spark, sf_dir):
    lineitem = I.table(spark, sf_dir, "lineitem")
    clipped = encode.robust_smooth_clip(lineitem, [], MEASURED)[0]
    return rounded(
        clipped.select("l_orderkey", "l_linenumber", *MEASURED), ["l_orderkey", "l_linenumber"]
    )


@query("standardize_target", f"SELECT id, {sql_r6('(y - avg(y) OVER ()) / (stddev_pop(y) OVER () + 1e-30)')} AS y FROM {I.scored_sql()} s")
def standardize_target(spark, sf_dir):
    rows = I.scored(spark, sf_dir)
    (done,), _ = encode.standardize_target(rows, [], "y")
    return done.select("id", r6("y").alias("y"))


@query("union_relaxed", "SELECT o_orderkey AS id, o_totalprice AS value FROM orders UNION ALL SELECT c_custkey, CAST(c_nationkey AS DOUBLE) FROM customer")
def union_relaxed(spark, sf_dir):
    """Doubles and integers widened to doubles."""
    orders = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")
    )
    customers = I.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value")
    )
    return pseudo.union_relaxed(orders, customers)


@query("union_strict", "SELECT o_orderkey AS id, o_totalprice AS value FROM orders UNION ALL SELECT CAST(s_suppkey AS BIGINT), CAST(s_nationkey AS DOUBLE) FROM supplier")
def union_strict(spark, sf_dir):
    """The second frame cast to the schema of the first."""
    orders = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")
    )
    suppliers = I.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("value"), F.col("s_suppkey").cast("string").alias("id")
    )
    return pseudo.union_strict(orders, suppliers)


@query("union_lists", f"SELECT {', '.join(q(c) for c in dict.fromkeys([*SEASONS[:3], *CODES[:3], SEASONS[1], SEASONS[4]]))} FROM {encoded_sql()} e")
def union_lists(spark, sf_dir):
    """Columns that several members use, each selected once."""
    names = union_lists_of([[*SEASONS[:3], *CODES[:3]], [SEASONS[1], SEASONS[4]]])
    return encode.encode_categories(I.subjects(spark, sf_dir), ROLES).select(*names)

