"""Queries on stated trees.

Fitted trees have no closed form in SQL, stated ones have: every tree is a nested CASE,
an expectation over left-out features is one with shares of cover in place of tests, and
Shapley values are sums over coalitions. The SQL side spells these out, so that it knows
curves, importances and contributions without what the operators use to find them.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial, nan

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.catalog import inputs as I
from ordina.catalog.inputs import r6, rounded, sql_r6
from ordina.catalog.metric_queries import N_FOLD, SCORED, _info_sql, class_sql, kappa_sql
from ordina.catalog.registry import query
from ordina.operators import explain, models
from ordina.operators.models import PRED, FeatureSpace, StatedTrees, TreeNodes

SPACE = FeatureSpace({"a": 1.5, "b": 1.0}, ("b",), {"c": 3})
A, B, B_MISSING, C = range(4)  # slots
COLUMNS = {
    "a": "CAST(CASE WHEN id % 29 = 0 THEN NULL ELSE (id * 37) % 100 / 100e0 * 3e0 END AS DOUBLE)",
    "b": "CAST(CASE WHEN id % 13 = 0 THEN NULL ELSE id % 7 * 5e-1 END AS DOUBLE)",
    "c": "CAST(CASE WHEN id % 17 = 0 THEN NULL ELSE id % 6 END AS INT)",
}


def leaf(value: float, cover: float) -> tuple:
    return (None, value, cover)


def stated(k: int) -> list[tuple[tuple, float]]:
    """(tree, weight) of fold k; a split is (slot, threshold or codes, left, right)."""
    edge = 1 + 0.25 * k
    first = (A, edge, leaf(0.25, 60), (B, 1.5, leaf(1.0, 25), leaf(1.75, 15)))
    second = (C, {0, 2}, (A, 2.0, leaf(-0.25, 30), leaf(0.5, 20)), (B_MISSING, 0.5, leaf(0.25, 40), leaf(-0.5, 10)))
    third = (B, 0.5, leaf(0.0, 35), (B, 2.5, leaf(1.0, 45), (C, {1, 4}, leaf(2.0, 5), leaf(1.5, 15))))
    trees = [(first, 1.0), (second, 1.0), (third, 0.5), (leaf(0.125, 100), 1.0)]
    return trees if k < N_FOLD - 1 else [trees[0], trees[3], trees[1], trees[2]]


def kept(k: int) -> int:
    """The last fold is cut to trees that do not use c."""
    return 4 if k < N_FOLD - 1 else 2


def averages(k: int) -> bool:
    return k >= N_FOLD - 2


def cover(node: tuple) -> float:
    return node[2] if node[0] is None else cover(node[2]) + cover(node[3])


def tree_nodes(root: tuple) -> TreeNodes:
    nodes, rows = [root], []
    while len(rows) < len(nodes):
        node = nodes[len(rows)]
        if node[0] is None:
            rows.append((-1, nan, None, -1, -1, node[1], node[2], -1.0))
            continue
        slot, test, left, right = node
        codes = frozenset(map(float, test)) if isinstance(test, set) else None
        rows.append((slot, nan if codes else test, codes, len(nodes), len(nodes) + 1, 0.0, cover(node), 1.0))
        nodes += [left, right]
    columns = list(zip(*rows))
    return TreeNodes(*(c if i == 2 else np.array(c) for i, c in enumerate(columns)))


def fold_models() -> list[StatedTrees]:
    out = []
    for k in range(N_FOLD):
        trees = stated(k)
        out.append(
            StatedTrees(k, SPACE, [tree_nodes(t) for t, _ in trees], [w for _, w in trees], averages(k), kept(k))
        )
    return out


def tree_rows(spark, sf_dir) -> DataFrame:
    base = I.scored(spark, sf_dir).select("id", "y")
    columns = [F.expr(f"{sql} AS {name}") for name, sql in COLUMNS.items()]
    return base.select("id", "y", *columns, F.expr(_info_sql().replace("doc_id", "id")).alias("fold_info"))


ROWS_SQL = f"(SELECT id, fold, y, {', '.join(f'{sql} AS {name}' for name, sql in COLUMNS.items())} FROM {SCORED} s)"

# --- trees in SQL ------------------------------------------------------------

SLOTS_SQL = (
    "coalesce({a}, 1.5e0)",
    "coalesce({b}, 1e0)",
    "CASE WHEN {b} IS NULL THEN 1e0 ELSE 0e0 END",
    "CASE WHEN {c} BETWEEN 0 AND 3 THEN {c} ELSE 4 END",
)
OWN = {"a": "a", "b": "b", "c": "c"}


def expected_sql(node: tuple, known: tuple[int, ...], columns: dict[str, str]) -> str:
    """Expectation of a tree where only the slots in `known` are."""
    if node[0] is None:
        return f"{node[1]!r}e0"
    slot, test, left, right = node
    yes, no = expected_sql(left, known, columns), expected_sql(right, known, columns)
    if slot not in known:
        return f"({cover(left)}e0 / {cover(node)}e0 * {yes} + {cover(right)}e0 / {cover(node)}e0 * {no})"
    value = SLOTS_SQL[slot].format(**columns)
    hit = f"{value} IN ({', '.join(map(str, sorted(test)))})" if isinstance(test, set) else f"{value} <= {test!r}e0"
    return f"CASE WHEN {hit} THEN {yes} ELSE {no} END"


def score_sql(k: int, upto: int, columns: dict[str, str] = OWN) -> str:
    trees = stated(k)[:upto]
    total = " + ".join(f"{w!r}e0 * {expected_sql(t, (A, B, B_MISSING, C), columns)}" for t, w in trees)
    return f"(({total}) / {sum(w for _, w in trees) if averages(k) else 1.0!r}e0)"


def by_fold_sql(of_fold) -> str:
    return "CASE fold " + " ".join(f"WHEN {k} THEN {of_fold(k)}" for k in range(N_FOLD)) + " END"


def shapley_sql(k: int, feature: str) -> str:
    """Shapley values of a feature's slots from all coalitions of each tree's slots."""
    trees = stated(k)[: kept(k)]
    scale = sum(w for _, w in trees) if averages(k) else 1.0
    terms = ["0e0"]
    for tree, weight in trees:
        slots = sorted(slots_of(tree))
        for slot in (s for s in slots if SPACE.slot_owners[s] == feature):
            others = [s for s in slots if s != slot]
            for n in range(len(slots)):
                chance = factorial(n) * factorial(len(slots) - 1 - n) / factorial(len(slots)) * weight / scale
                for some in combinations(others, n):
                    gain = f"{expected_sql(tree, (*some, slot), OWN)} - {expected_sql(tree, some, OWN)}"
                    terms.append(f"{chance:.17f} * ({gain})")
    return "(" + " + ".join(terms) + ")"


def slots_of(node: tuple) -> set[int]:
    return set() if node[0] is None else {node[0]} | slots_of(node[2]) | slots_of(node[3])


def bias_sql(k: int) -> str:
    trees = stated(k)[: kept(k)]
    scale = sum(w for _, w in trees) if averages(k) else 1.0
    return "(" + " + ".join(f"{w / scale:.17f} * {expected_sql(t, (), OWN)}" for t, w in trees) + ")"


# --- queries -----------------------------------------------------------------

SCORES_SQL = f"(SELECT id, fold, y, {by_fold_sql(lambda k: score_sql(k, kept(k)))} AS pred FROM {ROWS_SQL} t)"


@query("oof_predict_stated", f"SELECT id, fold, {sql_r6('pred')} AS pred FROM {SCORES_SQL} o")
def oof_predict_stated(spark, sf_dir):
    """Validation rows scored by trees."""
    scored = models.oof_predict(fold_models(), tree_rows(spark, sf_dir), keep=["id"])
    return scored.select("id", "fold", r6(PRED).alias("pred"))


def _staged_sql() -> str:
    """Scores cut at every tree of every fold, one after another."""
    cuts = [
        f"SELECT {k} AS fold, {i} AS iter, y, {score_sql(k, i + 1)} AS pred FROM {ROWS_SQL} t WHERE fold = {k}"
        for k in range(N_FOLD)
        for i in range(kept(k))
    ]
    return "(" + " UNION ALL ".join(cuts) + ")"


STAGED_KAPPA = kappa_sql(f"(SELECT fold || '-' || iter AS grp, y, {class_sql('pred')} AS p FROM {_staged_sql()} c)", "y", "p", "grp")


@query("staged_metric_stated", f"SELECT CAST(split_part(grp, '-', 1) AS INT) AS fold, CAST(split_part(grp, '-', 2) AS INT) AS iter, {sql_r6('qwk')} AS value FROM {STAGED_KAPPA} k")
def staged_metric_stated(spark, sf_dir):
    """Kappa after every tree."""
    curve = models.staged_metric(fold_models(), tree_rows(spark, sf_dir), "y")
    return curve.select("fold", "iter", r6("value").alias("value"))


@query("staged_metrics_stated", f"SELECT fold, iter, {sql_r6('avg((y - pred) * (y - pred))')} AS mse, {sql_r6('avg(abs(y - pred))')} AS mae FROM {_staged_sql()} c GROUP BY fold, iter")
def staged_metrics_stated(spark, sf_dir):
    """Squared and absolute error after every tree, from one pass."""
    several = {
        "mse": models.Metric(*_error(lambda y, p: F.avg((y - p) * (y - p)))),
        "mae": models.Metric(*_error(lambda y, p: F.avg(F.abs(y - p)))),
    }
    curve = models.staged_metric(fold_models(), tree_rows(spark, sf_dir), "y", metrics=several)
    wide = curve.groupBy("fold", "iter").agg(
        *[F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in several]
    )
    return rounded(wide, ["fold", "iter"])


def _error(how):
    return lambda y, p: [how(y, p).alias("__error")], lambda df, out: df.withColumnRenamed("__error", out)


CONTRIBS_SQL = "SELECT id, fold, " + ", ".join(
    f"{by_fold_sql(lambda k, c=c: shapley_sql(k, c))} AS of_{c}" for c in SPACE.features
) + f", {by_fold_sql(bias_sql)} AS bias FROM {ROWS_SQL} t"


@query("contributions_stated", f"SELECT id, fold, {', '.join(f'{sql_r6(c)} AS {c}' for c in ('of_a', 'of_b', 'of_c', 'bias'))} FROM ({CONTRIBS_SQL}) c")
def contributions_stated(spark, sf_dir):
    """Shapley values of every feature for every validation row."""
    found = explain.contributions(fold_models(), tree_rows(spark, sf_dir), "id")
    each = [F.get("contributions", F.lit(i)).alias(f"of_{c}") for i, c in enumerate(SPACE.features)]
    return rounded(found.select("id", "fold", *each, "bias"), ["id", "fold"])


@query("mean_abs_contrib_stated", " UNION ALL ".join(f"SELECT '{c}' AS feature, {sql_r6('avg(v)')} AS importance FROM (SELECT avg(abs(of_{c})) AS v FROM ({CONTRIBS_SQL}) x GROUP BY fold) y" for c in SPACE.features))
def mean_abs_contrib_stated(spark, sf_dir):
    """Mean absolute Shapley values, per fold and then over the folds."""
    found = explain.contributions(fold_models(), tree_rows(spark, sf_dir), "id")
    return rounded(explain.mean_abs_contrib(found, SPACE.features), ["feature"])


def _shuffled_sql(repeats: int = 3, seed: int = 0) -> str:
    ranks = "row_number() OVER (PARTITION BY fold ORDER BY md5('{key}' || id), id) AS rn"
    pairs = " UNION ALL ".join(
        f"SELECT {r} AS repeat, o.*, p.a AS pa, p.b AS pb, p.c AS pc"
        f" FROM (SELECT *, {ranks.format(key=f'{seed}-a-')} FROM {ROWS_SQL} t) o"
        f" JOIN (SELECT *, {ranks.format(key=f'{seed}-b{r}-')} FROM {ROWS_SQL} t) p USING (fold, rn)"
        for r in range(repeats)
    )
    shuffled = " UNION ALL ".join(
        f"SELECT '{c}-' || repeat || '-' || fold AS grp, y, {class_sql(by_fold_sql(lambda k, c=c: score_sql(k, kept(k), {**OWN, c: 'p' + c})))} AS p FROM ({pairs}) x"
        for c in SPACE.features
    )
    kappas = kappa_sql(f"({shuffled})", "y", "p", "grp")
    base = kappa_sql(SCORES_SQL, "y", class_sql("pred"), "fold")
    return (
        f"SELECT split_part(grp, '-', 1) AS feature, {sql_r6(f'(SELECT avg(qwk) FROM {base} k) - avg(qwk)')} AS importance"
        f" FROM {kappas} k GROUP BY 1"
    )


@query("permutation_importance_stated", _shuffled_sql())
def permutation_importance_stated(spark, sf_dir):
    """Three features shuffled in turn under trees."""
    table = explain.permutation_importance(fold_models(), tree_rows(spark, sf_dir), "id", "y", SPACE.features)
    return rounded(table, ["feature"])
