"""Class, level and stratum columns of the ordinal target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordina.functions.features import ColumnLike, _c

# --- fixed values ------------------------------------------------------------
AGE_EDGES = (7, 8, 9, 10, 12, 14)
LEVEL_EDGES = (30, 49, 79)
# -----------------------------------------------------------------------------


def _steps(value: Column, edges: Sequence[float], inclusive: bool) -> Column:
    """Index of the first edge above the value, `len(edges)` when there is none."""
    out = None
    for i, edge in enumerate(edges):
        hit = value <= F.lit(edge) if inclusive else value < F.lit(edge)
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def bin_age(age: ColumnLike) -> Column:
    """Ordered age bucket 0..6; a missing age falls into the last one."""
    return _steps(_c(age), AGE_EDGES, inclusive=True)


def strata_key(*parts: ColumnLike) -> Column:
    return F.concat(*[_c(p).cast("string") for p in parts])


def score_to_level(total: ColumnLike) -> Column:
    """Questionnaire total to severity level 0..3."""
    return _steps(_c(total), LEVEL_EDGES, inclusive=True)


def round_to_class(pred: ColumnLike, thresholds: Sequence[float]) -> Column:
    """Class 0..len(thresholds) with strict `<`; null and NaN give the top class."""
    return _steps(_c(pred), thresholds, inclusive=False)


def round_half_even(pred: ColumnLike) -> Column:
    """Nearest integer, ties to even; NaN has none and gives null."""
    return F.bround(_c(pred)).try_cast("int")


def ordinal_target(label: ColumnLike, n: int) -> Column:
    """Class `c` as `n` numbers: one up to position `c`, zero behind it."""
    return F.array(*[(_c(label) >= F.lit(i)).cast("double") for i in range(n)])


def ordinal_decode(scores: ColumnLike, cut: float = 0.5) -> Column:
    """Position of the last score above `cut`, 0 when there is none."""
    scores = _c(scores)
    above = F.filter(
        F.sequence(F.lit(0), F.size(scores) - F.lit(1)), lambda i: F.get(scores, i) > F.lit(cut)
    )
    return F.when(F.size(scores) == 0, F.lit(0)).otherwise(
        F.coalesce(F.array_max(above), F.lit(0))
    )


def map_values(key: ColumnLike, mapping: dict, default=None) -> Column:
    """Literal dictionary lookup; unknown keys give `default`."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), _c(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def encode_label(label: ColumnLike, mapping: dict[str, int]) -> Column:
    """Label to short code. Nulls stay null, an unknown label fails the query."""
    label = _c(label)
    code = map_values(label, mapping).cast("short")
    unknown = F.raise_error(F.concat(F.lit("no code for label: "), label)).cast("short")
    return F.when(label.isNull(), F.lit(None).cast("short")).otherwise(F.coalesce(code, unknown))


def fill_none(column: ColumnLike) -> Column:
    """Category as text with `none` for a missing value."""
    return F.coalesce(_c(column).cast("string"), F.lit("none"))


def fold_entry(fold_info: ColumnLike, k: int) -> Column:
    """Flag of fold `k` (`t`, `v` or `n`) in a `fold_info` string."""
    return F.element_at(F.split(_c(fold_info), ", "), k + 1)


def validation_fold(fold_info: ColumnLike) -> Column:
    """The fold a row validates, null when it validates none."""
    at = F.array_position(F.split(_c(fold_info), ", "), "v").cast("int") - F.lit(1)
    return F.when(at >= 0, at)


def pseudo_fold_info(k: int, n_fold: int) -> str:
    """`fold_info` of a pseudo-labelled row: trains fold `k`, is unused elsewhere."""
    return ", ".join("t" if i == k else "n" for i in range(n_fold))


def swap_fold_flags(fold_info: ColumnLike) -> Column:
    """`t` becomes `n` and `v` becomes `t`."""
    return F.translate(_c(fold_info), "tv", "nt")
