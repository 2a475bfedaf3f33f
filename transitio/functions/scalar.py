"""Column-level functions: daily sensor arithmetic, rounding, labels and decoding.

All of them return ``Column`` expressions, so they stay inside whole-stage codegen.
Missing values are SQL NULL; a zero-denominator ratio is IEEE +Infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical labels and texts.
LABEL_MORE = "More Depressed"
LABEL_LESS = "Less Depressed"
LABEL_REMAINS = "Remains"
# Text-to-code map used by the prompting path: Remains=0, More Depressed=1, Less Depressed=2.
LABEL_CODES = {LABEL_REMAINS: 0, LABEL_MORE: 1, LABEL_LESS: 2}
STATE_DEPRESSED = "in depression"
STATE_NOT_DEPRESSED = "in non-depression"
CONTROL_GROUP = "mmm-control"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q(name: str) -> str:
    """Backtick-quoted column reference for SQL expression strings."""
    return "`" + name.replace("`", "``") + "`"


def np_round_sql(x: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(rint(({x}) * {scale}D) / {scale}D)"


def np_round(c: Column | str, digits: int) -> Column:
    """numpy/pandas ``.round(d)``: ``rint(x * 10^d) / 10^d`` (half to even on the scaled value).

    Spark's ``round`` is HALF_UP and differs on ties (0.25 -> 0.3), so it is not used.
    """
    if isinstance(c, str):
        return F.expr(np_round_sql(q(c), digits))
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def nan_to_null(c: Column | str) -> Column:
    """IEEE NaN becomes NULL, so ``greatest``/aggregates skip it instead of returning NaN."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def battery_daily_mean(cols: Sequence[str]) -> Column:
    """sum of the epoch means (NULLs skipped) divided by the number of epochs, always;
    0 when the sum is not positive; truncated to int."""
    total = "(" + " + ".join(f"coalesce({q(c)}, 0D)" for c in cols) + ")"
    return F.expr(f"CAST(CASE WHEN {total} > 0 THEN {total} / {len(cols)}D ELSE 0D END AS INT)")


def quadratic_mean(cols: Sequence[str]) -> Column:
    """``sqrt(sum(x^2) / n)`` truncated to int; 0 when the sum is not positive or a cell is NULL."""
    total = "(" + " + ".join(f"{q(c)} * {q(c)}" for c in cols) + ")"
    return F.expr(f"CAST(CASE WHEN {total} > 0 THEN sqrt({total} / {len(cols)}D) ELSE 0D END AS INT)")


def truncate_int(c: Column | str) -> Column:
    """truncation toward zero; NULL stays NULL."""
    return col(c).cast("int")


def daily_max(cols: Sequence[str], digits: int = 1) -> Column:
    """maximum over the epochs (NULL and NaN skipped), 0 when not positive, rounded."""
    m = "greatest(" + ", ".join(f"nanvl({q(c)}, CAST(NULL AS DOUBLE))" for c in cols) + ")"
    return F.expr(np_round_sql(f"CASE WHEN {m} > 0 THEN {m} ELSE 0D END", digits))


def seconds_to(c: str, seconds_per_unit: float, digits: int = 1) -> Column:
    """Duration in seconds converted to minutes (60) or hours (3600), rounded; NULL stays NULL."""
    x = f"CAST({q(c)} AS DOUBLE)"
    return F.expr(np_round_sql(f"CASE WHEN {x} = 0 THEN 0D ELSE {x} / {float(seconds_per_unit)}D END", digits))


def safe_ratio(num: str, den: str, digits: int = 2) -> Column:
    """NULL if either side is NULL, +Infinity if the denominator is 0, else the rounded ratio."""
    a, b = f"CAST({q(num)} AS DOUBLE)", f"CAST({q(den)} AS DOUBLE)"
    return F.expr(f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN CAST(NULL AS DOUBLE) "
                  f"WHEN {b} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE {np_round_sql(f'{a} / {b}', digits)} END")


def severity_state(score: Column | str, cut: float = 10) -> Column:
    """score at or above the cut is 'in depression'."""
    return F.when(col(score) >= F.lit(cut), F.lit(STATE_DEPRESSED)).otherwise(F.lit(STATE_NOT_DEPRESSED))


def transition_label(current: Column | str, previous: Column | str, threshold: float = 3) -> Column:
    """strict threshold on the change of score."""
    cur, pre = col(current), col(previous)
    return (F.when(cur - pre > F.lit(threshold), F.lit(LABEL_MORE))
            .when(pre - cur > F.lit(threshold), F.lit(LABEL_LESS))
            .otherwise(F.lit(LABEL_REMAINS)))


def label_code(label: Column | str) -> Column:
    """F16: label text to its prompting-path code; unknown text is NULL."""
    out = F.lit(None).cast("int")
    for text, code in reversed(list(LABEL_CODES.items())):
        out = F.when(col(label) == F.lit(text), F.lit(code)).otherwise(out)
    return out


def gender_text(bg_sex: Column | str) -> Column:
    """1 is male, anything else female (NULL stays NULL)."""
    return F.when(col(bg_sex).isNull(), F.lit(None).cast("string")) \
        .when(col(bg_sex) == 1, F.lit("male")).otherwise(F.lit("female"))


def initial_state_text(group: Column | str) -> Column:
    """the control group entered not depressed."""
    return F.when(col(group).isNull(), F.lit(None).cast("string")) \
        .when(col(group) == F.lit(CONTROL_GROUP), F.lit("not depressed")).otherwise(F.lit("depressed"))


def coerce_numeric(c: Column | str, fill_after: bool) -> Column:
    """text to double with bad text -> missing.

    ``fill_after=False`` is the tree path (fill NULL with 0, then coerce: bad text stays
    missing); ``fill_after=True`` is the sequence path (fill again, so everything missing is 0).
    """
    parsed = nan_to_null(F.expr(f"try_cast(coalesce({_sql_ref(c)}, '0') AS DOUBLE)"))
    return F.coalesce(parsed, F.lit(0.0)) if fill_after else parsed


def _sql_ref(c: Column | str) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("coerce_numeric takes a column name")


def argmax_index(arr: Column | str) -> Column:
    """0-based position of the first maximum of an array."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def md5_int(text: Column) -> Column:
    """A 60-bit hash from the first 15 hex digits of md5, equal in Spark and plain SQL engines."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
