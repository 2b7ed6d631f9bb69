"""Column helpers where Spark's own functions differ from what the analyses need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b as double; null where b is zero or null."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation; null, never an error, for constant input or one pair."""
    pa, pb = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(pa) * F.stddev_pop(pb), F.lit(0.0))


def any_nonnull(x: str) -> Column:
    """Some value of the group that is not null."""
    return F.expr(f"any_value({x}, true)")


def arg_max(x: str, by: str, tie: str | None = None) -> Column:
    """``x`` where ``by`` is largest, rows with null ``x`` left out; ties go to the smallest ``tie``."""
    return F.expr(f"max_by({x}, {_key(by, tie, -1)}) FILTER (WHERE {x} IS NOT NULL)")


def arg_min(x: str, by: str, tie: str | None = None) -> Column:
    """``x`` where ``by`` is smallest, rows with null ``x`` left out; ties go to the smallest ``tie``."""
    return F.expr(f"min_by({x}, {_key(by, tie, 1)}) FILTER (WHERE {x} IS NOT NULL)")


def _key(by: str, tie: str | None, sign: int) -> str:
    if tie is None:
        return by
    return f"struct({by}, {'-' if sign < 0 else ''}{tie})"


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds, null conditions left out."""
    return F.avg(condition.cast("int").cast("double"))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Mean of x weighted by w over rows with both; null for no weight."""
    both = col(x).isNotNull() & col(w).isNotNull()
    return F.sum(F.when(both, col(x) * col(w))) / F.nullif(F.sum(F.when(both, col(w))).cast("double"), F.lit(0.0))


def band(x: Column | str, width: float = 5.0, bands: int = 20) -> Column:
    """Number of the equal-width band, from 1 to ``bands``."""
    return F.least(F.lit(bands), F.greatest(F.lit(1), F.floor(col(x) / width) + 1)).cast("int")


def rank_strength(rank: Column | str, n: Column | str, single: float | None = 1.0) -> Column:
    """1 for the first of n, 0 for the last; ``single`` if there is only one."""
    one = F.lit(single).cast("double")
    return F.when(col(n) > 1, 1.0 - (col(rank) - 1).cast("double") / (col(n) - 1)).when(col(n) == 1, one)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Prefix and md5 of the parts joined by a bar; the same on every engine."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", *(col(p).cast("string") for p in parts))))


def record_id(*parts: Column | str) -> Column:
    """First 32 hex digits of the sha-256 over the parts joined by the unit separator; nulls count as empty."""
    filled = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *filled), 256), 1, 32)
