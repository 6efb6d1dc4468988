"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later expressions read as values: as plain columns they would be put into each of them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for it, within one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or ``default`` where b is 0 or null."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if default is None else F.coalesce(r, F.lit(default))


def ladder(value: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """The label of the first step that ``value`` reaches; steps in falling order of their floor."""
    out = F.when(value >= steps[0][0], F.lit(steps[0][1]))
    for floor, label in steps[1:]:
        out = out.when(value >= floor, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def log_share(value: Column, full: float) -> Column:
    """ln(1 + value) / ln(full), at most 1."""
    return F.least(F.log1p(value.cast("double")) / F.log(F.lit(float(full))), F.lit(1.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def age_days(us: Column, now: Column) -> Column:
    """Whole days between two times in microseconds."""
    return F.floor((now - us) / DAY_US)


def age_decay(days: Column) -> Column:
    """Weight of an attestation by its age in whole days: a half beyond 90 days, a quarter beyond 180."""
    return F.when(days > 180, 0.25).when(days > 90, 0.5).otherwise(1.0)


def like_escape(text: str) -> str:
    """A literal for LIKE patterns: backslash, percent and underscore lose their meaning."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def visible(tier: Column, is_self: Column, viewer_verified: bool, followed: Column) -> Column:
    """Public, one's own, verified to verified viewers, or private and followed."""
    seen = (tier == "public") | is_self | ((tier == "private") & followed)
    return seen | (tier == "verified") if viewer_verified else seen


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum of a digit string of 13 to 19 digits."""
    chars = F.reverse(F.split(digits, ""))
    chars = F.filter(chars, lambda c: c != "")
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def redact(secret: Column) -> Column:
    """First and last four characters of a secret; all of a short one is hidden."""
    return F.when(F.length(secret) <= 8, F.lit("****")).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(4))))
