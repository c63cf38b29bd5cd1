"""Column expressions shared by the operators; all of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<missing>"
#: Fixed value: the 97.5 % quantile of the normal distribution.
Z95 = 1.959963984540054

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: ColumnLike) -> Column:
    """Trimmed text of a group value; null and blank become the missing token."""
    return F.coalesce(F.nullif(F.trim(_col(c).cast("string")), F.lit("")), F.lit(MISSING))


def key_text(c: ColumnLike, kind: str = "string") -> Column:
    """Text of a key part; booleans are spelled True and False, null is the missing token."""
    c = _col(c)
    text = F.initcap(c.cast("string")) if kind == "boolean" else F.trim(c.cast("string"))
    return F.coalesce(text, F.lit(MISSING))


def surrogate_key(prefix: str, parts: Sequence[Column], length: int = 12) -> Column:
    """prefix_ and the first hex digits of the SHA-1 of the parts joined by two bars."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("||", *parts)), 1, length))


def numeric(c: ColumnLike) -> Column:
    """Double, or null for text that is no number, NaN and infinities."""
    x = _col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_divide(n: ColumnLike, d: ColumnLike) -> Column:
    """n / d where d is positive and the result finite, else null."""
    ratio = F.when(_col(d) > 0, F.try_divide(_col(n), _col(d)))
    return F.when(F.abs(ratio) != float("inf"), ratio)


def clip(c: ColumnLike, low: float, high: float) -> Column:
    """Bounded value; null stays null."""
    return F.when(_col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _col(c))))


def finite_clipped(c: ColumnLike, bound: float = 8.0) -> Column:
    """Value within +-bound; null, NaN and infinities become 0."""
    return F.coalesce(clip(numeric(c), -bound, bound), F.lit(0.0))


def to_bool(c: ColumnLike) -> Column:
    """True for true, 1, yes and y in any case; false for everything else, null included."""
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def holds(condition: Column) -> Column:
    """A predicate for which unknown means false."""
    return F.coalesce(condition, F.lit(False))


def time_of_day(hour: ColumnLike) -> Column:
    """night, morning, afternoon or evening by quarters of the day; anything else is missing."""
    h = _col(hour)
    out = F.lit(MISSING)
    for low, name in ((18, "evening"), (12, "afternoon"), (6, "morning"), (0, "night")):
        out = F.when(h.between(low, low + 5), name).otherwise(out)
    return out


def cut(c: ColumnLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: labels[i] where edges[i] < value <= edges[i + 1], the lowest edge included; null outside."""
    c = _col(c)
    out = F.lit(None).cast("string")
    for i in range(len(labels) - 1, -1, -1):
        low = c >= edges[0] if i == 0 else c > edges[i]
        out = F.when(low & (c <= edges[i + 1]), labels[i]).otherwise(out)
    return F.when(~F.isnan(c.cast("double")), out)


def item(prefix: str, c: ColumnLike) -> Column:
    """family=value token of a transaction; spaces, semicolons and commas become _, and null, blank or nan gives null."""
    text = F.trim(_col(c).cast("string"))
    family = prefix.removesuffix("_bin")
    return F.when((text != "") & (F.lower(text) != "nan"), F.concat(F.lit(family + "="), F.translate(text, " ;,", "___")))


def family_of(token: ColumnLike) -> Column:
    return F.substring_index(_col(token), "=", 1)


def value_of(token: ColumnLike) -> Column:
    c = _col(token)
    return F.when(F.instr(c, "=") > 0, F.regexp_replace(c, "^[^=]*=", ""))


def safe_token(c: ColumnLike) -> Column:
    """Lower-case token of letters, digits and single underscores; 'missing' if nothing is left."""
    text = F.regexp_replace(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))), r"[\s/\\:;,|()\[\]]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", ""), F.lit("")), F.lit("missing"))


def node_id(view: str, kind: str, value: ColumnLike) -> Column:
    """view:type:token:digest of a graph node."""
    text = F.coalesce(_col(value).cast("string"), F.lit(MISSING))
    return F.concat_ws(":", F.lit(view), F.lit(kind), F.substring(safe_token(text), 1, 70), F.substring(F.sha1(text), 1, 12))


def edge_id(view: str, kind: str, *values: ColumnLike) -> Column:
    """edge_ and a digest of view, type and end points."""
    return F.concat(F.lit("edge_"), F.substring(F.sha1(F.concat_ws("||", F.lit(view), F.lit(kind), *[_col(v).cast("string") for v in values])), 1, 18))


def wilson(k: ColumnLike, n: ColumnLike, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval; (0, 0) without trials."""
    k, n = _col(k).cast("double"), _col(n).cast("double")
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), centre + half)).otherwise(0.0)


def technology(mode: ColumnLike) -> Column:
    """Generation of a radio mode; where several names occur, the oldest generation counts."""
    m = F.upper(_col(mode).cast("string"))
    out = F.lit("unknown")
    for pattern, name in (("5G", "5g"), ("LTE", "lte"), ("HSPA|UMTS|WCDMA", "3g"), ("GSM|EDGE|GPRS", "2g")):
        out = F.when(holds(m.rlike(pattern)), name).otherwise(out)
    return out


def parse_timestamp(c: ColumnLike, formats: Sequence[str] = ("yyyy.MM.dd_HH.mm.ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")) -> Column:
    """First format that fits, then Spark's own reading, else null."""
    text = _col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], F.try_to_timestamp(text))


def label_case(c: ColumnLike, names: dict[str, str] | None = None) -> Column:
    """Display text: a given name, or the value with spaces and capitals."""
    value = _col(c).cast("string")
    out = F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))
    for key, name in (names or {}).items():
        out = F.when(value == key, name).otherwise(out)
    return out


def strip_prefixes(c: ColumnLike, prefixes: dict[str, str]) -> Column:
    """Compact label: the first matching prefix is replaced, underscores become spaces."""
    value = _col(c).cast("string")
    out = value
    for prefix, name in reversed(prefixes.items()):
        out = F.when(value.startswith(prefix), F.concat(F.lit(name), F.substring(value, len(prefix) + 1, 1 << 30))).otherwise(out)
    return F.replace(out, F.lit("_"), F.lit(" "))


def median_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, or null where b is null or 0."""
    return F.when(_col(b) != 0, _col(a) / _col(b))
