"""Column functions: cleaning, tokens, years, scales and colours, all as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Words that carry no topic in titles and abstracts.
STOPWORDS = (
    "about above across after again against also among analysis and are article based been between both but can case "
    "data development during each effect evidence findings for from had has have how into its may more not our paper "
    "research result results show study such than that the their these this through using was were which while with"
).split()
# Two-colour scales (low, high) and the root size classes.
BROWNS = ("#C4AE97", "#441A03")
LEAF_GREENS = ("#7D932D", "#BECC2D")
FRUIT_REDS = ("#E9A195", "#A32314")
DORMANT_BROWNS = ("#5B3A24", "#8A5F3E")
ACTIVE_GREENS = ("#244F1C", "#D7F22A")
ROOT_SIZES = (14.0, 18.0, 22.0, 26.0, 30.0)


def trim_ws(c: Column) -> Column:
    """Strip white space of every kind, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(trim_ws(c.cast("string")) != "", c)


def semicolon_parts(c: Column) -> Column:
    """Trimmed, non-empty parts of a semicolon list; an empty array for a missing one."""
    return F.coalesce(F.filter(F.transform(F.split(c, ";"), trim_ws), lambda x: x != ""), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Runs of two or more ASCII letters, lower-cased, longer than two and not a stop word."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z]+"), 0)
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def number(c: Column) -> Column:
    """A number, or null where the value is none."""
    return c.cast("string").try_cast("double")


def year_in_word(c: Column) -> Column:
    """The first year that stands as a word of its own."""
    return F.regexp_extract(c, r"\b(?:19|20)\d{2}\b", 0).try_cast("int")


def year_in_digits(c: Column) -> Column:
    """The first year that no other digit touches."""
    return F.regexp_extract(c, r"(?<!\d)(19\d{2}|20\d{2})(?!\d)", 1).try_cast("int")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.lower(text).contains(p)
    return out


def close(a: Column, b: Column) -> Column:
    """Equal within a billionth of the larger value."""
    return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))


def _between(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNull(), None).when(close(low, high), F.lit(1.0)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def minmax(value: Column, over: WindowSpec | None = None) -> Column:
    """Scale to 0..1 over a window; a constant becomes 1. Without a window all rows meet in one task: for role tables only."""
    over = W.partitionBy() if over is None else over
    return _between(value, F.min(value).over(over), F.max(value).over(over))


def scaled(df: DataFrame, **values: Column) -> DataFrame:
    """Adds each value scaled to 0..1 over all rows; a constant becomes 1.

    The bounds are aggregated where the rows are and sent back as one row, so no row moves.
    """
    held = df.withColumns({f"_value_{k}": v for k, v in values.items()})
    bounds = held.agg(*(f(f"_value_{k}").alias(f"_{n}_{k}") for k in values for n, f in (("low", F.min), ("high", F.max))))
    out = held.crossJoin(F.broadcast(bounds))  # one row
    out = out.withColumns({k: _between(F.col(f"_value_{k}"), F.col(f"_low_{k}"), F.col(f"_high_{k}")) for k in values})
    return out.drop(*(f"_{n}_{k}" for k in values for n in ("value", "low", "high")))


def age(year: Column, current_year: int) -> Column:
    """Years since publication, counting both ends, at least 1; a missing year counts as the current one."""
    return F.greatest(F.lit(current_year) - F.coalesce(year, F.lit(current_year)) + 1, F.lit(1))


def mixed_color(score: Column, scale: tuple[str, str]) -> Column:
    """Linear interpolation between two hex colours, each channel rounded half to even."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    parts = []
    for i in (1, 3, 5):
        low, high = int(scale[0][i : i + 2], 16), int(scale[1][i : i + 2], 16)
        parts.append(F.lpad(F.hex(F.rint(F.lit(float(low)) + F.lit(float(high - low)) * clamped).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), *parts)


def size_level(score: Column) -> Column:
    """1 plus how many of 0.2, 0.4, 0.6 and 0.8 the score exceeds."""
    return sum(((score > edge).cast("int") for edge in (0.2, 0.4, 0.6, 0.8)), F.lit(1))


def short_label(node: Column) -> Column:
    """The first two comma parts of a node id."""
    parts = F.transform(F.split(node, ","), trim_ws)
    return F.when(F.size(parts) >= 2, F.concat_ws(", ", F.slice(parts, 1, 2))).otherwise(node)


def joined(rows: Column, sep: str = "; ") -> Column:
    """The values of sorted (order..., value) structs, joined; the value is the field named ``v``."""
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["v"].cast("string")), sep)


def weights(*values: float) -> list[float]:
    """Weights scaled to a sum of 1."""
    total = sum(values)
    if total <= 0:
        raise ValueError("at least one weight must be positive")
    return [v / total for v in values]
