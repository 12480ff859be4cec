"""Row-local column expressions (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def symbol_key(c) -> Column:
    """Trimmed upper-case symbol used as the join key everywhere."""
    return F.upper(F.trim(col(c).cast("string")))


#: The five predefined HTML entities and their characters.
HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_unescape(c) -> Column:
    out = col(c)
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def listing_symbol(c) -> Column:
    """Vendor-neutral ticker: entities decoded, share-class separators become dashes."""
    return F.translate(F.upper(F.trim(html_unescape(c))), "./", "--")


def number(c) -> Column:
    """Lenient numeric cast; text, NaN and infinities become null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a, b) -> Column:
    """``a / b`` with null instead of an error (ANSI mode) or infinity on a zero divisor."""
    return F.try_divide(col(a), col(b))


def change(a, b) -> Column:
    """Relative change from ``b`` to ``a``."""
    return ratio(a, b) - F.lit(1.0)


def texts(*cases: Column, sep: str = "; ", limit: int | None = None) -> Column:
    """Join the non-null strings of ``cases`` in order, keeping at most ``limit`` of them."""
    found = F.array_compact(F.array(*cases))
    if limit is not None:
        found = F.slice(found, 1, limit)
    return F.array_join(found, sep)


def percent(c, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c) * 100.0)


def fixed(c, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", col(c))


def zero_padded(c, width: int = 3) -> Column:
    return F.format_string(f"%0{width}d", col(c).cast("long"))


def label(mapping: dict[str, str], c, default: Column | None = None) -> Column:
    """Code-to-name lookup for a small literal table; unknown codes pass through."""
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    key = col(c)
    return F.coalesce(F.create_map(*pairs)[key], key if default is None else default)


def row_median(columns) -> Column:
    """Median across columns of one row, nulls skipped."""
    values = F.array_sort(F.array_compact(F.array(*[col(c) for c in columns])))
    n = F.size(values)
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def finite_json(c, schema: str) -> Column:
    """``from_json`` that tolerates bare NaN/Infinity tokens by reading them as null numbers."""
    cleaned = F.regexp_replace(col(c), r"(?<=[:\[,\s])-?(NaN|Infinity)(?=\s*[,}\]])", "null")
    return F.from_json(cleaned, schema)


def cell(c) -> Column:
    """Typed view of a CSV cell: number, boolean or text."""
    text = F.nullif(F.trim(col(c)), F.lit(""))
    return F.struct(
        text.try_cast("double").alias("number"),
        F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true").alias("flag"),
        text.alias("text"),
    )


def session_mode(ts, *, reconcile_until: str = "08:30", monitor_until: str = "15:45") -> Column:
    """Tag a local timestamp with the part of the trading day a run belongs to."""
    clock = F.date_format(col(ts), "HH:mm")
    return (
        F.when(clock < reconcile_until, "reconcile")
        .when(clock < monitor_until, "intraday-monitor")
        .otherwise("after-close")
    )


def short_id(length: int = 12) -> Column:
    return F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, length)
