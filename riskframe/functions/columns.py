"""Scalar column functions shared by the operators (FN group)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Python ``str.strip()`` removes.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " + "".join(
    map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

SEVERITIES = ("HIGH", "MEDIUM", "LOW")

# Sentences of an order document.
DELAY_SENTENCE = "Shipment took {} days vs {} scheduled ({}{} days)."
LATE_SENTENCE = "This order was flagged with late-delivery risk."
NOT_LATE_SENTENCE = "No late-delivery risk was flagged."
PROFIT_SENTENCE = "Order generated profit of {} (ratio {}); sales {}, discount {}."


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def as_text(c: Column | str, default: str = "unknown") -> Column:
    """Trimmed text; null and blank become ``default``."""
    return F.coalesce(F.nullif(strip(col(c).cast("string")), F.lit("")), F.lit(default))


def to_numeric_or_null(c: Column | str) -> Column:
    """Numeric value; anything unparsable, and NaN, becomes null."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def as_double(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(to_numeric_or_null(c), F.lit(float(default)))


def as_int(c: Column | str, default: int = 0) -> Column:
    """Whole part of a number (truncated toward zero); bad input gives ``default``."""
    return F.coalesce(to_numeric_or_null(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def doc_id(prefix: str, *parts: Column) -> Column:
    """The md5 of ``prefix::part::part`` in hex: all 128 bits, so ids stay distinct for any number of rows."""
    return F.md5(F.concat_ws("::", F.lit(prefix), *[p.cast("string") for p in parts]))


def fixed(c: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals.

    Exact decimal ties round away from zero, so the last digit can differ from
    a half-even formatter on values such as 0.125. Decimals are rendered in
    generated code; only what no decimal can hold goes through a formatter.
    """
    d = c.try_cast(f"decimal(38,{digits})")
    sign = F.when((c < 0) & (d == 0), "-").otherwise("")
    return F.coalesce(F.concat(sign, d.cast("string")), F.format_string(f"%.{digits}f", c))


def fill(template: str, *args: Column) -> Column:
    """``template`` with each ``{}`` replaced by the next column."""
    parts: list[Column] = []
    for i, piece in enumerate(template.split("{}")):
        if piece:
            parts.append(F.lit(piece))
        if i < len(args):
            parts.append(args[i].cast("string"))
    return F.concat(*parts)


def order_severity(late: Column, profit: Column, delivery_status: Column) -> Column:
    """HIGH / MEDIUM / LOW of one order line."""
    status = F.lower(delivery_status)
    high = (late == 1) | status.contains("cancel") | status.contains("suspect") | (profit < -50)
    medium = status.contains("late") | (profit < 0)
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def sku_severity(defect: Column, inspection: Column, stock: Column, lead: Column) -> Column:
    """HIGH / MEDIUM / LOW of one SKU."""
    high = (defect > 3) | (F.lower(inspection) == "fail")
    medium = (defect > 1) | (stock < 20) | (lead > 25)
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def delay_days(real: Column, scheduled: Column) -> Column:
    return real - scheduled


def delay_phrase(real: Column, scheduled: Column) -> Column:
    delay = delay_days(real, scheduled)
    sign = F.when(delay > 0, "+").otherwise("")
    return fill(DELAY_SENTENCE, real, scheduled, sign, delay)


def late_phrase(late: Column) -> Column:
    return F.when(late == 1, LATE_SENTENCE).otherwise(NOT_LATE_SENTENCE)


def profit_phrase(profit: Column, ratio: Column, sales: Column, discount: Column) -> Column:
    return fill(PROFIT_SENTENCE, *[fixed(c, 2) for c in (profit, ratio, sales, discount)])


def day_gap(real: Column | str, scheduled: Column | str) -> Column:
    """Real minus scheduled days; null where either is missing or unparsable."""
    return to_numeric_or_null(real) - to_numeric_or_null(scheduled)


def normalise_severity(c: Column | str) -> Column:
    upper = F.upper(col(c))
    return F.when(upper.isin(*SEVERITIES), upper).otherwise("LOW")


def severity_rank(c: Column | str) -> Column:
    """3 for HIGH, 2 for MEDIUM, 1 for LOW, 0 otherwise."""
    c = col(c)
    return F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")
