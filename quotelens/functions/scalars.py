"""Numeric helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rnd(col: Column, digits: int = 2) -> Column:
    """Round on the binary value: 2.675 stays below its tie and gives 2.67."""
    scale = F.lit(float(10**digits))
    return F.floor(col * scale + F.lit(0.5)) / scale


def exact_sum(col: Column, digits: int = 2) -> Column:
    """Sum that does not depend on the order in which partitions arrive."""
    return F.sum(col.cast(f"decimal(28,{digits})")).cast("double")


def or_default(col: Column, default) -> Column:
    """Null and zero both count as missing."""
    return F.coalesce(F.nullif(col, F.lit(0).cast("double")), F.lit(default).cast("double"))


def once(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated and written into the plan once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_number(col: Column) -> Column:
    """US ``12,892.91`` and European ``12.892,91``; null where it is no number."""
    def plain(s):
        back = F.reverse(s)
        comma, dot = F.instr(back, ","), F.instr(back, ".")
        return (
            F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when((comma > 0) & (dot > 0), F.replace(s, F.lit(","), F.lit("")))
            .when((comma > 0) & s.rlike(r",\d{1,2}$"), F.replace(s, F.lit(","), F.lit(".")))
            .when(comma > 0, F.replace(s, F.lit(","), F.lit("")))
            .otherwise(s)
        )

    written = once(F.regexp_replace(F.trim(col), " ", ""), plain)
    return once(written, lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("double")))


def general_text(col: Column) -> Column:
    """Number as short text: 10 instead of 10.0, 7.2 as it is."""
    return F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(col.cast("string"))
