"""Style arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.css import EM


def em_length(number: Column, unit: Column, percent: float | None = None) -> Column:
    """A length in ems; percentages of a measure of 30 ems where percent is 0.3; null for other units."""
    factor = F.create_map(*(F.lit(x) for pair in EM.items() for x in (pair[0], float(pair[1]))))
    known = F.try_element_at(factor, F.lower(unit))
    return F.when(unit == "%", number * F.lit(percent).cast("double")).when((unit == "") & (number == 0), 0.0).otherwise(number * known)


def clamped(value: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def relative_weight(parent: Column, kind: Column) -> Column:
    """What bolder and lighter make of a weight."""
    bolder = F.when(parent < 350, 400.0).when(parent < 550, 700.0).otherwise(F.greatest(F.lit(900.0), parent))
    lighter = F.when(parent < 100, parent).when(parent < 550, 100.0).when(parent < 750, 400.0).otherwise(700.0)
    return F.when(kind == "bolder", bolder).when(kind == "lighter", lighter).otherwise(parent)


def text_align(align: Column, direction: Column) -> Column:
    """left and right as start and end of the reading direction."""
    side = F.when((align == "left") == (direction == "ltr"), "start").otherwise("end")
    return F.when(align.isin("left", "right"), side).otherwise(align)


def font_size_step(ratio: Column) -> Column:
    return F.when(ratio < 0.95, "smaller").when(ratio > 1.05, "larger").otherwise("same")


def is_bold(weight: Column) -> Column:
    return weight >= 600


def specificity(counts: Column) -> Column:
    """Counts of ids, classes and tags of each compound, summed up to 1023 each and packed."""
    total = lambda k: F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: F.least(acc + c[k], F.lit(1023).cast("bigint")))
    return F.shiftleft(total("a"), 20).bitwiseOR(F.shiftleft(total("b"), 10)).bitwiseOR(total("c"))
