"""Running values over a whole table in an order, in two levels.

Rows are dealt to ranges of the order and sorted; a range is a task's. Each range
is summed up, the sums (a row for each range) run over all ranges, and within a
range rows run on from there. So no task sees more than a range and one row for
each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

START = {"sum": 0, "max": None}


def running(rows: DataFrame, order: list[str | Column], **values: tuple[str, str | Column]) -> DataFrame:
    """rows with a column for each value, (``sum`` or ``max``, of what): over all
    rows up to this one. Rows that tie in ``order`` run in any order."""
    named = {name: (how, F.expr(of) if isinstance(of, str) else of) for name, (how, of) in values.items()}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__range", F.shiftright("__at", 33))
    total = lambda how, c: F.sum(c) if how == "sum" else F.max(c)
    ranges = dealt.groupBy("__range").agg(*[total(how, of).alias(f"__{name}") for name, (how, of) in named.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select("__range", *[total(how, F.col(f"__{name}")).over(before).alias(f"__{name}") for name, (how, _) in named.items()])
    within = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(ranges), "__range")
    for name, (how, of) in named.items():
        here, there = total(how, of).over(within), F.col(f"__{name}")
        out = out.withColumn(name, here + F.coalesce(there, F.lit(0)) if how == "sum" else F.greatest(here, there))
    return out.drop("__at", "__range", *[f"__{name}" for name in named])
