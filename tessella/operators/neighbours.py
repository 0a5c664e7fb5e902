"""The best partners of each item by a score that falls with a distance, without looking at all pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import half_up
from ..sources.tables import stored
from .prefixes import running_sum

#: Neighbours on either side that are looked at first, and by what their number grows where they don't settle it.
NEAR, GROWS = 8, 4


def best_partners(items: DataFrame, item: str, value: str, group: str, score: Callable[[Column, Column], Column], top: int, near: int = NEAR) -> DataFrame:
    """(item, other, edge, nth): for each item the top others by score(distance, same), to three digits, the smaller one first
    among equals. The score may not rise with the distance of the values, and same (whether the groups agree) not lower it.

    Items are sorted by value once, all of them and within their groups, and numbered; each asks for the numbers next to its
    own. What it has not seen lies further off than what it has, in its group and outside, which bounds the score; only items
    whose top could still change by that bound look further, four times as far each time. So rows met grow with the items
    and with how many tie, not with their square."""
    narrow = items.select(item, value, group)
    placed = running_sum(narrow, [], [F.col(value), F.col(item)], F.lit(1).cast("long"), "at")
    placed = stored(running_sum(placed, [group], [F.col(value), F.col(item)], F.lit(1).cast("long"), "own"), "placed")
    others = placed.select(F.col(item).alias("other"), F.col(value).alias("_value"), F.col(group).alias("_group"), F.col("at").alias("_at"), F.col("own").alias("_own"))
    open_, done = placed, []
    apart, same = F.abs(F.col(value) - F.col("_value")), F.col(group).eqNullSafe(F.col("_group"))
    while True:
        asked = open_.withColumn("o", F.explode(F.array(*(F.lit(o).cast("long") for o in range(-near, near + 1) if o))))
        along = asked.join(others, F.col("at") + F.col("o") == F.col("_at")).withColumn("kin", F.lit(False))
        kin = asked.join(others, (F.col(group) == F.col("_group")) & (F.col("own") + F.col("o") == F.col("_own"))).withColumn("kin", F.lit(True))
        met = stored(along.unionByName(kin).select(item, "other", "o", "kin", apart.alias("apart"), half_up(score(apart, same)).alias("edge")), "met")
        by = Window.partitionBy(item).orderBy(F.desc("edge"), "other")
        best = met.select(item, "other", "edge").distinct().withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= top)
        # how far the nearest item that wasn't seen lies at least: null where a list has come to both its ends
        side = lambda k, left: F.when(F.count_if((F.col("kin") == k) & ((F.col("o") < 0) == left)) == near, F.max(F.when((F.col("kin") == k) & ((F.col("o") < 0) == left), F.col("apart"))))
        unseen = met.groupBy(item).agg(F.least(side(False, True), side(False, False)).alias("further"), F.least(side(True, True), side(True, False)).alias("kin_further"))
        least = best.groupBy(item).agg(F.min("edge").alias("least"), F.count(F.lit(1)).alias("n"))
        bound = lambda d, k: F.col(d).isNull() | F.coalesce((F.col("n") >= top) & (F.col("least") > half_up(score(F.col(d), F.lit(k)))), F.lit(False))
        settled = unseen.join(least, item).select(item, (bound("further", False) & bound("kin_further", True)).alias("settled"))
        settled = stored(settled, "settled")
        done.append(best.join(settled.where("settled").select(item), item, "left_semi"))
        open_ = open_.join(settled.where("not settled").select(item), item, "left_semi")
        if not settled.where("not settled").limit(1).count():
            return reduce(DataFrame.union, done)
        near *= GROWS
