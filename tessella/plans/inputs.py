"""Views of the driver's tables that the queries share, for both engines, and SQL for the common column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import HALF
from ..sources.tables import table

#: 2024-01-31 00:00:00 UTC: the time that queries take as now.
NOW = 1_706_659_200_000

EVENTS = "ev as (select event_id, user_id, event_type, value, cast(floor(epoch_us(ts) / 1000) as bigint) as at_ms, ts, cast(json_extract_string(props, '$.k') as bigint) as k from events)"
LINES = """scored as (
    select *, least(100.0, l_quantity * 2) as score, l_tax * 1000 - 40 as timing_ms, abs(l_tax * 1000 - 40) as abs_timing_ms, l_linestatus = 'F' as fallback,
           l_discount >= 0.09 as negative, case when l_returnflag <> 'N' then l_discount < 0.05 end as cache_hit,
           case when l_extendedprice > 20000 then l_extendedprice / 1000 end as render_ms,
           case when l_quantity * 2 >= 90 then 'A' when l_quantity * 2 >= 78 then 'B' when l_quantity * 2 >= 65 then 'C' when l_quantity * 2 >= 50 then 'D' else 'F' end as grade
    from lineitem)"""


def r(x: str, digits: int = 3) -> str:
    """Half towards plus infinity."""
    scale = f"{10**digits}.0"
    return f"floor(({x}) * {scale} + {HALF}) / {scale}"


def c01(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", at.alias("at_ms"), "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "score": F.least(F.lit(100.0), F.col("l_quantity") * 2),
            "timing_ms": F.col("l_tax") * 1000 - 40,
            "fallback": F.col("l_linestatus") == "F",
            "negative": F.col("l_discount") >= 0.09,
            "cache_hit": F.when(F.col("l_returnflag") != "N", F.col("l_discount") < 0.05),
            "render_ms": F.when(F.col("l_extendedprice") > 20000, F.col("l_extendedprice") / 1000),
        }
    )


STATS = f"""count(*) as n, {r('avg(score)', 1)} as avg_score, {r('min(score)', 1)} as min_score, {r('max(score)', 1)} as max_score,
    count(*) filter (where grade = 'A') as grade_a, count(*) filter (where grade = 'B') as grade_b, count(*) filter (where grade = 'C') as grade_c,
    count(*) filter (where grade = 'D') as grade_d, count(*) filter (where grade = 'F') as grade_f, {r('avg(timing_ms)', 1)} as avg_timing_ms,
    {r('quantile_disc(abs_timing_ms, 0.5)', 1)} as p50_abs_timing_ms, {r('quantile_disc(abs_timing_ms, 0.95)', 1)} as p95_abs_timing_ms,
    {r('count(*) filter (where fallback) / count(*)')} as fallback_rate, {r('count(*) filter (where negative) / count(*)')} as negative_rate,
    case when count(cache_hit) > 0 then {r('count(*) filter (where cache_hit) / count(cache_hit)')} end as cache_hit_rate, {r('avg(render_ms)', 1)} as avg_render_ms"""
