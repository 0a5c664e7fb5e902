"""Sequences, joins, folds and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, half_up
from ..operators import folds, graph, joins, ledger, ranking, sequences, sets
from ..sources.tables import table
from .inputs import EVENTS, NOW, c01, events, r
from .registry import query

DAY = 86_400_000

_DAILY = f"{EVENTS}, daily as (select event_type, cast(floor(at_ms / {DAY}) as bigint) as day, sum(value) / 1000 as v from ev group by 1, 2)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", F.floor(F.col("at_ms") / DAY).alias("day")).agg((F.sum("value") / 1000).alias("v"))


@query(
    "trend_velocity",
    f"""with {_DAILY}, d as (select *, v - lag(v) over (partition by event_type order by day) as d from daily), dd as (select *, d - lag(d) over (partition by event_type order by day) as dd from d),
    g as (select event_type, count(*) as n, coalesce(avg(d), 0.0) as ve, coalesce(avg(dd), 0.0) as ac from dd group by 1)
    select event_type, n, {r('ve')} as velocity, {r('ac')} as acceleration, case when ve > 0.15 then 'rising' when ve < -0.15 then 'falling' else 'stable' end as direction,
           {r(f"case when n < 2 then 0.15 else {c01('0.25 + n * 0.12')} end")} as confidence from g""",
)
def trend_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.trend(_daily(spark, sf_dir), "event_type", "day", "v")


@query(
    "strategy_fatigue",
    f"""with {EVENTS}, l as (select *, row_number() over (partition by user_id order by event_id desc) as nth from ev), e as (select *, count(*) over (partition by user_id) as size from l where nth <= 8),
    p as (select *, size - nth + 1 as pos from e), f as (select *, arg_max(event_type, pos) over (partition by user_id) as final from p),
    s as (select *, size - coalesce(max(case when event_type <> final then pos end) over (partition by user_id), 0) as streak from f),
    g as (select user_id, event_type, count(*) as recent, sum(pos * 1.0 / size) as w, max(case when event_type = final then streak else 0 end) as cons from s group by 1, 2)
    select user_id, event_type, recent, cast(cons as bigint) as consecutive, {r('w / 2.6 + greatest(0, cons - 1) * 0.22')} as fatigue, {r(f"{r('w / 2.6 + greatest(0, cons - 1) * 0.22')} * 0.35")} as penalty from g""",
)
def strategy_fatigue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.strategy_fatigue(events(spark, sf_dir), "user_id", ["event_id"], "event_type").withColumn("consecutive", F.col("consecutive").cast("long"))


@query(
    "repetition",
    f"""with {EVENTS}, l as (select *, row_number() over (partition by user_id order by event_id desc) as nth from ev), c as (select user_id, event_type, count(*) as c from l where nth <= 8 group by 1, 2), g as (select user_id, max(c) as top, sum(c) as n from c group by 1)
    select user_id, {r('case when n > 1 then (top - 1) * 1.0 / (n - 1) else 0.0 end')} as repetition from g""",
)
def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.repetition(events(spark, sf_dir), "user_id", ["event_id"], "event_type")


@query(
    "runs_of_type",
    f"""with {EVENTS}, e as (select *, case when lag(event_type) over (partition by user_id order by event_id) = event_type then 0 else 1 end as edge from ev),
    n as (select *, sum(edge) over (partition by user_id order by event_id rows unbounded preceding) as run from e)
    select user_id, cast(run as bigint) as run, event_type, min(event_id) as first, count(*) as n, {r('avg(value)', 2)} as mean from n group by 1, 2, 3""",
)
def runs_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(events(spark, sf_dir), ["user_id"], ["event_id"], "event_type", "value")


_CURVE = f"{EVENTS}, curve as (select user_id, event_id, {c01('value / 100')} as v from ev)"


@query(
    "section_labels",
    f"""with {_CURVE}, l as (select *, case when v < 0.4 then 'low' when v > 0.72 then 'high' else 'mid' end as level from curve), e as (select *, case when lag(level) over (partition by user_id order by event_id) = level then 0 else 1 end as edge from l),
    n as (select *, sum(edge) over (partition by user_id order by event_id rows unbounded preceding) as run from e), g as (select user_id, cast(run as bigint) as run, level, min(event_id) as first, count(*) as n, {r('avg(v)', 2)} as mean from n group by 1, 2, 3),
    k as (select *, count(*) over (partition by user_id) as alls from g), m as (select *, lag(level) over (partition by user_id order by run) as bef, lead(level) over (partition by user_id order by run) as aft from k where n >= 3 or alls <= 2)
    select user_id, run, case when level = 'low' and bef is null then 'intro' when level = 'low' and aft is null then 'outro' when level = 'low' and bef = 'high' then 'break' when level = 'mid' and aft = 'high' then 'build' when level = 'high' then 'drop' else 'body' end as kind,
           first, n, mean from m""",
)
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", clamp(F.col("value") / 100).alias("v"))
    return sequences.sections(rows, "user_id", "event_id", "v", 3)


@query(
    "onset_rows",
    f"""with {_CURVE}, w as (select *, lag(v) over (partition by user_id order by event_id) as b, lead(v) over (partition by user_id order by event_id) as a from curve)
    select user_id, event_id, {r('v')} as level from w where v - b > 0.12 and v >= a and v > 0.2""",
)
def onset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", clamp(F.col("value") / 100).alias("v"))
    return sequences.onsets(rows, "user_id", "event_id", "v").select("user_id", "event_id", half_up("v").alias("level"))


@query("endpoint_drift", f"with {EVENTS} select user_id, count(*) as n, {r('case when count(*) > 1 then (arg_max(value, event_id) - arg_min(value, event_id)) / (count(*) - 1) else 0.0 end')} as slope from ev group by 1")
def endpoint_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.endpoint_drift(events(spark, sf_dir), "user_id", "event_id", "value")


@query(
    "energy_pattern",
    f"""with {_CURVE}, d as (select *, abs(v - lag(v) over (partition by user_id order by event_id)) as d from curve), g as (select user_id, arg_min(v, event_id) as a, arg_max(v, event_id) as z, max(v) as top, avg(d) as d from d group by 1)
    select user_id, case when top > greatest(a, z) + 0.1 then 'arc' when z > a + 0.1 then 'rise' when z < a - 0.1 then 'fall' else 'stable' end as pattern, {r('coalesce(d, 0.0)')} as mean_step from g""",
)
def energy_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", clamp(F.col("value") / 100).alias("v"))
    return sequences.energy_pattern(rows, "user_id", "event_id", "v", 0.1)


@query("phase_ends", f"with {EVENTS} select user_id, at_ms, lead(at_ms) over (partition by user_id order by at_ms) as ended from ev where event_type = 'signup'")
def phase_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.phases(events(spark, sf_dir).where("event_type = 'signup'").select("user_id", "at_ms"), "user_id", "at_ms")


@query("trailing_week", f"with {EVENTS} select event_id, count(*) over (partition by user_id order by at_ms range between {7 * DAY} preceding and current row) as recent from ev")
def trailing_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.trailing_count(events(spark, sf_dir), "user_id", "at_ms", 7 * DAY).select("event_id", "recent")


_SPANS = f"{EVENTS}, spans as (select event_id, user_id, at_ms / 1000.0 as s, at_ms / 1000.0 + value * 600 as e, {c01('value / 100')} as density from ev)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("at_ms") / 1000.0
    return events(spark, sf_dir).select("event_id", "user_id", s.alias("start"), (s + F.col("value") * 600).alias("end"), clamp(F.col("value") / 100).alias("density"))


@query(
    "coverage_gaps",
    f"""with {_SPANS}, w as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from spans)
    select user_id, {r('reach')} as gap_start, {r('s')} as gap_end from w where s - reach >= 36000""",
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.gaps(_spans(spark, sf_dir), "user_id", "start", "end", 36000)
    return found.select("user_id", half_up("gap_start").alias("gap_start"), half_up("gap_end").alias("gap_end"))


@query(
    "session_islands",
    f"""with {EVENTS}, e as (select *, case when at_ms - lag(at_ms) over (partition by user_id order by at_ms) <= 21600000 then 0 else 1 end as new from ev), n as (select *, sum(new) over (partition by user_id order by at_ms) as session from e)
    select user_id, cast(session as bigint) as session, min(at_ms) as started, max(at_ms) as ended, count(*) as n, {r('sum(value)')} as total from n group by 1, 2""",
)
def session_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sessions(events(spark, sf_dir), "user_id", "at_ms", 21_600_000, F.col("value"))


@query(
    "asof_last_signup",
    f"""with {EVENTS}, l as (select event_id, user_id, at_ms from ev where event_type = 'purchase'), x as (select user_id, at_ms, value as level from ev where event_type = 'signup')
    select l.event_id, l.user_id, l.at_ms, x.level from l asof left join x on l.user_id = x.user_id and l.at_ms >= x.at_ms""",
)
def asof_last_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    right = ev.where("event_type = 'signup'").select("user_id", "at_ms", F.col("value").alias("level"))
    return joins.asof_join(ev.where("event_type = 'purchase'").select("event_id", "user_id", "at_ms"), right, ["user_id"], "at_ms", ["level"])


@query(
    "interval_overlap",
    f"""with {_SPANS}, w as (select event_id as w_id, user_id, s as ws, s + 43200 as we from spans)
    select w_id, event_id, {r('least(e, we) - greatest(s, ws)')} as overlap from w join spans on w.user_id = spans.user_id and s < we and e > ws""",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    windows = spans.select(F.col("event_id").alias("w_id"), "user_id", F.col("start").alias("w_start"), (F.col("start") + 43200).alias("w_end"))
    return joins.interval_overlap(spans, windows, "user_id", 86400.0).select("w_id", "event_id", half_up("overlap").alias("overlap"))


@query(
    "window_activity",
    f"""with {_SPANS}, w as (select event_id as w_id, user_id, s as ws, s + 43200 as we from spans),
    m as (select w_id, sum(least(e, we) - greatest(s, ws)) as c, sum(density * (least(e, we) - greatest(s, ws))) as d, max(density) as p from w join spans on w.user_id = spans.user_id and s < we and e > ws group by 1)
    select w.w_id, {r('case when coalesce(c, 0.0) > 0 then d / c else 0.0 end')} as density, {r('coalesce(p, 0.0)')} as peak, {r(c01('coalesce(c, 0.0) / (we - ws)'))} as coverage from w left join m on w.w_id = m.w_id""",
)
def window_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    windows = spans.select(F.col("event_id").alias("w_id"), "user_id", F.col("start").alias("w_start"), (F.col("start") + 43200).alias("w_end"))
    return joins.window_activity(spans, windows, "user_id", "w_id", 86400.0)


@query(
    "band_semi_join",
    f"""with {EVENTS} select a.event_id from ev a join ev b on a.user_id = b.user_id and abs(a.value - b.value) <= 0.5 and b.event_type <> a.event_type where a.event_type = 'click' group by 1 having count(distinct b.event_type) >= 2""",
)
def band_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    left = ev.where("event_type = 'click'").select("event_id", "user_id", "value")
    return joins.band_semi_join(left, ev.where("event_type <> 'click'"), "user_id", "value", 0.5, 2, "event_type").select("event_id")


@query(
    "nearest_cue",
    """with c as (select event_type, list(distinct floor(value / 50) * 50.0) as cues from events group by 1)
    select event_id, floor(list_min(list_transform(cues, lambda x: abs(x - value))) * 1000.0 + 0.5000001) / 1000.0 as distance from events e join c on e.event_type = c.event_type""",
)
def nearest_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    cues = ev.groupBy("event_type").agg(F.collect_set(F.floor(F.col("value") / 50) * 50.0).alias("cues"))  # eleven values at most
    return ev.join(cues, "event_type").select("event_id", half_up(joins.nearest_distance(F.col("value"), F.col("cues"))).alias("distance"))


@query(
    "first_catalogue_match",
    """with s as (select a.s_suppkey as id, b.s_suppkey as other, (case when a.s_nationkey = b.s_nationkey then 0.4 else 0 end) + (case when abs(a.s_acctbal - b.s_acctbal) <= 500 then 0.35 else 0 end) as sc
               from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey),
    m as (select id, min(other) as match from s where sc >= 0.65 group by 1) select s_suppkey as id, match from supplier left join m on s_suppkey = id""",
)
def first_catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    a = s.select(F.col("s_suppkey").alias("id"), "s_nationkey", F.col("s_acctbal").alias("x"))
    b = s.select(F.col("s_suppkey").alias("match"), "s_nationkey", F.col("s_acctbal").alias("y"))
    score = F.when(F.col("id") == F.col("match"), 0.0).otherwise(0.4 + F.when(F.abs(F.col("x") - F.col("y")) <= 500, 0.35).otherwise(0.0))
    return joins.first_near_match(a, b, "id", ["s_nationkey"], ("x", "y", 500.0), score, 0.65, "match").select("id", "match")


@query(
    "rule_penalty",
    f"""with rules as (select 'brand' as type, 'Brand#' || x as target, 0.1 * x as weight, x = 3 as hard from (select unnest(range(1, 6)) as x) union all select 'type', 'ECONOMY', 0.3, false union all select 'size', '11', 0.5, true),
    m as (select p_partkey, weight, hard from part join rules on (type = 'brand' and target = p_brand) or (type = 'type' and target = p_type) or (type = 'size' and target = cast(p_size as varchar))),
    g as (select p_partkey, 1 - product(1 - weight) as p, bool_or(hard) as b from m group by 1)
    select part.p_partkey, {r('coalesce(p, 0.0)')} as penalty, coalesce(b, false) as blocked from part left join g on part.p_partkey = g.p_partkey""",
)
def rule_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("brand", f"Brand#{x}", 0.1 * x, x == 3) for x in range(1, 6)] + [("type", "ECONOMY", 0.3, False), ("size", "11", 0.5, True)]
    rule_rows = spark.createDataFrame(rules, "type string, target string, weight double, hard boolean")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return joins.rule_penalty(parts, rule_rows, "p_partkey", {"brand": "p_brand", "type": "p_type", "size": "p_size"}).select("p_partkey", "penalty", "blocked")


@query(
    "same_recording",
    """select distinct a.s_suppkey as a_id, b.c_custkey as b_id from supplier a join customer b on (a.s_nationkey = b.c_nationkey and floor(a.s_acctbal / 100) = floor(b.c_acctbal / 100)) or substr(a.s_name, 10) = substr(b.c_name, 10)""",
)
def same_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda n, x: F.concat_ws("/", F.col(n).cast("string"), F.floor(F.col(x) / 100).cast("string")).alias("cell")
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a_id"), cell("s_nationkey", "s_acctbal"), F.substring("s_name", 10, 99).alias("serial"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b_id"), cell("c_nationkey", "c_acctbal"), F.substring("c_name", 10, 99).alias("serial"))
    return joins.any_key_matches(a, b, "a_id", "b_id", ["cell", "serial"])


@query(
    "journey_interpolation",
    f"""with {EVENTS}, c as (select event_type, cast(floor(at_ms / {5 * DAY}) * {5 * DAY} as bigint) as t, avg(value) as v from ev group by 1, 2), e as (select *, lead(t) over (partition by event_type order by t) as t1, lead(v) over (partition by event_type order by t) as v1 from c)
    select event_id, {r(f'case when t1 is null then v else v + (v1 - v) * (at_ms - t) / (t1 - t) end')} as value from ev join e on ev.event_type = e.event_type and e.t = cast(floor(at_ms / {5 * DAY}) * {5 * DAY} as bigint)""",
)
def journey_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    points = ev.groupBy("event_type", (F.floor(F.col("at_ms") / (5 * DAY)) * (5 * DAY)).alias("at_ms")).agg(F.avg("value").alias("value"))
    return joins.interpolate(ev.select("event_id", "event_type", "at_ms"), points, "event_type", "at_ms", "value").select("event_id", "value")


_DELTA = f"{EVENTS}, d as (select user_id, event_id, case when event_type in ('purchase', 'click') then value / 1000 else -value / 2000 end as x, value from ev)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_type").isin("purchase", "click"), F.col("value") / 1000).otherwise(-F.col("value") / 2000)
    return events(spark, sf_dir).select("user_id", "event_id", x.alias("x"), "value", "event_type", "k")


@query(
    "saturating_affinity",
    f"""with {_DELTA} select user_id, {r('list_reduce(list_prepend(0.0, list(x order by event_id)), lambda a, x: least(greatest(a + x * (1 - abs(a)), -1.0), 1.0))', 6)} as score, count(*) as n from d group by 1""",
)
def saturating_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.saturating(_deltas(spark, sf_dir), "user_id", ["event_id"], "x")


@query("smoothed_level", f"with {EVENTS} select user_id, {r('list_reduce(list(value order by event_id), lambda a, x: a * 0.72 + x * 0.28)', 6)} as level from ev group by 1")
def smoothed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.smoothed(events(spark, sf_dir), "user_id", ["event_id"], "value", 0.28)


_LEVELS = ", ".join(f"'{v}': s.{v} * 0.72 + x.{v} * 0.28" for v in ("chill", "love", "energy", "party"))


@query(
    "mood_hysteresis",
    f"""with {EVENTS}, e as (select user_id, list({{'chill': case when event_type = 'view' then 1.0::double else 0.0::double end, 'love': case when event_type = 'click' then 1.0::double else 0.0::double end,
        'energy': case when event_type = 'purchase' then 1.0::double else 0.0::double end, 'party': case when event_type = 'signup' then 1.0::double else 0.0::double end, 'state': 'chill', 'n': 0::bigint}} order by event_id) as l from ev group by 1),
    f as (select user_id, list_reduce(l, lambda s, x: list_transform([{{{_LEVELS}}}], lambda v: list_transform([{{'now': case s.state when 'chill' then v.chill when 'love' then v.love when 'energy' then v.energy else v.party end, 'top': greatest(v.chill, v.love, v.energy, v.party),
        'lead': case when v.chill >= greatest(v.love, v.energy, v.party) then 'chill' when v.love >= greatest(v.energy, v.party) then 'love' when v.energy >= v.party then 'energy' else 'party' end}}],
        lambda b: {{'chill': v.chill, 'love': v.love, 'energy': v.energy, 'party': v.party, 'state': case when b.lead <> s.state and b.top - b.now >= 0.14 then b.lead else s.state end,
        'n': s.n + case when b.lead <> s.state and b.top - b.now >= 0.14 then 1::bigint else 0::bigint end}})[1])[1],
        {{'chill': 0.0::double, 'love': 0.0::double, 'energy': 0.0::double, 'party': 0.0::double, 'state': 'chill', 'n': 0::bigint}}) as s from e)
    select user_id, s.state as state, s.n as switches from f""",
)
def mood_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.when(F.col("event_type") == kind, 1.0).otherwise(0.0)
    rows = events(spark, sf_dir).select("user_id", "event_id", of("view").alias("chill"), of("click").alias("love"), of("purchase").alias("energy"), of("signup").alias("party"))
    return folds.hysteresis(rows, "user_id", ["event_id"], ["chill", "love", "energy", "party"], 0.28, 0.14)


@query(
    "discovery_budget",
    f"""with {EVENTS}, e as (select user_id, list({{'x': 0.0::double, 'run': case when event_type in ('purchase', 'signup') then 1::bigint else 0::bigint end, 'longest': 0::bigint}} order by event_id) as l from ev group by 1),
    f as (select user_id, list_reduce(l, lambda s, x: {{'x': case when x.run = 1 then greatest(s.x - 0.2::double, 0.0::double) else least(s.x + 0.08::double, 1.0::double) end, 'run': case when x.run = 1 then s.run + 1 else 0::bigint end, 'longest': greatest(s.longest, case when x.run = 1 then s.run + 1 else 0::bigint end)}},
        {{'x': 1.0::double, 'run': 0::bigint, 'longest': 0::bigint}}) as s from e)
    select user_id, {r('s.x', 6)} as "left", s.longest as longest from f""",
)
def discovery_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("spent", F.col("event_type").isin("purchase", "signup"))
    return folds.budget(rows, "user_id", ["event_id"], "spent", 1.0, 0.2, 0.08)


@query(
    "violation_debt",
    f"""with {EVENTS}, b as (select *, event_type <> 'error' as ok, count(*) filter (where event_type <> 'error') over (partition by user_id order by event_id) as grp from ev), g as (select user_id, grp, count(*) filter (where not ok) as n, max(event_id) as last from b group by 1, 2)
    select user_id, arg_max(n, grp) as open, max(n) as worst from g group by 1""",
)
def violation_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.violation_debt(events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error"), "user_id", ["event_id"], "ok")


@query(
    "change_points",
    f"""with {EVENTS}, e as (select user_id, list({{'n': 0::bigint, 'x': value::double}} order by event_id) as l from ev group by 1),
    f as (select user_id, list_reduce(l, lambda s, y: case when s.x is null or abs(y.x - s.x) >= greatest(20.0::double, abs(s.x) * 0.3) then {{'n': s.n + 1, 'x': y.x}} else s end, {{'n': 0::bigint, 'x': null::double}}) as s from e)
    select user_id, s.n as changes, {r('s.x', 6)} as last from f""",
)
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.change_points(events(spark, sf_dir), "user_id", ["event_id"], "value", 20.0, 0.3)


@query(
    "merge_operations",
    """with u as (select conv_id * 10 + turn % 4 as id, turn, role, 0 as side from conversations where role = 'user' union all select conv_id * 10 + turn % 4, turn, role, 1 from conversations where role <> 'user'),
    n as (select *, row_number() over (partition by id order by turn desc, side, role) as nth from u) select id, turn, role, side from n where nth = 1""",
)
def merge_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10 + F.col("turn") % 4).alias("id"), "turn", "role")
    a, b = c.where("role = 'user'").withColumn("side", F.lit(0)), c.where("role <> 'user'").withColumn("side", F.lit(1))
    return sets.merge_operations(a, b, "id", "turn", ["side", "role"])


_QUOTA = {"view": 40, "click": 30, "purchase": 30, "signup": 10}


@query(
    "merge_sources",
    f"""with {EVENTS}, g as (select k, event_type, sum(value) / 10000 as score from ev group by 1, 2), n as (select *, row_number() over (partition by event_type order by score desc, k) as nth, case event_type {" ".join(f"when '{s}' then {i}" for i, s in enumerate(_QUOTA))} end as place, case event_type {" ".join(f"when '{s}' then {m}" for s, m in _QUOTA.items())} else 0 end as quota from g),
    l as (select k, list({{'x': score::double, 's': [event_type], 'n': 0}} order by place) as l from n where nth <= quota group by 1),
    f as (select k, list_reduce(l, lambda a, y: case when a.n = 0 then {{'x': {r(c01('y.x'))}, 's': y.s, 'n': 1}} else {{'x': {r('greatest(a.x, y.x) + least(0.15, (a.n + 1) * 0.025)')}, 's': list_concat(a.s, y.s), 'n': a.n + 1}} end, {{'x': 0.0::double, 's': []::varchar[], 'n': 0}}) as s from l)
    select k, s.x as score, array_to_string(s.s, ',') as sources from f""",
)
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("k", "event_type").agg((F.sum("value") / 10000).alias("score"))
    return sets.merge_sources(rows, "k", "event_type", "k", "score", _QUOTA)


@query(
    "merge_layers",
    f"""with {EVENTS}, l as (select k, {c01('avg(value) / 100')} as v, 1.0 as w from ev group by 1 union all select k, {c01('avg(value) / 100')}, 2.0 from ev where at_ms >= {NOW - 10 * DAY} group by 1 union all select k, {c01('avg(value) / 100')}, 8.0 from ev where event_type = 'purchase' group by 1)
    select k, {r('sum(v * w) / sum(w)')} as v from l group by 1""",
)
def merge_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    layer = lambda rows, w: rows.groupBy("k").agg(clamp(F.avg("value") / 100).alias("v")).withColumn("w", F.lit(w))
    parts = layer(ev, 1.0).union(layer(ev.where(F.col("at_ms") >= NOW - 10 * DAY), 2.0)).union(layer(ev.where("event_type = 'purchase'"), 8.0))
    return sets.merge_layers(parts, "k", "v", "w")


@query(
    "orphan_recipes",
    f"""with {EVENTS}, p as (select user_id, k as src, lead(k) over (partition by user_id order by event_id) as dst from ev), q as (select user_id, k as src, (k * 7) % 100 as dst from ev)
    select distinct q.user_id, q.src, q.dst from q where not exists (select 1 from p where p.user_id = q.user_id and p.src = q.src and p.dst = q.dst)""",
)
def orphan_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    recipes = ev.select("user_id", F.col("k").alias("src"), ((F.col("k") * 7) % 100).alias("dst")).distinct()
    return sets.adjacent_pairs_missing(recipes, ev, "user_id", "event_id", "k")


@query(
    "private_profile",
    f"""with {EVENTS}, t as (select k % 10 as grp, user_id, event_type, {c01('avg(value) / 100')} as v from ev group by 1, 2, 3), m as (select grp, count(distinct user_id) as members from t group by 1), g as (select grp, event_type, sum(v) as s, count(distinct user_id) as c from t group by 1, 2)
    select g.grp, event_type, {r('s / members')} as mean, members from g join m on g.grp = m.grp where c >= 5""",
)
def private_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).groupBy((F.col("k") % 10).alias("grp"), "user_id", "event_type").agg(clamp(F.avg("value") / 100).alias("v"))
    return sets.private_profile(t, "user_id", "event_type", "v", "grp", 5)


_EDGES = "edges as (select c_custkey as a, c_custkey + 1 + c_custkey % 37 as b from customer where c_custkey + 1 + c_custkey % 37 < (select max(c_custkey) from customer))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    top = c.agg(F.max("c_custkey").alias("top"))  # one row
    b = F.col("c_custkey") + 1 + F.col("c_custkey") % 37
    return c.join(F.broadcast(top)).where(b < F.col("top")).select(F.col("c_custkey").alias("a"), b.alias("b"))


@query(
    "components",
    f"""with recursive {_EDGES}, sym as (select a, b from edges union select b, a from edges), reach as (select a as node, a as seen from sym union select r.node, e.b from reach r join sym e on r.seen = e.a)
    select node, min(seen) as component from reach group by 1""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir))


@query("leakage_safe_splits")
def leakage_safe_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.splits(graph.components(_edges(spark, sf_dir)))


@query("leaking_keys", "select p_brand as brand, count(distinct p_partkey % 3) as splits from part where p_size > 30 group by 1 having count(distinct p_partkey % 3) > 1")
def leaking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_brand").alias("brand"), (F.col("p_partkey") % 3).alias("split"))
    return graph.leaking_keys(rows, "brand", "split")


@query(
    "compatibility_edges",
    f"""select a.s_suppkey as src, b.s_suppkey as dst, {r('1 - abs(a.s_acctbal - b.s_acctbal) / 11000')} as score from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey
    where {r('1 - abs(a.s_acctbal - b.s_acctbal) / 11000')} >= 0.6""",
)
def compatibility_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    # a score of 0.6, rounded, allows balances 4,405.5 apart
    return graph.compatibility_edges(s, "s_suppkey", "s_nationkey", 1 - F.abs(F.col("a_s_acctbal") - F.col("b_s_acctbal")) / 11000, 0.6, ("s_acctbal", 4406.0))


def _hop(k: int) -> str:
    """The best 20 routes of k hops from those of k - 1."""
    edge = r("0.5 + 0.3 * (1 - abs(t.s_acctbal - x.s_acctbal) / 11000) + 0.2 * cast(t.s_nationkey = x.s_nationkey as int)")
    return f"""h{k} as (select list_append(route, x.s_suppkey) as route, s * {edge} as s from h{k - 1} join supplier t on t.s_suppkey = route[-1] join supplier x on not list_contains(route, x.s_suppkey) and {edge} >= 0.75
        order by {r(f"s * {edge}", 9)} desc, list_append(route, x.s_suppkey) limit 20)"""


@query("beam_routes", f"with h0 as (select [s_suppkey] as route, 1.0::double as s from supplier where s_suppkey = 0), {', '.join(_hop(k) for k in range(1, 5))} select route, {r('s', 6)} as score from h4")
def beam_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    score = 0.5 + 0.3 * (1 - F.abs(F.col("tip_s_acctbal") - F.col("s_acctbal")) / 11000) + 0.2 * (F.col("tip_s_nationkey") == F.col("s_nationkey")).cast("int")
    return ranking.beam_routes(s, "s_suppkey", 0, score, 0.75, 4, 20)


@query("upserted_cache", "select p_partkey, p_brand, p_size + case when p_retailprice > 950 then 100 else 0 end as size from part")
def upserted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old, new = p.select("p_partkey", "p_brand", F.col("p_size").alias("size")), p.where("p_retailprice > 950").select("p_partkey", "p_brand", (F.col("p_size") + 100).alias("size"))
    return ledger.upserted(old, new, ["p_partkey"])


@query("cache_freshness", "select p.p_partkey, q.p_partkey is not null as hit from part p left join (select p_partkey from part where p_size < 25) q on p.p_partkey = q.p_partkey")
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return ledger.fresh(p.where("p_size < 25"), p.select("p_partkey"), ["p_partkey"])
