"""Charts, telemetry buckets, calibration and evidence over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, clamped_index, floor_index, half_life, half_up
from ..operators import calibration, fusion, groups, ledger, prefixes, ranking, sets, telemetry
from ..sources.tables import table
from .inputs import EVENTS, LINES, NOW, STATS, c01, events, r, scored_lines
from .registry import query

DAY = 86_400_000


@query(
    "social_chart",
    f"""
    with {EVENTS}
    select k as item, count(distinct user_id) as users, count(distinct user_id) * 2 + count(*) filter (where event_type = 'click') * 1.5
           + count(*) filter (where event_type = 'view') * 2 + count(*) filter (where event_type = 'purchase') * 2.5 :: double as score
    from ev group by 1 order by score desc, item limit 50
    """,
)
def social_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    users = F.countDistinct("user_id")
    score = users * 2 + of("click") * 1.5 + of("view") * 2 + of("purchase") * 2.5
    return events(spark, sf_dir).groupBy(F.col("k").alias("item")).agg(users.alias("users"), score.cast("double").alias("score")).orderBy(F.desc("score"), "item").limit(50)


@query(
    "capped_chart",
    f"""
    with s as (select l_partkey, count(*) as n, {r('sum(l_quantity)', 1)} as score from lineitem group by 1),
    j as (select p_partkey as item, p_brand as brand, score, row_number() over (partition by p_brand order by score desc, p_partkey) as nth from s join part on p_partkey = l_partkey)
    select item, brand, score from j where nth <= 3 order by score desc, item limit 100
    """,
)
def capped_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(half_up(F.sum("l_quantity"), 1).alias("score"))
    rows = sold.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), "score")
    return ranking.capped_chart(rows, "score", "item", "brand", 3, 100)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart signals of items (k): this and the last fortnight's ranks by listens."""
    ev = events(spark, sf_dir)
    late = F.col("at_ms") >= NOW - 15 * DAY
    return ev.groupBy("k").agg(
        F.count_if(late).alias("recent"), F.count_if(~late).alias("earlier"), F.countDistinct("user_id").alias("listeners"), F.count(F.lit(1)).alias("listens"),
        (F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("save"), (F.count_if(F.col("event_type") != "error") / F.count(F.lit(1))).alias("completion"),
    )


@query(
    "trend_classes",
    f"""
    with {EVENTS},
    s as (select k, count(*) filter (where at_ms >= {NOW - 15 * DAY}) as recent, count(*) filter (where at_ms < {NOW - 15 * DAY}) as earlier,
                 count(distinct user_id) as listeners, count(*) as listens, count(*) filter (where event_type = 'purchase') / count(*) as save,
                 count(*) filter (where event_type <> 'error') / count(*) as completion from ev group by k),
    m as (select k, (recent - earlier) * 1.0 as velocity, (recent - earlier) / 2.0 as acceleration,
                 {c01(f"0.28 + tanh((recent - earlier) * 1.0 / 100) * 0.24 + tanh((recent - earlier) / 2.0 / 50) * 0.12 + {c01('log10(greatest(1.0, listens)) / 7')} * 0.1"
                      f" + {c01('listeners * 1.0 / greatest(1, listens) * 8')} * 0.08 + {c01('save')} * 0.08 + {c01('completion')} * 0.05 + {c01('listeners / 150.0')} * 0.13")} as momentum,
                 listeners / 150.0 as spread from s)
    select k as item, {r('momentum')} as momentum,
           case when velocity < -10 then 'falling' when momentum >= 0.82 and spread >= 0.65 then 'viral' when momentum >= 0.7 and velocity >= 100 then 'breaking'
                when momentum >= 0.58 and velocity > 5 then 'rising' else 'stable-hit' end as trend from m
    """,
)
def trend_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir).withColumns({"velocity": (F.col("recent") - F.col("earlier")) * 1.0, "acceleration": (F.col("recent") - F.col("earlier")) / 2.0, "spread": F.col("listeners") / 150.0})
    m = ranking.momentum(F.col("velocity"), F.col("acceleration"), F.col("listens").cast("double"), F.col("listeners") * 1.0, F.col("save"), F.col("completion"), F.col("spread"))
    s = s.withColumn("momentum", m)
    kind = ranking.trend_class(F.col("velocity"), F.col("velocity"), F.lit(30), F.col("momentum"), F.col("spread"))
    return s.select(F.col("k").alias("item"), half_up("momentum").alias("momentum"), kind.alias("trend"))


@query(
    "rising_shares",
    f"""
    with {EVENTS},
    t as (select greatest(1, count(*) filter (where {NOW} - at_ms <= {10 * DAY})) as r, greatest(1, count(*) filter (where {NOW} - at_ms > {10 * DAY})) as p from ev),
    g as (select k, count(*) filter (where {NOW} - at_ms <= {10 * DAY}) as r, count(*) filter (where {NOW} - at_ms > {10 * DAY}) as p from ev group by k)
    select k as item, {r('g.r * 1.0 / t.r', 6)} as recent_share, {r('g.p * 1.0 / t.p', 6)} as previous_share, {r('g.r * 1.0 / t.r - g.p * 1.0 / t.p', 6)} as growth from g, t
    """,
)
def rising_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).withColumn("late", NOW - F.col("at_ms") <= 10 * DAY)
    total = ev.agg(F.greatest(F.lit(1), F.count_if("late")).alias("tr"), F.greatest(F.lit(1), F.count_if(~F.col("late"))).alias("tp"))  # one row
    g = ev.groupBy(F.col("k").alias("item")).agg(F.count_if("late").alias("r"), F.count_if(~F.col("late")).alias("p")).join(F.broadcast(total))
    a, b = F.col("r") / F.col("tr"), F.col("p") / F.col("tp")
    return g.select("item", half_up(a, 6).alias("recent_share"), half_up(b, 6).alias("previous_share"), half_up(a - b, 6).alias("growth"))


@query(
    "forgotten_favorites",
    f"""
    with {EVENTS}
    select user_id * 1000 + k as item, {r("sum(case when event_type = 'purchase' then 1.0 else 0.5 end)")} as score from ev
    where event_type in ('purchase', 'click') and user_id * 1000 + k not in (select user_id * 1000 + k from ev where {NOW} - at_ms <= {10 * DAY}) group by 1
    """,
)
def forgotten_favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).withColumn("item", F.col("user_id") * 1000 + F.col("k"))
    weight = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.5)
    return sets.forgotten(ev, "item", NOW - F.col("at_ms") <= 10 * DAY, F.col("event_type").isin("purchase", "click"), weight)


@query("bucket_stats", f"with {LINES} select l_returnflag as flag, l_linestatus as status, {STATS} from scored group by 1, 2")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_lines(spark, sf_dir).withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})
    return telemetry.bucket_stats(rows, ["flag", "status"])


_PATTERNS = """keyed as (
    select 'tempo' as pattern, case when l_discount * 100 <= 2 then '0-2' when l_discount * 100 <= 6 then '2-6' when l_discount * 100 <= 8 then '6-8' else '8+' end as bucket, * from scored
    union all select 'key', case when l_tax >= 0.07 then 'compatible' when l_tax >= 0.04 then 'borderline' else 'clash' end, * from scored
    union all select 'stretch', case when l_quantity <= 10 then '0-10' when l_quantity <= 30 then '10-30' else '30+' end, * from scored)"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, q = F.col("l_discount") * 100, F.col("l_tax"), F.col("l_quantity")
    return telemetry.pattern_stats(
        scored_lines(spark, sf_dir),
        {
            "tempo": F.when(d <= 2, "0-2").when(d <= 6, "2-6").when(d <= 8, "6-8").otherwise("8+"),
            "key": F.when(t >= 0.07, "compatible").when(t >= 0.04, "borderline").otherwise("clash"),
            "stretch": F.when(q <= 10, "0-10").when(q <= 30, "10-30").otherwise("30+"),
        },
    )


@query("pattern_stats", f"with {LINES}, {_PATTERNS} select pattern, bucket, {STATS} from keyed group by 1, 2")
def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir)


@query(
    "pattern_findings",
    f"with {LINES}, {_PATTERNS}, b as (select pattern, bucket, {STATS} from keyed group by 1, 2) select pattern, bucket, n, avg_score from b where n >= 100 and avg_score < 78 order by avg_score, n desc, pattern, bucket limit 8",
)
def pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.findings(_patterns(spark, sf_dir), 100).select("pattern", "bucket", "n", "avg_score")


@query(
    "feedback_bias",
    f"""with {LINES}, {_PATTERNS}, b as (select pattern, bucket, {STATS} from keyed group by 1, 2)
    select pattern, bucket, {r(c01('n * 1.0 / 4'))} as confidence,
           {r(f"least(greatest((avg_score - 82) * 0.45 - fallback_rate * 18 - negative_rate * 28, -24.0), 12.0) * {c01('n * 1.0 / 4')}")} as bias from b""",
)
def feedback_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.feedback_bias(_patterns(spark, sf_dir)).select("pattern", "bucket", "confidence", "bias")


@query(
    "failure_rates",
    f"""with {EVENTS}, kinds as (select unnest(['error', 'timeout', 'click', 'crash', 'view']) as kind), g as (select event_type, count(*) as c from ev group by 1)
    select kind, coalesce(c, 0) as n, {r('coalesce(c, 0) * 1.0 / (select greatest(1, count(*)) from ev)', 6)} as rate from kinds left join g on kind = event_type""",
)
def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(x,) for x in ("error", "timeout", "click", "crash", "view")], "kind string")
    return telemetry.failure_rates(events(spark, sf_dir), "event_type", kinds)


@query(
    "percentile_conventions",
    f"""with {EVENTS}, o as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as pos, count(*) over (partition by event_type) as n from ev)
    select event_type, max(value) filter (where pos = floor((n - 1) * 0.95)) as p95_floor, max(value) filter (where pos = least(n - 1, floor(n * 0.95))) as p95_clamped,
           max(value) filter (where pos = floor((n - 1) * 0.5)) as p50_floor, max(value) as worst from o group by 1""",
)
def percentile_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = {"p95_floor": floor_index(0.95), "p95_clamped": clamped_index(0.95), "p50_floor": floor_index(0.5), "worst": F.col("n") - 1}
    return prefixes.index_percentiles(events(spark, sf_dir), ["event_type"], "value", ranks)


@query(
    "cold_start_stats",
    f"""with {EVENTS} select event_type, count(*) filter (where value < 50) as warm, count(*) filter (where value >= 50) as cold,
    quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, {r('count(*) filter (where value >= 50) / count(*)')} as cold_rate from ev group by 1""",
)
def cold_start_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import nearest_rank, ratio

    warm = F.count_if(F.col("value") < 50)
    cold = F.count_if(F.col("value") >= 50)
    return events(spark, sf_dir).groupBy("event_type").agg(
        warm.alias("warm"), cold.alias("cold"), nearest_rank("value", 0.5).alias("p50"), nearest_rank("value", 0.95).alias("p95"), ratio(cold, F.count(F.lit(1))).alias("cold_rate")
    )


_PREDICTED = f"pred as (select lang, {c01('n_chars / 3000.0')} as p, quality as y from documents d join labels l on d.doc_id = l.doc_id)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("lang", clamp(F.col("n_chars") / 3000.0).alias("p"), F.col("quality").alias("y"))


@query(
    "calibration",
    f"""with {_PREDICTED}, b as (select lang, least(floor(p * 10), 9) as bin, count(*) as n, {r('avg(p)')} as pm, {r('avg(y * 1.0)')} as ob, sum(pow(p - y, 2)) as sq from pred group by 1, 2)
    select lang, {r('sum(abs(pm - ob) * n) / sum(n)')} as ece, {r('sum(sq) / sum(n)')} as brier, cast(sum(n) as bigint) as n from b group by 1""",
)
def calibration_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.calibration(_predicted(spark, sf_dir), "lang", "p", "y")


@query(
    "reliability_bins",
    f"""with {_PREDICTED}, b as (select cast(least(floor(p * 10), 9) as bigint) as bin, count(*) as n, avg(p) as c, avg(y * 1.0) as a from pred group by 1), bins as (select unnest(range(0, 10)) as bin)
    select bins.bin, coalesce(n, 0) as n, {r('coalesce(c, 0.0)')} as mean_confidence, {r('coalesce(a, 0.0)')} as accuracy, {r('abs(coalesce(c, 0.0) - coalesce(a, 0.0))')} as error from bins left join b on bins.bin = b.bin""",
)
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.reliability_bins(_predicted(spark, sf_dir), "p", "y")


@query(
    "absolute_calibration",
    f"""with {_PREDICTED} select lang, {r('avg(abs(p - y))')} as mae, {r('avg(pow(p - y, 2))')} as brier,
    {r('count(*) filter (where p >= 0.8 and y = 0) * 1.0 / greatest(1, count(*) filter (where p >= 0.8))')} as catastrophic from pred group by 1""",
)
def absolute_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.absolute_calibration(_predicted(spark, sf_dir), "lang", "p", "y")


@query(
    "wilson_intervals",
    f"""with {_PREDICTED}, g as (select lang, count(*) as n, count(*) filter (where y = 1) as s from pred group by 1), w as (select *, s * 1.0 / n as p, 1 + 1.96 * 1.96 / n as den from g),
    m as (select *, (p + 1.96 * 1.96 / (2 * n)) / den as ctr, 1.96 / den * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) as mar from w)
    select lang, n, s as successes, {r(c01('ctr - mar'), 6)} as low, {r(c01('ctr + mar'), 6)} as high from m""",
)
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.rate_intervals(_predicted(spark, sf_dir).withColumn("ok", F.col("y") == 1), ["lang"], "ok")


@query(
    "mean_intervals",
    f"""with {_PREDICTED}, g as (select lang, count(p) as n, avg(p) as m, var_samp(p) as v from pred group by 1)
    select lang, n, {r('m', 6)} as mean, {r(c01('m - case when n > 1 then 1.96 * sqrt(v / n) else 0.5 end'), 6)} as low, {r(c01('m + case when n > 1 then 1.96 * sqrt(v / n) else 0.5 end'), 6)} as high from g""",
)
def mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.mean_intervals(_predicted(spark, sf_dir), ["lang"], "p")


_KINDS = {"accepted": ("click", "purchase"), "undone": ("error",), "voluntary": ("view", "signup")}


@query(
    "ledger_summary",
    f"""with {EVENTS}, w as (select *, {c01('value / 100')} as weight from ev where at_ms between {NOW - 20 * DAY} and {NOW}),
    g as (select count(*) as events, coalesce(sum(weight) filter (where event_type in ('click', 'purchase')), 0.0) as accepted, coalesce(sum(weight) filter (where event_type = 'error'), 0.0) as undone,
                 coalesce(sum(weight) filter (where event_type in ('view', 'signup')), 0.0) as voluntary, count(*) filter (where event_type in ('click', 'purchase', 'error')) as evidence from w)
    select events, {r('accepted')} as accepted, {r('undone')} as undone, {r('voluntary')} as voluntary, evidence,
           {r(f"case when evidence < 10 then 0.5 else {c01('0.5 * 0.9 + (case when accepted + undone > 0 then accepted / (accepted + undone) else 0.5 end) * 0.1')} end")} as trust from g""",
)
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_type").alias("kind"), clamp(F.col("value") / 100).alias("weight"), "at_ms")
    return ledger.summary(rows, NOW, _KINDS["accepted"], _KINDS["undone"], _KINDS["voluntary"], days=20)


@query(
    "reaction_feedback",
    f"""with {EVENTS}, t as (select k as item, {r(f"case event_type when 'click' then 0.55 when 'error' then -0.65 when 'purchase' then 1.0 when 'view' then 0.8 else 0.0 end * {c01('value / 100')} * pow(2.0, -greatest(0, {NOW} - at_ms) / 60000.0 / 4320.0)")} as x from ev)
    select item, {r('least(greatest(sum(x), -1.0), 1.0)')} as adjustment, count(*) as evidence from t group by 1""",
)
def reaction_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"click": "like", "error": "skip", "purchase": "request", "view": "dance"}
    reaction = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in names.items()), F.lit("neutral"))
    rows = events(spark, sf_dir).select(F.col("k").alias("item"), reaction.alias("reaction"), (F.col("value") / 100).alias("confidence"), "at_ms")
    return ledger.reaction_feedback(rows, "item", NOW, 4320.0)


@query("newest_events", f"with {EVENTS} select event_id, user_id, at_ms from ev order by at_ms desc, event_id desc limit 100")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(events(spark, sf_dir), 100, ["at_ms", "event_id"]).select("event_id", "user_id", "at_ms")


@query(
    "cache_eviction",
    "with h as (select doc_id, source, sum(n_chars) over (partition by source order by doc_id desc rows unbounded preceding) as held from documents) select doc_id, source from h where held > 60000",
)
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("at", F.col("doc_id"))
    return ledger.evicted(docs, "source", "at", "n_chars", "doc_id", 60_000).select("doc_id", "source")


@query(
    "decayed_values",
    f"with {EVENTS} select user_id, event_type, {r(f'sum(value * pow(2.0, -greatest({NOW} - at_ms, 0) / {7.0 * DAY}))')} as level from ev group by 1, 2",
)
def decayed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    decayed = half_life("value", NOW - F.col("at_ms"), 7.0 * DAY)
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(half_up(F.sum(decayed)).alias("level"))


@query(
    "categorical_fusion",
    f"""with {EVENTS}, e as (select user_id as entity, event_type as value, k % 5 as family, {c01('value / 200')} as conf from ev where value > 0),
    f as (select entity, value, family, sum(conf) as support, max(conf) as best from e group by 1, 2, 3),
    v as (select entity, value, sum(support) as support, 1 - product(1 - best) as u from f group by 1, 2),
    w as (select *, row_number() over (partition by entity order by support desc, value) as nth, sum(support) over (partition by entity) as total, lead(support, 1, 0.0) over (partition by entity order by support desc, value) as nxt from v)
    select entity, value, {r('u * (support / total) * (support / total)', 4)} as confidence, {r('support / total', 4)} as agreement, support / total < 0.67 or nxt >= support * 0.5 as conflicted from w where nth = 1""",
)
def categorical_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("value"), F.col("event_id").cast("string").alias("source"), (F.col("k") % 5).cast("string").alias("family"),
        clamp(F.col("value") / 200).alias("confidence"), F.lit(1.0).alias("weight"),
    )
    return fusion.fuse_categorical(rows)


@query(
    "numeric_fusion",
    f"""with {EVENTS}, e as (select user_id as entity, value, {c01('k / 100.0')} as s from ev where k > 0),
    c as (select entity, value, sum(s) over w as support, sum(s * value) over w as moment, count(*) over w as members from e window w as (partition by entity order by value range between 5.0 preceding and 5.0 following)),
    b as (select *, row_number() over (partition by entity order by {r('support', 9)} desc, value) as nth from c)
    select entity, {r('moment / support')} as value, {r('support', 4)} as support, members from b where nth = 1""",
)
def numeric_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("user_id").alias("entity"), "value", F.col("event_id").cast("string").alias("source"), (F.col("k") / 100.0).alias("confidence"), F.lit(1.0).alias("weight"))
    return fusion.fuse_numeric(rows, 5.0)


@query(
    "positionwise_mean",
    f"""with e as (select label, vec_id, cast(unnest(embedding) as double) as x, unnest(range(0, len(embedding))) as pos from embeddings)
    select label, cast(pos as int) as pos, {r('sum(x * (1 + vec_id % 3)) / sum(1 + vec_id % 3)', 4)} as value from e group by 1, 2""",
)
def positionwise_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", (1 + F.col("vec_id") % 3).alias("w"), F.col("embedding").cast("array<double>").alias("x"))
    return fusion.positionwise_mean(rows, "label", "x", "w")


def _tastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return g.select("user_id", F.col("event_type").alias("genre"), clamp(F.col("v") / 1500).alias("affinity"))


_TASTES = f"{EVENTS}, tastes as (select user_id, event_type as genre, {c01('sum(value) / 1500')} as affinity from ev group by 1, 2)"


@query(
    "crowd_taste",
    f"""with {_TASTES}, m as (select count(distinct user_id) as members from tastes),
    g as (select genre, sum(affinity) as s, sum(affinity * affinity) as q, min(affinity) as lo, max(affinity) as hi, count(*) as n from tastes group by 1),
    j as (select *, s / members as mean, case when n < members then 0.0 else lo end as low from g, m)
    select genre, {r('mean * 0.55 + low * 0.45')} as consensus, {r('mean')} as mean, {r('low')} as minimum, {r('hi')} as maximum, {r('q / members - mean * mean', 6)} as variance, low >= 0.55 as shared, hi - low >= 0.5 as contested from j""",
)
def crowd_taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.crowd_taste(_tastes(spark, sf_dir))


@query(
    "crowd_score",
    f"""with {_TASTES}, fits as (select k as track_id, event_type as genre, {c01('avg(value) / 100')} as fit from ev group by 1, 2), w as (select user_id, sum(affinity) as w from tastes group by 1), m as (select count(*) as members from w),
    x as (select track_id, t.user_id, {c01('sum(fit * affinity) / max(case when w = 0 then 1.0 else w end)')} as x from tastes t join fits f on t.genre = f.genre join w on t.user_id = w.user_id group by 1, 2),
    q as (select genre, {r('max(affinity)')} as hi, {r('case when count(*) < (select members from m) then 0.0 else min(affinity) end')} as lo, max(affinity) - case when count(*) < (select members from m) then 0.0 else min(affinity) end as gap from tastes group by 1), c as (select genre, {r('hi - lo')} as gap from q where gap >= 0.5),
    p as (select track_id, sum(fit * gap) / (select greatest(count(*), 1) from c) as cost from fits join c using (genre) group by 1),
    g as (select track_id, sum(x) / max(members) as mean, case when count(*) < max(members) then 0.0 else min(x) end as low, sum((user_id % 10) / 20.0 * x) / max(members) as boost from x, m group by 1)
    select g.track_id, {r(c01('mean * 0.45 + low * 0.35 + boost * 0.25 - coalesce(cost, 0.0) * 0.15'))} as score, {r('mean')} as average, {r('low')} as minimum, {r('boost')} as fairness_boost, {r('coalesce(cost, 0.0)')} as contested_penalty from g left join p on g.track_id = p.track_id""",
)
def crowd_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    fits = ev.groupBy(F.col("k").alias("track_id"), F.col("event_type").alias("genre")).agg(clamp(F.avg("value") / 100).alias("fit"))
    debts = ev.select("user_id", ((F.col("user_id") % 10) / 20.0).alias("debt")).distinct()
    return groups.crowd_score(_tastes(spark, sf_dir), fits, debts)


@query(
    "group_satisfaction",
    f"""with {EVENTS}, e as (select k, {c01('value / 100')} as v, event_type = 'purchase' as ok, (user_id % 10) / 10.0 as debt from ev where event_type <> 'error'),
    g as (select k, count(*) as n, avg(v) as mean, min(v) as low, max(v) as high, var_pop(v) as var, count(*) filter (where ok) / count(*) as approval, coalesce(avg(v) filter (where v >= 0.18), 0.0) as spared, avg(debt * v) * 0.35 as bonus from e group by 1),
    p as (select *, {r(f"case when n < 2 then 0.0 else {c01('2 * sqrt(var)')} end")} as polarization, case when low < 0.18 then (0.18 - low) / 0.18 * 0.35 else 0.0 end as penalty from g),
    w as (select *, case when polarization > 0.55 then 0.25 else 0.12 end as w2, case when n <= 6 then 0.18 else 0.1 end as w4, case when n >= 4 then 0.12 else 0.05 end as w5 from p)
    select k, {r(c01(f"(mean * 0.25 + low * w2 + high * 0.08 + spared * w4 + approval * w5 + {c01('mean + bonus')} * 0.25) / (0.25 + w2 + 0.08 + w4 + w5 + 0.25) - penalty"))} as score,
           {r('mean')} as mean, {r('low')} as minimum, {r('high')} as maximum, polarization, {r('penalty')} as penalty, {r('bonus')} as fairness_bonus from w""",
)
def group_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "k", (F.col("value") / 100).alias("satisfaction"), (F.col("event_type") == "purchase").alias("approved"), ((F.col("user_id") % 10) / 10.0).alias("fairness_debt"), (F.col("event_type") != "error").alias("active")
    )
    return groups.group_satisfaction(rows, "k")


@query(
    "fairness_window",
    f"""with {EVENTS}, w as (select * from ev where at_ms >= {NOW - 4320 * 60000}), f as (select k, min(event_id) as first from w group by 1 order by 2 desc limit 10),
    x as (select user_id, count(*) filter (where event_type <> 'error') * 1.0 / count(*) as rep, avg(0.8 - {c01('value / 100')}) as gap from w where k in (select k from f) group by 1)
    select user_id, {r('rep')} as representation, {r(c01('(1 - rep) * 0.7 + greatest(0.0, gap) * 0.3'))} as debt from x""",
)
def fairness_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "at_ms", F.col("k").alias("track_id"), "user_id", F.lit(0.8).alias("expected"), (F.col("value") / 100).alias("observed"), (F.col("event_type") != "error").alias("represented")
    )
    return groups.fairness_window(rows, NOW, 4320, 10)


@query(
    "crowd_fatigue",
    f"""with {EVENTS}, l as (select *, row_number() over (partition by user_id order by event_id desc) as nth from ev), e as (select *, {c01('value / 100')} as energy, (k % 11) / 10.0 as novelty, (k % 7) / 6.0 as reaction from l where nth <= 8),
    t as (select user_id, max(c) as top from (select user_id, event_type, count(*) as c from e group by 1, 2) group by 1),
    g as (select user_id, count(*) as n, avg(energy) as en, avg(novelty) as nv, arg_min(reaction, event_id) as a, arg_max(reaction, event_id) as z from e group by 1), d as (select *, case when n > 1 then {c01('a - z + 0.5')} else 0.0 end as dr from g)
    select d.user_id, {r(c01('en * dr'))} as energy_fatigue, {r(c01('nv * dr'))} as novelty_fatigue, {r(c01('top * 1.0 / n * dr'))} as genre_fatigue from d join t on d.user_id = t.user_id""",
)
def crowd_fatigue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "user_id", F.col("event_id").alias("seq"), clamp(F.col("value") / 100).alias("energy"), ((F.col("k") % 11) / 10.0).alias("novelty"), F.col("event_type").alias("genre"), ((F.col("k") % 7) / 6.0).alias("reaction")
    )
    return groups.fatigue(rows, "user_id")


@query(
    "supplier_diversity",
    f"""with g as (select l_returnflag as flag, l_suppkey, count(*) as c from lineitem group by 1, 2), t as (select flag, sum(c) as t, count(*) as d from g group by 1)
    select g.flag, {r('max(d) * 1.0 / max(t)', 6)} as distinct_share, {r('sum(pow(c * 1.0 / t, 2))', 6)} as herfindahl from g join t on g.flag = t.flag group by 1""",
)
def supplier_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    s = g.groupBy("flag").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("d"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return s.select("flag", half_up(F.col("d") / F.col("t"), 6).alias("distinct_share"), half_up(F.col("q") / (F.col("t") * F.col("t")), 6).alias("herfindahl"))


@query(
    "request_ranking",
    f"""with {EVENTS}, d as (select event_id, user_id, {c01('value / 100')} as pr, {c01('k / 100.0')} as co, k % 9 as votes, at_ms, case when event_type = 'signup' then at_ms + 600000 end as dl, event_type = 'purchase' and k % 10 = 0 as ho, (user_id % 10) / 10.0 as debt, user_id % 4 as rc from ev),
    s as (select *, {c01('0.55 + debt * 0.55 - rc * 0.12')} as fa, {c01(f'1 - ({NOW} - at_ms) / 2700000.0')} as re, case when dl is null then 0.0 else {c01(f'1 - (dl - {NOW}) / 1800000.0')} end as ur from d)
    select event_id, {r('fa')} as fairness, {r('re')} as recency, {r(f"case when ho then 1.0 else {c01('pr * 0.22 + fa * 0.24 + re * 0.1 + co * 0.22 + least(votes / 8.0, 1.0) * 0.12 + ur * 0.1')} end")} as score from s""",
)
def request_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        events(spark, sf_dir)
        .select(
            "event_id", (F.col("value") / 100).alias("priority"), (F.col("k") / 100.0).alias("compatibility"), (F.col("k") % 9).alias("votes"), F.col("at_ms").alias("created_ms"),
            F.when(F.col("event_type") == "signup", F.col("at_ms") + 600_000).alias("deadline_ms"), ((F.col("event_type") == "purchase") & (F.col("k") % 10 == 0)).alias("host_override"),
            ((F.col("user_id") % 10) / 10.0).alias("debt"), (F.col("user_id") % 4).alias("recent"),
        )
    )
    return groups.rank_requests(rows, NOW).select("event_id", "fairness", "recency", "score")
