"""Panels of ratings, choices among candidates, and crowd wishes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, half_up
from ..operators import choices, groups, panels
from ..sources.tables import table
from .inputs import EVENTS, c01, events, r
from .registry import query

_RATINGS = f"""{EVENTS}, cases as (select p_partkey as case_id, [p_size, p_size + 1] as variants from part),
    met as (select event_id, k, user_id, case event_type when 'view' then null when 'error' then -1 when 'click' then variants[1] else variants[2] end as preferred, {c01('value / 200')} as confidence, variants from ev join cases on k = case_id),
    valid as (select * from (select *, row_number() over (partition by k, user_id order by event_id) as nth from met where preferred is null or list_contains(variants, preferred)) where nth = 1)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.array("p_size", F.col("p_size") + 1).alias("variants"))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    kind = F.col("event_type")
    said = events(spark, sf_dir).join(cases, F.col("k") == F.col("case_id"))
    preferred = F.when(kind == "view", None).when(kind == "error", -1).when(kind == "click", F.col("variants")[0]).otherwise(F.col("variants")[1])
    ratings = said.select(F.col("event_id").alias("seq"), "case_id", F.col("user_id").alias("rater"), preferred.alias("preferred"), clamp(F.col("value") / 200).alias("confidence"))
    return panels.valid_ratings(ratings, cases)


_PREFS = f"""{_RATINGS}, s as (select unnest(variants) as variant, preferred, confidence from valid),
    g as (select variant, count(*) as n, count(*) filter (where preferred = variant) as wins, count(*) filter (where preferred is null) as ties, avg(confidence) as c from s group by 1),
    w as (select *, (wins + ties * 0.5) / n as p, 1 + 1.96 * 1.96 / n as den from g), m as (select *, (p + 1.96 * 1.96 / (2 * n)) / den as ctr, 1.96 / den * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) as mar from w),
    prefs as (select variant, n as comparisons, wins, ties, {r('p', 6)} as rate, {r(c01('ctr - mar'), 6)} as low, {r(c01('ctr + mar'), 6)} as high, {r('c', 6)} as confidence from m)"""


@query("panel_preferences", f"with {_PREFS} select * from prefs")
def panel_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.preferences(_valid(spark, sf_dir))


@query("panel_size", f"with {_RATINGS} select count(*) as ratings, count(distinct user_id) as raters, {r('count(distinct k) * 1.0 / (select count(*) from cases)', 6)} as coverage from valid")
def panel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.panel_size(_valid(spark, sf_dir), _cases(spark, sf_dir))


@query(
    "promotion_gate",
    f"""with {_RATINGS}, g as (select count(*) as ratings, count(distinct user_id) as raters, {r('count(distinct k) * 1.0 / (select count(*) from cases)', 6)} as coverage from valid)
    select *, concat_ws(',', case when ratings < 100000 then 'need-100000-ratings' end, case when raters < 10 then 'need-10-raters' end, case when coverage < 0.8 then 'coverage' end) as reasons from g""",
)
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.promotion_gate(panels.panel_size(_valid(spark, sf_dir), _cases(spark, sf_dir)), ratings=100_000)


@query(
    "joint_scores",
    f"""with {_PREFS}, t as (select distinct p_size as variant, 60.0 + p_size % 30 as technical from part),
    j as (select t.variant, technical, rate, case when comparisons >= 5 then {r(f"least(0.5, {c01('(comparisons - 4) / 15.0')} * confidence * 0.5)")} else 0.0 end as w from t left join prefs on t.variant = prefs.variant)
    select variant, coalesce(w, 0.0) as human_weight, {r('case when coalesce(w, 0.0) > 0 then technical * (1 - w) + rate * 100 * w else technical end', 1)} as joint from j""",
)
def joint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = table(spark, sf_dir, "part").select(F.col("p_size").alias("variant"), (60.0 + F.col("p_size") % 30).alias("technical")).distinct()
    return panels.joint_scores(variants, panels.preferences(_valid(spark, sf_dir)))


_COHORTS = f"{EVENTS}, s as (select event_type as cohort, k as item, {r('sum(value)', 2)} as score, count(distinct user_id) as listeners from ev group by 1, 2)"


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("cohort"), F.col("k").alias("item")).agg(half_up(F.sum("value"), 2).alias("score"), F.countDistinct("user_id").alias("listeners"))


@query("cohort_winners", f"with {_COHORTS}, n as (select *, row_number() over (partition by cohort order by score desc, item) as nth from s) select cohort, item as winner from n where nth = 1")
def cohort_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.cohort_winners(_cohorts(spark, sf_dir), "cohort", "item", "score")


@query("overall_winner", f"with {_COHORTS} select item, {r('sum(score * listeners) / sum(listeners)', 6)} as mean from s group by 1 order by mean desc, item limit 1")
def overall_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.overall_winner(_cohorts(spark, sf_dir), "item", "score", "listeners")


@query("shadow_disagreements", f"select p_partkey, {r('greatest(p_size / 50.0, (p_retailprice - 900) / 100, p_partkey % 7 / 6.0) - least(p_size / 50.0, (p_retailprice - 900) / 100, p_partkey % 7 / 6.0)', 6)} as spread from part order by spread desc, p_partkey limit 25")
def shadow_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), ((F.col("p_retailprice") - 900) / 100).alias("b"), (F.col("p_partkey") % 7 / 6.0).alias("c"))
    return panels.disagreement(rows, "p_partkey", ["a", "b", "c"], 25)


@query(
    "confidence_island",
    """with n as (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_size desc, p_partkey) as nth from part where p_retailprice >= 950) select p_brand as brand, p_partkey as part, p_retailprice as price from n where nth = 1""",
)
def confidence_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = choices.best(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.desc("p_size"), "p_partkey"], F.col("p_retailprice") >= 950)
    return found.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price"))


@query(
    "routed_jobs",
    """with n as (select s_nationkey, s_suppkey, s_acctbal, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as nth from supplier where s_acctbal > 5000) select n_nationkey as nation, coalesce(s_suppkey, -1) as supplier, coalesce(s_acctbal, 0.0) as balance from nation left join n on n_nationkey = s_nationkey and nth = 1""",
)
def routed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("balance"))
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return choices.best_or(s, keys, "nation", [F.desc("balance"), "supplier"], F.col("balance") > 5000, {"supplier": -1, "balance": 0.0})


@query(
    "source_hierarchy",
    f"""with {EVENTS}, n as (select *, row_number() over (partition by user_id order by case event_type when 'signup' then 0 when 'purchase' then 1 when 'click' then 2 else 3 end, at_ms desc, event_id) as nth from ev) select user_id, event_type as source, value from n where nth = 1""",
)
def source_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = choices.by_source(events(spark, sf_dir), ["user_id"], "event_type", ["signup", "purchase", "click"], [F.desc("at_ms"), "event_id"])
    return found.select("user_id", F.col("event_type").alias("source"), "value")


@query(
    "residual_states",
    f"""with {EVENTS}, x as (select k * 10 + user_id % 10 as g, event_id, (value - 50) / 1500 as v from ev), s as (select g, count(*) as n, avg(v) as m, max(v) - min(v) as spread, arg_min(v, event_id) as a, arg_max(v, event_id) as z from x group by 1)
    select g, case when spread > 0.06 then 'REACQUIRING' when abs(case when n > 1 then (z - a) / (n - 1) else 0.0 end) > 0.004 then 'DRIFTING' when abs(m) > 0.03 then 'UNCERTAIN' else 'LOCKED' end as state from s""",
)
def residual_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("k") * 10 + F.col("user_id") % 10).alias("g"), "event_id", ((F.col("value") - 50) / 1500).alias("v"))
    return choices.residual_state(rows, "g", "event_id", "v")


@query(
    "committee_disagreement",
    f"""with {EVENTS}, h as (select k, event_id, value, 60.0 + user_id as bpm, (event_id % 100) / 100.0 as phase from ev), g as (select k, max(bpm) as hi, min(bpm) as lo, max(phase) - min(phase) as ph from h group by 1), n as (select k, event_id, row_number() over (partition by k order by value desc, event_id) as nth from h)
    select g.k, event_id as primary, {r(c01('(hi - lo) / greatest(1.0, hi)'))} as tempo_spread, {r(c01('ph'))} as phase_spread, {r(f"greatest({c01('(hi - lo) / greatest(1.0, hi)')}, {c01('ph')})")} as impact from g join n on g.k = n.k and nth = 1""".replace("as primary", 'as "primary"'),
)
def committee_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("k", "event_id", "value", (60.0 + F.col("user_id")).alias("bpm"), ((F.col("event_id") % 100) / 100.0).alias("phase"))
    return choices.committee(rows, "k", "event_id", "value", "bpm", "phase")


@query(
    "nearest_pulses",
    f"""with p as (select p_partkey, 100.0 + p_size as a, 60.0 + p_partkey % 120 as b from part), o as (select p_partkey, a, unnest([b, b / 2, b * 2]) as v, unnest([0, 1, 2]) as kk from p), n as (select *, row_number() over (partition by p_partkey order by abs(v - a), kk) as nth from o)
    select p_partkey, {r('v / a')} as ratio, abs(v / a - 1) <= 0.04 as compatible from n where nth = 1""",
)
def nearest_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = choices.nearest_pulse(100.0 + F.col("p_size"), 60.0 + F.col("p_partkey") % 120)
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.ratio", "p.compatible")


@query(
    "transition_robustness",
    f"""with q as (select p_partkey, p_retailprice / 1000 as q, p_size / 500.0 as s from part) select p_partkey, {r('((case when q - s >= 0.9 then 2 else 0 end) + (case when q - 0.5 * s >= 0.9 then 2 else 0 end) + (case when q >= 0.9 then 1 else 0 end)) / 5.0')} as robust from q""",
)
def transition_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", choices.robustness(F.col("p_retailprice") / 1000, F.col("p_size") / 500.0, 0.9).alias("robust"))


@query(
    "layer_decision",
    f"""with q as (select p_partkey, p_size / 50.0 as a, (p_retailprice - 900) / 100 as b, (1 + p_partkey % 9) / 9.0 as c from part) select p_partkey, {r(f"pow({c01('a')} * {c01('b')} * {c01('c')}, 1.0 / 3)")} as score, case when a <= b and a <= c then 'size' when b <= c then 'price' else 'key' end as weakest from q""",
)
def layer_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"size": F.col("p_size") / 50.0, "price": (F.col("p_retailprice") - 900) / 100, "key": (1 + F.col("p_partkey") % 9) / 9.0}
    return table(spark, sf_dir, "part").select("p_partkey", choices.geometric_mean(list(parts.values())).alias("score"), choices.weakest(parts).alias("weakest"))


@query(
    "relaxed_constraints",
    "with n as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size desc, p_retailprice, p_partkey) as nth from part) select p_brand as brand, string_agg(cast(p_partkey as varchar), ',' order by cast(p_partkey as varchar)) as dropped from n where nth <= 3 group by 1",
)
def relaxed_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("name"), "p_partkey", "p_size", "p_retailprice")
    first = choices.best(rows, ["brand"], [F.desc("p_size"), "p_retailprice", "p_partkey"], most=3)
    return choices.relaxed(first, "brand", "name", "p_size", "p_retailprice", 3)


@query(
    "grid_search",
    f"""with g as (select s_suppkey, d, h, {r('1 - abs(d - 4 - s_suppkey % 9) / 20 - abs(h - 0.3 - s_nationkey / 50.0)', 6)} as best from supplier, (select unnest([4.0::double, 8.0::double, 16.0::double]) as d) x, (select unnest([0.35::double, 0.5::double, 0.65::double]) as h) y), n as (select *, row_number() over (partition by s_suppkey order by best desc, d, h) as nth from g) select s_suppkey, d, h, best from n where nth = 1""",
)
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 1 - F.abs(F.col("d") - 4 - F.col("s_suppkey") % 9) / 20 - F.abs(F.col("h") - 0.3 - F.col("s_nationkey") / 50.0)
    found = choices.grid_search(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), {"d": [4.0, 8.0, 16.0], "h": [0.35, 0.5, 0.65]}, score)
    return found.select("s_suppkey", "d", "h", "best")


@query("critic_cascade", "select count(*) filter (where p_size >= 10) as after_p_size, count(*) filter (where p_size >= 10 and p_retailprice >= 950) as after_p_retailprice from part")
def critic_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.criticism(table(spark, sf_dir, "part"), [("p_size", 10), ("p_retailprice", 950)])


@query(
    "two_hop_paths",
    """with e as (select c_custkey as seq, c_nationkey as a, c_custkey % 25 as b, (c_custkey % 10) / 10.0 as conf from customer), s as (select * from e where conf >= 0.7), f as (select a, arg_min(b, seq) as via from s group by 1),
    p as (select x.n_nationkey as src, y.n_nationkey as dst from nation x join nation y on x.n_regionkey = y.n_regionkey and x.n_nationkey <> y.n_nationkey)
    select src, dst, case when exists (select 1 from s where s.a = src and s.b = dst) then src || '>' || dst when exists (select 1 from s where s.a = via and s.b = dst) then src || '>' || via || '>' || dst else '' end as path from p left join f on f.a = src""",
)
def two_hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    edges = c.select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).alias("b"), ((F.col("c_custkey") % 10) / 10.0).alias("confidence"))
    n = table(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_nationkey").alias("src"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("dst"), "n_regionkey"), "n_regionkey").where("src <> dst").select("src", "dst")
    return choices.two_hop_path(edges, pairs)


@query(
    "community_affinity",
    f"""with {EVENTS} select user_id as src, k % 10 as dst, {r(f"max({c01('value / 100')} * case event_type when 'purchase' then 1.0 when 'click' then 0.82 when 'view' then 0.58 else 0.0 end)")} as affinity from ev group by 1, 2""",
)
def community_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = events(spark, sf_dir).select(F.col("user_id").alias("src"), (F.col("k") % 10).alias("dst"), (F.col("value") / 100).alias("strength"), F.col("event_type").alias("relation"))
    return choices.affinity(edges, {"purchase": 1.0, "click": 0.82, "view": 0.58})


@query(
    "trusted_corrections",
    f"""with {EVENTS}, c as (select k as item, event_type = 'signup' as by_user, {c01('value / 100')} as trust, user_id % 5 as contributors, event_id as fixed, row_number() over (partition by k order by event_type = 'signup' desc, {c01('value / 100')} desc, event_id) as nth from ev where {c01('value / 100')} >= 0.6 and (event_type = 'signup' or user_id % 5 >= 3))
    select p_partkey as item, coalesce(fixed, p_size) as level from part left join c on item = p_partkey and nth = 1""",
)
def trusted_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("long").alias("level"))
    fixes = events(spark, sf_dir).select(
        F.col("k").alias("item"), (F.col("event_type") == "signup").alias("by_user"), clamp(F.col("value") / 100).alias("trust"), (F.col("user_id") % 5).alias("contributors"), F.col("event_id").alias("fixed")
    )
    return choices.corrected(features, fixes, "item", "level")


_WISHES = f"{EVENTS}, w as (select {c01('value / 100')} as confidence, (k - 50) / 50.0 as valence, (user_id % 10) / 9.0 as arousal from ev)"
_CLUSTERS = f"""{_WISHES}, g as (select case when valence >= 0 then 'positive' else 'negative' end || '-' || case when arousal >= 0.5 then 'high' else 'low' end as cluster, count(*) as members, sum(confidence) as w, sum(valence * confidence) as v, sum(arousal * confidence) as a from w group by 1),
    c as (select cluster, members, {r('v / greatest(w, 1.0)')} as valence, {r(c01('a / greatest(w, 1.0)'))} as arousal, {r('w / (select greatest(sum(w), 1.0) from g)')} as weight from g)"""


def _wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select((F.col("value") / 100).alias("confidence"), ((F.col("k") - 50) / 50.0).alias("valence"), ((F.col("user_id") % 10) / 9.0).alias("arousal"))


@query("crowd_intent", f"with {_CLUSTERS} select * from c")
def crowd_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.crowd_intent(_wishes(spark, sf_dir))


@query(
    "intent_polarization",
    f"with {_CLUSTERS} select {r(c01('max((abs(x.valence - y.valence) / 2 + abs(x.arousal - y.arousal)) / 2 * least(1.0, (x.weight + y.weight) * 1.5))'))} as polarization from c x, c y",
)
def intent_polarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.intent_polarization(groups.crowd_intent(_wishes(spark, sf_dir)))


@query(
    "crowd_cohesion",
    f"""with {EVENTS}, s as (select k, user_id, at_ms % 40000 as t, case when event_type = 'error' then -1.0 else 1.0 end as d, {c01('value / 100')} as e from ev), m as (select k, avg(d) as m from s group by 1), g as (select s.k, avg(abs(d - m)) as dis, avg(e) as e, max(t) - min(t) as t, count(distinct user_id) as n from s join m on s.k = m.k group by 1)
    select k, {r(c01('1 - dis / 2'))} as consensus, {r(c01('e'))} as engagement, {r(c01('1 - t / 30000.0'))} as synchrony, {r(c01('n / 6.0'))} as confidence from g""",
)
def crowd_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("k", F.col("user_id").alias("member"), (F.col("at_ms") % 40000).alias("at_ms"), F.when(F.col("event_type") == "error", -1.0).otherwise(1.0).alias("direction"), clamp(F.col("value") / 100).alias("engagement"))
    return groups.cohesion(rows, "k")


@query(
    "group_taste",
    f"""with {EVENTS}, p as (select k, {c01('value / 100')} as s, {c01('value / 200')} as a, (user_id % 10) / 10.0 as debt, event_type = 'click' as rq, user_id % 50 = 0 as ho from ev), q as (select *, {c01('s * 0.45 + a * 0.55')} as p from p),
    g as (select k, avg(p) as m, min(p) as lo, avg(debt * a) * 0.2 as f, avg(case when rq then 0.08 else 0.0 end) as r, avg(case when ho and a < 0.25 then 0.2 else 0.0 end) as h from q group by 1)
    select k, {r(c01('m * 0.55 + lo * 0.35 + f + r - h'), 6)} as score, {r('lo', 6)} as minimum, {r('f', 6)} as fairness from g""",
)
def group_taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "k", clamp(F.col("value") / 100).alias("satisfaction"), clamp(F.col("value") / 200).alias("affinity"), ((F.col("user_id") % 10) / 10.0).alias("debt"), (F.col("event_type") == "click").alias("requested"), (F.col("user_id") % 50 == 0).alias("host")
    )
    return groups.group_taste(rows, "k")
