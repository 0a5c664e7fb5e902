"""Plans, checks and regions of sessions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import camelot_score, clamp, half_up
from ..operators import choices, joins, queues, sessions, studies
from ..sources.tables import table
from .inputs import c01, r
from .registry import query
from .studies import _X, _best, _case, _mapped, _x

_OCCASIONS = {"view": "chill", "click": "love", "purchase": "energy", "signup": "party", "error": "party"}
_OCCASION = _case("event_type", {k: repr(v) for k, v in _OCCASIONS.items()}, repr("party"))
_KEPT = _case("event_type", {k: sessions.PRESERVATION[v] for k, v in _OCCASIONS.items()}, 0.05)


@query("segment_policy", f"with {_X} select event_id, {r('u')} as utility, {r('d')} as importance, {r(c01(f'd * ((case when k % 2 = 0 then 0.35 else 0.0 end) + {_KEPT}) + greatest(0.0, d - u) * 0.5'))} as risk from x")
def segment_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("k") % 2 == 0, 0.35).otherwise(0.0) + studies.looked_up(_mapped(F.col("event_type"), _OCCASIONS, "party"), sessions.PRESERVATION, 0.05)
    risk = clamp(F.col("d") * kept + F.greatest(F.lit(0.0), F.col("d") - F.col("u")) * 0.5)
    return _x(spark, sf_dir).select("event_id", half_up("u").alias("utility"), half_up("d").alias("importance"), half_up(risk).alias("risk"))


_PLACES = {"view": "next", "click": "next-plus-one", "purchase": "library-candidate", "signup": "now-playing", "error": "later"}


@query(
    "analysis_plan",
    f"""with {_X}, p as (select event_id, event_type as t, u, [1, 2, 3, 4, 4][cast(k % 5 + 1 as int)] as most from x), f as (select *, least(case when t = 'view' and u >= 0.7 then 4 when t = 'click' or u >= 0.45 then 3 when t = 'purchase' then 2 else 1 end, most) as fidelity from p)
    select event_id, case t when 'view' then 'critical' when 'click' then 'high' when 'purchase' then 'medium' when 'signup' then 'high' else 'low' end as priority, cast(fidelity as bigint) as fidelity, fidelity = 4 and u >= 0.7 as stems from f""",
)
def analysis_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, likely = _mapped(F.col("event_type"), _PLACES, "later"), F.col("u")
    wanted = F.when((place == "next") & (likely >= 0.7), 4).when((place == "next-plus-one") | (likely >= 0.45), 3).when(place == "library-candidate", 2).otherwise(1)
    tier = F.element_at(F.array(*map(F.lit, (1, 2, 3, 4, 4))), (F.col("k") % 5 + 1).cast("int"))
    priority = _mapped(place, {"next": "critical", "next-plus-one": "high", "library-candidate": "medium", "now-playing": "high"}, "low")
    rows = _x(spark, sf_dir).select("event_id", priority.alias("priority"), F.least(wanted, tier).cast("long").alias("fidelity"), likely.alias("u"))
    return rows.select("event_id", "priority", "fidelity", ((F.col("fidelity") == 4) & (F.col("u") >= 0.7)).alias("stems"))


@query(
    "offline_validation",
    f"""with {_X}, q as (select event_id, value - 1 as dur, case when event_type <> 'view' then value end as want, -80 + value / 2 as rms, u * 2 - 1.2 as peak from x),
    i as (select *, dur <= 0 as i1, rms <= -70 as i2, peak > 0.5 as i3, peak > -0.1 and peak <= 0.5 as i4, coalesce(abs(dur - want) * 1000 > greatest(150, want * 20), false) as i5 from q)
    select event_id, case when i1 or i2 or i3 or i5 then 'fallback' when i4 then 'accept-with-warning' else 'accept' end as recommendation, concat_ws(',', case when i1 then 'empty' end, case when i2 then 'silence' end, case when i3 then 'peak-unsafe' end, case when i4 then 'headroom-low' end, case when i5 then 'duration' end) as issues from i""",
)
def offline_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    length, wanted = F.col("value") - 1, F.when(F.col("event_type") != "view", F.col("value"))
    loud, peak = -80 + F.col("value") / 2, F.col("u") * 2 - 1.2
    off = F.coalesce(F.abs(length - wanted) * 1000 > F.greatest(F.lit(150.0), wanted * 20), F.lit(False))
    checks = [("empty", length <= 0), ("silence", loud <= -70), ("peak-unsafe", peak > 0.5), ("headroom-low", (peak > -0.1) & (peak <= 0.5)), ("duration", off)]
    fatal = checks[0][1] | checks[1][1] | checks[2][1] | off
    issues = F.concat_ws(",", *(F.when(bad, name) for name, bad in checks))
    return _x(spark, sf_dir).select("event_id", F.when(fatal, "fallback").when(issues != "", "accept-with-warning").otherwise("accept").alias("recommendation"), issues.alias("issues"))


@query(
    "harmonic_overlap",
    f"""with {_X}, s as (select user_id, event_id, k % 12 as c, u, event_type in ('view', 'click') as is_a from x), p as (select a.user_id, a.event_id as a, b.event_id as b, {r(f"(case when a.c = b.c then 0.0 else 0.6 end) + ({r('a.u', 9)} + {r('b.u', 9)}) * 0.2")} as risk, {r('a.u', 9)} as ua, {r('b.u', 9)} as ub, a.c as ca, b.c as cb
        from s a join s b on a.user_id = b.user_id and a.is_a and not b.is_a)
    select user_id, min(risk) as risk from p group by 1""",
)
def harmonic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select("user_id", "event_id", (F.col("k") % 12).alias("centre"), "u", F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b").alias("side"))
    return sessions.harmonic_overlap(rows, "user_id", "side", "centre", "u", "event_id").select("user_id", "risk")


@query(
    "aggregated_intents",
    f"""with {_X}, g as (select user_id, sum(u * case when event_type = 'signup' then 1.5 else 1.0 end) / sum(case when event_type = 'signup' then 1.5 else 1.0 end) as e, sum(w * case when event_type = 'signup' then 1.5 else 1.0 end) / sum(case when event_type = 'signup' then 1.5 else 1.0 end) as f,
        list(distinct 'g' || (k % 7)) as wished, coalesce(list(distinct 'g' || (k % 11)) filter (where event_type = 'error'), []) as outs from x group by 1)
    select user_id, {r('e')} as energy, {r('f')} as familiarity, array_to_string(list_sort(list_filter(wished, lambda g: not list_contains(outs, g))), ',') as genres, array_to_string(list_sort(list_filter(wished, lambda g: list_contains(outs, g))), ',') as conflicts from g""",
)
def aggregated_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda n: F.concat(F.lit("G"), (F.col("k") % n).cast("string"))
    rows = _x(spark, sf_dir).select("user_id", F.col("u").alias("energy"), F.col("w").alias("familiarity"), (F.col("event_type") == "signup").alias("host"), named(7).alias("genre"), F.when(F.col("event_type") == "error", named(11)).alias("excluded"))
    return sessions.crowd_intents(rows, "user_id")


@query(
    "golden_benchmark",
    f"""with {_X}, g as (select count(*) as n, count(*) filter (where u > 0.1) * 1.0 / count(*) as p, sum(case when k % 10 = 0 then 1 else 0 end) * 1.0 / greatest(1, sum(k % 4)) as f, avg(u * 100) as nat, avg(d * 100) as art, avg(w * 5) as pan from x)
    select n as cases, {r('p')} as pass_rate, {r('f')} as forbidden_rate, {r('nat', 1)} as naturalness, {r('art', 1)} as artifact_risk, {r('pan', 2)} as panel, concat_ws(',', case when p < 1 then 'pass-rate' end, case when f > 0 then 'forbidden' end, case when nat < 65 then 'naturalness' end, case when art > 40 then 'artifacts' end) as faults from g""",
)
def golden_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select(
        (F.col("u") > 0.1).alias("passed"), (F.col("k") % 4).alias("offered"), F.when(F.col("k") % 10 == 0, 1).otherwise(0).alias("forbidden"), (F.col("u") * 100).alias("naturalness"), (F.col("d") * 100).alias("artifact_risk"), (F.col("w") * 5).alias("panel")
    )
    return sessions.golden_benchmark(rows)


@query(
    "switch_margin",
    f"""with {_X}, g as (select user_id, event_type, {r('avg(u) * 100')} as pts from x group by 1, 2), b as ({_best('user_id', 'pts', 'event_type', 'event_type, pts', source='g')}), o as (select user_id, pts as base from g where event_type = 'view')
    select b.user_id, case when base is not null and pts < base + 4 then 'view' else event_type end as event_type, {r('case when base is not null and pts < base + 4 then base else pts end')} as score from b left join o on b.user_id = o.user_id""",
)
def switch_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).groupBy("user_id", "event_type").agg(half_up(F.avg("u") * 100).alias("pts"))
    return sessions.with_switch_margin(g, "user_id", "event_type", "pts", "view")


@query(
    "radio_scores",
    f"""with p as (select p_partkey, p_size / 50.0 as en, (p_partkey % 4) / 3.0 as da, p_partkey % 12 + 1 as n, (p_partkey % 10) / 10.0 as sim, p_brand = 'Brand#1' as chill from part)
    select p_partkey, {r("(1 - abs(en - 0.6)) * 2 + (case when n = 8 then 1.0 when n in (7, 9) then 0.8 when n in (6, 10) then 0.4 else 0.0 end) * 1.2 + (case when chill then 1 - da else da end) * 0.6 + sim * 1.6")} as score from p""",
)
def radio_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    dance = k % 4 / 3.0
    key = camelot_score(F.lit("8A"), F.concat((k % 12 + 1).cast("string"), F.lit("A")))
    score = (1 - F.abs(F.col("p_size") / 50.0 - 0.6)) * 2 + key * 1.2 + F.when(F.col("p_brand") == "Brand#1", 1 - dance).otherwise(dance) * 0.6 + k % 10 / 10.0 * 1.6
    return table(spark, sf_dir, "part").select("p_partkey", half_up(score).alias("score"))


_RIGHTS = {"stream": "p_size > 10", "mix": "p_retailprice > 920", "record": "p_partkey % 3 > 0"}


@query("shared_rights", f"with r as (select p_partkey as id, {', '.join(f'{x} as {n}' for n, x in _RIGHTS.items())} from part) select a.id, {', '.join(f'a.{n} and b.{n} as {n}' for n in _RIGHTS)} from r a join r b on b.id = a.id - a.id % 10")
def shared_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.expr(x).alias(n) for n, x in _RIGHTS.items()))
    other = rights.select(F.col("id").alias("other"), *(F.col(n).alias(f"o_{n}") for n in _RIGHTS))
    met = rights.join(other, F.col("other") == F.col("id") - F.col("id") % 10)
    return met.select("id", *((F.col(n) & F.col(f"o_{n}")).alias(n) for n in _RIGHTS))


@query(
    "stem_demand",
    f"""with {_X}, g as (select user_id, list_sort(list(distinct event_type)) as need, coalesce(list(distinct event_type) filter (where value > 120), []) as have, greatest(0, floor(max(k) / greatest(1, 30))) as room from x group by 1), m as (select *, list_filter(need, lambda t: not list_contains(have, t)) as lack from g)
    select user_id, array_to_string(lack[1:cast(room as int)], ',') as computed, array_to_string(lack[cast(room as int) + 1:], ',') as fallback from m""",
)
def stem_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).groupBy("user_id").agg(
        F.array_sort(F.collect_set("event_type")).alias("need"), F.collect_set(F.when(F.col("value") > 120, F.col("event_type"))).alias("have"), F.greatest(F.lit(0), F.floor(F.max("k") / 30)).cast("int").alias("room")
    )
    lack = g.select("user_id", "room", F.filter("need", lambda t: ~F.array_contains("have", t)).alias("lack"))
    part = lambda test: F.array_join(F.filter("lack", test), ",")
    return lack.select("user_id", part(lambda t, i: i < F.col("room")).alias("computed"), part(lambda t, i: i >= F.col("room")).alias("fallback"))


@query("moment_familiarity", f"with {_X} select user_id, {r('list_reduce(list(u order by event_id), lambda a, x: least(1.0, greatest(0.0, a * 0.8 + x * 0.2)), 0.5::double)', 6)} as familiarity, count(*) as evidence from x group by 1")
def moment_familiarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.moment_familiarity(_x(spark, sf_dir), "user_id", ["event_id"], "u")


_FORBIDDEN = ("error", "signup")


@query("realtime_audit", f"with {_X} select user_id, count(*) filter (where event_type not in {_FORBIDDEN!r}) as allowed, coalesce(string_agg(distinct event_type, ',' order by event_type) filter (where event_type in {_FORBIDDEN!r}), '') as violations from x group by 1")
def realtime_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type").isin(*_FORBIDDEN)
    return _x(spark, sf_dir).groupBy("user_id").agg(F.count_if(~bad).alias("allowed"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("event_type")))), ",").alias("violations"))


@query(
    "grid_failures",
    f"""with {_X}, o as (select user_id, e / 10 - d / 20 as off, 100 + k / 4.0 as bpm, row_number() over (partition by user_id order by event_id) as pos, count(*) over (partition by user_id) as n from x),
    g as (select user_id, avg(off) as m, avg(off) filter (where pos <= greatest(1, floor(n / 3))) as a, avg(off) filter (where pos > n - greatest(1, floor(n / 3))) as z, case when count(*) > 1 then {c01('max(bpm) / greatest(1.0, min(bpm)) - 1')} else 0.0 end as jump from o group by 1),
    s as (select *, {r('m * 1000')} as drift, {r('abs(z - a) * 1000')} as per from g) select user_id, drift as drift_ms, per as periodic_ms, {r('jump')} as discontinuity, case when per >= 80 or jump > 0.2 then 'safe-transition' when abs(drift) >= 35 or per >= 25 or jump > 0.08 then 'dynamic-grid' else 'constant-grid' end as action from s""",
)
def grid_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select("user_id", "event_id", (F.col("d") / 20).alias("expected"), (F.col("e") / 10).alias("actual"), (100 + F.col("k") / 4.0).alias("bpm"))
    return sessions.grid_failures(rows, "user_id", "event_id", "expected", "actual", "bpm")


@query(
    "mesh_promotion",
    f"""with {_X}, g as (select k as domain, count(*) filter (where event_type = 'error') as fails, avg(u) as cal, max(d) / 10 as lat, min(w) as fc from x group by 1) select domain, fails <= 100 and cal >= 0.3 and lat <= 0.09 and fc <= 0.02 as promoted from g""",
)
def mesh_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).groupBy(F.col("k").alias("domain")).agg(F.count_if(F.col("event_type") == "error").alias("fails"), F.avg("u").alias("cal"), (F.max("d") / 10).alias("lat"), F.min("w").alias("fc"))
    return g.select("domain", ((F.col("fails") <= 100) & (F.col("cal") >= 0.3) & (F.col("lat") <= 0.09) & (F.col("fc") <= 0.02)).alias("promoted"))


@query("transition_windows", f"with {_X}, b as ({_best('user_id', 'u', 'event_id', 'value')}) select user_id, {r('greatest(0.0, value - 2)')} as earliest, {r('value')} as ideal, {r('value + 2')} as latest, {r(c01('score'))} as confidence from b")
def transition_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = studies.leading(_x(spark, sf_dir), ["user_id"], "u", "event_id", ["value"])
    return found.select("user_id", half_up(F.greatest(F.lit(0.0), F.col("value") - 2)).alias("earliest"), half_up("value").alias("ideal"), half_up(F.col("value") + 2).alias("latest"), half_up(clamp("score")).alias("confidence"))


_PICKED = {n: f"r_{n} / greatest(r_chill + r_love + r_energy + r_party, 1e-9)" for n in ("chill", "love", "energy", "party")}


@query(
    "detected_experience",
    f"""with {_X}, t as (select *, case when k % 3 = 0 then 'edm' when k % 3 = 1 then 'chill' else 'pop' end as genre from x where d > 0.15), g as (select user_id, count(*) as n, avg(u) as en, avg(w) as da, avg(e) as ac, avg(d) as va, avg(1 - u) as vo, count(*) filter (where genre = 'edm') * 1.0 / count(*) as edm, count(*) filter (where genre = 'chill') * 1.0 / count(*) as calm from t group by 1),
    s as (select user_id, n, {c01('(1 - en) * 0.65 + ac * 0.25 + calm * 0.45')} as r_chill, {c01('(1 - abs(va - 0.58)) * 0.45 + vo * 0.25 + ac * 0.18')} as r_love, {c01('en * 0.72 + (1 - da) * 0.1')} as r_energy, {c01('en * 0.45 + da * 0.45 + edm * 0.35')} as r_party from g),
    o as (select user_id, n, unnest([{', '.join(repr(x) for x in _PICKED)}]) as name, unnest([0, 1, 2, 3]) as i, unnest([{', '.join(r(x, 9) for x in _PICKED.values())}]) as v from s), q as (select *, row_number() over (partition by user_id order by v desc, i) as nth, lead(v) over (partition by user_id order by v desc, i) as nx from o)
    select u.user_id, coalesce(name, 'chill') as experience, case when name is null then 0.2 else {r(c01('0.45 + v - nx + n * 0.04'))} end as confidence from (select distinct user_id from x) u left join q on u.user_id = q.user_id and nth = 1""",
)
def detected_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    genre = F.when(F.col("k") % 3 == 0, "edm").when(F.col("k") % 3 == 1, "chill").otherwise("pop")
    rows = _x(spark, sf_dir).select("user_id", F.col("u").alias("energy"), F.col("w").alias("dance"), F.col("e").alias("acoustic"), F.col("d").alias("valence"), (1 - F.col("u")).alias("vocal"), genre.alias("genre"), F.col("d").alias("confidence"))
    return sessions.detected_experience(rows, "user_id")


@query(
    "lyric_lookup",
    f"""with {_X}, l as (select user_id, k, min(event_id) as id from x where event_type = 'click' group by 1, 2), q as (select event_id, user_id, value / 2 as t from x where event_type = 'view')
    select event_id, k as line, case when k % 3 = 0 then id end as translation from q join l on q.user_id = l.user_id and t >= k and t < k + 1""",
)
def lyric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    lines = x.where("event_type = 'click'").groupBy("user_id", "k").agg(F.min("event_id").alias("id")).select("user_id", F.col("k").alias("line"), F.col("k").cast("double").alias("w_start"), (F.col("k") + 1.0).alias("w_end"))
    told = x.where("event_type = 'click' and k % 3 = 0").groupBy("user_id", F.col("k").alias("line")).agg(F.min("event_id").alias("translation"))
    asked = x.where("event_type = 'view'").select("event_id", "user_id", (F.col("value") / 2).alias("t"))
    return joins.points_in_windows(asked, lines, "user_id", "t", 4.0).join(told, ["user_id", "line"], "left").select("event_id", "line", "translation")


_VERSION = {"view": "remix", "click": "original-version", "purchase": "acoustic-version", "signup": "extended-version", "error": "cover"}
_RANK = _case("event_type", {k: sessions.PREFERRED["chill"].index(v) if v in sessions.PREFERRED["chill"] else 99 for k, v in _VERSION.items()}, 99)


@query("version_choice", f"with {_X} select k, event_id from (select *, row_number() over (partition by k order by {_RANK}, event_id) as nth from x) where nth = 1")
def version_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).withColumn("version", _mapped(F.col("event_type"), _VERSION, "cover"))
    place = F.coalesce(*(F.when(F.col("version") == v, F.lit(i)) for i, v in enumerate(sessions.PREFERRED["chill"])), F.lit(99))
    return rows.groupBy("k").agg(F.min(F.struct(place.alias("p"), "event_id")).alias("b")).select("k", "b.event_id")


_COVERED = {"beat_grid": "p_size > 0", "structure": "p_partkey % 5 > 0", "stems": "p_size > 60", "genre": "p_type is not null"}


@query(
    "signal_coverage",
    f"""with g as (select count(*) as total, {', '.join(f'count(*) filter (where {x}) as {n}' for n, x in _COVERED.items())} from part), s as ({' union all '.join(f"select '{n}' as signal, {n} as available, total from g" for n in _COVERED)})
    select *, case when available = total then 'complete' when available > 0 then 'partial' else 'missing' end as status from s""",
)
def signal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", *(F.expr(x).alias(n) for n, x in _COVERED.items()))
    return sessions.signal_coverage(rows, "p_partkey", list(_COVERED))


@query(
    "masking_matrix",
    f"""with {_X}, p as (select event_type as role, k % 10 as band, sum(w) / 100 as v from x group by 1, 2) select a.role as masker, b.role as masked, {r(c01('sum(least(a.v, b.v)) / 10'))} as masking from p a join p b on a.band = b.band and a.role <> b.role group by 1, 2""",
)
def masking_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select(F.col("event_type").alias("role"), (F.col("k") % 10).alias("band"), (F.col("w") / 100).alias("energy"))
    return sessions.masking_matrix(rows, "role", "band", "energy", 10)


@query("journey_edit", f"with {_X}, t as (select user_id, event_id, case when event_type = 'signup' then 0 else k end as pos, case when event_type = 'signup' then {c01('u + 0.5')} else u end as energy from x) select event_id, row_number() over (partition by user_id order by pos, event_id) as place, {r('energy')} as energy from t")
def journey_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    hit = F.col("event_type") == "signup"
    edited = _x(spark, sf_dir).select("user_id", "event_id", F.when(hit, 0).otherwise(F.col("k")).alias("pos"), F.when(hit, clamp(F.col("u") + 0.5)).otherwise(F.col("u")).alias("energy"))
    return edited.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("pos", "event_id")).alias("place"), half_up("energy").alias("energy"))


@query(
    "planning_loops",
    f"""with {_X}, f as (select *, row_number() over (partition by user_id order by event_id) as nth from x), t as (select * from f where nth <= 3), g as (select user_id, min(nth) filter (where event_type = 'purchase') as ok, count(*) as n from t group by 1)
    select g.user_id, 'plan' || coalesce(string_agg('+' || event_type, '' order by nth) filter (where nth <= coalesce(ok - 1, n) and event_type <> 'view'), '') as plan, cast(coalesce(any_value(ok), any_value(n)) as bigint) as iterations, any_value(ok) is not null as committed from g join t on g.user_id = t.user_id group by 1""",
)
def planning_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("repair"))
    return sessions.planning_loops(rows, "user_id", "event_id", "ok", "repair")


@query("session_pseudonyms", "select user_id % 100 as grp, sha256('salt|' || (user_id % 100)) as session, count(distinct user_id) as members from events group by 1, 2")
def session_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("grp")).agg(F.countDistinct("user_id").alias("members"))
    return g.select("grp", F.sha2(F.concat(F.lit("salt|"), F.col("grp").cast("string")), 256).alias("session"), "members")


_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint)"


@query("input_hashes", f"select p_partkey, lpad(lower(to_hex({_FNV.format('p_name')})), 8, '0') as mark from part")
def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sessions.fnv1a(F.col("p_name")).alias("mark"))


@query("blind_trials", f"with {{}} select event_id, {_FNV.format(chr(39) + 'p' + chr(39) + ' || k || ' + chr(39) + 'r' + chr(39) + ' || user_id')} % 2 = 1 as swapped from ev".replace("{}", _X.split(", x as")[0]))
def blind_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = sessions.fnv1a(F.concat(F.lit("p"), F.col("k").cast("string"), F.lit("r"), F.col("user_id").cast("string")))
    return _x(spark, sf_dir).select("event_id", (F.conv(F.right(mark, F.lit(1)), 16, 10).cast("int") % 2 == 1).alias("swapped"))


@query("media_schedule", f"with {_X} select event_id, at_ms - k - user_id % 50 as deadline, at_ms - k - user_id % 50 - 20 - k * 2 as send_at, u >= 0.8 as qualified from x")
def media_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    deadline = F.col("at_ms") - F.col("k") - F.col("user_id") % 50
    return _x(spark, sf_dir).select("event_id", deadline.alias("deadline"), (deadline - 20 - F.col("k") * 2).alias("send_at"), (F.col("u") >= 0.8).alias("qualified"))


@query("catalog_entities", "select n_name as text, min(s_suppkey) as entity from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 0 group by 1")
def catalog_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first available entry whose name holds the text; texts are few and are sent to the entries."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("text"))
    entries = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    named = entries.join(F.broadcast(n.withColumnRenamed("text", "of")), "n_nationkey").select("s_suppkey", F.concat_ws(" ", "of", F.lit("supplier")).alias("name"))
    hits = named.join(F.broadcast(n.select("text")), F.startswith(F.col("name"), F.concat("text", F.lit(" ")))).groupBy("text").agg(F.min("s_suppkey").alias("entity"))
    return n.select("text").join(hits, "text", "left")


@query("warm_targets", f"with {_X}, h as (select *, row_number() over (partition by user_id order by event_id) as nth from x) select event_id from h where nth <= 3 and event_type <> 'error'")
def warm_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each queue first, what is wanted of it then."""
    head = choices.best(_x(spark, sf_dir), ["user_id"], ["event_id"], most=3)
    return head.where("event_type <> 'error'").select("event_id")


@query("grounded_explanations", f"with {_X}, g as (select user_id, list(distinct event_type) as told, list(distinct event_type) filter (where value > 60) as real from x group by 1) select user_id, array_to_string(list_sort(list_filter(told, lambda t: list_contains(coalesce(real, []), t))), ',') as reasons from g")
def grounded_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("told"), F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("real"))
    return g.select("user_id", F.array_join(F.array_sort(F.array_intersect("told", "real")), ",").alias("reasons"))


@query("learnable_scopes", f"with {_X} select user_id, not bool_or(event_type in ('error', 'signup')) as may_learn from x group by 1")
def learnable_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("scopes"))
    return g.select("user_id", (~F.arrays_overlap("scopes", F.array(F.lit("error"), F.lit("signup")))).alias("may_learn"))


@query(
    "queue_edits",
    f"""with {_X}, q as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as n from x)
    select user_id, event_id, case when pos < 1 then pos when pos > 1 then pos - 1 else -1 end as removed, case when pos >= 2 then pos - 2 else -1 end as jumped, case when pos = 0 then least(2, n - 1) when pos <= 2 then pos - 1 else pos end as moved from q""",
)
def queue_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a queue without its second entry, from its third on, and with its first entry moved behind the third; -1 for
    what is not in it."""
    q = queues.places(_x(spark, sf_dir), "user_id", ["event_id"])
    at = F.col("at")
    return q.select("user_id", "event_id", F.coalesce(queues.without(at, 1), F.lit(-1)).alias("removed"), F.coalesce(queues.jumped(at, 2), F.lit(-1)).alias("jumped"), queues.moved(at, F.col("n"), 0, 2).alias("moved"))
