"""Consensus, budgets, fatigue, charts, presence, evidence and quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import evidence
from ..functions.scalars import clamp, half_up, noisy_or, tempo_relation
from ..operators import groups, joins, signals, studies
from ..sources import jsonl
from ..sources.tables import fresh_path, table
from ..streaming import events as streaming
from .inputs import EVENTS, NOW, c01, events, r
from .registry import query

DAY = 86_400_000

_X = f"{EVENTS}, x as (select *, {c01('value / 100')} as u, {c01('value / 200')} as w, (user_id % 10) / 10.0::double as d, (event_id % 100) / 100.0::double as e from ev)"


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with numbers in [0, 1]: u and w of the value, d of the user and e of the event."""
    new = {"u": clamp(F.col("value") / 100), "w": clamp(F.col("value") / 200), "d": (F.col("user_id") % 10) / 10.0, "e": (F.col("event_id") % 100) / 100.0}
    return events(spark, sf_dir).withColumns(new)


def _case(x: str, table_: dict[str, object], otherwise: object) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then {v}" for k, v in table_.items()) + f" else {otherwise} end"


def _mapped(x: Column, table_: dict[str, str], otherwise: str | None = None) -> Column:
    return F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in table_.items()), F.lit(otherwise))


def _best(keys: str, score: str, tie: str, take: str, where: str = "true", source: str = "x") -> str:
    """The row with the best score of each key."""
    return f"select {keys}, {take}, {r(score, 9)} as score from (select *, row_number() over (partition by {keys} order by {r(score, 9)} desc, {tie}) as nth from {source} where {where}) where nth = 1"


@query(
    "crowd_consensus",
    f"""with {_X}, g as (select k, avg(u) as m, case when count(*) < 2 then 0.0 else {r(c01('2 * sqrt(var_pop(u))'))} end * 0.45 as p from x group by 1)
    select k, {r(c01('m - p'))} as consensus, {r('m')} as mean, {r('p')} as penalty from g""",
)
def crowd_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.consensus(_x(spark, sf_dir), "k", "u")


@query(
    "cross_dataset",
    f"""with {_X} select avg(u) >= 0.5 and avg(w) >= 0.65 and avg(d / 2) <= 0.2 as robust, {r('avg(u)')} as mean_valence, {r('avg(w)')} as mean_arousal, {r('avg(d / 2)')} as mean_error,
    (select event_id from x order by {r('u + w - d / 2', 9)}, event_id limit 1) as weakest from x""",
)
def cross_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.cross_dataset(_x(spark, sf_dir).withColumn("err", F.col("d") / 2), "event_id", "u", "w", "err")


@query(
    "analyzer_routes",
    f"""with {_X}, g as (select event_type as domain, k % 5 as s, user_id % 7 as analyzer, avg(u) * least(1.0, count(*) / 20.0) as rel from x group by 1, 2, 3),
    c as (select domain, s as section, analyzer, rel from g where s > 0 union all select g.domain, t.s, analyzer, rel from g join (select distinct domain, s from g where s > 0) t on g.domain = t.domain where g.s = 0),
    b as ({_best('domain, section', 'rel', 'analyzer', 'analyzer', source='c')}) select domain, cast(section as varchar) as section, analyzer, {r('score')} as reliability from b""",
)
def analyzer_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("k") % 5 == 0, "any").otherwise((F.col("k") % 5).cast("string"))
    g = _x(spark, sf_dir).groupBy(F.col("event_type").alias("domain"), section.alias("section"), (F.col("user_id") % 7).alias("analyzer")).agg(F.avg("u").alias("success"), F.count(F.lit(1)).alias("samples"))
    return studies.analyzer_routes(g)


@query(
    "pairwise_mixes",
    f"""with {_X}, g as (select k, count(*) as n, count(*) filter (where event_type = 'click') as a, count(*) filter (where event_type = 'purchase') as b, avg(user_id % 5 + 1) as artifacts, avg(event_id % 5 + 1) as timing from x group by 1)
    select k, case when a = b then 'tie' when a > b then 'A' else 'B' end as winner, {r('(a + (n - a - b) * 0.5) / n', 6)} as share_a, n, {r('artifacts')} as artifacts, {r('timing')} as timing from g""",
)
def pairwise_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select("k", _mapped(F.col("event_type"), {"click": "A", "purchase": "B"}, "tie").alias("p"), (F.col("user_id") % 5 + 1).alias("artifacts"), (F.col("event_id") % 5 + 1).alias("timing"))
    return studies.pairwise_mixes(rows, "k", "p", ["artifacts", "timing"])


_MOVES = {"view": "fade", "click": "cut", "purchase": "bassdrop", "signup": "roll", "error": "other"}
_MOVE = f"m as (select *, {_case('event_type', {k: repr(v) for k, v in _MOVES.items()}, repr('other'))} as move from x)"
_COST = _case("move", studies.EFFECTS, 0.5)


@query(
    "novelty_budget",
    f"""with {_X}, {_MOVE}, l as (select *, row_number() over (partition by user_id order by event_id desc) as nth from m), t as (select *, count(*) over (partition by user_id) as size from l where nth <= 8), p as (select *, size - nth + 1 as pos from t),
    f as (select *, arg_max(move, pos) over (partition by user_id) as final from p), s as (select *, size - coalesce(max(case when move <> final then pos end) over (partition by user_id), 0) as run from f),
    g as (select user_id, move, count(*) as recent, sum(pos) * 1.0 / max(size) as hits, max(case when move = final then run else 0 end) as consecutive from s group by 1, 2), b as (select *, {c01('hits / 2.4 + greatest(0, consecutive - 1) * 0.22')} as us from g)
    select user_id, move, recent, cast(consecutive as bigint) as consecutive, {r('us')} as used, {r(f'1 - {c01(f"us * {_COST}")}')} as remaining, {r(c01(f'us * {_COST}'))} as penalty from b""",
)
def novelty_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).withColumn("move", _mapped(F.col("event_type"), _MOVES, "other"))
    return studies.novelty_budget(rows, "user_id", "event_id", "move", studies.EFFECTS)


_TOP = "max(c) filter (where n = '{0}')"


@query(
    "session_fatigue",
    f"""with {_X}, {_MOVE}, l as (select *, row_number() over (partition by user_id order by event_id desc) as nth from m), t as (select user_id, nth, cast(k % 3 as varchar) as artist, cast(k % 2 as varchar) as genre, move, cast(k % 4 as varchar) as mk, u, w, 100 + k % 20 as bpm from l where nth <= 8),
    g as (select user_id, count(*) as n, count(*) filter (where nth <= 6) as n6, avg(u) filter (where nth <= 6) as vocals, min(nth) filter (where nth <= 6 and u < 0.6) as calm, max(w) - min(w) as er, max(bpm) - min(bpm) as br, avg({_COST}) filter (where nth <= 6) as effects from t group by 1),
    c as (select user_id, max(c) as na from (select user_id, artist, count(*) as c from t group by 1, 2) group by 1), c2 as (select user_id, max(c) as ng from (select user_id, genre, count(*) as c from t group by 1, 2) group by 1),
    c3 as (select user_id, max(c) as nt from (select user_id, move, count(*) as c from t where nth <= 6 group by 1, 2) group by 1), c4 as (select user_id, max(c) as nk from (select user_id, mk, count(*) as c from t group by 1, 2) group by 1),
    p as (select user_id, case when n < 2 then 0.0 else {c01('(na - 1) * 1.0 / greatest(1, n - 1)')} end as artist, case when n < 2 then 0.0 else {c01('(ng - 1) * 1.0 / greatest(1, n - 1)')} end as genre, case when n6 < 2 then 0.0 else {c01('(nt - 1) * 1.0 / greatest(1, n6 - 1)')} end as transition,
        {c01('greatest(0.0, (vocals - 0.48) / 0.42) * 0.7 + coalesce(calm - 1, n6) / 6.0 * 0.3')} as vocal, case when n < 3 then 0.0 else {c01('(1 - er / 0.28) * ' + c01('(n - 2) / 4.0'))} end as energy,
        {c01(f'effects * 0.7 + (case when n6 < 2 then 0.0 else {c01("(nt - 1) * 1.0 / greatest(1, n6 - 1)")} end) * 0.3')} as effect, case when n < 3 then 0.0 else {c01('(1 - br / 14.0) * ' + c01('(n - 2) / 4.0'))} end as tempo, case when n < 2 then 0.0 else {c01('(nk - 1) * 1.0 / greatest(1, n - 1)')} end as "key"
        from g join c using (user_id) join c2 using (user_id) join c3 using (user_id) join c4 using (user_id)),
    o as (select user_id, unnest([{', '.join(repr(n) for n in studies.FATIGUE)}]) as n, unnest(range(0, 8)) as i, unnest([{', '.join(r(f'"{n}"', 9) for n in studies.FATIGUE)}]) as v from p), top as (select user_id, n as dominant from (select *, row_number() over (partition by user_id order by v desc, i) as nth from o) where nth = 1)
    select user_id, {', '.join(f'{r(chr(34) + n + chr(34))} as "{n}"' for n in studies.FATIGUE)}, {r(' + '.join(f'"{n}" * {w}' for n, w in studies.FATIGUE.items()))} as total, dominant from p join top using (user_id)""",
)
def session_fatigue(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda n: (F.col("k") % n).cast("string")
    rows = _x(spark, sf_dir).select(
        "user_id", "event_id", name(3).alias("artist"), name(2).alias("genre"), _mapped(F.col("event_type"), _MOVES, "other").alias("transition"), name(4).alias("musical_key"), F.col("u").alias("vocal"), F.col("w").alias("energy"),
        (100 + F.col("k") % 20).alias("bpm"),
    )
    return studies.session_fatigue(rows, "user_id", "event_id", studies.EFFECTS)


_CAUSES = ("track", "transition", "session", "repetition")


@query(
    "feedback_causes",
    f"""with {_X}, {_MOVE}, i as (select event_id, case when event_type <> 'error' then k * 500 end as af, case when event_type <> 'signup' then u end as ra, case when event_type <> 'view' then move end as mv, value > 150 as dis, case when event_type <> 'click' then w - d end as en, user_id % 5 as rep from m),
    t as (select *, (case when af is null then 0.06 when af <= 4000 then 0.9 when af <= 12000 then 0.68 when af <= 30000 then 0.35 else 0.05 end) + (case when mv in {evidence.COMPLEX!r} then 0.18 else 0.0 end) as a,
        case when dis then 1.4 when ra is null then 0.28 when ra < 0.04 then 0.16 when ra < 0.15 then 0.46 when ra < 0.5 then 0.74 else 0.9 end as b, case when en is null then 0.2 else 0.22 + abs(en) * 2 end as c, least(0.9, rep * 0.24) as z from i),
    s as (select *, {r('b / (a + b + c + z)')} as track, {r('a / (a + b + c + z)')} as transition, {r('c / (a + b + c + z)')} as session, {r('z / (a + b + c + z)')} as repetition,
        {r(c01('0.28 + (case when af is not null then 0.2 else 0.0 end) + (case when ra is not null then 0.2 else 0.0 end) + (case when mv is not null then 0.12 else 0.0 end) + (case when en is not null then 0.1 else 0.0 end) + (case when rep > 0 then 0.06 else 0.0 end)'))} as confidence from t),
    o as (select *, list_reverse_sort([track, transition, session, repetition]) as v from s), q as (select *, case when {r('v[1] - v[2]', 6)} < 0.08 then 'uncertain' when track = v[1] then 'track' when transition = v[1] then 'transition' when session = v[1] then 'session' else 'repetition' end as dominant from o)
    select event_id, track, transition, session, repetition, confidence, dominant, confidence >= 0.6 and dominant = 'track' and track >= 0.45 as learn_track, confidence >= 0.6 and dominant = 'transition' and transition >= 0.45 as learn_transition from q""",
)
def feedback_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, unless = F.col("event_type"), lambda k, x: F.when(F.col("event_type") != k, x)
    found = evidence.feedback_causes(
        unless("error", F.col("k") * 500), unless("signup", F.col("u")), unless("view", _mapped(kind, _MOVES, "other")), F.col("value") > 150, unless("click", F.col("w") - F.col("d")), F.col("user_id") % 5
    )
    return _x(spark, sf_dir).select("event_id", found.alias("f")).select("event_id", "f.*")


_WEIGHTS = f"list_concat([{', '.join(map(str, evidence.GENOME_WEIGHTS))}]::double[], list_transform(range(0, 51), lambda i: 1.0::double))"


@query(
    "genome_similarity",
    f"""with v as (select vec_id, cast(embedding as double[]) as v from embeddings), p as (select a.vec_id, a.v as a, b.v as b, {_WEIGHTS} as w from v a join v b on b.vec_id = a.vec_id - a.vec_id % 100)
    select vec_id, {r(c01('1 - sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a[i] - b[i], 2) * w[i])) / list_sum(w))'), 6)} as similarity from p""",
)
def genome_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    seeds = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("seed"), F.col("a").alias("b"))
    met = v.join(seeds, F.col("seed") == F.col("vec_id") - F.col("vec_id") % 100)
    return met.select("vec_id", half_up(evidence.genome_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(
    "track_vectors",
    f"""select p_partkey, {r(f"1 * {c01('(60 + p_size * 2 - 70) / 70.0')} + 2 * (p_size / 50.0) + 3 * least(1.0, (p_partkey % 4) / 3.0) + 4 * ((p_partkey % 10) / 10.0) + 5 * {c01('(p_retailprice * 3 - 800) / 4200')} + 6 * {c01('(p_retailprice * 6 - 1000) / 11000')} + 7 * least(1.0, (p_partkey % 20) / 100.0 * 5) + 8 * {c01('(p_partkey % 9) / 20.0 / 0.4')} + 9 * cast(p_type = 'STANDARD' as int) + 11 * cast(p_type = 'ECONOMY' as int) + 13 * {c01('((p_partkey % 6) / 20.0 + 0.5 - 0.5) / 0.2')}", 6)} as mark from part""",
)
def track_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("p_partkey")
    genre = _mapped(c("p_type"), {"STANDARD": "edm", "ECONOMY": "pop"}, "unknown")
    v = evidence.track_vector(60 + c("p_size") * 2, c("p_size") / 50.0, k % 4, k % 10 / 10.0, c("p_retailprice") * 3, c("p_retailprice") * 6, k % 20 / 100.0, k % 9 / 20.0, genre, k % 6 / 20.0 + 0.5)
    mark = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "part").select("p_partkey", half_up(mark, 6).alias("mark"))


@query("serendipity", f"with {_X} select event_id, {r('u * w * d')} as score from x")
def serendipity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("event_id", evidence.serendipity(F.col("u"), F.col("w"), F.col("d")).alias("score"))


@query(
    "genre_evidence",
    """with p as (select p_partkey, 1500 + p_size * 60 as cen, (p_partkey % 20) / 100.0 as fl, (p_partkey % 10) / 10.0 as pu, p_size / 50.0 as en, p_partkey % 4 as da, case p_type when 'ECONOMY' then 'pop' when 'STANDARD' then 'edm' else 'unknown' end as told from part),
    h as (select *, case when pu < 0.3 and cen < 2900 then 'chill' when en < 0.32 and pu < 0.42 then 'chill' when pu >= 0.42 and cen < 2700 and fl < 0.09 then 'hiphop' when (cen >= 3100 or fl >= 0.14) and (en >= 0.6 or da >= 2 or pu >= 0.45) then 'edm' when cen >= 3400 or fl >= 0.18 then 'edm' when pu >= 0.3 then 'pop' else 'chill' end as heard from p)
    select p_partkey, heard, case when told <> 'unknown' then told else heard end as genre, cast(case when told <> 'unknown' and told = heard then 0.92 when told <> 'unknown' and told <> heard then 0.42 else 0.7 end as double) as confidence, told <> 'unknown' and told <> heard as conflicted from h""",
)
def genre_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("p_partkey")
    heard = evidence.genre_by_sound(1500 + c("p_size") * 60, k % 20 / 100.0, k % 10 / 10.0, c("p_size") / 50.0, k % 4)
    rows = table(spark, sf_dir, "part").select("p_partkey", heard.alias("heard"), _mapped(c("p_type"), {"ECONOMY": "pop", "STANDARD": "edm"}, "unknown").alias("told"))
    return rows.select("p_partkey", "heard", evidence.genre_evidence(c("told"), c("heard")).alias("g")).select("p_partkey", "heard", "g.*")


@query(
    "reconciled_tempi",
    f"""with p as (select p_partkey, 60.0::double + p_size * 3 as bpm, case when p_partkey % 7 <> 0 then 50.0::double + p_partkey % 220 end as hint, p_partkey % 4 as ph from part),
    f as (select *, coalesce(hint between 40 and 260, false) as ok, case when hint between 40 and 260 and hint / bpm > 1.75 and hint / bpm < 2.25 then 2.0 when hint between 40 and 260 and hint / bpm > 0.44 and hint / bpm < 0.57 then 0.5 else 1.0 end as factor from p)
    select p_partkey, case when ok then {r('bpm * factor', 1)} else bpm end as bpm, cast(factor as double) as factor, cast(case factor when 2.0 then ph * 2 % 4 when 0.5 then floor(ph / 2) else ph end as bigint) as phase from f""",
)
def reconciled_tempi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t = evidence.reconciled_tempo(60.0 + F.col("p_size") * 3, F.when(k % 7 != 0, 50.0 + k % 220), k % 4)
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.*")


def _ramp(a: float, b: float) -> str:
    x = c01(f"(value / 200 - {a}) / ({b} - {a})")
    return r(f"{x} * {x} * (3 - 2 * {x})", 6)


@query("band_gains", f"select event_id, {_ramp(0.46, 0.58)} as low, {_ramp(0.25, 0.7)} as mid, {_ramp(0.0, 0.45)} as high from events")
def band_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").select("event_id", evidence.band_gains(F.col("value") / 200).alias("g"))
    return g.select("event_id", *(half_up(f"g.{n}", 6).alias(n) for n in ("low", "mid", "high")))


@query(
    "signal_envelopes",
    f"""with w as (select vec_id, list_transform(range(0, 16), lambda k: sqrt(list_sum(list_transform(embedding[k * 4 + 1:k * 4 + 4], lambda x: cast(x as double) * cast(x as double))) / 4)) as v from embeddings),
    m as (select *, list_sum(v) / 16 as mean, list_sort(v)[16] as peak, list_sort(v)[13] as level from w),
    e as (select *, coalesce(list_max(list_filter(range(0, 16), lambda k: v[k + 1] >= level * 0.45)), 0) as la, coalesce(list_min(list_filter(range(0, 16), lambda k: v[k + 1] >= level * 0.5)), 15) as fi from m)
    select vec_id, {r('least(1.0, mean / 0.2)', 6)} as energy, {r(c01('((case when mean > 1e-6 then peak / mean else 1.0 end) - 1) / 2'), 6)} as punch, cast(case when level <= 1e-4 or la >= 14 then 16 else la + 1 end as bigint) as musical_end,
           {r('case when level <= 1e-4 or fi <= 1 then 0.0 else least(fi, 16 / 3.0) end', 6)} as intro from e""",
)
def signal_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rms = table(spark, sf_dir, "embeddings").select("vec_id", evidence.loudness_windows(F.col("embedding"), 4).alias("rms"))
    return rms.select("vec_id", evidence.envelope(F.col("rms")).alias("e")).select("vec_id", "e.*")


@query(
    "constrained_beats",
    f"""with {_X}, c as (select k, arg_min(1 + d, event_id) filter (where event_type = 'signup') as scale, arg_min(e, event_id) filter (where event_type = 'error') as anchor, count(*) filter (where event_type in ('signup', 'error')) as n from x group by 1)
    select event_id, {r('(60 + user_id) * coalesce(scale, 1.0)')} as bpm, {r('coalesce(anchor, e)')} as phase, {r('least(0.99, w + n * 0.05)')} as confidence from x join c using (k) where event_type = 'view'""",
)
def constrained_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    first = lambda kind, v: F.min_by(v, F.when(F.col("event_type") == kind, F.col("event_id")))
    has = lambda kind: F.max(F.col("event_type") == kind)
    c = x.groupBy("k").agg(
        F.when(has("signup"), first("signup", 1 + F.col("d"))).alias("scale"), F.when(has("error"), first("error", F.col("e"))).alias("anchor"), F.count_if(F.col("event_type").isin("signup", "error")).alias("n")
    )
    met = x.where("event_type = 'view'").join(c, "k")
    return met.select(
        "event_id", half_up((60 + F.col("user_id")) * F.coalesce("scale", F.lit(1.0))).alias("bpm"), half_up(F.coalesce("anchor", "e")).alias("phase"), half_up(F.least(F.lit(0.99), F.col("w") + F.col("n") * 0.05)).alias("confidence")
    )


@query("dj_pulse", f"with {_X}, b as ({_best('k', 'u', 'event_id', '60 + user_id as bpm')}) select k, coalesce((select max(100 + y.user_id) from x y where y.k = b.k and y.event_type = 'signup' and y.value > 195), bpm) as grid from b")
def dj_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir).withColumn("bpm", 60 + F.col("user_id"))
    wanted = x.where("event_type = 'signup' and value > 195").groupBy("k").agg(F.max(100 + F.col("user_id")).alias("wanted"))
    return studies.leading(x, ["k"], "u", "event_id", ["bpm"]).join(wanted, "k", "left").select("k", F.coalesce("wanted", "bpm").alias("grid"))


@query("beat_consensus", f"with {_X} select k, {r(c01('avg(u) * (1 - (max(e) - min(e)) / 2)'))} as confidence, count(distinct event_type) as sources from x group by 1")
def beat_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = clamp((F.max("e") - F.min("e")) / 2)
    return _x(spark, sf_dir).groupBy("k").agg(half_up(clamp(F.avg("u") * (1 - spread))).alias("confidence"), F.countDistinct("event_type").alias("sources"))


_PROVIDERS = {"purchase": "dj-correction", "signup": "user-correction", "click": "official-metadata", "view": "provider-analysis", "error": "own-model"}
_TRUST = _case("event_type", {k: studies.PROVENANCE[v] for k, v in _PROVIDERS.items()}, 0.0)


@query("provenance_choice", f"with {_X}, b as ({_best('k', f'{_TRUST} * u', 'event_id', 'event_id')}) select k, event_id, {r('score')} as confidence from b")
def provenance_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = studies.looked_up(_mapped(F.col("event_type"), _PROVIDERS), studies.PROVENANCE, 0.0)
    return studies.leading(_x(spark, sf_dir).withColumn("s", trust * F.col("u")), ["k"], "s", "event_id", ["event_id"]).select("k", "event_id", half_up("score").alias("confidence"))


@query("clean_regions", f"with {_X}, b as ({_best('user_id', 'w', 'event_id', 'event_id', 'w >= 0.2')}) select user_id, event_id, score from b")
def clean_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.leading(_x(spark, sf_dir), ["user_id"], "w", "event_id", ["event_id"], F.col("w") >= 0.2)


@query("mix_patterns", f"with {_X}, t as (select *, k % 5 as intro from x), b as ({_best('event_type, intro', 'u', 'event_id', 'event_id', source='t')}) select event_type as outro, intro, event_id, score as quality from b")
def mix_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = studies.leading(_x(spark, sf_dir).withColumn("intro", F.col("k") % 5), ["event_type", "intro"], "u", "event_id", ["event_id"])
    return found.select(F.col("event_type").alias("outro"), "intro", "event_id", F.col("score").alias("quality"))


@query("weighted_grid_error", f"with {_X} select k, {r('sum(u * d) / greatest(2.220446049250313e-16, sum(d))')} as error from x group by 1")
def weighted_grid_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).groupBy("k").agg(half_up(F.sum(F.col("u") * F.col("d")) / F.greatest(F.lit(2.220446049250313e-16), F.sum("d"))).alias("error"))


@query("credit_discovery", f"with {_X} select distinct event_type as role, user_id as creator from x where value > 50")
def credit_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).where("value > 50").select(F.col("event_type").alias("role"), F.col("user_id").alias("creator")).distinct()


_SIGNALS = {"view": "passive-stream", "click": "completion", "purchase": "concert-merch", "signup": "repeat", "error": "artist-page"}


@query(
    "artist_stages",
    f"""with {_X}, s as (select c_custkey as user_id, c_custkey % 5 as spot, (c_custkey % 10) / 10.0::double as affinity, (c_custkey % 4) / 4.0::double as confidence from customer),
    g as (select user_id, sum({_case('event_type', {k: studies.ARTIST_SIGNALS[v] for k, v in _SIGNALS.items()}, 0)}) as w, count(*) filter (where event_type = 'signup') as again, count(*) as n from x group by 1),
    v as (select s.*, {c01('coalesce(w, 0) / 100.0')} as v, coalesce(again, 0) as again, coalesce(n, 0) as n from s left join g using (user_id))
    select user_id, [{', '.join(repr(s) for s in studies.STAGES)}][cast(least(4, spot + case when v >= 0.6 then 2 when v >= 0.2 then 1 else 0 end) + 1 as int)] as stage, {r(c01('affinity + v * 0.2'))} as affinity, {r(c01('again * 0.1'))} as repeats, {r(c01('confidence + n * 0.03'))} as confidence, {r('v')} as relationship from v""",
)
def artist_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    was = table(spark, sf_dir, "customer").select(k.alias("user_id"), F.element_at(F.array(*map(F.lit, studies.STAGES)), (k % 5 + 1).cast("int")).alias("stage"), (k % 10 / 10.0).alias("affinity"), (k % 4 / 4.0).alias("confidence"))
    return studies.artist_stages(_x(spark, sf_dir).withColumn("signal", _mapped(F.col("event_type"), _SIGNALS)), "user_id", "signal", was)


@query("dominant_attribution", f"with {_X} select event_id, case when u >= greatest(w, d, e) then 'intent' when w >= greatest(d, e) then 'novelty' when d >= e then 'history' else 'crowd' end as source from x")
def dominant_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("event_id", evidence.largest({"intent": F.col("u"), "novelty": F.col("w"), "history": F.col("d"), "crowd": F.col("e")}).alias("source"))


@query("fidelity_bench", f"with {_X} select event_type as name, {r('avg(w)')} as score, {r('avg(w)')} >= 0.8 as passed from x group by 1")
def fidelity_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(half_up(F.avg("w")).alias("score"))
    return g.select("name", "score", (F.col("score") >= 0.8).alias("passed"))


@query(
    "codec_risks",
    f"""with p as (select p_brand as codec, avg(p_partkey % 700) as de, avg(p_size * 20) as pa, avg((p_retailprice - 950) / 100) as lo, avg((p_partkey % 5) / 10.0) as pe, avg(p_size / 60.0) as tr, avg((p_partkey % 11) / 20.0) as sp from part group by 1)
    select codec, {r(f"{c01('abs(de) / 1024')} * 0.15 + {c01('abs(pa) / 1024')} * 0.1 + {c01('abs(lo)')} * 0.15 + {c01('abs(pe)')} * 0.2 + {c01('tr')} * 0.2 + {c01('sp')} * 0.2")} as risk from p""",
)
def codec_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = {"delay": k % 700, "padding": F.col("p_size") * 20, "loudness": (F.col("p_retailprice") - 950) / 100, "peak": k % 5 / 10.0, "transient": F.col("p_size") / 60.0, "spectral": k % 11 / 20.0}
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("codec")).agg(*(F.avg(x).alias(n) for n, x in parts.items()))
    return g.select("codec", evidence.codec_risk(**{n: F.col(n) for n in parts}).alias("risk"))


@query(
    "tempo_families",
    f"""with p as (select p_partkey, 40.0::double + p_size * 3 as det, case when p_partkey % 3 <> 0 then 90.0::double + p_partkey % 60 end as prior, (p_partkey % 10) / 10.0::double as st from part),
    o as (select p_partkey, det, prior, unnest([0, 1, 2]) as kk, unnest([det, det * 2, det / 2]) as v, st from p), q as (select *, row_number() over (partition by p_partkey order by {r('abs(v - prior) * st + abs(v - det) * (1 - st)', 9)}, kk) as nth, count(*) over (partition by p_partkey) as n from o where v between 45 and 220)
    select p.p_partkey, {r('case when p.prior is null then p.det else q.v end')} as canonical, coalesce(q.n, 0) - (case when p.prior is not null or p.det between 45 and 220 then 1 else 0 end) as others from p left join q on p.p_partkey = q.p_partkey and nth = 1""",
)
def tempo_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t = evidence.tempo_family(40.0 + F.col("p_size") * 3, F.when(k % 3 != 0, 90.0 + k % 60), k % 10 / 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.canonical", F.size("t.alternatives").cast("long").alias("others"))


@query("sync_quality", f"with {_X} select event_id, case when u <= least(w, d, e) then 'tempo' when w <= least(d, e) then 'phase' when d <= e then 'phrase' else 'bar' end as weakest, u >= 0.7 and w >= 0.7 and d >= 0.7 and e >= 0.7 as blend_ready from x")
def sync_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = evidence.sync_quality({"tempo": F.col("u"), "phase": F.col("w"), "phrase": F.col("d"), "bar": F.col("e")})
    return _x(spark, sf_dir).select("event_id", q.alias("q")).select("event_id", "q.*")


@query("catalog_access", f"with {_X}, b as ({_best('k', 'u - d', 'event_id', 'event_id', chr(39).join(['event_type <> ', 'error', ' and event_type <> ', 'view', '']))}) select k, event_id, score from b")
def catalog_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).withColumn("s", F.col("u") - F.col("d"))
    return studies.leading(rows, ["k"], "s", "event_id", ["event_id"], ~F.col("event_type").isin("error", "view"))


@query(
    "counterfactual_taste",
    f"""with {_X}, g as (select user_id, {r("coalesce(avg(u) filter (where event_type = 'view'), 0.0)")} as consumption, {r("coalesce(avg(u) filter (where event_type = 'purchase'), 0.0)")} as voluntary, {r("coalesce(avg(u) filter (where event_type = 'click'), 0.0)")} as recommended, count(*) filter (where event_type in ('view', 'purchase', 'click')) as n from x group by 1)
    select user_id, consumption, voluntary, recommended, {r(c01('recommended - voluntary'))} as exposure_risk, {r('least(1.0, n / 20.0)')} as confidence from g""",
)
def counterfactual_taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: half_up(F.coalesce(F.avg(F.when(F.col("event_type") == kind, F.col("u"))), F.lit(0.0)))
    g = _x(spark, sf_dir).groupBy("user_id").agg(of("view").alias("consumption"), of("purchase").alias("voluntary"), of("click").alias("recommended"), F.count_if(F.col("event_type").isin("view", "purchase", "click")).alias("n"))
    return g.select("user_id", "consumption", "voluntary", "recommended", half_up(clamp(F.col("recommended") - F.col("voluntary"))).alias("exposure_risk"), half_up(F.least(F.lit(1.0), F.col("n") / 20.0)).alias("confidence"))


@query(
    "genre_chart",
    f"""with p as (select p_partkey, (p_retailprice - 900) / 100 as base, case when p_type = 'ECONOMY' then (p_partkey % 10) / 10.0 when p_partkey % 3 = 0 then 0.5 else 0.0 end as conf from part), s as (select p_partkey, {r(f"{c01('base')} * {c01('conf')}")} as score, {r(c01('conf'))} as confidence from p)
    select * from s where confidence > 0 order by score desc, p_partkey limit 100""",
)
def genre_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    named = F.array(F.struct(F.col("p_type").alias("genre"), (k % 10 / 10.0).alias("confidence")), F.struct(F.when(k % 3 == 0, F.lit(" Economy ")).otherwise("other").alias("genre"), F.lit(0.5).alias("confidence")))
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_retailprice") - 900) / 100).alias("base"), named.alias("genres"))
    first = F.get(F.filter("genres", lambda g: F.lower(F.trim(g["genre"])) == "economy"), F.lit(0))["confidence"]
    confidence = clamp(F.coalesce(first, F.lit(0.0)))
    scored = rows.select("p_partkey", half_up(clamp("base") * confidence).alias("score"), half_up(confidence).alias("confidence"))
    return scored.where("confidence > 0").orderBy(F.desc("score"), "p_partkey").limit(100)


@query(
    "constraint_choice",
    f"""with {_X}, s as (select *, u * 0.24 + (1 - d) * 0.14 + (1 - e) * 0.16 + (1 - w) * 0.12 + w * 0.14 + u * 0.2 as s from x), b as ({_best('k', 's', 'event_id', 'event_id', chr(39).join(['event_type <> ', 'error', '']), source='s')}), n as (select k, count(*) as n from x group by 1)
    select n.k, event_id as selected, n - case when event_id is null then 0 else 1 end as rejected from n left join b on n.k = b.k""",
)
def constraint_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, w, d, e = (F.col(c) for c in "uwde")
    x = _x(spark, sf_dir).withColumn("s", u * 0.24 + (1 - d) * 0.14 + (1 - e) * 0.16 + (1 - w) * 0.12 + w * 0.14 + u * 0.2)
    won = studies.leading(x, ["k"], "s", "event_id", ["event_id"], F.col("event_type") != "error")
    met = x.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(won, "k", "left")
    return met.select("k", F.col("event_id").alias("selected"), (F.col("n") - F.when(F.col("event_id").isNull(), 0).otherwise(1)).alias("rejected"))


@query(
    "group_utility",
    f"""with {_X} select k, {r('min(u)')} as least_misery, {r('max(u)')} as most_pleasure, {r("count(*) filter (where event_type <> 'error') * 1.0 / count(*)")} as approval, {r('sum(u * (1 + d)) / sum(1 + d)')} as fair_share, {r('sum(u * (user_id % 3)) / greatest(1.0, sum(user_id % 3))')} as consensus, {r('avg(u)')} as average from x group by 1""",
)
def group_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select("k", F.col("u").alias("utility"), (F.col("event_type") != "error").alias("approved"), F.col("d").alias("debt"), (F.col("user_id") % 3).cast("double").alias("weight"))
    return studies.group_utility(rows, "k")


@query("fairness_gap", f"with {_X}, g as (select user_id, avg(w) as b, avg(u) filter (where event_type = 'purchase') as p from x group by 1) select user_id, {r('b')} as computed, {r('p')} as perceived, {r('abs(b - p)')} as gap from g")
def fairness_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.fairness_gap(_x(spark, sf_dir).withColumn("report", F.when(F.col("event_type") == "purchase", F.col("u"))), "user_id", "w", "report")


@query(
    "genre_bias",
    f"""with {_X}, g as (select k % 10 as genre, count(*) as n, avg(w) as v, avg(d) as a from x group by 1), s as (select *, (v + a) / 2 as err, max(n) over () * 1.0 / sum(n) over () as share from g)
    select genre, {r(c01('(1 - err) * (1 - greatest(0.0, share - 0.5) * 0.6)'))} as multiplier, {r('share')} as dominance, share > 0.65 or err > 0.3 as cross_validate from s""",
)
def genre_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).groupBy((F.col("k") % 10).alias("genre")).agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("v"), F.avg("d").alias("a"))
    return studies.genre_bias(g, "genre", "n", "v", "a")


@query(
    "milestone_progress",
    f"""with p as (select distinct p_brand as brand, p_size as capability from part), d as (select distinct p_size as capability from part where p_retailprice > 980), m as (select brand, count(*) as total, count(d.capability) as complete from p left join d using (capability) group by 1)
    select brand, complete, total, {r('complete * 1.0 / total', 6)} as ratio, total - complete as missing from m""",
)
def milestone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return studies.milestones(p.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("capability")), p.where("p_retailprice > 980").select(F.col("p_size").alias("capability")), "brand", "capability")


@query(
    "discovery_personality",
    f"""with {_X}, g as (select user_id, avg(u) filter (where event_type = 'click') as s, avg(w) filter (where event_type = 'purchase') as a, count(*) filter (where event_type in ('click', 'purchase')) as n from x group by 1), f as (select user_id, n, coalesce(s, 0.5) as s, coalesce(a, s, 0.5) as a from g)
    select user_id, {r('1 - (s * 0.55 + a * 0.45)')} as familiarity, {r('s * 0.55 + a * 0.45')} as diversity, {r('a')} as tolerance, {r(c01('n / 12.0'))} as confidence from f""",
)
def discovery_personality(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, x: F.when(F.col("event_type") == kind, F.col(x))
    return studies.discovery_personality(_x(spark, sf_dir).withColumns({"slider": of("click", "u"), "accepted": of("purchase", "w")}), "user_id", "slider", "accepted")


@query(
    "energy_zones",
    f"""with {_X}, b as ({_best('user_id', 'd * w', 'event_id', 'u', 'w >= 0.3')}), g as (select user_id, count(*) filter (where w >= 0.3) as n, avg(w) filter (where w >= 0.3) as c from x group by 1)
    select g.user_id, case when n > 0 then {r(c01('u - 0.12'))} else 0.55 end as low, case when n > 0 then {r(c01('u + 0.12'))} else 0.78 end as high, case when n > 0 then {r('u')} else 0.68 end as peak, case when n > 0 then {r(c01('n / 12.0 * c'))} else 0.15 end as confidence from g left join b on g.user_id = b.user_id""",
)
def energy_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.energy_zones(_x(spark, sf_dir), "user_id", "u", "d", "w", "event_id")


@query("stem_mosaic", f"with {_X}, t as (select *, k % 4 as role from x), b as ({_best('user_id, role', 'w * 0.6 + e * 0.4', 'event_id', 'event_id', source='t')}) select user_id, role, event_id, score from b")
def stem_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).withColumns({"role": F.col("k") % 4, "s": F.col("w") * 0.6 + F.col("e") * 0.4})
    return studies.leading(rows, ["user_id", "role"], "s", "event_id", ["event_id"])


@query(
    "bridge_genres",
    f"""with {_X}, t as (select user_id % 25 as grp, user_id, event_type as genre, max(u) as v from x group by 1, 2, 3), m as (select grp, count(distinct user_id) as members from t group by 1), g as (select grp, genre, min(v) as lo, max(v) as hi, count(distinct user_id) as n from t group by 1, 2)
    select grp, genre from g join m using (grp) where n = members and lo >= 0.35 and hi >= 0.65""",
)
def bridge_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _x(spark, sf_dir).groupBy((F.col("user_id") % 25).alias("grp"), "user_id", F.col("event_type").alias("genre")).agg(F.max("u").alias("v"))
    return studies.bridge_genres(t, "grp", "user_id", "genre", "v")


_STATES = {"view": "ready", "click": "running", "purchase": "ready", "signup": "not-required", "error": "failed"}


@query(
    "readiness",
    f"""with {_X}, t as (select *, {_case('event_type', {k: repr(v) for k, v in _STATES.items()}, repr('ready'))} as st, case when event_type <> 'signup' then k * 10 end as rem from x),
    g as (select user_id, bool_and(st in ('ready', 'not-required')) as alls, bool_or(st = 'failed') as fails, bool_or(st = 'running') as runs, min(u) as p, max(rem) as m, min(w) as c, arg_min(u, event_id) filter (where st = 'failed') as fp, arg_min(rem, event_id) filter (where st = 'failed') as fm, arg_min(w, event_id) filter (where st = 'failed') as fc from t group by 1)
    select user_id, case when alls then 'ready' when fails then 'failed' when runs then 'running' else 'not-started' end as status, {r('case when alls then 1.0 when fails then fp else p end')} as progress, cast(case when alls then 0 when fails then fm else m end as bigint) as remaining_ms, {r('case when alls then 1.0 when fails then fc else c end')} as confidence from g""",
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select(
        "user_id", "event_id", _mapped(F.col("event_type"), _STATES, "ready").alias("status"), F.col("u").alias("progress"), F.when(F.col("event_type") != "signup", F.col("k") * 10).alias("remaining_ms"), F.col("w").alias("confidence")
    )
    return studies.readiness(rows, "user_id", "event_id")


@query("moment_choice", f"with {_X}, b as ({_best('k', c01('u * 0.25 + w * 0.35 + d * 0.18 + e * 0.22'), 'event_id', 'event_id')}) select k, event_id, {r('score')} as score from b")
def moment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clamp(F.col("u") * 0.25 + F.col("w") * 0.35 + F.col("d") * 0.18 + F.col("e") * 0.22)
    return studies.leading(_x(spark, sf_dir).withColumn("s", s), ["k"], "s", "event_id", ["event_id"]).select("k", "event_id", half_up("score").alias("score"))


@query(
    "section_intents",
    f"""with {_X}, g as (select user_id, min(k) filter (where u >= 0.8 and w >= 0.45) as starts, max(d) as energy from x group by 1)
    select user_id, case when starts <= 45 then 'wait-current-track' else 'replace-track' end as action, {r('case when starts <= 45 then starts / 45.0 else abs(0.8 - energy) end')} as cost from g""",
)
def section_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).groupBy("user_id").agg(F.min(F.when((F.col("u") >= 0.8) & (F.col("w") >= 0.45), F.col("k"))).alias("starts"), F.max("d").alias("energy"))
    waits = F.coalesce(F.col("starts") <= 45, F.lit(False))
    return g.select("user_id", F.when(waits, "wait-current-track").otherwise("replace-track").alias("action"), half_up(F.when(waits, F.col("starts") / 45.0).otherwise(F.abs(0.8 - F.col("energy")))).alias("cost"))


_TERMS = " + ".join(f"(p_partkey * {i + 2} % 11) / 10.0 * {w}" if False else f"least(1.0, (p_partkey * {i + 2} % 11) / 10.0) * {w}" for i, w in enumerate(evidence.SEMANTIC.values()))


@query("semantic_similarity", f"select p_partkey, {r(_TERMS)} as total from part")
def semantic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {n: (F.col("p_partkey") * (i + 2) % 11) / 10.0 for i, n in enumerate(evidence.SEMANTIC)}
    return table(spark, sf_dir, "part").select("p_partkey", evidence.semantic_similarity(parts)["total"].alias("total"))


@query(
    "embedding_affinity",
    f"""with v as (select vec_id, cast(embedding as double[]) as v from embeddings), t as (select a.vec_id, a.v as track, b.v as u, c.v as c from v a join v b on b.vec_id = a.vec_id - a.vec_id % 100 join v c on c.vec_id = a.vec_id - a.vec_id % 10)
    select vec_id, {r(c01('(list_cosine_similarity(list_transform(range(1, 65), lambda i: (u[i] + c[i] * 2) / 3 * 0.6 + c[i] * 0.4), track) + 1) / 2'), 6)} as affinity from t""",
)
def embedding_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("track"))
    named = lambda by, name: v.where(F.col("vec_id") % by == 0).select(F.col("vec_id").alias(f"{name}_id"), F.col("track").alias(name))
    near = lambda by, name: F.col(f"{name}_id") == F.col("vec_id") - F.col("vec_id") % by
    met = v.join(named(100, "lasting"), near(100, "lasting")).join(named(10, "session"), near(10, "session"))
    user = evidence.layered_vector([(F.col("lasting"), 1.0), (F.col("session"), 2.0)])
    return met.select("vec_id", evidence.embedding_affinity(user, F.col("session"), F.col("track")).alias("affinity"))


@query("transition_evidence", f"with {_X} select k, {r('sum(u * w) / greatest(1.0, sum(w))')} as expected from x group by 1")
def transition_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).groupBy("k").agg(half_up(F.sum(F.col("u") * F.col("w")) / F.greatest(F.lit(1.0), F.sum("w"))).alias("expected"))


_GIVEN = {"intent": "u - 0.3", "novelty": "w - 0.3", "history": "d - 0.5", "crowd": "e - 0.5"}


@query(
    "decision_reasons",
    f"""with {_X}, o as (select event_id, unnest([{', '.join(repr(n) for n in _GIVEN)}]) as n, unnest([0, 1, 2, 3]) as i, unnest([{', '.join(r(v, 9) for v in _GIVEN.values())}]) as v from x), t as (select *, row_number() over (partition by event_id order by v desc, i) as nth from o where v > 0)
    select x.event_id, coalesce(string_agg(n, ', ' order by nth), '') as reasons from x left join t on x.event_id = t.event_id and nth <= 3 group by 1""",
)
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"intent": F.col("u") - 0.3, "novelty": F.col("w") - 0.3, "history": F.col("d") - 0.5, "crowd": F.col("e") - 0.5}
    return _x(spark, sf_dir).select("event_id", evidence.reasons(parts).alias("reasons"))


@query("counterfactual_mix", f"with {_X}, b as ({_best('user_id', 'u - w - d * 0.1', 'event_id', 'event_id')}) select * from b")
def counterfactual_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.leading(_x(spark, sf_dir).withColumn("s", F.col("u") - F.col("w") - F.col("d") * 0.1), ["user_id"], "s", "event_id", ["event_id"])


@query("semantic_journey", f"with {_X} select user_id, count(*) as points, count(*) = count(distinct k) as valid from x group by 1")
def semantic_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sorted positions rise strictly if none comes twice
    per = _x(spark, sf_dir).groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("user_id").agg(F.sum("n").alias("points"), (F.max("n") == 1).alias("valid"))


@query(
    "semantic_vocabulary",
    f"with {_X} select k, {r("coalesce(arg_min(u, event_id) filter (where event_type = 'signup'), avg(u))", 6)} as arousal, {r("coalesce(arg_min(w, event_id) filter (where event_type = 'signup'), avg(w))", 6)} as warmth from x group by 1",
)
def semantic_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.col("event_type") == "signup"
    first = lambda c: F.min(F.when(told, F.struct("event_id", c)))[c]
    return _x(spark, sf_dir).groupBy("k").agg(half_up(F.coalesce(first("u"), F.avg("u")), 6).alias("arousal"), half_up(F.coalesce(first("w"), F.avg("w")), 6).alias("warmth"))


@query(
    "grounded_reasons",
    f"""with {_X}, o as (select event_id, unnest(['sound', 'mood']) as n, unnest([0, 1]) as i, unnest([u, d]) as s, unnest([e, u]) as c, unnest([event_type <> 'error', k % 2 = 0]) as g from x), t as (select *, {r('s * c', 9)} as v from o where g and c >= 0.6 and s >= 0.6)
    select x.event_id, coalesce(string_agg(n, ',' order by v desc, i), '') as reasons from x left join t on x.event_id = t.event_id group by 1""",
)
def grounded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"sound": (F.col("u"), F.col("e"), F.col("event_type") != "error"), "mood": (F.col("d"), F.col("u"), F.col("k") % 2 == 0)}
    return _x(spark, sf_dir).select("event_id", evidence.grounded_reasons(parts).alias("reasons"))


@query("stem_bake_off", f"with {_X}, b as ({_best('k', r('u * 0.45 + w * 0.55'), 'event_id', 'event_id')}) select * from b")
def stem_bake_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.leading(_x(spark, sf_dir).withColumn("s", half_up(F.col("u") * 0.45 + F.col("w") * 0.55)), ["k"], "s", "event_id", ["event_id"])


@query("decision_shares", f"with {_X} select k, event_type, {r('sum(u) / greatest(2.220446049250313e-16, sum(sum(u)) over (partition by k))')} as share from x group by 1, 2")
def decision_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _x(spark, sf_dir).groupBy("k", "event_type").agg(F.sum(F.greatest(F.lit(0.0), "u")).alias("w"))
    total = per.groupBy("k").agg(F.greatest(F.lit(2.220446049250313e-16), F.sum("w")).alias("t"))
    return per.join(total, "k").select("k", "event_type", half_up(F.col("w") / F.col("t")).alias("share"))


@query(
    "exploration_bridges",
    f"with {_X}, b as ({_best('k', 'u * 0.45 + w * 0.45 + d * 0.1', 'event_id', 'event_id', chr(39).join(['event_type <> ', 'error', '']))}) select k, case when score >= 0.55 then event_id end as bridge, {r('score')} as score, score >= 0.55 as bridge_used from b",
)
def exploration_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("u") * 0.45 + F.col("w") * 0.45 + F.col("d") * 0.1
    found = studies.leading(_x(spark, sf_dir).withColumn("s", s), ["k"], "s", "event_id", ["event_id"], F.col("event_type") != "error")
    used = F.col("score") >= 0.55
    return found.select("k", F.when(used, F.col("event_id")).alias("bridge"), half_up("score").alias("score"), used.alias("bridge_used"))


@query("sanitized_contributions", f"select vec_id, cast(32 as bigint) as dims, {r('list_sum(list_transform(embedding[1:32], lambda x: greatest(-1.0, least(1.0, cast(x as double) * 8))))', 6)} as mass from embeddings")
def sanitized_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.transform(F.slice("embedding", 1, 32), lambda x: clamp(x.cast("double") * 8, -1.0, 1.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(kept).cast("long").alias("dims"), half_up(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), 6).alias("mass"))


@query("intent_overlaps", f"with {_X} select user_id, count(*) filter (where event_type = 'view') - count(distinct k) filter (where event_type = 'view') as overlaps from x group by 1")
def intent_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = F.when(F.col("event_type") == "view", F.col("k"))
    return _x(spark, sf_dir).groupBy("user_id").agg((F.count(timed) - F.countDistinct(timed)).alias("overlaps"))


_ROLES = {"bass": "view", "vocals": "click", "drums": "purchase", "lead": "signup"}


@query(
    "role_ownership",
    f"""with {_X}, g as (select k, {', '.join(f"{r(f"coalesce(avg(least(u, d)) filter (where event_type = '{t}'), 0.0)")} as {n}" for n, t in _ROLES.items())} from x group by 1) select *, {r(c01('1 - (bass + vocals + drums + lead) / 4'))} as smoothness from g""",
)
def role_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.least("u", "d")
    g = _x(spark, sf_dir).groupBy("k").agg(*(half_up(F.coalesce(F.avg(F.when(F.col("event_type") == t, both)), F.lit(0.0))).alias(n) for n, t in _ROLES.items()))
    return g.select("*", half_up(clamp(1 - (F.col("bass") + F.col("vocals") + F.col("drums") + F.col("lead")) / 4)).alias("smoothness"))


@query(
    "timbral_continuity",
    f"""with v as (select vec_id, cast(embedding as double[]) as v from embeddings), t as (select a.vec_id, a.v as a, b.v as b from v a join v b on b.vec_id = a.vec_id - a.vec_id % 10), s as (select vec_id, {c01('list_sum(list_transform(range(1, 17), lambda i: abs(a[i] * 4 - case when i <= 12 then b[i] * 4 else 0.0 end))) / 16')} as s from t)
    select vec_id, {r('1 - s')} as continuity, {r('s')} as shock, s > 0.35 as compensated from s""",
)
def timbral_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = lambda c, n: F.transform(F.slice(c, 1, n), lambda x: x.cast("double") * 4)
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    seeds = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("seed"), F.col("a").alias("b"))
    met = v.join(seeds, F.col("seed") == F.col("vec_id") - F.col("vec_id") % 10)
    return met.select("vec_id", evidence.timbral_continuity(scaled("a", 16), scaled("b", 12)).alias("t")).select("vec_id", "t.*")


@query("experience_morph", f"with {_X} select event_id, {r(c01('u + (w - u) * least(d, 0.3)'))} as energy, {r(c01('e + (d - e) * least(d, 0.3)'))} as calm from x")
def experience_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.least(F.col("d"), F.lit(0.3))
    as_map = lambda a, b: F.create_map(F.lit("energy"), F.col(a), F.lit("calm"), F.col(b))
    morphed = F.map_zip_with(as_map("u", "e"), as_map("w", "d"), lambda k, x, y: clamp(x + (y - x) * weight))
    return _x(spark, sf_dir).select("event_id", morphed.alias("m")).select("event_id", half_up(F.col("m")["energy"]).alias("energy"), half_up(F.col("m")["calm"]).alias("calm"))


@query("nearest_beats", f"with {_X} select event_id, {r('d / 2 + floor((value - d / 2) / 0.5 + 0.5) * 0.5', 6)} as beat from x")
def nearest_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.col("d") / 2
    return _x(spark, sf_dir).select("event_id", half_up(phase + F.floor((F.col("value") - phase) / 0.5 + 0.5) * 0.5, 6).alias("beat"))


@query("era_affinity", f"with {_X}, s as (select user_id % 10 as artist, k % 6 as era, arg_min(u, event_id) as a from x where event_type = 'signup' group by 1, 2) select event_id, {r('coalesce(a, 0.5)')} as affinity from x left join s on s.artist = x.user_id % 10 and s.era = x.k % 6")
def era_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir).withColumns({"artist": F.col("user_id") % 10, "era": F.col("k") % 6})
    known = x.where("event_type = 'signup'").groupBy("artist", "era").agg(F.min_by("u", "event_id").alias("a"))
    return x.join(known, ["artist", "era"], "left").select("event_id", half_up(F.coalesce("a", F.lit(0.5))).alias("affinity"))


@query("scene_roles", f"with {_X} select event_id, exists (select 1 from x y where y.event_type = 'error' and y.user_id = x.user_id and y.k % 4 = x.k % 4 and y.user_id % 3 = x.user_id % 3) as compatible from x where event_type = 'view'")
def scene_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir).withColumn("role", F.col("k") % 4)
    going = x.where("event_type = 'error'").select("user_id", "role").distinct().withColumn("ok", F.lit(True))
    return x.where("event_type = 'view'").join(going, ["user_id", "role"], "left").select("event_id", F.coalesce("ok", F.lit(False)).alias("compatible"))


@query("exposure_tiers", f"with {_X} select user_id, k % 5 as tier, {r('arg_max(u, event_id)')} as exposure from x group by 1, 2")
def exposure_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).groupBy("user_id", (F.col("k") % 5).alias("tier")).agg(half_up(F.max_by("u", "event_id")).alias("exposure"))


@query(
    "karaoke_queue",
    f"""with {_X}, q as (select k % 7 as session, event_id, k as track, user_id as singer, event_type = 'purchase' as prepared from x where event_type <> 'view'), f as (select * from (select *, row_number() over (partition by session, track order by event_id) as nth from q) where nth = 1)
    select session, event_id, row_number() over (partition by session order by exists (select 1 from x y where y.event_type = 'signup' and y.user_id = singer and y.value > 100), prepared desc, event_id) as place from f""",
)
def karaoke_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    asked = x.where("event_type <> 'view'").select((F.col("k") % 7).alias("session"), "event_id", F.col("k").alias("track"), F.col("user_id").alias("singer"), (F.col("event_type") == "purchase").alias("prepared"))
    return studies.karaoke_queue(asked, "session", "event_id", "track", "singer", "prepared", x.where("event_type = 'signup' and value > 100").select(F.col("user_id").alias("singer")))


@query(
    "coherence",
    f"""with p as (select p_partkey, p_brand as brand, case p_type when 'ECONOMY' then 'pop' when 'STANDARD' then 'edm' else 'unknown' end as genre, 100.0::double + p_size * 10 as dur, 80.0::double + p_size as bpm from part), s as (select brand, arg_min(genre, p_partkey) as sg, arg_min(dur, p_partkey) as sd, arg_min(bpm, p_partkey) as sb from p group by 1),
    h as (select p_partkey, brand, genre, dur, sg, sd, unnest([0, 1, 2, 3, 4]) as kk, unnest([1.0, 2.0, 0.5, 2.0 / 3, 1.5]) as m, unnest([1.0, 0.92, 0.92, 0.72, 0.72]) as prior, sb, bpm from p join s using (brand)),
    c as (select *, abs(sb / (bpm * m) - 1) as gap, exp(-pow(abs(sb / (bpm * m) - 1) / 0.08, 2)) * (prior * 0.55 + 0.6 * 0.45) as pl from h), n as (select *, row_number() over (partition by p_partkey order by pl desc, gap, kk) as nth from c)
    select p_partkey, {r(f"(case when sg <> 'unknown' and genre = sg then 0.65 else 0.0 end) + (case when gap <= 0.08 and pl >= (case when kk >= 3 then 0.62 else 0.55 end) then {r('pl')} else 0.0 end) + (case when greatest(dur, sd) / least(dur, sd) <= 1.5 then 1.0 when greatest(dur, sd) / least(dur, sd) >= 3 then -0.5 else 0.0 end)")} as score from n where nth = 1""",
)
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), _mapped(F.col("p_type"), {"ECONOMY": "pop", "STANDARD": "edm"}, "unknown").alias("genre"), (100.0 + F.col("p_size") * 10).alias("duration"), (80.0 + F.col("p_size")).alias("bpm"))
    first = F.min(F.struct("p_partkey", "genre", "duration", "bpm")).alias("s")
    seed = p.groupBy("brand").agg(first).select("brand", F.col("s.genre").alias("seed_genre"), F.col("s.duration").alias("seed_duration"), F.col("s.bpm").alias("seed_bpm"))
    return studies.coherence(p, seed, "brand", "genre", "duration", tempo_relation("seed_bpm", "bpm")).select("p_partkey", "score")


@query("session_curves", f"with {_X}, t as (select *, abs(u - d) as err from x), b as ({_best('user_id', 'err', 'event_id', 'event_type', source='t')}) select t.user_id, {r('avg(err)')} as mean_error, any_value(b.event_type) as worst from t join b on t.user_id = b.user_id group by 1")
def session_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _x(spark, sf_dir).withColumn("err", F.abs(F.col("u") - F.col("d")))
    worst = F.min(F.struct((-half_up("err", 9)).alias("o"), "event_id", "event_type"))["event_type"]
    return t.groupBy("user_id").agg(half_up(F.avg("err")).alias("mean_error"), worst.alias("worst"))


_COMINGS = {"view": "active", "click": "inactive", "purchase": "active", "signup": "joined", "error": "left"}


@query(
    "presence",
    f"""with {_X}, l as (select user_id, list({{'e': {_case('event_type', {k: repr(v) for k, v in _COMINGS.items()}, repr('active'))}, 'w': 0.0::double, 'p': true, 'j': at_ms, 'a': at_ms}} order by event_id) as l from x group by 1),
    f as (select user_id, list_reduce(l, lambda s, x: case when s.e = 'none' or x.e = 'joined' then {{'e': x.e, 'w': case when x.e = 'joined' then 0.15::double else 1.0::double end, 'p': x.e <> 'left', 'j': x.a, 'a': x.a}} when x.e = 'left' then {{'e': x.e, 'w': 0.0::double, 'p': false, 'j': s.j, 'a': x.a}}
        when x.e = 'inactive' then {{'e': x.e, 'w': {r('greatest(0.1::double, s.w * 0.65)')}, 'p': s.p, 'j': s.j, 'a': s.a}} else {{'e': x.e, 'w': {r('greatest(s.w, 0.15 + least(1.0, greatest(0.0, (x.a - s.j) / 300000.0)) * 0.85)')}, 'p': true, 'j': s.j, 'a': x.a}} end,
        {{'e': 'none', 'w': 0.0::double, 'p': true, 'j': 0::bigint, 'a': 0::bigint}}) as s from l)
    select user_id, s.w as weight, s.p as present, s.j as joined_ms, s.a as active_ms from f""",
)
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("event", _mapped(F.col("event_type"), _COMINGS, "active"))
    return studies.presence(rows, "user_id", ["event_id"], "event", "at_ms")


_LEVEL_OF = {"view": "hypothesis", "click": "experimental", "purchase": "supported", "signup": "established", "error": "hypothesis"}


@query(
    "evidence_confidence",
    f"""with {_X}, reg as (select k as item, arg_min(u, event_id) as c, arg_min(event_type, event_id) as t from x where value > 20 group by 1), req as (select distinct user_id, k as item from x),
    g as (select user_id, avg(c * {_case('t', {k: studies.LEVELS[v] for k, v in _LEVEL_OF.items()}, 0.25)}) as c, string_agg(distinct t, ',' order by t) as kinds, min({_case('t', {k: list(studies.LEVELS).index(v) for k, v in _LEVEL_OF.items()}, 0)}) as lv from req join reg using (item) group by 1)
    select user_id, {r('c')} as confidence, kinds, [{', '.join(repr(n) for n in studies.LEVELS)}][cast(lv + 1 as int)] as weakest from g""",
)
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    registry = x.where("value > 20").groupBy(F.col("k").alias("item")).agg(F.min_by("u", "event_id").alias("confidence"), F.min_by("event_type", "event_id").alias("kind"))
    registry = registry.withColumn("level", _mapped(F.col("kind"), _LEVEL_OF))
    return studies.evidence_confidence(x.select("user_id", F.col("k").alias("item")), registry, "user_id", "item")


@query("transport_recovery", f"with {_X} select k % 4 as qos, count(*) as stale, case when k % 4 >= 2 then count(*) else 0 end as dropped from x where u < 0.5 group by 1, k % 4")
def transport_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _x(spark, sf_dir).where("u < 0.5").groupBy((F.col("k") % 4).alias("qos")).agg(F.count(F.lit(1)).alias("stale"))
    return g.select("qos", "stale", F.when(F.col("qos") >= 2, F.col("stale")).otherwise(0).alias("dropped"))


_CAMELOT = "(p_partkey % 12 + 1) || case when p_size % 2 = 0 then 'A' else 'B' end"


@query(
    "transition_quality",
    f"""with {_X}, {_MOVE}, i as (select event_id, move, u * 400 - 150 as ms, w - 0.3 as delta, case when k % 5 = 0 then 'offline-cache' when k % 5 = 1 then 'offline-render' when k % 5 = 2 then 'live' else 'fallback' end as mode, k * 10 - 100 as slack, case when k % 2 = 0 then 'disabled' else 'late' end as reason, 1 + d / 10 as ra, 1 + e / 10 as rb,
        case when event_type = 'error' then w end as sk, event_type = 'click' as dis, k % 12 + 1 as n1, user_id % 12 + 1 as n2, e as kc from m),
    h as (select *, least(abs(n1 - n2), 12 - abs(n1 - n2)) as kd, greatest(abs(ra - 1), abs(rb - 1)) as wo from i),
    p as (select *, case when abs(ms) <= 30 then 100.0 when abs(ms) <= 80 then 92.0 when abs(ms) <= 150 then 75.0 when abs(ms) <= 300 then 55.0 else least(greatest(35 - (abs(ms) - 300) / 20, 0.0), 35.0) end as timing,
        case when kc < 0.35 then 72.0 when move in {evidence.HARD!r} then greatest(72.0, (case kd when 0 then 1.0 when 1 then 0.8 when 2 then 0.4 else 0.0 end) * 100) when move in {evidence.MASKING!r} then greatest(68.0, (case kd when 0 then 1.0 when 1 then 0.8 when 2 then 0.4 else 0.0 end) * 100) else (case kd when 0 then 1.0 when 1 then 0.8 when 2 then 0.4 else 0.0 end) * 100 end as harmonic,
        72.0 as tempo, least(greatest(100 - abs(delta - 0.08) * 220, 0.0), 100.0) as energy,
        case mode when 'offline-cache' then 100.0 when 'offline-render' then (case when slack >= 500 then 98.0 when slack >= 100 then 92.0 when slack >= 0 then 84.0 else 70.0 end) when 'live' then 86.0 else (case when reason = 'disabled' then 76.0 else 58.0 end) end as execution,
        case when wo <= 0.02 then 100.0 when wo <= 0.05 then 92.0 when wo <= 0.08 then 82.0 when wo <= 0.12 then 62.0 else 40.0 end as stretch, case when sk is not null then least(greatest(100 - sk * 100, 0.0), 100.0) when dis then 72.0 else 100.0 end as feedback from h),
    s as (select *, {r('least(greatest(timing * 0.24 + harmonic * 0.15 + tempo * 0.17 + energy * 0.1 + execution * 0.18 + stretch * 0.06 + feedback * 0.1, 0.0), 100.0)', 1)} as score from p)
    select event_id, score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 55 then 'D' else 'F' end as grade, {', '.join(f'{r(n, 1)} as {n}' for n in evidence.QUALITY)} from s""",
)
def transition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    ring = lambda x: F.concat((x % 12 + 1).cast("string"), F.lit("A"))
    mode = F.when(k % 5 == 0, "offline-cache").when(k % 5 == 1, "offline-render").when(k % 5 == 2, "live").otherwise("fallback")
    none = F.lit(None).cast("double")
    q = evidence.transition_quality(
        _mapped(kind, _MOVES, "other"), F.col("u") * 400 - 150, (none, none), (ring(k), ring(F.col("user_id")), F.col("e")), (F.lit(0.3), F.col("w")), (mode, k * 10 - 100, F.when(k % 2 == 0, "disabled").otherwise("late")),
        (1 + F.col("d") / 10, 1 + F.col("e") / 10), F.when(kind == "error", F.col("w")), kind == "click",
    )
    return _x(spark, sf_dir).select("event_id", q.alias("q")).select("event_id", "q.*")


@query(
    "intensities",
    f"""with p as (select p_partkey, case when p_partkey % 3 <> 0 then p_size / 50.0::double end as en, case when p_partkey % 4 <> 0 then (p_partkey % 10) / 10.0::double end as pu, case when p_partkey % 5 <> 0 then (p_partkey % 4)::double end as da from part)
    select p_partkey, case when en is not null or pu is not null or da is not null then {r(f"(coalesce(en, pu, 0.5) + coalesce(pu, en, 0.5)) / 2 * 0.55 + (case when da is null then (coalesce(en, pu, 0.5) + coalesce(pu, en, 0.5)) / 2 else {c01('da / 3')} end) * 0.45", 6)} end as intensity from p""",
)
def intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    unless = lambda n, x: F.when(k % n != 0, x.cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", half_up(evidence.loudness_of(unless(3, F.col("p_size") / 50.0), unless(4, k % 10 / 10.0), unless(5, k % 4)), 6).alias("intensity"))


@query(
    "personal_top",
    f"""with {_X}, c as (select user_id, event_type as context, k, sum(case when event_type = 'purchase' or value > 50 then 1.0 else 0.5 end) as plays from x group by 1, 2, 3) select * from (select user_id, context, k as track, cast(plays as double) as plays, row_number() over (partition by user_id, context order by plays desc, k) as place from c) where place <= 3""",
)
def personal_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select("user_id", F.col("event_type").alias("context"), F.col("k").alias("track"), ((F.col("event_type") == "purchase") | (F.col("value") > 50)).alias("done"))
    return studies.top_personal(rows, ["user_id", "context"], "track", "done", 3)


@query(
    "rising_artists",
    f"""with {_X}, p as (select user_id, k % 10 as artist, count(*) filter (where {NOW} - at_ms <= {15 * DAY}) as n, count(*) filter (where {NOW} - at_ms > {15 * DAY} and {NOW} - at_ms <= {90 * DAY}) as o from x group by 1, 2), t as (select user_id, greatest(sum(n), 1) as nn, greatest(sum(o), 1) as oo from p group by 1)
    select user_id, artist, {r('n / nn')} as recent, {r('o / oo')} as before, {r('n / nn - o / oo')} as growth from p join t using (user_id)""",
)
def rising_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).withColumn("artist", F.col("k") % 10)
    return studies.growth(rows, ["user_id"], "artist", "at_ms", NOW, 15, 90)


@query(
    "new_discoveries",
    f"""with {_X}, g as (select user_id, k as track, max(at_ms) as last from x where event_type = 'click' and {NOW} - at_ms <= {30 * DAY} group by 1, 2) select user_id, track, row_number() over (partition by user_id order by last desc, track) as place from g""",
)
def new_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select("user_id", F.col("k").alias("track"), "at_ms", (F.col("event_type") == "click").alias("found"))
    return studies.new_discoveries(rows, ["user_id"], "track", "at_ms", "found", NOW)


def _routes_sql(depth: int = 3, branches: int = 3) -> str:
    edge = r("0.4 + 0.4 * (1 - abs(t.s_acctbal - x.s_acctbal) / 11000) + 0.2 * cast(t.s_nationkey = x.s_nationkey as int)")
    out = ["h0 as (select [s_suppkey] as route, 0.0::double as s, 0.0::double as w from supplier where s_suppkey = 0)"]
    for k in range(1, depth + 1):
        keep = "" if k == 1 else f" where nth <= {branches}"
        out.append(
            f"""h{k} as (select route, s, w from (select list_append(route, x.s_suppkey) as route, s + {edge} * {0.72 ** (k - 1)!r} as s, w + {0.72 ** (k - 1)!r} as w, row_number() over (partition by route order by {edge} desc, x.s_suppkey) as nth
            from h{k - 1} join supplier t on t.s_suppkey = route[-1] join supplier x on not list_contains(route, x.s_suppkey)){keep})"""
        )
    union = " union all ".join(f"select route[2] as first, array_to_string(route, '/') as route, {r('s / w')} as score from h{k}" for k in range(1, depth + 1))
    return f"with {', '.join(out)}, u as ({union}), n as (select *, row_number() over (partition by first order by score desc, route) as nth from u) select first, route, score from n where nth = 1"


@query("compatibility_routes", _routes_sql())
def compatibility_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return studies.neighbour_routes(s, "s_suppkey", 0, "s_acctbal", "s_nationkey", lambda d, same: 0.4 + 0.4 * (1 - d / 11000) + 0.2 * same.cast("int"), 3, 3)


@query(
    "case_faults",
    """with p as (select page_id, 'case:' || page_id || case when page_id % 5 = 0 then ' x' else '' end as id, page_id - 3 as made, url, page_id % 7 as v from pages)
    select page_id, case when not regexp_full_match(id, '[a-zA-Z0-9:_-]{1,256}') then 'id' when made < 0 then 'created' when length(trim(url)) = 0 or length(url) > 256 then 'from' when v = 1 then 'variants' when v = 2 then 'split' end as fault from p""",
)
def case_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id"), F.col("url")
    case = {
        "id": F.concat(F.lit("case:"), k.cast("string"), F.when(k % 5 == 0, " x").otherwise("")), "created_ms": k - 3, "from_ref": url, "to_ref": url, "artists": F.array(url), "genre_pair": F.lit("a/b"), "pair_ref": url, "context": F.lit("home"),
        "device": F.lit("phone"), "variants": F.array(F.lit("a"), F.when(k % 7 == 1, "a").otherwise("b")), "split": F.when(k % 7 == 2, "other").otherwise("train"),
    }
    return table(spark, sf_dir, "pages").select("page_id", evidence.case_fault(case).alias("fault"))


@query(
    "event_faults",
    """select event_id, case when event_type not in ('view', 'click', 'purchase') then 'kind' when value / 150 > 1 then 'weight' end as fault from events""",
)
def event_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = evidence.event_fault(F.col("event_type"), ["view", "click", "purchase"], F.col("value") / 150, F.array("value", F.col("value") * 2))
    return table(spark, sf_dir, "events").select("event_id", fault.alias("fault"))


@query("polarization", f"with {_X} select k, {r(c01('2 * sqrt(var_pop(u))'))} as polarization from x group by 1")
def polarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.polarization("u", "k", _x(spark, sf_dir))


@query("noisy_or", f"with {_X} select k, {r('1 - product(1 - w * 0.1)', 6)} as risk from x group by 1")
def noisy_or_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).groupBy("k").agg(half_up(noisy_or(F.col("w") * 0.1), 6).alias("risk"))


@query("null_test", f"with v as (select vec_id, cast(embedding as double[]) as v from embeddings) select a.vec_id, {r('list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))', 6)} as worst from v a join v b on b.vec_id = a.vec_id - a.vec_id % 100")
def null_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    seeds = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("seed"), F.col("a").alias("b"))
    met = v.join(seeds, F.col("seed") == F.col("vec_id") - F.col("vec_id") % 100)
    return met.select("vec_id", half_up(signals.null_test(F.col("a"), F.col("b")), 6).alias("worst"))


@query("grid_confidence", f"""with {_X}, b as (select user_id, at_ms / 1000.0 as s, w, event_type from x), g as (select user_id, cast(floor(at_ms / {DAY}) as bigint) as day, min(floor(at_ms / {DAY})) * {DAY} / 1000.0 as s, (min(floor(at_ms / {DAY})) + 1) * {DAY} / 1000.0 as e from x group by 1, 2)
    select g.user_id, g.day, {r('avg(w)')} as beat, {r(c01("count(*) filter (where event_type = 'signup') / greatest(1, count(*) / 4.0) * 0.9"))} as downbeat from g join b on b.user_id = g.user_id and b.s >= g.s and b.s < g.e group by 1, 2""")
def grid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    day = F.floor(F.col("at_ms") / DAY)
    regions = x.select("user_id", day.alias("day")).distinct().select("user_id", "day", (F.col("day") * (DAY // 1000)).cast("double").alias("w_start"), ((F.col("day") + 1) * (DAY // 1000)).cast("double").alias("w_end"))
    beats = x.select("user_id", (F.col("at_ms") / 1000.0).alias("at"), "w", (F.col("event_type") == "signup").alias("down"))
    met = joins.points_in_windows(beats, regions, "user_id", "at", 43_200.0)
    n = F.count(F.lit(1))
    return met.groupBy("user_id", "day").agg(half_up(F.avg("w")).alias("beat"), half_up(clamp(F.count_if("down") / F.greatest(F.lit(1.0), n / 4) * 0.9)).alias("downbeat"))


@query("jsonl_scan", f"with {EVENTS} select k, count(*) as n from ev where k >= 20 group by 1 union all select -1, count(*) from ev where k < 20")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events written as JSON lines, scanned with a rule; what it rejects is counted under -1."""
    path = fresh_path(spark, "lines")
    jsonl.append(table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")), path)
    records, rejects = jsonl.scan(spark, path, "k long", F.col("k") >= 20)
    return records.groupBy("k").agg(F.count(F.lit(1)).alias("n")).union(rejects.select(F.lit(-1).cast("long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")))


_STREAMED = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("stream_days", f"with {EVENTS} select cast(floor(at_ms / {DAY}) * {DAY} as bigint) as start_ms, event_type, count(*) as n, {r('sum(value)')} as total from ev group by 1, 2")
def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = streaming.windowed(streaming.event_stream(spark, sf_dir, _STREAMED), "1 day")
    done = streaming.run_to_folder(windows, fresh_path(spark, "days"), "complete")
    return done.select(F.unix_millis("start").alias("start_ms"), "event_type", "n", "total")


@query(
    "stream_sessions",
    f"""with {EVENTS}, e as (select *, case when at_ms - lag(at_ms) over (partition by user_id order by at_ms) < 21600000 then 0 else 1 end as new from ev), n as (select *, sum(new) over (partition by user_id order by at_ms rows unbounded preceding) as s from e)
    select user_id, min(at_ms) as started, max(at_ms) + 21600000 as ended, count(*) as n from n group by user_id, s""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = streaming.run_to_folder(streaming.sessions(streaming.event_stream(spark, sf_dir, _STREAMED), "6 hours"), fresh_path(spark, "sessions"), "complete")
    return done.select("user_id", F.unix_millis("started").alias("started"), F.unix_millis("ended").alias("ended"), "n")


@query("stream_affinity", f"with {EVENTS} select user_id, {r('list_reduce(list(value / 1000 order by ts, event_id), lambda a, x: least(greatest(a + x * (1 - abs(a)), -1.0), 1.0), 0.0::double)', 6)} as score, count(*) as n from ev group by 1")
def stream_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streaming.event_stream(spark, sf_dir, _STREAMED).select("user_id", "ts", "event_id", (F.col("value") / 1000).alias("delta"))
    done = streaming.run_to_folder(streaming.saturating(stream, "user_id"), fresh_path(spark, "affinity"), "update")
    return done.groupBy("user_id").agg(F.max_by("score", "n").alias("score"), F.max("n").alias("n"))


@query("stream_revisions", f"with {EVENTS}, n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as revision from ev) select user_id, count(*) as applied, 0::bigint as gaps from n group by 1")
def stream_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered envelopes of each user, replayed: all of them follow each other."""
    path = fresh_path(spark, "envelopes")
    by = Window.partitionBy("user_id").orderBy("event_id")
    events(spark, sf_dir).select("user_id", F.row_number().over(by).cast("long").alias("revision")).write.parquet(path)
    frames = spark.readStream.schema("user_id long, revision long").parquet(path)
    done = streaming.run_to_folder(streaming.revisions(frames, "user_id"), fresh_path(spark, "revisions"), "append")
    return done.groupBy("user_id").agg(F.count_if(F.col("verdict") == "applied").alias("applied"), F.count_if(F.col("verdict") == "gap").alias("gaps"))
