"""Knowledge of tracks over the driver's tables: fused genres and embeddings, stems, sources, bundles, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import knowledge
from ..functions.scalars import clamp, half_up
from ..operators import catalog
from ..sources.tables import table
from .inputs import c01, r
from .registry import query
from .studies import _X, _case, _mapped, _x

_SOURCES = {"view": "audio-classifier", "click": "user-tag", "purchase": "editorial", "signup": "track-metadata", "error": "community-tag"}
_RELIABLE = _case("event_type", {k: knowledge.RELIABILITY[v] for k, v in _SOURCES.items()}, 0.0)


@query("fused_genres", f"with {_X} select user_id, 'g' || (k % 5) as genre, {r(f'1 - product(1 - w * {_RELIABLE})', 6)} as weight from x group by 1, 2")
def fused_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir).select("user_id", F.concat(F.lit(" G"), (F.col("k") % 5).cast("string")).alias("genre"), F.col("w").alias("confidence"), _mapped(F.col("event_type"), _SOURCES).alias("source"))
    return catalog.fused_genres(rows, "user_id")


@query(
    "fused_embeddings",
    f"""with v as (select vec_id, cast(embedding as double[]) as v, vec_id % 4 <> 0 as ha, vec_id % 3 <> 0 as hl, (vec_id % 10) / 10.0 as ca from embeddings), w as (select *, case when ha then 0.3 * ca else 0.0 end as wa, case when hl then 0.18 else 0.0 end as wl from v)
    select vec_id, {r('list_sum(list_transform(range(1, 65), lambda i: case when wa + wl = 0 then 0.0 else ' + r('(case when ha then v[i] * wa else 0.0 end + case when hl and i <= 32 then v[i] * wl else 0.0 end) / (wa + wl)') + ' end * i))', 6)} as mark, {r(c01('(wa + wl) / 1.0'))} as confidence from w""",
)
def fused_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    v = F.transform("embedding", lambda x: x.cast("double"))
    parts = {"audio": (F.when(k % 4 != 0, v), k % 10 / 10.0), "lyrics": (F.when(k % 3 != 0, F.slice(v, 1, 32)), F.lit(1.0))}
    fused = table(spark, sf_dir, "embeddings").select("vec_id", knowledge.fused_embedding(parts, 64).alias("f"))
    mark = F.aggregate(F.transform("f.embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return fused.select("vec_id", half_up(mark, 6).alias("mark"), "f.confidence")


@query("affect_states", f"with {_X} select event_id, {r('greatest(-1.0, least(1.0, u * 3 - 1.5))')} as valence, {r(c01('w * 1.5'))} as arousal, {r('d')} as confidence from x")
def affect_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("event_id", half_up(clamp(F.col("u") * 3 - 1.5, -1.0, 1.0)).alias("valence"), half_up(clamp(F.col("w") * 1.5)).alias("arousal"), half_up(clamp("d")).alias("confidence"))


_TAGS = [(c, t) for c, tags in knowledge.TAXONOMY.items() for t in tags]


@query("semantic_terms", f"select doc_id, category, tag from documents, (values {', '.join(f'({c!r}, {t!r})' for c, t in _TAGS)}) v(category, tag) where contains(lower(text), tag)")
def semantic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(knowledge.semantic_terms(F.col("text"))).alias("t")).select("doc_id", "t.category", "t.tag")


@query(
    "listening_responses",
    f"""with {_X} select event_id, case when event_type = 'error' then 'choice' when k % 7 > 5 or user_id % 6 < 1 then 'ratings' when value > 150 then 'confidence' end as fault from x""",
)
def listening_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as JSON text, parsed and checked."""
    choice = _mapped(F.col("event_type"), {"view": "A", "click": "B", "purchase": "no-preference", "signup": "A"}, "C")
    body = F.to_json(F.struct(choice.alias("choice"), F.array(F.col("k") % 7, F.lit(3)).alias("a"), F.array(F.col("user_id") % 6, F.lit(5)).alias("b"), (F.col("value") / 150).alias("confidence")))
    zero = F.col("k") % 7 == 0  # a rating of none is no rating; here it stands for one
    rows = _x(spark, sf_dir).select("event_id", F.when(zero, F.replace(body, F.lit('"a":[0,'), F.lit('"a":[1,'))).otherwise(body).alias("body"))
    return rows.select("event_id", knowledge.response_fault(F.col("body")).alias("fault"))


@query("annotation_windows", f"with {_X} select event_id, {r('u * d * e')} as gain from x order by gain desc, event_id limit 25")
def annotation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = half_up(clamp("u") * clamp("d") * clamp("e"))
    return _x(spark, sf_dir).select("event_id", gain.alias("gain")).orderBy(F.desc("gain"), "event_id").limit(25)


_DISTANCE = " + ".join(f"sqrt(list_sum(list_transform(range({a}, {a + 16}), lambda i: pow(p.v[i] - q.v[i], 2))))" for a in (1, 17, 33, 49))


@query(
    "similar_recipes",
    f"""with v as (select vec_id, label, cast(embedding as double[]) as v from embeddings), m as (select p.vec_id as a, q.vec_id as b, {r(_DISTANCE, 6)} as distance from v p join v q on p.vec_id % 100 = 0 and p.vec_id <> q.vec_id)
    select a, b, distance from (select *, row_number() over (partition by a order by distance, b) as nth from m) where nth <= 3""",
)
def similar_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.similar_recipes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("k") % 100 == 0, 3, 16)


@query(
    "stem_components",
    f"""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 6) as v from embeddings), w as (select *, list_sort(list_transform(range(0, 16), lambda k: sqrt(list_sum(list_transform(v[k * 4 + 1:k * 4 + 4], lambda x: x * x)) / 4))) as s from v),
    t as (select *, greatest(0.004, s[2] * 2.5, s[8] * 1.25) as th from w)
    select vec_id, {r('sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64)', 6)} as level, {r('len(list_filter(s, lambda x: x >= th)) / 16.0')} as density, {r('s[16] / greatest(1e-9, s[8])')} as dynamic_range,
           {r(c01('len(list_filter(v, lambda x: abs(x) >= 0.995)) / 64.0 * 12 + len(list_filter(range(2, 65), lambda i: abs(v[i] - v[i - 1]) > 1.2)) / 64.0 * 18'))} as artifact_risk from t""",
)
def stem_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") * 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", knowledge.stem_component(v, 4, 1.2).alias("s")).select("vec_id", "s.*")


def _cor(a: int, b: int) -> str:
    dot = lambda p, q: f"list_sum(list_transform(range(1, 17), lambda i: v[i + {p}] * v[i + {q}]))"
    return f"abs({dot(a, b)}) / greatest(1e-9, sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


@query("stem_bleed", f"with v as (select vec_id, cast(embedding as double[]) as v from embeddings) select vec_id, {r('greatest(' + ', '.join(_cor(16 * a, 16 * b) for a in range(4) for b in range(a + 1, 4)) + ')', 6)} as bleed from v")
def stem_bleed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = [F.slice("embedding", 16 * k + 1, 16) for k in range(4)]
    return table(spark, sf_dir, "embeddings").select("vec_id", half_up(knowledge.bleed(stems), 6).alias("bleed"))


@query(
    "structural_cuts",
    f"""with {_X}, s as (select user_id, k as idx, min(value) as a, min(value) + 20 as b from x where event_type = 'view' group by 1, 2), d as (select user_id, k as src, k % 10 as dst, w as strength, event_id from x where event_type = 'click'), q as (select event_id, user_id, value as cut from x where event_type = 'purchase'),
    m as (select q.event_id, max(d.strength) as pen, count(*) as n from q join s on q.user_id = s.user_id and q.cut >= s.a and q.cut < s.b join d on d.user_id = q.user_id and d.src = s.idx join s t on t.user_id = q.user_id and t.idx = d.dst and t.a >= q.cut group by 1)
    select q.event_id, {r('coalesce(pen, 0.0)')} as penalty, coalesce(pen, 0.0) >= 0.8 as blocked, coalesce(n, 0) as unresolved from q left join m on q.event_id = m.event_id""",
)
def structural_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    sections = x.where("event_type = 'view'").groupBy("user_id", F.col("k").alias("section")).agg(F.min("value").alias("w_start")).withColumn("w_end", F.col("w_start") + 20)
    depends = x.where("event_type = 'click'").select("user_id", F.col("k").alias("section"), (F.col("k") % 10).alias("target"), F.col("w").alias("strength"))
    cuts = x.where("event_type = 'purchase'").select("event_id", "user_id", F.col("value").alias("cut"))
    return catalog.structural_cuts(cuts, sections, depends, "event_id", "user_id", "cut", 20.0)


_ALLOWED = "s_acctbal > 0 and s_nationkey % 3 <> 1"


@query("playback_sources", f"select n_nationkey as recording, s.s_suppkey as source, case when n_nationkey % 8 = 7 then 'recording-rights-denied' when s.s_suppkey is null then 'no-compatible-source' else 'resolved' end as reason from nation left join (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey % 2 desc, s_suppkey) as nth from supplier where {_ALLOWED}) s on s_nationkey = n_nationkey and nth = 1 and n_nationkey % 8 <> 7")
def playback_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("recording"), F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 2 == 1).alias("lossless"), F.expr(_ALLOWED).alias("allowed"))
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("recording"), (F.col("n_nationkey") % 8 != 7).alias("granted"))
    return catalog.playback_sources(wanted, offers)


@query(
    "candidate_ranking",
    f"""with {_X}, c as (select user_id, k, max(u) as own from x group by 1, 2), rt as (select user_id, k, max(w) + 0.2 as route from x where event_type = 'click' group by 1, 2), o as (select user_id, k, max(d) as forced from x where event_type = 'signup' group by 1, 2),
    s as (select c.user_id, c.k as track, {r('coalesce(forced, coalesce(route, own * 0.5) * 0.6 + own * 0.4)')} as score from c left join rt on rt.user_id = c.user_id and rt.k = c.k left join o on o.user_id = c.user_id and o.k = c.k)
    select user_id, track, score from (select *, row_number() over (partition by user_id order by score desc, track) as nth from s) where nth <= 5""",
)
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    best = lambda kind, v, name: x.where(F.col("event_type") == kind).groupBy("user_id", F.col("k").alias("track")).agg(F.max(v).alias(name))
    own = x.groupBy("user_id", F.col("k").alias("track")).agg(F.max("u").alias("own"))
    return catalog.ranked_candidates(own, best("click", F.col("w") + 0.2, "route"), best("signup", F.col("d"), "forced"), ["user_id"], "track", 5)


@query(
    "offline_bundles",
    """with p as (select p_brand, count(*) as n, count(distinct p_size) as ids, max(p_retailprice) as top, min(p_partkey) as k from part group by 1) select p_brand as brand, case when top > 950 and k % 2 = 1 then 'expired' end as fault, ids as tracks from p""",
)
def offline_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of a brand's sizes as JSON text, parsed: what has expired is refused, ids count once."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_size").alias("sizes"), F.max("p_retailprice").alias("top"), F.min("p_partkey").alias("k"))  # 50 sizes at most
    old = (F.col("top") > 950) & (F.col("k") % 2 == 1)
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.when(old, 5).otherwise(500).alias("expires"), F.concat("sizes", F.slice("sizes", 1, 2)).alias("tracks")))
    return g.select("brand", knowledge.bundle(body, 100).alias("b")).select("brand", "b.fault", F.size("b.tracks").cast("long").alias("tracks"))


@query(
    "group_profiles",
    f"""with {_X}, l as (select user_id, list({{'a': case when event_type in ('view', 'purchase') then u else 0.0::double end, 'b': case when event_type in ('click', 'signup', 'error') then u else 0.0::double end, 'n': 1}} order by event_id) as l from x group by 1),
    f as (select user_id, list_reduce(l, lambda s, y: case when s.n = 0 then y else {{'a': {r('s.a * 0.8 + y.a * 0.2')}, 'b': {r('s.b * 0.8 + y.b * 0.2')}, 'n': s.n + 1}} end, {{'a': 0.0::double, 'b': 0.0::double, 'n': 0}}) as s from l)
    select user_id, cast(s.n as bigint) as version, {r('s.a')} as calm, {r('s.b')} as lively from f""",
)
def group_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    calm = F.col("event_type").isin("view", "purchase")
    rows = _x(spark, sf_dir).select("user_id", "event_id", F.when(calm, F.col("u")).otherwise(0.0).alias("calm"), F.when(calm, 0.0).otherwise(F.col("u")).alias("lively"))
    return catalog.evolving_profiles(rows, "user_id", ["event_id"], ["calm", "lively"])


@query("play_history", f"with {_X}, n as (select user_id, k, event_id, row_number() over (partition by user_id order by event_id desc) as nth from x where event_type <> 'error') select user_id, k as previous, nth - 1 as back from n where nth between 2 and 6")
def play_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five entries before the latest of each user."""
    return catalog.history(_x(spark, sf_dir).where("event_type <> 'error'"), "user_id", "event_id", "k", 5)


@query(
    "vocal_profiles",
    f"""with w as (select vec_id, list_transform(range(0, 16), lambda k: sqrt(list_sum(list_transform(embedding[k * 4 + 1:k * 4 + 4], lambda x: cast(x as double) * cast(x as double))) / 4)) as v from embeddings), t as (select *, greatest(0.004, list_sort(v)[2] * 2.5, list_sort(v)[8] * 1.3) as th from w),
    s as (select vec_id, unnest(range(0, 4)) as segment, v, th from t) select vec_id, cast(segment as bigint) as segment, {r('len(list_filter(v[segment * 4 + 1:segment * 4 + 4], lambda x: x >= th)) / 4.0')} as density, {r('list_max(v[segment * 4 + 1:segment * 4 + 4])', 6)} as peak, len(list_filter(v[segment * 4 + 1:segment * 4 + 4], lambda x: x >= th)) >= 2 as active from s""",
)
def vocal_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "embeddings").select("vec_id", knowledge.vocal_segments(F.col("embedding"), 4, 4, 0.35).alias("s"))
    return segments.select("vec_id", F.explode("s").alias("s")).select("vec_id", "s.*")
