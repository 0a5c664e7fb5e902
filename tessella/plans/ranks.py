"""Ranking, scalar, text, signal and relational queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalars import all_failed, camelot_score, clamp, cosine01, dot, first_failed, half_up, ladder, octave_folded, present_mean, tempo_relation
from ..operators import folds, groups, ranking, signals
from ..sources.tables import table
from .inputs import EVENTS, NOW, c01, events, r
from .registry import query

DAY = 86_400_000


@query(
    "hard_gates",
    """select p_partkey, case when not (p_size >= 5) then 'size' when not (p_retailprice < 990) then 'price' when not (p_brand <> 'Brand#3') then 'brand' when not (p_type <> 'ECONOMY' or p_size < 40) then 'economy' end as gate from part""",
)
def hard_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [("size", F.col("p_size") >= 5), ("price", F.col("p_retailprice") < 990), ("brand", F.col("p_brand") != "Brand#3"), ("economy", (F.col("p_type") != "ECONOMY") | (F.col("p_size") < 40))]
    return table(spark, sf_dir, "part").select("p_partkey", first_failed(gates).alias("gate"))


@query(
    "gate_failures",
    """select p_partkey, array_to_string(list_filter([case when not (p_size >= 5) then 'size' end, case when not (p_retailprice < 990) then 'price' end, case when not (p_brand <> 'Brand#3') then 'brand' end], lambda x: x is not null), ',') as failed from part""",
)
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [("size", F.col("p_size") >= 5), ("price", F.col("p_retailprice") < 990), ("brand", F.col("p_brand") != "Brand#3")]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(all_failed(gates), ",").alias("failed"))


@query("value_ladder", "select event_id, case when value <= 10 then 'low' when value <= 50 then 'mid' when value <= 150 then 'high' else 'top' end as step from events")
def value_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ladder("value", [(10, "low"), (50, "mid"), (150, "high")], "top").alias("step"))


@query(
    "curated_parts",
    "select p_partkey, p_brand = 'Brand#1' as seed, p_retailprice / 1000 as fit from part where p_retailprice >= 920 and p_type in ('ECONOMY', 'STANDARD') order by seed desc, fit desc, p_partkey limit 200",
)
def curated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where((F.col("p_retailprice") >= 920) & F.col("p_type").isin("ECONOMY", "STANDARD"))
    rows = p.select("p_partkey", (F.col("p_brand") == "Brand#1").alias("seed"), (F.col("p_retailprice") / 1000).alias("fit"))
    return rows.orderBy(F.desc("seed"), F.desc("fit"), "p_partkey").limit(200)


@query(
    "weighted_recommendation",
    f"""with {EVENTS}, g as (select k, {c01('avg(value) / 100')} as a, {c01("count(*) filter (where event_type = 'purchase') / count(*) * 3")} as b, {c01('count(distinct user_id) / 100.0')} as c from ev group by 1)
    select k, {r('(a * 0.3 + b * 0.5 + c * 0.2) / 1.0')} as score, case when a * 0.3 > greatest(b * 0.5, c * 0.2) then 'value' when b * 0.5 >= c * 0.2 then 'bought' else 'reach' end as reason from g""",
)
def weighted_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy("k").agg(
        clamp(F.avg("value") / 100).alias("a"), clamp(F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1)) * 3).alias("b"), clamp(F.countDistinct("user_id") / 100.0).alias("c")
    )
    parts = [("bought", F.col("b") * 0.5), ("value", F.col("a") * 0.3), ("reach", F.col("c") * 0.2)]
    return g.select("k", half_up(ranking.weighted_score([("a", 0.3), ("b", 0.5), ("c", 0.2)])).alias("score"), ranking.top_reasons(parts)[0].alias("reason"))


_AVAILABLE = f"s as (select p_partkey, case when p_size % 3 <> 0 then p_size / 50.0 end as a, (p_retailprice - 900) / 100 as b, case when p_partkey % 2 = 0 then 0.7 end as c from part)"


@query(
    "available_score",
    f"""with {_AVAILABLE}, w as (select *, (case when a is not null then 0.2 else 0.0 end) + 0.5 + (case when c is not null then 0.3 else 0.0 end) as w from s)
    select p_partkey, {r(f"coalesce({r(f'{c01('a')} * 0.2 / w')}, 0.0) + {r(f'{c01('b')} * 0.5 / w')} + coalesce({r(f'{c01('c')} * 0.3 / w')}, 0.0)")} as score from w""".replace(c01("a"), "a").replace(c01("c"), "c"),
)
def available_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 50.0).alias("a"), ((F.col("p_retailprice") - 900) / 100).alias("b"), F.when(F.col("p_partkey") % 2 == 0, 0.7).alias("c")
    )
    return rows.select("p_partkey", ranking.available_score([("a", 0.2), ("b", 0.5), ("c", 0.3)]).alias("score"))


@query(
    "present_mean",
    "select p_partkey, floor((coalesce(a * 2, 0) + b) / (case when a is not null then 3.0 else 1.0 end) * 1000 + 0.5000001) / 1000 as mean from (select p_partkey, case when p_size % 4 <> 0 then p_size / 50.0 end as a, p_retailprice / 1000 as b from part)",
)
def present_mean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("p_size") % 4 != 0, F.col("p_size") / 50.0)
    return table(spark, sf_dir, "part").select("p_partkey", half_up(present_mean([(a, 2.0), (F.col("p_retailprice") / 1000, 1.0)])).alias("mean"))


_COS = """x as (select a.vec_id as a, b.vec_id as b, floor(greatest(0.0, least(1.0, (list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) + 1) / 2)) * 1000000 + 0.5000001) / 1000000 as score
    from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)"""


@query("cosine_top", f"with {_COS}, n as (select *, row_number() over (partition by a order by score desc, b) as nth from x) select a, b, score from n where nth <= 5")
def cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("k") % 100 == 0, 5)


@query(
    "two_stage_funnel",
    f"""with {_COS}, one as (select b, score from x where a = 0 order by score desc, b limit 100), two as (select one.b, score, label from one join embeddings on vec_id = one.b order by label, score desc, b limit 20), three as (select * from two order by score desc, b limit 5)
    select b as vec_id, label, score from three order by score, b limit 2""",
)
def two_stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    seed = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("x")))  # one row
    scored = v.where("vec_id <> 0").join(seed).select("vec_id", "label", half_up(cosine01(F.col("x"), F.col("embedding")), 6).alias("score"))
    best, by_label, worst = [F.desc("score"), F.col("vec_id")], [F.col("label"), F.desc("score"), F.col("vec_id")], [F.col("score"), F.col("vec_id")]
    return ranking.funnel(scored, [(best, 100), (by_label, 20), (best, 5), (worst, 2)])


@query(
    "clear_winner",
    f"""with {EVENTS}, s as (select user_id, event_type, {r('sum(value) / 1000')} as score from ev group by 1, 2), n as (select *, row_number() over (partition by user_id order by score desc, event_type) as nth, lead(score) over (partition by user_id order by score desc, event_type) as nx from s)
    select user_id, event_type, score, {r('score - coalesce(nx, 0.0)')} as margin, {r('score - coalesce(nx, 0.0)')} >= 0.1 as clear from n where nth = 1""",
)
def clear_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id", "event_type").agg(half_up(F.sum("value") / 1000).alias("score"))
    return ranking.with_margin(s, "user_id", "score", "event_type", 0.1)


@query(
    "greedy_route",
    f"""with {EVENTS}, e as (select user_id, list({{'items': [event_id], 'm': value / 20}} order by k / 100 desc, event_id) as l from ev where event_type = 'view' group by 1),
    f as (select user_id, list_reduce(l, lambda a, x: case when a.m < 10 and a.m + x.m <= 12 then {{'items': list_concat(a.items, x.items), 'm': a.m + x.m}} else a end, {{'items': []::bigint[], 'm': 0.0::double}}) as s from e)
    select user_id, s.items as items, {r('s.m')} as filled from f""",
)
def greedy_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("event_id").alias("item"), (F.col("k") / 100).alias("score"), (F.col("value") / 20).alias("minutes"))
    return folds.greedy_fill(rows, "user_id", "score", "minutes", "item", 10.0, 2.0)


@query(
    "softmax_choice",
    f"""with {EVENTS}, s as (select user_id, event_type, {r('sum(value) / 1000')} as score from ev group by 1, 2), n as (select *, row_number() over (partition by user_id order by score desc, event_type) as nth from s), e as (select *, exp(score) / sum(exp(score)) over (partition by user_id) as p from n where nth <= 3),
    c as (select *, sum(p) over (partition by user_id order by nth) as run from e) select user_id, arg_min(event_type, nth) as event_type, {r('arg_min(p, nth)')} as probability from c where run >= 0.6 - 1e-9 group by 1""",
)
def softmax_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id", "event_type").agg(half_up(F.sum("value") / 1000).alias("score"))
    return ranking.softmax_choice(s, "user_id", "score", "event_type", 0.6)


@query(
    "harmonic_scores",
    """with k as (select distinct s_suppkey % 12 + 1 as n, case when s_nationkey % 2 = 0 then 'A' else 'B' end as ring from supplier), d as (select a.n || a.ring as a, b.n || b.ring as b, a.n as an, b.n as bn, a.ring as ar, b.ring as br, least(abs(a.n - b.n), 12 - abs(a.n - b.n)) as d from k a, k b),
    m as (select s_suppkey % 12 + 1 || case when s_nationkey % 2 = 0 then 'A' else 'B' end as a, count(*) as suppliers from supplier group by 1)
    select d.a, d.b, suppliers, case when an = bn and ar = br then 1.0 when ar = br and d = 1 then 0.8 when ar = br and d = 2 then 0.4 when ar <> br and an = bn then 0.7 else 0.0 end :: double as score from d join m on d.a = m.a""",
)
def harmonic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the 24 keys with each other, and how many suppliers each key has: the pairs of suppliers follow."""
    key = F.concat((F.col("s_suppkey") % 12 + 1).cast("string"), F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("B"))
    k = table(spark, sf_dir, "supplier").groupBy(key.alias("a")).agg(F.count(F.lit(1)).alias("suppliers"))  # 24 rows at most
    return k.join(F.broadcast(k.select(F.col("a").alias("b")))).select("a", "b", "suppliers", camelot_score("a", "b").alias("score"))


@query(
    "tempo_relations",
    f"""with p as (select p_partkey, 60.0 + p_size as a, 80.0 + p_partkey % 100 as b from part), h as (select p_partkey, a, b, unnest([0, 1, 2, 3, 4]) as kk, unnest([1.0, 2.0, 0.5, 2.0 / 3, 1.5]) as m, unnest([1.0, 0.92, 0.92, 0.72, 0.72]) as prior, unnest(['same', 'double', 'half', 'two-over-three', 'three-over-two']) as rel from p),
    s as (select *, abs(a / (b * m) - 1) as gap, exp(-pow(abs(a / (b * m) - 1) / 0.08, 2)) * (prior * 0.55 + 0.6 * 0.45) as pl from h), n as (select *, row_number() over (partition by p_partkey order by pl desc, gap, kk) as nth from s)
    select p_partkey, case when gap <= 0.08 and pl >= (case when kk >= 3 then 0.62 else 0.55 end) then rel else 'unrelated' end as relation, {r('pl')} as plausibility from n where nth = 1""",
)
def tempo_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tempo_relation(60.0 + F.col("p_size"), 80.0 + F.col("p_partkey") % 100)
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.relation", "t.plausibility")


@query(
    "octave_folded",
    """with recursive f as (select p_partkey, p_retailprice / 3 * (1 + p_size % 5) as bpm from part where p_size > 0 union all select p_partkey, bpm / 2 from f where bpm > 140)
    select p_partkey, floor(min(bpm) * 10 + 0.5000001) / 10 as bpm from f group by 1""",
)
def octave_folded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", octave_folded(F.col("p_retailprice") / 3 * (1 + F.col("p_size") % 5)).alias("bpm"))


@query(
    "musical_time",
    """select event_id, cast(floor(b / 4) + 1 as bigint) as bar, cast(b % 4 + 1 as bigint) as beat, cast(floor((s / 0.5 - b) * 960) as bigint) as tick, cast(floor(floor(b / 4) / 4) + 1 as bigint) as phrase
    from (select event_id, value as s, floor(value / 0.5) as b from events)""",
)
def musical_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.floor(F.col("value") / 0.5)
    bar = F.floor(b / 4)
    return table(spark, sf_dir, "events").select(
        "event_id", (bar + 1).alias("bar"), (b % 4 + 1).alias("beat"), F.floor((F.col("value") / 0.5 - b) * 960).alias("tick"), (F.floor(bar / 4) + 1).alias("phrase")
    )


@query("vector_norms", "select vec_id, floor(list_dot_product(cast(embedding as double[]), cast(embedding as double[])) * 1000000 + 0.5000001) / 1000000 as norm2 from embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", half_up(dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"))


_MAPS = f"{EVENTS}, m as (select user_id, k % 8 as g, {c01('avg(value) filter (where at_ms < ' + str(NOW - 15 * DAY) + ') / 100')} as a, {c01('avg(value) filter (where at_ms >= ' + str(NOW - 15 * DAY) + ') / 100')} as b, count(*) filter (where at_ms < {NOW - 15 * DAY}) as na, count(*) filter (where at_ms >= {NOW - 15 * DAY}) as nb from ev group by 1, 2)"


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("at_ms") < NOW - 15 * DAY
    per = events(spark, sf_dir).groupBy("user_id", (F.col("k") % 8).cast("string").alias("g")).agg(clamp(F.avg(F.when(early, F.col("value"))) / 100).alias("a"), clamp(F.avg(F.when(~early, F.col("value"))) / 100).alias("b"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("g", c))))
    return per.groupBy("user_id").agg(as_map("a").alias("before"), as_map("b").alias("recent"))


@query("taste_drift", f"with {_MAPS}, d as (select user_id, {r('(case when nb > 0 then b else 0.0 end) - (case when na > 0 then a else 0.0 end)')} as d from m) select user_id, {r('avg(abs(d))', 6)} as magnitude, {r('avg(abs(d))', 6)} >= 0.22 as shifted from d group by 1")
def taste_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.taste_drift(_maps(spark, sf_dir), "before", "recent", digits=6).select("user_id", "magnitude", "shifted")


@query("taste_compatibility", f"with {_MAPS}, d as (select user_id, case when na > 0 then a else 0.0 end as x, case when nb > 0 then b else 0.0 end as y from m) select user_id, {r('avg(1 - abs(x - y))')} as score, count(*) filter (where least(x, y) >= 0.55) as shared from d group by 1")
def taste_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.taste_compatibility(_maps(spark, sf_dir), "before", "recent").select("user_id", "score", F.size("shared").cast("long").alias("shared"))


_TITLE = "t as (select doc_id, 'Artist ' || source || ' - ' || regexp_extract(text, '^[^.\\n]+', 0) || case doc_id % 4 when 0 then ' (Official Video)' when 1 then ' [HD remaster]' when 2 then ' feat. Someone' else ' (Acoustic) - Live' end as title from documents)"


def _spoken(x: str) -> str:
    return rf"(' ' || array_to_string(list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}&]'), lambda w: w <> ''), ' ') || ' ')"


def _says(x: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, ' {p} ')" for p in phrases) + ")"


def _first_said(x: str, table_: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when {_says(x, p)} then '{n}'" for n, p in table_.items()) + " else 'unknown' end"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s'), lambda w: w <> '')"


def _guestless(x: str, words: list[str]) -> str:
    """The tokens before the one that names guests."""
    marks = ", ".join(f"'{w}'" for w in words)
    at = f"coalesce(list_position(list_transform({_tokens(x)}, lambda w: trim({_spoken('w')}) in ({marks})), true), 0)"
    return f"case when {at} > 0 then list_slice({_tokens(x)}, 1, {at} - 1) else {_tokens(x)} end"


def _unbracketed(x: str, lost: str) -> str:
    return rf"array_to_string(list_filter(regexp_extract_all({x}, '[(\[{{][^)\]}}]*[)\]}}]|[^(\[{{]+|[(\[{{]'), lambda p: not (p[1] in ('(', '[', '{{') and length(p) > 1 and {lost})), '')"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*(F.lit(x) for x in (" (Official Video)", " [HD remaster]", " feat. Someone", " (Acoustic) - Live"))), (F.col("doc_id") % 4 + 1).cast("int"))
    title = F.concat(F.lit("Artist "), "source", F.lit(" - "), F.regexp_extract("text", r"^[^.\n]+", 0), end)
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))


@query("title_versions", f"with {_TITLE}, s as (select doc_id, {_spoken('title')} as w from t) select doc_id, {_first_said('w', text.VERSIONS)} as version from s")
def title_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", text.version_of(F.col("title")).alias("version"))


@query(
    "clean_titles",
    f"""with {_TITLE}, g as (select doc_id, title, {_guestless(_unbracketed('title', _says(_spoken('p'), text.JUNK)), text.GUESTS)} as w, {_first_said(_spoken("(title || ' Up - Topic')"), text.GENRES)} as genre from t),
    d as (select *, case when len(w) > 2 then coalesce(list_position(list_transform(list_slice(w, 2, len(w) - 1), lambda x: x in ('-', '–', '—')), true), 0) else 0 end as spot from g)
    select doc_id, case when spot > 0 then array_to_string(list_slice(w, 1, spot), ' ') else 'Up' end as artist, genre,
           coalesce(nullif(trim(translate(array_to_string(case when spot > 0 then list_slice(w, spot + 2, len(w)) else w end, ' '), chr(34) || chr(39), '')), ''), trim(title)) as title from d""",
)
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.lit("Up - Topic")
    done = _titles(spark, sf_dir).select("doc_id", text.clean_title(F.col("title"), channel).alias("m"), text.genre_of(F.col("title"), channel).alias("genre"))
    return done.select("doc_id", "m.artist", "m.title", "genre")


@query(
    "title_variants",
    f"""with {_TITLE}, g as (select doc_id, array_to_string({_tokens('title')}, ' ') as plain, {_guestless('title', text.GUESTS_LOOSE)} as w from t),
    d as (select *, array_to_string(w, ' ') as less, coalesce(list_position(list_slice(w, 2, len(w)), '-'), 0) as spot from g),
    f as (select doc_id, plain, less, array_to_string({_tokens(_unbracketed('less', 'true'))}, ' ') as bare, array_to_string(case when spot > 0 then list_slice(w, 1, spot) else w end, ' ') as dashless from d)
    select doc_id, concat_ws('|', nullif(plain, ''), case when less <> '' and less <> plain then less end, case when bare <> '' and bare not in (plain, less) then bare end, case when dashless <> '' and dashless not in (plain, less, bare) then dashless end) as variants from f""",
)
def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", F.array_join(text.title_variants(F.col("title")), "|").alias("variants"))


@query(
    "timed_lines",
    r"""with c as (select conv_id, text, printf('[%02d:%02d.%d]', turn, turn * 7 % 60, conv_id % 100) as stamp from conversations), l as (select conv_id, unnest(string_split(stamp || replace(text, chr(10), chr(10) || stamp) || chr(10) || '[00:99] ' || chr(10) || 'no stamp', chr(10))) as raw from c),
    s as (select conv_id, raw, list_filter(regexp_extract_all(raw, '\[[0-9:.]+\]'), lambda s: contains(string_split(s, '.')[1], ':') and len(string_split(translate(s, '.', ':'), ':')) between 2 and 3 and length(string_split(translate(s, '.', ':'), ':')[1]) in (2, 3)
             and length(string_split(translate(s[2:-2], '.', ':'), ':')[2]) = 2 and coalesce(length(string_split(translate(s, '.', ':'), ':')[3]), 2) between 2 and 4) as stamps from l),
    x as (select conv_id, trim(list_reduce(stamps, lambda a, s: replace(a, s, ''), raw)) as line, unnest(list_transform(stamps, lambda s: string_split(translate(s[2:-2], '.', ':'), ':'))) as p from s where len(stamps) > 0)
    select conv_id, cast(floor((cast(p[1] as double) * 60 + cast(p[2] as double) + coalesce(cast('0.' || p[3] as double), 0)) * 1000 + 0.5000001) as bigint) as time_ms, line from x""",
)
def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    stamp = F.format_string("[%02d:%02d.%d]", F.col("turn"), F.col("turn") * 7 % 60, F.col("conv_id") % 100)
    line = F.concat(stamp, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), stamp)))
    lrc = c.select("conv_id", F.concat(line, F.lit("\n[00:99] \nno stamp")).alias("lrc"))
    return text.timed_lines(lrc, "conv_id", "lrc")


@query(
    "page_hosts",
    r"select page_id, lower(regexp_extract(url, '^[a-z]+://(?:www\.|m\.)?([^/:?#]+)', 1)) as host, nullif(regexp_extract(url, '^https?://(?:[a-z0-9-]+\.)*example\.(?:com|net|org)/(?:[a-z-]+/)*en/(\d+)(?:[/?#]|$)', 1), '') as item from pages",
)
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"), text.path_id(F.col("url"), r"example\.(?:com|net|org)", "en", r"\d+").alias("item"))


@query(
    "intents",
    r"""with c as (select conv_id, turn, list_filter(string_split_regex(lower('keine ' || text || ' in ' || turn || ' min mehr energie richtung techno'), '[^\p{L}\p{N}-]'), lambda w: w <> '') as w from conversations),
    n as (select *, list_filter(list_transform(range(2, len(w)), lambda k: case when regexp_matches(w[k], '^[0-9]+$') and w[k - 1] in ('in', 'über') and starts_with(w[k + 1], 'min') then w[k] end), lambda x: x is not null)[1] as m from c)
    select conv_id, turn, w[2] as exclude, try_cast(m as int) as minutes, w[list_position(w, 'richtung') + 1] as toward from n""",
)
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("keine "), F.col("text"), F.lit(" in "), F.col("turn").cast("string"), F.lit(" min mehr energie richtung techno"))
    done = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.intent(said).alias("i"))
    return done.select("conv_id", "turn", "i.exclude", "i.minutes", "i.toward")


@query("slugs", r"select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query(
    "rms_curves",
    """with h as (select vec_id, unnest(range(0, 8)) as hop, embedding from embeddings), e as (select vec_id, hop, sqrt(list_sum(list_transform(list_slice(embedding, hop * 8 + 1, hop * 8 + 8), lambda x: cast(x as double) * cast(x as double))) / 8) as v from h)
    select vec_id, cast(hop as int) as hop, floor(v / greatest(1e-9, max(v) over (partition by vec_id)) * 10000 + 0.5000001) / 10000 as level from e""",
)
def rms_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = signals.rms_curve(F.col("embedding"), 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(curve).alias("hop", "x")).select("vec_id", "hop", half_up("x", 4).alias("level"))


@query(
    "signal_health",
    """select vec_id, floor(list_max(list_transform(embedding, lambda x: abs(cast(x as double)))) * 1000000 + 0.5000001) / 1000000 as peak, floor(list_sum(list_transform(embedding, lambda x: cast(x as double))) / 64 * 10000 + 0.5000001) / 10000 as dc from embeddings""",
)
def signal_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "embeddings").select("vec_id", signals.health(F.col("embedding")).alias("h"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("s"))
    return h.select("vec_id", "h.peak", half_up(F.col("s") / 64, 4).alias("dc"))


@query("spectra")
def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.spectra(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 22_050, 64)


@query(
    "groove_kinds",
    f"""with {EVENTS}, i as (select user_id, value % 1.0 as p from ev where value % 1.0 > 0.05 and value % 1.0 < 0.95),
    g as (select user_id, count(*) as n, count(*) filter (where abs(p - 1.0 / 3) < 0.045) as third, avg(least(p, abs(p - 0.25), abs(p - 0.5), abs(p - 0.75))) as off, list(p order by p) filter (where p >= 0.35 and p <= 0.75) as ands from i group by 1)
    select u.user_id, case when coalesce(n, 0) < 8 then 'straight' when third * 1.0 / n > 0.18 then 'triplet' when off > 0.14 then 'broken' when coalesce(ands[len(ands) // 2 + 1], 0.5) < 0.54 then 'straight' when coalesce(ands[len(ands) // 2 + 1], 0.5) < 0.61 then 'swing' else 'shuffle' end as groove
    from (select distinct user_id from ev) u left join g on u.user_id = g.user_id""",
)
def groove_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.groove(events(spark, sf_dir).select("user_id", (F.col("value") % 1.0).alias("p")), "user_id", "p")


@query("cube_sales", "select l_returnflag as flag, l_linestatus as status, grouping(l_returnflag) * 2 + grouping(l_linestatus) as level, count(*) as n, floor(sum(l_quantity) * 10 + 0.5000001) / 10 as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    return rows.cube("flag", "status").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), half_up(F.sum("l_quantity"), 1).alias("quantity"))


@query("rollup_orders", "select year(o_orderdate) as y, o_orderstatus as status, count(*) as n from orders group by rollup (y, status)")
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderstatus").alias("status"))
    return rows.rollup("y", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nation_revenue",
    """select n_name as nation, floor(sum(l_extendedprice * (1 - l_discount)) / 1000 + 0.5) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by 1""",
)
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    rows = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000 + 0.5).cast("double").alias("revenue"))


@query("customers_without_orders", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("set_operations", "(select n_regionkey as x from nation union select s_nationkey from supplier) except select c_nationkey from customer where c_acctbal > 9900 intersect select 3")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("x"))
    some = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("x"))
    three = spark.range(1).select(F.lit(3).alias("x"))
    return t("nation", "n_regionkey").union(t("supplier", "s_nationkey")).distinct().exceptAll(some.intersect(three))


@query("tumbling_days", f"with {EVENTS} select cast(floor(at_ms / {DAY}) * {DAY} as bigint) as start_ms, event_type, count(*) as n, {r('sum(value)')} as total from ev group by 1, 2")
def tumbling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = ev.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("value")).alias("total"))
    return g.select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n", "total")


@query("sliding_windows", f"with {EVENTS}, s as (select *, unnest([0, 1, 2, 3]) as back from ev) select cast((floor(at_ms / {DAY // 4}) - back) * {DAY // 4} as bigint) as start_ms, count(*) as n from s group by 1")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.window("ts", "1 day", "6 hours")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("window.start").alias("start_ms"), "n")


@query(
    "preference_graph",
    f"""with {EVENTS}, p as (select k, (k * 7 + user_id) % 100 as j, value from ev), e as (select case when value > 50 then k else j end as id, 1 as w from p union all select case when value > 50 then j else k end, 0 from p) select id, cast(sum(w) as bigint) as wins, count(*) as n from e group by 1""",
)
def preference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = (F.col("k") * 7 + F.col("user_id")) % 100
    won, lost = F.when(F.col("value") > 50, F.col("k")).otherwise(other), F.when(F.col("value") > 50, other).otherwise(F.col("k"))
    spread = events(spark, sf_dir).select(F.explode(F.array(F.struct(won.alias("id"), F.lit(1).alias("w")), F.struct(lost.alias("id"), F.lit(0).alias("w")))).alias("e"))
    return spread.groupBy("e.id").agg(F.sum("e.w").alias("wins"), F.count(F.lit(1)).alias("n"))


@query(
    "bayesian_trend",
    f"""with {EVENTS}, g as (select k, count(*) filter (where at_ms < {NOW - 15 * DAY}) * 1.0 as p, count(*) filter (where at_ms >= {NOW - 15 * DAY}) * 1.0 as c from ev group by 1),
    x as (select *, (c - p) / greatest(1, p) as raw, (p + c) / greatest(1, p + c + 50) as rel from g), y as (select *, raw * rel as post, sqrt(1 / (c + 1) + 1 / (p + 1)) * rel as se from x)
    select k, {r('post')} as growth, {r('post - 1.96 * se')} as low, {r('post + 1.96 * se')} as high, {r(c01('rel * (1 - least(1, se))'))} as confidence from y""",
)
def bayesian_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("at_ms") >= NOW - 15 * DAY
    g = events(spark, sf_dir).groupBy("k").agg(F.count_if(~late).cast("double").alias("p"), F.count_if(late).cast("double").alias("c"))
    reliability = (F.col("p") + F.col("c")) / F.greatest(F.lit(1.0), F.col("p") + F.col("c") + 50)
    post = (F.col("c") - F.col("p")) / F.greatest(F.lit(1.0), F.col("p")) * reliability
    error = F.sqrt(1 / (F.col("c") + 1) + 1 / (F.col("p") + 1)) * reliability
    return g.select("k", half_up(post).alias("growth"), half_up(post - 1.96 * error).alias("low"), half_up(post + 1.96 * error).alias("high"), half_up(clamp(reliability * (1 - F.least(F.lit(1.0), error)))).alias("confidence"))
