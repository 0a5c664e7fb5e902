"""Queues, tempo, sound, journeys, presence and growing graphs against plain Python."""

import collections
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import grammar, moves, records
from tessella.functions.journeys import INTENTS, journey
from tessella.functions.scalars import clamp, once
from tessella.operators import beats, graph, neighbours, queues, sequences
from tessella.operators import moves as move_choice
from tessella.operators.folds import rounded
from tessella.plans import mixes, registry
from tessella.streaming import events as streaming


def test_once_and_clamp(spark):
    row = spark.range(1).select(once(F.rand(), lambda x: F.array(x, x)).alias("two"), clamp(F.lit(None).cast("double")).alias("none"), clamp(F.lit(-3.0)).alias("low"), clamp(F.lit(9.0), 1.0, 2.0).alias("high")).first()
    assert row.two[0] == row.two[1] and (row.none, row.low, row.high) == (None, 0.0, 2.0)


def plain_queue(items, window=3):
    """Windows that are sorted again and again, each sort keeping the order of equals."""
    out, k = [], 0
    while k < len(items):
        if items[k][1]:
            out.append(items[k])
            k += 1
            continue
        held = []
        while k < len(items) and len(held) < window and not items[k][1]:
            held.append(items[k])
            k += 1
        while held:
            before = out[-1][2] if out else None
            held.sort(key=lambda x: -rounded(0.0 if before is None else 1 - abs(before - x[2]), 6))
            out.append(held.pop(0))
    return [x[0] for x in out]


@pytest.mark.parametrize("window", [1, 3, 5])
def test_ordered_queue(spark, window):
    rng = random.Random(window)
    lists = {k: [(f"{k}-{i}", rng.random() < 0.3, rng.choice([0.1, 0.2, 0.5, 0.9, rng.random()])) for i in range(rng.choice([1, 2, 7, 40]))] for k in range(20)}
    rows = [(k, i, *x) for k, items in lists.items() for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "k long, i long, item string, pin boolean, u double").repartition(3)
    got = queues.ordered_queue(df, "k", ["i"], "item", "pin", ["u"], lambda a, b: 0.0 if a is None else 1 - abs(a[0] - b[0]), window).collect()
    for k, items in lists.items():
        assert [r["item"] for r in sorted((r for r in got if r.k == k), key=lambda r: r.place)] == plain_queue(items, window)


def plain_segments(y, penalty):
    f, came = [-penalty], [0]
    s, q = np.concatenate(([0], np.cumsum(y))), np.concatenate(([0], np.cumsum(np.square(y))))
    for t in range(1, len(y) + 1):
        costs = [f[a] + penalty + q[t] - q[a] - (s[t] - s[a]) ** 2 / (t - a) for a in range(t)]
        k = int(np.argmin(costs))
        f.append(costs[k])
        came.append(k)
    out, end = [], len(y)
    while end > 0:
        out.append((came[end], end - came[end]))
        end = came[end]
    return f[-1], out[::-1]


@pytest.mark.parametrize("seed", range(6))
def test_segments_are_the_best_cut(seed):
    rng = random.Random(seed)
    y = []
    for _ in range(rng.randint(1, 6)):
        level = rng.uniform(60, 180)
        y += [level + rng.gauss(0, 3) for _ in range(rng.randint(1, 40))]
    for penalty in (1.0, 30.0, 500.0, 1e9):
        found = beats.Segments(penalty)
        for v in y:
            found.add(v)
        cost, pieces = plain_segments(y, penalty)
        assert [(b, n) for b, n, _ in found.pieces()] == pieces and abs(found.best - cost) < 1e-5 * max(1, abs(cost))
        assert all(abs(level - np.mean(y[b : b + n])) < 1e-6 for b, n, level in found.pieces())


def test_long_series_hold_few_beginnings():
    rng, found, most = random.Random(1), beats.Segments(60.0), 0
    for k in range(6000):
        found.add(100 + 20 * (k // 2000) + rng.gauss(0, 2))
        most = max(most, len(found.open))
    assert most < 200 and [n for _, n, _ in found.pieces()] == [2000, 2000, 2000]


def test_segments_of_rows(spark):
    rows = [("a", k, 100.0 if k < 5 else 140.0) for k in range(12)] + [("b", 0, None), ("c", 0, 90.0), ("c", 1, None)]
    got = beats.segments(spark.createDataFrame(rows, "k string, n long, v double").repartition(3), "k", ["n"], "v", 50.0)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0, 5, 100.0, 0.0, 1.0), ("a", 1, 5, 7, 140.0, 40.0, 0.996), ("c", 0, 0, 1, 90.0, 0.0, 1.0)]


def test_tempo_of_a_steady_and_a_changing_grid(spark):
    steady, changing = [0.5 * k for k in range(60)], [0.0]
    for k in range(60):
        changing.append(changing[-1] + (0.5 if k < 30 else 0.4) + (3.0 if k == 40 else 0))
    rows = [("s", t) for t in steady] + [("c", t) for t in changing] + [("one", 1.0)] + [("few", 0.5 * k) for k in range(4)]
    df = spark.createDataFrame(rows, "k string, t double").repartition(3)
    got = {r.k: r for r in beats.tempo_report(df, "k", "t").collect()}
    assert (got["s"].median_bpm, got["s"].drift_bpm, got["s"].variable, got["s"].confidence) == (120.0, 0.0, False, 1.0)
    assert (got["c"].min_bpm, got["c"].max_bpm, got["c"].variable) == (120.0, 150.0, True) and "one" not in got
    told = sorted(map(tuple, beats.tempo_changes(df, "k", "t").collect()))
    assert told == [("c", 0, 120.0), ("c", 32, 150.0), ("few", 0, 120.0), ("s", 0, 120.0)]


def test_downbeat_and_sound_by_hand():
    rate, interval = 1000.0, 0.1
    x = np.zeros(4000)
    for k in range(40):
        x[100 * k : 100 * k + 20] = 0.9 if k % 4 == 2 else 0.2
    times = np.arange(40) * interval
    assert beats.downbeat(x, rate, times, interval) == 2 and beats.downbeat(x, rate, times[:7], interval) == 0
    keep = 1 - math.exp(-2 * math.pi * beats.CORNER / rate)
    levels = collections.defaultdict(list)
    for i, t in enumerate(times):
        low = energy = 0.0
        for j in range(round(t * rate), round(t * rate) + 20):
            low += keep * (x[j] - low)
            energy += low * low
        levels[i % 4].append(math.sqrt(energy / 20))
    assert max(levels, key=lambda p: np.mean(levels[p])) == 2
    faded = np.concatenate([np.full(2000, 0.01), np.full(4000, 0.5), np.full(3000, 0.01)])
    energy, punch, ends, intro = beats.sound(faded, rate)
    assert (ends, intro) == (6.0, 2.0) and energy == 1.0 and 0 < punch < 1
    assert beats.sound(np.zeros(0), rate) == (0.0, 0.0, 0.0, 0.0) and beats.sound(np.zeros(5000), rate) == (0.0, 0.0, 5.0, 0.0)


def test_sound_of_rows(spark):
    rows = [(1, bytearray(b"ab cd " * 2000)), (2, None), (3, bytearray(b""))]
    got = {r.k: r for r in beats.sound_profiles(spark.createDataFrame(rows, "k long, raw binary"), "k", "raw", 2000.0, 0.0125).collect()}
    assert len(got) == 3 and got[1].energy > 0 and (got[2].downbeat, got[2].energy, got[3].ends) == (0, 0.0, 0.0)


def plain_journey(now, to, phase, skips, likes, flat, recent, length):
    c = lambda x: min(1.0, max(0.0, x))
    now, to, flat, intent, friction = c(now), c(to), c(flat), INTENTS[phase], c((skips - likes) / 5)
    most = 0.13 - friction * 0.065
    wanted = max(-most, min(most, to - now))
    contrast = flat >= 0.58 and abs(wanted) < 0.055
    if contrast:
        wanted = (-1 if phase in ("reset", "cooldown") else 1) * (0.045 + flat * 0.035)
    nxt, n, path, roles = c(now + wanted), max(2, min(8, math.floor(length + 0.5))), [], []
    for k in range(1, n + 1):
        lift = math.sin(k / n * math.pi) * 0.025 if intent == "peak" else 0.0
        path.append(rounded(nxt if k == 1 else c(now + (to - now) * (1 - (1 - k / n) ** 1.4) + lift)))
        roles.append("contrast" if contrast and k == 1 else "landing" if k == n and intent in ("breathe", "resolve") else "lift" if intent in ("build", "rebuild", "peak") else "hold" if intent == "hold" else "bridge")
    recent = [c(e) for e in recent]
    moves = [abs(b - a) for a, b in zip(recent[:-1], recent[1:], strict=True)]
    stability = c(1 - (sum(moves) / len(moves) if moves else 0.0) / 0.28)
    sure = c(0.35 + c(len(recent) / 6) * 0.38 + c((likes + skips) / 8) * 0.12 + stability * 0.15 - friction * 0.12)
    gap = nxt - now
    return intent, "up" if gap > 0.025 else "down" if gap < -0.025 else "hold", rounded(nxt), path, roles, rounded(stability), rounded(sure)


def test_journeys(spark):
    rng = random.Random(12)
    rows = [(rng.uniform(-0.2, 1.2), rng.random(), rng.choice(list(INTENTS)), rng.randint(0, 6), rng.randint(0, 6), rng.random(), [rng.random() for _ in range(rng.randint(0, 8))], float(rng.randint(0, 10))) for _ in range(200)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, now double, to double, phase string, skips long, likes long, flat double, recent array<double>, length double")
    got = {r.k: tuple(r.j) for r in df.select("k", journey(*(F.col(c) for c in df.columns[1:])).alias("j")).collect()}
    assert [got[k] for k in range(len(rows))] == [plain_journey(*r) for r in rows]


def test_components_split_hubs_and_keep_loops(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 20)
    edges = [(0, k) for k in range(1, 200)] + [(300 + k, 301 + k) for k in range(50)] + [(500, 199), (700, 700), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    want = {k: 0 for k in [*range(200), 500]} | {k: 300 for k in range(300, 351)} | {700: 700}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges_of_a_growing_graph_are_written_once(spark, tmp_path, monkeypatch):
    """The query's folder keeps the items, and its edges, which are the result, come of them as they are read."""
    rng = random.Random(8)
    items = [(k, rng.choice([rng.uniform(0, 10_000), 500.0])) for k in range(150)]
    spark.createDataFrame(items, "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/in/supplier.parquet")
    monkeypatch.setattr(mixes, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    df = mixes.growing_graph(spark, f"{tmp_path}/in")
    assert sorted(p.name for p in (tmp_path / "graph").iterdir()) == ["items"]
    assert {p.name for p in (tmp_path / "graph/items").iterdir()} == {"batch=0", "batch=1", "batch=2"}
    want = sorted((a, b, rounded(1 - abs(x - y) / 11000)) for a, x in items for b, y in items if a < b and rounded(1 - abs(x - y) / 11000) >= 0.9)
    assert sorted(map(tuple, df.collect())) == want


def test_growing_graph_is_the_whole_one(spark, tmp_path):
    rng = random.Random(3)
    items = [(k, rng.choice([rng.uniform(0, 100), 50.0])) for k in range(120)]
    score = 1 - F.abs(F.col("a_v") - F.col("b_v")) / 100
    df = spark.createDataFrame([(k, v, k % 3) for k, v in items], "k long, v double, part int")
    reached = []
    for batch in (0, 1, 1, 2):  # a batch that is run again replaces what it wrote
        reached.append(graph.extend_edges(spark, str(tmp_path), batch, df.where(F.col("part") == batch).drop("part"), "k", score, 0.95, ("v", 5.06)))
    got = sorted(map(tuple, graph.kept_edges(spark, str(tmp_path)).collect()))
    want = sorted((a, b, rounded(1 - abs(x - y) / 100)) for a, x in items for b, y in items if a < b and rounded(1 - abs(x - y) / 100) >= 0.95)
    assert got == want and reached[0] == 0 and reached[1] == reached[2] and all(r <= 40 * k for k, r in zip((0, 1, 1, 2), reached, strict=True))


GAP = 3_600_000


def plain_presences(rows):
    out, stays = [], {}
    for user, at, event, _ in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        stay = stays.get(user)
        if stay and at > stay[1] + GAP:
            out.append((user, stay[0], stay[1] + GAP, "timeout", stay[2], stay[3]))
            stay = None
        if event == "left":
            if stay:
                out.append((user, stay[0], at, "left", 0.0, stay[3]))
            stay = None
        elif stay is None or event == "joined":
            if stay:
                out.append((user, stay[0], at, "joined", stay[2], stay[3]))
            stay = (at, at, 0.15 if event == "joined" else 1.0, 1)
        else:
            stay = (stay[0], stay[1] if event == "inactive" else at, streaming.presence_weight(stay[2], event, at, stay[0]), stay[3] + 1)
        stays[user] = stay
    out += [(u, s[0], s[1] + GAP, "timeout", s[2], s[3]) for u, s in stays.items() if s]
    return sorted(out)


@pytest.mark.parametrize("files", [2, 7])
def test_presence_does_not_depend_on_the_batches(spark, tmp_path, files):
    """A stream of several files gives what a fold over all rows does; rows behind the watermark are dropped."""
    rng, start = random.Random(5), 1_700_000_000_000
    rows = [(rng.randint(0, 9), start + int(k * 400_000 + rng.randint(0, 300_000)), rng.choice(["joined", "active", "active", "inactive", "left"]), k) for k in range(400)]
    ends = start + 400 * 400_000
    parts = [[r for r in rows if (r[1] - start) * files // (ends - start + 1) == k] for k in range(files)]
    late = [(3, start + 1, "joined", 1000 + k) for k in range(5)]
    parts += [late, [(-1, ends + 100 * GAP, "active", 2000)], [(-1, ends + 200 * GAP, "active", 2001)]]
    for part in parts:
        df = spark.createDataFrame([(u, datetime.datetime.fromtimestamp(at / 1000, datetime.UTC), e, s) for u, at, e, s in part], "user_id long, ts timestamp, event string, seq long")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp, event string, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streaming.run_to_folder(streaming.presences(stream, "user_id", GAP, "1 minute"), f"{tmp_path}/out", "append")
    assert sorted(tuple(r) for r in got.where("user_id >= 0").collect()) == plain_presences(rows)


def test_few_tasks_keep_the_state_of_a_stream(spark, tmp_path):
    """Each takes its time in every batch, so there are no more than cores can make use of; the session's setting stays."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame([(k, 1, 1, False) for k in range(50)], "k long, seq long, revision long, snapshot boolean").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        frames = spark.readStream.schema("k long, seq long, revision long, snapshot boolean").parquet(f"{tmp_path}/in")
        got = streaming.run_to_folder(streaming.envelopes(frames, "k"), f"{tmp_path}/out", "append")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in (tmp_path / "out/state/state/0").iterdir() if p.name.isdigit()]) == 2 * spark.sparkContext.defaultParallelism
    assert got.count() == 50 and {r.verdict for r in got.collect()} == {"applied"}


def test_envelopes_with_gaps_and_snapshots(spark, tmp_path):
    files = [[(1, 1, False), (2, 2, False), (3, 2, False)], [(4, 4, False), (5, 5, False), (6, 3, False)], [(7, 9, False), (8, 12, True), (9, 13, False), (10, 11, True)]]
    for part in files:
        spark.createDataFrame([("a", *x) for x in part], "k string, seq long, revision long, snapshot boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    frames = spark.readStream.schema("k string, seq long, revision long, snapshot boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streaming.run_to_folder(streaming.envelopes(frames, "k"), f"{tmp_path}/out", "append").orderBy("seq").collect()
    assert [r.verdict for r in got] == ["applied", "applied", "stale", "gap", "gap", "applied", "gap", "snapshot", "applied", "stale"]


def test_streams_fold_a_bucket_of_keys_at_a_time(spark, tmp_path, monkeypatch):
    """Keys that share a bucket, and rows without a key, keep a state of their own; a part of several files is one batch."""
    monkeypatch.setattr(streaming, "BUCKETS", 3)
    keys = [*range(40), None]
    rows = [(k, s, s + s // 4, s % 7 == 0, s // 10) for k in keys for s in range(1, 30)]
    plans = []

    def made(stream):
        plans.append(streaming.envelopes(stream, "k"))
        return plans[-1]

    df = spark.createDataFrame(rows, "k long, seq long, revision long, snapshot boolean, part int").repartition(5)
    got = {(r.k, r.seq): r.verdict for r in mixes._replayed(df, f"{tmp_path}/replay", 3, made).collect()}
    want = {}
    for k in keys:
        last = 0
        for _, s, r, whole, _ in (x for x in rows if x[0] == k):
            want[k, s] = "stale" if r <= last else "snapshot" if whole else "applied" if r == last + 1 else "gap"
            last = r if want[k, s] in ("snapshot", "applied") else last
    assert got == want
    assert "_bucket" in plans[0]._jdf.queryExecution().analyzed().toString()
    starts = [(k, datetime.datetime.fromtimestamp(1_700_000_000 + 60 * i, datetime.UTC), e, i) for k in keys for i, e in enumerate(["joined", "active", "inactive"])]
    ahead = [(-1, datetime.datetime.fromtimestamp(1_800_000_000, datetime.UTC), "active", 9)]
    stays = spark.createDataFrame([(*r, 0) for r in starts] + [(*r, p) for r in ahead for p in (1, 2)], "user_id long, ts timestamp, event string, seq long, part int").repartition(3)
    ended = mixes._replayed(stays, f"{tmp_path}/stays", 3, lambda s: streaming.presences(s, "user_id", GAP, "1 minute")).collect()
    assert {tuple(r) for r in ended} == {(k, 1_700_000_000_000, 1_700_000_060_000 + GAP, "timeout", 0.208, 3) for k in keys} and len(ended) == len(keys)


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_places_after_edits(spark, n):
    df = queues.places(spark.createDataFrame([("u", 10 * k) for k in range(n)], "k string, i long"), "k", ["i"])
    items = [10 * k for k in range(n)]

    def after(place):
        return [r.i for r in df.withColumn("to", place).where("to is not null").orderBy("to").collect()]

    assert after(queues.without(F.col("at"), 1)) == items[:1] + items[2:] and after(queues.jumped(F.col("at"), 2)) == items[2:]
    for start, to in ((0, 2), (2, 0), (1, 1), (0, 9)):
        want = list(items)
        if start < n:
            want.insert(to, want.pop(start))
            assert after(queues.moved(F.col("at"), F.col("n"), start, to)) == want


def test_moves_by_hand(spark):
    given = {
        "analysed": True, "gap": 0.01, "close": True, "plausibility": 0.9, "ratio": 1.01, "key_score": 0.8, "high_energy": True, "outro": True, "intro": 4.0, "stem_ready": True, "stem": 88.0, "risk": 0.1, "vocal_score": 80.0, "vocal_safe": True,
        "g0": "edm", "g1": "pop", "c0": 1.0, "c1": 0.8, "base": "blend",
    }
    kinds = "k long, analysed boolean, gap double, close boolean, plausibility double, ratio double, key_score double, high_energy boolean, outro boolean, intro double, stem_ready boolean, stem double, risk double, vocal_score double, vocal_safe boolean, g0 string, g1 string, c0 double, c1 double, base string"
    rows = [given, given | {"analysed": False, "gap": None, "close": False, "base": "acapella"}, given | {"gap": 0.3, "close": False, "base": "riser"}, given | {"high_energy": False, "key_score": 0.4, "g0": "other", "base": "fade"}]
    df = spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rows)], kinds)
    c = lambda n: F.col(n)
    own = {n: c(n) for n in moves.Pair.__dataclass_fields__ if n not in ("genres", "confidences")}
    pair = moves.Pair(**own, genres=(c("g0"), c("g1")), confidences=(c("c0"), c("c1")))
    told = spark.createDataFrame([("type:blend", -10.0), ("type-tempo:blend:tempo:0-2", 5.0), ("type-key:cut:key:compatible", 10.0)], "key string, bias double")
    got = {(r.k, r.move): r for r in move_choice.ranked_moves(df, "k", pair, told).collect()}
    assert {m for k, m in got if k == 0} == set(moves.MOVES) and {m for k, m in got if k == 1} == {"fade", "blend", "acapella"}
    assert {m for k, m in got if k == 2} == {"fade", "echo", "cut", "spinback", "riser"} and {m for k, m in got if k == 3} == {"fade", "echo", "blend", "filter"}
    beat, sure = 90.0, 0.8 * 0.65 + 0.9 * 0.35
    blend = 94 * 0.2 + 80 * 0.16 + 78 * 0.14 + beat * 0.1 + (48 + beat * 0.28 + 18) * 0.08 + 88 * 0.08 + 95.5 * 0.08 + 90 * 0.06 + rounded(72 + (88 - 72) * sure, 1) * 0.1
    row = got[0, "blend"]
    assert (row.musical, row.bias, row.score) == (rounded(blend, 1), -3.0, rounded(rounded(blend, 1) - 3.0 + 3.0, 1))
    assert got[0, "cut"].bias == 4.0 and got[0, "fade"].bias == 0.0  # the first known key weighs most
    acapella = 94 * 0.2 + 80 * 0.16 + 78 * 0.14 + 9.0 + (48 + beat * 0.28 + 18) * 0.08 + 88 * 0.08 + 80 * 0.08 + 90 * 0.06 + rounded(72 + (77 - 72) * sure, 1) * 0.1 + 16 * 0.15
    assert got[0, "acapella"].musical == rounded(acapella, 1)
    chosen = {r.k: (r.move, r.switched) for r in move_choice.preferred_moves(move_choice.ranked_moves(df, "k", pair, told), "k").collect()}
    for k, (move, switched) in chosen.items():
        best, base = min((r for (i, _), r in got.items() if i == k), key=lambda r: r.place), got[k, rows[k]["base"]]
        assert (move, switched) == ((best.move, True) if best.score - base.score >= 4 else (base.move, False))
    quiet = spark.createDataFrame([(90.0, False, False, "fade")] * 3, "score double, fallback boolean, negative boolean, move string")
    assert {r.bias for r in move_choice.feedback_profile(quiet, "move", F.lit(1.0), F.lit(0.9), F.lit(0.0)).collect()} == {1.8}


def said(spark, of, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r.x for r in df.select("k", of(F.col("t")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize("name", ["ranked_moves", "preferred_moves"])
def test_moves_send_only_the_feedback(spark, small_dir, name):
    """However small the events look on disk, their moves are not broadcast."""
    df = registry.queries()[name](spark, small_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert len(joins) == 4 and all("rightHint=(strategy=broadcast)" in x for x in joins)


@pytest.mark.parametrize("name", ["ranked_moves", "preferred_moves"])
def test_moves_are_made_by_all_cores(spark, small_dir, name):
    """A small file of events is read by one task; their moves are made and ranked by four for each core."""
    df = registry.queries()[name](spark, small_dir)
    assert df.select(F.spark_partition_id().alias("task")).distinct().count() == 4 * spark.sparkContext.defaultParallelism


def test_requests_fill_slots(spark):
    got = said(spark, grammar.request, ["Erst chill, dann Party in 45 min mit mehr Energie", "one hour romantisch, ruhiger", "in 2 stunden feiern", "90min steigern", "", None, "mehr davon, energie", "9999 min", "30 - min club"])
    want = [("chill", "party", 45, "rising", 1.0), ("chill", "love", 60, "falling", 0.94), ("party", "party", 120, "steady", 0.57), ("chill", "chill", 90, "rising", 0.5), ("chill", "chill", 30, "steady", 0.35), None,
            ("energy", "energy", 30, "steady", 0.57), ("chill", "chill", 240, "steady", 0.35), ("party", "party", 30, "steady", 0.57)]
    assert [None if w is None else tuple(g) for g, w in zip(got, want, strict=True)] == want


def test_words_end_where_ascii_does(spark):
    """As a boundary of RE2 and JavaScript has it; digits before a unit are those next to it."""
    got = said(spark, grammar.request, ["die stunde öein", "stunde ein_", "stunde x_an", "a1b2min", "x_5 min", "5_min"])
    assert [g.minutes for g in got] == [60, 240, 240, 2, 5, 30]
    got = said(spark, grammar.description, ["ö1990s", "x1990s", "_1990s 2010sö", "7ö1980s"])
    assert [g.decade for g in got] == [1990, None, 2010, 1980]
    got = said(spark, grammar.command, ["hey dj play beundüüver", "hey dj play be undüüver", "hey dj 𝒜lles spielen 𝒜b", "hey dj öspiel mal"])
    assert [g.query for g in got] == ["beundüüver", "be üüver", "𝒜lles 𝒜b", "ö mal"]


def test_descriptions_fill_slots(spark):
    got = said(spark, grammar.description, ["1990s Synth-pop with female vocals and piano", "male vocal, violins", "mixed vocals", "vocals by a female", "2050s 1985s guitars", ""])
    assert [(list(g.instruments), g.voice, g.decade) for g in got] == [(["piano", "synth"], "female", 1990), (["violin"], "male", None), ([], "mixed", None), ([], None, None), (["guitar"], None, 2050), ([], None, None)]


def test_commands(spark):
    texts = ["Hey DJ, skip this please", "hey dj play higher power von Coldplay", "hey tj pause", "yo dj was läuft gerade?", "hey dj kannst du Mr Brightside spielen", "hey dj play", "hey dj skipper", "hey dj uberspringian", "hello there skip", "hey dj l e a r", "hey dj", "", None, "hey dj quarterly figures", "dj louder"]
    want = [("skip", None), ("play", "higher power coldplay"), ("pause", None), ("nowPlaying", None), ("play", "mr brightside"), ("resume", None), ("skip", None), ("skip", None), None, None, None, None, None, None, ("volumeUp", None)]
    got = said(spark, grammar.command, texts)
    assert [None if g is None or g.kind is None else tuple(g) for g in got] == want


def test_fingerprints_of_three_versions(spark):
    import json

    old = {"version": 1, "experienceDNA": {"weights": {"chill": 3, "party": 1, "odd": 5, "love": -2}, "targetEnergy": 2}, "energyCurve": [0.2, 1.7, -1] + [0.5] * 70, "mixPersonality": {"tempoTolerance": 0.9, "vocalOverlap": "x"}, "genreDistribution": {"rock": 2, "pop": 2}, "sampleSize": 7.9, "extra": {"a": [1]}}
    new = {"version": 3, "moods": {"weights": {"energy": 1}}, "curve": [0.1], "personality": {}, "confidence": 0.4}
    bodies = [json.dumps(old), json.dumps(new), json.dumps(old | {"version": 9}), "{", json.dumps(new | {"curve": []}), json.dumps(new | {"moods": {}}), None, "[]"]
    got = said(spark, records.fingerprint, bodies)
    assert [g.fault for g in got] == [None, None, "version", "json", "curve", "moods", "json", "json"]
    a, b = got[:2]
    assert (a.moods.chill, a.moods.party, a.moods.love, a.target, len(a.curve), a.curve[-1], a.samples) == (0.75, 0.25, 0.0, 1.0, 64, 0.5, 7)
    assert (a.mix.tempoTolerance, a.mix.vocalOverlap, a.genres, list(a.others)) == (0.25, 0.12, {"rock": 0.5, "pop": 0.5}, ["extra"]) and '"a":[1]' in a.others["extra"].replace(" ", "")
    assert (b.version, b.moods.energy, b.curve, b.confidence, b.samples, b.others) == (3, 1.0, [0.1], 0.4, 1, {})


def test_faults_of_overrides(spark):
    good = '{"transitionType": "cut", "fadeSec": 4}'
    cases = {good: None, "{": "object", "[]": "object", "{}": "intent", '{"fadeSec": 61}': "fade", '{"toTrackId": " ", "fadeSec": 2}': "to", '{"transitionType": "acapella", "stemUsage": "forbid"}': "conflict", '{"fadeSec": 2, "expiresAtMs": 5}': "expired",
             '{"neverMixRegions": [{"track": "next", "start": 3, "end": 2}]}': "regions", '{"neverMixRegions": [{"track": "next", "start": 1, "end": 2}]}': None, '{"preserveSection": "drop"}': None, '{"preserveSection": "solo"}': "section"}
    assert said(spark, lambda t: records.override_fault(t, 10, ("drop",)), list(cases)) == list(cases.values())


def test_plans_and_handovers(spark):
    on, off = F.lit(True), F.lit(False)
    every = dict.fromkeys(("raw", "decks", "crossfade", "effects", "stems", "rate", "eq"), on)
    plan = lambda move, **can: tuple(spark.range(1).select(records.gated_plan(F.lit(move), F.lit(6.0), F.lit(1.1), on, every | can).alias("p")).first().p)
    assert plan("echo") == ("echo", 6.0, 1.1, True, "full-engine", [])
    assert plan("echo", effects=off, rate=off, eq=off) == ("blend", 6.0, 1.0, False, "full-engine", ["effect:echo", "tempo-sync", "eq-sweep"])
    assert plan("acapella", stems=off, raw=off) == ("blend", 6.0, 1.1, True, "smart-crossfade", ["stem-mix"])
    assert plan("cut", decks=off, crossfade=off) == ("cut", 0.05, 1.0, False, "native-ordering", ["dual-deck-transition"])
    for scores, sure, n, committed in (([0.7] * 4, [0.6] * 4, 4, True), ([0.7, 0.6, 0.9, 0.9], [0.6] * 4, 2, False), ([0.1] * 4, [1.0] * 4, 1, False), ([0.7] * 4, [0.6, 0.5, 0.6, 0.6], 4, False)):
        h = spark.range(1).select(records.handover(F.array(*map(F.lit, scores)), F.array(*map(F.lit, sure))).alias("h")).first().h
        assert (len(h.stages), h.committed) == (n, committed)


def test_payoffs(spark):
    rows = [("a", 0, "verse", 0.0, 10.0, 0.3, 0.5), ("a", 1, "build", 10.0, 20.0, 0.5, 0.5), ("a", 2, "drop", 20.0, 40.0, 0.9, 0.9), ("b", 0, "build", 0.0, 60.0, 0.5, 0.5), ("b", 1, "chorus", 60.0, 70.0, 0.9, 0.5)]
    sections = spark.createDataFrame(rows, "k string, section long, type string, w_start double, w_end double, energy double, drums double")
    cuts = spark.createDataFrame([(1, "a", 5.0), (2, "a", 15.0), (3, "a", 39.0), (4, "a", 50.0), (5, "b", 10.0), (6, "b", 50.0)], "i long, k string, cut double")
    got = {r.i: tuple(r)[1:] for r in sequences.payoff_cuts(cuts, sections, "i", "k", "cut").collect()}
    assert got == {1: (False, 0.236, 2, 35.0), 2: (True, 1.0, 2, 25.0), 3: (False, 0.2, None, None), 4: (False, 0.0, None, None), 5: (False, 1.0, None, None), 6: (True, 1.0, 1, 20.0)}


@pytest.mark.parametrize("values", ["spread", "ties", "few"])
def test_best_partners_against_all_pairs(spark, values):
    """Ties beyond the first neighbours, by equal values and by rounding, and a bonus that brings far items near."""
    rng = random.Random(6)
    n = {"spread": 120, "ties": 90, "few": 4}[values]
    items = [(k, 5.0 if values == "ties" and k % 3 else rng.uniform(0, 100), rng.randint(0, 3)) for k in range(n)]
    score = lambda d, same: 0.4 + 0.4 * (1 - d / 100) + 0.2 * same.cast("int")
    df = spark.createDataFrame(items, "k long, v double, g long").repartition(3)
    got = {(r.k, r.nth): (r.other, r.edge) for r in neighbours.best_partners(df, "k", "v", "g", score, 5, near=2).collect()}
    want = {}
    for a, x, g in items:
        edges = sorted((-rounded(0.4 + 0.4 * (1 - abs(x - y) / 100) + 0.2 * (g == h)), b) for b, y, h in items if b != a)[:5]
        want |= {(a, k + 1): (b, -e) for k, (e, b) in enumerate(edges)}
    assert got == want


def test_edges_are_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([(k, 1, k * 10.0) for k in range(30)], "k long, b int, v double")
    got = graph.compatibility_edges(df, "k", "b", 1 - F.abs(F.col("a_v") - F.col("b_v")) / 100, 0.5, ("v", 50.6))
    assert sorted((r.src, r.dst) for r in got.collect()) == [(x, y) for x in range(30) for y in range(30) if x != y and abs(x - y) <= 5]
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()
