"""Exact values and edge cases of operators that work on small literal tables."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import evidence, text
from tessella.functions.scalars import all_failed, camelot_score, clamped_index, first_failed, floor_index, half_up, index_percentiles, ladder, octave_folded, tempo_relation, wilson
from tessella.operators import calibration, folds, fusion, graph, groups, joins, ledger, prefixes, ranking, sequences, sets, signals, studies, telemetry
from tessella.sources import jsonl, tables
from tessella.streaming import events as streaming


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rounding_is_half_up(spark):
    assert one(spark, *(half_up(F.lit(x), 0) for x in (-2.5, 2.5, -0.5, 0.5, 1.4999))) == (-2.0, 3.0, 0.0, 1.0, 1.0)


def test_wilson(spark):
    none, some = one(spark, wilson(F.lit(0), F.lit(0)), wilson(F.lit(8), F.lit(10)))
    assert tuple(none) == (0.0, 1.0)
    assert some.low == pytest.approx(0.490162, abs=1e-5) and some.high == pytest.approx(0.943318, abs=1e-5)


def test_percentile_conventions(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 2, 3)] + [("b", 7.0)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in index_percentiles(df, ["k"], "v", {"p50": floor_index(0.5), "p95": floor_index(0.95), "c95": clamped_index(0.95)}).collect()}
    assert got == {"a": (3.0, 4.0, 5.0), "b": (7.0, 7.0, 7.0)}


def test_gates_and_ladders(spark):
    gates = [("a", F.lit(True)), ("b", F.lit(None).cast("boolean")), ("c", F.lit(False))]
    assert one(spark, first_failed(gates), F.array_join(all_failed(gates), ","), first_failed(gates[:1])) == ("b", "b,c", None)
    steps = [(2, "x"), (6, "y")]
    assert one(spark, *(ladder(F.lit(v).cast("double"), steps, "z", "?") for v in (2, 2.1, 7, None))) == ("x", "y", "z", "?")


def test_music_scalars(spark):
    pairs = [("8A", "8A"), ("8A", "9A"), ("8A", "8B"), ("8A", "10A"), ("8A", "9B"), ("12A", "1A"), ("x", "8A")]
    assert one(spark, *(camelot_score(F.lit(a), F.lit(b)) for a, b in pairs)) == (1.0, 0.8, 0.7, 0.4, 0.0, 0.8, 0.0)
    assert one(spark, *(octave_folded(F.lit(float(x))) for x in (70, 140, 141, 280, 35, 34, 0))) == (70.0, 140.0, 70.5, 140.0, 70.0, 136.0, None)
    relations = [(120.0, 121.0), (70.0, 140.0), (140.0, 70.0), (120.0, 97.0)]
    assert [x.relation for x in one(spark, *(tempo_relation(F.lit(a), F.lit(b)) for a, b in relations))] == ["same", "half", "double", "unrelated"]


def test_trust_moves_slowly(spark):
    day = 86_400_000
    rows = [("done", 1.0, 100 * day)] * 8 + [("undo", 1.0, 100 * day)] * 2 + [("undo", 1.0, 0)]
    got = ledger.summary(spark.createDataFrame(rows, "kind string, weight double, at_ms long"), 100 * day, ["done"], ["undo"], ["search"]).first()
    assert (got.accepted, got.undone, got.evidence, got.trust) == (8.0, 2.0, 10, 0.53)


def test_saturating_fold(spark):
    rows = [("chill", k, 0.15) for k in range(4)]
    got = folds.saturating(spark.createDataFrame(rows, "g string, seq long, d double"), "g", ["seq"], "d").first()
    assert got.score == pytest.approx(1 - 0.85**4, abs=1e-6) and got.n == 4


def test_budget_and_debt(spark):
    df = spark.createDataFrame([("u", k, x) for k, x in enumerate([True, True, False, True])], "u string, seq long, x boolean")
    assert tuple(folds.budget(df, "u", ["seq"], "x", 1.0, 0.5, 0.25).first()) == ("u", 0.0, 2)
    assert tuple(folds.violation_debt(df, "u", ["seq"], "x").first()) == ("u", 0, 1)


def test_hysteresis_holds_below_the_margin(spark):
    rows = [("u", k, 0.0, 0.1) for k in range(5)] + [("u", k, 0.0, 1.0) for k in range(5, 9)]
    got = folds.hysteresis(spark.createDataFrame(rows, "u string, seq long, a double, b double"), "u", ["seq"], ["a", "b"], 0.28, 0.14).first()
    assert (got.state, got.switches) == ("b", 1)
    assert folds.hysteresis(spark.createDataFrame(rows[:5], "u string, seq long, a double, b double"), "u", ["seq"], ["a", "b"], 0.28, 0.14).first().state == "a"


def test_change_points(spark):
    rows = [("u", k, v) for k, v in enumerate([100.0, 101.0, 110.0, 111.0, 90.0])]
    got = folds.change_points(spark.createDataFrame(rows, "u string, seq long, v double"), "u", ["seq"], "v", 5.0, 0.01).first()
    assert (got.changes, got.last) == (3, 90.0)


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 1), (4, "b", 9), (5, None, 3)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 10, 2.0), ("a", 11, 3.0)], "k string, t long, v double")
    got = {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: None}


def test_interval_overlap_counts_each_pair_once(spark):
    segments = spark.createDataFrame([("a", 0.0, 100.0, 1), ("a", 95.0, 96.0, 2), ("a", 5.0, 5.0, 3), ("b", 0.0, 10.0, 4)], "k string, start double, end double, id int")
    windows = spark.createDataFrame([("a", 50.0, 99.0, 9)], "k string, w_start double, w_end double, w int")
    got = sorted((r.id, r.overlap) for r in joins.interval_overlap(segments, windows, "k", 7.0).collect())
    assert got == [(1, 49.0), (2, 1.0)]


def test_interval_overlap_takes_segments_without_length(spark):
    segments = spark.createDataFrame([("a", 60.0, 60.0, 1), ("a", 50.0, 50.0, 2), ("a", 99.0, 99.0, 3), ("a", 63.0, 63.0, 4)], "k string, start double, end double, id int")
    windows = spark.createDataFrame([("a", 50.0, 99.0, 9)], "k string, w_start double, w_end double, w int")
    got = sorted((r.id, r.overlap) for r in joins.interval_overlap(segments, windows, "k", 7.0).collect())
    assert got == [(1, 0.0), (4, 0.0)]


def test_band_semi_join(spark):
    left = spark.createDataFrame([("t", 1.0), ("t", 2.0)], "k string, v double")
    right = spark.createDataFrame([("t", 1.05, "x"), ("t", 0.95, "y"), ("t", 2.05, "x"), ("t", 2.01, "x")], "k string, v double, s string")
    assert [r.v for r in joins.band_semi_join(left, right, "k", "v", 0.06, 2, "s").collect()] == [1.0]


def test_rule_penalty(spark):
    items = spark.createDataFrame([(1, "t1", "a1"), (2, "t2", "a1"), (3, "t3", None)], "id long, track string, artist string")
    rules = spark.createDataFrame([("track", "t1", 0.5, True), ("artist", "a1", 0.4, False)], "type string, target string, weight double, hard boolean")
    got = {r.id: (r.penalty, r.blocked) for r in joins.rule_penalty(items, rules, "id", {"track": "track", "artist": "artist"}).collect()}
    assert got == {1: (0.7, True), 2: (0.4, False), 3: (0.0, False)}


def test_capped_chart(spark):
    rows = [("a1", "A", 1.0), ("a2", "A", 0.9), ("a3", "A", 0.9), ("b1", "B", 0.1)]
    got = ranking.capped_chart(spark.createDataFrame(rows, "id string, artist string, s double"), "s", "id", "artist", 2, 10)
    assert [r.id for r in got.collect()] == ["a1", "a2", "b1"]


def test_greedy_fill_skips_what_is_too_long(spark):
    rows = [("u", 1, 0.9, 20.0), ("u", 2, 0.8, 15.0), ("u", 3, 0.7, 11.0), ("u", 4, 0.6, 9.0)]
    got = folds.greedy_fill(spark.createDataFrame(rows, "u string, id long, s double, m double"), "u", "s", "m", "id", 30.0, 2.0).first()
    assert (got["items"], got.filled) == ([1, 3], 31.0)


def test_beam_routes(spark):
    items = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0)], "id int, x double")
    near = 1 - F.abs(F.col("tip_x") - F.col("x")) / 10
    got = ranking.beam_routes(items, "id", 0, near, 0.75, 2, 2).collect()
    assert [(r.route, r.score) for r in got] == [([0, 1, 2], 0.81), ([0, 1, 3], 0.72)]
    assert ranking.beam_routes(items, "id", 9, near, 0.75, 2, 2).count() == 0


def test_compatibility_routes(spark):
    items = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0), (3, 9.0)], "id int, x double")
    got = {r.first: (r.route, r.score) for r in studies.compatibility_routes(items, "id", 0, 1 - F.abs(F.col("tip_x") - F.col("x")) / 10, 2, 1, 0.5).collect()}
    assert got == {1: ("0/1", 0.9), 2: ("0/2/1", 0.833), 3: ("0/3/2", 0.167)}


def test_fusion(spark):
    schema = "entity string, value string, source string, family string, confidence double, weight double"
    rows = [("x", "8A", "s1", "f", 0.8, None), ("x", "8A", "s2", "f", 0.5, None), ("x", "9A", "s3", None, 0.1, None), ("x", None, "s4", None, 0.9, None), ("x", "9A", " ", None, 0.9, None)]
    got = fusion.fuse_categorical(spark.createDataFrame(rows, schema)).first()
    agreement = 1.3 / 1.4
    assert (got.value, got.conflicted) == ("8A", False) and got.confidence == pytest.approx(0.8 * agreement**2, abs=1e-4)
    numbers = [("t", 120.0, "a", 0.5, None), ("t", 121.0, "b", 0.5, None), ("t", 60.0, "c", 0.9, None)]
    best = fusion.fuse_numeric(spark.createDataFrame(numbers, "entity string, value double, source string, confidence double, weight double"), 2.0).first()
    assert (best.value, best.members) == (120.5, 2)


def test_fairness_window_keeps_the_last_tracks(spark):
    rows = []
    for k in range(12):
        rows += [(2 * k, k * 60_000, f"t{k}", "a", 0.8, 0.8, True), (2 * k + 1, k * 60_000, f"t{k}", "b", 0.8, 0.3, k < 2)]
    df = spark.createDataFrame(rows, "seq long, at_ms long, track_id string, user_id string, expected double, observed double, represented boolean")
    got = {r.user_id: (r.representation, r.debt) for r in groups.fairness_window(df, 11 * 60_000).collect()}
    assert got == {"a": (1.0, 0.0), "b": (0.0, 0.85)}


def test_crowd_taste_counts_missing_as_zero(spark):
    rows = [("u1", "rock", 0.8), ("u2", "rock", 0.6), ("u1", "jazz", 0.9)]
    got = {r.genre: r for r in groups.crowd_taste(spark.createDataFrame(rows, "user_id string, genre string, affinity double")).collect()}
    assert (got["rock"].consensus, got["rock"].shared) == (0.655, True)
    assert (got["jazz"].minimum, got["jazz"].contested, got["jazz"].variance) == (0.0, True, 0.2025)


def test_polarization(spark):
    df = spark.createDataFrame([("g", 0.0), ("g", 1.0), ("h", 0.4)], "k string, v double")
    assert {r.k: r.polarization for r in groups.polarization("v", "k", df).collect()} == {"g": 1.0, "h": 0.0}


def test_components_and_splits(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101)], "a long, b long")
    found = graph.components(edges)
    assert {r.component for r in found.where("node < 50").collect()} == {1} and {r.component for r in found.where("node > 50").collect()} == {100}
    done = graph.splits(found)
    assert graph.leaking_keys(done, "component", "split").count() == 0 and done.count() == 43


def test_merges(spark):
    a = spark.createDataFrame([("o1", 1, 0, "x"), ("o2", 5, 1, "x")], "op string, lamport long, seq long, side string")
    b = spark.createDataFrame([("o1", 3, 0, "y"), ("o2", 5, 2, "y")], "op string, lamport long, seq long, side string")
    assert {(r.op, r.side) for r in sets.merge_operations(a, b, "op", "lamport", ["seq"]).collect()} == {("o1", "y"), ("o2", "x")}
    rows = [("t1", "charts", 0.5), ("t1", "friends", 0.7), ("t2", "friends", 0.9), ("t3", "friends", 0.1)]
    got = sets.merge_sources(spark.createDataFrame(rows, "id string, src string, s double"), "id", "src", "id", "s", {"charts": 5, "friends": 2})
    assert {(r.id, r.s, r.sources) for r in got.collect()} == {("t1", 0.75, "charts,friends"), ("t2", 0.9, "friends")}


def test_sequences(spark):
    df = spark.createDataFrame([("u", k, v) for k, v in enumerate([1.0, 2.0, 4.0])], "u string, t long, v double")
    got = sequences.trend(df, "u", "t", "v").first()
    assert (got.velocity, got.acceleration, got.direction) == (1.5, 1.0, "rising")
    levels = [0.1] * 4 + [0.5] * 4 + [0.9] * 4 + [0.2] * 4 + [0.8] * 4
    found = sequences.sections(spark.createDataFrame([("u", k, v) for k, v in enumerate(levels)], "u string, t long, v double"), "u", "t", "v", 3).orderBy("run").collect()
    assert [r.kind for r in found] == ["intro", "build", "drop", "break", "drop"]
    spans = spark.createDataFrame([("u", 0.0, 10.0), ("u", 5.0, 6.0), ("u", 12.0, 13.0)], "u string, s double, e double")
    assert [tuple(r) for r in sequences.gaps(spans, "u", "s", "e", 2.0).collect()] == [("u", 10.0, 12.0)]


def test_calibration_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, p double, y int")
    assert calibration.calibration(empty, "k", "p", "y").count() == 0
    assert [r.n for r in calibration.reliability_bins(empty, "p", "y").collect()] == [0] * 10


def test_failure_rates_of_nothing(spark):
    kinds = spark.createDataFrame([("a",), ("b",)], "kind string")
    got = telemetry.failure_rates(spark.createDataFrame([], "kind string"), "kind", kinds).collect()
    assert {(r.kind, r.n, r.rate) for r in got} == {("a", 0, 0.0), ("b", 0, 0.0)}


def test_titles(spark):
    raw = "Some Artist - Great Song (Official Video) feat. Other"
    got = one(spark, text.clean_title(F.lit(raw), F.lit("X - Topic")), text.clean_title(F.lit("Song [4K]"), F.lit("Name - Topic")), text.title_variants(F.lit("Song (Live) feat. X")))
    assert tuple(got[0]) == ("Some Artist", "Great Song") and tuple(got[1]) == ("Name", "Song") and got[2] == ["Song (Live) feat. X", "Song (Live)", "Song"]
    assert one(spark, text.genre_of(F.lit("Deep House mix")), text.genre_of(F.lit("x")), text.version_of(F.lit("Song (Club Mix)"))) == ("edm", "unknown", "extended")
    assert one(spark, text.genre_of(F.lit("x"), F.lit("Lo-Fi Girl")), text.clean_title(F.lit("A & B – Song 'x' (Subtitulado)"), F.lit(None)), text.clean_title(F.lit("(Lyrics)"), F.lit("Some VEVO"))) == ("chill", ("A & B", "Song x"), ("Some", "(Lyrics)"))
    assert one(spark, text.title_variants(F.lit("Song - Radio Edit")), text.title_variants(F.lit("A {x} b (feat. C)")))  == (["Song - Radio Edit", "Song"], ["A {x} b (feat. C)", "A {x} b", "A b"])


def test_intent(spark):
    said = one(spark, text.intent(F.lit("Bitte kein Deutschrap, mehr Energie und in 20 Minuten Richtung Techno")), text.intent(F.lit("weniger Vocals, spiel Das Lied als nächstes")), text.intent(F.lit("hallo")))
    assert tuple(said[0]) == ("deutschrap", None, True, False, 20, "techno", None, 0.95)
    assert tuple(said[1]) == (None, "vocals", False, False, None, None, "das lied", 0.65) and tuple(said[2])[-1] == 0.45
    assert one(spark, text.path_id(F.lit("https://shop.example.com/de/track/123?u=1"), r"example\.com", "track", r"\d+"), text.path_id(F.lit("https://notexample.com/track/1"), r"example\.com", "track", r"\d+")) == ("123", None)


def test_timed_lines(spark):
    df = spark.createDataFrame([(1, "[00:01.50][01:00]hello\nplain\n[00:00.25] first\n[ar:x] [1:2] [100:00] [00.01:02] none")], "id int, lrc string")
    assert sorted((r.time_ms, r.line) for r in text.timed_lines(df, "id", "lrc").collect()) == [(250, "first"), (1500, "hello"), (60000, "hello")]


def test_signals(spark):
    import numpy as np

    t = np.arange(22_050) / 22_050
    df = spark.createDataFrame([("tone", (0.5 * np.sin(2 * np.pi * 440 * t)).tolist()), ("dc", [1.0] * 64), ("none", [])], "id string, x array<double>")
    got = {r.id: r for r in signals.spectra(df, "id", "x", 22_050).collect()}
    assert got["tone"].centroid == pytest.approx(440, abs=25) and got["none"].key_name is None and got["tone"].key_name.startswith("A ") and got["tone"].camelot in ("11B", "8A")
    h = {r.id: r.h for r in df.select("id", signals.health(F.col("x")).alias("h")).collect()}
    assert (h["dc"].peak, h["dc"].dc, h["dc"].clipped, h["none"].peak) == (1.0, 1.0, 1.0, 0.0)
    assert df.select(F.max(F.size(signals.rms_curve(F.col("x"), 1000)))).first()[0] == 22
    assert one(spark, signals.null_test(F.array(F.lit(1.0)), F.array(F.lit(0.25))), signals.null_test(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == (0.75, float("inf"))


def test_nearest_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(60, v[7].tolist()), (61, [0.0] * 8)], "id long, v array<double>").repartition(4)
    v = np.vstack([v, v[7], np.zeros(8)])
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    score = np.floor((unit @ unit.T + 1) / 2 * 1e6 + 0.5000001) / 1e6
    for size in (signals.QUERIES_BYTES, 300):
        monkeypatch.setattr(signals, "QUERIES_BYTES", size)
        got = {(r.a, r.b): r.score for r in signals.nearest(df, "id", "v", F.col("k") % 7 == 0, 3).collect()}
        want = {(a, b): score[a, b] for a in range(0, 62, 7) for b in sorted((b for b in range(62) if b != a), key=lambda b: (-score[a, b], b))[:3]}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_folds_go_over_batches(spark):
    """States are kept from batch to batch, and null keys are keys."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(k % 3 if k % 3 else None, k, float(k)) for k in range(40)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = {r.u: (r.open, r.worst) for r in folds.violation_debt(spark.createDataFrame(rows, "u long, seq long, v double").withColumn("ok", F.col("seq") < 9), "u", ["seq"], "ok").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {None: (11, 11), 1: (10, 10), 2: (10, 10)}
    assert folds.smoothed(spark.createDataFrame([], "u long, seq long, v double"), "u", ["seq"], "v", 0.5).count() == 0


def test_presence(spark):
    rows = [("a", 0, "joined", 0), ("a", 1, "active", 150_000), ("a", 2, "inactive", 200_000), ("b", 0, "view", 5), ("b", 1, "left", 9)]
    got = {r.u: tuple(r)[1:] for r in studies.presence(spark.createDataFrame(rows, "u string, seq long, e string, at long"), "u", ["seq"], "e", "at").collect()}
    assert got == {"a": (0.374, True, 0, 150_000), "b": (0.0, False, 5, 9)}


def test_envelopes_and_families(spark):
    faded = F.array(*(F.lit(x) for x in (0.01, 0.01, 0.2, 0.3, 0.2, 0.3, 0.01, 0.01)))
    got = one(spark, evidence.envelope(faded), evidence.envelope(F.array().cast("array<double>")), evidence.tempo_family(F.lit(70.0), F.lit(138.0), F.lit(0.9)))
    assert (got[0].musical_end, got[0].intro) == (6, 2.0) and tuple(got[1]) == (0.0, 0.0, 0, 0.0)
    assert (got[2].canonical, got[2].alternatives) == (140.0, [70.0])
    assert one(spark, evidence.genome_similarity(F.array(F.lit(1.0)), F.lit(None).cast("array<double>")), evidence.genome_similarity(F.array(F.lit(1.0)), F.array(F.lit(0.0)))) == (0.5, 0.0)


def test_spectra_of_frames_by_hand():
    import numpy as np

    rng = np.random.default_rng(5)
    x, size, rate = rng.normal(size=(3, 300)), 64, 1000
    x[1] = 0.0
    got = signals.spectra_of(x, rate, size)
    hann, hz = np.hanning(size + 1)[:-1], np.arange(1, size // 2) * rate / size
    for row in range(3):
        rows, before, flux = [], None, []
        for start in range(0, 300 - size + 1, size // 2):
            mag = np.abs(np.fft.rfft(x[row, start : start + size] * hann))[1 : size // 2]
            if mag.sum() < 1e-9:
                before = None
                continue
            total = np.cumsum(mag)
            rows.append(((mag * hz).sum() / mag.sum(), hz[np.nonzero(total >= 0.85 * mag.sum())[0][0]], np.exp(np.log(mag).mean()) / mag.mean()))
            if before is not None:
                flux.append(np.maximum(mag / mag.sum() - before, 0).sum())
            before = mag / mag.sum()
        want = np.mean(rows, axis=0) if rows else np.zeros(3)
        assert np.allclose([got["centroid"][row], got["rolloff"][row], got["flatness"][row]], want) and np.isclose(got["flux"][row], np.mean(flux) if flux else 0.0)
        assert (got["best"][row] < 0) == (not rows)


def test_release(spark):
    one_, other = tables.stored(spark.range(3), "kept"), tables.fresh_path(spark, "unused")
    assert one_.count() == 3 and other
    paths = list(tables._GIVEN)
    tables.release(spark)
    assert not tables._GIVEN and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_running_sums(spark):
    rows = [(k % 2, (k * 37) % 100, k) for k in range(400)]
    got = prefixes.running_sum(spark.createDataFrame(rows, "g long, v long, id long").repartition(5), ["g"], [F.col("v"), F.col("id")], F.col("v"), "total").collect()
    total = {0: 0, 1: 0}
    want = {}
    for g, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total[g] += v
        want[i] = total[g]
    assert {r.id: r.total for r in got} == want


def test_jsonl_scan(spark, tmp_path):
    schema = T.StructType([T.StructField("schemaVersion", T.IntegerType()), T.StructField("score", T.DoubleType())])
    (tmp_path / "log.jsonl").write_text(json.dumps({"schemaVersion": 1, "score": 90.0}) + '\n\nnot-json\n{"schemaVersion":1}\n')
    records, rejects = jsonl.scan(spark, str(tmp_path / "log.jsonl"), schema, (F.col("schemaVersion") == 1) & F.col("score").isNotNull())
    assert [r.score for r in records.collect()] == [90.0]
    assert {(r.line, r.reason) for r in rejects.collect()} == {("not-json", "not JSON"), ('{"schemaVersion":1}', "not valid")}
    jsonl.append(records, str(tmp_path / "out"))
    jsonl.append(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_streaming_windows_match_batch(spark, small_dir):
    stream = streaming.windowed(streaming.event_stream(spark, small_dir, EVENTS), "1 day")
    got = streaming.run_once(stream, "tumbling", "complete")
    batch = spark.read.parquet(f"{small_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert {(r.start, r.event_type, r.n) for r in got.collect()} == {(r.start, r.event_type, r.n) for r in want.collect()}


def test_streaming_fold_matches_batch(spark, small_dir):
    delta = (F.col("value") / 1000).alias("delta")
    stream = streaming.event_stream(spark, small_dir, EVENTS).select("user_id", "ts", "event_id", delta)
    got = streaming.run_once(streaming.saturating(stream, "user_id"), "folded", "update")
    batch = folds.saturating(spark.read.parquet(f"{small_dir}/events.parquet").select("user_id", "ts", "event_id", delta), "user_id", ["ts", "event_id"], "delta")
    assert {r.user_id: (r.score, r.n) for r in got.collect()} == {r.user_id: (r.score, r.n) for r in batch.collect()}


def test_streaming_revisions(spark, tmp_path):
    for k, rows in enumerate([[("s", 1), ("s", 2)], [("s", 2), ("s", 5)], [("s", 3)]]):
        spark.createDataFrame(rows, "session string, revision long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    frames = spark.readStream.schema("session string, revision long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streaming.run_once(streaming.revisions(frames, "session"), "revised", "append").collect()
    assert sorted((r.revision, r.verdict) for r in got) == [(1, "applied"), (2, "applied"), (2, "stale"), (3, "applied"), (5, "gap")]


def test_scratch_deletes_what_a_job_stored(spark):
    kept = tables.stored(spark.range(3), "kept")
    with pytest.raises(RuntimeError), tables.scratch(spark):
        path = tables.fresh_path(spark, "gone")
        spark.range(5).write.parquet(path)
        assert spark.read.parquet(path).count() == 5
        raise RuntimeError("a job that fails")
    assert kept.count() == 3 and not os.path.exists(path.removeprefix("file:"))


def test_taste_drift_is_judged_as_it_is_rounded(spark):
    df = spark.sql("select map('a', 0D, 'b', 0D, 'c', 0D) as before, map('a', 0.001D, 'b', 0.059D, 'c', 0.6D) as recent")
    row = groups.taste_drift(df, "before", "recent", digits=6).first()
    sizes = list(row.drift.values())
    assert sum(sizes) / 3 < 0.22 and row.magnitude == 0.22 and row.shifted


def test_matches_of_any_key_come_once_without_comparing_pairs(spark):
    left = spark.createDataFrame([(1, "p", "s"), (1, "q", None), (2, None, "t"), (3, "p", "t")], "a long, k string, l string")
    right = spark.createDataFrame([(7, "p", "s"), (7, "q", "t"), (8, "q", "s"), (9, None, None)], "b long, k string, l string")
    got = joins.any_key_matches(left, right, "a", "b", ["k", "l"])
    assert sorted(map(tuple, got.collect())) == [(1, 7), (1, 8), (2, 7), (3, 7)]
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_large_components_do_not_pass_the_driver(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 20)
    rows = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")
    plan = graph._stars(rows, 50)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
