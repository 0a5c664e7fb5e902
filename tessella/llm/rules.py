"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

The signals of a text are counted in one pass. Which value of a signal rejects a document is not guessed: on a labelled
holdout, each cutoff of a fixed grid is tested in each stratum (language) for the null hypothesis that it rejects more
than RISK / signals of the good documents. It is certified where the exact binomial probability of so few rejections,
were that so, is at most DELTA divided by the number of tests (Bonferroni over strata, signals and cutoffs). Of the
certified cutoffs the one that rejects most documents labelled bad is used, the loosest of equals, and only if it
rejects more of them, by share, than of the good. So with probability 1 - DELTA at least no stratum loses more than RISK
of its good documents to the signals. A stratum with too few labels has no certified cutoff, and keeps its documents.

Nulls: a null text has no words; a null language and an empty one are one stratum; labels without a quality are left out,
and a doc_id with several labels is good only if all of them say so. Rows that repeat a doc_id each get their row (and
count in the holdout as often). Ties: of cutoffs that reject as many the loosest is used. Very long texts are counted whole.
Empty tables give empty results; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACES, SPACES, small, stored

RISK = 0.02
DELTA = 0.05
RUN = 8
#: Cutoffs tested for each signal: the document is rejected above it.
GRID = {
    "symbol_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "upper_share": (0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
}


def features(docs: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, stratum, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper); keep
    names further columns of docs."""
    keep = keep or {}
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), *(x.alias(n) for n, x in keep.items()), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    base = base.withColumns(
        {
            "words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACES)),
            "word_chars": F.length(F.regexp_replace("text", SPACES, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long"),
        }
    ).drop("text")
    size = F.size("words")
    window = F.transform(F.sequence(F.lit(1), size - RUN + 1), lambda i: F.xxhash64(F.slice("words", i, RUN)))
    base = base.withColumns(
        {
            "n_words": size.cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "windows": F.when(size >= RUN, window).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("words", "lines")
    # most texts have no window twice; only the others are sorted
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    base = base.withColumn("placed", F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    base = base.drop("windows")
    same = lambda x, j: F.coalesce(F.get("placed", j)["h"] == x["h"], F.lit(False))
    again = F.filter("placed", lambda x, j: F.when(j == 0, F.lit(False)).otherwise(same(x, j - 1)) | same(x, j + 1))
    base = base.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("placed")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-RUN).alias("last"))
    covered = F.aggregate("again", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(RUN), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])
    base = base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return base.select("doc_id", "stratum", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def signals() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial of n and p: exact terms by their ratios, summed in logs. For 0 <= k < n p."""
    step = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + step
        high, low = F.greatest(term, a["total"]), F.least(term, a["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    return F.when(k < 1, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, add, lambda a: a["total"]))


def thresholds(feats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, signal, cutoff): the cutoff used for each stratum and signal that has a certified one.

    Good documents that fail the base rules are no part of the risk: they are lost anyway."""
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    held = feats.where(~base_failed()).join(quality, "doc_id")
    tests = [F.struct(F.lit(s).alias("signal"), F.lit(c).alias("cutoff"), (x > c).alias("out")) for s, x in signals().items() for c in GRID[s]]
    good = F.col("good") == 1
    counted = (
        held.select("stratum", "good", F.explode(F.array(*tests)).alias("t"))
        .groupBy("stratum", "t.signal", "t.cutoff")
        .agg(F.count_if(good).alias("n"), F.count_if(good & F.col("t.out")).alias("k"), F.count_if(~good).alias("n_bad"), F.count_if(~good & F.col("t.out")).alias("hits"))
    )
    counted = stored(counted, "counted")
    n_tests = max(1, counted.count())
    part = risk / len(GRID)
    certified = counted.where((F.col("n") > 0) & (F.col("k") < F.col("n") * part)).where(log_binomial_tail(F.col("n"), F.col("k"), part) <= F.log(F.lit(delta / n_tests)))
    useful = certified.where(F.col("hits") * F.col("n") > F.col("k") * F.col("n_bad"))
    best = F.max_by("cutoff", F.struct("hits", "cutoff"))
    return useful.groupBy("stratum", "signal").agg(best.alias("cutoff"))


def judge(feats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """feats with base_failed and kept. cutoffs: what thresholds() returns; a signal without one rejects nothing."""
    names = list(GRID)
    cutoffs = stored(cutoffs, "cutoffs")
    wide = cutoffs.groupBy("stratum").pivot("signal", names).agg(F.first("cutoff"))
    wide = wide.select("stratum", *(F.col(n).alias(f"cut_{n}") for n in names))
    out = feats.join(small(wide, cutoffs.count()), "stratum", "left").withColumn("base_failed", base_failed())
    over = [F.coalesce(x > F.col(f"cut_{n}"), F.lit(False)) for n, x in signals().items()]
    rejected = F.col("base_failed")
    for x in over:
        rejected = rejected | x
    return out.withColumn("kept", ~rejected).drop(*(f"cut_{n}" for n in names))
