"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources, in code point order with null last, weigh as given (repeating) and share a total of words; a target stops at
EPOCHS times its source's size, and what is over goes to the others by weight. The words of a source are dealt into
parts by a hash of doc_id and text (and, where rows agree in both, their number among those), and the words of a part, in a seeded order of its documents, are cut into equal blocks. The
blocks to take are apportioned by highest quotients (divisors 1, 3, 5, ...) to the sources by target, then from each
source to its parts by size, which gives each part an integer quota. A part takes its quota as whole passes over its
blocks and, for the rest, a run of blocks from a seeded start in the shuffled order. A document takes what the chosen
blocks cover of it, so never more than EPOCHS times its size.

Only narrow rows (id, source, size) are dealt and ordered; texts are read once to be counted and once to be cut. The sums of
sources and parts come to the driver if there are SOURCES_MOST sources at most (and PARTS_MOST parts more); of more sources,
levels and divisors are searched for by sums over their table, by the same rule and with the same result. A hot source is many
parts, and so many tasks; its parts are PARTS_MOST at most, which one task apportions.

Nulls: a null text has no words and takes none; a null source is a source; a null doc_id is dealt and ordered like 0.
Rows that agree in doc_id, source and text share what they take in any order; they are dealt to parts like others. Very long texts may be cut by a block's edge. An
empty table gives an empty result. Further columns of any name stay as they are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_SPACES, indexed, keyed, small, stored
from .sharding import numbered

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 42
#: Words of a block; halved for small inputs until a source of average size has BLOCKS_LEAST of them.
BLOCK_WORDS = 256
BLOCKS_LEAST = 1000
#: Words of a part at least, and parts at most (besides one for each source): larger inputs have larger parts.
PART_WORDS = 100_000
PARTS_MOST = 20_000
#: Sources whose sums the driver takes at most.
SOURCES_MOST = 50_000
#: Divisors that one pass over the table of sources tries.
TRIED = 32


def sainte_lague(shares: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients share / (2 k + 1), the earlier entry first among equals; none gets over its most.

    A bisection for the divisor gives all seats but the last few at once, a heap of quotients the rest."""
    x, cap = np.array(shares, float), np.array(most, np.int64)
    seats = min(seats, int(cap[x > 0].sum()))
    if seats <= 0:
        return [0] * len(shares)
    given = lambda d: np.minimum(cap, np.floor(x / d + 0.5).astype(np.int64))
    low, high = x.sum() / (4 * (seats + len(x))) * 1e-3, 2 * x.max() + 1.0
    while given(low).sum() < seats:
        low /= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    out = given(high)
    heap = [(-x[k] / (2 * out[k] + 1), k) for k in range(len(x)) if x[k] > 0 and out[k] < cap[k]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, k = heapq.heappop(heap)
        out[k] += 1
        if out[k] < cap[k]:
            heapq.heappush(heap, (-x[k] / (2 * out[k] + 1), k))
    return out.tolist()


def block_size(total: int, n_sources: int) -> int:
    size = BLOCK_WORDS
    while size > 1 and total < size * BLOCKS_LEAST * n_sources:
        size //= 2
    return size


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, source, size, text_hash, and the columns keep): size is the number of words of the text (null: 0)."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(NOT_SPACES)), F.lit(0)).cast("long").alias("size")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), *keep)


def targeted(sums: DataFrame, total: int, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, words, k, target) of sums (source, words): k is the source's place. A target is the weight times a common
    level, epochs times the words at most. The level rises as long as it fills further sources."""
    ranked = indexed(sums.select("source", "words"), [F.col("source").asc_nulls_last()], "k")
    ranked = ranked.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int")))
    ranked = stored(ranked, "sources")
    cap, level, before = F.col("words") * epochs, 0.0, -1
    while total:
        full = F.col("w") * level >= cap
        n, filled, open_ = ranked.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("w")))).first()
        if n == before or not open_:
            break
        before, level = n, (total - (filled or 0)) / open_
    return ranked.select("source", "words", "k", F.when(F.col("w") * level >= cap, cap.cast("double")).otherwise(F.col("w") * level).alias("target"))


def levels(words: list[int], weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> list[float]:
    """The same targets, of the words of all sources in order."""
    cap, w = [epochs * n for n in words], [float(weights[k % len(weights)]) for k in range(len(words))]
    total, level, before = sum(words), 0.0, -1
    while total:
        full = [w[k] * level >= cap[k] for k in range(len(words))]
        n, open_ = sum(full), sum(w[k] for k in range(len(words)) if not full[k])
        if n == before or not open_:
            break
        before, level = n, (total - sum(c for c, f in zip(cap, full, strict=True) if f)) / open_
    return [float(c) if x * level >= c else x * level for c, x in zip(cap, w, strict=True)]


def apportioned(shares: DataFrame, seats: int) -> DataFrame:
    """(k, seats) of shares (k, x, most): seats by highest quotients x / (2 s + 1), the smaller k first among equals; none
    gets over its most. A divisor is searched for that leaves less than one further seat for each; those go by quotient."""
    x, most = F.col("x"), F.col("most")
    top, total, n, least = shares.where((x > 0) & (most > 0)).agg(F.max("x"), F.sum("x"), F.count(F.lit(1)), F.sum("most")).first()
    seats = min(seats, least or 0)
    given = lambda d: F.when(x > 0, F.least(most, F.floor(x / d + 0.5))).otherwise(0).cast("long")
    if seats <= 0:
        return shares.select("k", F.lit(0).cast("long").alias("seats"))
    low, high = total / (4 * (seats + n)) * 1e-3, 2 * top + 1.0
    while shares.agg(F.sum(given(low))).first()[0] < seats:
        low /= 1024
    while True:
        tried = np.geomspace(low, high, TRIED + 2)[1:-1].tolist()
        *sums, spread = shares.agg(*(F.sum(given(d)) for d in tried), F.max(given(low) - given(high))).first()
        if spread <= 1 or not low < tried[0] < high:
            break
        low, high = max([low, *(d for d, s in zip(tried, sums, strict=True) if s > seats)]), min([high, *(d for d, s in zip(tried, sums, strict=True) if s <= seats)])
    base = shares.withColumn("seats", given(high))
    left = seats - base.agg(F.sum("seats")).first()[0]
    if not left:
        return base.select("k", "seats")
    more = base.where((x > 0) & (F.col("seats") < most)).select("k", (-x / (2 * F.col("seats") + 1)).alias("q"))
    more = indexed(more, [F.col("q"), F.col("k")], "place").where(F.col("place") < left).select(F.col("k").alias("_k"), F.lit(1).alias("one"))
    return base.join(more, F.col("k") == F.col("_k"), "left").select("k", (F.col("seats") + F.coalesce("one", F.lit(0))).alias("seats"))


def _quotas(block: int, epochs: int):
    def of(parts: pd.DataFrame) -> pd.DataFrame:
        """The parts of one source (k, part, words, seats)."""
        n = -(-parts["words"] // block)
        quota = np.array(sainte_lague(parts["words"].astype(float).tolist(), int(parts["seats"].iloc[0]), (epochs * n).tolist()))
        return pd.DataFrame({"k": parts["k"], "part": parts["part"], "n": n, "passes": quota // np.maximum(n, 1), "rest": quota % np.maximum(n, 1)})

    return of


def dealt_by(sizes: DataFrame, seed: int) -> DataFrame:
    """sizes with dealt, a hash that differs between rows however often an id, or a text under it, is repeated."""
    rows = sizes.withColumn("same", F.lit(0).cast("long"))
    if sizes.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        group = F.xxhash64("doc_id", "source", "size", "text_hash").alias("same_as")
        rows = numbered(sizes.select("*", group, F.monotonically_increasing_id().alias("at_row")), ["same_as"], sizes.count(), ["at_row"])
        rows = stored(rows.withColumnRenamed("slot", "same").drop("same_as", "at_row"), "dealt")
    return rows.withColumn("dealt", F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text_hash", "same", F.lit(seed))).drop("same")


def _planned(sizes: DataFrame, sums: DataFrame, weights: tuple[float, ...], epochs: int) -> tuple[DataFrame, int, int]:
    """(k, own, source_size, target, parts) of the sources, how many there are, and the block."""
    spark = sizes.sparkSession
    first = sums.select("source", "words").orderBy(F.col("source").asc_nulls_last()).limit(SOURCES_MOST + 1).collect()
    schema = "k long, own string, source_size long, target double, parts int"
    if len(first) <= SOURCES_MOST:
        total = sum(r.words for r in first)
        part = max(PART_WORDS, total // PARTS_MOST)
        rows = [(k, r.source, r.words, t, max(1, -(-r.words // part))) for k, (r, t) in enumerate(zip(first, levels([r.words for r in first], weights, epochs), strict=True))]
        return spark.createDataFrame(rows, schema), len(first), block_size(total, max(1, len(first)))
    n_sources, total = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    part = max(PART_WORDS, total // PARTS_MOST)
    wanted = targeted(sums, total, weights, epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("words") / part)).cast("int").alias("parts")
    return stored(wanted.select("k", F.col("source").alias("own"), F.col("words").alias("source_size"), "target", parts), "sources"), n_sources, block_size(total, n_sources)


def _quotas_of(sources: DataFrame, held: DataFrame, n_sources: int, block: int, epochs: int) -> DataFrame:
    """(k, part, n, passes, rest) of the parts held (k, part, words)."""
    schema = "k long, part int, n long, passes long, rest long"
    if n_sources <= SOURCES_MOST:
        targets = {r.k: (r.target, r.source_size) for r in sources.collect()}
        parts = held.toPandas().sort_values(["k", "part"])
        blocks = (-(-parts["words"] // block)).groupby(parts["k"]).sum()
        order = [k for k in sorted(targets) if k in blocks.index]
        seats = sainte_lague([targets[k][0] for k in order], round(sum(n for _, n in targets.values()) / block), [epochs * int(blocks[k]) for k in order])
        quota = _quotas(block, epochs)
        found = [quota(parts[parts["k"] == k].assign(seats=s)) for k, s in zip(order, seats, strict=True)]
        rows = [tuple(map(int, r)) for f in found for r in f.itertuples(index=False)]
        return held.sparkSession.createDataFrame(rows, schema)
    blocks = held.groupBy("k").agg(F.sum(F.ceil(F.col("words") / block)).alias("n"))
    shares = stored(sources.join(blocks, "k").select("k", F.col("target").alias("x"), (F.col("n") * epochs).alias("most")), "shares")
    seats = apportioned(shares, round(held.agg(F.sum("words")).first()[0] / block))
    return stored(held.join(seats, "k").groupBy("k").applyInPandas(_quotas(block, epochs), schema), "quotas")


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of a stored table (doc_id, source, size, text_hash, more) with source_size, target, taken and the piece of the
    source's stream they take: passes (whole), and begin and length of a word span, and the length of another from the
    document's start, length2, for a run that goes round the end."""
    keep = [c for c in sizes.columns if c not in ("doc_id", "source", "size", "text_hash")]
    sums = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    sources, n_sources, block = _planned(sizes, sums, weights, epochs)
    joined = dealt_by(sizes, seed).join(small(sources, n_sources), F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    joined = joined.withColumn("part", F.pmod("dealt", F.col("parts")).cast("int")).drop("parts")
    held = joined.groupBy("k", "part").agg(F.sum("size").alias("words"))
    held = held if n_sources <= SOURCES_MOST else stored(held, "parts")
    quotas = _quotas_of(sources, held, n_sources, block, epochs)

    # the seeded order within a part, and where each document's words lie in it
    order = Window.partitionBy("k", "part").orderBy("dealt", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.join(small(quotas, PARTS_MOST + n_sources), ["k", "part"], "left").withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    start = F.pmod(F.xxhash64("k", "part", F.lit(seed + 1)), F.greatest("n", F.lit(1))) * block
    placed = placed.withColumns({"from": start, "to": start + F.col("rest") * block})
    end = F.col("at") + F.col("size")
    cut = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(F.col("at"), a))
    round_ = F.greatest(F.lit(0), F.col("to") - F.col("n") * block)
    placed = placed.withColumns({"begin": F.greatest(F.lit(0), F.col("from") - F.col("at")), "length": cut(F.col("from"), F.col("to")), "length2": cut(F.lit(0), round_)})
    taken = F.coalesce(F.col("passes") * F.col("size") + F.col("length") + F.col("length2"), F.lit(0)).cast("long")
    return placed.select("doc_id", "source", "size", *keep, "source_size", "target", taken.alias("taken"), "passes", "begin", "length", "length2")


def _span(text: Column, begin: Column, length: Column) -> Column:
    """So many words from the begin-th on (from 0), with the white space between them as it was."""
    word, gap = NOT_SPACES, r"[\x20\x09-\x0D]*"
    words = F.regexp_extract_all(text, F.lit(f"{gap}{word}"), F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(words, (begin + 1).cast("int"), length.cast("int")), ""), f"^{gap}", "")


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """What the mix takes, in the columns of docs: one row for each whole pass over a document and for each span of words
    of it. n_chars, where it is there, is counted anew."""
    rows = keyed(docs)
    plan = mix(stored(sized(rows.select("row_key", "doc_id", "text", F.col("rest.source").alias("source")), "row_key"), "sizes"), weights, epochs, seed)
    plan = plan.where("taken > 0").select("row_key", "passes", "begin", "length", "length2")
    piece = lambda a, n: F.when(n > 0, _span(F.col("text"), a, n))
    whole = F.array_repeat(F.col("text"), F.col("passes").cast("int"))
    spans = F.array(piece(F.col("begin"), F.col("length")), piece(F.lit(0), F.col("length2")))
    cut = rows.join(plan, "row_key").withColumn("piece", F.explode(F.concat(whole, F.array_compact(spans))))
    columns = {c: F.col("piece") if c == "text" else F.length("piece").cast("long") if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns}
    return cut.select(*(x.alias(c) for c, x in columns.items()))
