"""Edges, components and leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import half_up
from ..sources.tables import spread, stored


#: Edges from which on what is known of a node is sent to all tasks, instead of its edges to one.
HUB = 50_000
#: Hubs that are sent at most; more are joined by a shuffle.
HUBS_MOST = 200_000


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (a, b) with m of least (a, m, n), where n counts a's rows. A hub's rows stay where they are."""
    hubs = least.where(F.col("n") > HUB).select("a", "m")
    many = hubs.count() if edges > HUB else 0
    if edges > HUB:  # not by way of the driver, which would get some of it in every round
        least = least.hint("merge")
    if not many or many > HUBS_MOST:
        return rows.join(least.select("a", "m"), "a")
    sent = F.broadcast(hubs)
    others = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("n") <= HUB).select("a", "m"), "a")
    return rows.join(sent, "a").select("a", "b", "m").union(others.select("a", "b", "m"))


def _stars(rows: DataFrame, edges: int) -> DataFrame:
    """rows with the least neighbour m of a, itself included if it is less than all."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(rows, stored(least, "least") if edges > HUB else least, edges)


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, for the nodes that have an edge (a, b) to a smaller
    node of their component; the smallest itself isn't listed.

    Alternating large and small stars, each round written to the shared folder, until a round changes nothing; rounds grow
    with the logarithm of the longest path."""
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    now, before = state(edges), None
    while now[0] and now != before:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, now[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = stored(large, "large") if now[0] > HUB else large
        small = _stars(large, now[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now, before = state(edges), now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for nodes with an edge (a, b), to themselves too."""
    found = stored(star_components(edges), "found")
    first = found.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    alone = alone.join(found.select("node").union(first.select("node")).hint("merge"), "node", "left_anti").withColumn("component", F.col("node"))
    return found.union(first).union(alone)


def splits(components_: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """(node, component, split): all of a component to train, validation or test, about 70/20/10 by its checksum."""
    bucket = F.crc32(F.col(component).cast("string").cast("binary")) % 10
    return components_.select(node, component, F.when(bucket < 7, "train").when(bucket < 9, "validation").otherwise("test").alias("split"))


def leaking_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits) of keys that are in more than one split."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


#: Cells in the width of a band: many small ones are dealt evenly, and fewer pairs meet that are too far apart.
FINE = 32


def _cells(value: str, width: float) -> tuple[Column, Column]:
    """The cell of a value, and those (exploded) that values no further than the width can lie in."""
    cell = F.floor(F.col(value) / (width / FINE))
    return cell, F.explode(F.sequence(cell - FINE, cell + FINE))


def compatibility_edges(items: DataFrame, item: str, block: str, score: Column, least: float, band: tuple[str, float]) -> DataFrame:
    """(src, dst, score) of directed pairs of a block; score uses the columns of both sides as a_ and b_ ones. band: a column
    and how far apart it may be in a pair that scores enough, so that only items of neighbouring cells meet."""
    value, width = band
    cell, wide = _cells(value, width)
    a = items.withColumn("_cell", wide)
    a = a.select("_cell", *(F.col(c).alias(c if c == block else f"a_{c}") for c in items.columns))
    b = items.select(cell.alias("_cell"), *(F.col(c).alias(c if c == block else f"b_{c}") for c in items.columns))
    pairs = spread(a, block, "_cell").join(spread(b, block, "_cell"), [block, "_cell"]).where(F.col(f"a_{item}") != F.col(f"b_{item}"))
    return pairs.select(F.col(f"a_{item}").alias("src"), F.col(f"b_{item}").alias("dst"), half_up(score).alias("score")).where(F.col("score") >= least)


def _added(new: DataFrame, held: DataFrame, item: str, score: Column, least: float, band: tuple[str, float]) -> DataFrame:
    """(src, dst, score) of pairs of new items, each once, and of new with held ones."""
    cell, wide = _cells(*band)
    side = lambda df, name, *more: df.select(*more, *(F.col(c).alias(f"{name}_{c}") for c in new.columns))
    there = side(new, "y", cell.alias("_cell"), F.lit(True).alias("_new")).union(side(held, "y", cell.alias("_cell"), F.lit(False).alias("_new")))
    met = spread(side(new, "x", wide.alias("_cell")), "_cell").join(spread(there, "_cell").hint("merge"), "_cell").where(~F.col("_new") | (F.col(f"x_{item}") < F.col(f"y_{item}")))
    turned = F.col(f"x_{item}") > F.col(f"y_{item}")
    pairs = met.select(*(F.when(turned, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(f"a_{c}") for c in new.columns), *(F.when(turned, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"b_{c}") for c in new.columns))
    return pairs.select(F.col(f"a_{item}").alias("src"), F.col(f"b_{item}").alias("dst"), half_up(score).alias("score")).where(F.col("score") >= least)


def extend_edges(spark: SparkSession, folder: str, batch: int, new: DataFrame, item: str, score: Column, least: float, band: tuple[str, float]) -> int:
    """Adds a batch of items to a graph that is kept in a folder, and returns how many items held before were met: new items
    meet each other and those of neighbouring cells held before, each pair once, whichever came first. Batches are numbered
    upwards; one that is run again replaces what it wrote. score uses the columns of both sides as a_ and b_ ones (a: the
    smaller item)."""
    held = _held(spark, f"{folder}/items", new, batch)
    _added(new, held, item, score, least, band).write.mode("overwrite").parquet(f"{folder}/edges/batch={batch}")
    cell, wide = _cells(*band)
    near = new.select(wide.alias("_cell")).distinct()
    reached = held.withColumn("_cell", cell).join(near, "_cell", "left_semi").count()
    new.write.mode("overwrite").parquet(f"{folder}/items/batch={batch}")
    return reached


def joining_edges(spark: SparkSession, folder: str, batch: int, new: DataFrame, item: str, score: Column, least: float, band: tuple[str, float]) -> DataFrame:
    """(src, dst, score) of what a batch of items adds to a graph, as extend_edges() has it, for those who write the edges to a
    place of their own: the folder keeps the items alone, so that edges, which grow with the square, are written once."""
    new.write.mode("overwrite").parquet(f"{folder}/items/batch={batch}")
    kept = _held(spark, f"{folder}/items", new, batch + 1, batch)
    return _added(kept, _held(spark, f"{folder}/items", new, batch), item, score, least, band)


def _held(spark: SparkSession, path: str, like: DataFrame, batch: int, since: int = 0) -> DataFrame:
    """The items of earlier batches, since one of them."""
    if not batch:
        return like.limit(0)
    schema = T.StructType([*like.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).where((F.col("batch") < batch) & (F.col("batch") >= since)).drop("batch")


def kept_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, score) of all batches."""
    return spark.read.parquet(f"{folder}/edges").drop("batch")
