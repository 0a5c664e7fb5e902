"""Column functions that operators share. Rounding is half towards plus infinity, and ratios guard their denominators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Milliseconds of a day.
DAY_MS = 86_400_000


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


#: Added before cutting off. What is under a half by the error of a sum counts as a half, so that the order in which a
#: plan adds up can't decide.
HALF = 0.5000001


def half_up(x: Column | str, digits: int = 3) -> Column:
    """Rounded half towards plus infinity: -2.5 gives -2."""
    scale = float(10**digits)
    return F.floor(_col(x) * scale + HALF) / scale


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Within low and high; null stays null."""
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of x, which is computed once however often use takes it: it is the variable of a one-element array. A
    struct of such a kind is not taken apart and repeated for each of its fields either."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """Rounded share; null where there is no whole."""
    return F.when(whole > 0, half_up(part / whole, digits))


def share(part: Column, whole: Column) -> Column:
    """Share with a denominator of one at least: nothing of nothing is zero."""
    return part / F.greatest(whole, F.lit(1))


def half_life(value: Column | str, age: Column | str, half: float) -> Column:
    """value after age, halved each half; a negative age counts as none."""
    return _col(value) * F.pow(F.lit(2.0), -F.greatest(_col(age), F.lit(0)) / half)


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the Wilson interval, to six digits; (0, 1) of no observations."""
    n = F.greatest(total, F.lit(1)).cast("double")
    p = successes / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    margin = z / denominator * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda x, none: F.when(total > 0, half_up(clamp(x), 6)).otherwise(F.lit(none))
    return F.struct(bound(centre - margin, 0.0).alias("low"), bound(centre + margin, 1.0).alias("high"))


def ladder(x: Column | str, steps: Sequence[tuple[float, str]], otherwise: str, unknown: str | None = None) -> Column:
    """The label of the first step that x does not exceed."""
    x = _col(x)
    out = reduce(lambda c, s: c.when(x <= s[0], F.lit(s[1])), steps, F.when(x.isNull(), F.lit(unknown)))
    return out.otherwise(F.lit(otherwise))


def first_failed(gates: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first gate that does not hold (null counts as not holding), or null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates))


def all_failed(gates: Sequence[tuple[str, Column]]) -> Column:
    """The names of all gates that do not hold, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates)))


def present_mean(parts: Sequence[tuple[Column, float]]) -> Column:
    """Mean of what is not null, by weight; null if all are."""
    total = reduce(lambda a, b: a + b, (F.when(x.isNotNull(), x * w).otherwise(0.0) for x, w in parts))
    weight = reduce(lambda a, b: a + b, (F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts))
    return F.when(weight > 0, total / weight)


def noisy_or(p: Column) -> Column:
    """Aggregate: the chance that at least one of independent causes holds."""
    return 1 - F.product(1 - p)


def nearest_rank(x: Column | str, p: float) -> Column:
    """Aggregate: the value at rank ceil(p n)."""
    name = x if isinstance(x, str) else None
    if name is None:
        raise TypeError("nearest_rank takes the name of a column")
    return F.expr(f"percentile_disc({p}) within group (order by `{name}`)")


def index_percentiles(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys and for each name of ranks the value at that zero-based index of the sorted values of a group.

    ranks may use the column n, the group's count. Rows are ranked where they lie; no group is gathered in an array."""
    sorted_ = Window.partitionBy(*keys).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"at": F.row_number().over(sorted_) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("at") == k, F.col(value))).alias(name) for name, k in ranks.items()))


def floor_index(p: float) -> Column:
    """Index floor((n - 1) p)."""
    return F.floor((F.col("n") - 1) * p)


def clamped_index(p: float) -> Column:
    """Index floor(n p), the last one at most."""
    return F.least(F.col("n") - 1, F.floor(F.col("n") * p))


def circular(distance: Column, size: int) -> Column:
    d = F.abs(distance) % size
    return F.least(d, size - d)


def camelot_score(a: Column | str, b: Column | str) -> Column:
    """How well two keys of the wheel (1A to 12B) go together: the same 1, a neighbour 0.8, two steps 0.4, the other ring
    at the same place 0.7, else 0."""
    a, b = _col(a), _col(b)
    number = lambda k: F.coalesce(F.regexp_extract(k, r"^(\d{1,2}).$", 1).try_cast("int"), F.lit(0))
    ring = lambda k: F.right(k, F.lit(1))
    d, same = circular(number(a) - number(b), 12), ring(a) == ring(b)
    out = F.when(a == b, 1.0).when((number(a) == 0) | (number(b) == 0), 0.0).when(same & (d == 1), 0.8).when(same & (d == 2), 0.4)
    return out.when(~same & (number(a) == number(b)), 0.7).otherwise(0.0)


#: Metrical relations: name, multiplier of the next tempo, prior (fixed values).
TEMPO_RELATIONS = (("same", 1.0, 1.0), ("double", 2.0, 0.92), ("half", 0.5, 0.92), ("two-over-three", 2 / 3, 0.72), ("three-over-two", 1.5, 0.72))


def tempo_relation(current: Column | str, following: Column | str, evidence: float = 0.6, tolerance: float = 0.08) -> Column:
    """struct(relation, gap, plausibility, compatible): which metrical relation of two tempos is the most plausible."""
    a, b = _col(current), _col(following)
    made = []
    for k, (name, times, prior) in enumerate(TEMPO_RELATIONS):
        gap = F.abs(a / (b * times) - 1)
        match = F.exp(-F.pow(gap / tolerance, 2)) * (prior * 0.55 + evidence * 0.45)
        made.append(F.struct((-match).alias("order"), gap.alias("gap"), F.lit(k).alias("k"), F.lit(name).alias("relation")))
    best = F.array_min(F.array(*made))
    least = F.when(best["k"] >= 3, 0.62).otherwise(0.55)
    fits = (best["gap"] <= tolerance) & (-best["order"] >= least)
    known = (a > 0) & (b > 0)
    return F.struct(
        F.when(known & fits, best["relation"]).otherwise("unrelated").alias("relation"),
        F.when(known, half_up(F.when(fits, best["gap"]).otherwise(F.abs(a / b - 1)))).alias("gap"),
        F.when(known, half_up(-best["order"])).otherwise(0.0).alias("plausibility"),
        F.coalesce(known & fits, F.lit(False)).alias("compatible"),
    )


def octave_folded(bpm: Column | str) -> Column:
    """bpm halved until it is 140 or less, or doubled until it is 70 or more, to one digit; null for none or zero."""
    bpm = _col(bpm)
    down, up = F.greatest(F.lit(0), F.ceil(F.log2(bpm / 140))), F.greatest(F.lit(0), F.ceil(F.log2(70 / bpm)))
    return F.when(bpm > 0, half_up(F.when(bpm > 140, bpm / F.pow(2, down)).when(bpm < 70, bpm * F.pow(2, up)).otherwise(bpm), 1))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of two arrays of doubles."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 over the shorter length; 0 where a vector has no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, clamp((dot(a, b) / norm + 1) / 2)).otherwise(F.lit(0.0))


def map_value(m: Column, key: Column) -> Column:
    """The value of a sparse vector; missing is zero."""
    return F.coalesce(F.try_element_at(m, key), F.lit(0.0))
