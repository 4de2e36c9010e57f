"""Row order operators that hold when one group has most of the rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.session import shuffle_width

# rows one window group may hold before it is split
GROUP_SPAN = 100_000
# keys looked at for each bound between ranges
SAMPLED_KEYS = 20


def with_next(
    df: DataFrame, key: str, position: str, columns: list[str], name: str = "next", span: int = GROUP_SPAN
) -> DataFrame:
    """Add ``name``: a struct of ``columns`` of the row that follows within ``key``.

    ``position`` is a whole number, unique within a key. Keys whose positions
    pass ``span`` are split into stretches of that many positions: the row that
    follows is found inside the stretch, and for the last row of one it is the
    first row of the next stretch.
    """
    here = F.struct(*columns)
    if df.filter((F.col(position) >= span) | (F.col(position) < 0)).isEmpty():
        order = Window.partitionBy(key).orderBy(position)
        return df.withColumn(name, F.lead(here).over(order))

    stretch = F.floor(F.col(position) / span)
    split = df.withColumn("_stretch", stretch)
    heads = split.groupBy(key, "_stretch").agg(F.min_by(here, position).alias("_head"))
    following = Window.partitionBy(key).orderBy("_stretch")
    heads = heads.select(key, "_stretch", F.lead("_head").over(following).alias("_head"))
    inside = Window.partitionBy(key, "_stretch").orderBy(position)
    return (
        split.withColumn(name, F.lead(here).over(inside))
        .join(heads, [key, "_stretch"], "left")
        .withColumn(name, F.coalesce(name, "_head"))
        .drop("_stretch", "_head")
    )


def range_bounds(keys: DataFrame, key: str, ranges: int) -> list:
    """At most ``ranges - 1`` keys that cut the distinct keys into ranges of about equal size.

    They come from a sample of bounded size, chosen by a hash of the key: the
    same on every run.
    """
    sample = keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.xxhash64(F.first(key)).alias("_hash"))
    sample = sample.orderBy("_hash", key).limit(SAMPLED_KEYS * ranges)
    cuts = [r[0] for r in sample.orderBy(key).select(key).collect()]
    places = sorted({len(cuts) * i // ranges for i in range(1, ranges)} - {0})
    return [cuts[i] for i in places if i < len(cuts)]


def range_of(key: Column, bounds: list, kind: T.DataType) -> Column:
    """How many of the ascending ``bounds`` are not above the key, by bisection; null counts as below all."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b) for b in bounds]).cast(T.ArrayType(kind))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, width: Column) -> Column:
        reached = F.coalesce(F.get(held, at + width - 1) <= key, F.lit(False))
        return F.when(reached, at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_dense_index(df: DataFrame, order_by: str, name: str = "index", ranges: int | None = None) -> DataFrame:
    """Add a gap-free 0-based row number in ``order_by`` order, without a single-task sort.

    Bounds of ranges and the rows in each are found from the key column alone,
    which a columnar scan reads by itself. Then the rows are shuffled once, to
    their range, numbered there and shifted by the rows of the ranges before.
    Rows of equal keys lie in one range, in any order; nulls come first.
    """
    keys, kind = df.select(order_by), df.schema[order_by].dataType
    bounds = range_bounds(keys, order_by, ranges or shuffle_width(df.sparkSession))
    place = range_of(F.col(order_by), bounds, kind)
    counts = {r["_range"]: r["count"] for r in keys.groupBy(place.alias("_range")).count().collect()}
    before = list(accumulate((counts.get(i, 0) for i in range(len(bounds))), initial=0))
    shift = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_range"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(order_by))
    return df.withColumn("_range", place).withColumn(name, shift + number - 1).drop("_range")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; every task cuts to ``k`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def gather_lines(df: DataFrame, keys: list[str], rank: str, line: str, name: str, separator: str = "\n") -> DataFrame:
    """Join the few ranked lines of each group into one text, in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(line).alias("l"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ranked, lambda x: x.getField("l")), separator).alias(name))


def preview_with_overflow(df: DataFrame, key: str, order: list[Column], line: str, shown: int) -> DataFrame:
    """Per key the first ``shown`` lines, how many more exist, and the text saying so.

    The size of a group comes from a partial count, never from a window over it.
    """
    top = gather_lines(top_per_group(df, [key], order, shown), [key], "rank", line, "shown")
    sizes = df.groupBy(key).agg(F.count("*").alias("total"))
    hidden = F.greatest(F.col("total") - shown, F.lit(0))
    more = F.when(hidden > 0, F.concat(F.lit("...and "), hidden.cast("string"), F.lit(" more")))
    return (
        sizes.join(top, key)
        .withColumn("hidden", hidden)
        .withColumn("overflow", F.coalesce(more, F.lit("")))
    )
