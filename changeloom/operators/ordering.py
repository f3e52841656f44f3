"""Places and running values inside large groups, without one task a group.

A window by table alone puts a whole table into one task.  Here each group is
cut into slices by quantiles of its ordering column; windows run inside slices,
one small row a slice is carried over the slices, and joined back.  Slices
depend on the data only, so a recomputed task gives the same ones.  Rows of one
value of the ordering column stay together, as one transaction does.  Rows are
counted first: slices and tasks are as many as they need.  What is joined back
is broadcast, as a join by the group would put a group into one task; it has a
row for each slice behind a group's first, so one for each WHOLE rows or fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most slices of a group; groups of up to so many rows aren't cut, and tasks and slices have about as many.
SLICES, WHOLE = 4096, 100_000


def _free(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name


def slice_of(bounds: Column, at: Column, slices: int) -> Column:
    """How many of the sorted bounds (slices - 1 of them, a power of two less one) are below a value, by halving."""

    def go(step: int):
        # of one parameter: transform gives the element's index to a second
        return lambda p: F.when(F.get(bounds, p + F.lit(step - 1)) < at, p + F.lit(step)).otherwise(p)

    place, step = F.lit(0), slices // 2
    while step:
        place, step = F.element_at(F.transform(F.array(place), go(step)), 1), step // 2
    return place


def extent(df: DataFrame, by: str) -> tuple[int, int]:
    """How many rows there are, and how many in the largest group."""
    total, largest = df.groupBy(by).count().agg(F.sum("count"), F.max("count")).first()
    return total or 0, largest or 0


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df by some columns in as many tasks as its rows need; as it is where the session's number is enough."""
    tasks = -(-rows // WHOLE)
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def sliced(df: DataFrame, by: str, at: str, name: str, slices: int | None = None, whole: int = WHOLE, size: tuple[int, int] | None = None) -> DataFrame:
    """df with the slice of each row, ascending with ``at`` within each value of ``by``; 0 for all rows of a small group.

    slices: of each large group, else as many as its rows need; size: df's extent, if it is known.
    """
    bounds, key = _free("bounds", df), _free("of", df)
    most = slices
    if most is None:
        largest, most = (size or extent(df, by))[1], 2
        if largest <= whole:
            return df.withColumn(name, F.lit(0))
        while most < SLICES and most * whole < largest:
            most *= 2
    fractions = [i / most for i in range(1, most)]
    large = df.groupBy(F.col(by).alias(key)).agg(F.percentile_approx(at, fractions, 4 * most).alias(bounds), F.count("*").alias("n")).where(F.col("n") > whole)
    if slices is None:
        own = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / max(whole, 1)))).cast("int"), F.lit(most))
        large = large.withColumn(bounds, F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.element_at(bounds, (i * F.lit(most) / own).cast("int"))))
    joined = df.join(F.broadcast(large.drop("n")), F.col(by) == F.col(key), "left")
    return joined.withColumn(name, F.when(F.col(bounds).isNull(), 0).otherwise(slice_of(F.col(bounds), F.col(at), most))).drop(key, bounds)


def numbered(df: DataFrame, by: str, at: str, order: list, name: str = "seq", size: tuple[int, int] | None = None, **how) -> DataFrame:
    """The place of each row (from 1) among those of its group, ordered by ``at`` and then ``order``."""
    cut, base, key, own = (_free(x, df) for x in ("slice", "base", "of", "of_slice"))
    size = size or ((0, 0) if "slices" in how else extent(df, by))
    rows = sliced(df, by, at, cut, size=size, **how)
    before = Window.partitionBy(key).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(by).alias(key), F.col(cut).alias(own)).agg(F.count("*").alias("n"))
    sizes = sizes.select(key, own, F.sum("n").over(before).alias(base)).where(F.col(own) > 0)
    inside = F.row_number().over(Window.partitionBy(by, cut).orderBy(at, *order))
    out = dealt(rows, size[0], by, cut).withColumn(name, inside).join(F.broadcast(sizes), (F.col(by) == F.col(key)) & (F.col(cut) == F.col(own)), "left")
    return out.withColumn(name, (F.col(name) + F.coalesce(base, F.lit(0))).cast("int")).drop(cut, base, key, own)


def carried(df: DataFrame, by: str, at: str, order: list, value: Column, how: str, name: str, including: bool, **cut_how) -> DataFrame:
    """A running value over a group in order: ``how`` is sum, max or last (not null); with or without the row's own.

    Null where nothing came before.
    """
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    cut, kept, before, key, own = (_free(x, df) for x in ("slice", "value_", "before_", "of", "of_slice"))
    size = (0, 0) if "slices" in cut_how else extent(df, by)
    rows = sliced(df.withColumn(kept, value), by, at, cut, size=size, **cut_how)
    w = Window.partitionBy(by, cut).orderBy(at, *order)
    if how == "last":
        place = F.struct(F.col(at), *[o if isinstance(o, Column) else F.col(o) for o in order])
        ends = rows.where(F.col(kept).isNotNull()).groupBy(F.col(by).alias(key), F.col(cut).alias(own)).agg(F.max_by(kept, place).alias("v"))
    else:
        ends = rows.groupBy(F.col(by).alias(key), F.col(cut).alias(own)).agg(fold(F.col(kept)).alias("v"))
    every = rows.select(F.col(by).alias(key), F.col(cut).alias(own)).distinct().join(ends, [key, own], "left")
    over = Window.partitionBy(key).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(key, own, fold(F.col("v")).over(over).alias(before)).where(F.col(own) > 0)
    inside = fold(F.col(kept)).over(w.rowsBetween(Window.unboundedPreceding, 0 if including else -1))
    out = dealt(rows, size[0], by, cut).withColumn(name, inside).join(F.broadcast(every), (F.col(by) == F.col(key)) & (F.col(cut) == F.col(own)), "left")
    here, there = F.col(name), F.col(before)
    total = {"sum": F.when(here.isNull(), there).when(there.isNull(), here).otherwise(here + there), "max": F.greatest(here, there), "last": F.coalesce(here, there)}[how]
    return out.withColumn(name, total).drop(cut, kept, before, key, own)
