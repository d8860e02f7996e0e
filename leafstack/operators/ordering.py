"""Orders of nodes, most recent ones, and first occurrences. Orders are columns, never the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafstack.functions.text import natural_key


def sort_columns(key: str | Column | None, name: str, unique: str, descending: bool = False) -> list[Column]:
    """Sort keys: the key, then the natural name, then the name and a unique column; the direction holds for all, nulls are last."""
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    first = [] if key is None else [F.col(key) if isinstance(key, str) else key]
    return [turn(c) for c in [*first, natural_key(F.col(name)), F.col(name), F.col(unique)]]


def ranked(df: DataFrame, keys: list[Column], by: list[str], as_: str = "rank") -> DataFrame:
    """Rank (from 1) of each row among those of its group."""
    return df.withColumn(as_, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def shuffled(df: DataFrame, by: list[str], unique: str, seed: int) -> DataFrame:
    """A repeatable random order: by a digest of the seed and the unique column."""
    return ranked(df, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(unique).cast("string"))), F.col(unique)], by)


def last_of_each(df: DataFrame, by: list[str], when: str, unique: str) -> DataFrame:
    """The latest row of each group: aggregated before it is shuffled, so a hot group costs no more than others."""
    names = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max(F.struct(F.col(when), F.col(unique), *[F.col(c) for c in names if c not in (when, unique)])).alias("x"))
    return best.select(*by, *[F.col(f"x.{c}").alias(c) for c in names])


def recent(df: DataFrame, by: list[str], when: str, unique: str, n: int) -> DataFrame:
    """The n groups with the latest rows, newest first: rank, and that row."""
    top = last_of_each(df, by, when, unique).orderBy(F.col(when).desc(), F.col(unique).desc()).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(when).desc(), F.col(unique).desc())))  # n rows


def placed(df: DataFrame, newest: str, unique: str, as_: str = "place", parts: int = 256) -> DataFrame:
    """Place (from 1) of each row among all, newest first, then by the unique column, without a window over all rows.

    Some rows, chosen by a hash of the unique column, bound ranges; a row's place is its rank in its range after the
    rows of the ranges before. Only the bounds and a count for each range come to the driver.
    """
    t, u = F.col(newest), F.col(unique)
    kinds = df.schema[newest].dataType, df.schema[unique].dataType
    chosen = df.filter(t.isNotNull() & u.isNotNull()).select(newest, unique).orderBy(F.xxhash64(unique), unique).limit(parts - 1)
    bounds = [F.struct(F.lit(r.t).cast(kinds[0]).alias("t"), F.lit(r.u).cast(kinds[1]).alias("u")) for r in chosen.select(t.cast("string").alias("t"), u.cast("string").alias("u")).collect()]
    before = F.size(F.filter(F.array(*bounds), lambda x: (x.t > t) | ((x.t == t) & (x.u < u)))) if bounds else F.lit(0)
    rows = df.withColumn("range", F.when(t.isNull(), parts).otherwise(before))
    starts, n = [], 0
    for r in rows.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        starts.append((r["range"], n))
        n += r.n
    inside = Window.partitionBy("range").orderBy(t.desc(), u)
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "range int, start long"))
    return rows.withColumn("rank", F.row_number().over(inside)).join(starts, "range").withColumn(as_, F.col("start") + F.col("rank")).drop("range", "rank", "start")


def first_of_each(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """The first row of each group by position, as an order-preserving distinct."""
    names = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min(F.struct(F.col(position), *[F.col(c) for c in names if c != position])).alias("x"))
    return best.select(*by, *[F.col(f"x.{c}").alias(c) for c in names])


def unique_names(df: DataFrame, name: str, unique: str, by: list[str]) -> DataFrame:
    """names made unique: the second and later ones of a group get a number before their extension."""
    place = F.row_number().over(Window.partitionBy(*by, name).orderBy(unique))
    stem, extension = F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return df.withColumn("place", place).withColumn("unique_name", F.when(F.col("place") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), (F.col("place") - 1).cast("string"), extension))).drop("place")
