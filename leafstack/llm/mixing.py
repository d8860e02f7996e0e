"""Mixing sources to target weights: hierarchical token budgets, and seeded token-prefixes of each leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafstack.llm.common import BROADCAST_BYTES, cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Leading hexadecimal digits of the order key that make a bucket; the prefix ends within one bucket of a leaf.
DIGITS = 3
SALTS = 16


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def _weights(level: str, given: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in sorted(given.items()):
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's budget among its nodes (columns weight, capacity, budget): alloc.

    In order of capacity for their weight, nodes that can't use their share get all they have; the rest is shared
    by weight among the others, so that what one lacks goes to its siblings first. Whole numbers, rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn("full", F.col("capacity") * F.sum("weight").over(rest) <= F.col("weight") * (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))))
    given = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0))
    others = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    share = F.expr("least(capacity, (weight * (budget - given)) div others)")
    return nodes.withColumn("given", given).withColumn("others", others).withColumn("alloc", F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop("full", "given", "others")


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], part: tuple[int, int], epochs: int, default: int = 1) -> DataFrame:
    """leaves (levels and tokens) with alloc: the tokens that each leaf is to give.

    The whole budget is tokens * part[0] div part[1] of all leaves. It goes down the tree of levels by weight; a
    node's capacity is epochs times the tokens beneath it, so a shortage is made up by siblings before it reaches
    the siblings of an ancestor.
    """
    nodes = leaves.select(*levels, (F.col("tokens") * epochs).alias("capacity"))
    total = leaves.agg(F.expr(f"(coalesce(sum(tokens), 0L) * {part[0]}) div {part[1]}").alias("budget"))
    above = None
    for depth, level in enumerate(levels):
        here = nodes.groupBy(*levels[: depth + 1]).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weights(level, weights[depth], default))
        if above is None:
            here = here.crossJoin(F.broadcast(total)).withColumn("budget", F.least("budget", F.sum("capacity").over(Window.partitionBy())))  # the first level's few nodes
            here = _fill(here, [], level)
        else:
            same = [F.col(c).eqNullSafe(F.col(f"above_{c}")) for c in levels[:depth]]
            here = here.join(above.select(*[F.col(c).alias(f"above_{c}") for c in levels[:depth]], F.col("alloc").alias("budget")), same).drop(*[f"above_{c}" for c in levels[:depth]])
            here = _fill(here, levels[:depth], level)
        above = here
    return above.select(*levels, F.col("alloc").cast("long").alias("alloc"), F.expr(f"capacity div {epochs}").alias("tokens"))


def mix(docs: DataFrame, domain: Column, weights: list[dict[str, int]], part: tuple[int, int] = (1, 1), epochs: int = 1, seed: str = "0", key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with domain, n_tokens and n_copies: how often the mixture holds each document (rows that it doesn't hold are left out).

    Tokens are words. Each leaf (domain, lang, source) gets a budget; as many whole epochs as fit it are taken, and
    of one more the longest prefix whose tokens fit the rest, in the order of md5(seed:epoch:key). Rows with equal
    keys stand at one place and go in together or not. Buckets of the key's first digits are summed before anything
    is ordered, so only the bucket in which the prefix ends is sorted, and no leaf is gathered in one task. Null
    names are names of their own; a null text has no tokens; a null key is ordered as an empty one. An empty table
    gives an empty table. Columns of docs named domain, n_tokens or n_copies are replaced.
    """
    levels = ["__domain", "__lang", "__source"]
    names = [c for c in docs.columns if c not in ("domain", "n_tokens", "n_copies")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names], domain.alias("__domain"), F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("__key"))
    small = cut(docs.select(*levels, "__key", n_words(F.col(f"`{text}`")).alias("n_tokens")), "mix-tokens")
    leaves = cut(small.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-leaves")
    plan = budgets(leaves, levels, weights, part, epochs)
    plan = plan.select(*levels, F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(0).alias("whole"), F.when(F.col("tokens") > 0, F.col("alloc") % F.col("tokens")).otherwise(0).alias("rest"))
    plan = cut(plan, "mix-plan")
    size = (leaves.count() or 0) * 200
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.col("__key")))

    def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"p{c}")) for c in levels]
        plan = plan.select(*[F.col(c).alias(f"p{c}") for c in levels], *[c for c in plan.columns if c not in levels])
        if size <= BROADCAST_BYTES:
            return rows.join(F.broadcast(plan), same).drop(*[f"p{c}" for c in levels])
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)))
        plan = plan.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return rows.join(plan, [*same, F.col("__salt") == F.col("__salt2")]).drop("__salt", "__salt2", *[f"p{c}" for c in levels])

    placed = with_plan(small, plan).withColumn("place", place).withColumn("bucket", F.substring("place", 1, DIGITS))
    sums = placed.groupBy(*levels, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(upto))  # at most 16**DIGITS rows a leaf
    last = sums.filter("upto > rest").groupBy(*levels).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
    last = last.select(*[F.col(c).alias(f"l{c}") for c in levels], F.col("x.bucket").alias("end_bucket"), F.col("x.before").alias("before"))
    plan = cut(plan.join(last, [F.col(c).eqNullSafe(F.col(f"l{c}")) for c in levels], "left").select(*levels, "whole", "rest", "end_bucket", "before"), "mix-ends")
    at_end = with_plan(small, plan.filter("end_bucket is not null")).withColumn("place", place).filter(F.substring("place", 1, DIGITS) == F.col("end_bucket"))
    order = Window.partitionBy(*levels).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = at_end.withColumn("upto", F.col("before") + F.sum("n_tokens").over(order)).filter("upto <= rest").groupBy(*levels).agg(F.max("place").alias("end_place"))
    taken = taken.select(*[F.col(c).alias(f"l{c}") for c in levels], "end_place")
    plan = cut(plan.join(taken, [F.col(c).eqNullSafe(F.col(f"l{c}")) for c in levels], "left").select(*levels, "whole", "end_bucket", "end_place"), "mix-places")
    inside = F.col("end_bucket").isNull() | (F.substring("place", 1, DIGITS) < F.col("end_bucket")) | F.coalesce(F.col("place") <= F.col("end_place"), F.lit(False))
    out = with_plan(docs, plan).withColumn("place", place).withColumn("n_copies", F.col("whole") + F.when(inside, 1).otherwise(0)).filter("n_copies > 0")
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("__domain").alias("domain"), n_words(F.col(f"`{text}`")).alias("n_tokens"), F.col("n_copies").cast("long").alias("n_copies"))


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each copy."""
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select(*[F.col(f"`{c}`") for c in columns])
