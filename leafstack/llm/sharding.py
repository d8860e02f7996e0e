"""Shards of nearly equal bytes: the minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import cut, drop_cut, meet

#: Group boundaries that one look at the groups brings to the driver; finer looks follow where they are needed.
POINTS = 8192


class Boundaries:
    """What is known of the groups laid end to end: some of them (start, end), and gaps in which others lie unseen."""

    def __init__(self, total: int):
        self.total, self.known = total, {}
        self.closed: list[tuple[int, int]] = []

    def add(self, groups: list[tuple[int, int]]) -> None:
        self.known |= dict(groups)
        self.starts = sorted(self.known)
        self.ends = [self.known[s] for s in self.starts]

    def below(self, x: int) -> tuple[int, int]:
        """Bounds on the last boundary that is not after x."""
        if x >= self.total:
            return self.total, self.total
        i = bisect_right(self.starts, x) - 1
        if i < 0:
            return 0, min(x, self.starts[0] if self.starts else x)
        if x < self.ends[i]:
            return self.starts[i], self.starts[i]
        if x == self.ends[i] or (i + 1 < len(self.starts) and self.starts[i + 1] == self.ends[i]):
            return self.ends[i], self.ends[i]
        return self.ends[i], x

    def cuts(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """Where greedy filling cuts, at best (upper) or at worst."""
        out, at = [], 0
        for _ in range(shards):
            at = max(at, self.below(at + capacity)[upper])
            out.append(at)
        return out

    def least(self, shards: int, upper: bool) -> int:
        """The smallest capacity with which greedy filling reaches the end, by binary search."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, upper)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(total: int, shards: int, look) -> list[int]:
    """Boundaries at which the least feasible capacity cuts groups that lie from 0 to total.

    look(ranges, step) gives the (start, end) of the groups in the ranges that hold a multiple of step; with step 1
    that is every group there. A capacity is checked greedily. While unseen groups leave it open which capacity is
    the least one or where it cuts, only the ranges in question are looked at again, in finer steps. Greedy filling
    from the left and from the right bounds each cut; within these bounds it goes to the boundary nearest its even
    share, so that the last shard isn't left with the rest.
    """
    if total <= 0:
        return []
    seen, back, step = Boundaries(total), Boundaries(total), max(1, total // POINTS)

    def learn(ranges, step):
        groups = look(ranges, step)
        seen.add(groups)
        back.add([(total - b, total - a) for a, b in groups])

    learn([(0, total)], step)
    while True:
        least, most = seen.least(shards, True), seen.least(shards, False)
        low, high = seen.cuts(least, shards, False), seen.cuts(most, shards, True)
        ranges = [*zip(low, high, strict=True), *((total - b, total - a) for a, b in zip(back.cuts(least, shards, False), back.cuts(most, shards, True), strict=True))]
        ranges = [(a, b) for a, b in ranges if a < b]
        if least == most and not ranges:
            break
        if step == 1:
            raise AssertionError("every boundary in question is known")
        step = max(1, min(step // 16, sum(b - a for a, b in ranges) // POINTS))
        learn(ranges, step)
    even = [j * total // shards for j in range(1, shards)]
    learn([(x, x) for x in even], 1)
    first = [total - x for x in reversed(back.cuts(least, shards, False)[:-1])]
    cuts, at = [], 0
    for x, earliest in zip(even, first, strict=True):
        left, right = seen.below(x)[0], total - back.below(total - x)[0]
        best = max(left if x - left <= right - x else right, earliest)
        if best > at + least:  # the last boundary known that the capacity allows; `earliest` is one
            best = max(seen.below(at + least)[0], earliest)
        at = max(at, best)
        cuts.append(at)
    return sorted({c for c in cuts if 0 < c < total})


def _running(value: str | None, per: str | None):
    """A function for mapInArrow that adds the task's number and a running count or sum within it (and within runs of per)."""

    def work(batches):
        pid, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            step = np.ones(batch.num_rows, np.int64) if value is None else batch.column(value).to_numpy(zero_copy_only=False)
            run = np.cumsum(step)
            if per is not None:
                kind = batch.column(per).to_numpy(zero_copy_only=False)
                new = np.flatnonzero(np.r_[kind[0] != last, kind[1:] != kind[:-1]])
                before = np.r_[0, run][new]
                if not len(new) or new[0]:
                    new, before = np.r_[0, new], np.r_[-at, before]
                run = run - np.repeat(before, np.diff(np.r_[new, len(run)]))
                at, last = int(run[-1]), kind[-1]
            else:
                run = run + at
                at = int(run[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(run), pid, np.int32)), pa.array(run.astype(np.int64))], names=[*batch.schema.names, "pid", "run"])

    return work


def _ddl(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row of docs into one of the shards 0 to shards-1, so that the largest holds as few bytes as possible.

    Equal texts are one group and stay together; groups are ordered by their smallest key, and each shard takes a
    contiguous run of them. The least feasible capacity is found by binary search with greedy checks; of the cuts
    that it allows, those nearest to even shares are taken, so that the last shard isn't left with the rest. Returns key, size (UTF-8 bytes of the text plus 8), text_crc32, law 'bytes', shard,
    slot (from 0 without a gap within its shard, by group and key) and grown_shard (null: only a law by key has
    it). A null text has no bytes and is equal to an empty one. Null keys come first. Repeated rows are rows of
    their own, with slots of their own. An empty table gives an empty table. A group larger than an even share is
    not broken: it then decides the capacity.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = cut(docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("crc"), F.unhex(F.sha2(body, 256)).alias("same")), "shard-rows")
    groups = rows.groupBy("same").agg(F.min("key").alias("first"), F.sum("size").alias("bytes"))
    ordered = groups.repartitionByRange("first", "same").sortWithinPartitions("first", "same")
    ordered = cut(ordered.mapInArrow(_running("bytes", None), _ddl(ordered, "pid int, run bigint")), "shard-groups")
    sums = sorted((r.pid, r.most) for r in ordered.groupBy("pid").agg(F.max("run").alias("most")).collect())  # a row for each task
    before, total = [], 0
    for pid, most in sums:
        before.append((pid, total))
        total += most
    laid = ordered.join(F.broadcast(spark.createDataFrame(before, "pid int, before bigint")), "pid").select("same", "first", (F.col("before") + F.col("run") - F.col("bytes")).alias("start"), (F.col("before") + F.col("run")).alias("end"))
    laid = cut(laid, "shard-laid")  # in order, so that a look reads only the parts of it that it asks for

    def look(ranges, step):
        where = F.lit(False)
        for a, b in ranges:
            where = where | ((F.col("end") >= a) & (F.col("start") <= b))
        if step > 1:
            where &= F.floor(F.col("start") / step) != F.floor(F.col("end") / step)
        return [(r.start, r.end) for r in laid.filter(where).select("start", "end").collect()]

    cuts = minimax_cuts(total, shards, look)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + F.when(F.col("start") >= c, 1).otherwise(0)
    placed = meet(rows, laid.select("same", "first", shard.alias("shard")), "same", 96).select("shard", "first", "same", "key", "size", "crc")
    placed = placed.repartitionByRange("shard", "first", "same", "key", "crc", F.rand(7)).sortWithinPartitions("shard", "first", "same", "key")
    placed = placed.select("key", "size", "crc", "shard")
    placed = cut(placed.mapInArrow(_running(None, "shard"), _ddl(placed, "pid int, run bigint")), "shard-slots")
    counts = placed.groupBy("pid", "shard").agg(F.max("run").alias("n")).collect()  # at most a row for each task and shard
    filled, offsets = [0] * max(shards, 1), []
    for r in sorted(counts, key=lambda r: (r.pid, r.shard)):
        offsets.append((r.pid, r.shard, filled[r.shard]))
        filled[r.shard] += r.n
    for x in (ordered, laid, rows):
        drop_cut(x)
    offsets = F.broadcast(spark.createDataFrame(offsets, "pid int, shard int, before bigint"))
    return placed.join(offsets, ["pid", "shard"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("run") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
