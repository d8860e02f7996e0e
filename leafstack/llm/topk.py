"""Exact top-k search by inner product, by distributed selection over score histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafstack.llm.common import BROADCAST_BYTES, cut, drop_cut, whole_key

#: Vectors in a block of candidates and in a block of queries; a task scores one pair of blocks at a time.
CANDIDATES, QUERIES = 8192, 1024
#: Bins of a histogram.
BINS = 256
#: Scores beyond this, either way, count as this; components are cut off at HUGE before.
FARTHEST, HUGE = (1 << 62) - (1 << 12), 1e300


def _blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Vectors as rows (dim, n, peak, ids, data): blocks of at most size vectors of one dimension, as bytes."""

    def work(batches):
        waiting: dict[int, list] = {}

        def out(dim: int, n: int):
            ids, data = (np.concatenate(x) for x in zip(*waiting[dim], strict=True))
            waiting[dim] = [(ids[n:], data[n:])]
            return dim, len(ids[:n]), float(np.abs(data[:n]).max(initial=0)), ids[:n].astype("<i8").tobytes(), _pack(data[:n])

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "n", "peak", "ids", "data"])

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            values, offsets = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == dim)
                data = values[offsets[which][:, None] + np.arange(dim)]
                waiting.setdefault(dim, []).append((ids[which], np.clip(np.floor(np.clip(data, -HUGE / scale, HUGE / scale) * scale), -HUGE, HUGE)))
                while sum(len(x[0]) for x in waiting[dim]) >= size:
                    yield batch_of([out(dim, size)])
        if found := [out(dim, size) for dim in waiting if sum(len(x[0]) for x in waiting[dim])]:
            yield batch_of(found)

    return rows.mapInArrow(work, "dim int, n int, peak double, ids binary, data binary")


def _pack(data: np.ndarray) -> bytes:
    """Whole numbers as 16-bit integers if they fit, else as doubles; a first byte says which."""
    small = np.abs(data).max(initial=0) < 1 << 15
    return (b"h" if small else b"d") + data.astype("<i2" if small else "<f8").tobytes()


def _unpack(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"h" else "<f8", offset=1).reshape(n, dim)


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and the integer scores (queries by candidates) of a pair of blocks; a query isn't its own candidate."""
    q, c = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
    a, b = _unpack(row.q_data, row.dim, len(q)), _unpack(row.data, row.dim, len(c))
    top = row.dim * row.peak * row.q_peak
    if top < 1 << 24:
        s = (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int32)
    elif top < 1 << 53:
        s = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    elif top < FARTHEST:
        s = a.astype(np.int64) @ b.astype(np.int64).T
    else:  # in Python's whole numbers
        whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
        s = np.clip(whole(a) @ whole(b).T, -FARTHEST, FARTHEST).astype(np.int64) if row.dim else np.zeros((len(q), len(c)), np.int64)
    return q, c, s


def _own(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, candidate) of pairs of a vector with itself."""
    order = np.argsort(c, kind="stable")
    at, end = np.searchsorted(c[order], q), np.searchsorted(c[order], q, side="right")
    rows = np.repeat(np.arange(len(q)), end - at)
    return rows, order[np.concatenate([np.arange(a, b) for a, b in zip(at, end, strict=True)])] if len(rows) else rows


def _each(pairs: DataFrame, f, schema: str) -> DataFrame:
    """Run f(row) for every pair of blocks."""

    def work(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                for out in f(row):
                    yield out

    return pairs.mapInPandas(work, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """The k highest integer inner products of each query with every other row, exactly.

    Components are floor(scale * x). Everything is scored, in blocks of candidates against blocks of queries. The
    first histograms cover each query's whole range of scores; each next one covers the bin that holds the kth
    value, until that bin is one integer wide. From each pair of blocks only the highest bins are sent on, as far as
    they hold k scores: lower ones can't hold the kth. Then scores above the kth value are taken, and of those equal
    to it the smallest keys.

    Returns query_id, rank (from 1), vec_id, score. Ties go to the smaller key. Vectors that are null or hold a null
    or a non-finite component take no part, nor do rows with a null key; a vector has no score with one of another
    length, but an empty one has score 0 with the other empty ones. Scores beyond FARTHEST (about 4.6e18) either way
    count as that. Of several vectors with one key, the least one asks. Keys are whole numbers; others raise TypeError. Rows with the query's own key are no
    candidates. A key that is there several times counts as several candidates (and, as a query, once). An empty
    table gives an empty table.
    """
    spark = vectors.sparkSession
    clean = vectors.select(whole_key(vectors, key).alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"), is_query.alias("is_query")).filter("id is not null and x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    candidates = cut(_blocks(clean.select("id", "x"), CANDIDATES, scale), "topk-candidates")
    asked = _blocks(clean.filter("is_query").groupBy("id").agg(F.min("x").alias("x")), QUERIES, scale)
    queries = cut(asked.select(F.monotonically_increasing_id().alias("b"), F.col("dim").alias("q_dim"), F.col("peak").alias("q_peak"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "topk-queries")
    sizes = sorted((r.b, r.n) for r in queries.select("b", (F.octet_length("q_data") + 3 * F.octet_length("q_ids")).alias("n")).collect())  # a row for each block of queries
    groups, room = [[]], BROADCAST_BYTES
    for b, n in sizes:
        if n > room and groups[-1]:
            groups.append([])
            room = BROADCAST_BYTES
        groups[-1].append(b)
        room -= n

    def pairs(side: DataFrame) -> DataFrame:
        """Every block of candidates with every block of queries of its dimension: queries go to the candidates by broadcast, as many blocks at a time as may be."""
        parts = [candidates.join(F.broadcast(side.filter(F.col("b").between(g[0], g[-1])) if len(groups) > 1 else side), F.col("dim") == F.col("q_dim")) for g in groups if g] or [candidates.join(F.broadcast(side), F.col("dim") == F.col("q_dim"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def with_state(state: DataFrame) -> DataFrame:
        """Blocks of queries with the bounds of their queries in order; there are at most QUERIES in a block."""
        packed = state.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("s"))
        return queries.join(packed.select("b", F.expr("transform(s, x -> x.low)").alias("lows"), F.expr("transform(s, x -> x.high)").alias("highs")), "b")

    def bounds(row):
        q, c, s = _scores(row)
        yield pd.DataFrame({"b": row.b, "pos": np.arange(len(q), dtype=np.int32), "low": s.min(1).astype(np.int64), "high": s.max(1).astype(np.int64), "n": len(c) - np.bincount(_own(q, c)[0], minlength=len(q))})

    state = _each(pairs(queries), bounds, "b long, pos int, low long, high long, n long").groupBy("b", "pos").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    # the kth score lies from low to high; above: scores over high, which are all taken
    state = cut(state.filter("n > 0").select("b", "pos", "low", F.when(F.col("n") <= k, F.col("low")).otherwise(F.col("high")).alias("high"), F.lit(0).cast("long").alias("above")), "topk-state")

    def histogram(row):
        q, c, s = _scores(row)
        low, high = np.asarray(row.lows), np.asarray(row.highs)
        rows, columns = _own(q, c)
        own: dict[int, list] = {}
        for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
            own.setdefault(i, []).append(j)
        out = []
        for i in np.flatnonzero(low < high).tolist():
            mine = np.delete(s[i], own[i]) if i in own else s[i]
            mine = mine[(mine >= low[i]) & (mine <= high[i])]
            counts = np.bincount((mine - low[i]) // -((low[i] - high[i] - 1) // BINS))
            bins = np.flatnonzero(counts)[::-1]
            bins = bins[np.cumsum(counts[bins]) - counts[bins] < k]
            out.append((np.full(len(bins), i), bins, counts[bins]))
        if out:
            pos, bins, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"b": row.b, "pos": pos.astype(np.int32), "bin": bins.astype(np.int32), "n": n.astype(np.int64)})

    while not (todo := state.filter("low < high")).isEmpty():
        live = with_state(state).filter("exists(arrays_zip(lows, highs), x -> x.lows < x.highs)")
        found = _each(pairs(live), histogram, "b long, pos int, bin int, n long").groupBy("b", "pos", "bin").agg(F.sum("n").alias("n"))
        ahead = Window.partitionBy("b", "pos").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows each
        width = F.expr(f"(high - low + {BINS}) div {BINS}")
        kth = found.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(todo, ["b", "pos"]).filter(f"above + ahead < {k} and above + ahead + n >= {k}")
        kth = kth.select("b", "pos", (F.col("low") + F.col("bin") * width).alias("low"), F.least("high", F.col("low") + (F.col("bin") + 1) * width - 1).alias("high"), (F.col("above") + F.col("ahead")).alias("above"))
        new = cut(kth.unionByName(state.filter("low >= high")), "topk-state")
        drop_cut(state)
        state = new

    def select(row):
        q, c, s = _scores(row)
        own = np.zeros(s.shape, bool)
        own[_own(q, c)] = True
        i, j = np.nonzero((s >= np.asarray(row.lows)[:, None]) & ~own)
        value = s[i, j].astype(np.int64)
        order = np.lexsort((c[j], -value, i))
        i, j, value = i[order], j[order], value[order]
        few = np.arange(len(i)) - np.searchsorted(i, i) < k  # no more than k of a block can be wanted, and ties go to the smallest keys
        yield pd.DataFrame({"query_id": q[i[few]], "vec_id": c[j[few]], "score": value[few]})

    found = _each(pairs(with_state(state)), select, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
