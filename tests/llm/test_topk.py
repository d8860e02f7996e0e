import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.llm import topk as K


def brute(rows, k, every):
    def whole(v):
        return [math.floor(64 * x) for x in v] if v is not None and all(x is not None and math.isfinite(x) for x in v) else None

    good = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q, v in {i: w for i, w in good if i % every == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def run(spark, rows, k, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in K.top_k(df, F.col("vec_id") % every == 0, k).collect())


@pytest.mark.parametrize("blocks", [(8192, 1024), (7, 3)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(K, "CANDIDATES", blocks[0])
    monkeypatch.setattr(K, "QUERIES", blocks[1])
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [0.5] * 6) for i in range(40)]  # ties without end
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (205, [1.0, 2.0]), (210, []), (215, [])]
    rows += [(220, [30000.0] * 6), (225, [-30000.5] * 6), (1, [0.25] * 6)]
    assert run(spark, rows, 5, 5) == brute(rows, 5, 5)


def test_few(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])], 20, 1) == [(0, 1, 1, 8192), (1, 1, 0, 8192)]
    assert run(spark, [(0, [1.0])], 20, 1) == []
    assert K.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_shuffled_way(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(K, "BROADCAST_BYTES", -1)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 120").collect()]
    assert run(spark, rows, 20, 20) == brute([(i, list(v)) for i, v in rows], 20, 20)


def test_huge_components(spark):
    """Scores that no long holds count as the farthest; others near them are exact."""
    rows = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 1.0]), (3, [1e7, 1.0]), (4, [0.0, 1e308]), (5, [1e-3, 5.0]), (6, [0.0, 0.0])]
    got = {(r.query_id, r.vec_id): r.score for r in K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 6, k=6).collect()}
    whole = {k: [max(-(10**300), min(10**300, math.floor(64 * x) if abs(x) < 1e300 else int(math.copysign(1e300, x)))) for x in v] for k, v in rows}
    for q in range(6):
        for c in range(7):
            if q != c:
                exact = sum(a * b for a, b in zip(whole[q], whole[c], strict=True))
                assert got[q, c] == max(-K.FARTHEST, min(K.FARTHEST, exact)), (q, c)


def test_queries_in_several_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_BYTES", 300)
    monkeypatch.setattr(K, "QUERIES", 3)
    rng = np.random.default_rng(7)
    data = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, K.top_k(df, F.col("vec_id") % 4 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect()))
    whole = np.floor(64 * data).astype(np.int64)
    wanted = []
    for q in range(0, 60, 4):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(60) if c != q)[:5]
        wanted += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(wanted)
