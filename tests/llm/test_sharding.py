import random
import zlib

import pytest

from leafstack.llm import sharding as S


def least(sizes, shards):
    """Smallest capacity for contiguous shards, by trying."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, n, at = (low + high) // 2, 1, 0
        for x in sizes:
            if at + x > middle:
                n, at = n + 1, 0
            at += x
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed", range(40))
def test_cuts(seed, monkeypatch):
    monkeypatch.setattr(S, "POINTS", 16)
    rng = random.Random(seed)
    sizes = [rng.choice([8, 9, 20, 100, 1000, 5000]) for _ in range(rng.choice([1, 2, 5, 30, 300, 2000]))]
    if rng.random() < 0.3:
        sizes[rng.randrange(len(sizes))] = sum(sizes)
    shards, ends = rng.choice([1, 2, 3, 7, 24]), [0]
    for x in sizes:
        ends.append(ends[-1] + x)
    groups = list(zip(ends, ends[1:], strict=False))

    def look(ranges, step):
        return [(a, b) for a, b in groups if any(b >= lo and a <= hi for lo, hi in ranges) and (step == 1 or a // step != b // step)]

    cuts = S.minimax_cuts(ends[-1], shards, look)
    loads = [b - a for a, b in zip([0, *cuts], [*cuts, ends[-1]], strict=True)]
    assert set(cuts) <= set(ends) and len(loads) <= shards and max(loads) == least(sizes, shards)


def check(rows, out, shards):
    assert len(out) == len(rows)
    by_shard, of_text = {}, {}
    texts = {}
    for k, t in rows:
        texts.setdefault(k, set()).add(t or "")
    for r in out:
        by_shard.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        assert any(r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) for t in texts[r.doc_id])
        of_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    for rs in by_shard.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    groups = {}
    for k, t in rows:
        g = groups.setdefault(t or "", [None, 0])
        g[0] = k if g[0] is None else g[0] if k is None else min(g[0], k)
        g[1] += len((t or "").encode()) + 8
    import hashlib

    ordered = sorted(groups.items(), key=lambda x: (x[1][0] is not None, x[1][0], hashlib.sha256(x[0].encode()).digest()))
    assert max(sum(r.size for r in rs) for rs in by_shard.values()) == least([g[1] for _, g in ordered], shards)


def test_rows(spark, sf_dir):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randrange(50)) for k in range(300)] + [(1000 + k, "copy" * 30) for k in range(150)] + [(7, None), (None, "n"), (5, "five"), (5, "five"), (2000, "é" * 40)]
    for data in (rows, rows[:1], [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]):
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        check(data, S.shard_documents(df, 24).collect(), 24)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.shard_documents(df.filter("false"), 24).count() == 0
