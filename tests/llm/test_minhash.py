import random
from collections import Counter

import numpy as np
import pytest

from leafstack.llm import minhash as M


def bag(text, k=5):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def similar(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    label = {}
    bags = [(k, bag(t)) for k, t in rows if k is not None]
    for k, _ in rows:
        label[k] = k
    changed = True
    while changed:
        changed = False
        for i, (k, a) in enumerate(bags):
            for m, b in bags[:i]:
                if a and b and label[k] != label[m] and similar(a, b) >= 0.8:
                    label[k] = label[m] = min(label[k], label[m])
                    changed = True
    return sorted((-1 if k is None else k, -1 if k is None else label[k]) for k, _ in rows)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id) for r in M.near_duplicates(df).collect())


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    m = 4096
    for _ in range(4):
        hashes = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        a, b = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
        both = M.signatures(np.repeat([0, 1], 40), np.r_[hashes, hashes], np.r_[a, b], 2, m)
        wanted = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((both[0] == both[1]).mean() - wanted) < 4 * np.sqrt(wanted * (1 - wanted) / m)


def test_signature_of_a_text_alone():
    owner, hashes, counts = np.array([0, 0, 1, 2, 2]), np.array([5, 9, 7, 5, 9], np.uint64), np.array([1, 3, 100000, 1, 3])
    every = M.signatures(owner, hashes, counts, 3)
    alone = M.signatures(np.array([0, 0]), hashes[:2], counts[:2], 1)
    assert (every[0] == alone[0]).all() and (every[2] == alone[0]).all() and np.isfinite(every).all()


def test_similarity():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (" ".join(rng.choices("abc", k=30)) for _ in range(2))
        raw = [M._bag(x.encode()) for x in (a, b)]
        assert abs(M.similarity(*raw) - similar(bag(a), bag(b))) < 1e-12


def test_classes(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 50, 200]))] for _ in range(12)]
    rows = []
    for k in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"n{k}"
        rows.append((k * 7 % 151, " ".join(words)))
    chain = [f"c{i}" for i in range(120)]
    for k in range(12):  # each like the one before it, the ends unlike
        chain = [*chain[4:], *(f"d{k}-{i}" for i in range(4))]
        rows.append((300 + k, " ".join(chain)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, ""), (503, "one"), (504, "one"), (505, "  one\n"), rows[5], rows[5]]
    assert run(spark, rows) == brute(rows)


def test_one_stays(spark):
    text = " ".join(f"x{i}" for i in range(50))
    df = spark.createDataFrame([(3, text, "a"), (1, text + " y", "b"), (2, "other words here", "c"), (4, None, "d")], "doc_id long, text string, label string")
    assert sorted(r.doc_id for r in M.keep_one(df).collect()) == [1, 2, 4]
    assert M.keep_one(df.filter("false")).count() == 0 and M.near_duplicates(df.filter("false")).count() == 0


def test_real(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_blocks(spark, monkeypatch):
    """Many near copies of several degrees, in small blocks."""
    monkeypatch.setattr(M, "FRINGE", 5)
    monkeypatch.setattr(M, "BLOCK", 9)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(120):
        words = list(base) + ["w1 w2 w3 w4 w5 w6"] * 2
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def test_shuffled_way(spark, monkeypatch):
    """Nothing is small, many rows share keys, and texts meet few of their pairs at a time."""
    from leafstack.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 40)
    monkeypatch.setattr(M, "FAN", 4)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base)) for k in range(40)]
    for k in range(40, 110):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def test_several_texts_of_a_key(spark):
    """One of them stands for the key, the same whatever the rows' order."""
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1]), (4, texts[2]), (4, None)]
    got = [run(spark, r) for r in (rows, rows[::-1], rows * 2)]
    assert got[0] == got[1] and got[2] == sorted(got[0] * 2) and got[0] in ([(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (4, 4)], [(1, 1), (2, 2), (2, 2), (3, 2), (4, 4), (4, 4)])


def test_keys(spark):
    with pytest.raises(TypeError):
        M.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    odd = spark.createDataFrame([(1, "a b", 2, 3), (2, "a b", 3, 4)], "doc_id int, text string, label int, doc int")
    assert [tuple(r) for r in M.keep_one(odd).collect()] == [(1, "a b", 2, 3)]
