import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from leafstack.llm import mixing as X


def fill(nodes, budget):
    """nodes: name to (capacity, weight). The shares, by trying."""
    out, open_ = {}, dict(nodes)
    left = budget
    while True:
        total = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c * total <= w * left]
        if not full:
            return out | {n: min(c, w * left // total) for n, (c, w) in open_.items()}
        n = min(full, key=lambda n: (open_[n][0] / open_[n][1], n is not None, n))
        out[n] = open_[n][0]
        left -= open_.pop(n)[0]
        if not open_:
            return out


def brute(rows, weights, part, epochs, seed):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = defaultdict(int)
    for k, t, d, lang, s in rows:
        leaves[d, lang, s] += words(t)
    shares = {(): sum(leaves.values()) * part[0] // part[1]}
    shares[()] = min(shares[()], sum(leaves.values()) * epochs)
    for depth in range(3):
        new = {}
        for above, budget in shares.items():
            nodes = defaultdict(int)
            for leaf, n in leaves.items():
                if leaf[:depth] == above:
                    nodes[leaf[depth]] += n * epochs
            given = fill({n: (c, weights[depth].get(n, 1)) for n, c in nodes.items()}, budget)
            new |= {(*above, n): a for n, a in given.items()}
        shares = new
    out = []
    for leaf, n in leaves.items():
        whole, rest = divmod(shares[leaf], n) if n else (0, 0)
        mine = defaultdict(list)
        for r in rows:
            if r[2:] == leaf:
                mine[hashlib.md5(f"{seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest()].append(r)
        at = 0
        for place in sorted(mine):
            at += sum(words(r[1]) for r in mine[place])
            copies = whole + (at <= rest)
            out += [(-1 if r[0] is None else r[0], words(r[1]), copies) for r in mine[place] if copies]
    return sorted(out)


def run(spark, rows, weights, part, epochs):
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, lang string, source string").repartition(3)
    got = X.mix(df, F.col("d"), weights, part, epochs, "s").collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_copies) for r in got)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "DIGITS", 1)
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(60), rng.choice("ab"), rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "s2"])) for k in range(400)]
    rows += [(None, "x y", "a", "en", "s0"), (7, None, "a", "en", "s9"), (1000, "z " * 5000, "b", "en", "s1"), rows[0], rows[0]]
    weights = [{"a": 3}, {"en": 5, "fr": 2}, {"s0": 2}]
    for part, epochs in (((1, 2), 1), ((3, 4), 3), ((2, 1), 3), ((9, 1), 2), ((0, 1), 1)):
        assert run(spark, rows, weights, part, epochs) == brute(rows, weights, part, epochs, "s")


def test_salted_way(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_BYTES", -1)
    rows = [(k, "w " * (k % 9), "a" if k % 3 else "b", "en", f"s{k % 2}") for k in range(100)]
    assert run(spark, rows, [{}, {}, {}], (1, 2), 1) == brute(rows, [{}, {}, {}], (1, 2), 1, "s")


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, l string, tokens long")
    got = {(r.d, r.l): r.alloc for r in X.budgets(leaves, ["d", "l"], [{}, {}], (800, 2010), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 390, ("b", "z"): 400}


def test_copies_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "k", "en", "s", 9)], "doc_id long, text string, d string, lang string, source string, n_tokens int")
    mixed = X.mix(df, F.col("d"), [{}, {}, {}], (3, 1), 5)
    assert [r.n_copies for r in mixed.collect()] == [3] and X.copies(mixed, ["doc_id"]).count() == 3
    assert X.mix(df.filter("false"), F.col("d"), [{}, {}, {}]).count() == 0
