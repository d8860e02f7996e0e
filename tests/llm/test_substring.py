import hashlib
import random

import pytest

from leafstack.llm import substring as S


def brute(rows, n):
    """What is left of each (key, text) row."""
    words = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - n + 1):
                first[tuple(w[i : i + n])] = min(k, first.get(tuple(w[i : i + n]), k))
    out = []
    for k, w in words:
        gone = [False] * len(w)
        if k is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < k:
                    gone[i : i + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((-1 if k is None else k, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def run(spark, rows, n):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.remove_repeats(df, n, outputs=("n_words", "n_removed", "kept_sha256")).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)


def test_automaton():
    rng = random.Random(2)
    for _ in range(200):
        refs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        a = S.Automaton()
        for r in refs:
            a.add(b" ".join(r))
        known = {tuple(r[i : i + 4]) for r in refs for i in range(len(r) - 3)}
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        assert a.matched(text, 4) == [i for i in range(4, 61) if tuple(text[i - 4 : i]) in known]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(12)]
    rows = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rows and rng.random() < 0.6:
            other = (rng.choice(rows)[1] or "").split()
            at = rng.randrange(len(other) + 1)
            text[rng.randrange(len(text) + 1) : 0] = other[at : at + rng.randrange(40)]
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), rows[3], rows[3], (5002, rows[3][1]), (5003, "w1 " * 300), (5004, "w1 " * 200), (5005, "é x " * 20), (5006, "é x " * 20)]
    for n in (6, 13):
        assert run(spark, rows, n) == brute(rows, n)


def test_hot_passage_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARE", 10)
    monkeypatch.setattr(S, "SHARD_WORDS", 50)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k, f"a{k} b{k} {passage} c{k}") for k in range(200)]
    assert run(spark, rows, 13) == brute(rows, 13)


def test_text_and_columns(spark):
    text = " ".join(f"x{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, "k"), (2, "a  b\n" + text, None), (3, None, "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in S.remove_repeats(df, 13).collect()}
    assert got[1].text == text and got[2].text == "a b" and got[3].text is None and got[1].spans == "k"
    assert S.remove_repeats(df.filter("false"), 13).count() == 0


def test_real(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert run(spark, rows, 13) == brute(rows, 13)


def test_shuffled_way(spark, monkeypatch):
    """Nothing is small, hot passages are few, and a long document is several references."""
    from leafstack.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(S, "HOT_KEYS", 20)
    monkeypatch.setattr(S, "SHARD_WORDS", 64)
    rng = random.Random(5)
    long = [f"l{rng.randrange(200)}" for _ in range(600)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(0, " ".join(long))] + [(k, " ".join(long[(at := rng.randrange(500)) : at + 90]) + f" x{k} {passage} y{k}") for k in range(1, 60)]
    assert run(spark, rows, 13) == brute(rows, 13)


@pytest.mark.parametrize("hot_keys", [20, 20_000])
def test_joins_make_rows_of_shared_keys_only(spark, monkeypatch, hot_keys):
    """Whether keys are broadcast or dealt, no join puts out the rows of keys that one document has alone."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "HOT_KEYS", hot_keys)
    passage = " ".join(f"p{i}" for i in range(40))
    pairs = [" ".join(f"q{k}x{i}" for i in range(30)) for k in range(40)]
    rows = [(k, " ".join(f"a{k}x{i}" for i in range(100)) + f" {pairs[k % 40]} b{k} {passage} c{k}") for k in range(80)]
    spans = spark.createDataFrame(rows, "doc long, text string").select("doc", F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("start"), F.col("text").cast("binary").alias("text"))
    done = S._round(spans, 13, False)
    assert "LeftAnti" not in done._jdf.queryExecution().optimizedPlan().toString()
    keys = [r.key for r in S._sketches(spans, 13, False).collect()]
    often = sorted({k for k in keys if keys.count(k) > 40})
    left = [r.key for r in S._sketches(spans, 13, False, spark.sparkContext.broadcast(S.np.array(often, S.np.int64))).collect()]
    assert often and sorted(left) == sorted(k for k in keys if k not in often)
    assert run(spark, rows, 13) == brute(rows, 13)


def test_names_and_keys(spark):
    rows = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8)], "doc_id long, text string, __spans int, __doc int")
    got = sorted(map(tuple, S.remove_repeats(rows, 3).collect()))
    assert got == [(1, "a b c d", 5, 6), (2, "", 7, 8)]
    with pytest.raises(TypeError):
        S.remove_repeats(rows.selectExpr("string(doc_id) doc_id", "text"))
