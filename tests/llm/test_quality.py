import math
import random

import numpy as np
import pyarrow as pa

from leafstack.llm import quality as Q
from leafstack.llm.common import text_buffers


def features(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    return Q.features(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def test_held_out(spark, sf_dir):
    """Accuracy on labelled documents that the heads have not seen."""
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/documents.parquet").join(spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/labels.parquet"), "doc_id").toPandas()
    seen = docs["doc_id"] % 4 != 0
    train, test = docs[seen], docs[~seen]
    heads = [Q.fit(*features(train["text"].tolist()), train[t].to_numpy(float)) for t in ("quality", "toxic")]
    p = [1 / (1 + np.exp(-h.logit(*features(test["text"].tolist())))) for h in heads]
    good = ((test["quality"] == 1) & (test["toxic"] == 0)).to_numpy()
    accepted = (p[0] >= 0.5) & (p[1] < 0.5)
    assert accepted[good].mean() > 0.98 and accepted[~good].mean() < 0.1


def test_features_alone_and_together():
    texts = ["Some text, some TEXT!", "", "x", "  \n", "a" * 5000, "é é é 12"]
    shape, owner, word = features(texts)
    for i, t in enumerate(texts):
        s, _, w = features([t])
        assert np.allclose(s[0], shape[i]) and (word[owner == i] == w).all()


def test_strength():
    assert Q.strength(0.5, 0.25, 0.25) == Q.STRENGTH[1] and Q.strength(0.5, 0.3, 0.0) == Q.STRENGTH[0]
    assert abs(Q.strength(0.5, 0.05, 0.0) - 4) < 1e-9


def table(spark, n=300):
    rng = random.Random(1)
    rows = [(k, "good words in a fine text about things " * 3 if (good := rng.random() < (0.2 if k % 3 == 0 else 0.9)) else "buy$$$ now%%% cheap### PILLS!!! " * 4, f"h{k % 3}", "en", good) for k in range(n)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[4]), 0) for r in rows if r[0] % 2] + [(None, 1, 0), (4, None, 0), (1, int(rows[1][4]), 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_posteriors_by_hand(spark):
    rows, docs, labels = table(spark)
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    p = {k: r.p_text for k, r in got.items()}
    mean = sum(p.values()) / len(p)
    hosts = {h: [p[k] for k, _, s, _, _ in rows if s == h] for h in ("h0", "h1", "h2")}
    n = len(p)
    between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in hosts.values()) / n
    within = len(hosts) * mean * (1 - mean) / n
    top = Q.strength(mean, between, within)
    for k, _, s, _, _ in rows[:20]:
        post = (sum(hosts[s]) + top * mean) / (len(hosts[s]) + top)
        assert abs(got[k].host_posterior - post) < 1e-9
    assert got[3].host_posterior < got[1].host_posterior
    paths = {h: hosts[h] for h in hosts}  # one language, so each host has one path
    spread = sum(len(v) * (sum(v) / len(v) - (sum(v) + top * mean) / (len(v) + top)) ** 2 for v in paths.values()) / n
    low = Q.strength(mean, spread, within)
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for k, _, s, _, _ in rows[:20]:
        others = (sum(hosts[s]) - p[k] + top * mean) / (len(hosts[s]) - 1 + top)
        path = (sum(hosts[s]) - p[k] + low * others) / (len(hosts[s]) - 1 + low)
        assert abs(got[k].path_posterior - path) < 1e-9
        assert abs(got[k].score - 1 / (1 + math.exp(-(odds(p[k]) + odds(path) - odds(mean))))) < 1e-9
    assert all(got[k].accepted == good for k, _, _, _, good in rows)


def test_rows(spark, monkeypatch):
    _, docs, labels = table(spark, 60)
    odd = spark.createDataFrame([(1000, None, None, None), (1001, "", "h0", None), (None, "good words", None, "en"), (1002, "x" * 100000, "new", "en"), (1002, "x" * 100000, "new", "en")], docs.schema)
    both = docs.union(odd).selectExpr("*", "1 as score")
    got = Q.judge(both, labels).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 and r.accepted is not None for r in got)
    a, b = (r for r in got if r.doc_id == 1002)
    assert a.score == b.score
    monkeypatch.setattr(Q, "BROADCAST_BYTES", -1)
    salted = Q.judge(both, labels).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    assert [round(r.score, 9) for r in sorted(salted, key=key)] == [round(r.score, 9) for r in sorted(got, key=key)]
    assert Q.judge(docs.filter("false"), labels).count() == 0
    assert all(r.accepted is not None for r in Q.judge(docs, labels.filter("false")).collect())


def test_sparse_sites_shrink(spark):
    """A document alone on its host has the global mean, and of two on one host each has the other's evidence, shrunk."""
    _, docs, labels = table(spark)
    alone = spark.createDataFrame([(900, "good words in a fine text about things", "one", "en"), (901, "good words in a fine text", "two", "en"), (902, "buy$$$ now%%% PILLS!!!", "two", "en")], docs.schema)
    got = {r.doc_id: r for r in Q.judge(docs.union(alone), labels).collect()}
    mean = sum(r.p_text for r in got.values()) / len(got)
    assert abs(got[900].path_posterior - mean) < 1e-9
    assert got[902].p_text < got[901].path_posterior < mean < got[902].path_posterior < got[901].p_text


def test_features_pack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4000, 4096, 4097, 40000):
        word = np.sort(rng.permutation(1 << Q.WORD_BITS)[:n])
        assert (Q._unpacked(Q._packed(word)) == word).all() and len(Q._packed(word)) < 9000


def test_repeated_keys_and_names(spark):
    """Rows of the fit are one for each key; columns of any name come back as they were."""
    _, docs, labels = table(spark, 60)
    many = docs.union(docs).union(docs).selectExpr("*", "2 as host", "3 as c0", "4 as salt", "5 as n", "6 as s")
    got = Q.judge(many, labels)
    assert got.columns == [*many.columns, *Q.VERDICT] and got.count() == 180
    assert got.filter("host <> 2 or c0 <> 3 or salt <> 4 or n <> 5 or s <> 6").count() == 0
    one = {r.doc_id: r.p_text for r in Q.judge(docs, labels).collect()}
    assert all(abs(one[r.doc_id] - r.p_text) < 1e-12 for r in got.collect())
