"""Quality of documents: a text classifier's evidence, combined with posteriors of their host and path by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import BROADCAST_BYTES, chunks, cut, freeing, lower_ascii, text_buffers, word_hashes, word_spans

#: Words are hashed into 2**WORD_BITS features.
WORD_BITS = 16
#: Labelled rows that the classifier is fitted on, at most: those with the smallest hashes of their keys.
SAMPLE_ROWS = 6000
#: Bytes at the beginning of a word that are a feature of their own.
STEM = 6
#: Standard deviations by which a word's share of the target must differ from the mean for the word to count.
TELLING = 5.0
#: Estimates of prior strength (in documents) stay within these bounds.
STRENGTH = (1.0, 1e6)
SALTS = 16


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.int8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 4
    kind[[9, 10, 11, 12, 13, 32]] = 5
    return kind


_KIND = _kinds()
#: Columns of the shape features.
SHAPE = ("upper", "digit", "mark", "long", "short", "repeat", "variety", "marked words", "lines", "size")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in data at offsets: their shape (texts by SHAPE), and (text, word feature) pairs, each once."""
    n = len(offsets) - 1
    starts, ends, words_at = word_spans(data, offsets)
    hashes = word_hashes(lower_ascii(data), starts, ends)
    doc = np.repeat(np.arange(n), np.diff(words_at))
    size, words = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(words_at), 1)
    kind = _KIND[data]
    count = [np.diff(np.concatenate([[0], np.cumsum(kind == k)])[offsets]) for k in (0, 1, 2, 3)]
    length = ends - starts
    per = lambda x: np.bincount(doc, weights=x, minlength=n) / words
    plain = np.where(kind == 0, 32, lower_ascii(data)).astype(np.uint8)  # as features, words have no marks
    first, end, at = word_spans(plain, offsets)
    names, of = word_hashes(plain, first, end), np.repeat(np.arange(n), np.diff(at))
    stems = ~word_hashes(plain, first, np.minimum(end, first + STEM))
    names, of = np.concatenate([names, stems]), np.concatenate([of, of])
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    pair = np.unique((of.astype(np.uint64) << np.uint64(WORD_BITS)) | (names >> np.uint64(64 - WORD_BITS)))
    owner, word = (pair >> np.uint64(WORD_BITS)).astype(np.int64), (pair & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    last = kind[ends - 1] if len(ends) else np.zeros(0, np.int8)
    breaks = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets])
    shape = np.stack([
        count[1] / np.maximum(count[1] + count[2], 1), count[3] / size, count[0] / size, per(length > 14), per(length < 2), per(again),
        np.bincount(owner, minlength=n) / words, per((last == 0) & (length > 3)), breaks / words, np.log1p(np.diff(words_at)) / 10,
    ], axis=1)
    return shape.astype(np.float32), owner, word


@dataclass
class Head:
    """A logistic model: P = sigmoid(bias + shape . dense + sum of the weights of the text's words)."""

    bias: float
    dense: np.ndarray
    words: np.ndarray

    def logit(self, shape, owner, word) -> np.ndarray:
        return self.bias + shape @ self.dense + np.bincount(owner, weights=self.words[word], minlength=len(shape))


def fit(shape: np.ndarray, owner: np.ndarray, word: np.ndarray, target: np.ndarray, steps: int = 300, decay: float = 2e-3) -> Head:
    """Adam on the mean logistic loss with L2; words in fewer than three texts, or whose share of the target is within chance, have no weight. One class only: its share."""
    n, width = shape.shape
    share = (target.sum() + 1) / (n + 2)
    head = Head(float(np.log(share / (1 - share))), np.zeros(width), np.zeros(1 << WORD_BITS))
    if n == 0 or target.min() == target.max():
        return head
    texts, hits = (np.bincount(word, weights=w, minlength=1 << WORD_BITS) for w in (np.ones(len(word)), target[owner]))
    mean = target.mean()
    known = (texts >= 3) & (np.abs(hits - texts * mean) >= TELLING * np.sqrt(np.maximum(texts * mean * (1 - mean), 1e-12)))
    owner, word = owner[known[word]], word[known[word]]
    centre, scale = shape.mean(0), shape.std(0) + 1e-6
    x = (shape - centre) / scale
    size = 1 + width + (1 << WORD_BITS)
    p, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    p[0] = head.bias
    for t in range(1, steps + 1):
        z = p[0] + x @ p[1 : 1 + width] + np.bincount(owner, weights=p[1 + width :][word], minlength=n)
        r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / n
        g = np.concatenate([[r.sum()], x.T @ r, np.bincount(word, weights=r[owner], minlength=1 << WORD_BITS)])
        g[1:] += decay * p[1:] / np.sqrt(n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9) * min(1, 3 * (1 - t / (steps + 1)))
    dense = p[1 : 1 + width] / scale
    return Head(float(p[0] - centre @ dense), dense, p[1 + width :])


def _packed(word: np.ndarray) -> bytes:
    """Feature numbers, each once, as 16-bit integers or as a bit for each feature, after a byte that says which."""
    if 2 * len(word) <= (1 << WORD_BITS) // 8:
        return b"n" + word.astype("<u2").tobytes()
    bits = np.zeros(1 << WORD_BITS, np.uint8)
    bits[word] = 1
    return b"b" + np.packbits(bits).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2", offset=1).astype(np.int64) if raw[:1] == b"n" else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", targets: tuple[str, ...] = ("quality", "toxic"), rows: int = SAMPLE_ROWS) -> list[Head]:
    """One head for each target, fitted on at most `rows` labelled texts. Rows with a null label or key don't count; of several labels or texts of a key the least does.

    A text comes to the driver as its shape and its word features: as their numbers, or as a bit for each feature
    if that is shorter, so under 9 KB a text.
    """
    chosen = labels.filter(" and ".join(f"`{c}` is not null" for c in (key, *targets))).groupBy(F.col(f"`{key}`").alias("key")).agg(F.min(F.struct(*[F.col(f"`{t}`").cast("double").alias(f"t{i}") for i, t in enumerate(targets)])).alias("t")).select("key", "t.*")
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(rows)
    names = [f"t{i}" for i in range(len(targets))]
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), *[F.min(t).alias(t) for t in names]).select("text", *names)

    @freeing
    def work(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                shape, owner, word = features(data[part[0] : part[-1]], part - part[0])
                at = np.searchsorted(owner, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.tobytes() for x in shape], pa.binary()), pa.array([_packed(word[at[i] : at[i + 1]]) for i in range(b - a)], pa.binary()), *[c.slice(a, b - a) for c in batch.columns[1:]],
                ], names=["shape", "words", *names])

    found = given.mapInArrow(work, "shape binary, words binary, " + ", ".join(f"{t} double" for t in names)).collect()  # at most `rows` rows of hashed words
    found.sort(key=lambda r: (r["shape"], r["words"]))
    shape = np.array([np.frombuffer(r["shape"], np.float32) for r in found]).reshape(len(found), len(SHAPE))
    words = [_unpacked(r["words"]) for r in found]
    owner, word = np.repeat(np.arange(len(found)), [len(w) for w in words]), np.concatenate([*words, np.zeros(0, np.int64)])
    return [fit(shape, owner, word, np.array([r[t] for r in found])) for t in names]


def classify(docs: DataFrame, heads: list[Head], names: list[str], text: str = "text", keep: bool = True) -> DataFrame:
    """docs (without its texts unless keep) with a probability in each column of names."""
    model = docs.sparkSession.sparkContext.broadcast(heads)  # about half a megabyte a head
    at = docs.columns.index(text)
    left = [f for f in docs.schema.fields if keep or f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in left] + [f"{c} double" for c in names])

    @freeing
    def work(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            out = [np.zeros(batch.num_rows) for _ in names]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                found = features(data[part[0] : part[-1]], part - part[0])
                for o, head in zip(out, model.value, strict=True):
                    o[a:b] = 1 / (1 + np.exp(-np.clip(head.logit(*found), -50, 50)))
            if not keep:
                batch = batch.remove_column(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(work, schema)


def strength(mean: float, between: float, within: float) -> float:
    """Prior strength by moments: between is the groups' mean squared deviation, of which within is due to chance."""
    spread = max(between - within, 0.0)
    return float(np.clip(mean * (1 - mean) / spread - 1, *STRENGTH)) if spread > 0 else STRENGTH[1]


def site_posteriors(scored: DataFrame, host: str, path: str, evidence: str) -> tuple[DataFrame, float]:
    """Posterior means of hosts and of paths within them, and the global mean.

    Evidence is summed by (host, path) once; everything else works on these sums. Sparse paths shrink towards their
    host and sparse hosts towards the global mean, by strengths that the spread of the groups' means gives.
    """
    paths = cut(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(evidence).alias("s")), "quality-sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = float(s / n) if n else 0.5

    def spread(groups: DataFrame, count: str, total: str, centre) -> float:
        m = F.col(total) / F.col(count)
        r = groups.agg((F.sum(F.col(count) * (m - centre) * (m - centre)) / F.sum(count)).alias("b"), (F.sum(F.lit(mean * (1 - mean))) / F.sum(count)).alias("w")).first()
        return strength(mean, r.b or 0.0, r.w or 0.0)

    top = spread(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + top * mean) / (F.col("hn") + top))
    both = paths.join(hosts.select(F.col("host").alias("h"), "hn", "hs", "host_posterior"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    low = spread(both, "n", "s", F.col("host_posterior"))
    return cut(both.withColumn("top", F.lit(top)).withColumn("low", F.lit(low)), "quality-posteriors"), mean


#: Columns that judge() adds.
VERDICT = ("p_text", "p_toxic", "host_posterior", "path_posterior", "score", "accepted")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", key: str = "doc_id", text: str = "text", accept: float = 0.5, toxic: float = 0.5, columns: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or the columns of it that are given) with p_text, p_toxic, host_posterior, path_posterior, score and accepted.

    Where pages have addresses, host and path are parts of them; here a source is a host and a language a path.
    p_text is the classifier's probability that the text is good. host_posterior is that of the whole host. A
    document's path_posterior leaves out its own evidence, from its path and from the host that its path shrinks to,
    so a document alone on its host has the global mean. score has the odds of p_text times the odds of the path
    posterior over the global odds. A document is accepted if score is at least accept and p_toxic is under toxic. A
    null text counts as empty, a null host or path as one of its own. Equal rows get equal results. Without labels,
    or with labels of one kind, the classifier has their share only. Hosts and paths are joined by broadcast as long
    as their table is small, else salted. Columns of docs that have one of the new names are replaced; others may
    have any names. An empty table gives an empty table.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in VERDICT]
    heads = train(docs, labels, key, text)
    own = [f"c{i}" for i in range(len(columns))]
    texts = own[columns.index(text)] if text in columns else "text"
    given = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(columns, own, strict=True)], F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), *([] if text in columns else [F.col(f"`{text}`").alias("text")]))
    scored = cut(classify(given, heads, ["p_text", "p_toxic"], texts, text in columns), "quality-scored")  # texts are looked at once
    sites, mean = site_posteriors(scored, "host", "path", "p_text")
    size = sites.agg(F.sum(F.coalesce(F.length("host"), F.lit(0)) + F.coalesce(F.length("path"), F.lit(0)) + 96)).first()[0] or 0
    sites = sites.withColumnsRenamed({"host": "site_host", "path": "site_path"})
    same = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    if size <= BROADCAST_BYTES:
        scored = scored.join(F.broadcast(sites), same, "left")
    else:
        scored = scored.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
        sites = sites.withColumn("site_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        scored = scored.join(sites, same & (F.col("salt") == F.col("site_salt")), "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    p = F.col("p_text")
    others = (F.col("hs") - p + F.col("top") * mean) / (F.col("hn") - 1 + F.col("top"))
    scored = scored.withColumn("path_posterior", (F.col("s") - p + F.col("low") * others) / (F.col("n") - 1 + F.col("low")))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-(odds(p) + odds(F.col("path_posterior")) - odds(F.lit(mean))))))
    scored = scored.withColumn("accepted", (F.col("score") >= accept) & (F.col("p_toxic") < toxic))
    return scored.select(*[F.col(o).alias(c) for c, o in zip(columns, own, strict=True)], *VERDICT)
