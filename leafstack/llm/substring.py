"""Substring dedup: documents stream through suffix automata of reference shards, and what they share with earlier documents goes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import BROADCAST_BYTES, HOT_KEYS, chunks, cut, drop_cut, free, freeing, run_hashes, text_buffers, whole_key, word_hashes, word_spans

#: Words whose hash can be a window's sketch; the sketch is the least hash among those in the window.
GRAM = 4
#: Reference words of a shard, about, and words of one document that go to one shard at most: they bound the automaton that a task holds.
SHARD_WORDS = 150_000
#: Shares of a shard's documents are dealt to tasks of their own beyond this many sketches, or an even share if that is more.
SHARE = 2000


class Automaton:
    """Suffix automaton of several word sequences. A state's first transition stands in lists, any others in a dict."""

    def __init__(self):
        self.link, self.length, self.word, self.to = [-1], [0], [-1], [0]
        self.more: dict[int, dict[int, int]] = {}
        self.ids: dict[bytes, int] = {}

    def add(self, text: bytes) -> None:
        link, length, word, to, more, ids = self.link, self.length, self.word, self.to, self.more, self.ids
        last = 0
        for raw in text.split():
            w = ids.setdefault(raw, len(ids))
            new = to[last] if word[last] == w else more[last].get(w, 0) if last in more else 0
            if new:  # known from an earlier sequence
                last = new if length[new] == length[last] + 1 else self._clone(last, new, w)
                continue
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            word.append(-1)
            to.append(0)
            p = last
            while p >= 0:
                if word[p] < 0:
                    word[p], to[p] = w, new
                elif word[p] == w or (p in more and w in more[p]):
                    break
                else:
                    more.setdefault(p, {})[w] = new
                p = link[p]
            if p >= 0:
                q = to[p] if word[p] == w else more[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = new

    def _clone(self, p: int, q: int, w: int) -> int:
        link, length, word, to, more = self.link, self.length, self.word, self.to, self.more
        c = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        word.append(word[q])
        to.append(to[q])
        if q in more:
            more[c] = dict(more[q])
        link[q] = c
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = c
            elif p in more and more[p].get(w) == q:
                more[p][w] = c
            else:
                break
            p = link[p]
        return c

    def matched(self, words: list[bytes], n: int) -> list[int]:
        """Ends (one after the last word) of the windows of n words that occur in the sequences, by matching statistics."""
        link, length, word, to, more, ids = self.link, self.length, self.word, self.to, self.more, self.ids
        out, at, size = [], 0, 0
        for i, raw in enumerate(words, 1):
            w = ids.get(raw, -1)
            if w < 0:
                at = size = 0
                continue
            while True:
                if word[at] == w:
                    at, size = to[at], size + 1
                    break
                if at in more and (new := more[at].get(w)):
                    at, size = new, size + 1
                    break
                if not at:
                    size = 0
                    break
                at = link[at]
                size = length[at]
            if size >= n:
                out.append(i)
        return out


def _keys(data: np.ndarray, offsets: np.ndarray, n: int, whole: bool):
    """For texts at offsets: word starts and ends, words' places by text, the windows' first words, texts and keys.

    A window's key is a hash of all its words (whole) or its sketch, which equal windows share and near windows mostly do.
    """
    starts, ends, at = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.maximum(np.diff(at) - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + at[:-1][owner]
    if not len(first):
        return starts, ends, at, first, owner, np.zeros(0, np.uint64)
    if whole:
        keys = run_hashes(words, n)
    else:
        keys = run_hashes(words, min(GRAM, n))
        need, have = n - min(GRAM, n) + 1, 1
        while have < need:  # least of each `need` neighbours
            step = min(have, need - have)
            keys = np.minimum(keys[:-step], keys[step:])
            have += step
    return starts, ends, at, first, owner, keys[first]


def _sketches(spans: DataFrame, n: int, whole: bool, without=None) -> DataFrame:
    """(key, doc, block) for the windows of each span; runs of equal keys once. block: which SHARD_WORDS of the document the window begins in.

    without: a broadcast of keys, in order, whose rows are left out.
    """

    @freeing
    def work(batches):
        for batch in batches:
            doc, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "start"))
            data, offsets = text_buffers(batch.column("text"))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                _, _, at, first, owner, keys = _keys(data[part[0] : part[-1]], part - part[0], n, whole)
                if len(keys):
                    new = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]
                    if without is not None and len(known := without.value):
                        long = keys.view(np.int64)
                        new &= known[np.minimum(np.searchsorted(known, long), len(known) - 1)] != long
                    owner = owner[new]
                    block = (start[a:b][owner] + first[new] - at[owner]) // SHARD_WORDS
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(doc[a:b][owner]), pa.array(block.astype(np.int32))], names=["key", "doc", "block"])

    return spans.select("doc", "start", "text").mapInArrow(work, "key long, doc long, block int")


def _round(spans: DataFrame, n: int, whole: bool) -> DataFrame:
    """One pass over spans (doc, version, start, text).

    Keys that occur in several documents name the first of them, and a place in it, as their reference. Windows with
    such keys, of the reference document and of later ones, go to the shard of that place. There the former make an
    automaton, and the latter are streamed through it: they match or don't.
    Returns (doc, version, start, n, text): matched words (text null), or runs of windows that didn't match, as spans.
    """
    spark = spans.sparkSession
    rows = _sketches(spans, n, whole).select("key", "doc")
    shared = rows.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).filter("first < last").select("key", "first", "n")
    shared = cut(shared, "substring-keys")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    refs, uses = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(4 * tasks, refs * (n - GRAM) // SHARD_WORDS + 1)
    share = max(SHARE, uses // (2 * tasks))
    # only a document of so many bytes has windows beyond its first SHARD_WORDS words; a key that is there goes to the first such block
    later = _sketches(spans.filter(F.col("start") + F.octet_length("text") / 2 >= SHARD_WORDS), n, whole).filter("block > 0")
    blocks = cut(later.groupBy("key", F.col("doc").alias("first")).agg(F.min("block").alias("block")), "substring-blocks")
    placed = shared.withColumn("block", F.lit(0)) if blocks.isEmpty() else shared.join(blocks, ["key", "first"], "left").withColumn("block", F.coalesce("block", F.lit(0)))
    placed = placed.select("key", "first", "n", F.pmod(F.xxhash64("first", "block"), F.lit(shards)).alias("shard"))
    full = placed.groupBy("shard").agg(F.sum("n").alias("n")).filter(F.col("n") > share).collect()  # at most uses / share of them
    salts = spark.sparkContext.broadcast({r.shard: -(-r.n // share) for r in full})
    # keys of many rows, fewer than HOT_KEYS, meet them by broadcast; all other rows are dealt by key
    most = uses // HOT_KEYS
    hot = F.broadcast(placed.filter(F.col("n") > most).select("key", "first", "shard"))
    often = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in shared.filter(F.col("n") > most).select("key").collect()], np.int64)))
    cold = _sketches(spans, n, whole, often).select("key", "doc").join(placed.filter(F.col("n") <= most).select("key", "first", "shard"), "key")
    met = rows.join(hot, "key").unionByName(cold)
    code = F.col("shard") * 2 + (F.col("first") != F.col("doc")).cast("int")
    hits = met.groupBy("doc").agg(F.collect_set(F.struct("key", code.alias("code"))).alias("hits"))  # of one document
    hits = hits.select("doc", F.transform("hits", lambda x: x.key).alias("keys"), F.transform("hits", lambda x: x.code).alias("codes"))

    @freeing
    def route(batches):
        for batch in batches:
            out: list[tuple] = []
            size = 0
            data, offsets = text_buffers(batch.column("text"))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version", "start")]
            keys_of, codes_of = batch.column("keys"), batch.column("codes")
            for r in range(batch.num_rows):
                doc, version, start = (int(c[r]) for c in columns)
                raw = data[offsets[r] : offsets[r + 1]]
                starts, ends, _, first, _, keys = _keys(raw, np.array([0, len(raw)]), n, whole)
                if not len(first):
                    continue
                known, codes = keys_of[r].values.to_numpy(zero_copy_only=False).view(np.uint64), codes_of[r].values.to_numpy(zero_copy_only=False)
                order = np.argsort(known)
                known, codes = known[order], codes[order]
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                code = np.where(known[at] == keys, codes[at], -1)
                edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if (c := int(code[a])) < 0:
                        continue
                    shard, text = c >> 1, raw[starts[first[a]] : ends[first[b - 1] + n - 1]].tobytes()
                    spread = salts.value.get(shard, 1)
                    for salt in (doc % spread,) if c & 1 else range(spread):
                        out.append((shard, salt, c & 1, doc, version, start + int(first[a]), text))
                        size += len(text)
                if size > 8 << 20:
                    yield _batch(out, ROUTED)
                    out, size = [], 0
            if out:
                yield _batch(out, ROUTED)

    routed = spans.join(hits, "doc").mapInArrow(route, "shard long, salt long, later int, doc long, version long, start long, text binary")
    routed = routed.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "later")

    @freeing
    def stream(batches):
        here, automaton = None, None
        for batch in batches:
            out: list[tuple] = []
            for shard, salt, later, doc, version, start, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (shard, salt) != here:
                    here, automaton = (shard, salt), Automaton()
                if not later:
                    automaton.add(text)
                    continue
                words = text.split()
                found = np.zeros(len(words) - n + 1, bool)
                found[np.array(automaton.matched(words, n), np.int64) - n] = True
                edge = np.flatnonzero(np.r_[True, found[1:] != found[:-1], True])
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    out.append((doc, version, start + a, b - a + n - 1, None if found[a] else b" ".join(words[a : b + n - 1])))
            if out:
                yield _batch(out, STREAMED)

    return routed.mapInArrow(stream, "doc long, version long, start long, n long, text binary")


ROUTED = (("shard", pa.int64()), ("salt", pa.int64()), ("later", pa.int32()), ("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("text", pa.binary()))
STREAMED = (("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("text", pa.binary()))


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])


def repeated_spans(docs: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, spans): for each text the word ranges (start, n) covered by windows that also occur in a document with a smaller key."""
    spans = docs.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(whole_key(docs, key).alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.lit(0).cast("long").alias("start"), F.col(f"`{text}`").cast("binary").alias("text"))
    first = cut(_round(spans, n, False), "substring-first")
    # a window that isn't in its sketch's first document may be in another earlier one: those windows go by themselves
    second = cut(_round(first.filter("text is not null").select("doc", "version", "start", "text"), n, True), "substring-second")
    found = first.filter("text is null").unionByName(second.filter("text is null"))
    out = cut(found.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "substring-spans")
    for x in (first, second):
        drop_cut(x)
    return out


def remove_repeats(docs: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs without the words covered by a window of n words that also occurs in a document with a smaller key.

    Words are runs of characters other than ASCII white space, compared as they are; windows are judged on the
    input. outputs: text (kept words, joined by one blank where any went, else as it was; replaces the column),
    n_words, n_removed, kept_sha256 (of the kept words joined by one blank) and spans (ranges of removed words).
    A null text stays null and has no words. A row with a null key keeps all and is no one's reference; rows with
    one key aren't each other's. Ties can't occur otherwise. Keys are whole numbers; others raise TypeError. Columns
    of docs named like an output are replaced, others may have any names. An empty table gives an empty table. Of a
    long document each SHARD_WORDS words are a reference of their own; a text is one row, and so has to fit a task.
    """
    spans_, doc_, version_ = (free(docs, x) for x in ("__spans", "__doc", "__version"))
    spans = repeated_spans(docs, n, key, text).select(F.col("doc").alias(doc_), F.col("version").alias(version_), F.col("spans").alias(spans_))
    size = spans.agg(F.sum(F.size(spans_) * 16 + 32)).first()[0] or 0
    same = (whole_key(docs, key) == F.col(doc_)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(version_))
    joined = docs.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, same, "left").drop(doc_, version_)
    names = [c for c in docs.columns if c not in outputs or c == text]
    kinds = {"n_words": ("bigint", pa.int64()), "n_removed": ("bigint", pa.int64()), "kept_sha256": ("string", pa.string()), "spans": ("array<struct<start:bigint,n:bigint>>", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))}
    more = [c for c in outputs if c != text]
    kept = [c for c in names if c != text or text in outputs]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + [f"{c} {kinds[c][0]}" for c in more])

    @freeing
    def work(batches):
        for batch in batches:
            made: dict[str, list] = {c: [] for c in outputs}
            for given, found in zip(batch.column(text), batch.column(spans_), strict=True):
                given, found = given.as_py(), sorted((s["start"], s["n"]) for s in found.as_py() or ())
                words = (given or "").encode().split()
                ranges: list[list[int]] = []
                for a, size in found:
                    if ranges and a <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], a + size)
                    else:
                        ranges.append([a, a + size])
                left = words
                if ranges:
                    left, last = [], 0
                    for a, b in ranges:
                        left += words[last:a]
                        last = b
                    left += words[last:]
                joined = b" ".join(left)
                for c in outputs:
                    made[c].append(
                        (joined.decode() if ranges else given) if c == text else len(words) if c == "n_words" else len(words) - len(left) if c == "n_removed" else hashlib.sha256(joined).hexdigest() if c == "kept_sha256" else [{"start": a, "n": b - a} for a, b in ranges]
                    )
            columns = [pa.array(made[c], pa.string()) if c == text else batch.column(c) for c in kept] + [pa.array(made[c], kinds[c][1]) for c in more]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *more])

    return joined.select(*[F.col(f"`{c}`") for c in names], spans_).mapInArrow(work, schema)
