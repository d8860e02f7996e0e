"""Near-duplicates by weighted Jaccard: BagMinHash signatures of word shingles, bands, and exact checks of multiset overlap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import chunks, cut, drop_cut, freeing, meet, mix, run_hashes, small, text_buffers, whole_key, word_hashes, word_spans

SHINGLE = 5
SIMILAR = 0.8
#: Pairs with one text that meet it in one task.
FAN = 256
#: Bands and components of each. A pair at the threshold shares no band with probability (1 - 0.8**ROWS)**BANDS = 0.0002, one at 0.85 with 2e-6.
BANDS, ROWS = 28, 6
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of the bags of shingles of texts at offsets, and each text's number of words.

    A text of fewer than k words has one shingle, all of it; one without words has none.
    """
    starts, ends, at = word_spans(data, offsets)
    words, size = word_hashes(data, starts, ends), np.diff(at)
    count = np.maximum(size - k + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + at[:-1][owner]
    hashes = run_hashes(words, k)[first] if len(first) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((size > 0) & (size < k)).tolist():
        short = run_hashes(words[at[i] : at[i + 1]], int(size[i])) ^ np.uint64(size[i])
        owner, hashes = np.r_[owner, i], np.r_[hashes, short]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]) if len(owner) else np.zeros(0, np.int64)
    return owner[new], hashes[new], np.diff(np.r_[new, len(owner)]), size


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int, components: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures (texts by components) of bags: the share of equal components estimates weighted Jaccard without bias.

    The weights of an element are cut into the levels [0, 1], [1, 2], [2, 4], [4, 8] and so on. Each level has a
    Poisson process over time, with a rate of its width in each component, from the element's hash and the level
    alone; a point lies at a whole weight within its level, and counts if the element's weight in the bag is more
    than that. A component's value is the time of its first point. Processes go on, a few points at a time, until
    they are past the latest value of their text. Texts without elements keep infinite values.
    """
    h = np.full(texts * components, np.inf)
    level = np.zeros(len(owner), np.int64)
    parts = []
    base, width, live = 0, 1, np.arange(len(owner))
    while len(live):
        parts.append((live, np.full(len(live), width), np.minimum(counts[live] - base, width), level[live] + len(parts)))
        base, width = base + width, max(1, base + width)
        live = live[counts[live] > base]
    which, wide, limit, number = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    doc, seed = owner[which], mix(hashes[which] + mix((number + 1).astype(np.uint64) * _GOLD))
    t, j, block = np.zeros(len(doc)), 0, 2
    latest = np.full(texts, np.inf)
    while len(doc):
        r = mix(seed[:, None] + (np.arange(j + 1, j + block + 1, dtype=np.uint64) * _GOLD)[None, :])
        waits = -np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32) / wide[:, None]
        times = t[:, None] + np.cumsum(waits, axis=1)
        slot = (mix(r) % np.uint64(components)).astype(np.int64) + (doc * components)[:, None]
        counted = times < latest[doc][:, None]
        partly = np.flatnonzero(limit < wide)
        if len(partly):
            place = mix(r[partly] + _GOLD) % wide[partly].astype(np.uint64)[:, None]
            counted[partly] &= place < limit[partly].astype(np.uint64)[:, None]
        np.minimum.at(h, slot[counted], times[counted])
        latest = h.reshape(texts, components).max(1)
        t = times[:, -1]
        on = t < latest[doc]
        doc, seed, wide, limit, t = doc[on], seed[on], wide[on], limit[on], t[on]
        j, block = j + block, min(2 * block if j else block, 64)
    return h.reshape(texts, components)


def bands_of(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = mix(signature.view(np.uint64)).reshape(len(signature), bands, rows)
    key = np.zeros((len(signature), bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)
    for i in range(rows):
        key = mix(key * _GOLD + parts[:, :, i])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _sketch(docs: DataFrame) -> DataFrame:
    """(doc, version, content, bands) of texts with words; content is a digest of the words."""

    @freeing
    def work(batches):
        for batch in batches:
            doc = batch.column("doc")
            data, offsets = text_buffers(batch.column("text"))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                raw = data[part[0] : part[-1]]
                owner, hashes, counts, size = shingles(raw, part - part[0])
                kept = np.flatnonzero(size > 0)
                if not len(kept):
                    continue
                place = np.cumsum(size > 0) - 1
                keys = bands_of(signatures(place[owner], hashes, counts, len(kept)))
                content = [hashlib.blake2b(b" ".join(data[offsets[a + i] : offsets[a + i + 1]].tobytes().split()), digest_size=16).digest() for i in kept.tolist()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                which = pa.array(kept + a)
                yield pa.RecordBatch.from_arrays([doc.take(which), batch.column("version").take(which), pa.array(content, pa.binary()), lists], names=["doc", "version", "content", "bands"])

    return docs.mapInArrow(work, "doc long, version long, content binary, bands array<long>")


def _small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """df, for broadcast if its rows are few enough."""
    return F.broadcast(df) if small(df, bytes_per_row) else df


def _texts_of(ids: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc, text) of the nodes in ids (cut): of each the one version that firsts names, once."""
    wanted = cut(firsts.join(_small(ids, 16), "doc", "left_semi"), "minhash-wanted")
    return docs.join(_small(wanted, 24), ["doc", "version"], "left_semi").select("doc", "text").dropDuplicates(["doc"])


def _similar(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b; cut) whose texts' bags overlap by at least `least`, checked exactly. A node of many pairs has copies of its text, each for FAN of them."""
    texts = cut(_texts_of(cut(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "minhash-ids"), docs, firsts), "minhash-texts")
    fans = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fan")), "minhash-fans")
    dealt = meet(pairs, fans, "a", 40).select("a", "b", F.pmod(F.xxhash64("b"), F.col("fan")).alias("part"))
    spread = texts.join(fans.select(F.col("a").alias("doc"), "fan"), "doc").select(F.col("doc").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("part"), F.col("text").alias("ta"))
    both = dealt.join(spread, ["a", "part"]).join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")

    @freeing
    def work(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            last, bag = None, None
            for i, (a, ta, tb) in enumerate(zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True)):
                if a != last:
                    last, bag = a, _bag(ta.as_buffer())
                ok[i] = similarity(bag, _bag(tb.as_buffer())) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def _bag(raw) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    _, hashes, counts, _ = shingles(data, np.array([0, len(data)]))
    return hashes, counts


#: Nodes outside the largest class, and nodes of a bucket, that one block holds.
FRINGE, BLOCK = 256, 1024


def _across(left: DataFrame, docs: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between classes within buckets: left has (bucket, doc, label, largest).

    Nodes outside the largest class are dealt to blocks of about FRINGE, all nodes to blocks of about BLOCK, and each
    pair of blocks is a group of its own. In a group the first block's bags stand as lists of nodes by shingle, and
    the other's nodes stream by: the shingles of a node add up its overlap with all of them at once. A group gives
    fewer links than it has nodes, as only those are put out that join classes not yet joined in it.
    """
    size = left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count_if(F.col("label") != F.col("largest")) / FRINGE).alias("fringes"))
    rows = meet(left, cut(size, "minhash-sizes"), "bucket", 48)
    dealt = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fringe = rows.filter("label <> largest").select("bucket", dealt("fringes").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"), "doc", "label")
    block = rows.select("bucket", every("fringes").alias("i"), dealt("blocks").alias("j"), F.lit(1).alias("side"), "doc", "label")
    texts = _texts_of(cut(left.select("doc").distinct(), "minhash-ids"), docs, firsts)
    dealt_out = fringe.union(block).join(texts, "doc").select("bucket", "i", "j", "side", "doc", "label", "text")
    dealt_out = dealt_out.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")

    @freeing
    def work(batches):
        here, held, index = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for bucket, i, j, side, doc, label, text in zip(*columns, batch.column("text"), strict=True):
                if (bucket, i, j) != here:
                    here, held, index = (bucket, i, j), [], None
                bag = _instances(text.as_buffer())
                if not side:
                    held.append((doc, label, bag))
                    continue
                if not held:
                    continue
                index = index or _Index(held)
                out += [(min(doc, x), max(doc, x)) for x in index.partners(bag, label, least)]
            if out:
                a, b = zip(*set(out), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt_out.mapInArrow(work, "a long, b long").distinct()


def _instances(raw) -> np.ndarray:
    """A bag as a sorted set: each occurrence of a shingle is an element of its own, so overlaps of bags are those of sets."""
    hashes, counts = _bag(raw)
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.where(number == 0, np.repeat(hashes, counts), mix(np.repeat(hashes, counts) + number.astype(np.uint64) * _GOLD)))


class _Index:
    """Nodes by element of their bags."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]):
        self.docs = np.array([d for d, _, _ in held])
        self.labels = np.array([x for _, x, _ in held])
        self.joined: dict[int, int] = {}  # classes that links found here have made part of another
        self.sizes = np.array([len(b) for _, _, b in held])
        elements, owners = np.concatenate([b for _, _, b in held]), np.repeat(np.arange(len(held)), self.sizes)
        order = np.argsort(elements, kind="stable")
        self.elements, first = np.unique(elements[order], return_index=True)
        self.owners, self.first = owners[order], np.r_[first, len(elements)]

    def partners(self, bag: np.ndarray, label: int, least: float) -> list[int]:
        """One node of each other class that overlaps enough; these classes then are one with the given one, and give no more links here."""
        at = np.minimum(np.searchsorted(self.elements, bag), len(self.elements) - 1)
        at = at[self.elements[at] == bag]
        start, n = self.first[at], self.first[at + 1] - self.first[at]
        places = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
        both = np.bincount(self.owners[places], minlength=len(self.docs))
        while label in self.joined:
            label = self.joined[label]
        hit = np.flatnonzero((both / np.maximum(1, self.sizes + len(bag) - both) >= least) & (self.labels != label))
        classes, one = np.unique(self.labels[hit], return_index=True)
        if len(classes):
            self.joined |= dict.fromkeys(classes.tolist(), label)
            self.labels[np.isin(self.labels, classes)] = label
        return self.docs[hit[one]].tolist()


def components(edges: DataFrame) -> DataFrame:
    """(doc, label): for each node of the edges (a, b) the smallest node that it is connected with.

    Labels spread along edges and are then replaced by their own labels, so that the distance covered doubles.
    """
    both = cut(edges.union(edges.select("b", "a")).distinct(), "components-edges")
    labels = cut(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "components-labels")
    while True:
        spread = meet(both, labels.select(F.col("doc").alias("b"), "label"), "b", 48).groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("near"))
        new = cut(spread.join(_small(labels, 48), "doc").select("doc", F.least("label", "near").alias("label"), F.col("label").alias("old")), "components-near")
        jump = labels.select(F.col("doc").alias("label"), F.col("label").alias("further"))
        new, near = cut(meet(new, jump, "label", 48).select("doc", F.least("label", "further").alias("label"), "old"), "components-labels"), new
        drop_cut(near)
        done = new.filter("label <> old").isEmpty()
        drop_cut(labels)
        labels = new.select("doc", "label")
        labels._cut_path = new._cut_path
        if done:
            drop_cut(both)
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """(key, class_id) for every row: class_id is the smallest key among the texts connected by weighted Jaccard of at least `least`.

    Bags are of five-word shingles. Texts with the same words are one node, named by its smallest key. In each
    bucket of a band all nodes are first compared with the smallest one. In a bucket whose nodes then still lie in
    several classes, the nodes outside its largest class are compared with all of other classes, block by block, and
    one link for each class that a node meets is put out: nodes already connected need no comparison, no pairs are
    written out, and no link between classes is left out that a band shows. Every comparison is exact.

    Null and wordless texts are alone in their class, as are rows with a null key (whose class is null). Repeated
    rows get equal rows. Of different texts with one key, the one with the least hash stands for the key, and all
    its rows get that one's class. Keys are whole numbers; others raise TypeError. An empty table gives an empty
    table, and other columns may have any names. A text of any length is one row, and so has to fit a task.
    """
    given = docs.select(whole_key(docs, key).alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))
    known = given.filter("doc is not null and text is not null").withColumn("version", F.xxhash64("text"))
    base = sketched = cut(_sketch(known), "minhash-bands")
    several = base.groupBy("doc").agg(F.min("version").alias("v"), F.max("version").alias("w")).filter("v < w").select("doc", F.col("v").alias("least"))
    several = cut(several, "minhash-several")
    if not several.isEmpty():
        base = base.join(_small(several, 24), "doc", "left").filter("least is null or version = least").drop("least")
    nodes = cut(base.groupBy("content").agg(F.min("doc").alias("node")), "minhash-contents")
    named = cut(meet(base.select("doc", "version", "content"), nodes, "content", 64).select("doc", "version", "node"), "minhash-nodes")
    firsts = cut(named.filter("doc = node").select("doc", "version").distinct(), "minhash-firsts")
    rows = cut(base.join(_small(firsts, 24), ["doc", "version"], "left_semi").select("doc", F.explode("bands").alias("bucket")).distinct(), "minhash-rows")
    buckets = cut(rows.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.max("doc").alias("other")).filter("pivot < other").select("bucket", "pivot"), "minhash-pivots")
    members = cut(meet(rows, buckets, "bucket", 48), "minhash-buckets")
    pairs = cut(members.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct(), "minhash-pairs")
    links = cut(_similar(pairs, known, firsts, least), "minhash-links")
    first = components(links)
    placed = cut(members.join(_small(first, 48), "doc", "left").select("bucket", "pivot", "doc", F.coalesce("label", "doc").alias("label")), "minhash-placed")
    classes = placed.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
    open_ = cut(classes.filter("classes > 1 and n > 2").select("bucket", F.col("most.label").alias("largest")), "minhash-open")
    left = cut(meet(placed, open_, "bucket", 48).filter("doc <> pivot"), "minhash-left")
    found = cut(_across(left, known, firsts, least), "minhash-across")
    labels = first if found.isEmpty() else components(links.union(found))
    final = named.join(_small(labels, 48).select(F.col("doc").alias("node"), "label"), "node", "left").groupBy("doc").agg(F.min(F.coalesce("label", "node")).alias("label"))
    final = cut(final.filter("label <> doc"), "minhash-classes")
    for x in (sketched, several, nodes, named, firsts, rows, buckets, members, pairs, links, first, placed, open_, left, found, labels):
        drop_cut(x)
    keys = docs.select(whole_key(docs, key).alias("__key"), F.col(f"`{key}`").alias("__given"))
    return keys.join(_small(final, 48).select(F.col("doc").alias("__doc"), "label"), F.col("__key") == F.col("__doc"), "left").select(F.col("__given").alias(key), F.coalesce("label", "__key").alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """docs without the rows whose class has a smaller key; rows with a null key stay."""
    gone = near_duplicates(docs, key, text, least).filter(F.col(key) != F.col("class_id")).select(F.col(key).alias("__gone")).distinct()
    gone = cut(gone, "minhash-gone")
    return docs.join(_small(gone, 48), F.col(f"`{key}`") == F.col("__gone"), "left_anti")
