"""Scores of texts by a unigram base and by a causal self-attention model over subword ids, trained in numpy."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.llm.bpe import LONG_WORD, Codec, byte_letters
from leafstack.llm.common import chunks, cut, drop_cut, lower_ascii, text_buffers, word_hashes, word_spans

#: Pieces that the model knows, as inputs: 0 is the end (and what stands before a text), then the commonest pieces, then kinds of the others.
KNOWN, KINDS = 2048, 32
#: Classes that the model predicts: the end, the commonest pieces, and the kinds of the others. A piece given its class follows corpus counts.
CLASSES = 64
#: Inputs of a window, and the targets at its end that it scores: windows overlap by their difference.
WINDOW, STRIDE = 24, 16
WIDTH = 16
#: Windows that are worked on at once: their arrays stay in the cache.
BATCH = 96
#: Every window of the training texts trains the model, in one of so many steps: one pass.
STEPS, RATE = 32, 0.05
#: Commonest words whose counts every task holds (16 bytes each); other words meet their counts by a join.
HOT_WORDS = 200_000
#: Upper bits of a word's hash by which its place among the common ones is looked up.
FIRST_BITS = 18
#: Text bytes that are cut into pieces at once, and sequences bytes that one task trains on, about.
PIECE_BYTES, TASK_BYTES = 1 << 20, 4 << 20


def in_training(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def _parts(batch, column: str, limit: int | None = None):
    """Of chunks of the batch's texts: first and end row, lower-cased bytes, words' starts and ends, where texts' words begin, words' hashes."""
    data, offsets = text_buffers(batch.column(column))
    for a, b in chunks(offsets, limit) if limit else chunks(offsets):
        part = offsets[a : b + 1]
        low = lower_ascii(data[part[0] : part[-1]])
        starts, ends, at = word_spans(low, part - part[0])
        yield a, b, low, starts, ends, at, word_hashes(low, starts, ends)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word is in the column text; words are 64-bit hashes."""

    def work(batches):
        for batch in batches:
            found = []
            for *_, hashes in _parts(batch, "text"):
                found.append(np.unique(hashes, return_counts=True))
            if found:
                word, n = (np.concatenate(x) for x in zip(*found, strict=True))
                word, back = np.unique(word, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(back, weights=n, minlength=len(word)).astype(np.int64))], names=["word", "n"])

    return texts.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame) -> DataFrame:
    """(word, n) of the words above a count, chosen by a histogram so that they are at most HOT_WORDS.

    No task hands on more than its own share of them, however many tasks there are.
    """
    bins = counts.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()  # some thousand rows at most
    least, taken = None, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        taken += r.words
        if taken > HOT_WORDS:
            break
        least = r.n
    return counts.filter(F.col("n") >= least if least is not None else F.lit(False)).select("word", "n")


def _find(table: np.ndarray, keys: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Places of keys in a sorted table, or -1. first: what _firsts() gives for the table, which makes it quicker."""
    if not len(table):
        return np.full(len(keys), -1)
    if first is None:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    else:
        at, last = first[keys >> np.uint64(64 - FIRST_BITS)], len(table) - 1
        rest = np.flatnonzero((table[at] < keys) & (at < last))
        while len(rest):
            at[rest] += 1
            rest = rest[(table[at[rest]] < keys[rest]) & (at[rest] < last)]
    return np.where(table[at] == keys, at, -1)


def _firsts(table: np.ndarray) -> np.ndarray | None:
    """Where in a sorted table of hashes those with each value of their FIRST_BITS upper bits begin; None if many have the same."""
    bounds = np.searchsorted(table, np.arange(1 << FIRST_BITS, dtype=np.uint64) << np.uint64(64 - FIRST_BITS))
    if not len(table) or np.diff(bounds, append=len(table)).max() > 32:
        return None
    return np.minimum(bounds, len(table) - 1)


# --- pieces ----------------------------------------------------------------------------------------------------------


@dataclass
class Hot:
    """The commonest words: sorted hashes, log10(count + 1) of each, and the pieces of those that this task has met."""

    words: np.ndarray
    logs: np.ndarray


class Merges:
    """The merges of a codec for many words at once, which stand one after another in one array. The ids are those of merge_raw().

    Ranks of pairs are in a table by hash, with linear probing; an entry is the pair (16 bits for each part) and its rank (24 bits).
    """

    NONE, FREE, FACTOR = 1 << 30, -1 << 60, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codec: Codec):
        self.codec, pairs = codec, codec.pairs[:-1]
        bits = max(8, int(len(pairs) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, self.FREE, np.int64)
        keys = pairs >> 32 << 16 | pairs & 0xFFFF
        entries, slots = keys << 24 | codec.pair_ranks[:-1], self._slots(keys)
        while len(entries):
            self.table[slots] = np.where(free := self.table[slots] == self.FREE, entries, self.table[slots])
            left = ~free | (self.table[slots] != entries)  # of several that want one slot, one has it
            entries, slots = entries[left], slots[left] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.FACTOR >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 16 | right
        slots = self._slots(keys)
        found = self.table[slots]
        own = found >> 24
        out = np.where(own == keys, found & 0xFFFFFF, self.NONE)
        rest = np.flatnonzero((own != keys) & (found != self.FREE))
        slots = slots[rest]
        while len(rest):
            slots = slots + 1 & self.mask
            found = self.table[slots]
            hit = found >> 24 == keys[rest]
            out[rest[hit]] = found[hit] & 0xFFFFFF
            on = ~hit & (found != self.FREE)
            rest, slots = rest[on], slots[on]
        return out

    def __call__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the words (none is empty) that start and end there, one after another, and how many each word has."""
        length = ends - starts
        size, done = np.zeros(len(length), np.int32), []  # done: words, and their pieces one after another
        for k in np.flatnonzero(length > LONG_WORD).tolist():
            ids = np.frombuffer(self.codec.merge_raw([low[starts[k] : ends[k]].tobytes()])[0], "<u4")
            size[k] = len(ids)
            done.append((np.array([k]), ids.astype(np.uint16)))
        which = np.flatnonzero(length <= LONG_WORD)
        n = length[which]
        end = np.cumsum(n)
        symbols = low[np.repeat(starts[which] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        parts = self.codec.first[symbols]
        parts[end - 1] = self.codec.last[symbols[end - 1]]
        at = np.append(self.ranks(parts[:-1], parts[1:]), self.NONE) if len(parts) else np.zeros(0, np.int64)
        at[end - 1] = self.NONE
        while len(which):
            first = end - n
            lowest = np.minimum.reduceat(at, first)
            if not (live := lowest != self.NONE).all():
                inside, ended = np.repeat(live, n), which[~live]
                ids, owner = parts[~inside], np.repeat(np.arange(len(ended)), n[~live])
                size[ended] = np.bincount(owner[ids >= 0], minlength=len(ended))  # symbols outside the vocabulary give no piece
                done.append((ended, ids[ids >= 0].astype(np.uint16)))
                which, n, lowest, parts, at = which[live], n[live], lowest[live], parts[inside], at[inside]
                if not len(which):
                    break
                end = np.cumsum(n)
                first = end - n
            place = np.flatnonzero(at == np.repeat(lowest, n))
            place = place[np.searchsorted(place, first)]  # each word's first pair of its lowest rank
            parts[place] = self.codec.made[lowest]
            kept = np.ones(len(parts), bool)
            kept[place + 1] = False
            parts, at = parts[kept], at[kept]
            gone = np.arange(len(which))
            place, first = place - gone, first - gone
            n = n - 1
            end = end - gone - 1
            at[place] = self.NONE
            right, left = place[place + 1 < end], place[place > first]
            at[right] = self.ranks(parts[right], parts[right + 1])
            at[left - 1] = self.ranks(parts[left - 1], parts[left])
        out, before = np.zeros(int(size.sum()), np.uint16), np.cumsum(size) - size
        for words, ids in done:
            n = size[words]
            out[np.repeat(before[words] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, size


@dataclass
class Pieces:
    """Cuts words into pieces of a public vocabulary. Pieces of common words are remembered; others are cut once in each chunk."""

    codec: Codec
    hot: Hot
    flat: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, np.uint16))
    used: int = 0

    def __post_init__(self):
        self.merges, self.firsts = Merges(self.codec), _firsts(self.hot.words)
        self.first, self.size = np.full(len(self.hot.words), -1, np.int32), np.zeros(len(self.hot.words), np.int32)

    def _put(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of these words now are in flat, and how many."""
        made, size = self.merges(low, starts, ends)
        total = len(made)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.uint16)])
        self.flat[self.used : self.used + total] = made
        first = self.used + np.cumsum(size) - size
        self.used += total
        return first.astype(np.int32), size

    def cut(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' pieces, one after another, and how many each word has; at: places of words among the hot ones."""
        common = np.flatnonzero(at >= 0)
        fresh = common[self.first[at[common]] < 0]
        if len(fresh):
            new, where = np.unique(at[fresh], return_index=True)
            where = fresh[where]
            self.first[new], self.size[new] = self._put(low, starts[where], ends[where])
        first, size = (self.first[at], self.size[at]) if len(self.first) else np.zeros((2, len(at)), np.int32)
        kept, rare = self.used, np.flatnonzero(at < 0)
        if len(rare):
            _, where, back = np.unique(hashes[rare], return_index=True, return_inverse=True)
            put = self._put(low, starts[rare[where]], ends[rare[where]])
            first[rare], size[rare] = put[0][back], put[1][back]
        ends = np.cumsum(size, dtype=np.int64)
        out = self.flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        self.used = kept  # rare words are forgotten
        return out, size


@dataclass
class Numbering:
    """Of each piece: its number as an input, its class, and log10 of its share of its class."""

    inputs: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    share: np.ndarray  # of each class


def kinds(tokens: dict[int, str], size: int, suffix: str) -> np.ndarray:
    """A kind below KINDS for each piece: its first byte's class, and whether it ends a word."""
    letters = {x: b for b, x in enumerate(byte_letters())}
    out = np.zeros(size, np.int64)
    for i, t in tokens.items():
        b = letters.get(t[:1], 0)
        group = (b | 32) - 97 if 97 <= (b | 32) <= 122 else 26 if 48 <= b <= 57 else 27 if b < 128 else 28
        out[i] = group % (KINDS // 2) * 2 + (bool(suffix) and t.endswith(suffix))
    return out


def number(counts: np.ndarray, kind: np.ndarray, end: int) -> Numbering:
    """Number pieces by their counts in the training texts; end is the piece that ends a text."""
    size, most = len(counts), counts.copy()
    most[end] = counts.max(initial=0) + 1
    order = np.lexsort((np.arange(size), -most))
    inputs, classes = KNOWN - KINDS + kind, CLASSES - KINDS + kind
    inputs[order[: KNOWN - KINDS]] = np.arange(min(size, KNOWN - KINDS))
    classes[order[: CLASSES - KINDS]] = np.arange(min(size, CLASSES - KINDS))
    total, each = np.bincount(classes, weights=counts, minlength=CLASSES), np.bincount(classes, minlength=CLASSES)
    within = np.log10(counts + 1.0) - np.log10(np.maximum(total + each, 1))[classes]
    return Numbering(inputs.astype(np.int16), classes.astype(np.int16), within, (total + 1) / (total.sum() + CLASSES))


# --- the model -------------------------------------------------------------------------------------------------------

SHAPES = {"e": (KNOWN, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "u": (CLASSES, WIDTH), "b": (CLASSES,), "r": (WINDOW,)}
#: How far before its query each key of a window stands; negative ones are in its future.
DISTANCE = (WINDOW - STRIDE + np.arange(STRIDE))[:, None] - np.arange(WINDOW)[None, :]
_FAR, _SEEN = np.maximum(DISTANCE, 0).ravel(), DISTANCE.ravel() >= 0
SCALE = np.float32(1 / np.sqrt(WIDTH))
#: Logits are at most MOST, and sums of their exps at least LEAST, so that none overflows or divides by 0.
MOST, LEAST = np.float32(60), np.float32(1e-30)


def start(share: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before training: without context, classes have their shares."""
    rng = np.random.default_rng(0)
    out = {k: rng.normal(0, 0.3, s) for k, s in SHAPES.items()}
    out["u"], out["r"], out["b"] = np.zeros(SHAPES["u"]), np.zeros(WINDOW), np.log(share)
    return out


def tables(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters, and queries, keys and values of each input: inputs are few, so they are worked out once."""
    out = p | {"eq": p["e"] @ p["q"] * SCALE, "ek": p["e"] @ p["k"], "ev": p["e"] @ p["v"]}
    out["ones"] = np.ones(CLASSES)
    out["kv"] = np.concatenate([p["k"].T, p["v"].T])
    out["mask"] = np.where(DISTANCE >= 0, p["r"][np.maximum(DISTANCE, 0)], -1e9)
    out = {k: v.astype(np.float32) for k, v in out.items()}
    # whether no score and no logit can be more than MOST
    size = {k: float(np.linalg.norm(out[k], axis=1).max()) for k in ("e", "eq", "ek", "ev", "u")}
    out["near"] = size["eq"] * size["ek"] + float(out["r"].max()) < MOST
    out["low"] = (size["e"] + size["ev"]) * size["u"] + float(out["b"].max()) < MOST
    return out


def windows_of(n: np.ndarray, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows by WINDOW), targets (windows by STRIDE, -1 past the end of a text), and each window's text.

    n: targets of each text; inputs and targets: those of all texts one after another. A target's input is what
    stands before it; 0 stands before each text.
    """
    per = -(-n // STRIDE)
    text = np.repeat(np.arange(len(n)), per)
    base = (np.cumsum(per) - per) * STRIDE
    place = np.arange(len(targets)) + np.repeat(base - (np.cumsum(n) - n), n)
    want = np.full(len(text) * STRIDE, -1, np.int16)
    want[place] = targets
    own = np.zeros(len(text) * STRIDE + 1, np.int16)
    own[place + 1] = inputs
    own = own[:-1]
    own[base[n > 0]] = 0
    own = own.reshape(-1, STRIDE)
    x = np.zeros((len(text), WINDOW), np.int16)
    x[:, WINDOW - STRIDE :] = own
    later = np.flatnonzero(text[1:] == text[:-1]) + 1
    x[later, : WINDOW - STRIDE] = own[later - 1, 2 * STRIDE - WINDOW :]
    return x, want.reshape(-1, STRIDE), text


def across(x: np.ndarray) -> np.ndarray:
    """Each window's matrix lying across, laid out anew: products with it are far quicker than with a turned view."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def forward(t: dict[str, np.ndarray], x: np.ndarray):
    """exp of each class's logit for each target, the logits' own and total, and what is needed to go back. Logits over MOST count as that."""
    xq = x[:, WINDOW - STRIDE :]
    k, v, q = t["ek"].take(x, 0), t["ev"].take(x, 0), t["eq"].take(xq, 0)
    s = q @ across(k)
    s += t["mask"]
    a = np.exp(s if t["near"] else np.minimum(s, MOST, out=s), out=s)
    a *= (1 / ((a.reshape(-1, WINDOW) @ t["ones"][:WINDOW]) + LEAST)).reshape(*a.shape[:2], 1)
    h = a @ v
    h += t["e"].take(xq, 0)
    z = h.reshape(-1, WIDTH) @ np.ascontiguousarray(t["u"].T)
    z += t["b"]
    return (z if t["low"] else np.minimum(z, MOST, out=z)), (xq, k, v, q, a, h)


def log_probabilities(t: dict[str, np.ndarray], x: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log10 of each target's probability, 0 for those past the end."""
    z, _ = forward(t, x.astype(np.intp))
    y = targets.ravel()
    own = z[np.arange(len(y)), np.maximum(y, 0)]
    out = (own - np.log(np.exp(z, out=z) @ t["ones"] + LEAST)) * np.float32(1 / np.log(10))
    return np.where(y < 0, 0, out).reshape(targets.shape)


def nothing() -> dict[str, np.ndarray]:
    """Sums of gradients to begin with; that of the inputs lies across."""
    return {k: np.zeros(shape[::-1] if k == "e" else shape) for k, shape in SHAPES.items()}


def gradient(t: dict[str, np.ndarray], x: np.ndarray, targets: np.ndarray, total: dict[str, np.ndarray]) -> int:
    """Add the gradients of the loss (in natural logarithms) with respect to the parameters to total; the number of targets.

    Windows are worked on BATCH at once; the gradients of their inputs are summed by input for all of them together.
    """
    x = x.astype(np.intp)
    of_inputs = np.empty((WIDTH, x.size))
    for at in range(0, len(x), BATCH):
        part = x[at : at + BATCH]
        of_inputs[:, at * WINDOW : at * WINDOW + part.size] = _back(t, part, targets[at : at + BATCH], total).T
    for place, weights in zip(total["e"], of_inputs, strict=True):
        place += np.bincount(x.ravel(), weights=weights, minlength=KNOWN)
    return int(np.count_nonzero(targets >= 0))


def _back(t: dict[str, np.ndarray], x: np.ndarray, targets: np.ndarray, total: dict[str, np.ndarray]) -> np.ndarray:
    """Add the gradients of all parameters but the inputs' to total; those with respect to each place's input."""
    z, (xq, k, v, q, a, h) = forward(t, x)
    y = targets.ravel()
    live, line = y >= 0, np.arange(len(y))
    p = np.exp(z, out=z)
    own = (p @ t["ones"]) + LEAST
    p[line, np.maximum(y, 0)] -= own  # what follows is weighted, so that p needn't be divided by its sums
    weight = (live / own).astype(p.dtype)[:, None]
    flat = h.reshape(-1, WIDTH) * weight
    dh = ((p @ t["u"]) * weight).reshape(h.shape)
    da = dh @ across(v)
    da -= np.einsum("ijk,ijk->ij", a, da)[:, :, None]
    da *= a
    dkv = np.empty((*x.shape, 2 * WIDTH), p.dtype)
    np.matmul(da.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])  # q holds SCALE, as this has to
    np.matmul(a.transpose(0, 2, 1), dh, out=dkv[:, :, WIDTH:])
    dkv = dkv.reshape(-1, 2 * WIDTH)
    dq = (da @ k).reshape(-1, WIDTH) * SCALE
    dx = (dkv @ t["kv"]).reshape(*x.shape, WIDTH)
    dx[:, WINDOW - STRIDE :] += dh + (dq @ np.ascontiguousarray(t["q"].T)).reshape(dh.shape)
    e, eq = t["e"].take(x, 0).reshape(-1, WIDTH), t["e"].take(xq, 0).reshape(-1, WIDTH)
    total["q"] += eq.T @ dq
    dkv = e.T @ dkv
    total["k"] += dkv[:, :WIDTH]
    total["v"] += dkv[:, WIDTH:]
    total["u"] += (flat.T @ p).T
    total["b"] += weight[:, 0] @ p
    total["r"] += np.bincount(_FAR, weights=da.sum(0).ravel() * _SEEN, minlength=WINDOW)
    return dx.reshape(-1, WIDTH)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], steps: int):
        self.p, self.steps, self.t = p, steps, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = RATE * min(1.0, self.t / 3) * (1 - (self.t - 1) / (self.steps + 1))
        for k, x in self.p.items():
            self.m[k] = 0.85 * self.m[k] + 0.15 * g[k]
            self.v[k] = 0.97 * self.v[k] + 0.03 * g[k] ** 2
            x -= rate * (self.m[k] / (1 - 0.85**self.t)) / (np.sqrt(self.v[k] / (1 - 0.97**self.t)) + 1e-8)


def _windows(batch, numbering: Numbering):
    """Of some rows at a time: first and end row, windows as windows_of() gives them, and all pieces with how many each row has."""
    sizes = batch.column("pieces").cast(pa.binary()).to_pylist()
    n = np.array([len(x) // 2 for x in sizes], np.int64)
    for a, b in chunks(np.r_[0, np.cumsum(n)], 100_000):
        pieces = np.frombuffer(b"".join(sizes[a:b]), "<u2")
        yield a, b, windows_of(n[a:b], numbering.inputs[pieces], numbering.classes[pieces]), pieces, n[a:b]


def train(sequences: DataFrame, numbering: Numbering, attention: bool = True) -> dict[str, np.ndarray]:
    """Train on sequences (step, pieces), one step for each step from 0.

    The gradient of a step is summed over the tasks that hold its windows; only the sum of it (some tens of
    thousands of numbers) comes to the driver. Without attention the values stay 0, for comparison.
    """
    spark = sequences.sparkSession
    p = start(numbering.share)
    if not attention:
        p["v"][:] = 0
    adam = Adam(p, STEPS)
    sizes = {k: int(np.prod(s)) for k, s in SHAPES.items()}
    for s in range(STEPS):
        now = spark.sparkContext.broadcast((tables(p), numbering))

        def work(batches, now=now):
            t, numbering = now.value
            g, seen = nothing(), 0
            for batch in batches:
                for _, _, (x, targets, _), _, _ in _windows(batch, numbering):
                    for at in range(0, len(x), 8 * BATCH):
                        seen += gradient(t, x[at : at + 8 * BATCH], targets[at : at + 8 * BATCH], g)
            if seen:
                total = np.concatenate([*((x.T if k == "e" else x).ravel() for k, x in g.items()), [seen]])
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "value"])

        summed = sequences.filter(F.col("step") == s).select("pieces").mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        now.destroy()
        if not len(summed):
            continue
        total = np.zeros(sum(sizes.values()) + 1)
        total[summed["at"].to_numpy()] = summed["value"].to_numpy()
        g, at = {}, 0
        for k, size in sizes.items():
            g[k] = total[at : at + size].reshape(SHAPES[k]) / total[-1]
            at += size
        if not attention:
            g["v"][:] = 0
        adam.step(g)
    return p


def attend(t: dict[str, np.ndarray], numbering: Numbering, batch) -> np.ndarray:
    """log10 of the probability of each row's text by the model: of each piece's class given the pieces before it, and of the piece given its class."""
    out = np.zeros(batch.num_rows)
    for a, b, (x, targets, text), pieces, n in _windows(batch, numbering):
        found = np.empty(len(x))
        for at in range(0, len(x), BATCH):
            found[at : at + BATCH] = log_probabilities(t, x[at : at + BATCH], targets[at : at + BATCH]).sum(1, dtype=np.float64)
        out[a:b] = np.bincount(text, weights=found, minlength=b - a) + np.bincount(np.repeat(np.arange(b - a), n), weights=numbering.within[pieces], minlength=b - a)
    return out


def sequences_of(given: DataFrame, hot: Hot, spec: str, end: int) -> DataFrame:
    """(key, held_out, step, n_tokens, known, logs, rare, times, pieces) of rows (key, held_out, step, text).

    known, logs: the common words' number and sum of log10(count + 1); rare, times: the other words and how often
    each is there; pieces: those of all words and the end, as unsigned 16-bit integers.
    """
    both = given.sparkSession.sparkContext.broadcast((spec, hot))

    def work(batches):
        cutter = None
        for batch in batches:
            cutter = cutter or Pieces(Codec(json.loads(both.value[0])), both.value[1])
            for a, b, low, starts, ends, at, hashes in _parts(batch, "text", PIECE_BYTES):
                n, place = np.diff(at), _find(cutter.hot.words, hashes, cutter.firsts)
                doc, seen = np.repeat(np.arange(b - a), n), place >= 0
                logs = np.bincount(doc, weights=np.where(seen, cutter.hot.logs[place] if len(cutter.hot.logs) else 0, 0), minlength=b - a)
                flat, size = cutter.cut(low, starts, ends, hashes, place)
                each = np.bincount(doc, weights=size, minlength=b - a).astype(np.int64)
                flat = np.insert(flat, np.cumsum(each), end).astype("<u2")
                offsets = np.r_[0, np.cumsum(each + 1)] * 2
                rare, owner = hashes[~seen], doc[~seen]
                order = np.lexsort((rare, owner))
                rare, owner = rare[order], owner[order]
                new = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])]) if len(rare) else np.zeros(0, np.int64)
                lists = pa.array(np.searchsorted(owner[new], np.arange(b - a + 1)), pa.int32())
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(a, b - a) for c in ("key", "held_out", "step")], pa.array(n + 1), pa.array(np.bincount(doc, weights=seen, minlength=b - a).astype(np.int64)), pa.array(logs),
                    pa.ListArray.from_arrays(lists, pa.array(rare[new].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(np.diff(np.r_[new, len(rare)]))), blob,
                ], names=["key", "held_out", "step", "n_tokens", "known", "logs", "rare", "times", "pieces"])

    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(work, f"key {kind}, held_out boolean, step int, n_tokens long, known long, logs double, rare array<long>, times array<long>, pieces binary")


def piece_counts(sequences: DataFrame, size: int) -> np.ndarray:
    """How often each piece of the vocabulary is in the sequences."""

    def work(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("pieces"):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=size)[:size] if len(x.as_buffer()) > 4 * size else 0
            few = [x.as_buffer() for x in batch.column("pieces") if len(x.as_buffer()) <= 4 * size]
            for at in range(0, len(few), 200):
                total += np.bincount(np.frombuffer(b"".join(few[at : at + 200]), "<u2"), minlength=size)[:size]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

    out = np.zeros(size, np.int64)
    found = sequences.select("pieces").mapInArrow(work, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row for each piece of the vocabulary
    out[found["piece"].to_numpy()] = found["n"].to_numpy()
    return out


def score_texts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", training: Column | None = None) -> DataFrame:
    """For every row: key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are words (A-Z lower-cased) and one end. base_score sums log10((c + 1) / (N + V + 1)). For score, words
    are cut into pieces of a public BPE vocabulary (vocabulary: its tokenizers JSON file on the driver), each word's
    pieces covering it whole. score is the model's log10 probability of all the text's pieces and its end: of each
    piece's class given the pieces before it, by masked attention over overlapping windows that score each piece
    once, and of the piece given its class, by (c + 1) / (its class's pieces in texts and vocabulary). A token's
    score is the sum of its pieces'. Counts cover all training texts, and every window of every training text trains
    the model, in one pass.

    A null text counts as empty: one token, the end. A null key counts as an empty one. Equal rows get equal rows;
    an empty table gives an empty table; without training texts all counts are 0. Other columns may have any names.
    """
    spark = docs.sparkSession
    spec = open(vocabulary, encoding="utf-8").read()
    codec = Codec(json.loads(spec))
    suffix, size, end = json.loads(spec)["model"].get("end_of_word_suffix") or "", max(codec.tokens) + 1, max(codec.tokens)
    if size > 1 << 16:
        raise ValueError("the vocabulary has more than 65,536 pieces")
    held = ~(in_training(F.col(f"`{key}`")) if training is None else training)
    given = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("name"), held.alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    step = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("name", "text"), F.lit(STEPS)).cast("int"))
    given = given.select("key", "held_out", step.alias("step"), "text")
    learn = given.filter("not held_out")
    counts = cut(word_counts(learn), "lm-counts")
    texts = learn.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, types = words + texts, distinct + (texts > 0)
    common = commonest(counts).toPandas()
    code, often = common["word"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)
    order = np.argsort(code)
    found = sequences_of(given, Hot(code[order], np.log10(often[order] + 1.0)), spec, end).withColumn("row", F.monotonically_increasing_id())
    rows = cut(found, "lm-sequences")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rest = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    numbering = number(piece_counts(rows.filter("not held_out"), size), kinds(codec.tokens, size, suffix), end)
    weight = rows.filter("not held_out").agg(F.coalesce(F.sum(F.octet_length("pieces")), F.lit(0))).first()[0]
    parts = max(4, int(weight // (STEPS * TASK_BYTES)) + 1)
    dealt = rows.filter("not held_out").select("step", "pieces", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"))
    dealt = cut(dealt.repartition(STEPS * parts, "step", "part").sortWithinPartitions("step"), "lm-steps", by=("step",))
    model = train(dealt, numbering)
    drop_cut(dealt)
    ready = spark.sparkContext.broadcast((tables(model), numbering))

    def score(batches):
        t, numbering = ready.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(attend(t, numbering, batch))], names=[*batch.schema.names[:-1], "score"])

    kind = given.schema["key"].dataType.simpleString()
    scored = rows.select("row", "key", "held_out", "n_tokens", "known", "logs", "pieces").mapInArrow(score, f"row long, key {kind}, held_out boolean, n_tokens long, known long, logs double, score double").join(rest, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + float(np.log10(texts + 1))
    return scored.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(texts > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"), "score",
    )
