"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import chunks, freeing

#: Words whose ids are kept; when there are more, the memory starts anew.
CACHE_WORDS = 150_000
#: Characters of text that are encoded together, and rows whose results are put out together: they bound what a task holds beside its batch.
STEP, ROWS = 250_000, 1000
#: Words of more bytes are merged by a heap.
LONG_WORD = 128
NO_RANK = 1 << 60
#: str.split() takes these for white space, the normaliser doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space in Unicode's sense, which the normaliser makes one blank.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Letters and numbers that the regex module knows from newer versions of Unicode than the tokenizers library does.
NEWER = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7cf\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1"
    "\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6"
    "\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2"
    "\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff"
    "\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff"
    "\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)

#: Combining marks that Python composes and reorders and the library, whose tables for this are older, leaves where they are.
UNMOVED = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e"
    "\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97"
    "\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
#: First and last capital letter, and how far on the small ones are, of those that the library knows and Python doesn't.
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
SMALL = {c: c + on for first, last, on in NEWER_CAPITALS for c in range(first, last + 1)}
_UNMOVED = re.compile(f"([{UNMOVED}])")
_CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")


def normalised(text: str) -> str:
    """NFC as the library has it."""
    if not _UNMOVED.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join([unicodedata.normalize("NFC", part) for part in _UNMOVED.split(text)])


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


class Codec:
    """encode() and decode() of a word-ended BPE vocabulary (tokenizers' JSON), by rank arrays.

    A word is an array of parts beside an array of the ranks of neighbouring parts. The lowest rank is looked for,
    the boundary inside that pair is deleted, and the ranks at either side are looked up again, until no pair has a
    rank. Words of one length stand in one matrix, so that each of these steps is done for all of them at once.
    Symbols that the vocabulary lacks give no id.
    """

    def __init__(self, spec: dict):
        import regex

        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab, letters = dict(model["vocab"]), byte_letters()
        merges = [m if not isinstance(m, str) else m.split(" ") for m in model["merges"]]
        pairs = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in reversed([*enumerate(merges)])}
        self.pairs = np.array([*sorted(pairs), 1 << 62], np.int64)
        self.pair_ranks = np.array([*(pairs[k] for k in sorted(pairs)), NO_RANK], np.int64)
        self.rank, self.made = pairs.get, np.array([vocab[a + b] for a, b in merges], np.int64)
        self.first, self.last = (np.array([vocab.get(x + end, -1) for x in letters], np.int64) for end in ("", suffix))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        odd, self.ascii = NEWER, re.compile(split.replace("\\s", "\\t-\\r ").replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9"))
        split = split.replace("[^\\s\\p{L}\\p{N}]", f"[[^{WHITE}\\p{{L}}\\p{{N}}]||[{odd}]]").replace("[\\p{L}]", f"[\\p{{L}}--[{odd}]]")
        self.pattern = regex.compile(split.replace("[\\p{N}]", f"[\\p{{N}}--[{odd}]]"), regex.VERSION1)
        self.white = regex.compile(f"[{WHITE}]+")
        marks = sorted(self.special, key=len, reverse=True)
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NO_RANK)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes."""
        return self.merge_raw([w.encode() for w in words])

    def merge_raw(self, raw: list[bytes]) -> list[bytes]:
        """Ids of each word, given in UTF-8, as bytes."""
        out: list[bytes] = [b""] * len(raw)
        by_length: dict[int, list[int]] = {}
        for k, r in enumerate(raw):
            by_length.setdefault(len(r), []).append(k)
        for length, rows in by_length.items():
            if length > LONG_WORD:
                for k in rows:
                    out[k] = np.array(self._merge_long([*self.first[[*raw[k]][:-1]].tolist(), int(self.last[raw[k][-1]])]), "<u4").tobytes()
            elif length:
                for at in range(0, len(rows), 20_000):
                    self._merge_matrix(raw, rows[at : at + 20_000], length, out)
        return out

    def _merge_matrix(self, raw: list[bytes], rows: list[int], length: int, out: list[bytes]) -> None:
        symbols = np.frombuffer(b"".join([raw[k] for k in rows]), np.uint8).reshape(len(rows), length)
        parts = self.first[symbols]
        parts[:, -1] = self.last[symbols[:, -1]]
        which, at = np.array(rows), self.ranks(parts[:, :-1], parts[:, 1:])
        while True:
            n, width = at.shape
            line = np.arange(n)
            i = at.argmin(1) if width else np.zeros(n, np.int64)
            low = at[line, i] if width else np.full(n, NO_RANK)
            if (done := low == NO_RANK).any():
                ended = parts[done]
                if ended.min() < 0:  # symbols outside the vocabulary
                    for k, ids in zip(which[done].tolist(), ended, strict=True):
                        out[k] = ids[ids >= 0].astype("<u4").tobytes()
                else:
                    flat, size = ended.astype("<u4").tobytes(), 4 * ended.shape[1]
                    for j, k in enumerate(which[done].tolist()):
                        out[k] = flat[j * size : j * size + size]
                parts, at, which, i, low = parts[~done], at[~done], which[~done], i[~done], low[~done]
                line = np.arange(len(which))
            if not len(which):
                return
            kept = np.arange(width) + (np.arange(width) > i[:, None])  # all parts but the second of the pair
            parts[line, i] = self.made[low]
            parts = parts[line[:, None], kept]
            kept = np.arange(width - 1) + (np.arange(width - 1) >= i[:, None])
            at = at[line[:, None], kept]
            right = np.flatnonzero(i < width - 1)
            at[right, i[right]] = self.ranks(parts[right, i[right]], parts[right, i[right] + 1])
            left = np.flatnonzero(i > 0)
            at[left, i[left] - 1] = self.ranks(parts[left, i[left] - 1], parts[left, i[left]])

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for long words, with the ranks in a heap: time grows as n log n."""
        import heapq

        n, rank, made = len(parts), self.rank, self.made
        after, before, live = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or rank(parts[i] << 32 | parts[j], NO_RANK) != r:
                continue  # a part of the pair has been merged since
            parts[i], live[j], after[i] = made[r], False, after[j]
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    before[after[k]] = k
                    if (new := rank(parts[k] << 32 | parts[after[k]], NO_RANK)) != NO_RANK:
                        heapq.heappush(heap, (new, k))
        return [p for p, on in zip(parts, live, strict=True) if on and p >= 0]

    def _learn(self, missing: list[str]) -> None:
        """Put the ids of these blank-free strings into known."""
        words: dict[str, None] = {}
        split = {}
        for chunk in missing:
            found = [chunk] if chunk.isalpha() else (self.ascii if chunk.isascii() else self.pattern).findall(chunk)
            split[chunk] = found
            words.update(dict.fromkeys(found))
        ids = dict(zip(words, self.merge_all([*words]), strict=True))
        self.known |= {chunk: ids[found[0]] if len(found) == 1 else b"".join([ids[w] for w in found]) for chunk, found in split.items()}

    def _split(self, text: str) -> list[str]:
        """Blank-free strings of a text without special tokens, normalised."""
        if not text.isascii():
            text = normalised(text)
            if _CAPITAL.search(text):
                text = text.translate(SMALL)
        parts = self.white.split(text) if SEPARATORS.search(text) else text.split()
        return "\n".join(parts).replace("Σ", "σ").lower().split("\n") if parts else parts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        pieces = [[t] if self.cutter is None or "<|" not in t else self.cutter.split(t) for t in texts]
        chunks = [[self.special[p] if p in self.special else self._split(p) for p in ps] for ps in pieces]
        missing = set().union(*[c for cs in chunks for c in cs if isinstance(c, list)]).difference(self.known)
        self._learn([*missing])
        get = self.known.__getitem__
        return [b"".join([struct.pack("<I", c) if isinstance(c, int) else b"".join(map(get, c)) for c in cs]) for cs in chunks]

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a blank: the vocabulary names no decoder. Special tokens stay, unknown ids go."""
        return " ".join([t for i in ids if (t := self.tokens.get(i)) is not None])


def encode_batches(batches: Iterable[pa.RecordBatch], spec, kept: int, outputs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """For each batch of columns to keep and then a text, those columns and outputs. spec: its value is the vocabulary's JSON."""
    types = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    codec = None
    for batch in batches:
        codec = codec or Codec(json.loads(spec.value))
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            made: dict[str, list] = {c: [] for c in outputs}
            texts = [x or "" for x in part.column(kept).to_pylist()]
            ends = np.cumsum([0, *map(len, texts)])
            for first, end in chunks(ends, STEP):
                for raw in codec.encode_all(texts[first:end]):
                    ids = np.frombuffer(raw, "<u4")
                    if "decoded" in made or "decoded_sha256" in made:
                        decoded = codec.decode(ids.tolist())
                    for c in outputs:
                        made[c].append(ids.astype(np.int32) if c == "ids" else decoded if c == "decoded" else len(ids) if c == "n_tokens" else hashlib.sha256(raw if c == "ids_sha256" else decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*part.columns[:kept], *[pa.array(made[c], types[c]) for c in outputs]], names=[*part.schema.names[:kept], *outputs])
        batch = part = texts = made = None  # before the next batch is read


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode and decode whole texts.

    Returns the columns in keep and then, as asked for in outputs: ids array<int>, decoded string, n_tokens long,
    ids_sha256 and decoded_sha256 string (digests of the ids as little-endian unsigned 32-bit integers and of the
    decoded text in UTF-8). A null text counts as empty: no ids, an empty decoded text. Other columns of docs may
    have any names. Equal rows give equal rows; an empty table gives an empty table. vocabulary is the path of a
    tokenizers JSON file on the driver; the executors get it by broadcast (a file of fixed size, under 4 MB).
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + [f"{c} {kinds[c]}" for c in outputs])

    @freeing
    def work(batches):
        return encode_batches(batches, spec, len(keep), outputs)

    return given.mapInArrow(work, schema)
