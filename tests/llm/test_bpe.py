import hashlib
import random

import numpy as np
import pytest

from leafstack.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    import json

    from tokenizers import Tokenizer

    return bpe.Codec(json.load(open(PATH, encoding="utf-8"))), Tokenizer.from_file(PATH)


def test_same_as_library(both):
    codec, library = both
    rng = random.Random(1)
    pool = [chr(c) for c in range(0x600)] + list("ΣςİßﬁÅ\x1c\x1f\x85\xa0​　﻿中文한😀") * 9 + ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "don't", " ", "\n"] * 30
    texts = ["", " ", "a" * 3000 + "zq" * 500, "<|endoftext|>"] + ["".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(1500)]
    for text, raw in zip(texts, codec.encode_all(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and len(raw) == 4 * len(ids)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("around", ["{0}", "{0}{0}", "a{0}a", "1{0}1", "a\u0301{0}\u0323\u0301z"])
def test_every_character(both, around):
    """All code points: alone, doubled, between letters and digits, and beside combining marks."""
    codec, library = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 100_000):
        texts = [around.format(chr(c)) for c in points[at : at + 100_000]]
        wanted = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [t for t, x, y in zip(texts, codec.encode_all(texts), wanted, strict=True) if x != y] == []


def test_small_memory(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    for text in ("one two three four five", "six one seven two", "five"):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, sf_dir, both):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (2, None, "x"), (3, "", None), (None, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df, PATH, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == 5
    hello = next(r for r in got if r.doc_id == 1)
    assert hello.ids == both[1].encode("Hello world", add_special_tokens=False).ids and hello.decoded == both[1].decode(hello.ids, skip_special_tokens=False)
    empty = next(r for r in got if r.doc_id == 2)
    assert (empty.ids, empty.decoded, empty.n_tokens, empty.ids_sha256) == ([], "", 0, hashlib.sha256(b"").hexdigest())
    assert bpe.encode_documents(df.filter("false"), PATH).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in docs.join(bpe.encode_documents(docs, PATH, outputs=("ids_sha256", "decoded_sha256")), "doc_id").collect():
        ids = both[1].encode(r.text, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows_in_parts(spark, both, monkeypatch):
    """A batch's rows are encoded a part at a time, which changes nothing."""
    monkeypatch.setattr(bpe, "ROWS", 7)
    rows = [(k, None if k % 10 == 3 else f"Text {k} of many " * (k % 5)) for k in range(60)]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, outputs=("ids", "n_tokens")).collect()
    assert [(r.doc_id, r.ids, r.n_tokens) for r in sorted(got)] == [(k, ids := both[1].encode(t or "", add_special_tokens=False).ids, len(ids)) for k, t in rows]


def test_memory_of_a_task():
    """Many different words: what a task holds beside the vocabulary stays small."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(2)
    rows = [" ".join(f"{rng.randrange(1 << 28):07x}" for _ in range(400)) for _ in range(900)]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[:0])], ["text"]), pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])]
    spec = SimpleNamespace(value=open(PATH, encoding="utf-8").read())
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in bpe.encode_batches(batches, spec, 0, ("n_tokens",))) == 900
        assert tracemalloc.get_traced_memory()[1] < 70e6
    finally:
        tracemalloc.stop()


def test_memory_is_given_back(monkeypatch):
    """A worker that stays for later tasks doesn't keep what its allocators hold: also when its task ends early."""
    from leafstack.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    run = common.freeing(lambda batches: (2 * b for b in batches))
    assert list(run(iter([1, 2]))) == [2, 4] and calls == [1]
    begun = run(iter([1, 2]))
    assert next(begun) == 2 and calls == [1]
    begun.close()
    assert calls == [1, 1]
    monkeypatch.undo()
    common.give_back()
