"""Quirks, edge cases and models of functions and operators."""

import bz2
import gzip
import io
import random
import tarfile
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from leafstack import registry
from leafstack.functions import bytes as B
from leafstack.functions import codes as C
from leafstack.functions import numbers as N
from leafstack.functions import text as T
from leafstack.operators import dispatch as D
from leafstack.operators import entries as E
from leafstack.operators import ordering as O
from leafstack.operators import trees as R
from leafstack.sources import archives as A
from leafstack.sources import pages as P


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_natural_order(spark):
    names = ["a10", "a2", "A1", "b", "a-1", "a02", "a"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = [r.name for r in O.ranked(df.withColumn("g", F.lit(1)), O.sort_columns(None, "name", "i"), ["g"]).orderBy("rank").collect()]
    assert got == ["a", "a-1", "A1", "a02", "a2", "a10", "b"]


@pytest.mark.parametrize(("query", "text", "wanted"), [("7", "x007y", True), ("7", "-7", True), ("-7", "-7", False), ("7", "7a8", True), ("8", "7a8", True), ("78", "7a8", False), ("", "x", True), ("AB  7", "cab 7", True), ("ab 7", "cab 77", False), ("2147483647", "2147483647", True), ("é", "CAFÉ", True)])
def test_search(spark, query, text, wanted):
    assert column(spark, [text], "string", lambda c: T.matches(c, query)) == [wanted]


def test_glob(spark):
    f = lambda p, **k: column(spark, ["a/b.txt", "A/B.TXT", "a.b", "x\ny", "a*b"], "string", lambda c: T.glob(c, p, **k))
    assert f("a*t") == [True, True, False, False, False]
    assert f("a*t", ignore_case=False) == [True, False, False, False, False]
    assert f("a?b") == [False, False, True, False, True]
    assert f("a\\*b") == [False, False, False, False, True]
    assert f("x*y") == [False, False, False, True, False]
    assert f("[!a]*") == [False, False, False, True, False]


def canonical(path):
    out = []
    for p in (x for x in path.split("/") if x and x != "."):
        if p == ".." and out and out[-1] != "..":
            out.pop()
        else:
            out.append(p)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), max_size=7).map("/".join), min_size=1, max_size=30))
def test_canonical(spark, paths):
    assert column(spark, paths, "string", T.canonical) == [canonical(p) for p in paths]


def test_paths(spark):
    assert column(spark, ["a/./b/../c", "../x", "/", "", "/a"], "string", T.sanitized) == ["a/c", "__Parent__/x", ".", ".", "a"]
    assert column(spark, ["a/./b/../c", "a/../c"], "string", lambda c: T.canonical(c, compat=True)) == [["a", ".", "b", "..", "c"], ["c"]]
    assert column(spark, ["a/b/c", "a/bc", "a"], "string", lambda c: T.has_prefix(c, F.lit("a/b"))) == [True, False, False]
    assert column(spark, ["a/b/c", "a/bc", "a"], "string", lambda c: T.has_prefix(c, F.lit("a/b"), compat=True)) == [True, True, False]
    assert column(spark, ["x.tar.gz", "x.PART12.rar", "x.zip", "x", ".hid", "a.b.c"], "string", T.archive_stem) == ["x", "x", "x", "x", ".hid", "a.b"]
    assert column(spark, ["a<b>c</b>d", "a", "<b>x"], "string", lambda c: T.between(c, "<b>", "</b>")) == ["c", None, "x"]


def test_sizes(spark):
    assert column(spark, [0, 999, 1000, 1234, 12345, 123456, 1500000, 2 * 10**13], "bigint", N.bytes_human) == ["0 B", "999 B", "1 KB", "1.23 KB", "12.3 KB", "123 KB", "1.5 MB", "20 TB"]
    assert column(spark, [999, 1234, 5 * 10**12], "bigint", N.bytes_short) == ["999 B", "1.23 KB", "5000 GB"]
    assert column(spark, [1234567], "bigint", N.bytes_long) == ["1.23 MB (1,234,567 bytes)"]
    df = spark.createDataFrame([(100, 50), (0, 5), (None, 5), (100, 250)], "s bigint, p bigint")
    assert [r[0] for r in df.select(N.compression_text(F.col("s"), F.col("p"))).collect()] == [" 50.0%", " -----", " -----", " -150%"]
    assert column(spark, [0o755], "int", N.posix_text) == ["rwxr-xr-x (755)"]
    assert column(spark, [None, 5, 4], "bigint", lambda c: F.when(c.isNull(), "n").otherwise("y")) == ["n", "y", "y"]


def test_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "g string, size bigint")
    assert {r.g: (r.x, r.y) for r in df.groupBy("g").agg(E.total().alias("x"), E.total(known_only=True).alias("y")).collect()} == {"a": (-1, 1), "b": (5, 5)}
    assert df.filter("false").agg(E.total().alias("x")).first().x == 0


def test_runs(spark):
    things = ["x", "x", "y", None, None, "y", "x"]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(things)], "g string, i int, t string")
    got = [(r.first_index, r.next_index, r.is_solid) for r in E.solid_runs(df, ["g"], "i", "t").orderBy("i").collect()]
    assert got == [(0, 1, False), (0, None, True), (2, None, False), (3, 4, False), (3, None, True), (5, None, False), (6, None, False)]


def merged(rows):
    """Step by step: only the latest entry of a name can be completed."""
    latest, out = {}, []
    for i, (name, resource) in enumerate(rows):
        e = latest.get(name)
        if e is None or e[1 + resource] is not None:
            e = [name, None, None]
            latest[name] = e
            out.append(e)
        e[1 + resource] = i
        if e[1] is not None and e[2] is not None:
            pass
    return sorted(tuple(-1 if x is None else x for x in e) for e in out)


@pytest.mark.parametrize("pattern", ["DR", "RD", "DDR", "DRR", "DRD", "random"])
def test_forks(spark, pattern):
    rng = random.Random(5)
    rows = [("n", c == "R") for c in pattern] if pattern != "random" else [(rng.choice("abcdef"), rng.random() < 0.5) for _ in range(400)]
    df = spark.createDataFrame([("g", i, n, r) for i, (n, r) in enumerate(rows)], "g string, i int, n string, r boolean")
    got = E.merge_forks(df, ["g"], "i", "n", "r").collect()
    assert sorted((x.n, -1 if x.data_index is None else x.data_index, -1 if x.resource_index is None else x.resource_index) for x in got) == merged(rows)


def test_count_quirk(spark):
    paths = ["r/f1/i1", "r/f2/i2"]
    nodes = R.path_tree(spark.createDataFrame([("t", p) for p in paths], "t string, p string").withColumn("viewable", F.lit(True)), "t", "p", ["viewable"])
    exact = {r.node: r.over for r in R.counts_over(nodes, 1).collect()}
    quirk = {r.node: r.over for r in R.counts_over(nodes, 1, compat=True).collect()}
    assert exact["r"] and not quirk["r"]


def test_dispatch(spark):
    df = spark.createDataFrame([(1, "zip", "image/png", None), (2, None, None, None), (3, "JPG", None, "504b0304"), (4, None, None, "377ac2bc"), (5, "pdf", None, "25504446")], "i int, ext string, mime string, fourcc string")
    got = {r.i: (r.adapter, r.candidates) for r in D.resolve(df, "i", {k: F.col(k) for k in ("ext", "mime", "fourcc")}).collect()}
    assert got == {1: ("image", "image,archive,resource"), 2: ("resource", "resource"), 3: ("archive", "archive,image,resource"), 4: ("resource", "resource"), 5: ("pdf", "pdf,resource")}


def test_refs():
    page = '<link rel="alternate nofollow" type="text/html" href="/l"><link rel="alternatex" type="text/html" href="/no"><a href="/a#x">A <b>b</b><img src="/in.png"></a><a href="/a#y">again</a><a href="#z">none</a><a href="mailto:x">m</a><img src="/i.png" alt="pic"><img src="/i.png"><a href="/l">l</a>'
    assert P.page_refs(page, "http://h/d/") == [("link", 0, "http://h/l", ""), ("anchor", 0, "http://h/a", "A b"), ("anchor", 1, "http://h/l", "l"), ("image", 0, "http://h/i.png", "pic")]


def test_anchors_of_any_markup(spark):
    page = "<!-- <a href='/no'> --><A HREF=/up>u</A><a\nhref='one.html#f'>1</a><a class=x href=../two>2</a><a href=\"//other/x\">o</a><a href='#f'>f</a><a href=one.html>again</a><a href='mailto:x'>m</a><a href='//[bad'>b</a><area href='/map'>"
    df = spark.createDataFrame([(1, "http://h/d/e", page), (2, "http://h/d/e", "<base href='http://b/c/'><a href=x>x</a>"), (3, None, None)], "page_id long, url string, html string")
    got = [tuple(r) for r in P.anchors(df, "page_id", "url", "html").orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, "http://h/up"), (1, 1, "http://h/d/one.html"), (1, 2, "http://h/two"), (1, 3, "http://other/x"), (1, 8, "http://h/map"), (2, 0, "http://b/c/x")]


def test_feeds(spark):
    media = 'xmlns:media="http://search.yahoo.com/mrss/"'
    item = '<item><title>t</title><media:content url="u"/></item>'
    feeds = [f"<rss {media}><channel>{item}{item}</channel></rss>", f"<rss {media}></rss>", f"<rss {media}><channel>{item}</channel><channel>{item}</channel></rss>", f"<rss><channel>{item}</channel></rss>", f"<feed {media}><channel>{item}</channel></feed>", None, "<rss"]
    df = spark.createDataFrame(list(enumerate(feeds)), "i int, x string")
    assert sorted((r.i, r.pos, r.title, r.url) for r in P.feed_items(df, "i", "x").collect()) == [(0, 0, "t", "u"), (0, 1, "t", "u")]


def packed_zip(name="a.txt", body=b"hello"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, body)
    return out.getvalue()


def test_archives():
    good = packed_zip()
    assert [(r[1], r[2], r[11], r[12]) for r in A.list_archive(good, "x.zip")] == [("a.txt", 5, zlib.crc32(b"hello"), "ok")]
    assert A.list_archive(good.replace(b"hello", b"hellx"), "x.zip")[0][12] == "wrong_checksum"
    assert A.list_archive(b"nothing", "x") == [] and A.list_archive(good[:20], "x") == []
    assert [r[1] for r in A.list_archive(packed_zip("in.zip", good), "y.zip")] == ["a.txt"]
    assert A.list_archive(bz2.compress(b"abc"), "b.bz2")[0][12] == "ok"
    broken = bytearray(gzip.compress(b"abc"))
    broken[-8] ^= 1
    assert A.list_archive(bytes(broken), "b.gz")[0][12] == "wrong_checksum"
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "target"
        t.addfile(link)
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
    assert [(r[1], r[5], r[6], r[7], r[12]) for r in A.list_archive(tar.getvalue(), "t.tgz")] == [("l", False, True, "target", "not_tested"), ("d/", True, False, None, "not_tested")]


def test_read_folder(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.zip").write_bytes(packed_zip())
    (tmp_path / ".hidden").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in A.read_listing(spark, str(tmp_path)).collect()] == ["a.zip"]
    assert [(r.path, r.verdict) for r in A.read_archives(spark, str(tmp_path), "*.zip").collect()] == [("a.txt", "ok")]


def test_archives_are_packed_and_read_a_few_at_a_time(spark, monkeypatch):
    """What the two steps of archive_entries hold besides a batch doesn't grow with the batch."""
    import tracemalloc

    import pyarrow as pa

    from leafstack.plans import readers

    steps = []

    class Frame:
        schema = PT.StructType([PT.StructField("missing", PT.BooleanType())])

        def select(self, *_):
            return self

        filter = select

        def mapInArrow(self, work, _):  # noqa: N802
            steps.append(work)
            return self

        def mapInPandas(self, work, _):  # noqa: N802
            steps.append(lambda batches: (pa.RecordBatch.from_pandas(x) for x in work(b.to_pandas() for b in batches)))
            return self

    def peak(work, batch, take):
        tracemalloc.start()
        try:
            for out in work(iter([batch])):
                take(out)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    monkeypatch.setattr(readers, "table", lambda *_: Frame())
    registry.queries()["archive_entries"](None, "")
    rng = random.Random(5)
    ids = [i for i in range(1500) if i % 5 < 3]
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([rng.randbytes(15_000).hex() for _ in ids], pa.string())})
    packed, entries = [], []
    assert peak(steps[0], docs, packed.append) < 6 << 20
    assert sum(b.nbytes for b in packed) > 15 << 20
    files = pa.Table.from_batches(packed).rename_columns(["name", "content", "missing"][: packed[0].num_columns]).combine_chunks().to_batches()
    assert len(files) == 1
    assert peak(steps[1], files[0], entries.append) < 6 << 20
    rows = pa.Table.from_batches(entries).to_pylist()
    assert [(r["path"], r["size"], r["verdict"]) for r in rows] == [(f"d{i}.txt", None if i % 5 == 2 and i % 11 == 7 else 30_000, "no_checksum" if i % 5 == 1 else "wrong_checksum" if i % 5 == 2 and i % 11 == 7 else "ok") for i in ids]


def test_archives_of_odd_texts(spark, tmp_path):
    """Missing, empty and other texts in every kind of archive: as the SQL has it."""
    import duckdb

    spark.createDataFrame([(i, (None, "", "é" * i, "x")[i // 5 % 4]) for i in range(80)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["archive_entries"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(registry.oracles()["archive_entries"])
    assert got.columns == [d[0] for d in wanted.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def test_charsets():
    assert B.detect(b"\xef\xbb\xbf") == (None, 0.0) or B.detect(b"\xef\xbb\xbf")[0] != "UTF-16LE"
    assert B.detect(b"\xef\xbb\xbfx") == ("UTF-8", 1.0)
    assert B.detect(b"\xff\xfex\x00") == ("UTF-16LE", 1.0)
    assert B.detect(b"abc\xa0def") == ("US-ASCII", 1.0)
    assert B.detect(b"\x1b$Babc")[0] == "ISO-2022-JP" and B.detect(b"x~{y")[0] == "HZ-GB-2312"
    assert B.detect("Привет, как дела сегодня".encode("cp1251"))[0] == "windows-1251"
    assert B.detect("Привет, как дела сегодня".encode("koi8_r"))[0] == "KOI8-R"
    assert B.detect("これはひらがなとカタカナの文章です".encode("shift_jis"))[0] == "Shift_JIS"
    assert B.detect("これはひらがなとカタカナの文章です".encode("euc_jp"))[0] == "EUC-JP"
    assert B.detect("Un café très agréable à côté".encode("cp1252"))[0] == "windows-1252"
    assert B.detect(b"") == (None, 0.0)


def test_find_next_wraps(spark):
    """Against a walk in plain Python, in trees with no, one, a few and only matches."""
    rng = random.Random(3)
    trees = {f"t{k}": [(f"n{i}", rng.random() < p, rng.random() < 0.8) for i in range(n)] for k, (n, p) in enumerate([(1, 0), (1, 1), (30, 0), (30, 0.04), (30, 0.3), (30, 1)])}
    trees["one"] = [(f"n{i}", i == 3, True) for i in range(6)]
    rows = [(t, x, [f"{i:03}"], hit, seen) for t, nodes in trees.items() for i, (x, hit, seen) in enumerate(nodes)]
    got = R.find_next(spark.createDataFrame(rows, "tree string, node string, sort_path array<string>, hit_here boolean, viewable boolean").repartition(3), F.col("hit_here"))
    assert got.columns == ["tree", "node", "sort_path", "hit_here", "viewable", "found"]
    wanted = {}
    for t, nodes in trees.items():
        nodes = [n for n in nodes if n[2]]
        for i, n in enumerate(nodes):
            wanted[t, n[0]] = next((m[0] for m in nodes[i + 1 :] + nodes[:i] if m[1]), None)
    assert {(r.tree, r.node): r.found for r in got.collect()} == wanted
    assert wanted["one", "n3"] is None and wanted["one", "n4"] == "n3"


def test_charsets_of_odd_texts(spark, tmp_path):
    """Missing and empty texts, escape sequences, marks and blanks: as the SQL has it."""
    import duckdb

    texts = [None, "", "plain", "x~{y", "~{<:Ky2;R~}", "\x1b$Babc", "\x1b(J", "\x1b", "\xa0", "a\xa0b", "\ufeff", "\ufeffx", "\ufeff~{", "\x00", "\x00\x00\xfe\xff", "\xff\xfex", "é", "~{é", "\x1b$)Aé", "€", "\U0001f600"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.charset for r in registry.queries()["detect_charset"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(registry.oracles()["detect_charset"]).fetchall())


def test_checksums():
    assert B.crc(b"123456789", 0xA001, 16) == 0xBB3D
    assert B.crc16_ccitt(b"123456789") == 0x31C3
    ones = (1 << 64) - 1
    assert B.crc(b"123456789", 0xC96C5795D7870F42, 64, ones, ones) == 0x995DC9BBDF1939FA
    assert B.crc(b"123456789", 0xEDB88320, 32, 0xFFFFFFFF, 0xFFFFFFFF) == zlib.crc32(b"123456789")


@pytest.mark.parametrize(("text", "wanted"), [("example", "http://www.example.com/"), ("example.org/a b", "http://example.org/a%20b"), ("ftp://u:p@h.org:21/x", "ftp://u:p@h.org:21/x"), ("/tmp/x", "file:///tmp/x"), ("ht tp://x", None), ("http://-bad.org", None), ("http://a..b", None), ("", None), (None, None), ("http://localhost", "http://localhost/"), ("http://h.org:x/", None), ("http://h.org/%C3%A9", "http://h.org/%C3%A9"), ("http://h.org/100%", "http://h.org/100%25")])
def test_urls(text, wanted):
    assert B.normal_url(text) == wanted


def test_orientation(spark):
    df = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b int")
    got = {(r.a, r.b): r.c for r in df.select("a", "b", N.add_orientation(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got[(4, 4)] == 3 and got[(7, 4)] == 0 and got[(4, 2)] == 5 and got[(0, 6)] == 6


def test_codes():
    assert [C.plain_code(x) for x in ("Method 0", "Method 1", "Quantum:07", "Quantum:7", "Fast v2.0", "Fast v3.0")] == ["Meth", "Mth1", "Quan", "Qua7", "Fs20", "Fast"]
    names = ["Deflate64", "Quantum:7", "Quantum:31", "Quantum:32", "LZX:4", "Method 16", "Fast v2.0", "-lh5-", "-lh0-", "Stored", "Stored again", "None", "Store"]
    assert list(C.short_codes(names).values()) == ["Df64", "Qua7", "Qu31", "Quan", "LZX4", "Mt16", "Fs20", "lh5", "None", "Stor", "Sto2", "Non2", "Sto3"]


def test_long_listing_of_a_large_archive(spark, tmp_path):
    """Every entry has a line, and indexes beyond three digits are whole."""
    from leafstack.plans import listing

    docs = spark.range(1203).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'s' as source", "id + 1 as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lines = {r.idx: r.line for r in listing.list_long(spark, str(tmp_path)).collect()}
    assert sorted(lines) == list(range(1203))
    assert all(line.startswith(f"{i:3d}. ") for i, line in lines.items())


def test_strict_totals_beyond_the_twentieth_entry(spark, tmp_path):
    """An unknown size makes its archive's total -1 wherever it stands, and a total is of all entries."""
    from leafstack.plans import archives

    docs = spark.createDataFrame([(i, "t", "en", "a" if i < 40 else "b", 2) for i in range(18, 70) if i != 51], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.archive, r.volume): r.total for r in archives.total_size_all(spark, str(tmp_path)).collect()}
    assert got[("a", None)] == -1 and got[("b", None)] == -1 and got[("a", 0)] == -1 and got[("a", 1)] == 4
    docs.filter("doc_id not in (34, 68)").write.parquet(f"{tmp_path}/whole/documents.parquet")
    got = {(r.archive, r.volume): r.total for r in archives.total_size_all(spark, f"{tmp_path}/whole").collect()}
    assert got[("a", None)] == 42 and got[("b", None)] == 56 and got[(None, None)] == 98


@pytest.mark.parametrize("parts", [2, 16, 256])
def test_places_of_all(spark, parts):
    """Every row has its place, ties and unknown times among them, however many ranges there are."""
    from datetime import datetime, timedelta

    from leafstack.operators import ordering as O

    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 50 == 7 else start + timedelta(seconds=i * 7919 % 101 / 4)) for i in range(300)]
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] - start).total_seconds() if r[1] else 0, r[0]))
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(rows, f"user_id long, ts {kind}")
        got = {r.user_id: r.place for r in O.placed(df, "ts", "user_id", parts=parts).collect()}
        assert got == {r[0]: i + 1 for i, r in enumerate(wanted)}
    assert O.placed(df.filter("false"), "ts", "user_id", parts=parts).count() == 0


def test_activities_beyond_the_fiftieth_have_places(spark, tmp_path):
    from leafstack.plans import listing

    events = spark.range(120).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id as user_id", "'a' as event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: r.place for r in listing.activity_places(spark, str(tmp_path)).collect()} == {i: 120 - i for i in range(120)}


def test_every_signature_is_met(spark, sf_dir):
    from leafstack.plans import archives

    assert {r.format for r in archives.detect_format_all(spark, sf_dir).collect()} == {n for n, _, _ in D.SIGNATURES} | {None}


def test_long_numbers_in_names(spark):
    names = ["a2", "a1" + "0" * 21, "a1" + "0" * 20, "a" + "0" * 30 + "3", "a10", "a01", "b", "a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(T.natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "a01", "a2", "a" + "0" * 30 + "3", "a10", "a1" + "0" * 20, "a1" + "0" * 21, "b"]


def test_long_lines_are_whole(spark):
    rows = spark.createDataFrame([(7, 12), (1000, 123456789012345), (1234567, None)], "i int, s long")
    c = F.col
    lines = [r.x for r in rows.select(E.long_line(c("i"), F.lit(False), F.lit(False), F.lit(False), F.lit(False), c("s"), F.lit(None).cast("long"), F.lit("Defl"), F.lit("d"), F.lit("n")).alias("x")).collect()]
    assert lines[0].startswith("  7. ") and lines[1].startswith("1000. ") and "123456789012345 " in lines[1] and lines[2].startswith("1234567. ")


def test_feeds_with_any_prefix(spark):
    feed = '<rss xmlns:m="http://search.yahoo.com/mrss/"><channel><item><title>t</title><m:content url="u"/></item></channel></rss>'
    other = '<rss><!-- http://search.yahoo.com/mrss/ --><channel><item><title>t</title></item></channel></rss>'
    df = spark.createDataFrame([(0, feed), (1, other)], "i int, x string")
    assert [tuple(r) for r in P.feed_items(df, "i", "x").collect()] == [(0, 0, "t", "u")]


def test_archives_that_cannot_be_read_have_a_verdict():
    for head, kind in ((b"Rar!\x1a\x07\x00", "RAR"), (b"7z\xbc\xaf\x27\x1c", "7-Zip"), (b"MSCF", "CAB"), (b"x1-lh5-", "LZH")):
        rows = A.list_archive(head + bytes(600), "f/x.bin")
        assert [(r[0], r[1], r[4], r[-1]) for r in rows] == [(0, None, kind, "not_supported")]
    assert A.list_archive(b"PK\x03\x04" + bytes(100), "x.zip") == []
    assert A.list_archive(b"just text", "x.txt") == []


def test_a_batch_done_again_counts_once(spark, tmp_path):
    from leafstack.streaming import changes as S

    batch = spark.createDataFrame([(1, 2), (1, 4), (3, 8)], "user_id long, flags int")
    put = S.kept(str(tmp_path / "found"), lambda b: S.coalesced(b, "user_id", "flags"))
    for number in (0, 1, 1, 0):
        put(batch, number)
    found = spark.read.parquet(str(tmp_path / "found"))
    assert sorted((r.batch, r.user_id, r.flags, r.n) for r in found.collect()) == [(0, 1, 6, 2), (0, 3, 8, 1), (1, 1, 6, 2), (1, 3, 8, 1)]
