"""Scalar functions over the tables: names, paths, sizes, flags, dates, digests, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack.functions import numbers as N
from leafstack.functions import text as T
from leafstack.plans.analogs import ENTRIES, entries, table
from leafstack.registry import query

c = F.col


@query("str_replace_set", "select page_id, regexp_replace(url, '[:/?&=#.]+', '_', 'g') shown from pages")
def str_replace_set(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.replace_set(c("url"), ":/?&=#.", "_").alias("shown"))


@query("str_between", "select page_id, case when contains(html, '<title>') then split_part(regexp_extract(html, '(?s)<title>(.*)$', 1), '</title>', 1) end title from pages")
def str_between(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.between(c("html"), "<title>", "</title>").alias("title"))


@query("path_first", f"with {ENTRIES} select entry_id, split_part(path, '/', 1) as first from entries")
def path_first(spark, sf_dir):
    return entries(spark, sf_dir, "entry_id", "path").select("entry_id", T.first_component(c("path")).alias("first"))


_ROUGH = "concat('/./', lang, '/x/../s', cast(n_chars % 7 as string), '//d', cast(doc_id as string), case when doc_id % 3 = 0 then '/..' else '' end)"


@query("path_canonical", "select doc_id, concat(lang, '/s', cast(n_chars % 7 as varchar), case when doc_id % 3 = 0 then '' else concat('/d', doc_id) end) path from documents")
def path_canonical(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_ROUGH} as rough").select("doc_id", F.array_join(T.canonical(c("rough")), "/").alias("path"))


@query("path_sanitize", "select doc_id, case when doc_id % 4 = 0 then '.' else concat('__Parent__/', lang, '/d', doc_id) end path from documents")
def path_sanitize(spark, sf_dir):
    rough = "case when doc_id % 4 = 0 then '/a/..' else concat('/../', lang, '/./d', cast(doc_id as string)) end"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{rough} as rough").select("doc_id", T.sanitized(c("rough")).alias("path"))


@query("path_string", "select doc_id, concat(lang, '/a:b/d', doc_id) path from documents")
def path_string(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.path_string(F.array(c("lang"), F.lit("a/b"), F.concat(F.lit("d"), c("doc_id").cast("string")))).alias("path"))


@query("path_parts", f"with {ENTRIES}, p as (select entry_id, list_filter(string_split(path, '/'), lambda x: x <> '') p from entries) select entry_id, cast(len(p) as int) depth, p[len(p)] as last, array_to_string(p[1:len(p)-1], '/') parent, p[1] = 'en' and p[2] = 's1' under from p")
def path_parts(spark, sf_dir):
    parts = T.components(c("path"))
    return entries(spark, sf_dir, "entry_id", "path").select("entry_id", F.size(parts).alias("depth"), F.element_at(parts, -1).alias("last"), T.parent(c("path")).alias("parent"), T.has_prefix(c("path"), F.lit("en/s1")).alias("under"))


@query("path_prefix_compat", f"with {ENTRIES} select entry_id from entries where starts_with(path, 'en/s')")
def path_prefix_compat(spark, sf_dir):
    """Prefixes by characters, as an option: 'en/s' takes 'en/s1/...' in."""
    return entries(spark, sf_dir, "entry_id", "path").filter(T.has_prefix(c("path"), F.lit("en/s"), compat=True)).select("entry_id")


@query("ctrl_escape", "select doc_id, replace(replace(text, chr(10), '^J'), chr(9), '^I') shown from documents")
def ctrl_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_controls(c("text")).alias("shown"))


@query("ascii_escape", "select p_partkey, regexp_replace(regexp_replace(concat(p_name, 'é', '€'), 'é', '%c3%a9'), '€', '%e2%82%ac') shown from part")
def ascii_escape(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.escape_bytes(F.concat(c("p_name"), F.lit("é€")).cast("binary")).alias("shown"))


@query("archive_stem", "select doc_id, concat('d', doc_id) stem from documents")
def archive_stem(spark, sf_dir):
    name = "concat('d', cast(doc_id as string), case doc_id % 6 when 0 then '.zip' when 1 then '.tar.gz' when 2 then '.part1.rar' when 3 then '.SIT.HQX' when 4 then '.tar.bz2' else '.tar.lzma' end)"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{name} as name").select("doc_id", T.archive_stem(c("name")).alias("stem"))


@query("display_name", "select p_partkey, replace(coalesce(nullif(case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then concat('My', chr(10), p_brand) end, ''), p_name), chr(10), '') shown from part")
def display_name(spark, sf_dir):
    custom = F.expr("case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then concat('My', '\\n', p_brand) end")
    return table(spark, sf_dir, "part").select("p_partkey", T.one_line(F.coalesce(F.nullif(custom, F.lit("")), c("p_name"))).alias("shown"))


@query("regex_ops", r"select page_id, regexp_matches(url, '[0-9]+') matched, regexp_extract(url, '[0-9]+') as first, regexp_extract(url, '^([a-z]+)://([^/]+)', 2) host, len(regexp_extract_all(url, '[a-z]+')) n_words, string_split_regex(url, '[/?]+')[2] part from pages")
def regex_ops(spark, sf_dir):
    url = c("url")
    return table(spark, sf_dir, "pages").select("page_id", url.rlike("[0-9]+").alias("matched"), F.regexp_extract(url, "[0-9]+", 0).alias("first"), F.regexp_extract(url, "^([a-z]+)://([^/]+)", 2).alias("host"), F.size(F.regexp_extract_all(url, F.lit("[a-z]+"), F.lit(0))).cast("long").alias("n_words"), F.get(F.split(url, "[/?]+"), F.lit(1)).alias("part"))


_DIGITS = "case when b < 10 * d then concat(((b * 100 + d // 2) // d) // 100, '.', lpad(cast(((b * 100 + d // 2) // d) % 100 as varchar), 2, '0')) when b < 100 * d then concat(((b * 10 + d // 2) // d) // 10, '.', ((b * 10 + d // 2) // d) % 10) else cast((b + d // 2) // d as varchar) end"


@query("bytes_human", f"with x as (select o_orderkey k, cast(floor(o_totalprice) * (case when o_orderkey % 3 = 0 then 1 when o_orderkey % 3 = 1 then 1000 else 1000000 end) as bigint) b from orders), y as (select k, b, case when b < 1000 then 1 when b < 1000000 then 1000 when b < 1000000000 then 1000000 when b < 1000000000000 then 1000000000 else 1000000000000 end d, case when b < 1000 then 'B' when b < 1000000 then 'KB' when b < 1000000000 then 'MB' when b < 1000000000000 then 'GB' else 'TB' end u from x), z as (select k, u, {_DIGITS} t from y) select k, concat(case when contains(t, '.') then rtrim(rtrim(t, '0'), '.') else t end, ' ', u) shown from z")
def bytes_human(spark, sf_dir):
    size = F.expr("cast(floor(o_totalprice) as bigint) * (case when o_orderkey % 3 = 0 then 1L when o_orderkey % 3 = 1 then 1000L else 1000000L end)")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), N.bytes_human(size).alias("shown"))


_SHORT = f"case when b < 1000 then concat(b, ' B') else concat({_DIGITS}, case when b < 1000000 then ' KB' when b < 1000000000 then ' MB' else ' GB' end) end"


@query("bytes_human_short", f"with x as (select doc_id, n_chars * (doc_id % 1000) b from documents), y as (select *, case when b < 1000000 then 1000 when b < 1000000000 then 1000000 else 1000000000 end d from x) select doc_id, {_SHORT} short, case when b < 1000 then concat(b, ' bytes') else concat({_SHORT}, ' (', format('{{:,}}', b), ' bytes)') end long from y")
def bytes_human_short(spark, sf_dir):
    size = c("n_chars") * (c("doc_id") % 1000)
    return table(spark, sf_dir, "documents").select("doc_id", N.bytes_short(size).alias("short"), N.bytes_long(size).alias("long"))


_SHARE = "100 * (1 - cast(packed as double) / cast(nullif(size, 0) as double))"


@query("compression_pct", f"with {ENTRIES} select entry_id, case when coalesce(size, 0) <> 0 and coalesce(packed, 0) <> 0 then case when {_SHARE} <= -100 then printf('%5.0f%%', {_SHARE}) else printf('%5.1f%%', {_SHARE}) end else ' -----' end shown from entries")
def compression_pct(spark, sf_dir):
    return entries(spark, sf_dir, "entry_id", "size", "packed").select("entry_id", N.compression_text(c("size"), c("packed")).alias("shown"))


def _bits(value: str, letters: str, flip: int = 0) -> str:
    top = len(letters) - 1
    return "concat(" + ", ".join(f"case when (xor({value}, {flip}) & {1 << (top - i)}) <> 0 then '{x}' else '-' end" for i, x in enumerate(letters)) + ")"


@query(
    "fmt_attrs",
    f"with {ENTRIES}, m as (select entry_id, coalesce(mode, 0) & 511 m, coalesce(dos, 0) d, windows w from entries) select entry_id, concat({_bits('m', 'rwxrwxrwx')}, ' (', case when m >= 64 then concat(cast(m // 64 as varchar), cast(m // 8 % 8 as varchar), cast(m % 8 as varchar)) when m >= 8 then concat(cast(m // 8 as varchar), cast(m % 8 as varchar)) else cast(m as varchar) end, ')') posix, concat({_bits('d', 'ADVSHR')}, ' (0x', printf('%02x', d), ')') dos, "
    f"concat({_bits('d', 'hsparwed', 15)}, ' (0x', printf('%02x', d), ')') amiga, concat({_bits('w', 'EIOCLPTN AD SHR')}, ' (0x', printf('%04x', w), ')') windows, case when d = 1 then 'Yes' when d = 0 then 'No' else printf('%x', d) end yes_no from m",
)
def fmt_attrs(spark, sf_dir):
    rows = entries(spark, sf_dir, "entry_id", "mode", "dos", "windows").selectExpr("entry_id", "coalesce(mode, 0) & 511 as m", "coalesce(dos, 0) as d", "windows as w")
    return rows.select("entry_id", N.posix_text(c("m")).alias("posix"), N.dos_text(c("d")).alias("dos"), N.amiga_text(c("d")).alias("amiga"), N.windows_text(c("w")).alias("windows"), N.yes_no(c("d")).alias("yes_no"))


@query("os_type", "select p_partkey, concat('J', chr(cast(65 + p_partkey % 26 as int)), case when p_partkey % 3 = 0 then '?' else 'E' end, 'G') shown from part")
def os_type(spark, sf_dir):
    code = F.expr("cast(74 * 16777216L + (65 + p_partkey % 26) * 65536L + (case when p_partkey % 3 = 0 then 7 else 69 end) * 256L + 71 as bigint)")
    return table(spark, sf_dir, "part").select("p_partkey", N.os_type(code).alias("shown"))


@query("parse_octal", "select p_partkey, cast(p_partkey % 64 as bigint) as octal, cast(-p_size as bigint) as decimal_, cast(p_size as bigint) hex_ from part")
def parse_octal(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", N.parse_number(F.concat(F.lit(" "), F.conv((c("p_partkey") % 64).cast("string"), 10, 8), F.lit("8x")), 8).alias("octal"), N.parse_number(F.concat(F.lit("-"), c("p_size").cast("string"), F.lit(" kg")), 10).alias("decimal_"), N.parse_number(F.concat(F.lit("0x"), F.hex("p_size"), F.lit("g")), 16).alias("hex_"))


@query("date_epochs", "select o_orderkey, make_timestamp((o_orderkey * 86400 + 946684800) * 1000000) d2000, make_timestamp((o_orderkey * 86400 - 2082844800) * 1000000) d1904, make_timestamp((o_orderkey * 86400 + 355526400) * 1000000) d1601 from orders")
def date_epochs(spark, sf_dir):
    seconds = c("o_orderkey") * 86400
    return _zoneless(table(spark, sf_dir, "orders").select("o_orderkey", N.date_2000(seconds).alias("d2000"), N.date_1904(seconds).alias("d1904"), N.date_1601(seconds + 12000000000).alias("d1601")))


def _zoneless(df):
    """Times without a zone, as the tables have them."""
    return df.select(*[c(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.simpleString() == "timestamp" else c(f.name) for f in df.schema.fields])


@query("date_dos", "with x as (select o_orderkey, o_orderdate t from orders) select o_orderkey, case when o_orderkey % 7 = 0 then null else make_timestamp(year(t), month(t), day(t), o_orderkey % 24, o_orderkey % 60, 2.0 * (o_orderkey % 30)) end shown from x")
def date_dos(spark, sf_dir):
    t = "o_orderdate"
    packed = F.expr(f"case when o_orderkey % 7 = 0 then 0L else shiftleft(cast(year({t}) - 1980 as bigint), 25) | shiftleft(cast(month({t}) as bigint), 21) | shiftleft(cast(day({t}) as bigint), 16) | shiftleft(o_orderkey % 24, 11) | shiftleft(o_orderkey % 60, 5) | (o_orderkey % 30) end")
    return _zoneless(table(spark, sf_dir, "orders").select("o_orderkey", N.date_dos(packed).alias("shown")))


@query("date_filetime", "select event_id, ts - interval (epoch_us(ts) % 10) microsecond as shown from events")
def date_filetime(spark, sf_dir):
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    ticks = (micros - micros % 10 + 11644473600000000) * 10 + 7
    return _zoneless(table(spark, sf_dir, "events").select("event_id", N.date_filetime(ticks).alias("shown")))


@query("date_cpm", "select o_orderkey, make_timestamp((283910400 + (o_orderkey % 9000) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey % 30) * 2) * 1000000) shown from orders")
def date_cpm(spark, sf_dir):
    time = F.expr("cast(shiftleft(o_orderkey % 24, 11) | shiftleft(o_orderkey % 60, 5) | (o_orderkey % 30) as int)")
    return _zoneless(table(spark, sf_dir, "orders").select("o_orderkey", N.date_cpm(F.expr("o_orderkey % 9000"), time).alias("shown")))


@query("best_date", "select o_orderkey, coalesce(strftime(coalesce(case when o_orderkey % 2 = 0 then o_orderdate end, case when o_orderkey % 3 = 0 then o_orderdate + interval 1 day end, case when o_orderkey % 5 = 0 then o_orderdate + interval 2 day end), '%Y-%m-%d %H:%M'), '----------------') shown from orders")
def best_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.best_date(F.expr("case when o_orderkey % 2 = 0 then o_orderdate end"), F.expr("case when o_orderkey % 3 = 0 then o_orderdate + interval 1 day end"), F.expr("case when o_orderkey % 5 = 0 then o_orderdate + interval 2 day end")).alias("shown"))


@query("date_after", "select o_orderkey from orders where o_orderdate > timestamp '1996-06-30 00:00:00'")
def date_after(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderdate > timestamp_ntz '1996-06-30 00:00:00'").select("o_orderkey")


@query("digests", "select doc_id, md5(text) md5, sha1(text) sha1, sha256(text) sha256 from documents")
def digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("snap_one", "select l_orderkey, l_linenumber, case when abs(1 - l_discount / 4 - 1.0) < 0.01 then 1.0 else 1 - l_discount / 4 end as scale from lineitem")
def snap_one(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.snap_one(1 - c("l_discount") / 4).alias("scale"))


_W, _H = "cast(200 + p_partkey % 1800 as double)", "cast(100 + p_partkey % 1500 as double)"


@query("fit_size", f"with x as (select p_partkey, {_W} w, {_H} h from part), s as (select *, least(800.0 / round(w), 600.0 / round(h)) s from x) select p_partkey, cast(round(w * s) as bigint) fit_w, cast(round(h * s) as bigint) fit_h, cast(round(w * least(s, 1.0)) as bigint) down_w, cast(round(w * greatest(s, 1.0)) as bigint) up_w from s")
def fit_size(spark, sf_dir):
    w, h = F.expr(_W), F.expr(_H)
    size = lambda x, only="": F.round(x * N.fit_scale(w, h, 800.0, 600.0, only)).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", size(w).alias("fit_w"), size(h).alias("fit_h"), size(w, "down").alias("down_w"), size(w, "up").alias("up_w"))


@query("thumb_size", f"with x as (select p_partkey, {_W} w, {_H} h from part), s as (select *, least(1.0, 128.0 / w, 128.0 / h) s from x) select p_partkey, cast(round(case when p_partkey % 2 = 0 then w else h end * s) as bigint) thumb_w, cast(round(case when p_partkey % 2 = 0 then h else w end * s) as bigint) thumb_h from s")
def thumb_size(spark, sf_dir):
    w, h = F.expr(_W), F.expr(_H)
    s, upright = N.thumb_scale(w, h, 128.0), c("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.when(upright, w).otherwise(h) * s).cast("long").alias("thumb_w"), F.round(F.when(upright, h).otherwise(w) * s).cast("long").alias("thumb_h"))


_A = ("cast(p_partkey % 20 as double)", "cast(p_partkey % 17 as double)", "cast(p_partkey % 13 as double)", "cast(p_partkey % 11 as double)")
_B = ("5.0", "4.0", "6.0", "cast(p_partkey % 7 as double)")


@query("rect_overlap", "with x as (select p_partkey, " + ", ".join(f"{e} a{i}" for i, e in enumerate(_A)) + ", " + ", ".join(f"{e} b{i}" for i, e in enumerate(_B)) + " from part) select p_partkey, a0 < b0 + b2 and b0 < a0 + a2 and a1 < b1 + b3 and b1 < a1 + a3 meets from x")
def rect_overlap(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.rects_meet(tuple(map(F.expr, _A)), tuple(map(F.expr, _B))).alias("meets"))


@query("rect_diff", "with x as (select p_partkey, " + ", ".join(f"{e} a{i}" for i, e in enumerate(_A)) + ", " + ", ".join(f"cast({e} as double) b{i}" for i, e in enumerate(_B)) + " from part), y as (select *, greatest(a1, b1) low, b1 + b3 - greatest(a1, b1) side from x), z as (select p_partkey, unnest(case when b2 <= 0 or b3 <= 0 then [[a0, a1, a2, a3]] else list_filter([[a0, b1 + b3, a2, greatest(a1 + a3 - b1 - b3, 0.0)], [a0, a1, a2, greatest(b1 - a1, 0.0)], [a0, low, greatest(b0 - a0, 0.0), side], [b0 + b2, low, greatest(a0 + a2 - b0 - b2, 0.0), side]], lambda r: r[3] > 0 and r[4] > 0) end) r from y) select p_partkey, r[1] x, r[2] y, r[3] w, r[4] h from z")
def rect_diff(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(N.rect_difference(tuple(map(F.expr, _A)), tuple(map(F.expr, _B)))).alias("r")).select("p_partkey", "r.*")


@query("geom_ops", f"with x as (select p_partkey, {_A[0]} x, {_A[1]} y, {_W} w, {_H} h from part) select p_partkey, round(x + 0.25) rx, x + 3 - y dx, x + w / 2 cx, y + h / 2 cy, w * 1.5 sw, x + 2 ix, w - 4 iw from x")
def geom_ops(spark, sf_dir):
    """Rounding, offset, centre, scale and inset of rectangles."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_A[0]} x", f"{_A[1]} y", f"{_W} w", f"{_H} h").selectExpr("p_partkey", "round(x + 0.25D) rx", "x + 3 - y dx", "x + w / 2 cx", "y + h / 2 cy", "w * 1.5D sw", "x + 2 ix", "w - 4 iw")


@query("orient_add", "with x as (select p_partkey, [0, 0, 2, 3, 1, 6, 7, 5, 4][p_partkey % 9 + 1] a, [0, 0, 2, 3, 1, 6, 7, 5, 4][p_partkey // 9 % 9 + 1] b from part), y as (select *, case when (a & 4) <> 0 and (b & 4) = 0 then ((b & 2) >> 1) | ((b & 1) << 1) else b end n from x) select p_partkey, cast(xor(xor(a, n), case when (a & 4) <> 0 and (b & 4) <> 0 then 3 else 0 end) as int) as orientation from y")
def orient_add(spark, sf_dir):
    a, b = N.tiff_orientation(c("p_partkey") % 9), N.tiff_orientation(F.expr("p_partkey div 9 % 9"))
    return table(spark, sf_dir, "part").select(c("p_partkey"), a.alias("a"), b.alias("b")).select("p_partkey", N.add_orientation(c("a"), c("b")).alias("orientation"))


@query("reading_edges", "select p_partkey, cast(case p_partkey % 4 when 0 then 8 + case when p_size % 2 = 0 then 1 else 4 end when 1 then 2 + case when p_size % 2 = 0 then 4 else 1 end when 2 then 8 + case when p_size % 2 = 0 then 4 else 1 end else 0 end as int) edges from part")
def reading_edges(spark, sf_dir):
    place = F.element_at(F.array(*map(F.lit, ("home", "end", "end_top", "other"))), (c("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", N.reading_edges(place, c("p_size") % 2 == 0).alias("edges"))


@query("label_color", "select p_partkey, cast((p_partkey >> 1) & 7 as int) color from part")
def label_color(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.shiftright("p_partkey", 1).bitwiseAND(7).cast("int").alias("color"))


@query("progress", "select o_orderkey, case when o_orderkey % 5 = 0 then 0.0 else least(o_custkey / cast(o_orderkey as double), 1.0) end done from orders")
def progress(spark, sf_dir):
    """Loaded share of a load; unknown lengths count as none."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case when o_orderkey % 5 = 0 then 0.0D else least(o_custkey / cast(o_orderkey as double), 1.0D) end").alias("done"))


@query("status_ok", "select event_id from events where 100 + event_id % 500 between 200 and 299")
def status_ok(spark, sf_dir):
    return table(spark, sf_dir, "events").filter((c("event_id") % 500 + 100).between(200, 299)).select("event_id")


@query("viewable", "select event_id, event_id % 3 = 0 or event_type = 'view' viewable from events")
def viewable(spark, sf_dir):
    """Loading, or read by an adapter that can show it."""
    return table(spark, sf_dir, "events").select("event_id", ((c("event_id") % 3 == 0) | (c("event_type") == "view")).alias("viewable"))


@query("kind_label", "select p_partkey, coalesce(case when p_partkey % 3 = 0 then p_type end, case when p_partkey % 3 = 1 then upper(p_brand) end, 'application/octet-stream') kind from part")
def kind_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.expr("case when p_partkey % 3 = 0 then p_type end"), F.expr("case when p_partkey % 3 = 1 then upper(p_brand) end"), F.lit("application/octet-stream")).alias("kind"))


@query("sort_label", "select o_orderkey, concat('order ', o_orderkey, ' (', case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then concat(cast(floor(o_totalprice) as bigint), ' B') else o_orderpriority end, ')') label from orders")
def sort_label(spark, sf_dir):
    """A menu label with what the rows are sorted by."""
    shown = F.when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(c("o_orderkey") % 3 == 1, F.concat(F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(" B"))).otherwise(c("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order "), c("o_orderkey").cast("string"), F.lit(" ("), shown, F.lit(")")).alias("label"))


@query("charset_default", "select p_partkey, case when p_partkey % 4 = 0 then 'windows-1252' when p_partkey % 4 = 1 then 'macintosh' else 'UTF-8' end charset, case when p_partkey % 4 = 0 then 0.0 when p_partkey % 4 = 3 then 1.0 else 0.5 end confidence from part")
def charset_default(spark, sf_dir):
    """The charset to decode by: a fixed one is certain, none at all means windows-1252 with no confidence, and Mac archives take macintosh for windows-1252."""
    fixed, guess, mac = F.expr("case when p_partkey % 4 = 3 then 'UTF-8' end"), F.expr("case p_partkey % 4 when 1 then 'windows-1252' when 2 then 'UTF-8' end"), c("p_partkey") % 4 == 1
    chosen = F.when(mac & (guess == "windows-1252"), "macintosh").otherwise(F.coalesce(fixed, guess, F.lit("windows-1252")))
    return table(spark, sf_dir, "part").select("p_partkey", chosen.alias("charset"), F.when(fixed.isNotNull(), 1.0).when(guess.isNotNull(), 0.5).otherwise(0.0).alias("confidence"))
