"""Archive entries: runs, totals, forks, flags, verdicts, dispatch and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack.operators import dispatch as D
from leafstack.operators import entries as E
from leafstack.plans.analogs import ENTRIES, entries, table
from leafstack.registry import query

c = F.col


@query("solid_runs", f"with {ENTRIES}, f as (select *, case when solid is not distinct from lag(solid) over (partition by archive order by idx) and idx > 0 then 0 else 1 end n from entries), r as (select *, sum(n) over (partition by archive order by idx) run from f) select archive, idx, min(idx) over (partition by archive, run) first_index, lead(idx) over (partition by archive, run order by idx) next_index, row_number() over (partition by archive, run order by idx) > 1 is_solid from r")
def solid_runs(spark, sf_dir):
    return E.solid_runs(entries(spark, sf_dir, "archive", "idx", "solid"), ["archive"], "idx", "solid").select("archive", "idx", "first_index", "next_index", "is_solid")


@query("event_runs", "with f as (select user_id, event_id, event_type, case when event_type is not distinct from lag(event_type) over (partition by user_id order by event_id) and row_number() over (partition by user_id order by event_id) > 1 then 0 else 1 end n from events), r as (select *, sum(n) over (partition by user_id order by event_id) run from f) select user_id, event_id, min(event_id) over (partition by user_id, run) first_index, lead(event_id) over (partition by user_id, run order by event_id) next_index from r")
def event_runs(spark, sf_dir):
    return E.solid_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "first_index", "next_index")


@query("entry_index", f"with {ENTRIES} select archive, entry_id, idx from entries")
def entry_index(spark, sf_dir):
    return entries(spark, sf_dir, "archive", "entry_id", "idx")


@query("total_size_strict", f"with {ENTRIES} select archive, cast(case when count(*) = count(size) then coalesce(sum(size), 0) else -1 end as bigint) total from entries group by 1")
def total_size_strict(spark, sf_dir):
    return entries(spark, sf_dir, "archive", "size").groupBy("archive").agg(E.total().alias("total"))


@query("total_size_all", f"with {ENTRIES}, v as (select archive, entry_id % 17 volume, size from entries) select archive, volume, cast(case when count(*) = count(size) then coalesce(sum(size), 0) else -1 end as bigint) total from v group by rollup (archive, volume)")
def total_size_all(spark, sf_dir):
    """Totals over all entries of volumes, archives and everything; only some volumes have an unknown size."""
    rows = entries(spark, sf_dir, "archive", "entry_id", "size").selectExpr("archive", "entry_id % 17 as volume", "size")
    return rows.rollup("archive", "volume").agg(E.total().alias("total"))


@query("total_size_known", f"with {ENTRIES} select archive, cast(coalesce(sum(size), 0) as bigint) total from entries group by 1")
def total_size_known(spark, sf_dir):
    return entries(spark, sf_dir, "archive", "size").groupBy("archive").agg(E.total(known_only=True).alias("total"))


@query("total_size_files", f"with {ENTRIES} select archive, cast(case when count(*) = count(size) then coalesce(sum(size), 0) else -1 end as bigint) total from entries where not is_dir group by 1")
def total_size_files(spark, sf_dir):
    return entries(spark, sf_dir, "archive", "size", "is_dir").filter("not is_dir").groupBy("archive").agg(E.total().alias("total"))


@query("repr_size", f"with {ENTRIES} select entry_id, cast(case when entry_id % 7 = 0 then 0 else coalesce(size, packed, 1000) end as bigint) shown from entries")
def repr_size(spark, sf_dir):
    return entries(spark, sf_dir, "entry_id", "size", "packed").select("entry_id", E.representative_size(c("size"), c("packed"), c("entry_id") % 7 == 0).alias("shown"))


@query("archive_flags", f"with {ENTRIES} select archive, bool_or(encrypted) encrypted, bool_or(solid is not null) solid, bool_or(entry_id % 397 = 0) corrupted from entries group by 1")
def archive_flags(spark, sf_dir):
    rows = entries(spark, sf_dir, "archive", "encrypted", "solid", "entry_id")
    return rows.groupBy("archive").agg(F.bool_or("encrypted").alias("encrypted"), F.bool_or(c("solid").isNotNull()).alias("solid"), F.bool_or(c("entry_id") % 397 == 0).alias("corrupted"))


@query("entry_flags", f"with {ENTRIES}, k as (select *, coalesce(mode, 0) & 61440 k from entries) select entry_id, target is not null or k = 40960 is_link, k = 16384 is_dir, k = 8192 is_character_device, k = 24576 is_block_device, k = 4096 is_fifo, (coalesce(dos, windows, 0) & 2) <> 0 is_hidden from k")
def entry_flags(spark, sf_dir):
    return entries(spark, sf_dir, "entry_id", "mode", "dos", "windows", "target").select("entry_id", *E.flags(c("mode"), c("dos"), c("windows"), c("target")))


@query("finder_info", "select p_partkey, cast(1414284399 + p_partkey as bigint) as type, cast(1414746996 as bigint) creator, cast(p_partkey % 65536 as int) as flags, cast((p_partkey % 65536 >> 1) & 7 as int) as label from part")
def finder_info(spark, sf_dir):
    info = F.unhex(F.concat(F.lpad(F.hex(c("p_partkey") + 1414284399), 8, "0"), F.lit("54534354").substr(1, 0), F.lpad(F.hex(F.lit(1414746996)), 8, "0"), F.lpad(F.hex(c("p_partkey") % 65536), 4, "0")))
    return table(spark, sf_dir, "part").select("p_partkey", E.finder_info(info).alias("x")).select("p_partkey", "x.*")


@query("fork_merge", f"with {ENTRIES}, f as (select *, case when is_resource <> lag(is_resource) over (partition by archive, stem_key order by idx) then 0 else 1 end n from entries), ch as (select *, sum(n) over (partition by archive, stem_key order by idx) chain from f), p as (select *, (row_number() over (partition by archive, stem_key, chain order by idx) - 1) // 2 pair from ch) select archive, stem_key, min(idx) entry_index, min(idx) filter (where not is_resource) data_index, min(idx) filter (where is_resource) resource_index from p group by archive, stem_key, chain, pair")
def fork_merge(spark, sf_dir):
    return E.merge_forks(entries(spark, sf_dir, "archive", "idx", "stem_key", "is_resource"), ["archive"], "idx", "stem_key", "is_resource")


@query("fork_pairs", f"with {ENTRIES} select archive, stem_key from entries group by all having count(*) = 2")
def fork_pairs(spark, sf_dir):
    return E.fork_pairs(entries(spark, sf_dir, "archive", "stem_key"), ["archive"], "stem_key")


_VERDICT = "case when is_dir or is_link then 'not_tested' when entry_id % 31 = 0 then 'not_supported' when entry_id % 37 = 0 then 'unpacking_failed' when entry_id % 3 = 0 and entry_id % 41 = 0 then 'wrong_checksum' when size is not null and entry_id % 43 = 0 then 'wrong_size' when entry_id % 3 <> 0 then 'no_checksum' else 'ok' end"


def _verdicts(spark, sf_dir):
    i = c("entry_id")
    rows = entries(spark, sf_dir, "archive", "entry_id", "size", "is_dir", "is_link")
    return rows.withColumn("verdict", E.verdict(~(c("is_dir") | c("is_link")), i % 31 != 0, i % 37 != 0, ~(c("size").isNotNull() & (i % 43 == 0)), i % 3 == 0, i % 41 != 0))


@query("verdict", f"with {ENTRIES} select entry_id, {_VERDICT} verdict from entries")
def verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("entry_id", "verdict")


@query("verdict_counts", f"with {ENTRIES}, v as (select archive, {_VERDICT} v from entries) select archive, count(*) filter (where v = 'ok') passed, count(*) filter (where v in ('not_supported', 'unpacking_failed', 'wrong_size', 'wrong_checksum')) failed, count(*) filter (where v = 'no_checksum') as unknown from v group by 1")
def verdict_counts(spark, sf_dir):
    return E.verdict_counts(_verdicts(spark, sf_dir), ["archive"])


@query("entry_class_counts", f"with {ENTRIES} select archive, case when is_dir then 'directory' when is_link then 'link' when entry_id % 3 = 0 then 'success' else 'unknown' end as class, count(*) n from entries group by all")
def entry_class_counts(spark, sf_dir):
    kind = F.when(c("is_dir"), "directory").when(c("is_link"), "link").when(c("entry_id") % 3 == 0, "success").otherwise("unknown")
    return entries(spark, sf_dir, "archive", "entry_id", "is_dir", "is_link").groupBy("archive", kind.alias("class")).agg(F.count("*").alias("n"))


@query("link_target", f"with {ENTRIES} select entry_id, case when is_link then coalesce(target, path) end target from entries")
def link_target(spark, sf_dir):
    """A link's stored target, else what it contains."""
    return entries(spark, sf_dir, "entry_id", "is_link", "target", "path").select("entry_id", F.when(c("is_link"), F.coalesce("target", "path")).alias("target"))


@query("activity_active", "with a as (select user_id, event_id, bool_or(value > 50) own from events group by all), up as (select user_id, own from a) select user_id, bool_or(own) active, count(*) filter (where own) as busy from up group by 1")
def activity_active(spark, sf_dir):
    """Activities that make progress themselves or have one beneath them that does."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(c("value") > 50).alias("active"), F.count_if(c("value") > 50).alias("busy"))


@query("child_activities", "select user_id, event_id from events where value > 50")
def child_activities(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value > 50").select("user_id", "event_id")


@query("open_documents", "select count(distinct user_id) n, count(*) filter (where event_type is not null) shown from events")
def open_documents(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n"), F.count("event_type").alias("shown"))


@query("props_flatten", "select event_id, 'Key' label, json_extract_string(props, '$.k') shown from events where json_extract_string(props, '$.k') is not null union all select event_id, 'Type', event_type from events")
def props_flatten(spark, sf_dir):
    """Known keys of nested properties under their labels, one level flat; unknown keys go."""
    labels = F.create_map(F.lit("k"), F.lit("Key"), F.lit("type"), F.lit("Type"))
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.map_from_arrays(F.array(F.lit("type"), F.lit("extra")), F.array(c("event_type"), F.lit("x"))))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("key", "shown"))
    return rows.withColumn("label", F.element_at(labels, c("key"))).filter("label is not null").select("event_id", "label", "shown")


@query("props_derive", "select p_partkey, concat(200 + p_partkey % 1800, 'x', 100 + p_partkey % 1500) pixels, cast(round(72 + p_partkey % 100 / 3.0) as bigint) dpi, case when p_size <> p_partkey % 50 then cast(p_size as bigint) end original from part")
def props_derive(spark, sf_dir):
    p = c("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat((p % 1800 + 200).cast("string"), F.lit("x"), (p % 1500 + 100).cast("string")).alias("pixels"), F.round(72 + p % 100 / 3.0).cast("long").alias("dpi"), F.when(~c("p_size").cast("long").eqNullSafe(p % 50), c("p_size").cast("long")).alias("original"))


_RULE_ROWS = ", ".join(f"('{a}', '{k}', '{p}', {D.PRIORITY.get(k, 0)})" for a, kinds in D.RULES.items() for k, ps in kinds.items() for p in ps.split())
_EVIDENCE = "select doc_id, case doc_id % 4 when 0 then 'jpg' when 1 then 'zip' when 2 then 'rss' else 'xyz' end ext, case doc_id % 5 when 0 then 'text/html' when 1 then 'image/png' when 2 then 'application/pdf' end mime, case when doc_id % 7 = 0 then 'public.folder' when doc_id % 7 = 1 then 'public.jpeg' end uti, case when n_chars > 4 and doc_id % 6 = 0 then '504b0304' when doc_id % 6 = 1 then '377ac2bc' end fourcc from documents"
_DISPATCH = f"with r(adapter, kind, pattern, priority) as (values {_RULE_ROWS}), e as ({_EVIDENCE}), g as (select doc_id, unnest([{{'k': 'ext', 'p': ext}}, {{'k': 'mime', 'p': mime}}, {{'k': 'uti', 'p': uti}}, {{'k': 'fourcc', 'p': fourcc}}]) x from e), m as (select doc_id, adapter, max(priority) priority from g join r on g.x.k = r.kind and g.x.p = r.pattern group by all)"


def _resolved(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(*_split_select(_EVIDENCE))
    return D.resolve(rows, "doc_id", {k: c(k) for k in ("ext", "mime", "uti", "fourcc")})


def _split_select(sql: str) -> list[str]:
    import re

    return re.split(r", (?=case )", sql.removeprefix("select ").removesuffix(" from documents"))


@query("dispatch_priority", f"{_DISPATCH} select e.doc_id, cast(coalesce(max(priority), 0) as int) priority from e left join m using (doc_id) group by 1")
def dispatch_priority(spark, sf_dir):
    return _resolved(spark, sf_dir).select("doc_id", c("priority").cast("int").alias("priority"))


@query("dispatch_resolve", f"{_DISPATCH} select e.doc_id, coalesce(any_value(a.l)[1], 'resource') adapter, array_to_string(list_concat(coalesce(any_value(a.l), []), ['resource']), ',') candidates from e left join (select doc_id, list(adapter order by priority desc, adapter) l from m group by 1) a using (doc_id) group by e.doc_id")
def dispatch_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select("doc_id", "adapter", "candidates")


@query("supported_types", f"with r(adapter, kind, pattern, priority) as (values {_RULE_ROWS}) select adapter, kind, pattern from r where kind in ('ext', 'mime')")
def supported_types(spark, sf_dir):
    """Extensions and MIME types that can be read."""
    return D.rules(spark).filter("kind in ('ext', 'mime')").select("adapter", "kind", "pattern")


_HEADS = ", ".join(f"'{'00' * o + s}'" for _, o, s in D.SIGNATURES if o < 300)
_NAMES = ", ".join(f"'{n}'" for n, o, _ in D.SIGNATURES if o < 300)


@query("detect_format", f"select doc_id, [{_NAMES}, null][doc_id % {len([1 for s in D.SIGNATURES if s[1] < 300]) + 1} + 1] as format from documents")
def detect_format(spark, sf_dir):
    """Formats by signature: each document's bytes stand behind one of the known signatures, or behind none."""
    heads = [("00" * o + s) for _, o, s in D.SIGNATURES if o < 300]
    content = F.concat(F.unhex(F.element_at(F.array(*map(F.lit, [*heads, "00"])), (c("doc_id") % (len(heads) + 1) + 1).cast("int"))), F.unhex(F.lit("0000000000000000")))
    return table(spark, sf_dir, "documents").select("doc_id", D.detect_format(content).alias("format"))


_ALL_NAMES = ", ".join(f"'{n}'" for n, _, _ in D.SIGNATURES)


@query("detect_format_all", f"select doc_id, [{_ALL_NAMES}, null][doc_id % {len(D.SIGNATURES) + 1} + 1] as format from documents")
def detect_format_all(spark, sf_dir):
    """Formats by every signature, those far into the header too; zero bytes stand before each."""
    at = (c("doc_id") % (len(D.SIGNATURES) + 1) + 1).cast("int")
    zeros = F.repeat(F.lit("00"), F.element_at(F.array(*[F.lit(o) for _, o, _ in D.SIGNATURES], F.lit(0)), at))
    code = F.element_at(F.array(*[F.lit(s) for _, _, s in D.SIGNATURES], F.lit("00")), at)
    content = F.unhex(F.concat(zeros, code, F.lit("0000000000000000")))
    return table(spark, sf_dir, "documents").select("doc_id", D.detect_format(content).alias("format"))


@query("tar_variant", "select p_partkey, case p_partkey % 4 when 0 then 'USTAR' when 1 then 'GNU' when 2 then 'STAR' else 'V7' end variant from part")
def tar_variant(spark, sf_dir):
    """Headers made of zero bytes, a magic, and for the oldest variant the checksum of 512 zero bytes with blanks in its place (256 in octal is 400)."""
    zero = lambda n: F.repeat(F.lit("00"), n)
    magic = F.element_at(F.array(F.lit("7573746172003030"), F.lit("7573746172202000"), F.lit("7573746172003030"), F.lit("0000000000000000")), (c("p_partkey") % 4 + 1).cast("int"))
    total = F.when(c("p_partkey") % 4 == 3, "3030303430300020").otherwise("0000000000000000")
    value = F.when(c("p_partkey") % 4 == 3, F.concat(zero(148), F.lit("3030303430300020"), zero(356))).otherwise(F.concat(zero(148), total, zero(101), magic, zero(243), F.when(c("p_partkey") % 4 == 2, "74617200").otherwise("00000000")))
    return table(spark, sf_dir, "part").select("p_partkey", D.tar_variant(F.unhex(value)).alias("variant"))


@query("union_all", "select p_brand v from part union all select p_type from part")
def union_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(c("p_brand").alias("v")).unionByName(part.select(c("p_type").alias("v")))
