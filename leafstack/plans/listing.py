"""Orders, filters, searches, most recent things, and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack.functions import numbers as N
from leafstack.functions import text as T
from leafstack.operators import entries as E
from leafstack.operators import ordering as O
from leafstack.plans.analogs import ENTRIES, entries, natural_sql, table
from leafstack.registry import query

_SORTS = {"name": (None, "name"), "date": ("modified", "modified"), "size": ("size", "size"), "kind": ("kind", "kind")}
_PART = "select p_partkey id, p_name name, cast(case when p_partkey % 11 = 0 then null else p_size end as bigint) size, p_type kind, p_brand folder from part"


def _sorted(key: str, descending: bool):
    def run(spark, sf_dir):
        if key == "modified":
            rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "o_orderstatus folder", "concat('order ', cast(o_custkey as string)) name", "case when o_orderkey % 13 = 0 then null else o_orderdate end modified")
        else:
            rows = table(spark, sf_dir, "part").selectExpr(*_PART.removeprefix("select ").removesuffix(" from part").split(", ", 2)[:2], "cast(case when p_partkey % 11 = 0 then null else p_size end as bigint) size", "p_type kind", "p_brand folder")
        return O.ranked(rows, O.sort_columns(None if key == "name" else key, "name", "id", descending), ["folder"]).select("folder", "id", F.col("rank").cast("long").alias("rank"))

    source = _PART if key != "modified" else "select o_orderkey id, o_orderstatus folder, concat('order ', cast(o_custkey as string)) name, case when o_orderkey % 13 = 0 then null else o_orderdate end modified from orders"
    turn = "desc nulls last" if descending else "asc nulls last"
    keys = ", ".join(f"{c} {turn}" for c in [*([] if key == "name" else [key]), natural_sql("name"), "name", "id"])
    return run, f"with x as ({source}) select folder, id, cast(row_number() over (partition by folder order by {keys}) as bigint) rank from x"


for _name, _key, _down in (("sort_by_name", "name", False), ("sort_by_date", "modified", True), ("sort_by_size", "size", False), ("sort_by_kind", "kind", True), ("natural_sort", "name", True)):
    _run, _sql = _sorted(_key, _down)
    _run.__qualname__ = _name
    query(_name, _sql)(_run)


@query("sort_innate", "select conv_id, turn, cast(row_number() over (partition by conv_id order by turn desc, role desc, text desc) as bigint) rank from conversations")
def sort_innate(spark, sf_dir):
    return O.ranked(table(spark, sf_dir, "conversations"), [F.col("turn").desc(), F.col("role").desc(), F.col("text").desc()], ["conv_id"]).select("conv_id", "turn", F.col("rank").cast("long").alias("rank"))


@query("sort_shuffle", "select p_brand, p_partkey, cast(row_number() over (partition by p_brand order by md5(concat('7:', p_partkey)), p_partkey) as bigint) rank from part")
def sort_shuffle(spark, sf_dir):
    return O.shuffled(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 7).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("recent_topk", "with x as (select user_id, max(struct_pack(ts := ts, event_id := event_id)) m from events group by 1), t as (select user_id, m.ts ts, m.event_id event_id, row_number() over (order by m.ts desc, m.event_id desc) rank from x) select user_id, ts, event_id, cast(rank as bigint) rank from t where rank <= 25")
def recent_topk(spark, sf_dir):
    """The 25 users seen last."""
    return O.recent(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 25).select("user_id", "ts", "event_id", F.col("rank").cast("long").alias("rank"))


@query("lru_3", "with x as (select event_type, max(struct_pack(ts := ts, event_id := event_id)) m from events group by 1), t as (select event_type, m.ts ts, m.event_id event_id, row_number() over (order by m.ts desc, m.event_id desc) rank from x) select event_type, ts, event_id, cast(rank as bigint) rank from t where rank <= 3")
def lru_3(spark, sf_dir):
    """The three kinds of events that a cache of three would still hold."""
    return O.recent(table(spark, sf_dir, "events").select("event_type", "ts", "event_id"), ["event_type"], "ts", "event_id", 3).select("event_type", "ts", "event_id", F.col("rank").cast("long").alias("rank"))


@query("bookmarks_latest", "select user_id, event_type, m.ts added, m.event_id event_id, cast(row_number() over (partition by user_id order by m.ts desc, m.event_id desc) as bigint) rank from (select user_id, event_type, max(struct_pack(ts := ts, event_id := event_id)) m from events group by all)")
def bookmarks_latest(spark, sf_dir):
    last = O.last_of_each(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")
    return O.ranked(last, [F.col("ts").desc(), F.col("event_id").desc()], ["user_id"]).select("user_id", "event_type", F.col("ts").alias("added"), "event_id", F.col("rank").cast("long").alias("rank"))


@query("unique_first", "select event_type, user_id, min(event_id) first_id from events group by all")
def unique_first(spark, sf_dir):
    return O.first_of_each(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], "event_id").withColumnRenamed("event_id", "first_id")


@query("activity_priority", "select event_type, user_id, m.event_id last_id, cast(row_number() over (order by m.ts desc, m.event_id) as bigint) place from (select event_type, user_id, max(struct_pack(ts := ts, event_id := event_id)) m from events group by all)")
def activity_priority(spark, sf_dir):
    """Every activity's place: an activity is what a user does of one kind, and each event moves its own to the front."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    last = events.groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("event_type", "user_id", "m.ts", "m.event_id")
    return O.placed(last, "ts", "event_id").select("event_type", "user_id", F.col("event_id").alias("last_id"), "place")


@query("activity_places", "select user_id, m.event_id last_id, cast(row_number() over (order by m.ts desc, user_id) as bigint) place from (select user_id, max(struct_pack(ts := ts, event_id := event_id)) m from events where event_type = (select min(event_type) from events) group by 1)")
def activity_places(spark, sf_dir):
    """Every activity's place, the one prioritised last first."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    kind = events.agg(F.min("event_type").alias("kind"))
    rows = events.join(F.broadcast(kind), F.col("event_type") == F.col("kind"))
    last = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.ts", "m.event_id")
    return O.placed(last, "ts", "user_id").select("user_id", F.col("event_id").alias("last_id"), "place")


_DIGITS = r"list_transform(regexp_extract_all({0}, '(\d+)', 1), lambda r: regexp_replace(r, '^0+(\d)', '\1'))"


@query("search_terms", rf"select doc_id from documents where contains(lower(text), 'the') and list_contains({_DIGITS.format('text')}, '7')")
def search_terms(spark, sf_dir):
    """Documents that match 'THE 7'."""
    return table(spark, sf_dir, "documents").filter(T.matches(F.col("text"), "THE 7")).select("doc_id")


@query("search_names", rf"select p_partkey, p_name from part where contains(lower(p_name), 'a') and list_contains({_DIGITS.format('p_name')}, '12') or contains(lower(p_name), 'small')")
def search_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return rows.filter(T.matches(F.col("p_name"), " A  012") | T.matches(F.col("p_name"), "SMALL"))


@query("search_pages", "select doc_id, cast(i as bigint) page from (select doc_id, unnest(range(1, greatest(n_chars // 500, 1) + 1)) i from documents) where i = 3")
def search_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr("sequence(1, greatest(n_chars div 500, 1))")).alias("page"))
    return pages.filter(T.matches_page(F.col("page"), "3 03")).select("doc_id", F.col("page").cast("long").alias("page"))


@query("search_props", "with p as (select event_id, unnest(['k', 'type', 'value']) label, unnest([json_extract_string(props, '$.k'), event_type, cast(cast(value as bigint) as varchar)]) shown from events) select event_id, label, shown, cast(row_number() over (partition by event_id order by label) as bigint) place from p where contains(lower(label), 'k') or contains(lower(shown), 'k')")
def search_props(spark, sf_dir):
    """Properties of events whose label or value holds a k, by label."""
    props = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), c.alias("shown")) for k, c in (("k", F.get_json_object("props", "$.k")), ("type", F.col("event_type")), ("value", F.expr("cast(cast(round(value) as bigint) as string)")))])).alias("p")).select("event_id", "p.*")
    found = props.filter(T.matches(F.col("label"), "K") | F.coalesce(T.matches(F.col("shown"), "K"), F.lit(False)))
    return O.ranked(found, [F.col("label")], ["event_id"], "place").withColumn("place", F.col("place").cast("long"))


@query("hidden_filter", f"with {ENTRIES} select entry_id, path from entries where not (starts_with(path, '.') or contains(path, '/.'))")
def hidden_filter(spark, sf_dir):
    return entries(spark, sf_dir, "entry_id", "path").filter(~T.hidden(F.col("path")))


@query("glob_filter", "select page_id, url from pages where regexp_matches(url, '(?si)^http.*/e[ns]/[0-9]+.*$') ")
def glob_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").filter(T.glob(F.col("url"), "HTTP*/e[ns]/[0-9]*"))


@query("entry_filter", f"with {ENTRIES} select archive, idx, path from entries where (regexp_matches(path, '(?si)^.*\\.JPG$') or regexp_matches(path, '(?si)^en/s.*$')) and idx in (0, 1, 2, 3, 5, 8, 13, 21, 34)")
def entry_filter(spark, sf_dir):
    """Entries that one of two globs and a set of indexes name."""
    rows = entries(spark, sf_dir, "archive", "idx", "path")
    return rows.filter((T.glob(F.col("path"), "*.JPG") | T.glob(F.col("path"), "en/s*")) & F.col("idx").isin(0, 1, 2, 3, 5, 8, 13, 21, 34))


@query("locate_entry", f"with {ENTRIES} select archive, min(idx) idx, arg_min(path, idx) path from entries where not is_dir and regexp_matches(path, '(?s)^.*/d.*\\.zip$') group by archive")
def locate_entry(spark, sf_dir):
    """The first entry of each archive that a glob names, folders apart."""
    rows = entries(spark, sf_dir, "archive", "idx", "path", "is_dir").filter(~F.col("is_dir") & T.glob(F.col("path"), "*/d*.zip", ignore_case=False))
    return rows.groupBy("archive").agg(F.min("idx").alias("idx"), F.min_by("path", "idx").alias("path"))


@query("scan_listing", f"with {ENTRIES} select entry_id, path, size from entries where not (starts_with(path, '.') or contains(path, '/.')) and not is_dir and path not in ('en/s0/d0.jpg', 'en/s1/d1.zip') and not regexp_matches(path, '\\.(app|bundle)$')")
def scan_listing(spark, sf_dir):
    """A folder's listing without packages, hidden things and paths to be ignored."""
    rows = entries(spark, sf_dir, "entry_id", "path", "size", "is_dir")
    return rows.filter(~T.hidden(F.col("path")) & ~F.col("is_dir") & ~F.col("path").isin("en/s0/d0.jpg", "en/s1/d1.zip") & ~F.col("path").rlike(r"\.(app|bundle)$")).drop("is_dir")


@query("listing_diff", "with a as (select p_partkey id, p_size was from part where p_partkey % 5 <> 0), b as (select p_partkey id, case when p_partkey % 7 = 0 then p_size + 1 else p_size end now from part where p_partkey % 4 <> 0) select coalesce(a.id, b.id) id, case when a.id is null then 'added' when b.id is null then 'removed' when was is not distinct from now then 'kept' else 'changed' end change from a full join b on a.id = b.id")
def listing_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return E.difference(part.filter("id % 5 <> 0"), part.filter("id % 4 <> 0").withColumn("p_size", F.expr("case when id % 7 = 0 then p_size + 1 else p_size end")), "id", "p_size")


@query("volume_order", f"with v as (select archive, name, size from (select source archive, concat('Vol', lpad(cast(doc_id % 50 as varchar), 2, '0'), case when doc_id % 50 = 7 then '.RAR' else '.r01' end) as name, n_chars size from documents) where regexp_matches(name, '(?i)^vol[0-9]+\\.r(ar|[0-9]+)$')) select archive, name, size, cast(row_number() over (partition by archive order by case when ends_with(lower(name), '.rar') then 0 else 1 end, lower(name), name, size) as bigint) place from v")
def volume_order(spark, sf_dir):
    """Volumes of each archive in the order in which they are read."""
    rows = table(spark, sf_dir, "documents").selectExpr("source archive", "concat('Vol', lpad(cast(doc_id % 50 as string), 2, '0'), case when doc_id % 50 = 7 then '.RAR' else '.r01' end) as name", "n_chars size").filter(F.col("name").rlike(r"(?i)^vol[0-9]+\.r(ar|[0-9]+)$"))
    return O.ranked(rows, [*E.volume_order(F.col("name"), ".rar"), F.col("size")], ["archive"], "place").withColumn("place", F.col("place").cast("long"))


@query("volume_offset", f"with {ENTRIES} select archive, idx, coalesce(size, 0) size, cast(coalesce(sum(coalesce(size, 0)) over (partition by archive order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ from entries")
def volume_offset(spark, sf_dir):
    rows = entries(spark, sf_dir, "archive", "idx", "size").withColumn("size", F.coalesce("size", F.lit(0)))
    return E.volume_offsets(rows, ["archive"], "idx", "size").withColumnRenamed("offset", "offset_")


@query("paginate", "select doc_id, cast(i as bigint) page, cast(i + 1 as varchar) as name from (select doc_id, unnest(range(0, greatest((n_chars + 999) // 1000, 1))) i from documents)")
def paginate(spark, sf_dir):
    """A node for each page of a thousand characters."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr("sequence(0, greatest((n_chars + 999) div 1000, 1) - 1)")).alias("page"))
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), (F.col("page") + 1).cast("string").alias("name"))


@query("thumb_frame", "select doc_id, cast(n_chars // 10 as bigint) frame from documents")
def thumb_frame(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("n_chars div 10").alias("frame"))


@query("save_collisions", "select count(*) n from (select distinct p_name from part where p_partkey % 2 = 0) a where p_name in (select p_name from part where p_partkey % 2 = 1)")
def save_collisions(spark, sf_dir):
    """How many names to be saved exist already."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.filter("p_partkey % 2 = 0").select("p_name").distinct().join(part.filter("p_partkey % 2 = 1").select("p_name"), "p_name", "left_semi").agg(F.count("*").alias("n"))


@query("unique_names", "with x as (select p_partkey, p_brand, concat(p_type, '.jpg') as name from part), r as (select *, row_number() over (partition by p_brand, name order by p_partkey) k from x) select p_partkey, p_brand, name, case when k = 1 then name else concat(p_type_, '-', k - 1, '.jpg') end unique_name from (select r.*, left(name, length(name) - 4) p_type_ from r)")
def unique_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "concat(p_type, '.jpg') as name")
    return O.unique_names(rows, "name", "p_partkey", ["p_brand"])


@query("entries_json", f"with {ENTRIES} select entry_id, concat('{{', case when size is not null then concat('\"size\":', size, ',') else '' end, '\"path\":\"', path, '\",\"directory\":', case when is_dir then 'true' else 'false' end, '}}') as json from entries")
def entries_json(spark, sf_dir):
    """Entries as JSON; unknown values have no key."""
    return entries(spark, sf_dir, "entry_id", "path", "size", "is_dir").select("entry_id", F.to_json(F.struct("size", "path", F.col("is_dir").alias("directory"))).alias("json"))


@query("list_short", f"with {ENTRIES} select archive, idx, concat(path, case when is_dir then '/' else '' end) line from entries")
def list_short(spark, sf_dir):
    return entries(spark, sf_dir, "archive", "idx", "path", "is_dir").select("archive", "idx", F.concat("path", F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))


_SHARE = "100 * (1 - cast(packed as double) / cast(nullif(size, 0) as double))"


@query("list_long", f"with {ENTRIES} select archive, idx, concat(lpad(cast(idx as varchar), cast(greatest(3, length(cast(idx as varchar))) as int), ' '), '. ', case when is_dir then 'D' else '-' end, case when is_resource then 'R' else '-' end, case when is_link then 'L' else '-' end, case when encrypted then 'E' else '-' end, '- ', coalesce(lpad(cast(size as varchar), cast(greatest(11, length(cast(size as varchar))) as int), ' '), ' ----------'), ' ', case when coalesce(size, 0) <> 0 and coalesce(packed, 0) <> 0 then case when {_SHARE} <= -100 then printf('%5.0f%%', {_SHARE}) else printf('%5.1f%%', {_SHARE}) end else ' -----' end, '  ', rpad('Defl', 4, ' '), '  ----------------  ', path, case when is_dir then '/' else '' end) line from entries")
def list_long(spark, sf_dir):
    """The long listing of all entries; indexes are three digits wide at least."""
    rows = entries(spark, sf_dir, "archive", "idx", "is_dir", "is_resource", "is_link", "encrypted", "size", "packed", "path")
    c = F.col
    return rows.select("archive", "idx", E.long_line(c("idx"), c("is_dir"), c("is_resource"), c("is_link"), c("encrypted"), c("size"), c("packed"), F.lit("Defl"), N.best_date(F.lit(None).cast("timestamp")), c("path")).alias("line"))


@query("label_lines", "select user_id, string_agg(concat(event_type, ': ', n), chr(10) order by event_type) text from (select user_id, event_type, count(*) n from events group by all) group by user_id")
def label_lines(spark, sf_dir):
    """'label: value' lines of each user's counts."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    lines = F.sort_array(F.collect_list(F.struct("event_type", "n")))  # as many as there are types
    return counts.groupBy("user_id").agg(lines.alias("x")).select("user_id", F.array_join(F.transform("x", lambda p: F.concat(p.event_type, F.lit(": "), p.n.cast("string"))), "\n").alias("text"))


@query("bookmark_migrate", "select p_partkey, coalesce(case when p_partkey % 3 = 0 then p_name end, case when p_partkey % 2 = 0 then p_type end, p_brand) place from part")
def bookmark_migrate(spark, sf_dir):
    """The newest of three generations of a key that is there."""
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.expr("case when p_partkey % 3 = 0 then p_name end"), F.expr("case when p_partkey % 2 = 0 then p_type end"), "p_brand").alias("place"))
