"""Trees from paths, cursors over them, and lookups in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack.functions import text as T
from leafstack.operators import trees as R
from leafstack.plans.analogs import ENTRIES, NODES, entries, table
from leafstack.registry import query


def nodes(spark, sf_dir):
    rows = entries(spark, sf_dir, "archive", "path", "entry_id", "size").withColumn("viewable", F.col("entry_id") % 4 != 0)
    return R.path_tree(rows, "archive", "path", ["entry_id", "size", "viewable"])


_ORDER = "partition by tree order by sort_path"


@query("path_tree", f"with {NODES} select tree, node, parent, name, depth, entry_id, synthetic from nodes")
def path_tree(spark, sf_dir):
    return nodes(spark, sf_dir).select("tree", "node", "parent", "name", "depth", "entry_id", "synthetic")


@query("viewable_index", f"with {NODES} select tree, node, cast(row_number() over ({_ORDER}) - 1 as bigint) view_index from nodes where viewable")
def viewable_index(spark, sf_dir):
    return R.with_index(nodes(spark, sf_dir)).select("tree", "node", F.col("view_index").cast("long").alias("view_index"))


@query("nav_next", f"with {NODES} select tree, node, lead(node) over ({_ORDER}) as next from nodes where viewable")
def nav_next(spark, sf_dir):
    return R.neighbours(nodes(spark, sf_dir)).select("tree", "node", "next")


@query("nav_prev", f"with {NODES} select tree, node, lag(node) over ({_ORDER}) as previous from nodes where viewable")
def nav_prev(spark, sf_dir):
    return R.neighbours(nodes(spark, sf_dir)).select("tree", "node", "previous")


@query("nav_next_wrap", f"with {NODES} select tree, node, coalesce(lead(node) over ({_ORDER}), first_value(node) over ({_ORDER} rows between unbounded preceding and unbounded following)) as next, coalesce(lag(node) over ({_ORDER}), last_value(node) over ({_ORDER} rows between unbounded preceding and unbounded following)) as previous from nodes where viewable")
def nav_next_wrap(spark, sf_dir):
    return R.neighbours(nodes(spark, sf_dir), wrap=True).select("tree", "node", "next", "previous")


@query("nav_first_last", f"with {NODES} select tree, arg_min(node, sort_path) as first, arg_max(node, sort_path) as last from nodes where viewable group by tree")
def nav_first_last(spark, sf_dir):
    return R.ends(nodes(spark, sf_dir))


@query("nav_after_removal", f"with {NODES}, kept as (select * from nodes where viewable and split_part(node, '/', 2) <> 's3') select tree, node, lead(node) over ({_ORDER}) as next from kept")
def nav_after_removal(spark, sf_dir):
    """The next viewable node once the folders named s3 are gone."""
    every = nodes(spark, sf_dir)
    gone = every.filter("depth = 2 and name = 's3'").select(F.col("tree").alias("t"), F.col("node").alias("top"))
    two = F.array_join(F.slice(T.components(F.col("node")), 1, 2), "/")
    left = every.join(gone, (F.col("tree") == F.col("t")) & (two == F.col("top")), "left_anti")
    return R.neighbours(left).select("tree", "node", "next")


_FOLDERS = f"with {NODES}, f as (select tree, parent, min(sort_path) sort_path, arg_min(node, sort_path) as first, arg_max(node, sort_path) as last from nodes where viewable group by all)"


@query("nav_folder_next", f"{_FOLDERS} select tree, parent, first, last, lead(first) over ({_ORDER}) next_first from f")
def nav_folder_next(spark, sf_dir):
    return R.folder_neighbours(nodes(spark, sf_dir)).select("tree", "parent", "first", "last", "next_first")


@query("nav_folder_prev", f"{_FOLDERS} select tree, parent, lag(first) over ({_ORDER}) previous_first from f")
def nav_folder_prev(spark, sf_dir):
    return R.folder_neighbours(nodes(spark, sf_dir)).select("tree", "parent", "previous_first")


@query("find_next", f"with {NODES}, v as (select *, case when contains(lower(name), '7') and list_contains(regexp_extract_all(name, '(\\d+)', 1), '77') then node end hit from nodes where viewable) select tree, node, coalesce(first_value(hit ignore nulls) over ({_ORDER} rows between 1 following and unbounded following), first_value(hit ignore nulls) over ({_ORDER} rows between unbounded preceding and 1 preceding)) found from v")
def find_next(spark, sf_dir):
    """The next node whose name holds the number 77."""
    return R.find_next(nodes(spark, sf_dir), T.matches(F.col("name"), "77")).select("tree", "node", "found")


_BENEATH = f"with {NODES}, up as (select n.*, array_to_string(list_slice(string_split(node, '/'), 1, i), '/') above from (select *, unnest(range(1, depth + 1)) i from nodes) n)"


@query("subtree_count", f"{_BENEATH} select tree, above as node, count(*) filter (where viewable) n, cast(coalesce(sum(size), 0) as bigint) total from up group by all")
def subtree_count(spark, sf_dir):
    return R.beneath(nodes(spark, sf_dir), [F.count_if("viewable").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")])


@query("count_gt", f"{_BENEATH} select tree, above as node, count(*) filter (where viewable) > 3 as over from up group by all")
def count_gt(spark, sf_dir):
    return R.counts_over(nodes(spark, sf_dir), 3).select("tree", "node", "over")


@query("any_data", f"{_BENEATH} select tree, above as node, bool_or(coalesce(size > 5000, false)) any_data, bool_or(node <> above and coalesce(entry_id % 5 = 0, false)) any_savable from up group by all")
def any_data(spark, sf_dir):
    rows = nodes(spark, sf_dir)
    up = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.array_join(F.slice(T.components(F.col("node")), F.lit(1), i), "/"))
    return rows.withColumn("above", F.explode(up)).groupBy("tree", F.col("above").alias("node")).agg(F.bool_or(F.coalesce(F.col("size") > 5000, F.lit(False))).alias("any_data"), F.bool_or((F.col("node") != F.col("above")) & F.coalesce(F.col("entry_id") % 5 == 0, F.lit(False))).alias("any_savable"))


@query("tree_parent", f"with {NODES} select n.tree, n.node, p.name parent_name, split_part(n.node, '/', 1) root from nodes n left join nodes p on n.tree = p.tree and n.parent = p.node")
def tree_parent(spark, sf_dir):
    every = nodes(spark, sf_dir)
    above = every.select("tree", F.col("node").alias("parent"), F.col("name").alias("parent_name"))
    return every.join(above, ["tree", "parent"], "left").select("tree", "node", "parent_name", T.first_component(F.col("node")).alias("root"))


@query("info_label", f"with {NODES}, v as (select *, row_number() over ({_ORDER}) k, count(*) over (partition by tree) n from nodes where viewable) select tree, node, concat(case when depth > 2 then concat(string_split(node, '/')[depth - 1], ' > ', name) else name end, ' (', k, '/', n, ')') label from v")
def info_label(spark, sf_dir):
    """'parent > name (index/count)' of viewable nodes; the parent only if it has a parent itself."""
    seen = R.with_index(nodes(spark, sf_dir)).withColumn("n", F.expr("count(*) over (partition by tree)"))
    name = F.when(F.col("depth") > 2, F.concat(F.element_at(T.components(F.col("node")), -2), F.lit(" > "), F.col("name"))).otherwise(F.col("name"))
    return seen.select("tree", "node", F.concat(name, F.lit(" ("), (F.col("view_index") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")")).alias("label"))


@query("is_descendant", f"with {NODES} select tree, node from nodes where list_slice(string_split(node, '/'), 1, 2) = ['en', 's1'] and depth > 2")
def is_descendant(spark, sf_dir):
    return nodes(spark, sf_dir).filter(T.has_prefix(F.col("node"), F.lit("en/s1")) & (F.col("node") != "en/s1")).select("tree", "node")


@query("find_node", f"with {NODES}, w as (select 'dx' k, 3 j), v as (select *, row_number() over ({_ORDER}) k from nodes) select tree, name, arg_max(node, sort_path) node from v where name in ('s1', 's2', 's3') group by tree, name")
def find_node(spark, sf_dir):
    """Where a name is found last on the walk through each tree."""
    return nodes(spark, sf_dir).filter(F.col("name").isin("s1", "s2", "s3")).groupBy("tree", "name").agg(F.max_by("node", "sort_path").alias("node"))


@query("viewable_ancestor", f"{_BENEATH}, a as (select tree, node, above, len(string_split(above, '/')) d from up), seen as (select tree, node from nodes where viewable or (entry_id is null and name <> 's3')) select a.tree, a.node, arg_max(a.above, a.d) ancestor from a join seen s on a.tree = s.tree and a.above = s.node group by all")
def viewable_ancestor(spark, sf_dir):
    """The nearest node upwards, itself included, that can be shown."""
    every = nodes(spark, sf_dir)
    up = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.struct(i.alias("d"), F.array_join(F.slice(T.components(F.col("node")), F.lit(1), i), "/").alias("above")))
    seen = every.filter("viewable or (entry_id is null and name <> 's3')").select("tree", F.col("node").alias("above"))
    rows = every.select("tree", "node", F.explode(up).alias("u")).select("tree", "node", "u.d", "u.above")
    return rows.join(seen, ["tree", "above"]).groupBy("tree", "node").agg(F.max_by("above", "d").alias("ancestor"))


@query("depth_prune", f"with {NODES} select tree, node, depth from nodes where depth <= 2")
def depth_prune(spark, sf_dir):
    return nodes(spark, sf_dir).filter("depth <= 1 + 1").select("tree", "node", "depth")


@query("common_root", f"with {ENTRIES}, p as (select archive, string_split(path, '/') p from entries where not contains(path, '/.')), d as (select archive, min(p[1:len(p)-1]) a, max(p[1:len(p)-1]) b from p group by 1) select archive, case when a = b then array_to_string(a, '/') when len(a) > 0 and len(b) > 0 and a[1] = b[1] then a[1] else '' end root from d")
def common_root(spark, sf_dir):
    return R.common_root(entries(spark, sf_dir, "archive", "path").filter(~T.hidden(F.col("path"))), "archive", "path")


@query("common_top_dir", f"with {ENTRIES}, x as (select archive, arg_min(split_part(path, '/', 1), idx) top from entries group by 1) select x.archive, case when bool_and(starts_with(e.path, concat(x.top, '/'))) then x.top end top from x join entries e on e.archive = x.archive group by x.archive, x.top")
def common_top_dir(spark, sf_dir):
    """The first entry's top folder if all entries lie in it."""
    rows = entries(spark, sf_dir, "archive", "path", "idx").withColumn("top", T.first_component(F.col("path")))
    return rows.groupBy("archive").agg(F.min("top").alias("a"), F.max("top").alias("b")).select("archive", F.expr("case when a = b then a end").alias("top"))


@query("solo_item", f"with {ENTRIES} select archive, count(distinct split_part(path, '/', 1)) = 1 solo from entries group by 1")
def solo_item(spark, sf_dir):
    rows = entries(spark, sf_dir, "archive", "path").withColumn("top", T.first_component(F.col("path")))
    return rows.groupBy("archive").agg((F.min("top") == F.max("top")).alias("solo"))


@query("lookup_id", "select c.c_custkey, n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey")
def lookup_id(spark, sf_dir):
    """A small table's names by identifier."""
    return table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")  # nations are few and fixed


@query("resumable", "select distinct user_id from events where user_id in (select c_custkey from customer)")
def resumable(spark, sf_dir):
    """Bookmarks whose target is there."""
    return table(spark, sf_dir, "events").select("user_id").distinct().join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")


@query("bookmark_valid", "select page_id, starts_with(url, 'http://') and (not contains(url, '?') or starts_with(url, concat('http', '://www.'))) valid from pages")
def bookmark_valid(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", (url.startswith("http://") & (~url.contains("?") | url.startswith("http://www."))).alias("valid"))


@query("super_url", "with recursive up as (select r_regionkey k, concat('http://', lower(r_name)) u from region) select c.c_custkey, case when c.c_custkey % 3 = 0 then concat('http://c/', c.c_custkey) when c.c_custkey % 3 = 1 then concat('http://n/', n.n_name) else up.u end url from customer c join nation n on c.c_nationkey = n.n_nationkey join up on up.k = n.n_regionkey")
def super_url(spark, sf_dir):
    """The nearest URL up a chain: an item's own, its parent's, or the root's."""
    chain = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))  # both are fixed small tables
    return chain.select("c_custkey", F.coalesce(F.expr("case when c_custkey % 3 = 0 then concat('http://c/', cast(c_custkey as string)) end"), F.expr("case when c_custkey % 3 = 1 then concat('http://n/', n_name) end"), F.concat(F.lit("http://"), F.lower("r_name"))).alias("url"))
