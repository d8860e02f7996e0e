"""Entries and nodes made of the tables of a folder: the same expressions serve Spark and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of entries over documents, in SQL that both engines read.
ENTRY = {
    "archive": "source",
    "idx": "cast(row_number() over (partition by source order by doc_id) - 1 as int)",
    "entry_id": "doc_id",
    "path": "concat(lang, case when doc_id % 9 = 0 then '/.cache' else '' end, '/s', cast(n_chars % 7 as string), '/d', cast(doc_id as string), case when doc_id % 5 = 0 then '.jpg' when doc_id % 5 = 1 then '.zip' else '.txt' end)",
    "size": "case when doc_id % 17 = 0 then null else n_chars end",
    "packed": "case when doc_id % 6 = 0 then null else cast(floor(n_chars * (1 + doc_id % 9) / 4.0) as bigint) end",
    "is_dir": "doc_id % 10 = 3",
    "is_link": "doc_id % 10 = 4",
    "is_archive": "doc_id % 5 = 1",
    "is_resource": "doc_id % 3 = 0",
    "encrypted": "doc_id % 19 = 0",
    "mode": "cast(case doc_id % 8 when 0 then 16877 when 1 then 41471 when 2 then 8612 when 3 then 25008 when 4 then 4516 when 5 then null else 33188 + doc_id % 8 end as int)",
    "dos": "cast(case when doc_id % 3 = 0 then null else doc_id % 64 end as int)",
    "windows": "cast(doc_id % 32768 as int)",
    "target": "case when doc_id % 14 = 5 then concat('../s', cast(doc_id % 7 as string)) end",
    "stem_key": "concat('e', cast(cast(floor(doc_id / 2.0) as bigint) % 40 as string))",
    "solid": "case when doc_id % 23 = 0 then null else concat('b', cast(cast(floor(doc_id / 60.0) as bigint) % 3 as string)) end",
    "kind": "lang",
}
ENTRIES = "entries as (select " + ", ".join(f"{e} as {c}" for c, e in ENTRY.items()) + " from documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Entries of archives: a document is an entry, its source the archive. columns: only these are worked out."""
    chosen = columns or tuple(ENTRY)
    return table(spark, sf_dir, "documents").selectExpr(*[f"{ENTRY[c]} as {c}" for c in chosen])


#: The natural key of a name, as the functions make it.
def natural_sql(name: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({name}), '(\d+)', '{'0' * 20}\1', 'g'), '\d*(\d{{20}})', '\1', 'g')"


#: Nodes of the trees that entries' paths make, for the checking engine.
NODES = (
    ENTRIES
    + f""", split_ as (select archive tree, list_filter(string_split(path, '/'), lambda x: x <> '') p, entry_id, size, entry_id % 4 <> 0 as viewable from entries),
prefix as (select distinct tree, p[1:i] p from (select tree, p, unnest(range(1, len(p) + 1)) i from split_)),
nodes as (select x.tree, array_to_string(x.p, '/') node, case when len(x.p) > 1 then array_to_string(x.p[1:len(x.p)-1], '/') end parent, x.p[len(x.p)] as name, cast(len(x.p) as int) depth,
  list_transform(x.p, lambda c: concat({natural_sql('c')}, chr(1), c)) sort_path, s.entry_id, s.size, s.viewable, s.entry_id is null synthetic
  from prefix x left join split_ s on x.tree = s.tree and x.p = s.p)"""
)
