"""Ingest and mutation plans: each returns the new rows of a table, to be written in place of the old."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarto.functions.dates import date_int
from quarto.session import ensure_checkpoint_dir
from quarto.sources.archive import SQL, Archive


def pdf_intake(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of the PDF files of a folder, those within ZIP files included.

    Folders, resource forks and files without the PDF mark are left out.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            out = []
            for name, content in zip(b.path, b.content):
                files = [(name.rsplit("/", 1)[-1], bytes(content))]
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        files = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX")]
                out += [(n, hashlib.sha256(c).hexdigest(), len(c)) for n, c in files if n.lower().endswith(".pdf") and c[:5] == b"%PDF-"]
            yield pd.DataFrame(out, columns=["name", "sha256", "bytes"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(expand, "name string, sha256 string, bytes long")


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """S3: incoming rows whose natural key is new; all of them with ``force``, which replaces the old."""
    return incoming if force else incoming.join(existing.select(*keys), keys, "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row written last; the new side wins a tie."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_side"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_side")


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The table without the rows of the ids."""
    return table.join(ids.select(key), key, "left_anti")


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The table with new values where the condition holds; null conditions change nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def get_or_create(dimension: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """The dimension with a row for every name; new ids go on from the largest, in the order of names."""
    ensure_checkpoint_dir(names.sparkSession)
    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(dimension.select(name), name, "left_anti")
    new = new.orderBy(name).withColumn("_p", F.spark_partition_id()).checkpoint()  # ranges of names, numbered one after another
    before = new.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_b", F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # one row per range
    top = dimension.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    add = new.join(F.broadcast(before.select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))), "_p").crossJoin(F.broadcast(top))  # one row
    at = F.row_number().over(Window.partitionBy("_p").orderBy(name))
    return dimension.select(key, name).unionByName(add.select((F.col("top") + F.col("_b") + at).cast("long").alias(key), name))


def delete_issue(ar: Archive, issue_id: int) -> dict[str, DataFrame]:
    """Every table without an issue and what hangs on it.

    Pages take their stories and raw items along, articles their chunks, and
    chunks their vectors unless a chunk that stays has the same one.
    """
    gone_articles = ar.articles.where(F.col("issue_id") == issue_id).select(F.col("id").alias("article_id"))
    gone_pages = ar.table("page_layouts").where(F.col("issue_id") == issue_id).select("layout_id")
    vector = F.lower(F.trim(F.translate("embedding_vector_id", "{}", ""))).alias("id")
    chunks = ar.chunks.join(gone_articles, "article_id", "left_anti")
    gone_vectors = ar.chunks.join(gone_articles, "article_id", "left_semi").select(vector).where("id <> ''").join(chunks.select(vector), "id", "left_anti").distinct()
    return {
        "issues": ar.issues.where(F.col("id") != issue_id),
        "articles": ar.articles.where(F.coalesce(F.col("issue_id") != issue_id, F.lit(True))),
        "article_chunks": chunks,
        "vector_points": ar.vectors.join(gone_vectors, "id", "left_anti"),
        "page_layouts": ar.table("page_layouts").where(F.coalesce(F.col("issue_id") != issue_id, F.lit(True))),
        "article_skeletons": ar.table("article_skeletons").dropDuplicates(["skeleton_id"]).join(gone_pages, "layout_id", "left_anti"),
        "parsed_items": ar.table("parsed_items").dropDuplicates(["item_id"]).join(gone_pages, "layout_id", "left_anti"),
    }


def remaining_rows(ar: Archive, issue_id: int) -> DataFrame:
    """(name, id) of every row that stays when an issue is deleted."""
    keys = {"page_layouts": "layout_id", "article_skeletons": "skeleton_id", "parsed_items": "item_id"}
    out = None
    for name, df in delete_issue(ar, issue_id).items():
        part = df.select(F.lit(name).alias("name"), F.col(keys.get(name, "id")).cast("string").alias("id"))
        out = part if out is None else out.unionAll(part)
    return out


def purge_page(ar: Archive, issue_id: int, page: int) -> DataFrame:
    """(article_id, action) of the stories on a page: deleted if they have no other page, else only unmapped."""
    p = ar.story_pages.where(F.col("issue_id") == issue_id)
    on = p.where(F.col("page_number") == page).select("article_id")
    n = p.join(on, "article_id", "left_semi").groupBy("article_id").agg(F.count_if(F.col("page_number") != page).alias("others"))
    return n.select("article_id", F.when(F.col("others") > 0, "unmap").otherwise("delete").alias("action"))


def backfill_dates(ar: Archive) -> DataFrame:
    """(id, issue_date_int) of vector payloads with a date."""
    d = F.try_to_date(F.get_json_object("payload", "$.issue_date"), "yyyy-MM-dd")
    return ar.vectors.select("id", date_int(d).alias("issue_date_int")).where("issue_date_int is not null")


def rename_paper(ar: Archive, old: str, new: str) -> DataFrame:
    """(id, newspaper_name) of the vectors after a paper is renamed."""
    v = ar.vectors.select("id", F.get_json_object("payload", "$.newspaper_name").alias("newspaper_name"))
    return update_where(v, F.col("newspaper_name") == old, {"newspaper_name": F.lit(new)})


def cached(cache: DataFrame, now_us: int, ttl_seconds: int = 3600) -> DataFrame:
    """The live entry of each key: written last, within its time to live. ``cache``: key, value, written_us."""
    w = Window.partitionBy("key").orderBy(F.desc("written_us"))
    live = cache.where(F.col("written_us") + ttl_seconds * 1_000_000 > now_us)
    return live.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def history(log: DataFrame, limit: int = 20) -> DataFrame:
    """The latest log rows, with the number of citations of a JSON list or of its ``citations``."""
    n = F.coalesce(F.json_array_length("citations"), F.json_array_length(F.get_json_object("citations", "$.citations")), F.lit(0))
    return log.orderBy(F.desc("at"), F.desc("id")).limit(limit).select("id", "query", n.alias("citations_count"), "at")


def schema_rows(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    """(table, column, type) of the tables' schemas."""
    rows = [(t, f.name, f.dataType.simpleString()) for t in tables for f in spark.read.parquet(f"{root}/{t}.parquet").schema]
    return spark.createDataFrame(rows, "table string, column string, type string")


def export_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON files, one folder per issue."""
    rows.write.mode("overwrite").partitionBy("issue_id").json(path)


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that the rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _q(f):
    return lambda spark, root: f(Archive(spark, root))


def _old_new(ar: Archive) -> tuple[DataFrame, DataFrame]:
    v = ar.vectors.select("id", F.get_json_object("payload", "$.section").alias("section"), "upserted_at")
    return v.where("upserted_at < timestamp_ntz'2025-01-01'"), v.select("id", F.lit("again").alias("section"), F.expr("upserted_at + interval 1 day").alias("upserted_at")).where("section is not null and upserted_at >= timestamp_ntz'2024-12-01'")


QUERIES = {
    "s03_new_issues": _q(lambda ar: new_rows(ar.issues.where("ingestion_status = 'pending'").select("newspaper_id", "issue_date", "edition"), ar.issues.where("ingestion_status = 'ready'").select("newspaper_id", "issue_date", "edition"), ["newspaper_id", "issue_date", "edition"])),
    "s05_upsert_latest": _q(lambda ar: upsert_latest(*_old_new(ar), "id", "upserted_at")),
    "s06_delete_vectors": _q(lambda ar: delete_ids(ar.vectors.select("id"), ar.table("deletion_log").where("target_table = 'vector_points'").select(F.lower("target_key").alias("id")), "id")),
    "s07_backfill_dates": _q(backfill_dates),
    "s10_history": _q(lambda ar: history(ar.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("query"), F.lit('{"citations": [1, 2]}').alias("citations"), F.col("ts").alias("at")))),
    "s12_delete_issue": _q(lambda ar: remaining_rows(ar, 58)),
    "s13_purge_page": _q(lambda ar: purge_page(ar, 301, 12)),
    "s15_schema": lambda spark, root: schema_rows(spark, root, ["articles", "issues", "newspapers"]),
    "s18_rename_paper": _q(lambda ar: rename_paper(ar, "Ostelby Ledger", "Ostelby Post")),
    "s19_get_or_create": _q(lambda ar: get_or_create(ar.newspapers.select("id", "name"), ar.table("page_layouts").select(F.trim("newspaper_brand").alias("name")).where("name <> ''"), "name", "id")),
}

ORACLE = {
    "s03_new_issues": "select newspaper_id, issue_date, edition from (select distinct * from issues where ingestion_status = 'pending') p where not exists (select 1 from issues r where r.ingestion_status = 'ready' and r.newspaper_id = p.newspaper_id and r.issue_date = p.issue_date and r.edition = p.edition)",
    "s05_upsert_latest": """with v as (select distinct id, json_extract_string(payload, '$.section') section, upserted_at from vector_points), b as (select *, 0 s from v where upserted_at < timestamp '2025-01-01'
        union all select id, 'again', upserted_at + interval 1 day, 1 from v where upserted_at + interval 1 day >= timestamp '2024-12-01')
        select id, section, upserted_at from (select *, row_number() over (partition by id order by upserted_at desc, s desc) r from b) where r = 1""",
    "s06_delete_vectors": "select distinct id from vector_points where id not in (select lower(target_key) from deletion_log where target_table = 'vector_points')",
    "s07_backfill_dates": "select distinct id, cast(strftime(try_cast(json_extract_string(payload, '$.issue_date') as date), '%Y%m%d') as integer) issue_date_int from vector_points where try_cast(json_extract_string(payload, '$.issue_date') as date) is not null",
    "s10_history": "select event_id id, event_type query, cast(2 as integer) citations_count, ts as at from events order by ts desc, event_id desc limit 20",
    "s12_delete_issue": """with a as (select distinct id, issue_id from articles), g as (select id article_id from a where issue_id = 58), c as (select distinct id, article_id, lower(trim(translate(embedding_vector_id, '{}', ''))) v from article_chunks), k as (select * from c where article_id is null or article_id not in (select article_id from g)), p as (select layout_id from page_layouts where issue_id = 58)
        select 'issues' as name, cast(id as varchar) id from (select distinct id from issues where id <> 58) union all select 'articles', cast(id as varchar) from a where issue_id is distinct from 58 union all select 'article_chunks', cast(id as varchar) from (select distinct id from k)
        union all select 'vector_points', id from (select distinct id from vector_points) where id not in (select v from c where article_id in (select article_id from g) and v <> '') or id in (select v from k where v <> '')
        union all select 'page_layouts', cast(layout_id as varchar) from page_layouts where issue_id is distinct from 58
        union all select 'article_skeletons', cast(skeleton_id as varchar) from (select distinct skeleton_id, layout_id from article_skeletons) where layout_id is null or layout_id not in (select layout_id from p)
        union all select 'parsed_items', cast(item_id as varchar) from (select distinct item_id, layout_id from parsed_items) where layout_id is null or layout_id not in (select layout_id from p)""",
    "s13_purge_page": SQL + "select article_id, case when count(*) filter (page_number <> 12) > 0 then 'unmap' else 'delete' end action from story_pages where issue_id = 301 and article_id in (select article_id from story_pages where issue_id = 301 and page_number = 12) group by 1",
    "s18_rename_paper": "select distinct id, case when n = 'Ostelby Ledger' then 'Ostelby Post' else n end newspaper_name from (select id, json_extract_string(payload, '$.newspaper_name') n from vector_points)",
    "s19_get_or_create": "with n as (select distinct trim(newspaper_brand) as name from page_layouts where trim(newspaper_brand) <> ''), m as (select name from n where name not in (select name from newspapers)) select id, name from newspapers union all select (select max(id) from newspapers) + row_number() over (order by name), name from m",
}

ORACLE["s15_schema"] = "select table_name as \"table\", column_name as \"column\", case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'DATE' then 'date' when 'TIMESTAMP' then 'timestamp_ntz' else lower(data_type) end as \"type\" from duckdb_columns() where table_name in ('articles', 'issues', 'newspapers')"
