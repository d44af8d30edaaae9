"""References to records that are missing, deleted or arrive later.

Keys become 128-bit fingerprints; the space of the first 64 bits is cut into
ranges. Parents lie as sorted arrays per range, and batches of references of
the same range probe them by vectorised binary search. A range that holds too
many references (one popular parent may own a third of them) is split, and its
parents, a bounded array, are copied to each split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.sources.tables import micros, read_table

DAY_US = 24 * 3600 * 1_000_000
RESULT = "ref_table string, ref_column string, ref_key string, ref_us long, cause string"


def number_key(c: Column) -> Column:
    """Ids compared by number: ``7``, ``7.0`` and ``' 7 '`` are one key; blank is null; other text is itself."""
    text = F.trim(c.cast("string"))
    num = text.try_cast("decimal(38,6)")
    whole = F.when(num == F.floor(num), F.floor(num).cast("string"))
    return F.when(text != "", F.coalesce(whole, F.concat(F.lit("text:"), text)))


def vector_key(c: Column) -> Column:
    """Vector ids compared without letter case, outer blanks and braces; blank is null."""
    text = F.lower(F.regexp_replace(c, r"^[\s{]+|[\s}]+$", ""))
    return F.when(text != "", text)


def archive_references(spark: SparkSession, root: str) -> DataFrame:
    """(ref_table, ref_column, ref_key, ref_us, target, key) of every reference that is neither null nor blank."""

    def refs(table: str, column: str, key: Column, target: str, time: str, own: str = "id") -> DataFrame:
        return (
            read_table(spark, root, table)
            .select(F.lit(table).alias("ref_table"), F.lit(column).alias("ref_column"), F.col(own).cast("string").alias("ref_key"), micros(time).alias("ref_us"), F.lit(target).alias("target"), key.alias("key"))
            .where(F.col("key").isNotNull())
        )

    parts = [
        refs("issues", "newspaper_id", number_key(F.col("newspaper_id")), "newspapers", "created_at"),
        refs("articles", "issue_id", number_key(F.col("issue_id")), "issues", "created_at"),
        refs("article_chunks", "article_id", number_key(F.col("article_id")), "articles", "created_at"),
        refs("article_chunks", "embedding_vector_id", vector_key(F.col("embedding_vector_id")), "vector_points", "created_at"),
        refs("vector_points", "payload.article_id", number_key(F.get_json_object("payload", "$.article_id")), "articles", "upserted_at"),
        refs("entities", "canonical_id", number_key(F.col("canonical_id")), "entities", "first_seen_at"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def archive_parents(spark: SparkSession, root: str) -> DataFrame:
    """(target, key, arrival_us, has_row, deleted_us): one row per key that has a row or a deletion entry.

    A paper has no arrival. Of several arrivals or deletions of a key the last counts.
    """

    def rows(table: str, key: Column, time: str | None) -> DataFrame:
        at = micros(time) if time else F.lit(None).cast("long")
        return read_table(spark, root, table).select(F.lit(table).alias("target"), key.alias("key"), at.alias("arrival_us"), F.lit(True).alias("has_row"), F.lit(None).cast("long").alias("deleted_us"))

    log = read_table(spark, root, "deletion_log")
    key = F.when(F.col("target_table") == "vector_points", vector_key(F.col("target_key"))).otherwise(number_key(F.col("target_key")))
    deleted = log.select(F.col("target_table").alias("target"), key.alias("key"), F.lit(None).cast("long").alias("arrival_us"), F.lit(False).alias("has_row"), micros("deleted_at").alias("deleted_us"))
    out = deleted
    for table, k, time in (("newspapers", number_key(F.col("id")), None), ("issues", number_key(F.col("id")), "created_at"), ("articles", number_key(F.col("id")), "created_at"), ("vector_points", vector_key(F.col("id")), "upserted_at"), ("entities", number_key(F.col("id")), "first_seen_at")):
        out = out.unionByName(rows(table, k, time))
    return out.where(F.col("key").isNotNull()).groupBy("target", "key").agg(F.max("arrival_us").alias("arrival_us"), F.max("has_row").alias("has_row"), F.max("deleted_us").alias("deleted_us"))


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """Binary search of one range's references in its sorted parents; keeps the misses with their cause."""
    h1, h2 = parents["h1"].to_numpy(), parents["h2"].to_numpy()
    order = np.lexsort((h2, h1))
    pair = np.empty(len(h1), dtype=[("a", "i8"), ("b", "i8")])
    pair["a"], pair["b"] = h1[order], h2[order]
    r1, r2 = refs["h1"].to_numpy(), refs["h2"].to_numpy()
    n = len(pair)
    at = np.searchsorted(pair["a"], r1) if n else np.zeros(len(r1), "i8")
    hit = np.zeros(len(r1), bool)
    step = at.copy()
    live = np.arange(len(r1))
    while n and len(live):  # walks along equal first halves, of which there is nearly always one
        s = step[live]
        same = (s < n) & (pair["a"][np.minimum(s, n - 1)] == r1[live])
        live, s = live[same], s[same]
        found = pair["b"][s] == r2[live]
        hit[live[found]] = True
        at[live[found]] = s[found]
        live = live[~found]
        step[live] += 1

    def column(name: str, missing: int) -> np.ndarray:
        if not n:
            return np.full(len(r1), missing)
        values = parents[name].combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False)[order]
        return np.where(hit, values[np.minimum(at, n - 1)], missing)

    low, high = np.iinfo("i8").min, np.iinfo("i8").max
    arrival, deleted = column("arrival_us", low), column("deleted_us", low)
    has_row = (column("has_row", 0) if n else np.zeros(len(r1))).astype(bool)
    ref_us = refs["ref_us"].combine_chunks().fill_null(high).to_numpy(zero_copy_only=False)
    gone = (deleted > low) & (~has_row | (deleted >= arrival))
    late = has_row & (arrival > low) & (ref_us < high) & (arrival - np.minimum(ref_us, high - 1) > DAY_US)
    cause = np.select([~has_row & (deleted == low), gone, late], ["missing", "deleted", "late"], "")
    keep = np.flatnonzero(cause != "")
    out = refs.take(pa.array(keep)).select(["ref_table", "ref_column", "ref_key", "ref_us"])
    return out.append_column("cause", pa.array(cause[keep].astype(object), pa.string()))


def find_orphans(refs: DataFrame, parents: DataFrame, range_rows: int = 100_000, split_rows: int = 400_000) -> DataFrame:
    """One row per reference that is missing, deleted or late: ``RESULT``.

    ``missing``: no parent row and no deletion. ``deleted``: a deletion without
    a row, or at or after the arrival. ``late``: arrived more than a day after
    the reference. A parent without arrival and a reference without time are
    never late. A row that occurs again as an exact copy counts once. Empty
    parents make every reference ``missing``; empty references give no rows.

    ``range_rows`` parents are held per range; a range with more than
    ``split_rows`` references is split.
    """
    finger = lambda seed: F.xxhash64(F.lit(seed), "target", "key")
    n = max(12, -(-parents.count() // range_rows))
    span = 2**64 // n + 1
    place = F.floor((F.col("h1").cast("decimal(20,0)") + F.expr("cast(9223372036854775808 as decimal(20,0))")) / F.expr(f"cast({span} as decimal(20,0))")).cast("int")
    p = parents.select(finger(1).alias("h1"), finger(2).alias("h2"), "arrival_us", "deleted_us", F.col("has_row").cast("int").alias("has_row")).withColumn("rng", place)
    r = refs.select("ref_table", "ref_column", "ref_key", "ref_us", finger(1).alias("h1"), finger(2).alias("h2")).withColumn("rng", place)
    # one row per range, however large the tables
    splits = r.groupBy("rng").count().select("rng", F.greatest(F.lit(1), F.ceil(F.col("count") / split_rows)).cast("int").alias("splits"))
    splits = F.broadcast(splits)
    r = r.join(splits, "rng").withColumn("part", F.pmod(F.xxhash64("ref_table", "ref_column", "ref_key"), F.col("splits")).cast("int")).drop("splits")
    p = p.join(splits, "rng").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    found = r.groupBy("rng", "part").cogroup(p.groupBy("rng", "part")).applyInArrow(_probe, RESULT)
    return found.dropDuplicates(["ref_table", "ref_column", "ref_key"])


def archive_orphans(spark: SparkSession, root: str) -> DataFrame:
    return find_orphans(archive_references(spark, root), archive_parents(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return archive_orphans(spark, root).select("ref_table", "ref_column", "ref_key", "cause")


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per referring table, column, month of the referring record and cause."""
    month = F.date_format(F.timestamp_micros("ref_us"), "yyyy-MM")
    return archive_orphans(spark, root).groupBy("ref_table", "ref_column", month.alias("month"), "cause").agg(F.count("*").alias("orphans"))


_ORPHANS_SQL = r"""
with refs as (
  select 'issues' ref_table, 'newspaper_id' ref_column, cast(id as varchar) ref_key, created_at t, 'newspapers' target, cast(newspaper_id as varchar) k from issues
  union all select 'articles', 'issue_id', cast(id as varchar), created_at, 'issues', cast(issue_id as varchar) from articles
  union all select 'article_chunks', 'article_id', cast(id as varchar), created_at, 'articles', cast(article_id as varchar) from article_chunks
  union all select 'article_chunks', 'embedding_vector_id', cast(id as varchar), created_at, 'vector_points', lower(regexp_replace(embedding_vector_id, '^[\s{]+|[\s}]+$', '', 'g')) from article_chunks
  union all select 'vector_points', 'payload.article_id', id, upserted_at, 'articles', json_extract_string(payload, '$.article_id') from vector_points
  union all select 'entities', 'canonical_id', cast(id as varchar), first_seen_at, 'entities', cast(canonical_id as varchar) from entities),
r as (select distinct ref_table, ref_column, ref_key, t, target,
        case when target = 'vector_points' then k else coalesce(cast(cast(try_cast(trim(k) as double) as bigint) as varchar), 'text:' || trim(k)) end k
      from refs where k is not null and trim(k) <> ''),
tgt as (
  select 'newspapers' target, cast(id as varchar) k, null::timestamp a from newspapers
  union all select 'issues', cast(id as varchar), created_at from issues
  union all select 'articles', cast(id as varchar), created_at from articles
  union all select 'vector_points', lower(trim(id)), upserted_at from vector_points
  union all select 'entities', cast(id as varchar), first_seen_at from entities),
t1 as (select target, k, max(a) a from tgt group by all),
del as (select target_table target, lower(trim(target_key)) k, max(deleted_at) d from deletion_log group by all),
c as (select r.*, case
        when t1.k is null and del.k is null then 'missing'
        when del.k is not null and (t1.k is null or d >= a) then 'deleted'
        when a > t + interval 24 hour then 'late' end cause
      from r left join t1 using (target, k) left join del using (target, k))
"""

ORACLE = {
    "p4_found": _ORPHANS_SQL + "select ref_table, ref_column, ref_key, cause from c where cause is not null",
    "p4_report": _ORPHANS_SQL + "select ref_table, ref_column, strftime(t, '%Y-%m') as month, cause, count(*) as orphans from c where cause is not null group by all",
}
QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
