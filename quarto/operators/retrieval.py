"""Retrieval: exact dense search, BM25, reciprocal-rank fusion, reranking, and its evaluation.

All routines take a table of queries, so one job answers many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarto.operators.orphans import number_key
from quarto.sources.archive import SQL, Archive

RRF_K, DENSE, SPARSE, BONUS = 60, 0.5, 0.5, 0.15
#: Queries that are searched against all points at once; more are searched in further blocks.
BLOCK = 2000


def valid_vectors(points: DataFrame, size: int = 128) -> DataFrame:
    """(id, vector) of vectors of the wished length that are not all zero."""
    return points.where((F.size("vector") == size) & F.exists("vector", lambda x: x != 0)).select("id", "vector")


def dense_search(queries: DataFrame, points: DataFrame, k: int = 10, threshold: float = 0.15) -> DataFrame:
    """(query_id, id, score, rank): per query the k points of highest cosine, the query's own point left out.

    ``queries``: query_id, vector. Queries are broadcast in blocks of BLOCK;
    each partition of the points keeps its own k best, and the best of those
    are ranked, so what is shuffled is k rows per query and partition. Scores
    are rounded to 6 digits; equal ones are ordered by id.
    """
    rows = queries.select("query_id", "vector").dropDuplicates(["query_id"])
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        mine = sorted((r["query_id"], r["vector"]) for r in rows.where(F.col("block") == b).collect())
        shared = queries.sparkSession.sparkContext.broadcast(([q for q, _ in mine], np.array([v for _, v in mine], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            if not len(names):
                return
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            best: list[list] = [[] for _ in names]
            for t in batches:
                if not t.num_rows:
                    continue
                ids = np.array(t.column(0).to_pylist(), object)
                x = t.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                s = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                keep = min(k + 1, len(ids))
                for i, name in enumerate(names):
                    cut = np.partition(s[i], len(ids) - keep)[len(ids) - keep]
                    new = [(-s[i, j], ids[j]) for j in np.flatnonzero(s[i] >= max(cut, threshold)) if ids[j] != name]
                    best[i] = sorted(best[i] + new)[:k]
            out = [(names[i], d, -s) for i, rows in enumerate(best) for s, d in rows]
            cols = list(zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["query_id", "id", "score"])

        part = points.select("id", "vector").mapInArrow(run, "query_id string, id string, score double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tokens(c: Column) -> Column:
    """Lower-case ASCII words of three characters and more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3)


def postings(docs: DataFrame, key: str, text: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, dl) of each document, of the ``wanted`` terms only if given, which are cut before they are counted."""
    t = docs.select(F.col(key), tokens(text).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    if wanted is not None:
        t = t.join(wanted, "term", "left_semi")
    return t.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def bm25_scores(queries: DataFrame, docs: DataFrame, key: str, text: Column, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) by BM25 of every document that holds a query word; scores have 9 digits."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    size = docs.select(F.size(tokens(text)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    p = postings(docs, key, text, terms.select("term").distinct())
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    s = p.join(terms, "term").join(df, "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return s.groupBy("query_id", key).agg(F.round(F.sum(part), 9).alias("score"))


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: Column, k: int = 30) -> DataFrame:
    """(query_id, key, score, rank) of the k best by BM25; ``queries``: query_id, query. Equal scores go by key."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return bm25_scores(queries, docs, key, text).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(query_id, article_id, rrf_score, vector_rank, keyword_rank, vector_hits).

    ``dense``: query_id, article_id, rank of chunks; ``sparse``: of articles.
    The first chunk of an article gives w / (k + rank), its second to fourth
    0.15 of that, the keyword list w / (k + rank) once.
    """
    nth = F.row_number().over(Window.partitionBy("query_id", "article_id").orderBy("rank"))
    part = DENSE / (RRF_K + F.col("rank"))
    d = dense.where("article_id is not null").withColumn("nth", nth).withColumn("s", F.when(F.col("nth") == 1, part).when(F.col("nth") <= 4, BONUS * part).otherwise(0.0))
    d = d.select("query_id", "article_id", "s", F.col("rank").alias("v"), F.lit(None).cast("int").alias("k"))
    s = sparse.select("query_id", "article_id", (SPARSE / (RRF_K + F.col("rank"))).alias("s"), F.lit(None).cast("int").alias("v"), F.col("rank").alias("k"))
    g = d.unionByName(s).groupBy("query_id", "article_id")
    return g.agg(F.round(F.sum("s"), 6).alias("rrf_score"), F.min("v").alias("vector_rank"), F.min("k").alias("keyword_rank"), F.count("v").alias("vector_hits"))


def rerank(fused: DataFrame, queries: DataFrame, articles: DataFrame, pool: int = 16, strict: bool = False) -> DataFrame:
    """(query_id, article_id, rerank_score): 0.6 word overlap + 0.3 fused score + 0.1 prominence, over the best ``pool`` of each query.

    A single candidate used to keep its fused score, which ``strict`` repeats;
    otherwise it is scored like the rest.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "article_id")
    c = fused.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool)
    c = c.join(queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("q")), "query_id")
    # only the articles of the pools, and their text is tokenised behind the join
    mine = articles.join(c.select("article_id").distinct(), "article_id", "left_semi")
    c = c.join(mine.select("article_id", F.concat_ws(" ", "headline", "full_text").alias("text"), F.col("prominence_score").alias("p")), "article_id")
    c = c.withColumn("d", F.array_distinct(tokens(F.col("text"))))
    overlap = F.size(F.array_intersect("q", "d")) / F.greatest(F.lit(1), F.size("q"))
    score = F.round(0.6 * overlap + 0.3 * F.col("rrf_score") + 0.1 * F.least(F.lit(1.0), F.col("p")), 4)
    if strict:
        score = F.when(F.count("*").over(Window.partitionBy("query_id")) == 1, F.col("rrf_score")).otherwise(score)
    return c.select("query_id", "article_id", score.alias("rerank_score"))


def clean_query(c: Column) -> Column:
    """R2: a quoted phrase of 8 to 150 characters, else the text without words about the archive, dates and page references."""
    noise = r"(?i)\b(?:explain|summari[sz]e|tell\s+me\s+about|what\s+happened|article|story|headline|newspaper|broadsheet|edition|dated?|published\s+on|page\s*\d+|pg\s*\d+|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})\b"
    quoted = F.trim(F.regexp_extract(c, "[\"“']([^\"”']{8,150})[\"”']", 1))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, noise, " "), r"\s+", " "), "^[ ?.!,'\"“”]+|[ ?.!,'\"“”]+$", "")
    return F.when(quoted != "", quoted).when(F.length(plain) >= 2, plain).otherwise(F.trim(c))


def snippet(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Up to two chunk texts and 1800 characters of the article, per article."""
    two = chunks.groupBy("article_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text"))), lambda x: x["text"]), 1, 2).alias("t"))
    return articles.join(two, "article_id").select("article_id", F.concat_ws("\n\n", F.array_join("t", "\n\n"), F.substring("full_text", 1, 1800)).alias("snippet"))


def query_set(ar: Archive) -> DataFrame:
    """(query_id, vector, query): the points of old searches with the section of their payload as text."""
    ids = ar.table("vector_hits").select(F.lower("query_id").alias("id")).distinct()
    v = ar.vectors.join(ids, "id", "left_semi")
    return v.join(valid_vectors(v).select("id"), "id").select(F.col("id").alias("query_id"), "vector", F.get_json_object("payload", "$.section").alias("query"))


def dense_hits(ar: Archive, k: int = 30) -> DataFrame:
    return dense_search(query_set(ar), valid_vectors(ar.vectors), k)


def keyword_hits(ar: Archive, k: int = 30) -> DataFrame:
    docs = ar.articles.withColumnRenamed("id", "article_id")
    return bm25(query_set(ar).where("query is not null"), docs, "article_id", F.concat_ws(" ", "headline", "full_text"), k)


def hybrid(ar: Archive) -> DataFrame:
    owner = ar.vectors.select("id", number_key(F.get_json_object("payload", "$.article_id")).try_cast("long").alias("article_id"))
    return fuse(dense_hits(ar).join(owner, "id"), keyword_hits(ar))


def reranked(ar: Archive) -> DataFrame:
    q = query_set(ar).where("query is not null")
    return rerank(hybrid(ar), q, ar.articles.withColumnRenamed("id", "article_id"))


def ranked_metrics(retrieved: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """E1 to E4 per query: recall, precision, reciprocal rank and NDCG at k.

    ``retrieved``: query_id, id, rank; ``truth``: query_id, id. A query without
    truth has recall 1 if nothing was retrieved, else 0; precision divides by
    what was retrieved, k at most.
    """
    t = truth.select("query_id", "id").distinct()
    hit = retrieved.join(t.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    near = F.col("rank") <= k
    h = hit.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(F.when(near, F.col("hit"))).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(near & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    g = t.groupBy("query_id").agg(F.count("*").alias("m"))
    x = h.join(g, "query_id", "full_outer").na.fill(0, ["n", "hits", "m"]).na.fill(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("m").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    r = lambda c, name: F.round(c, 6).alias(name)
    return x.select(
        "query_id", r(F.when(F.col("m") == 0, F.when(F.col("n") == 0, 1.0).otherwise(0.0)).otherwise(F.col("hits") / F.col("m")), "recall"), r(F.when((F.col("n") == 0) | (F.col("m") == 0), 0.0).otherwise(F.col("hits") / F.least(F.lit(k), F.col("n"))), "precision"),
        r(F.coalesce(1 / F.col("first"), F.lit(0.0)), "reciprocal_rank"), r(F.when(F.col("m") == 0, 0.0).otherwise(F.col("dcg") / ideal), "ndcg"),
    )


def citation_metrics(cited: DataFrame, truth: DataFrame) -> DataFrame:
    """E5 per query: citation precision and recall; without citations precision is 1 only if there is no truth, without truth recall is 1."""
    c, t = cited.select("query_id", "id").distinct(), truth.select("query_id", "id").distinct()
    both = c.join(t, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("b"))
    n = c.groupBy("query_id").agg(F.count("*").alias("c")).join(t.groupBy("query_id").agg(F.count("*").alias("t")), "query_id", "full_outer").join(both, "query_id", "left").na.fill(0)
    p = F.when(F.col("c") == 0, F.when(F.col("t") == 0, 1.0).otherwise(0.0)).otherwise(F.col("b") / F.col("c"))
    r = F.when(F.col("t") == 0, 1.0).otherwise(F.col("b") / F.col("t"))
    return n.select("query_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


_FAITH_STOP = ["that", "with", "this", "from", "were", "have", "been", "their", "which"]


def faithfulness(answers: DataFrame) -> DataFrame:
    """(key, faithfulness): share of the answer's sentences of which half the words stand in the context.

    ``answers``: key, answer, context. Sentences of ten characters and less
    and words of less than four do not count; no sentence gives 1, an empty
    answer or context 0.
    """
    sent = F.filter(F.transform(F.split("answer", r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    words = lambda s: F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-zA-Z0-9_-]{4,}"), F.lit(0)), lambda w: ~w.isin(_FAITH_STOP))
    context = F.lower("context")
    share = lambda ws: F.size(F.filter(ws, lambda w: F.instr(context, w) > 0)) >= 0.5 * F.size(ws)
    x = answers.withColumn("w", F.transform(sent, words))
    ok = F.size(F.filter("w", lambda ws: (F.size(ws) == 0) | share(ws)))
    value = F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", 0.0).when(F.coalesce(F.col("context"), F.lit("")) == "", 0.0).when(F.size("w") == 0, 1.0).otherwise(ok / F.size("w"))
    return x.select("key", F.round(value, 6).alias("faithfulness"))


def coverage_f1(rows: DataFrame) -> DataFrame:
    """(key, coverage_f1): mean of the F1 of covered and of omitted names; an empty denominator counts as 1.

    ``rows``: key, name, predicted, truth (booleans: covered or omitted).
    """

    def f1(tp: Column, fp: Column, fn: Column) -> Column:
        p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
        r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
        return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)

    n = lambda a, b: F.count_if((F.col("predicted") == a) & (F.col("truth") == b))
    g = rows.groupBy("key").agg(n(True, True).alias("tt"), n(True, False).alias("tf"), n(False, True).alias("ft"), n(False, False).alias("ff"))
    c = [F.col(x) for x in ("tt", "tf", "ft", "ff")]
    return g.select("key", F.round((f1(c[0], c[1], c[2]) + f1(c[3], c[2], c[1])) / 2, 6).alias("coverage_f1"))


def _truth(ar: Archive) -> DataFrame:
    return ar.table("vector_hits").where("score >= 0.5").select(F.lower("query_id").alias("query_id"), F.lower("id").alias("id")).join(query_set(ar).select("query_id"), "query_id", "left_semi")


def _faith(ar: Archive) -> DataFrame:
    context = ar.chunks.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", F.coalesce("raw_text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("context"))
    a = ar.articles.select(F.col("id").alias("article_id"), F.col("full_text").alias("answer"))
    return faithfulness(a.join(context, "article_id").withColumnRenamed("article_id", "key"))


def _coverage(ar: Archive) -> DataFrame:
    d = ar.dated_articles.where("section is not null")
    y = lambda year: d.where(F.year("issue_date") == year).select(F.col("section").alias("key"), F.col("newspaper").alias("name")).distinct()
    grid = d.select(F.col("section").alias("key")).distinct().crossJoin(F.broadcast(ar.newspapers.select("name").distinct()))  # sections by papers: both fixed lists
    mark = lambda df, c: df.withColumn(c, F.lit(True))
    return coverage_f1(grid.join(mark(y(2024), "predicted"), ["key", "name"], "left").join(mark(y(2025), "truth"), ["key", "name"], "left").na.fill(False))


def _rows(f):
    return lambda spark, root: f(Archive(spark, root))


QUERIES = {
    "r01_dense_search": _rows(lambda ar: dense_hits(ar, 10)),
    "r02_clean_query": _rows(lambda ar: ar.articles.select(F.col("id").alias("article_id"), clean_query(F.concat(F.lit("Tell me about the story "), F.coalesce("headline", F.lit("")), F.lit(" on page 3 dated 2024-05-01?"))).alias("query"))),
    "r03_bm25": _rows(keyword_hits),
    "r05_rrf": _rows(hybrid),
    "r07_snippet": _rows(lambda ar: snippet(ar.chunks, ar.articles.withColumnRenamed("id", "article_id"))),
    "r08_rerank": _rows(reranked),
    "e01_ranked_metrics": _rows(lambda ar: ranked_metrics(dense_hits(ar, 10), _truth(ar), 5)),
    "e05_citation_metrics": _rows(lambda ar: citation_metrics(dense_hits(ar, 10).where("rank <= 3"), _truth(ar))),
    "e06_faithfulness": _rows(_faith),
    "e07_coverage_f1": _rows(_coverage),
}

_VALID = "len(vector) = 128 and len(list_filter(vector, lambda x: x <> 0)) > 0"
_Q = f"""{SQL}, v_ as (select id, any_value(vector) vector, any_value(payload) payload from vector_points group by 1),
ok_ as (select * from v_ where {_VALID}),
q_ as (select id query_id, cast(vector as double[]) qv, json_extract_string(payload, '$.section') query from ok_ where id in (select lower(query_id) from vector_hits)),
sc_ as (select query_id, id, round(list_cosine_similarity(qv, cast(vector as double[])), 6) score from q_, ok_ where id <> query_id),
dense_ as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as "rank" from sc_ where score >= 0.15)
"""
_BM = _Q + """, dt as (select article_id, list_filter(regexp_extract_all(lower(concat_ws(' ', headline, full_text)), '[a-z0-9]+'), lambda t: length(t) >= 3) t from a_),
post as (select article_id, len(t) dl, unnest(t) term from dt), tf as (select term, article_id, dl, count(*) tf from post group by all),
dfq as (select term, count(*) df from tf group by 1), st as (select count(*) n, avg(len(t)) avgdl from dt),
qt as (select distinct query_id, unnest(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) >= 3)) term from q_ where query is not null),
bm as (select query_id, article_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) score from qt join tf using (term) join dfq using (term), st group by 1, 2),
kw as (select *, row_number() over (partition by query_id order by score desc, article_id) as "rank" from bm)
"""
_RRF = _BM + """, own as (select id, try_cast(cast(try_cast(trim(json_extract_string(payload, '$.article_id')) as double) as bigint) as bigint) article_id from v_),
dd as (select query_id, article_id, "rank" r, row_number() over (partition by query_id, article_id order by "rank") nth from dense_ join own using (id) where "rank" <= 30 and article_id is not null),
un as (select query_id, article_id, case when nth = 1 then 0.5::double / (60 + r) when nth <= 4 then 0.15::double * (0.5::double / (60 + r)) else 0 end s, r v, null k from dd
       union all select query_id, article_id, 0.5::double / (60 + "rank"), null, "rank" from kw where "rank" <= 30),
rrf as (select query_id, article_id, round(sum(s), 6) rrf_score, cast(min(v) as integer) vector_rank, cast(min(k) as integer) keyword_rank, count(v) vector_hits from un group by 1, 2)
"""
_TRUTH = ", truth as (select distinct lower(query_id) query_id, lower(id) id from vector_hits where score >= 0.5 and lower(query_id) in (select query_id from q_))"

ORACLE = {
    "r02_clean_query": SQL + r""", x as (select article_id, 'Tell me about the story ' || coalesce(headline, '') || ' on page 3 dated 2024-05-01?' c from a_),
        y as (select *, trim(regexp_extract(c, '["“'']([^"”'']{8,150})["”'']', 1)) qt, regexp_replace(regexp_replace(regexp_replace(c, '(?i)\b(?:explain|summari[sz]e|tell\s+me\s+about|what\s+happened|article|story|headline|newspaper|broadsheet|edition|dated?|published\s+on|page\s*\d+|pg\s*\d+|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})\b', ' ', 'g'), '\s+', ' ', 'g'), '^[ ?.!,''"“”]+|[ ?.!,''"“”]+$', '', 'g') p from x)
        select article_id, case when qt <> '' then qt when length(p) >= 2 then p else trim(c) end query from y""".replace("\\\\", "\\"),
    "e06_faithfulness": SQL + r""", c as (select distinct id, article_id, chunk_index, coalesce(raw_text, '') t from article_chunks), k as (select article_id, lower(string_agg(t, ' ' order by chunk_index, id)) ctx from c group by 1),
        s as (select article_id, ctx, full_text, list_filter(list_transform(regexp_split_to_array(full_text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) > 10) s from a_ join k using (article_id)),
        w as (select *, list_transform(s, lambda x: list_filter(regexp_extract_all(lower(x), '[a-zA-Z0-9_-]{4,}'), lambda y: y not in ('that', 'with', 'this', 'from', 'were', 'have', 'been', 'their', 'which'))) w from s)
        select article_id as key, round(case when trim(coalesce(full_text, '')) = '' or ctx = '' then 0 when len(w) = 0 then 1 else len(list_filter(w, lambda ws: len(ws) = 0 or len(list_filter(ws, lambda y: contains(ctx, y))) >= 0.5 * len(ws))) / len(w) end, 6) faithfulness from w""".replace("\\\\", "\\"),
    "r01_dense_search": _Q + 'select query_id, id, score, cast("rank" as integer) as "rank" from dense_ where "rank" <= 10',
    "r03_bm25": _BM + 'select query_id, article_id, score, cast("rank" as integer) as "rank" from kw where "rank" <= 30',
    "r05_rrf": _RRF + "select * from rrf",
    "r07_snippet": SQL + r""", c as (select article_id, text, row_number() over (partition by article_id order by chunk_index, id) r from (select distinct id, article_id, chunk_index, text from article_chunks)),
        t as (select article_id, string_agg(text, chr(10) || chr(10) order by r) t from c where r <= 2 group by 1) select article_id, concat_ws(chr(10) || chr(10), t, substr(full_text, 1, 1800)) snippet from a_ join t using (article_id)""",
    "r08_rerank": _RRF + """, pool as (select * from (select *, row_number() over (partition by query_id order by rrf_score desc, article_id) p from rrf) where p <= 16),
        x as (select pool.query_id, pool.article_id, rrf_score, prominence_score, list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) >= 3)) q, list_distinct(t) d
              from pool join q_ using (query_id) join dt using (article_id) join a_ using (article_id) where query is not null)
        select query_id, article_id, round(0.6::double * (len(list_intersect(q, d)) / greatest(1, len(q))) + 0.3::double * rrf_score + 0.1::double * least(1.0, prominence_score), 4) rerank_score from x""",
    "e01_ranked_metrics": _Q + _TRUTH + """, ret as (select query_id, id, "rank" r from dense_ where "rank" <= 10),
        h as (select query_id, count(*) n, count(t.id) filter (r <= 5) hits, min(r) filter (t.id is not null) f, coalesce(sum(1 / log2(r + 1)) filter (r <= 5 and t.id is not null), 0) dcg from ret left join truth t using (query_id, id) group by 1),
        g as (select query_id, count(*) m from truth group by 1)
        select coalesce(h.query_id, g.query_id) query_id, round(case when coalesce(m, 0) = 0 then case when coalesce(n, 0) = 0 then 1 else 0 end else coalesce(hits, 0) / m end, 6) recall,
          round(case when coalesce(n, 0) = 0 or coalesce(m, 0) = 0 then 0 else hits / least(5, n) end, 6) as "precision", round(coalesce(1 / f, 0), 6) reciprocal_rank,
          round(case when coalesce(m, 0) = 0 then 0 else coalesce(dcg, 0) / (select sum(1 / log2(i + 1)) from range(1, cast(least(5, m) as bigint) + 1) t(i)) end, 6) ndcg
        from h full join g on h.query_id = g.query_id""",
    "e05_citation_metrics": _Q + _TRUTH + """, c as (select query_id, id from dense_ where "rank" <= 3), nc as (select query_id, count(*) c from c group by 1), nt as (select query_id, count(*) t from truth group by 1),
        nb as (select query_id, count(*) b from c join truth using (query_id, id) group by 1), j as (select coalesce(nc.query_id, nt.query_id) query_id, coalesce(c, 0) c, coalesce(t, 0) t from nc full join nt on nc.query_id = nt.query_id)
        select query_id, round(case when c = 0 then case when t = 0 then 1 else 0 end else coalesce(b, 0) / c end, 6) as "precision", round(case when t = 0 then 1 else coalesce(b, 0) / t end, 6) recall from j left join nb using (query_id)""",
    "e07_coverage_f1": SQL + """, g as (select s.section as key, n_.newspaper as name, bool_or(year(issue_date) = 2024) p, bool_or(year(issue_date) = 2025) t from (select distinct section from dated_articles where section is not null) s, n_
        left join dated_articles d on d.section = s.section and d.newspaper = n_.newspaper group by 1, 2),
        c as (select key, count(*) filter (p and t) tt, count(*) filter (p and not coalesce(t, false)) tf, count(*) filter (not coalesce(p, false) and t) ft, count(*) filter (not coalesce(p, false) and not coalesce(t, false)) ff from g group by 1),
        r as (select key, case when tt + tf > 0 then tt / (tt + tf) else 1 end p1, case when tt + ft > 0 then tt / (tt + ft) else 1 end r1, case when ff + ft > 0 then ff / (ff + ft) else 1 end p2, case when ff + tf > 0 then ff / (ff + tf) else 1 end r2 from c)
        select key, round(((case when p1 + r1 > 0 then 2 * p1 * r1 / (p1 + r1) else 0 end) + (case when p2 + r2 > 0 then 2 * p2 * r2 / (p2 + r2) else 0 end)) / 2, 6) coverage_f1 from r""",
}
