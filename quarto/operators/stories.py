"""Stories across papers and time: matching, entity graph, timelines, coverage, lookups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarto.functions import text as T
from quarto.functions.dates import window_around
from quarto.operators.documents import mentions
from quarto.operators.retrieval import bm25_scores, tokens
from quarto.plans.filters import contains_ci, label
from quarto.session import written
from quarto.sources.archive import READY, SQL, Archive

# Headlines that are no stories.
NOISE_HEADLINES = ["saturday", "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "in short >>", "in short", "news in brief", "panaji", "margao", "vasco", "mapusa", "delhi", "mumbai", "when: ", "where: ", "studio xo", "sit vacant", "[advertisement]", "results"]


def comparable(rows: DataFrame) -> DataFrame:
    """Rows whose headline has ten characters and is no noise."""
    h = F.trim(F.coalesce("headline", F.lit("")))
    return rows.where((F.length(h) >= 10) & ~F.lower(h).isin(NOISE_HEADLINES))


def shared_candidates(ar: Archive, least: float = 0.40) -> DataFrame:
    """(issue_date, paper_a, paper_b, id_a, id_b, score, tier): pairs of stories of two papers of one day that may be the same.

    Tier 1: two common words and an overlap c / min(n_a, n_b) of ``least``, or
    of 0.25 with a common number (plus 0.35, 0.95 at most). Tier 2, where that
    stays under 0.5: two common entities and a common word or number give
    0.55 + 0.1 n, 0.90 at most. Pairs meet through an inverted index of words
    and entities within the day, never all with all.
    """
    a = comparable(ar.dated_articles).select("issue_date", F.col("newspaper_id").alias("paper"), "article_id", T.substantive_tokens(F.col("headline")).alias("toks"), T.numeric_anchors(F.col("headline")).alias("nums"))
    m = mentions(ar).select("article_id", F.lower(F.trim("name")).alias("e")).where((F.length("e") >= 3) & ~F.col("e").isin(T.UBIQUITOUS))
    a = a.join(m.groupBy("article_id").agg(F.collect_set("e").alias("ents")), "article_id", "left").withColumn("ents", F.coalesce("ents", F.array().cast("array<string>")))
    keys = a.select("issue_date", "paper", "article_id", F.explode(F.array_union(F.transform("toks", lambda t: F.concat(F.lit("t:"), t)), F.transform("ents", lambda t: F.concat(F.lit("e:"), t)))).alias("k"))
    left, right = keys.select("issue_date", "k", F.col("paper").alias("paper_a"), F.col("article_id").alias("id_a")), keys.select("issue_date", "k", F.col("paper").alias("paper_b"), F.col("article_id").alias("id_b"))
    met = left.join(right, ["issue_date", "k"]).where("paper_a < paper_b").groupBy("issue_date", "paper_a", "paper_b", "id_a", "id_b").agg(F.count("*").alias("n")).where("n >= 2")
    side = lambda s: a.select(F.col("article_id").alias(f"id_{s}"), F.col("toks").alias(f"t{s}"), F.col("nums").alias(f"n{s}"), F.col("ents").alias(f"e{s}"))
    p = met.drop("n").join(side("a"), "id_a").join(side("b"), "id_b")
    ct, cn, ce = (F.size(F.array_intersect(f"{x}a", f"{x}b")) for x in "tne")
    p = p.select("issue_date", "paper_a", "paper_b", "id_a", "id_b", ct.alias("ct"), cn.alias("cn"), ce.alias("ce"), (ct / F.least(F.size("ta"), F.size("tb"))).alias("o"))
    one = F.when((F.col("ct") >= 2) & (F.col("o") >= least), F.col("o")).when((F.col("ct") >= 2) & (F.col("o") >= 0.25) & (F.col("cn") > 0), F.least(F.lit(0.95), F.col("o") + 0.35)).otherwise(0.0)
    two = F.when((F.col("ce") >= 2) & ((F.col("ct") > 0) | (F.col("cn") > 0)), F.least(F.lit(0.90), 0.55 + F.col("ce") * 0.10)).otherwise(0.0)
    p = p.withColumn("one", one).withColumn("two", F.when(F.col("one") < 0.50, two).otherwise(0.0))
    tier = F.when(F.col("two") > F.col("one"), "entities").when((F.col("ct") >= 2) & (F.col("o") >= least), "words").otherwise("numbers")
    return p.withColumn("score", F.round(F.greatest("one", "two"), 6)).where(F.col("score") >= least).select("issue_date", "paper_a", "paper_b", "id_a", "id_b", "score", tier.alias("tier"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    used_a, used_b, keep = set(), set(), []
    for i, r in enumerate(pdf.sort_values(["score", "id_a", "id_b"], ascending=[False, True, True]).itertuples()):
        if r.id_a not in used_a and r.id_b not in used_b:
            used_a.add(r.id_a)
            used_b.add(r.id_b)
            keep.append(r.Index)
    return pdf.loc[keep]


def shared_stories(ar: Archive, least: float = 0.40) -> DataFrame:
    """One-to-one matches of each pair of papers and day, best score first, ties by ids."""
    c = shared_candidates(ar, least)
    return c.groupBy("issue_date", "paper_a", "paper_b").applyInPandas(_greedy, c.schema)


def exclusive_stories(ar: Archive) -> DataFrame:
    """Stories of a paper without a match in another paper of the day, by id or headline; two anti-joins."""
    a = comparable(ar.dated_articles).select("issue_date", "newspaper_id", "article_id", F.lower(F.trim("headline")).alias("h"))
    m = shared_stories(ar)
    hit = m.select(F.col("id_a").alias("article_id")).unionAll(m.select(F.col("id_b").alias("article_id"))).distinct()
    told = a.join(hit, "article_id", "left_semi").select("issue_date", "newspaper_id", "h").distinct()
    return a.join(hit, "article_id", "left_anti").join(told, ["issue_date", "newspaper_id", "h"], "left_anti").select("issue_date", "newspaper_id", "article_id")


def cooccurrence(m: DataFrame) -> DataFrame:
    """(source, target, weight, avg_salience): articles that two entities share; an article has 15 at most."""
    x, y = m.select("article_id", F.col("name").alias("source"), F.col("salience").alias("sx")), m.select("article_id", F.col("name").alias("target"), F.col("salience").alias("sy"))
    p = x.join(y, "article_id").where("source < target").groupBy("source", "target")
    return p.agg(F.count("*").alias("weight"), F.round(F.avg((F.col("sx") + F.col("sy")) / 2), 6).alias("avg_salience"))


def entity_graph(ar: Archive, name: str, depth: int = 2, top: int = 15, least: int = 1) -> DataFrame:
    """G1: edges around the first five entities whose name contains ``name``, ``depth`` hops of 3 at most.

    Each hop goes on from the ``top`` new entities of most articles, then by
    name; an article counts once per pair, and salience is a true mean, where
    the graph of old counted articles again at each hop. The frontier is the
    only thing that reaches the driver, ``top`` names at most.
    """
    m = written(mentions(ar))  # read by every hop
    frontier = [r["name"] for r in m.where(contains_ci("name", name)).select("name").distinct().orderBy("name").limit(5).collect()]
    seen, touched = list(frontier), None
    for _ in range(min(depth, 3)):
        if not frontier:
            break
        arts = m.where(F.col("name").isin(frontier)).select("article_id").distinct()
        touched = arts if touched is None else touched.unionAll(arts).distinct()
        new = m.join(arts, "article_id", "left_semi").where(~F.col("name").isin(seen)).groupBy("name").agg(F.count("*").alias("n"))
        frontier = [r["name"] for r in new.orderBy(F.desc("n"), "name").limit(top).collect()]
        seen += frontier
    if touched is None:
        return cooccurrence(m.limit(0))
    return cooccurrence(m.join(touched, "article_id", "left_semi")).where(F.col("weight") >= least).orderBy(F.desc("weight"), "source", "target").limit(2 * top)


def entity_search(ar: Archive, names: list[str], limit: int = 20) -> DataFrame:
    """Articles that mention an entity, by salience, then mentions; one row per article after the limit."""
    hit = mentions(ar).where(T.any_of([contains_ci("name", n) for n in names])).join(ar.dated_articles.select("article_id", "headline", "issue_date", "newspaper"), "article_id")
    w = Window.partitionBy("article_id").orderBy(F.desc("salience"), F.desc("mention_count"), "name")
    top = hit.orderBy(F.desc("salience"), F.desc("mention_count"), "article_id", "name").limit(limit)
    return top.withColumn("r", F.row_number().over(w)).where("r = 1").select("article_id", "name", "salience", "mention_count", "newspaper", "issue_date")


def entity_query_terms(text: str) -> list[str]:
    """Search terms of an entity question: without title, split at "or", and the last word."""
    import re

    title = r"(?i)^(?:chief\s+minister|prime\s+minister|union\s+minister|minister|president|governor|senator|justice|judge|general|colonel|dr\.?|mr\.?|mrs\.?|ms\.?|prof\.?|shri|smt\.?|cm|pm)\s+"
    out: list[str] = []
    for part in (p.strip() for p in re.split(r"(?i)\s+or\s+", text or "")):
        bare = re.sub(title, "", part).strip("?:!.,\"' ")
        long = re.findall(r"[A-Za-z0-9]{4,}", bare)
        out += [t for t in (bare, part, long[-1] if len(long) > 1 else "") if t and t not in out]
    return list(dict.fromkeys(out))


def entity_listing(ar: Archive, limit: int = 50) -> DataFrame:
    """Names of people by name, with their canonical row."""
    e = ar.table("entities").dropDuplicates(["id"]).where((F.col("entity_type") == "person") & contains_ci("name", "an"))
    return e.select("id", "name", "canonical_id").orderBy("name", "id").limit(limit)


def entity_trend(ar: Archive, name: str) -> DataFrame:
    """A2: articles, mentions and mean salience of an entity per date."""
    m = mentions(ar).where(contains_ci("name", name)).join(ar.dated_articles.select("article_id", "issue_date"), "article_id")
    return m.groupBy("issue_date").agg(F.count("*").alias("article_count"), F.sum("mention_count").alias("total_mentions"), F.round(F.avg("salience") + 1e-9, 3).alias("avg_salience"))


def headline_lookup(ar: Archive, wanted: DataFrame) -> DataFrame:
    """(headline, article_id) of wanted headlines: an equal one without case, else one that contains the first 40 characters (12 at least); the least id."""
    a = ar.articles.select(F.col("id").alias("article_id"), F.lower("headline").alias("h")).where("h is not null")
    w = wanted.select("headline", F.lower("headline").alias("h")).distinct()
    exact = w.join(a, "h").groupBy("headline").agg(F.min("article_id").alias("article_id"))
    rest = w.join(exact, "headline", "left_anti").where(F.length("h") >= 12).select("headline", F.substring("h", 1, 40).alias("p"), F.substring("h", 1, 12).alias("k"))
    # headlines that contain the prefix hold its first 12 characters somewhere: an index over those
    grams = a.where(F.length("h") >= 12).select("article_id", "h", F.explode(F.transform(F.sequence(F.lit(1), F.length("h") - 11), lambda i: F.col("h").substr(i, F.lit(12)))).alias("k"))
    part = rest.join(grams, "k").where(F.col("h").contains(F.col("p"))).groupBy("headline").agg(F.min("article_id").alias("article_id"))
    return exact.unionByName(part)


def suggestions(ar: Archive, limit: int = 30) -> DataFrame:
    """The latest headlines, cut at a colon, spaced dash or bar, 75 characters at most, each once."""
    last = ar.dated_articles.where(F.coalesce("headline", F.lit("")) != "").orderBy(F.desc("issue_date"), F.desc("article_id")).limit(limit)
    cut = F.trim(F.split("headline", r":|\s[-–|]\s")[0])
    return last.select(cut.alias("suggestion")).where(F.length("suggestion").between(1, 75)).distinct()


def timeline(ar: Archive, words: list[str], limit: int = 50) -> DataFrame:
    """The first ``limit`` articles by date that contain a word, grouped by date and paper."""
    hit = T.any_of([contains_ci(c, w) for w in words[:5] for c in ("headline", "full_text")])
    a = ar.dated_articles.where(hit).orderBy("issue_date", "article_id").limit(limit)
    g = a.groupBy("issue_date", "newspaper").agg(F.count("*").alias("articles"), F.array_sort(F.collect_list(F.struct("article_id", F.coalesce(F.nullif("headline", F.lit("")), F.lit("Untitled")).alias("headline")))).alias("list"))
    return g.select("issue_date", "newspaper", "articles", F.array_join(F.transform("list", lambda x: F.concat(x["article_id"].cast("string"), F.lit(" "), x["headline"])), " | ").alias("milestones"))


def trajectory(ar: Archive, words: list[str], limit: int = 35) -> DataFrame:
    """Per date of the best articles: phase, lead headline, discrepancy, and the six most salient entities.

    Phase: first date Breaking; the last of more than two Regulatory; a section
    of markets or finance Financial; else Development. The entities are
    attached, which the plan of old forgot.
    """
    hit = T.any_of([contains_ci(c, w) for w in words[:5] for c in ("headline", "full_text")])
    a = ar.dated_articles.where(hit).orderBy(F.desc("prominence_score"), "article_id").limit(limit)
    fin = F.lower(F.coalesce("section", F.lit(""))).rlike("financial|market")
    first = F.row_number().over(Window.partitionBy("issue_date").orderBy(F.desc("prominence_score"), "article_id"))
    a = a.withColumn("r", first)
    d = a.groupBy("issue_date").agg(F.count("*").alias("articles"), F.max(fin).alias("fin"), F.max(F.when(F.col("r") == 1, F.coalesce("headline", F.lit("Untitled")))).alias("lead"), F.max(F.when(F.col("r") == 1, F.col("newspaper"))).alias("p1"), F.max(F.when(F.col("r") == 2, F.col("newspaper"))).alias("p2"))
    order = Window.orderBy("issue_date")  # ``limit`` dates at most
    d = d.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    phase = F.when(F.col("i") == 1, "Breaking").when((F.col("i") == F.col("n")) & (F.col("n") > 2), "Regulatory").when(F.col("fin"), "Financial").otherwise("Development")
    m = mentions(ar).join(a.select("article_id", "issue_date"), "article_id")
    m = m.groupBy("issue_date", "name").agg(F.max("salience").alias("s"))
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("issue_date").orderBy(F.desc("s"), "name"))).where("r <= 6")
    m = m.groupBy("issue_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("entities"))
    return d.join(m, "issue_date", "left").select("issue_date", "articles", phase.alias("phase"), "lead", F.when(F.col("articles") > 1, F.concat_ws(" / ", "p1", "p2")).alias("discrepancy"), F.coalesce("entities", F.lit("")).alias("entities"))


def two_hop(ar: Archive, words: list[str], limit: int = 20) -> DataFrame:
    """Articles that share a focal entity (salience 0.5, the best eight by name) with the hits, at salience 0.4, between their dates."""
    hit = T.any_of([contains_ci("headline", w) for w in words])
    root = ar.dated_articles.where(hit).select("article_id", "issue_date")
    m = mentions(ar)
    focal = m.join(root, "article_id").where("salience >= 0.5").groupBy("name").agg(F.max("salience").alias("s")).orderBy(F.desc("s"), "name").limit(8)
    span = root.agg(F.min("issue_date").alias("lo"), F.max("issue_date").alias("hi"))
    near = m.where("salience >= 0.4").join(focal.select("name"), "name", "left_semi").select("article_id").distinct()
    rows = ar.dated_articles.join(near, "article_id", "left_semi").join(root.select("article_id"), "article_id", "left_anti").crossJoin(F.broadcast(span)).where("issue_date between lo and hi")  # one row
    return rows.orderBy("issue_date", "article_id").limit(limit).select("article_id", "issue_date", "newspaper")


def coverage(ar: Archive, query: str, day: str, days: int = 2, strict: bool = False) -> DataFrame:
    """(newspaper, status, confidence, top_score) of each paper with an issue around a day, in one job.

    PROCESSING_ERROR if an issue in the window is not ready; else the best of
    the paper's five top articles after reranking decides: 0.35 COVERED (0.95
    sure from 0.75 on, else 0.85), 0.15 UNCERTAIN, below NOT_FOUND. ``strict``
    keeps the fused score of a paper's only candidate, as of old.
    """
    win = ar.issue_papers.where(window_around(F.col("issue_date"), day, days))
    health = win.groupBy("newspaper_id", "newspaper").agg(F.max((~F.col("ingestion_status").isin(*READY)).cast("int")).alias("broken"))
    docs = ar.dated_articles.join(win.select("issue_id"), "issue_id", "left_semi").withColumn("body", F.concat_ws(" ", "headline", "full_text"))
    words = F.array_distinct(tokens(F.lit(query)))
    hits = bm25_scores(ar.spark.createDataFrame([(0, query)], "query_id int, query string"), docs, "article_id", F.col("body"))
    own = hits.join(docs.select("article_id", "newspaper_id", F.array_distinct(tokens(F.col("body"))).alias("d"), "prominence_score"), "article_id")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("newspaper_id").orderBy(F.desc("score"), "article_id"))).where("r <= 5")
    fused = F.round(0.5 / (60 + F.col("r")), 6)
    overlap = F.size(F.array_intersect(words, F.col("d"))) / F.greatest(F.lit(1), F.size(words))
    score = F.round(0.6 * overlap + 0.3 * fused + 0.1 * F.least(F.lit(1.0), F.col("prominence_score")), 4)
    if strict:
        score = F.when(F.count("*").over(Window.partitionBy("newspaper_id")) == 1, fused).otherwise(score)
    best = own.withColumn("s", score).groupBy("newspaper_id").agg(F.max("s").alias("top_score"))
    x = health.join(best, "newspaper_id", "left")
    s = F.col("top_score")
    status = F.when(F.col("broken") == 1, "PROCESSING_ERROR").when(s >= 0.35, "COVERED").when(s >= 0.15, "UNCERTAIN").otherwise("NOT_FOUND")
    sure = F.when(F.col("broken") == 1, 0.0).when(s >= 0.75, 0.95).when(s >= 0.35, 0.85).when(s >= 0.15, 0.5).otherwise(0.95)
    return x.select("newspaper", status.alias("status"), sure.alias("confidence"), F.when(F.col("broken") == 0, s).alias("top_score"))


def coverage_tally(ar: Archive, query: str, day: str, days: int = 2) -> DataFrame:
    """Papers per coverage status."""
    return coverage(ar, query, day, days).groupBy("status").agg(F.count("*").alias("papers"))


def issues_on(ar: Archive, day: str) -> DataFrame:
    """Issues of a date."""
    return ar.issue_papers.where(F.col("issue_date") == F.lit(day).cast("date")).select("issue_id", "newspaper", "edition", "ingestion_status")


def newspaper_ids(ar: Archive, names: list[str]) -> DataFrame:
    """(name, newspaper_id): the least id of a paper whose name contains the text."""
    q = ar.spark.createDataFrame([(n,) for n in names], "wanted string")
    return q.join(F.broadcast(ar.newspapers), F.lower("name").contains(F.lower("wanted"))).groupBy("wanted").agg(F.min("id").alias("newspaper_id"))


def chunk_context(ar: Archive) -> DataFrame:
    """Each visual chunk with its article, issue and paper; what is not there stays null."""
    c = ar.chunks.where("chunk_type = 'visual'").select(F.col("id").alias("chunk_id"), "article_id")
    a = ar.articles.select(F.col("id").alias("article_id"), "headline", "issue_id")
    i = ar.issue_papers.select("issue_id", "issue_date", "newspaper")
    return c.join(a, "article_id", "left").join(i, "issue_id", "left").select("chunk_id", "article_id", F.coalesce("headline", F.lit("Untitled")).alias("headline"), "issue_date", F.coalesce("newspaper", F.lit("unknown")).alias("newspaper"))


def missing_papers(ar: Archive, day: str) -> DataFrame:
    """Papers without an issue on a date."""
    return ar.newspapers.join(issues_on(ar, day).select(F.col("newspaper").alias("name")), "name", "left_anti").select("id", "name")


def compatible_papers(ar: Archive) -> DataFrame:
    """Printed brands and papers of which one's name contains the other's; the least paper id per brand.

    The list of papers is fixed, so the pairs grow with the distinct brands.
    """
    b = ar.table("page_layouts").select(F.lower(F.trim("newspaper_brand")).alias("brand")).where("brand <> ''").distinct()
    n = ar.newspapers.select("id", F.lower("name").alias("n"))
    return b.join(F.broadcast(n), F.col("brand").contains(F.col("n")) | F.col("n").contains(F.col("brand"))).groupBy("brand").agg(F.min("id").alias("newspaper_id"))


def category_filter(rows: DataFrame, wanted: str, synonyms: dict[str, str], keywords: dict[str, list[str]]) -> DataFrame:
    """P10: rows of a category: by section, or by one of its keywords as a word of the headline."""
    canon = synonyms.get(wanted.lower(), wanted)
    keys = [k for k in keywords.get(canon, []) if len(k) >= 3]
    word = F.lower(F.coalesce("headline", F.lit(""))).rlike(r"\b(?:" + "|".join(keys) + r")\b") if keys else F.lit(False)
    return rows.where(contains_ci(label("section", ""), canon) | word)


def relaxed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Q7: the first plan's rows, or the second's if it has none; decided within the job."""
    some = first.limit(1).select(F.lit(1).alias("one"))
    return first.unionByName(second.join(F.broadcast(some), F.lit(True), "left_anti"))


def _q(f, *args):
    return lambda spark, root: f(Archive(spark, root), *args)


_KEYS = {"Markets & Prices": ["market", "price", "trade"]}

QUERIES = {
    "g01_entity_graph": _q(entity_graph, "harbour"),
    "g02_timeline": _q(timeline, ["harbour", "storm"]),
    "g03_trajectory": _q(trajectory, ["harbour", "storm"]),
    "g04_coverage": _q(coverage, "harbour storm council", "2024-03-01", 20),
    "g05_coverage_tally": _q(coverage_tally, "harbour storm council", "2024-03-01", 20),
    "g06_shared_candidates": _q(lambda ar: shared_candidates(ar, 0.25)),
    "g06_shared_stories": _q(lambda ar: shared_stories(ar, 0.25)),
    "g07_exclusive_stories": _q(exclusive_stories),
    "j12_cooccurrence": _q(lambda ar: cooccurrence(mentions(ar))),
    "j14_two_hop": _q(two_hop, ["market", "price"]),
    "j19_missing_papers": _q(missing_papers, "2024-02-15"),
    "f06_compatible_papers": _q(compatible_papers),
    "f10_category_filter": _q(lambda ar: category_filter(ar.dated_articles, "prices", {"prices": "Markets & Prices"}, _KEYS).select("article_id")),
    "q07_relaxed": _q(lambda ar: relaxed(ar.dated_articles.where("section = 'no such section'").select("article_id"), ar.dated_articles.where("section = 'Farm & Weather'").select("article_id"))),
    "r10_entity_search": _q(entity_search, ["the", "was"]),
    "r11_headline_lookup": _q(lambda ar: headline_lookup(ar, ar.articles.where("length(headline) > 20").select(F.lower(F.substring("headline", 1, 30)).alias("headline")))),
    "r14_entity_listing": _q(entity_listing),
    "r15_suggestions": _q(suggestions),
    "r16_issues_on": _q(issues_on, "2024-02-15"),
    "r16_newspaper_ids": _q(newspaper_ids, ["herald", "Ostelby", "none"]),
    "r17_chunk_context": _q(chunk_context),
    "a02_entity_trend": _q(entity_trend, "was"),
}


def _mentions_sql() -> str:
    from quarto.operators.documents import ORACLE as D

    return D["t18_mentions"].replace("\n        select article_id, name, case when name in", ", m_ as (select article_id, name, case when name in", 1) + ")"


_M = _mentions_sql()
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_toks = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: length(w) >= 3 and not list_contains({_STOP}, w)))"
_nums = lambda c: rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '\b(?:\d+[.,]?\d*(?:%|k|cr|crore|lakh|bn|m)?)\b'), lambda w: length(w) >= 2))"
_list = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_HIT = "(headline ilike '%harbour%' or full_text ilike '%harbour%' or headline ilike '%storm%' or full_text ilike '%storm%')"

ORACLE = {
    "g01_entity_graph": _M + """, f0 as (select distinct name from m_ where name ilike '%harbour%' order by name limit 5), a1 as (select distinct article_id from m_ where name in (select name from f0)),
        f1 as (select name from m_ where article_id in (select article_id from a1) and name not in (select name from f0) group by 1 order by count(*) desc, name limit 15),
        tt as (select article_id from a1 union select article_id from m_ where name in (select name from f1))
        select x.name source, y.name target, count(*) weight, round(avg((x.salience + y.salience) / 2), 6) avg_salience from m_ x join m_ y using (article_id) where x.name < y.name and article_id in (select article_id from tt) group by 1, 2 order by weight desc, source, target limit 30""",
    "g02_timeline": SQL + f", t as (select * from dated_articles where {_HIT} order by issue_date, article_id limit 50) select issue_date, newspaper, count(*) articles, string_agg(article_id || ' ' || coalesce(nullif(headline, ''), 'Untitled'), ' | ' order by article_id) milestones from t group by 1, 2",
    "g03_trajectory": _M + f""", tt as (select * from dated_articles where {_HIT} order by prominence_score desc, article_id limit 35), u as (select *, row_number() over (partition by issue_date order by prominence_score desc, article_id) k from tt),
        dd as (select issue_date, count(*) articles, bool_or(regexp_matches(lower(coalesce(section, '')), 'financial|market')) fin, max(case when k = 1 then coalesce(headline, 'Untitled') end) lead_, max(case when k = 1 then newspaper end) p1, max(case when k = 2 then newspaper end) p2 from u group by 1),
        w as (select *, row_number() over (order by issue_date) i, count(*) over () n from dd),
        e2 as (select issue_date, name, max(salience) s from m_ join tt using (article_id) group by 1, 2), f2 as (select *, row_number() over (partition by issue_date order by s desc, name) q from e2), h as (select issue_date, string_agg(name, ', ' order by q) entities from f2 where q <= 6 group by 1)
        select w.issue_date, articles, case when i = 1 then 'Breaking' when i = n and n > 2 then 'Regulatory' when fin then 'Financial' else 'Development' end phase, lead_ as "lead", case when articles > 1 then concat_ws(' / ', p1, p2) end discrepancy, coalesce(entities, '') entities from w left join h on h.issue_date = w.issue_date""",
    "g04_coverage": SQL + """, win as (select * from issue_papers where issue_date between date '2024-03-01' - 20 and date '2024-03-01' + 20), hl as (select newspaper_id, newspaper, max(case when ingestion_status in ('completed','indexed','ready') then 0 else 1 end) broken from win group by 1, 2),
        docs as (select article_id, d.newspaper_id, prominence_score, list_filter(regexp_extract_all(lower(concat_ws(' ', headline, full_text)), '[a-z0-9]+'), lambda t: length(t) >= 3) t from dated_articles d join win using (issue_id)),
        po as (select article_id, newspaper_id, len(t) dl, unnest(t) term from docs), tf as (select article_id, newspaper_id, dl, term, count(*) tf from po where term in ('harbour', 'storm', 'council') group by all), df as (select term, count(*) df from tf group by 1), st as (select count(*) n, avg(len(t)) avgdl from docs),
        bm as (select article_id, newspaper_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) s from tf join df using (term), st group by 1, 2),
        rk as (select *, row_number() over (partition by newspaper_id order by s desc, article_id) k from bm),
        sc as (select rk.newspaper_id, max(round(0.6::double * (len(list_intersect(list_distinct(t), ['harbour', 'storm', 'council'])) / 3) + 0.3::double * round(0.5::double / (60 + k), 6) + 0.1::double * least(1.0, prominence_score), 4)) top from rk join docs using (article_id) where k <= 5 group by 1)
        select newspaper, case when broken = 1 then 'PROCESSING_ERROR' when top >= 0.35 then 'COVERED' when top >= 0.15 then 'UNCERTAIN' else 'NOT_FOUND' end status, case when broken = 1 then 0.0 when top >= 0.75 then 0.95 when top >= 0.35 then 0.85 when top >= 0.15 then 0.5 else 0.95 end::double confidence, case when broken = 0 then top end top_score from hl left join sc using (newspaper_id)""",
    "g06_shared_candidates": _M + f""", cc as (select issue_date, newspaper_id paper, article_id, {_toks('headline')} t, {_nums('headline')} n from dated_articles where length(trim(coalesce(headline, ''))) >= 10 and lower(trim(headline)) not in ({_list(NOISE_HEADLINES)})),
        en as (select article_id, list_distinct(list(lower(trim(name)))) e from m_ where length(trim(name)) >= 3 and lower(trim(name)) not in ({_list(T.UBIQUITOUS)}) group by 1), ss as (select cc.*, coalesce(e, []) e from cc left join en using (article_id)),
        p as (select a.issue_date, a.paper paper_a, b.paper paper_b, a.article_id id_a, b.article_id id_b, len(list_intersect(a.t, b.t)) ct, len(list_intersect(a.n, b.n)) cn, len(list_intersect(a.e, b.e)) ce, len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) o from ss a join ss b on a.issue_date = b.issue_date and a.paper < b.paper),
        q as (select *, case when ct >= 2 and o >= 0.25 then o when ct >= 2 and o >= 0.25 and cn > 0 then least(0.95, o + 0.35) else 0 end::double one, case when ce >= 2 and (ct > 0 or cn > 0) then least(0.9, 0.55 + ce * 0.1) else 0 end::double two from p),
        z as (select *, case when one < 0.5 then two else 0 end tw from q)
        select issue_date, paper_a, paper_b, id_a, id_b, round(greatest(one, tw), 6) score, case when tw > one then 'entities' when ct >= 2 and o >= 0.25 then 'words' else 'numbers' end tier from z where round(greatest(one, tw), 6) >= 0.25""",
    "j12_cooccurrence": _M + " select x.name source, y.name target, count(*) weight, round(avg((x.salience + y.salience) / 2), 6) avg_salience from m_ x join m_ y using (article_id) where x.name < y.name group by 1, 2",
    "j14_two_hop": _M + """, ro as (select article_id, issue_date from dated_articles where headline ilike '%market%' or headline ilike '%price%'), fo as (select name from m_ join ro using (article_id) where salience >= 0.5 group by 1 order by max(salience) desc, name limit 8)
        select article_id, issue_date, newspaper from dated_articles where article_id in (select article_id from m_ where salience >= 0.4 and name in (select name from fo)) and article_id not in (select article_id from ro) and issue_date between (select min(issue_date) from ro) and (select max(issue_date) from ro) order by issue_date, article_id limit 20""",
    "j19_missing_papers": SQL + "select newspaper_id id, newspaper as name from n_ where newspaper not in (select newspaper from issue_papers where issue_date = date '2024-02-15')",
    "f06_compatible_papers": "select brand, min(id) newspaper_id from (select distinct lower(trim(newspaper_brand)) brand from page_layouts where trim(newspaper_brand) <> '') b, newspapers n where contains(brand, lower(n.name)) or contains(lower(n.name), brand) group by 1",
    "f10_category_filter": SQL + r"select article_id from dated_articles where coalesce(section, '') ilike '%Markets & Prices%' or regexp_matches(lower(coalesce(headline, '')), '\b(?:market|price|trade)\b')",
    "q07_relaxed": SQL + "select article_id from dated_articles where section = 'Farm & Weather'",
    "r10_entity_search": _M + ", h as (select * from m_ join (select article_id, newspaper, issue_date from dated_articles) d using (article_id) where name ilike '%the%' or name ilike '%was%' order by salience desc, mention_count desc, article_id, name limit 20), r2 as (select *, row_number() over (partition by article_id order by salience desc, mention_count desc, name) k from h) select article_id, name, salience, mention_count, newspaper, issue_date from r2 where k = 1",
    "r11_headline_lookup": SQL + ", w as (select distinct lower(substr(headline, 1, 30)) headline from a_ where length(headline) > 20), ex as (select w.headline, min(article_id) article_id from w join a_ on lower(a_.headline) = lower(w.headline) group by 1) select * from ex union all select w.headline, min(article_id) from w join a_ on contains(lower(a_.headline), substr(lower(w.headline), 1, 40)) where w.headline not in (select headline from ex) group by 1",
    "r14_entity_listing": "select id, name, canonical_id from (select distinct * from entities) where entity_type = 'person' and name ilike '%an%' order by name, id limit 50",
    "r15_suggestions": SQL + r"select distinct s suggestion from (select trim(regexp_split_to_array(headline, ':|\s[-–|]\s')[1]) s from (select headline from dated_articles where coalesce(headline, '') <> '' order by issue_date desc, article_id desc limit 30)) where length(s) between 1 and 75",
    "r16_issues_on": SQL + "select issue_id, newspaper, edition, ingestion_status from issue_papers where issue_date = date '2024-02-15'",
    "r16_newspaper_ids": "select wanted, min(id) newspaper_id from (values ('herald'), ('Ostelby'), ('none')) w(wanted) join newspapers on contains(lower(name), lower(wanted)) group by 1",
    "r17_chunk_context": SQL + "select c.id chunk_id, c.article_id, coalesce(headline, 'Untitled') headline, issue_date, coalesce(newspaper, 'unknown') newspaper from (select distinct id, article_id from article_chunks where chunk_type = 'visual') c left join a_ using (article_id) left join issue_papers p on p.issue_id = a_.issue_id",
    "a02_entity_trend": _M + " select issue_date, count(*) article_count, cast(sum(mention_count) as bigint) total_mentions, round(avg(salience) + 1e-9, 3) avg_salience from m_ join dated_articles using (article_id) where name ilike '%was%' group by 1",
}
ORACLE["g05_coverage_tally"] = "select status, count(*) papers from (" + ORACLE["g04_coverage"] + ") group by 1"
