"""Relational archive analytics: counts, rosters, distributions, trends and statistics.

Each routine takes an ``Archive`` and optional filters and returns a plan.
Filters follow one rule set (``plans.filters``): names by case-insensitive
containment, an exact date before a range, ranges with both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarto.plans.filters import Filters, apply_filters, apply_filters_to, label
from quarto.sources.archive import READY, SQL, Archive


def narrowed(ar: Archive, f: Filters, tables: list[str]) -> Archive:
    """The archive with those filters on its tables that copies of a row meet all or none of, below the step that drops the copies."""
    dates, texts = apply_filters_to(f, ["newspaper_id", "issue_date"]), apply_filters_to(f, ["section", "article_type"])
    conditions = {t: c for t in tables if (c := dates if t == "issues" else texts) is not None}
    return ar.where(**conditions)


def availability(ar: Archive) -> DataFrame:
    """A1: papers with a ready issue, per date."""
    ready = ar.issue_papers.where(F.col("ingestion_status").isin(*READY))
    return ready.groupBy("issue_date").agg(F.array_join(F.array_sort(F.collect_set("newspaper")), ", ").alias("papers"), F.countDistinct("newspaper").alias("n_papers"))


def topic_distribution(ar: Archive, newspaper_id: int | None = None) -> DataFrame:
    """A3: articles and mean prominence per section and type; a missing section is labelled after grouping, so it stays apart from a real one of that name."""
    rows = apply_filters(ar.dated_articles, Filters(newspaper_id=newspaper_id))
    g = rows.groupBy("section", "article_type").agg(F.count("*").alias("articles"), F.round(F.avg("prominence_score") + 1e-9, 3).alias("avg_prominence"))
    return g.select(label("section", "General").alias("section"), "article_type", "articles", "avg_prominence")


def front_page_ratio(ar: Archive, newspaper_id: int | None = None) -> DataFrame:
    """A4: share of page 1; the total adds up the pages' distinct stories, so a story on two pages counts on both."""
    pages = apply_filters(ar.story_pages, Filters(newspaper_id=newspaper_id)).groupBy("page_number").agg(F.countDistinct("article_id").alias("n"))
    t = pages.agg(F.sum("n").alias("total_articles"), F.sum(F.when(F.col("page_number") == 1, F.col("n")).otherwise(0)).alias("frontpage_articles"), F.count("*").alias("pages"))
    return t.withColumn("frontpage_ratio", F.when(F.col("total_articles") > 0, F.round(F.col("frontpage_articles") / F.col("total_articles"), 4)).otherwise(0.0))


def page_distribution(ar: Archive) -> DataFrame:
    """A4: distinct stories per page number."""
    return ar.story_pages.groupBy("page_number").agg(F.countDistinct("article_id").alias("articles"))


def latest_issue(ar: Archive, f: Filters) -> DataFrame:
    """The issue of the latest date that the filters leave, then of the highest id."""
    return apply_filters(ar.issue_papers, f).orderBy(F.desc("issue_date"), F.desc("issue_id")).limit(1)


def issue_manifest(ar: Archive, f: Filters) -> DataFrame:
    """A5: the stories of the latest issue that the filters leave, page by page, lead stories first; the issue is looked up first, so only its pages are read on."""
    rank = prominence_rank(F.col("prominence"))
    found = narrowed(ar, f, ["issues"])
    issue = latest_issue(found, f).select("issue_id").first()  # one row
    s = ar.of_issue(issue[0] if issue else None).stories
    return s.select("issue_id", "article_id", "page_number", F.coalesce(F.nullif("headline", F.lit("")), F.lit("Untitled Article")).alias("headline"), label("section", "General").alias("section"), "article_type", rank.alias("prominence_rank"))


def manifest_breakdown(ar: Archive, f: Filters) -> DataFrame:
    """A5: counts by section and by type of the issue, before any page or section filter."""
    m = issue_manifest(ar, f)
    by = lambda kind, col: m.groupBy(F.lit(kind).alias("breakdown"), F.coalesce(col, F.lit("unknown")).alias("name")).agg(F.count("*").alias("articles"))
    return by("section", "section").unionAll(by("type", F.col("article_type")))


def prominence_rank(c: Column) -> Column:
    return F.when(c == "lead", 1).when(c == "major", 2).when(c == "standard", 3).when(c == "minor", 4).otherwise(5)


def count_articles(ar: Archive, f: Filters) -> DataFrame:
    """Distinct stories under all filters, the page filter included."""
    ar = narrowed(ar, f, ["issues", "article_skeletons"])
    rows = apply_filters(ar.stories, f)
    if f.page is not None:
        pages = ar.story_pages.where(F.col("page_number") == f.page).select("article_id").distinct()
        rows = rows.join(pages, "article_id", "left_semi")
    return rows.agg(F.countDistinct("article_id").alias("articles"))


def list_articles(ar: Archive, f: Filters, limit: int = 30, strict: bool = True) -> DataFrame:
    """The listing beside the count, newest first, then by first page, then id.

    The listing of old ignored the page filter, which ``strict`` keeps.
    """
    ar = narrowed(ar, f, ["issues", "article_skeletons"])
    rows = apply_filters(ar.stories, f)
    if f.page is not None and not strict:
        rows = rows.join(ar.story_pages.where(F.col("page_number") == f.page).select("article_id").distinct(), "article_id", "left_semi")
    first = F.least("page_number", F.coalesce("continues_to_page", "page_number"))
    rows = rows.select("article_id", F.coalesce(F.nullif("headline", F.lit("")), F.lit("Untitled Article")).alias("headline"), label("section", "General").alias("section"), "article_type", "issue_date", "newspaper", first.alias("first_page"))
    return rows.orderBy(F.desc("issue_date"), "first_page", "article_id").limit(limit)


def count_ads(ar: Archive, f: Filters) -> DataFrame:
    """Advertisements per paper."""
    ar = narrowed(ar, f, ["issues", "articles"]).where(articles=F.col("article_type") == "advertisement")
    rows = apply_filters(ar.dated_articles, f)
    return rows.groupBy("newspaper").agg(F.count("*").alias("advertisements"), F.min("issue_date").alias("first_date"), F.max("issue_date").alias("last_date"))


def count_issues(ar: Archive, f: Filters) -> DataFrame:
    """Issues and roster per paper; without a hit the archive's bounds over all papers."""
    hit = apply_filters(ar.issue_papers, f)
    agg = [F.count("*").alias("issues"), F.min("issue_date").alias("first_date"), F.max("issue_date").alias("last_date")]
    roster = hit.groupBy("newspaper").agg(*agg)
    bounds = ar.issue_papers.agg(F.lit(0).cast("long").alias("issues"), *agg[1:]).withColumn("newspaper", F.lit("(archive)"))
    return roster.unionByName(bounds.join(hit.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_anti"))


def visual_counts(ar: Archive) -> DataFrame:
    """Visual chunks per section of their article; a missing section is unassigned."""
    v = ar.chunks.where(F.col("chunk_type") == "visual").join(ar.dated_articles.select("article_id", "section"), "article_id")
    return v.groupBy(F.coalesce("section", F.lit("Unassigned")).alias("section")).agg(F.count("*").alias("visuals"))


def newspaper_roster(ar: Archive) -> DataFrame:
    """A10: issues, articles and date range of every paper, those without an issue included.

    Both sides are aggregated before they are joined, so nothing fans out.
    """
    i = ar.issues.groupBy(F.col("newspaper_id").alias("id")).agg(F.count("*").alias("issues"), F.min("issue_date").alias("first_date"), F.max("issue_date").alias("last_date"))
    a = ar.articles.join(ar.issues.select(F.col("id").alias("issue_id"), "newspaper_id"), "issue_id").groupBy(F.col("newspaper_id").alias("id")).agg(F.count("*").alias("articles"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ar.newspapers.select("id", "name").join(i, "id", "left").join(a, "id", "left").select("id", "name", zero("issues"), zero("articles"), "first_date", "last_date")


def issue_list(ar: Archive) -> DataFrame:
    """Articles and chunks of every issue."""
    a = ar.articles.groupBy("issue_id").agg(F.count("*").alias("articles"))
    owner = ar.articles.select(F.col("id").alias("article_id"), "issue_id")
    c = ar.chunks.join(owner, "article_id").groupBy("issue_id").agg(F.count("*").alias("chunks"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return ar.issue_papers.join(a, "issue_id", "left").join(c, "issue_id", "left").select("issue_id", "newspaper", "issue_date", "edition", zero("articles"), zero("chunks"))


def archive_bounds(ar: Archive) -> DataFrame:
    """Bounds and number of ready issues per paper."""
    ready = ar.issue_papers.where(F.col("ingestion_status").isin(*READY))
    return ready.groupBy("newspaper").agg(F.min("issue_date").alias("first_date"), F.max("issue_date").alias("last_date"), F.count("*").alias("issues"))


def word_stats(ar: Archive) -> DataFrame:
    """Word-count statistics over articles that have words."""
    a = ar.articles.where(F.col("word_count") > 0)
    return a.agg(F.sum("word_count").alias("total_words"), F.round(F.avg("word_count"), 2).alias("avg_words"), F.min("word_count").alias("min_words"), F.max("word_count").alias("max_words"), F.count("*").alias("articles"))


def daily_correlation(ar: Archive, period: str = "day") -> DataFrame:
    """Pearson correlation of the counts per day, or longer period, of each pair of papers, over those in which both have articles (two at least); null where one does not vary."""
    d = ar.dated_articles.groupBy("newspaper", F.date_trunc(period, "issue_date").alias("issue_date")).agg(F.count("*").cast("double").alias("n"))
    x, y = d.select(F.col("newspaper").alias("paper_a"), "issue_date", F.col("n").alias("x")), d.select(F.col("newspaper").alias("paper_b"), "issue_date", F.col("n").alias("y"))
    p = x.join(y, "issue_date").where("paper_a < paper_b").groupBy("paper_a", "paper_b").agg(F.count("*").alias("n_days"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))
    r = F.when(F.isnan("r"), None).otherwise(F.round("r", 6))
    return p.where("n_days >= 2").select("paper_a", "paper_b", "n_days", r.alias("correlation"))


def section_word_stats(ar: Archive) -> DataFrame:
    """Number, mean, sample variance and deviation, and median of word counts per section."""
    a = ar.articles.where("word_count > 0").groupBy(label("section", "General").alias("section"))
    r = lambda c, n: F.round(c, 4).alias(n)
    return a.agg(F.count("*").alias("articles"), r(F.avg("word_count"), "mean"), r(F.var_samp("word_count"), "variance"), r(F.stddev_samp("word_count"), "deviation"), r(F.median("word_count"), "median"))


def distribution_stats(ar: Archive) -> DataFrame:
    """Percentiles, Gini coefficient, Pearson, Spearman and regression of prominence on word count."""
    a = ar.articles.where("word_count > 0").select(F.col("word_count").cast("double").alias("w"), F.col("prominence_score").alias("p"), "id")
    by = a.groupBy("w").agg(F.count("*").alias("k"))
    cum = by.select("w", "k", (F.sum("k").over(Window.orderBy("w")) - F.col("k")).alias("before"))
    byp = a.groupBy("p").agg(F.count("*").alias("kp"))
    cump = byp.select("p", "kp", (F.sum("kp").over(Window.orderBy("p")) - F.col("kp")).alias("beforep"))
    ranked = a.join(cum, "w").join(cump, "p").select("w", "p", (F.col("before") + (F.col("k") + 1) / 2).alias("rw"), (F.col("beforep") + (F.col("kp") + 1) / 2).alias("rp"))
    # with equal values at their mean rank the sum of rank times value is that of any order
    gini = 2 * F.sum(F.col("rw") * F.col("w")) / (F.count("*") * F.sum("w")) - (F.count("*") + 1) / F.count("*")
    r = lambda c, name: F.round(c, 6).alias(name)
    return ranked.agg(
        F.count("*").alias("articles"), r(F.percentile("w", F.lit(0.25)), "p25"), r(F.percentile("w", F.lit(0.9)), "p90"), r(gini, "gini"), r(F.corr("w", "p"), "pearson"), r(F.corr("rw", "rp"), "spearman"),
        r(F.regr_slope("p", "w"), "slope"), r(F.regr_intercept("p", "w"), "intercept"), r(F.regr_r2("p", "w"), "r2"),
    )


def word_histogram(ar: Archive, width: int = 100, buckets: int = 10) -> DataFrame:
    """Articles per word-count bucket of fixed width; the last bucket is open."""
    b = F.least(F.floor(F.col("word_count") / width), F.lit(buckets - 1)).cast("int")
    return ar.articles.groupBy(b.alias("bucket")).agg(F.count("*").alias("articles"))


def moving_average(ar: Archive, days: int = 7) -> DataFrame:
    """Articles per date with the mean of the last ``days`` dates that have articles."""
    d = ar.dated_articles.groupBy("issue_date").agg(F.count("*").alias("articles"))
    return d.select("issue_date", "articles", F.round(F.avg("articles").over(Window.orderBy("issue_date").rowsBetween(1 - days, 0)), 4).alias("moving_average"))


def section_trend(ar: Archive, period: str = "month") -> DataFrame:
    """A2 with the period applied: articles, words and mean prominence per period and section."""
    t = F.date_format(F.date_trunc(period, "issue_date"), "yyyy-MM-dd")
    g = ar.dated_articles.groupBy(t.alias("period"), label("section", "General").alias("section"))
    return g.agg(F.count("*").alias("articles"), F.sum("word_count").alias("words"), F.round(F.avg("prominence_score") + 1e-9, 3).alias("avg_prominence"))


def consensus_brand(ar: Archive) -> DataFrame:
    """The brand most printed on an issue's pages (ties: the smaller name)."""
    p = ar.table("page_layouts").where(F.trim("newspaper_brand") != "").groupBy("issue_id", F.trim(F.lower("newspaper_brand")).alias("brand")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("issue_id").orderBy(F.desc("votes"), "brand")
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").select("issue_id", "brand", "votes")


def status_tally(ar: Archive) -> DataFrame:
    """Issues per ingestion status."""
    return ar.issues.groupBy("ingestion_status").agg(F.count("*").alias("issues"))


def distinct_papers(ar: Archive) -> DataFrame:
    """Names of papers with an article."""
    return ar.dated_articles.select("newspaper").distinct()


def upsert_max(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key the larger value of both sides."""
    return old.select(*keys, *values).unionByName(new.select(*keys, *values)).groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def upserted_sections(ar: Archive) -> DataFrame:
    """A18 over section prominence of the articles before and from 2025 on."""
    part = lambda cond: ar.dated_articles.where(cond).groupBy("newspaper_id", "section").agg(F.count("*").alias("mentions"), F.round(F.max("prominence_score"), 4).alias("salience"))
    return upsert_max(part("issue_date < '2025-01-01'"), part("issue_date >= '2025-01-01'"), ["newspaper_id", "section"], ["mentions", "salience"])


def cost_rollup(ar: Archive) -> DataFrame:
    """Price of the chunks' tokens by the first matching pattern of a price list."""
    prices = ar.spark.createDataFrame([(1, "visual", 2.5), (2, "text", 0.6), (3, "", 1.0)], "ord int, pattern string, price double")
    c = ar.chunks.select("id", "chunk_type", F.coalesce(F.col("token_count"), F.lit(0)).alias("tokens"))
    hit = c.join(F.broadcast(prices), F.col("chunk_type").contains(F.col("pattern")))  # three fixed rows
    first = hit.groupBy("id", "chunk_type", "tokens").agg(F.min_by("price", "ord").alias("price"))
    return first.groupBy("chunk_type").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * F.col("price") / 1e6), 4).alias("cost"))


def page_leads(ar: Archive) -> DataFrame:
    """The stories of each page in order of prominence; rank 1 leads the page."""
    w = Window.partitionBy("issue_id", "page_number").orderBy(prominence_rank(F.col("prominence")), "article_id")
    return ar.stories.select("issue_id", "page_number", "article_id", F.row_number().over(w).alias("rank_on_page")).where("rank_on_page <= 3")


def page_slice(ar: Archive, limit: int = 20, offset: int = 40) -> DataFrame:
    """L4: one page of the article listing, with whether more follow."""
    rows = ar.articles.orderBy(F.desc("prominence_score"), "id").offset(offset).limit(limit + 1)
    n = rows.agg((F.count("*") > limit).alias("has_more"))
    return rows.orderBy(F.desc("prominence_score"), "id").limit(limit).select(F.col("id").alias("article_id"), "prominence_score").join(F.broadcast(n))


def balanced_budget(ar: Archive, papers: int = 4) -> DataFrame:
    """Evidence of several papers under one budget: at most max(8, 32 // p) each and max(36, 16 p) in all, taken in turns."""
    each, total = max(8, 32 // papers), max(36, 16 * papers)
    chosen = ar.newspapers.orderBy("id").limit(papers).select(F.col("id").alias("newspaper_id"))
    w = Window.partitionBy("newspaper_id").orderBy(F.desc("prominence_score"), "article_id")
    rows = ar.dated_articles.join(chosen, "newspaper_id", "left_semi").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= each)
    return rows.orderBy("turn", "newspaper_id").limit(total).select("newspaper_id", "article_id", "turn")


def shared_sections(ar: Archive) -> DataFrame:
    """Set operations: sections of both 2024 and 2025, of 2024 alone and of either year."""
    of = lambda y: ar.dated_articles.where(F.year("issue_date") == y).select("section").where("section is not null")
    a, b = of(2024), of(2025)
    tag = lambda d, t: d.select(F.lit(t).alias("op"), "section")
    return tag(a.intersect(b), "both").unionAll(tag(a.subtract(b), "first")).unionAll(tag(a.union(b).distinct(), "either"))


def grouping_extras(ar: Archive) -> DataFrame:
    """Cube over year and article type: an addition beside the reference's aggregates."""
    c = ar.dated_articles.cube(F.year("issue_date").alias("year"), "article_type").agg(F.count("*").alias("articles"), F.grouping_id().cast("long").alias("level"))
    return c.select("year", "article_type", "level", "articles")


def date_forms(ar: Archive) -> DataFrame:
    """P5: the page's printed date in ISO form; text of another form stays as it is."""
    from quarto.functions.dates import iso_date

    return ar.table("page_layouts").select("layout_id", iso_date(F.col("issue_date")).alias("iso_date"))


def _q(f, *args, **kw):
    return lambda spark, root: f(Archive(spark, root), *args, **kw)


_F = Filters(newspaper="ostelby", date_from="2024-01-01", date_to="2024-12-31")
_P = Filters(newspaper="ostelby", date_from="2024-01-01", date_to="2025-12-31", page=1)
_DAY = Filters(issue_date="15/2/2024", date_from="2030-01-01")

QUERIES = {
    "a01_availability": _q(availability),
    "a02_section_trend": _q(section_trend),
    "a03_topic_distribution": _q(topic_distribution),
    "a04_front_page_ratio": _q(front_page_ratio),
    "a04_page_distribution": _q(page_distribution),
    "a05_issue_manifest": _q(issue_manifest, Filters(newspaper="ostelby")),
    "a05_manifest_breakdown": _q(manifest_breakdown, Filters(newspaper="ostelby")),
    "a06_count_articles": _q(count_articles, _P),
    "a06_list_articles": _q(list_articles, _F),
    "a07_count_ads": _q(count_ads, Filters()),
    "a08_count_issues": _q(count_issues, _F),
    "a08_count_issues_none": _q(count_issues, Filters(newspaper="no such paper")),
    "a09_visual_counts": _q(visual_counts),
    "a10_newspaper_roster": _q(newspaper_roster),
    "a11_issue_list": _q(issue_list),
    "a12_archive_bounds": _q(archive_bounds),
    "a13_word_stats": _q(word_stats),
    "a14_daily_correlation": _q(daily_correlation),
    "a14_monthly_correlation": _q(lambda ar: daily_correlation(ar, "month")),
    "a14_section_word_stats": _q(section_word_stats),
    "a15_distribution_stats": _q(distribution_stats),
    "a15_word_histogram": _q(word_histogram),
    "a16_consensus_brand": _q(consensus_brand),
    "a17_status_tally": _q(status_tally),
    "a18_upsert_max": _q(upserted_sections),
    "a20_cost_rollup": _q(cost_rollup),
    "a21_distinct_papers": _q(distinct_papers),
    "w03_latest_issue": _q(lambda ar: latest_issue(ar, Filters(newspaper="herald")).select("issue_id", "newspaper", "issue_date")),
    "w08_moving_average": _q(moving_average),
    "w11_page_leads": _q(page_leads),
    "l04_page_slice": _q(page_slice),
    "l07_balanced_budget": _q(balanced_budget),
    "v00_set_operations": _q(shared_sections),
    "x_cube": _q(grouping_extras),
    "f04_exact_date": _q(lambda ar: apply_filters(ar.issue_papers, _DAY).select("issue_id", "newspaper")),
    "f05_iso_dates": _q(date_forms),
}

_F_SQL = "newspaper ilike '%ostelby%' and issue_date between date '2024-01-01' and date '2024-12-31'"
_GENERAL = "coalesce(nullif(section, ''), 'General')"
_RANK = "case prominence when 'lead' then 1 when 'major' then 2 when 'standard' then 3 when 'minor' then 4 else 5 end"
_MANIFEST = f"""{SQL}, latest as (select issue_id from issue_papers where newspaper ilike '%ostelby%' order by issue_date desc, issue_id desc limit 1),
m as (select issue_id, article_id, page_number, coalesce(nullif(headline, ''), 'Untitled Article') headline, {_GENERAL} section, article_type, {_RANK} prominence_rank from stories join latest using (issue_id))"""

ORACLE = {
    "a01_availability": SQL + "select issue_date, string_agg(distinct newspaper, ', ' order by newspaper) papers, count(distinct newspaper) n_papers from issue_papers where ingestion_status in ('completed','indexed','ready') group by 1",
    "a02_section_trend": SQL + f"select strftime(date_trunc('month', issue_date), '%Y-%m-%d') period, {_GENERAL} section, count(*) articles, cast(sum(word_count) as bigint) words, round(avg(prominence_score) + 1e-9, 3) avg_prominence from dated_articles group by 1, 2",
    "a03_topic_distribution": SQL + "select coalesce(nullif(section, ''), 'General') section, article_type, n articles, p avg_prominence from (select section, article_type, count(*) n, round(avg(prominence_score) + 1e-9, 3) p from dated_articles group by 1, 2)",
    "a04_front_page_ratio": SQL + ", g as (select page_number, count(distinct article_id) n from story_pages group by 1) select cast(sum(n) as bigint) total_articles, cast(coalesce(sum(n) filter (page_number = 1), 0) as bigint) frontpage_articles, count(*) pages, round(coalesce(sum(n) filter (page_number = 1), 0) / sum(n), 4) frontpage_ratio from g",
    "a04_page_distribution": SQL + "select page_number, count(distinct article_id) articles from story_pages group by 1",
    "a05_issue_manifest": _MANIFEST + " select * from m",
    "a05_manifest_breakdown": _MANIFEST + " select 'section' breakdown, section as name, count(*) articles from m group by 2 union all select 'type', coalesce(article_type, 'unknown'), count(*) from m group by 2",
    "a06_count_articles": SQL + "select count(distinct article_id) articles from stories where newspaper ilike '%ostelby%' and issue_date between date '2024-01-01' and date '2025-12-31' and article_id in (select article_id from story_pages where page_number = 1)",
    "a06_list_articles": SQL + f"select article_id, coalesce(nullif(headline, ''), 'Untitled Article') headline, {_GENERAL} section, article_type, issue_date, newspaper, least(page_number, coalesce(continues_to_page, page_number)) first_page from stories where {_F_SQL} order by issue_date desc, first_page, article_id limit 30",
    "a07_count_ads": SQL + "select newspaper, count(*) advertisements, min(issue_date) first_date, max(issue_date) last_date from dated_articles where article_type = 'advertisement' group by 1",
    "a08_count_issues": SQL + f"select newspaper, count(*) issues, min(issue_date) first_date, max(issue_date) last_date from issue_papers where {_F_SQL} group by 1",
    "a08_count_issues_none": SQL + "select '(archive)' newspaper, cast(0 as bigint) issues, min(issue_date) first_date, max(issue_date) last_date from issue_papers",
    "a09_visual_counts": SQL + "select coalesce(section, 'Unassigned') section, count(*) visuals from (select distinct id, article_id from article_chunks where chunk_type = 'visual') join dated_articles using (article_id) group by 1",
    "a10_newspaper_roster": SQL + "select n_.newspaper_id id, newspaper as name, count(distinct i_.issue_id) issues, count(distinct article_id) articles, min(issue_date) first_date, max(issue_date) last_date from n_ left join i_ using (newspaper_id) left join a_ on a_.issue_id = i_.issue_id group by 1, 2",
    "a11_issue_list": SQL + "select p.issue_id, newspaper, issue_date, edition, count(distinct a_.article_id) articles, count(distinct c.id) chunks from issue_papers p left join a_ on a_.issue_id = p.issue_id left join (select distinct id, article_id from article_chunks) c on c.article_id = a_.article_id group by 1, 2, 3, 4",
    "a12_archive_bounds": SQL + "select newspaper, min(issue_date) first_date, max(issue_date) last_date, count(*) issues from issue_papers where ingestion_status in ('completed','indexed','ready') group by 1",
    "a13_word_stats": SQL + "select cast(sum(word_count) as bigint) total_words, round(avg(word_count), 2) avg_words, min(word_count) min_words, max(word_count) max_words, count(*) articles from a_ where word_count > 0",
    "a14_daily_correlation": SQL + ", d as (select newspaper, issue_date, count(*) n from dated_articles group by 1, 2) select a.newspaper paper_a, b.newspaper paper_b, count(*) n_days, case when isnan(corr(a.n, b.n)) then null else round(corr(a.n, b.n), 6) end correlation from d a join d b using (issue_date) where a.newspaper < b.newspaper group by 1, 2 having count(*) >= 2",
    "a14_section_word_stats": SQL + f"select {_GENERAL} section, count(*) articles, round(avg(word_count), 4) mean, round(var_samp(word_count), 4) variance, round(stddev_samp(word_count), 4) deviation, round(median(word_count), 4) median from a_ where word_count > 0 group by 1",
    "a15_distribution_stats": SQL + """, t as (select cast(word_count as double) w, prominence_score p, rank() over (order by word_count) + (count(*) over (partition by word_count) - 1) / 2.0 rw,
        rank() over (order by prominence_score) + (count(*) over (partition by prominence_score) - 1) / 2.0 rp, row_number() over (order by word_count, article_id) i from a_ where word_count > 0)
        select count(*) articles, round(quantile_cont(w, 0.25), 6) p25, round(quantile_cont(w, 0.9), 6) p90, round(2 * sum(i * w) / (count(*) * sum(w)) - (count(*) + 1) / count(*), 6) gini,
        round(corr(w, p), 6) pearson, round(corr(rw, rp), 6) spearman, round(regr_slope(p, w), 6) slope, round(regr_intercept(p, w), 6) as "intercept", round(regr_r2(p, w), 6) r2 from t""",
    "a15_word_histogram": SQL + "select cast(least(floor(word_count / 100), 9) as integer) bucket, count(*) articles from a_ group by 1",
    "a16_consensus_brand": "select issue_id, brand, votes from (select issue_id, trim(lower(newspaper_brand)) brand, count(*) votes, row_number() over (partition by issue_id order by count(*) desc, trim(lower(newspaper_brand))) r from page_layouts where trim(newspaper_brand) <> '' group by 1, 2) where r = 1",
    "a17_status_tally": SQL + "select ingestion_status, count(*) issues from i_ group by 1",
    "a18_upsert_max": SQL + ", g as (select newspaper_id, section, year(issue_date) >= 2025 late, count(*) m, round(max(prominence_score), 4) s from dated_articles group by 1, 2, 3) select newspaper_id, section, max(m) mentions, max(s) salience from g group by 1, 2",
    "a20_cost_rollup": "select chunk_type, cast(sum(tokens) as bigint) tokens, round(sum(tokens * price / 1e6), 4) as cost from (select id, chunk_type, coalesce(token_count, 0) tokens, case when chunk_type like '%visual%' then 2.5 when chunk_type like '%text%' then 0.6 else 1.0 end::double price from (select distinct id, chunk_type, token_count from article_chunks)) group by 1",
    "a21_distinct_papers": SQL + "select distinct newspaper from dated_articles",
    "w03_latest_issue": SQL + "select issue_id, newspaper, issue_date from issue_papers where newspaper ilike '%herald%' order by issue_date desc, issue_id desc limit 1",
    "w08_moving_average": SQL + ", d as (select issue_date, count(*) articles from dated_articles group by 1) select issue_date, articles, round(avg(articles) over (order by issue_date rows between 6 preceding and current row), 4) moving_average from d",
    "w11_page_leads": SQL + f"select issue_id, page_number, article_id, cast(r as integer) rank_on_page from (select *, row_number() over (partition by issue_id, page_number order by {_RANK}, article_id) r from stories) where r <= 3",
    "l04_page_slice": SQL + "select article_id, prominence_score, (select count(*) from a_) > 60 has_more from a_ order by prominence_score desc, article_id limit 20 offset 40",
    "l07_balanced_budget": SQL + "select newspaper_id, article_id, cast(turn as integer) turn from (select *, row_number() over (partition by newspaper_id order by prominence_score desc, article_id) turn from dated_articles where newspaper_id in (select newspaper_id from n_ order by 1 limit 4)) where turn <= 8 order by turn, newspaper_id limit 64",
    "v00_set_operations": SQL + ", s as (select year(issue_date) y, section from dated_articles where section is not null), a as (select section from s where y = 2024), b as (select section from s where y = 2025) select 'both' op, section from (select * from a intersect select * from b) union all select 'first', section from (select * from a except select * from b) union all select 'either', section from (select * from a union select * from b)",
    "x_cube": SQL + "select year, article_type, cast(grouping(year, article_type) as bigint) as level, count(*) articles from (select cast(year(issue_date) as integer) as year, article_type from dated_articles) group by cube (year, article_type)",
    "f04_exact_date": SQL + "select issue_id, newspaper from issue_papers where issue_date = date '2024-02-15'",
    "f05_iso_dates": r"""select layout_id, case
        when regexp_matches(issue_date, '^\d{4}-\d{1,2}-\d{1,2}$') then printf('%s-%02d-%02d', split_part(issue_date, '-', 1), cast(split_part(issue_date, '-', 2) as integer), cast(split_part(issue_date, '-', 3) as integer))
        when regexp_matches(issue_date, '^\d{1,2}[/-]\d{1,2}[/-]\d{4}$') then (select printf('%s-%02d-%02d', p[3], case when b > 12 and a <= 12 then a else b end, case when b > 12 and a <= 12 then b else a end) from (select regexp_split_to_array(issue_date, '[/-]') p, cast(p[1] as integer) a, cast(p[2] as integer) b))
        else issue_date end iso_date from page_layouts""",
}

ORACLE["a14_monthly_correlation"] = ORACLE["a14_daily_correlation"].replace("select newspaper, issue_date, count(*) n", "select newspaper, date_trunc('month', issue_date) issue_date, count(*) n")
