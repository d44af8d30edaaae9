"""The archive's relations over the Parquet tables.

Rows that occur again as exact copies count once. ``stories`` are the articles
as laid out on pages, with their issue and paper; ``story_pages`` has one row
per story and page, where a story that continues has two.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.sources.tables import read_table

READY = ("completed", "indexed", "ready")


class Archive:
    """The tables under a root. ``keep`` has a condition per table that rows must meet; it is applied before copies are dropped, so it reaches the scan."""

    def __init__(self, spark: SparkSession, root: str, keep: dict[str, Column] | None = None):
        self.spark, self.root, self.keep = spark, root, keep or {}

    def table(self, name: str) -> DataFrame:
        t = read_table(self.spark, self.root, name)
        return t.where(self.keep[name]) if name in self.keep else t

    def where(self, **conditions: Column) -> Archive:
        """The archive with further conditions per table, of copies of a row all or none."""
        both = {n: c & self.keep[n] if n in self.keep else c for n, c in conditions.items()}
        return Archive(self.spark, self.root, self.keep | both)

    def of_issue(self, issue_id: int) -> Archive:
        """The archive of one issue: its pages, articles and itself."""
        return self.where(issues=F.col("id") == issue_id, articles=F.col("issue_id") == issue_id, page_layouts=F.col("issue_id") == issue_id)

    @cached_property
    def newspapers(self) -> DataFrame:
        return self.table("newspapers")

    @cached_property
    def issues(self) -> DataFrame:
        return self.table("issues").dropDuplicates(["id"])

    @cached_property
    def articles(self) -> DataFrame:
        return self.table("articles").dropDuplicates(["id"])

    @cached_property
    def chunks(self) -> DataFrame:
        return self.table("article_chunks").dropDuplicates(["id"])

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("vector_points").dropDuplicates(["id"])

    @cached_property
    def issue_papers(self) -> DataFrame:
        """(issue_id, newspaper_id, newspaper, issue_date, edition, ingestion_status) of issues whose paper exists."""
        n = self.newspapers.select(F.col("id").alias("newspaper_id"), F.col("name").alias("newspaper"))
        i = self.issues.select(F.col("id").alias("issue_id"), "newspaper_id", "issue_date", "edition", "ingestion_status")
        return i.join(n, "newspaper_id")

    @cached_property
    def dated_articles(self) -> DataFrame:
        """Articles with their issue and paper."""
        a = self.articles.withColumnRenamed("id", "article_id").drop("created_at")
        return a.join(self.issue_papers, "issue_id")

    @cached_property
    def stories(self) -> DataFrame:
        s = self.table("article_skeletons").withColumnRenamed("skeleton_id", "article_id").drop("newspaper_id")
        p = self.table("page_layouts").select("layout_id", "issue_id", "page_number", "is_advertisement_page")
        if "page_layouts" in self.keep:  # few pages: their stories first, then the copies
            s = s.join(p.select("layout_id"), "layout_id", "left_semi")
        return s.dropDuplicates(["article_id"]).join(p, "layout_id").join(self.issue_papers, "issue_id")

    @cached_property
    def story_pages(self) -> DataFrame:
        """(article_id, issue_id, newspaper_id, page_number) of each story's pages."""
        s = self.stories.select("article_id", "issue_id", "newspaper_id", F.explode(F.array_distinct(F.array_compact(F.array("page_number", "continues_to_page")))).alias("page_number"))
        return s


#: The same relations for DuckDB, as the head of a query.
SQL = """
with n_ as (select id newspaper_id, name newspaper from newspapers),
i_ as (select distinct id issue_id, newspaper_id, issue_date, edition, ingestion_status from issues),
issue_papers as (select i_.*, newspaper from i_ join n_ using (newspaper_id)),
a_ as (select distinct id article_id, issue_id, headline, byline_author, section, article_type, lang, prominence_score, word_count, full_text from articles),
dated_articles as (select a_.*, newspaper_id, newspaper, issue_date, edition, ingestion_status from a_ join issue_papers using (issue_id)),
s_ as (select distinct skeleton_id article_id, layout_id, headline, byline, body_text, section, article_type, prominence, bbox, continues_to_page from article_skeletons),
stories as (select s_.*, issue_id, page_number, is_advertisement_page, newspaper_id, newspaper, issue_date, edition, ingestion_status
            from s_ join (select layout_id, issue_id, page_number, is_advertisement_page from page_layouts) using (layout_id) join issue_papers using (issue_id)),
story_pages as (select article_id, issue_id, newspaper_id, page_number from stories
                union select article_id, issue_id, newspaper_id, continues_to_page from stories where continues_to_page is not null)
"""
