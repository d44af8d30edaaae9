"""Filters behind retrieval, visual assets, evidence checks, and what is written back about articles.

Everything is expressions, equality joins and windows; only broken JSON is read
row by row, in Arrow batches.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarto.functions import text as T
from quarto.operators import documents, layout, mutations, retrieval
from quarto.plans.filters import names_compatible, pages_overlap
from quarto.sources.archive import SQL, Archive

# Words of a wished category, and the words of an article's category and section that meet it.
BRIDGES = [
    (["econom", "financ", "business", "market"], ["business", "market", "econom", "financ", "trade", "commerce", "money", "industry", "corporate"]),
    (["world", "international", "geopolitic", "foreign", "global"], ["world", "international", "global", "foreign", "diplomacy"]),
    (["opinion", "editorial", "column", "commentary"], ["opinion", "editorial", "column", "commentary", "view"]),
    (["crime", "law", "legal", "court"], ["crime", "law", "legal", "court", "police", "justice"]),
]
# Patterns of the article type's ladder.
EDITORIAL_WORDS = r"(?i)\b(?:editorial|opinion|commentary|op-ed|column|columnist|letters\s+to\s+the\s+editor|perspective|viewpoint|our\s+view|my\s+view|their\s+view|quick\s+edit)\b"
STRONG_AD = r"(?i)\b(?:advertisement|advertorial|special\s+promotional\s+feature|sponsored\s+feature|red\s+herring\s+prospectus|book\s+running\s+lead\s+manager|public\s+notice|statutory\s+notice|tender\s+notice|corrigendum|classifieds?|special\s+offer|call\s+now|toll\s+free)\b"
OFFER = r"(?i)\b(?:for\s+sale|auction\s+sale|discount\s+rates?|inquiries|book\s+now|limited\s+period\s+offer)\b"
DATELINE = r"(?im)^\s*[A-Z][A-Z\s,/.-]{2,30}\s*:\s+|\b(?:correspondent|bureau|reuters|pti|ani|bloomberg|press\s+trust)\b"
TABLE_WORDS = r"(?i)(?:\d+\.\d{2}|\b(?:high|low|close|volume|yield|prev|change|indices|stock|commodity)\b)"
SIDEBAR_WORDS = r"(?i)\b(?:sidebar|box\s+story|highlights|key\s+takeaways|at\s+a\s+glance|in\s+a\s+nutshell|quick\s+facts)\b"
# Types and prominences of a model's layout, words that leave a headline open.
LAYOUT_TYPES = ["news", "editorial", "sidebar", "advertisement", "photo_caption", "table_data", "index", "teaser", "unknown"]
PROMINENCES = ["lead", "major", "standard", "minor", "filler"]
OPEN_WORDS = "and or to in of for with the a an on at by from as".split()


def category_gate(request: str, meta: Column, article_type: Column) -> Column:
    """Whether an article's category words (``meta``, lower case) meet a wished category: by its bridge, else by the request or one of its words."""
    low = request.strip().lower()
    holds = lambda words: T.any_of([meta.contains(w) for w in words])
    for asks, meets in BRIDGES:
        if any(w in low for w in asks):
            return holds(meets) | (F.coalesce(article_type == "editorial", F.lit(False)) if "opinion" in meets else F.lit(False))
    words = [w for w in re.split(r"[\s/&]+", low) if len(w) >= 3 and w not in ("and", "the", "for")]
    return holds([low, *words])


def payload_filter(payload: Column, filters: dict[str, Any]) -> Column:
    """Predicate on a JSON payload: a value, or bounds (gte, gt, lte, lt) of numbers or ISO dates.

    Equal bounds are a value. Two dates at most 366 days apart mean any day
    between them, as written; dates further apart or open compare as whole
    numbers YYYYMMDD. Bounds that are no dates are ignored.
    """
    field = lambda key: F.get_json_object(payload, f"$.{key}")

    def same(key: str, value: Any) -> Column:
        return field(key) == F.lit(value) if isinstance(value, str) else field(key).try_cast("double") == float(value)

    def one(key: str, value: Any) -> Column:
        if not isinstance(value, dict):
            return same(key, value)
        if value.get("gte") is not None and value.get("gte") == value.get("lte"):
            return same(key, value["gte"])
        compare = {"gte": lambda a, b: a >= b, "gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "lt": lambda a, b: a < b}
        if not any(isinstance(v, str) and "-" in v for v in value.values()):
            return reduce(lambda a, b: a & b, [compare[k](field(key).try_cast("double"), float(v)) for k, v in value.items() if k in compare], F.lit(True))
        days = {}
        for k, v in value.items():
            try:
                days[k] = dt.date.fromisoformat(str(v)[:10])
            except ValueError:
                continue
        lo, hi = days.get("gte", days.get("gt")), days.get("lte", days.get("lt"))
        if lo and hi and 0 <= (hi - lo).days <= 366:
            return field(key).between(lo.isoformat(), hi.isoformat()) & (F.length(field(key)) == 10)
        number = F.replace(F.substring(field(key), 1, 10), F.lit("-"), F.lit("")).try_cast("int")
        return reduce(lambda a, b: a & b, [compare[k](number, int(d.strftime("%Y%m%d"))) for k, d in days.items() if k in compare], F.lit(True))

    return F.coalesce(reduce(lambda a, b: a & b, [one(k, v) for k, v in filters.items()], F.lit(True)), F.lit(False))


@dataclass(frozen=True)
class SearchFilters:
    """What search results must meet; each only if given."""

    article_type: str | None = None
    min_prominence: float | None = None
    category: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    page: int | None = None
    exclude_pages: tuple[int, ...] = ()


def post_filtered(rows: DataFrame, f: SearchFilters) -> DataFrame:
    """The rows (with article_type, prominence_score, section, issue_date, and pages where page filters are given) that meet the filters.

    Applied behind the top-k, as of old; ``rows`` may also be the candidates
    before it, which then fill the k.
    """
    out = rows
    if f.article_type:
        out = out.where(F.col("article_type") == f.article_type)
    if f.min_prominence:
        out = out.where(F.col("prominence_score") >= f.min_prominence)
    if f.category:
        out = out.where(category_gate(f.category, F.lower(F.coalesce("section", F.lit(""))), F.col("article_type")))
    if f.date_from and len(f.date_from) == 10:
        out = out.where(F.col("issue_date").isNull() | (F.col("issue_date") >= F.lit(f.date_from).cast("date")))
    if f.date_to and len(f.date_to) == 10:
        out = out.where(F.col("issue_date").isNull() | (F.col("issue_date") <= F.lit(f.date_to).cast("date")))
    if f.exclude_pages:
        out = out.where(pages_overlap("pages", list(f.exclude_pages), exclude=True))
    if f.page is not None:
        out = out.where(F.array_contains("pages", f.page))
    return out


def filtered_hybrid(ar: Archive, f: SearchFilters) -> DataFrame:
    """Fused search results that meet the filters."""
    a = ar.dated_articles.select("article_id", "article_type", "prominence_score", "section", "issue_date")
    return post_filtered(retrieval.hybrid(ar).join(a, "article_id"), f).select("query_id", "article_id", "rrf_score")


def category_of(ar: Archive) -> DataFrame:
    """(article_id, section_id) of every article: the listed section of its section's name, else of its type's, null without; two equality joins in place of one by OR."""
    s = ar.table("section_list").select(F.lower(F.trim("section_name")).alias("k"), "section_id").groupBy("k").agg(F.min("section_id").alias("section_id"))
    a = ar.articles.select(F.col("id").alias("article_id"), F.lower(F.trim("section")).alias("sec"), F.lower(F.trim("article_type")).alias("typ"))
    a = a.join(s.select(F.col("k").alias("sec"), F.col("section_id").alias("by_section")), "sec", "left").join(s.select(F.col("k").alias("typ"), F.col("section_id").alias("by_type")), "typ", "left")
    return a.select("article_id", F.coalesce("by_section", "by_type").alias("section_id"))


def context_conflicts(ar: Archive) -> DataFrame:
    """(id, date_conflict, paper_conflict, section_conflict): where a vector's payload contradicts the article it stands for."""
    g = lambda k: F.get_json_object("payload", f"$.{k}")
    v = ar.vectors.select("id", retrieval.number_key(g("article_id")).try_cast("long").alias("article_id"), g("issue_date").alias("d"), g("newspaper_name").alias("p"), g("section").alias("s"))
    j = v.join(ar.dated_articles.select("article_id", "issue_date", "newspaper", "section"), "article_id")
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select("id", no(F.col("d") != F.col("issue_date").cast("string")).alias("date_conflict"), no(~names_compatible(F.col("p"), F.col("newspaper"))).alias("paper_conflict"), no(F.lower("s") != F.lower("section")).alias("section_conflict"))


def visual_assets(ar: Archive, words: list[str], layouts: DataFrame | None = None, limit: int = 6) -> DataFrame:
    """(item_id, kind, strategy, score): pictures and tables for a question, charts first.

    A visual is found by its caption, by the headline of the story it belongs
    to, else only by its page; the better way counts. The score is the number of
    the question's words met, 4 at most.
    """
    v = layout.page_items(ar).where(F.col("label").isin("picture", "table"))
    v = v.join(layouts, "layout_id", "left_semi") if layouts is not None else v
    bound = layout.photo_bindings(ar).join(ar.stories.select("article_id", F.lower(F.coalesce("headline", F.lit(""))).alias("head")), "article_id").select("item_id", "head")
    met = lambda c: reduce(lambda a, b: a + b, [F.coalesce(F.lower(c).contains(w.lower()), F.lit(False)).cast("int") for w in words], F.lit(0))
    v = v.join(bound, "item_id", "left").select("item_id", F.when(F.col("label") == "table", "chart").otherwise("photo").alias("kind"), met(F.col("text")).alias("caption"), met(F.col("head")).alias("story"))
    strategy = F.when(F.col("caption") > 0, "caption").when(F.col("story") > 0, "story").otherwise("page")
    score = F.least(F.lit(4), F.when(F.col("caption") > 0, F.col("caption")).otherwise(F.col("story")))
    order = [F.col("kind") != "chart", F.when(F.col("strategy") == "caption", 0).when(F.col("strategy") == "story", 1).otherwise(2), F.desc("score"), "item_id"]
    return v.select("item_id", "kind", strategy.alias("strategy"), score.alias("score")).orderBy(*order).limit(limit)


def evidence_rows(routine: str, rows: DataFrame, limit: int = 30) -> DataFrame:
    """(article_id, rank, routine, content): a summary with article 0 and the number of rows, then ``limit`` rows as JSON, NaN as 0.

    Rows are taken in the order of their columns, so the choice does not depend on the plan.
    """
    clean = [F.nanvl(F.col(c), F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    items = rows.select(*clean).orderBy(*rows.columns).limit(limit)
    key = F.col("article_id").cast("long") if "article_id" in rows.columns else F.lit(None).cast("long")
    items = items.select(key.alias("article_id"), F.row_number().over(Window.orderBy(*rows.columns)).alias("rank"), F.lit(routine).alias("routine"), F.to_json(F.struct(*rows.columns)).alias("content"))  # ``limit`` rows
    head = rows.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("article_id"), F.lit(0).alias("rank"), F.lit(routine).alias("routine"), F.format_string("%d rows", F.col("n")).alias("content"))
    return head.unionByName(items)


def article_types(ar: Archive) -> DataFrame:
    """(article_id, kind, place): an article's type by the ladder of its text, and the section it is filed under.

    Advertisements come first, then the type as typed where it is a known one,
    editorials, tables, captions, sidebars, shorts. The section is that of the
    type, the front page's, or the printed one, else National.
    """
    s = ar.stories.select("article_id", "page_number", "article_type", "byline", F.nullif(F.trim("section"), F.lit("")).alias("printed"), F.trim(F.coalesce("headline", F.lit(""))).alias("h"), F.trim(F.coalesce("body_text", F.lit(""))).alias("b"))
    s = s.withColumn("t", F.concat_ws("\n", "h", F.lit(""), "b")).withColumn("n", F.size(T.words(F.col("b")))).withColumn("up", F.upper("h"))
    signal = F.col("byline").isNotNull() | F.substring("b", 1, 250).rlike(DATELINE) | (F.col("n") >= 180)
    lead = F.substring("t", 1, 400)
    ad = F.col("up").startswith("[ADVERTISEMENT]") | F.col("up").startswith("[PUBLIC NOTICE]") | lead.rlike(STRONG_AD) | (lead.rlike(OFFER) & ~signal)
    editorial = F.col("h").rlike(EDITORIAL_WORDS) | (F.col("page_number").isin(2, 4) & F.substring("t", 1, 300).rlike(EDITORIAL_WORDS))
    boxed = F.col("up").startswith("[SIDEBAR]") | F.col("up").startswith("[BOX]") | F.col("h").rlike(SIDEBAR_WORDS)
    known = F.col("article_type").isin(*LAYOUT_TYPES) & (F.col("article_type") != "unknown")
    kind = (
        F.when(ad, "advertisement").when(known, F.col("article_type")).when(editorial, "editorial").when((T.hits(F.col("b"), TABLE_WORDS) > 15) & (F.col("n") < 400), "table_content")
        .when((F.col("n") < 40) & (F.col("h") == ""), "photo_caption").when(boxed, "sidebar").otherwise("news")
    )
    s = s.withColumn("kind", kind)
    own = F.when(F.col("kind") == "advertisement", "Advertisements & Notices").when(F.col("kind") == "editorial", "Opinion & Editorial").when(F.col("kind") == "table_content", "Markets & Data").when(F.col("kind") == "photo_caption", "Life & Culture").when(F.col("up").startswith("[SHORTS]"), "News Briefs")
    return s.select("article_id", "kind", F.coalesce(own, F.when(F.col("page_number") == 1, "Front Page"), F.col("printed"), F.lit("National")).alias("place"))


def open_fragment(c: Column) -> Column:
    """Whether a headline breaks off: it ends in a connective or in ``, - — : ...``."""
    last = F.regexp_extract(F.lower(c), r"(\S+?)[\s.:;,]*$", 1)
    return F.coalesce((F.trim(c) != "") & (last.isin(*OPEN_WORDS) | F.rtrim(c).rlike(r"(?:,|-|—|:|\.\.\.)$")), F.lit(False))


def block_tests(ar: Archive) -> DataFrame:
    """(item_id, numeric, garbled, subhead, open, headline): tests of a block's text, and whether it may be a headline.

    ``numeric``: 40 % of the words are numbers; ``garbled``: 28 % of the signs
    are symbols, or six consonants stand together; ``subhead``: a number before
    the text. A headline has 2 to 30 words, is none of these and no noise.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    i = layout.page_items(ar).where(F.length(t) > 0).select("item_id", t.alias("t"))
    w, solid = T.words(F.col("t")), F.regexp_replace("t", r"\s+", "")
    numeric = F.size(F.filter(w, lambda x: x.rlike(r"^[\d.,%$€£+-]*\d[\d.,%$€£+-]*$"))) >= 0.4 * F.size(w)
    garbled = (F.length(F.regexp_replace(solid, r"[\p{L}\p{M}\p{N}]", "")) > 0.28 * F.length(solid)) | F.lower("t").rlike("[bcdfghjklmnpqrstvwxz]{6}")
    i = i.select("item_id", "t", F.size(w).alias("n"), numeric.alias("numeric"), garbled.alias("garbled"), F.col("t").rlike(r"^\d{1,2}[.)]\s+\S").alias("subhead"), open_fragment(F.col("t")).alias("open"), T.is_noise(F.col("t")).alias("noise"))
    return i.select("item_id", "numeric", "garbled", "subhead", "open", (F.col("n").between(2, 30) & ~F.col("numeric") & ~F.col("garbled") & ~F.col("subhead") & ~F.col("noise")).alias("headline"))


def layout_defaults(ar: Archive) -> DataFrame:
    """(article_id, headline, article_type, section, prominence, x0, y0, x1, y1): a model's layout with defaults for what is missing or unknown."""
    b = F.when(F.size("bbox") == 4, F.col("bbox")).otherwise(F.array(*map(F.lit, (0.0, 0.0, 1000.0, 1000.0))))
    pick = lambda c, known, other: F.when(F.lower(c).isin(*known), F.lower(c)).otherwise(other)
    return ar.stories.select(
        "article_id", F.coalesce(F.nullif(F.trim("headline"), F.lit("")), F.lit("News Item")).alias("headline"), pick(F.col("article_type"), LAYOUT_TYPES, "news").alias("article_type"), F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("National")).alias("section"),
        pick(F.col("prominence"), PROMINENCES, "standard").alias("prominence"), *[b[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
    )


def parser_items(ar: Archive, points: tuple[float, float] = (1440.0, 2160.0)) -> DataFrame:
    """(item_id, x0, y0, x1, y1, furniture): boxes from points with the origin at the lower left to pixels from the top, kept on the page; headers and footers told."""
    sx, sy = layout.PAGE_W / points[0], layout.PAGE_H / points[1]
    b = F.col("bbox")
    x, y = (lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(layout.PAGE_W), c * sx)), 4)), (lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(layout.PAGE_H), (points[1] - c) * sy)), 4))
    return layout.page_items(ar).select("item_id", x(b[0]).alias("x0"), y(b[3]).alias("y0"), x(b[2]).alias("x1"), y(b[1]).alias("y1"), F.col("label").isin("page_header", "page_footer").alias("furniture"))


def topic_links(ar: Archive) -> DataFrame:
    """(article_id, name, path, confidence): topics of the text and an article's further categories as ``Newsroom > X``, each link once with the highest confidence."""
    t = ar.articles.select(F.col("id").alias("article_id"), F.explode(T.topics(F.col("headline"), F.col("full_text"))).alias("t")).select("article_id", "t.name", "t.path", "t.confidence")
    c = documents.categories(ar.articles.withColumnRenamed("id", "article_id")).where("secondary <> ''").select("article_id", F.explode(F.split("secondary", ", ")).alias("name"), "confidence")
    c = c.select("article_id", "name", F.concat(F.lit("Newsroom > "), "name").alias("path"), "confidence")
    return t.unionByName(c).groupBy("article_id", "name", "path").agg(F.max("confidence").alias("confidence"))


def bulk_links(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The links with new ones added, each once; a link that is there stays as it is."""
    add = new.join(existing.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys])
    return existing.unionByName(add.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"))


def restored_articles(ar: Archive) -> DataFrame:
    """(article_id, headline, needs_chunks): advertisements by type that are no notice by their opening and fail the test again, without their tag, and whether they have to be chunked."""
    t = T.squeeze(F.coalesce("full_text", F.lit("")))
    a = ar.articles.where("article_type = 'advertisement'").where(~(F.substring(t, 1, 400).rlike(T.AD_HEADER) | t.rlike(T.AD_OPENING))).where(~T.is_ad(F.col("full_text")))
    a = a.select(F.col("id").alias("article_id"), F.regexp_replace(F.coalesce("headline", F.lit("")), r"^\[Advertisement\]\s*", "").alias("headline"))
    have = ar.chunks.select("article_id").distinct().withColumn("has", F.lit(True))
    return a.join(have, "article_id", "left").select("article_id", "headline", F.col("has").isNull().alias("needs_chunks"))


def page_again(ar: Archive, issue_id: int, page: int) -> DataFrame:
    """(action, key, text): a page read again: what is purged, then the segments that its items give."""
    gone = mutations.purge_page(ar, issue_id, page).select("action", F.col("article_id").cast("string").alias("key"), F.lit(None).cast("string").alias("text"))
    one = ar.where(page_layouts=(F.col("issue_id") == issue_id) & (F.col("page_number") == page))
    here = ar.where(parsed_items=F.col("layout_id").isin([r[0] for r in one.table("page_layouts").select("layout_id").distinct().collect()]))  # the layouts of one page
    new = layout.segments(here).select(F.lit("segment").alias("action"), F.concat_ws(":", "layout_id", "segment").alias("key"), F.col("headline").alias("text"))
    return gone.unionByName(new)


def repaired_json(text: str | None) -> str | None:
    """The JSON object in a model's answer: without reasoning, fences and words around it; one that breaks off is closed behind its last whole value.

    Null if there is no object.
    """
    body = re.sub(r"(?s)<(thought|think)>.*?</\1>", "", text or "")
    at = body.find("{")
    if at < 0:
        return None
    body = body[at:]
    open_: list[str] = []
    quoted = escaped = False
    safe: list[tuple[int, str]] = []  # (end, closers) of every place at which the object could be closed
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = (escaped or c != '"'), (not escaped and c == "\\")
            if quoted:
                continue
        elif c == '"':
            quoted = True
            continue
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                break
        if not quoted:
            safe.append((i + 1, "".join(reversed(open_))))
        if not open_:
            break
    for end, closers in reversed(safe):
        whole = re.sub(r",\s*([}\]])", r"\1", re.sub(r"[,\s]+$", "", body[:end]) + closers)
        try:
            if isinstance(json.loads(whole), dict):
                return whole
        except ValueError:
            continue
    return None


def repaired_answers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json): ``repaired_json`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([repaired_json(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "json"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, json string")


def broken_payloads(ar: Archive) -> DataFrame:
    """Payloads that lost their end, read again: the first three fields."""
    v = ar.vectors.where("payload is not null").select("id", F.concat(F.lit("<think>so { then</think>```json\n"), F.expr("substring(payload, 1, length(payload) - 14)")).alias("answer"))
    j = repaired_answers(v, "id", "answer")
    return j.select("id", F.get_json_object("json", "$.newspaper_name").alias("newspaper"), F.get_json_object("json", "$.issue_date").alias("issue_date"))


def without_repeats(c: Column) -> Column:
    """An answer without reasoning, and with each bullet once: lines that start with a bullet and have stood before are dropped."""
    lines = F.split(F.trim(F.regexp_replace(c, r"(?s)<(thought|think)>.*?</\1>", "")), "\n", -1)
    return T.let(lines, lambda x: F.array_join(F.filter(x, lambda y, i: ~(y.rlike(r"^\s*[-*•]\s") & F.array_contains(F.slice(x, 1, i), y))), "\n"))


def _q(f, *args):
    return lambda spark, root: f(Archive(spark, root), *args)


_WORDS = ["market", "council", "the"]
QUERIES = {
    "f11_category_gate": _q(lambda ar: ar.articles.where(category_gate("Business & Markets", F.lower(F.coalesce("section", F.lit(""))), F.col("article_type"))).select(F.col("id").alias("article_id"))),
    "f12_payload_filter": _q(lambda ar: ar.vectors.where(payload_filter(F.col("payload"), {"language": "en", "issue_date": {"gte": "2024-03-01", "lte": "2024-09-30"}, "chunk_index": {"lte": 2}})).select("id")),
    "r06_post_filtered": _q(filtered_hybrid, SearchFilters(article_type="news", min_prominence=0.3, date_from="2024-02-01", date_to="2024-11-30")),
    "j03_article_categories": _q(category_of),
    "r19_context_conflicts": _q(context_conflicts),
    "r12_visual_assets": _q(visual_assets, _WORDS),
    "q15_evidence_rows": _q(lambda ar: evidence_rows("papers", ar.newspapers.select("id", "name", "country"))),
    "t21_article_types": _q(article_types),
    "t12_block_tests": _q(block_tests),
    "t27_clean_answers": _q(lambda ar: ar.articles.select(F.col("id").alias("article_id"), without_repeats(F.coalesce("full_text", F.lit(""))).alias("text"))),
    "t28_repaired_json": _q(broken_payloads),
    "k10_parser_items": _q(parser_items),
    "k11_layout_defaults": _q(layout_defaults),
    "k16_topic_links": _q(topic_links),
    "k19_restored_articles": _q(restored_articles),
    "k20_page_again": _q(page_again, 301, 12),
    "k27_bulk_links": _q(lambda ar: bulk_links(topic_links(ar).where("article_id % 2 = 0").select("article_id", "name", F.lit(0.5).alias("confidence")), topic_links(ar).select("article_id", "name", "confidence"), ["article_id", "name"])),
}

_d = lambda p: p.replace("'", "''")
_items = "it as (select distinct * from parsed_items where len(bbox) >= 4)"
_words = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_links = f"(select article_id, name, path, max(confidence) confidence from (select article_id, name, path, confidence from ({documents.ORACLE['t17_topics']}) union all select article_id, x, 'Newsroom > ' || x, confidence from (select article_id, confidence, unnest(string_split(\"secondary\", ', ')) x from ({documents.ORACLE['t20_categories']}) where \"secondary\" <> '')) group by 1, 2, 3)"
_met = lambda c: " + ".join(f"cast(coalesce(contains(lower({c}), '{w}'), false) as integer)" for w in _WORDS)
ORACLE = {
    "f11_category_gate": SQL + "select article_id from a_ where " + " or ".join(f"contains(lower(coalesce(section, '')), '{w}')" for w in BRIDGES[0][1]),
    "f12_payload_filter": "select distinct id from vector_points where json_extract_string(payload, '$.language') = 'en' and json_extract_string(payload, '$.issue_date') between '2024-03-01' and '2024-09-30' and length(json_extract_string(payload, '$.issue_date')) = 10 and try_cast(json_extract_string(payload, '$.chunk_index') as double) <= 2",
    "r06_post_filtered": f"select query_id, f.article_id, rrf_score from ({retrieval.ORACLE['r05_rrf']}) f join (select distinct a.id article_id, article_type, prominence_score, i.issue_date from articles a join (select distinct id, newspaper_id, issue_date from issues) i on a.issue_id = i.id join newspapers n on n.id = i.newspaper_id) a on a.article_id = f.article_id where article_type = 'news' and prominence_score >= 0.3 and issue_date between date '2024-02-01' and date '2024-11-30'",
    "j03_article_categories": SQL + "select article_id, coalesce(x.section_id, y.section_id) section_id from a_ left join (select lower(trim(section_name)) k, min(section_id) section_id from section_list group by 1) x on x.k = lower(trim(section)) left join (select lower(trim(section_name)) k, min(section_id) section_id from section_list group by 1) y on y.k = lower(trim(article_type))",
    "r12_visual_assets": f"""with b9 as ({layout.ORACLE['j16_photo_bindings']}), {_items}, st as (select distinct skeleton_id article_id, lower(coalesce(headline, '')) head from article_skeletons),
        v9 as (select item_id, case when label = 'table' then 'chart' else 'photo' end kind, {_met('it.text')} caption, {_met('head')} story from it left join b9 using (item_id) left join st using (article_id) where label in ('picture', 'table')),
        w9 as (select item_id, kind, case when caption > 0 then 'caption' when story > 0 then 'story' else 'page' end strategy, cast(least(4, case when caption > 0 then caption else story end) as integer) score from v9)
        select * from w9 order by kind <> 'chart', case strategy when 'caption' then 0 when 'story' then 1 else 2 end, score desc, item_id limit 6""",
    "q15_evidence_rows": "select 0::bigint article_id, 0 as \"rank\", 'papers' routine, count(*) || ' rows' as \"content\" from newspapers union all select null, * from (select cast(row_number() over (order by id, name, country) as integer), 'papers', '{\"id\":' || id || ',\"name\":\"' || name || '\",\"country\":\"' || country || '\"}' from newspapers order by id, name, country limit 30)",
    "t21_article_types": SQL + rf""", x as (select article_id, page_number, article_type, byline, nullif(trim(section), '') printed, trim(coalesce(headline, '')) h, trim(coalesce(body_text, '')) b from stories), y as (select *, h || chr(10) || chr(10) || b t, {_words.format('b')} n, upper(h) up from x),
        z as (select *, case when starts_with(up, '[ADVERTISEMENT]') or starts_with(up, '[PUBLIC NOTICE]') or regexp_matches(substr(t, 1, 400), '{_d(STRONG_AD)}') or (regexp_matches(substr(t, 1, 400), '{_d(OFFER)}') and not (byline is not null or regexp_matches(substr(b, 1, 250), '{_d(DATELINE)}') or n >= 180)) then 'advertisement'
            when article_type in ({', '.join(f"'{k}'" for k in LAYOUT_TYPES if k != 'unknown')}) then article_type when regexp_matches(h, '{EDITORIAL_WORDS}') or (page_number in (2, 4) and regexp_matches(substr(t, 1, 300), '{EDITORIAL_WORDS}')) then 'editorial'
            when len(regexp_extract_all(b, '{TABLE_WORDS}')) > 15 and n < 400 then 'table_content' when n < 40 and h = '' then 'photo_caption' when starts_with(up, '[SIDEBAR]') or starts_with(up, '[BOX]') or regexp_matches(h, '{SIDEBAR_WORDS}') then 'sidebar' else 'news' end kind from y)
        select article_id, kind, coalesce(case kind when 'advertisement' then 'Advertisements & Notices' when 'editorial' then 'Opinion & Editorial' when 'table_content' then 'Markets & Data' when 'photo_caption' then 'Life & Culture' else case when starts_with(up, '[SHORTS]') then 'News Briefs' end end, case when page_number = 1 then 'Front Page' end, printed, 'National') place from z""",
    "t28_repaired_json": "select distinct id, json_extract_string(payload, '$.newspaper_name') newspaper, json_extract_string(payload, '$.issue_date') issue_date from vector_points where payload is not null",
    "k10_parser_items": f"with {_items} select item_id, round(greatest(0.0, least(2000.0, bbox[1] * (2000.0::double / 1440.0::double))), 4) x0, round(greatest(0.0, least(3000.0, (2160.0::double - bbox[4]) * (3000.0::double / 2160.0::double))), 4) y0, round(greatest(0.0, least(2000.0, bbox[3] * (2000.0::double / 1440.0::double))), 4) x1, round(greatest(0.0, least(3000.0, (2160.0::double - bbox[2]) * (3000.0::double / 2160.0::double))), 4) y1, label in ('page_header', 'page_footer') furniture from it",
    "k11_layout_defaults": SQL + f", x as (select *, case when len(bbox) = 4 then bbox else [0.0, 0.0, 1000.0, 1000.0]::double[] end b from stories) select article_id, coalesce(nullif(trim(headline), ''), 'News Item') headline, case when lower(article_type) in ({', '.join(repr(k) for k in LAYOUT_TYPES)}) then lower(article_type) else 'news' end article_type, coalesce(nullif(trim(section), ''), 'National') section, case when lower(prominence) in ({', '.join(repr(k) for k in PROMINENCES)}) then lower(prominence) else 'standard' end prominence, b[1] x0, b[2] y0, b[3] x1, b[4] y1 from x",
    "k16_topic_links": "select * from " + _links,
    "k27_bulk_links": f"with l as (select * from {_links}), e as (select article_id, name, 0.5::double confidence from l where article_id % 2 = 0) select * from e union all select article_id, name, min(confidence) from l where article_id % 2 <> 0 group by 1, 2",
}
ORACLE |= {
    "r19_context_conflicts": SQL + """, v as (select distinct id, try_cast(try_cast(json_extract_string(payload, '$.article_id') as double) as bigint) article_id, json_extract_string(payload, '$.issue_date') d, json_extract_string(payload, '$.newspaper_name') p, json_extract_string(payload, '$.section') s from vector_points)
        select id, coalesce(d <> cast(issue_date as varchar), false) date_conflict, coalesce(not (contains(lower(p), lower(newspaper)) or contains(lower(newspaper), lower(p))), false) paper_conflict, coalesce(lower(s) <> lower(section), false) section_conflict from v join dated_articles using (article_id)""",
    "t12_block_tests": f"""with {_items}, i as (select item_id, trim(text) t from it where length(trim(text)) > 0), w as (select *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') w, regexp_replace(t, '\\s+', '', 'g') solid from i),
        x as (select item_id, t, len(w) n, len(list_filter(w, lambda x: regexp_matches(x, '^[\\d.,%$€£+-]*\\d[\\d.,%$€£+-]*$'))) >= 0.4::double * len(w) as "numeric", length(regexp_replace(solid, '[\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')) > 0.28::double * length(solid) or regexp_matches(lower(t), '[bcdfghjklmnpqrstvwxz]{{6}}') garbled,
            regexp_matches(t, '^\\d{{1,2}}[.)]\\s+\\S') subhead, regexp_extract(lower(t), '(\\S+?)[\\s.:;,]*$', 1) in ({', '.join(f"'{k}'" for k in OPEN_WORDS)}) or regexp_matches(rtrim(t), '(?:,|-|—|:|\\.\\.\\.)$') as "open", {documents._noise('t')} noise from w)
        select item_id, "numeric", garbled, subhead, "open", n between 2 and 30 and not "numeric" and not garbled and not subhead and not noise headline from x""",
    "k19_restored_articles": f"""with s9 as ({documents.ORACLE['t09_ad_signals']}), z9 as (select *, trim(regexp_replace(coalesce(full_text, ''), '\\s+', ' ', 'g')) t from (select distinct id article_id, headline, article_type, full_text from articles where article_type = 'advertisement')),
        y9 as (select z9.*, s9.* exclude (article_id), regexp_matches(t, '{_d(T.AD_CATEGORIES[1])}') priced, {_words.format('t')} n from z9 join s9 using (article_id)),
        x9 as (select *, case when n = 0 then false when header then true when terms >= 3 then true when density >= 0.04 and score >= 3.5 then true when editorial >= 3 and n >= 350 then score >= 6 when n < 50 and ((density >= 0.2 and score >= 2) or (priced and editorial = 0)) then true when n < 250 and score >= 3 then true else score >= 4.5 end is_ad from y9)
        select article_id, regexp_replace(coalesce(headline, ''), '^\\[Advertisement\\]\\s*', '') headline, article_id not in (select article_id from article_chunks where article_id is not null) needs_chunks from x9 where not header and not is_ad""",
}


def boxes_of(c: Column) -> Column:
    """The boxes in a JSON text: one box as four numbers or as an object with x0, y0, x1, y1, or a list of boxes; none for anything else."""
    t = F.trim(c)
    one = F.from_json(t, "array<double>")
    obj = F.from_json(t, "x0 double, y0 double, x1 double, y1 double")
    many = F.when(t.rlike(r"^\[\s*\["), F.from_json(t, "array<array<double>>")).when(t.rlike(r"^\[\s*-?\d"), F.array(one)).when(t.startswith("{"), F.array(F.array(obj["x0"], obj["y0"], obj["x1"], obj["y1"])))
    return F.filter(F.coalesce(many, F.array().cast("array<array<double>>")), lambda b: (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull()))


def json_boxes(ar: Archive) -> DataFrame:
    """The boxes of page items from three ways of writing them."""
    b = F.col("bbox")
    i = layout.page_items(ar).select("item_id", F.when(F.col("item_id") % 3 == 0, F.to_json("bbox")).when(F.col("item_id") % 3 == 1, F.to_json(F.array("bbox", "bbox"))).otherwise(F.to_json(F.struct(*[b[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]))).alias("j"))
    x = i.select("item_id", boxes_of(F.col("j")).alias("b"))
    return x.select("item_id", F.size("b").alias("boxes"), F.col("b")[0][0].alias("x0"), F.col("b")[0][3].alias("y1"))


def on_pages(ar: Archive, wanted: list[int], exclude: bool = False) -> DataFrame:
    """The stories of which a page is among the wanted ones, or none."""
    p = ar.story_pages.groupBy("article_id").agg(F.collect_set("page_number").alias("pages"))
    return p.where(pages_overlap("pages", wanted, exclude)).select("article_id")


QUERIES |= {"f07_on_pages": _q(on_pages, [2, 3, 15]), "f08_not_on_pages": _q(on_pages, [2, 3, 15], True), "f15_json_boxes": _q(json_boxes)}
ORACLE |= {
    "f07_on_pages": SQL + "select distinct article_id from story_pages where page_number in (2, 3, 15)",
    "f08_not_on_pages": SQL + "select distinct article_id from story_pages where article_id not in (select article_id from story_pages where page_number in (2, 3, 15))",
    "f15_json_boxes": f"with {_items} select item_id, case when item_id % 3 = 1 then 2 else 1 end boxes, bbox[1] x0, bbox[4] y1 from it",
}
ORACLE["t27_clean_answers"] = SQL + r", l as (select article_id, string_split(trim(regexp_replace(coalesce(full_text, ''), '(?s)<thought>.*?</thought>|<think>.*?</think>', '', 'g')), chr(10)) l from a_) select article_id, array_to_string(list_filter(l, lambda x, i: not (regexp_matches(x, '^\s*[-*•]\s') and list_contains(l[1:i - 1], x))), chr(10)) as text from l"
