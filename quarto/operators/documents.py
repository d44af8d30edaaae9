"""The document pipeline's text operators over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarto.functions import text as T
from quarto.sources.archive import SQL, Archive


def mentions(ar: Archive, top: int = 15) -> DataFrame:
    """(article_id, name, type, mention_count, salience): the ``top`` entities of each article.

    Salience is half the share of mentions plus 0.5 in a headline, else 0.1,
    1 at most; equal ones are ordered by name.
    """
    a = ar.articles.select(F.col("id").alias("article_id"), "headline", T.entity_names(F.col("headline"), F.col("full_text")).alias("names"))
    a = a.select("article_id", "headline", F.size("names").alias("total"), F.explode("names").alias("name"))
    g = a.groupBy("article_id", "headline", "total", "name").agg(F.count("*").alias("mention_count"))
    bonus = F.when(F.lower("headline").contains(F.lower("name")), 0.5).otherwise(0.1)
    g = g.withColumn("salience", F.round(F.least(F.lit(1.0), F.col("mention_count") / F.col("total") * 0.5 + bonus), 2))
    w = Window.partitionBy("article_id").orderBy(F.desc("salience"), "name")
    return g.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("article_id", "name", T.entity_type(F.col("name")).alias("type"), "mention_count", "salience")


def chunked(ar: Archive) -> DataFrame:
    """(article_id, chunk_index, token_count, raw_text, text) of every article that is no advertisement."""
    a = ar.dated_articles.where(F.coalesce("article_type", F.lit("")) != "advertisement")
    head = T.header_context(F.col("newspaper"), F.col("issue_date").cast("string"), F.col("section"), F.col("headline"), F.array().cast("array<int>"))
    a = a.select("article_id", head.alias("header"), "full_text").select("article_id", "header", F.posexplode(T.chunk_texts(F.col("full_text"), F.col("header"))).alias("chunk_index", "raw_text"))
    text = F.concat("header", F.lit("\n\n"), "raw_text")
    return a.select("article_id", "chunk_index", F.size(T.words(text)).alias("token_count"), "raw_text", text.alias("text"))


#: A small taxonomy; ``categories`` takes any other of the same shape.
TAXONOMY = {
    "Business & Markets": "market price bank credit company trade dividend share".split(),
    "Politics": "minister parliament council election committee vote treaty".split(),
    "Crime & Law": "court judge police witness inquest verdict trial".split(),
    "Science & Environment": "storm flood climate comet fossil laboratory drought".split(),
    "Sports": "match club player goal wicket innings champion".split(),
    "Health": "hospital patient clinic vaccine surgeon fever".split(),
    "Local/Metro": "town village street parish mason bridge".split(),
}
ANCHORS = {"business": ["dividend", "credit", "bank"], "politics": ["minister", "parliament"], "sports": ["wicket", "innings", "goal"]}


def categories(rows: DataFrame, taxonomy: dict[str, list[str]] = TAXONOMY, anchors: dict[str, list[str]] = ANCHORS) -> DataFrame:
    """(article_id, category, confidence, secondary): keyword hits count 3 in the headline and 1 in the first 1500 characters.

    Business or politics anchors without sports anchors dampen Sports to 0.15;
    each adds 4 to its category. Ties go by the taxonomy's order; a second
    category needs 3 and 40 % of the top.
    """
    h, b = F.lower(F.coalesce("headline", F.lit(""))), F.lower(F.substring(F.coalesce("full_text", F.lit("")), 1, 1500))
    word = lambda k: rf"\b{k}\b"
    score = {c: sum((F.when(h.rlike(word(k)), 3.0).otherwise(0.0) + F.when(b.rlike(word(k)), 1.0).otherwise(0.0) for k in ks), F.lit(0.0)) for c, ks in taxonomy.items()}
    both = F.concat_ws("\n", h, b)
    has = {n: both.rlike(r"\b(?:" + "|".join(ks) + r")\b") for n, ks in anchors.items()}
    damp = (has["business"] | has["politics"]) & ~has["sports"]
    score["Sports"] = F.when(damp, score["Sports"] * 0.15).otherwise(score["Sports"])
    score["Business & Markets"] = score["Business & Markets"] + F.when(has["business"], 4.0).otherwise(0.0)
    score["Politics"] = score["Politics"] + F.when(has["politics"], 4.0).otherwise(0.0)
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("category")) for i, (c, s) in enumerate(score.items())]))
    r = rows.select("article_id", ranked.alias("r")).withColumn("top", -F.col("r")[0]["neg"])
    confidence = F.least(F.lit(0.98), F.greatest(F.lit(0.60), F.round(0.60 + F.col("top") / 15.0 * 0.38, 2)))
    other = F.transform(F.filter(F.slice("r", 2, 99), lambda x: (-x["neg"] >= 3.0) & (-x["neg"] >= F.col("top") * 0.40)), lambda x: x["category"])
    first = F.when(F.col("top") > 0, F.col("r")[0]["category"]).otherwise("Local/Metro")
    return r.select("article_id", first.alias("category"), F.when(F.col("top") > 0, confidence).otherwise(0.63).alias("confidence"), F.array_join(other, ", ").alias("secondary"))


def section_categories(rows: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """(article_id, category, confidence) of a printed section: 0.95 for an alias itself, 0.90 for one within the other, first in the list."""
    s = F.lower(F.trim("section"))
    exact = F.coalesce(*[F.when(s == a, F.struct(F.lit(c).alias("category"), F.lit(0.95).alias("confidence"))) for a, c in aliases])
    part = F.coalesce(*[F.when(s.contains(a) | F.lit(a).contains(s), F.struct(F.lit(c).alias("category"), F.lit(0.90).alias("confidence"))) for a, c in aliases])
    hit = F.when(s != "", F.coalesce(exact, part))
    return rows.select("article_id", hit["category"].alias("category"), F.coalesce(hit["confidence"], F.lit(0.0)).alias("confidence"))


ALIASES = [("markets & prices", "Business & Markets"), ("banking", "Business & Markets"), ("sport", "Sports"), ("parliament", "Politics"), ("courts & inquests", "Crime & Law"), ("police", "Crime & Law"), ("health", "Health"), ("science", "Science & Environment"), ("town", "Local/Metro"), ("foreign despatches", "World/International")]


def reclassified(ar: Archive) -> DataFrame:
    """(article_id, article_type, headline): a byline or 300 words protect from the text test; advertisements get their tag."""
    kept = F.col("article_type") == "advertisement"
    tested = F.col("byline_author").isNull() & (F.col("word_count") < 300) & T.is_ad(F.col("full_text"))
    ad = F.coalesce(kept, F.lit(False)) | tested
    head = F.coalesce("headline", F.lit(""))
    return ar.articles.select(F.col("id").alias("article_id"), F.when(ad, "advertisement").otherwise(F.col("article_type")).alias("article_type"), F.when(ad & ~head.startswith("[Advertisement]"), F.concat(F.lit("[Advertisement] "), head)).otherwise(head).alias("headline"))


def text_flags(ar: Archive) -> DataFrame:
    """Boolean tests of every article."""
    a = ar.articles
    t = F.coalesce("full_text", F.lit(""))
    table = t.rlike(r"(?m)^\s*\|.*\|\s*$")
    return a.select(F.col("id").alias("article_id"), T.is_noise(t).alias("noise"), T.is_title_case(F.coalesce("headline", F.lit(""))).alias("title_case"), T.is_gibberish(t).alias("gibberish"), T.is_ad(t).alias("ad"), table.alias("has_table"))


def _q(f):
    return lambda spark, root: f(Archive(spark, root))


def _art(*cols):
    return lambda ar: ar.articles.select(F.col("id").alias("article_id"), *cols)


_H, _T = F.col, F.col
QUERIES = {
    "t01_tokens": _q(lambda ar: _art(F.array_join(F.array_sort(T.substantive_tokens(F.col("headline"))), " ").alias("tokens"))(ar)),
    "t02_numeric_anchors": _q(lambda ar: _art(F.array_join(F.array_sort(T.numeric_anchors(F.col("full_text"))), " ").alias("anchors"))(ar)),
    "t03_headlines": _q(lambda ar: _art(T.clean_headline(F.col("headline"), F.col("byline_author"), F.col("full_text")).alias("h"))(ar).select("article_id", "h.headline", "h.byline")),
    "t04_ligatures": _q(lambda ar: _art(T.repair_ligatures(F.col("full_text")).alias("text"))(ar)),
    "t05_text_flags": _q(text_flags),
    "t06_sanitized": _q(lambda ar: _art(T.sanitize_block(F.col("full_text")).alias("text"))(ar)),
    "t09_ad_signals": _q(lambda ar: _art(T.ad_signals(F.col("full_text")).alias("s"))(ar).select("article_id", "s.score", "s.editorial", "s.header", "s.terms", F.round("s.density", 9).alias("density"))),
    "t16_printed_dates": _q(lambda ar: ar.table("parsed_items").dropDuplicates(["item_id"]).select("item_id", T.printed_date(F.col("text")).alias("printed")).where("printed is not null")),
    "t17_topics": _q(lambda ar: _art(F.explode(T.topics(F.col("headline"), F.col("full_text"))).alias("t"))(ar).select("article_id", "t.name", "t.path", "t.confidence")),
    "t18_mentions": _q(mentions),
    "t19_summaries": _q(lambda ar: _art(T.summary(F.col("headline"), F.col("full_text")).alias("summary"))(ar)),
    "t20_categories": _q(lambda ar: categories(ar.articles.withColumnRenamed("id", "article_id"))),
    "t21_prominence": _q(lambda ar: ar.stories.select("article_id", T.prominence(F.col("page_number"), F.size(T.words(F.coalesce("body_text", F.lit("")))), F.coalesce("headline", F.lit("")), F.when(F.col("continues_to_page").isNull(), 1).otherwise(2), F.col("article_type")).alias("prominence"))),
    "t22_section_categories": _q(lambda ar: section_categories(ar.articles.withColumnRenamed("id", "article_id"), ALIASES)),
    "t23_relevance": _q(lambda ar: _art(F.round(T.lexical_relevance(F.lit("harbour prices and elections"), F.col("headline"), F.col("full_text")), 6).alias("relevance"))(ar)),
    "t26_citations": _q(lambda ar: ar.dated_articles.select("article_id", T.inline_citation(F.concat(F.lit("[1] "), "newspaper", F.lit(", "), F.col("issue_date").cast("string"), F.lit(', Page 3, "'), F.coalesce("headline", F.lit("none")), F.lit('"'))).alias("c")).select("article_id", "c.*")),
    "t29_cache_keys": _q(lambda ar: _art(T.cache_key(F.coalesce("headline", F.lit("")), F.col("section"), F.col("lang")).alias("key"))(ar)),
    "t30_slugs": _q(lambda ar: ar.newspapers.select("id", T.slug(F.col("name")).alias("slug"))),
    "t31_chunks": _q(chunked),
    "t32_visual_chunks": _q(lambda ar: ar.chunks.where("chunk_type = 'visual'").select("id", T.visual_chunk(F.coalesce("header_context", F.lit("")), F.lit("price_chart"), F.lit(""), F.col("raw_text")).alias("text"))),
    "k14_reclassified": _q(reclassified),
    "k25_continuations": _q(lambda ar: ar.stories.where("continues_to_page is not null").alias("a").join(ar.stories.alias("b"), F.expr("a.issue_id = b.issue_id and a.continues_to_page = b.page_number and a.article_id <> b.article_id")).select(F.col("a.article_id").alias("article_id"), F.col("b.article_id").alias("other_id"), T.continuation_metrics(F.col("a.headline"), F.col("b.headline")).alias("m")).select("article_id", "other_id", "m.*")),
}

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_d = lambda p: p.replace("'", "''")
_body = lambda p: p.removeprefix(r"(?i)\b").removesuffix(r"\b")
_EVERY = "(?i)(?:" + "|".join(_body(p) for p in [T.AD_HEADER, *T.AD_CATEGORIES]) + ")"
_count = lambda p: f"len(regexp_extract_all(t, '{_d(p)}'))"
_ADS = SQL + ", z as (select article_id, trim(regexp_replace(coalesce(full_text, ''), '\\s+', ' ', 'g')) t from a_)"


def _categories_sql() -> str:
    hit = lambda c, k, w: f"case when regexp_matches({c}, '\\b{k}\\b') then {w} else 0 end"
    raw = {c: " + ".join(f"{hit('h', k, 3)} + {hit('b', k, 1)}" for k in ks) for c, ks in TAXONOMY.items()}
    has = {n: "regexp_matches(h || chr(10) || b, '\\b(?:" + "|".join(ks) + ")\\b')" for n, ks in ANCHORS.items()}
    final = {c: f"({r})::double" for c, r in raw.items()}
    final["Sports"] = f"case when ({has['business']} or {has['politics']}) and not {has['sports']} then ({raw['Sports']}) * 0.15::double else ({raw['Sports']})::double end"
    final["Business & Markets"] = f"(({raw['Business & Markets']}) + case when {has['business']} then 4 else 0 end)::double"
    final["Politics"] = f"(({raw['Politics']}) + case when {has['politics']} then 4 else 0 end)::double"
    scores = " union all ".join(f"select article_id, {i} ord, '{c}' category, {e} s from x" for i, (c, e) in enumerate(final.items()))
    return f"""{SQL}, x as (select article_id, lower(coalesce(headline, '')) h, lower(substr(coalesce(full_text, ''), 1, 1500)) b from a_), sc as ({scores}),
        r as (select *, row_number() over (partition by article_id order by s desc, ord) r, max(s) over (partition by article_id) top from sc)
        select article_id, case when max(top) > 0 then max(case when r = 1 then category end) else 'Local/Metro' end category, case when max(top) > 0 then least(0.98, greatest(0.6, round(0.6::double + max(top) / 15.0::double * 0.38::double, 2))) else 0.63 end::double confidence,
        coalesce(string_agg(category, ', ' order by r) filter (r > 1 and s >= 3 and s >= top * 0.4::double), '') "secondary" from r group by 1"""


ORACLE = {
    "t01_tokens": SQL + f"select article_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(headline, '')), '[a-z0-9]+'), lambda w: length(w) >= 3 and not list_contains({_STOP}, w)))), ' '), '') tokens from a_",
    "t02_numeric_anchors": SQL + r"select article_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(full_text, '')), '\b(?:\d+[.,]?\d*(?:%|k|cr|crore|lakh|bn|m)?)\b'), lambda w: length(w) >= 2))), ' '), '') anchors from a_",
    "t09_ad_signals": _ADS + " select article_id, " + " + ".join(f"case when regexp_matches(t, '{_d(p)}') then 2.0 else 0 end" for p in T.AD_CATEGORIES) + f" + case when regexp_matches(t, '{_d(T.AD_CONTACT)}') then 1.5 else 0 end::double as score, {_count(T.EDITORIAL)} editorial, regexp_matches(substr(t, 1, 400), '{_d(T.AD_HEADER)}') or regexp_matches(t, '{_d(T.AD_OPENING)}') header, "
    + " + ".join(f"case when regexp_matches(lower(t), '\\b{_d(p)}\\b') then 1 else 0 end" for p in T.TERMS) + rf" terms, round(({_count(_EVERY)} + {_count('(?i)' + chr(92) + 'b(?:' + '|'.join(T.TERMS) + ')' + chr(92) + 'b')}) / greatest(1, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))), 9) density from z",
    "t17_topics": SQL + ", k as (select * from (values " + ", ".join(f"('{k}', '{n}', '{p}')" for k, n, p in T.TOPICS) + ") k(k, name, path)), x as (select article_id, lower(coalesce(headline, '')) h, lower(coalesce(headline, '') || ' ' || coalesce(full_text, '')) b from a_), f as (select article_id, name, path, case when contains(h, k) then 0.95 else 0.8 end::double confidence from x, k where contains(b, k)) select * from f union all select article_id, 'General News', 'News > General', 0.7::double from a_ where article_id not in (select article_id from f)",
    "t18_mentions": SQL + f""", x as (select article_id, coalesce(headline, '') h, regexp_replace(coalesce(headline, '') || chr(10) || coalesce(full_text, ''), '[ªµºÀ-ÖØ-öø-ʯͰ-῿]', '_', 'g') b from a_),
        n as (select article_id, h, list_concat(list_filter(list_transform(regexp_extract_all(b, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,3}})\\b', 1), lambda m: trim(regexp_replace(m, '^The ', ''))), lambda m: length(m) >= 3 and m not in ('Daily', 'The Daily', 'Newspaper Intelligence')), list_filter(regexp_extract_all(b, '\\b([A-Z]{{3,8}})\\b', 1), lambda a: list_contains(['{"', '".join(T.ACRONYMS)}'], a))) ns from x),
        e as (select article_id, h, len(ns) total, unnest(ns) as name from n), g as (select article_id, h, total, name, count(*) mention_count from e group by all),
        s as (select *, round(least(1.0, mention_count / total * 0.5::double + case when contains(lower(h), lower(name)) then 0.5 else 0.1 end::double), 2) salience from g),
        r as (select *, row_number() over (partition by article_id order by salience desc, name) r from s)
        select article_id, name, case when name in ('{"', '".join(T.LOCATIONS)}') then 'location' when name in ('{"', '".join(T.ACRONYMS)}') or regexp_matches(name, '{T.ORG_WORD}') then 'org' when regexp_matches(name, '{T.CONCEPT_WORD}') then 'misc' when regexp_matches(name, '^[A-Z][a-z]+\\s+[A-Z][a-z]+$') then 'person' else 'misc' end "type", mention_count, salience from r where r <= 15""",
    "t21_prominence": SQL + r"""select article_id, round(greatest(0.05, least(1.0, (case when page_number = 1 then 0.5::double when page_number in (2, 3) then 0.3::double else 0.15::double end + case when w > 800 then 0.25::double when w > 400 then 0.2::double when w > 200 then 0.15::double when w > 80 then 0.1::double else 0.05::double end
        + least(0.25::double, case when length(coalesce(headline, '')) > 30 then 0.15::double else 0.05::double end + 0.05::double * case when continues_to_page is null then 1 else 2 end))
        * case when article_type in ('advertisement', 'photo_caption') then 0.4::double when article_type in ('sidebar', 'table_content', 'table_data') then 0.7::double else 1.0::double end)), 2) prominence
        from (select *, len(list_filter(regexp_split_to_array(coalesce(body_text, ''), '\s+'), lambda x: x <> '')) w from stories)""",
    "t29_cache_keys": SQL + r"select article_id, sha256(concat_ws('|', trim(regexp_replace(lower(coalesce(headline, '')), '\s+', ' ', 'g')), lower(trim(coalesce(section, ''))), lower(trim(coalesce(lang, ''))))) as key from a_",
    "t30_slugs": r"select id, regexp_replace(lower(trim(regexp_replace(name, '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'))), '[-\s]+', '_', 'g') slug from newspapers",
    "t22_section_categories": SQL + ", s as (select article_id, lower(trim(section)) s from a_) select article_id, coalesce(" + ", ".join(f"case when s = '{a}' then '{c}' end" for a, c in ALIASES) + ", " + ", ".join(f"case when s <> '' and (contains(s, '{a}') or contains('{a}', s)) then '{c}' end" for a, c in ALIASES)
    + ") category, coalesce(" + ", ".join(f"case when s = '{a}' then 0.95 end" for a, _ in ALIASES) + ", " + ", ".join(f"case when s <> '' and (contains(s, '{a}') or contains('{a}', s)) then 0.9 end" for a, _ in ALIASES) + ", 0)::double confidence from s",
    "t32_visual_chunks": r"select id, coalesce(header_context, '') || chr(10) || chr(10) || '[Visual Data Asset: Price Chart]' || chr(10) || chr(10) || trim(raw_text) as text from (select distinct id, header_context, raw_text from article_chunks where chunk_type = 'visual')",
    "t20_categories": _categories_sql(),
    "k25_continuations": SQL + r""", w as (select article_id, issue_id, page_number, continues_to_page, list_filter(list_distinct(regexp_extract_all(lower(coalesce(nullif(trim(regexp_replace(headline, '(?i)[.…]+\s*(?:from\s+page\s+\d+|cont[''’]?d?|continued\s+from\s+p(?:age)?\s*\d*).*$', '')), ''), headline)), '[a-z0-9_]+')), lambda x: not list_contains(__WORDS__, x)) t from stories),
        p as (select a.article_id, b.article_id other_id, a.t x, b.t y from w a join w b on a.issue_id = b.issue_id and a.continues_to_page = b.page_number and a.article_id <> b.article_id)
        select article_id, other_id, case when len(x) > 0 and len(y) > 0 then round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) else 0 end::double jaccard, case when len(x) > 0 and len(y) > 0 then round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) else 0 end::double containment,
        cast(case when len(x) > 0 and len(y) > 0 then len(list_filter(list_intersect(x, y), lambda v: length(v) >= 4)) else 0 end as integer) shared from p""".replace("\\\\", "\\").replace("__WORDS__", "[" + ", ".join(f"'{w}'" for w in T.CONTINUATION_WORDS) + "]"),
}


def _ligature_sql() -> str:
    e = "coalesce(full_text, '')"
    for sign, letters in T.LIGATURES.items():
        e = f"replace({e}, '{sign}', '{letters}')"
    for pattern, word in T.LOST_LIGATURES:
        e = f"regexp_replace({e}, '(?i){pattern}', '{word.replace('$1', chr(92) + '1')}', 'g')"
    return f"{SQL} select article_id, replace({e}, '�', '') as text from a_"


_noise = lambda x: f"({x} = '' or regexp_matches({x}, '{T.UUID}') or regexp_matches({x}, '{_d(T.PROMO)}') or regexp_matches({x}, '{_d(T.PRINTER)}'))"
_sentences = lambda x: f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_cite = "(?i)(?:\\[(?:\\d+|photo)?\\]\\s*)?(?:\\{?([A-Za-z0-9\\s.''\\-]+?)\\}?,\\s*)(?:(\\d{4}-\\d{2}-\\d{2}),\\s*)?(?:Page\\s*(\\d+),\\s*)?(?:Headline:\\s*)?[\"“]([^\"”]+)[\"”]"
_month = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def _dated(pattern: str, y: int, m: int, d: int, named: bool) -> str:
    g = lambda i: f"regexp_extract(text, '{pattern}', {i})"
    month = f"case when {g(m)} <> '' then (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr({g(m)}, 1, 3))) - 1) // 3 + 1 end" if named else f"try_cast({g(m)} as integer)"
    year, day = f"try_cast({g(y)} as integer)", f"try_cast({g(d)} as integer)"
    return f"case when {year} between 2020 and 2035 and {month} between 1 and 12 and {day} between 1 and 31 then try_cast(printf('%04d-%02d-%02d', {year}, {month}, {day}) as date) end"


ORACLE |= {
    "t03_headlines": SQL + r""", x as (select article_id, byline_author, trim(coalesce(headline, '')) h, nullif(trim(coalesce(byline_author, '')), '') b, trim(regexp_split_to_array(trim(coalesce(full_text, '')), '[.\n]')[1]) f from a_),
        y as (select *, case when b is null then h else h || ' (' || b || ')' end own, trim(substr(regexp_replace(f, '(?i)^(?:A|The)\s+', ''), 1, 70)) topic, regexp_matches(h, '(?i)^(?:Dr\.?|Doctor|Prof\.?|Professor)\s+[A-Z]') doctor,
            upper(h) = h and lower(h) <> h and len(list_filter(regexp_split_to_array(h, '\s+'), lambda w: w <> '')) between 2 and 3 and regexp_matches(h, '^[\p{L}\s]+$') capital, array_to_string(list_transform(string_split(lower(h), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') named from x)
        select article_id, case when h = '' then 'Untitled Report' when doctor then case when length(f) > 10 then substr(f, 1, 80) else 'Medical Column: ' || h end when lower(h) = lower(b) then case when length(f) > 10 then substr(f, 1, 80) else 'Profile: ' || h end
            when capital and length(f) > 15 then upper(substr(topic, 1, 1)) || lower(substr(topic, 2, 70)) when capital then 'Special Feature: ' || named else h end headline,
            case when h = '' then byline_author when doctor then own when lower(h) = lower(b) then b when capital and length(f) > 15 then case when b is null then h else h || ' / ' || b end when capital then coalesce(b, named) else b end byline from y""",
    "t04_ligatures": _ligature_sql(),
    "t06_sanitized": SQL + rf"""select article_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(full_text, ''), '\n\s*\n'), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda y: trim(y)), lambda x: not {_noise('x')}), chr(10))), lambda q: q <> ''), chr(10) || chr(10)) as text from a_""",
    "t16_printed_dates": "with t as (select distinct item_id, text from parsed_items), d as (select item_id, coalesce(" + ", ".join([_dated(rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+{_month}\.?,?\s+(\d{{4}})", 3, 2, 1, True), _dated(rf"{_month}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", 3, 1, 2, True), _dated(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", 1, 2, 3, False), _dated(r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", 3, 2, 1, False)]) + ") printed from t) select * from d where printed is not null",
    "t19_summaries": SQL + f""", p as (select article_id, headline, list_filter(list_transform(string_split(coalesce(full_text, ''), chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') p from a_),
        l as (select *, trim(array_to_string(({_sentences('p[1]')})[1:2], ' ')) lead, ({_sentences('p[2]')})[1] more from p)
        select article_id, case when len(p) = 0 then coalesce(nullif(headline, ''), 'News article report.') else substr(case when length(lead) < 30 and len(p) > 1 then lead || ' ' || more else lead end, 1, 500) end summary from l""",
    "t26_citations": SQL + f""", c as (select article_id, '[1] ' || newspaper || ', ' || cast(issue_date as varchar) || ', Page 3, "' || coalesce(headline, 'none') || '"' t from dated_articles)
        select article_id, nullif(trim(regexp_extract(t, '{_cite}', 1)), '') newspaper, nullif(trim(regexp_extract(t, '{_cite}', 2)), '') issue_date, try_cast(nullif(trim(regexp_extract(t, '{_cite}', 3)), '') as integer) as page, nullif(trim(regexp_extract(t, '{_cite}', 4)), '') headline from c""",
    "k14_reclassified": f"""with s9 as ({ORACLE['t09_ad_signals']}), z9 as (select *, trim(regexp_replace(coalesce(full_text, ''), '\\s+', ' ', 'g')) t from (select distinct id article_id, headline, byline_author, article_type, word_count, full_text from articles)),
        y9 as (select z9.*, s9.* exclude (article_id), regexp_matches(t, '{_d(T.AD_CATEGORIES[1])}') priced, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) n from z9 join s9 using (article_id)),
        x9 as (select *, case when n = 0 then false when header then true when terms >= 3 then true when density >= 0.04 and score >= 3.5 then true when editorial >= 3 and n >= 350 then score >= 6 when n < 50 and ((density >= 0.2 and score >= 2) or (priced and editorial = 0)) then true when n < 250 and score >= 3 then true else score >= 4.5 end is_ad from y9),
        w9 as (select *, coalesce(article_type = 'advertisement', false) or (byline_author is null and coalesce(word_count < 300, false) and is_ad) ad, coalesce(headline, '') h from x9)
        select article_id, case when ad then 'advertisement' else article_type end article_type, case when ad and not starts_with(h, '[Advertisement]') then '[Advertisement] ' || h else h end headline from w9""",
}
