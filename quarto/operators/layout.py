"""Page layout and assembly: reading order, segments, stitching across pages, visuals and their stories.

Block assembly runs per page, whose items are few; everything else is
expressions, joins within a page or issue, and windows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarto.functions import geometry as G
from quarto.functions import text as T
from quarto.plans.graph import connected_components
from quarto.sources.archive import SQL, Archive

PAGE_W, PAGE_H = 2000.0, 3000.0
HEADS = ("title", "section_header")


# Reach of a headline's span in pixels, share of an item's width that lies under it, gap between columns, height of a band of headlines.
SPAN_SLACK, UNDER, LANE_GAP, BAND = 30.0, 0.40, 90.0, 30.0


def _lanes(items: list[dict], gap: float) -> list[list[dict]]:
    """Columns from left to right, each from top to bottom: a left edge more than ``gap`` beyond the one before starts the next."""
    lanes: list[list[dict]] = []
    edge = None
    for it in sorted(items, key=lambda i: (i["box"][0], i["item_id"])):
        if edge is None or it["box"][0] - edge > gap:
            lanes.append([])
        lanes[-1].append(it)
        edge = it["box"][0]
    return [sorted(lane, key=lambda i: (i["box"][1], i["item_id"])) for lane in lanes]


def page_items(ar: Archive) -> DataFrame:
    """Items of scanned pages with a whole box, each once."""
    return ar.table("parsed_items").dropDuplicates(["item_id"]).where(F.size("bbox") >= 4)


def reading_order(items: DataFrame) -> DataFrame:
    """(layout_id, item_id, reading_index, lane) of items (layout_id, item_id, label, bbox), each once.

    An item belongs to the nearest headline above whose span it lies under;
    headlines go by bands from the top and left to right, what belongs to none
    comes last. Under a headline the columns are read from left to right, each
    from the top; a headline is in lane 0. Pages are joined by equality and
    ordered by windows, so a page is never a Python object.
    """
    b = F.col("bbox")
    it = items.select("layout_id", "item_id", F.col("label").isin(*HEADS).alias("head"), b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1"))
    heads = it.where("head").select("layout_id", F.col("item_id").alias("head_id"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y0").alias("hy0"), F.col("y1").alias("hy1"))
    left, right, mid = F.col("hx0") - SPAN_SLACK, F.col("hx1") + SPAN_SLACK, (F.col("x0") + F.col("x1")) / 2
    under = mid.between(left, right) | ((F.least("x1", right) - F.greatest("x0", left)) >= UNDER * F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)))
    above = F.col("hy1") <= (F.col("y0") + F.col("y1")) / 2
    body = it.where("not head").join(heads, "layout_id").where(under & above)
    near = F.row_number().over(Window.partitionBy("layout_id", "item_id").orderBy(F.desc("hy1"), "hx0", "head_id"))
    body = body.withColumn("r", near).where("r = 1").select("layout_id", "item_id", "head_id")
    placed = it.join(body, ["layout_id", "item_id"], "left").withColumn("head_id", F.when(F.col("head"), F.col("item_id")).otherwise(F.col("head_id")))
    placed = placed.join(heads.select("layout_id", "head_id", "hx0", "hy0"), ["layout_id", "head_id"], "left")
    column = Window.partitionBy("layout_id", "head_id", "head").orderBy("x0", "item_id")
    starts = F.coalesce(F.col("x0") - F.lag("x0").over(column) > LANE_GAP, F.lit(True)).cast("int")
    placed = placed.withColumn("starts", starts).withColumn("lane", F.when(F.col("head"), 0).otherwise(F.sum("starts").over(column)).cast("int"))
    order = Window.partitionBy("layout_id").orderBy(F.col("head_id").isNull(), F.round(F.col("hy0") / BAND), "hx0", "head_id", "lane", "y0", "item_id")
    return placed.select("layout_id", "item_id", F.row_number().over(order).alias("reading_index"), "lane")


def ordered_items(ar: Archive) -> DataFrame:
    """(layout_id, item_id, reading_index, lane) of every page."""
    return reading_order(page_items(ar))


def segments(ar: Archive) -> DataFrame:
    """K7, K9: (layout_id, segment, headline, body, items, bbox): in reading order a headline opens a segment.

    Headlines that follow each other make one; captions, pictures and tables
    stay with their segment; text before any headline is a segment without one.
    """
    order = ordered_items(ar).join(page_items(ar).select("item_id", "label", "text", "bbox"), "item_id")
    w = Window.partitionBy("layout_id").orderBy("reading_index")
    head = F.col("label").isin(*HEADS)
    opens = head & ~F.coalesce(F.lag(head).over(w), F.lit(False)) | (F.col("reading_index") == 1)
    s = order.withColumn("segment", F.sum(opens.cast("int")).over(w)).withColumn("head", head)
    text = lambda flag, sep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("reading_index", "head", "text"))), lambda x: (x["head"] == flag) & (F.length(F.trim(x["text"])) > 0)), lambda x: F.trim(x["text"])), sep)
    box = F.array(F.min(F.col("bbox")[0]), F.min(F.col("bbox")[1]), F.max(F.col("bbox")[2]), F.max(F.col("bbox")[3]))
    return s.groupBy("layout_id", "segment").agg(text(True, " ").alias("headline"), text(False, "\n\n").alias("body"), F.count("*").alias("items"), box.alias("bbox"))


def _box_union(a: list[float], b: list[float]) -> list[float]:
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def merge_headlines(items: list[dict], width: float = PAGE_W) -> list[dict]:
    """K4: slices of one headline joined: same band (half their height in common), heights within 15 %, gap of 3.5 % of the page at most.

    One pass from left to right within each band; the union keeps the least id
    and the members.
    """
    heads = sorted((i for i in items if i["label"] in HEADS), key=lambda i: (i["box"][1], i["box"][0], i["item_id"]))
    out: list[dict] = []
    for h in sorted(heads, key=lambda i: (i["box"][0], i["item_id"])):
        tall = h["box"][3] - h["box"][1]
        for o in out:
            t = o["box"][3] - o["box"][1]
            band = min(o["box"][3], h["box"][3]) - max(o["box"][1], h["box"][1])
            if band >= 0.5 * min(t, tall) and abs(t - tall) <= 0.15 * max(t, tall) and -0.01 * width <= h["box"][0] - o["box"][2] <= 0.035 * width:
                o["box"], o["text"] = _box_union(o["box"], h["box"]), f"{o['text']} {h['text']}".strip()
                o["members"].append(h["item_id"])
                break
        else:
            out.append({**h, "text": h["text"] or "", "members": [h["item_id"]]})
    return out


def attach_drop_caps(items: list[dict], look: int = 4) -> list[dict]:
    """A block of one capital goes to the front of the first of the next ``look`` blocks that lies right of it at its height and starts in lower case."""
    rows = sorted(items, key=lambda i: (i["box"][1], i["box"][0], i["item_id"]))
    taken: set[int] = set()
    for k, c in enumerate(rows):
        letter = (c["text"] or "").strip()
        if len(letter) != 1 or not letter.isupper():
            continue
        for t in rows[k + 1 : k + 1 + look]:
            body = (t["text"] or "").lstrip()
            level = min(c["box"][3], t["box"][3]) - max(c["box"][1], t["box"][1])
            if t["item_id"] not in taken and len(body) > 1 and body[0].islower() and level > 0 and -5 <= t["box"][0] - c["box"][2] <= 60:
                t["text"], t["box"] = letter + body, _box_union(c["box"], t["box"])
                taken.add(c["item_id"])
                break
    return [r for r in rows if r["item_id"] not in taken]


def consolidate(items: list[dict], height: float = PAGE_H) -> list[dict]:
    """K5: text blocks of one column joined from top to bottom while the gap is 1.5 % of the page at most; a headline between them parts them."""
    items = attach_drop_caps([dict(i) for i in items])
    heads = [i for i in items if i["label"] in HEADS]
    out: list[dict] = []
    for lane in _lanes([i for i in items if i["label"] not in HEADS], 90.0):
        for it in lane:
            last = out[-1] if out and out[-1].get("lane") is lane else None
            if last is not None:
                gap = it["box"][1] - last["box"][3]
                between = any(last["box"][3] <= h["box"][1] <= it["box"][1] and min(h["box"][2], it["box"][2]) > max(h["box"][0], it["box"][0]) for h in heads)
                if last["label"] == it["label"] and -0.02 * height <= gap <= 0.015 * height and not between:
                    last["text"] = f"{last['text']}\n{it['text'] or ''}".strip()
                    last["box"] = _box_union(last["box"], it["box"])
                    last["members"].append(it["item_id"])
                    continue
            out.append({**it, "text": it["text"] or "", "lane": lane, "members": [it["item_id"]]})
    return out


def table_from_words(words: list[dict]) -> tuple[str, dict[str, str]]:
    """(Markdown table, first column to last number) of word boxes: rows by vertical centre, cells where the gap exceeds a word height."""
    if not words:
        return "", {}
    tall = sorted(w["box"][3] - w["box"][1] for w in words)[len(words) // 2] or 1.0
    rows: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (w["box"][1] + w["box"][3], w["box"][0])):
        mid = (w["box"][1] + w["box"][3]) / 2
        if rows and abs(mid - sum(x["box"][1] + x["box"][3] for x in rows[-1]) / 2 / len(rows[-1])) <= 0.6 * tall:
            rows[-1].append(w)
        else:
            rows.append([w])
    table: list[list[str]] = []
    for row in rows:
        cells: list[str] = []
        edge = None
        for w in sorted(row, key=lambda w: w["box"][0]):
            if edge is None or w["box"][0] - edge > 1.2 * tall:
                cells.append(w["text"])
            else:
                cells[-1] += " " + w["text"]
            edge = w["box"][2]
        table.append(cells)
    wide = max(map(len, table))
    table = [r + [""] * (wide - len(r)) for r in table]
    lines = ["| " + " | ".join(r) + " |" for r in table]
    lines.insert(1, "|" + "---|" * wide)
    number = re.compile(r"[-+]?\d[\d.,]*%?$")
    metrics = {r[0]: next(c for c in reversed(r) if number.match(c)) for r in table if r[0] and any(number.match(c) for c in r[1:])}
    return "\n".join(lines), metrics


def _page_blocks(ar: Archive, machine) -> DataFrame:
    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [{"item_id": int(i), "label": lab, "text": t, "box": list(b)} for i, lab, t, b in zip(pdf.item_id, pdf.label, pdf.text, pdf.bbox)]
        out = machine(items)
        objects = lambda xs: pd.Series(xs, dtype=object)
        return pd.DataFrame({"layout_id": pd.Series([int(pdf.layout_id.iloc[0])] * len(out), dtype="int64"), "item_id": pd.Series([min(o["members"]) for o in out], dtype="int64"), "members": objects([sorted(o["members"]) for o in out]), "text": objects([o["text"] for o in out]), "bbox": objects([o["box"] for o in out])})

    return page_items(ar).select("layout_id", "item_id", "label", "text", "bbox").groupBy("layout_id").applyInPandas(page, "layout_id long, item_id long, members array<long>, text string, bbox array<double>")


_BULLET = re.compile(r"(?m)^(?=\s*(?:[•▪■►]|\d{1,2}[.)]\s|[A-Z][A-Z .]{2,20}:\s))")


def debundle(text: str, least: int = 8) -> list[str]:
    """K8: short pieces bundled in one text, cut before bullets, numbers and datelines (two at least); parts under ``least`` words join the one before."""
    parts = [p for p in _BULLET.split(text) if p.strip()]
    if len(parts) < 2:
        return [text]
    out: list[str] = []
    for p in parts:
        if out and len(p.split()) < least:
            out[-1] += p
        else:
            out.append(p)
    return [p.strip() for p in out]


# Overlap of headlines by which a part that a jump points to goes on, by which any part does, words of a headline that is long enough by itself, words of a teaser.
JUMP_CONTAINMENT, JUMP_JACCARD, NEAR_CONTAINMENT, NEAR_JACCARD, LONG_HEADLINE, TEASER_WORDS = 0.30, 0.20, 0.80, 0.60, 4, 35
_MARKER = r"(?i)\b(?:continued\s+from|from\s+page|cont['’]d|turn\s+to)\b|\.{3}|…"


def continuations(parts: DataFrame) -> DataFrame:
    """(issue_id, id, next_id): the part of a later page in which a part goes on; each part follows one and has one next part per page.

    ``parts``: issue_id, id, page, headline, byline, text, jump. Parts meet on
    the words of their headlines within an issue; a part goes on where its jump
    points to and the headlines overlap a little, or where they overlap much.
    Of several the best by jump, overlap, nearness of the page and id is taken
    on both sides.
    """
    words = T.headline_words(F.col("headline"))
    p = parts.select("issue_id", "id", "page", "jump", F.lower(F.coalesce("byline", F.lit(""))).alias("byline"), F.coalesce("headline", F.lit("")).alias("headline"), F.concat_ws(" ", "headline", F.substring("text", 1, 200)).rlike(_MARKER).alias("marker"), words.alias("words"))
    token = p.select("issue_id", "id", "page", F.explode("words").alias("word"))
    met = token.join(token.select("issue_id", F.col("id").alias("next_id"), F.col("page").alias("next_page"), "word"), ["issue_id", "word"]).where("next_page > page").select("issue_id", "id", "next_id").distinct()
    follow = p.select("issue_id", F.col("id").alias("next_id"), F.col("page").alias("next_page"), F.col("headline").alias("next_headline"), F.col("byline").alias("next_byline"), F.col("marker").alias("next_marker"), F.size("words").alias("next_words"))
    m = met.join(p, ["issue_id", "id"]).join(follow, ["issue_id", "next_id"]).withColumn("m", T.continuation_metrics(F.col("headline"), F.col("next_headline")))
    jac, con, shared = (F.col(f"m.{c}") for c in ("jaccard", "containment", "shared"))
    jump = (F.col("jump") == F.col("next_page")) & ((con >= JUMP_CONTAINMENT) | (jac >= JUMP_JACCARD) | ((shared >= 1) & F.col("next_marker")))
    alike = (con >= NEAR_CONTAINMENT) | (jac >= NEAR_JACCARD) | ((shared >= 2) & F.col("next_marker"))
    same = (F.col("byline") != "") & F.col("next_byline").contains(F.col("byline"))
    near = alike & ((F.least(F.size("words"), F.col("next_words")) >= LONG_HEADLINE) | same | F.col("next_marker") | (jac >= NEAR_JACCARD))
    m = m.withColumn("jumps", F.coalesce(jump, F.lit(False)).cast("int")).where((F.col("jumps") == 1) | near).withColumn("jac", jac)
    best = lambda *by: F.row_number().over(Window.partitionBy("issue_id", *by).orderBy(F.desc("jumps"), F.desc("jac"), F.col("next_page") - F.col("page"), "id", "next_id"))
    return m.withColumn("r", best("next_id")).where("r = 1").withColumn("q", best("id", "next_page")).where("q = 1").select("issue_id", "id", "next_id")


def stitch(parts: DataFrame) -> DataFrame:
    """(issue_id, article_id, members, headline, byline, pages, word_count): the stories of each issue, continuations merged.

    Parts that go on in each other are one story, told by its first part. The
    longest headline and the first byline win; a teaser of under TEASER_WORDS
    words that goes on nowhere joins the story before it.
    """
    links = continuations(parts)
    chain = connected_components(links, "id", "next_id").select(F.col("node").alias("id"), F.col("component"))
    order = Window.partitionBy("issue_id", "component").orderBy("page", "id")
    p = parts.join(chain, "id", "left").withColumn("component", F.coalesce("component", "id"))
    p = p.withColumn("story", F.first("id").over(order)).withColumn("n", F.size(T.words(F.coalesce("text", F.lit("")))))
    own = Window.partitionBy("issue_id", "component")
    p = p.withColumn("fold", F.coalesce(F.col("teaser"), F.lit(False)) & (F.count("*").over(own) == 1) & (F.col("n") < TEASER_WORDS))
    before = Window.partitionBy("issue_id").orderBy("page", "id").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("into", F.last(F.when(~F.col("fold"), F.col("story")), ignorenulls=True).over(before)).withColumn("part", F.when(F.col("fold"), F.coalesce("into", "story")).otherwise(F.col("story")))
    head = F.when(~F.col("fold") | F.col("into").isNull(), F.struct(F.length(F.coalesce("headline", F.lit(""))).alias("n"), (-F.col("page")).alias("p"), (-F.col("id")).alias("i"), "headline"))
    by = F.when(F.col("byline") != "", F.struct("page", "id", "byline"))
    g = p.groupBy("issue_id", F.col("part").alias("article_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page", "id"))), lambda x: x["id"]).alias("members"), F.coalesce(F.nullif(F.max(head)["headline"], F.lit("")), F.lit("Untitled Article")).alias("headline"), F.min(by)["byline"].alias("byline"),
        F.array_sort(F.collect_set("page")).alias("pages"), F.sum("n").cast("int").alias("word_count"),
    )
    return g.select("issue_id", "article_id", "members", "headline", "byline", "pages", "word_count")


def stitched_stories(ar: Archive) -> DataFrame:
    """The stitched stories of every issue, with members and pages as text."""
    parts = ar.stories.select("issue_id", F.col("article_id").alias("id"), F.col("page_number").alias("page"), "headline", "byline", F.col("body_text").alias("text"), F.col("continues_to_page").alias("jump"), (F.col("article_type") == "teaser").alias("teaser"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return stitch(parts).select("issue_id", "article_id", text("members"), "headline", "byline", text("pages"), "word_count")


def box_pairs(ar: Archive) -> DataFrame:
    """B1: overlap, IoU, track ratio and distance of every two stories of a page, the smaller id first; a page has few."""
    s = ar.stories.where(F.size("bbox") >= 4).select("layout_id", "article_id", "bbox")
    p = s.join(s.select("layout_id", F.col("article_id").alias("other_id"), F.col("bbox").alias("o")), "layout_id").where("article_id < other_id")
    a, b = F.col("bbox"), F.col("o")
    r = lambda c, n: F.round(c, 6).alias(n)
    return p.select("layout_id", "article_id", "other_id", r(G.h_overlap(a, b), "h_overlap"), r(G.v_overlap(a, b), "v_overlap"), r(G.iou(a, b), "iou"), r(G.track_ratio(a, b), "track_ratio"), r(G.distance(a, b), "distance"), G.contains(a, b).alias("contains"))


def photo_bindings(ar: Archive) -> DataFrame:
    """(item_id, article_id, score): the story each picture of a page belongs to.

    0.4 horizontal overlap, 0.4 nearness (gone at 600 px), 0.5 if the picture's
    centre lies in the story (not for a box of over 40 % of the page), and 0.25
    per word of four letters that caption and headline share, 0.6 at most.
    Equal scores go to the least id.
    """
    ph = page_items(ar).where("label = 'picture'").select("layout_id", "item_id", F.col("bbox").alias("p"), F.lower(F.coalesce("text", F.lit(""))).alias("cap"))
    st = ar.stories.where(F.size("bbox") >= 4).select("layout_id", "article_id", F.col("bbox").alias("a"), F.lower(F.coalesce("headline", F.lit(""))).alias("h"))
    j = ph.join(st, "layout_id")
    p, a = F.col("p"), F.col("a")
    cx, cy = G.center(p)
    inside = (F.least(a[0], a[2]) <= cx) & (cx <= F.greatest(a[0], a[2])) & (F.least(a[1], a[3]) <= cy) & (cy <= F.greatest(a[1], a[3]))
    giant = G.area(a) / (PAGE_W * PAGE_H) > 0.40
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9_]{4,}"), F.lit(0)))
    caption = F.least(F.lit(0.6), F.size(F.array_intersect(words(F.col("cap")), words(F.col("h")))) * 0.25)
    score = 0.4 * G.h_overlap(p, a) / F.greatest(F.lit(1.0), G.width(p)) + 0.4 * F.greatest(F.lit(0.0), 1 - G.distance(p, a) / 600) + F.when(inside & ~giant, 0.5).otherwise(0.0) + caption
    j = j.select("item_id", "article_id", F.round(score, 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "article_id")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def visual_triage(ar: Archive) -> DataFrame:
    """Pictures and tables by size: normalised box, and whether area (0.5 to 60 % of the page), sides and aspect (12 at most) let them through."""
    v = page_items(ar).where(F.col("label").isin("picture", "table"))
    b = F.col("bbox")
    share = G.area(b) / (PAGE_W * PAGE_H)
    ok = share.between(0.005, 0.60) & (F.least(G.width(b), G.height(b)) >= 30) & (F.greatest(G.aspect(b), F.when(G.aspect(b) > 0, 1 / G.aspect(b)).otherwise(99.0)) <= 12)
    n = G.normalized(b, PAGE_W, PAGE_H)
    return v.select("item_id", "label", F.round(share, 6).alias("share"), *[n[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], ok.alias("keep"))


def issue_view(ar: Archive) -> DataFrame:
    """Per issue the pages with their stories nested in order, and how each page was read."""
    s = ar.stories.select("issue_id", "page_number", "is_advertisement_page", F.struct("article_id", F.substring(F.coalesce("body_text", F.lit("")), 1, 300).alias("preview")).alias("s"))
    p = s.groupBy("issue_id", "page_number").agg(F.max("is_advertisement_page").alias("ad"), F.array_sort(F.collect_list("s")).alias("stories"))
    mode = F.when(F.col("ad"), "Advertisement").when(F.size("stories") == 0, "OCR").otherwise("Digital Native")
    return p.select("issue_id", "page_number", mode.alias("extraction_mode"), F.size("stories").alias("stories"), F.array_join(F.transform("stories", lambda x: x["article_id"].cast("string")), ",").alias("article_ids"))


def masthead(ar: Archive) -> DataFrame:
    """The topmost text in the upper 15 % of each page."""
    t = page_items(ar).where((F.col("bbox")[1] <= 0.15 * PAGE_H) & (F.length(F.trim("text")) > 0))
    return t.groupBy("layout_id").agg(F.min_by("text", F.struct(F.col("bbox")[1], "item_id")).alias("masthead"))


def number_agreement(ar: Archive) -> DataFrame:
    """Share of a chunk's numbers that its article has too, 0.4 + 0.6 times it, between 0.2 and 1."""
    nums = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))
    c = ar.chunks.select(F.col("id").alias("chunk_id"), "article_id", nums(F.col("raw_text")).alias("x")).join(ar.articles.select(F.col("id").alias("article_id"), nums(F.col("full_text")).alias("y")), "article_id").where(F.size("x") > 0)
    share = F.size(F.array_intersect("x", "y")) / F.size("x")
    return c.select("chunk_id", F.round(F.greatest(F.lit(0.2), F.least(F.lit(1.0), 0.4 * 0.9 + 0.6 * share)), 6).alias("agreement"))


def _q(f):
    return lambda spark, root: f(Archive(spark, root))


QUERIES = {
    "b01_box_pairs": _q(box_pairs),
    "b02_visual_triage": _q(visual_triage),
    "b04_number_agreement": _q(number_agreement),
    "j16_photo_bindings": _q(photo_bindings),
    "k04_merged_headlines": _q(lambda ar: _page_blocks(ar, merge_headlines)),
    "k05_consolidated_blocks": _q(lambda ar: _page_blocks(ar, consolidate)),
    "k06_reading_order": _q(ordered_items),
    "k07_segments": _q(lambda ar: segments(ar).select("layout_id", "segment", "headline", "body", "items", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("left_edge", "top_edge", "right_edge", "bottom_edge"))])),
    "k12_stitched_stories": _q(stitched_stories),
    "k13_masthead": _q(masthead),
    "k23_issue_view": _q(issue_view),
}

_ORDER = """with it as (select distinct * from parsed_items where len(bbox) >= 4), i9 as (select distinct layout_id, item_id, label in ('title', 'section_header') head, bbox[1] x0, bbox[2] y0, bbox[3] x1, bbox[4] y1 from it),
        h9 as (select layout_id, item_id head_id, x0 hx0, x1 hx1, y0 hy0, y1 hy1 from i9 where head),
        b9 as (select layout_id, item_id, head_id from (select i.layout_id, item_id, head_id, row_number() over (partition by i.layout_id, item_id order by hy1 desc, hx0, head_id) r from i9 i join h9 h on i.layout_id = h.layout_id
            where not head and hy1 <= (y0 + y1) / 2 and ((x0 + x1) / 2 between hx0 - 30 and hx1 + 30 or least(x1, hx1 + 30) - greatest(x0, hx0 - 30) >= 0.4::double * greatest(x1 - x0, 1))) where r = 1),
        p9 as (select i.*, case when head then item_id else b.head_id end head_id from i9 i left join b9 b using (layout_id, item_id)), q9 as (select p.*, hx0, hy0 from p9 p left join h9 using (layout_id, head_id)),
        g9 as (select *, case when coalesce(x0 - lag(x0) over (partition by layout_id, head_id, head order by x0, item_id) > 90, true) then 1 else 0 end starts from q9),
        lanes as (select *, cast(case when head then 0 else sum(starts) over (partition by layout_id, head_id, head order by x0, item_id) end as integer) lane from g9)"""
_STITCHED = SQL + r""", w as (select issue_id, article_id id, page_number page, continues_to_page jump, headline, lower(coalesce(byline, '')) byline, byline raw_byline, coalesce(article_type = 'teaser', false) teaser, len(list_filter(regexp_split_to_array(coalesce(body_text, ''), '\s+'), lambda x: x <> '')) n,
        regexp_matches(concat_ws(' ', headline, substr(body_text, 1, 200)), '(?i)(?:continued\s+from|from\s+page|cont[''’]d|turn\s+to)|\.{3}|…') marker,
        list_filter(list_distinct(regexp_extract_all(lower(coalesce(nullif(trim(regexp_replace(coalesce(headline, ''), '(?i)[.…]+\s*(?:from\s+page\s+\d+|cont[''’]?d?|continued\s+from\s+p(?:age)?\s*\d*).*$', '')), ''), coalesce(headline, ''))), '[a-z0-9_]+')), lambda x: not list_contains(__WORDS__, x)) t from stories),
        m as (select a.issue_id, a.id, b.id next_id, a.page, b.page next_page, a.jump, a.byline, b.byline nb, b.marker nm, len(a.t) la, len(b.t) lb, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) jac, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) con, len(list_filter(list_intersect(a.t, b.t), lambda v: length(v) >= 4)) sh
            from w a join w b on a.issue_id = b.issue_id and b.page > a.page and len(list_intersect(a.t, b.t)) > 0),
        k as (select *, case when coalesce(jump = next_page and (con >= 0.3 or jac >= 0.2 or (sh >= 1 and nm)), false) then 1 else 0 end j from m),
        l as (select * from k where j = 1 or ((con >= 0.8 or jac >= 0.6 or (sh >= 2 and nm)) and (least(la, lb) >= 4 or (byline <> '' and contains(nb, byline)) or nm or jac >= 0.6))),
        r1 as (select * from (select *, row_number() over (partition by issue_id, next_id order by j desc, jac desc, next_page - page, id, next_id) r from l) where r = 1),
        links as (select issue_id, id, next_id from (select *, row_number() over (partition by issue_id, id, next_page order by j desc, jac desc, next_page - page, id, next_id) q from r1) where q = 1),
        up as (select w.issue_id, w.id, coalesce(links.id, w.id) top from w left join links on links.issue_id = w.issue_id and links.next_id = w.id),
        u2 as (select a.issue_id, a.id, b.top from up a join up b on a.top = b.id and a.issue_id = b.issue_id), u4 as (select a.issue_id, a.id, b.top from u2 a join u2 b on a.top = b.id and a.issue_id = b.issue_id), u8 as (select a.issue_id, a.id, b.top from u4 a join u4 b on a.top = b.id and a.issue_id = b.issue_id), u16 as (select a.issue_id, a.id, b.top from u8 a join u8 b on a.top = b.id and a.issue_id = b.issue_id), u32 as (select a.issue_id, a.id, b.top from u16 a join u16 b on a.top = b.id and a.issue_id = b.issue_id),
        s0 as (select w.*, u.top component, first_value(w.id) over (partition by w.issue_id, u.top order by w.page, w.id) story, count(*) over (partition by w.issue_id, u.top) c from w join u32 u using (issue_id, id)),
        s1 as (select *, teaser and c = 1 and n < 35 fold from s0), s2 as (select *, last_value(case when not fold then story end ignore nulls) over (partition by issue_id order by page, id rows between unbounded preceding and 1 preceding) into_ from s1),
        s3 as (select *, case when fold then coalesce(into_, story) else story end part from s2)
        select issue_id, part article_id, string_agg(cast(id as varchar), ',' order by page, id) members, coalesce(nullif(arg_max(headline, row(length(coalesce(headline, '')), -page, -id)) filter (not fold or into_ is null), ''), 'Untitled Article') headline,
        arg_min(raw_byline, row(page, id)) filter (raw_byline <> '') byline, array_to_string(list_sort(list_distinct(list(page))), ',') pages, cast(sum(n) as integer) word_count from s3 group by 1, 2""".replace("__WORDS__", "[" + ", ".join(f"'{w}'" for w in T.CONTINUATION_WORDS) + "]")
_ITEMS = "it as (select distinct * from parsed_items where len(bbox) >= 4)"
ORACLE = {
    "b01_box_pairs": SQL + """, s9 as (select x.layout_id, x.article_id, x.bbox a, y.article_id other_id, y.bbox b from stories x join stories y on x.layout_id = y.layout_id and x.article_id < y.article_id where len(x.bbox) >= 4 and len(y.bbox) >= 4),
        x9 as (select *, greatest(0.0, least(a[3], b[3]) - greatest(a[1], b[1])) h, greatest(0.0, least(a[4], b[4]) - greatest(a[2], b[2])) v, (a[3] - a[1]) * (a[4] - a[2]) aa, (b[3] - b[1]) * (b[4] - b[2]) bb from s9)
        select layout_id, article_id, other_id, round(h, 6) h_overlap, round(v, 6) v_overlap, round(case when h * v > 0 then h * v / (aa + bb - h * v) else 0 end, 6) iou, round(case when greatest(a[3] - a[1], b[3] - b[1]) > 0 then h / greatest(a[3] - a[1], b[3] - b[1]) else 0 end, 6) track_ratio,
        round(sqrt(pow(greatest(0.0, b[1] - a[3], a[1] - b[3]), 2) + pow(greatest(0.0, b[2] - a[4], a[2] - b[4]), 2)), 6) distance, a[1] <= b[1] and a[2] <= b[2] and a[3] >= b[3] and a[4] >= b[4] as "contains" from x9""",
    "b02_visual_triage": f"""with {_ITEMS}, v as (select *, bbox[3] - bbox[1] w, bbox[4] - bbox[2] h from it where label in ('picture', 'table'))
        select item_id, label, round(w * h / 6e6, 6) share, round(bbox[1] / 2000, 4) x0, round(bbox[2] / 3000, 4) y0, round(bbox[3] / 2000, 4) x1, round(bbox[4] / 3000, 4) y1,
        w * h / 6e6 between 0.005 and 0.6 and least(w, h) >= 30 and greatest(case when h > 0 then w / h else 0 end, case when w > 0 and h > 0 then h / w else 99 end) <= 12 as keep from v""",
    "b04_number_agreement": SQL + r""", c9 as (select distinct id, article_id, raw_text from article_chunks), y9 as (select id chunk_id, list_distinct(regexp_extract_all(coalesce(raw_text, ''), '[0-9]+(?:\.[0-9]+)?')) x, list_distinct(regexp_extract_all(coalesce(full_text, ''), '[0-9]+(?:\.[0-9]+)?')) y from c9 join a_ using (article_id))
        select chunk_id, round(greatest(0.2, least(1.0, 0.4::double * 0.9::double + 0.6::double * (len(list_intersect(x, y)) / len(x)))), 6) agreement from y9 where len(x) > 0""",
    "j16_photo_bindings": SQL + f""", {_ITEMS}, p9 as (select layout_id, item_id, bbox p, lower(coalesce(text, '')) cap from it where label = 'picture'), s9 as (select layout_id, article_id, bbox a, lower(coalesce(headline, '')) h from stories where len(bbox) >= 4),
        j9 as (select *, (p[1] + p[3]) / 2 cx, (p[2] + p[4]) / 2 cy, sqrt(pow(greatest(0.0, a[1] - p[3], p[1] - a[3]), 2) + pow(greatest(0.0, a[2] - p[4], p[2] - a[4]), 2)) d from p9 join s9 using (layout_id)),
        k9 as (select item_id, article_id, round(0.4::double * greatest(0.0, least(p[3], a[3]) - greatest(p[1], a[1])) / greatest(1.0, p[3] - p[1]) + 0.4::double * greatest(0.0, 1 - d / 600) + case when cx between a[1] and a[3] and cy between a[2] and a[4] and (a[3] - a[1]) * (a[4] - a[2]) / 6e6 <= 0.4 then 0.5 else 0 end::double
          + least(0.6, len(list_intersect(list_distinct(regexp_extract_all(cap, '[a-z0-9_]{{4,}}')), list_distinct(regexp_extract_all(h, '[a-z0-9_]{{4,}}')))) * 0.25)::double, 6) score from j9)
        select item_id, article_id, score from (select *, row_number() over (partition by item_id order by score desc, article_id) r from k9) where r = 1""",
    "k06_reading_order": _ORDER + " select layout_id, item_id, cast(row_number() over (partition by layout_id order by head_id is null, round(hy0 / 30), hx0, head_id, lane, y0, item_id) as integer) reading_index, lane from lanes",
    "k07_segments": _ORDER + """, o9 as (select l.*, t.text, row_number() over (partition by layout_id order by head_id is null, round(hy0 / 30), hx0, head_id, lane, y0, item_id) n from lanes l join (select distinct item_id, text from it) t using (item_id)),
        f9 as (select *, case when n = 1 or (head and not coalesce(lag(head) over (partition by layout_id order by n), false)) then 1 else 0 end opens from o9), s9 as (select *, sum(opens) over (partition by layout_id order by n) segment from f9)
        select layout_id, segment, coalesce(string_agg(trim(text), ' ' order by n) filter (head and length(trim(text)) > 0), '') headline, coalesce(string_agg(trim(text), chr(10) || chr(10) order by n) filter (not head and length(trim(text)) > 0), '') body, count(*) items, min(x0) left_edge, min(y0) top_edge, max(x1) right_edge, max(y1) bottom_edge from s9 group by 1, 2""",
    "k12_stitched_stories": _STITCHED,
    "k13_masthead": f"with {_ITEMS} select layout_id, text masthead from (select *, row_number() over (partition by layout_id order by bbox[2], item_id) r from it where bbox[2] <= 450 and length(trim(text)) > 0) where r = 1",
    "k23_issue_view": SQL + "select issue_id, page_number, case when bool_or(is_advertisement_page) then 'Advertisement' else 'Digital Native' end extraction_mode, cast(count(*) as integer) stories, string_agg(cast(article_id as varchar), ',' order by article_id) article_ids from stories group by 1, 2",
}
