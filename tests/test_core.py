"""Hand cases, invariants and edge cases of the core."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from util import frame

from quarto.functions import dates, geometry, text
from quarto.operators import analytics, enrichment, layout, mutations, orphans, retrieval, stories
from quarto.plans import filters, frontend, graph
from quarto.sources.archive import Archive


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


# orphan references


def refs(spark, rows):
    return frame(spark, rows, "ref_table string, ref_column string, ref_key string, ref_us long, target string, key string, extra string")


def parents(spark, rows):
    return frame(spark, rows, "target string, key string, arrival_us long, has_row boolean, deleted_us long")


def test_orphan_causes(spark):
    day = orphans.DAY_US
    p = parents(spark, [("t", "1", 10, True, None), ("t", "2", 10, True, 10), ("t", "3", 10, True, 9), ("t", "4", None, False, 5), ("t", "5", 3 * day, True, None), ("n", "1", None, True, None)])
    rows = [("r", "c", f"k{i}", us, t, k, "x") for i, (us, t, k) in enumerate([(0, "t", "1"), (0, "t", "2"), (0, "t", "3"), (0, "t", "4"), (0, "t", "5"), (2 * day, "t", "5"), (None, "t", "5"), (0, "n", "1"), (0, "t", "9"), (0, "u", "1")])]
    got = {r.ref_key: r.cause for r in orphans.find_orphans(refs(spark, rows + rows[:4]), p).collect()}
    assert got == {"k1": "deleted", "k3": "deleted", "k4": "late", "k8": "missing", "k9": "missing"}


def test_orphans_empty_and_hot(spark):
    p = parents(spark, [("t", str(i), 0, True, None) for i in range(50)])
    none = refs(spark, [])
    assert orphans.find_orphans(none, p).count() == 0
    rows = [("r", "c", str(i), 0, "t", "7" if i % 3 else f"gone{i}", None) for i in range(600)]
    out = orphans.find_orphans(refs(spark, rows), p, range_rows=5, split_rows=20)
    assert out.count() == 200 and {r.cause for r in out.collect()} == {"missing"}
    assert orphans.find_orphans(refs(spark, rows), parents(spark, [])).count() == 600


def test_keys(spark):
    d = frame(spark, [("7",), ("7.0",), (" 7 ",), ("",), (None,), ("a7",), ("7.5",)], "k string").select(orphans.number_key(F.col("k")).alias("k"))
    assert [r.k for r in d.collect()] == ["7", "7", "7", None, None, "text:a7", "text:7.5"]
    v = frame(spark, [("{AB-1} ",), (" ab-1",), ("{}",), (None,)], "k string").select(orphans.vector_key(F.col("k")).alias("k"))
    assert [r.k for r in v.collect()] == ["ab-1", "ab-1", None, None]


# components


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (9, 9)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in graph.connected_components(frame(spark, edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for e in edges if e[1] is not None and e[0] != e[1] for n in e}
    assert graph.connected_components(frame(spark, [], "a long, b long"), "a", "b").count() == 0


# metrics: values worked out by hand


def ranked(spark, ids):
    return frame(spark, [("q", str(x), i) for i, x in enumerate(ids, 1)], "query_id string, id string, rank int")


def truth(spark, ids):
    return frame(spark, [("q", str(x)) for x in ids], "query_id string, id string")


@pytest.mark.parametrize(("k", "recall", "precision"), [(1, 0, 0), (2, 1 / 3, 1 / 2), (5, 2 / 3, 2 / 5)])
def test_recall_precision(spark, k, recall, precision):
    r = retrieval.ranked_metrics(ranked(spark, ["a1", "a2", "a3", "a4", "a5"]), truth(spark, ["a2", "a4", "a6"]), k).first()
    assert (r.recall, r.precision) == (round(recall, 6), round(precision, 6))


def test_mrr_ndcg(spark):
    r = retrieval.ranked_metrics(ranked(spark, [10, 20, 30]), truth(spark, [20]), 3).first()
    assert (r.reciprocal_rank, r.ndcg) == (0.5, 0.63093)
    alone = retrieval.ranked_metrics(ranked(spark, [10]), truth(spark, []), 3).first()
    assert (alone.recall, alone.precision, alone.ndcg) == (0.0, 0.0, 0.0)
    assert retrieval.ranked_metrics(ranked(spark, []), truth(spark, [1]), 3).first().recall == 0.0


def test_citations(spark):
    r = retrieval.citation_metrics(truth(spark, [1, 2, 3]), truth(spark, [1, 2])).first()
    assert (r.precision, r.recall) == (0.666667, 1.0)


def test_fusion_by_hand(spark):
    dense = frame(spark, [("q", 1, 1), ("q", 2, 2), ("q", None, 3)], "query_id string, article_id long, rank int")
    sparse = frame(spark, [("q", 2, 1)], "query_id string, article_id long, rank int")
    got = {r.article_id: r.rrf_score for r in retrieval.fuse(dense, sparse).collect()}
    assert got == {1: 0.008197, 2: 0.016262} or got == {1: 0.008197, 2: 0.016261}


def test_fusion_bonus(spark):
    dense = frame(spark, [("q", 1, r) for r in range(1, 7)], "query_id string, article_id long, rank int")
    r = retrieval.fuse(dense, frame(spark, [], "query_id string, article_id long, rank int")).first()
    assert r.rrf_score == round(0.5 / 61 + 0.15 * 0.5 * (1 / 62 + 1 / 63 + 1 / 64), 6) and r.vector_hits == 6


def test_single_candidate(spark):
    fused = frame(spark, [("q", 1, 0.008)], "query_id string, article_id long, rrf_score double")
    q = frame(spark, [("q", "harbour storm")], "query_id string, query string")
    a = frame(spark, [(1, "Harbour", "a storm", 0.5)], "article_id long, headline string, full_text string, prominence_score double")
    assert retrieval.rerank(fused, q, a, strict=True).first().rerank_score == 0.008
    assert retrieval.rerank(fused, q, a).first().rerank_score == round(0.6 + 0.3 * 0.008 + 0.05, 4)


def test_faithfulness(spark):
    rows = [(1, "The central bank raised rates today. Rates were raised by the bank.", "Central bank raised its rates"), (2, "Completely invented statement about giraffes.", "central bank"), (3, "", "x"), (4, "Short.", "x"), (5, "A longer sentence here.", None)]
    got = {r.key: r.faithfulness for r in retrieval.faithfulness(frame(spark, rows, "key int, answer string, context string")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0}


# text functions


def test_prominence(spark):
    f = lambda page, words, head, kind: one(spark, text.prominence(F.lit(page), F.lit(words), F.lit(head), F.lit(1), F.lit(kind)))
    assert f(1, 550, "A headline of more than thirty characters", "news") == 0.90
    assert f(3, 20, "Sale", "advertisement") <= 0.40


def test_header(spark):
    h = one(spark, text.header_context(F.lit("Mint"), F.lit("2024-08-09"), F.lit("Markets"), F.lit("X"), F.array(F.lit(4), F.lit(1))))
    assert h == "[Newspaper: Mint | Date: 2024-08-09 | Section: Markets | Headline: X | Page(s): 1, 4]"


def brute_chunks(body, header, target=350, overlap=50, most=500):
    import re

    goal = min(target, max(50, most - len(header.split()) - 10))
    paras = [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]
    parts = []
    for p in paras:
        if len(p.split()) <= goal:
            parts.append(p)
            continue
        for line in (x.strip() for x in p.split("\n") if x.strip()):
            if len(line.split()) <= goal:
                parts.append(line)
                continue
            buf = []
            for s in re.split(r"(?<=[.!?])\s+", line):
                if buf and len(" ".join(buf).split()) + len(s.split()) > goal:
                    parts.append(" ".join(buf))
                    buf = []
                buf.append(s)
            parts.append(" ".join(buf))
    out, cur = [], []
    for p in parts:
        n = sum(len(c.split()) for c in cur)
        if cur and n + len(p.split()) > goal:
            out.append("\n\n".join(cur))
            cur = [cur[-1], p] if len(cur) > 1 and len(cur[-1].split()) <= overlap else [p]
        else:
            cur.append(p)
    return out + ["\n\n".join(cur)] if cur else out


def test_chunks_against_brute_force(spark):
    rng = random.Random(5)
    bodies = []
    for _ in range(25):
        sent = lambda: " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(3, 60))) + "."
        bodies.append("\n\n".join(rng.choice(["\n", " "]).join(sent() for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 9))))
    bodies += ["", "   ", "one"]
    head = "[Newspaper: A | Date: 2024-01-01 | Headline: B]"
    df = frame(spark, list(enumerate(bodies)), "i int, t string").select("i", text.chunk_texts(F.col("t"), F.lit(head)).alias("c"))
    for r in df.collect():
        assert r.c == brute_chunks(bodies[r.i], head), r.i
    assert frame(spark, [(None,)], "t string").select(text.chunk_texts(F.col("t"), F.lit(head)).alias("c")).first().c == []


def test_summary(spark):
    s = lambda t: one(spark, text.summary(F.lit("Head"), F.lit(t)))
    assert s("One sentence here is long. Second one! Third.") == "One sentence here is long. Second one!"
    assert s("Short.\n\nNext begins. More.") == "Short. Next begins."
    assert s("") == "Head"


def test_gibberish(spark):
    g = lambda t: one(spark, text.is_gibberish(F.lit(t)))
    assert g("b" * 80) and g("x y z " * 5 + "�" * 40) and g(("qqqqqq zz " * 20))
    assert not g("short") and not g("the and in to of for is on that by with as said from at it be an have has was were not " * 3)


def test_ads(spark):
    ad = lambda t: one(spark, text.is_ad(F.lit(t)))
    assert ad("ADVERTISEMENT buy") and ad("Book now! Flat 50% off, call toll free 1800-123-4567") and ad("t&c apply, cashback, easy emi, buyback")
    assert not ad("") and not ad("The council met on Tuesday to discuss the harbour wall.")


def test_ligatures_and_noise(spark):
    assert one(spark, text.repair_ligatures(F.lit("ﬁne o�cer e� ort pro�t a�b"))) == "fine officer effort profit ab"
    t = "Join FREE Whatsapp Channel now\nreal line\n\n01234567-89ab-cdef-0123-456789abcdef\n\nend"
    assert one(spark, text.sanitize_block(F.lit(t))) == "real line\n\nend"
    assert one(spark, text.printed_date(F.lit("Friday, August 9, 2024"))) == dt.date(2024, 8, 9)
    assert one(spark, text.printed_date(F.lit("9/8/2024"))) == dt.date(2024, 8, 9)
    assert one(spark, text.printed_date(F.lit("9/8/1999"))) is None


def test_dates(spark):
    f = lambda t: one(spark, dates.iso_date(F.lit(t)))
    for a, b in (("2024-1-2", "2024-01-02"), ("3/11/2024", "2024-11-03"), ("12-25-2024", "2024-12-25"), ("25-12-2024", "2024-12-25"), ("soon", "soon")):
        assert f(a) == b == filters.iso(a)


def test_boxes(spark):
    a, b = F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), F.array(*map(F.lit, (15.0, 10.0, 5.0, 5.0)))
    assert one(spark, geometry.iou(a, b)) == 25 / (100 + 50 - 25)
    assert one(spark, geometry.union(a, b)) == [0.0, 0.0, 15.0, 10.0]
    assert one(spark, geometry.distance(a, F.array(*map(F.lit, (13.0, 14.0, 20.0, 20.0))))) == 5.0


# layout and matching


def ordered(spark, items):
    return layout.reading_order(frame(spark, items, "layout_id long, item_id long, label string, bbox array<double>")).orderBy("layout_id", "reading_index").collect()


def test_reading_order_drops_nothing(spark):
    rng = random.Random(1)
    items = [(i % 2, i, rng.choice(["title", "text", "text", "picture"]), [x := rng.uniform(0, 1900), y := rng.uniform(0, 2800), x + 90, y + 60]) for i in range(120)]
    o = ordered(spark, items)
    assert sorted(r.item_id for r in o) == list(range(120)) and [r.reading_index for r in o] == [*range(1, 61)] * 2


def test_reading_order_columns(spark):
    box = lambda x, y, w=400: [float(x), float(y), float(x + w), float(y + 100)]
    items = [(1, 1, "title", box(100, 100, 1800)), (1, 2, "text", box(1000, 300)), (1, 3, "text", box(100, 500)), (1, 4, "text", box(100, 300)), (1, 5, "title", box(100, 900)), (1, 6, "text", box(120, 1100)), (1, 7, "text", box(1000, 1100)), (1, 8, "text", box(100, 10))]
    assert [(r.item_id, r.lane) for r in ordered(spark, items)] == [(1, 0), (4, 1), (3, 1), (2, 2), (7, 2), (5, 0), (6, 1), (8, 1)]


def test_stitch(spark):
    part = lambda i, page, head, text="some words of the story", jump=None, teaser=False, byline="": (9, i, page, head, byline, text, jump, teaser)
    rows = [part(1, 1, "Harbour wall falls", jump=3), part(2, 1, "Other news entirely", "x", byline="A. B."), part(3, 3, "Harbour wall falls in storm ... from page 1"), part(4, 2, "Teaser", "tiny", teaser=True), part(5, 4, "Harbour wall falls in storm", "the end"), part(6, 5, None, None)]
    got = layout.stitch(frame(spark, rows, "issue_id long, id long, page int, headline string, byline string, text string, jump int, teaser boolean")).orderBy("article_id").collect()
    assert [(r.members, r.pages) for r in got] == [([1, 3, 5], [1, 3, 4]), ([2, 4], [1, 2]), ([6], [5])]
    assert got[0].headline.startswith("Harbour wall falls in storm ... from") and got[1].byline == "A. B." and got[2].headline == "Untitled Article" and got[0].word_count == 12
    assert layout.stitch(frame(spark, [], "issue_id long, id long, page int, headline string, byline string, text string, jump int, teaser boolean")).count() == 0


def test_debundle():
    t = "• one two three four five six seven eight\n• nine ten\n• eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    assert len(layout.debundle(t)) == 2 and layout.debundle("plain text") == ["plain text"]


def test_greedy_is_one_to_one(spark):
    rng = random.Random(2)
    rows = [(dt.date(2024, 1, 1), 1, 2, rng.randrange(12), 100 + rng.randrange(12), rng.choice([0.4, 0.5, 0.6]), "words") for _ in range(60)]
    rows = list({(r[3], r[4]): r for r in rows}.values())
    df = frame(spark, rows, "issue_date date, paper_a long, paper_b long, id_a long, id_b long, score double, tier string")
    got = df.groupBy("issue_date", "paper_a", "paper_b").applyInPandas(stories._greedy, df.schema).collect()
    used_a, used_b, want = set(), set(), []
    for r in sorted(rows, key=lambda r: (-r[5], r[3], r[4])):
        if r[3] not in used_a and r[4] not in used_b:
            used_a.add(r[3])
            used_b.add(r[4])
            want.append((r[3], r[4]))
    assert sorted((r.id_a, r.id_b) for r in got) == sorted(want)


# mutations and filters


def test_upsert_and_cache(spark):
    s = "id int, v string, at long"
    old, new = frame(spark, [(1, "a", 5), (2, "b", 5), (3, None, 1)], s), frame(spark, [(1, "c", 5), (2, "d", 4)], s)
    assert sorted((r.id, r.v) for r in mutations.upsert_latest(old, new, "id", "at").collect()) == [(1, "c"), (2, "b"), (3, None)]
    again = mutations.upsert_latest(mutations.upsert_latest(old, new, "id", "at"), new, "id", "at")
    assert again.count() == 3
    c = frame(spark, [("k", "old", 0), ("k", "new", 10), ("dead", "x", -4_000_000_000)], "key string, value string, written_us long")
    assert [(r.key, r.value) for r in mutations.cached(c, 100).collect()] == [("k", "new")]


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda v, ks: frame(spark, [(k, v) for k in ks], "k int, v string")
    mutations.write_partitions(rows("a", [1, 2]), path, "k")
    for _ in range(2):
        mutations.write_partitions(rows("b", [2, 3]), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "b")]


def test_intake(spark, tmp_path):
    import zipfile

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/c.pdf", b"%PDF-1.7 y")
        z.writestr("__MACOSX/c.pdf", b"%PDF-1.7 y")
    assert sorted(r.name for r in mutations.pdf_intake(spark, str(tmp_path)).collect()) == ["a.pdf", "in/c.pdf"]


def test_page_filters(spark):
    assert filters.page_numbers("pages 2, 4 and 1024 or 15") == [2, 4, 15] and filters.page_numbers(None) == []
    d = frame(spark, [([1, 2],), ([3],)], "pages array<int>")
    assert d.where(filters.pages_overlap("pages", [2])).count() == 1 and d.where(filters.pages_overlap("pages", [2], exclude=True)).count() == 1


def test_upsert_max(spark):
    a, b = frame(spark, [(1, 2), (2, 5)], "k int, v int"), frame(spark, [(1, 3), (3, None)], "k int, v int")
    assert sorted((r.k, r.v) for r in analytics.upsert_max(a, b, ["k"], ["v"]).collect()) == [(1, 3), (2, 5), (3, None)]


# front end

PAPERS = ["Ostelby Ledger", "The Wexcombe Observer"]


def test_parse():
    q = frontend.parse('Stories in the Wexcombe Observer but not in Ostelby Ledger on 3rd March 2024, pages 2-4, "A quoted headline"', PAPERS, ["Farm & Weather"])
    assert q.papers == ["The Wexcombe Observer", "Ostelby Ledger"] and q.dates == ["2024-03-03"] and q.pages == [2, 3, 4] and q.differential and q.headline == "A quoted headline"
    assert frontend.decide(q)[0] == "coverage_difference"
    m = frontend.parse("issues in June", PAPERS, [], year=2025)
    assert (m.date_from, m.date_to) == ("2025-06-01", "2025-06-30")
    assert frontend.parse("issues in June", PAPERS, []).date_from is None and frontend.parse("you may ask", PAPERS, [], 2025).date_from is None
    assert frontend.follow_up("and page 3?", q, PAPERS, []).papers == q.papers


def test_safe_sql(spark):
    spark.range(3).createOrReplaceTempView("three")
    spark.range(3).createOrReplaceTempView("secret")
    spark.udf.register("own_udf", lambda x: x)
    ok = [
        "with a as (select id from three) select count(distinct id) n from a",
        "select count(*) n from three where id in (select max(id) + 1 from three) or exists (select 1 from three t where t.id = three.id)",
        "select n from (select id, row_number() over (order by id) n from three union all select id, 0 from three) order by n desc limit 1",
    ]
    for good in ok:
        assert frontend.safe_sql(spark, good, {"three"}).first().n == 3
    for bad in (
        "drop table three", "insert into three select 1", "create table x as select 1", "set a=b", "cache table three", "show tables", "describe three", "explain select 1", "add jar 'x'",
        "select java_method('java.lang.System', 'exit', 0)", "select java_method/**/('java.lang.System','getProperty','user.name')", "select `java_method`('java.lang.System','getProperty','user.name')", "select reflect('java.lang.System','getProperty','user.name')", "select try_reflect('java.lang.System','getProperty','user.name')",
        "select system.builtin.java_method('java.lang.System','getProperty','user.name')", "select id from three where exists (select java_method('java.lang.System','getProperty','user.name'))",
        "select * from text.`/etc/hostname`", "select * from `text`.`/etc/hostname`", "select * from csv.`/etc/passwd`", "select (select first(value) from text.`/etc/hostname`) from three", "select * from three where id in (select 1 from text.`/etc/hostname`)", "with a as (select * from text.`/etc/hostname`) select * from a", "select * from secret", "select * from default.three", "select * from range(5)", "select own_udf(id) from three",
        "select transform(id) using 'cat' from three", "begin select 1; end",
    ):
        with pytest.raises(Exception):
            frontend.safe_sql(spark, bad, {"three"})
    assert frontend.fan_out("select count(a.id) from a join b") and not frontend.fan_out("select count(distinct a.id) from a join b")


def test_evidence():
    q = frontend.parse("How many articles in Ostelby Ledger on 2024-01-02?", PAPERS, [])
    assert frontend.evidence_gaps(q, []) == ["no_evidence"]
    assert frontend.evidence_gaps(q, [{"newspaper": "Ostelby Ledger", "issue_date": "2024-01-02", "count": 4}]) == []
    assert frontend.ungrounded_numbers("There were 4 of 9 [1]", [{"count": 4}]) == ["9"]
    assert frontend.repaired_citations("a [1] [1] b [7]", 2) == "a [1] b "


def test_stream_ingest(spark, tmp_path):
    from quarto.streaming import events as E

    root = "/root/testdata/sf0.001"
    for i in range(2):
        E.ingest(E.event_stream(spark, root), str(tmp_path / "out"), str(tmp_path / f"cp{i}"), "event_type", ["event_id"])
    assert E.ingested(spark, str(tmp_path / "out")).count() == spark.read.parquet(f"{root}/events.parquet").count()


def test_stream_ingest_adds_to_a_key(spark, tmp_path):
    from quarto.streaming import events as E

    src = tmp_path / "in"
    for i, rows in enumerate(([("k", 1), ("k", 2)], [("k", 3), ("k", 2)])):
        spark.createDataFrame(rows, "key string, id long").coalesce(1).write.parquet(str(src / f"{i}"))
    stream = spark.readStream.schema("key string, id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    E.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "key", ["id"])
    assert sorted(r.id for r in E.ingested(spark, str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_late_events_are_dropped(spark, tmp_path):
    from quarto.streaming import events as E

    src = tmp_path / "in"
    for i, ts in enumerate(("2024-01-01 00:10:00", "2024-01-01 06:00:00", "2024-01-01 06:01:00", "2024-01-01 00:20:00", "2024-01-01 05:55:00")):
        spark.sql(f"select timestamp'{ts}' ts, 'a' event_type, 1.0D value, 1L user_id").coalesce(1).write.parquet(str(src / f"{i}"))
        for f in (src / f"{i}").glob("*.parquet"):
            import os

            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, user_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(src))
    got = E.run_to_table(E.tumbling(stream), "update", ["start", "event_type"]).collect()
    assert sorted((r.start.hour, r.events) for r in got) == [(0, 1), (5, 1), (6, 2)]


def test_deleted_issue_leaves_no_orphans(spark):
    from quarto.operators import mutations as M

    ar = Archive(spark, "/root/testdata/sf0.001")
    issue = ar.table("page_layouts").join(ar.issues, F.col("issue_id") == F.col("id")).select("issue_id").orderBy("issue_id").first()[0]
    left = M.delete_issue(ar, issue)
    pages = left["page_layouts"].select("layout_id")
    gone = ar.table("page_layouts").where(F.col("issue_id") == issue).select("layout_id")
    for t in ("article_skeletons", "parsed_items"):
        assert left[t].join(gone, "layout_id").count() == 0 and ar.table(t).join(gone, "layout_id").count() > 0
        assert left[t].join(pages, "layout_id", "left_anti").count() == ar.table(t).distinct().join(ar.table("page_layouts").select("layout_id"), "layout_id", "left_anti").count()


def test_headline_slices_and_drop_caps():
    it = lambda i, label, text, x, y, w=200, h=50: {"item_id": i, "label": label, "text": text, "box": [x, y, x + w, y + h]}
    heads = layout.merge_headlines([it(2, "title", "WALL", 320, 105), it(1, "title", "HARBOUR", 100, 100), it(3, "title", "OTHER", 1200, 100), it(4, "text", "x", 0, 0)])
    assert sorted((h["text"], h["members"]) for h in heads) == [("HARBOUR WALL", [1, 2]), ("OTHER", [3])]
    blocks = layout.consolidate([it(1, "text", "T", 100, 100, 40, 60), it(2, "text", "he first", 150, 105), it(3, "text", "goes on", 150, 170), it(4, "title", "NEW", 100, 240), it(5, "text", "other", 150, 300), it(6, "text", None, 1500, 100)])
    assert sorted(b["text"] for b in blocks) == ["", "The first\ngoes on", "other"]


def test_table_from_words():
    w = lambda t, x, y: {"text": t, "box": [x, y, x + 8 * len(t), y + 12]}
    md, metrics = layout.table_from_words([w("Price", 200, 0), w("Item", 0, 1), w("Fresh", 0, 30), w("cod", 48, 31), w("4.50", 200, 29)])
    assert md == "| Item | Price |\n|---|---|\n| Fresh cod | 4.50 |" and metrics == {"Fresh cod": "4.50"}
    assert layout.table_from_words([]) == ("", {})


def test_nulls_everywhere(spark):
    d = frame(spark, [(None, None)], "a string, b string")
    for c in (text.substantive_tokens(F.col("a")), text.numeric_anchors(F.col("a")), text.repair_ligatures(F.col("a")), text.sanitize_block(F.col("a")), text.is_ad(F.col("a")), text.summary(F.col("a"), F.col("b")), text.is_gibberish(F.col("a")), text.clean_headline(F.col("a"), F.col("b"), F.col("b"))):
        d.select(c.alias("x")).collect()


# filters, evidence, repair


def test_payload_filter(spark):
    import json as j

    rows = [(i, j.dumps(x)) for i, x in enumerate([{"d": "2024-03-05", "n": 3, "s": "a"}, {"d": "2024-12-31", "n": 5}, {"d": "2026-01-01"}, {"d": "5/3/2024", "n": "x"}, {}])] + [(9, None), (10, "no json")]
    df = frame(spark, rows, "i int, p string")
    ids = lambda f: sorted(r.i for r in df.where(enrichment.payload_filter(F.col("p"), f)).collect())
    assert ids({"d": {"gte": "2024-03-01", "lte": "2024-12-31"}}) == [0, 1] and ids({"d": {"gte": "2024-06-01"}}) == [1, 2] and ids({"d": {"gte": "2020-01-01", "lt": "2026-01-01"}}) == [0, 1]
    assert ids({"n": {"gt": 3}}) == [1] and ids({"n": {"gte": 3, "lte": 3}}) == [0] and ids({"s": "a"}) == [0] and len(ids({})) == 7 and ids({"d": {"gte": "2024-03-05", "lte": "2024-03-05"}}) == [0]


def test_category_gate(spark):
    df = frame(spark, [("courts & inquests", "news"), ("farm & weather", "editorial"), ("", None)], "m string, t string")
    ids = lambda w: [r.m for r in df.where(enrichment.category_gate(w, F.col("m"), F.col("t"))).collect()]
    assert ids("Crime/Law") == ["courts & inquests"] and ids("Opinion") == ["farm & weather"] and ids("the farm and field") == ["farm & weather"] and ids("sport") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('<think>{"x": 2}</think>```json\n{"a": [1, 2,], }\n```', {"a": [1, 2]}), ('Here: {"a": {"b": "x}y", "c": "cut o', {"a": {"b": "x}y"}}), ('{"a": 1, "b": [1, 2, {"c": 3', {"a": 1, "b": [1, 2, {"c": 3}]}), ('{"a": "q\\"{", "b', {"a": 'q"{'}), ("no object", None), ("", None), (None, None), ("[1, 2]", None),
    ],
)
def test_repaired_json(text, want):
    import json as j

    got = enrichment.repaired_json(text)
    assert (got and j.loads(got)) == want


def test_bulk_links_keep_what_is_there(spark):
    old, new = frame(spark, [(1, "a", 0.2)], "k int, n string, c double"), frame(spark, [(1, "a", 0.9), (2, "b", 0.4), (2, "b", 0.3), (2, None, 0.1)], "k int, n string, c double")
    assert sorted(map(tuple, enrichment.bulk_links(old, new, ["k", "n"]).collect()), key=str) == [(1, "a", 0.2), (2, "b", 0.3), (2, None, 0.1)]


def test_answers_without_repeats(spark):
    t = "<think>no</think>- one\n- two\nplain\nplain\n- one\n* one"
    assert one(spark, enrichment.without_repeats(F.lit(t))) == "- one\n- two\nplain\nplain\n* one" and one(spark, enrichment.open_fragment(F.lit("A vote for the"))) and not one(spark, enrichment.open_fragment(F.lit("A vote")))


def test_steps_of_a_question(spark):
    papers = ["Ostelby Ledger", "Ostelby Herald"]
    q = frontend.parse("Show the timeline of Harbour Bridge in Ostelby Ledger", papers, [])
    steps = frontend.plan_steps(q)
    assert [s for s, _ in steps] == ["timeline", "list_articles"] and "Harbour" in steps[0][1].words
    ar = Archive(spark, "/root/testdata/sf0.001")
    got = frontend.run_steps(ar, [("roster", q.filters()), ("no such routine", q.filters())])
    assert got[0]["error"] is None and got[0]["rows"][0]["article_id"] == 0 and len(got[0]["rows"]) == 31 and got[1]["error"] and got[1]["rows"] == []
    assert frontend.recovery(q, ["no_evidence"])[0] == ("entity_search", filters.Filters(words=("Harbour Bridge",))) and frontend.recovery(q, []) == [] and frontend.recovery(q, ["no_quantity"])[0][0] == "statistics"
    assert [frontend.next_stage("evaluate", ["x"], n) for n in (0, 1)] == ["recover", "answer"] and frontend.next_stage("run", [], 0) == "evaluate"
    assert frontend.evidence_label({"articles": 3}) == "quantity" and frontend.evidence_label({"article_id": 0}) == "structure" and frontend.evidence_label({"headline": "x"}) == "text"
    b = frontend.Budget()
    b.charge(0.4)
    with pytest.raises(RuntimeError):
        b.charge(0.2)
    for routine in ("visuals", "timeline", "entity_graph"):
        frontend.run(ar, routine, q.filters()).collect()


def test_domains():
    from quarto.plans.domains import domain_of

    assert domain_of("Which court verdicts were reported?") == "Crime & Law" and domain_of("compare business and cricket news") is None and domain_of("top stories about cricket") is None and domain_of("hello") is None


def test_hooks(spark):
    from quarto.operators import hooks as H

    ar = Archive(spark, "/root/testdata/sf0.001")
    fake = lambda texts: [[float(len(t)), 1.0] for t in texts]
    rows = frame(spark, [(i, "x" * i) for i in range(150)] + [(200, None)], "id long, text string")
    got = {r.id: r.vector for r in H.embedded(rows, "id", "text", fake).collect()}
    assert len(got) == 149 and got[7] == [7.0, 1.0]
    issue = ar.articles.select("issue_id").join(ar.issues.select(F.col("id").alias("issue_id")), "issue_id").first()[0]
    assert 0 < H.reembedded(ar, fake, issue).count() == H.reembedded(ar, fake, issue, dry_run=True).count() < H.reembedded(ar, fake, dry_run=True).count()
    assert {k: d.count() for k, d in H.by_dimension(frame(spark, [([1.0],), ([1.0, 2.0],), (None,)], "vector array<float>"), {1: "a", 2: "b"}).items()} == {"a": 1, "b": 1}
    pairs = frame(spark, [("q", 1, "a", "b"), ("q", 2, "a", "ccc")], "query_id string, article_id long, query string, text string")
    assert {r.article_id: round(r.score, 3) for r in H.cross_reranked(pairs, lambda q, t: [len(x) / 2 for x in t]).collect()} == {1: 0.5, 2: 0.818}
    answers = frame(spark, [("k", "The harbour council approved it.", "the harbour council approved a budget")], "key string, answer string, context string")
    assert H.judged(answers).first().faithfulness == H.judged(answers, lambda a: 1 / 0).first().faithfulness == 1.0
    now = [0.0]
    b = H.Breaker(lambda: now[0])
    b.trip(5, "down")
    assert b.open and b.reason == "down"
    now[0] = 6
    assert not b.open
