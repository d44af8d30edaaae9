"""Query front end: a question becomes a typed spec, the spec a plan; read-only SQL is checked before it runs."""

from __future__ import annotations

import calendar
import re
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

from quarto.operators import analytics as A
from quarto.operators import enrichment as V
from quarto.operators import stories as S
from quarto.plans.filters import Filters, iso, page_numbers
from quarto.sources.archive import Archive

MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}
# Words that tell shared and differing coverage, pictures, and computations.
SHARED = ("similar", "shared", "common", "same article", "same stor", "both newspaper", "both paper", "in both", "covered by both", "both carried", "syndicated", "wire stor", "wire report")
DIFFERENT = ("but not in", "not in", "absent", "exclusive", "omitted", "missing from")
VISUAL = r"\b(?:infographic|chart|diagram|graph|photograph|photo|picture|image)s?\b"
STATISTICS = r"\b(?:mean|median|average|correlat\w*|regression|variance|std|standard deviation|percentile|quantile|histogram|moving average|pearson|spearman|gini|distribution|ratio)\b"
COUNT = r"\b(?:how many|count|number of|total|volume of)\b"


# Words of a question that name no content.
QUESTION_WORDS = frozenset("what which who when where how many much does did do is are was were the a an of in on at for to and or from by with about show list give tell me timeline history evolution network graph related connected photos photo pictures picture images image charts chart articles article stories story newspaper newspapers paper papers page pages issue issues".split())


def content_words(text: str, papers: list[str]) -> list[str]:
    """Words of a question that name content: longer ones without dates, question words and names of papers, in order."""
    bare = re.sub("|".join(re.escape(p) for p in papers) or r"(?!)", " ", text, flags=re.I)
    return list(dict.fromkeys(w for w in re.findall(r"[^\W\d_]{3,}", bare) if w.lower() not in QUESTION_WORDS and w.lower() not in MONTHS))


@dataclass
class QuerySpec:
    """Q1: what a question names."""

    text: str
    papers: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None
    issue_id: int | None = None
    section: str | None = None
    headline: str | None = None
    pages: list[int] = field(default_factory=list)
    differential: bool = False
    shared: bool = False

    def filters(self) -> Filters:
        return Filters(newspaper=self.papers[0] if self.papers else None, issue_date=self.dates[0] if len(self.dates) == 1 else None, date_from=self.date_from, date_to=self.date_to, section=self.section, page=self.pages[0] if len(self.pages) == 1 else None, words=tuple(content_words(self.text, self.papers)))


def parse(text: str, papers: list[str], sections: list[str], year: int | None = None) -> QuerySpec:
    """Papers in the order of the text, dates, month ranges, issue, section, quoted headline, pages, flags.

    A month without a year means ``year``, and nothing without it.
    """
    q = QuerySpec(text)
    low = text.lower()
    at = []
    for p in papers:
        bare = re.sub(r"(?i)^the\s+", "", p)
        at += [(m.start(), p) for m in re.finditer(rf"(?<!\w){re.escape(bare.lower())}(?!\w)", low)]
    q.papers = list(dict.fromkeys(p for _, p in sorted(at)))
    found = [(m.start(), iso(m[0].replace("/", "-"))) for m in re.finditer(r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b", text)]
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    for m in re.finditer(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({names})\b,?\s+(\d{{4}})\b", low):
        found.append((m.start(), f"{m[3]}-{MONTHS[m[2]]:02d}-{int(m[1]):02d}"))
    for m in re.finditer(rf"\b({names})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", low):
        found.append((m.start(), f"{m[3]}-{MONTHS[m[1]]:02d}-{int(m[2]):02d}"))
    q.dates = list(dict.fromkeys(d for _, d in sorted(found)))
    if len(q.dates) > 1:
        q.date_from, q.date_to = min(q.dates), max(q.dates)
    if not q.dates:
        m = re.search(rf"\b({names})\s+(\d{{4}})\b", low)
        bare = re.search(r"\b(?:in|during|for|from|of|throughout|across|since|until)\s+(may)\b|\b(" + "|".join(n.lower() for n in calendar.month_name if n and n != "May") + r")\b", low)
        pair = (MONTHS[m[1]], int(m[2])) if m else (MONTHS[bare[1] or bare[2]], year) if bare and year else None
        if pair:
            q.date_from = f"{pair[1]:04d}-{pair[0]:02d}-01"
            q.date_to = f"{pair[1]:04d}-{pair[0]:02d}-{calendar.monthrange(pair[1], pair[0])[1]:02d}"
    if m := re.search(r"(?i)\bissue\s*(?:id\s*[:=]?\s*|#\s*|no\.?\s*|number\s*)?(\d+)\b", text):
        q.issue_id = int(m[1])
    q.section = next((s for s in sections if s.lower() in low), None)
    if m := re.search("[\"“]([^\"”]{8,150})[\"”]", text):
        q.headline = m[1].strip()
    for m in re.finditer(r"(?i)\bpages?\s+((?:\d{1,3})(?:\s*(?:,|and|&|to|-|–)\s*\d{1,3})*)", text):
        n = page_numbers(m[1])
        q.pages += list(range(n[0], n[-1] + 1)) if re.search(r"to|-|–", m[1]) and len(n) == 2 else n
    q.shared = any(w in low for w in SHARED)
    q.differential = len(q.papers) > 0 and any(w in low for w in DIFFERENT)
    return q


def archive_wide(text: str) -> bool:
    """Q2: whether a question is about the papers of the whole archive."""
    return bool(re.search(r"(?i)\b(?:all|which|list|every)\b.*\b(?:newspapers?|papers?|publications?)\b", text))


def decide(q: QuerySpec) -> tuple[str, str]:
    """Q3, Q13: (routine, archetype) by the first rule that holds."""
    low = q.text.lower()
    two = len(q.papers) >= 2
    rules = [
        (re.fullmatch(r"(?:hi|hello|hey|thanks?|thank you|good (?:morning|evening))[\s!.]*", low), "none", "conversation"),
        (re.search(STATISTICS, low), "statistics", "analytical_computation"),
        (re.search(VISUAL, low) and re.search(COUNT, low), "visual_counts", "quantitative"),
        (re.search(VISUAL, low), "visuals", "factual_lookup"),
        (q.differential and two, "coverage_difference", "comparison"),
        (q.shared and two, "shared_coverage", "comparison"),
        (re.search(r"\b(?:available|availability|do you have)\b", low), "availability", "quantitative"),
        (re.search(r"\b(?:timeline|chronolog\w*|evolution|trajectory|history of)\b", low), "timeline", "timeline"),
        (re.search(r"\b(?:co-?occur\w*|connected|related to|graph of|network)\b", low), "entity_graph", "entity"),
        (re.search(r"\b(?:ads?|advertisements?)\b", low) and re.search(COUNT, low), "count_ads", "quantitative"),
        (re.search(COUNT, low) and re.search(r"\b(?:issues?|editions?|newspapers?|papers?)\b", low) and not re.search(r"\b(?:articles?|stories)\b", low), "count_issues", "quantitative"),
        (archive_wide(q.text), "count_issues", "quantitative"),
        (re.search(COUNT, low), "count_articles", "quantitative"),
        (re.search(r"\b(?:first|1st|lead|top)\s+(?:news|story|article)\b", low), "page_leads", "ordinal"),
        (re.search(r"\b(?:list|manifest|contents|articles in|stories in)\b", low), "issue_manifest", "listing"),
    ]
    return next(((r, a) for ok, r, a in rules if ok), ("search", "factual_lookup"))


#: Q6: routine name to plan; aliases follow.
ROUTINES = {
    "availability": lambda ar, f: A.availability(ar), "count_articles": A.count_articles, "list_articles": A.list_articles, "count_ads": A.count_ads, "count_issues": A.count_issues, "issue_manifest": A.issue_manifest, "visual_counts": lambda ar, f: A.visual_counts(ar),
    "page_leads": lambda ar, f: A.page_leads(ar), "statistics": lambda ar, f: A.section_word_stats(ar), "topic_distribution": lambda ar, f: A.topic_distribution(ar, f.newspaper_id), "front_page_ratio": lambda ar, f: A.front_page_ratio(ar, f.newspaper_id),
    "shared_coverage": lambda ar, f: S.shared_stories(ar), "coverage_difference": lambda ar, f: S.exclusive_stories(ar), "roster": lambda ar, f: A.newspaper_roster(ar),
    "visuals": lambda ar, f: V.visual_assets(ar, f.words or ["the"]), "timeline": lambda ar, f: S.timeline(ar, list(f.words)), "entity_graph": lambda ar, f: S.entity_graph(ar, f.words[0] if f.words else ""), "entity_search": lambda ar, f: S.entity_search(ar, list(f.words)),
}
ALIASES = {"issue_summary": "issue_manifest", "issue_articles": "issue_manifest", "shared_articles": "shared_coverage", "coverage_diff": "coverage_difference", "section_distribution": "topic_distribution", "frontpage_ratio": "front_page_ratio", "search": "list_articles", "volume": "count_issues"}


def run(ar: Archive, routine: str, f: Filters) -> DataFrame:
    """Q6, Q7: the routine's plan; a section filter without a hit is dropped."""
    plan = ROUTINES[ALIASES.get(routine, routine)]
    out = plan(ar, f)
    if f.section and routine in ("list_articles", "search"):
        return S.relaxed(out, plan(ar, Filters(**{**f.__dict__, "section": None})))
    return out


def dedupe_calls(calls: list[tuple[str, Filters]]) -> list[tuple[str, Filters]]:
    """Q5: plan steps, each once, the first place kept; unknown routines are dropped."""
    return list(dict.fromkeys((ALIASES.get(r, r), f) for r, f in calls if ALIASES.get(r, r) in ROUTINES))


class UnsafeSQL(ValueError):
    pass


#: Plan nodes of which a read-only query may consist, as parsed; anything else, commands first, is refused.
READ_NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith CTERelationDef WithCTE Union Intersect Except"
    " Window WithWindowDefinition UnresolvedHaving OneRowRelation UnresolvedInlineTable ResolvedInlineTable LocalRelation Generate Pivot Unpivot Sample".split()
)
#: Expressions that leave the engine, by class name as analysed.
OUTSIDE = re.compile(r"Reflect|CallMethod|Invoke$|UDF|UDTF|UDAF|ScriptInput|InputFile|PythonFunction|ScalaAggregator|Hive")


def _walk(spark: SparkSession, plan):
    """(node, class name, is a plan) of every plan node and expression, those of subqueries and common table expressions included."""
    todo, each = [plan], lambda seq: (seq.apply(i) for i in range(seq.size()))
    kind = lambda node, name: is_instance_of(spark.sparkContext._gateway, node, f"org.apache.spark.sql.catalyst.{name}")
    while todo:
        node = todo.pop()
        is_plan = kind(node, "plans.logical.LogicalPlan")
        yield node, node.getClass().getSimpleName(), is_plan
        todo += each(node.children())
        todo += each(node.innerChildren())
        if is_plan:
            todo += each(node.expressions())
        elif kind(node, "expressions.PlanExpression"):
            todo.append(node.plan())


def safe_sql(spark: SparkSession, text: str, tables: set[str]) -> DataFrame:
    """Q12: a DataFrame of one read-only statement over the named temporary views, checked on the parsed and on the analysed plan.

    Of plan nodes only READ_NODES may occur, so commands, writes, DDL, scripts
    and table functions are refused. A relation has one part and is one of
    ``tables`` or a common table expression, so no path, catalog or other view
    can be read. Functions that call into the JVM or Python are refused as
    analysed, whatever the spelling. Unknown columns fail in analysis.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    own, used = {t.lower() for t in tables}, set()
    for node, name, is_plan in _walk(spark, plan):
        if is_plan and name not in READ_NODES:
            raise UnsafeSQL(f"not a read-only query: {name}")
        if name == "UnresolvedWith":
            ctes = node.cteRelations()
            own |= {str(ctes.apply(i)._1()).lower() for i in range(ctes.size())}
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            used.add(".".join(str(parts.apply(i)) for i in range(parts.size())).lower() if parts.size() == 1 else f"`{parts.mkString('.')}`")
        if name == "UnresolvedFunction" and node.nameParts().size() > 1:
            raise UnsafeSQL(f"function {node.nameParts().mkString('.')}")
    if used - own:
        raise UnsafeSQL(f"relations that are not on the list: {', '.join(sorted(used - own))}")
    df = spark.sql(text)
    for _, name, is_plan in _walk(spark, df._jdf.queryExecution().analyzed()):
        if not is_plan and OUTSIDE.search(name):
            raise UnsafeSQL(f"expression {name}")
    return df


def fan_out(text: str) -> bool:
    """Q12: whether a query counts rows of a join without DISTINCT, which counts some twice."""
    return bool(re.search(r"(?i)\bjoin\b", text) and re.search(r"(?i)\bcount\s*\(\s*(?!distinct)[\w.]*id\s*\)", text))


def evidence_gaps(q: QuerySpec, evidence: list[dict]) -> list[str]:
    """What the evidence lacks for a question, in the order of the ladder."""
    gaps = []
    if not evidence:
        return ["no_evidence"]
    have = {str(e.get("newspaper", "")).lower() for e in evidence}
    if any(not any(p.lower() in h or (h and h in p.lower()) for h in have) for p in q.papers):
        gaps.append("missing_publication")
    if q.dates and not any(str(e.get("issue_date")) in q.dates for e in evidence):
        gaps.append("wrong_date")
    if q.pages and not any(e.get("page") in q.pages for e in evidence if e.get("page") is not None):
        gaps.append("wrong_page")
    if re.search(COUNT, q.text.lower()) and not any(isinstance(e.get("count"), int) for e in evidence):
        gaps.append("no_quantity")
    if q.headline and not any(q.headline.lower() in str(e.get("headline", "")).lower() for e in evidence):
        gaps.append("headline_not_found")
    return gaps


def ungrounded_numbers(answer: str, evidence: list[dict]) -> list[str]:
    """Q9, Q18: numbers of an answer that no evidence row holds."""
    known = set(re.findall(r"\d+(?:\.\d+)?", " ".join(str(v) for e in evidence for v in e.values())))
    return [n for n in dict.fromkeys(re.findall(r"\d+(?:\.\d+)?", re.sub(r"\[\d+\]", "", answer))) if n not in known]


def repaired_citations(answer: str, n: int) -> str:
    """Q10: citations beyond the ``n`` evidence rows are dropped, repeated ones in a row count once."""
    out = re.sub(r"\[(\d+)\]", lambda m: m[0] if 1 <= int(m[1]) <= n else "", answer)
    return re.sub(r"(\[\d+\])(?:\s*\1)+", r"\1", out)


def follow_up(text: str, before: QuerySpec | None, papers: list[str], sections: list[str]) -> QuerySpec:
    """Q11: a question that leaves paper or date open after another takes them over."""
    q = parse(text, papers, sections)
    if before and (len(text.split()) <= 6 or re.search(r"(?i)\b(?:that|those|it|they|same|also|there)\b", text)):
        q.papers = q.papers or before.papers
        if not q.dates and not q.date_from:
            q.dates, q.date_from, q.date_to = before.dates, before.date_from, before.date_to
    return q


def plan_steps(q: QuerySpec) -> list[tuple[str, Filters]]:
    """Q4, Q5: the routines that a question takes, best first: the one decided on, what its form asks besides, and a search where nothing is counted."""
    first, _ = decide(q)
    steps = [] if first == "none" else [(first, q.filters())]
    low = q.text.lower()
    if len(q.papers) >= 2 and first not in ("coverage_difference", "shared_coverage"):
        steps.append(("shared_coverage", q.filters()))
    if re.search(r"\b(?:first|lead|top|front)\b", low):
        steps.append(("page_leads", q.filters()))
    if q.dates and first not in ("issue_manifest", "availability"):
        steps.append(("issue_manifest", q.filters()))
    if first != "none" and not re.search(COUNT, low):
        steps.append(("search", q.filters()))
    return dedupe_calls(steps)


def run_steps(ar: Archive, steps: list[tuple[str, Filters]], workers: int = 4) -> list[dict]:
    """Q16: the evidence of every step, run side by side: routine, rows (``evidence_rows``, a bounded number), seconds, error; a step that fails leaves the others alone."""

    def one(step: tuple[str, Filters]) -> dict:
        began, out = time.monotonic(), {"routine": step[0], "rows": [], "error": None}
        try:
            out["rows"] = [r.asDict() for r in V.evidence_rows(step[0], run(ar, *step)).collect()]
        except Exception as e:  # noqa: BLE001 - the failure is the result
            out["error"] = f"{type(e).__name__}: {str(e)[:200]}"
        return out | {"seconds": round(time.monotonic() - began, 3)}

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, steps))


def evidence_label(row: dict) -> str:
    """Q19: ``quantity`` for a row that counts, ``structure`` for a summary or manifest, else ``text``."""
    if any(isinstance(v, (int, float)) and not isinstance(v, bool) and re.search(r"count|articles|issues|total|number|ratio|^n_", k) for k, v in row.items()):
        return "quantity"
    return "structure" if row.get("article_id") == 0 or row.get("routine") in ("issue_manifest", "page_leads", "availability") else "text"


def recovery(q: QuerySpec, gaps: list[str]) -> list[tuple[str, Filters]]:
    """Q20: what to run where evidence is lacking: the statistics for a missing quantity, else a search for the first capitalised name, else a wider search."""
    if not gaps:
        return []
    if "no_quantity" in gaps:
        return [("statistics", q.filters())]
    bare = re.sub("|".join(re.escape(p) for p in q.papers) or r"(?!)", " ", q.text, flags=re.I)
    names = [m for m in re.findall(r"(?<!^)\b[A-Z][\w'’-]+(?:\s+[A-Z][\w'’-]+)*", bare) if m.lower() not in MONTHS]
    if names:
        return [("entity_search", Filters(words=(names[0],)))]
    return [("search", Filters(newspaper=q.papers[0] if q.papers else None))]


def next_stage(stage: str, gaps: list[str], cycles: int) -> str:
    """Q21: the stage that follows: evidence that lacks something is recovered once, then the answer is written whatever it holds."""
    after = {"parse": "plan", "plan": "run", "run": "evaluate", "recover": "evaluate", "answer": "done"}
    return after.get(stage) or ("recover" if gaps and cycles < 1 else "answer")


@dataclass
class Budget:
    """Q22: what a query may cost, and how many words its answer may have."""

    most: float = 0.50
    spent: float = 0.0

    def charge(self, cost: float) -> None:
        if self.spent + cost > self.most:
            raise RuntimeError(f"budget of {self.most} exceeded")
        self.spent += cost

    @staticmethod
    def answer_words(rows: int, archetype: str) -> int:
        return min(1200, {"quantitative": 120, "conversation": 60}.get(archetype, 250) + 25 * rows)


QUESTIONS = [
    "How many articles did Ostelby Ledger publish between 2024-01-01 and 2024-12-31 on page 15?",
    "What stories in Ostelby Ledger are shared with Ostelby Herald on 15 February 2024?",
    "Which stories of Brackmoor Argus are not in Fellgate Dispatch?",
    "List the articles in Quernford Gazette in March 2024, pages 2 to 4",
    "Give me the median word count per section",
]


def parsed_questions(spark: SparkSession, root: str) -> DataFrame:
    ar = Archive(spark, root)
    papers = [r[0] for r in ar.newspapers.select("name").orderBy("id").collect()]
    sections = [r[0] for r in ar.table("section_list").select("section_name").orderBy("section_id").collect()]
    rows = []
    for i, t in enumerate(QUESTIONS):
        q = parse(t, papers, sections)
        rows.append((i, *decide(q), ", ".join(q.papers), ", ".join(q.dates), q.date_from, q.date_to, ", ".join(map(str, q.pages))))
    return spark.createDataFrame(rows, "question int, routine string, archetype string, papers string, dates string, date_from string, date_to string, pages string")


def answered(spark: SparkSession, root: str) -> DataFrame:
    """The first question from its text to its rows."""
    ar = Archive(spark, root)
    papers = [r[0] for r in ar.newspapers.select("name").orderBy("id").collect()]
    q = parse(QUESTIONS[0], papers, [])
    return run(ar, decide(q)[0], q.filters())


def sandboxed(spark: SparkSession, root: str) -> DataFrame:
    Archive(spark, root).articles.createOrReplaceTempView("archive_articles")
    return safe_sql(spark, "select article_type, count(distinct id) as articles from archive_articles group by article_type", {"archive_articles"})


QUERIES = {"q01_parsed_questions": parsed_questions, "q06_answered": answered, "q12_safe_sql": sandboxed}
ORACLE = {
    "q06_answered": A.SQL + "select count(distinct article_id) articles from stories where newspaper ilike '%ostelby ledger%' and issue_date between date '2024-01-01' and date '2024-12-31' and article_id in (select article_id from story_pages where page_number = 15)",
    "q12_safe_sql": "select article_type, count(distinct id) articles from articles group by 1",
}
