"""Domains of questions and evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarto.functions.text import any_of
from quarto.sources.archive import SQL, Archive

# Pattern of a question and word stems of evidence, by domain.
DOMAINS: dict[str, tuple[str, list[str]]] = {
    "Economics & Finance": (r"\b(econom(?:y|ic|ics)?|financ(?:e|ial)?|business|markets?|trade|tax(?:es|ation)?|budget|fiscal|monetary|bank(?:s|ing)?|corporate|revenue|gdp|stocks?|shares?)\b", ["econom", "financ", "business", "market", "trade", "tax", "solar", "power", "seabed", "fund", "money", "bank", "stock", "rupee", "dollar", "gdp", "rbi", "corp", "profit"]),
    "Health & Medicine": (
        r"\b(health|hospitals?|pharma(?:ceutical)?|medicines?|vaccines?|diseases?|doctors?)\b",
        ["health", "hospital", "pharma", "medicine", "doctor", "patient", "disease", "vaccin", "virus", "treatment", "care", "clinic", "surgery", "drug", "medical", "heart", "infect", "liver", "blood", "cancer", "illness", "symptom", "organ", "diet", "nutrition", "wellness", "therapy"],
    ),
    "Sports": (r"\b(sports?|cricket|football|tennis|olympics?|tournaments?|match(?:es)?|boxing)\b", ["sport", "cricket", "football", "tennis", "olympic", "tournament", "match", "boxing", "player", "game"]),
    "Politics & Governance": (r"\b(politic(?:s|al)?|elections?|parliament|assembly|ministers?|cabinet|governance|policy|bills?)\b", ["politic", "election", "parliament", "assembly", "minister", "cabinet", "governance", "policy", "bill", "party", "vote"]),
    "Crime & Law": (r"\b(crimes?|courts?|legal|law|police|arrest(?:s|ed)?|investigations?|verdicts?|bail)\b", ["crime", "court", "legal", "law", "police", "arrest", "investigation", "verdict", "bail", "judge", "jail"]),
    "Technology & AI": (r"\b(tech|technology|ai|artificial\s+intelligence|cyber|software)\b", ["tech", "technology", "ai", "artificial intelligence", "cyber", "software", "digital", "chip"]),
    "World & Geopolitics": (
        r"\b(geopolitic(?:s|al)?|international|global(?:\s+south)?|brics|multipolar(?:ity)?|bipolar(?:ity)?|foreign\s+policy|diplomacy|diplomatic|treaty|\bun\b|united\s+nations|g7|g20|summit)\b",
        ["geopolitic", "international", "global", "brics", "multipolar", "bipolar", "foreign policy", "diplomacy", "diplomatic", "treaty", "united nations", "g7", "g20", "summit", "world", "bilateral", "sanctions"],
    ),
    "Science & Environment": (
        r"\b(science|environment(?:al)?|climate\s+change|emissions?|biodiversity|isro|nasa|space|satellites?|astronomy|ecology|wildlife|pollution)\b",
        ["science", "environment", "climate", "emission", "biodiversity", "isro", "nasa", "space", "satellite", "lunar", "solar", "orbit", "ecology", "wildlife", "forest", "pollution", "warming"],
    ),
    "Entertainment": (r"\b(entertainment|cinema|movies?|films?|bollywood|hollywood|box\s+office|theatre|music|concerts?|celebrity|ott)\b", ["entertainment", "cinema", "movie", "film", "bollywood", "hollywood", "box office", "actor", "director", "music", "concert", "ott", "series"]),
    "Opinion/Editorial": (r"\b(opinion|editorials?|op-ed|columns?|columnists?|commentary|viewpoints?|letters\s+to\s+the\s+editor)\b", ["opinion", "editorial", "op-ed", "column", "commentary", "viewpoint", "perspective", "our view", "my view"]),
}
# Fixed value: questions about a whole issue or page, which have no domain.
OVERVIEW = r"\b(?:all\s+(?:stories|articles|news|sections)|top\s+(?:stories|news|headlines)|main\s+(?:stories|news|headlines)|summarize\s+(?:the\s+)?(?:issue|edition|newspaper|front\s+page|page)|what\s+is\s+on\s+(?:the\s+)?(?:front\s+page|page\s+\d+))\b"


def domain_of(text: str) -> str | None:
    """The one domain that a question names; none for an overview, or where several are named."""
    low = text.lower()
    hit = [d for d, (pattern, _) in DOMAINS.items() if re.search(pattern, low)]
    return hit[0] if len(hit) == 1 and not re.search(OVERVIEW, low) else None


def domain_score(domain: str, headline: Column, text: Column, counted: Column, unwanted: list[str] | None = None) -> Column:
    """100 for counted evidence, -50 for a headline with an unwanted word, 50 if a stem of the domain stands in it, else 0."""
    h = F.lower(F.coalesce(headline, F.lit("")))
    both = F.concat_ws(" ", h, F.lower(F.coalesce(text, F.lit(""))))
    out = F.when(counted, 100)
    if unwanted:
        out = out.when(any_of([h.contains(w) for w in unwanted]), -50)
    return out.when(any_of([both.contains(s) for s in DOMAINS[domain][1]]), 50).otherwise(0)


def article_scores(spark, root: str):
    a = Archive(spark, root).articles
    return a.select(F.col("id").alias("article_id"), *[domain_score(d, F.col("headline"), F.col("full_text"), F.lit(False)).alias(n) for n, d in (("law", "Crime & Law"), ("world", "World & Geopolitics"))])


_hit = lambda d: "case when " + " or ".join(f"contains(lower(coalesce(headline, '')) || ' ' || lower(coalesce(full_text, '')), '{s}')" for s in DOMAINS[d][1]) + " then 50 else 0 end"
QUERIES = {"t25_domain_scores": article_scores}
ORACLE = {"t25_domain_scores": SQL + f"select article_id, {_hit('Crime & Law')} law, {_hit('World & Geopolitics')} world from a_"}
