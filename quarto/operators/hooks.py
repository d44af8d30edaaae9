"""Batch hooks for models that are not part of the library: embedding, cross-encoder scores, a judge, and the guard before a failing service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarto.operators import retrieval
from quarto.sources.archive import Archive

#: Texts that a model gets at once.
BATCH = 64


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, vector) of each row with text, BATCH texts per call of ``embed`` in the workers; null and blank texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for at in range(0, len(texts), BATCH):
                out += embed(texts[at : at + BATCH])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(float, v)) for v in out], pa.list_(pa.float32()))], names=[key, "vector"])

    some = rows.where(F.trim(text) != "").select(key, text)
    return some.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vector array<float>")


def reembedded(ar: Archive, embed: Callable[[list[str]], list[list[float]]], issue_id: int | None = None, dry_run: bool = False) -> DataFrame:
    """(id, vector) of all chunks, or of one issue's; a dry run gives (id) of those that would be embedded."""
    chunks = ar.chunks
    if issue_id is not None:
        chunks = chunks.join(ar.articles.where(F.col("issue_id") == issue_id).select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return chunks.where(F.trim("text") != "").select("id") if dry_run else embedded(chunks, "id", "text", embed)


def by_dimension(points: DataFrame, sizes: dict[int, str]) -> dict[str, DataFrame]:
    """The points of each index, told by the length of their vector; other lengths go to none."""
    return {name: points.where(F.size("vector") == n) for n, name in sizes.items()}


def unit_score(score: Column) -> Column:
    """A score between 0 and 1 as it is, another one through the logistic function, cut at 20 either way."""
    return F.when(score.between(0.0, 1.0), score).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), score)))))


def cross_reranked(pairs: DataFrame, score: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """(query_id, article_id, score) of (query_id, article_id, query, text) by a model that reads both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, t = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = [float(x) for at in range(0, len(q), BATCH) for x in score(q[at : at + BATCH], t[at : at + BATCH])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["query_id", "article_id", "raw"])

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "article_id")}
    scored = pairs.select("query_id", "article_id", "query", "text").mapInArrow(run, f"query_id {kinds['query_id']}, article_id {kinds['article_id']}, raw double")
    return scored.select("query_id", "article_id", unit_score(F.col("raw")).alias("score"))


def judged(answers: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, faithfulness) by a judge, or by the words of the context (E6) where there is none or it fails."""
    if judge:
        try:
            return judge(answers).select("key", "faithfulness")
        except Exception:  # noqa: BLE001 - the fallback is the rule
            pass
    return retrieval.faithfulness(answers)


class Breaker:
    """§2.15: keeps calls from a failing service for a while after it was tripped."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.until, self.reason = clock, 0.0, ""

    def trip(self, seconds: float, reason: str) -> None:
        self.until, self.reason = self.clock() + seconds, reason

    def reset(self) -> None:
        self.until, self.reason = 0.0, ""

    @property
    def open(self) -> bool:
        return self.clock() < self.until


def live_first(stream: DataFrame, key: str, time_column: str, ttl: str = "1 hour") -> DataFrame:
    """§2.15: of each key the first row within ``ttl``, as a cache that expires; state older than that is dropped."""
    return stream.withWatermark(time_column, ttl).dropDuplicatesWithinWatermark([key])
