"""Lines repeated across the documents of one source.

A line's unit is (source, normal form); its document frequency is counted over
all documents. The unit's line, with numbers, dates and names masked, becomes a
set of shingles of five words. Within a source, units of the same set are
linked at once; sets that share a band of their minhash signature and whose
Jaccard similarity is 0.8 are linked, all of a band that agree. The components
are clusters of near-duplicate lines, whose document frequency is the number of
different documents that hold any of their lines. Clusters at or above the
limit are repeated lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.llm.textcodes import DATE_WORDS, DIGIT, LETTER, MARK, codes_of, kind_table
from quarto.plans.graph import connected_components
from quarto.session import written
from quarto.sources.tables import read_table

MIN_DOCS, MIN_CHARS, SHINGLE = 5, 20, 5
BANDS, ROWS, JACCARD = 8, 2, 0.8  # a pair of Jaccard 0.8 shares a band with probability 0.9997
#: Different sets of one bucket, or of two of its blocks, that one task compares.
TASK_SETS = 20_000
_EDGE = " .,;:!?*-_|"
_SPACE = r"[\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"  # all but the line feed, at which lines are split


def normal_forms(text: Column) -> Column:
    """The lines of a text in lower case, digit runs as ``0``, white space as one blank; edges stay."""
    c = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    return F.split(F.regexp_replace(c, _SPACE, " "), "\n", -1)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case code, is upper case, is lower case) of every code point."""
    n = 0x110000
    lower, up, low = np.arange(n, dtype=np.uint32), np.zeros(n, bool), np.zeros(n, bool)
    for cp in range(0x1F000):
        c = chr(cp)
        up[cp], low[cp] = c.isupper(), c.islower()
        if up[cp] and len(c.lower()) == 1:
            lower[cp] = ord(c.lower())
    return lower, up, low


_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(256)], np.uint64)
_MIX = np.array([pow(0xD6E8FEB86659FD93, i + 3, 1 << 64) | 1 for i in range(BANDS * ROWS)], np.uint64)
_NUMBER_WORD, _NAME_WORD = np.uint64(0x30), np.uint64(0x4E)


def _word_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = np.minimum(np.arange(len(codes)) - np.repeat(starts, lengths), 255)
    return np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * _POWERS[at], starts)


def _plain_hash(word: str) -> int:
    return sum((ord(c) + 1) * int(_POWERS[i]) for i, c in enumerate(word)) % (1 << 64)


def line_shingles(lines: list[str]) -> pa.ListArray:
    """Shingles of SHINGLE words of each line, as hashes of 32 bits, sorted and each once; a shorter line is one, a line without words has none.

    Words with a digit, and month or weekday names beside one, are masked as
    number, words with a capital and a small letter that do not start the line
    as name.
    """
    n = len(lines)
    lower, up, low = _tables()
    raw = codes_of("\0".join(lines) + "\0")
    ends = np.flatnonzero(raw == 0)
    kinds = kind_table()[raw]
    inside = (kinds == LETTER) | (kinds == MARK) | (kinds == DIGIT)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return pa.array([[]] * n, pa.list_(pa.int32()))
    line = np.searchsorted(ends, starts)
    lengths = stops - starts
    text = lower[raw][inside]
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = _word_hashes(text, firsts, lengths)
    some = lambda m: np.add.reduceat(m[inside].astype(np.int64), firsts) > 0
    number = some(kinds == DIGIT)
    month = np.isin(h, _DATE_HASHES)
    beside = np.zeros(len(h), bool)
    beside[1:] |= number[:-1] & (line[1:] == line[:-1])
    beside[:-1] |= number[1:] & (line[1:] == line[:-1])
    opens = np.concatenate([[True], line[1:] != line[:-1]])
    name = up[raw][inside][firsts] & some(low[raw]) & ~opens
    h = np.where(number | (month & beside), _NUMBER_WORD, np.where(name, _NAME_WORD, h))
    # shingles
    has, first, count = np.unique(line, return_index=True, return_counts=True)
    per = np.maximum(1, count - SHINGLE + 1)
    begin = np.concatenate([[0], np.cumsum(per)[:-1]])
    at = np.repeat(first - begin, per) + np.arange(per.sum())
    last = np.repeat(first + count, per)
    sh = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        k = np.minimum(at + j, len(h) - 1)
        sh += np.where(at + j < last, (h[k] + np.uint64(1)) * _POWERS[j + 7], np.uint64(0))
    sh ^= sh >> np.uint64(31)
    short = (sh * _POWERS[3]) >> np.uint64(32)
    each = np.unique((np.repeat(has, per).astype(np.uint64) << np.uint64(32)) | short)
    offsets = np.searchsorted(each >> np.uint64(32), np.arange(n + 1, dtype=np.uint64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((each & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))


def set_keys(shingles: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices of the sets that are not empty, hash of each whole set, band keys of each)."""
    sizes = shingles.value_lengths().to_numpy()
    has = np.flatnonzero(sizes)
    flat = shingles.flatten().to_numpy().view(np.uint32).astype(np.uint64)
    begin = (np.cumsum(sizes) - sizes)[has]
    if not len(has):
        return has, np.empty(0, np.int64), np.empty((0, BANDS), np.int64)
    minima = np.empty((len(has), BANDS * ROWS), np.uint64)
    mixed = (flat + np.uint64(1)) * _POWERS[0]
    mixed ^= mixed >> np.uint64(32)
    for j in range(BANDS * ROWS):
        v = mixed * _MIX[j]
        minima[:, j] = np.minimum.reduceat(v ^ (v >> np.uint64(29)), begin)
    keys = minima[:, ::ROWS].copy()
    for r in range(1, ROWS):
        keys = keys * _POWERS[0] + minima[:, r::ROWS]
    v = mixed * _MIX[0]
    whole = np.add.reduceat((v ^ (v >> np.uint64(31))) * _MIX[1], begin)
    return has, whole.view(np.int64), keys.view(np.int64)


_DATE_HASHES = np.array([_plain_hash(w) for w in DATE_WORDS.split()], np.uint64)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            shingles = line_shingles([x.replace("\0", " ") for x in b.column(5).to_pylist()])
            has, whole, _ = set_keys(shingles)
            same = np.zeros(b.num_rows, np.int64)
            same[has] = whole
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(same, mask=shingles.value_lengths().to_numpy() == 0), shingles], names=["h1", "h2", "uid", "src", "unit_docs", "same", "shingles"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, bucket): the buckets of each set, by source and band."""
    band = np.arange(1, BANDS + 1, dtype=np.uint64) * _POWERS[2]
    for b in batches:
        has, _, keys = set_keys(b.column(2))
        src = b.column(1).to_numpy()[has].view(np.uint64)
        v = (keys.view(np.uint64) ^ src[:, None]) * _POWERS[1] + band
        v ^= v >> np.uint64(31)
        uid = np.repeat(b.column(0).to_numpy()[has], BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(v.view(np.int64).ravel())], names=["uid", "bucket"])


def _alike(t: pa.Table) -> pa.Table:
    """(uid, head) that connect the sets of one bucket, or of two of its blocks, whose shingles reach JACCARD, through any that agree."""
    uid = t["uid"].to_numpy()
    order = np.argsort(uid, kind="stable")
    uid, lists = uid[order], t["shingles"].combine_chunks().take(pa.array(order))
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    rest, out = np.flatnonzero(sizes > 0), []
    while len(rest):  # each unit, once reached, is compared with those that are not yet
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            h = front.pop()
            begin = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
            at = np.repeat(starts[rest] - begin, sizes[rest]) + np.arange(sizes[rest].sum())
            both = np.add.reduceat(np.isin(flat[at], flat[starts[h] : ends[h]]).astype(np.int64), begin)
            near = both >= JACCARD * (sizes[rest] + sizes[h] - both) - 1e-9
            out += [(u, uid[h]) for u in uid[rest[near]]]
            front += rest[near].tolist()
            rest = rest[~near]
    a, b = zip(*out) if out else ((), ())
    return pa.table({"uid": pa.array(a, pa.int64()), "head": pa.array(b, pa.int64())})


def source_lines(df: DataFrame, doc: str, source: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, source, line_no, line, norm) of the lines whose normal form has ``min_chars``; lines count from 1."""
    both = F.arrays_zip(F.split(text, "\n", -1).alias("line"), normal_forms(F.col(text)).alias("norm"))
    lines = df.where(F.col(doc).isNotNull() & F.col(source).isNotNull()).select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.posexplode(both).alias("at", "x"))
    # edges without blanks and punctuation; worked out on the whole text first, as calls per line cost most
    lines = lines.select("doc", "source", (F.col("at") + 1).cast("int").alias("line_no"), "x.line", F.btrim("x.norm", F.lit(_EDGE)).alias("norm"))
    return lines.where(F.char_length("norm") >= min_chars)


def _unit(kind: str) -> list[Column]:
    """Fingerprint of 128 bits of a line's unit."""
    source = F.col("source").cast(kind)
    return [F.xxhash64(source, "norm").alias("h1"), F.xxhash64(F.lit(7), source, "norm").alias("h2")]


def near_links(units: DataFrame) -> DataFrame:
    """(uid, head) of the units (uid, src, same, shingles) that are near-duplicates within a source: of one set, or of sets at JACCARD or more.

    Sets are compared within the buckets of their bands. A bucket of more than
    TASK_SETS different sets is cut into blocks that are compared two by two.
    """
    units = units.where("same is not null")
    heads = units.groupBy("src", "same").agg(F.min(F.struct("uid", "shingles")).alias("x"), F.count("*").alias("n"))
    heads = written(heads.select("src", "same", "x.uid", "x.shingles", "n"))
    # small tables are written, so that their size is known and large sides need not be shuffled to meet them
    shared = written(heads.where("n > 1").select("src", "same", F.col("uid").alias("head")))
    equal = units.select("src", "same", "uid").join(shared, ["src", "same"]).where("uid <> head").select("uid", "head")
    slots = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = heads.select("uid", "src", "shingles").mapInArrow(_buckets, "uid long, bucket long").repartition(slots, "bucket")
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.when(F.col("n") > TASK_SETS, F.ceil(F.col("n") / (TASK_SETS // 2))).otherwise(1).cast("int")
    filled = written(rows.join(full.select("bucket", blocks.alias("blocks")), "bucket"))
    filled = filled.join(heads.select("uid", "shingles"), "uid")
    filled = filled.withColumn("block", F.pmod("uid", "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    filled = filled.select("uid", "shingles", "bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    return filled.groupBy("bucket", "i", "j").applyInArrow(_alike, "uid long, head long").unionAll(equal).distinct()


def repeated_lines(df: DataFrame, doc: str, source: str, text: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, line_no, unit_docs, cluster_docs) of every repeated line, once per document and line.

    ``unit_docs`` counts the documents that hold the line's own normal form,
    ``cluster_docs`` those that hold it or a near-duplicate; lines come out
    whose cluster has ``min_docs``. Null texts, documents or sources give no
    rows. Documents that occur twice count once.
    """
    spark = df.sparkSession
    lines = source_lines(df, doc, source, text, min_chars)
    kind = lines.schema["source"].dataType.simpleString()
    places = written(lines.select("doc", "line_no", *_unit(kind), F.xxhash64("source").alias("src")))
    # of a line's spellings the greatest stands for it: small letters come after capitals; documents are counted without their lines, which are shuffled once
    said = lines.select(*_unit(kind), "line").groupBy("h1", "h2").agg(F.max("line").alias("line"))
    docs = places.select("h1", "h2", "src", "doc").distinct().groupBy("h1", "h2").agg(F.max("src").alias("src"), F.count("*").alias("unit_docs"))
    units = said.join(docs, ["h1", "h2"])
    units = units.select("h1", "h2", F.xxhash64("h1", "h2").alias("uid"), "src", "unit_docs", "line")
    units = written(units.mapInArrow(_shingled, "h1 long, h2 long, uid long, src long, unit_docs long, same long, shingles array<int>"))
    parts = written(connected_components(near_links(units.select("uid", "src", "same", "shingles")), "uid", "head").withColumnRenamed("node", "uid"))
    together = places.select("doc", F.xxhash64("h1", "h2").alias("uid")).join(parts, "uid").select("component", "doc").distinct().groupBy("component").agg(F.count("*").alias("docs"))
    # units without a near-duplicate that are rare by themselves are gone before they are joined
    sizes = units.select("h1", "h2", "uid", "unit_docs")
    linked = sizes.join(parts, "uid").join(together.where(F.col("docs") >= min_docs), "component").select("h1", "h2", "unit_docs", F.col("docs").alias("cluster_docs"))
    alone = sizes.where(F.col("unit_docs") >= min_docs).join(parts, "uid", "left_anti").select("h1", "h2", "unit_docs", F.col("unit_docs").alias("cluster_docs"))
    return places.join(written(linked.unionAll(alone)), ["h1", "h2"]).select("doc", "line_no", "unit_docs", "cluster_docs").dropDuplicates(["doc", "line_no"])


def without_repeated(df: DataFrame, doc: str, source: str, text: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text): each document once, without its repeated lines; a null text stays null, a text of nothing else is empty."""
    gone = repeated_lines(df, doc, source, text, min_docs, min_chars).groupBy("doc").agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("text")).dropDuplicates(["doc"])
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), (i + 1).cast("int")))
    return rows.join(gone, "doc", "left").select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    found = repeated_lines(read_table(spark, root, "article_skeletons"), "skeleton_id", "newspaper_id", "body_text")
    return found.where(F.col("unit_docs") >= MIN_DOCS).select(F.col("doc").alias("skeleton_id"), "line_no")


def p3_clean(spark: SparkSession, root: str) -> DataFrame:
    """Every body_text without its repeated lines, near-duplicates included."""
    return without_repeated(read_table(spark, root, "article_skeletons"), "skeleton_id", "newspaper_id", "body_text").select(F.col("doc").alias("skeleton_id"), F.col("text").alias("body_text"))


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
ORACLE = {
    "p3_found": r"""
with s as (select distinct skeleton_id, newspaper_id, body_text from article_skeletons),
l as (select skeleton_id, newspaper_id, unnest(string_split(body_text, chr(10))) line, generate_subscripts(string_split(body_text, chr(10)), 1) line_no from s),
n as (select skeleton_id, newspaper_id, cast(line_no as integer) line_no,
        trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' .,;:!?*-_|') f from l),
g as (select newspaper_id, f from n where length(f) >= 20 group by all having count(distinct skeleton_id) >= 5)
select distinct skeleton_id, line_no from n join g using (newspaper_id, f)""",
}
