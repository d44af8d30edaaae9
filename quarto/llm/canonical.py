"""Free-entered values mapped to the closest entry of a reference list.

A prefix-filter set-similarity join: values and the written forms of the
entries (in full, abbreviated, initials, first word) become sets of hashed
character bigrams, ordered by global rarity. Only the rare prefixes that two
sets of the wished similarity must share are joined; length and position
filters drop candidates, and Jaccard is verified exactly on the sets. Distinct
values are joined, not rows. The candidates' words are then aligned with the
entry's, under an edit cost that knows scanning confusions, and the best entry
is kept if it agrees well enough and no other agrees as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.sources.tables import read_table

SIMILARITY = 0.3
#: Hashed bigrams; also the bound of what is collected and broadcast for the rarity order.
TOKENS = 1 << 16
_STOP = {"the", "and", "of", "a"}
_DIGITS = str.maketrans("01!58|", "olisbl")
_AFFIX = re.compile(r"^\s*(?:section\s*:|(?:www\.)(?=\S+\.\w+\s*$)|[A-Z]\d{1,2}\s+)|(?:\s+[-–|]\s+(?:[\w-]+\s+)?(?:edition|e-paper)|(?<=\w)\.example)\s*$", re.I)
_SPACED = re.compile(r"^\s*(?:\S\s+){3,}\S\s*$")
# Groups of letters that scanning confuses.
CONFUSED = [("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("ri", "n"), ("in", "m"), ("ni", "m"), ("fi", "ti"), ("tl", "d"), ("ll", "u")]
_NEAR = {q for p in (("c", "e"), ("f", "t"), ("l", "i"), ("q", "g"), ("h", "b"), ("u", "n"), ("a", "o"), ("i", "j"), ("l", "t"), ("v", "y")) for q in (p, p[::-1])}
_LIKE = 0.3  # cost of a confusion; any other edit costs 1


@lru_cache(maxsize=100_000)
def words_of(value: str) -> list[tuple[str, bool]]:
    """(letters, abbreviated) of each word of a value, without decorations, articles and joining words."""
    text = unicodedata.normalize("NFKC", value)
    for _ in range(3):
        text = _AFFIX.sub("", text)
    if _SPACED.match(text):
        text = " ".join("".join(w.split()) for w in re.split(r"\s{2,}", text.strip()))
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-zà-ÿ])", " ", text)
    out = []
    for m in re.finditer(r"([^\s/&,()+|.:;\[\]\"'–-]+)(\.?)", text):
        w = "".join(c for c in unicodedata.normalize("NFKD", m[1].lower().translate(_DIGITS)) if c.isalnum() or c in "�?!")
        w = w.replace("?", "�").replace("!", "i")
        if w.strip("�") and (w not in _STOP or m[2]):
            out.append((w, bool(m[2])))
    return out


_SWAPS: dict[tuple[str, str], list[tuple[str, str]]] = {}
for _p, _q in CONFUSED:
    for _u, _w in ((_p, _q), (_q, _p)):
        _SWAPS.setdefault((_u[-1], _w[-1]), []).append((_u, _w))
_FAR = 9.0


@lru_cache(maxsize=200_000)
def edit_cost(a: str, b: str) -> float:
    """Edits between two words; swaps of neighbours cost 1, scanning confusions and unread characters ``_LIKE``.

    Worked out within a band of four diagonals to either side; ``_FAR`` and
    more where the lengths differ by more than that.
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    if abs(n - m) > 4:
        return _FAR + abs(n - m)
    d = [[_FAR] * (m + 1) for _ in range(n + 1)]
    for i in range(min(n, 4) + 1):
        d[i][0] = float(i)
    for j in range(min(m, 4) + 1):
        d[0][j] = float(j)
    for i in range(1, n + 1):
        x, above, row = a[i - 1], d[i - 1], d[i]
        for j in range(max(1, i - 4), min(m, i + 4) + 1):
            y = b[j - 1]
            if x == y:
                v = above[j - 1]
            else:
                v = above[j - 1] + (_LIKE if x == "�" or y == "�" or (x, y) in _NEAR else 1.0)
            w = (above[j] if above[j] < row[j - 1] else row[j - 1]) + 1.0
            if w < v:
                v = w
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                v = min(v, d[i - 2][j - 2] + 1.0)
            for u, w in _SWAPS.get((x, y), ()):
                if a.endswith(u, 0, i) and b.endswith(w, 0, j):
                    v = min(v, d[i - len(u)][j - len(w)] + _LIKE)
            row[j] = v
    return d[n][m]


def _word_cost(value: str, abbreviated: bool, entry: str, tolerance: float) -> float | None:
    """Cost per letter of reading ``entry`` in ``value``; None beyond the tolerance."""
    if value == entry:
        return 0.0
    if abbreviated and len(value) < len(entry):
        if entry.startswith(value):
            return 0.02 if len(value) > 2 else 0.1
        if len(value) > 2 and edit_cost(value, entry[: len(value)]) <= tolerance * len(value):
            return 0.2
    if len(value) == 1:
        return 0.1 if abbreviated and entry[0] == value else None
    cost = edit_cost(value, entry)
    if cost and value[0] != entry[0] and (value[0], entry[0]) not in _NEAR and value[0] != "�" and cost >= 2:
        cost += 1  # names that begin otherwise are rather other names
    return cost / len(entry) if cost <= tolerance * len(entry) + 1e-9 else None


def _assigned(costs: list[list[float | None]], weights: list[int], spare: frozenset[int]) -> list[tuple[float, bool, tuple[int, ...]]]:
    """(cost, turned round, words) of the cheapest reading in order and of the cheapest in any order; words that stay over must be spare.

    A table over the sets of words taken; words that no entry's word may be are
    never taken, so the sets stay few. ``costs[k][i]``: of reading the entry's
    word k in word i, None if it may not.
    """
    n = len(costs[0])
    must = sum(1 << i for i in range(n) if i not in spare)
    out = []
    for ordered in (True, False):
        best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row, w in zip(costs, weights):
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for taken, (c, picked) in best.items():
                for i, x in enumerate(row):
                    if x is None or taken >> i & 1 or (ordered and taken >> i):
                        continue
                    t, v = taken | 1 << i, (c + x * w, (*picked, i))
                    if t not in new or v < new[t]:
                        new[t] = v
            best = new
        full = [v for t, v in best.items() if t & must == must]
        if full:
            c, picked = min(full)
            out.append((c, list(picked) != sorted(picked), picked))
    return out


def agreement(value: str, entry: str, tolerance: float) -> float:
    """0 if the value's words do not mean the entry, else a score up to 1."""
    got, want = words_of(value), [w for w, _ in words_of(entry)]
    if not got or not want:
        return 0.0
    best = 0.0
    joined, full = "".join(w for w, _ in got), ["".join(want), "".join(reversed(want)), "and".join(want), "the" + "".join(want)]
    if len(got) == 1 or len(joined) > 6:
        for i, f in enumerate(full):
            c = edit_cost(joined, f)
            c = (c + (c >= 2 and joined[0] != f[0] and (joined[0], f[0]) not in _NEAR)) / len(f)
            if c <= min(tolerance, 0.17):
                best = max(best, 1 - c - 0.005 * i)
    if len(got) == 1 and len(want) > 1 and not got[0][1]:
        c = _word_cost(got[0][0], False, want[0], min(tolerance, 0.34))
        if c is not None:
            best = max(best, 0.8 - c)
    initials = "".join(w[0] for w in want)
    if len(got) == 2 and len(want) == 2 and got[0][0] == initials:  # "QG (Quernford)"
        c = _word_cost(got[1][0], False, want[0], tolerance)
        if c is not None:
            best = max(best, 0.85 - c)
    if len(want) > 1 and len(want) <= len(got) <= len(want) + 2:
        spare = [i for i, (r, _) in enumerate(got) if len(r) <= 4 and min(edit_cost(r, s) for s in ("the", "and")) <= 2]
        costs = [[_word_cost(*g, w, tolerance) for g in got] for w in want]
        for c, turned, picked in _assigned(costs, [len(w) for w in want], frozenset(spare)):
            if any(len(got[i][0]) >= 3 for i in picked):
                best = max(best, 1 - c / sum(map(len, want)) - 0.01 * turned - 0.02 * (len(got) - len(want)))
    return best


def forms_of(entry: str) -> list[str]:
    """Written forms of an entry whose sets the values are compared with."""
    want = [w for w, _ in words_of(entry)]
    if len(want) < 2:
        return want
    initials = "".join(w[0] for w in want)
    return ["".join(want), "and".join(want), want[0][0] + "".join(want[1:]), initials + want[0], "".join(w[:4] for w in want), want[0] + "".join(w[:4] for w in want[1:]), want[0]]


def grams(letters: str) -> list[int]:
    """Hashed bigrams and letters of a word or of joined words."""
    return sorted({crc32(letters[i : i + 2].encode()) % TOKENS for i in range(len(letters) - 1)} | {crc32(c.encode()) % TOKENS for c in letters})


def _sets(rows: DataFrame, forms: bool) -> DataFrame:
    """(field, item, toks): the set of each value, or of each form of an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts = forms_of(v) if forms else ["".join(w for w, _ in words_of(v))]
                out += [(f, v, grams(t)) for t in texts if t]
            cols = list(zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int32()))], names=["field", "item", "toks"])

    return rows.mapInArrow(run, "field string, item string, toks array<int>")


def _prefixes(sets: DataFrame, rank: np.ndarray, similarity: float) -> DataFrame:
    """(field, item, toks, tok, pos): toks by rarity, one row per token of the prefix."""
    shared = sets.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            out: list[tuple] = []
            for f, v, toks in zip(*(b.column(i).to_pylist() for i in range(3))):
                toks = sorted(toks, key=order.__getitem__)
                for i in range(len(toks) - int(np.ceil(similarity * len(toks) - 1e-9)) + 1):
                    out.append((f, v, toks, toks[i], i))
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["field", "item", "toks", "tok", "pos"])

    return sets.mapInArrow(run, "field string, item string, toks array<int>, tok int, pos int")


def similar_entries(values: DataFrame, entries: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(field, value, entry, jaccard) of every value and entry, one of whose forms reaches the similarity."""
    slots = 2 * values.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not to be coalesced
    v, e = _sets(values.select("field", "value").repartition(slots, "value"), False), _sets(entries.select("field", "entry"), True)
    counts = v.unionAll(e).select(F.explode("toks").alias("t")).groupBy("t").count().collect()  # TOKENS rows at most
    seen = np.zeros(TOKENS, np.int64)
    for r in counts:
        seen[r["t"]] = r["count"]
    rank = np.empty(TOKENS, np.int64)
    rank[np.lexsort((np.arange(TOKENS), seen))] = np.arange(TOKENS)
    left = _prefixes(v, rank, similarity).select("field", "tok", F.col("item").alias("value"), F.col("toks").alias("x"), F.col("pos").alias("i"))
    right = _prefixes(e, rank, similarity).select("field", "tok", F.col("item").alias("entry"), F.col("toks").alias("y"), F.col("pos").alias("j"))
    nx, ny = F.size("x"), F.size("y")
    pairs = left.join(right, ["field", "tok"]).where((ny >= similarity * nx) & (nx >= similarity * ny))
    pairs = pairs.where(1 + F.least(nx - F.col("i"), ny - F.col("j")) - 1 >= F.ceil(similarity / (1 + similarity) * (nx + ny) - 1e-9) - F.least("i", "j"))
    pairs = pairs.select("field", "value", "entry", "x", "y").distinct()
    both = F.size(F.array_intersect("x", "y"))
    pairs = pairs.select("field", "value", "entry", (both / (F.size("x") + F.size("y") - both)).alias("jaccard")).where(F.col("jaccard") >= similarity)
    return pairs.groupBy("field", "value", "entry").agg(F.max("jaccard").alias("jaccard"))


def map_to_list(records: DataFrame, entries: DataFrame, tolerance: dict[str, float], similarity: float = SIMILARITY) -> DataFrame:
    """(field, rec_id, value, ref_id, score): one row per record whose value is neither null nor empty nor an entry as it stands.

    ``records``: field, rec_id, value; ``entries``: field, ref_id, entry.
    ``tolerance`` holds the edits per letter that a word of each field may have.
    ref_id is 0, and score null, where no entry agrees or two agree equally
    well; a blank value never agrees. Records that occur twice count once.
    Entries of the same field and text count as the one of least ref_id.
    """
    entries = entries.where(F.col("entry").isNotNull()).groupBy("field", "entry").agg(F.min("ref_id").alias("ref_id"))
    todo = records.where(F.col("value").isNotNull() & (F.col("value") != "")).select("field", "rec_id", "value").distinct()
    todo = todo.join(entries.select("field", F.col("entry").alias("value")), ["field", "value"], "left_anti")
    values = todo.select("field", "value").distinct()
    pairs = similar_entries(values, entries, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, v, e, j = (b.column(i).to_pylist() for i in range(4))
            s = [agreement(y, z, tolerance[x]) for x, y, z in zip(f, v, e)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(s, pa.float64())], names=["field", "value", "entry", "jaccard", "score"])

    slots = values.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not to be coalesced
    scored = pairs.repartition(2 * slots, "field", "value").mapInArrow(run, "field string, value string, entry string, jaccard double, score double").where("score > 0")
    # the best two by the words' agreement; equal ones leave the value open
    top = scored.groupBy("field", "value").agg(F.max(F.struct("score", "jaccard", "entry")).alias("top"), F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias("two"))
    clear = (F.size("two") < 2) | (F.col("two")[0] - F.try_element_at("two", F.lit(2)) > 0.015)
    best = top.where(clear).select("field", "value", F.col("top.entry").alias("entry"), F.col("top.score").alias("score"))
    best = best.join(entries, ["field", "entry"]).select("field", "value", "ref_id", "score")
    return todo.join(best, ["field", "value"], "left").select("field", "rec_id", "value", F.coalesce("ref_id", F.lit(0)).cast("long").alias("ref_id"), "score")


#: Edits per letter: names of papers differ in few letters from names that are not in the list, sections do not.
TOLERANCE = {"newspaper_brand": 0.25, "section": 0.5}


def archive_values(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    brand, section = F.lit("newspaper_brand").alias("field"), F.lit("section").alias("field")
    records = read_table(spark, root, "page_layouts").select(brand, F.col("layout_id").alias("rec_id"), F.col("newspaper_brand").alias("value"))
    records = records.unionAll(read_table(spark, root, "article_skeletons").select(section, F.col("skeleton_id").alias("rec_id"), F.col("section").alias("value")))
    entries = read_table(spark, root, "newspapers").select(brand, F.col("id").alias("ref_id"), F.col("name").alias("entry"))
    entries = entries.unionAll(read_table(spark, root, "section_list").select(section, F.col("section_id").alias("ref_id"), F.col("section_name").alias("entry")))
    return records, entries


def p5_mapped(spark: SparkSession, root: str) -> DataFrame:
    return map_to_list(*archive_values(spark, root), TOLERANCE)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_mapped(spark, root).select(F.col("field").alias("ref_field"), "rec_id", "ref_id")


def p5_unmatched(spark: SparkSession, root: str) -> DataFrame:
    """The values that mean no entry, with their number of records."""
    return p5_mapped(spark, root).where("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("records"))


QUERIES = {"p5_found": p5_found, "p5_unmatched": p5_unmatched}
