"""Variant spellings of people and organisations, linked.

A name is read as its parts: the family word, the given name or line of
business, further initials. Words become vectors of hashed character n-grams,
weighted by their rarity among all names; a name's vector is that of all its
words, in whatever order. A distributed sparse join over an inverted index of
the n-grams finds all pairs of words whose cosine reaches a threshold, and
names meet through such words where these weigh enough in both: no list of most
similar ones is cut. Pairs that met are scored by their parts, and each
component of linked ones is grouped by average linkage over its scored pairs:
in one task where they are few, by rounds of reciprocal nearest groups over all
tasks where they are many, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.llm.canonical import edit_cost
from quarto.plans.graph import connected_components
from quarto.session import ensure_checkpoint_dir
from quarto.sources.tables import read_table

COSINE, LINK, LINKAGE = 0.35, 0.5, 0.45
#: Edits between two similar words: a link allows a cost of 2, of which a change of places is two edits here.
EDITS = 4
#: Share of a name's weight that a word has through which it meets others; the heaviest and the family word always count.
KEY_SHARE = 0.45
#: What a pair of one component counts that never met, as two misspellings of one name may; pairs that met and contradict count 0.
UNMET = 0.4
#: Cosine of whole names from which a pair without similarity counts as a contradiction.
CONTRADICT = 0.5
#: Hashed n-grams; bound of the rarity table that is collected and broadcast.
GRAMS = 1 << 18
#: More edits that two misspellings of one name may be apart; such pairs count in the linkage and link nothing themselves.
SLACK = 1.5
#: Pairs of a component that one task groups; larger ones are grouped by distributed rounds.
TASK_PAIRS = 200_000
_DIGITS = str.maketrans("01!58|", "olisbl")
# Short forms of given names.
NICKNAMES = {
    "bill": "william", "will": "william", "bob": "robert", "rob": "robert", "dick": "richard", "rick": "richard", "ted": "edward", "eddie": "edward", "ned": "edward", "jim": "james", "jimmy": "james", "mike": "michael", "tom": "thomas", "ben": "benjamin", "fred": "frederick", "freddie": "frederick",
    "nat": "nathaniel", "nate": "nathaniel", "len": "leonard", "leo": "leonard", "wat": "walter", "wally": "walter", "alex": "alexander", "sandy": "alexander", "chris": "christopher", "kit": "christopher", "peg": "margaret", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth",
    "kate": "katherine", "kathy": "katherine", "kitty": "katherine", "vicky": "victoria", "vic": "victoria", "sue": "susan", "susie": "susan", "pat": "patricia", "tricia": "patricia", "patty": "patricia", "jo": "josephine", "josie": "josephine", "pippa": "philippa", "thea": "theodora", "dora": "theodora", "mina": "wilhelmina", "minnie": "wilhelmina", "billie": "wilhelmina",
    "gabi": "gabriela", "luci": "lucia", "lucy": "lucia", "paco": "francisco", "pancho": "francisco", "pepe": "jose", "nacho": "ignacio", "meena": "meenakshi", "raj": "rajendra", "dev": "devendra", "anu": "ananya", "lucky": "lakshmi", "ossi": "oskar", "ossie": "oskar", "fran": "francois", "frank": "francisco",
}
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "hon", "capt", "sir", "lady", "shri", "smt", "rev", "col", "maj", "gen", "lt", "sri"}
_LEGAL = {"company", "co", "corporation", "corp", "incorporated", "inc", "limited", "ltd", "brothers", "bros", "international", "intl", "association", "assn", "sons", "son", "and", "the", "gmbh", "plc"}
_LEAD = re.compile(r"^\s*(?:(?:story|words|text|report|reported|written)\s*(?:by\b|:)|by\b|from\b|words\s*:)\s*:?\s*", re.I)
_TAIL = re.compile(r"\s*(?:\|.*|,\s*(?:staff|special|senior|chief|our)\b.*|\s(?:in|at)\s+[^\s,]+(?:\s+[^\s,]+)?)\s*$", re.I)
_DESK = re.compile(r"\b(?:bureau|correspondent|reporter|agenc(?:y|ies)|desk|staff|newsroom|editor|service|wire)\b", re.I)


def _letters(word: str) -> str:
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word).lower().translate(_DIGITS))
    return "".join(c for c in text if c.isalpha() or c == "�")


@lru_cache(maxsize=100_000)
def person(name: str) -> tuple[str, str, str] | None:
    """(family, given or its initial, further initials) of a person's name; None if there is no family name."""
    left, comma, right = name.partition(",")
    turned = bool(comma and right.strip() and len(left.split()) == 1)
    text = re.sub(r"(?<=\b\w)\.(?=\w)", ". ", f"{right} {left}" if turned else name.replace(",", " "))
    words = [w for w in (_letters(x) for x in re.split(r"[\s.\-]+", text)) if w]
    while len(words) > 1 and words[0] in _TITLES:
        words.pop(0)
    if not words:
        return None
    if not turned and len(words) > 1 and len(words[0]) > 1 and all(len(w) == 1 for w in words[1:]):
        words = [*words[1:], words[0]]  # "Family A. B."
    if len(words) < 2 or len(words[-1]) < 2:
        return None
    given = NICKNAMES.get(words[0], words[0])
    return words[-1], given, "".join(w[0] for w in words[1:-1])


@lru_cache(maxsize=100_000)
def organisation(name: str) -> tuple[str, str, str] | None:
    """(family word, line of business, "") of a firm's name; words that tell the legal form are left out."""
    text = re.sub(r"\([^)]*\)", " ", name)
    left, comma, right = text.rpartition(",")
    if comma and len(right.split()) == 1:
        text = f"{right} {left}"
    words = [w for w in (_letters(x) for x in re.split(r"[\s.\-&/,]+", text)) if w]
    words = [w for w in words if w not in ("the", "and")]
    if not words:
        return None
    rest = [w for w in words[1:] if w not in _LEGAL]
    return words[0], " ".join(rest), ""


def byline_people(byline: str) -> list[str]:
    """The people that a byline names."""
    text = _LEAD.sub("", _LEAD.sub("", byline))
    for _ in range(3):
        text = _TAIL.sub("", text)
    out = []
    for part in re.split(r"\s+(?:and|AND|And|und|et|y)\s+|\s*[&/;]\s*", text):
        if part.strip() and not _DESK.search(part):
            p = _TAIL.sub("", part).strip()
            if person(p):
                out.append(p)
    return out


def _given(a: str, b: str) -> float:
    """Agreement of two given names: 1 the same, 0.75 one an initial of the other, 0 different."""
    if a == b:
        return 1.0 if len(a) > 1 else 0.8
    if len(a) == 1 or len(b) == 1:
        return 0.75 if a[0] == b[0] else 0.0
    c = edit_cost(a, b)
    return max(0.0, 1 - 0.12 * c) if c <= max(1.0, 0.3 * max(len(a), len(b))) else 0.0


def _short_for(s: str, t: str) -> bool:
    """Whether ``s`` may abbreviate ``t``: a prefix, or letters of it in order (``bk`` for ``bank``)."""
    rest = iter(t)
    return s[0] == t[0] and (t.startswith(s) if len(s) > 2 else all(c in rest for c in s)) or (not set(s[1:]) & set("aeiou") and all(c in rest for c in s))


def _business(a: str, b: str) -> float:
    """Agreement of two lines of business, word by word; a shortened one may leave out its last words."""
    x, y = sorted((a.split(), b.split()), key=len)
    if not x or not y:
        return 1.0 if x == y else 0.0
    worst = 1.0 if len(x) == len(y) else 0.8
    for u, v in zip(x, y):
        if u == v:
            if len(x) != len(y):
                return 0.0
            continue
        s, t = sorted((u, v), key=len)
        if len(s) > 1 and len(s) < len(t) and _short_for(s, t):
            worst = min(worst, 0.9)
            continue
        c = edit_cost(u, v)
        worst = min(worst, 1 - 0.1 * c if c <= 0.3 * max(len(u), len(v)) and len(x) == len(y) else 0.0)
    return worst


def name_similarity(kind: str, a: tuple[str, str, str], b: tuple[str, str, str], slack: float = 0.0) -> float:
    """Similarity of two names from their parts, 0 if any part contradicts; a person's family and given name may be turned round."""
    s = _similarity(kind, a, b, slack)
    if not s and kind == "person" and len(a[1]) > 1 and len(b[1]) > 1 and edit_cost(a[0], b[1]) + edit_cost(a[1], b[0]) <= 1:
        return 0.85 - 0.12 * (edit_cost(a[0], b[1]) + edit_cost(a[1], b[0]))
    return s


def _similarity(kind: str, a: tuple[str, str, str], b: tuple[str, str, str], slack: float) -> float:
    """Similarity of two names from their parts, 0 if any part contradicts.

    ``slack`` more edits of the family word count against it without
    contradicting: two misspellings of one name are further from each other
    than from the name.
    """
    rest = _business(a[1], b[1]) if kind == "org" else _given(a[1], b[1])
    if not rest:
        return 0.0
    initials = kind == "person" and (len(a[1]) == 1 or len(b[1]) == 1)
    if a[2] and b[2] and a[2][0] != b[2][0]:
        if initials:
            return 0.0
        rest -= 0.1
    if a[0] == b[0]:
        return rest
    c = edit_cost(a[0], b[0])
    most = 1.35 if initials or min(len(a[0]), len(b[0])) < 8 else 2.0
    if c > most + slack or (c >= 1 and a[0][0] != b[0][0] and c > 1.35 + slack):
        return 0.0
    return max(0.0, rest - 0.12 * c)


def grams_of(*words: str) -> list[int]:
    """Hashed n-grams of the words, their ends marked: trigrams, runs of four in order of the alphabet, which two letters changed round do not alter, and of each word its first letter, which an initial has too."""
    out = set()
    for w in words:
        text = f"^{w}$"
        out |= {text[i : i + 3] for i in range(len(text) - 2)} | {"".join(sorted(text[i : i + 4])) + "4" for i in range(len(text) - 3)} | {text[:2]}
    return sorted({crc32(g.encode()) % GRAMS for g in out})


def _parsed(rows: DataFrame) -> DataFrame:
    """(kind, family, rest, more, rec): the parts of each (kind, name, rec); names without a family word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, name, rec in zip(*(b.column(i).to_pylist() for i in range(3))):
                for one in byline_people(name) if kind == "byline" else [name]:
                    k = "org" if kind == "org" else "person"
                    p = organisation(one) if k == "org" else person(one)
                    if p:
                        out.append((k, *p, rec))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "family", "rest", "more", "rec"])

    return rows.mapInArrow(run, "kind string, family string, rest string, more string, rec string")


NAME = "kind string, family string, rest string, more string"
PARTS = ["family", "rest", "more"]


def _words(family: str, rest: str, more: str) -> list[str]:
    return [family, *rest.split(), *more]


def gram_weights(units: DataFrame) -> np.ndarray:
    """Rarity of each hashed n-gram among the names; GRAMS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GRAMS, np.int64)
        for b in batches:
            for parts in zip(*(b.column(i).to_pylist() for i in range(3))):
                n[grams_of(*_words(*parts))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["t", "n"])

    n = np.ones(GRAMS)
    for r in units.select(*PARTS).mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # GRAMS rows at most
        n[r["t"]] = r["n"]
    return np.log(1 + units.count() / n).astype(np.float32)


def similar_words(words: DataFrame, shared, cosine: float = COSINE) -> DataFrame:
    """(kind, u, v) of all distinct (kind, word) whose vectors reach the cosine and that are EDITS edits apart at most, both ways round; a few whose cosine falls short may come too."""
    high = float(np.sqrt(cosine))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            rows, cols = [], [[], [], [], []]
            for i, word in enumerate(b.column(1).to_pylist()):
                g = np.array(grams_of(word))
                g = g[np.lexsort((g, -w[g]))]
                x = w[g].astype(float)
                rest = np.sqrt(np.cumsum(x[::-1] ** 2)[::-1])  # from each n-gram on
                x, rest = x / rest[0], rest / rest[0]
                low = rest[rest < high]
                rows += [i] * len(g)
                for c, v in zip(cols, (g.tolist(), x.tolist(), (rest >= high).tolist(), [float(low[0]) if len(low) else 0.0] * len(g))):
                    c += v
            at = pa.array(rows, pa.int32())
            types = [pa.int32(), pa.float32(), pa.bool_(), pa.float32()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, types))], names=["kind", "word", "t", "x", "high", "low"])

    # Two n-grams that both lie where their vectors have less than the root of the cosine left add less than ``low * low`` in all, so such pairs are not met.
    slots = 2 * words.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not to be coalesced
    index = words.select("kind", "word").mapInArrow(vectors, "kind string, word string, t int, x float, high boolean, low float").repartition(slots, "kind", "t")
    left = index.where("high").select("kind", "t", F.col("word").alias("p"), F.col("x").alias("px"), F.col("low").alias("pl"))
    right = index.select("kind", "t", F.col("word").alias("q"), F.col("x").alias("qx"), F.col("low").alias("ql"), "high")
    met = left.join(right, ["kind", "t"]).where((F.col("p") < F.col("q")) | (~F.col("high") & (F.col("p") != F.col("q"))))
    pairs = met.groupBy("kind", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.sum(F.col("px").cast("double") * F.col("qx")).alias("dot"), F.max(F.col("pl") * F.col("ql")).alias("open"))
    pairs = pairs.where(F.col("dot") + F.col("open") >= cosine - 1e-5).where(F.levenshtein("u", "v", EDITS) >= 0).select("kind", "u", "v")
    same = words.select("kind", F.col("word").alias("u"), F.col("word").alias("v"))
    return pairs.unionAll(pairs.select("kind", F.col("v").alias("u"), F.col("u").alias("v"))).unionAll(same)


def similar_names(units: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(kind, a, b, s, loose) of the pairs of names (uid, kind, family, rest, more), a < b, that meet through similar words.

    ``s`` is their similarity by parts, ``loose`` the one with SLACK; pairs
    without come out where the whole names' cosine tells that they contradict
    each other rather than having nothing in common.
    """
    units = units.select("uid", "kind", *PARTS)
    shared = units.sparkSession.sparkContext.broadcast(gram_weights(units))
    slots = 2 * units.sparkSession.sparkContext.defaultParallelism

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            rows, words = [], []
            for i, parts in enumerate(zip(*(b.column(i).to_pylist() for i in range(2, 5)))):
                own = sorted({x for x in _words(*parts) if len(x) > 1})
                mass = [float((w[grams_of(x)].astype(float) ** 2).sum()) for x in own]
                least = min(KEY_SHARE * sum(mass), max(mass))
                for x, m in zip(own, mass):
                    if m >= least or x == parts[0]:
                        rows.append(i)
                        words.append(x)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int32())) for c in b.columns), pa.array(words, pa.string())], names=["uid", "kind", *PARTS, "word"])

    named = units.mapInArrow(keys, f"uid long, {NAME}, word string").checkpoint()
    near = similar_words(named.select("kind", "word").distinct(), shared, cosine)
    side = lambda x, word: named.select("kind", F.col("word").alias(word), F.col("uid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in PARTS))
    pairs = near.join(side("a", "u"), ["kind", "u"]).join(side("b", "v"), ["kind", "v"]).where("a < b")
    pairs = pairs.select("kind", "a", "b", "u", "v", *(f"{c}_{x}" for x in "ab" for c in PARTS)).repartition(slots, "a")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value

        @lru_cache(maxsize=50_000)
        def vector(parts: tuple) -> tuple[frozenset, float]:
            g = grams_of(*_words(*parts))
            return frozenset(g), float(np.sqrt((w[g].astype(float) ** 2).sum()))

        for batch in batches:
            kind, a, b, _, _, fa, ra, ma, fb, rb, mb = (batch.column(i).to_pylist() for i in range(11))
            out = []
            for i, (x, y) in enumerate(zip(zip(fa, ra, ma), zip(fb, rb, mb))):
                loose = name_similarity(kind[i], x, y, SLACK)
                if loose:
                    out.append((kind[i], a[i], b[i], name_similarity(kind[i], x, y), loose))
                    continue
                (gx, nx), (gy, ny) = vector(x), vector(y)
                if float((w[list(gx & gy)].astype(float) ** 2).sum()) >= CONTRADICT * nx * ny:
                    out.append((kind[i], a[i], b[i], 0.0, 0.0))
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["kind", "a", "b", "s", "loose"])

    return pairs.mapInArrow(score, "kind string, a long, b long, s double, loose double").distinct()


def sparse_linkage(left: list[int], right: list[int], similarity: list[float], weight: list[float], least: float, unmet: float = 0.0) -> list[int]:
    """Group number (its least item) of each item: the two groups of highest mean similarity are joined until none reaches ``least``.

    Pairs that are not given count ``unmet``, so memory and time go by the pairs given.
    A mean in the heap is a bound from above: it falls as its groups grow, and
    one whose sum has grown is put in anew.
    """
    n = len(weight)
    size, label, members = list(weight), list(range(n)), [[i] for i in range(n)]
    total: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, s in zip(left, right, similarity):
        if i != j:
            total[i][j] = total[j][i] = (s - unmet) * weight[i] * weight[j]
    least -= unmet
    live = [True] * n

    def entry(i: int, j: int) -> tuple[float, int, int, int, int]:
        return (-total[i][j] / (size[i] * size[j]), min(label[i], label[j]), max(label[i], label[j]), i, j)

    heap = [e for i in range(n) for j in total[i] if i < j and -(e := entry(i, j))[0] >= least]
    heapify(heap)
    while heap:
        bound, _, _, i, j = heappop(heap)
        if not (live[i] and live[j]):
            continue
        now = entry(i, j)
        if now[0] > bound:
            if -now[0] >= least:
                heappush(heap, now)
            continue
        if len(total[i]) < len(total[j]):
            i, j = j, i
        live[j] = False
        del total[i][j]
        size[i] += size[j]
        label[i] = min(label[i], label[j])
        members[i] += members[j]
        for k, t in total[j].items():
            if k != i:
                del total[k][j]
                total[i][k] = total[k][i] = total[i].get(k, 0.0) + t
                if -(e := entry(i, k))[0] >= least:
                    heappush(heap, e)
        total[j], members[j] = {}, []
    group = [0] * n
    for i in range(n):
        for m in members[i]:
            group[m] = label[i]
    return group


def average_linkage(similarity: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """``sparse_linkage`` of a full matrix."""
    i, j = np.nonzero(np.triu(similarity, 1))
    return np.array(sparse_linkage(i.tolist(), j.tolist(), similarity[i, j].tolist(), weight.tolist(), least))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, cluster): average linkage of each component of (of, a, b, loose, wa, wb), whose rows follow each other."""

    def group(rows: np.ndarray, pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b, loose, wa, wb = (c[rows] for c in pairs)
        uid, first = np.unique(np.concatenate([a, b]), return_index=True)
        weight = np.concatenate([wa, wb])[first]
        i, j = np.searchsorted(uid, a), np.searchsorted(uid, b)
        return uid, uid[np.array(sparse_linkage(i.tolist(), j.tolist(), loose.tolist(), weight.tolist(), LINKAGE, UNMET))]

    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3 + [np.empty(0)] * 3
    for b in chain(batches, [None]):
        cols = held if b is None else [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
        of = cols[0]
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        done = ends if b is None else ends[:-1]  # the last component may go on in the next batch
        starts = np.concatenate([[0], done[:-1]]) if len(done) else done
        out = [group(np.arange(s, e), cols[1:]) for s, e in zip(starts, done) if e > s]
        cut = int(done[-1]) if len(done) else 0
        held = [c[cut:] for c in cols]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["uid", "cluster"])


def linkage_rounds(nodes: DataFrame, pairs: DataFrame, least: float = LINKAGE, unmet: float = UNMET) -> DataFrame:
    """(uid, cluster): ``sparse_linkage`` of (uid, weight) nodes and (a, b, loose) pairs of any number, by distributed rounds.

    Each round joins all pairs of groups that are each other's nearest and reach
    ``least``. The mean of a joined group is never above its parts' better one,
    so the order of such joins does not matter and the groups are those of the
    one-by-one linkage. Every round is cut by a checkpoint.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    groups = nodes.select("uid", F.col("uid").alias("cluster"), "weight").checkpoint()
    w = nodes.select(F.col("uid").alias("a"), F.col("weight").alias("wa")), nodes.select(F.col("uid").alias("b"), F.col("weight").alias("wb"))
    edges = pairs.join(w[0], "a").join(w[1], "b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max((F.col("loose") - unmet) * F.col("wa") * F.col("wb")).alias("total")).checkpoint()
    while True:
        size = groups.groupBy("cluster").agg(F.sum("weight").alias("size"))
        mean = edges.join(size.select(F.col("cluster").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("cluster").alias("b"), F.col("size").alias("sb")), "b")
        mean = mean.select(F.struct((F.col("total") / (F.col("sa") * F.col("sb"))).alias("m"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b")).alias("x"), "a", "b").where(F.col("x.m") >= least - unmet)
        best = mean.select(F.col("a").alias("g"), "x").unionAll(mean.select(F.col("b").alias("g"), "x")).groupBy("g").agg(F.max("x").alias("x"))
        joins = best.groupBy("x").agg(F.count("*").alias("n")).where("n = 2").select((-F.col("x.b")).alias("cluster"), (-F.col("x.a")).alias("into")).checkpoint()
        if joins.isEmpty():
            return groups.select("uid", "cluster")
        moved = lambda df, c: df.join(joins.withColumnRenamed("cluster", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        groups = moved(groups, "cluster").checkpoint()
        edges = moved(moved(edges, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total")).checkpoint()


def link_names(rows: DataFrame) -> DataFrame:
    """(rec, cluster) of each (kind, name, rec) row, kind being ``person``, ``org`` or ``byline``.

    Records of one cluster mean the same person or firm; a byline that names
    two people has two rows. Null and blank names and bylines without a person
    have none. Rows that occur twice count once. Distinct names are compared,
    so a name that a third of all rows bear costs no more than another.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    parsed = _parsed(rows.where(F.trim("name") != "").select("kind", "name", "rec")).distinct()
    parsed = parsed.select("*", F.xxhash64("kind", *PARTS).alias("uid")).checkpoint()
    units = parsed.groupBy("uid", "kind", *PARTS).agg(F.sqrt(F.count("*")).alias("weight")).checkpoint()
    near = similar_names(units).checkpoint()
    parts = connected_components(near.where(F.col("s") >= LINK), "a", "b").checkpoint()
    # the pairs within a component, also those that alone would not link, or contradict
    of = lambda c, x: parts.select(F.col("node").alias(c), F.col("component").alias(x))
    inside = near.join(of("a", "of"), "a").join(of("b", "of_b"), "b").where("of = of_b").select("of", "a", "b", "loose").checkpoint()
    large = inside.groupBy("of").count().where(F.col("count") > TASK_PAIRS).select("of")
    linked = units.join(parts, units.uid == parts.node).select("component", "uid", "weight").checkpoint()
    slots = 2 * rows.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not to be coalesced
    weight = lambda c, w: units.select(F.col("uid").alias(c), F.col("weight").alias(w))
    small = inside.join(large, "of", "left_anti").join(weight("a", "wa"), "a").join(weight("b", "wb"), "b").select("of", "a", "b", "loose", "wa", "wb")
    clusters = small.repartition(slots, "of").sortWithinPartitions("of", "a", "b").mapInArrow(_grouped, "uid long, cluster long")
    if not large.isEmpty():
        clusters = clusters.unionByName(linkage_rounds(linked.join(large, linked.component == large.of, "left_semi").select("uid", "weight"), inside.join(large, "of", "left_semi").select("a", "b", "loose")))
    return parsed.join(clusters, "uid", "left").select("rec", F.coalesce("cluster", "uid").alias("cluster")).distinct()


def archive_names(spark: SparkSession, root: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 12, "0"))
    e = read_table(spark, root, "entities").where(F.col("entity_type").isin("person", "org"))
    e = e.select(F.col("entity_type").alias("kind"), "name", key("e", "id").alias("rec"))
    s = read_table(spark, root, "article_skeletons").select(F.lit("byline").alias("kind"), F.col("byline").alias("name"), key("s", "skeleton_id").alias("rec"))
    return e.unionAll(s.where(F.trim("name") != ""))


def p7_clusters(spark: SparkSession, root: str) -> DataFrame:
    return link_names(archive_names(spark, root))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    c = p7_clusters(spark, root).checkpoint()
    e = c.where(F.col("rec").startswith("e")).select(F.col("rec").alias("rec_a"), "cluster")
    return e.join(c.withColumnRenamed("rec", "rec_b"), "cluster").where("rec_a < rec_b").select("rec_a", "rec_b").distinct()


QUERIES = {"p7_found": p7_found, "p7_clusters": p7_clusters}
