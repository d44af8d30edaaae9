"""Evaluation passages inside a corpus, found by q-gram lemma filtering.

The evaluation side is indexed by its character q-grams. Every q-gram of a
document is looked up; hits are counted per (document, item, diagonal band), in
bands that overlap by the edit budget, so that a region lies in one of them as
a whole. By the q-gram lemma a region of ``w`` characters with ``e`` edits
shares at least ``w + 1 - q * (e + 1)`` q-grams, so bands with fewer hits are
dropped; the rest is verified by an alignment of characters within the band's
diagonals, in which letters may be changed, lost or put in.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.llm.textcodes import DIGIT, LETTER, MARK, codes_of, kind_table
from quarto.session import spread
from quarto.sources.tables import read_table

Q, MIN_WORDS = 16, 13
#: Characters of evaluation text per broadcast block; more text is searched in further blocks.
BLOCK_CHARS = 8_000_000
#: Characters of corpus text that are looked at in one vectorised step.
STEP_CHARS = 2_000_000
#: Shared q-grams that are counted in one step; texts with more are looked at alone, and against part of the items at a time.
STEP_HITS = 4_000_000
_BREAK = re.compile("[-‐­](?:\r\n|[\n\r  \x85\x0b\x0c])")
_FILTER_BITS = 24
_BASE, _WORD64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def plain(text: str) -> str:
    """NFKC, without hyphens before line breaks, in lower case."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _BREAK.sub("", text).lower().replace("\0", " ")


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the words of the texts with single blanks between them, text after text, each ended by 0."""
    codes = codes_of("\0".join(texts) + "\0")
    kinds = kind_table()[codes]
    word = (kinds == LETTER) | (kinds == MARK) | (kinds == DIGIT)
    end = codes == 0
    after = np.empty_like(word)
    after[0], after[1:] = False, word[:-1]
    keep = word | (after & ~end) | end
    out = np.where(word, codes, np.where(end, 0, 32))[keep].astype(np.uint32)
    ends = np.flatnonzero(out == 0)
    return out, np.concatenate([[0], ends[:-1] + 1])


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Polynomial hash of every q-gram, by doubling; q is a power of two."""
    h, size, power = codes.astype(np.uint64), 1, _BASE
    while size < q:
        if len(h) <= size:
            return np.empty(0, np.uint64)
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = (power * power) & _WORD64, size * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_size(min_words: int, edits: int) -> int:
    """The largest power of two, ``Q`` at most, that leaves several shared q-grams in the shortest passage."""
    q = Q
    while q > 2 and 2 * min_words - q * (edits + 1) < 4:
        q //= 2
    return q


class PassageIndex:
    """Q-grams of one block of evaluation items, with a bit filter in front of the sorted array."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q):
        self.q = q
        self.ids = np.array(ids, np.int64)
        codes, starts = word_codes([plain(t) for t in texts])
        self.codes, self.starts = codes, starts
        h = gram_hashes(codes, q)
        ends = np.append(starts[1:], len(codes)) - 1
        item = np.searchsorted(starts, np.arange(len(h)), "right") - 1
        at = np.arange(len(h)) - starts[item]
        inside = np.arange(len(h)) + q <= ends[item]
        h, self.item, self.at = h[inside], item[inside], at[inside]
        order = np.argsort(h, kind="stable")
        self.item, self.at = self.item[order], self.at[order]
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def words(self, i: int) -> list[str]:
        end = self.starts[i + 1] - 1 if i + 1 < len(self.starts) else len(self.codes) - 1
        return _decode(self.codes[self.starts[i] : end]).split()

    def search(self, texts: list[str], min_words: int, edits: int) -> Iterator[tuple[int, int]]:
        """(index of the text, index of the item) of each leak."""
        codes, starts = word_codes(texts)
        h = gram_hashes(codes, self.q)
        if not len(h) or not len(self.grams):
            return
        pos = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        g = np.minimum(np.searchsorted(self.grams, h[pos]), len(self.grams) - 1)
        hit = self.grams[g] == h[pos]
        pos, g = pos[hit], g[hit]
        if not len(pos):
            return
        n = self.first[g + 1] - self.first[g]
        total = int(n.sum())
        if total > STEP_HITS and len(texts) > 1:
            half = len(texts) // 2
            yield from self.search(texts[:half], min_words, edits)
            yield from ((half + i, k) for i, k in self.search(texts[half:], min_words, edits))
            return
        doc = np.searchsorted(starts, pos, "right") - 1
        parts = min(len(self.ids), -(-total // STEP_HITS))
        for part in range(parts):  # the counts of one item do not depend on another's
            lo, hi = part * len(self.ids) // parts, (part + 1) * len(self.ids) // parts
            found: list[tuple[np.ndarray, ...]] = []
            for at in range(0, len(pos), max(1, STEP_HITS // max(1, int(n.max())))):
                s = slice(at, at + max(1, STEP_HITS // max(1, int(n.max()))))
                m = n[s]
                post = np.repeat(self.first[g[s]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                keep = (self.item[post] >= lo) & (self.item[post] < hi) if parts > 1 else slice(None)
                found.append((np.repeat(doc[s], m)[keep], np.repeat(pos[s] - starts[doc[s]], m)[keep], post[keep]))
            yield from self._bands(codes, starts, *(np.concatenate(c) for c in zip(*found)), min_words, edits)

    def _bands(self, codes: np.ndarray, starts: np.ndarray, doc: np.ndarray, pos: np.ndarray, post: np.ndarray, min_words: int, edits: int) -> Iterator[tuple[int, int]]:
        item, diagonal = self.item[post], pos - self.at[post]
        width = max(1, 2 * edits)
        need = max(1, 2 * min_words - 1 + 1 - self.q * (edits + 1))
        seen = set()
        for shift in sorted({0, edits}):  # bands of 2e diagonals, twice, moved by e
            band = (diagonal + shift) // width
            order = np.lexsort((band, item, doc))
            d, i, b = doc[order], item[order], band[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])]))
            count = np.diff(np.append(new, len(d)))
            for k in np.flatnonzero(count >= need):
                key = (int(d[new[k]]), int(i[new[k]]))
                if key not in seen and self._verify(codes, starts, key, diagonal[order[new[k] : new[k] + count[k]]], min_words, edits):
                    seen.add(key)
                    yield key

    def _verify(self, codes: np.ndarray, starts: np.ndarray, key: tuple[int, int], diagonals: np.ndarray, min_words: int, edits: int) -> bool:
        """Whether ``min_words`` whole words in a row of the item stand in the text along the band's diagonals, but for ``edits`` characters."""
        d, i = key
        end = starts[d + 1] - 1 if d + 1 < len(starts) else len(codes) - 1
        own = self.starts[i + 1] - 1 if i + 1 < len(self.starts) else len(self.codes) - 1
        text, item = codes[starts[d] : end], self.codes[self.starts[i] : own]
        if not edits:
            return any(whole_words(text, item, x) >= min_words for x in np.unique(diagonals).tolist())
        return aligned(text, item, int(diagonals.min()) - edits, int(diagonals.max()) + edits, min_words, edits)


def whole_words(text: np.ndarray, item: np.ndarray, diagonal: int) -> int:
    """The most whole words in a row that text and item share where the item's start lies at ``diagonal`` of the text."""
    lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if hi <= lo:
        return 0
    x, y = np.concatenate([[32], item, [32]]), np.concatenate([[32], text, [32]])  # place p of the item is x[p + 1]
    p = np.arange(lo, hi)
    same = item[p] == text[p + diagonal]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    best = 0
    for a, b in zip(p[0] + edge[::2], p[0] + edge[1::2]):
        if b - a <= best:
            continue
        q = np.arange(a, b + 1)
        opens = (x[q] == 32) & (y[q + diagonal] == 32)  # a word may begin at q in both
        closes = (x[q + 1] == 32) & (y[q + diagonal + 1] == 32)  # a word may end before q in both
        first = np.flatnonzero(opens[:-1])
        if len(first):
            best = max(best, int(closes[first[0] + 1 :].sum()))
    return best


def aligned(text: np.ndarray, item: np.ndarray, low: int, high: int, min_words: int, edits: int) -> bool:
    """Whether a run of ``min_words`` of the item's words, with the blanks around it, is within ``edits`` edits of a stretch of the text that starts on a diagonal of the band.

    All runs are aligned at once: cost[r, b] is the least number of edits of
    run r's first k characters that ends on diagonal b. A step keeps the
    diagonal for a kept or changed letter, lowers it for a lost one and raises
    it for one put in.
    """
    x = np.concatenate([[32], item, [32]])
    blanks = np.flatnonzero(x == 32)
    if len(blanks) <= min_words:
        return False
    begin, length = blanks[:-min_words], blanks[min_words:] - blanks[:-min_words] + 1
    band = np.arange(low - edits, high + edits + 1)
    far = edits + 1
    y = np.concatenate([[32], text, [32]])
    cost = np.zeros((len(begin), len(band)), np.int64)
    for k in range(int(length.max())):
        p = np.minimum(begin + k, len(x) - 1)
        at = p[:, None] + band[None, :]
        letter = np.where((at >= 0) & (at < len(y)), y[np.clip(at, 0, len(y) - 1)], 1)
        new = cost + (letter != x[p][:, None])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        for b in range(1, len(band)):
            np.minimum(new[:, b], new[:, b - 1] + 1, out=new[:, b])
        cost = np.where((k < length)[:, None], np.minimum(new, far), cost)
        live = cost.min(1) <= edits
        if not live.any():
            return False
        begin, length, cost = begin[live], length[live], cost[live]
    return True


def _decode(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


_built: dict[str, PassageIndex] = {}


def _index(mark: str, shared, q: int) -> PassageIndex:
    """The worker's index of the broadcast items, built once; ``mark`` is the broadcast's own."""
    if mark not in _built:
        _built.clear()
        _built[mark] = PassageIndex([k for k, _ in shared.value], [t for _, t in shared.value], q)
    return _built[mark]


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, edits: int = 0) -> DataFrame:
    """(doc_key, item_key) of each document that holds at least ``min_words`` consecutive words of an item.

    Words are runs of letters, combining marks and digits after ``plain``.
    ``edits`` characters of the passage, or blanks in and around it, may be
    changed, lost or put in. Null and empty texts hold
    nothing; items of fewer words than ``min_words`` are never found; items and
    documents that occur twice count once. Items are broadcast in blocks of
    ``BLOCK_CHARS`` characters, each searched against all documents.
    """
    spark = docs.sparkSession
    d = spread(docs.select(F.col(doc_key), F.col(doc_text).alias("_text")).where(F.char_length("_text") >= 2 * min_words - 1))
    kinds = (docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString())
    rows = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull()).distinct()
    chars = rows.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    q = gram_size(min_words, edits)
    found = None
    for block in range(blocks):
        mine = sorted((r.k, r.t) for r in rows.where(F.col("b") == block).collect())
        shared = spark.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, mark=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(mark, shared, q)
            for b in batches:
                keys, texts, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
                step: list[str] = []
                at = size = 0
                for n, t in enumerate(texts, 1):
                    step.append(plain(t))
                    size += len(t)
                    if size >= STEP_CHARS or n == len(texts):
                        out += [(keys[at + x], int(index.ids[y])) for x, y in index.search(step, min_words, edits)]
                        at, size, step = n, 0, []
                types = [b.schema.field(0).type, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], []), types)], names=[doc_key, item_key])

        part = d.mapInArrow(run, f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"))


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """Per evaluation item the number of documents that hold a passage of it; items without leak have 0."""
    leaks = p9_found(spark, root).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = read_table(spark, root, "eval_items").select("item_id").distinct()
    return items.join(leaks, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
