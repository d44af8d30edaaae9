"""Encoding of a corpus by a byte-level BPE vocabulary through a tokenization automaton.

``compile_merges`` starts from the one-state automaton over all bytes and
applies one merge gadget per rule, in rank order. The gadget of ``u v -> w``
gives ``w`` an arc wherever ``u`` has one, splits the state behind ``u`` and
removes its arc ``v``. All arcs of one label lead to one state, so a state is
named by the token read last. A removed arc stays removed for the tokens made
of its ends later: for the states whose right spine leads to ``u`` by younger
rules, and the labels whose left spine leads to ``v`` by rules not older. With
tokens numbered along the tree of left parts, younger children first, those
labels are one interval; so each gadget is compiled to one interval of labels,
and the row of a state is the union of the intervals along its right spine. A
word is encoded from left to right over the trie of the labels: from every
position, which only one token reaches, the arcs of its state lead on. Decoding
emits the arc labels.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.session import spread
from quarto.sources.tables import read_table

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pre-split pattern that belongs to the vocabulary.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker; a full cache is emptied, which costs time and changes no result.
CACHE_WORDS = 400_000
#: Rows of the transition table that a worker keeps unpacked; there is one per token at most.
CACHE_ROWS = 8_192


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest is moved to 256 and up."""
    stay = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {chr(b): b for b in stay} | {chr(256 + i): b for i, b in enumerate(moved)}


def compile_merges(path: str = TOKENIZER_PATH) -> dict:
    """The compiled automaton as arrays of bounded size (the vocabulary's)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = byte_alphabet()
    vocab = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
    n = max(vocab.values()) + 1
    rank = np.full(n, -1, np.int64)  # of bytes: -1
    left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    gadgets: dict[tuple[int, int], int] = {}  # the first rule of a pair
    for r, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        u, v = vocab[bytes(back[c] for c in a)], vocab[bytes(back[c] for c in b)]
        w = vocab[bytes(back[c] for c in a + b)]
        if (u, v) not in gadgets:
            gadgets[u, v] = r
        if rank[w] < 0:
            rank[w], left[w], right[w] = r, u, v
    labels = [b""] * n
    for t, i in vocab.items():
        labels[i] = t
    # tokens along the tree of left parts, younger children first: position, end of the subtree
    children: list[list[int]] = [[] for _ in range(n)]
    for w in np.argsort(-rank, kind="stable").tolist():
        if left[w] >= 0:
            children[left[w]].append(w)
    place, end, at = [0] * n, [0] * n, 0
    for root in (t for t in vocab.values() if left[t] < 0):
        stack = [(root, False)]
        while stack:
            t, done = stack.pop()
            if done:
                end[t] = at
                continue
            place[t], at = at, at + 1
            stack.append((t, True))
            stack += [(c, False) for c in reversed(children[t])]
    # the labels that each gadget removes: v, and what was made of it by rules not older
    older = [[-int(rank[c]) for c in cs] for cs in children]
    cuts: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for (u, v), r in gadgets.items():
        young = bisect_right(older[v], -r)
        cuts[u].append((r, place[v], end[children[v][young - 1]] if young else place[v] + 1))
    counts = np.array([len(c) for c in cuts], np.int64)
    flat = np.array([x for c in cuts for x in sorted(c)], np.int64).reshape(-1, 3)
    return {"rank": rank, "right": right, "place": np.array(place, np.int64), "first": np.concatenate([[0], np.cumsum(counts)]), "gadgets": flat, "labels": labels}


class Automaton:
    """Table-driven encoder and decoder of one compiled vocabulary."""

    def __init__(self, compiled: dict):
        self.rank, self.right, self.place, self.first = (compiled[k].tolist() for k in ("rank", "right", "place", "first"))
        self.gadgets, self.labels = compiled["gadgets"], compiled["labels"]
        self.rows: dict[int, tuple[list[int], list[int]]] = {}
        self.ahead: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.token: dict[int, int] = {}
        size = 1
        for i, t in enumerate(self.labels):
            if not t or (len(t) > 1 and self.rank[i] < 0):
                continue
            node = 0
            for b in t:
                nxt = self.ahead.get(node << 8 | b)
                if nxt is None:
                    nxt = self.ahead[node << 8 | b] = size
                    size += 1
                node = nxt
            self.token[node] = i
        self.split = regex.compile(PRE_SPLIT).findall
        self.words: dict[str, list[int]] = {}

    def row(self, t: int) -> tuple[list[int], list[int]]:
        """The state behind ``t``: starts and ends of the intervals of labels that have no arc."""
        known = self.rows.get(t)
        if known is None:
            parts, until, x = [], 1 << 60, t
            while x >= 0:  # along the right spine, each token up to the rule that took it into the next
                g = self.gadgets[self.first[x] : self.first[x + 1]]
                parts.append(g[: np.searchsorted(g[:, 0], until), 1:])
                until, x = self.rank[x], self.right[x]
            cut = np.concatenate(parts)
            cut = cut[np.argsort(cut[:, 0], kind="stable")]
            reach = np.maximum.accumulate(cut[:, 1]) if len(cut) else cut[:, 1]
            new = np.flatnonzero(np.concatenate([[True], cut[1:, 0] > reach[:-1]])) if len(cut) else np.empty(0, int)
            known = cut[new, 0].tolist(), (reach[np.append(new[1:], len(cut)) - 1] if len(cut) else reach).tolist()
            if len(self.rows) >= CACHE_ROWS:
                self.rows.clear()
            self.rows[t] = known
        return known

    def arc(self, t: int, w: int) -> bool:
        """Whether the state behind token ``t`` has an arc ``w``."""
        starts, ends = self.row(t)
        p = self.place[w]
        k = bisect_right(starts, p) - 1
        return k < 0 or p >= ends[k]

    def word(self, text: str) -> list[int]:
        """Ids of one pre-split word."""
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        ahead, token, place = self.ahead, self.token, self.place
        for i in range(n):
            starts, ends = self.row(last[i]) if i else ((), ())
            node, j = 0, i
            while j < n:
                node = ahead.get(node << 8 | data[j])
                if node is None:
                    break
                j += 1
                if last[j] < 0:  # exactly one token reaches each position
                    t = token.get(node)
                    if t is not None:
                        k = bisect_right(starts, place[t]) - 1
                        if k < 0 or place[t] >= ends[k]:
                            last[j], start[j] = t, i
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text has none."""
        if not text:
            return []
        words, out, pending = self.words, [], ""
        if len(words) > CACHE_WORDS:
            words.clear()
        # A blank between two other signs always starts a word, so such pieces are encoded apart.
        first = True
        for piece in text.split(" "):
            if first:
                pending, first = piece, False
                continue
            if piece and pending and not piece[0].isspace() and not pending[-1].isspace():
                out.append(pending)
                pending = " " + piece
            else:
                pending = pending + " " + piece
        out.append(pending)
        ids: list[list[int]] = []
        for piece in out:
            known = words.get(piece)
            if known is None:
                known = []
                for w in self.split(piece):
                    x = words.get(w)
                    if x is None:
                        x = self.word(w)
                        if len(w) < 64:
                            words[w] = x
                    known += x
                if len(piece) < 64:
                    words[piece] = known
            ids.append(known)
        return list(chain.from_iterable(ids))

    def decode(self, ids: list[int]) -> str:
        """Emits the arc labels along the path."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


_built: dict[str, Automaton] = {}


def _automaton(mark: str, shared) -> Automaton:
    """The worker's automaton, built once; ``mark`` is the broadcast's own."""
    if mark not in _built:
        _built.clear()
        _built[mark] = Automaton(shared.value)
    return _built[mark]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER_PATH) -> DataFrame:
    """(key, ids array<int>): one row per row of ``df``.

    Null and empty texts give an empty list, blank texts the ids of their white
    space. The vocabulary is read on the driver from ``path`` and broadcast; its
    size is fixed by the tokenizer, not by the data.
    """
    spark = df.sparkSession
    shared, mark = spark.sparkContext.broadcast(compile_merges(path)), uuid.uuid4().hex
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _automaton(mark, shared).encode
        for b in batches:
            lists = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return spread(df.select(F.col(key), F.col(text).alias("_text"))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = TOKENIZER_PATH) -> DataFrame:
    """(key, text): the text of each list of ids; a null list gives null."""
    shared, mark = df.sparkSession.sparkContext.broadcast(compile_merges(path)), uuid.uuid4().hex
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _automaton(mark, shared).decode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decode(x) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids).alias("_ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_corpus(read_table(spark, root, "documents"))


QUERIES = {"p8_ids": p8_ids}
