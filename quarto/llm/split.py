"""Splitting of items larger than a limit at natural boundaries, with overlap.

Word offsets are prefix sums over the text; boundaries (paragraph, line,
sentence) are one sorted array of word positions each. A piece ends at the last
boundary under the limit, found by binary search, best kind first; a better
kind in the first half of the window yields to a lesser one in the second. The
next piece starts the wished number of words earlier. Only where no boundary
lies under the limit and beyond the piece before the cut is hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.sources.tables import read_table

MAX_WORDS, MAX_CHARS, OVERLAP = 500, 4000, 40
_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?।…][\"'”’»)\]]*$")
PIECE = "piece_no int, start_char int, end_char int, words int, chars int, cut string, text string"


def split_text(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, words, cut) of each piece of a text; one piece ``whole`` if it keeps the limits, none if blank.

    No piece has more than ``max_words`` words or ``max_chars`` code points,
    the pieces cover every word in order, and each piece starts with the last
    ``overlap`` words of the one before (fewer only where a piece would not get
    beyond it, none within a word that is itself cut).
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    # A word longer than the limit is cut hard into parts that count as words; parts[i]: it goes on.
    starts, ends, broken = [], [], []
    for a, b in spans:
        while b - a > max_chars:
            starts.append(a), ends.append(a + max_chars), broken.append(True)
            a += max_chars
        starts.append(a), ends.append(b), broken.append(False)
    n = len(starts)
    if not n:
        return []
    if len(spans) <= max_words and len(text) <= max_chars:
        return [(0, len(text), n, "whole")]
    s, e = np.array(starts), np.array(ends)
    gaps = [text[ends[i] : starts[i + 1]] for i in range(n - 1)]
    kinds = {
        "paragraph": np.array([i + 1 for i, g in enumerate(gaps) if g.count("\n") > 1], int),
        "line": np.array([i + 1 for i, g in enumerate(gaps) if "\n" in g], int),
        "sentence": np.array([i + 1 for i, g in enumerate(gaps) if _SENTENCE.search(text, max(starts[i], ends[i] - 8), ends[i])], int),
    }
    words_before = np.concatenate([[0], np.cumsum(~np.array(broken))])
    out, at, reached = [], 0, 0
    while True:
        # last end under both limits: prefix sums of words, then of characters
        by_words = int(np.searchsorted(words_before, words_before[at] + max_words, "right")) - 1
        by_chars = int(np.searchsorted(e, s[at] + max_chars, "right"))
        end, cut = min(by_words, by_chars, n), "hard"
        if end >= n:
            out.append((int(s[at]), int(e[n - 1]), n - at, "end"))
            return out
        last = {}
        for kind, places in kinds.items():
            k = int(np.searchsorted(places, end, "right")) - 1
            if k >= 0 and places[k] > reached:
                last[kind] = int(places[k])
        if last:  # the best kind in the second half of the window, else the last boundary of any kind
            half = at + max(1, (end - at) // 2)
            cut = next((kind for kind in last if last[kind] >= half), max(last, key=last.get))
            end = last[cut]
        out.append((int(s[at]), int(e[end - 1]), end - at, cut))
        back = end
        while back > at + 1 and end - back < overlap and not broken[back - 1]:
            back -= 1
        # the next piece must get beyond this one
        while back < end and (e[end] - s[back] > max_chars or words_before[end + 1] - words_before[back] > max_words):
            back += 1
        at, reached = back, end


def split_oversized(df: DataFrame, key: str, text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, only_oversized: bool = True) -> DataFrame:
    """(key, piece_no, start_char, end_char, words, chars, cut, text) of every item larger than the limit.

    An item is larger if it has more than ``max_words`` words (separated by
    white space) or ``max_chars`` code points. With ``only_oversized=False`` the
    other items come out too, as one piece. Items without a word have no piece
    but for blank ones that are too long, which give one piece of no words. Null
    texts have none. A key that occurs again with the same text counts once.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    if only_oversized:  # max_words + 1 words need at least 2 * max_words + 1 characters
        rows = rows.where((F.char_length("_text") > max_chars) | (F.char_length("_text") > 2 * max_words))
    rows = rows.withColumn("_h", F.xxhash64("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for k, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                pieces = split_text(t, max_words, max_chars, overlap)
                if not pieces and len(t) > max_chars:
                    pieces = [(0, 0, 0, "blank")]
                if only_oversized and len(pieces) == 1 and pieces[0][3] == "whole":
                    continue
                for i, (x, y, w, cut) in enumerate(pieces):
                    for c, v in zip(cols, (k, h, i, x, y, w, y - x, cut, t[x:y])):
                        c.append(v)
            types = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "_h", "piece_no", "start_char", "end_char", "words", "chars", "cut", "text"])

    out = rows.mapInArrow(run, f"`{key}` {kind}, _h long, {PIECE}")
    return out.dropDuplicates([key, "_h", "piece_no"]).drop("_h")


def p6_pieces(spark: SparkSession, root: str) -> DataFrame:
    chunks = read_table(spark, root, "article_chunks").withColumnRenamed("id", "chunk_id")
    return split_oversized(chunks, "chunk_id", "raw_text")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_pieces(spark, root).select("chunk_id").distinct()


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
ORACLE = {
    "p6_found": r"""select distinct id as chunk_id from article_chunks
        where length(raw_text) > 4000 or length(regexp_replace(trim(regexp_replace(raw_text, '\s+', ' ', 'g')), '[^ ]', '', 'g')) + 1 > 500""",
}
