"""Per-document text statistics, and running prose told from lists, tables and junk.

Tables and lists show in the layout: delimiters that stand in the same columns
of neighbouring lines, a common number of cells, item marks, a period of the
indentation, and a rhythm of the line lengths. These signs are combined with
word, symbol, punctuation and common-word ratios by an additive model over
their steps, fitted on the labels at hand when the query runs; a rule stands in
where labels are few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.llm.sampling import sampled
from quarto.llm.textcodes import DIGIT, LETTER, MARK, NUMBER, OTHER, PUNCT, SPACE, SYMBOL, codes_of, kind_table
from quarto.session import spread
from quarto.sources.tables import read_table

# Frequent function words of the archive's languages.
COMMON = (
    "the of and to in a that was for on with as by it at from is be were had have has not or which an but who they this their he she his her its are been will would there when what said more than into over only also other if up out no all can may".split()
    + "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split()
    + "le les des et en du un une est pour dans qui que pas sur plus par je avec tout au ce sont il elle mais ou son sa ses nous vous même aux cette comme très sans deux où après été ont leur se était aussi depuis entre ne d'un on".split()
    + "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde".split()
    + "के में है की को का से और कि पर ने यह हैं एक भी था इस नहीं या हो कर तो जो ही थे वह थी लिए अपने कहा गया साथ बाद हुए तक किया रहे उन वे जा".split()
)
_COMMON = frozenset(w + e for w in COMMON for e in ("", ",", ".", "?", "!", "।", ";", ":"))
_GAP = re.compile(r"\t| {2,}|\s*\|\s*|;")
_NUMERIC = re.compile(r"[+-]?[\d.,:/]*\d[\d.,:/]*%?$|[-–—]$")
_ITEM = re.compile(r"\s*(?:[-*•·–▪‣◦]\s|\(?\d{1,3}[.):]\s|\d{1,2}:\d\d\b|[a-zA-Z][.)]\s)")
_LEADER = re.compile(r"(?:\.{3,}|…)\s*\d+\s*$")
_SENTENCE_END = ".!?।…\"'”’»)"
STATS = [
    ("words", "int"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("punctuated_line_share", "double"), ("common_word_share", "double"),
    ("lines", "int"), ("aligned_share", "double"), ("numeric_cell_share", "double"), ("item_share", "double"), ("line_autocorrelation", "double"), ("distinct_word_share", "double"), ("indent_periodicity", "double"), ("inline_list_share", "double"), ("kind", "string"),
]
KINDS = ["prose", "list", "table", "junk"]
#: Labelled documents that the model is fitted on, by the hash of their key; steps per statistic, lags looked at.
LABELS, STEPS, LAGS = 20_000, 8, 6
#: Log-odds that the rule gives its kind before any label, and the weight that holds the model back.
TRUST, RIDGE, ROUNDS = 3.0, 0.5, 400


def _periodicity(x: np.ndarray) -> float:
    """Highest correlation of a sequence with itself 1 to LAGS places on; 0 for under four values, 1 for equal ones."""
    if len(x) < 4:
        return 0.0
    y = x - x.mean()
    v = float((y * y).sum())
    return 1.0 if v == 0 else max(float((y[k:] * y[:-k]).sum() / v) * len(y) / (len(y) - k) for k in range(1, min(LAGS, len(y) // 2) + 1))


def layout(lines: list[str]) -> tuple[float, float, float, float, float]:
    """(aligned, numeric cells, items, rhythm of line lengths, indentation period) of the lines that are not blank."""
    n = len(lines)
    if n < 2:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    edges, cells, numeric, items = [], [], 0, 0
    total = 0
    for line in lines:
        ends = [m.end() for m in _GAP.finditer(line.strip("| "))]
        edges.append(ends)
        parts = [c for c in _GAP.split(line) if c]
        if len(parts) < 3:
            parts = line.split()
        cells.append(len(ends))
        total += len(parts)
        numeric += sum(1 for c in parts if _NUMERIC.match(c))
        items += bool(_ITEM.match(line) or _LEADER.search(line))
    aligned = 0
    for a, b, k, m in zip(edges, edges[1:], cells, cells[1:]):
        if k >= 2 and m >= 2:
            aligned += k == m or len(set(a) & set(b)) * 2 >= min(k, m)
    lengths = np.array([len(x) for x in lines], float)
    indents = [len(x) - len(x.lstrip()) for x in lines]
    indents = np.array(indents, float)
    period = _periodicity(indents) if indents.any() and np.ptp(indents) else 0.0
    return aligned / (n - 1), numeric / max(1, total), items / n, _periodicity(lengths), period


def kind_of(words: int, mean_length: float, symbols: float, punctuated: float, common: float, lines: int, aligned: float, numeric: float, items: float, distinct: float, inline: float) -> str:
    """``prose``, ``table``, ``list`` or ``junk`` by a rule, which the model starts from."""
    if lines >= 3 and (aligned >= 0.5 or numeric >= 0.4) and common < 0.2:
        return "table"
    if lines >= 3 and items >= 0.5 and common < 0.2:
        return "list"
    if symbols > 0.15 or mean_length > 25 or (words >= 20 and distinct < 0.12):
        return "junk"
    if common >= 0.14 or words < 4:
        return "prose"
    if inline >= 0.3 or (lines >= 4 and punctuated < 0.3):
        return "list"
    return "junk"


def text_statistics(texts: list[str]) -> list[tuple]:
    """The ``STATS`` of each text that has a word."""
    codes = codes_of("\0".join(texts) + "\0")
    kinds = kind_table()[codes]
    ends = np.flatnonzero(codes == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    odd = (kinds == SYMBOL) | (kinds == OTHER) | ((kinds == PUNCT) & np.isin(codes, np.frombuffer("\\|/#*_§¶[]{}@^~<>•▪".encode("utf-32-le"), np.uint32))) | (codes == 0x7C)
    odd &= codes != 0
    solid = (kinds != SPACE) & (codes != 0)
    sums = lambda m: np.add.reduceat(m, starts)
    n_odd, n_solid = sums(odd.astype(np.int64)), sums(solid.astype(np.int64))
    out = []
    for t, o, s in zip(texts, n_odd.tolist(), n_solid.tolist()):
        low = t.lower().split()
        n = len(low)
        lines = [x for x in t.splitlines() if x.strip()]
        ended = sum(x.rstrip()[-1] in _SENTENCE_END for x in lines)
        common = sum(map(_COMMON.__contains__, low)) / n
        slashes = sum(w in ("/", "·", "|", "•") for w in low) + sum(w[-1] in ",;" for w in low)
        feats = layout(lines)
        mean, sym, punct, distinct, inline = s / n, o / max(1, s), ended / len(lines), len(set(low)) / n, slashes / n
        kind = kind_of(n, mean, sym, punct, common, len(lines), feats[0], feats[1], feats[2], distinct, inline)
        out.append((n, mean, sym, punct, common, len(lines), feats[0], feats[1], feats[2], feats[3], distinct, feats[4], inline, kind))
    return out


def _matrix(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, number of the rule's kind) of ``text_statistics`` rows."""
    return np.array([r[:-1] for r in rows], float).reshape(len(rows), len(STATS) - 1), np.array([KINDS.index(r[-1]) for r in rows], int)


class KindModel:
    """Softmax over the steps of each statistic, with the rule's kind as offset."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray):
        self.cuts, self.weights = cuts, weights

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") + j * STEPS for j, c in enumerate(self.cuts)], 1)

    def scores(self, x: np.ndarray, rule: np.ndarray) -> np.ndarray:
        out = self.weights[self.cells(x)].sum(1)
        out[np.arange(len(x)), rule] += TRUST
        return out

    def kinds(self, x: np.ndarray, rule: np.ndarray) -> list[str]:
        return [KINDS[k] for k in self.scores(x, rule).argmax(1).tolist()] if len(x) else []


def fit_kinds(rows: list[tuple], labels: list[str]) -> KindModel:
    """The model of ``text_statistics`` rows and their labels; with no labels it is the rule."""
    x, rule = _matrix(rows)
    gold = np.array([KINDS.index(k) for k in labels], int)
    quantiles = np.arange(1, STEPS) / STEPS
    model = KindModel([np.quantile(x[:, j], quantiles) if len(x) else np.zeros(STEPS - 1) for j in range(x.shape[1])], np.zeros((x.shape[1] * STEPS, len(KINDS))))
    if not len(x):
        return model
    cells = model.cells(x)
    hot = np.zeros((len(x), len(model.weights)))
    np.put_along_axis(hot, cells, 1.0, 1)
    target = np.eye(len(KINDS))[gold]
    step = 1.0 / (0.5 * x.shape[1] + RIDGE / len(x))
    ahead, before = model.weights, model.weights
    for i in range(ROUNDS):  # accelerated gradient descent of a convex loss
        model.weights = ahead
        z = model.scores(x, rule)
        z = np.exp(z - z.max(1, keepdims=True))
        new = ahead - step * (hot.T @ (z / z.sum(1, keepdims=True) - target) + RIDGE * ahead) / len(x)
        ahead, before = new + i / (i + 3) * (new - before), new
    model.weights = before
    return model


def quality_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", model: KindModel | None = None) -> DataFrame:
    """(key, ``STATS``): one row per row of ``df``; the kind is the model's, or the rule's without one.

    Null, empty and blank texts have 0 words and lines, null elsewhere. The
    symbol ratio is of the characters that are not white space.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model and (model.cuts, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = KindModel(*shared.value) if shared.value else None
        for b in batches:
            texts = [(t or "").replace("\0", " ") for t in b.column(1).to_pylist()]
            full = [i for i, t in enumerate(texts) if t and not t.isspace()]
            rows: list[tuple] = [(0, None, None, None, None, 0) + (None,) * 8] * len(texts)
            if full:
                found = text_statistics([texts[i] for i in full])
                kinds = fitted.kinds(*_matrix(found)) if fitted else [r[-1] for r in found]
                for i, r, k in zip(full, found, kinds):
                    rows[i] = (*r[:-1], k)
            types = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
            cols = [pa.array(c, types[k]) for c, (_, k) in zip(zip(*rows) if rows else [()] * len(STATS), STATS)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *(n for n, _ in STATS)])

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} {k}" for n, k in STATS)
    return spread(df.select(F.col(key), F.col(text).alias("_text"))).mapInArrow(run, schema)


def fitted_kinds(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> KindModel:
    """The model fitted on LABELS labelled documents at most; documents without words, other labels and contradicting ones are left out."""
    few = labels.where(F.col("kind").isin(*KINDS) & F.col(key).isNotNull()).groupBy(key).agg(F.min("kind").alias("label"), F.max("kind").alias("other"))
    few = sampled(few.where("label = other").select(key, "label"), key, LABELS)
    # LABELS keys at most are broadcast
    known = quality_statistics(docs.join(F.broadcast(few.select(key)), key, "left_semi").select(key, text), key, text).where("words > 0").dropDuplicates([key])
    rows = known.join(few, key).select(*(n for n, _ in STATS), "label").orderBy(F.xxhash64(key), key).collect()
    return fit_kinds([tuple(r)[:-1] for r in rows], [r["label"] for r in rows])


def p10_stats(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    return quality_statistics(docs, model=fitted_kinds(docs, read_table(spark, root, "doc_labels")))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_stats(spark, root).where("kind <> 'prose'").select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_stats": p10_stats}
