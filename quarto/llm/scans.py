"""Noise in text from scanned pages: found, named and repaired.

An averaged-perceptron editor predicts one operation for each character of a
word (keep, delete, replace by one or two letters, insert a letter after it) and
for each hyphen-like sign at a line end (join the lines or keep it). It is
trained on frequent words of the corpus itself, as they stand and with scanning
confusions put in, on cut words and on words that the corpus hyphenates. Every
distinct word of the corpus is edited once; a word counts as misread if it
holds a sign that no frequent word has, or if the editor turns it into a word
that the corpus has far more often. Running headers and page numbers are told
by their parts (paper, date, section, page) and by a perceptron of the place on
the page, trained on the corpus' own lines of such parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarto.llm.canonical import CONFUSED, edit_cost
from quarto.llm.sampling import sampled
from quarto.llm.textcodes import DATE_WORDS
from quarto.session import ensure_checkpoint_dir, spread
from quarto.sources.tables import read_table

#: Words and hyphenated words that the editor is trained on, by the hash of the word; how often a frequent word occurs at least.
TRAIN_WORDS, TRAIN_COMPOUNDS, FREQUENT, EPOCHS, BUCKETS = 12_000, 3_000, 5, 4, 1 << 16
#: Items with a box that the place on the page is learned from, by the hash of their id.
TRAIN_ITEMS = 20_000
#: Names of papers and sections that are broadcast; longer lists are refused.
MAX_NAMES = 20_000
#: Bits of the filter of misread words that is broadcast; more words than it can tell apart cost time, not results.
FILTER_BITS = 24
#: Share of the characters of frequent words that are kept by less than what counts as a close choice.
CLOSE = 0.15
#: Corrupted words trained on, at least, so that a small vocabulary is seen often enough.
NOISY_SAMPLES = 8_000
#: A misread word is at most so often as a share of the word it stands for.
SHARE, MISREAD = 0.05, 3
HYPHENS = "-‐‑­¬"
_MARKS = "\u0300-\u036f\u0900-\u0963\u0970-\u097f"  # combining signs, which re does not count as letters
_JOIN = re.compile(rf"(?:(?<=[^\W\d_])|(?<=[{_MARKS}]))[{HYPHENS}][ \t]*\r?\n[ \t]*(?=[^\W\d_]|[{_MARKS}])")
_LAST, _FIRST = re.compile(rf"(?:[^\W\d_]|[{_MARKS}])+$"), re.compile(rf"(?:[^\W\d_]|[{_MARKS}])+")
_COMPOUND = re.compile(rf"(?:[^\W\d_]|[{_MARKS}])+-(?:[^\W\d_]|[{_MARKS}])+")
_WORD = re.compile(r"[^\s.,;:?\"()\[\]{}«»“”„।…*·•—–―‐‑¬/&+=<>_^~#-]+")
_PAGE = re.compile(r"^\W*(?:(?:page|pg|p|seite|página|pág|p\.)\W{0,2})?(\d{1,3})(?:\s*(?:/|of|von|de)\s*\d{1,3})?\W*$", re.I)
# Single signs that scanning confuses.
SINGLES = [("o", "0"), ("l", "1"), ("s", "5"), ("b", "8"), ("i", "!"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("g", "q"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("i", "l"), ("l", "i"), ("y", "v"), ("न", "ऩ"), ("ा", "|"), ("ब", "व"), ("व", "ब"), ("भ", "म"), ("म", "भ"), ("घ", "ध"), ("ध", "घ"), ("ि", "ी"), ("प", "ष"), ("य", "थ"), ("थ", "य"), ("र", "स")]
#: Signs that stand for letters in misread words; ordinals and the like, whose digits are meant.
UNREAD = frozenset("01!58|�©")
STANDS_FOR = [str.maketrans("01!58|©", "ol" + i + "sb" + j + "e") for i, j in ("il", "li", "ll", "ii")] + [str.maketrans("01!58|", "oiisbi")]
_MEANT = re.compile(r"\d+(?:st|nd|rd|th|er|e|s|º|ª|o|a|\.)?$|\d{2}")
_DATES = frozenset(DATE_WORDS.split())
# Nearly every line of running text has a word in small letters; of a header only dates, page words and names may be.
_SMALL = re.compile(r"(?<![\w!|'’])[a-zß-öø-ÿ]{3,}")
# Words beside page numbers.
_PAGE_WORD = {"page", "pg", "p", "no", "vol", "seite", "página", "edition"}


_clean_words: dict[str, str] = {}


def cleaned(word: str) -> str:
    """A token as a word: without signs at its ends; empty for numbers and signs alone."""
    known = _clean_words
    c = known.get(word)
    if c is None:
        if len(known) > 1_000_000:
            known.clear()
        c = word.strip("'’|!`")
        if len(c) < 2 or c.isdecimal() or not any(x.isalpha() for x in c):
            c = ""
        known[word] = c
    return c


def words_of(text: str) -> list[str]:
    """Lower-case words of a text whose cut words are joined; numbers and signs alone are none."""
    return [c for w in _WORD.findall(_JOIN.sub("", text).lower()) if (c := cleaned(w))]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``text``, counted per batch before they are shuffled. Words hyphenated within a line count beside their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: Counter = Counter()
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                low = _JOIN.sub("", t).lower()
                raw.update(_WORD.findall(low))
                if "-" in low:
                    n.update(_COMPOUND.findall(low))
            for w, k in raw.items():
                if c := cleaned(w):
                    n[c] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Editor:
    """Averaged perceptron over hashed character contexts."""

    def __init__(self, ops: list[str], alphabet: set[str], weights: np.ndarray | None = None, close: float = 0.0):
        self.ops, self.alphabet, self.close = ops, alphabet, close
        self.weights = weights if weights is not None else np.zeros((BUCKETS, len(ops)), np.float32)

    @staticmethod
    def features(words: list[str], evidence: list[int] | None = None) -> np.ndarray:
        """(characters, templates): hashed contexts of each character of the words, one word after another.

        ``evidence`` tells of each word whether the corpus has its parts more
        often joined (1) or hyphenated (2); 0, or no list, where it is not known.
        """
        pad = "\x02\x02\x02"
        codes = np.array([ord(c) for w in words for c in pad + w + pad], np.uint64)
        inside = np.concatenate([np.concatenate([np.zeros(3, bool), np.ones(len(w), bool), np.zeros(3, bool)]) for w in words]) if words else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        c = {k: codes[at + k] for k in range(-3, 4)} if len(at) else {k: codes[:0] for k in range(-3, 4)}
        spans = [(0,), (-1, 0), (0, 1), (-1, 0, 1), (-2, -1, 0), (0, 1, 2), (-2, -1, 0, 1), (-1, 0, 1, 2), (-2, -1, 0, 1, 2), (-3, -2, -1, 0), (0, 1, 2, 3), (-3, -2, -1, 0, 1, 2, 3)]
        out = np.empty((len(at), len(spans) + 1), np.int64)
        known = np.repeat(np.array(evidence if evidence is not None else [0] * len(words), np.int64), [len(w) for w in words])
        out[:, -1] = np.where(codes[at] == ord("-"), 1 + known, 0) if len(at) else 0
        for j, span in enumerate(spans):
            h = np.full(len(at), j + 1, np.uint64)
            for k in span:
                h = (h ^ c[k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, j] = (h % np.uint64(BUCKETS)).astype(np.int64)
        return out

    def scores(self, words: list[str], evidence: list[int] | None = None) -> np.ndarray:
        """(characters, operations)."""
        f = self.features(words, evidence)
        return np.concatenate([self.weights[f[i : i + 20_000]].sum(1) for i in range(0, len(f), 20_000)]) if len(f) else np.zeros((0, len(self.ops)), np.float32)

    def apply(self, word: str, ops: list[int]) -> str:
        return "".join(c if o == 0 else c + self.ops[o][2:] if self.ops[o][0] == "I" else self.ops[o][2:] for c, o in zip(word, ops))

    def candidates(self, words: list[str]) -> list[list[tuple[str, bool]]]:
        """(form, letters only lost) of each word's possible repairs: the predicted one, and ones with the closest choice made otherwise.

        A sign that no frequent word has is not kept. A choice counts as close
        that is made by less than ``close``; a word without any has no repair.
        The corpus decides between the forms.
        """
        out, at = [], 0
        scores = self.scores(words)
        first = scores.argmax(1) if len(scores) else np.zeros(0, np.int64)
        margin = -np.diff(np.partition(scores, -2, axis=1)[:, -2:], axis=1)[:, 0] if scores.shape[1] > 1 else np.zeros(len(scores))
        margin = np.abs(margin)
        second = np.argpartition(scores, -2, axis=1)[:, -3:] if scores.shape[1] > 2 else np.zeros((len(scores), 0), np.int64)
        for w in words:
            s, ops = scores[at : at + len(w)], first[at : at + len(w)].tolist()
            unread = [k for k, c in enumerate(w) if c in UNREAD]
            for k in unread:
                if ops[k] == 0 and s.shape[1] > 1:
                    ops[k] = 1 + int(s[k, 1:].argmax())
            forms: dict[str, bool] = {}
            for table in STANDS_FOR if unread else ():
                forms[w.translate(table)] = False
            if unread and not UNREAD & set(w.translate(STANDS_FOR[0])):  # signs read as letters, then edited
                for form, _ in self.candidates([w.translate(STANDS_FOR[0])])[0]:
                    forms[form] = False
            by = margin[at : at + len(w)]
            near = sorted((k for k in range(len(w)) if ops[k] or by[k] < self.close), key=by.__getitem__)
            if near:
                tries = [ops]
                for k in near[:3]:
                    tries += [[*ops[:k], int(o), *ops[k + 1 :]] for o in second[at + k] if o != ops[k]]
                other = {k: next((int(o) for o in second[at + k][np.argsort(-s[k, second[at + k]])] if o != ops[k]), ops[k]) for k in near[:3]}
                tries += [[other[k] if k in pair else o for k, o in enumerate(ops)] for pair in combinations(other, 2)]
                for t in tries:
                    form = self.apply(w, t)
                    if form != w and len(form) > 1:
                        forms.setdefault(form, all(o == 0 or self.ops[o][0] == "I" for o in t))
            out.append(list(forms.items()))
            at += len(w)
        return out

    def odd(self, word: str) -> bool:
        """Whether the word holds a sign that no frequent word has."""
        return not self.alphabet.issuperset(word)

    def joins(self, cuts: list[tuple[str, str]], evidence: list[int] | None = None) -> list[bool]:
        """Whether the line-join operation is predicted between the two parts of each cut word."""
        words = [left[-3:] + "-" + right[:3] for left, right in cuts]
        best = self.scores(words, evidence).argmax(1) if words else np.zeros(0, int)
        ends = np.cumsum([len(w) for w in words]) - [len(r[:3]) for _, r in cuts] - 1 if words else []
        return [self.ops[int(best[k])] == "J:" for k in ends]


NARROW = "iltfrj"


def _noisy(word: str, rng: np.random.Generator) -> tuple[str, list[str]] | None:
    """The word with one or two confusions put in, and the operation that undoes it at each character."""
    chars: list[tuple[str, str]] = [(c, "K:") for c in word]
    done = False
    for _ in range(int(rng.integers(1, 3))):
        choices = []
        for clean, noise in [*SINGLES, *[(b, a) for a, b in CONFUSED], *CONFUSED]:
            k = word.find(clean)
            while k >= 0:
                if all(o == "K:" for _, o in chars[k : k + len(clean)]) and len(chars) == len(word):
                    choices.append((k, clean, noise))
                k = word.find(clean, k + 1)
        lost = [k for k in range(1, len(word)) if (word[k] in NARROW or word[k] == word[k - 1]) and len(word) > 4]
        if lost and not done and rng.random() < 0.1:  # a narrow or doubled letter is lost
            k = lost[int(rng.integers(len(lost)))]
            chars[k - 1 : k + 1] = [(word[k - 1], "I:" + word[k])]
            done = True
            break
        if not choices:
            break
        k, clean, noise = choices[int(rng.integers(len(choices)))]
        chars[k : k + len(clean)] = [(noise[0], "R:" + clean)] + [(n, "D:") for n in noise[1:]]
        done = True
        if len(noise) != len(clean):
            break
    return ("".join(c for c, _ in chars), [o for _, o in chars]) if done else None


def train_editor(counts: DataFrame, seed: int = 7) -> Editor:
    """The editor for a corpus whose word counts are given; at most TRAIN_WORDS words reach the driver."""
    frequent = counts.where(F.col("n") >= FREQUENT).where(~F.col("word").rlike(r"[0-9!|�©]") & (F.length("word") < 40))
    compounds = [r["word"] for r in sampled(frequent.where(F.col("word").contains("-")), "word", TRAIN_COMPOUNDS).collect()]
    frequent = frequent.where(~F.col("word").contains("-"))
    words = [r["word"] for r in sampled(frequent, "word", TRAIN_WORDS).collect()]
    letters = frequent.select(F.explode(F.split("word", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).where(F.length("c") == 1)
    letters = letters.checkpoint()
    total = letters.agg(F.sum("n")).first()[0] or 1
    # at most half a million signs can have such a share
    alphabet = {r["c"] for r in letters.where(F.col("n") >= total * 2e-6).collect() if (r["c"].isalpha() or unicodedata.category(r["c"])[0] == "M" or r["c"] in "'’")} | {"'", "’", "-"}
    rng = np.random.default_rng(seed)
    samples: list[tuple[str, list[str]]] = []
    variants = min(60, max(3, NOISY_SAMPLES // max(1, len(words))))
    cuts = max(1, variants // 6)
    evidence: list[int] = []
    for w in words:
        samples.append((w, ["K:"] * len(w)))
        for _ in range(variants):
            if (x := _noisy(w, rng)) and x[0] != w:
                samples.append(x)
        evidence += [0] * (len(samples) - len(evidence))
        for _ in range(cuts if len(w) > 5 else 0):
            k = int(rng.integers(2, len(w) - 2))
            left, right = w[:k][-3:], w[k:][:3]
            samples.append((left + "-" + right, ["K:"] * len(left) + ["J:"] + ["K:"] * len(right)))
            evidence.append(int(rng.random() < 0.6))  # at times unknown, so that the context counts too
    for w in compounds * cuts:
        left, _, right = w.partition("-")
        w = left[-3:] + "-" + right[:3]
        samples.append((w, ["K:"] * len(w)))
        evidence.append(2 if rng.random() < 0.6 else 0)
    tally = Counter(o for _, ops in samples for o in ops)
    names = ["K:"] + sorted(o for o in tally if o != "K:")
    number = {o: i for i, o in enumerate(names)}
    editor = Editor(names, alphabet)
    if not samples:
        return editor
    w, total_w, steps = editor.weights, np.zeros_like(editor.weights), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), 500):
            part = [samples[i] for i in order[at : at + 500]]
            f = Editor.features([x for x, _ in part], [evidence[i] for i in order[at : at + 500]])
            gold = np.array([number[o] for _, ops in part for o in ops])
            guess = w[f].sum(1).argmax(1)
            steps += 1
            wrong = np.flatnonzero(guess != gold)
            if len(wrong):
                for sign, op in ((1.0, gold), (-1.0, guess)):
                    cells = f[wrong], np.broadcast_to(op[wrong, None], f[wrong].shape)
                    np.add.at(w, cells, sign)
                    np.add.at(total_w, cells, sign * steps)
    editor.weights = w - total_w / max(1, steps)
    if len(names) > 1:
        top = np.partition(editor.scores(words[:2000]), -2, axis=1)[:, -2:]
        editor.close = float(np.quantile(np.abs(top[:, 1] - top[:, 0]), CLOSE))
    return editor


class Furniture:
    """Running headers and page numbers of the archive's papers."""

    def __init__(self, papers: list[str], sections: list[str], margins: np.ndarray | None = None):
        self.margins = margins
        split = lambda x: [w for w in re.findall(r"\w+", x.lower()) if w not in ("the", "and")]
        self.papers = [split(p) for p in papers]
        self.kinds = {p[-1] for p in self.papers if p}
        self.sections = {w for s in sections for w in split(s)}
        self.small = _DATES | _PAGE_WORD | self.sections | {w for p in self.papers for w in p} | {"the", "and", "von", "der", "del", "les", "des"}
        self.near = lru_cache(200_000)(self._near)
        self.title = lru_cache(200_000)(self._title)

    @staticmethod
    def folio(line: str) -> bool:
        return bool(_PAGE.match(line))

    @staticmethod
    def _clean(token: str) -> str:
        return token.lower().translate(str.maketrans("01!58|", "olisbl")).replace("?", "�")

    def _near(self, token: str, among: str) -> bool:
        t = self._clean(token)
        if among == "date":
            return t in _DATES or (len(t) > 2 and any(abs(len(t) - len(k)) <= 2 and edit_cost(t, k) <= 0.1 + 0.05 * len(k) + 0.1 * (len(k) < 5) for k in _DATES))
        return any(abs(len(t) - len(k)) <= 3 and edit_cost(t, k) <= 0.26 * len(k) for k in (self.kinds if among == "kind" else self.sections))

    def _title(self, tokens: tuple[str, ...]) -> bool:
        """Whether the words are the name of a paper."""
        words = [self._clean(t) for t in tokens]
        joined = "".join(words)
        for p in self.papers:
            full = "".join(p)
            if abs(len(full) - len(joined)) <= 4 and (edit_cost(joined, full) <= 0.2 * len(full)):
                return True
        return False

    def parts(self, line: str) -> bool:
        """Whether a line has the parts of a page number or header."""
        return bool(line) and (len(line) <= 16 and self.folio(line) or self.header(line))

    def header(self, line: str) -> bool:
        """Paper, and date, section or page number, and nothing else."""
        if len(line) > 110 or len(line) < 8 or any(w not in self.small for w in _SMALL.findall(line)):
            return False
        text = line.strip()
        # letter-spaced names: single characters with single blanks, words further apart
        text = "  ".join(p.replace(" ", "") if re.fullmatch(r"(?:\S )+\S", p) else p for p in re.split(r"\s{2,}", text))
        tokens = re.findall(r"[\w!|�']+", text)
        if not 2 <= len(tokens) <= 14:
            return False
        rest, number, dated, section = [], False, False, False
        for t in tokens:
            if t.isdecimal() or re.fullmatch(r"\d+(?:st|nd|rd|th)", t):
                number = True
            elif self.near(t, "date"):
                dated = True
            elif t.lower() in _PAGE_WORD or t.lower() in ("and", "|", "de", "of") or (len(t) < 5 and edit_cost(self._clean(t), "the") <= 0.6):
                continue
            else:
                rest.append(t)
        if not rest or not any(self.near(t, "kind") for t in rest[-6:]):
            return False
        for n in range(1, min(4, len(rest)) + 1):  # the paper's words stand together, before or after the section
            for name, other in ((rest[:n], rest[n:]), (rest[-n:], rest[:-n])):
                if self.title(tuple(name)) and all(self.near(t, "section") for t in other):
                    section = bool(other)
                    if number or dated or section:
                        return True
        return False


    def margin(self, box: list | None) -> bool | None:
        """Whether furniture is likely at a box's place on the page; None without a box or a model."""
        if self.margins is None or not box or len(box) < 4 or any(x is None for x in box[:4]):
            return None
        return float(self.margins[_place(box)].sum()) > 0


PAGE_HEIGHT, PLACES = 3000.0, 60


def _place(box: list) -> list[int]:
    """Features of a box: steps of its upper and lower edge on the page, its height, and 1."""
    step = lambda y: min(PLACES - 1, max(0, int(y / PAGE_HEIGHT * PLACES)))
    return [step(box[1]), PLACES + step(box[3]), 2 * PLACES + step(box[3] - box[1]), 3 * PLACES]


def train_margins(texts: DataFrame, furniture: tuple[list[str], list[str]], seed: int = 3) -> np.ndarray | None:
    """Averaged perceptron of the place on the page: where lines with the parts of a header or page number stand, against all items.

    Learned on TRAIN_ITEMS items with a box at most; both kinds weigh alike. None without items of both kinds.
    """
    rows = sampled(texts.where(F.col("box").isNotNull()).select("rec_id", "text", "box"), "rec_id", TRAIN_ITEMS).collect()
    fur = Furniture(*furniture)
    seen = [(_place(r["box"]), fur.parts(r["text"].strip())) for r in rows if len(r["box"]) >= 4 and all(x is not None for x in r["box"][:4])]
    n = sum(y for _, y in seen)
    if not 0 < n < len(seen):
        return None
    w, total, steps = np.zeros(3 * PLACES + 1), np.zeros(3 * PLACES + 1), 0
    gain = {True: (len(seen) - n) / n, False: 1.0}
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(seen)):
            f, y = seen[i]
            steps += 1
            if (w[f].sum() > 0) != y:
                d = gain[y] if y else -gain[y]
                w[f] += d
                total[f] += d * steps
    return w - total / max(1, steps)


RECORD = "src string, rec_id long, header boolean, folio boolean, odd int, words array<string>, cuts array<string>"
_REMOVED = "\x0c"


def _positions(words: list[str]) -> np.ndarray:
    """Two places of each word in the filter."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    return np.concatenate([h >> np.uint64(64 - FILTER_BITS), h & np.uint64((1 << FILTER_BITS) - 1)]).astype(np.int64)


def word_filter(words: DataFrame) -> np.ndarray:
    """Bits of a filter of all ``word``; its blocks are joined in tasks, so the driver gets 2^FILTER_BITS bits whatever the number of words."""
    size = (1 << FILTER_BITS) >> 7

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for b in batches:
            at = _positions(b.column(0).to_pylist())
            for block in np.unique(at // size):
                mine.setdefault(int(block), np.zeros(size, bool))[at[at // size == block] % size] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int32()), pa.array([np.packbits(x).tobytes() for x in mine.values()], pa.binary())], names=["block", "bits"])

    def join(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()], axis=0)
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "bits": pa.array([both.tobytes()], pa.binary())})

    out = np.zeros(1 << FILTER_BITS, bool)
    for r in words.select("word").mapInArrow(bits, "block int, bits binary").groupBy("block").applyInArrow(join, "block int, bits binary").collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out


def misread_words(counts: DataFrame, editor: Editor, share: float = SHARE) -> DataFrame:
    """(word, repair, odd, lost): words of the corpus whose best repair the corpus has far more often, or, of words with an odd sign, as often.

    ``lost`` tells that the repair only puts letters in. Words of digits that are meant, such as ordinals, are left.
    """
    shared = counts.sparkSession.sparkContext.broadcast((editor.ops, editor.alphabet, editor.weights, editor.close))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Editor(*shared.value)
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            pick = [i for i, w in enumerate(words) if len(w) < 60 and "-" not in w and not _MEANT.match(w)]
            out = []
            for at in range(0, len(pick), 4000):
                part = pick[at : at + 4000]
                for i, forms in zip(part, e.candidates([words[i] for i in part])):
                    out += [(words[i], n[i], e.odd(words[i]), f, lost) for f, lost in forms]
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["word", "n_word", "odd", "repair", "lost"])

    slots = 2 * counts.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not to be coalesced
    pairs = counts.repartition(slots, "word").mapInArrow(run, "word string, n_word long, odd boolean, repair string, lost boolean")
    pairs = pairs.join(counts.select(F.col("word").alias("repair"), F.col("n").alias("n_repair")), "repair")
    often = F.when(F.col("odd"), F.col("n_word") <= F.col("n_repair")).otherwise(F.col("n_word") <= 1 + share * F.col("n_repair"))
    best = pairs.where((F.col("n_repair") >= 3) & often).groupBy("word").agg(F.max(F.struct("n_repair", "repair", "lost", "odd")).alias("x"))
    return best.select("word", "x.repair", "x.odd", "x.lost")


def joined_cuts(cuts: DataFrame, counts: DataFrame, editor: Editor) -> DataFrame:
    """(cut): those of the cut words (``left-right``, each once) whose parts the editor joins, told what the corpus has more often."""
    shared = counts.sparkSession.sparkContext.broadcast((editor.ops, editor.alphabet, editor.weights, editor.close))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Editor(*shared.value)
        for b in batches:
            cuts = b.column(0).to_pylist()
            yes = e.joins([tuple(c.split("-", 1)) for c in cuts], b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, y in zip(cuts, yes) if y], pa.string())], names=["cut"])

    known = cuts.withColumn("whole", F.regexp_replace("cut", "-", ""))
    known = known.join(counts.select(F.col("word").alias("whole"), F.col("n").alias("n1")), "whole", "left").join(counts.select(F.col("word").alias("cut"), F.col("n").alias("n2")), "cut", "left")
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    code = F.when(n2 >= F.greatest(n1, F.lit(1)), 2).when((n1 >= 2) & (n1 > n2), 1).otherwise(0)  # a cut word itself counts once as joined
    return known.select("cut", code.cast("int").alias("code")).mapInArrow(run, "cut string")


def cut_of(last: str, now: str) -> str | None:
    """``left-right`` in small letters if the word at the end of a line is cut and goes on in the next."""
    if len(last) < 2 or last[-1] not in HYPHENS or not now or now[0].isupper():
        return None
    left, right = _LAST.search(last[-41:-1]), _FIRST.match(now)
    return f"{left[0]}-{right[0]}".lower() if left and right else None


def furniture_of(text: str, box: list | None, fur: Furniture) -> tuple[bool, bool, list[str]]:
    """(header, folio, lines with _REMOVED in place of furniture) of one text."""
    header = folio = False
    place = fur.margin(box)
    kept: list[str] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        short = line.strip()
        if short and len(short) <= 110 and place is not False:
            if len(short) <= 16 and fur.folio(short):
                folio = True
                kept.append(_REMOVED)
                continue
            if fur.header(short):
                header = True
                kept.append(_REMOVED)
                continue
        kept.append(line)
    return header, folio, kept


def cuts_of(lines: list[str]) -> list[str]:
    """Cut words of lines without furniture, across removed and empty ones."""
    out, last = [], ""
    for line in lines:
        now = line.strip()
        if now:
            if last and last[-1] in HYPHENS and (c := cut_of(last, now)):
                out.append(c)
            last = now
    return out


def examine(records: DataFrame, editor: Editor, misread: np.ndarray, furniture: tuple) -> DataFrame:
    """``RECORD`` of each (src, rec_id, text, box), once: furniture seen, number of words with odd signs, words that the filter of misread words holds, cut words."""
    shared = records.sparkSession.sparkContext.broadcast((editor.alphabet, np.packbits(misread), furniture))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, bits, names = shared.value
        bits, fur = np.unpackbits(bits).astype(bool), Furniture(*names)
        known: dict[str, tuple] = {}
        for b in batches:
            texts = b.column(2).to_pylist()
            tokens = [_WORD.findall(_JOIN.sub("", t).lower()) for t in texts]
            if len(known) > 1_000_000:
                known.clear()
            new = [w for w in {w for ts in tokens for w in ts} if w not in known]
            clean = [cleaned(w) for w in new]
            at = _positions(clean).reshape(2, -1)
            for w, c, hit in zip(new, clean, (bits[at[0]] & bits[at[1]]).tolist()):
                odd = bool(c) and not alphabet.issuperset(c)
                known[w] = (c, odd, bool(c) and hit) if odd or (c and hit) else ()
            out: list[list] = [[] for _ in range(5)]
            for t, box, ts in zip(texts, b.column(3).to_pylist(), tokens):
                header, folio, kept = furniture_of(t, box, fur)
                marked = [x for w in ts if (x := known[w])]
                for c, v in zip(out, (header, folio, sum(x[1] for x in marked), [x[0] for x in marked if x[2]], cuts_of(kept))):
                    c.append(v)
            words = pa.list_(pa.string())
            types = [pa.bool_(), pa.bool_(), pa.int32(), words, words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, types))], names=["src", "rec_id", "header", "folio", "odd", "words", "cuts"])

    return spread(records).mapInArrow(run, RECORD).dropDuplicates(["src", "rec_id"])


class Reading(NamedTuple):
    """What is learned of a corpus: word counts, editor, misread words, examined records, cut words that are joined."""

    misread: DataFrame
    seen: DataFrame
    joined: DataFrame
    furniture: tuple


def read_corpus(spark: SparkSession, texts: DataFrame, furniture: tuple[list[str], list[str]]) -> Reading:
    ensure_checkpoint_dir(spark)
    counts = word_counts(spread(texts.select("text"))).checkpoint()
    editor = train_editor(counts)
    names = (*furniture, train_margins(texts, furniture))
    misread = misread_words(counts, editor).checkpoint()
    seen = examine(texts, editor, word_filter(misread), names).checkpoint()
    joined = joined_cuts(seen.select(F.explode("cuts").alias("cut")).distinct(), counts, editor).checkpoint()
    return Reading(misread, seen, joined, names)


def archive_texts(spark: SparkSession, root: str) -> DataFrame:
    """(src, rec_id, text, box) of the archive's scanned texts that are neither null nor empty."""
    no_box = F.lit(None).cast("array<double>").alias("box")
    pick = lambda table, key, text, box: read_table(spark, root, table).select(F.lit(table).alias("src"), F.col(key).alias("rec_id"), F.col(text).alias("text"), box)
    out = pick("articles", "id", "full_text", no_box).unionAll(pick("article_skeletons", "skeleton_id", "body_text", no_box)).unionAll(pick("parsed_items", "item_id", "text", F.col("bbox").alias("box")))
    return out.where(F.length("text") > 0)


def archive_furniture(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """Names of the papers and sections: the two canonical lists, which are fixed."""

    def take(table: str, col: str) -> list[str]:
        rows = read_table(spark, root, table).select(col).where(F.col(col) != "").distinct()
        if rows.count() > MAX_NAMES:
            raise ValueError(f"{table}.{col} has more than {MAX_NAMES} names, which are too many to broadcast")
        return sorted(r[0] for r in rows.collect())

    return take("newspapers", "name"), take("section_list", "section_name")


def find_noise(spark: SparkSession, texts: DataFrame, furniture: tuple[list[str], list[str]]) -> tuple[DataFrame, DataFrame]:
    """(noise rows (src, rec_id, noise), misread words): each noise of a record once.

    ``hyphen``: a word is cut by a hyphen-like sign at a line end and goes on in
    the next line that is not furniture. ``chars``: at least MISREAD words are
    misread; words that only lost a letter do not count. ``header``, ``folio``:
    a line is a running header or a page number. Null and empty texts have
    none; a record that occurs twice counts once.
    """
    misread, seen, joined, _ = read_corpus(spark, texts, furniture)
    words = seen.select("src", "rec_id", F.explode("words").alias("word")).groupBy("src", "rec_id", "word").agg(F.count("*").alias("n"))
    words = words.join(misread.where("not odd and not lost").select("word"), "word").select("src", "rec_id", "n")
    per = words.unionAll(seen.where("odd > 0").select("src", "rec_id", F.col("odd").cast("long").alias("n")))
    chars = per.groupBy("src", "rec_id").agg(F.sum("n").alias("n")).where(F.col("n") >= MISREAD).select("src", "rec_id", F.lit("chars").alias("noise"))
    flags = F.array(*[F.when(F.col(c), F.lit(c)) for c in ("header", "folio")])
    rest = seen.select("src", "rec_id", F.explode(F.array_compact(flags)).alias("noise"))
    cuts = seen.select("src", "rec_id", F.explode("cuts").alias("cut")).join(joined, "cut", "left_semi").select("src", "rec_id").distinct()
    return rest.unionAll(chars).unionAll(cuts.select("src", "rec_id", F.lit("hyphen").alias("noise"))), misread


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return find_noise(spark, archive_texts(spark, root), archive_furniture(spark, root))[0]


def repair_texts(spark: SparkSession, texts: DataFrame, furniture: tuple[list[str], list[str]]) -> DataFrame:
    """(src, rec_id, text): each record once, as continuous paragraphs.

    Headers and page numbers are dropped, cut words joined where the editor
    joins them, misread words replaced by their repair with the first letter's
    case kept; the lines of a paragraph are joined by blanks, paragraphs by an
    empty line. A sentence that goes on behind furniture stays one paragraph.
    """
    misread, seen, joined, names = read_corpus(spark, texts, furniture)
    key = ["src", "rec_id"]
    words = seen.select(*key, F.explode(F.array_distinct("words")).alias("word")).join(misread, "word").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "repair"))).alias("words"))
    cuts = seen.select(*key, F.explode(F.array_distinct("cuts")).alias("cut")).join(joined, "cut", "left_semi").groupBy(*key).agg(F.collect_list("cut").alias("cuts"))
    shared = spark.sparkContext.broadcast(names)
    rows = texts.dropDuplicates(key).join(words, key, "left").join(cuts, key, "left").select(*key, "text", "box", "words", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fur = Furniture(*shared.value)
        for b in batches:
            t, box, words, cuts = (b.column(i).to_pylist() for i in range(2, 6))
            out = [repaired(furniture_of(x, y, fur)[2], dict(w or []), set(c or [])) for x, y, w, c in zip(t, box, words, cuts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["src", "rec_id", "text"])

    return rows.mapInArrow(run, "src string, rec_id long, text string")


def repaired(lines: list[str], words: dict[str, str], joined: set[str]) -> str:
    """Lines without furniture as paragraphs, with the given words replaced and the given cut words joined."""
    paragraphs: list[str] = []
    text, gap, removed = "", False, False
    for line in lines:
        now = re.sub(r"\s+", " ", line).strip()
        if line == _REMOVED or not now:
            removed |= line == _REMOVED
            gap |= line != _REMOVED
            continue
        cut = cut_of(text, now) if text and text[-1] in HYPHENS else None
        if not text:
            text = now
        elif cut in joined:
            text = text[:-1] + now
        elif cut and not gap:
            text = text[:-1] + "-" + now
        elif gap and not (removed and now[0].islower() and text[-1] not in ".!?।…"):
            paragraphs.append(text)
            text = now
        else:
            text += " " + now
        gap = removed = False
    if text:
        paragraphs.append(text)

    def swap(m: re.Match) -> str:
        w = m[0]
        bare = w.strip("'’|!`")
        new = words.get(bare.lower())
        if new is None:
            return w
        new = new.upper() if bare.isupper() and len(bare) > 1 else new[:1].upper() + new[1:] if bare[0].isupper() else new
        return w.replace(bare, new, 1)

    text = "\n\n".join(paragraphs)
    return _WORD.sub(swap, text) if words else text


def p2_repaired(spark: SparkSession, root: str) -> DataFrame:
    return repair_texts(spark, archive_texts(spark, root), archive_furniture(spark, root))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
