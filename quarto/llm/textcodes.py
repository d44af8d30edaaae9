"""Vectorised views of texts as code points, shared by the text operators."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# Month and weekday names of the archive's languages, lower case.
DATE_WORDS = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday"
    " enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo"
    " janvier février mars avril mai juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche"
    " januar februar märz juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag"
)

LETTER, MARK, DIGIT, NUMBER, PUNCT, SYMBOL, SPACE, OTHER = range(1, 9)
_KINDS = {"L": LETTER, "M": MARK, "P": PUNCT, "S": SYMBOL, "Z": SPACE}


@lru_cache(maxsize=1)
def kind_table() -> np.ndarray:
    """Kind of every code point, by its general category."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(0x30000):
        c = unicodedata.category(chr(cp))
        out[cp] = DIGIT if c == "Nd" else NUMBER if c[0] == "N" else _KINDS.get(c[0], OTHER)
    for cp in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85):
        out[cp] = SPACE
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
