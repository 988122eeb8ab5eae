"""Which single-byte code page a text is in, by how well its pairs of characters fit.

A text that is not UTF-8 is decoded by every candidate. Each character beyond ASCII is judged with its two neighbours: a letter that
the page's languages use and that continues a word in its script and case speaks for the page; a sign or a control
character inside a word, a change of script, or a capital after a small letter speaks against it. The mean is the page's score;
the best one is taken if it reaches LEAST, else the encoding counts as unknown.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters beyond ASCII that the languages of a code page use.
LETTERS = {
    "windows-1252": "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜŒ",
    "windows-1254": "âçğıîöşûüÂÇĞİÎÖŞÛÜ",
    "windows-1250": "áâăąćčçďđéęëěíîĺľłńňóôőöŕřśšşťţúůűüýźžżßÁÂĂĄĆČÇĎĐÉĘËĚÍÎĹĽŁŃŇÓÔŐÖŔŘŚŠŞŤŢÚŮŰÜÝŹŽŻ",
    "windows-1251": "абвгдежзийклмнопрстуфхцчшщъыьэюяёєіїґўАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁЄІЇҐЎ",
    "koi8-r": "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ",
    "cp850": "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ",
}
CANDIDATES = tuple(LETTERS)
#: Bytes that are judged, and the least score of a page that is taken.
HEAD, LEAST = 1 << 16, 0.25


def _characters(encoding: str) -> str:
    """The characters of the bytes 128 to 255; a byte without one is the control character of its number."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(128, 256))


_TABLES = {e: _characters(e) for e in CANDIDATES}


def decoded(raw: bytes, encoding: str) -> str:
    return raw.decode("latin-1").translate(dict(zip(range(128, 256), _TABLES[encoding])))


def decoded_column(raw: Column, encoding: Column) -> Column:
    """The text of a column of bytes by a column of encodings: UTF-8 or a candidate."""
    plain = F.decode(raw, "ISO-8859-1")
    out = raw.cast("string")
    for name, table in _TABLES.items():
        moved = [(chr(128 + i), c) for i, c in enumerate(table) if c != chr(128 + i)]
        out = F.when(encoding == name, F.translate(plain, "".join(a for a, _ in moved), "".join(b for _, b in moved))).otherwise(out)
    return out


def _fit(before: str, c: str, after: str, letters: str) -> float:
    """What one character says, from -1 to 1."""
    word = before.isalpha() or after.isalpha()
    if not c.isalpha():
        if unicodedata.category(c)[0] == "C":
            return -1.0
        return -1.0 if before.isalpha() and after.isalpha() and c not in "’" else 0.3 if not (before.isalpha() and after.isalpha()) and c in "«»“”„‘’‚–—…€£°§·¿¡•" else -0.5 if word else 0.0
    if c not in letters:
        return -0.5
    latin = unicodedata.name(c, "").startswith("LATIN")
    for other in (before, after):
        if other.isalpha() and latin != unicodedata.name(other, "").startswith("LATIN"):
            return -1.0
    if c.isupper() and before.islower():
        return -1.0
    return 1.0


def score(raw: bytes, encoding: str) -> float:
    """How well the bytes beyond ASCII fit a candidate; 1 where there are none."""
    text = f" {decoded(raw, encoding)} "
    found = [_fit(text[i - 1], c, text[i + 1], LETTERS[encoding]) for i, c in enumerate(text) if c > "\x7f"]
    return sum(found) / len(found) if found else 1.0


def detect(raw: bytes) -> str | None:
    """The best candidate, the first of equals; None if none fits."""
    scores = {e: score(raw[:HEAD], e) for e in CANDIDATES}
    best = max(scores, key=scores.get)
    return best if scores[best] >= LEAST else None
