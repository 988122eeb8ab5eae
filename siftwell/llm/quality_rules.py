"""Quality rules with distribution divergence.

Base rules count words, symbols, repeated lines and repeated three-word windows. On top of them a text's
histogram of character classes and of common words is compared with the references of every language by
the Jensen-Shannon distance (base 2, the square root of the divergence); the nearest language counts. A text
is kept if the base rules pass and neither distance is above its bound; both tests need a minimum length.

References come from all rows with a language and are exact: every word of every partition is counted, and the common
words are chosen from the sums. A task that holds too many words hands its counts on and starts again. Defined results: a null or empty text has no words and fails the base rules; without any reference
the base rules alone decide; rows without a language are judged like the others; of words that are equally common the
smaller is chosen; repeated rows and repeated ids are counted and judged row by row; a text may be of any length; an
empty table gives an empty result; columns besides the named ones are not read, whatever they are called.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

#: Classes of characters: 0 letter, 1 upper-case letter, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 anything else.
CLASSES = 7
#: Sentence marks of ASCII; beyond it all punctuation counts as such.
MARKS = ".,;:?!'\"-()"


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point, by its Unicode category: letters and the marks on them, upper-case letters, decimal digits,
    separators, punctuation."""
    of_category = {"Lu": 1, "Lt": 1, "Nd": 2, "Zs": 3} | {c: 0 for c in ("Ll", "Lm", "Lo", "Mn", "Mc", "Me")} | {c: 5 for c in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po")}
    table = np.fromiter((of_category.get(unicodedata.category(chr(c)), 6) for c in range(0x110000)), np.uint8, 0x110000)
    table[:128][table[:128] == 5] = 6
    table[[ord(c) for c in MARKS]] = 5
    table[[9, 11, 12, 13]] = 3
    table[10] = 4
    return table


SYMBOLS = b"#*$%&|<>"
#: A task hands its word counts on when it holds this many words, or has read this many bytes since it last did.
HELD_WORDS, HELD_BYTES = 300_000, 1 << 27
#: Into so many parts a language's words are dealt before the commonest are chosen.
PARTS = 16
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Bounds:
    """Distances above these fail a text. A word histogram of n words strays by about word_spread / sqrt(n) by chance."""

    char_distance: float = 0.25
    min_chars: int = 200
    word_distance: float = 0.30
    word_spread: float = 1.25
    min_words: int = 50


@dataclass
class References:
    languages: list[str]
    chars: np.ndarray  # languages x CLASSES, shares
    place: dict[str, list[tuple[int, int]]]  # word: (language, rank) of each language it is common in
    words: np.ndarray  # languages x (common words + 1), shares; the last is for all other words


def char_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.bincount(character_classes()[points], minlength=CLASSES)


def references(docs: DataFrame, *, text_col: str, lang_col: str, common_words: int = 100) -> References:
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        seen: Counter = Counter()
        held = read = 0

        def hand_on() -> Iterator[dict]:
            for lang, c in words.items():
                # Rows with a null word carry the number of all words and the character classes.
                yield {
                    "lang": [lang] * (len(c) + 1),
                    "word": [k.decode("utf-8", "replace") for k in c] + [None],
                    "n": [*c.values(), seen[lang]],
                    "chars": [None] * len(c) + [[int(x) for x in chars[lang]]],
                }
            words.clear(), chars.clear(), seen.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                raw = text.encode("utf-8", "replace")
                w = raw.split()
                c = words.setdefault(lang, Counter())
                held -= len(c)
                c.update(w)
                held += len(c)
                read += len(raw)
                seen[lang] += len(w)
                chars[lang] = chars.get(lang, 0) + char_histogram(text)
                if held > HELD_WORDS or read > HELD_BYTES:
                    yield from hand_on()
                    held = read = 0
        yield from hand_on()

    parts = map_batches(rows, count, "lang string, word string, n bigint, chars array<bigint>")
    sums = parts.groupBy("lang", "word").agg(F.sum("n").alias("n"), *[F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(CLASSES)])
    order = (F.col("word").isNotNull(), F.desc("n"), "word")  # the null row, then common words
    best = lambda rows, *keys: rows.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("row") <= common_words + 1)
    # In two steps, so that a language's words are ranked by PARTS tasks and only the best of each go to one.
    some = best(sums.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS))), "lang", "part")
    top = best(some, "lang").withColumn("rank", F.col("row") - 1).orderBy("lang", "rank").collect()
    languages = sorted({r["lang"] for r in top})
    at = {x: i for i, x in enumerate(languages)}
    chars, words = np.zeros((len(languages), CLASSES)), np.zeros((len(languages), common_words + 1))
    place: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        i = at[r["lang"]]
        if r["rank"] == 0:
            chars[i] = [r[f"c{j}"] for j in range(CLASSES)]
            words[i, -1] = r["n"]
        else:
            place.setdefault(r["word"], []).append((i, r["rank"] - 1))
            words[i, r["rank"] - 1] = r["n"]
            words[i, -1] -= r["n"]
    return References(languages, chars / np.maximum(1, chars.sum(1, keepdims=True)), place, np.maximum(0, words) / np.maximum(1, words.sum(1, keepdims=True)))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of p and q, in bits ** 0.5."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(d / 2, 0))


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included; each word once."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and x.split()]
    return len(lines) - len(set(lines))


class Judge:
    def __init__(self, refs: References, bounds: Bounds):
        self.refs, self.bounds = refs, bounds
        self.place = {k.encode(): v for k, v in refs.place.items()}

    def measure(self, text: str | None) -> dict:
        raw = (text or "").encode("utf-8", "replace")
        words, refs, b = raw.split(), self.refs, self.bounds
        n = len(words)
        joined = b"".join(words)
        out = {
            "n_words": n,
            "word_chars": len(joined) if joined.isascii() else len(joined.decode()),
            "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
            "n_dup_lines": repeated_lines(raw),
            "n_repeat_words": repeated_words(words),
            "char_distance": None,
            "word_distance": None,
        }
        out["base_failed"] = n < MIN_WORDS or 100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n
        kept = not out["base_failed"]
        if refs.languages and raw:
            classes = char_histogram(text)
            if classes.sum() >= b.min_chars:
                out["char_distance"] = float(js_distance(classes / classes.sum(), refs.chars).min())
                kept &= out["char_distance"] <= b.char_distance
            if n >= b.min_words:
                hist = np.zeros_like(refs.words)
                for w, k in Counter(words).items():
                    for i, j in self.place.get(w, ()):
                        hist[i, j] = k
                hist[:, -1] = n - hist.sum(1)
                out["word_distance"] = float(js_distance(hist / n, refs.words).min())
                kept &= out["word_distance"] <= b.word_distance + b.word_spread / n**0.5
        out["kept"] = kept
        return out


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, char_distance double, word_distance double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, refs: References, *, id_col: str, text_col: str, bounds: Bounds = Bounds()) -> DataFrame:
    """Every row of docs: its id and FIELDS."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)  # bounded: languages x common words
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        one = Judge(shared.value, bounds)
        for b in batches:
            found = [one.measure(t) for t in b["text"]]
            yield {id_col: b[id_col]} | {k: [x[k] for x in found] for k in names}

    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return map_batches(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, {FIELDS}")
