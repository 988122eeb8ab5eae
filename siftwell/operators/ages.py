"""Whole numbers such as ages, in digits or English words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import HIGH, MEDIUM, TEXT_NUMBER, UNPARSEABLE, Cleaner, Parts
from ..functions.text import lookup

AGENT = "NumericAgent"
LEAST, MOST = 0, 120
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
# Methods.
AS_TYPED, STRIPPED, WORDS, FAR = "rule_based_normalization", "whitespace_stripped", "text_to_number_pattern", "implausible_range"


def number_words() -> dict[str, int]:
    """The English words of 0 to 99; tens and ones parted by one space."""
    out = {w: i for i, w in enumerate(_ONES)} | {w: 10 * (i + 2) for i, w in enumerate(_TENS)}
    return out | {f"{t} {o}": 10 * (i + 2) + j for i, t in enumerate(_TENS) for j, o in enumerate(_ONES[:10]) if j}


def cleaner() -> Cleaner:
    def digits(p: Parts) -> dict[str, Column]:
        return {"number": F.when(p("value").rlike(r"^-?\d+$"), p("value").try_cast("decimal(38,0)"))}

    def words(p: Parts) -> dict[str, Column]:
        return {"word": F.when(p("number").isNull(), lookup(number_words(), F.regexp_replace(F.lower(p("value")), r"[\s-]+", " ")))}

    def judge(p: Parts) -> dict[str, Column]:
        number, word = p("number"), p("word")
        method = (
            F.when(~number.between(LEAST, MOST), FAR)
            .when(number.isNotNull(), F.when(p("raw") == p("value"), AS_TYPED).otherwise(STRIPPED))
            .when(word.isNotNull(), WORDS)
            .otherwise(UNPARSEABLE)
        )
        return {"method": method, "cleaned": F.coalesce(number.cast("string"), word.cast("string"))}

    return Cleaner(
        AGENT,
        (digits, words, judge),
        {AS_TYPED: HIGH, STRIPPED: HIGH, WORDS: TEXT_NUMBER, FAR: MEDIUM},
        frozenset({FAR}),
        lambda p: {FAR: F.lit(f'{{"plausible_range":[{LEAST},{MOST}]}}')},
    )
