"""Amounts of money in five written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import HIGH, MEDIUM, UNPARSEABLE, Cleaner, Parts, details
from ..functions.text import is_missing, strip, two_decimals

AGENT = "CurrencyAgent"
# The written forms and the methods they are known by, in the order in which they are tried.
DOLLAR = r"^\$\s?\d[\d,]*\.?\d*$"
LIRA_SUFFIX = r"^\d[\d.]*\s?TL$"
LIRA_SYMBOL = r"^₺\s?\d[\d,]*$"
COMMA_DECIMAL = r"^\d+,\d{1,2}$"
PLAIN = r"^\d+(\.\d+)?$"
FORMS = {"symbol_usd": DOLLAR, "suffix_tl": LIRA_SUFFIX, "symbol_try": LIRA_SYMBOL, "bare_comma_decimal_currency_assumed": COMMA_DECIMAL, "plain_number_currency_assumed": PLAIN}
ASSUMED = "TRY"


def cleaner(hint: Column | None = None) -> Cleaner:
    """hint: the currency code that the same row gives elsewhere."""

    def form(p: Parts) -> dict[str, Column]:
        method = F.coalesce(*[F.when(p("value").rlike(pattern), name) for name, pattern in FORMS.items()], F.lit(UNPARSEABLE))
        return {"method": method, "hint": F.lit(ASSUMED) if hint is None else F.when(is_missing(hint), ASSUMED).otherwise(F.upper(strip(hint)))}

    def number(p: Parts) -> dict[str, Column]:
        v, how = p("value"), p("method")
        marks = F.when(how == "suffix_tl", r"\D").otherwise(r"[^\d.]")
        text = F.when(how == "bare_comma_decimal_currency_assumed", F.replace(v, F.lit(","), F.lit("."))).when(how == "plain_number_currency_assumed", v)
        return {"text": text.when(how != UNPARSEABLE, F.regexp_replace(v, marks, F.lit("")))}

    def amount(p: Parts) -> dict[str, Column]:
        return {"cleaned": two_decimals(p("text").try_cast("double"))}

    known = lambda code: F.lit(f'{{"currency_code":"{code}"}}')

    def info(p: Parts) -> dict[str, Column]:
        guessed = details(currency_code=p("hint"), currency_assumed=F.lit(True))
        return {"symbol_usd": known("USD"), "suffix_tl": known("TRY"), "symbol_try": known("TRY"), "bare_comma_decimal_currency_assumed": guessed, "plain_number_currency_assumed": guessed}

    return Cleaner(AGENT, (form, number, amount), dict(zip(FORMS, [HIGH, HIGH, HIGH, MEDIUM, MEDIUM])), details=info)
