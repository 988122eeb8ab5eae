"""Phone numbers (to E.164) and e-mail addresses.

Validity of numbers follows the Turkish plan as far as it is public in shape: ten digits of which the first is 2-5
for national numbers, and 8 to 15 digits after a plus sign with another country code. Addresses are checked by
syntax, without name lookups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import HIGH, MEDIUM, Cleaner, Parts

AGENT = "ContactAgent"
PHONE_SHAPE = r"^\+?[\d\s().\-/]{3,}$"
EMAIL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$"
#: Names that no mail goes to.
RESERVED = r"(?i)(^|\.)(invalid|localhost|local|test|example)$"


# Methods.
E164, TO_E164, BAD_SHAPE, BAD_NUMBER = "valid_e164", "normalized_to_e164", "unparseable_phone", "invalid_phone_number"
EMAIL_AS_IS, EMAIL_LOWERED, BAD_EMAIL = "valid_email", "cleaned_then_validated", "invalid_email"


def phone_cleaner() -> Cleaner:
    def digits(p: Parts) -> dict[str, Column]:
        return {"digits": F.when(p("value").rlike(PHONE_SHAPE), F.regexp_replace(p("value"), r"\D", ""))}

    def prefix(p: Parts) -> dict[str, Column]:
        zeros = p("digits").startswith("00")
        return {"abroad": p("value").startswith("+") | zeros, "rest": F.when(zeros, F.substring(p("digits"), 3, 40)).otherwise(p("digits"))}

    def national(p: Parts) -> dict[str, Column]:
        rest, abroad = p("rest"), p("abroad")
        country = rest.startswith("90") & (abroad | ((F.length(rest) == 12) & F.substring(rest, 3, 1).between("2", "5")))
        own = F.when(country, F.substring(rest, 3, 40)).when(~abroad & rest.startswith("0"), F.substring(rest, 2, 40)).when(~abroad, rest)
        return {"own": own}

    def number(p: Parts) -> dict[str, Column]:
        own, rest = p("own"), p("rest")
        turkish = F.when((F.length(own) == 10) & F.substring(own, 1, 1).between("2", "5"), F.concat(F.lit("+90"), own))
        other = F.when(p("abroad") & ~rest.startswith("90") & F.length(rest).between(8, 15) & ~rest.startswith("0"), F.concat(F.lit("+"), rest))
        return {"cleaned": F.coalesce(turkish, other)}

    def judge(p: Parts) -> dict[str, Column]:
        as_is = F.replace(p("value"), F.lit(" "), F.lit("")) == p("cleaned")
        return {"method": F.when(p("digits").isNull(), BAD_SHAPE).when(p("cleaned").isNull(), BAD_NUMBER).when(as_is, E164).otherwise(TO_E164)}

    return Cleaner(AGENT, (digits, prefix, national, number, judge), {E164: HIGH, TO_E164: MEDIUM}, frozenset({BAD_SHAPE, BAD_NUMBER}))


def email_cleaner() -> Cleaner:
    def fits(p: Parts) -> dict[str, Column]:
        v = p("value")
        return {"fits": v.rlike(EMAIL), "lower": F.lower(v), "local": F.substring_index(v, "@", 1), "domain": F.lower(F.substring_index(v, "@", -1))}

    def checks(p: Parts) -> dict[str, Column]:
        local, whole = p("local"), p("value")
        return {"sound": (F.length(local) <= 64) & (F.length(whole) <= 254) & ~p("domain").rlike(RESERVED), "fits_lower": p("fits") | p("lower").rlike(EMAIL)}

    def judge(p: Parts) -> dict[str, Column]:
        good, lowered = p("fits") & p("sound"), p("fits_lower") & p("sound")
        as_is = F.concat(p("local"), F.lit("@"), p("domain"))
        return {"method": F.when(good, EMAIL_AS_IS).when(lowered, EMAIL_LOWERED).otherwise(BAD_EMAIL), "cleaned": F.when(good, as_is).when(lowered, p("lower"))}

    return Cleaner(AGENT, (fits, checks, judge), {EMAIL_AS_IS: HIGH, EMAIL_LOWERED: MEDIUM}, frozenset({BAD_EMAIL}))


def cleaner(kind: str) -> Cleaner:
    if kind not in ("phone", "email"):
        raise ValueError(f"a contact column is phone or email, not {kind!r}")
    return (phone_cleaner if kind == "phone" else email_cleaner)()
