"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path, written as text: ``*`` stands for anything, ``^`` for a separator (a character
that is not a letter, a digit, ``-``, ``_``, ``%`` or beyond ASCII) or for an end, ``||`` at the start for the start of a host or of one of its
domains, ``|`` at the start or the end for that end. Patterns take the letters A-Z and a-z as equal. Its literal tokens, runs of characters that are no separators and are
bounded by separators or ends on both sides, are derived from the pattern: any address that fits holds them whole. A first pass counts, over
all URLs, how often the rules' tokens occur; each rule is then filed under its rarest token. A URL's tokens
fetch the candidate rules and only those run their expressions. Rules without a token always run.

Rules of the other kind, ``host/path``, fit a host and its subdomains if the path starts with theirs, letter by letter; the longest of these
that fits gives the verdict, and only where none does do the patterns count.

The rule set travels to the executors in a broadcast; ``max_rules`` bounds it and a larger set is refused. A worker files the rules
once for all its tasks, and an expression is compiled when it is first fetched.
Defined results: a null URL or one without ``://`` has an empty host and path, and only rules that match an
empty address could fit it; ties between rules go to the smaller rule text; an exception among the patterns (verdict
allow) wins over those that block; repeated rows each get their own equal verdict; an empty table gives an empty
result; columns besides the two named ones are not read, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

_ADDRESS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What tokens are made of; everything else separates.
_IN_TOKEN = r"[A-Za-z0-9_%\x80-\U0010ffff-]"
_TOKEN = re.compile(rf"{_IN_TOKEN}+")
#: What separates: the rest of ASCII, as a class that compiles at once.
_SEPARATOR = r"[\x00-$&-,./:-@\[-^`{-\x7f]"


@dataclass(frozen=True)
class Rule:
    """pattern runs on host + path from the start; tokens are whole tokens that a match must hold."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    host_rule: bool = False


def host_rule(verdict: str, text: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the URL's path starts with /path."""
    host, _, path = text.partition("/")
    return Rule(text, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", literal_tokens(f"||{host}/{path}"), True)


def pattern_rule(verdict: str, text: str) -> Rule:
    text_ = text.translate(_LOWER)
    body = text_.removeprefix("||") if text.startswith("||") else text_.removeprefix("|")
    start = r"(?:[^/]*\.)?" if text.startswith("||") else "" if text.startswith("|") else ".*"
    end = r"\Z" if body.endswith("|") else ""
    # A separator at the very start or end of the address is its end.
    parts = {"*": ".*", "^": rf"(?:{_SEPARATOR}|\Z|\A)"}
    return Rule(text, verdict, start + "".join(parts.get(c) or re.escape(c) for c in body.removesuffix("|")) + end, literal_tokens(text_))


def literal_tokens(text: str) -> tuple[str, ...]:
    """The tokens that every address has that fits the pattern."""
    body = text.removeprefix("|").removeprefix("|")
    found = []
    for m in _TOKEN.finditer(body):
        before = body[m.start() - 1] if m.start() else "^" if text.startswith("|") else "*"
        after = body[m.end()] if m.end() < len(body) else "*"
        if "*" not in (before, after):
            found.append(m[0])
    return tuple(found)


def read_rules(rules: DataFrame, max_rules: int = 100_000) -> list[Rule]:
    """Rules of a table with verdict, kind (host or pattern) and text; rows that lack one are left out."""
    rows = rules.select("verdict", "kind", "text").where("verdict is not null and kind in ('host', 'pattern') and text <> ''").distinct().limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    return [(host_rule if r["kind"] == "host" else pattern_rule)(r["verdict"], r["text"]) for r in sorted(rows)]


#: Blocked words: whole parts of a host or path that name spam, trackers and pages for members only.
BLOCKED_PARTS = ("adserver", "casino", "doubleclick", "gambling", "login", "phishing", "porn", "sex", "signin", "tracker", "viagra", "wp-login", "xxx")


def address(url: str | None) -> tuple[str, str]:
    found = _ADDRESS.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def token_counts(urls: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """URLs that hold each of the tokens; pre-aggregated in every task, as many rows come back as tokens exist."""
    wanted = urls.sparkSession.sparkContext.broadcast(frozenset(tokens))  # at most some for each rule

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        sums: Counter = Counter()
        for b in batches:
            for url in b["url"]:
                where = "".join(address(url))
                sums.update(wanted.value.intersection([*_TOKEN.findall(where), *_TOKEN.findall(where.translate(_LOWER))]))
        yield {"token": list(sums), "n": list(sums.values())}

    parts = map_batches(urls.select(F.col(url_col).alias("url")), count, "token string, n bigint")
    return dict(parts.groupBy("token").agg(F.sum("n")).collect()) if tokens else {}


class _Expression:
    """A regular expression that is compiled when it is first run."""

    def __init__(self, pattern: str):
        self.pattern, self.compiled = pattern, None

    def match(self, text: str) -> bool:
        if self.compiled is None:
            self.compiled = re.compile(self.pattern, re.S)
        return self.compiled.match(text) is not None


class RuleIndex:
    """Rules by their rarest token. Host rules are held against the address as it is, patterns against it in small letters."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str | None, list[tuple[Rule, _Expression]]] = {}
        for rule in rules:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
            self.by_token.setdefault(rarest, []).append((rule, _Expression(rule.pattern)))

    def fits(self, host: str, path: str) -> list[Rule]:
        where = host + path
        small = where.translate(_LOWER)
        tokens = {*_TOKEN.findall(where), *_TOKEN.findall(small), None}
        return [r for t in tokens if t in self.by_token for r, p in self.by_token[t] if p.match(where if r.host_rule else small)]


class _Shared:
    """What is broadcast. A worker holds one copy for all its tasks, and with it the index."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules, self.counts, self._index = rules, counts, None

    def index(self) -> RuleIndex:
        if self._index is None:
            self._index = RuleIndex(self.rules, self.counts)
        return self._index


def judge(pages: DataFrame, rules: list[Rule], *, id_col: str, url_col: str, default: str = "allow", max_rules: int = 100_000) -> DataFrame:
    """Every row of pages: its id, host, path, rule (the longest host rule that fits, else null), verdict and
    pattern (the pattern that decided it, else null)."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast")
    counts = token_counts(pages, url_col, sorted({t for r in rules for t in r.tokens}))
    shared = pages.sparkSession.sparkContext.broadcast(_Shared(rules, counts))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        index = shared.value.index()
        for b in batches:
            out = {id_col: b[id_col], "host": [], "path": [], "rule": [], "verdict": [], "pattern": []}
            for url in b["url"]:
                host, path = address(url)
                fits = index.fits(host, path)
                best = max((r for r in fits if r.host_rule), key=lambda r: (len(r.name), [-ord(c) for c in r.name]), default=None)
                part = min((r for r in fits if not r.host_rule), key=lambda r: (r.verdict != "allow", r.name), default=None) if best is None else None
                for k, v in (("host", host), ("path", path), ("rule", best and best.name), ("pattern", part and part.name), ("verdict", best.verdict if best else part.verdict if part else default)):
                    out[k].append(v)
            yield out

    source = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    return map_batches(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string, pattern string")
