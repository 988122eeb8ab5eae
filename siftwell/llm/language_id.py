"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams says
which side of the bit a text is on; decoding picks the language whose codeword loses least against the
calibrated bit margins, each bit weighted by its reliability. Near ties are flagged as ambiguous.

Fitting: n-gram log-odds for each bit from a bounded, deterministic sample (``per_language`` rows of each
language, half for the n-grams and half for calibration). Prediction reads every whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; with no labelled language
at all every text is ``und``; with one language every text with a letter is that language. Repeated rows
each get their own equal answer; ties go to the language that sorts first; texts may be of any length; an empty table
gives an empty result; columns besides the named ones are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, sample_per_label

UNDETERMINED = "und"
ORDERS = (1, 2, 3, 4)
DIMENSIONS = 1 << 14
#: ASCII bytes that are no letters become one space, letters become lower case.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # dimensions x bits
    slope: np.ndarray
    offset: np.ndarray
    reliability: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords for n languages: the exhaustive code up to seven, else random ones of which the set with
    the largest least distance is kept."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        masks = range(1, 2 ** (n - 1))
        return np.array([[1 if (m >> i) & 1 else -1 for m in masks] for i in range(n)], float)
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        agree = code @ code.T - 2 * code.shape[1] * np.eye(n)  # bits that agree less bits that differ, of all pairs
        least = int(code.shape[1] - agree.max()) // 2
        if least > most:
            best, most = code, least
    return best


def features(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole text, case folded, runs of other characters as one space."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_TABLE), np.uint8)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
    a = a[keep].astype(np.uint32)
    counts = np.zeros(DIMENSIONS, np.int64)
    h = np.zeros(len(a) + 1, np.uint32)[: len(a)]
    for n in ORDERS:
        if len(a) < n:
            break
        h = h[: len(a) - n + 1] * np.uint32(2654435761) + (a[n - 1 :] + np.uint32(n * 257)) * np.uint32(40503)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        counts += np.bincount((mixed >> np.uint32(18)).astype(np.int64), minlength=DIMENSIONS)
    return counts


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int = 1500) -> LanguageModel:
    """docs: the labelled rows. At most 2 * per_language rows of a language are used; every language with a text that has a letter
    is learned, and more than 2000 languages are an error."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and id is not null")
    sample = materialise(sample_per_label(rows, "lang", "id", per_language, "language"), "language-sample")

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                if _has_letter(text):
                    sums[lang] = sums.get(lang, 0) + features(text)
        yield {"lang": list(sums), "counts": [v.astype(np.int64).tobytes() for v in sums.values()]}

    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2))

    def counted(rows: DataFrame) -> dict[str, np.ndarray]:
        totals: dict[str, np.ndarray] = {}
        for lang, counts in map_batches(rows.select("text", "lang").repartition(8, "lang"), count, "lang string, counts binary").collect():
            totals[lang] = totals.get(lang, 0) + np.frombuffer(counts, np.int64)
        return totals

    totals = counted(sample.where(fold == 0))
    # A rare language may have all its rows in the other half: it is learned from those.
    known = F.col("lang").isin(list(totals)) if totals else F.lit(False)
    totals |= counted(sample.where((fold == 1) & ~known))
    languages = sorted(totals)
    codes = codewords(len(languages))
    bits = codes.shape[1]
    weights = np.zeros((DIMENSIONS, bits))
    if len(languages) > 1:
        share = np.array([totals[x] / totals[x].sum() for x in languages])  # languages count alike
        for b in range(bits):
            one, zero = share[codes[:, b] > 0].mean(0), share[codes[:, b] < 0].mean(0)
            weights[:, b] = np.log((one + 1e-6) / (zero + 1e-6))
    model = LanguageModel(languages, codes, weights, np.ones(bits), np.zeros(bits), np.ones(bits))
    if len(languages) < 2:
        return model

    def margins(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            pairs = [(lang, _margins(model, text)) for text, lang in zip(b["text"], b["lang"]) if _has_letter(text)]
            yield {"lang": [x for x, _ in pairs], "m": [y.tolist() for _, y in pairs]}

    found = map_batches(sample.where(fold == 1).select("text", "lang"), margins, "lang string, m array<double>").collect()
    place = {x: i for i, x in enumerate(languages)}
    found = [(place[r[0]], r[1]) for r in found if r[0] in place]
    if found:
        m, y = np.array([x[1] for x in found]), codes[[x[0] for x in found]]
        for b in range(bits):
            model.slope[b], model.offset[b] = _platt(m[:, b], y[:, b])
            right = np.mean(np.sign(m[:, b] * model.slope[b] + model.offset[b]) == y[:, b])
            model.reliability[b] = max(0.05, 2 * right - 1)
    return model


def _platt(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic regression in one variable by damped Newton steps, lightly regularised."""
    scale = float(np.std(x)) or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - (y > 0)) + 0.5 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0] / scale), float(w[1])


def _margins(model: LanguageModel, text: str) -> np.ndarray:
    c = features(text)
    return (c @ model.weights) / c.sum()


def decode(model: LanguageModel, text: str | None, ambiguity: float) -> tuple[str, float, bool]:
    if not model.languages or not _has_letter(text):
        return UNDETERMINED, 0.0, True
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    f = _margins(model, text) * model.slope + model.offset
    loss = (np.logaddexp(0, -model.codes * f) * model.reliability).sum(1) / model.reliability.sum() * np.log2(2 + len(f))
    e = np.exp(loss.min() - loss)
    k = int(np.argmin(loss))
    runner = np.partition(loss, 1)[1]
    return model.languages[k], float(e[k] / e.sum()), bool(runner - loss[k] < ambiguity)


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str, text_col: str, keep: list[str] = [], ambiguity: float = 0.1) -> DataFrame:
    """Every row of docs: its id, the columns of keep, lang_pred, score and ambiguous (the best codeword's
    loss is within ``ambiguity`` of the next one's, or nothing can be told)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIMENSIONS x bits

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [decode(shared.value, t, ambiguity) for t in b.pop("text")]
            yield b | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "ambiguous": [x[2] for x in found]}

    source = docs.select(F.col(id_col), *[F.col(k) for k in keep], F.col(text_col).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_batches(source, run, f"{kept}, lang_pred string, score double, ambiguous boolean")
