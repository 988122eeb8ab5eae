"""Quality classification by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad. A text is
cut into blocks, all of which are compressed against either dictionary; the difference of the two sizes,
normalised by the text's size, becomes a score from 0 to 1 by a logistic calibration fitted on labelled rows
that the dictionaries have not seen.

Fitting uses a bounded, deterministic sample of labelled rows (``per_label`` of either label); scoring reads
every whole text. Defined results: an empty or null text has difference 0 and so the calibration's
prior-like score; without rows of both labels every score is 0.5; several labels of one document count as
its best one; ties and repeated rows score alike; texts may be of any length; an empty table gives an empty result;
columns besides the named ones are not read, whatever they are called.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, sample_per_label

BLOCK = 1024
LEVEL = 3
#: Added to a text's size: a difference over few bytes says little.
SMOOTHING = 96


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Compressors:
    """Both dictionaries, digested once a worker."""

    def __init__(self, good: bytes, bad: bytes):
        self._pair = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self._pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def difference(self, text: str | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / size; above 0 the text is like the good."""
        raw = (text or "").encode("utf-8", "replace")
        good, bad = self._pair
        total = 0
        for i in range(0, len(raw), BLOCK):
            block = raw[i : i + BLOCK]
            total += len(bad(block)) - len(good(block))
        return total / (len(raw) + SMOOTHING)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    samples = sorted(x for x in samples if len(x) >= 8)
    while size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, k=64, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text for a dictionary of this size
            size //= 2
    return b"".join(samples)[-4096:] or b"\n" * 8


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, per_label: int = 3000, blocks_per_text: int = 4, dictionary_bytes: int = 65536) -> QualityModel | None:
    """labels: the rows that may be learned from, with id_col and label_col (1 good, 0 bad). None if a label has no row."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = sample_per_label(rows, "label", "id", per_label, "quality").groupBy("id").agg(F.max("label").alias("label"))  # at most 4 * per_label rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    # Repeated ids: about as many rows as labels are wanted, however many copies there are.
    sample = materialise(texts.join(F.broadcast(chosen), "id").limit(8 * per_label), "quality-sample")

    def blocks(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {"label": [], "block": []}
            for key, text, label in zip(b["id"], b["text"], b["label"]):
                raw = text.encode("utf-8", "replace")
                starts = range(0, len(raw), BLOCK)
                for s in random.Random(str(key)).sample(starts, min(len(starts), blocks_per_text)):
                    out["label"].append(label)
                    out["block"].append(raw[s : s + BLOCK])
            yield out

    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2))
    found = map_batches(sample.where(fold == 0), blocks, "label int, block binary").collect()  # at most 8 * per_label * blocks_per_text blocks
    by = {k: [bytes(r[1]) for r in found if r[0] == k] for k in (0, 1)}
    if not by[0] or not by[1]:
        return None
    model = QualityModel(_dictionary(by[1], dictionary_bytes), _dictionary(by[0], dictionary_bytes), 1.0, 0.0)

    def differences(batches: Iterator[dict]) -> Iterator[dict]:
        c = Compressors(model.good, model.bad)
        for b in batches:
            yield {"label": b["label"], "x": [c.difference(t) for t in b["text"]]}

    held = map_batches(sample.where(fold == 1).select("label", "text"), differences, "label int, x double").collect()
    if len({r[0] for r in held}) == 2:
        x, y = np.array([r[1] for r in held]), np.array([r[0] for r in held], float)
        # The sample holds labels in equal shares; the shares among all labelled rows are put back.
        share = dict(rows.groupBy("label").count().collect())
        weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
        model.slope, model.offset = _logistic(x, y, weight / weight.mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    scale = float(np.std(x)) or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 0.1 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0] / scale), float(w[1])


_ready: dict[bytes, Compressors] = {}


def scores(model: QualityModel | None, texts: list[str | None]) -> list[float]:
    if model is None:
        return [0.5] * len(texts)
    if model.good not in _ready:
        _ready.clear()
        _ready[model.good] = Compressors(model.good, model.bad)
    x = np.array([_ready[model.good].difference(t) for t in texts])
    return (1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))).tolist()


def score(docs: DataFrame, model: QualityModel | None, *, id_col: str, text_col: str, keep: list[str] = []) -> DataFrame:
    """Every row of docs: its id, the columns of keep, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: two dictionaries

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = b.pop("text")
            yield b | {"score": scores(shared.value, texts)}

    source = docs.select(F.col(id_col), *[F.col(k) for k in keep], F.col(text_col).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_batches(source, run, f"{kept}, score double")
