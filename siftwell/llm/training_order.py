"""Training-order materialisation: token sequences in shards of fixed stride, ordered by a keyed permutation.

Documents are tokenised partition by partition into a stream that is cut into sequences of equal length; every
sequence gets a running number. A keyed Feistel network over the smallest even-bit domain that holds all
numbers, walked until the result is in range, maps it to its slot in the training order, without any sort or
state. A shard holds ``shard_sequences`` consecutive slots at a fixed stride, so slot s is at byte
(s mod shard_sequences) * stride of shard s div shard_sequences and reading can stop and resume anywhere.

Slots are dealt evenly by construction, whatever the documents' keys. A task writes a range of consecutive shards, one
after another, and holds one at a time. A shard is written under a temporary name and renamed, so a task that runs
again writes the same file; what a failed attempt leaves is removed. The tokens wait in the session's shared folder, not in
the output. Defined results: null and empty texts are
the end-of-document id; the last sequence of a partition is padded; repeated rows and repeated ids are written row by
row; a text may be of any length; an empty table gives no shard; columns besides the two named ones are not read.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, scratch_path
from .tokens import document_ids, encoder

ROUNDS = 6
PAD = 0


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def round_keys(key: str) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{i}".encode()).digest()[:8], "little")) for i in range(ROUNDS)]


def permute(numbers: np.ndarray, size: int, key: str) -> np.ndarray:
    """The slots of numbers under the keyed permutation of range(size)."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << half) - 1), np.uint64(half), round_keys(key)

    def feistel(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return left << shift | right

    out = feistel(np.asarray(numbers, np.uint64))
    while (outside := out >= np.uint64(size)).any():  # at most four numbers a slot, so a few walks
        out[outside] = feistel(out[outside])
    return out.astype(np.int64)


def unpermute(slots: np.ndarray, size: int, key: str) -> np.ndarray:
    """The numbers at slots: the inverse of permute."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << half) - 1), np.uint64(half), round_keys(key)[::-1]

    def back(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right ^ (_mix(left, k) & mask), left
        return left << shift | right

    out = back(np.asarray(slots, np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = back(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, *, id_col: str, text_col: str, vocabulary: str, pattern: str, length: int) -> DataFrame:
    """part, place (running number in the partition), n_tokens, doc_ids (in order), tokens (uint16, padded)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encode, part, place = encoder(vocabulary, pattern, added_tokens=True), TaskContext.get().partitionId(), 0
        rest, owners = np.zeros(0, np.uint16), []  # tokens not yet emitted; (id, tokens of it in rest)

        def cut(last: bool) -> dict:
            nonlocal rest, owners, place
            out: dict[str, list] = {k: [] for k in ("part", "place", "n_tokens", "doc_ids", "tokens")}
            at, i, left = 0, 0, owners[0][1] if owners else 0
            while len(rest) - at >= length or last and at < len(rest):
                block = rest[at : at + length]
                need, ids = len(block), []
                while need:
                    ids.append(owners[i][0])
                    take = min(left, need)
                    need, left = need - take, left - take
                    if not left:
                        i += 1
                        left = owners[i][1] if i < len(owners) else 0
                padded = np.full(length, PAD, "<u2")
                padded[: len(block)] = block
                for k, v in zip(out, (part, place, len(block), ids, padded.tobytes())):
                    out[k].append(v)
                at, place = at + len(block), place + 1
            owners = ([(owners[i][0], left)] if i < len(owners) else []) + owners[i + 1 :]
            rest = rest[at:]
            return out

        for b in batches:
            for at in range(0, len(b["id"]), 500):
                arrays = [document_ids(encode, t) for t in b["text"][at : at + 500]]
                if any(a.max() > 0xFFFF for a in arrays):
                    raise ValueError("ids above 65535 do not fit in two bytes")
                arrays = [a.astype(np.uint16) for a in arrays]
                owners += [(k, len(a)) for k, a in zip(b["id"][at : at + 500], arrays)]
                rest = np.concatenate([rest, *arrays])
                yield cut(False)
        yield cut(True)

    return map_batches(source, run, f"part int, place bigint, n_tokens int, doc_ids array<{kind}>, tokens binary")


def materialise_order(docs: DataFrame, out_uri: str, *, id_col: str, text_col: str, vocabulary: str, pattern: str, key: str, length: int = 1024, shard_sequences: int = 8192, most_tasks: int = 20_000) -> DataFrame:
    """Writes the shards and a manifest under out_uri (a folder all executors reach) and returns the manifest:
    slot, shard, byte_offset, n_tokens, doc_ids, tokens_crc32. A task writes a shard, or more where there would be more than
    most_tasks tasks."""
    spark = docs.sparkSession
    # Tokenising is the dear part: it is done once, into a table that outlives its executors.
    staged = scratch_path(spark, "staged-tokens")
    made = sequences(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, pattern=pattern, length=length)
    made.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "5").parquet(staged)
    rows = spark.read.schema(made.schema).parquet(staged)
    counts = sorted(rows.groupBy("part").count().collect())  # one row a partition
    total, base = 0, {}
    for part, n in counts:
        base[part] = total
        total += n
    bases = spark.sparkContext.broadcast(base)
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    stride, shards = length * 2, max(1, -(-total // shard_sequences))
    each = -(-shards // most_tasks)
    tasks = -(-shards // each)

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=5)
        for b in batches:
            numbers = np.array([bases.value[p] for p in b["part"]], np.int64) + np.array(b["place"], np.int64)
            slots = permute(numbers, total, key)
            order = np.argsort(slots)
            cuts = np.flatnonzero(np.diff(slots[order] // shard_sequences)) + 1
            out: dict[str, list] = {k: [] for k in ("shard", "slots", "n_tokens", "doc_ids", "packed")}
            for rows in np.split(order, cuts) if len(order) else []:
                out["shard"].append(int(slots[rows[0]] // shard_sequences))
                out["slots"].append(slots[rows].tolist())
                out["n_tokens"].append([b["n_tokens"][i] for i in rows])
                out["doc_ids"].append([b["doc_ids"][i] for i in rows])
                out["packed"].append(pack.compress(b"".join([b["tokens"][i] for i in rows])))
            yield out

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        fs, root = pyarrow.fs.FileSystem.from_uri(out_uri)
        unpack = zstandard.ZstdDecompressor()
        held: dict[int, dict] = {}  # one shard at a time; bounded by a shard's size

        def close(shard: int, h: dict) -> dict:
            name = f"shard-{shard:08d}.bin"
            temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
            try:
                with fs.open_output_stream(temporary) as stream:
                    stream.write(memoryview(h["bytes"]))
                fs.move(temporary, f"{root}/{name}")
            except BaseException:
                with contextlib.suppress(OSError):  # it may not have come to be
                    fs.delete_file(temporary)
                raise
            places = range(len(h["n_tokens"]))
            return {
                "slot": [shard * shard_sequences + i for i in places],
                "shard": [shard] * len(places),
                "byte_offset": [i * stride for i in places],
                "n_tokens": h["n_tokens"],
                "doc_ids": h["doc_ids"],
                "tokens_crc32": [zlib.crc32(h["bytes"][i * stride : (i + 1) * stride]) for i in places],
            }

        for b in batches:
            for shard, slots, n_tokens, doc_ids, packed in zip(b["shard"], b["slots"], b["n_tokens"], b["doc_ids"], b["packed"]):
                size = min(shard_sequences, total - shard * shard_sequences)
                h = held.setdefault(shard, {"bytes": bytearray(size * stride), "n_tokens": [0] * size, "doc_ids": [None] * size, "left": size})
                raw = unpack.decompress(packed)
                for i, slot in enumerate(slots):
                    at = slot % shard_sequences
                    h["bytes"][at * stride : (at + 1) * stride] = raw[i * stride : (i + 1) * stride]
                    h["n_tokens"][at], h["doc_ids"][at] = n_tokens[i], doc_ids[i]
                h["left"] -= len(slots)
                if not h["left"]:
                    yield close(shard, held.pop(shard))
        if held:
            raise ValueError(f"shards {sorted(held)} are not complete")

    # Sequences of one shard travel together, packed; a shard is put in order in memory, so nothing is sorted.
    placed = map_batches(rows, place, f"shard int, slots array<bigint>, n_tokens array<int>, doc_ids array<array<{kind}>>, packed binary", rows=20_000)
    dealt = placed.repartitionById(tasks, F.floor(F.col("shard") / each).cast("int"))
    dealt = dealt.sortWithinPartitions("shard") if each > 1 else dealt
    manifest = map_batches(dealt, write, f"slot bigint, shard int, byte_offset bigint, n_tokens int, doc_ids array<{kind}>, tokens_crc32 bigint")
    manifest.write.parquet(f"{out_uri}/manifest")
    meta = {"sequences": total, "length": length, "shard_sequences": shard_sequences, "key_sha256": hashlib.sha256(key.encode()).hexdigest()}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{out_uri}/meta")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return spark.read.schema(manifest.schema).parquet(f"{out_uri}/manifest")


def read_slots(out_uri: str, start: int, *, length: int = 1024, shard_sequences: int = 8192, last: int | None = None) -> Iterator[np.ndarray]:
    """Sequences in training order from slot start on: one seek, then sequential reads."""
    fs, root = pyarrow.fs.FileSystem.from_uri(out_uri)
    slot, stride = start, length * 2
    while last is None or slot < last:
        path = f"{root}/shard-{slot // shard_sequences:08d}.bin"
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return
        with fs.open_input_file(path) as f:
            f.seek(slot % shard_sequences * stride)
            while (last is None or slot < last) and len(raw := f.read(stride)) == stride:
                yield np.frombuffer(raw, "<u2")
                slot += 1
        if slot % shard_sequences:
            return


def new_output(spark: SparkSession) -> str:
    return scratch_path(spark, "training-order")
