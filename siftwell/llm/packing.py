"""Hierarchical residual packing of token pieces into sequences of fixed length.

Every input partition cuts its documents into pieces and packs them by best fit, longest first. Bins that are
full but for ``slack`` tokens are sequences. The underfull ones go up a tree as items of their own: in every round
the bins of ``fan_in`` nodes are packed together by best fit, nearly full bins come out as sequences and the rest go
on, until one node is left. What no round could fill is opened once more, and its pieces are packed by best fit.

A round needs only how many bins there are of each fill, at most ``capacity`` numbers a node: bins of one fill go into
alike bins in bulk, which gives as many as taking them one by one (``plan``). A bin then finds its place by its number
among the bins of its fill. So no task gathers bins, no bin is closed because there are many, and no piece is ever
left out.

Bins are told apart by how much room they have, and a bitmap over the possible rooms finds the best fit in
constant time.

Defined results: a null or empty text is the single end-of-document id; repeated rows and repeated ids are
packed row by row; a text of any length is cut into pieces; an empty table gives an empty result; columns besides the
two named ones are not read, whatever they are called.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_groups, materialise
from .tokens import document_ids, encoder

#: Bits of a sequence's number that count within a node of the tree; above them come the node's number and then the round's.
LOCAL_BITS, ROUND_BITS = 36, 58
#: The first number of a bin of pieces that no round could place; those of rounds are smaller.
SHARED_BINS = 1 << 62
#: Up to so many rows of a round's plan are broadcast; more are joined by key.
BROADCAST_ROWS = 100_000


def best_fit(sizes: list[int], capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of every item, and the fill of every bin; items are taken longest first."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    fill: list[int] = []
    open_bins: dict[int, list[int]] = {}  # room: bins
    rooms = 0  # bit r: a bin with room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        placed[i] = (b, fill[b])
        fill[b] += size
        left = room - size
        if left:
            stack = open_bins.setdefault(left, [])
            if not stack:
                rooms |= 1 << left
            stack.append(b)
    return placed, fill


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole, or cut from the end so that the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int, dict[int, list[tuple[int, int]]]]:
    """Best fit, longest first, of counts[length] items of each length, in bulk; the number of bins; the ranges (first bin, how many)
    of bins with room, by room. For each length the runs (first item, first bin, items a bin, offset in the bin): items of a run
    fill its bins one after another."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first bin, how many)
    rooms = 0  # bit r: a bin with room r

    def leave(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if room and n:
            open_bins.setdefault(room, []).append((first, n))
            rooms |= 1 << room

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        taken, count = 0, counts[size]
        found = runs.setdefault(size, [])
        while taken < count:
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    rooms ^= 1 << room
            else:
                room, first, n = capacity, bins, -(-(count - taken) // (capacity // size))
                bins += n
            each = room // size
            whole = min(n, (count - taken) // each)
            if whole:
                found.append((taken, first, each, capacity - room))
                taken += whole * each
                leave(room - each * size, first, whole)
            if whole < n:
                rest = min(count - taken, each)  # fewer than each, for all that are left
                if rest:
                    found.append((taken, first + whole, each, capacity - room))
                    taken += rest
                    leave(room - rest * size, first + whole, 1)
                leave(room, first + whole + bool(rest), n - whole - bool(rest))
    return runs, bins, open_bins


def steps(counts: dict[int, int], capacity: int, full: int) -> dict[int, list[tuple[int, int, int, int, int, int]]]:
    """One round over counts[fill] bins of each fill: plan's runs, cut so that all bins of a step end alike. To a run's numbers a step
    adds the fill of its bins and the first one's number among the underfull bins of that fill; 0 and 0 if they are done."""
    runs, _, rooms = plan(counts, capacity)
    underfull, seen = [], Counter()
    for first, n, room in sorted((first, n, room) for room, found in rooms.items() for first, n in found):
        if capacity - room < full:
            underfull.append((first, n, capacity - room, seen[room]))
            seen[room] += n
    begins = [x[0] for x in underfull]
    out: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
    for size, found in runs.items():
        ends = [x[0] for x in found[1:]] + [counts[size]]
        cut = out[size] = []
        for (item, first, each, offset), end in zip(found, ends):
            b, stop = first, first - (item - end) // each
            while b < stop:
                at = bisect_right(begins, b) - 1
                if at >= 0 and b < underfull[at][0] + underfull[at][1]:
                    begin, n, fill, number = underfull[at]
                    until, after = begin + n, (fill, number + b - begin)
                else:
                    until, after = begins[at + 1] if at + 1 < len(begins) else stop, (0, 0)
                cut.append((item + (b - first) * each, b, each, offset, *after))
                b = min(stop, until)
    return out


def merge(loose: DataFrame, names: tuple[str, ...], level: int, fan_in: int, capacity: int, full: int) -> DataFrame:
    """One round: the bins of fan_in nodes as items. loose has a row a piece, with names, its bin's node, fill and number among the
    node's bins of that fill, and its offset in the bin. Returns the same of the bins that the round makes, and ``bin``, the
    sequence's number where it is done; its fill is 0 then."""
    # The piece at a bin's start stands for the bin.
    counts = loose.where("offset = 0").groupBy("node", "fill").agg(F.count("*").alias("n")).withColumn("parent", F.floor(F.col("node") / F.lit(fan_in)).cast("int"))

    def fit(key: tuple, rows: dict[str, list]) -> dict[str, list]:
        """The plan of one parent: at most fan_in rows of each fill."""
        total: Counter = Counter()
        out: dict[str, list] = {"node": [], "fill": [], "parent": [], "base": [], "steps": []}
        for node, fill, n in sorted(zip(rows["node"], rows["fill"], rows["n"])):
            for k, v in zip(out, (node, fill, key[0], total[fill], n)):
                out[k].append(v)
            total[fill] += n
        found = steps(total, capacity, full)
        starts = {fill: [x[0] for x in cut] for fill, cut in found.items()}
        for i, (fill, base, n) in enumerate(zip(out["fill"], out["base"], out["steps"])):
            out["steps"][i] = [list(x) for x in found[fill][bisect_right(starts[fill], base) - 1 : bisect_left(starts[fill], base + n)]]
        return out

    plans = materialise(map_groups(counts, ["parent"], fit, "node int, fill bigint, parent int, base bigint, steps array<array<bigint>>"), "round-plan")
    if plans.count() <= BROADCAST_ROWS:
        plans = F.broadcast(plans)  # counted
    item = loose.join(plans, ["node", "fill"]).withColumn("item", F.col("number") + F.col("base"))
    item = item.withColumn("step", F.element_at(F.filter("steps", lambda s: s[0] <= F.col("item")), -1))
    item = item.withColumn("nth", F.expr("(item - step[0]) div step[2]"))
    offset = F.col("offset") + F.expr("step[3] + (item - step[0]) % step[2] * fill")
    number = F.lit(level << ROUND_BITS) + F.shiftleft(F.col("parent").cast("bigint"), LOCAL_BITS) + F.expr("step[1] + nth")
    done = F.expr("step[4] = 0")
    return item.select(*names, F.col("parent").alias("node"), F.expr("step[4]").alias("fill"), F.expr("step[5] + nth").alias("number"), offset.alias("offset"), F.when(done, number).alias("bin"))


def pack(docs: DataFrame, *, id_col: str, text_col: str, vocabulary: str, pattern: str, capacity: int = 1024, slack: int = 8, fan_in: int = 16, at_once: int = 300_000) -> DataFrame:
    """Rows of pieces: id_col, piece, start, length, ids_crc32, sequence_id, offset. fan_in nodes meet in a round; a partition packs
    at_once pieces at a time."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    full = capacity - slack
    names = ("id", "piece", "start", "length", "ids_crc32")
    piece = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def local(batches: Iterator[dict]) -> Iterator[dict]:
        encode, part, first_bin = encoder(vocabulary, pattern, added_tokens=True), TaskContext.get().partitionId(), 0
        held: dict[str, list] = {k: [] for k in names}
        underfull: Counter = Counter()  # fill: bins so far

        def flush() -> dict:
            nonlocal first_bin
            placed, fill = best_fit(held["length"], capacity)
            numbers: list[int | None] = []
            for f in fill:
                numbers.append(underfull[f] if f < full else None)
                underfull[f] += 1
            base = (part << LOCAL_BITS) + first_bin
            first_bin += len(fill)
            out = {k: held[k] for k in names} | {"node": [part] * len(placed), "fill": [fill[b] for b, _ in placed], "number": [numbers[b] for b, _ in placed]}
            out |= {"offset": [o for _, o in placed], "bin": [base + b if numbers[b] is None else None for b, _ in placed]}
            for k in names:
                held[k] = []
            return out

        for b in batches:
            for key, text in zip(b["id"], b["text"]):
                ids = document_ids(encode, text)
                for n, (start, length) in enumerate(pieces(len(ids), capacity)):
                    for k, v in zip(names, (key, n, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        held[k].append(v)
            if len(held["id"]) >= at_once:
                yield flush()
        if held["id"]:
            yield flush()

    rows = materialise(map_batches(source, local, f"{piece}, node int, fill bigint, number bigint, offset bigint, bin bigint"), "packed-pieces")
    most = 64 * rows.count()
    columns = [F.col("id").alias(id_col), *names[1:], F.col("bin").alias("sequence_id"), "offset"]
    finished, loose = rows.where("bin is not null").select(*columns), rows.where("bin is null")
    nodes, level = (rows.agg(F.max("node")).first()[0] or 0) + 1, 0
    while nodes > 1:
        nodes, level = -(-nodes // fan_in), level + 1
        rows = materialise(merge(loose, names, level, fan_in, capacity, full), "merged-pieces", most)
        finished, loose = finished.unionByName(rows.where("bin is not null").select(*columns)), rows.where("bin is null")

    def number(batches: Iterator[dict]) -> Iterator[dict]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            numbers = []
            for length in b["length"]:
                numbers.append(seen[length])
                seen[length] += 1
            yield b | {"part": [part] * len(numbers), "number": numbers}

    loose = materialise(map_batches(loose.select(*names), number, f"{piece}, part int, number bigint"), "loose-pieces", most)
    # Numbers of loose pieces count on from partition to partition.
    counts = materialise(loose.groupBy("part", "length").agg(F.count("*").alias("n")), "loose-lengths", most)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    runs, *_ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    shared = docs.sparkSession.sparkContext.broadcast({size: ([r[0] for r in found], found) for size, found in runs.items()})

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            bins, offsets = [], []
            for size, number in zip(b["length"], b["number"]):
                starts, found = shared.value[size]
                start, first, each, offset = found[bisect_right(starts, number) - 1]
                bins.append(SHARED_BINS + first + (number - start) // each)
                offsets.append(offset + (number - start) % each * size)
            yield {k: b[k] for k in names} | {"bin": bins, "offset": offsets}

    numbered = loose.join(bases, ["part", "length"]).select(*names, (F.col("number") + F.col("base")).alias("number"))
    placed = map_batches(numbered, place, f"{piece}, bin bigint, offset bigint")
    return finished.unionByName(placed.select(*columns))
