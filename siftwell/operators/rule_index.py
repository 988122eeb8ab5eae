"""Rules by the thousand: an index for each target in place of an expression for each rule.

Bounds of a target are sorted, so the ones a number breaks are a range found by bisection; values that must be equal, or be among
some, are looked up by their text; patterns run once for a distinct text, each once for all of its rules, and only if one pattern made of
all of them fits at all. The index of all targets is broadcast, bounded by ``MOST`` rules. More rules stay a table: blocks of them and
shares of the cells meet in tasks, of each pair the rules first, then the cells one after another. A task gives tiles, cells times
rules that all of them break, in pieces of a bounded number; Spark makes the rows of violations of them, and only the columns asked for.
What counts as a number, a blank or a null is said by the same expressions as for a few rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain, groupby
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Rules that are broadcast at most, and violations that a task holds at a time, about.
MOST, PIECE = 100_000, 200_000
#: Cells of a share, about.
SHARE_CELLS = 200_000
#: A table of rules: as operators.rules.Rule, condition_value as JSON.
RULE_COLUMNS = ("rule_id", "target_kind", "target_value", "condition_operator", "condition_value", "action", "severity", "is_active")
#: Cells and rules of a tile at most: its rows are held at once when it is taken apart.
TILE_CELLS, TILE_RULES = 32, 512
_OF_CELLS = ("record_id", "column_name", "row_index", "cleaned_value")
_OF_RULES = {"rule_id": pa.int64(), "severity": pa.string(), "action": pa.string()}
#: A tile: cells, and rules that each of them breaks.
SCHEMA = "record_id array<bigint>, column_name array<string>, row_index array<bigint>, cleaned_value array<string>, rule_id array<bigint>, severity array<string>, action array<string>"
#: What cannot stand in a pattern made of several: references, names and flags.
_ALONE = re.compile(r"\\[1-9]|\(\?[P(aiLmsux-]")


class _Target:
    """The rules of one column or type, in an order in which what a cell breaks are runs of places: bounds by their number, values
    by their text, equal patterns side by side."""

    def __init__(self, rules: list, compiles):
        of: dict[str, list] = {op: [] for op in ("gte", "lte", "eq", "in", "regex_match", "not_null")}
        for r in rules:
            of.get(r.condition_operator, []).append(r)
        self.bounds = {}
        for op in ("gte", "lte"):
            bounds = np.array([float(r.condition_value) for r in of[op]])
            order = np.argsort(bounds, kind="stable")
            self.bounds[op], of[op] = bounds[order], [of[op][i] for i in order]
        listed = [(r, {str(r.condition_value)}) for r in of["eq"]] + [(r, {str(x) for x in r.condition_value}) for r in of["in"]]
        listed.sort(key=lambda x: min(x[1], default=""))
        spelled = lambda r: (isinstance(r.condition_value, str), str(r.condition_value))
        of["regex_match"].sort(key=spelled)
        kinds = [of["gte"], of["lte"], [r for r, _ in listed], of["regex_match"], of["not_null"]]
        in_order = [r for kind in kinds for r in kind]
        self.columns = {c: pa.array([getattr(r, c) for r in in_order], kind) for c, kind in _OF_RULES.items()}
        self.ends = [0, *accumulate(map(len, kinds))]
        self.met: dict[str, list[int]] = {}  # text: places of the values that it meets
        for i, (_, texts) in enumerate(listed, self.ends[2]):
            for text in texts:
                self.met.setdefault(text, []).append(i)
        self.patterns, at = [], self.ends[3]  # each pattern once, with the places of its rules
        for _, same in groupby(of["regex_match"], spelled):
            same = list(same)
            if compiles(same[0].condition_value):
                self.patterns.append((re.compile(same[0].condition_value), at, at + len(same)))
            at += len(same)
        joint = [p.pattern for p, _, _ in self.patterns]
        self.any = re.compile("|".join(f"(?:{p})" for p in joint)) if joint and not any(_ALONE.search(p) for p in joint) else None
        self._forget()

    def _forget(self) -> None:
        """Which runs a text breaks is kept for a bounded number of texts and runs."""
        self.seen: dict[str, int] = {}
        self.known: dict[tuple, int] = {}
        self.runs: list[np.ndarray] = []
        self.held = 0

    def broken_by_text(self, text: str) -> int:
        """The place in ``runs`` of the values and patterns that are not met: first place, place after the last."""
        found = self.seen.get(text)
        if found is None:
            kept = [(i, i + 1) for i in self.met.get(text, ())]
            if self.any is None or self.any.match(text):
                kept += [(start, end) for p, start, end in self.patterns if p.match(text)]
            kept = tuple(chain.from_iterable(kept))
            if kept not in self.known:
                between = np.array([self.ends[2], *kept, self.ends[4]], np.int64).reshape(-1, 2)
                self.known[kept] = len(self.runs)
                self.runs.append(between[between[:, 0] < between[:, 1]])
                self.held += len(kept)
            found = self.seen[text] = self.known[kept]
            self.held += 1
        return found

    def broken(self, texts: pa.Array, numbers: np.ndarray, blanks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What cells break, for a bounded number of runs at a time: the cell's place, the first place of a run, the place after its
        last. numbers: NaN where the value is none."""
        if self.ends[2] == self.ends[4]:
            yield from self._runs(0, np.full(len(numbers), self.broken_by_text("")), numbers, blanks)
            return
        first, codes = 0, []
        for i, text in enumerate(texts.fill_null("None").to_pylist(), 1):
            codes.append(self.broken_by_text(text))
            if self.held > PIECE or i == len(texts):
                yield from self._runs(first, np.array(codes), numbers[first:i], blanks[first:i])
                first, codes = i, []
                if self.held > PIECE:
                    self._forget()

    def _runs(self, first: int, codes: np.ndarray, numbers: np.ndarray, blanks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        by_text = np.array([len(x) for x in self.runs])
        pieces = np.cumsum(by_text[codes] + self.ends[-1] // TILE_RULES + 4) // PIECE
        cuts = [0, *np.flatnonzero(np.diff(pieces)) + 1, len(codes)]
        for start, end in zip(cuts, cuts[1:]):
            cell, begin, stop = self._runs_of(codes[start:end], numbers[start:end], blanks[start:end])
            yield first + start + cell, begin, stop

    def _runs_of(self, codes: np.ndarray, numbers: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells, none = np.arange(len(codes)), np.isnan(numbers)
        place = lambda i: np.full(len(cells), self.ends[i])
        above = np.where(none, 0, np.searchsorted(self.bounds["gte"], numbers, "right"))
        below = np.where(none, len(self.bounds["lte"]), np.searchsorted(self.bounds["lte"], numbers, "left"))
        there, code = np.unique(codes, return_inverse=True)
        runs = [self.runs[i] for i in there]
        lengths = np.array([len(x) for x in runs])
        at = np.repeat((np.cumsum(lengths) - lengths)[code], lengths[code]) + _within(lengths[code])
        runs = np.concatenate(runs)[at]
        parts = [(cells, above, place(1)), (cells, place(1), self.ends[1] + below), (np.repeat(cells, lengths[code]), runs[:, 0], runs[:, 1]), (cells, place(4), np.where(blanks, place(5), place(4)))]
        cell, start, end = (np.concatenate(x) for x in zip(*parts))
        some = start < end
        return cell[some], start[some], end[some]


class RuleIndex:
    def __init__(self, rules: list, compiles):
        targets: dict[tuple[str, str], list] = {}
        for r in rules:
            if r.is_active:
                targets.setdefault((r.target_kind, r.target_value), []).append(r)
        self.targets = {k: _Target(v, compiles) for k, v in targets.items()}

    def of(self, b: pa.RecordBatch) -> Iterator[tuple[_Target, np.ndarray]]:
        """The targets of a batch of cells, each with the places of its cells."""
        for kind, column in (("column_name", "column_name"), ("detected_type", "column_type")):
            coded = b[column].dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code, name in enumerate(coded.dictionary.to_pylist()):
                if (kind, name) in self.targets:
                    yield self.targets[kind, name], np.flatnonzero(codes == code)


def violations(cells: DataFrame, rules: list, compiles) -> DataFrame:
    """As operators.rules.violations. compiles: whether a pattern can be run."""
    if len(rules) > MOST:
        raise ValueError(f"{len(rules)} rules; at most {MOST} are broadcast")
    shared = cells.sparkSession.sparkContext.broadcast((rules, compiles))
    source = _cells(cells)
    wanted = {k: [r.target_value for r in rules if r.is_active and r.target_kind == k] for k in ("column_name", "detected_type")}
    source = source.where(F.col("column_name").isin(sorted(set(wanted["column_name"]))) | F.col("column_type").isin(sorted(set(wanted["detected_type"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(*shared.value)
        for b in batches:
            yield from _judge(index, b)

    return _each(source.mapInArrow(run, SCHEMA))


def _cells(cells: DataFrame) -> DataFrame:
    value = F.col("cleaned_value")
    kinds = {"record_id": "bigint", "column_name": "string", "column_type": "string", "row_index": "bigint", "cleaned_value": "string"}
    return cells.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], F.coalesce(value.try_cast("double"), F.lit(float("nan"))).alias("number"), (~F.coalesce(strip(value) != "", F.lit(False))).alias("blank"))


def _each(tiles: DataFrame) -> DataFrame:
    """A row for each cell and each rule of a tile, made by Spark's own generated code."""
    cell = tiles.select(F.posexplode("record_id").alias("at", "cell_id"), *_OF_CELLS, *_OF_RULES)
    cell = cell.select(F.col("cell_id").alias("record_id"), *[F.get(c, F.col("at")).alias(c) for c in _OF_CELLS if c != "record_id"], *_OF_RULES)
    pair = cell.select(F.posexplode("rule_id").alias("at", "one_rule"), *_OF_CELLS, *_OF_RULES)
    return pair.select(F.col("one_rule").alias("rule_id"), *_OF_CELLS, *[F.get(c, F.col("at")).alias(c) for c in _OF_RULES if c != "rule_id"])


def _judge(index: RuleIndex, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for target, at in index.of(b):
        cells = b if len(at) == len(b) else b.take(pa.array(at))
        for runs in target.broken(cells["cleaned_value"], cells["number"].to_numpy(), cells["blank"].to_numpy(zero_copy_only=False)):
            yield from _rows(cells, target, *_tiles(*runs))


def _tiles(cell: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells side by side that break the same rules, where a tile's cells begin among them, and the run of its rules. Runs are cut at
    fixed places, so that cells whose runs only overlap have most of the pieces in common."""
    strip = start // TILE_RULES
    pieces = (end - 1) // TILE_RULES - strip + 1
    at = np.repeat(np.arange(len(cell)), pieces)
    strip = (strip[at] + _within(pieces)) * TILE_RULES
    cell, start, end = cell[at], np.maximum(start[at], strip), np.minimum(end[at], strip + TILE_RULES)
    order = np.lexsort((end, start))
    cell, start, end = cell[order], start[order], end[order]
    other = np.flatnonzero(np.diff(start, prepend=-1) | np.diff(end, prepend=-1))
    first = np.flatnonzero(_within(np.diff(other, append=len(cell))) % TILE_CELLS == 0)
    return cell, first, start[first], end[first]


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _rows(cells: pa.RecordBatch, target: _Target, cell: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each tile, a bounded number of cells and rules at a time."""
    n_cells, n_rules = np.diff(first, append=len(cell)), end - start
    batch = np.cumsum(n_cells + n_rules) // PIECE
    for some in np.split(np.arange(len(first)), np.flatnonzero(np.diff(batch)) + 1) if len(first) else ():
        of_cells = pa.array(cell[first[some[0]] : first[some[-1]] + n_cells[some[-1]]])
        of_rules = pa.array(np.repeat(start[some], n_rules[some]) + _within(n_rules[some]))
        lists = lambda lengths, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)
        made = {c: lists(n_cells[some], cells[c].take(of_cells)) for c in _OF_CELLS} | {c: lists(n_rules[some], target.columns[c].take(of_rules)) for c in _OF_RULES}
        yield pa.RecordBatch.from_pydict(made)


def violations_of_table(cells: DataFrame, rules: DataFrame, compiles, most: int = MOST, share_cells: int = SHARE_CELLS) -> DataFrame:
    """As violations, for any number of rules. rules: RULE_COLUMNS, one row a rule. No rule comes to the driver, and a task holds the
    rules of one block at a time."""
    rules = rules.where("is_active")
    blocks, shares = max(1, -(-rules.count() // most)), max(1, -(-cells.count() // share_cells))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    source = _cells(cells).select("*", F.lit(None).cast("string").alias("rule"))
    one = {f.name: F.lit(None) for f in source.schema} | {c: F.lit(0) for c in ("record_id", "row_index", "number")} | {"blank": F.lit(False), "rule": F.to_json(F.struct(*RULE_COLUMNS))}
    of_rules = rules.select(*[one[f.name].cast(f.dataType).alias(f.name) for f in source.schema], F.pmod(F.xxhash64("rule_id"), F.lit(blocks)).cast("int").alias("block"), each(shares).alias("share"), F.lit(False).alias("is_cell"))
    of_cells = source.select("*", each(blocks).alias("block"), F.pmod(F.xxhash64("record_id", "column_name"), F.lit(shares)).cast("int").alias("share"), F.lit(True).alias("is_cell"))
    group = ["block", "share"]
    met = of_rules.unionByName(of_cells).repartitionById(blocks * shares, F.col("block") * shares + F.col("share")).sortWithinPartitions("is_cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, index = [], None
        for b in batches:
            n_rules = len(b) - b["is_cell"].true_count
            if n_rules:
                made = json.loads(f"[{','.join(b['rule'].slice(0, n_rules).to_pylist())}]")
                there += [SimpleNamespace(**(dict.fromkeys(RULE_COLUMNS) | r | {"condition_value": None if r.get("condition_value") is None else json.loads(r["condition_value"])})) for r in made]
            if there and n_rules < len(b):
                index = index or RuleIndex(there, compiles)
                yield from _judge(index, b.slice(n_rules))

    return _each(met.mapInArrow(run, SCHEMA))
