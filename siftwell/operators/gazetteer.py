"""Places named in texts, from a table of names of any size and two levels.

Of the outer names the first, in the table's order, that a text holds is its place; of that place's own inner names the first that it
holds is its part. Names are found by automata. A level that is small, counted before it is broadcast, is one automaton a worker, and
texts stay where they are. Of a larger level names and texts meet by groups: blocks of the outer names, or the inner names of
one outer name (in blocks, if it has many). Of a partition's groups one at a time is in memory: its names come first, then its texts one after
another. Texts of an outer name that has many are dealt to shares, each with these names. Equal texts are searched once.

Names and texts are compared in small letters, as parts of the text whatever stands around them. Null and empty names are
nowhere, and a null rank comes last; a null text has no place; ties of order go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of names in a block, and of a group's texts in a share, about.
BLOCK_BYTES, SHARE_BYTES = 32 << 20, 64 << 20


def _automaton(names: dict[str, object]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for name, value in names.items():
        made.add_word(name, value)
    made.make_automaton()
    return made


class _Names:
    """What is broadcast of a small level, and the automaton that a worker makes of it."""

    def __init__(self, rows: list[tuple[str, int | None, int, int]]):
        self.rows, self._automaton = rows, None

    def automaton(self):
        if self._automaton is None:
            by: dict[str, list[tuple[int | None, tuple[int, int]]]] = {}
            for name, outer, rank, place in self.rows:
                by.setdefault(name, []).append((outer, (rank, place)))
            self._automaton, self.rows = _automaton(by), []
        return self._automaton


def _bytes(name: str) -> Column:
    return F.octet_length(name) + 80


def _finder(shared, inner: bool):
    @F.pandas_udf("rank bigint, id bigint")
    def held(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        automaton = shared.value.automaton()
        out = []
        for t, w in zip(texts, wanted):
            w = None if w is None or pd.isna(w) else int(w)
            none = t is None or (inner and w is None)
            out.append((None, None) if none else min((order for _, places in automaton.iter(t) for o, order in places if o == w), default=(None, None)))
        return pd.DataFrame({c: pd.array([x[i] for x in out], dtype="Int64") for i, c in enumerate(("rank", "id"))})

    return held


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of names and texts, group by group, names first: rank and id of the first name that each text holds."""
    group, names, automaton = None, {}, None
    for b in batches:
        found = []
        for outer, block, share, is_text, text, digest, rank, place in zip(*(b[c] for c in ("outer", "block", "share", "is_text", "text", "digest", "rank", "id"))):
            key = (outer, block, share)
            if key != group:
                group, names, automaton = key, {}, None
            if not is_text:
                order = (int(rank), int(place))
                names[text] = min(order, names.get(text, order))
            elif names:
                automaton = automaton or _automaton(names)
                first = min((order for _, order in automaton.iter(text)), default=None)
                if first is not None:
                    found.append((digest, *first))
        yield pd.DataFrame(found, columns=["digest", "rank", "id"])


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _in_groups(texts: DataFrame, names: DataFrame, block_bytes: int, share_bytes: int) -> DataFrame:
    """digest, rank and id of the first name in order that each text holds among those of its outer id. texts: digest, text and outer, one
    row a text; names: name, outer, rank and id. Outer ids are null on both sides for the outer level."""
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / F.lit(block_bytes))).cast("int")
    sizes = names.groupBy("outer").agg(blocks(F.sum(_bytes("name"))).alias("blocks"))
    shares = texts.groupBy("outer").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("text") + 80) / F.lit(share_bytes))).cast("int").alias("shares"))
    both = sizes.join(shares, sizes["outer"].eqNullSafe(shares["outer"])).select(sizes["outer"], "blocks", "shares")
    met = lambda rows: rows.join(both.withColumnRenamed("outer", "its"), F.col("outer").eqNullSafe(F.col("its")))
    none = F.lit(None)
    of_names = met(names).select("outer", F.pmod(F.xxhash64("name"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("is_text"), F.col("name").alias("text"), none.cast("string").alias("digest"), "rank", "id")
    of_texts = met(texts).select("outer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("digest"), "shares").cast("int").alias("share"), F.lit(True).alias("is_text"), "text", "digest", none.cast("bigint").alias("rank"), none.cast("bigint").alias("id"))
    group = ("outer", "block", "share")
    dealt = of_names.unionByName(of_texts).repartition(*group).sortWithinPartitions(*group, "is_text")
    # Whole numbers beside nulls would pass as floating point: they travel as text.
    spelt = dealt.select(F.col("outer").cast("string").alias("outer"), "block", "share", "is_text", "text", "digest", F.col("rank").cast("string").alias("rank"), F.col("id").cast("string").alias("id"))
    found = spelt.mapInPandas(_search, "digest string, rank bigint, id bigint")
    return found.groupBy("digest").agg(F.min(F.struct("rank", "id")).alias("first")).select("digest", "first.rank", "first.id")


def _with_first(df: DataFrame, names: DataFrame, outer: Column | None, out: str, block_bytes: int, share_bytes: int) -> DataFrame:
    """df with the id of the first name in order that its column __text holds; null if there is none."""
    size = names.agg(F.sum(_bytes("name"))).first()[0]
    if size is None:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    if size <= block_bytes:
        rows = names.select("name", "outer", "rank", "id").collect()  # a small level
        shared = df.sparkSession.sparkContext.broadcast(_Names([tuple(r) for r in rows]))
        wanted = F.lit(None).cast("string") if outer is None else outer.cast("string")  # as text: numbers beside nulls would pass as floating point
        return df.withColumn(out, _finder(shared, outer is not None)(F.col("__text"), wanted)["id"])
    keyed = df.withColumn("__digest", _digest(F.col("__text")))
    of = F.lit(None).cast("bigint") if outer is None else outer
    texts = keyed.select(F.col("__digest").alias("digest"), F.col("__text").alias("text"), of.alias("outer")).where("text is not null" + ("" if outer is None else " and outer is not null"))
    once = texts.groupBy("digest").agg(F.first("text").alias("text"), F.first("outer").alias("outer"))  # a text has one outer name
    found = _in_groups(once, names, block_bytes, share_bytes).select(F.col("digest").alias("__digest"), F.col("id").alias(out))
    return keyed.join(found, "__digest", "left").drop("__digest")


def places(df: DataFrame, text_col: str, names: DataFrame, block_bytes: int = BLOCK_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """df with place: a struct of outer and inner (names as the table spells them; null where none is held). names: id, name,
    outer_id (null for outer names) and rank, the order; ids and ranks are 64-bit numbers."""
    rows = names.where("id is not null and name is not null and name <> ''").select(F.col("id").cast("bigint").alias("id"), F.col("name").alias("spelt"), F.lower("name").alias("name"), F.col("outer_id").cast("bigint").alias("outer"), F.coalesce(F.col("rank").cast("bigint"), F.lit((1 << 63) - 1)).alias("rank"))
    own = [f"`{c}`" for c in df.columns]
    spelt = lambda level: rows.select(F.col("id").alias(f"__{level}_id"), F.col("spelt").alias(f"__{level}_name"))
    found = df.withColumn("__text", F.lower(F.col(f"`{text_col}`")))
    found = _with_first(found, rows.where("outer is null"), None, "__outer_id", block_bytes, share_bytes)
    found = _with_first(found, rows.where("outer is not null"), F.col("__outer_id"), "__inner_id", block_bytes, share_bytes)
    found = found.join(spelt("outer"), "__outer_id", "left").join(spelt("inner"), "__inner_id", "left")
    return found.select(*own, F.struct(F.col("__outer_name").alias("outer"), F.col("__inner_name").alias("inner")).alias("place"))
