"""CSV files of any number and size, read by many tasks, every file by its own header.

Files are read as lines, so one large file is split like any text. Whether a line begins inside a quoted field depends on
all lines before it; a line itself only says where it ends if it begins outside, and where if inside. Such functions of two
states compose, so states are found by a prefix scan: within a block of a file by running the block's lines in order, in the task
that reads them, over the blocks of a file by the functions of whole blocks, a row a block. Then every line knows its record's
number, records of one line stay where they are, and only records with line breaks are gathered, each by itself.

The first record of a file is its header; cells are taken by name. What is refused is reported as rows, not as a failure: a file that
is binary, of another extension, of no known encoding, without a column that is asked for, or with a quote that is never closed from
there on; a record with more fields than its header or with text after a closing quote. Short records are filled up with null,
blank lines are passed over, as are files of no bytes. A line of a file must fit into a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encodings
from .uploads import EXTENSIONS, MAGIC, NO_VALUE, ROW_INDEX, UploadError, renamed, without_no_value

#: Lines with bytes beyond ASCII that an encoding is judged by, and bytes of each.
SAMPLE_LINES, SAMPLE_BYTES = 500, 1000
#: Rows of one a block or a file that are broadcast; more are joined.
FEW = 200_000
#: Names of columns that come to the driver when none are asked for.
MOST_NAMES = 10_000

# A whole field up to its comma, and a quoted field that does not end. Possessive, so that no text makes them try again.
_FIELD = '(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+'
_OPEN = f'(?:{_FIELD},)*+"[^"]*+(?:""[^"]*+)*+\\z'
_OPENS_OUTSIDE = f"\\A{_OPEN}"
_STAYS_INSIDE = f'\\A[^"]*+(?:""[^"]*+)*+(?:\\z|"[^,]*+,{_OPEN})'
_LAST_FIELD = f"({_FIELD})(?:,|\\z)"
ERRORS = "file string, row bigint, error string, message string"


@dataclass
class CsvFolder:
    rows: DataFrame  # row_index (contiguous from 0, by file and place), file, row (from 1 in the file) and the columns, as text
    errors: DataFrame  # file, row (null: the file), error (a class of uploads), message
    files: DataFrame  # file, encoding, names
    columns: list[str]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (its first byte), at (growing within a block) and line, in bytes."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    meta = lambda x: F.col(f"_metadata.{x}")
    return lines.select(meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def inspect(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, work: str | None = None) -> DataFrame:
    """file, encoding (utf-8 or a candidate; null if unknown) and error (null if the file may be read), of every file that is not
    empty. One pass, and one more over files that are not UTF-8, of whose lines that are not ASCII a bounded number a file is judged.
    work: a folder that keeps what the first pass found."""
    lines = _lines(spark, path)
    raw, line = F.col("line").cast("binary"), F.col("line")
    begins = (F.col("block") == 0) & reduce(lambda a, m: a | F.startswith(raw, F.lit(m)), MAGIC, F.lit(False))
    # Numbers and booleans alone, so that lines are not sorted to be aggregated. A file's first line is the first of block 0.
    facts = lines.groupBy("file").agg(F.count_if(~F.is_valid_utf8(line)).alias("invalid"), F.bool_or(F.contains(line, F.lit("\x00"))).alias("nul"), F.min(F.when(F.col("block") == 0, F.col("at"))).alias("top"), F.min(F.when(begins, F.col("at"))).alias("magic"))
    facts = facts.select("file", "invalid", (F.col("nul") | F.coalesce(F.col("magic") == F.col("top"), F.lit(False))).alias("binary"))
    facts = _written(facts, f"{work}/facts") if work else facts
    unlike = facts.where("invalid > 0").select("file")
    n_unlike = unlike.count()
    odd = F.octet_length("line") != F.char_length("line")
    order = Window.partitionBy("file").orderBy("block", "at")
    some = lines.join(_small(unlike, n_unlike), "file").where(odd | ~F.is_valid_utf8("line")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_LINES)
    heads = some.groupBy("file").agg(F.collect_list(F.substring(raw, 1, SAMPLE_BYTES)).alias("head_lines"))
    known = facts.join(heads, "file", "left") if n_unlike else facts.withColumn("head_lines", F.lit(None).cast("array<binary>"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            guess = [None if not n else encodings.detect(b"\n".join(bytes(x) for x in h)) if h is not None else None for n, h in zip(b["invalid"], b["head_lines"])]
            yield pd.DataFrame({"file": b["file"], "invalid": b["invalid"], "binary": b["binary"], "guess": guess})

    known = known.mapInPandas(judge, "file string, invalid bigint, binary boolean, guess string")
    named = reduce(lambda a, e: a | F.lower("file").endswith(e.lower()), extensions, F.lit(False))
    encoding = F.when(F.col("invalid") == 0, "utf-8").otherwise(F.col("guess"))
    return known.select("file", encoding.alias("encoding"), F.when(~named | F.col("binary"), "InvalidFileTypeError").when(encoding.isNull(), "EncodingDetectionError").alias("error"))


def _bit(inside: Column) -> Column:
    return inside.cast("int")


SCANNED = "file string, block bigint, n bigint, text string, outside int, inside int, state0 int, state1 int, begun0 bigint, begun1 bigint"


def _scanned(lines: DataFrame) -> DataFrame:
    """file, block, n (place in the block) and text of lines, outside and inside (whether the line ends within a quoted field if it
    begins outside, or inside), and for both states at the block's start the state before the line and the records begun so far.
    A block's lines must come one after the other, in order."""
    # The first line of a file may begin with a mark, and only the scan knows which line is the first: such lines are judged without it too.
    whole, marked, unmarked = F.col("text"), (F.col("block") == 0) & F.startswith("text", F.lit("\ufeff")), F.substring("text", 2, 1 << 30)

    def judged(text: Column) -> list[Column]:
        quoted = F.contains(text, F.lit('"'))
        return [_bit(quoted & text.rlike(_OPENS_OUTSIDE)), _bit(~quoted | text.rlike(_STAYS_INSIDE)), _bit(text.isin("", "\r"))]

    plain, of_marked = judged(whole), [F.when(marked, x) for x in judged(unmarked)]
    return lines.select("file", "block", "text", *[x.alias(f"x{i}") for i, x in enumerate(plain + of_marked)]).mapInArrow(_scan, SCANNED)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, place, states, begun = None, 0, [0, 1], [0, 0]  # of the block that the last batch ended in
    for b in batches:
        if not b.num_rows:
            continue
        file, block, text = b["file"], b["block"].to_numpy(), b["text"]
        outside, inside, blank = (b[f"x{i}"].to_numpy() for i in range(3))
        at = np.arange(b.num_rows)
        first = np.ones(b.num_rows, bool)
        first[1:] = (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        goes_on = here == (file[0].as_py(), block[0])
        first[0] = not goes_on
        marks = first & (block == 0) & b["x3"].is_valid().to_numpy(zero_copy_only=False)
        if marks.any():
            outside, inside, blank = (np.where(marks, b[f"x{i + 3}"].fill_null(0).to_numpy(), x) for i, x in enumerate((outside, inside, blank)))
            text = pc.replace_with_mask(text, pa.array(marks), pc.utf8_slice_codeunits(text.filter(pa.array(marks)), 1))
        top = np.maximum.accumulate(np.where(first, at, 0))  # the block's first line in this batch
        carried = (top == 0) & goes_on
        turns = np.cumsum((outside == 1) & (inside == 0))  # lines that turn the state, and the last one before that sets it
        before = np.concatenate(([0], turns[:-1]))
        last = np.concatenate(([-1], np.maximum.accumulate(np.where(outside == inside, at, -1))[:-1]))
        fixed = last >= top
        n = at - top + 1 + np.where(carried, place, 0)
        found, counted = [], []
        for s in (0, 1):
            state = np.where(fixed, outside[last] + before - turns[last], np.where(carried, states[s], s) + before - before[top]) % 2
            begins = np.cumsum((state == 0) & (blank == 0))
            counted.append(begins - np.where(top > 0, begins[top - 1], 0) + np.where(carried, begun[s], 0))
            found.append(state)
        here, place, begun = (file[-1].as_py(), block[-1]), n[-1], [c[-1] for c in counted]
        states = [(inside if x[-1] else outside)[-1] for x in found]
        bits = [pa.array(x, pa.int32()) for x in (outside, inside, *found)]
        yield pa.RecordBatch.from_arrays([file, b["block"], pa.array(n, pa.int64()), text, *bits, *[pa.array(c, pa.int64()) for c in counted]], "file block n text outside inside state0 state1 begun0 begun1".split())


def _blocks(scanned: DataFrame) -> DataFrame:
    """file, block, start (the state before it), base (records begun before it) and, of the file's last block, left_open."""
    last = scanned.groupBy("file", "block").agg(*[F.max_by(c, "n").alias(c) for c in ("outside", "inside", "state0", "state1", "begun0", "begun1")])
    ends = lambda s: F.when(F.col(f"state{s}") == 0, F.col("outside")).otherwise(F.col("inside"))
    last = last.select("file", "block", ends(0).alias("end0"), ends(1).alias("end1"), "begun0", "begun1")
    order = Window.partitionBy("file").orderBy("block")  # a row a block
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("turned", F.coalesce(F.sum(F.when((F.col("end0") == 1) & (F.col("end1") == 0), 1).otherwise(0)).over(before), F.lit(0)))
    last = last.withColumn("set", F.last(F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("state"), "turned")), True).over(before))
    start = F.pmod(F.coalesce(F.col("set.state") + F.col("turned") - F.col("set.turned"), F.col("turned")), F.lit(2)).cast("int")
    last = last.withColumn("start", start)
    here = lambda x: F.when(F.col("start") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1"))
    last = last.withColumns({"base": F.coalesce(F.sum(here("begun")).over(before), F.lit(0)), "end": here("end"), "begun": here("begun")})
    newest = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1
    return last.select("file", "block", "start", "base", "begun", (newest & (F.col("end") == 1)).alias("left_open"), newest.alias("newest"))


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _parsed(record: Column) -> Column:
    """fields: of a whole record, unquoted; broken: whether text follows a closing quote."""
    plain = F.split(record, ",", -1)
    opens = lambda x: x.startswith('"')
    within = lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2)
    whole = lambda x: (F.char_length(x) > 1) & x.endswith('"') & ~F.contains(F.replace(within(x), F.lit('""'), F.lit("")), F.lit('"'))
    # Nearly always every other piece between quotes is inside of them. Commas there make way (no text that is read has a NUL), and
    # if then each field is quoted from end to end or has no quote at all, that is how the record is read.
    pieces = F.transform(F.split(record, '"', -1), lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(","), F.lit("\x00"))).otherwise(x))
    simple = F.split(F.array_join(pieces, '"'), ",", -1)
    # Else fields are cut one by one. A record that does not end in a comma yields one empty match too many, at its very end.
    exact = _let(F.regexp_extract_all(record, F.lit(_LAST_FIELD), F.lit(1)), lambda c: F.when(record.endswith(","), c).otherwise(F.slice(c, F.lit(1), F.greatest(F.lit(1), F.size(c) - 1))))
    cut = _let(simple, lambda c: F.when(F.forall(c, lambda x: F.when(opens(x), whole(x)).otherwise(~F.contains(x, F.lit('"')))), c).otherwise(exact))
    inner = lambda x: F.when(opens(x), F.replace(F.replace(within(x), F.lit('""'), F.lit('"')), F.lit("\x00"), F.lit(","))).otherwise(x)
    quoted = _let(cut, lambda c: F.struct(F.transform(c, inner).alias("fields"), F.exists(c, lambda x: opens(x) & ~whole(x)).alias("broken")))
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(F.struct(plain.alias("fields"), F.lit(False).alias("broken")))


def _records(scanned: DataFrame, blocks: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """file, record (its number from 1) and text, of all whole records; and file, record of those that never end."""
    lines = scanned.join(_small(blocks.select("file", "block", "start", "base"), n_blocks), ["file", "block"])
    here = lambda x: F.when(F.col("start") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1"))
    lines = lines.select("file", "block", "n", "text", here("state").alias("state"), (F.col("base") + here("begun")).alias("record"), "outside", "state0", "state1")
    endless = blocks.where("left_open").select("file", (F.col("base") + F.col("begun")).alias("last"))
    single = lines.where((F.col("state") == 0) & (F.col("outside") == 0) & ~F.col("text").isin("", "\r")).select("file", "record", "text")
    pieces = lines.where("state0 = 1 or state1 = 1 or outside = 1").where((F.col("state") == 1) | (F.col("outside") == 1))  # the first can be told from footers
    pieces = pieces.join(_small(endless, n_blocks), "file", "left").where(F.col("last").isNull() | (F.col("record") < F.col("last")))
    joined = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("p"))  # the lines of one record
    whole = joined.select("file", "record", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    text = F.when(F.endswith("text", F.lit("\r")), F.substring("text", F.lit(1), F.char_length("text") - 1)).otherwise(F.col("text")).alias("text")
    return single.unionByName(whole).select("file", "record", text), endless.withColumnRenamed("last", "record")


def read(spark: SparkSession, path: str, work: str, columns: list[str] | None = None, *, extensions: tuple[str, ...] = EXTENSIONS, no_value: list[str] = NO_VALUE) -> CsvFolder:
    """The files under a path. work: a folder that the driver and the executors share, where the scan is kept; it must stay while
    the result is read. columns: by the names of the files' headers, repeated ones with .1, .2; None: all that any file has."""
    files = _written(inspect(spark, path, extensions, work), f"{work}/files")
    n_files = files.count()
    good = files.where("error is null")
    lines = _lines(spark, path).join(_small(good.select("file", "encoding"), n_files), "file")
    text = F.when(F.col("encoding") == "utf-8", F.col("line")).otherwise(encodings.decoded_column(F.col("line").cast("binary"), F.col("encoding")))
    lines = lines.select("file", "block", "at", text.alias("text"))
    if n_files > FEW:  # the join has mixed the lines
        lines = lines.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    scanned = _written(_scanned(lines), f"{work}/lines")
    blocks = _written(_blocks(scanned), f"{work}/blocks")
    n_blocks = blocks.count()
    records, endless = _records(scanned, blocks, n_blocks)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # a row a file
            yield pd.DataFrame({"file": b["file"], "encoding": b["encoding"], "names": [None if h is None else renamed(list(h)) for h in b["header"]]})

    # A file's first record is the first or none of its block; that can be told from footers.
    first = _records(scanned.where("begun0 <= 1 or begun1 <= 1"), blocks, n_blocks)[0].where("record = 1").select("file", _parsed(F.col("text"))["fields"].alias("header"))
    headers = good.select("file", "encoding").join(_small(first, n_files), "file", "left").mapInPandas(name, "file string, encoding string, names array<string>")
    headers = _written(headers, f"{work}/headers")
    if columns is None:
        found = headers.select(F.posexplode("names").alias("i", "name")).groupBy("name").agg(F.min("i").alias("i")).orderBy("i", "name").limit(MOST_NAMES + 1).collect()
        if len(found) > MOST_NAMES:
            raise UploadError(f"The files have more than {MOST_NAMES} different columns.")
        wanted, needed = [r["name"] for r in found], []
    else:
        wanted = needed = list(columns)
    lacking = F.array_except(F.array(*[F.lit(c) for c in needed]).cast("array<string>"), F.col("names"))
    refused = F.when(F.col("names").isNull(), "NoColumnsError").when(F.size(lacking) > 0, "CSVParseError")
    said = F.when(F.col("names").isNull(), "The file has no header.").otherwise(F.concat(F.lit("The header lacks "), F.array_join(lacking, ", "), F.lit(".")))
    headers = headers.withColumns({"error": refused, "message": said})
    taken = headers.where("error is null").select("file", "names")

    # Rows are numbered without a gap: a file's records follow those of the files before it.
    sizes = blocks.groupBy("file").agg((F.sum("begun") - F.max(F.col("left_open").cast("long"))).alias("records")).join(_small(taken, n_files), "file")
    places = F.array(*[F.coalesce(F.array_position("names", F.lit(c)), F.lit(0)).cast("int") - 1 for c in wanted]).cast("array<int>")
    bases = sizes.select("file", F.size("names").alias("n_names"), places.alias("places"), (F.coalesce(F.sum(F.col("records") - 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("first"))  # a row a file
    bases = _written(bases, f"{work}/bases")
    body = records.where("record > 1").join(_small(bases, n_files), "file")
    # Exploded, as filters would repeat what is merely projected.
    body = body.select("file", (F.col("record") - 1).alias("row"), (F.col("first") + F.col("record") - 2).alias(ROW_INDEX), "n_names", "places", F.explode(F.array(_parsed(F.col("text")))).alias("parsed"))
    body = body.select("file", "row", ROW_INDEX, "n_names", "places", "parsed.*")
    surplus = F.size("fields") > F.col("n_names")
    cell = lambda i: without_no_value(F.get("fields", F.get("places", F.lit(i))), no_value)
    rows = body.where(~surplus & ~F.col("broken")).select(ROW_INDEX, "file", "row", *[cell(i).alias(c) for i, c in enumerate(wanted)])
    wrong = F.when(F.col("broken"), "Text follows a closing quote.").otherwise(F.concat(F.lit("The row has "), F.size("fields"), F.lit(" fields, the header has "), F.col("n_names"), F.lit(".")))
    unread = {"InvalidFileTypeError": "The file is binary or of another extension.", "EncodingDetectionError": "The file's encoding could not be told."}
    of_files = files.where("error is not null").select("file", F.lit(None).cast("long").alias("row"), "error", reduce(lambda a, e: F.when(F.col("error") == e[0], e[1]).otherwise(a), unread.items(), F.lit("")).alias("message"))
    of_headers = headers.where("error is not null").select("file", F.lit(None).cast("long").alias("row"), "error", "message")
    of_rows = body.where(surplus | F.col("broken")).select("file", "row", F.lit("CSVParseError").alias("error"), wrong.alias("message"))
    of_ends = endless.select("file", (F.col("record") - 1).alias("row"), F.lit("CSVParseError").alias("error"), F.lit("A quote is never closed.").alias("message"))
    errors = of_files.unionByName(of_headers).unionByName(of_rows).unionByName(of_ends)
    return CsvFolder(rows, errors, headers.select("file", "encoding", "names"), wanted)
