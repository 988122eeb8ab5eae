"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, opened by Spark alone so that any store Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: under the session's spark.checkpoint.dir, or under a temporary folder
    where that is unset and the one machine is all there is."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(app)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    return f"{root.rstrip('/')}/siftwell-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Bytes of a written file at which tables with a known bound are cut.
FILE_BYTES = 128 << 20


def materialise(df: DataFrame, name: str, at_most: int | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back, so that losing an executor costs a re-read
    and never a recomputation. at_most: a counted bound of the table's bytes, where there is one; so many files of FILE_BYTES
    are enough for it (twice the cores at least), and every file costs its making."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if at_most is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-at_most // FILE_BYTES)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes what materialise wrote for df, which must not be read again. Only under the shared folder."""
    spark = df.sparkSession
    own = shared_folder(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{own.rsplit('/', 1)[1]}/" in path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def joined_by_key(rows: DataFrame, by_key: DataFrame, key: str, most: int, few: int, width: int, written: list[DataFrame]) -> DataFrame:
    """rows joined with by_key, which has one row a key and at most ``most`` rows. If these are no more than ``few``, they are
    broadcast; else they are written (and put on the list), so that both sides of the join come plainly out of a shuffle and
    Spark can split a key that many rows have."""
    if most <= few:
        return rows.join(F.broadcast(by_key), key)
    kept = materialise(by_key, "by-key", most * width)
    written.append(kept)
    return rows.join(kept, key)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def hash_share(column: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the value and the salt only; rows of one value get one number."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def sample_per_label(rows: DataFrame, label: str, key: str, per_label: int, salt: str, max_labels: int = 2000) -> DataFrame:
    """A deterministic sample of about per_label rows of each label, for fitting classifiers only.

    The share of each label comes from counts over all rows; the choice depends on the hash of key.
    Repeated keys hash alike, so a hard bound of twice the expected number of rows closes the sample. More than max_labels
    labels are an error: none is left out.
    """
    counts = rows.groupBy(label).count().limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} values of {label}")
    if not counts:
        return rows.limit(0)
    shares = F.create_map(*[F.lit(x) for row in counts for x in (row[0], min(1.0, per_label / row[1]))])
    return rows.where(hash_share(F.col(key), salt) < F.try_element_at(shares, F.col(label))).limit(2 * per_label * len(counts))


def map_batches(df: DataFrame, function: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow over plain Python columns. function gets an iterator over batches of at most ``rows`` rows, each a dict of
    lists, once a partition, and yields dicts of lists in the order of schema. Only one batch at a time is held as Python
    objects."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                yield {name: column.to_pylist() for name, column in zip(part.schema.names, part.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(plain(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_groups(df: DataFrame, keys: list[str], function: Callable[[tuple, dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """function(key, columns of its rows) for every key, over sorted partitions: many small groups cost little.
    The caller bounds the rows of a key. Yields dicts of lists in the order of schema."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held_key, held, out = None, None, {n: [] for n in names}

        def close() -> None:
            for n, values in function(held_key, held).items():
                out[n].extend(values)

        for b in batches:
            columns = list(b)
            heads = list(zip(*[b[k] for k in keys]))
            start = 0
            for i in range(1, len(heads) + 1):
                if i < len(heads) and heads[i] == heads[start]:
                    continue
                part = {c: b[c][start:i] for c in columns}
                if held_key is not None and held_key == heads[start]:
                    for c in columns:
                        held[c].extend(part[c])
                else:
                    if held_key is not None:
                        close()
                    held_key, held = heads[start], part
                start = i
                if len(out[names[0]]) >= 5000:
                    yield out
                    out = {n: [] for n in names}
        if held_key is not None:
            close()
        yield out

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)
