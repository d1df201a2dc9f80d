"""Input columns, the shared folder, and exchanges of packed arrays.

``pick`` reads named columns of any frame. ``exchange`` moves packed arrays (one binary row for each
task and bucket, not one row for each item) to the shard's own partition, in order of bucket, so that
a shard is worked off bucket by bucket. ``Folder`` keeps arrays that are too large to broadcast in the
shared folder of ``spark.checkpoint.dir``, from which workers map them into memory.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import mix

def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; of columns with one name (in any case) the first that is spelt alike."""
    columns = df.columns
    low = [c.lower() for c in columns]
    at = [columns.index(n) if n in columns else low.index(n.lower()) for n in names]
    flat = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return flat.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def numbered(df: DataFrame) -> DataFrame:
    """The frame with its columns called c0, c1 .., for functions over whole rows of frames with clashing names."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


#: Bytes of input that a shard and a bucket of a shard are made for, and the largest number of shards.
SHARD, BUCKET, MOST_SHARDS = 48 << 20, 64 << 20, 1 << 14


def input_bytes(df: DataFrame) -> int:
    """The size of what the frame reads, by Spark's own estimate of its sources; 0 for one that has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def shards_of(df: DataFrame) -> tuple[int, int]:
    """(shards, buckets in each): as many shards as shuffle partitions, more for a large input, and buckets
    where even the most shards would be too large to hold."""
    size = input_bytes(df)
    shards = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-size // SHARD)))
    return shards, max(1, -(-size // (shards * BUCKET)))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (one machine, tests) an own one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridforge-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


class Folder:
    """A new folder in the shared one, which goes when the application ends. Files are written whole under
    another name and then renamed, so a task that runs twice leaves the same file."""

    def __init__(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/gridforge-{uuid.uuid4().hex}")
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = str(store.makeQualified(path).toString())  # one place for Spark and for workers
        store.mkdirs(path)
        store.deleteOnExit(path)

    def _place(self, name: str):
        from pyarrow import fs

        path = f"{self.path}/{name}"
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return fs.FileSystem.from_uri(path)

    @contextmanager
    def output(self, name: str):
        """A stream to a file that is there once the block has ended well."""
        store, path = self._place(name)
        store.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            yield out
        store.move(part, path)

    def write(self, name: str, array: np.ndarray) -> None:
        with self.output(name) as out:
            out.write(_raw(array))

    def read(self, name: str, dtype) -> np.ndarray:
        from pyarrow import fs

        store, path = self._place(name)
        if isinstance(store, fs.LocalFileSystem):
            return _mapped(path, dtype)
        with store.open_input_file(path) as file:
            return np.frombuffer(file.read_buffer(), dtype)

    @contextmanager
    def pack(self, name: str):
        """A function that adds arrays of unsigned numbers to a file; a list of their places ends it."""
        with self.output(name) as out:
            places, at = [], 0

            def add(*arrays: np.ndarray) -> None:
                nonlocal at
                for a in arrays:
                    out.write(_raw(a))
                    out.write(bytes(-a.nbytes % 8))
                    places.append((at, a.itemsize, a.size))
                    at += a.nbytes + -a.nbytes % 8

            yield add
            out.write(np.array([*(x for p in places for x in p), len(places)], np.int64).tobytes())

    def unpack(self, name: str) -> list[np.ndarray]:
        """The arrays of a pack, mapped."""
        raw = self.read(name, np.uint8)
        count = int(raw[-8:].view(np.int64)[0])
        places = raw[len(raw) - 8 - 24 * count : -8].view(np.int64).reshape(-1, 3).tolist()
        return [raw[at : at + width * size].view(f"u{width}") for at, width, size in places]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The frame, written as Parquet here and read again: cuts lineage and outlives executors."""
        df.write.parquet(f"{self.path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, spark: SparkSession, name: str) -> None:
        """Remove what save() wrote, once nothing reads it any more."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _raw(array: np.ndarray):
    return memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b""


def _mapped(path: str, dtype) -> np.ndarray:
    """The file, mapped; where Python can, without keeping it open, as there may be thousands."""
    if not os.path.getsize(path):
        return np.zeros(0, dtype)
    with open(path, "rb") as file:
        try:
            return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), dtype)
        except TypeError:
            return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), dtype)


def by_shard(shard: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, the columns' bytes one after another) of each shard that has items; order inside is kept."""
    order = np.argsort(shard, kind="stable") if len(shard) and np.any(shard[1:] < shard[:-1]) else slice(None)
    columns = tuple(c[order] for c in columns)
    edge = np.searchsorted(shard[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edge)):
        yield int(k), b"".join(c[edge[k] : edge[k + 1]].tobytes() for c in columns)


def unpack(blobs, dtypes) -> list[np.ndarray]:
    """The columns of by_shard() blobs, joined."""
    size = sum(np.dtype(d).itemsize for d in dtypes)
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // size, 0
        for part, d in zip(parts, dtypes, strict=True):
            part.append(np.frombuffer(blob, d, n, at))
            at += n * np.dtype(d).itemsize
    return [np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, dtypes, strict=True)]


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of the 64-bit key, so shards in order are the whole in order."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def exchange(df: DataFrame, n: int, fine: int = 1) -> DataFrame:
    """Rows with ``bucket`` in 0..n * fine - 1 to the partition bucket // fine, in order of bucket.

    Each partition gets a row without a blob besides, so that none is planned away where there are no rows.
    """
    every = df.sparkSession.range(0, n, 1, 1).select((F.col("id") * fine).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("blob"))
    df = df.select("bucket", "blob").unionByName(every)
    return df.repartitionById(n, F.expr(f"cast(bucket div {fine} as int)")).sortWithinPartitions("bucket")


def buckets_of(batches, fine: int) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, its blobs) of each bucket of this shard in turn; only one bucket's blobs are held."""
    from pyspark import TaskContext

    bucket = TaskContext.get().partitionId() * fine
    end = bucket + fine
    rows = ((b, x) for batch in batches for b, x in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True))
    for b, group in groupby(rows, itemgetter(0)):
        yield from ((k, []) for k in range(bucket, b))
        yield b, [x for _, x in group if x is not None]
        bucket = b + 1
    yield from ((k, []) for k in range(bucket, end))


def blob_batches(pairs, names=("bucket", "blob"), types=(pa.int32(), pa.binary()), most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded size."""
    rows: list[tuple] = []
    size = 0
    for pair in pairs:
        rows.append(pair)
        size += sum(len(x) for x in pair if isinstance(x, bytes | str)) + 64
        if size >= most:
            yield _batch(rows, names, types)
            rows, size = [], 0
    if rows:
        yield _batch(rows, names, types)


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, found) of each wanted value (sorted) in sorted keys."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def without(df: DataFrame, gone: DataFrame, folder: Folder, key: str = "row") -> DataFrame:
    """The rows of df, with all columns but the key, whose key (a long) isn't among gone's.

    Gone's keys become sorted arrays in the folder, which workers map; df is read through and not shuffled.
    """
    (n, fine) = shards_of(df)
    buckets, at = n * fine, df.columns.index(key)
    rest = [k for k in range(len(df.columns)) if k != at]

    def mixed(column) -> np.ndarray:
        return np.sort(mix(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = mixed(batch.column(0))
            yield from blob_batches(by_shard(shard_of(hashed, buckets), buckets, hashed))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        with folder.pack(f"gone-{TaskContext.get().partitionId()}") as add:
            for _, blobs in buckets_of(batches, fine):
                add(np.sort(unpack(blobs, (np.uint64,))[0]))
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    exchange(gone.select(key).mapInArrow(send, "bucket int, blob binary"), n, fine).mapInArrow(write, "done long").agg(F.sum("done")).first()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [x for k in range(n) for x in folder.unpack(f"gone-{k}")]
        for batch in batches:
            hashed = mix(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            bucket, stays = shard_of(hashed, buckets), np.ones(len(hashed), bool)
            for k in np.unique(bucket):
                mine = np.flatnonzero(bucket == k)
                stays[mine] = ~lookup(tables[k], hashed[mine])[1]
            kept = batch.filter(pa.array(stays))
            yield pa.RecordBatch.from_arrays([kept.column(k) for k in rest], schema=pa.schema([kept.schema.field(k) for k in rest]))

    names = [df.columns[k] for k in rest]
    whole = numbered(df)
    return whole.mapInArrow(keep, whole.drop(f"c{at}").schema).toDF(*names)
