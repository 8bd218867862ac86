"""Shared helpers of the training-data operators: scratch tables, blocks of documents, block-wise sums.

``cut`` replaces a lineage by a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``, which every executor reaches; ``discard`` deletes such tables once later
ones have replaced them, and what is left goes when the driver ends.  ``pack_blocks`` turns texts
into blocks of token arrays, one row a block.  ``block_sums`` answers, for sorted key lists of many
blocks, what the keys add up to over the whole corpus.
"""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where driver and executors are one process (tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a cluster has to name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
    return named or LOCAL_SCRATCH


@contextmanager
def _shuffle_files_freed(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as the written table replaces them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the written table.

    With ``bucket`` the table is dealt by that column into as many buckets as the session has
    shuffle partitions, so that grouping by it later needs no shuffle of the table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    table = None
    with _shuffle_files_freed(spark):
        writer = df.write.option("compression", "zstd")
        if bucket:
            n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"scratch_{uuid.uuid4().hex}"
            df.repartition(n, bucket).write.option("compression", "zstd").bucketBy(n, bucket).option("path", path).saveAsTable(table)
        else:
            writer.parquet(path)
    out = spark.table(table) if table else spark.read.schema(df.schema).parquet(path)
    out._scratch = (path, table)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing will read again."""
    for df in tables:
        path, table = df._scratch
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        fs, at = _folder(df.sparkSession, path)
        fs.delete(at, True)


#: Tables that lazy results still read; the next stage deletes those that its own input does not.
_HELD: list[DataFrame] = []


def hold(*tables: DataFrame) -> None:
    """Keep tables made by :func:`cut` for a result that is still to be computed; see :func:`release`."""
    _HELD.extend(tables)


def release(docs: DataFrame) -> None:
    """Delete held tables that ``docs`` does not read: what was made of them has been written by now."""
    if _HELD:
        read = docs.inputFiles()
        gone = [x for x in _HELD if not any(x._scratch[0].rsplit("/", 1)[-1] in f for f in read)]  # folders have names of their own
        discard(*gone)
        _HELD[:] = [x for x in _HELD if not any(x is y for y in gone)]


#: The column that tells rows apart, whatever their doc_id, and the one that holds the row as it was.
ROW, WHOLE = "_row_key", "_row"


def with_row_keys(docs: DataFrame) -> DataFrame:
    """(ROW, WHOLE): the rows as structs, each with a distinct number, written first, so that every read has the same.

    Columns of ``docs`` stay inside the struct, so that none can clash with a working column.
    """
    return cut(docs.select(F.monotonically_increasing_id().alias(ROW), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(WHOLE)), "keyed-rows")


def keyed_texts(keyed: DataFrame) -> DataFrame:
    """(ROW, doc_id, text) of keyed rows; the scan reads no other column."""
    return keyed.select(ROW, F.col(f"{WHOLE}.doc_id").alias("doc_id"), F.col(f"{WHOLE}.text").alias("text"))


def whole_rows(keyed: DataFrame) -> DataFrame:
    """The rows as they were."""
    return keyed.select(*[F.col(WHOLE)[c].alias(c) for c in keyed.schema[WHOLE].dataType.names])


#: Rows up to this many are broadcast to the documents, more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def without_rows(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose keys ``gone`` does not have; few keys are broadcast, so that texts are not shuffled."""
    few = gone.count() <= BROADCAST_ROWS
    return whole_rows(keyed.join(F.broadcast(gone) if few else gone, ROW, "left_anti"))


def crc_remainder(doc_id, modulus: int):
    """``crc32(doc_id as text) mod modulus``; null ids count as remainder 0 of the empty text."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(0)) % modulus


# -- memory of Python workers ---------------------------------------------------------------


@lru_cache(maxsize=1)
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may lack it


def give_back() -> None:
    """Return to the system what this worker has freed; Spark keeps workers, and an idle one would hold it."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def freed(made: pa.Table) -> pa.Table:
    """``made``, once the memory that making it took is given back."""
    give_back()
    return made


def freeing_batches(work: Callable) -> Callable:
    """A function over batches that gives back memory when it ends."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return each


# -- blocks -------------------------------------------------------------------------------

#: A block: its number, its rows' keys, ids and lengths, and its words as places in the list of distinct ones.
BLOCK = "block long, rows binary, ids binary, flags binary, lengths binary, tokens binary, words binary, n_docs long, n_tokens long, n_windows long"
_BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
#: Stands for a null doc_id: after all others.
NO_ID = (1 << 63) - 1


class Block(NamedTuple):
    number: int
    rows: np.ndarray
    ids: np.ndarray
    flags: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    words: list[bytes]


def pack_blocks(docs: DataFrame, split: Callable[[str], list[bytes]], first: tuple[bytes, ...] = (), flag: Column | None = None, window: int = 1, block_bytes: int = 6 << 20, key: str | None = None) -> DataFrame:
    """Texts as blocks of about ``block_bytes``, each task packing the rows it reads: one row a block.

    ``split`` makes the words of a text; ``first`` are words that every block numbers 0, 1, ...
    A text longer than a block is a block of its own.  ``window`` sets what n_windows counts;
    ``key`` names the column of row numbers, if there is one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def fresh():
            known = defaultdict(itertools.count().__next__)  # the next number for a new word
            for w in first:
                known[w]
            return known, [], [], [], [], []

        known, rows, ids, flags, lengths, parts = fresh()

        def block():
            n = np.array(lengths, np.int64)
            arrays = [np.array(rows, np.int64), np.array(ids, np.int64), np.array(flags, np.uint8), n]
            values = [number, *[x.tobytes() for x in arrays], pack_counts(np.concatenate(parts)), b"\n".join(list(known)[len(first) :]), len(n), int(n.sum()), int(np.maximum(n - window + 1, 0).sum())]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], _BLOCK_NAMES)

        size = 0
        for b in batches:
            for row, doc, text, marked in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = split(text or "")
                parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                rows.append(row)
                ids.append(NO_ID if doc is None else doc)
                flags.append(bool(marked))
                lengths.append(len(words))
                size += len(text or "") + 32
                if size >= block_bytes:
                    yield block()
                    number, size = number + 1, 0
                    known, rows, ids, flags, lengths, parts = fresh()
        if rows:
            yield block()

    row = F.col(key) if key else F.lit(0).cast("long")
    marked = F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(False)
    return docs.select(row, F.col("doc_id").cast("long"), "text", marked.alias("flag")).mapInArrow(pack, BLOCK)


def read_block(table: pa.Table | pa.RecordBatch, i: int = 0, first: tuple[bytes, ...] = ()) -> Block:
    """The block in row ``i``."""
    at = lambda name, kind: np.frombuffer(table[name][i].as_py(), kind)
    blob = table["words"][i].as_py()
    words = [*first, *(blob.split(b"\n") if blob else [])]
    return Block(table["block"][i].as_py(), at("rows", np.int64), at("ids", np.int64), at("flags", np.uint8).astype(bool), at("lengths", np.int64), unpack_counts(table["tokens"][i].as_py()).view(np.int64), words)


# -- sorted key lists ---------------------------------------------------------------------


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as gaps in the fewest whole bytes, stored plane by plane."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max() if len(gaps) > 1 else 0).bit_length() + 7) // 8)
    planes = gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(planes).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    """The inverse of :func:`pack_sorted`."""
    if not data:
        return np.zeros(0, np.uint64)
    width, first = data[0], np.frombuffer(data, np.uint64, 1, 1)
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(np.concatenate([first, gaps.reshape(-1).view(np.uint64)]), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane (upper planes are mostly zero)."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    """The inverse of :func:`pack_counts`."""
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.uint64)


#: shard, block, sorted keys, and packed columns that go with them.
REQUEST = "shard long, block long, keys binary, sums array<binary>"
REQUEST_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("sums", pa.list_(pa.binary()))])
REPLY = "block long, shard long, sums array<binary>"
REPLY_ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("sums", pa.list_(pa.binary()))])


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(schema.types)], schema=schema)


def as_batches(made: Callable[[pa.RecordBatch], pa.Table]) -> Callable:
    """A function of one-block tables as one over Arrow batches of blocks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from made(b.slice(i, 1)).to_batches()

    return each


def shard_bounds(keys: np.ndarray, n_shards: int, bits: int) -> np.ndarray:
    """Where each of ``n_shards`` equal ranges of the ``bits``-bit key space begins in sorted ``keys``."""
    edges = [(i << bits) // n_shards for i in range(n_shards)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


def request_rows(block: int, keys: np.ndarray, sums: list[np.ndarray], n_shards: int, bits: int = 64, pack=None) -> pa.Table:
    """A block's sorted distinct ``keys`` with its own counts, a row for each shard it touches."""
    at, pack = shard_bounds(keys, n_shards, bits), pack or pack_counts
    rows = [(s, block, pack_sorted(keys[a:b]), [pack(x[a:b]) for x in sums]) for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a]
    return rows_of(rows, REQUEST_ARROW)


def by_shard(requests: DataFrame, n_shards: int):
    """Requests grouped by shard, dealt into as many partitions as there are shards."""
    return requests.repartition(n_shards, "shard").groupBy("shard")


def mapped(values: np.ndarray) -> np.ndarray:
    """The array memory-mapped from a file that has no name any more, so that nothing is left behind."""
    if not len(values):
        return values
    with tempfile.TemporaryFile() as f:
        values.tofile(f)
        f.flush()
        return np.memmap(f, values.dtype, "r", shape=values.shape)


def read_replies(replies: pa.Table, keys: np.ndarray, n_shards: int, n_sums: int, bits: int = 64) -> list[np.ndarray]:
    """Put a block's replies back into the order of its sorted ``keys``."""
    at = shard_bounds(keys, n_shards, bits)
    out = [np.zeros(len(keys), np.uint64) for _ in range(n_sums)]
    for shard, sums in zip(replies["shard"].to_pylist(), replies["sums"].to_pylist(), strict=True):
        for x, y in zip(out, sums, strict=True):
            x[at[shard] : at[shard + 1]] = unpack_counts(y)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values, so that ranges of the result are even."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
