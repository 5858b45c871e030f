"""What the operators share: raw UTF-8 access to Arrow columns, shared storage, exact global ranks."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds: whole texts pass through Python, so a batch of very long ones must stay small.
BATCH_ROWS = 1000

#: Lower-cases A-Z, and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: White space of the shingle and language-model words, as code points (fixed values: 0x20 and 0x09-0x0D).
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keeps Arrow batches small in this session; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, int64 offsets (n + 1, from 0) and a null mask of a string or binary column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else np.zeros(n, bool)
    if n == 0 or pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.ones(n, bool) if n else nulls
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if nulls.any() and (np.diff(at)[nulls] > 0).any():
        column = pa.array([x.as_py() if x.is_valid else None for x in column], column.type)
        return utf8(column)
    return raw, at, nulls


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """Each value's bytes; None for null."""
    raw, at, nulls = utf8(column)
    whole = raw.tobytes()
    for i in range(len(nulls)):
        yield None if nulls[i] else whole[at[i] : at[i + 1]]


def tidy(task):
    """A task's function over batches that gives freed memory back to the system at its end, as Python workers serve many tasks."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        given_back()

    return run


def given_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class Numbered(dict):
    """Numbers keys as they are first looked up; `new` lists those not yet encoded."""

    def __init__(self, entries=()):
        super().__init__(entries)
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


def gathered(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The rows `which` of a ragged array, one after another."""
    sizes = at[which + 1] - at[which]
    total = int(sizes.sum())
    return flat[np.repeat(at[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name in the folder that driver and executors share; set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows, written once to shared storage and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    (df.select(*columns) if columns else df).write.parquet(path)
    back = df.sparkSession.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by stored() that are no longer read."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        if path := getattr(frame, "stored_at", None):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffles of finished jobs: it does so once the driver's collector has met them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list[str], group: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds `name`: a gapless number from 0 within each value of `group`, in the order of `order`.

    A range sort on (group, order) deals equal shares whatever a group's size; the sorted rows are stored, each
    partition's first row number per group is summed up on the driver (groups + partitions rows at most), and a
    broadcast of those offsets numbers the rows. No window, so no group has to fit one task.
    """
    keys = [group, *[c for c in order if c != group]]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    kept = stored(dealt.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    firsts = kept.groupBy(F.col(group).alias("__nb_group"), part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).collect()
    before: dict = {}
    rows = []
    for r in sorted(firsts, key=lambda r: r["__part"]):
        rows.append((r["__nb_group"], r["__part"], r["__first"] - before.get(r["__nb_group"], 0)))
        before[r["__nb_group"]] = before.get(r["__nb_group"], 0) + r["__n"]
    kind = dict(df.dtypes)[group]
    offsets = df.sparkSession.createDataFrame(rows, f"__nb_group {kind}, __part bigint, __shift bigint")
    out = kept.join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col("__nb_group")) & (part == F.col("__part")))
    return out.withColumn(name, F.col("__at") - F.col("__shift")).drop("__at", "__nb_group", "__part", "__shift")


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as a forest: each node that is not the smallest of its component, and that smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


#: Links of a forest that one task finishes: 16 bytes each.
LOCAL_LINKS = 1 << 18


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every linked node but the smallest of each component, and that smallest node.

    Each task turns its links into a forest. Where LOCAL_LINKS or fewer are left, one task joins these. Else large-star and small-star steps then alternate until nothing changes, a
    logarithmic number of rounds. Minima are aggregated before they are joined, so a hub is no single task's work.
    """
    spark = links.sparkSession

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = 0
        for batch in batches:
            for side, column in zip(held, batch.columns, strict=True):
                side.append(column.to_numpy().astype(np.int64))
            size += batch.num_rows
            if size > 1 << 20:
                held = tuple([x] for x in local_forest(*map(np.concatenate, held)))
                size = len(held[0][0])
        u, v = local_forest(*map(np.concatenate, held))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = stored(pairs.mapInArrow(tidy(forest), "u long, v long").distinct())
    if now.count() <= LOCAL_LINKS:
        done = stored(now.coalesce(1).mapInArrow(tidy(forest), "u long, v long"))
        discard(spark, now)
        return done.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a hub's links may fill a task: the join's large partitions are split at run time (adaptive skew join)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        discard(spark, now)
        now = new


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads nearby values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd factor and its inverse modulo 2**64; a random 64-bit value for each byte, the same for a letter of A-Z and its lower case.
_FACTOR = 0xD1342543DE82EF95
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)[np.frombuffer(LOWER, np.uint8)]
_SPACE = np.isin(np.arange(256), list(SPACES))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(max(n, 1 << 20), x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def hash_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, lower-cased in A-Z, of texts that lie one after another; each text's first word.

    A word's hash is the sum of its bytes' values times powers of the factor, from sums over the whole block.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:n], out=sums[1:])
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * MIX), np.searchsorted(start, at)


def word_blocks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes of texts, in blocks of about `limit` bytes: (first text, text after the last, hashes, each text's first word)."""
    raw, at, _ = utf8(column)
    k, n = 0, len(at) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(at, at[k] + limit, side="right")) - 1)
        yield k, j, *hash_words(raw[at[k] : at[j]], at[k : j + 1] - at[k])
        k = j


def tasks_for(df: DataFrame, each: int) -> int:
    """Tasks of about `each` bytes by the plan's estimate of the table, and no fewer than the session's shuffle partitions."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 56 else max(least, -(-size // each))  # a plan without an estimate says 2**63


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
