"""Embedding near-duplicates by cross-polytope hashing.

A vector is scaled to length 1, padded to a power of two, and rotated by random signs and fast Hadamard transforms;
its hash under one rotation is the signed axis nearest to it. A bucket is named by the hashes under K rotations, and
there are several tables of them. Multiprobe: a vector enters its own bucket and, for each rotation, the one where the
second nearest axis stands in; vectors that share a bucket are candidates, and each candidate pair is verified by its
cosine in double precision. K grows with the logarithm of the number of distinct vectors, and the tables with K.

Hashing alone misses some pairs near the bound. An exact check follows: all classes are dealt into blocks of at most
EXACT bytes, every pair of blocks is one task's matrix products, and a pair that shares no bucket counts there. This is
quadratic work in floats (BLAS) and ships each vector once a block, but a task holds two blocks and no more.

Equal vectors are one class with a multiplicity. Buckets of one class end before vectors travel; a bucket of more
than BLOCK classes is compared in pairs of blocks, so no task holds more than two, and nothing is capped. A pair that
meets in several buckets counts in the smallest of them. Tasks give counts and forests of links, never all pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of unlike
lengths are never compared; repeated rows link with each other; an empty table gives no rows; ties on axes go to the
first axis; extra columns are ignored; rows with a null id count as vectors and get no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, bounded_batches, components, local_forest, mixed, stored

LEAST = 0.95
#: Rotations that name a bucket, and tables, for up to a few million vectors; rounds of signs and transform in a rotation.
ROTATIONS, TABLES, ROUNDS = 3, 8, 2
#: Classes that a task compares with as many others at a time.
BLOCK = 1024
#: Bytes of vectors in a block of the exact check, and blocks that share its work at least.
EXACT, SPREAD = 1 << 25, 4
#: No bucket has this name.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(unit: np.ndarray, rotations: int, tables: int, seed: int = 11) -> np.ndarray:
    """The buckets of each vector of length 1: (n, tables * (rotations + 1)) hashes, the own bucket of a table first."""
    n, width = unit.shape
    d = max(2, 1 << (width - 1).bit_length())
    padded = np.zeros((n, d), np.float32)
    padded[:, :width] = unit
    r = np.random.default_rng(seed)
    out = np.zeros((n, tables * (rotations + 1)), np.uint64)
    for t in range(tables):
        near = np.zeros((rotations, 2, n), np.uint64)
        for k in range(rotations):
            x = padded
            for _ in range(ROUNDS):
                x = hadamard(x * r.choice(np.array([-1, 1], np.float32), d))
            size = np.abs(x)
            for place in range(2):
                axis = size.argmax(1)
                near[k, place] = 2 * axis + (x[np.arange(n), axis] > 0)
                size[np.arange(n), axis] = -1
        for probe in range(rotations + 1):
            h = np.full(n, t * 1_000_003 + width, np.uint64)
            for k in range(rotations):
                h = mixed(h * MIX + near[k, int(probe == k + 1)])
            out[:, t * (rotations + 1) + probe] = h
    return out


def _vectors(column: pa.Array) -> tuple[list[np.ndarray | None], list[bytes | None]]:
    """Each usable vector in double precision, and its bytes; None where it links with nothing."""
    values, raw = [], []
    for x in column:
        v = None
        if x.is_valid and len(x) and x.values.null_count == 0:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            norm = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
            if norm == 0 or not math.isfinite(norm):
                top = np.abs(v).max() if np.isfinite(v).all() else 0.0
                v = v / top if top > 0 else None  # too small or too large to square
        values.append(v)
        raw.append(None if v is None else v.tobytes())
    return values, raw


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def shared_bucket(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """The smallest bucket that both rows of codes have in a table; NONE without one."""
    out = np.full(len(a), NONE)
    each = a.shape[1] // tables
    for t in range(0, a.shape[1], each):
        for i in range(t, t + each):
            for j in range(t, t + each):
                np.minimum(out, np.where(a[:, i] == b[:, j], a[:, i], NONE), out=out)
    return out


def linked(unit: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with the cosine `least` or more, BLOCK rows by BLOCK at a time: single precision finds where they are, double decides."""
    low = least - 1e-5 - 1e-6 * unit.shape[1]
    single = unit.astype(np.float32)
    same = left is right
    for i in range(0, len(left), BLOCK):
        for j in range(i if same else 0, len(right), BLOCK):
            x, y = left[i : i + BLOCK], right[j : j + BLOCK]
            near = single[x] @ single[y].T >= low
            if same and i == j:
                near &= np.tri(len(x), k=-1, dtype=bool).T
            if near.any():
                rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                sure = (unit[x[rows]] @ unit[y[columns]].T >= least) & near[np.ix_(rows, columns)]
                a, b = np.nonzero(sure)
                yield x[rows[a]], y[columns[b]]


def near_duplicates(vectors: DataFrame, embedding: str = "embedding", key: str = "vec_id", least: float = LEAST) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bounded_batches(vectors)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_vectors(b.column(1))[1], pa.binary())], ["id", "v"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("e")).mapInArrow(read, "id long, v binary").withColumn("digest", F.when(F.col("v").isNotNull(), F.md5("v")))
    classes = stored(rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("m"), F.any_value("v").alias("v")).withColumn("c", F.xxhash64("digest")))
    n = classes.count()
    top = classes.agg(F.max(F.octet_length("v"))).first()[0] or 16
    axes = 2 * max(2, 1 << (top // 8 - 1).bit_length())
    rotations = max(ROTATIONS, math.ceil(math.log(max(n, 2)) / math.log(axes)))
    tables = math.ceil(TABLES * 1.35 ** (rotations - ROTATIONS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_length(data: list[bytes]) -> Iterator[np.ndarray]:
        lengths = np.array([len(x) for x in data])
        for w in np.unique(lengths):
            yield np.flatnonzero(lengths == w)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, data = b.column(0).to_numpy(), b.column(1).to_pylist()
            for own in by_length(data):
                found = np.sort(codes(_unit([data[i] for i in own]), rotations, tables), 1)
                new = np.ones(found.shape, bool)
                new[:, 1:] = found[:, 1:] != found[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64)), pa.array(np.repeat(ids[own], new.sum(1)))], ["bucket", "c"])

    entries = stored(classes.select("c", "v").mapInArrow(hashed, "bucket long, c long"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = entries.join(shared, "bucket").withColumn("own", F.pmod(F.xxhash64("c", F.lit(3)), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "c")
    full = members.join(classes.select("c", "v", "m"), "c").repartition(tasks, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def compared(held: list[tuple], x: int, y: int, bucket: np.uint64) -> pa.RecordBatch:
        """Counts of links and a forest of them, of pairs whose smallest common bucket is this one."""
        own, c, m, data = (list(z) for z in zip(*held, strict=True))
        own, c, m = np.array(own), np.array(c, np.int64), np.array(m, np.int64)
        counts, forest = np.zeros(len(c), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for rows in by_length(data):
            unit = _unit([data[i] for i in rows])
            here = np.arange(len(rows))
            left, right = (here, here) if x == y else (here[own[rows] == x], here[own[rows] == y])
            for a, b in linked(unit, left, right, least):
                used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                named = codes(unit[used], rotations, tables)
                ok = shared_bucket(named[where[: len(a)]], named[where[len(a) :]], tables) == bucket
                a, b = rows[a[ok]], rows[b[ok]]
                ok = c[a] != c[b]
                a, b = a[ok], b[ok]
                np.add.at(counts, a, m[b])
                np.add.at(counts, b, m[a])
                forest = local_forest(np.concatenate([forest[0], c[a]]), np.concatenate([forest[1], c[b]]))
        hit, none = counts > 0, np.zeros(len(forest[0]), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in ((c[hit], forest[0]), (counts[hit], none), (c[hit], forest[1]))], ["c", "links", "to"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for b in batches:
            for bucket, x, y, own, c, m, v in zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in ("bucket", "x", "y", "own", "c", "m", "v")], strict=True):
                if (bucket, x, y) != name:
                    if len(held) > 1:
                        yield compared(held, *name[1:], np.uint64(name[0] & 0xFFFFFFFFFFFFFFFF))
                    name, held = (bucket, x, y), []
                held.append((own, c, m, v))
        if len(held) > 1:
            yield compared(held, *name[1:], np.uint64(name[0] & 0xFFFFFFFFFFFFFFFF))

    # bucket -1 is NONE: pairs without a bucket
    blocks = max(min(SPREAD, n // BLOCK + 1), math.ceil(n * top / EXACT))
    every = classes.withColumn("own", F.pmod(F.xxhash64("c", F.lit(5)), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = every.select(F.lit(-1).cast("long").alias("bucket"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "c", "v", "m")
    every = every.repartition(max(tasks, blocks * (blocks + 1) // 2), "x", "y").sortWithinPartitions("x", "y")
    outcome = "c long, links long, to long"
    found = stored(full.mapInArrow(compare, outcome).unionByName(every.mapInArrow(compare, outcome)))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found, "c", "to")
    label = classes.select("digest", "least", "m", "c").join(links, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    label = stored(label)
    smallest = label.groupBy("root").agg(F.min("least").alias("component"))
    label = label.join(smallest, "root").select("digest", "component", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    out = rows.select("id", "digest").join(label, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
