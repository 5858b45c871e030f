"""Sharding by best-fit-decreasing bin packing of indivisible groups.

best_fit() is the packer: sizes in descending order, each item into the bin with the tightest remaining capacity that
still holds it, found in a balanced search tree of remaining capacities. It works on size classes (size, count), so
thousands of equal items are placed by a few tree operations.

shards() deals rows to a fixed number of shards of nearly equal bytes: groups are rows with equal texts, kept whole.
The driver sees only the histogram of group sizes, whose length is bounded (exact below 2^16 bytes, 15 significant
bits above), finds the smallest capacity at which best-fit-decreasing needs no more bins than there are shards, and
sends the bins back as runs over the groups' rank within their class. Ranks come from a range sort, not a window.
A group of more bytes than a shard's share cannot be whole in a shard of equal size: its rows are cut, in key order,
into pieces of about SHARE-th of a share each, which are packed as groups of their own (group_split is then true).

Cases: null texts have 16 bytes and form one group, apart from empty texts, which also have 16; equal sizes are
ordered by the text's SHA-256; rows with an equal key and text are ordered arbitrarily among themselves; an empty
table gives no rows; one text larger than a shard's share fills a shard alone and the others share the rest evenly as
far as possible; extra columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

ROW_BYTES = 16
#: Pieces of a cut group per share of a shard.
SHARE = 20
#: Significant bits of a size class above 2^16 bytes.
BITS = 15
#: Groups of at least this part of all rows are joined by broadcast, so no join key is hot: at most as many such groups.
HEAVY_PARTS = 2000


class Capacities:
    """A treap of (remaining capacity, bin): the ceiling of a size is the tightest bin that holds it."""

    __slots__ = ("root", "random")

    def __init__(self, seed: int = 1):
        self.root, self.random = None, random.Random(seed)

    @staticmethod
    def _split(node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = Capacities._split(node[3], key)
            node[3] = a
            return node, b
        a, b = Capacities._split(node[2], key)
        node[2] = b
        return a, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Capacities._merge(a[3], b)
            return a
        b[2] = Capacities._merge(a, b[2])
        return b

    def add(self, room: int, bin_: int) -> None:
        a, b = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(a, [(room, bin_), self.random.random(), None, None]), b)

    def ceiling(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def remove(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        _, c = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, c)


def best_fit(classes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each (size, count), sizes descending: runs (bin, items). Opens bins as needed; None if more than `bins`."""
    tree, opened, out = Capacities(), 0, []
    for size, count in classes:
        runs = []
        while count:
            found = tree.ceiling(size)
            if found is None:
                if size > capacity or opened == bins:
                    return None
                found = (capacity, opened)
                opened += 1
            else:
                tree.remove(found)
            # the tightest bin stays the tightest while it still holds an item of this size
            n = min(count, found[0] // size) if size else count
            runs.append((found[1], n))
            count -= n
            tree.add(found[0] - n * size, found[1])
        out.append(runs)
    return out


def pack(classes: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """best_fit() at the smallest capacity, to one part in a hundred thousand, that needs no more than `bins` bins."""
    classes = sorted(classes, reverse=True)
    total = sum(s * n for s, n in classes)
    low = max(-(-total // bins), max((s for s, _ in classes), default=0), 1)
    found = best_fit(classes, low, bins)
    if found is not None:
        return found
    bad, good = low, low
    while found is None:
        good = good + max(1, good // 1000) if good == low else good + 2 * (good - low)
        found = best_fit(classes, good, bins)
    while good - bad > max(1, low // 100_000):
        middle = (good + bad) // 2
        tried = best_fit(classes, middle, bins)
        if tried is None:
            bad = middle
        else:
            good, found = middle, tried
    return found


def size_class(size: Column) -> Column:
    """The size itself below 2^16, else rounded up to BITS significant bits: a bounded number of classes."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))).cast("long")
    return F.when(size < 65536, size).otherwise(F.floor((size + step - 1) / step).cast("long") * step)


def shards(docs: DataFrame, n: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, size, text_crc32, shard, slot (gapless from 0 in each shard, in key order), group_split."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("__key"),
        (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(t.cast("binary"), 256))).alias("__group"),
    )
    rows = stored(rows)
    groups = rows.groupBy("__group").agg(F.count("*").alias("__rows"), F.sum("size").alias("__size"))
    groups = stored(groups)
    all_rows, all_bytes = groups.agg(F.sum("__rows"), F.sum("__size")).first()
    if not all_rows:
        return rows.select(F.col("__key").alias(key), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(False).alias("group_split"))
    share = -(-all_bytes // n)
    # at most n groups hold more than a share; their rows are numbered and cut
    large = [(bytes(r["__group"]), r["__rows"], r["__size"]) for r in groups.where((F.col("__size") > share) & (F.col("__rows") > 1)).collect()]
    pieces, cut = [], {}
    for g, count, size in large:
        per = max(1, share // SHARE // (size // count))
        cut[g] = per
        pieces += [(g, i, min(per, count - i * per) * (size // count)) for i in range(-(-count // per))]
    whole = groups.where(~F.col("__group").isin([F.lit(g) for g in cut])) if cut else groups
    whole = whole.withColumn("__class", size_class(F.col("__size")))
    classes = {r["__class"]: r["n"] for r in whole.groupBy("__class").agg(F.count("*").alias("n")).collect()}
    ranked = numbered(whole.withColumn("__down", -F.col("__class")), ["__group"], "__down", "__rank")
    counts = dict(classes)
    for _, _, size in pieces:
        counts[size] = counts.get(size, 0) + 1
    order = sorted(counts.items(), reverse=True)
    runs = {size: r for (size, _), r in zip(order, pack(order, n), strict=True)}
    # a class's groups come first in its runs, then the pieces of that size
    spans, left = [], {}
    for size, r in runs.items():
        at, room = 0, classes.get(size, 0)
        for b, k in r:
            take = min(k, room - at)
            if take > 0:
                spans.append((size, at, at + take, b))
            at += max(take, 0)
            left.setdefault(size, []).extend([b] * (k - max(take, 0)))
    where = spark.createDataFrame(spans, "__of long, __from long, __to long, __bin int")
    placed = ranked.join(F.broadcast(where), (F.col("__class") == F.col("__of")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))).select("__group", "__rows", "__bin")
    placed = stored(placed)
    heavy_rows = max(2, all_rows // HEAVY_PARTS)
    heavy = placed.where(F.col("__rows") >= heavy_rows).select("__group", F.col("__bin").alias("__heavy"))
    light = placed.where(F.col("__rows") < heavy_rows).select("__group", "__bin")
    by_heavy = rows.join(F.broadcast(heavy), "__group", "left")
    out = by_heavy.where(F.col("__heavy").isNotNull()).select("__key", "size", "text_crc32", F.col("__heavy").alias("shard"), F.lit(False).alias("group_split"))
    rest = by_heavy.where(F.col("__heavy").isNull()).drop("__heavy")
    if cut:
        mine = rest.where(F.col("__group").isin([F.lit(g) for g in cut])).withColumn("__hex", F.hex("__group"))
        rest = rest.where(~F.col("__group").isin([F.lit(g) for g in cut]))
        mine = numbered(mine.select("__key", "size", "text_crc32", "__hex"), ["__key"], "__hex", "__nth")
        at = spark.createDataFrame([(g.hex().upper(), i, left[size].pop(0)) for g, i, size in pieces], "__hex string, __piece long, shard int")
        per = F.coalesce(*[F.when(F.col("__hex") == g.hex().upper(), F.lit(k)) for g, k in cut.items()])
        mine = mine.withColumn("__piece", F.floor(F.col("__nth") / per)).join(F.broadcast(at), ["__hex", "__piece"])
        out = out.unionByName(mine.select("__key", "size", "text_crc32", "shard", F.lit(True).alias("group_split")))
    rest = rest.join(light, "__group").select("__key", "size", "text_crc32", F.col("__bin").alias("shard"), F.lit(False).alias("group_split"))
    out = numbered(out.unionByName(rest), ["__key", "text_crc32"], "shard", "slot")
    return out.select(F.col("__key").alias(key), "size", "text_crc32", "shard", "slot", "group_split")
