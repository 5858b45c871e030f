"""Exact Jaccard join of word-shingle sets over a token-group matrix.

A document's set holds its distinct shingles of `width` words, as 64-bit hashes; fewer words are one shingle. Two
documents link when PERCENT * |union| <= 100 * |intersection|. Documents with equal sets are one class, numbered by 64
bits of the set's digest; a table with two sets of one number (their other 64 bits tell) is numbered anew.

1. Partitions of similar documents: each class sends the least of its shingles (its head, see heads()) to where equal ones
   meet, and counts how many another class has sent, too: linked sets have a share of their heads in common, so a class
   with fewer links with none. A shingle travels in eight bytes however many tasks there are: half its hash and half its
   class; classes of one half stay without a count. Of the classes that are left, those whose shingles other classes have
   (any of them, together) do not reach the bound leave, too. So documents that only share passages go before groups are
   made. What is left is cut by hash into k parts, more than the number d of elements in which linked sets of that size
   may differ, so linked sets agree on a part. Where parts meet, a class is joined to the smallest class there (no pairs
   are made), and connected classes are one group, outside which no set reaches the bound. A part without elements is
   sent only where so many are empty that they could be all the agreement there is.
2. A group is cut into chunks of about CHUNK shingles. In a chunk documents are taken one by one; each partition found
   so far has its token union as a row of the matrix. Of a set that reaches the bound on a row, one of any
   |set| - need + 1 tokens lies in that row, so the rarest tokens name the rows to look at; how much of the set lies in
   a row's union bounds its overlap with every member, and only partitions that reach the bound are opened, their
   members compared exactly until one links.
3. In a group of several chunks one document per partition is compared with the others of its group in rounds, while
   that at least halves their number. A link that is still missing joins two partitions, one end lies outside the
   largest partition, and that end overlaps with the unions of its group's other partitions by what a link needs. Only
   documents that reach this bound are dealt to blocks, each block is a matrix, and all that is left of the group
   queries it in slices: a query opens the partitions that qualify and joins none to the matrix. Blocks come in rounds,
   so that not all copies of the texts lie on disk at once.

Texts are shingled in one pass that gives set sizes, numbers and heads together, and travel once more to find those that
may link, which are stored. What tasks count for a class goes packed to the task that sums it up. The number of tasks
follows the table's size.

Cases: null, empty and word-free texts have an empty set and link with nothing; repeated rows and equal texts share a
class; rows that share a key with different texts are compared each, and may be of different components; ties and very
long texts are nothing special; an empty table gives no rows; extra columns, also of clashing names, are ignored by
clusters() and kept by drop_near_duplicates(). A row with a null key has the component of equal sets with a key, else
null, and is never compared or dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, bounded_batches, components, discard, local_forest, mixed, stored, swept, tasks_for, tidy, unused, word_blocks

PERCENT, WIDTH = 85, 4
#: Shingles that one task of the matrix holds of a group, but for a larger single set.
CHUNK = 1 << 17
#: Chunks of a block, and of a slice of its queries: texts travel once per block or slice of their group.
BLOCK = 4
#: Blocks that a row is sent to, and slices that a block is sent to, at a time.
COPIES = 4
#: Bytes of the table for a task; hashes that a task packs at a time.
TASK_BYTES, PACKED = 8 << 20, 1 << 20
#: How a head's hashes and their classes travel.
HALF = "<u4"


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = WIDTH) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingles of each text, some texts at a time."""
    for _, _, words, at in word_blocks(column):
        m = max(0, len(words) - width + 1)
        whole = np.full(m, width, np.uint64)
        for i in range(width):
            whole = mixed(whole * MIX + words[i : i + m])
        out = []
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if y - x >= width:
                out.append(np.unique(whole[x : y - width + 1]))
            else:
                h = np.full(min(1, y - x), y - x, np.uint64)
                for i in range(x, y):
                    h = mixed(h * MIX + words[i])
                out.append(h)
        yield out


def number(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """A set's class, and as many bits more."""
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16, key=b"%d" % seed).digest(), np.int64).tolist())


def heads(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of its least elements a set of n sends, its head, and how many of these any set that it links with sends, too.

    Sets of n and m link by at least o = percent (n + m) / (100 + percent) common elements. The l least of these are among the
    first n - o + l of the one and m - o + l of the other. A head is one and a half times what all sets may differ by.
    """
    q, r = 100 - percent, 100 + percent
    head = np.minimum(n, 3 * q * n // 200 + 1)
    low, high = -(-percent * n // 100), 100 * n // percent  # sizes of sets that may link with one of n
    own = head - n - (-percent * (n + low) // r)
    other = [(3 * q * r * m - 200 * r * m + 200 * percent * (n + m)) // (200 * r) + 1 for m in (low, high)]  # linear in m but for rounding
    return head, np.maximum(1, np.minimum(own, np.minimum(*other)))


def part_hashes(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the parts, whose they are, whether of the set's next band, and each set's need; the sets have elements.

    Of a set's hashes of one of its two bands (own, next), any linked set has at least as many as the set needs there:
    the lower and the upper 32 bits of `need`.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    high, element = flat >> np.uint64(32), mixed(flat + MIX)
    own = np.floor(np.log(np.maximum(sizes, 1)) / math.log(100 / percent) + 1e-9).astype(np.int64)
    found, whose, later, need = [], [], [], np.zeros(len(sets), np.int64)
    for nth, band in enumerate((own, own + 1)):  # of two sets that may link, one's own band is one of both
        most = (100 / percent) ** (band + 1) + 1
        d = ((100 - percent) / (100 + percent) * 2 * most).astype(np.int64)
        k = d + 3 + d // 10
        first = np.cumsum(k) - k
        part = (high % np.repeat(k, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(first, sizes)
        total, count = np.zeros(int(k.sum()), np.uint64), np.bincount(part, minlength=int(k.sum()))
        np.add.at(total, part, element)
        of = np.repeat(np.arange(len(sets)), k)
        place = (np.arange(len(of)) - first[of]).astype(np.uint64)
        sig = mixed(mixed(total) + place * np.uint64(1_000_003) + band[of].astype(np.uint64) * MIX)
        empty = np.bincount(of[count == 0], minlength=len(sets))
        sent = (count > 0) | (empty >= k - d)[of]
        found.append(sig[sent])
        whose.append(of[sent])
        later.append(np.full(len(whose[-1]), bool(nth)))
        need += np.maximum(1, k - d - empty) << (32 * nth)  # an empty part may agree unseen
    return np.concatenate(found), np.concatenate(whose), np.concatenate(later), need


class _Mail:
    """Hashes with their classes, held until they are packed for the task where equal ones meet; `kind` is that of both as they travel.

    Of a hash or class that travels as four bytes, these are the upper half of the hash and the lower half of the class.
    """

    def __init__(self, tasks: int, kind: str = "<u8"):
        self.tasks, self.kind, self.held, self.size = tasks, np.dtype(kind), [], 0

    def add(self, sig: np.ndarray, own: np.ndarray) -> None:
        self.held.append((sig, own))
        self.size += len(sig)

    def packed(self) -> tuple[list[int], list[bytes]]:
        sig, own = map(np.concatenate, zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order, cut, some = _dealt((sig % np.uint64(self.tasks)).astype(np.int64), self.tasks)
        sig = (sig[order] >> np.uint64(64 - 8 * self.kind.itemsize)).astype(self.kind)
        own = own[order].astype(self.kind)
        return some, [sig[x:y].tobytes() + own[x:y].tobytes() for k in some for x, y in [(cut[k], cut[k + 1])]]

    def opened(self, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (hash, class), in order of both as they travelled."""
        both = [np.frombuffer(p, self.kind).reshape(2, -1) for p in payloads]
        sig, own = np.concatenate([np.zeros((2, 0), self.kind), *both], axis=1)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        return sig[new], own[new].astype(np.int64)


def _dealt(to: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order by task, where each task's entries begin in it, and the tasks that have any."""
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(tasks + 1))
    return order, cut, np.flatnonzero(np.diff(cut)).tolist()


def _tallies(name: np.ndarray, count: np.ndarray, tasks: int) -> tuple[list[int], list[bytes]]:
    """Counts of classes, packed for the tasks that sum them up."""
    order, cut, some = _dealt(name % tasks, tasks)
    name, count = name[order], count[order]
    return some, [name[cut[k] : cut[k + 1]].tobytes() + count[cut[k] : cut[k + 1]].tobytes() for k in some]


def _totals(sent: DataFrame, tasks: int) -> DataFrame:
    """(class, count) of the tallies (task, payload)."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            for p in b.column(1).to_pylist():
                both = np.frombuffer(p, np.int64).reshape(2, -1)
                names.append(both[0])
                counts.append(both[1])
        name, at = np.unique(np.concatenate(names), return_inverse=True)
        count = np.zeros(len(name), np.int64)
        np.add.at(count, at, np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(count)], ["class", "count"])

    return sent.select("task", "payload").repartition(tasks, "task").mapInArrow(tidy(total), "class long, count long")


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


class TokenGroups:
    """Partitions of similar documents; each keeps its token union and its members."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []
        self.unions: list[np.ndarray] = []
        self.members: list[list[int]] = []
        self.into: list[int] = []
        self.matrix: dict[int, list[int]] = {}

    def _home(self, g: int) -> int:
        while self.into[g] != g:
            self.into[g] = g = self.into[self.into[g]]
        return g

    def _candidates(self, s: np.ndarray, need: int) -> set[int]:
        """Partitions that may hold `need` tokens: those in the rows of the rarest |s| - need + 1 tokens."""
        held = [g for g in map(self.matrix.get, s.tolist()) if g is not None]
        look = len(held) - need + 1  # tokens that no row has come first
        if look <= 0:
            return set()
        held.sort(key=len)
        return {self._home(g) for groups in held[:look] for g in groups}

    def linked(self, s: np.ndarray) -> list[tuple[int, int]]:
        """The partitions that a document links with, and one member of each that it links with."""
        need = -(-self.percent * len(s) // 100)
        found = []
        for g in self._candidates(s, need):
            union = self.unions[g]
            at = np.minimum(np.searchsorted(union, s), len(union) - 1)
            if np.count_nonzero(union[at] == s) >= need:
                m = next((m for m in reversed(self.members[g]) if links(s, self.sets[m], self.percent)), None)
                if m is not None:
                    found.append((g, m))
        return found

    def add(self, s: np.ndarray) -> None:
        """Puts a document where it links; partitions that it connects become one."""
        i = len(self.sets)
        found = [g for g, _ in self.linked(s)]
        self.sets.append(s)
        if found:
            home = max(found, key=lambda g: len(self.unions[g]))
        else:
            home = len(self.members)
            self.members.append([])
            self.unions.append(np.zeros(0, np.uint64))
            self.into.append(home)
        fresh = [s]
        for g in found:
            if g != home:
                self.into[g] = home
                self.members[home] += self.members[g]
                fresh.append(self.unions[g])
                self.members[g], self.unions[g] = [], np.zeros(0, np.uint64)
        self.members[home].append(i)
        union = self.unions[home]
        new = np.setdiff1d(s, union, assume_unique=True)
        for t in new.tolist():
            groups = self.matrix.setdefault(t, [])
            if all(self._home(g) != home for g in groups):
                groups.append(home)
        self.unions[home] = np.union1d(union, np.concatenate(fresh)) if len(fresh) > 1 else np.sort(np.concatenate([union, new]), kind="stable")

    def forest(self, ids: list[int]) -> list[tuple[int, int]]:
        """(document, smallest of its partition) for these documents' names."""
        return [(ids[m], low) for g in self.members if g for low in [min(ids[m] for m in g)] for m in g]


def _compared(rows: DataFrame, by: list[str], width: int, percent: int, tasks: int) -> DataFrame:
    """(class, least) for every class of rows (by..., query, class, t): the smallest class of its partition within its group.

    Rows with `query` come after the others of their group and are not put into its matrix: (class, a class it links with).
    """
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, groups = None, [], None
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal out
            a, b = zip(*out, strict=True) if out else ((), ())
            out = []
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["class", "least"])

        for b in batches:
            names = list(zip(*[b.column(i).to_pylist() for i in range(n)], strict=True))
            asks, classes = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            at = 0
            for found in shingle_sets(b.column(n + 2), width):
                for s in found:
                    if names[at] != name:
                        if groups is not None:
                            out += groups.forest(ids)
                        name, ids, groups = names[at], [], TokenGroups(percent)
                    if asks[at]:
                        out += [(classes[at], ids[m]) for _, m in groups.linked(s)]
                    elif not ids or classes[at] != ids[-1]:  # rows of one class lie together
                        ids.append(classes[at])
                        groups.add(s)
                    at += 1
            if len(out) > 100_000:
                yield flush()
        if groups is not None:
            out += groups.forest(ids)
        yield flush()

    if "query" not in rows.columns:
        rows = rows.withColumn("query", F.lit(False))
    dealt = rows.select(*by, "query", "class", "t").repartition(tasks, *by).sortWithinPartitions(*by, "query", "class")
    return dealt.mapInArrow(tidy(run), "class long, least long")


def _described(narrow: DataFrame, width: int, percent: int, seed: int, tasks: int) -> DataFrame:
    """(id, n, class, more, need) of every row, `need` being that of heads(); and tallies (task, payload), by the lower half of a class, of what another class has of heads."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        mail = _Mail(tasks, HALF)
        turn = 0

        def rows(task, ids=None, n=None, own=None, more=None, need=None, payload=None) -> pa.RecordBatch:
            m = len(task)
            column = lambda x, kind: pa.nulls(m, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind)
            longs = [column(x, pa.int64()) for x in (ids, n, own, more, need)]
            return pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), *longs, column(payload, pa.binary())], ["task", "id", "n", "class", "more", "need", "payload"])

        for b in batches:
            sizes, names = [], []
            keyed = b.column(0).is_valid().to_pylist()
            for found in shingle_sets(b.column(1), width):
                new = []
                for s in found:
                    name = number(s, seed)
                    if len(s) and keyed[len(sizes)] and name[0] not in sent:
                        sent.add(name[0])
                        new.append((s, name[0]))
                    sizes.append(len(s))
                    names.append(name)
                if new:
                    m = heads(np.array([len(s) for s, _ in new]), percent)[0]
                    mail.add(mixed(np.concatenate([s[:k] for (s, _), k in zip(new, m.tolist(), strict=True)])), np.repeat(np.array([c for _, c in new], np.int64), m))
                if mail.size > PACKED:
                    to, data = mail.packed()
                    yield rows(to, payload=data)
            if len(sent) > 1_000_000:
                sent.clear()
            m = b.num_rows
            yield rows([(turn + i) % tasks for i in range(m)], b.column(0), sizes, [c for c, _ in names], [x for _, x in names], heads(np.array(sizes, np.int64), percent)[1])
            turn += m
        if mail.size:
            to, data = mail.packed()
            yield rows(to, payload=data)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads: list[bytes] = []
        names = ["id", "n", "class", "more", "need", "task", "payload"]
        for b in batches:
            b = b.select(names)
            if b.column(6).null_count:
                own = b.filter(b.column(6).is_null())
                yield pa.RecordBatch.from_arrays([*own.columns[:5], pa.nulls(own.num_rows, pa.int32()), own.column(6)], names)
            payloads += b.column(6).drop_null().to_pylist()
        sig, own = _Mail(tasks, HALF).opened(payloads)
        _, shared = _shared(sig, own)
        to, data = _tallies(*np.unique(own[shared], return_counts=True), tasks)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(to), pa.int64())] * 5, pa.array(to, pa.int32()), pa.array(data, pa.binary())], names)

    out = narrow.mapInArrow(tidy(describe), "task int, id long, n long, class long, more long, need long, payload binary").repartition(tasks, "task")
    return stored(out.mapInArrow(tidy(count), "id long, n long, class long, more long, need long, task int, payload binary"))


def _likely(narrow: DataFrame, reps: DataFrame, tallies: DataFrame, width: int, percent: int, seed: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(id, class, n, t) of the classes that have as much of their heads in common with others as a link asks for; (class) of those whose shingles others have as it asks for, too."""

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that share a key, those of the class that the key stands for."""
        for b in batches:
            found = [number(s, seed)[0] for sets in shingle_sets(b.column(b.schema.get_field_index("t")), width) for s in sets]
            yield b.filter(pa.array(np.array(found, np.int64) == b.column(b.schema.get_field_index("class")).to_numpy(), pa.bool_()))

    halves = reps.withColumn("half", F.col("class").bitwiseAND((1 << 32) - 1))
    alike = halves.groupBy("half").agg(F.count("*").alias("alike")).where("alike > 1")
    both = halves.join(_totals(tallies, tasks).withColumnRenamed("class", "half"), "half", "left").join(alike, "half", "left")
    rows = both.where("count >= need or alike > 1").select("id", "class", "n").join(narrow, "id")
    rows = stored(rows.mapInArrow(tidy(of_class), rows.schema))
    size = rows.agg(F.sum("n")).first()[0] or 0
    spread = F.lit(max(1, -(-size // PACKED))).alias("spread")
    one = rows.select(F.lit(0).cast("long").alias("root"), F.col("class").alias("part"), "class", F.lit(True).alias("minor"), spread, "t")
    enough = rows.select("class", "n").distinct().join(_overlaps(one, width, tasks), "class").where(F.col("overlap") >= F.ceil(F.col("n") * percent / 100))
    return rows, stored(enough.select("class"))


def _met(rows: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """(class, least): classes of rows (class, t) that share a part, each with the smallest class that it meets in a task."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = _Mail(tasks)

        def flush() -> pa.RecordBatch:
            to, data = mail.packed()
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(data, pa.binary())], ["task", "payload"])

        for b in batches:
            own, at = b.column(0).to_numpy(), 0
            for sets in shingle_sets(b.column(1), width):
                sig, of, *_ = part_hashes(sets, percent)
                mail.add(sig, own[at + of])
                at += len(sets)
                if mail.size > PACKED:
                    yield flush()
        if mail.size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, own = _Mail(tasks).opened([p for b in batches for p in b.column(1).to_pylist()])
        same = sig[1:] == sig[:-1]
        a, b = local_forest(own[1:][same], own[:-1][same])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["class", "least"])

    sent = rows.select("class", "t").mapInArrow(tidy(send), "task int, payload binary").repartition(tasks, "task")
    return sent.mapInArrow(tidy(meet), "class long, least long")


def _linked(likely: DataFrame, groups: DataFrame, reps: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """(node, root) of the linked classes: every class but the smallest of its component. likely: (id, class, n, t), deleted once its rows of groups are kept."""
    spark = likely.sparkSession
    members = reps.join(groups, "class")
    sizes = members.groupBy("root").agg(F.sum("n").alias("size")).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    placed = members.join(sizes.select("root", "chunks"), "root").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))

    inside = stored(placed.select("class", "root", "chunks", "chunk").join(likely, "class").select("id", "class", "n", "root", "chunks", "chunk", "t"))
    discard(spark, likely)
    found = stored(_compared(inside, ["root", "chunk"], width, percent, tasks))
    swept(spark)
    wide = inside.where("chunks > 1")
    if not wide.isEmpty():
        before = None
        while True:  # one document of each partition stands for it
            so_far = components(found, "class", "least")
            part = wide.select("class", "root").distinct().join(so_far.select(F.col("node").alias("class"), F.col("root").alias("part")), "class", "left")
            part = stored(part.select("class", "root", F.coalesce("part", "class").alias("part")))
            stand = wide.join(part.select(F.col("part").alias("class")).distinct(), "class")
            counts = stand.groupBy("root").agg(F.sum("n").alias("size"), F.countDistinct("class").alias("parts")).where("parts > 1")
            now = counts.agg(F.sum("parts")).first()[0] or 0
            if not now or before is not None and 2 * now > before:
                break
            before = now
            cut = counts.select("root", F.ceil(F.col("size") / CHUNK).cast("int").alias("cuts"))
            again = stand.join(cut, "root").withColumn("cut", F.pmod(F.xxhash64("class", F.lit(before)), F.col("cuts")).cast("int"))
            found = stored(found.unionByName(_compared(again, ["root", "cut"], width, percent, tasks)))
        swept(spark)
        if now:
            found = stored(found.unionByName(_across(inside, part, width, percent, tasks)))
    discard(spark, inside)
    swept(spark)
    return components(found, "class", "least")


def _overlaps(rows: DataFrame, width: int, tasks: int) -> DataFrame:
    """(class, overlap): at least how many tokens of each minor class another partition of its group has. rows: (root, part, class, minor, spread, t).

    A group's tokens go to as many tasks as its size asks for (`spread`), not to all, so that a class is counted in few
    places. A token travels as half its hash beside the task it goes to: where two meet by chance, the overlap is counted too
    high, so a document may be compared in vain, but none is left out.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = [len(k) for k, *_ in held]
            key, to = np.concatenate([k for k, *_ in held]), np.concatenate([t for _, t, *_ in held])
            part, name = np.repeat([p for *_, p, _ in held], n), np.repeat([c for *_, c in held], n)
            order = np.lexsort((name, part, key))
            key, to, part, name = key[order], to[order], part[order], name[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (name[1:] != name[:-1])  # classes that need no count are one
            key, to, part, name = key[new], to[new], part[new], name[new]
            at, shared = _shared(key, part)
            counted, n = np.unique(name[shared & (name != 0)], return_counts=True)
            # tokens that two partitions have here are counted here; two entries tell the others
            end = np.zeros(len(key), bool)
            end[at] = end[np.append(at[1:], len(key)) - 1] = True
            name = np.where(shared, 0, name)
            kept = ~shared | end
            key, to, part, name = key[kept], to[kept], part[kept], name[kept]
            order = np.argsort(to, kind="stable")
            key = key[order]
            cut = np.searchsorted(to[order], np.arange(tasks + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            parts, x = np.unique(part[order], return_inverse=True)
            names, y = np.unique(name[order], return_inverse=True)
            both, whose = np.unique(x * len(names) + y, return_inverse=True)
            pairs = np.stack([parts[both // len(names)], names[both % len(names)]], 1)
            data = []
            for k in some:
                used, at = np.unique(whose[cut[k] : cut[k + 1]], return_inverse=True)
                data.append(np.uint32(len(used)).tobytes() + pairs[used].tobytes() + (key[cut[k] : cut[k + 1]] >> np.uint64(32)).astype("<u4").tobytes() + at.astype("<u4").tobytes())
            m = len(some)
            tasks_of = [*some, *(counted % tasks).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(tasks_of, pa.int32()), pa.array([*data, *[None] * len(n)], pa.binary()), pa.array([*[None] * m, *counted.tolist()], pa.int64()), pa.array([*[None] * m, *n.tolist()], pa.int64())], ["task", "payload", "class", "overlap"])

        for b in batches:
            root, part, name, minor, spread = (b.column(i).to_pylist() for i in range(5))
            i = 0
            for sets in shingle_sets(b.column(5), width):
                for s in sets:
                    own = mixed(np.array([root[i]], np.int64).view(np.uint64))
                    key = mixed(s + own)
                    to = mixed(own + key % np.uint64(spread[i]) * MIX) % np.uint64(tasks)
                    held.append((key, to.astype(np.int32), part[i], name[i] if minor[i] else 0))
                    size += len(s)
                    i += 1
                if size > PACKED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners = [np.zeros(0, np.uint32)], [np.zeros((0, 2), np.int64)]
        names, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            told = b.filter(b.column(1).is_null())
            names.append(told.column(2).to_numpy())
            counts.append(told.column(3).to_numpy())
            for p in b.column(1).drop_null().to_pylist():
                m = int(np.frombuffer(p, "<u4", 1)[0])  # (partition, class) pairs, then keys, then each key's pair
                n = (len(p) - 4 - 16 * m) // 8
                keys.append(np.frombuffer(p, "<u4", n, 4 + 16 * m))
                owners.append(np.frombuffer(p, np.int64, 2 * m, 4).reshape(m, 2)[np.frombuffer(p, "<u4", n, 4 + 16 * m + 4 * n)])
        key, (part, name) = np.concatenate(keys), np.concatenate(owners).T
        order = np.lexsort((part, key))
        key, part, name = key[order], part[order], name[order]
        _, shared = _shared(key, part)
        counted, n = np.unique(name[shared & (name != 0)], return_counts=True)
        to, data = _tallies(np.concatenate([*names, counted]), np.concatenate([*counts, n]), tasks)
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(data, pa.binary())], ["task", "payload"])

    sent = rows.select("root", "part", "class", "minor", "spread", "t").mapInArrow(tidy(send), "task int, payload binary, class long, overlap long").repartition(tasks, "task")
    return _totals(sent.mapInArrow(tidy(add_up), "task int, payload binary"), tasks).withColumnRenamed("count", "overlap")


def _shared(key: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key begins among entries in order of key and part, and which entries' keys have two parts."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(at[1:], len(key))
    return at, np.repeat(part[at] != part[end - 1], end - at)


def _across(inside: DataFrame, part: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """(class, least) for the links between partitions of a group; inside is deleted once its rows of such groups are kept.

    One end of such a link lies outside the group's largest partition, and its overlap with all other partitions
    reaches the bound. Who does not reach it leaves, and with fewer rows the bound is taken again while that helps. The
    others are held in blocks, which all rows of their group that are left or of the largest partition query in slices, some
    blocks at a time: the work grows with the square of what is left, the disk does not.
    """
    spark = inside.sparkSession
    largest = part.groupBy("root", "part").agg(F.count("*").alias("m")).groupBy("root").agg(F.max_by("part", F.struct("m", "part")).alias("most"), F.count("*").alias("parts"))
    spread = F.ceil(F.col("chunks") * CHUNK / PACKED).cast("int").alias("spread")
    rows = inside.where("chunks > 1").select("root", "class", "n", spread, "t").join(part.select("class", "part"), "class").join(largest.where("parts > 1").select("root", "most"), "root")
    rows = stored(rows.withColumn("minor", F.col("part") != F.col("most")))
    discard(spark, inside)
    swept(spark)
    before = rows.where("minor").count()
    while before:
        need = F.ceil(F.col("n") * percent / 100)
        left = rows.join(_overlaps(rows, width, tasks), "class", "left").where(~F.col("minor") | (F.col("overlap") >= need)).select(rows.columns)
        less = stored(left)
        discard(spark, rows)
        swept(spark)
        rows = less
        now = rows.where("minor").count()
        if 10 * now > 9 * before:
            break
        before = now
    shingles = F.sum(F.when(F.col("minor"), F.col("n")))
    counts = rows.groupBy("root").agg(F.ceil(F.sum("n") / (BLOCK * CHUNK)).cast("int").alias("slices"), F.ceil(shingles / (BLOCK * CHUNK)).cast("int").alias("blocks")).where("blocks > 0")
    rows = rows.join(counts, "root").withColumn("slice", F.pmod(F.xxhash64("class", F.lit(-2)), F.col("slices")).cast("int"))
    own = F.pmod(F.xxhash64("class", F.lit(-1)), F.col("blocks")).cast("int")
    rounds = -(-(counts.agg(F.max(F.greatest("slices", "blocks"))).first()[0] or 1) // COPIES)
    found = []
    for k in range(rounds):  # some blocks at a time: the copies of texts that lie in shuffles follow the rows, not their square
        held = rows.where(F.col("minor") & (own % rounds == k)).select("root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), own.alias("block"), F.lit(False).alias("query"), "class", "t")
        blocks = F.sequence(F.lit(k), F.col("blocks") - 1, F.lit(rounds))
        asking = rows.where(F.col("blocks") > k).withColumn("block", F.explode(blocks)).where(~F.col("minor") | (own != F.col("block")))
        asking = asking.select("root", "slice", "block", F.lit(True).alias("query"), "class", "t")
        found.append(stored(_compared(held.unionByName(asking), ["root", "slice", "block"], width, percent, tasks)))
        swept(spark)
    return reduce(DataFrame.unionByName, found)


def clusters(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key that links reach, itself included)."""
    bounded_batches(docs)
    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    tasks = tasks_for(docs, TASK_BYTES)
    seed = 0
    while True:
        described = _described(narrow, width, percent, seed, tasks)
        swept(docs.sparkSession)  # the heads' messages have met
        measured = described.where("n is not null")
        reps = stored(measured.where("n > 0 and id is not null").groupBy("class").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("need").alias("need"), F.min("more").alias("lo"), F.max("more").alias("hi")))
        if reps.where("lo <> hi").isEmpty():
            break
        seed += 1  # two sets have one number
    likely, enough = _likely(narrow, reps, described.where("n is null"), width, percent, seed, tasks)
    swept(docs.sparkSession)
    met = components(_met(likely.join(enough, "class", "left_semi"), width, percent, tasks), "class", "least")
    groups = met.select(F.col("node").alias("class"), "root").unionByName(met.select(F.col("root").alias("class"), "root").distinct())
    roots = _linked(likely, groups, reps.select("class", "id", "n"), width, percent, tasks)
    named = reps.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "id", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component"))
    labels = named.join(smallest, "root").select("class", "component")
    out = measured.join(labels, "class", "left")
    own = F.when(F.col("n") > 0, F.col("component"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce(own, F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, whose key stands for a component; rows with equal keys stay or go together."""
    gone = unused(docs, "gone")
    found = clusters(docs, text, key, width, percent)
    names = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(gone)).distinct()
    return docs.join(names, docs[key].cast("long") == F.col(gone), "left_anti")
