"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Tokens are a text's words, lower-cased in A-Z, and one end token. Of the training rows every bigram is counted:

1. Rows are packed once into parts of about PART_BYTES of text, compressed, on shared storage.
2. A part sends each of its distinct bigrams, with its count in training rows, to the task that the first word's hash
   names. Words that make up more than one token in HOT of some part have their bigrams dealt over several tasks, by
   the second word too, so no task gets all of a frequent word.
3. That task adds the counts up and makes its blocks of the filter: a count c is kept as its quantised logarithm q, by q
   entries (bigram, 1) ... (bigram, q). The filter grows with the corpus, so it is not broadcast whole: probes go to
   the block that holds the bigram, once for all passages of a part, and (bigram, 1), (bigram, 2), ... until one fails
   gives q back. The answer to a part has q of each of its bigrams, and per first word its exact count, the sum of its
   successors' kept counts and their number.
4. With what comes back a part scores its rows: P(w | h) = (c'(h w) + FORCE * t(h) * base(w)) / (s(h) + FORCE * t(h)),
   where c' is the count that q stands for, s(h) the sum of c'(h .), t(h) the number of words seen after h, and
   base(w) = (c(w) + 1) / (N + V + 1). So the probabilities after a word sum to 1, but for what false positives add. A
   word that training never had as a first word leaves base(w).

Cases: a null or empty text is the end token alone; unknown words have count 0; with no training rows every token is
unknown and the score equals the base score; repeated rows are scored each; very long texts are not cut; an empty
table gives no rows; extra columns, also of clashing names, are ignored; a null key is kept; a row whose training
condition is null, as that of a null key is, is not learned from and counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX, bounded_batches, mixed, stored, tasks_for, utf8, word_blocks

#: Base of the counts' logarithm; bits and probes of a filter entry; weight of the base, times a word's distinct successors.
BASE, BITS, PROBES, FORCE = 1.5, 16, 8, 3.0
#: Bytes of text in a part; bytes of the table for a task that adds up; a word of more than one token in HOT is dealt out.
PART_BYTES, TASK_BYTES, HOT = 4 << 20, 6 << 20, 500
BEGIN, STOP = np.uint64(0x5BE0CD19137E2179), np.uint64(0x1F83D9ABFB41BD6B)

LEVELS = 120
_EDGES = np.array([BASE**q for q in range(LEVELS)])


def level(counts: np.ndarray) -> np.ndarray:
    """The quantised logarithm of counts of 1 or more, from 1."""
    return np.searchsorted(_EDGES, counts + 1e-9, side="right")


def _typical() -> np.ndarray:
    """The count that a level stands for: the middle of the counts that have it."""
    low = np.ceil(_EDGES - 1e-9)
    high = np.maximum(low, np.append(np.ceil(_EDGES[1:] - 1e-9), np.ceil(_EDGES[-1] * BASE)) - 1)
    return np.concatenate([[0.0], (low + high) / 2])


TYPICAL = _typical()


class Filter:
    """A block of the filter: bits that hold (key, 1) ... (key, level) for each key."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        entry = np.repeat(keys, levels)
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
        entry = mixed(entry + nth.astype(np.uint64) * MIX)
        self.size = np.uint64(-(-max(64, len(entry) * BITS) // 8) * 8)
        bits = np.zeros(int(self.size), bool)
        for j in range(PROBES):
            bits[self._spot(entry, j)] = True
        self.bits = np.packbits(bits)

    def _spot(self, entry: np.ndarray, j: int) -> np.ndarray:
        step = mixed(entry + MIX) | np.uint64(1)
        return ((entry + np.uint64(j) * step) % self.size).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last n for which (key, 1) ... (key, n) are all there."""
        q = np.zeros(len(keys), np.uint8)
        alive = np.arange(len(keys))
        nth = 1
        while len(alive) and nth < LEVELS:
            entry = mixed(keys[alive] + np.uint64(nth) * MIX)
            for j in range(PROBES):
                spot = self._spot(entry, j)
                hit = (self.bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
                alive, entry = alive[hit], entry[hit]
            q[alive] = nth
            nth += 1
        return q


def bigram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(context * MIX + word.astype(np.uint64))


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts, and the number of each text's."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, words, at in word_blocks(texts):
        n = np.diff(at)
        full = np.full(len(words) + len(n), STOP, np.uint64)
        keep = np.ones(len(full), bool)
        keep[np.cumsum(n + 1) - 1] = False
        full[keep] = words
        hashes.append(full)
        sizes.append(n + 1)
    return np.concatenate(hashes), np.concatenate(sizes)


class Part:
    """The tokens of a part and its distinct bigrams, in the order of their contexts' hashes.

    A context is the first word's hash; that of a word that is dealt out is mixed with a share of its second word's.
    """

    def __init__(self, texts, shares: dict[int, int]):
        self.token, self.sizes = tokens_of(texts)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = BEGIN
        self.before = before
        self.context = self.placed(before, self.token, shares)
        self.second = (self.token >> np.uint64(32)).astype(np.uint32)
        self.order = np.lexsort((self.second, self.context))
        c, s = self.context[self.order], self.second[self.order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
        self.pair = np.cumsum(new) - 1  # of the ordered tokens
        self.first = np.flatnonzero(new)
        self.pair_context, self.pair_second = c[self.first], s[self.first]
        head = np.ones(len(self.first), bool)
        head[1:] = self.pair_context[1:] != self.pair_context[:-1]
        self.head = np.flatnonzero(head)
        self.contexts = self.pair_context[self.head]
        self.owner = np.cumsum(head) - 1  # of the bigrams

    @staticmethod
    def placed(before: np.ndarray, token: np.ndarray, shares: dict[int, int]) -> np.ndarray:
        out = mixed(before)
        if shares:
            hot = np.array(sorted(shares), np.uint64)
            at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
            which = np.flatnonzero(hot[at] == before)
            n = np.array([shares[int(h)] for h in hot], np.uint64)[at[which]]
            out[which] = dealt_context(before[which], (token[which] >> np.uint64(7)) % n)
        return out


def dealt_context(before: np.ndarray, share: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) + (share + np.uint64(1)) * MIX)


def bucket(context: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of contexts, so that what is ordered by context is ordered by bucket."""
    return np.minimum((context >> np.uint64(11)).astype(np.float64) * (buckets / 2.0**53), buckets - 1).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each; larger ones follow."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def _unpacked(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    large = out == 255
    out[large] = np.frombuffer(data, "<i8", int(large.sum()), at + n)
    return out


def _packs(docs: DataFrame, training: Column, text: str, key: str) -> DataFrame:
    """(part, payload, hot): rows packed together, and the words that are frequent in them with their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            to = pa.BufferOutputStream()
            with pa.ipc.new_stream(to, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            token = tokens_of(table.column("t"))[0]
            word, n = np.unique(token, return_counts=True)
            often = (n * HOT > len(token)) & (n > 1)
            name = (task << 32) + nth
            nth, held, size = nth + 1, [], 0
            hot = np.concatenate([word[often], n[often].astype(np.uint64)]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([to.getvalue().to_pybytes()], pa.binary()), pa.array([hot], pa.binary()), pa.array([len(token)], pa.int64())], ["part", "payload", "hot", "tokens"])

        for b in batches:
            at = utf8(b.column(1))[1]
            x = 0
            while x < b.num_rows:
                y = max(x + 1, int(np.searchsorted(at, at[x] + PART_BYTES - size, side="right")) - 1)
                held.append(b.slice(x, y - x))
                size += int(at[y] - at[x])
                x = y
                if size >= PART_BYTES or x < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(training, F.lit(False)).alias("training"))
    return stored(rows.mapInArrow(run, "part long, payload binary, hot binary, tokens long"))


def _opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _shares(packs: DataFrame, tasks: int) -> dict[int, int]:
    """Into how many contexts each frequent word is dealt: its share of the tasks. At most 2 * HOT words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                w, n = np.frombuffer(data, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], ["w", "n"])

    total = packs.agg(F.sum("tokens")).first()[0] or 0
    often = packs.select("hot").mapInArrow(words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") * (2 * HOT) > total)
    return {r["w"] & 0xFFFFFFFFFFFFFFFF: max(2, -(-r["n"] * tasks // total)) for r in often.collect()}


def _virtual(shares: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The contexts that frequent words are dealt into, in order, and the word of each."""
    of = np.repeat(np.array(list(shares), np.uint64), list(shares.values())) if shares else np.zeros(0, np.uint64)
    nth = np.concatenate([np.arange(n) for n in shares.values()]).astype(np.uint64) if shares else np.zeros(0, np.uint64)
    name = dealt_context(of, nth)
    order = np.argsort(name)
    return name[order], of[order]


def _answers(packs: DataFrame, shares: dict[int, int], tasks: int) -> DataFrame:
    """(part, bucket, payload) for every part and bucket it has contexts in; per bucket a row of part -1 with its sums."""
    virtual = _virtual(shares)[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                table = _opened(payload)
                p = Part(table.column("t"), shares)
                learns = np.repeat(np.array(table.column("training").to_pylist(), bool), p.sizes)[p.order]
                n = np.add.reduceat(learns.astype(np.int64), p.first) if len(p.first) else np.zeros(0, np.int64)
                where = bucket(p.contexts, tasks)
                cut = np.searchsorted(where, np.arange(tasks + 1)) if tasks < len(where) else None
                runs = np.diff(np.append(p.head, len(p.first)))
                to, data = [], []
                for k in np.unique(where).tolist():
                    x, y = (cut[k], cut[k + 1]) if cut is not None else np.searchsorted(where, [k, k + 1])
                    u = p.head[x]
                    v = p.head[y] if y < len(p.head) else len(p.first)
                    to.append(k)
                    data.append(np.uint32(y - x).tobytes() + p.contexts[x:y].tobytes() + runs[x:y].astype("<u4").tobytes() + p.pair_second[u:v].tobytes() + _packed(n[u:v]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(to), pa.int64()), pa.array(to, pa.int32()), pa.array(data, pa.binary())], ["part", "bucket", "payload"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def answered() -> pa.RecordBatch:
            contexts, owner, second, counts, parts = [], [], [], [], []
            known = 0
            for part, data in held:
                m = int(np.frombuffer(data, "<u4", 1)[0])
                c, runs = np.frombuffer(data, np.uint64, m, 4), np.frombuffer(data, "<u4", m, 4 + 8 * m).astype(np.int64)
                n = int(runs.sum())
                contexts.append(c)
                owner.append(np.repeat(np.arange(known, known + m), runs))
                second.append(np.frombuffer(data, "<u4", n, 4 + 12 * m))
                counts.append(_unpacked(data, n, 4 + 12 * m + 4 * n))
                parts.append((part, m, n))
                known += m
            context, at = np.unique(np.concatenate(contexts), return_inverse=True)
            of = at[np.concatenate(owner)]  # of each bigram sent
            bigram, which = np.unique(bigram_keys(context[of], np.concatenate(second)), return_inverse=True)
            total = np.zeros(len(bigram), np.int64)
            np.add.at(total, which, np.concatenate(counts))
            whose = np.zeros(len(bigram), np.int64)
            whose[which] = of
            seen = np.flatnonzero(total)
            q = Filter(bigram[seen], level(total[seen])).levels(bigram)
            sums = [np.zeros(len(context), np.int64) for _ in range(3)]  # count, twice the kept counts, successors
            for s, x in zip(sums, (total[seen], np.round(2 * TYPICAL[q[seen]]).astype(np.int64), np.ones(len(seen), np.int64)), strict=True):
                np.add.at(s, whose[seen], x)
            out, x, y = [], 0, 0
            for part, m, n in parts:
                out.append((part, b"".join(s[at[x : x + m]].tobytes() for s in sums) + q[which[y : y + n]].tobytes()))
                x, y = x + m, y + n
            dealt = np.isin(context, virtual)
            plain = ~dealt & (sums[0] > 0)
            whole = np.array([sums[0].sum(), plain.sum()], np.int64).tobytes()
            out.append((-1, whole + context[dealt].tobytes() + b"".join(s[dealt].tobytes() for s in sums)))
            p, data = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array([name] * len(p), pa.int32()), pa.array(data, pa.binary())], ["part", "bucket", "payload"])

        for b in batches:
            for part, k, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k != name:
                    if held:
                        yield answered()
                    name, held = k, []
                held.append((part, data))
        if held:
            yield answered()

    schema = "part long, bucket int, payload binary"
    sent = packs.select("part", "payload").mapInArrow(count, schema).repartition(tasks, "bucket").sortWithinPartitions("bucket", "part")
    return stored(sent.mapInArrow(add_up, schema))


def score(docs: DataFrame, training: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    bounded_batches(docs)
    kind = docs.schema[key].dataType.simpleString()
    tasks = tasks_for(docs, TASK_BYTES)
    packs = _packs(docs, training, text, key)
    shares = _shares(packs, tasks)
    answers = _answers(packs, shares, tasks)
    # a row per bucket: two sums, and those of the contexts that frequent words are dealt into (2 * HOT words, tasks contexts)
    virtual, word = _virtual(shares)
    hot = {int(w): np.zeros(3, np.int64) for w in shares}
    of = dict(zip(virtual.tolist(), word.tolist(), strict=True))
    n_all = n_distinct = 0
    for r in answers.where("part = -1").select("payload").toLocalIterator():
        data = bytes(r["payload"])
        n_all += int(np.frombuffer(data, np.int64, 1)[0])
        n_distinct += int(np.frombuffer(data, np.int64, 1, 8)[0])
        m = (len(data) - 16) // 32
        for c, row in zip(np.frombuffer(data, np.uint64, m, 16).tolist(), np.frombuffer(data, np.int64, 3 * m, 16 + 8 * m).reshape(3, m).T, strict=True):
            hot[of[c]] += row
    n_distinct += sum(int(x[0] > 0) for x in hot.values())
    frequent = np.array(sorted(hot), np.uint64)
    frequent_sums = np.array([hot[int(w)] for w in frequent], np.int64).reshape(-1, 3)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            table = _opened(left.column("payload")[0].as_py())
            p = Part(table.column("t"), shares)
            by = np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist()
            data = [right.column("payload")[i].as_py() for i in by]
            where = bucket(p.contexts, tasks)
            pairs = np.bincount(bucket(p.pair_context, tasks), minlength=tasks)
            sums, levels = [[], [], []], []
            for k, d in zip(np.unique(where).tolist(), data, strict=True):
                n = int(pairs[k])
                m = (len(d) - n) // 24
                for j in range(3):
                    sums[j].append(np.frombuffer(d, np.int64, m, 8 * m * j))
                levels.append(np.frombuffer(d, np.uint8, n, 24 * m))
            own = np.stack([np.concatenate(s) for s in sums], 1)  # of the part's contexts
            first = p.order[p.first]  # a token of each bigram
            words, at = np.unique(p.before, return_inverse=True)
            total = own[np.minimum(np.searchsorted(p.contexts, mixed(words)), len(p.contexts) - 1)]
            if len(frequent):
                spot = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
                is_hot = frequent[spot] == words
                total[is_hot] = frequent_sums[spot[is_hot]]
            # every word is the first of some bigram here; the end token occurs as often as a beginning
            second = np.where(p.token == STOP, BEGIN, p.token)
            c = total[np.searchsorted(words, second), 0]
            base = (c + 1) / (n_all + n_distinct + 1)
            _, kept, successors = total[at[first]].T
            force = FORCE * successors
            seen = kept + force > 0
            prob = np.where(seen, (TYPICAL[np.concatenate(levels)] + force * base[first]) / np.where(seen, kept / 2 + force, 1), base[first])
            logs = np.empty(len(p.token))
            logs[p.order] = np.log10(prob)[p.pair]
            starts = np.cumsum(p.sizes) - p.sizes
            add = lambda x: np.add.reduceat(x, starts)
            out = [table.column("id").combine_chunks(), pa.array([not x for x in table.column("training").to_pylist()], pa.bool_()), pa.array(p.sizes, pa.int64()), pa.array(add((c > 0).astype(np.int64)), pa.int64()), pa.array(add(np.log10(base)), pa.float64()), pa.array(add(logs), pa.float64())]
        names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table(dict(zip(names, out or [pa.array([], id_type), *[pa.array([], t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]], strict=True)))

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[key].dataType)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    right = answers.where("part >= 0")
    out = packs.select("part", "payload").groupBy("part").cogroup(right.groupBy("part")).applyInArrow(scored, schema)
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
