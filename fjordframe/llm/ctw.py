"""Language-model scores by context-tree weighting over bytes.

A text is its words, lower-cased (A-Z) and parted by single spaces, then one end byte. Each byte is eight binary
decisions; a decision's context is the bits before it in the byte and the DEPTH bytes before the byte. Every node of
the context tree holds a Krichevsky-Trofimov estimate per decision, and a node's weighted probability is half its own
estimate and half the product of its children's, so that the score mixes the estimates of all depths.

Counts cover every byte of every training text: tasks count (context, byte) pairs on their own and one shuffle adds
them up. The tree holds every context of up to DEPTH bytes, so it grows with the corpus. No process holds it whole: all
contexts that end in the same SPLIT bytes are one subtree and are weighted in one task; only what is above, at most
256 ** (SPLIT - 1) contexts whatever the corpus holds, goes to the driver and back to the tasks. The result is a table
with the log probability of every (context, byte) pair that any text has; held-out texts add their pairs to it with a
count of zero. The HEAD_GRAMS most frequent pairs go to the executors; all others are joined by a shuffle.

The word base line needs each word's count. The HEAD most frequent words go to the executors; all other words are
joined with their counts by a shuffle, where no word of the training texts can be hot. Words are known by 64-bit hash.

A null or blank text is its end byte alone. A null id is never held out. Rows that repeat count, and come back, each.
With no training text every byte costs eight bits. Other columns, of any name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordframe.llm.common import mapped, most_frequent, written
from fjordframe.llm.textbytes import NOT_BLANK, Words, cut, joined_words, pieces, summed

DEPTH, SPLIT, HEAD, HEAD_GRAMS = 5, 3, 1 << 18, 1 << 20
END_BYTE = 0x0A
#: The key of the end token; a word's hash is as unlikely to equal it as any other.
END_KEY = np.uint64(0x27D4EB2F165667C5)
_GRAM, _WORD, _AWAY = 0, 1, 2
#: Distinct keys that a task holds before it hands them on, and (context, byte) pairs that are weighted at once.
_HELD, _BLOCK = 1_500_000, 100_000
#: Bytes whose contexts are in memory at once, whatever the length of a text.
_STRETCH = 1 << 19


def normal_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """Bytes of all texts in normal form with DEPTH end bytes before each; first and last-plus-one place of each."""
    out, bounds = joined_words(texts, NOT_BLANK)
    sizes, n = np.diff(bounds), len(bounds) - 1
    some = sizes > 0
    out[bounds[1:][some] - 1] = END_BYTE
    out = np.insert(out, np.repeat(bounds[1:], DEPTH - 1 + ~some), END_BYTE)
    sizes = np.maximum(sizes, 1)
    begins = DEPTH + np.cumsum(sizes + DEPTH - 1) - (sizes + DEPTH - 1)
    return np.concatenate([np.full(DEPTH, END_BYTE, np.uint8), out]), begins, begins + sizes, cut(texts, NOT_BLANK) if n else Words(out, *np.zeros((2, 0), np.int64), np.zeros(1, np.int64))


def _grams(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, rows): the DEPTH + 1 bytes up to each byte of the texts, the last byte lowest, and its text; by stretches."""
    for a in range(DEPTH, len(data), _STRETCH):
        b = min(len(data), a + _STRETCH)
        wide = data[a - DEPTH : b].astype(np.uint64)
        key = wide[DEPTH:].copy()
        for d in range(1, DEPTH + 1):
            key |= wide[DEPTH - d : len(wide) - d] << np.uint64(8 * d)
        first, last = np.searchsorted(stops, a, "right"), np.searchsorted(begins, b)
        low, high = np.clip(begins[first:last], a, b), np.clip(stops[first:last], a, b)
        scored = np.zeros(b - a + 1, np.int8)
        scored[low - a] += 1
        scored[high - a] -= 1
        yield key[np.cumsum(scored[:-1], dtype=np.int8) > 0], np.repeat(np.arange(first, last), high - low)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n, m): byte runs of DEPTH + 1 and words of the training texts, counted by this task; m counts the byte
    runs of held-out texts too."""
    held: dict[int, list] = {_GRAM: [], _WORD: [], _AWAY: []}

    def emit(kind: int) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(*map(np.concatenate, zip(*held[kind], strict=True)))
        for at in range(0, len(keys), 100_000):
            k, m = keys[at : at + 100_000], counts[at : at + 100_000]
            n, of = (m * 0, _GRAM) if kind == _AWAY else (m, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), of, np.int8)), pa.array(k.view(np.int64)), pa.array(n), pa.array(m)], names=["kind", "key", "n", "m"])
        held[kind] = []

    def hold(kind: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        held[kind].append(np.unique(keys, return_counts=True))
        if len(held[kind]) > 4:
            held[kind] = [summed(*map(np.concatenate, zip(*held[kind], strict=True)))]
        if sum(len(k) for k, _ in held[kind]) > _HELD:
            yield from emit(kind)

    for whole in batches:
        away = whole["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        for b, gram in ((b, gram) for gram, rows in ((_GRAM, ~away), (_AWAY, away)) if rows.any() for b in pieces(whole.filter(pa.array(rows)), "text")):
            data, begins, stops, words = normal_bytes(b["text"])
            for keys, _ in _grams(data, begins, stops):
                yield from hold(gram, keys)
            if gram == _GRAM:
                yield from hold(_WORD, np.concatenate([words.hashes(), np.full(b.num_rows, END_KEY)]))
    for kind in held:
        if held[kind]:
            yield from emit(kind)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a, 0.5) + _log_gamma(b, 0.5) - _log_gamma(a + b, 1.0) - np.log(np.pi)


_SMALL = {shift: np.array([lgamma(i + shift) for i in range(4096)]) for shift in (0.5, 1.0)}


def _log_gamma(n: np.ndarray, shift: float) -> np.ndarray:
    x = n + shift
    large = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x)
    return np.where(n < 4096, _SMALL[shift][np.minimum(n, 4095).astype(np.int64)], large)


def _chunks(n: int, size: int = 2048) -> Iterator[tuple[int, int]]:
    return ((a, min(a + size, n)) for a in range(0, n, size))


def _nodes(counts: tuple[np.ndarray, np.ndarray, np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at the 255 decision nodes of contexts a to b; counts are (row, byte, n) by row."""
    row, byte, n = counts
    lo, hi = np.searchsorted(row, (a, b))
    bits = np.zeros((b - a, 512))
    bits[row[lo:hi] - a, 256 + byte[lo:hi]] = n[lo:hi]
    for p in range(255, 0, -1):
        bits[:, p] = bits[:, 2 * p] + bits[:, 2 * p + 1]
    return bits[:, 2::2], bits[:, 3::2]


def _estimate(nodes: tuple[np.ndarray, np.ndarray], bit: int) -> np.ndarray:
    """The Krichevsky-Trofimov probability of a bit at each node."""
    return (nodes[bit] + 0.5) / (nodes[0] + nodes[1] + 1)


def _log_estimate(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The log probability of each node's counts."""
    logs = np.zeros(zero.shape)
    some = (zero > 0) | (one > 0)
    logs[some] = _log_kt(zero[some], one[some])
    return logs


class Tree:
    """The weighted context tree over any chosen contexts, in memory: next state by (state, byte), and log10 probability
    of (state, byte). language_scores() does not need it; it is what the tables are held against."""

    def __init__(self, contexts: list[np.ndarray], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """contexts[d]: sorted packed contexts of d bytes, closed under dropping first or last bytes.
        counts[d]: parallel (context, byte, n) of those contexts."""
        base = np.cumsum([0, *map(len, contexts)])
        total = int(base[-1])
        find = lambda d, x: base[d] + np.searchsorted(contexts[d], x)
        above = [np.zeros(1, np.int64)] + [find(d - 1, c & ((1 << 8 * (d - 1)) - 1)) for d, c in enumerate(contexts) if d]
        self.next = np.zeros((total, 256), np.uint32)
        for d in range(len(contexts)):
            own = slice(base[d], base[d + 1])
            if d:
                self.next[own] = self.next[above[d]]
            if d + 1 < len(contexts):
                longer = contexts[d + 1]
                self.next[find(d, longer >> 8), longer & 255] = np.arange(base[d + 1], base[d + 2])
        self.logp = np.zeros((total, 256), np.float32)
        own, rest = self._split(contexts, counts, above, base)
        stop: list[np.ndarray] = []
        weighted = np.zeros((0, 255))
        for d in range(len(contexts) - 1, -1, -1):
            n = len(contexts[d])
            product = np.zeros((n, 255))
            if len(weighted):
                parent = above[d + 1] - base[d]
                order = np.argsort(parent, kind="stable")
                heads = np.flatnonzero(np.diff(parent[order], prepend=-1))
                product[parent[order][heads]] = np.add.reduceat(weighted[order], heads)
            weighted = product
            stop.insert(0, np.ones((n, 255), np.float32))
            for a, b in _chunks(n):
                alone = _log_estimate(*_nodes(own[d], a, b))
                if d + 1 == len(contexts):
                    weighted[a:b] = alone
                    continue
                below = product[a:b] + _log_estimate(*_nodes(rest[d], a, b))
                best = np.maximum(alone, below)
                weighted[a:b] = best + np.log(0.5 * np.exp(alone - best) + 0.5 * np.exp(below - best))
                stop[0][a:b] = 0.5 * np.exp(alone - weighted[a:b])
        # Both outcomes are mixed on their own, so that a probability next to 1 leaves its complement exact.
        mixed = [np.zeros((1, 255), np.float32), np.zeros((1, 255), np.float32)]
        left = np.ones((1, 255), np.float32)
        for d in range(len(contexts)):
            n = len(contexts[d])
            parent = above[d] - base[d - 1] if d else np.zeros(1, np.int64)
            new, remaining = [np.empty((n, 255), np.float32) for _ in range(2)], np.empty((n, 255), np.float32)
            for a, b in _chunks(n):
                up = parent[a:b]
                here = left[up] * stop[d][a:b]
                remaining[a:b] = left[up] * (1 - stop[d][a:b])
                estimates, outside = _nodes(own[d], a, b), _nodes(rest[d], a, b)
                logs = []
                for k in range(2):
                    new[k][a:b] = mixed[k][up] + here * _estimate(estimates, k)
                    logs.append(np.log10(new[k][a:b].astype(float) + remaining[a:b] * _estimate(outside, k)))
                out = self.logp[base[d] + a : base[d] + b]
                for s in range(256):
                    out[:, s] = sum(logs[s >> (7 - k) & 1][:, ((1 << k) | (s >> (8 - k))) - 1] for k in range(8))
            mixed, left = new, remaining

    @staticmethod
    def _split(contexts: list, counts: list, above: list, base: np.ndarray) -> tuple[list, list]:
        """Per depth, (row, byte, n) of all that follows a context, and of what follows it outside of longer ones."""
        own, rest = [], []
        for c, (context, byte, n) in zip(contexts, counts, strict=True):
            own.append((np.searchsorted(c, context), byte.astype(np.int64), n.astype(float)))
        for d, c in enumerate(contexts):
            row, byte, n = own[d]
            dense = np.bincount(row * 256 + byte, n, len(c) * 256)
            if d + 1 < len(contexts):
                row, byte, n = own[d + 1]
                dense -= np.bincount((above[d + 1][row] - base[d]) * 256 + byte, n, len(c) * 256)
            at = np.flatnonzero(dense > 0)
            rest.append((at >> 8, at & 255, dense[at]))
        for k, (row, byte, n) in enumerate(own):
            order = np.argsort(row, kind="stable")
            own[k] = row[order], byte[order], n[order]
        return own, rest

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, object]:
        """log10 probability and bytes of each text's normal form, and its words."""
        data, begins, stops, words = normal_bytes(texts)
        step, at = self.next.reshape(-1), data.astype(np.int32)
        state = np.zeros(len(data), np.uint32)
        for _ in range(DEPTH):
            state[1:] = step[state[:-1].astype(np.int64) * 256 + at[1:]]
            state[0] = step[at[0]]
        cost = np.zeros(len(data) + 1)
        np.cumsum(self.logp.reshape(-1)[state[:-1].astype(np.int64) * 256 + at[1:]], out=cost[2:], dtype=np.float64)
        return cost[stops] - cost[begins], stops - begins, words


class _Level:
    """The nodes (context, decision) of one depth, sorted, with the zeros and ones seen there."""

    def __init__(self, nodes: np.ndarray, zero: np.ndarray, one: np.ndarray):
        self.nodes, self.zero, self.one = nodes, zero, one
        self.alone = _log_estimate(zero, one)
        self.weighted, self.stop, self.parent = self.alone, np.ones(len(nodes)), np.zeros(0, np.int64)

    def above(self, depth: int) -> _Level:
        """The level of contexts of depth bytes, one less than here."""
        nodes, self.parent = np.unique((self.nodes >> 8 & (1 << 8 * depth) - 1) << 8 | self.nodes & 255, return_inverse=True)
        add = lambda x: np.bincount(self.parent, x, len(nodes))
        level = _Level(nodes, add(self.zero), add(self.one))
        level.mix(add(self.weighted))
        return level

    def mix(self, below: np.ndarray) -> None:
        """Weight the own estimate with the product of longer contexts (its log)."""
        self.weighted = np.logaddexp(self.alone, below) - np.log(2)
        self.stop = 0.5 * np.exp(self.alone - self.weighted)

    def passed(self, left: np.ndarray, mixed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """What is left to longer contexts, and the probabilities of 0 and 1 mixed so far, from those of each node's parent.

        Both outcomes are mixed on their own, so that a probability next to 1 leaves its complement exact.
        """
        here = left * self.stop
        return left * (1 - self.stop), tuple(m + here * _estimate((self.zero, self.one), k) for k, m in enumerate(mixed))


def _subtree(key: np.ndarray, n: np.ndarray, k: int) -> tuple[list[_Level], np.ndarray, np.ndarray]:
    """Levels SPLIT to DEPTH of whole subtrees at bit k of the byte; each pair's node at the last level, and its bit."""
    byte = key & 255
    bit = byte >> 7 - k & 1
    nodes, at = np.unique(key >> 8 << 8 | 1 << k | byte >> 8 - k, return_inverse=True)
    levels = [_Level(nodes, np.bincount(at, n * (1 - bit), len(nodes)), np.bincount(at, n * bit, len(nodes)))]
    for d in range(DEPTH - 1, SPLIT - 1, -1):
        levels.insert(0, levels[0].above(d))
    return levels, at, bit


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, n, m) of whole subtrees from rows in the order of their contexts' last SPLIT bytes."""
    held, size = [], 0
    for b in batches:
        held.append([b[c].to_numpy() for c in ("key", "n", "m")])
        size += b.num_rows
        if size >= _BLOCK:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = columns[0] >> 8 & (1 << 8 * SPLIT) - 1
            last = int(np.searchsorted(end, end[-1]))
            if last:
                yield tuple(c[:last] for c in columns)
            held, size = [[c[last:] for c in columns]], len(end) - last
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, zero, one, below): counts and log weighted probability of the subtrees under nodes of SPLIT - 1 bytes."""
    for key, n, _ in _blocks(batches):
        for k in range(8):
            top = _subtree(key, n, k)[0][0]
            nodes, at = np.unique((top.nodes >> 8 & (1 << 8 * (SPLIT - 1)) - 1) << 8 | top.nodes & 255, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.array(np.bincount(at, x, len(nodes))) for x in (top.zero, top.one, top.weighted))], names=["node", "zero", "one", "below"])


class Crown:
    """Nodes of SPLIT - 1 bytes: what they leave to longer contexts, and the probabilities mixed up to them."""

    def __init__(self, nodes: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray):
        order = np.argsort(nodes)
        levels = [_Level(nodes[order], zero[order], one[order])]
        levels[0].mix(below[order])
        for d in range(SPLIT - 2, -1, -1):
            levels.insert(0, levels[0].above(d))
        left, mixed = np.ones(len(levels[0].nodes)), (np.zeros(len(levels[0].nodes)),) * 2
        for level, lower in zip(levels, [*levels[1:], None], strict=True):
            left, mixed = level.passed(left, mixed)
            if lower:
                left, mixed = left[lower.parent], tuple(m[lower.parent] for m in mixed)
        self.nodes, self.left, self.mixed = levels[-1].nodes, left, mixed

    def resolve(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, n, logp): log10 probability of each pair's byte after its context; n is how often texts have the pair."""
        for key, n, m in _blocks(batches):
            logp = np.zeros(len(key))
            for k in range(8):
                levels, at, bit = _subtree(key, n, k)
                top = levels[0].nodes
                up = np.searchsorted(self.nodes, (top >> 8 & (1 << 8 * (SPLIT - 1)) - 1) << 8 | top & 255)
                left, mixed = self.left[up], tuple(x[up] for x in self.mixed)
                for level, lower in zip(levels, [*levels[1:], None], strict=True):
                    left, mixed = level.passed(left, mixed)
                    to = lower.parent if lower else at
                    left, mixed = left[to], tuple(x[to] for x in mixed)
                logp += np.log10(np.where(bit == 1, mixed[1], mixed[0]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(m), pa.array(logp)], names=["key", "n", "logp"])


def pair_scores(grams: DataFrame) -> DataFrame:
    """(key, n, logp) of every pair in grams (key, n, m): the full tree is that of the counts n; the result's n is m."""
    end = F.shiftright("key", 8).bitwiseAND((1 << 8 * SPLIT) - 1)
    subtrees = grams.select("key", "n", "m").repartition(end).sortWithinPartitions(end)
    tops = subtrees.transform(mapped, _weigh, "node long, zero double, one double, below double")
    # At most 256 ** (SPLIT - 1) contexts of 255 nodes each.
    top = tops.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zero", "one", "below"))).toArrow()
    crown = grams.sparkSession.sparkContext.broadcast(Crown(*(top[c].to_numpy() for c in ("node", "zero", "one", "below"))))
    return written(subtrees.transform(mapped, lambda batches: crown.value.resolve(batches), "key long, n long, logp double"), "pairs")


class _Head:
    """Logarithms of the most frequent words or byte runs, by key."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are here, and their logarithms where they are."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        here = self.keys[at] == hashes
        return here, np.where(here, self.logs[at], 0.0)


def _lists(of: np.ndarray, keys: np.ndarray, n: int) -> pa.Array:
    """The keys of each of n rows as a list; of: the row of each key, in order."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])), pa.array(keys.view(np.int64))).cast(pa.list_(pa.int64()))


def language_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score, score and bits_per_byte; held_out rows do not train."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counted = docs.select("text", "held_out").transform(mapped, _count, "kind byte, key long, n long, m long")
    counts = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    words = counts.where(f"kind = {_WORD}").select("key", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head_rows = most_frequent(words, HEAD).toArrow()
    head = spark.sparkContext.broadcast(_Head(head_rows["key"].to_numpy().view(np.uint64), np.log10(head_rows["n"].to_numpy() + 0.1)))
    pairs = pair_scores(counts.where(f"kind = {_GRAM}"))
    pair_rows = most_frequent(pairs, HEAD_GRAMS).toArrow()
    often = spark.sparkContext.broadcast(_Head(pair_rows["key"].to_numpy().view(np.uint64), pair_rows["logp"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in pieces(whole, "text"):
                n = b.num_rows
                data, begins, stops, words = normal_bytes(b["text"])
                sizes, scores, rare = stops - begins, np.zeros(n), []
                for keys, byte_rows in _grams(data, begins, stops):
                    distinct, at = np.unique(keys, return_inverse=True)
                    found, logp = often.value.find(distinct)
                    scores += np.bincount(byte_rows, logp[at], n)
                    rare.append((byte_rows[~found[at]], keys[~found[at]]))
                rare_rows, rare_keys = map(np.concatenate, zip(*rare, strict=True))
                hashes, rows = words.hashes(), words.rows()
                here, logs = head.value.find(hashes)
                end_here, end_log = head.value.find(np.array([END_KEY]))
                known = np.bincount(rows, here, n).astype(np.int64) + int(end_here[0])
                base = np.bincount(rows, logs, n) + end_log[0]
                away = np.append(hashes[~here], np.repeat(END_KEY, 0 if end_here[0] else n))
                of = np.append(rows[~here], np.arange(0 if end_here[0] else n))
                order = np.argsort(of, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid + np.arange(n)), b["doc_id"], b["held_out"], pa.array(words.counts + 1), pa.array(known), pa.array(base), pa.array(scores), pa.array(sizes), _lists(of, away[order], n), _lists(rare_rows, rare_keys, n)],
                    names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "tail", "rare"],
                )
                rid += n

    kind = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, tail array<long>, rare array<long>"
    rows = written(docs.transform(mapped, score, kind), "scores")
    tails = rows.select("rid", F.explode("tail").alias("key")).join(words, "key", "left")
    sums = tails.groupBy("rid").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_base"))
    # Every pair of every text is in the table.
    rare = rows.select("rid", F.explode("rare").alias("key")).join(pairs.select("key", "logp"), "key").groupBy("rid").agg(F.sum("logp").alias("rare_score"))
    norm = float(np.log10(totals["n"] + 0.1 * (totals["v"] + 1)))
    total = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return rows.drop("tail", "rare").join(sums, "rid", "left").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(totals["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        total.alias("score"), (-total * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
