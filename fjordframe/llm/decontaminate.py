"""Benchmark decontamination by winnowing.

Every run of WINDOW words that a document shares with a benchmark item is found: both sides keep the minimum hash
of each SPAN consecutive GRAM-word hashes (SPAN + GRAM - 1 = WINDOW), so a shared run of WINDOW words has a kept hash
in common; equal hashes are then extended to every window of WINDOW words around them, which must be a window of an item.
Items of fewer than WINDOW words are one window each and are met by the hash of their whole sequence.

Two ways to join the fingerprints give the same rows. Where the benchmark text is at most `broadcast_bytes` (measured
first), its fingerprints and word hashes go to every executor and documents are read once, without a shuffle. Beyond
it the fingerprints of both sides are joined by a shuffle, after equal ones of a text are taken once, and those of the
benchmark are dealt out SALT times, so that a passage that many documents share is met in many tasks. The items that a
document may hold are then brought to it; its own text travels once.

Null or wordless texts have no words, no hits and are not contaminated; null items and items without words never
match; an item id that occurs twice counts once; items without an id mark words but are not listed. Item ids of any type
are listed, and told apart, as text. Document ids keep their type. Rows that repeat are judged each for itself. Other
columns, of any name, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordframe.llm.common import mapped, text_column, written
from fjordframe.llm.textbytes import _STEP, ALNUM, Words, cut, inside_texts, mixed, pieces, windows

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Copies of the benchmark's fingerprints on the join side, each for a part of the documents.
SALT = 16
#: Bytes of item texts that are laid beside a document at once on the join side.
_HELD = 4 << 20


def _slide(x: np.ndarray, take: np.ufunc, n: int) -> np.ndarray:
    """take over each n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = take(x[:-step], x[step:])
        have += step
    return x


def winnow(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the GRAM-word runs that are the minimum of some SPAN runs in a row."""
    grams = windows(hashes, GRAM)
    ok = inside_texts(words.first, GRAM)[: len(grams)]
    grams = np.where(ok, grams, _NEVER)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    edge = np.full(SPAN - 1, _NEVER)
    least = _slide(np.concatenate([edge, grams, edge]), np.minimum, SPAN)
    kept = np.flatnonzero((_slide(least, np.maximum, SPAN) == grams) & ok)
    return kept, grams[kept]


def _windows_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """windows(hashes, k) at some places."""
    out = hashes[at].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[at + j]
    return mixed(out + np.uint64(k))


class _Table:
    """Hashes of the items' windows of k words, and the items that each is in."""

    def __init__(self, k: int, hashes: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, hashes))
        hashes, item = hashes[order], item[order]
        new = np.ones(len(item), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])
        hashes, self.item = hashes[new], item[new]
        self.k, (self.hashes, first) = k, np.unique(hashes, return_index=True)
        self.first = np.append(first, len(self.item))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are here, and where."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes[at] == grams)
        return met, at[met]


class Benchmark:
    """Fingerprints of benchmark items, and their windows of WINDOW words; items of fewer words are one window each."""

    def __init__(self, ids: list, texts: pa.Array):
        words = cut(texts, ALNUM)
        hashes, self.ids, counts = words.hashes(), ids, words.counts
        at, prints = winnow(words, hashes)
        self.prints = np.unique(prints[counts[np.searchsorted(words.first, at, "right") - 1] >= WINDOW])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.prints >> np.uint64(44)).astype(np.int64)] = True
        grams = windows(hashes, WINDOW)
        at = np.flatnonzero(inside_texts(words.first, WINDOW)[: len(grams)])
        self.full = _Table(WINDOW, grams[at], np.searchsorted(words.first, at, "right") - 1)
        self.short = []
        for k in np.unique(counts[(counts > 0) & (counts < WINDOW)]).tolist():
            of = np.flatnonzero(counts == k)
            self.short.append(_Table(k, _windows_at(hashes, words.first[of], k), of))

    def _near(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Where windows of WINDOW words begin that hold a fingerprint of the benchmark."""
        at, prints = winnow(words, hashes)
        near = self.maybe[(prints >> np.uint64(44)).astype(np.int64)]
        at = at[near][np.isin(prints[near], self.prints)]
        if not len(at):
            return at
        begins = np.unique((at[:, None] - np.arange(SPAN)).reshape(-1))
        ok = inside_texts(words.first, WINDOW)
        begins = begins[(begins >= 0) & (begins < len(ok))]
        return begins[ok[begins]]

    def hits(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hit, rows, items): which words lie in a shared window, and every pair of text and item that share one.

        Each fingerprint in common is extended to all windows around it, which are compared as a whole: the work grows with
        the text, however often the same words stand in it or in an item.
        """
        change = np.zeros(len(hashes) + 1, np.int32)
        pairs = [np.zeros((0, 2), np.int64)]
        for table in (self.full, *self.short):
            if table is self.full:
                at = self._near(words, hashes)
                grams = _windows_at(hashes, at, WINDOW)
            else:
                grams = windows(hashes, table.k)
                at = np.flatnonzero(inside_texts(words.first, table.k)[: len(grams)])
                grams = grams[at]
            met, place = table.find(grams)
            at = at[met]
            change[at] += 1
            change[at + table.k] -= 1
            rows = np.searchsorted(words.first, at, "right") - 1
            seen = np.unique(np.stack([rows, place], axis=1), axis=0)
            sizes = table.first[seen[:, 1] + 1] - table.first[seen[:, 1]]
            begin = np.repeat(table.first[seen[:, 1]] - (np.cumsum(sizes) - sizes), sizes)
            pairs.append(np.stack([np.repeat(seen[:, 0], sizes), table.item[begin + np.arange(int(sizes.sum()))]], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(change[:-1]) > 0, found[:, 0], found[:, 1]


def _digest(ids: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def _judge(benchmark: Benchmark, texts: pa.Array) -> tuple[np.ndarray, dict[int, tuple[int, set]]]:
    """Words of each text, and for texts with hits the number of words hit and the item ids."""
    words = cut(texts, ALNUM)
    hit, rows, items = benchmark.hits(words, words.hashes())
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
    by: dict[int, tuple[int, set]] = {int(r): (int(n_hit[r]), set()) for r in np.flatnonzero(n_hit)}
    for r, i in zip(rows.tolist(), items.tolist(), strict=True):
        if benchmark.ids[i] is not None:
            by[r][1].add(benchmark.ids[i])
    return words.counts, by


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL")


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of its words hit)."""
    docs, items = docs.select("doc_id", "text"), _items(items)
    if _text_bytes(items) <= broadcast_bytes:
        found = _by_broadcast(docs, items)
    else:
        # Written once, so that a document keeps its number.
        marked = written(docs.withColumn("rid", F.monotonically_increasing_id()), "marked")
        counts = marked.transform(mapped, _word_counts, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long")
        found = counts.join(_by_join(marked.select("rid", "text"), items), "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_digest(set()))).alias("items_sha256"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, items: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    items = _items(items)
    if _text_bytes(items) > broadcast_bytes:
        marked = written(docs.withColumn("_fjordframe_rid", F.monotonically_increasing_id()), "marked")
        texts = marked.select(F.col("_fjordframe_rid").alias("rid"), "text")
        counts = texts.select("rid", F.lit(None).cast("long").alias("doc_id"), "text").transform(mapped, _word_counts, "rid long, doc_id long, n_words long")
        bad = _by_join(texts, items).join(counts, "rid").where(_contaminated(F.col("n_hit"), F.col("n_words")))
        return marked.join(bad.select(F.col("rid").alias("_fjordframe_rid")), "_fjordframe_rid", "left_anti").drop("_fjordframe_rid")
    shared = _shared(docs, items)

    def bad(arrays: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        for (text,) in arrays:
            out = []
            for b in pieces(pa.RecordBatch.from_arrays([text], names=["text"]), "text"):
                n_words, found = _judge(shared.value, b["text"])
                out += [r in found and bool(_contaminated(found[r][0], n_words[r])) for r in range(b.num_rows)]
            yield pa.array(out, pa.bool_())

    return docs.where(~text_column(docs.sparkSession, bad, "boolean", "text"))


def _text_bytes(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]


def _shared(docs: DataFrame, items: DataFrame):
    table = items.toArrow()
    return docs.sparkSession.sparkContext.broadcast(Benchmark(table["item_id"].to_pylist(), table["text"].combine_chunks()))


_HITS = "n_hit long, n_items long, items_sha256 string"


def _by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256), the last three null without a hit."""
    shared = _shared(docs, items)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                n_words, found = _judge(shared.value, b["text"])
                hits = [(found[r][0], len(found[r][1]), _digest(found[r][1])) if r in found else (None,) * 3 for r in range(b.num_rows)]
                columns = list(zip(*hits, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_words, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    return docs.transform(mapped, judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, {_HITS}")


def _prints(side: str, lengths: list[int]):
    """mapInArrow function: each text's winnowed fingerprints, each once, as (rid, print), and those of short windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                words = cut(b["text"], ALNUM)
                hashes = words.hashes()
                at, prints = winnow(words, hashes)
                rows = [np.searchsorted(words.first, at, "right") - 1]
                if side == "item":
                    full = words.counts[rows[0]] >= WINDOW
                    rows, prints = [rows[0][full]], prints[full]
                prints = [prints]
                for k in lengths:
                    grams = windows(hashes, k)
                    at = np.flatnonzero(inside_texts(words.first, k)[: len(grams)])
                    row = np.searchsorted(words.first, at, "right") - 1
                    whole_item = words.counts[row] == k if side == "item" else np.ones(len(row), bool)
                    rows.append(row[whole_item])
                    prints.append(grams[at][whole_item] ^ np.uint64(k))
                row, found = np.concatenate(rows), np.concatenate(prints)
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(b["rid"].to_numpy()[row[new]]), pa.array(found[new].view(np.int64))], names=["rid", "print"])

    return emit


def _item_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, "text"):
            counts = cut(b["text"], ALNUM).counts
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(counts[(counts > 0) & (counts < WINDOW)]))], names=["k"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, "text"):
            yield pa.RecordBatch.from_arrays([b["rid"], b["doc_id"], pa.array(cut(b["text"], ALNUM).counts)], names=["rid", "doc_id", "n_words"])


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, n_hit, n_items, items_sha256) of documents with hits; a document's row comes before those of its items."""
    rid, words, hashes, hit, ids, held = None, None, None, None, set(), []

    def lay() -> None:
        if held:
            item = [i for i, _ in held]
            own, _, items = Benchmark(item, pa.array([t for _, t in held], pa.string())).hits(words, hashes)
            np.logical_or(hit, own, out=hit)
            ids.update(item[i] for i in items.tolist() if item[i] is not None)
            held.clear()

    def closed() -> Iterator[pa.RecordBatch]:
        lay()
        if hit is not None and hit.any():
            row = [rid], [int(hit.sum())], [len(ids)], [_digest(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rid", "n_hit", "n_items", "items_sha256"])

    size = 0
    for b in batches:
        for r, is_item, item, text in zip(*(b[c] for c in ("rid", "is_item", "item_id", "text")), strict=True):
            text = text.as_py()
            if not is_item.as_py():
                yield from closed()
                rid, ids, size = r.as_py(), set(), 0
                words = cut(pa.array([text]), ALNUM)
                hashes = words.hashes()
                hit = np.zeros(len(hashes), bool)
                continue
            held.append((item.as_py(), text))
            size += len(text)
            if size > _HELD:
                lay()
                size = 0
    yield from closed()


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(rid, n_hit, n_items, items_sha256) of the documents (rid, text) with hits."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = written(items.withColumn("rid", F.monotonically_increasing_id()), "items")
    lengths = [r["k"] for r in items.transform(mapped, _item_lengths, "k long").distinct().collect()]  # 12 values at most
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    own = F.pmod(F.hash("rid"), F.lit(SALT)).alias("salt")
    left = docs.transform(mapped, _prints("doc", lengths), "rid long, print long").select("rid", "print", own)
    right = items.select("rid", "text").transform(mapped, _prints("item", lengths), "item_rid long, print long").withColumn("salt", salted)
    pairs = left.join(right, ["print", "salt"]).select("rid", "item_rid", "salt").distinct()
    texts = items.select(F.col("rid").alias("item_rid"), "item_id", "text").withColumn("salt", salted)
    brought = written(pairs.join(texts, ["item_rid", "salt"]).select("rid", F.lit(True).alias("is_item"), "item_id", "text"), "brought")
    asked = docs.join(brought.select("rid").distinct(), "rid", "left_semi").select("rid", F.lit(False).alias("is_item"), F.lit(None).cast("string").alias("item_id"), "text")
    beside = asked.unionByName(brought).repartition(width, "rid").sortWithinPartitions("rid", "is_item")
    return beside.transform(mapped, _laid, f"rid long, {_HITS}")
