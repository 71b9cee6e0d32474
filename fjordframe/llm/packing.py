"""Packing by lexical retrieval: windows of related documents, filled to the last token.

Each task reads its documents in order and closes a shard at SHARD_DOCS documents or SHARD_TOKENS tokens. A shard has
a BM25 inverted index over token ids. A window starts with a seed, the document that the window before had to cut or
else the first one unused; the seed's terms bring back its unused neighbours, best first, and they fill the
window greedily. The last one that fits only in part is cut and seeds the next window. Where a seed has no neighbour
left, the next unused document takes its place. A window that a shard leaves open is filled from the task's next shard, so
every window of a task but its last is full; the last one's tokens are cut into sequences whose lengths are powers of two,
which need no padding.

A seed searches with all its terms, so its neighbours are those of full BM25, in their order. `terms` limits a search to the
seed's terms of greatest weight, which is faster; 16 of them find about a third of the ten best neighbours, 64 three quarters.

A null text is empty; an empty document is its end id. Every row is packed, also rows that repeat an id or have none.
No shuffle: a lost task's shards are made anew from the same rows, with the same sequence ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordframe.llm.common import batch, mapped
from fjordframe.llm.textbytes import pieces
from fjordframe.llm.tokens import default_path, encoder

WINDOW = 2048
SHARD_DOCS, SHARD_TOKENS = 4096, 1_500_000
#: BM25's parameters.
K1, B = 1.2, 0.75
END = 1

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.binary())])
_PIECES_SQL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary"


class Index:
    """BM25 postings over the token ids of a shard's documents."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        n, sizes = len(bounds) - 1, np.diff(bounds)
        pairs, tf = np.unique(np.repeat(np.arange(n), sizes) << 20 | ids, return_counts=True)
        doc, term = pairs >> 20, pairs & 0xFFFFF
        df = np.bincount(term)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(1.0, sizes.mean())))
        self.n, self.df = n, df
        self.term, self.weight, self.of = term, weight, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.score = doc[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, seed: int, used: np.ndarray, terms: int | None) -> np.ndarray:
        """Unused documents that share the seed's strongest terms (all its terms if None), best first."""
        a, b = self.of[seed], self.of[seed + 1]
        term, weight = self.term[a:b], self.weight[a:b]
        shared = self.df[term] > 1
        term, weight = term[shared], weight[shared]
        if terms is not None and len(term) > terms:
            term = term[np.lexsort((term, -weight))[:terms]]
        score = np.zeros(self.n)
        for t in term:
            x, y = self.first[t], self.first[t + 1]
            score[self.doc[x:y]] += self.score[x:y]
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def filled(ids: np.ndarray, bounds: np.ndarray, window: int = WINDOW, taken: int = 0, terms: int | None = None) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of (document, start, length), and what the last, open one holds: every token of a shard once.

    The first window has `taken` places less.
    """
    index, sizes = Index(ids, bounds), np.diff(bounds)
    used = np.zeros(len(sizes), bool)
    out: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room, following, seed, at = window - taken, 0, -1, 0

    def place(doc: int, start: int) -> int:
        """Put what fits of a document into the window; what is left of it."""
        nonlocal room
        size = min(room, int(sizes[doc]) - start)
        now.append((doc, start, size))
        used[doc] = True
        room -= size
        return start + size if start + size < sizes[doc] else 0

    while True:
        if seed < 0:
            while following < len(sizes) and used[following]:
                following += 1
            if following == len(sizes):
                return out, now
            seed, at = following, 0
        left = place(seed, at)
        if not room:
            out.append(now)
            now, room = [], window
            seed, at = (seed, left) if left else (-1, 0)
            continue
        near, seed = index.neighbours(seed, used, terms), -1
        for doc in near:
            left = place(int(doc), 0)
            if not room:
                out.append(now)
                now, room = [], window
                seed, at = (int(doc), left) if left else (-1, 0)
                break


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """(document, start, length) pieces cut into sequences whose lengths are powers of two, the longest first."""
    rest, pieces = sum(p[2] for p in pieces), list(pieces)
    while rest:
        need = size = 1 << rest.bit_length() - 1
        head = []
        while need:
            doc, start, length = pieces.pop(0)
            head.append((doc, start, min(need, length)))
            if length > need:
                pieces.insert(0, (doc, start + need, length - need))
            need -= min(need, length)
        yield head
        rest -= size


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, terms: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids (32-bit little-endian).

    terms: how many of its terms a seed searches with, all if None.
    """
    tokenizer = tokenizer or default_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 36
        doc_ids, parts, tokens = [], [], 0
        # The open window's rows, and where it stands.
        open_rows, offset = [], 0

        def row(doc: tuple, start: int, raw: bytes) -> None:
            nonlocal offset
            open_rows.append((doc[0], start, len(raw) // 4, doc[1], sequence, offset, raw))
            offset += len(raw) // 4

        def closed() -> pa.RecordBatch:
            made = batch(_PIECES, list(map(list, zip(*open_rows, strict=True))))
            open_rows.clear()
            return made

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, offset
            sizes = np.concatenate([p[1] for p in parts])
            ids, bounds = np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(sizes)])
            raw = ids.astype("<u4").tobytes()
            full, left = filled(ids, bounds, window, offset, terms)
            for pieces_of in [*full, left]:
                for doc, start, length in pieces_of:
                    a = 4 * (int(bounds[doc]) + start)
                    row((doc_ids[doc], int(sizes[doc])), start, raw[a : a + 4 * length])
                if offset == window:
                    sequence, offset = sequence + 1, 0
            still = [r for r in open_rows if r[4] == sequence]
            del open_rows[len(open_rows) - len(still) :]
            if open_rows:
                yield closed()
            open_rows.extend(still)

        for whole in batches:
            for b in pieces(whole, "text", 2 << 20):
                ids, offsets = own.encode(b["text"])
                ids, sizes = np.insert(ids, offsets[1:], END), np.diff(offsets) + 1
                at = 0
                ends = np.concatenate([[0], np.cumsum(sizes)])
                names = b["doc_id"].to_pylist()
                while at < len(sizes):
                    to = min(len(sizes), at + SHARD_DOCS - len(doc_ids), max(at + 1, int(np.searchsorted(ends, ends[at] + SHARD_TOKENS - tokens, "right")) - 1))
                    parts.append((ids[ends[at] : ends[to]], sizes[at:to]))
                    doc_ids += names[at:to]
                    tokens += int(ends[to] - ends[at])
                    at = to
                    if len(doc_ids) >= SHARD_DOCS or tokens >= SHARD_TOKENS or at < len(sizes):
                        yield from shard()
                        doc_ids, parts, tokens = [], [], 0
        if doc_ids:
            yield from shard()
        tail = list(open_rows)
        open_rows.clear()
        for piece in powers_of_two([(k, 0, r[2]) for k, r in enumerate(tail)]):
            offset = 0
            for k, start, length in piece:
                row((tail[k][0], tail[k][3]), tail[k][1] + start, tail[k][6][4 * start : 4 * (start + length)])
            sequence += 1
        if open_rows:
            yield closed()

    return docs.select(F.col("doc_id").cast("long"), "text").transform(mapped, pack, _PIECES_SQL)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
