"""Alignment of the tokens that two tokenizers give the same text, and how often pairs of ids meet in a corpus.

Tokenizer A (a byte-level BPE file) encodes a space and the text, tokenizer B (a sentencepiece model that adds this space
itself) the text, so both cut the same bytes. The ends of both token sequences together cut these bytes into elementary
intervals; each lies in one token of either side and is the one link of that pair of tokens. Offsets where tokens of both
sides end close a group.

Both tokenizers also end a token wherever a single space follows a visible character, as neither has a token with a space
after such a character (checked when the files are loaded). Texts are cut into units there; units are encoded and aligned
once, all new ones of a batch together, and kept under their bytes (KEPT at most). Alignments are written with their links,
so that texts are encoded once; counts of all id pairs are taken from there. The most frequent pairs (HEAD at most) are sent to
the tasks that sum up each document's links; links of other pairs get their counts by a join.

A null or empty text, and one whose joined tokens of either side are other bytes than the space and the text (one with
U+2581, which B takes for a space), has no tokens: zeros and an empty groups column. Rows that repeat, or share an id, count
each and come back each. doc_id is an integer or null. Other columns, of any name, play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.llm.common import batch, mapped, most_frequent, written
from fjordframe.llm.textbytes import Words, flat, owners, pieces, summed
from fjordframe.llm.tokens import distinct_words

#: Units that a process keeps with their alignment before it starts anew.
KEPT = 250_000
#: Id pairs whose counts are sent to every task.
HEAD = 1 << 19
#: Links that are worked on at once.
WINDOW = 1 << 18
#: Different id pairs that a task holds while counting.
HELD = 1 << 20
#: Units whose groups are hashed at once.
STRETCH = 1 << 14
#: Bytes of new units that are encoded as one text.
JOINED = 1 << 16
_PAIR = np.int64(1 << 32)
#: A space after a character that cut_units() takes for visible.
_VISIBLE_SPACE = re.compile(rb"(?:[\x21-\x7E]|[\xC3-\xC5][\x80-\xBF]) ")
_JOINS = re.compile(rb"(?:[\x21-\x7E]|[\xC3-\xC5][\x80-\xBF])\Z")
_MARK = "▁".encode()


def default_paths() -> tuple[str, str]:
    """The installed byte-level file and piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level symbols: visible bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def cut_units(texts: pa.Array) -> Words:
    """Each text after a space, cut before spaces that stand between a visible character below U+0180 and another than a space."""
    raw, bounds = flat(texts)
    full = np.diff(bounds) > 0
    data = np.insert(raw, bounds[:-1][full], 0x20)
    bounds = bounds + np.concatenate([[0], np.cumsum(full)])
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(bounds), np.int64))
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, ahead = data[at - 1], data[np.maximum(at - 2, 0)]
    visible = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (ahead >= 0xC3) & (ahead <= 0xC5))
    start = np.zeros(n + 1, bool)
    start[at[visible & (data[at + 1] != 0x20)]] = True
    start[bounds[1:] - 1] = False  # a text's last byte; the first ones follow
    start[bounds[:-1][full]] = True
    starts = np.flatnonzero(start[:n])
    return Words(data, starts, np.append(starts[1:], n), np.searchsorted(starts, bounds))


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals of two cuts of the same bytes: the token of A and of B that each lies in, and whether both end with it."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, ends_a[a] == ends_b[b]


def _widths(ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 1


def _decimal(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The bytes of ids in decimal, each followed by its mark."""
    widths = _widths(ids)
    stops = np.cumsum(widths + 1) - 1
    out = np.zeros(int(stops[-1]) + 1 if len(stops) else 0, np.uint8)
    out[stops] = marks
    for k in range(int(widths.max(initial=0))):
        at = widths > k
        out[stops[at] - 1 - k] = 48 + ids[at] // 10**k % 10
    return out


class Aligner:
    """Encodes and aligns units. Of the unit at place p: ok, n_a, n_b, n_groups, links (id pairs) and groups (as text, each group with a semicolon)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        if max(self.a.get_vocab_size(), self.b.get_piece_size()) > 1 << 16:
            raise ValueError("ids of over 16 bits")
        symbols = _byte_of_symbol()
        self.bytes_a = [bytes(symbols[c] for c in t) if all(c in symbols for c in t) else b"" for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(_VISIBLE_SPACE.search(x) for x in [*self.bytes_a, *self.bytes_b]):
            raise ValueError("a token has a space after a visible character: texts can't be cut there")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.forget()

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ok = np.zeros(0, bool)
        self.n_a = self.n_b = self.n_groups = self.n_links = self.first_link = self.links = self.n_text = self.first_text = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)

    def _learn(self, units: list[bytes]) -> None:
        """Units that end in a visible character and do not begin with two spaces are encoded together, as cut_units() would part them again."""
        joined, alone, size = [[]], [], 0
        for u in units:
            if not _JOINS.search(u) or u[1:2] == b" " or _MARK in u:
                alone.append([u])
                continue
            joined[-1].append(u)
            size += len(u)
            if size > JOINED:
                joined.append([])
                size = 0
        self._learn_runs([*filter(None, joined), *alone])

    def _learn_runs(self, runs: list[list[bytes]]) -> None:
        """Encode each run of units as one text; a run of one unit whose tokens are other bytes has none."""
        raw = [b"".join(r) for r in runs]
        texts = [t.decode() for t in raw]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        same = [b"".join(map(self.bytes_a.__getitem__, x)) == t == b"".join(map(self.bytes_b.__getitem__, y)) for t, x, y in zip(raw, ids_a, ids_b, strict=True)]
        good = [k for k, fits in enumerate(same) if fits]
        self._keep([u for k in good for u in runs[k]], *(np.fromiter(chain.from_iterable(ids[k] for k in good), np.int64) for ids in (ids_a, ids_b)))
        bad = [r for r, fits in zip(runs, same, strict=True) if not fits]
        self._keep_empty([r[0] for r in bad if len(r) == 1])
        if again := [[u] for r in bad if len(r) > 1 for u in r]:
            self._learn_runs(again)

    def _keep(self, units: list[bytes], ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """Align units whose tokens stand in a row."""
        unit_ends = np.cumsum([len(u) for u in units], dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        own_a, own_b, shared = intervals(ends_a, ends_b)
        unit_a, unit_b = np.searchsorted(unit_ends, ends_a), np.searchsorted(unit_ends, ends_b)
        n = len(units)
        # Tokens by groups, those of A first; the last of each side has another mark than a comma.
        stops_a, stops_b = own_a[shared] + 1, own_b[shared] + 1
        at_a = np.arange(len(ids_a)) + np.concatenate([[0], stops_b])[np.searchsorted(stops_a, np.arange(len(ids_a)), "right")]
        at_b = np.arange(len(ids_b)) + stops_a[np.searchsorted(stops_b, np.arange(len(ids_b)), "right")]
        ids, marks = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        marks[at_a[stops_a - 1]], marks[at_b[stops_b - 1]] = ord("|"), ord(";")
        sizes = sum(np.bincount(unit, _widths(x) + 1, n).astype(np.int64) for unit, x in ((unit_a, ids_a), (unit_b, ids_b)))
        link_sizes = np.bincount(unit_a[own_a], minlength=n)
        self.place.update(zip(units, range(len(self.ok), len(self.ok) + n), strict=True))
        self.ok = np.append(self.ok, np.ones(n, bool))
        self.n_a, self.n_b = np.append(self.n_a, np.bincount(unit_a, minlength=n)), np.append(self.n_b, np.bincount(unit_b, minlength=n))
        self.n_groups = np.append(self.n_groups, np.bincount(unit_a[own_a[shared]], minlength=n))
        self.n_links, self.first_link = np.append(self.n_links, link_sizes), np.append(self.first_link, len(self.links) + np.cumsum(link_sizes) - link_sizes)
        self.n_text, self.first_text = np.append(self.n_text, sizes), np.append(self.first_text, len(self.text) + np.cumsum(sizes) - sizes)
        self.links = np.append(self.links, ids_a[own_a] * _PAIR + ids_b[own_b])
        self.text = np.append(self.text, _decimal(ids, marks))

    def _keep_empty(self, units: list[bytes]) -> None:
        self.place.update(zip(units, range(len(self.ok), len(self.ok) + len(units)), strict=True))
        self.ok = np.append(self.ok, np.zeros(len(units), bool))
        for name in ("n_a", "n_b", "n_groups", "n_links", "first_link", "n_text", "first_text"):
            setattr(self, name, np.append(getattr(self, name), np.zeros(len(units), np.int64)))

    def places(self, words: Words) -> np.ndarray:
        """Where the alignment of each unit is kept; new ones are learned, after all are forgotten if there would be too many."""
        if not len(words.starts):
            return np.zeros(0, np.int64)
        one, back = distinct_words(words)
        raw = words.data.tobytes()
        keys = [raw[p:q] for p, q in zip(words.starts[one].tolist(), words.ends[one].tolist(), strict=True)]
        fresh = [k for k in keys if k not in self.place]
        if self.place and len(self.place) + len(fresh) > KEPT:
            self.forget()
            fresh = keys
        if fresh:
            self._learn(fresh)
        return np.array([self.place[k] for k in keys], np.int64)[back]

    def groups_of(self, places: np.ndarray) -> bytes:
        """The groups of units, in a row."""
        sizes = self.n_text[places]
        return self.text[np.repeat(self.first_text[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()

    def links_of(self, places: np.ndarray) -> np.ndarray:
        """The links of units, in a row."""
        sizes = self.n_links[places]
        return self.links[np.repeat(self.first_link[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def digest(self, places: np.ndarray) -> str:
        """SHA-256 of the groups of a text's units, without the last semicolon."""
        digest = hashlib.sha256()
        for at in range(0, len(places), STRETCH):
            stretch = self.groups_of(places[at : at + STRETCH])
            digest.update(stretch if at + STRETCH < len(places) else stretch[:-1])
        return digest.hexdigest()


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """This process's aligner of two files; kept between tasks."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the units' values over each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


_ALIGNED = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<short>, b array<short>"
_ALIGNED_ARROW = pa.schema([*((c, pa.int64()) for c in ("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("a", pa.list_(pa.int16())), ("b", pa.list_(pa.int16()))])


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b): each document's alignment; a and b are the ids of its links in order, as shorts without a sign.

    groups_sha256 is that of the groups in order, `a1,a2|b1;a3|b2,b3` in decimal ids; rid numbers the rows.
    """
    paths = paths or default_paths()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(paths)
        rid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in pieces(whole, "text"):
                words = cut_units(b["text"])
                places, first = own.places(words), words.first
                valid = (_by_text(~own.ok[places], first) == 0) & (words.counts > 0)
                digests = [own.digest(places[p:q]) if good else "" for good, p, q in zip(valid.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
                totals = [np.where(valid, _by_text(x[places], first), 0) for x in (own.n_a, own.n_b, own.n_groups, own.n_links)]
                links = own.links_of(places[np.repeat(valid, words.counts)])
                bounds = pa.array(np.concatenate([[0], np.cumsum(totals[3])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.uint16).view(np.int16))) for x in np.divmod(links, _PAIR)]
                yield batch(_ALIGNED_ARROW, [rid + np.arange(b.num_rows), b["doc_id"], *totals, digests, *lists])
                rid += b.num_rows
        own.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped, align, _ALIGNED)


def _links(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The id pairs of all links of a batch, in a row, and the row of each, WINDOW after WINDOW."""
    bounds = b["a"].offsets.to_numpy().astype(np.int64)
    flat_a, flat_b = (b[c].flatten().to_numpy().view(np.uint16) for c in "ab")
    for at in range(0, len(flat_a), WINDOW):
        keys = flat_a[at : at + WINDOW].astype(np.int64) * _PAIR + flat_b[at : at + WINDOW]
        yield keys, owners(bounds - bounds[0], at, at + len(keys))


def pair_counts(alignments: DataFrame) -> DataFrame:
    """(a, b, n): for each pair of ids that meet, how many links hold it; each task counts its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            keys, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys // _PAIR), pa.array(keys % _PAIR), pa.array(n)], names=["a", "b", "n"])

        for b in batches:
            for keys, _ in _links(b):
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    return alignments.select("a", "b").transform(mapped, count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Counts:
    """Counts of id pairs, and whether each is the highest of its B id."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n, self.best = keys[order], n[order], best[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are here, their counts and bests (0 for others)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        return here, np.where(here, self.n[at], 0), np.where(here, self.best[at], 0)


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, head: int = HEAD) -> DataFrame:
    """One row per document: tokens of either side, groups, links, links of the best pair of their B id, sum of the links' counts, hash of the groups."""
    spark = docs.sparkSession
    rows = written(alignments(docs, paths), "aligned", **{"parquet.block.size": 32 << 20})
    pairs = pair_counts(rows).withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).cast("int"))
    counts = written(pairs.select((F.col("a") * int(_PAIR) + F.col("b")).alias("key"), "n", "best"), "pairs")
    often = most_frequent(counts, head).toArrow()
    sent = spark.sparkContext.broadcast(Counts(*(often[c].to_numpy() for c in ("key", "n", "best"))))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, sizes, rare = np.zeros((2, b.num_rows), np.int64), np.zeros(b.num_rows, np.int64), []
            for keys, row in _links(b):
                distinct, back = np.unique(keys, return_inverse=True)
                here, n, best = sent.value.find(distinct)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
                sums += [np.diff(np.concatenate([[0], np.cumsum(x[back])])[ends]) for x in (best, n)]  # of whole numbers
                away = ~here[back]
                sizes += np.bincount(row[away], minlength=b.num_rows)
                rare.append(keys[away])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *rare])))
            yield pa.RecordBatch.from_arrays([b["rid"], *map(pa.array, sums), lists], names=["rid", "head_best", "head_sum", "rare"])

    rated = written(rows.select("rid", "a", "b").transform(mapped, rate, "rid long, head_best long, head_sum long, rare array<long>"), "rated")
    # Every pair of every text is in the table.
    rare = rated.select("rid", F.explode("rare").alias("key")).join(counts, "key").groupBy("rid").agg(F.sum("best").alias("more_best"), F.sum("n").alias("more_sum"))
    sums = rated.drop("rare").join(rare, "rid", "left")
    plus = lambda own, rest: (F.col(own) + F.coalesce(rest, F.lit(0))).cast("long")
    return rows.drop("a", "b").join(sums, "rid").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("head_best", "more_best").alias("n_best"), plus("head_sum", "more_sum").alias("count_sum"), "groups_sha256")
