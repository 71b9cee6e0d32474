"""Token ids of a corpus in files of canonical length-limited Huffman codes, and reading them back.

write_ids() encodes every text once into a table of ids, counts the ids over the whole corpus, builds one code of at most LIMIT
bits from the counts (package-merge; at most a row an id comes to the driver, which the vocabulary bounds), and writes one file
a range of document ids, in ascending order. read_ids() decodes the files, read_range() any range of ids without what is before.

A file holds, all numbers little-endian:

* MAGIC, the number of ids in the alphabet and the compressed code lengths, a byte an id (0: not in the corpus); codes are
  given out by (length, id), so lengths say all;
* blocks of BLOCK ids or somewhat more, each decoded by itself: counts, per piece its document's id, number of ids and flags,
  a checkpoint (bit offset in the piece) for every SEGMENT ids, a checksum, and the pieces' codes. A piece is a document, or up
  to BLOCK ids of a longer one; it begins at a whole byte;
* the directory: offset and first id of each block, then counts and MAGIC again.

Decoding looks LIMIT bits up in a table and takes one id from each segment of a block at a time.

Null texts are empty; every document has the end id. Order is by doc_id, nulls first; documents that share an id, by
length and a checksum of their ids, so equal rows stand together and come back each. doc_id is an integer or null. Files carry
the task's attempt in their names and only those of attempts whose rows came back are read. Other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.llm.common import mapped, new_path, written
from fjordframe.llm.textbytes import pieces
from fjordframe.llm.tokens import default_path, encoder
from fjordframe.llm.warc import _attempt, _files

LIMIT, BLOCK, SEGMENT = 18, 1 << 16, 128
END_ID = 1
MAGIC = b"FJHUF1\r\n"
_BLOCK_HEAD, _TAIL = struct.Struct("<IIIII"), struct.Struct("<QQI8s")
_NULL, _MORE = 1, 2


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (more if there are over 2**limit ids); 0 for ids that don't occur.

    Package-merge: at each level the symbols are merged with pairs of the level below; what the first 2n - 2 of the last
    level hold, level by level, says how often each symbol is taken, which is its length.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64 if counts.sum() >= 1 << 53 else np.int64)
    level, own = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        own.append(at < n)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for symbols in reversed(own):
        singles = int(symbols[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        ids = np.flatnonzero(lengths)
        ids = ids[np.argsort(lengths[ids], kind="stable")]
        sizes = lengths[ids].astype(np.int64)
        self.most = int(sizes.max(initial=1))
        # The code of length l after a shorter one goes on from there, shifted: as fractions of 2**most they follow each other.
        spans = np.int64(1) << (self.most - sizes)
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (starts >> (self.most - sizes)).astype(np.uint64)
        self.ids, self.spans = ids, spans

    def table(self) -> np.ndarray:
        """For every run of `most` bits the id that it begins with, and its length: id * 32 + length."""
        full = np.zeros(1 << self.most, np.int64)
        entries = self.ids * 32 + self.lengths[self.ids]
        full[: int(self.spans.sum())] = np.repeat(entries, self.spans)
        return full

    def packed(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, offsets in bytes, checkpoints, their offsets) of pieces of ids, which begin at bounds."""
        sizes = self.lengths[ids].astype(np.int64)
        after = np.concatenate([[0], np.cumsum(sizes)])
        bits = np.diff(after[bounds])
        offsets = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
        counts = np.diff(bounds)
        place = after[:-1] + np.repeat(8 * offsets[:-1] - after[bounds[:-1]], counts)
        out = np.zeros(int(offsets[-1]) // 8 + 2, np.uint64)
        if len(ids):
            word, code = place >> 6, self.codes[ids]
            left = 64 - (place & 63) - sizes
            over = left < 0
            first = np.where(over, code >> np.where(over, -left, 0).astype(np.uint64), code << np.where(over, 0, left).astype(np.uint64))
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[heads]] = np.bitwise_or.reduceat(first, heads)
            out[word[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)
        segments = -(-counts // SEGMENT)
        check_bounds = np.concatenate([[0], np.cumsum(segments)])
        at = np.repeat(bounds[:-1] - SEGMENT * check_bounds[:-1], segments) + SEGMENT * np.arange(int(check_bounds[-1]))
        checkpoints = (place[at] - np.repeat(8 * offsets[:-1], segments)).astype("<u4")
        return out.astype(">u8").tobytes()[: int(offsets[-1])], offsets, checkpoints, check_bounds


class Decoder:
    """Decodes segments by table."""

    def __init__(self, lengths: np.ndarray):
        code = Code(lengths)
        self.most, self.table = code.most, code.table()

    def decoded(self, data: bytes, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of segments of given bit offsets and sizes, in a row; an id of each segment at a time."""
        padded = np.frombuffer(data + bytes(8), np.uint8)
        wide = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
        out = np.zeros(int(sizes.sum()), np.uint32)
        order = np.argsort(-sizes, kind="stable")
        at, to = places[order].copy(), (np.cumsum(sizes) - sizes)[order]
        alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
        mask, down = np.uint64((1 << self.most) - 1), 64 - self.most
        for k, n in enumerate(alive.tolist()):
            now = at[:n]
            entry = self.table[(wide[now >> 3].astype(np.uint64) >> (down - (now & 7)).astype(np.uint64)) & mask]
            out[to[:n] + k] = entry >> 5
            now += entry & 31
        return out


_TOKENS = "doc_id long, n long, crc long, ids binary"


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(rid, doc_id, n, crc, ids) of every document, the end id included, written: ids little-endian, two bytes each where the vocabulary allows."""
    tokenizer = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for whole in batches:
            for b in pieces(whole, "text", 2 << 20):
                ids, bounds = own.encode(b["text"])
                bounds = bounds + np.arange(len(bounds))
                full = np.full(int(bounds[-1]), END_ID, "<u4")
                keep = np.ones(len(full), bool)
                keep[bounds[1:] - 1] = False
                full[keep] = ids
                crc = [zlib.crc32(full[p:q]) for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                short = full.astype(_width(len(own.last)))
                data = [short[p:q].tobytes() for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "n", "crc", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped, encode, _TOKENS)
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "tokens", compression="zstd")


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in a token table; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            for row in b["ids"]:
                n += np.bincount(np.frombuffer(row.as_buffer(), _width(vocabulary)), minlength=vocabulary)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["id", "n"])

    rows = tokens.select("ids").transform(mapped, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


@dataclass(frozen=True)
class Store:
    """folder: where the files are; files: name, place of its first id, number of ids and documents, in order."""

    folder: str
    files: list[tuple[str, int, int, int]]


class _Writer:
    """Writes one file, block by block."""

    def __init__(self, folder: str, name: str, lengths: np.ndarray):
        system, path = _files(folder)
        system.create_dir(path, recursive=True)
        self.out = system.open_output_stream(f"{path}/{name}", compression=None)
        self.offset, self.n_ids, self.n_docs, self.directory = 0, 0, 0, []
        raw = zlib.compress(lengths.tobytes())
        self.write(MAGIC + struct.pack("<II", len(lengths), len(raw)) + raw)
        self.rows: list[tuple] = []
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def add(self, doc_id: int | None, n: int, more: bool, code: bytes, checkpoints: bytes) -> None:
        self.rows.append((doc_id, n, more, code, checkpoints))
        self.size += n
        self.n_docs += not more
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        doc_ids, sizes, more, codes, checkpoints = zip(*self.rows, strict=True)
        self.directory.append((self.offset, self.n_ids))
        flags = bytes(_NULL * (d is None) + _MORE * m for d, m in zip(doc_ids, more, strict=True))
        data, marks = b"".join(codes), b"".join(checkpoints)
        ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + np.array([len(c) for c in codes], "<u4").tobytes()
        self.write(_BLOCK_HEAD.pack(self.size, len(sizes), len(marks) // 4, len(data), zlib.crc32(data)) + ids + flags + marks + data)
        self.n_ids += self.size
        self.rows, self.size = [], 0

    def close(self) -> None:
        self.flush()
        directory = np.array(self.directory, "<u8").tobytes()
        self.write(directory + _TAIL.pack(self.n_ids, self.n_docs, len(self.directory), MAGIC))
        self.out.close()


_CODED = "doc_id long, n long, crc long, rid long, piece long, ids long, more boolean, code binary, checkpoints binary"


def write_ids(docs: DataFrame, tokenizer: str | None = None) -> Store:
    """Write the ids of all documents, in ascending order of doc_id, into a new folder."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()
    tokens = token_table(docs, tokenizer)
    vocabulary = len(encoder(tokenizer).last)
    lengths = code_lengths(id_counts(tokens, vocabulary))
    folder = new_path(spark, "ids")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(lengths)
        kinds = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "crc", "rid", "piece", "ids")), ("more", pa.bool_()), ("code", pa.binary()), ("checkpoints", pa.binary())])
        held: list[tuple] = []

        def coded() -> pa.RecordBatch:
            arrays = [x for *_, x in held]
            data, offsets, checkpoints, bounds = own.packed(np.concatenate(arrays), np.concatenate([[0], np.cumsum([len(x) for x in arrays])]))
            codes = [data[p:q] for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            marks = [checkpoints[p:q].tobytes() for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = [*zip(*(r[:-1] for r in held), strict=True), codes, marks]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds)

        for b in batches:
            size = 0
            for doc_id, n, crc, rid, raw in zip(*(b[c].to_pylist() for c in ("doc_id", "n", "crc", "rid")), b["ids"], strict=True):
                ids = np.frombuffer(raw.as_buffer(), _width(vocabulary))
                for k, at in enumerate(range(0, len(ids), BLOCK)):
                    part = ids[at : at + BLOCK]
                    held.append((doc_id, n, crc, rid, k, len(part), at + BLOCK < len(ids), part))
                    size += len(part)
                    if size > 1 << 18:
                        yield coded()
                        size = 0
            if held:
                yield coded()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, f"{_attempt('ids')}.huf"
        for b in batches:
            out = out or _Writer(folder, name, lengths)
            for row in zip(*(b[c].to_pylist() for c in ("doc_id", "ids", "more", "code", "checkpoints")), strict=True):
                out.add(*row)
        if out:
            out.close()
            row = [TaskContext.get().partitionId()], [name], [out.n_ids], [out.n_docs]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], names=["part", "file", "n_ids", "n_docs"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "n", "crc", "rid"]
    # The range's edges are found on the token table's small columns before texts' codes are made, and codes follow their rows.
    coded = tokens.transform(mapped, code, _CODED)
    ranged = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order, "piece").select("doc_id", "ids", "more", "code", "checkpoints")
    rows = sorted(ranged.transform(mapped, write, "part int, file string, n_ids long, n_docs long").collect())  # a row a task
    firsts = accumulate((r["n_ids"] for r in rows), initial=0)
    return Store(folder, [(r["file"], first, r["n_ids"], r["n_docs"]) for r, first in zip(rows, firsts)])  # noqa: B905


class Reader:
    """Reads one file: its code and directory at once, blocks by range reads."""

    def __init__(self, folder: str, name: str):
        system, path = _files(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        end = self.file.size()
        self.n_ids, self.n_docs, n, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, end - _TAIL.size))
        head = self.file.read_at(len(MAGIC) + 8, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a file of ids: {name}")
        start = end - _TAIL.size - 16 * n
        self.offsets, self.firsts = np.frombuffer(self.file.read_at(16 * n, start), "<u8").reshape(n, 2).astype(np.int64).T
        self.ends = np.append(self.offsets[1:], start)
        size, raw = struct.unpack("<II", head[len(MAGIC) :])
        self.decoder = Decoder(np.frombuffer(zlib.decompress(self.file.read_at(raw, len(MAGIC) + 8)), np.uint8))

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(doc_ids, flags, codes, sizes of pieces, bit offsets and sizes of segments) of a block."""
        raw = self.file.read_at(int(self.ends[k] - self.offsets[k]), int(self.offsets[k]))
        _, n, marks, data, checksum = _BLOCK_HEAD.unpack_from(raw)
        at = list(accumulate((8 * n, 4 * n, 4 * n, n, 4 * marks, data), initial=_BLOCK_HEAD.size))
        doc_ids, sizes, lengths, flags, checkpoints = (np.frombuffer(raw[p:q], kind).astype(np.int64) for p, q, kind in zip(at, at[1:], ("<i8", "<u4", "<u4", "u1", "<u4")))  # noqa: B905
        codes = raw[at[5] : at[6]]
        if zlib.crc32(codes) != checksum:
            raise ValueError(f"damaged block {k}")
        segments = -(-sizes // SEGMENT)
        places = checkpoints + np.repeat(8 * (np.cumsum(lengths) - lengths), segments)
        each = np.full(marks, SEGMENT, np.int64)
        each[np.cumsum(segments) - 1] = sizes - SEGMENT * (segments - 1)
        return doc_ids, flags, codes, sizes, places, each

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of places first to last (exclusive) of this file; decoding begins at the checkpoint before first."""
        found = [np.zeros(0, np.uint32)]
        k = int(np.searchsorted(self.firsts, first, "right")) - 1
        while 0 <= k < len(self.firsts) and self.firsts[k] < last:
            _, _, codes, _, places, each = self.block(k)
            starts = self.firsts[k] + np.cumsum(each) - each
            some = (starts < last) & (starts + each > first)
            ids = self.decoder.decoded(codes, places[some], each[some])
            begin = int(starts[some][0])
            found.append(ids[max(0, first - begin) : last - begin])
            k += 1
        return np.concatenate(found)


def read_range(store: Store, first: int, last: int) -> np.ndarray:
    """The ids of places first to last (exclusive) of the whole corpus."""
    parts = [Reader(store.folder, name).ids(max(0, first - base), min(n, last - base)) for name, base, n, _ in store.files if base < last and base + n > first]
    return np.concatenate([np.zeros(0, np.uint32), *parts])


_PIECES = "doc_id long, start long, offset long, ids binary, more boolean"


def read_ids(spark: SparkSession, store: Store) -> DataFrame:
    """(doc_id, start, offset, ids, more): all documents' ids in order, little-endian in four bytes, a row a piece.

    start: ids of all documents before it; offset: of the document before the piece; more: its ids go on in the next row.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("more", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b["file"].to_pylist(), b["first"].to_pylist(), strict=True):
                reader, offset = Reader(store.folder, name), 0
                for k in range(len(reader.offsets)):
                    doc_ids, flags, codes, sizes, places, each = reader.block(k)
                    ids = reader.decoder.decoded(codes, places, each).astype("<u4")
                    rows, at = [], 0
                    for doc_id, flag, size in zip(doc_ids.tolist(), flags.tolist(), sizes.tolist(), strict=True):
                        rows.append((None if flag & _NULL else doc_id, start, offset, ids[at : at + size].tobytes(), bool(flag & _MORE)))
                        at += size
                        offset += size
                        if not flag & _MORE:
                            start, offset = start + offset, 0
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    files = spark.createDataFrame([(k, name, first) for k, (name, first, _, _) in enumerate(store.files)], "k long, file string, first long")
    return files.repartition(max(1, len(store.files)), "k").select("file", "first").transform(mapped, read, _PIECES)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    crc = n = 0
    for b in batches:
        found = []
        for doc_id, start, raw, more in zip(b["doc_id"].to_pylist(), b["start"].to_pylist(), b["ids"], b["more"].to_pylist(), strict=True):
            crc, n = zlib.crc32(raw.as_buffer(), crc), n + raw.as_buffer().size // 4
            if not more:
                found.append((doc_id, start, n, crc))
                crc = n = 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def document_digests(pieces: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_ids() rows, whose pieces of a document are in one partition and in order."""
    return pieces.transform(mapped, _digested, "doc_id long, start long, n_tokens long, ids_crc32 long")
