"""WARC archives with a two-level capture index.

write_archives() writes one gzip member per page into WARC files of the shared folder, one file a task. Of pages with
equal payloads of at least `least_bytes`, the one with the largest id is a response record and the others are revisit
records that name it; smaller payloads are always responses. Captures are then sorted by key (reversed host, path and
query) into compressed blocks of BLOCK lines. Each sorting task also writes its sparse directory, a file with an entry a
block (first key, block file, offset, length) and, at its end, the entries' offsets. The driver keeps a line a task.

A search is binary at both levels: over the tasks' first keys in memory, then over a directory's entries by range reads of
an offset and an entry; it then reads the block's byte range and the records' byte ranges. lookup() finds the captures of a
table of urls: their keys are sorted, and a task searches for a key only where it lies beyond the block it stands on. A key
with very many captures names many blocks, which are read by as many tasks as there are. read_captures() is the lookup of
all urls of a table, and archived() reads its archives back by it.

Null html is an empty payload; a null url has an empty key and no target line. A page without an id is a revisit if
its payload has another page's, else a response. Rows that repeat are written and come back each; rows that repeat
the largest id are responses each. Files carry the task's attempt in their names, and only files of attempts whose
rows reached the index are ever read, so lost executors leave nothing wrong behind. Other columns play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, batched, groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordframe.llm.common import mapped, new_path, written

BLOCK, LEVEL = 500, 4
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_SHARD_SQL = "part int, first_key string, file string, entries long, offsets long"
_CAPTURE_SQL = "key string, page_id long, file string, offset long, length long"
_PAGE_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


@dataclass(frozen=True)
class Shard:
    """The directory of one sorting task: its file, number of entries, where their offsets begin, and the first key."""

    first_key: str
    file: str
    entries: int
    offsets: int


@dataclass(frozen=True)
class Archive:
    """folder: where the files are; shards: the tasks' directories in the order of their keys."""

    folder: str
    shards: list[Shard]


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder)) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)


def capture_key(url: str | None) -> str:
    """Reversed host, ")", then path and query: "http://a.b.org/x?y" gives "org,b,a)/x?y"; blanks and controls as %XX."""
    m = re.match(r"(?s).*?://(?:[^/?#]*@)?([^/?#]*)([^#]*)", url or "")
    return _one_line(f"{','.join(reversed(m[1].lower().split('.')))}){m[2] or '/'}" if m else (url or ""))


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed record. A revisit holds the HTTP header alone; its Content-Length is the full payload's."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parsed(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record's bytes."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(n) if (n := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    if fields["WARC-Type"] == "response" and (len(payload) != size or _base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], number("WARC-Refers-To"), payload if fields["WARC-Type"] == "response" else None


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _attempt(name: str) -> str:
    task = TaskContext.get()
    return f"{name}-{task.partitionId():06d}-{task.taskAttemptId()}"


def write_archives(pages: DataFrame, least_bytes: int = 0) -> Archive:
    """Write records of all pages and their capture index into a new folder."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    repeats = pages.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    joined = pages.join(written(repeats, "repeats"), "digest", "left")
    refers = F.when(F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))), F.col("last"))
    rows = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        system.create_dir(path, recursive=True)
        out, name, offset = None, f"{_attempt('pages')}.warc.gz", 0
        for b in batches:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            found = []
            for page_id, url, html, digest, refers_to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                raw = record(page_id, url, html.encode(), _base32(bytes.fromhex(digest)), refers_to)
                out.write(raw)
                found.append((capture_key(url), page_id, name, offset, len(raw)))
                offset += len(raw)
            yield _batch(found, _CAPTURE_SQL)
        if out:
            out.close()

    captures = written(rows.transform(mapped, write, _CAPTURE_SQL), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        out, name, offset, entries = None, f"{_attempt('index')}.gz", 0, []
        for b in batches:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            lines = list(zip(*(b[c].to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True))
            for at in range(0, len(lines), BLOCK):
                part = lines[at : at + BLOCK]
                raw = gzip.compress("\n".join(f"{k}\t{'' if p is None else p}\t{f}\t{o}\t{n}" for k, p, f, o, n in part).encode(), LEVEL, mtime=0)
                out.write(raw)
                entries.append((part[0][0], f"{part[0][0]}\t{name}\t{offset}\t{len(raw)}".encode()))
                offset += len(raw)
        if out:
            out.close()
            name = f"{_attempt('directory')}.bin"
            ends = list(accumulate((len(e) for _, e in entries), initial=0))
            with system.open_output_stream(f"{path}/{name}", compression=None) as directory:
                for _, e in entries:
                    directory.write(e)
                directory.write(b"".join(e.to_bytes(8, "little") for e in ends))
            yield _batch([(TaskContext.get().partitionId(), entries[0][0], name, len(entries), ends[-1])], _SHARD_SQL)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    rows = ordered.transform(mapped, index, _SHARD_SQL).collect()  # a row a task
    return Archive(folder, [Shard(*r[1:]) for r in sorted(map(tuple, rows))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Ranges:
    """Byte ranges of a folder's files; a few files stay open. reads counts them."""

    def __init__(self, folder: str, most: int = 64):
        (self.system, self.path), self.open, self.most, self.reads = _files(folder), {}, most, 0

    def read(self, name: str, offset: int, length: int) -> bytes:
        self.reads += 1
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.system.open_input_file(f"{self.path}/{name}")
        return self.open[name].read_at(length, offset)


class Directory:
    """The blocks of an archive in the order of their keys, numbered through all shards, read an entry at a time."""

    def __init__(self, archive: Archive, ranges: Ranges):
        self.shards, self.ranges = archive.shards, ranges
        self.bases = list(accumulate((s.entries for s in archive.shards), initial=0))
        self.first_keys = [s.first_key for s in archive.shards]

    def __len__(self) -> int:
        return self.bases[-1]

    def entry(self, block: int) -> tuple[str, str, int, int]:
        """(first key, file, offset, length) of a block."""
        k = bisect_right(self.bases, block) - 1
        shard, at = self.shards[k], block - self.bases[k]
        a, b = (int.from_bytes(x, "little") for x in batched(self.ranges.read(shard.file, shard.offsets + 8 * at, 16), 8))
        key, file, offset, length = self.ranges.read(shard.file, a, b - a).decode().rsplit("\t", 3)
        return key, file, int(offset), int(length)

    def place(self, key: str) -> int:
        """The last block whose first key is below the key, or 0: no block before it has the key."""
        k = max(0, bisect_left(self.first_keys, key) - 1)
        if k == len(self.shards) or self.first_keys[k] >= key:
            return 0
        low, high = self.bases[k], self.bases[k + 1]  # entry(low) is below the key, entry(high), if any, is not
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.entry(middle)[0] < key else (low, middle)
        return low

    def blocks(self, keys: Iterator[str]) -> Iterator[tuple[str, tuple[str, str, int, int]]]:
        """(key, entry) of every block that may have a key; keys come in order."""
        at, now, following = 0, None, None
        for key in keys:
            if not len(self):
                return
            if now is not None and following is not None and following[0] < key:  # the next block, if the key is not beyond it
                at, now = at + 1, following
                following = self.entry(at + 1) if at + 1 < len(self) else None
            if now is None or (following is not None and following[0] < key):
                at = self.place(key)
                now, following = self.entry(at), self.entry(at + 1) if at + 1 < len(self) else None
            yield key, now
            step, more = at + 1, following
            while more is not None and more[0] <= key:
                yield key, more
                step += 1
                more = self.entry(step) if step < len(self) else None


def captures_in(ranges: Ranges, name: str, offset: int, length: int) -> Iterator[tuple[str, str, int, int]]:
    """(key, file, offset, length) of a block's captures."""
    for line in gzip.decompress(ranges.read(name, offset, length)).decode().split("\n"):
        key, _, file, at, size = line.rsplit("\t", 4)
        yield key, file, int(at), int(size)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([(capture_key(u),) for u in b["url"].to_pylist()], "key string")


def lookup(archive: Archive, urls: DataFrame, payloads: bool = True) -> DataFrame:
    """(key, page_id, url, ...): the records of every url in urls (a column url; null stands for pages without one), each once."""
    spark, folder = urls.sparkSession, archive.folder
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = urls.select("url").distinct().transform(mapped, _keys, "key string").distinct()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(archive, Ranges(folder))
        found = directory.blocks(key for b in batches for key in b["key"].to_pylist())
        for some in batched(found, 10_000):
            yield _batch([(key, *entry[1:]) for key, entry in some], "key string, file string, offset long, length long")

    blocks = keys.repartitionByRange(parts, "key").sortWithinPartitions("key").transform(mapped, search, "key string, file string, offset long, length long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block come together; it is read once."""
        ranges = Ranges(folder)
        rows = ((block, key) for b in batches for *block, key in zip(*(b[c].to_pylist() for c in ("file", "offset", "length", "key")), strict=True))
        for block, group in groupby(rows, key=lambda r: r[0]):
            wanted = {key for _, key in group}
            places = sorted(c[1:] + c[:1] for c in captures_in(ranges, *block) if c[0] in wanted)
            for some in batched(places, BLOCK):
                records = [(place[3], *parsed(ranges.read(*place[:3]))) for place in some]
                yield _batch([r if payloads else (*r[:7], None) for r in records], f"key string, {_PAGE_SQL}")

    by_block = blocks.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return by_block.transform(mapped, read, f"key string, {_PAGE_SQL}")


def read_captures(archive: Archive, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all urls of pages, found by way of the index; without payloads if not wanted."""
    return lookup(archive, pages, payloads).drop("key")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages, read them back by their urls through the index, and return their digests."""
    return read_captures(write_archives(pages, least_bytes), pages, payloads=False).drop("payload", "url")
