"""Near-duplicate groups: one-permutation MinHash with optimal densification, banding and star-shaped candidates.

A document's set holds its distinct 5-word shingles (of fewer words: the whole sequence). One hash per shingle falls
into one of BANDS * ROWS bins and each bin keeps its minimum; empty bins take the value of a bin chosen by a hash
sequence that all documents share (optimal densification). A band of ROWS bins is a bucket key: sets of similarity
0.75 meet in one of 48 buckets with a probability over 0.9999.

A node of the link graph is a set, known by a 128-bit BLAKE2b digest of all its shingle hashes; documents of equal sets
are one node from the start, and two texts under one id are two. A bucket sends one edge per member to its centre, the member
of least digest hash, so pair counts stay linear in members; each edge is confirmed on the full sets, which hold all
shingle hashes. Buckets of more than PART members that still hold several components send up to STARS - 1 more stars, from
other centres, which joins most of a large group at a cost that is linear too. Buckets that then still hold several
components are settled one by one: members are tested against those of other components, the smallest component first,
until a link joins it or none is left to test. A bucket of more than PART members is cut into parts for this, and every
two parts are settled by a task of their own, so that no task holds more than about 2 * PART sets. No link inside a
bucket is lost, and no bucket is capped.

Null or wordless texts have empty sets, link with nothing and are kept. A null id is no node: such rows come back
unlinked, with a null component_id, and kept. Every row is judged by its own text: rows that repeat an id with another text
may lie in another component; rows that repeat both come back each, alike. deduplicated() leaves one row of each component.
Other columns, of any name, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.llm.common import mapped, written
from fjordframe.llm.components import components
from fjordframe.llm.textbytes import NOT_BLANK, cut, mixed, pieces, windows

SHINGLE, BANDS, ROWS = 5, 48, 6
BINS = BANDS * ROWS
PERCENT = 75
#: Members of a bucket that one part takes.
PART = 1000
#: Stars that a large bucket sends at most before it is settled.
STARS = 4
#: Nodes that hold more than this share of all rows are joined apart.
HOT = 1000


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts in a row, and the offsets of each text's."""
    words = cut(texts, NOT_BLANK)
    hashes, counts = words.hashes(), words.counts
    grams = windows(hashes, SHINGLE)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for r, (a, n) in enumerate(zip(words.first[:-1], counts, strict=True)):
        if n:
            own = np.unique(grams[a : a + n - SHINGLE + 1]) if n >= SHINGLE else windows(hashes[a : a + n], int(n))
            parts.append(own)
            sizes[r] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _bin_of(values: np.ndarray) -> np.ndarray:
    return (((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)


def band_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS keys for each non-empty set; values are sorted inside a set, so a bin's minimum comes first."""
    sizes = np.diff(bounds)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    cell = rows * BINS + _bin_of(values)
    head = np.ones(len(cell), bool)
    head[1:] = cell[1:] != cell[:-1]
    grid = np.zeros(len(sizes) * BINS, np.uint64)
    full = np.zeros(len(sizes) * BINS, bool)
    grid[cell[head]], full[cell[head]] = values[head], True
    todo = np.flatnonzero(~full & np.repeat(sizes > 0, BINS))
    own = full.copy()
    attempt = 0
    while len(todo):
        attempt += 1
        donors = (mixed(np.arange(BINS, dtype=np.uint64) + np.uint64(attempt << 20)) % np.uint64(BINS)).astype(np.int64)
        source = todo - todo % BINS + donors[todo % BINS]
        found = own[source]
        grid[todo[found]] = grid[source[found]]
        todo = todo[~found]
    keys = grid.reshape(len(sizes), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sizes), BANDS)).copy()
    for j in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, j])
    return out


def _digests(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A digest of each set, null for an empty one."""
    raw = values.astype("<u8").tobytes()
    return pa.array([hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, "text"):
            values, bounds = shingle_sets(b["text"])
            sizes = np.diff(bounds)
            keys = band_keys(values, bounds).astype("<u8")
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * BANDS), len(sizes), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["sign"], pa.array(sizes), _digests(values, bounds), blob], names=["doc_id", "sign", "n_shingles", "node", "keys"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.frombuffer(b["keys"].cast(pa.large_binary()).buffers()[2] or b"", np.int64)[: b.num_rows * BANDS] if b.num_rows else np.zeros(0, np.int64)
        for at in range(0, b.num_rows, 1024):
            c = b.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at * BANDS : (at + c.num_rows) * BANDS]), pa.array(np.repeat(c["id"].to_numpy(), BANDS)), pa.array(np.repeat(c["n_shingles"].to_numpy(), BANDS))], names=["bucket", "id", "n"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, "text"):
            values, bounds = shingle_sets(b["text"])
            raw = values.astype("<u8")
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([raw[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "grams"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets share PERCENT of their union."""
    for b in batches:
        keep = []
        for x, y in zip(b["ga"], b["gb"], strict=True):
            keep.append(_linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")))
        yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(keep, pa.bool_())), b["b"].filter(pa.array(keep, pa.bool_()))], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= PERCENT * (len(both) - shared)


def joined(labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (label, label) that join components of one group of sets; every pair that could is tested or joined."""
    groups: dict[int, list[int]] = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, []).append(i)
    links = []
    while len(groups) > 1:
        least = min(groups, key=lambda g: (len(groups[g]), g))
        own = groups.pop(least)
        other = next((g for x in own for g, members in sorted(groups.items(), key=lambda g: -len(g[1])) for y in members if _linked(sets[x], sets[y])), None)
        if other is not None:
            groups[other] += own
            links.append((least, other))
    return links


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each group of rows; groups are (bucket, p, q) in a row."""
    key, labels, sets = None, [], []

    def settled() -> pa.RecordBatch:
        links = joined(labels, sets)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    for b in batches:
        keys = zip(*(b[c].to_pylist() for c in ("bucket", "p", "q")), strict=True)
        for k, label, grams in zip(keys, b["component"].to_pylist(), b["grams"], strict=True):
            if k != key:
                yield settled()
                key, labels, sets = k, [], []
            labels.append(label)
            sets.append(np.frombuffer(grams.as_py(), "<u8"))
    yield settled()


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, sign, n_shingles, component_id, group) of every row; sign is a digest of the text, group a key of the component."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("sign"))
    sketches = written(docs.transform(mapped, _sketch, "doc_id long, sign string, n_shingles long, node binary, keys binary"), "sketches")
    nodes = sketches.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "sign")).alias("first"), F.count("*").alias("rows"))
    # Numbered and written once, so that a node keeps its number.
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "node", "rows", "first.doc_id", "first.sign"), "nodes")
    # By id and text, not by node, as a third of all documents may be one node.
    heads = sketches.join(nodes.select("id", "doc_id", "sign"), ["doc_id", "sign"]).dropDuplicates(["id"])
    rows = heads.select("id", "n_shingles", "keys").transform(mapped, _unpack, "bucket long, id long, n long")
    # A node's place in the order of centres is the hash of its number, the same in every bucket, so that the stars of one group share a centre.
    place = F.struct(F.xxhash64("id").alias("h"), F.col("id"), F.col("n"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(place).alias("c")).where("size > 1")
    members = written(rows.join(full, "bucket").select("bucket", "size", "id", "n", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n")), "members")

    def fits(x: str, y: str):
        return F.expr(f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})")

    pairs = members.where("id <> centre").where(fits("n", "centre_n")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    met = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "sign")
    texts = docs.join(met, ["doc_id", "sign"]).select("id", "text")
    sets = written(texts.transform(mapped, _full_sets, "id long, grams binary").dropDuplicates(["id"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
        right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
        return written(pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").transform(mapped, _confirm, "a long, b long"), "links")

    links = confirmed(pairs)
    found = components(links)

    def labelled_members(least: int) -> DataFrame:
        """Members of buckets of more than so many, with their component."""
        rows = members.where(F.col("size") > least).select("bucket", "id", "n").join(found, "id", "left")
        return rows.withColumn("component", F.coalesce("component", "id"))

    large = not members.where(F.col("size") > PART).isEmpty()
    for turn in range(1, STARS):
        if not large:
            break
        rows = labelled_members(PART)
        centre = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id"), F.col("n"), F.col("component"))).alias("c")
        stars = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), centre).where("lo < hi")
        stars = stars.select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.component").alias("joined"))
        open_pairs = rows.join(stars, "bucket").where("component <> joined").where(fits("n", "centre_n"))
        more = confirmed(open_pairs.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = components(links)
    labelled = labelled_members(2).drop("n")
    # Buckets of the same members, which the bands of one group often are, are settled once.
    torn = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum(F.hash("id").cast("long")).alias("s1"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("s2"))
    torn = torn.where("lo < hi").groupBy("size", "s1", "s2").agg(F.min("bucket").alias("bucket"))
    parts = F.ceil(F.col("size") / PART).cast("int")
    rows = labelled.join(torn.select("bucket", parts.alias("parts")), "bucket")
    own = F.pmod(F.hash("id", "bucket"), F.col("parts"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "component").join(sets, "id")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.repartition(width, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").select("bucket", "p", "q", "component", "grams")
    bridges = components(groups.transform(mapped, _settle, "a long, b long")).select(F.col("id").alias("component"), F.col("component").alias("joint"))
    linked = found.join(bridges, "component", "left").select("id", F.coalesce("joint", "component").alias("group"))
    alone = bridges.select(F.col("component").alias("id"), F.col("joint").alias("group")).join(found.select("id"), "id", "left_anti")
    groups = linked.unionByName(alone).join(nodes.select("id", "doc_id"), "id")
    least = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    # A node outside of every group is its own component, of its least id.
    named = nodes.join(groups.select("id", "group").join(least, "group"), "id", "left")
    named = written(named.select("node", "rows", F.coalesce("group", "id").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    out = sketches.select("doc_id", "sign", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    # Nodes of more rows than a HOTth of all, HOT at most, go to every task; only the rows of others are dealt out by node.
    often = nodes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"] / HOT
    hot = named.where(F.col("rows") > often).select("node", F.col("group").alias("_g"), F.col("component_id").alias("_c"))
    met = out.join(F.broadcast(hot), "node", "left")
    few = met.where("_g IS NOT NULL").select("doc_id", "sign", "n_shingles", F.col("_c").alias("component_id"), F.col("_g").alias("group"))
    rest = met.where("_g IS NULL").drop("_g", "_c").join(named.where(F.col("rows") <= often), "node", "left")
    return few.unionByName(rest.select("doc_id", "sign", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links) and kept."""
    return _judged(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each component, and all without an id or without words."""
    judged = _judged(docs).where("group IS NOT NULL")
    chosen = judged.groupBy("group").agg(F.min(F.struct("doc_id", "sign")).alias("m")).select(F.col("m.doc_id").alias("_fjordframe_id"), F.col("m.sign").alias("_fjordframe_sign"))
    alone = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.rlike(F.col("text"), F.lit(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumn("_fjordframe_id", F.col("doc_id").cast("long")).withColumn("_fjordframe_sign", F.md5("text"))
    one = rows.where(~alone).join(chosen, ["_fjordframe_id", "_fjordframe_sign"], "left_semi")
    # The join has dealt rows by id and text already; rows that repeat both come down to one.
    place = F.row_number().over(Window.partitionBy("_fjordframe_id", "_fjordframe_sign").orderBy(F.lit(0)))
    one = one.withColumn("_fjordframe_place", place).where("_fjordframe_place = 1").drop("_fjordframe_id", "_fjordframe_sign", "_fjordframe_place")
    return one.unionByName(docs.where(alone))
