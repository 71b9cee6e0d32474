"""Repair of conversations: the cheapest edits that leave turns of user and assistant in alternation, after a system turn or none.

Rows (conv_id, turn, role, text) stand by turn, null turns first, then by role and the SHA-256 of the text. A row's fault is the
first of: blank (no visible character), duplicate (role and text stood before in the conversation), truncated (its last visible
character ends no sentence). Edits are Keep (0), Rerole to user or assistant (3), Delete (4; blank rows and duplicates must go)
and Insert of an empty turn of user or assistant (3); a truncated row that stays costs 3 more. The roles' initials must then read
`(s?(ua)+)?`. Of the cheapest edits those whose initials, in order, come first in ASCII are taken.

Retained-subsequence DP: a row that is kept or reroled chooses the next such row. Deletions between them are priced by prefix
sums, and the minimum over all later rows is kept up to date for each role as the rows are walked backwards; the pair of roles
says what is inserted. At equal cost more deletions come first (so the later row), then an insertion, then Keep.

Rows are ordered over the whole table in ranges, equal rows of a turn as one row with their number, and each conversation is
cut into chunks of CHUNK rows at most. All chunks are worked on at once: first each gives the least cost for every pair of
roles that stand before and after it; these small tables are carried back through a conversation; then each chunk finds its edits
for every role that may stand before it; and the conversation's rows are read once in order. So only that reading, which hashes
and numbers the rows, is bound to one task a conversation, in constant memory (its edits' initials excepted, which are a value
of the result).

Null roles and texts are one space, which is another role; a null conv_id is a conversation. Equal rows are rows of their own.
Initials are first characters: any role that begins with s, u or a counts as such and stays as it is. Other columns, of any name, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordframe.llm.common import mapped, written

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_NONE, _S, _U, _A = range(4)
_NAMES = {_U: "user", _A: "assistant"}
#: Insertions between a role (or none, or a system turn) and the next one; FORBIDDEN where the next can't follow.
FORBIDDEN = 99
_BETWEEN = np.array([[FORBIDDEN, 0, 0, 1], [FORBIDDEN, FORBIDDEN, 0, 1], [FORBIDDEN, FORBIDDEN, 1, 0], [FORBIDDEN, FORBIDDEN, 0, 1]])
#: Insertions after the last row.
_LAST = np.array([0, 2, 1, 0])
#: A choice is one number: cost, then what breaks ties (distance of the next row from the chunk's end, no insertion, reroled), then its role.
_TIE_BITS, _FAR = 5 + CHUNK_BITS + 1, 1 << 42


def _visible(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn` modulo 20, a null in any of the columns as one space.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 makes the role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.col("_kind"), F.coalesce("text", space)
    hit = rows.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("_kind")).where("_kind <> 0")
    return hit.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_one"),
    ).drop("_one")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows in order, equal rows of a turn as one: (conv_id, turn, role, text, n, blank, first, truncated, at, chunk).

    first: no such role and text at an earlier turn. at numbers the rows in order, with gaps; chunk is unique with conv_id.
    """
    spark = rows.sparkSession
    space = F.lit(" ")
    keys = ["conv_id", "turn", "role", "digest"]
    texts = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    runs = texts.withColumn("digest", F.sha2("text", 256)).groupBy(*keys).agg(F.count("*").alias("n"), F.first("text").alias("text"))
    firsts = runs.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("_f"))
    firsts = firsts.select("conv_id", "role", "digest", F.col("_f.turn").alias("turn"), F.lit(True).alias("_first")).alias("f")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
    # A truncated text's last visible character is no end of a sentence.
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    flagged = runs.alias("r").join(firsts, same, "left").select(
        *(f"r.{c}" for c in keys), "text", "n", (~_visible(F.col("text"))).alias("blank"), F.coalesce("_first", F.lit(False)).alias("first"), (~ends).alias("truncated"),
    )
    order = [F.col(c).asc_nulls_first() for c in keys]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = flagged.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("digest").withColumn("at", F.monotonically_increasing_id())
    return written(placed.withColumn("chunk", F.shiftright("at", CHUNK_BITS)), "turns")


def _chosen(best: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every role before (second axis): the least of the choices of a next row and of none in this chunk, whose cost ends has."""
    out = ends << _TIE_BITS
    for before in range(4):
        for role in (_S, _U, _A):
            if (inserts := int(_BETWEEN[before, role])) != FORBIDDEN:
                choice = best[:, role] + (INSERT * inserts << _TIE_BITS) + (16 if not inserts else 0)
                np.minimum(out[:, before], choice, out=out[:, before])
    return out


def walked_back(codes: np.ndarray, repeats: np.ndarray, ends: np.ndarray, choices: np.ndarray | None = None) -> np.ndarray:
    """The best choice before chunks' first rows, for every role that may stand there (and every set of ends).

    codes (chunks, rows): initial + 4 if the row may stay + 8 if truncated; repeats: copies that must go after each; ends
    (chunks, roles, sets): the cost of all that follows the chunk by the last role. choices (chunks, rows, roles) takes each row's choice.
    """
    rows = codes.shape[1]
    initial, free, cut = codes & 3, codes >> 2 & 1, codes >> 3
    ends = np.minimum(ends + (DELETE * (free + repeats)).sum(axis=1)[:, None, None], _FAR)  # as if all went
    best = np.full(ends.shape, _FAR << _TIE_BITS)
    for j in range(rows - 1, -1, -1):
        following = _chosen(best, ends)
        if choices is not None:
            choices[:, j] = following[:, :, 0] & (1 << _TIE_BITS) - 1
        for role in (_S, _U, _A):
            other = (initial[:, j] != role).astype(np.int64)
            cost = (following[:, role] >> _TIE_BITS) + (REROLE * other + TRUNCATED * cut[:, j] - DELETE)[:, None]
            tie = (rows - j << 5) + 8 * other + role
            may = (free[:, j] == 1) & ((role != _S) | (other == 0))
            best[:, role] = np.where(may[:, None] & (cost < _FAR // 2), np.minimum(best[:, role], (cost << _TIE_BITS) + tie[:, None]), best[:, role])
    return _chosen(best, ends)


def traced(codes: np.ndarray, first: np.ndarray, choices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's edit for every role before the chunk, as its new role (0: deleted) + 4 if a turn is inserted ahead, and the last role."""
    n, rows = codes.shape
    edits, state = np.zeros((n, 4, rows), np.uint8), np.tile(np.arange(4), (n, 1))
    choice = first & (1 << _TIE_BITS) - 1
    for j in range(rows):
        role = choice & 7
        hit = (role > 0) & (rows - (choice >> 5) == j)
        edits[:, :, j] = np.where(hit, role + 4 * (choice >> 4 & 1 ^ 1), 0)
        state = np.where(hit, role, state)
        choice = np.where(hit, np.take_along_axis(choices[:, j], role, axis=1), choice)
    return edits, state


def _padded(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which chunks, their sizes, codes, repeats), chunks of like size together; rows that fill up change nothing."""
    bounds = b["codes"].offsets.to_numpy().astype(np.int64)
    codes, repeats = (b[c].flatten().to_numpy().astype(np.int64) for c in ("codes", "repeats"))
    sizes, base = np.diff(bounds), bounds[0]
    for width in np.unique(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)):
        of_width = np.flatnonzero((sizes <= width) & (sizes > width // 2))
        step = max(1, (1 << 17) // int(width))
        for at in range(0, len(of_width), step):
            some = of_width[at : at + step]
            place = (bounds[some] - base)[:, None] + np.arange(width)
            inside = np.arange(width) < sizes[some][:, None]
            yield some, sizes[some], *(np.where(inside, x[np.where(inside, place, 0)], 0) for x in (codes, repeats))


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prices: the least cost of each chunk for the role before it (four after four) and the role after it."""
    for b in batches:
        prices = np.zeros((b.num_rows, 16), np.int64)
        for some, _, codes, repeats in _padded(b):
            only = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _FAR), (len(some), 4, 4))
            prices[some] = (walked_back(codes, repeats, only) >> _TIE_BITS).reshape(len(some), 16)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * 16), pa.array(prices.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "prices"])


def _carried_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ends: the least cost of all that follows a chunk by the role before that; cost: with the chunk. A conversation's last chunk comes first."""
    now, ends = (), None
    for b in batches:
        found = np.zeros((b.num_rows, 4), np.int64)
        cost = np.zeros(b.num_rows, np.int64)
        prices = b["prices"].flatten().to_numpy().reshape(-1, 4, 4)
        for k, conversation in enumerate(b["conv_id"].to_pylist()):
            if now != (conversation,):
                now, ends = (conversation,), INSERT * _LAST
            found[k] = ends
            ends = np.minimum((prices[k] + ends).min(axis=1), _FAR)
            cost[k] = ends[_NONE]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * 4), pa.array(found.reshape(-1)))
        kept = [c for c in b.schema.names if c != "prices"]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), lists, pa.array(cost)], names=[*kept, "ends", "cost"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """edits: those of a chunk for each role before it, one after the other, and then the four last roles."""
    for b in batches:
        out: list[bytes] = [b""] * b.num_rows
        ends = b["ends"].flatten().to_numpy().reshape(-1, 4)
        for some, sizes, codes, repeats in _padded(b):
            choices = np.zeros((*codes.shape, 4), np.int64)
            first = walked_back(codes, repeats, ends[some][:, :, None], choices)[:, :, 0]
            edits, last = traced(codes, first, choices)
            for k, size, own, role in zip(some.tolist(), sizes.tolist(), edits, last.astype(np.uint8), strict=True):
                out[k] = own[:, :size].tobytes() + role.tobytes()
        yield pa.RecordBatch.from_arrays([b["conv_id"], b["chunk"], b["cost"], pa.array(out, pa.binary())], names=["conv_id", "chunk", "cost", "edits"])


def chunk_edits(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, cost, edits) of every chunk of ordered() rows, the cost that of the chunk and all after it."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    initial = F.substring("role", 1, 1)
    stays = F.col("first") & ~F.col("blank")
    code = F.when(initial == "s", _S).when(initial == "u", _U).when(initial == "a", _A).otherwise(_NONE) + stays.cast("int") * 4 + (stays & F.col("truncated")).cast("int") * 8
    rows = turns.select("conv_id", "chunk", F.struct("at", code.alias("code"), (F.col("n") - stays.cast("long")).alias("repeats")).alias("_r"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("_r")).alias("_r"))  # as many as a chunk has
    chunks = chunks.select("conv_id", "chunk", F.col("_r.code").alias("codes"), F.col("_r.repeats").alias("repeats"))
    kind = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, chunk long"
    arrays = f"{kind}, codes array<int>, repeats array<long>"
    priced = chunks.transform(mapped, _priced, f"{arrays}, prices array<long>")
    back = priced.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).transform(mapped, _carried_back, f"{arrays}, ends array<long>, cost long")
    return back.repartition(parts, "conv_id", "chunk").transform(mapped, _edited, f"{kind}, cost long, edits binary")


class _Reader:
    """Reads one conversation's rows in order, each chunk's edits before its rows."""

    def __init__(self, conversation: object, cost: int):
        self.conversation, self.cost, self.state, self.position, self.pending, self.illegal, self.before = conversation, cost, _NONE, 0, "", 0, None

    def begin(self, edits: bytes) -> None:
        size = (len(edits) - 4) // 4
        self.edits, self.at, self.last = edits[size * self.state : size * (self.state + 1)], 0, edits[4 * size + self.state]

    def inserted(self) -> tuple:
        """The turn that the state asks for next."""
        self.state = _A if self.state == _U else _U
        return self.row(_NAMES[self.state], "", "I")

    def row(self, role: str, text: str, letter: str) -> tuple:
        row = (self.conversation, self.position, role, text, self.pending + letter, None, None)
        self.position, self.pending = self.position + 1, ""
        return row

    def read(self, role: str, text: str, n: int, stays: bool) -> Iterator[tuple]:
        self.illegal += n - 1 + (self.before is not None and self.before + role[:1] not in ("su", "ua", "au"))
        self.before = role[:1]
        edit = self.edits[self.at]
        self.at += 1
        if not edit:
            self.pending += "D" * n
            return
        if edit & 4:
            yield self.inserted()
        new = edit & 3
        kept = role[:1] == "\0sua"[new]
        self.state = new
        yield self.row(role if kept else _NAMES[new], text, "K" if kept else "R")
        self.pending = "D" * (n - stays)

    def end(self) -> Iterator[tuple]:
        for _ in range(int(_LAST[self.state])):
            yield self.inserted()
        yield (self.conversation, None, None, None, self.pending, self.cost, self.illegal)


def _read(batches: Iterator[pa.RecordBatch], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    reader: _Reader | None = None
    found: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds)

    for b in batches:
        for conversation, cost, edits, role, text, n, stays in zip(*(b[c].to_pylist() for c in ("conv_id", "cost", "edits", "role", "text", "n", "stays")), strict=True):
            if edits is not None:
                if reader is None or reader.conversation != conversation:
                    found.extend(reader.end() if reader else ())
                    reader = _Reader(conversation, cost)
                reader.begin(edits)
                continue
            found.extend(reader.read(role, text, n, stays))
            size += len(text) + 100
            if size > 4 << 20:
                if found:
                    yield batch()
                size = 0
    if reader:
        found.extend(reader.end())
        yield batch()


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired rows of ordered() rows: (conv_id, position, role, text, edits, cost, illegal), a conversation's in one partition and in order.

    edits: initials of the edits since the row before, its own last. A row without a position ends each conversation: with the
    edits after its last row, the cost of all, and the number of neighbours in the input whose initials are not su, ua or au.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = chunk_edits(turns).selectExpr("conv_id", "chunk", "-1L AS at", "cost", "edits", "CAST(NULL AS STRING) AS role", "CAST(NULL AS STRING) AS text", "0L AS n", "false AS stays")
    rows = turns.selectExpr("conv_id", "chunk", "at", "0L AS cost", "CAST(NULL AS BINARY) AS edits", "role", "text", "n", "first AND NOT blank AS stays")
    both = heads.unionByName(rows).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "chunk", "at")
    kind = turns.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, position long, role string, text string, edits string, cost long, illegal long"
    fields = [("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edits", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _read(batches, pa.schema([("conv_id", to_arrow_type(kind)), *fields]))

    return both.transform(mapped, read, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, audit = hashlib.sha256(), []
    for b in batches:
        found = []
        for conversation, position, role, text, edits, cost, illegal in zip(*(c.to_pylist() for c in b.columns), strict=True):
            audit.append(edits)
            if position is not None:
                digest.update(f"{'\n' if position else ''}{role}:{text}".encode())
                continue
            found.append((conversation, illegal, cost, "".join(audit), digest.hexdigest()))
            digest, audit = hashlib.sha256(), []
        if found:
            ids, *rest = zip(*found, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("conv_id").type), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], names=["conv_id", "illegal", "cost", "audit", "repaired_sha256"])


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of rows.

    gaps: turns that lack between the least and the greatest; audit: the edits' initials; repaired_sha256: that of the
    repaired rows as `role:text`, parted by newlines. A conversation without rows has zeros and empty texts.
    """
    turns = ordered(rows)
    kind = turns.schema["conv_id"].dataType.simpleString()
    hashed = repaired(turns).transform(mapped, _hashed, f"conv_id {kind}, illegal long, cost long, audit string, repaired_sha256 string").alias("h")
    n, zero = F.col("n"), F.lit(0)
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), zero).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(n - F.col("first").cast("long"))).alias("duplicate"),
        F.sum((~F.col("blank") & F.col("first") & F.col("truncated")).cast("long")).alias("truncated"),
    ).alias("c")
    ids = conversations.select("conv_id").distinct().alias("i")
    joined = ids.join(counts, F.col("i.conv_id").eqNullSafe(F.col("c.conv_id")), "left").join(hashed, F.col("i.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    longs = [F.coalesce(c, zero).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("i.conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
