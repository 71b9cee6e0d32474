import heapq
import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fjordframe.llm import huffman
from fjordframe.llm.huffman import Code, Decoder, code_lengths, document_digests, read_ids, read_range, write_ids
from fjordframe.llm.tokens import default_path
from tests.llm.cases import SCHEMA, documents, with_clashes


def expected(rows):
    """(doc_id, ids) in order, by the tokenizer itself."""
    t = Tokenizer.from_file(default_path())
    found = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]
    return sorted(((d, np.array(i, "<u4")) for d, i in found), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(r[1])))


@pytest.mark.parametrize("block", [huffman.BLOCK, 300])
def test_round_trip_through_the_files(spark, monkeypatch, block):
    """Also with blocks that long documents go through."""
    monkeypatch.setattr(huffman, "BLOCK", block)
    rows = documents(120)
    store = write_ids(with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3))
    want, start, lines = expected(rows), 0, []
    for doc_id, ids in want:
        lines.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    got = [tuple(r) for r in document_digests(read_ids(spark, store)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == lines
    pieces = sorted(read_ids(spark, store).collect(), key=lambda r: r["start"] + r["offset"])
    everything = np.concatenate([i for _, i in want])
    assert np.array_equal(np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4"), everything)
    assert len(store.files) > 1 and sum(n for *_, n, _ in store.files) == len(everything) and sum(n for *_, n in store.files) == len(rows)
    rng = random.Random(1)
    for _ in range(60):
        a, b = sorted(rng.randrange(len(everything) + 1) for _ in range(2))
        assert np.array_equal(read_range(store, a, b), everything[a:b])
    assert len(read_range(store, 5, 5)) == 0


def test_ranges_decode_no_more_than_a_segment_ahead(spark, monkeypatch):
    store = write_ids(spark.createDataFrame(documents(40), SCHEMA).coalesce(1))
    decoded = []
    own = Decoder.decoded
    monkeypatch.setattr(Decoder, "decoded", lambda self, data, places, sizes: decoded.append(int(sizes.sum())) or own(self, data, places, sizes))
    total = sum(n for *_, n, _ in store.files)
    for at in range(0, total - 10, total // 20):
        decoded.clear()
        assert len(read_range(store, at, at + 10)) == 10
        assert sum(decoded) <= 10 + 2 * huffman.SEGMENT


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    return cost


def limited_cost(counts, limit):
    """The least cost of all length assignments that satisfy Kraft's inequality, tried one by one."""
    used = [c for c in counts if c]
    return min(sum(c * n for c, n in zip(used, sizes, strict=True)) for sizes in itertools.product(range(1, limit + 1), repeat=len(used)) if sum(2.0**-n for n in sizes) <= 1)


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 300):
        for counts in (rng.integers(0, 50, n), (1.5 ** rng.integers(0, 40, n)).astype(np.int64), np.ones(n, np.int64)):
            lengths = code_lengths(counts, 60)
            assert ((lengths > 0) == (counts > 0)).all() and int((counts * lengths).sum()) == (huffman_cost(counts) if counts.any() else 0)
    for _ in range(30):
        counts = (2.0 ** rng.integers(0, 12, 5)).astype(np.int64)
        lengths = code_lengths(counts, 3)
        assert lengths.max() <= 3 and int((counts * lengths).sum()) == limited_cost(counts.tolist(), 3)
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = code_lengths(np.array(fibonacci))
    assert lengths.max() == huffman.LIMIT and np.isclose((2.0 ** -lengths.astype(float)).sum(), 1)


def test_codes_are_canonical_and_decode():
    rng = np.random.default_rng(5)
    counts = (1.4 ** rng.integers(0, 50, 2000)).astype(np.int64)
    lengths = code_lengths(counts)
    code = Code(lengths)
    order = sorted(np.flatnonzero(lengths).tolist(), key=lambda i: (lengths[i], i))
    words = [f"{int(code.codes[i]):0{lengths[i]}b}" for i in order]
    assert words == sorted(words) and all(not b.startswith(a) for a, b in zip(words, words[1:]))  # noqa: B905
    sizes = rng.integers(1, 700, 40)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.choice(np.flatnonzero(counts), bounds[-1])
    data, offsets, checkpoints, check_bounds = code.packed(ids, bounds)
    bits = "".join(f"{b:08b}" for b in data)
    for k in range(40):
        own = "".join(f"{int(code.codes[i]):0{lengths[i]}b}" for i in ids[bounds[k] : bounds[k + 1]])
        assert bits[8 * offsets[k] : 8 * offsets[k] + len(own)] == own
        assert checkpoints[check_bounds[k] : check_bounds[k + 1]].tolist() == [int(lengths[ids[bounds[k] : bounds[k] + j]].sum()) for j in range(0, int(sizes[k]), huffman.SEGMENT)]
    whole, _, _, _ = code.packed(ids, np.array([0, len(ids)]))
    assert np.array_equal(Decoder(lengths).decoded(whole, np.array([0]), np.array([len(ids)])), ids)


def test_damage_is_found(spark):
    store = write_ids(spark.createDataFrame(documents(10), SCHEMA).coalesce(1))
    path = f"{store.folder.removeprefix('file:')}/{store.files[0][0]}"
    raw = bytearray(open(path, "rb").read())
    reader = huffman.Reader(store.folder, store.files[0][0])
    raw[int(reader.ends[0]) - 1] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged block 0"):
        read_range(store, 0, 5)


def test_empty_table_and_one_kind_of_id(spark):
    empty = write_ids(spark.createDataFrame([], SCHEMA))
    assert empty.files == [] and document_digests(read_ids(spark, empty)).collect() == [] and len(read_range(empty, 0, 9)) == 0
    store = write_ids(spark.createDataFrame([(1, None), (1, ""), (None, None)], "doc_id long, text string"))
    rows = [tuple(r) for r in document_digests(read_ids(spark, store)).orderBy("start").collect()]
    assert rows == [(None, 0, 1, zlib.crc32(b"\1\0\0\0")), (1, 1, 1, zlib.crc32(b"\1\0\0\0")), (1, 2, 1, zlib.crc32(b"\1\0\0\0"))]
