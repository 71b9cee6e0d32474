import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fjordframe.llm.lengths import length_histogram, length_quantiles, truncated_total
from fjordframe.llm import packing
from fjordframe.llm.packing import Index, filled, packed, piece_digests, powers_of_two
from fjordframe.llm.textbytes import Words
from fjordframe.llm.tokens import WordEncoder, default_path
from tests.llm.cases import SCHEMA, documents, thue_morse, with_clashes

ODD = ["it's we'll they've 'snow '' 's's x²3½ ÀÉÎ×÷ Ÿ İ Σας a<|b", "\x1c a\x85b\xa0c \x00 '", "don't!!'s ''s I'M 'RE 'll'", "1234 5a6 _x_ a_b ªº µ ß ¼ ©", "", None, "e\u0301", "'", "it'"]


def exact(texts):
    t = Tokenizer.from_file(default_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_tokenizers_own():
    texts = [r[1] for r in documents()] + ODD
    ids, bounds = WordEncoder(default_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == exact(texts)


def test_ids_of_long_alike_words():
    """Words that a polynomial hash takes for one, in one batch and in two, and words over the length that hashes in steps."""
    own = WordEncoder(default_path())
    for n in (64, 256, 1024, 4096):
        a, b = thue_morse(n)
        for texts in ([a + " " + b, b], [b], [a + b + " x " + a]):
            ids, bounds = own.encode(pa.array(texts))
            assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == exact(texts)


def test_words_of_equal_hashes_keep_their_own_ids(monkeypatch):
    texts = [r[1] for r in documents(20)] + ODD
    monkeypatch.setattr(Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    ids, bounds = WordEncoder(default_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == exact(texts)


def test_packing_round_trip(spark):
    docs = documents(300)
    df = with_clashes(spark.createDataFrame(docs, SCHEMA)).repartition(3)
    rows = packed(df).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert len(r["tokens"]) == 4 * r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["tokens"])))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert sum(n == 2048 for n in (sum(x[1] for x in p) for p in by_sequence.values())) >= 9
    want = {}
    for (doc_id, *_), ids in zip(docs, exact([r[1] for r in docs]), strict=True):
        raw = b"".join(i.to_bytes(4, "little") for i in [*ids, 1])
        want.setdefault((doc_id, len(ids) + 1), []).append(raw)
    assert {k: sorted(v) for k, v in want.items() if len(v) == 1} == {k: [b"".join(p for _, p in sorted(v))] for k, v in by_doc.items() if len(want[k]) == 1}
    assert all(sum(len(p) for _, p in by_doc[k]) == sum(map(len, v)) for k, v in want.items())
    crc = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in piece_digests(packed(df.coalesce(1))).collect()}
    assert len(crc) > 0 and all(0 <= c < 1 << 32 for c in crc.values())
    assert zlib.crc32(bytes(rows[0]["tokens"])) == next(r["ids_crc32"] for r in piece_digests(spark.createDataFrame(rows, packed(df).schema)).collect() if (r["sequence_id"], r["offset"]) == (rows[0]["sequence_id"], rows[0]["offset"]))


def bm25(docs, seed, terms):
    """Scores of all documents for the seed's heaviest terms, by plain sums."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = collections.Counter(t for d in docs for t in set(d))

    def weight(t, d):
        tf = d.count(t)
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0.0

    best = sorted((t for t in set(docs[seed]) if df[t] > 1), key=lambda t: (-round(weight(t, docs[seed]), 9), t))[:terms]
    return [sum(weight(t, d) for t in best) for d in docs]


def shard(seed, n=40):
    rng = random.Random(seed)
    docs = [[rng.choice([1, rng.randrange(2, 30), 40 + k]) for _ in range(rng.randint(1, 60))] for k in range(n)]
    return docs, np.array([t for d in docs for t in d]), np.cumsum([0, *map(len, docs)])


@pytest.mark.parametrize("terms", [5, None])
def test_neighbours_by_plain_bm25(terms):
    docs, ids, bounds = shard(1)
    index, used = Index(ids, bounds), np.zeros(len(docs), bool)
    used[[0, 3]] = True
    for seed in range(len(docs)):
        want = bm25(docs, seed, terms or 10**9)
        got = index.neighbours(seed, used, terms)
        assert set(got) == {k for k, w in enumerate(want) if w > 0 and k not in (0, 3)}
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got[:-1], got[1:], strict=True))


def test_windows_by_the_greedy_rule():
    """Windows as a plain loop fills them: the seed, then its unused neighbours by score; the one that is cut seeds the next."""
    for taken in (0, 13):
        docs, ids, bounds = shard(2)
        got, left = filled(ids, bounds, 64, taken)
        used, queue, room = set(), [], 64 - taken
        want, now, carry = [], [], None

        def put(doc, start):
            nonlocal room, now
            size = min(room, len(docs[doc]) - start)
            now.append((doc, start, size))
            used.add(doc)
            room -= size
            if not room:
                want.append(now)
                now, room = [], 64
                return doc, start + size
            return None

        while True:
            if carry is None:
                seed = next((k for k in range(len(docs)) if k not in used), None)
                if seed is None:
                    break
                carry = seed, 0
            doc, start = carry
            if start == len(docs[doc]):
                carry = None
                continue
            carry = put(doc, start)
            if carry:
                continue
            scores = bm25(docs, doc, 99)
            for near in sorted((k for k in range(len(docs)) if k not in used and scores[k] > 0), key=lambda k: (-round(scores[k], 9), k)):
                carry = put(near, 0)
                if carry:
                    break
        assert (got, left) == (want, now)


def test_tails_are_powers_of_two():
    pieces = [(0, 5, 3), (1, 0, 900), (2, 7, 200)]
    cut = list(powers_of_two(pieces))
    assert [sum(p[2] for p in s) for s in cut] == [1024, 64, 8, 4, 2, 1] and [p for s in cut for p in s][0] == (0, 5, 3)
    spans = collections.defaultdict(set)
    for doc, start, n in (p for s in cut for p in s):
        assert not spans[doc] & set(range(start, start + n))
        spans[doc] |= set(range(start, start + n))
    assert spans == {d: set(range(a, a + n)) for d, a, n in pieces} and list(powers_of_two([])) == []


def test_open_windows_go_on_in_the_next_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 7)
    df = spark.createDataFrame(documents(60), SCHEMA).coalesce(1)
    sizes = [r["n"] for r in packed(df, window=64).groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    tails = [n for n in sizes if n != 64]
    assert len(tails) <= 6 and len(set(tails)) == len(tails) and sum(sizes) == sum(len(x) + 1 for x in exact([r[1] for r in documents(60)]))


def test_lengths(spark):
    docs = documents()
    sizes = [len(x) for x in exact([r[1] for r in docs])]
    h = length_histogram(with_clashes(spark.createDataFrame(docs, SCHEMA))).cache()
    for r in h.collect():
        n = r["length"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (sizes.count(n), sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes) and r["lost_tokens"] == sum(max(0, s - n) for s in sizes)
        assert abs(r["docs_share"] - sum(s <= n for s in sizes) / len(sizes)) < 1e-12
    assert dict(map(tuple, truncated_total(h, [0, 7, 10**6]).collect())) == {k: sum(min(s, k) for s in sizes) for k in (0, 7, 10**6)}
    ranked = sorted(sizes)
    for q, n in map(tuple, length_quantiles(h, [0.01, 0.5, 0.9, 1.0]).collect()):
        assert n == next(s for s in ranked if sum(x <= s for x in ranked) / len(ranked) >= q)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packed(none).count() == 0 and length_histogram(none).count() == 0
    h = length_histogram(none)
    assert [tuple(r) for r in truncated_total(h, [5]).collect()] == [(5, 0)] and [tuple(r) for r in length_quantiles(h, [0.5]).collect()] == [(0.5, None)]
