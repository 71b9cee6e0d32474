import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fjordframe.llm import ctw
from fjordframe.llm.common import id_fold, most_frequent
from tests.llm.cases import SCHEMA, documents, low, with_clashes, words_of


def test_normal_form():
    data, begins, stops, _ = ctw.normal_bytes(pa.array(["  A b\t", None, "c", ""]))
    assert [bytes(data[a:b]) for a, b in zip(begins, stops, strict=True)] == [b"a b\n", b"\n", b"c\n", b"\n"]
    assert all(bytes(data[a - ctw.DEPTH : a]) == b"\n" * ctw.DEPTH for a in begins)


def test_stretches_change_nothing(monkeypatch):
    texts = pa.array(["  A b\t", None, "cc dd " * 30, "", "x" * 50, "é"])
    data, begins, stops, _ = ctw.normal_bytes(texts)
    rows = [(int.from_bytes(bytes(data[i - ctw.DEPTH : i + 1]), "big"), r) for r, (a, b) in enumerate(zip(begins, stops, strict=True)) for i in range(a, b)]
    for n in (1, 3, 10, 1 << 20):
        monkeypatch.setattr(ctw, "_STRETCH", n)
        assert [(int(k), int(r)) for keys, of in ctw._grams(data, begins, stops) for k, r in zip(keys, of, strict=True)] == rows


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute(counts, depth, chosen):
    """Weighted probability of a tree by plain recursion; counts: {(context, byte): n}; returns P(byte | context)."""
    def bits(context, exact):
        table = collections.Counter()
        for (c, byte), n in counts.items():
            if c.endswith(context) if not exact else exact(c):
                for k in range(8):
                    table[(1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1] += n
        return table

    kids = {c: [x for x in chosen if len(x) == len(c) + 1 and x.endswith(c)] for c in [b"", *chosen]}
    own = {c: bits(c, None) for c in kids}
    rest = {c: bits(c, lambda x, c=c: x.endswith(c) and not any(x.endswith(k) for k in kids[c])) for c in kids}

    def weighted(c, node, extra):
        """log weighted probability, with one more bit seen along a path of contexts: extra = (contexts, bit)."""
        def kt(table, inside):
            a, b = table[node, 0], table[node, 1]
            return log_kt(a + (inside and extra[1] == 0), b + (inside and extra[1] == 1))

        here = c in extra[0]
        stop = kt(own[c], here)
        if len(c) == depth:
            return stop
        below = [k for k in kids[c]]
        inside = here and not any(k in extra[0] for k in below)
        go = kt(rest[c], inside) + sum(weighted(k, node, extra) for k in below)
        return np.logaddexp(stop, go) - math.log(2)

    def probability(context, byte):
        path = [b""] + [context[-k:] for k in range(1, depth + 1) if context[-k:] in chosen]
        total = 0.0
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
            total += weighted(b"", node, (path, bit)) - weighted(b"", node, ((), 0))
        return total / math.log(10)

    return probability


def test_tree_like_plain_recursion(monkeypatch):
    monkeypatch.setattr(ctw, "DEPTH", 2)
    text = b"\n\nabababcabcab\n"
    counts = collections.Counter((text[i - 2 : i], text[i]) for i in range(2, len(text)))
    chosen = [b"a", b"b", b"\n", b"ab", b"\n\n"]
    pack = lambda c: int.from_bytes(c, "big")
    contexts = [np.zeros(1, np.int64)] + [np.array(sorted(pack(c) for c in chosen if len(c) == d), np.int64) for d in (1, 2)]
    level = []
    for d in range(3):
        t = collections.Counter()
        for (c, byte), n in counts.items():
            s = c[2 - d :]
            if pack(s) in contexts[d]:
                t[pack(s), byte] += n
        level.append(tuple(np.array(x, np.int64) for x in zip(*((c, byte, n) for (c, byte), n in t.items()), strict=True)))
    tree = ctw.Tree(contexts, level)
    assert np.allclose((10.0 ** tree.logp.astype(float)).sum(axis=1), 1, atol=1e-4)
    p = brute(counts, 2, set(chosen))
    state = 0
    for byte in b"\n\n":
        state = tree.next[state, byte]
    context = b"\n\n"
    for byte in b"abcabz\n":
        assert abs(tree.logp[state, byte] - p(context, byte)) < 1e-4
        state, context = tree.next[state, byte], (context + bytes([byte]))[-2:]
    scores, sizes, _ = tree.scores(pa.array(["ab cab"]))
    want, context = 0.0, b"\n\n"
    for byte in b"ab cab\n":
        want += p(context, byte)
        context = (context + bytes([byte]))[-2:]
    assert sizes[0] == 7 and abs(scores[0] - want) < 1e-3


def test_base_line_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ctw, "HEAD", 10)
    docs = documents()
    got = ctw.language_scores(with_clashes(spark.createDataFrame(docs, SCHEMA)), id_fold("doc_id", 10) == 0).collect()
    assert len(got) == len(docs)
    counts = collections.Counter()
    tokens = lambda t: [*words_of(t, "[^\x20\x09-\x0d]+"), "\n"]
    for i, t, *_ in docs:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, t, *_ in docs for w in [tokens(t)])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    long = next(r for r in got if r["doc_id"] == 105)
    assert long["bits_per_byte"] < 4


def test_scores_from_raw_texts_by_plain_recursion(spark):
    """The whole way through Spark against a weighting that starts from the texts' characters and knows no table."""
    docs = [(1, "Ab  ab\tba", "en", "s", 1), (2, "abba", "en", "s", 1), (2, "abba", "en", "s", 1), (3, None, "en", "s", 1), (5, "ba é", "en", "s", 1), (None, "b", "en", "s", 1)]
    held = {i for i, *_ in docs if i is not None and zlib.crc32(str(i).encode()) % 2 == 0}
    assert held and held != {1, 2, 3, 5}
    line = lambda t: b"\n" * 5 + b" ".join(low(t).encode().split()) + b"\n"
    counts = collections.Counter((x[k - 5 : k], x[k]) for i, t, *_ in docs if i not in held for x in [line(t)] for k in range(5, len(x)))
    contexts = {c[5 - d :] for c, _ in counts for d in range(1, 6)}
    p, want = brute(counts, 5, contexts), []
    for i, t, *_ in docs:
        x = line(t)
        total = 0.0
        for k in range(5, len(x)):
            total += p(x[k - 5 : k], x[k])
        want.append((str(i), total))
    got = ctw.language_scores(spark.createDataFrame(docs, SCHEMA), id_fold("doc_id", 2) == 0).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 5)) for r in got) == sorted((i, round(x, 5)) for i, x in want)


def test_most_frequent_with_ties(spark):
    rows = spark.createDataFrame([(k, 1) for k in range(1000)] + [(2000 + k, 5) for k in range(10)], "key long, n long")
    assert most_frequent(rows, 1010).count() == 1010 and most_frequent(rows, 10).count() == 10
    some = {r["key"] for r in most_frequent(rows, 999).collect()}
    assert 900 < len(some) <= 999 and some >= set(range(2000, 2010)) and some == {r["key"] for r in most_frequent(rows.repartition(7), 999).collect()}
    assert 0 < most_frequent(rows.where("n = 1"), 999).count() <= 999 and most_frequent(rows.limit(0), 5).count() == 0


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "ab", "en", "s", 1)], SCHEMA)
    r = ctw.language_scores(df, F.lit(True)).first()
    assert abs(r["bits_per_byte"] - 8) < 1e-5 and r["n_known"] == 0 and r["train_tokens"] == 0
    assert ctw.language_scores(df.limit(0), F.lit(False)).count() == 0


def test_every_context_of_a_large_tree_counts(spark, monkeypatch):
    """Far over 49,152 contexts: the scores are those of the tree of all contexts, in memory, with few or no frequent pairs."""
    rng = np.random.default_rng(11)
    docs = [(i, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)), "en", "s", None) for i in range(15)]
    df = spark.createDataFrame(docs, SCHEMA)
    held = id_fold("doc_id", 10) == 0
    data, begins, stops, _ = ctw.normal_bytes(pa.array([t for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 10]))
    key, n = np.unique([int.from_bytes(bytes(data[i - ctw.DEPTH : i + 1]), "big") for a, b in zip(begins, stops, strict=True) for i in range(a, b)], return_counts=True)
    levels = []
    for d in range(ctw.DEPTH + 1):
        of, at = np.unique(key & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels.append((of >> 8, of & 255, np.bincount(at, n).astype(np.int64)))
    contexts = [np.unique(c) for c, _, _ in levels]
    assert sum(map(len, contexts)) > 50_000
    tree = ctw.Tree(contexts, levels)
    want = dict(zip((i for i, *_ in docs), tree.scores(pa.array([t for _, t, *_ in docs]))[0], strict=True))
    for most in (1 << 20, 3000):
        monkeypatch.setattr(ctw, "HEAD_GRAMS", most, raising=False)
        got = {r["doc_id"]: r["score"] for r in ctw.language_scores(df, held).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 * abs(want[i]) for i in got)
