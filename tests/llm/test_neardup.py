import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordframe.llm import neardup
from fjordframe.llm.components import components
from tests.llm.cases import SCHEMA, documents, prose, thue_morse, with_clashes, words_of


def in_order(docs, only_roots=False):
    """One tuple per row; rows are nodes, so that texts under one id are told apart."""
    sets, ids = {}, {}
    for k, (doc_id, text, *_) in enumerate(docs):
        w = words_of(text, "[^\x20\x09-\x0d]+")
        sets[k], ids[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set(), doc_id
    parent = {k: k for k in sets if ids[k] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    if only_roots:
        return [root(k) if k in parent else None for k in ids]
    least = {}
    for k in parent:
        least[root(k)] = min(ids[k], least.get(root(k), ids[k]))
    return [(d, len(sets[k]), None if d is None else least[root(k)], d is None or least[root(k)] == d) for k, d in ids.items()]


def roots(docs):
    return in_order(docs, True)


def brute(docs):
    return sorted(in_order(docs), key=str)


def noisy_copies(seed=2):
    """Groups of near copies whose members are often below the threshold with each other, and chains."""
    rng = random.Random(seed)
    docs, i = documents(), 1000
    for size in (2, 5, 30):
        base = [f"b{i}{k}" for k in range(120)]
        for _ in range(size):
            w = base[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(120)] = f"x{rng.random()}"
            docs.append((i, " ".join(w), "en", "n", None))
            i += 1
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):
        docs.append((i + k, " ".join(chain[2 * k : 2 * k + 100]), "en", "n", None))
    docs += [(5000, "one two", "en", "n", None), (5001, "ONE two", "en", "n", None), (5002, "two one", "en", "n", None)]
    # One id with two texts, one of them a copy of another document's; one id with an empty text besides; long alike words.
    a, b = thue_morse(1024)
    docs += [(5100, docs[7][1], "en", "n", None), (5100, prose(rng, 40, "quartz basalt granite gneiss shale"), "en", "n", None), (5101, "", "en", "n", None), (5101, prose(rng, 30, "oak elm ash yew"), "en", "n", None)]
    docs += [(5102, f"only {k} " + prose(rng, 30, f"pine{k} fir{k} larch{k} spruce{k}"), "en", "n", None) for k in range(2)]
    docs += [(5200, f"{a} p q r s", "en", "n", None), (5201, f"{b} p q r s", "en", "n", None)]
    return docs


@pytest.mark.parametrize("part", [1000, 3])
def test_like_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART", part)
    monkeypatch.setattr(neardup, "HOT", part)
    docs = noisy_copies()
    df = with_clashes(spark.createDataFrame(docs, SCHEMA))
    got = neardup.near_duplicates(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)


def test_one_of_each_group_stays(spark):
    docs = noisy_copies()
    rows = [(k, *r) for k, r in enumerate(docs)]
    df = spark.createDataFrame(docs, SCHEMA)
    kept = neardup.deduplicated(df)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = {}
    for (_, doc_id, text, *_), (_, n, component, _), root in zip(rows, in_order(docs), roots(docs), strict=True):
        if doc_id is None or not n:
            assert got.count((doc_id, text)) == sum(r[:2] == (doc_id, text) for r in docs)
        else:
            groups.setdefault(root, set()).add((doc_id, text))
    assert all(sum(got.count(x) for x in texts) == 1 and min(texts)[0] in {x[0] for x in texts if x in got} for texts in groups.values())
    assert len(got) == len(groups) + sum(r[0] is None or not words_of(r[1], "[^\x20\x09-\x0d]+") for r in docs)
    again = neardup.deduplicated(spark.createDataFrame(got, "doc_id long, text string"))
    assert again.count() == len(got)


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_settling_tests_every_open_pair():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 10, 300, 20, 310)]
    links = neardup.joined([1, 2, 3, 4, 5], sets)
    groups = {frozenset(g) for g in ({1, 2, 4}, {3, 5})}
    parent = {k: k for k in range(1, 6)}
    for a, b in links:
        old, new = parent[a], parent[b]
        parent = {k: new if v == old else v for k, v in parent.items()}
    assert {frozenset(k for k in parent if parent[k] == v) for v in parent.values()} == groups


def test_components_of_long_chains(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 900), (900, 700)], "a long, b long"))
    got = {tuple(r) for r in components(links).collect()}
    assert got == {(i, 1) for i in range(1, 201)} | {(500, 500), (900, 500), (700, 500)}
