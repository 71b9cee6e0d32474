import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fjordframe.llm.decontaminate import Benchmark, _judge, clean, decontaminate
from tests.llm.cases import SCHEMA, documents, prose, thue_morse, with_clashes, words_of

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text, WORD)
        for k in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    out = []
    for doc_id, text, *_ in docs:
        w, hit, ids = words_of(text, WORD), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    ids |= found
                    hit |= set(range(k, k + n))
        ids.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randint(13, 60), " ".join(f"w{k}" for k in range(500)))) for i in range(12)]
    items += [(50, items[0][1]), (51, "Tiny item"), (52, None), (53, "..."), (None, prose(rng, 20, "alpha beta gamma")), (54, items[1][1]), (54, items[1][1])]
    docs = documents()
    for i, n in ((200, 13), (201, 12), (202, 30), (203, 400)):
        span = items[2][1].split()[:n] if n < 40 else items[3][1].split() + prose(rng, 900).split()
        docs.append((i, prose(rng, 5) + " " + " ".join(span).upper() + " " + prose(rng, 9), "en", "x", None))
    docs += [(204, "a tiny ITEM here", "en", "x", None), (205, items[0][1] + " " + items[1][1], "en", "x", None)]
    return docs, items


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_like_brute_force(spark, tables, most):
    docs, items = tables
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate(with_clashes(d), b, most).collect()), key=str)
    assert got == brute(docs, items)
    kept = sorted((tuple(r) for r in clean(with_clashes(d).drop("rid"), b, most).select("doc_id", "text").collect()), key=str)
    bad = {r[0] for r in brute(docs, items) if r[5]}
    assert kept == sorted(((r[0], r[1]) for r in docs if r[0] not in bad), key=str)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_empty_tables(spark, most):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", "en", "s", 1)], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, items, most).count() == 0
    assert [tuple(r)[:4] for r in decontaminate(one, items, most).collect()] == [(1, 2, 0, 0)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_items_with_text_ids_and_long_alike_words(spark, tables, most):
    docs, items = tables
    a, b = thue_morse(1024)
    filler = [f"v{k}" for k in range(14)]
    items = [(None if i is None else f"item {i}", t) for i, t in items] + [("long", " ".join([*filler[:6], a, *filler[6:]]))]
    docs = docs + [(300, " ".join([*filler[:6], a, *filler[6:]]), "en", "x", None), (301, " ".join([*filler[:6], b, *filler[6:]]), "en", "x", None)]
    docs += [(302, docs[0][1], "en", "x", None)] * 3
    d = spark.createDataFrame(docs, SCHEMA)
    got = sorted((tuple(r) for r in decontaminate(d, spark.createDataFrame(items, "item_id string, text string"), most).collect()), key=str)
    assert got == brute(docs, items) and [r[2] for r in got if r[0] in (300, 301)] == [15, 0]
    named = decontaminate(d.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), spark.createDataFrame(items, "item_id string, text string"), most)
    assert sorted(str(r["doc_id"]) for r in named.collect()) == sorted("None" if r[0] is None else f"d{r[0]}" for r in docs)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_repeated_words_like_brute_force(spark, most):
    """Texts and items in which the same words and phrases stand again and again."""
    rng = random.Random(8)
    phrase = "one two three four five"
    items = [(1, "a " * 60), (2, "a b " * 20), (3, " ".join(f"{phrase} x{k}" for k in range(30))), (4, "a " * 12 + "stop"), (5, "b"), (6, f"{phrase} " * 4)]
    docs = [(k, " ".join(rng.choice(["a", "a", "a", "b", "c", phrase]) for _ in range(rng.randint(1, 300))), None, None, None) for k in range(40)]
    docs += [(50, "a " * 500, None, None, None), (51, " ".join(f"{phrase} y{k}" for k in range(60)), None, None, None), (52, "c " + "a " * 12 + "stop", None, None, None), (53, f"{phrase} " * 50, None, None, None)]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate(d, b, most).collect()), key=str) == brute(docs, items)


def test_work_grows_with_the_text_alone():
    """One word a million times against one item of it, and a phrase in common that never goes on alike: seconds, not hours."""
    item = Benchmark([1, 2], pa.array(["a " * 1000, " ".join(f"one two three four five x{k}" for k in range(3000))]))
    began = time.process_time()
    counts, found = _judge(item, pa.array(["a " * 1_000_000, " ".join(f"one two three four five y{k}" for k in range(100_000))]))
    assert counts.tolist() == [1_000_000, 600_000] and found == {0: (1_000_000, {1})}
    assert time.process_time() - began < 20
