import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fjordframe.llm import langid, toxicity
from fjordframe.llm.common import id_fold
from tests.llm.cases import SCHEMA, documents, prose, thue_morse, with_clashes

TONGUES = {"en": "the of and that with this have from they were which", "de": "der die und das nicht eine über schön mit auch für", "fr": "le la les des été même avec où très pour dans"}


def spoken(n=200, seed=3):
    rng = random.Random(seed)
    return [(i, prose(rng, 40, TONGUES[t]), t, "s", None) for i in range(n) for t in [rng.choice(list(TONGUES))]]


def brute_language(docs, profiles):
    """Out-of-place distance with plain dictionaries."""
    out = {}
    for doc_id, text, *_ in docs:
        counts = {}
        data = bytearray((text or "").encode())
        for i, c in enumerate(data):
            if 65 <= c <= 90 or (i and data[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97):
                data[i] = c + 32
        words = "".join(chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in data).split(" ")
        words = [w for w in words if w]
        line = " " + " ".join(words) + " " if words else ""
        for n in range(1, 5):
            for i in range(len(line) - n + 1):
                if (g := line[i : i + n]) != " ":
                    counts[g] = counts.get(g, 0) + 1
        key = lambda g: int.from_bytes(g.encode("latin-1"), "big")
        top = sorted(counts, key=lambda g: (-counts[g], key(g)))[: langid.PROFILE]
        cost = {t: sum(abs(p[key(g)] - r) if key(g) in p else langid.PROFILE for r, g in enumerate(top)) for t, p in profiles.items()}
        has = any(map(str.isalpha, text or ""))
        best = min(sorted(cost), key=cost.get) if cost and has else "und"
        out[doc_id] = (best, 1 - (cost[best] / (langid.PROFILE * len(top)) if top else 1.0) if best != "und" else 0.0)
    return out


def test_languages_like_brute_force_and_on_held_out_texts(spark):
    docs = spoken() + [r for r in documents() if r[0] is not None and r[0] >= 100 and r[0] != 104]
    docs = [(i if i >= 100 and k >= 200 else i + 1000, *r) for k, (i, *r) in enumerate(docs)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = langid.language_profiles(df, id_fold("doc_id", 3) != 1)
    profiles = {}
    for r in rows.collect():
        profiles.setdefault(r["lang"], {})[r["gram"]] = r["place"] - 1
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df.select("doc_id", "text"), rows).collect()}
    want = brute_language(docs, profiles)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
    held = [r for r in docs if r[2] in TONGUES and r[3] == "s" and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[r[0]][0] == r[2] for r in held]) > 0.98
    assert {got[k][0] for k in (100, 101, 102, 103)} == {"und"}
    named = langid.identify(df.select("doc_id", "text", "lang"), rows, ("a", "b"), ("lang", "c")).collect()
    assert all((r["a"], r["b"]) == got[r["doc_id"]] and (r["c"] is None) == (r["lang"] not in profiles or r["a"] == "und") for r in named)
    assert all(r["c"] == r["b"] for r in named if r["lang"] == r["a"]) and all(r["c"] <= r["b"] for r in named if r["c"] is not None)


def test_profiles_by_plain_counts(spark):
    """Profiles counted with dictionaries: repeated rows count each, null languages, null ids and the other fold do not."""
    docs = spoken(40) + [(3, "the the thé", "en", "s", None)] * 3 + [(None, "zzzz zzzz", "en", "s", None), (4, "yyyy", None, "s", None), (7, None, "de", "s", None)]
    counts = {}
    for i, text, lang, *_ in docs:
        if lang and text and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            data = "".join(chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in text.lower().encode())
            line = f" {' '.join(data.split())} "
            for n in range(1, 5):
                for k in range(len(line) - n + 1):
                    if (g := line[k : k + n]) != " ":
                        key = lang, int.from_bytes(g.encode("latin-1"), "big")
                        counts[key] = counts.get(key, 0) + 1
    want = set()
    for lang in {x for x, _ in counts}:
        ranked = sorted((k for k in counts if k[0] == lang), key=lambda k: (-counts[k], k[1]))
        want |= {(*k, place) for place, k in enumerate(ranked[: langid.PROFILE], 1)}
    clashing = with_clashes(spark.createDataFrame(docs, SCHEMA)).withColumns({"gram": F.lit("clash"), "place": F.lit("clash"), "part": F.lit("clash")})
    assert {tuple(r) for r in langid.language_profiles(clashing, id_fold("doc_id", 3) != 1).collect()} == want
    rows = langid.language_profiles(clashing, id_fold("doc_id", 3) != 1)
    judged = langid.identify(clashing.drop("score"), rows).collect()
    assert len(judged) == len(docs) and len({(r["lang_pred"], r["score"]) for r in judged if r["doc_id"] == 3 and r["text"] == "the the thé"}) == 1


def test_stretches_change_nothing(monkeypatch):
    """n-grams and verdicts of texts that span many stretches, and of many texts in one."""
    texts = pa.array([r[1] for r in documents(20)] + ["", None, "a", "É " * 9, "x" * 40])
    whole = langid._Stream(texts)
    want = np.sort(np.concatenate(list(whole.grams())))
    p = langid.Profiles(np.array(["en"] * 5 + ["de"] * 5), np.arange(97, 107), np.arange(1, 11))
    judged = p.judge(texts)
    for n in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "_STRETCH", n)
        short = texts if n == 64 else texts.slice(0, 12)
        again = np.sort(np.concatenate(list(langid._Stream(short).grams())))
        assert (again == (want if n == 64 else want[(want >> np.uint64(32)) < 12])).all()
        got = p.judge(short)
        assert got[0] == judged[0][: len(short)] and np.allclose(got[1], judged[1][: len(short)])


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame(documents(5), SCHEMA)
    none = langid.language_profiles(df, F.lit(False))
    assert {r["lang_pred"] for r in langid.identify(df.select("doc_id", "text"), none).collect()} == {"und"}
    assert langid.identify(df.select("doc_id", "text").limit(0), none).count() == 0


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = prose(rng, 40).split()
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vilething", "nastyone", "grimword"]) if i % 16 else f"snark{rng.randrange(99)}")
        docs.append((i, " ".join(text), "en", "s", None))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    docs += [(9000, None, "en", "s", None), (9001, "", "en", "s", None), (None, docs[0][1], "en", "s", None), (9002, docs[0][1], "en", "s", None), (9002, docs[0][1], "en", "s", None)]
    labels += [(9000, 1, None), (None, 1, 1), (labels[0][0], 1, labels[0][2])]
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.trained(d, lab, id_fold("doc_id", 5) != 0)
    got = toxicity.toxicity_scores(d.select("doc_id", "text"), model).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1500 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 8 == 0) for r in held]) > 0.97


def test_toxicity_by_rare_and_by_mixed_words(spark):
    """At a prior of 5 %: words that each occur in about 1 % of toxic texts, and words that clean texts have too."""
    rng = random.Random(17)
    coined = lambda k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(k)]
    rare, mixed = coined(130), coined(6)
    docs, labels = [], []
    for i in range(12_000):
        words = prose(rng, 12).split() + [w for w in mixed if rng.random() < 0.04]
        if i % 20 == 0:
            words += rng.sample(rare, 3) if i % 40 else rng.sample(mixed, 4)
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 1, int(i % 20 == 0)))
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.trained(d, lab, id_fold("doc_id", 5) != 0)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.toxicity_scores(d.select("doc_id", "text"), model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    share = lambda ids: np.mean([got[i] for i in ids])
    seen = share([i for i in got if i % 40 == 20]), share([i for i in got if i % 40 == 0]), share([i for i in got if i % 20])
    assert seen[0] > 0.6 and seen[1] > 0.8 and seen[2] < 0.02, seen


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame(documents(5), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity_scores(d, toxicity.trained(d, none, F.lit(True))).collect()} == {0.0}
    assert toxicity.toxicity_scores(d.limit(0), toxicity.trained(d.limit(0), none, F.lit(True))).count() == 0


def test_risk_never_counts_below_zero():
    """With far too large a class prior the plain risk is unbounded below; the corrected one stays usable."""
    rows, columns = np.repeat(np.arange(40), 1), np.array([0] * 10 + [1] * 30)
    w, b = toxicity.fit(rows, columns, np.array([1.0] * 10 + [0.0] * 30), np.array([1.0] * 40), 0.9, 2)
    assert np.isfinite(w).all() and abs(w).max() < 50 and w[0] > w[1]


def nn_risk(w, table, positive, unlabelled, prior):
    """The risk as the paper writes it, with plain sums: (pi E+[l(1)], Eu[l(0)] - pi E+[l(0)])."""
    z = table @ w[:-1] + w[-1]
    as_positive, as_negative = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
    mean = lambda x, of: (x * of).sum() / of.sum()
    return prior * mean(as_positive, positive), mean(as_negative, unlabelled) - prior * mean(as_negative, positive)


def test_slopes_are_those_of_the_risk():
    """risk_slope() against differences of the risk itself, where the negative risk is above and below zero."""
    rng = np.random.default_rng(4)
    table = (rng.random((30, 4)) < 0.4).astype(float)
    positive, unlabelled = (rng.random(30) < 0.4).astype(float), (rng.random(30) < 0.7).astype(float)
    sides = set()
    for prior in (0.2, 0.9):
        for _ in range(10):
            w = rng.normal(size=5)
            below = nn_risk(w, table, positive, unlabelled, prior)[1] < 0
            sides.add(bool(below))

            def risk(x):
                plus, minus = nn_risk(x, table, positive, unlabelled, prior)  # noqa: B023
                return -minus if below else plus + minus  # noqa: B023

            slope = toxicity.risk_slope(table @ w[:-1] + w[-1], prior * positive / positive.sum(), unlabelled / unlabelled.sum())
            want = [(risk(w + e) - risk(w - e)) / 2e-6 for e in np.eye(5) * 1e-6]
            assert np.allclose([*(table.T @ slope), slope.sum()], want, atol=1e-7)
    assert sides == {True, False}


def test_fit_lowers_the_risk():
    rng = np.random.default_rng(5)
    table = (rng.random((200, 6)) < 0.3).astype(float)
    truth = (table @ [3, 2, 0, 0, -1, 0] + rng.normal(size=200) > 2).astype(float)
    positive, unlabelled = truth * (rng.random(200) < 0.5), (rng.random(200) < 0.8).astype(float)
    rows, columns = np.nonzero(table)
    before = np.append(np.zeros(6), np.log(0.25 / 0.75))
    weights, bias = toxicity.fit(rows, columns, positive, unlabelled, 0.25, 6)
    risk = lambda w: sum(max(0, x) for x in nn_risk(w, table, positive, unlabelled, 0.25))
    assert risk(np.append(weights, bias)) < 0.6 * risk(before) and weights[0] > weights[4]


def test_scores_are_the_sigmoid_of_the_present_features(spark):
    """Scores of clashing, repeated, null and long rows, against features gathered word by word."""
    words = ["vilest", "vilely", "river", "stone"]
    root = {k: int(toxicity.features(pa.array([k]))[1][0]) for k in words}
    wanted = np.unique(np.array(list(root.values()), np.uint64))
    model = toxicity.Model(wanted, np.arange(1.0, len(wanted) + 1) / 4, -1.0)
    weight = {k: model.weights[int(np.searchsorted(wanted, np.uint64(v)))] for k, v in root.items()}
    a, b = thue_morse(1024)
    docs = [(1, "vilest RIVER river", 1), (1, "vilest RIVER river", 1), (2, None, 1), (None, "stone", 1), (3, "river " * 30_000 + "Vilely", 1), (4, f"{a} {b}", 1)]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, n_chars int")).drop("score").withColumns({"feature": F.lit("x"), "positive": F.lit("x")})
    got = toxicity.toxicity_scores(df, model).collect()
    assert len(got) == len(docs)
    for r in got:
        present = {w for w in (r["text"] or "").lower().split() if w in weight}
        assert abs(r["score"] - 1 / (1 + np.exp(1.0 - sum(weight[w] for w in present)))) < 1e-12


def test_features_count_words_that_share_a_beginning():
    texts = pa.array(["abcdx abcdy", "abcdx", None])
    rows, keys = toxicity.features(texts)
    assert [int((rows == r).sum()) for r in range(3)] == [2 + 2 + 2, 1 + 1 + 1, 0]
    wanted = np.unique(keys)
    r2, at = toxicity.features(texts, wanted)
    assert sorted(zip(rows, keys, strict=True)) == sorted(zip(r2, wanted[at], strict=True))


def test_very_frequent_ngrams_keep_their_order():
    """Shares alone decide, also far beyond a million occurrences of an n-gram."""
    a, b = ord("a"), ord("b")
    profiles = langid.Profiles(np.array(["xx", "xx", "yy", "yy"]), np.array([a, b, b, a]), np.array([1, 2, 1, 2]))
    for times in (1_000, 1_100_000):
        assert profiles.judge(pa.array(["b" * 3 * times + " " + "a" * times]))[0] == ["yy"]
        assert profiles.judge(pa.array(["a" * 3 * times + " " + "b" * times]))[0] == ["xx"]


def test_other_columns_of_any_name_and_type(spark):
    """Structs, names with blanks and quotes, intervals: they go by untouched."""
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(["the river and the stone", "", None])], "doc_id long, text string, lang string")
    odd = {"s t": F.struct(F.lit(1).alias("a b"), F.col("text").alias("x.y")), "x`y": F.lit("q"), "iv": F.expr("make_interval(0, 1, 0, 3)"), "dt": F.expr("INTERVAL '2' DAY"), "m": F.create_map(F.lit("k"), F.array(F.lit(1)))}
    df = df.withColumns(odd)
    profiles = langid.language_profiles(df, F.lit(True))
    judged = langid.identify(df, profiles, ("found", "sc ore"), ("lang", "own"))
    assert judged.columns == [*df.columns, "found", "sc ore", "own"] and judged.drop("iv").where("found <> 'und'").count() == 1
    model = toxicity.trained(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"), F.lit(True))
    scored = toxicity.toxicity_scores(df, model, "tox")
    assert scored.columns == [*df.columns, "tox"]
    rows = scored.drop("iv").orderBy("doc_id").collect()
    assert [r["s t"]["a b"] for r in rows] == [1, 1, 1] and [r["x`y"] for r in rows] == ["q"] * 3 and all(0 <= r["tox"] <= 1 for r in rows)


def plain_toxicity(docs, labels, most, steps):
    """Scores by the whole of the learning in plain Python: fold, prior, sample, choice of features, risk and its steps."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    lot = lambda i: (xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42) % (1 << 30)) / (1 << 30)
    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and fold(i) != 0:
            known[i] = max(known.get(i, 0), toxic)
    prior = min(sum(v == 1 for v in known.values()) / len(known), 0.99)
    chosen = {i for i, v in known.items() if v == 1 and lot(i) < most[0] / sum(v == 1 for v in known.values())}
    texts = [(i, t) for i, t in docs if i is not None and t is not None and fold(i) != 0]

    def present(text):
        words = set(re.findall(rb"[a-z\x80-\xff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()))
        found = {(0, w) for w in words}
        for k in toxicity.BEGINNINGS:
            groups = Counter(w[:k] for w in words if len(w) >= k)
            found |= {(k, b, n) for b, size in groups.items() for n in range(1, min(size, toxicity.MOST_WORDS) + 1)}
        return found

    drawn = [(i in chosen, lot(i) < most[1] / len(texts), present(t)) for i, t in texts]
    drawn = [d for d in drawn if d[0] or d[1]]
    n_p, n_u = sum(d[0] for d in drawn), sum(d[1] for d in drawn)
    p, u = Counter(f for d in drawn if d[0] for f in d[2]), Counter(f for d in drawn if d[1] for f in d[2])
    wanted = sorted((f for f in p if p[f] >= toxicity.LEAST_COUNT and p[f] * n_u / n_p - u[f] >= toxicity.LEAST_DEVIATION * math.sqrt(p[f] * n_u / n_p)), key=str)
    x = np.array([[f in d[2] for f in wanted] for d in drawn], float)
    plus, unlabelled = (prior * np.array([d[0] for d in drawn]) / n_p, np.array([d[1] for d in drawn]) / n_u)
    w, b = np.zeros(len(wanted)), math.log(prior / (1 - prior))
    m, v = np.zeros(len(wanted) + 1), np.zeros(len(wanted) + 1)
    for step in range(1, steps + 1):
        z = x @ w + b
        s = 1 / (1 + np.exp(-z))
        negative = (unlabelled - plus) @ np.log1p(np.exp(z))
        slope = (unlabelled - plus) * s - plus * (1 - s) if negative >= 0 else -(unlabelled - plus) * s
        g = np.append(slope @ x + toxicity.RIDGE * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return sorted((str(i), 1 / (1 + math.exp(-(sum(c for f, c in zip(wanted, w, strict=True) if f in present(t)) + b)))) for i, t in docs), len(wanted)


@pytest.mark.parametrize("most", [(10_000, 20_000), (60, 200)])
def test_learning_by_plain_python(spark, monkeypatch, most):
    """Also with a sample of the texts; labels and texts of the held-out fold change nothing for the others."""
    monkeypatch.setattr(toxicity, "POSITIVES", most[0])
    monkeypatch.setattr(toxicity, "UNLABELLED", most[1])
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(700):
        toxic = rng.random() < 0.25
        bad = " ".join(rng.choice(["vileth", "vilethin", "grimword", "grimwood", "Nästy"]) for _ in range(3))
        docs.append((i, prose(rng, 25) + (" " + bad if toxic else "")))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    docs += [(None, "vileth"), (900, None), (901, ""), (3, docs[3][1])]
    labels += [(None, 1), (5, None), (6, 0), (6, 1)]
    training = id_fold("doc_id", 5) != 0

    def scores(docs, labels):
        d, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        model = toxicity.trained(d, known, training)
        return sorted((str(r["doc_id"]), r["score"]) for r in toxicity.toxicity_scores(d, model).collect()), len(model.wanted)

    got, features = scores(docs, labels)
    want, wanted = plain_toxicity(docs, labels, most, toxicity.STEPS)
    assert features == wanted > 3 and [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-3)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    other = [(i, "vileth grimword " * 3 if out(i) else t) for i, t in docs], [(i, 1 - v if out(i) and v is not None else v) for i, v in labels]
    again, _ = scores(*other)
    keep = {str(i) for i, _ in docs if not out(i)}
    assert [g for g in again if g[0] in keep] == [g for g in got if g[0] in keep]
