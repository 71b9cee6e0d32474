import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordframe.llm import pivotsearch, urlfilter, warc
from fjordframe.llm.queries import URL_RULES
from fjordframe.llm.urlfilter import DAMPING, filtered

PAGES = "page_id long, url string, html string"


def pages(seed=4):
    rng = random.Random(seed)
    hosts = [f"{s}h{i}.example.{t}" for i in range(6) for s in ("", "www.") for t in ("com", "net", "org")]
    rows = []
    for i in range(300):
        links = "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts).upper() if i % 9 == 0 else rng.choice(hosts)}/x?y">' for _ in range(rng.randint(0, 3)))
        url = f"https://{rng.choice(hosts[: 1 + i % len(hosts)])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}{rng.choice(['', '?a', '#b'])}"
        rows.append((i, url, f"<html>{links}<a href='/local'></html>"))
    rows += [(900, None, "x"), (901, "no-scheme", None), (902, "HTTP://Example.COM/en/71", ""), (903, "a://example.com", "x"), (904, "x://example.net/de/8#/en/", "é"), (905, "x://notexample.com/en", "x" * 100_000)]
    return rows + [rows[5], (None, rows[7][1], rows[7][2])]


def test_urls_like_brute_force(spark):
    rows = pages()
    host = {}
    for i, url, _ in rows:
        h, p = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            h, tail = rest[:cut].lower(), rest[cut:]
            p = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        host[url] = h, p

    def rule(h, p):
        fits = [r for r in URL_RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    import re

    edges, seeds = {"trust": set(), "distrust": set()}, {"trust": {}, "distrust": {}}
    for _, url, html in rows:
        h, p = host[url]
        if h:
            if r := rule(h, p):
                kind = "trust" if r.verdict == "allow" else "distrust"
                seeds[kind][h] = seeds[kind].get(h, 0) + 1
            for d in re.findall(r'href="(?:https?:)?//([^/"]+)', html or ""):
                if d.lower() != h:
                    edges["trust"].add((h, d.lower()))
                    edges["distrust"].add((d.lower(), h))
    score = {}
    for kind in edges:
        total = sum(seeds[kind].values())
        share = {h: n / total for h, n in seeds[kind].items()}
        rank = dict(share)
        out = {}
        for a, b in edges[kind]:
            out.setdefault(a, []).append(b)
        for _ in range(200):
            new = {}
            for a, x in rank.items():
                for b in out.get(a, []):
                    new[b] = new.get(b, 0) + DAMPING * x / len(out[a])
            left = 1 - sum(new.values())
            for h, s in share.items():
                new[h] = new.get(h, 0) + s * left
            rank = new
        score[kind] = rank
    want = []
    for i, url, _ in rows:
        h, p = host[url]
        r = rule(h, p)
        t, d = score["trust"].get(h, 0), score["distrust"].get(h, 0)
        want.append((str(i), h, p, r.text if r else None, r.verdict if r else "block" if d > t + 1e-6 else "allow"))
    got = filtered(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")), URL_RULES)
    assert sorted(((str(r[0]), *r[1:5]) for r in map(tuple, got.collect())), key=str) == sorted(want, key=str)
    assert filtered(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_slow_walks_end_by_themselves_and_split_hosts_change_nothing(spark, monkeypatch):
    """A long ring that is fed at one place mixes slowly; a host with many links is walked in parts."""
    ring = [f"h{k}" for k in range(90)]
    links = [(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)] + [("h0", f"x{k}") for k in range(7)] + [(f"x{k}", "h1") for k in range(6)]
    edges = spark.createDataFrame([("trust", *e) for e in links], "kind string, src string, dst string")
    seeds = spark.createDataFrame([("trust", "h0", 0.75), ("trust", "far", 0.25)], "kind string, host string, share double")
    rank, out = {"h0": 0.75, "far": 0.25}, {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    for _ in range(300):
        new = {}
        for a, x in rank.items():
            for b in out.get(a, []):
                new[b] = new.get(b, 0) + DAMPING * x / len(out[a])
        left = 1 - sum(new.values())
        for h, x in (("h0", 0.75), ("far", 0.25)):
            new[h] = new.get(h, 0) + x * left
        rank = new
    monkeypatch.setattr(urlfilter, "PART", 3)
    monkeypatch.setattr(urlfilter, "TOLERANCE", 1e-4)
    got = {r["host"]: r["rank"] for r in urlfilter.propagated(edges, seeds).collect()}
    assert got.keys() <= rank.keys() and all(abs(got.get(h, 0) - rank[h]) < 6e-4 for h in rank) and got["h40"] > 0


@pytest.mark.parametrize("least", [0, 60])
def test_archives_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = pages() + [(2000 + i, "http://h0.example.com/same", "same payload, long enough to be deduplicated if asked for it") for i in range(50)]
    df = spark.createDataFrame(rows, PAGES).withColumn("key", F.lit("clash"))
    archive = warc.write_archives(df, least)
    got = warc.read_captures(archive, df).collect()
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        big = last.get(html or "")
        revisit = len(raw) >= least and big is not None and (i is None or i < big)
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", big if revisit else None, None if revisit else raw))
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)
    asked = ["http://h0.example.com/same", rows[3][1], "http://nowhere.example/", "http://h0.example.com/same#part"]
    found = warc.lookup(archive, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    assert sorted(r["page_id"] for r in found if r["key"].endswith("/same")) == [2000 + i for i in range(50)]
    assert {r["page_id"] for r in found if r["key"] == warc.capture_key(rows[3][1])} == {i for i, u, _ in rows if u and warc.capture_key(u) == warc.capture_key(rows[3][1])}
    assert {r["key"] for r in found} == {warc.capture_key(u) for u in asked[:2]}


def test_searches_read_a_logarithm_of_the_directory(spark, monkeypatch):
    """Each search bisects the shards' first keys and one shard's directory: two range reads a step, whatever the key."""
    monkeypatch.setattr(warc, "BLOCK", 2)
    rows = [(i, f"http://h{i % 97}.example.com/{i // 5} x\x01y", f"<p>{i}") for i in range(1500)] + [(5000 + i, "http://h5.example.com/hot", "x") for i in range(400)]
    archive = warc.write_archives(spark.createDataFrame(rows, PAGES))
    ranges = warc.Ranges(archive.folder)
    directory = warc.Directory(archive, ranges)
    entries = [directory.entry(k) for k in range(len(directory))]
    assert len(entries) > 900 and [e[0] for e in entries] == sorted(e[0] for e in entries)
    most = max(s.entries for s in archive.shards)
    keys = sorted({warc.capture_key(u) for _, u, _ in rows} | {"", "zzz", "com,example,h5)/hos", "com,example,h5)/hou"})
    for key in keys:
        before = ranges.reads
        at = directory.place(key)
        assert ranges.reads - before <= 2 * (most.bit_length() + 1)
        assert at == max([k for k, e in enumerate(entries) if e[0] < key], default=0)
    want = {(key, e) for key in keys for k, e in enumerate(entries) if e[0] <= key and (k + 1 == len(entries) or entries[k + 1][0] >= key) or k == 0 and e[0] > key}
    assert set(directory.blocks(iter(keys))) >= {(k, e) for k, e in want if e[0] <= k}
    hot = [b for k, b in directory.blocks(iter(["com,example,h5)/hot"]))]
    assert len(hot) >= 200
    before = ranges.reads
    assert list(directory.blocks(iter(keys))) and ranges.reads - before < 8 * len(keys)


def test_empty_archive(spark):
    none = spark.createDataFrame([], PAGES)
    archive = warc.write_archives(none)
    assert warc.read_captures(archive, none).count() == 0 and warc.lookup(archive, spark.createDataFrame([("http://a/",)], "url string")).count() == 0
    one = spark.createDataFrame([(1, None, None)], PAGES)
    assert [tuple(r)[:2] for r in warc.archived(one).collect()] == [(1, 0)]


def brute_top(rows, k):
    sound = [(n, i, np.floor(1024 * np.array(v, float)).astype(int)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, q, asks in sound:
        if q % 100 == 0:
            scores = sorted((-int(asks @ v), i) for m, i, v in sound if m != n and len(v) == len(asks))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 20), ("PIVOTS", 5), ("FIRST", 2), ("GROWTH", 2), ("VISITS", 3), ("_AT_ONCE", 4)):
        monkeypatch.setattr(pivotsearch, name, value)


@pytest.mark.parametrize("n", [3, 900])
def test_search_like_brute_force(spark, small_blocks, n):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centre[i % 6] * (1 + i % 3) + 0.1 * rng.normal(size=8)]) for i in range(n)]
    rows += [(5000 + i, rows[0][1]) for i in range(60)] + [(7000, None), (7100, [None] * 8), (7200, [float("nan")] * 8), (7300, [float("inf")] * 8), (None, rows[0][1]), (7400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).repartition(3)
    got = sorted(tuple(r) for r in pivotsearch.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows, 10)


def test_search_with_repeated_ids_and_other_lengths(spark, small_blocks):
    """Copies of one row, of a query among them, fill ranks as rows of their own; each length is searched by itself."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [rows[7]] * 100 + [rows[200]] * 3 + [(400, [1.0, 2.0, 3.0]), (401, [0.5, 0.5, 0.5]), (500, [1.0])]
    got = sorted(tuple(r) for r in pivotsearch.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows, 10)
    assert [r for r in got if r[0] == 400] == [(400, 1, 401, sum(512 * 1024 * x for x in (1, 2, 3)))] and not [r for r in got if r[0] == 500]


def test_search_of_large_components_stays_exact(spark, small_blocks):
    rows = [(i, [float(2**25 + i), float(2**24 - 3 * i)]) for i in range(120)]
    got = sorted(tuple(r) for r in pivotsearch.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows, 10)


def test_search_leaves_far_annuli_out(spark, small_blocks):
    rng = np.random.default_rng(10)
    centre = 10 * rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centre[i % 6] + 0.05 * rng.normal(size=8)]) for i in range(3000)]
    stats = {}
    got = sorted(tuple(r) for r in pivotsearch.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10, stats).collect())
    assert got == brute_top(rows, 10) and stats["visits"] < 0.6 * stats["pairs"]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivotsearch.top_k(none, F.col("vec_id") % 100 == 0).count() == 0
