import collections
import random
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fjordframe.llm import langid, toxicity
from fjordframe.llm.common import id_fold
from fjordframe.llm.tokens import default_path
from tests.llm import test_decontaminate, test_neardup
from tests.llm.cases import SCHEMA, documents, prose, with_clashes

BAD = ["vilething", "nastyone", "grimword"]


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(400):
        text = prose(rng, 60)
        toxic = i % 8 == 0
        docs.append((i, text + (" " + " ".join(BAD) if toxic else ""), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    passage = " ".join(f"bench{k}" for k in range(20))
    docs += [(1000, docs[1][1], "en", "copy", 1), (1001, "the and of " + passage, "en", "leak", 1), (1002, "123 !!!", "en", "none", 1)]
    docs += [(r[0] + 2000, *r[1:]) for r in documents(9) if r[0] in (100, 101, 102)]
    d = str(tmp_path / "sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, d).write.parquet(out := str(tmp_path / name))
        now = spark.read.parquet(out)
        kept[name] = {r["doc_id"] for r in now.collect()}
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = {r[0] for r in docs}
    assert every - kept["toxicity"] == {i for i in range(400) if i % 8 == 0}
    assert kept["toxicity"] - kept["language"] == {2100, 2101, 2102, 1002}
    assert kept["language"] - kept["near_dedup"] == {1000}
    assert kept["near_dedup"] - kept["decontamination"] == {1001}
    assert kept["packing"] == kept["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == kept["packing"]


LABELS = "doc_id long, quality int, toxic int"


def save(spark, d, docs, labels, items, clashes=False):
    df = spark.createDataFrame(docs, SCHEMA)
    (with_clashes(df) if clashes else df).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_rows_against_the_stages_by_brute_force(spark, tmp_path):
    """Every stage's rows, with repeated ids, null ids, long texts and clashing columns, against plain Python over the same input."""
    rng = random.Random(13)
    docs = [r for r in test_neardup.noisy_copies() if r[0] != 104] + [(104, prose(rng, 9), "en", "s", 1)] * 2
    docs += [(9000 + i, prose(rng, 50) + " " + " ".join(rng.sample(BAD, 2)), "en", "bad", 1) for i in range(60)]
    docs += [(9500, prose(rng, 60_000), "en", "long", 1), (9600, "the of and " * 9, "zz", "unlearned", 1)]
    passage = " ".join(f"bench{k}" for k in range(20))
    docs += [(9700 + i, prose(rng, 3 + 40 * i) + " " + passage, "en", "leak", 1) for i in range(12)]
    labels = [(r[0], 1, int(r[3] == "bad")) for r in docs if r[0] is not None]
    items = [(1, passage), (2, None), (3, "short one")]
    d = str(tmp_path / "sf")
    save(spark, d, docs, labels, items, clashes=True)
    now, names = spark.read.parquet(f"{d}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r)[:5] for r in now.collect()]
        out = stage(spark, now, d)
        if name == "packing":
            break
        assert out.columns == now.columns
        out.write.parquet(place := str(tmp_path / name))
        after = sorted((tuple(r)[:5] for r in spark.read.parquet(place).collect()), key=str)
        texts = pa.array([r[1] for r in before], pa.string())
        if name == "toxicity":
            model = toxicity.trained(now, spark.read.parquet(f"{d}/labels.parquet"), id_fold("doc_id", 5) != 0)
            want = [r for r, s in zip(before, model.scores(texts), strict=True) if s < 0.5]
            assert not [r for r in after if r[3] == "bad"] and len([r for r in before if r[3] != "bad"]) == len(after)
        elif name == "language":
            rows = langid.language_profiles(now, id_fold("doc_id", 3) != 1).collect()
            profiles = {}
            for r in rows:
                profiles.setdefault(r["lang"], {})[r["gram"]] = r["place"] - 1
            from tests.llm.test_language_and_toxicity import brute_language

            found = brute_language([(k, r[1]) for k, r in enumerate(before)], profiles)
            want = []
            for k, r in enumerate(before):
                declared = brute_language([(0, r[1])], {r[2]: profiles[r[2]]})[0][1] if r[2] in profiles else None
                if found[k][0] != "und" and (declared is None or declared >= found[k][1] - corpus_pipeline.LEAD):
                    want.append(r)
        elif name == "near_dedup":
            groups, want = {}, []
            for r, root, (_, n, *_) in zip(before, test_neardup.roots(before), test_neardup.in_order(before), strict=True):
                if r[0] is None or not n:
                    want.append(r)
                else:
                    groups.setdefault(root, []).append(r)
            alone = collections.Counter(want)
            rest = collections.Counter(after) - alone
            assert sum(rest.values()) == len(groups) and all(sum(rest[r] for r in set(g)) == 1 and {r[0] for r in g if rest[r]} == {min(r[0] for r in g)} for g in groups.values())
            want = after
        else:
            judged = [test_decontaminate.brute([r], items)[0] for r in before]
            want = [r for r, j in zip(before, judged, strict=True) if not j[5]]
        assert after == sorted(want, key=str), name
        now = spark.read.parquet(place)
    pieces, own = collections.defaultdict(list), Tokenizer.from_file(default_path())
    for r in corpus_pipeline.run(spark, d).collect():
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    sizes = collections.Counter()
    for r in now.collect():
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        sizes[r["doc_id"], len(ids)] += len(ids)
        for start, n, crc in pieces[r["doc_id"], len(ids)] if sum(1 for x in before if x[0] == r["doc_id"]) == 1 else []:
            assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + n]))
    assert {k: sum(n for _, n, _ in v) for k, v in pieces.items()} == sizes


@pytest.mark.parametrize("docs", [[], [(1, None, None, None, None), (None, "", "en", "s", 1)], [(5, "the same of it", "en", "s", 1)] * 4])
def test_small_tables(spark, tmp_path, docs):
    d = str(tmp_path / "sf")
    save(spark, d, docs, [], [])
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, d)
    # Of all tables that the stages and their operators wrote, the result alone is left.
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"fjordframe-packing"}
    got = sorted(((r["doc_id"], r["start"]) for r in out.collect()), key=str)
    # Nothing to learn a language from: no text goes for having none.
    assert set(got) == {(r[0], 0) for r in docs} and len(docs) < 4 or len({x[0] for x in got}) == 1


def test_stages_with_columns_of_any_name_and_type(spark, tmp_path):
    """Extra columns that only Spark can hold pass every stage up to packing."""
    rng = random.Random(4)
    docs = [(i, prose(rng, 60), "en", "s", None) for i in range(30)]
    d = str(tmp_path / "sf")
    save(spark, d, docs, [(i, 1, int(i % 5 == 0)) for i in range(30)], [(1, prose(rng, 20, "alpha beta gamma"))])
    odd = {"s t": F.struct(F.lit(1).alias("a b")), "x`y": F.lit("q"), "iv": F.expr("make_interval(0, 1, 0, 3)"), "dt": F.expr("INTERVAL '2' DAY")}
    table = spark.read.parquet(f"{d}/documents.parquet").withColumns(odd)
    for name, stage in corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[3:4]:
        out = stage(spark, table, d)
        assert out.columns == table.columns, name
        assert all(r["s t"]["a b"] == 1 and r["x`y"] == "q" for r in out.drop("iv").collect()), name
