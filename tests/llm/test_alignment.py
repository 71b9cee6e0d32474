import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from fjordframe.llm import alignment
from fjordframe.llm.alignment import Aligner, aligned, cut_units, default_paths, intervals
from tests.llm.cases import SCHEMA, documents, with_clashes

ODD = [
    "a", " ", "  ", "\n", " x", "x ", "  two  spaces  ", "line\nbreak \n and\t tab", "it's we'll 'snow '' don't", "3.14 1234 a1b2", "é à café œuvre ﬁ x", "漢字 かな 😀 emoji", "<|endoftext|> <s> <0x41> <unk> </s>",
    "a▁b", "▁", "nbsp x   y　z  q", "\x00 \x1c \x85", "é ​ x", "x" * 400 + " " + "y" * 300, "a ſ b ƀ c", "punct!? , . ;: (a) [b] ", "ends in nl\n", "µ m", "▁ <|endoftext|>",
]


def plain(texts):
    """The contract word by word: tokens of whole texts, pairs of tokens compared one by one."""
    a, b = Tokenizer.from_file(default_paths()[0]), sentencepiece.SentencePieceProcessor(model_file=default_paths()[1])
    a.encode_special_tokens = True
    byte = {v: k for k, v in _symbols().items()}
    found = []
    for text in texts:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            found.append(None)
            continue
        spans = [[(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))] if len(x) < 300 else _spans(x) for x in (ba, bb)]
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for i, (_, e) in zip(ids, own, strict=True) if lo < e <= hi) for ids, own in ((ia, spans[0]), (ib, spans[1]))) for lo, hi in zip([0, *both], both)) if len(both) < 3000 else None  # noqa: B905
        links = [(i, j) for i, (p, q) in zip(ia, spans[0], strict=True) for j, (r, s) in zip(ib, spans[1], strict=True) if p < s and r < q] if len(ia) < 3000 else None
        found.append((ia, ib, both, groups, links))
    return found


def _spans(x):
    ends = np.cumsum([len(t) for t in x]).tolist()
    return list(zip([0, *ends], ends))  # noqa: B905


def _symbols():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


def expected(rows):
    parts = plain([t for _, t in rows])
    n = Counter(x for p in parts if p for x in p[4])
    best = Counter()
    for (_, b), c in n.items():
        best[b] = max(best[b], c)
    for (doc_id, _), p in zip(rows, parts, strict=True):
        if not p:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
            continue
        ia, ib, both, groups, links = p
        yield (doc_id, len(ia), len(ib), len(both), len(links), sum(n[x] == best[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(groups.encode()).hexdigest())


def test_aligned_against_pairs_of_tokens(spark):
    rows = [(r[0], r[1]) for r in documents(40) if r[0] != 105] + [(200 + k, t) for k, t in enumerate(ODD)]
    rng = random.Random(3)
    rows += [(300 + k, "".join(rng.choice("aé \n\t漢' 1.-xQ▁" if k % 7 else "aé \n\t漢' 1.-xQ") for _ in range(60))) for k in range(80)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    want = sorted(expected(rows), key=str)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for head in (alignment.HEAD, 50, 0):
        got = [tuple(r) for r in aligned(df, head=head).select(columns).collect()]
        assert sorted(got, key=str) == want


def test_full_memory_starts_anew(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in documents(20) if r[0] != 105]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(expected(rows), key=str)
    monkeypatch.setattr(alignment, "KEPT", 20)
    own, most, cleared = Aligner(*default_paths()), 0, 0
    for _, text in rows:
        before = len(own.place)
        most = max(most, len(set(own.places(cut_units(pa.array([text], pa.string()))).tolist())))
        assert len(own.place) <= max(20, most)
        cleared += len(own.place) < before
    assert cleared
    assert sorted((tuple(r) for r in aligned(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == want


def test_units_are_cut_where_both_tokenizers_cut():
    own = Aligner(*default_paths())
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choice("ab é  \n\t漢'1.,-ſ ") for _ in range(200)) for _ in range(60)]
    words = cut_units(pa.array(texts))
    raw = words.data.tobytes()
    for k, text in enumerate(texts):
        units = [raw[words.starts[i] : words.ends[i]].decode() for i in range(words.first[k], words.first[k + 1])]
        assert "".join(units) == " " + text and all(u.startswith(" ") for u in units)
        assert [i for u in units for i in own.a.encode(u, add_special_tokens=False).ids] == own.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in units for i in own.b.encode(u[1:])] == own.b.encode(text)


def test_intervals_by_hand():
    a, b, shared = intervals(np.array([2, 5, 6]), np.array([1, 2, 4, 6]))
    assert list(zip(a.tolist(), b.tolist(), shared.tolist(), strict=True)) == [(0, 0, False), (0, 1, True), (1, 2, False), (1, 3, False), (2, 3, True)]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert aligned(empty).collect() == []
    long = "water stone " * 200_000 + "x" * 50_000
    rows = aligned(spark.createDataFrame([(1, long), (1, long), (None, None)], "doc_id long, text string")).collect()
    one, two, none = sorted(rows, key=lambda r: r["n_a"], reverse=True)
    assert one == two and one["n_a"] > 400_000 and none["groups_sha256"] == "" and none["doc_id"] is None
    assert one["n_links"] >= max(one["n_a"], one["n_b"]) and one["n_groups"] <= min(one["n_a"], one["n_b"])
