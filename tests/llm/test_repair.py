import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fjordframe.llm import repair, sql
from fjordframe.llm.repair import damaged, ordered, repair_report, repaired
from tests.llm.cases import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(n=60, seed=2):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", "One. Two", "End. \n", "ÀÉ 漢字?", None]
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "usher", "sys"])
            rows.append((c, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.95 else None, role, rng.choice(texts)))
    rows += [(100 + c, t, ["user", "assistant"][t % 2], f"Line {t}.") for c in range(40) for t in range(6)]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi."), (500, None, "user", "a."), (500, None, "user", "a."), (500, 3, "user", "a.")]
    return rows


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """One conversation, all edits tried turn by turn with their initials."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.sha256((r[3] if r[3] is not None else " ").encode()).hexdigest()))
    rows = [(t, " " if role is None else role, " " if text is None else text) for _, t, role, text in rows]
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def put(to, state, item):
        if state not in to or item[:2] < to[state][:2]:
            to[state] = item

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, kept) in best.items():
            put(new, state, (cost + 4, audit + "D", kept))
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            for state, (cost, audit, kept) in best.items():
                for inserts in (0, 1, 2):
                    if inserts:
                        state = follows[state]
                        cost, audit, kept = cost + 3, audit + "I", (*kept, names[state] + ":")
                    for to in "sua":
                        if to == "s" and (state or role[:1] != "s") or to != "s" and follows[state] != to:
                            continue
                        own = role[:1] == to
                        put(new, to, (cost + more + (0 if own else 3), audit + ("K" if own else "R"), (*kept, f"{role if own else names[to]}:{text}")))
        best = new
    ends = []
    for state, (cost, audit, kept) in best.items():
        while state in ("s", "u"):
            state = follows[state]
            cost, audit, kept = cost + 3, audit + "I", (*kept, names[state] + ":")
        ends.append((cost, audit, kept))
    cost, audit, kept = min(ends)
    turns = [t for t, _, _ in rows if t is not None]
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))  # noqa: B905
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def expected(original, rows):
    for c in {r[0] for r in original}:
        yield (c, *plain([r for r in rows if r[0] == c]))


def same(df, want):
    assert sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bits", [repair.CHUNK_BITS, 1, 0])
def test_report_against_all_edits(spark, monkeypatch, bits):
    """Also with conversations of many chunks, of two rows and of one."""
    rows = conversations()
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    same(repair_report(damaged(df), df), expected(rows, hurt(rows)))


def test_report_without_damage_and_one_large_conversation(spark, monkeypatch):
    rng = random.Random(4)
    texts = [f"Text {k}{rng.choice(['.', '?', ''])}" for k in range(300)] + ["", "  "]
    rows = [(1, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(texts)) for k in range(900)] + [(2, 0, "user", "Same.")] * 500 + [(3, 0, "assistant", "A.")]
    monkeypatch.setattr(repair, "CHUNK_BITS", 5)
    df = spark.createDataFrame(rows, SCHEMA)
    same(repair_report(df, df), expected(rows, rows))


def test_long_chunks_of_one_width(spark):
    """The walk takes chunks of any size at once: one of thousands of rows beside small ones."""
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"{rng.random()}.") for k in range(3000)] + [(c, k, "user", f"{k}") for c in range(2, 30) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(repair_report(df, df), expected(rows, rows))


def test_repaired_turns_alternate(spark):
    rows = hurt(conversations(30, 8))
    out = repaired(ordered(spark.createDataFrame(rows, SCHEMA))).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r["conv_id"], []).append(r)
    for turns in by_id.values():
        kept = sorted((r for r in turns if r["position"] is not None), key=lambda r: r["position"])
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in kept))
        assert [r["position"] for r in kept] == list(range(len(kept))) and sum(r["position"] is None for r in turns) == 1


def test_same_rows_as_sql(spark):
    rows = [r for r in conversations(40, 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql.REPAIR})").fetchall()
    same(repair_report(damaged(df), df), found)


def test_nothing_left_and_empty_table(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)
    none = hashlib.sha256().hexdigest()
    same(repair_report(damaged(df), df), [(dropped, 0, 0, 0, 0, 0, 0, "", none)])
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_report(damaged(empty), empty).collect() == []


def test_choices_by_hand():
    """A user turn, then one of another role: rerole it at 3 rather than delete it and insert an answer at 7."""
    codes, repeats = np.array([[2 + 4, 0 + 4]]), np.zeros((1, 2), np.int64)
    choices = np.zeros((1, 2, 4), np.int64)
    first = repair.walked_back(codes, repeats, (3 * repair._LAST)[None, :, None].astype(np.int64), choices)[:, :, 0]
    edits, last = repair.traced(codes, first, choices)
    assert first[0, 0] >> repair._TIE_BITS == 3 and edits[0, 0].tolist() == [2, 3] and last[0, 0] == 3
