"""Conversation repair against a plain recursion over all edits."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scorespark.llm import queries, repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
AFTER = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault) by going through all (row, state) from the end."""
    best = None
    for i in range(len(rows), -1, -1):
        now = {}
        for q in range(4):
            options = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
            if i < len(rows):
                role, text, fault = rows[i]
                c, a, t = best[q]
                options.append((c + 4, "D" + a, t))
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    if (q, role[:1]) in NEXT:
                        c, a, t = best[NEXT[q, role[:1]]]
                        options.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                    c, a, t = best[AFTER[q]]
                    options.append((c + 3 + more, "R" + a, (f"{ROLE[q]}:{text}", *t)))
            now[q] = min(options, default=(10**9, "", ()))
        for _ in range(4):
            for q in range(4):
                c, a, t = now[AFTER[q]]
                now[q] = min(now[q], (c + 3, "I" + a, (ROLE[q] + ":", *t)))
        best = now
    return best[0]


def brute(table):
    """Rows (conv_id, turn, role, text) to conv_id -> all columns."""
    after = {}
    for conv, turn, role, text in table:
        rows = after.setdefault(conv, [])
        do = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if do == 0:
            continue
        text = "" if do == 1 else "".join(c for c in text if c not in ".!?") if do == 2 else text
        rows += [(turn, "user" if do == 4 else role, text)] * (2 if do == 3 else 1)
    out = {}
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
            if fault:
                n[fault] += 1
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, said = cheapest(told)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(told, told[1:], strict=False)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


COLUMNS = "conv_id long, turn long, role string, text string, cost int, _key string, edits string"


def table(spark, path, rows):
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def told(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def odd_rows(seed=5, convs=60):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Well then.", "Well then.", "So it is!", "cut sho", " \n", "", None, "Why?\x0b ", "é 日本.", "ends. \x1c"])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    return rows


def test_repair_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op12_repair(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("most, window", [(4096, 32), (3, 32), (3, 2), (0, 1)])
def test_repair_of_odd_rows(spark, tmp_path, monkeypatch, most, window):
    """Also with conversations that are put together from windows of a few rows, in parts of a sort by ranges."""
    monkeypatch.setattr(repair, "MOST_ROWS", most)
    monkeypatch.setattr(repair, "WINDOW", window)
    rows = odd_rows()
    assert told(repair.repair_conversations(table(spark, str(tmp_path / "c"), rows))) == brute(rows)


def test_repair_of_one_hot_conversation(spark, tmp_path):
    """3000 rows of one conversation, all but one of one text: it is dealt to several tasks; equal rows are duplicates."""
    rng = random.Random(2)
    rows = [(7, k, ("user", "assistant")[k % 2], f"Text {k % 900}.") for k in range(3000)] + [(7, None, "user", "Hot.")] * 300
    rows += [(8, k, "user", rng.choice(["Yes.", "No."])) for k in range(5)]
    got = told(repair._long(repair.in_order(repair.damaged(table(spark, str(tmp_path / "c"), rows)))).withColumn("gaps", F.lit(0)).withColumn("conv_id", F.expr("bigint(substring(_key, 2))")))
    want = brute(rows)
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}


def test_repair_of_nothing(spark, tmp_path):
    assert told(repair.repair_conversations(table(spark, str(tmp_path / "c"), []))) == {}


def test_search_matches_brute_force():
    rng = random.Random(11)
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), "x", rng.choice([None, None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 10))]
        coded = [(r[:1], {None: repair.SOUND, "blank": repair.GONE, "truncated": repair.TRUNCATED}[f]) for r, _, f in rows]
        costs, edits = repair.window_moves(coded)
        found = min((costs[s] + repair.ENDS[s][0], edits[s] + repair.ENDS[s][1]) for s in repair.STATES) if rows else (0, "")
        assert found == cheapest(rows)[:2]
