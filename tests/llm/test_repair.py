import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from llm_helpers import seeded
from pyspark.sql import functions as F

from vitalstream.llm import repair
from vitalstream.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        out += [(c, t, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = VISIBLE.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_audit(rows, found):
    """The least (cost, audit) by comparing whole audits, from the last row backwards."""
    roles, accept = ["", "s", "u", "a"], {0, 3}
    follow = {0: "su", 1: "u", 2: "a", 3: "u"}
    best = [[(0, "") if s in accept else (99, "") for s in range(4)]]
    insert = lambda b: [min([b[s], *((2 + b[roles.index(x)][0], "I" + b[roles.index(x)][1]) for x in follow[s] if x != "s")]) for s in range(4)]
    for _ in range(3):
        best[0] = insert(best[0])
    for (_, _, role, _), fault in zip(reversed(rows), reversed(found)):
        ahead, here = best[0], []
        for s in range(4):
            ways = [(3 + ahead[s][0], "D" + ahead[s][1])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for x in follow[s]:
                    cost, audit = ahead[roles.index(x)]
                    if x != "s":
                        ways.append((2 + more + cost, "R" + audit))
                    if role[:1] == x:
                        ways.append((more + cost, "K" + audit))
            here.append(min(ways))
        for _ in range(3):
            here = insert(here)
        best.insert(0, here)
    return best[0][0]


def brute_summary(rows):
    found = faults(rows)
    cost, audit = brute_audit(rows, found)
    initials = [r[2][:1] for r in rows]
    state, turns, at = "", [], 0
    for letter in audit:
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[follow]
        if letter == "I":
            turns.append(f"{name}:")
            state = follow
            continue
        _, _, role, text = rows[at]
        at += 1
        if letter == "K":
            turns.append(f"{role}:{text}")
            state = role[0]
        elif letter == "R":
            turns.append(f"{name}:{text}")
            state = follow
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (
        gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(turns).encode()).hexdigest(),
    )


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {c: sorted(r, key=lambda x: (x[1] is not None, x[1] or 0)) for c, r in out.items()}


def conversations(rng, n, longest=9):
    rows = []
    texts = ["Yes.", "no", "Why?", " ", "", "ok!\n", "a.b", None, "long " * 30 + "."]
    for c in range(n):
        role = rng.choice(["user", "system"])
        for t in range(rng.randint(1, longest)):
            odd = rng.random()
            name = role if odd < 0.8 else rng.choice(["system", "user", "assistant", "tool", "", None, "ux"])
            rows.append((c, None if t == 0 and odd > 0.9 else 2 * t if odd > 0.7 else t + 100, name, rng.choice(texts) if odd > 0.3 else f"text {t}."))
            role = "assistant" if role == "user" else "user"
    # One row a turn and conversation, as ties are ordered by a hash.
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("block", [1, 4, 1 << 14])
def test_summaries_equal_brute_force(spark, block):
    rng = seeded(3)
    rows = conversations(rng, 60) + conversations(rng, 1, 150)[1:]
    rows = [*rows, (None, 1, "user", "Hi."), (None, 2, "assistant", "Hm."), (777, None, None, None)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({n: F.lit(1) for n in ("gid", "conv", "code", "block")})
    got = repair.summarise(repair.repair_conversations(df, block=block)).collect()
    want = {c: brute_summary(r) for c, r in by_conversation(filled).items()}
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_edits_give_back_rows_and_roles(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "Bye."), (1, 4, "user", "so")]
    got = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    # Deleting both faulty rows costs as much as two rerolings; D comes first.
    assert [r.place for r in got] == list(range(len(got)))
    assert [(r.turn, r.was_role) for r in got if r.edit != "I"] == [(t, role) for _, t, role, _ in rows]
    assert "".join(r.edit for r in got) == brute_audit(rows, faults(rows))[1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got if r.edit != "D"))


def test_copies_are_adjacent_and_deleted(spark):
    rows = [(1, 1, "user", "A?"), (1, 1, "user", "A?"), (1, 2, "assistant", "B."), (1, 2, "assistant", "B.")]
    got = repair.summarise(repair.repair_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert (got.audit, got.cost, got.duplicate, got.gaps, got.illegal) == ("KDKD", 6, 2, 0, 2)


def test_damage(spark):
    rows = [(c, t, None if t == 3 else "system", None if t == 2 else "A. B! c?") for c in (None, 1, 2, 3) for t in (None, *range(12))]
    got = repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_damage(rows)))


def test_query_returns_every_conversation(spark, tmp_path):
    rows = conversations(seeded(5), 80, 4) + [(c, 0, "user", "Hm.") for c in range(100, 160)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    hurt = by_conversation(brute_damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert len(set(r[0] for r in rows) - set(hurt)) > 0
    assert got == {c: brute_summary(hurt[c]) if c in hurt else empty for c in {r[0] for r in rows}}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(df).count() == 0
    assert repair.summarise(repair.repair_conversations(df)).count() == 0
    assert repair.damaged(df).count() == 0
    with pytest.raises(ValueError):
        repair.repair_conversations(df, block=3)
