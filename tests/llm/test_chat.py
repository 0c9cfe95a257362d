import hashlib

from llm_helpers import EXTRA, seeded
from pyspark.sql import functions as F

from vitalstream.llm import chat
from vitalstream.llm.queries import op5_prefix_targets

NASTY = [
    "", None, "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|", "<|", "\\", "\\n\\-\n",
    "a\n\nb\n", "<<||>>", "é日<|x", "$1 \\1", "plain",
]


def conversations(rng):
    rows = []
    for c in range(30):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool\n<|im_end|>\\", None])
            rows.append((c, rng.choice([turn, turn, turn - 1, None]), role, rng.choice(NASTY)))
    return rows + [(None, 0, "assistant", "alone"), (None, 0, "user", "alone"), (None, 0, "user", "alone")]


def ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return [(r[2] or "", r[3] or "") for r in sorted(rows, key=key)]


def test_round_trip(spark):
    rows = conversations(seeded(1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in EXTRA})
    got = chat.read_chats(chat.format_chats(df)).collect()
    for r in got:
        turns = [(t.role, t.text) for t in r.turns]
        if r.conv_id is None:
            assert turns in ([("assistant", "alone")], [("user", "alone")])
            continue
        assert turns == ordered([x for x in rows if x[0] == r.conv_id])
        assert r.losses == [t for role, t in turns if role == "assistant"]
    assert len(got) == 33


def test_each_reply_has_its_whole_context(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t<|{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).orderBy("example").collect()
    whole = "".join(f"<|im_start|>{r}\nt<\\|{i}<|im_end|>\n" for _, i, r, _ in rows)
    assert [r.example for r in got] == [1, 3, 4]
    for r in got:
        assert whole.startswith(r.formatted) and r.formatted.count("<|im_end|>") == r.example + 1
    assert [r.loss_start is None for r in got] == [False, False, True]
    assert [r.formatted[r.loss_start : r.loss_end] for r in got[:2]] == ["t<\\|1", "t<\\|3"]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_chats(chat.format_chats(df)).count() == 0


def test_query(spark, tmp_path):
    rows = conversations(seeded(2))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op5_prefix_targets(spark, str(tmp_path)).collect()}
    for c in range(30):
        turns = ordered([x for x in rows if x[0] == c])
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")
