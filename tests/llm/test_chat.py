import hashlib
from itertools import groupby

from weirflow.llm import chat


def brute(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    t = sorted((n if n is not None else -(10**9), r or "", x or "") for n, r, x in turns)
    loss = "".join(x for _, r, x in t if r == "assistant")
    whole = "".join(
        chat.START + esc(role) + chat.TEXT + chat.MORE.join(esc(x) for _, _, x in g) + chat.END for role, g in groupby(t, key=lambda x: x[1])
    )
    return len(t), sha("".join(f"{r}\n{x}\n" for _, r, x in t)), len(loss), sha(loss), len(whole)


NASTY = ["", None, "<|end|>", "\\", "\\\\<|", "<\\|", "<|start|>assistant<|text|>x<|end|>", "a\\<|more|>\\", "🙂 漢\n\n", "$1 \\$2", "<<||>>", "\\### Assistant: </turn> ok"]


def test_round_trip_equals_brute_force(spark, rng):
    rows = [(c, k, rng.choice(["user", "assistant", "system", None, "<|end|>"]), rng.choice(NASTY), "other") for c in range(60) for k in range(rng.randrange(1, 14))]
    rows += [(100, 1, "user", "b", ""), (100, 1, "user", "a", ""), (100, 1, "user", "a", ""), (None, 0, "assistant", "lost", ""), (101, None, "assistant", None, None), (102, 0, "assistant", "x" * 100_000 + "<|", "")]
    rows += [(103, k, "assistant" if k % 3 else "user", f"turn {k}", "") for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    want = {c: brute([r[1:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    got = {r.conv_id: tuple(r)[1:] for r in chat.op8_rows(df).collect()}
    assert got == want


def test_probe_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.op8_rows(chat.with_probe(df)).collect()}
    said = "\\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(said)
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_neighbours_of_one_role_become_one_message(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat.format_turns(df).first()
    assert row.formatted == "<|start|>user<|text|>a<|more|>b<|end|><|start|>assistant<|text|>c<|end|>"
    assert [row.formatted[m.start : m.end] for m in row.loss_mask] == ["c"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.op8_rows(df).count() == 0
