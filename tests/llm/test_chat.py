from __future__ import annotations

import hashlib

from siltstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    found = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        found[c] = (len(turns), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)), len(loss), sha(loss))
    return found


def test_round_trip_with_small_windows(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "a\\", "", None, "é𝄞\n\n<", "|im_end|>", "<\\\\|x<|", "w " * 80, "\n"]
    rows = [(c, t, ["system", "user", "assistant", "us\\er\n<|", None][(t if t else 0 if c % 2 else 1) % 5], nasty[(c * 7 + t) % len(nasty)], 1) for c in range(6) for t in range(40)]
    rows += [(None, None, "assistant", "x", 1), (None, None, "assistant", "x", 1), (9, None, None, None, 1)]
    windows = chat.format_chats(spark.createDataFrame(rows, SCHEMA), stride=30, history=12)
    got = {r[0]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == brute(rows)
    assert windows.where("conv_id = 1 and new_from > 0").count() > 3
    for r in windows.where("conv_id = 1 and window > 0").collect():
        assert r.text.startswith("<|im_start|>system\n")


def test_empty(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def tokens(text):
    return sum(len(t.split("\n", 1)[1][: -len("<|im_end|>\n")].split()) + 4 for t in text.split("<|im_start|>")[1:])


def test_budget_holds_with_any_system_turn(spark):
    rows = []
    for c, n in enumerate([0, 1, 20, 46, 47, 300]):
        rows += [(c, 0, "system", "s " * n, 0)] + [(c, t, ["user", "assistant"][t % 2], "w " * ((t * 7 + c) % 23), 0) for t in range(1, 80)]
    rows += [(50, 0, "system", "s " * 10, 0), (50, 1, "user", "u " * 20, 0), (50, 2, "assistant", "long " * 400, 0), (50, 3, "user", "u " * 20, 0), (50, 4, "assistant", "ok", 0)]
    windows = chat.format_chats(spark.createDataFrame(rows, SCHEMA), stride=100, history=30)
    got = {r[0]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == brute(rows)
    over = [(r.conv_id, r.n_new) for r in windows.collect() if tokens(r.text) > 130]
    # Only turns that are too long by themselves: the system turn of 300 words, a turn of 400.
    assert sorted(over) == [(5, 1), (50, 1)]
    for c, n in enumerate([0, 1, 20, 46, 47, 300]):
        said = [r.text.startswith("<|im_start|>system\n") for r in windows.where(f"conv_id = {c}").collect()]
        assert all(said) if n <= 46 else sum(said) == 1


def test_nulls_come_before_negative_turns(spark):
    rows = [(1, t, "assistant", f"t{t}", 0) for t in (-300, None, -1, 0, 5, -70000)]
    windows = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    assert {r[0]: tuple(r)[1:5] for r in chat.read_back(windows).collect()} == brute([r if r[1] is not None else (1, -(10**9), *r[2:]) for r in rows])
