"""Chat formatting against plain Python on awkward conversations, and the marks themselves on literal rows."""

from __future__ import annotations

import hashlib
import random

from tokscope.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, slice string, formatted int"
PIECES = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|nl|>", "<\\|", "<\\\\|", "<", "|", "\\", "\n", "é", "日本", "assistant", " ok ", "", "<|"]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    convs = {}
    for conv_id, turn, role, text, *_ in rows:
        convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv_id, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        trained = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv_id] = (len(turns), sha(said), len(trained), sha(trained))
    return out


def awkward():
    rng = random.Random(12)
    rows = [(1, None, None, "x", "a", 1), (1, 0, "a\nb", "<|x|> <\\| <|", None, 1), (1, 0, "a\nb", None, "", None), (1, 0, "a\nb", None, "", None)]
    rows += [(None, 3, "assistant", "é<|im_sep|>日本", "", 0), (None, 2, "assistant", "", "", 0), (2, 5, "assistant", "<", "", 0), (2, 5, "assistant", "|im_end|>", "", 0)]
    for conv in range(10, 60):
        for _ in range(rng.randint(1, 12)):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, -4]), rng.choice(["user", "assistant", "assistant", None, "<|im_end|>\n", "sys\ntem"]), text, "", 0))
    # longer than SLICE in one conversation: by turn number, and with turn numbers that repeat
    rows += [(70, i, "assistant" if i // 700 % 2 else "user", f"t{i} é<|", "", 0) for i in range(3000)]
    rows += [(71, i % 3 if i % 5 else None, "assistant" if i // 700 % 2 else "user", f"t{i} é", "", 0) for i in range(3000)]
    return rows


def test_equals_plain_python(spark):
    rows = awkward()
    chats = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(7))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(chats).collect()}
    assert got == brute(rows)


def test_marks_and_masks(spark):
    rows = awkward()
    out = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[None].formatted == "<|im_start|>assistant\n<|im_sep|>é<\\|im_sep|>日本<|im_end|>\n"
    assert out[2].formatted == "<|im_start|>assistant\n<<|im_sep|>|im_end|><|im_end|>\n"
    assert out[1].formatted == "<|im_start|>\nx<|im_end|>\n<|im_start|>a<|nl|>b\n<|im_sep|><|im_sep|><\\|x|> <\\\\| <\\|<|im_end|>\n"
    for r in out.values():
        data, at = r.formatted.encode(), 0
        assert data.startswith(b"<|im_start|>") and data.endswith(b"<|im_end|>\n")
        for start, end in r.loss_spans:
            assert at <= start <= end and b"<|" not in data[start:end]
            at = end
            assert data[:start].endswith((b"<|im_sep|>", b"\n")) and data[end:].startswith((b"<|im_sep|>", b"<|im_end|>"))
    # one message for a run of turns of one role, also over the borders of chunks
    assert out[70].formatted.count("<|im_start|>") == 5 and out[70].formatted.count("<|im_sep|>") == 2995


def test_long_text_and_empty_table(spark):
    long = "<|" * 200_000 + "\\" * 200_000
    df = spark.createDataFrame([(1, 0, "assistant", long, "", 0), (1, 1, "user", long, "", 0)], SCHEMA)
    r = chat_format.digests(chat_format.format_chats(df)).collect()[0]
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(long), sha(long))
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).collect() == []


def test_registered_query_adds_the_tricky_conversation(spark):
    r = [r for r in chat_format.op12_chat_format(spark, "/root/testdata/sf0.001").collect() if r.conv_id == -1]
    assert [(x.n_turns, x.loss_chars, x.loss_sha256) for x in r] == [(2, 34, sha(chat_format.TRICKY))]


def test_no_python_on_the_main_path(spark, capsys):
    chat_format.op12_chat_format(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" in plan
