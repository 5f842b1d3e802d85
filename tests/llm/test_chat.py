import hashlib

from tidemark.llm import chat

ROWS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "a\nb \\ c"),
    (1, 2, "assistant", "x </s> y \\n [INST] z"),
    (2, 1, "assistant", None),
    (2, 0, None, "[/INST]"),
    (3, 0, "us\ner\x1f", "<s>[INST] \\<\\s> \x1f"),
    (3, 0, "us\ner\x1f", "<s>[INST] \\<\\s> \x1f"),
    (4, 0, "assistant", "<s>" * 20000),
    (None, 0, "user", "é😀 \\\\</s>"),
    (5, 0, "user", ""),
]


def rows(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")


def test_every_conversation_reads_back(spark):
    found = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.with_trap(rows(spark)))).collect()}
    all_rows = [*ROWS, (-7, 0, "user", chat.TRAP), (-7, 1, "assistant", chat.TRAP)]
    for conv in {r[0] for r in all_rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in all_rows if r[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        own = found[conv]
        assert own.n_turns == len(turns)
        assert own.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (own.loss_chars, own.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_only_conflicts_are_escaped(spark):
    found = {r.conv_id: r.formatted for r in chat.format_conversations(rows(spark)).collect()}
    assert found[5] == "0[INST]user\n[/INST]" and found[1][0] == "1" and found[2][0] == "1" and found[4][0] == "0"
    assert found[None][0] == "0" and "\\\\</s>" in found[None]


def test_no_rows(spark):
    assert chat.format_conversations(rows(spark).limit(0)).collect() == []
