import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import chat
from leafmill.llm.queries import op2_chat

NASTY = st.lists(st.sampled_from(list("<|[]\\/ aIé") + ["INST]", "s>", "end|>", "turn", "text|>", "<|end|>", "SYS>>"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(NASTY, st.lists(NASTY, max_size=3), st.booleans())
def test_escaping_is_reversible_and_complete(role, texts, image):
    visitor = chat.PartVisitor(chat.Expansion())
    for t in texts:
        visitor.visit({"kind": "text", "text": t})
    if image:
        visitor.visit({"kind": "image", "uri": "u", "width": 1, "height": 1})
        visitor.visit({"kind": "text", "text": "after"})
    visitor.finish()
    body = "".join(visitor.pieces)
    line = chat.TURN + chat.escape(role) + chat.TEXT + body + chat.END
    want = "".join(texts) + ("<|image|>after" if image else "")
    if not image:
        assert "<|" not in body and "[INST]" not in body and "</s>" not in body and "<s>" not in body
        assert chat.read_turns(line * 2) == [(role, want)] * 2
    learned = "".join(chat.unescape(body[s:e]) for s, e in visitor.spans)
    assert learned == "".join(texts) + ("after" if image else "")


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256(every.encode()).hexdigest(),
            len(learned),
            hashlib.sha256(learned.encode()).hexdigest(),
        )
    return out


def digest(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    got = op2_chat(spark, sf)
    assert digest(got) == brute(rows + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)])


@pytest.mark.parametrize("part_chars", [10, 1_000_000])
def test_odd_rows_in_parts(spark, part_chars):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a <|end|>"), (1, 2, "assistant", "b"), (1, None, None, None),
        (2, 0, "assistant", "x" * 100_000), (2, 1, "assistant", ""), (None, 1, "user", "no id"), (3, 0, "system", "é😀"),
    ] + [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.selectExpr("*", "turn as part", "role as formatted", "1 as n_turns")
    out = chat.format_conversations(chat.with_parts(turns), part_chars=part_chars)
    assert digest(chat.read_back(out, in_order=True)) == brute(rows)
    assert digest(chat.read_back(out.repartition(5))) == brute(rows)
    if part_chars == 10:
        assert out.where("conv_id = 9").count() > 50
    empty = chat.format_conversations(chat.with_parts(turns.limit(0)))
    assert empty.count() == 0 and chat.read_back(empty, in_order=True).count() == 0


def test_typed_parts(spark):
    parts = [
        ("text", "look: ", None, None, None, None, None), ("image", None, "s3://i", 1024, 513, None, None),
        ("text", "and hear", None, None, None, None, None), ("audio", None, "a.wav", None, None, 2.02, None),
        ("document", None, "d.pdf", None, None, None, 3),
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|turn|>assistant<|text|>look: <|image|>and hear<|audio|><|document|><|end|>"
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["look: ", "and hear"]
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == [("image", "s3://i", 85 + 170 * 4), ("audio", "a.wav", 51), ("document", "d.pdf", 3000)]
    assert all(r.formatted.startswith(f"<|{a.kind}|>", a.at) for a in r.attachments)
    assert r.expanded_tokens == sum(a.tokens for a in r.attachments)
    with pytest.raises(ValueError):
        chat.PartVisitor(chat.Expansion()).visit({"kind": "video"})
