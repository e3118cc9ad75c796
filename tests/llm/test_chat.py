import hashlib

from tillroll.llm import chat, queries
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def expected(rows):
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, []).append((-2 ** 63 if turn is None else turn, role or "", text or ""))
    out = {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_all_conversations(spark, small):
    rows = [*small("conversations", "conv_id, turn, role, text"),
            (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert got(queries.op1_chat_formatting(spark, SF_SMALL)) == expected(rows)


def test_controls_nulls_ties(spark):
    nasty = ["<s>", "</s>", r"<\/s>", r"<\\\s>", "[INST][/INST]", "<<s>", "[[INST]", "a\nb", "", None, "<", "\\", "é𝄞</s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(nasty)]
    rows += [(2, 0, "to\\ol\n</s>", "x", None), (2, 0, "to\\ol\n</s>", "x", None), (2, None, None, None, None),
             (None, 1, "assistant", "only", None), (3, 0, "user", "no reply", None)]
    ex = chat.expand(spark.createDataFrame(rows, SCHEMA))
    assert got(chat.digests(ex)) == expected(rows)
    for r in ex.collect():
        masked = r["formatted"][r["loss_start"]:r["loss_start"] + r["loss_chars"]]
        assert "</s>" not in masked and "[/INST]" not in masked
        assert r["formatted"].endswith("</s>" if r["target_turn"] is not None else "[/INST]")
    targets = sorted(r["target_turn"] for r in ex.where("conv_id = 1 and target_turn is not null").collect())
    assert targets == [1, 3, 5, 7, 9, 11]
    # every context is a prefix of the next example
    texts = [r["formatted"] for r in ex.where("conv_id = 1").orderBy("n_turns").collect()]
    assert all(b.startswith(a) for a, b in zip(texts, texts[1:]))


def test_empty(spark):
    assert chat.digests(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0
