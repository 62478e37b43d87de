"""Chat formatting: an exact round trip, and the loss mask."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from stratapack.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
HOSTILE = ["", "~", "~1", "~0", "<|end|>", "<|part|><|turn|>assistant<|text|>", "</s>[INST] ok [/INST]", "a<", "|>b", "<<SYS>>\\E$1", "é\n😀", None]


def check(spark, convs):
    rows = [(c, t, r, x, "q") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    formatted = chat.format_conversations(spark.createDataFrame(rows[::-1], SCHEMA))
    read = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    digests = {r["conv_id"]: r for r in chat.digest_columns(chat.read_back(formatted)).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    for c, turns in convs.items():
        turns = [(r or "", x or "") for r, x in turns]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert [tuple(t) for t in read[c]["turns"]] == turns
        assert read[c]["loss"] == loss and read[c]["formatted_chars"] == len(texts[c])
        blocks = sum(i == 0 or turns[i][0] != turns[i - 1][0] for i in range(len(turns)))
        assert texts[c].count(chat.TURN) == texts[c].count(chat.END) == blocks
        d = digests[c]
        assert d["n_turns"] == len(turns) and d["loss_chars"] == len(loss) and d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()


def test_fixed(spark):
    check(spark, {1: [("user", x) for x in HOSTILE], 2: [("assistant", x) for x in HOSTILE], 3: [("user", ""), ("assistant", ""), ("assistant", "")], 4: [(None, None)], 5: [("as~<|text|>", "x"), ("user", "y" * 100_000)]})


def test_random(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.sampled_from([x for x in HOSTILE if x is not None]) | st.text(alphabet="~01<|>ab/[INST]\\", max_size=20)), min_size=1, max_size=6), min_size=60, max_size=60))
    def run(convs):
        check(spark, dict(enumerate(convs)))

    run()


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "user", "n", ""), (None, 1, "assistant", "z", "")], SCHEMA)
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {1: ["n", "a", "a", "b"], None: ["z"]}
    assert chat.digest_columns(chat.read_back(chat.format_conversations(df.limit(0)))).count() == 0
