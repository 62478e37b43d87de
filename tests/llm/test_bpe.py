"""BPE against the tokenizers library, and decoding against its own tokens."""

import hashlib
import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from stratapack.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)

FIXED = [
    "", "  ", "Hello world's  café\n\nÀ 123 foo_bar!!", "x<|endoftext|>Y z", "a\x1cb \x85c​d", "日本語 🎉🎉", "İstanbul ΑΣ ΑΣ. ΣΑΣ",
    "é ạ̈", "<|endoftext|><|startoftext|>a<|x", "a" * 3000, "a\x0b\x0cb\rc", "a\x00\nb", "'S 'LL don't", "<|ENDOFTEXT|>", "the " * 20_000,
]


def random_texts(n=400):
    rng = random.Random(1)
    out = []
    for alphabet in ("abcdeéß日ñ'st 0-_\n😀<|>ﬁΣİ́\x1c", "aeinsthr "):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return out


def test_same_ids_as_the_library():
    texts = FIXED + random_texts()
    ids, ends = bpe.encode_texts(bpe.load(PATH), pa.array(texts))
    for i, t in enumerate(texts):
        want = LIB.encode(t, add_special_tokens=False).ids
        got = ids[ends[i] : ends[i + 1]].tolist()
        assert got == want, t[:80]
        assert bpe.load(PATH).decode(got) == LIB.decode(want, skip_special_tokens=False)


def test_backtracking_alone_gives_the_same_words():
    b = bpe.load(PATH)
    for w in ["thnterble", "ingleother", "été", "aaaaaaa", "ciónmente"]:
        assert b.encode_word(w) == LIB.encode(w, add_special_tokens=False).ids


def test_frame(spark):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, None), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(spark, df, PATH, with_ids=True).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    e = LIB.encode("Hello there", add_special_tokens=False)
    one = (1, len(e.ids), sha(" ".join(map(str, e.ids))), sha("hello</w> there</w>"))
    assert got == {one, (2, 0, sha(""), sha("")), (None, 0, sha(""), sha(""))}
    assert bpe.encode_documents(spark, df.limit(0), PATH).count() == 0


def test_long_text_in_parts(spark, monkeypatch):
    """A text cut at spaces has the digests of the whole, special tokens, runs of spaces and a long word included."""
    rng = random.Random(3)
    words = ["the", "", "thnterble", "a" * 300, "<|endoftext|>", "d'été", "x\u0301 \u0301y", "\n", "Ǆ"]
    text = " ".join(rng.choice(words) for _ in range(3000))
    whole = next(bpe.digests(PATH, True)(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})]))).to_pydict()
    assert whole["ids"][0] == LIB.encode(text, add_special_tokens=False).ids
    for size in (1, 50, 5000):
        monkeypatch.setattr(bpe, "PART", size)
        batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [text, None, ""]})
        got = pa.Table.from_batches(bpe.digests(PATH, True)(iter([batch]))).to_pydict()
        assert {k: v[:1] for k, v in got.items()} == whole and got["n_tokens"][1:] == [0, 0]
