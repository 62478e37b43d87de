"""The pipeline against a brute-force version of every stage."""

import os
from collections import Counter

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from test_mixing import brute_targets  # noqa: E402
from test_neardup import brute  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from stratapack.llm import pii, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    model = quality.train(docs, labels)
    rows = [r for r in rows if model.score(pa.array([r[1] or ""]))[0] >= 0.7]
    label = brute([(r[0], r[1]) for r in rows], 5)
    rows = [r for r in rows if label[r[0]] == r[0]]
    automaton = pii.build_automaton()
    text = {d: pii.redact_text(t, pii.find_spans(t, automaton)) for d, t, _ in rows}
    size = {d: len(text[d].split()) for d in text}
    per = Counter()
    for d, _, s in rows:
        per[s] += size[d]
    target = brute_targets(dict(per))

    got = corpus_pipeline.run(spark, SF).collect()
    times = Counter(r["doc_id"] for r in got)
    assert set(times) <= set(text) and max(times.values()) <= 3
    longest = Counter()
    for d, _, s in rows:
        longest[s] = max(longest[s], size[d])
    taken = Counter()
    for d, _, s in rows:
        taken[s] += times[d] * size[d]
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in per)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got:
        assert r["ids"] == lib.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "personal data", "source mix", "token ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
