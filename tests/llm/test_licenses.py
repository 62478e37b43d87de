"""License scans against a plain search for the phrases."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stratapack.llm import licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def brute_labels(text):
    """Every template at every start: labels and the highest share of words in place."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, score = set(), 0.0
    for t in licenses.TEMPLATES:
        first, end = t.key
        for start in range(-first, len(words)):
            if tuple(words[start + first : start + end]) != t.words[first:end]:
                continue
            share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)) / len(t.words)
            score = max(score, share)
            if t.base or share >= licenses.MIN_SHARE:
                labels.add(t.label)
    return ",".join(sorted(labels)), score


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(spark, df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert (r["labels"], r["score"]) == brute_labels(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    return got


def test_fixed(spark):
    got = check(spark, [
        "", None, "Released under the MIT License.", "mit\nLICENSE mit-license", "Apache License", "the GNU General  Public, License version 3", "mit licenses", "licenSe Kelvin MİT license",
        "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "redistribution and use in source and binary forms with or without modification", "license",
        "word " * 30_000 + "mit license", "license license general public license",
    ])
    assert got[8]["labels"] == "apache,apache-2.0" and "cc-by-nc" in got[9]["labels"] and got[10]["labels"] == "bsd"
    assert got[2]["score"] == 1.0 and got[0]["score"] == 0.0


def test_random(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.lists(st.sampled_from("mit license License apache general public GPL é x1 2 - . \n".split(" ")), max_size=25).map(" ".join), min_size=150, max_size=150))
    def run(texts):
        check(spark, texts)

    run()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(spark, df).count() == 0


def test_frequencies_cover_all_files(spark):
    """Files that can match no template count too, by whole words in any case."""
    texts = ["General by", "by-the-by", "generally bye", "é general", "égeneral 2general general2", "GENERAL\n", "mozilla public license", "general public license", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = sorted({w for t in licenses.TEMPLATES for w in licenses.key_words(t)})
    got = licenses.document_frequencies(df, words)
    split = [{w.lower() for w in re.findall(licenses.ANY_WORD, t or "")} for t in texts]
    assert got == {w: sum(w in s for s in split) for w in words}
    assert (got["general"], got["by"], got["public"]) == (4, 2, 2)


def test_damaged_wordings(spark):
    """Templates whole, cut, with words changed or put twice, in other text."""
    rng, texts = random.Random(5), []
    for t in licenses.TEMPLATES * 6:
        w = list(t.words)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["other", "license", "public", *t.words])
        w = w[rng.randrange(2) * rng.randrange(len(w)) :]
        texts.append(" ".join([*["license x public"] * rng.randrange(3), *w, *t.words[: rng.randrange(len(w) + 1)]]).title())
    check(spark, texts)
