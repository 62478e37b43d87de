"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are short licence wordings. An aggregate over all documents gives each key word's
document frequency; the index posts every template under the RAREST (highest-IDF) of them with their
places in the template. A file's licence words are looked up in the index, each hit proposes where
the template would start, and the proposals of a template's posted words are intersected. What is
left is verified: the key phrase word for word, the other places by relative position. The base phrases count wherever all their words stand in a row; the
longer wordings count from MIN_SHARE of their words in place, if their key phrase is there in full.

The words of a file are an array in its own row: nothing is exploded, joined or shuffled per word,
so a hot word or a very long file costs only its own row. Files in which some template word is
missing for every template are told apart by a plain search before any array is made.

Behaviour: null text counts as empty: 0 words, null positions, empty labels, score 0. Repeated rows
repeat their result. Overlapping places count each. An empty table gives an empty table (every IDF
is then equal and the first word is taken). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the lower-cased text, and of the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MIN_SHARE = 0.8
#: Key words under which a template is posted.
RAREST = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: Places [first, end) that must match word for word.
    key: tuple[int, int]
    base: bool = False


def template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, k = tuple(text.split()), key.split()
    at = next(i for i in range(len(words)) if list(words[i : i + len(k)]) == k)
    return Template(label, words, (at, at + len(k)), base)


TEMPLATES = (
    template("mit", "mit license", "mit license", True),
    template("apache", "apache license", "apache license", True),
    template("gpl", "general public license", "general public license", True),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source"),
    template("mpl", "mozilla public license", "mozilla public license"),
    template("isc", "isc license", "isc license"),
    template("cc-by", "licensed under cc by", "cc by"),
    template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    template("epl", "eclipse public license", "eclipse public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How many of all documents hold each template word, as one row of sums: one pass over each text for all words."""
    other = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    whole = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(rf"(?i)(?<={other}|\A)(?:{'|'.join(words)})(?={other}|\z)"), F.lit(0))
    texts = docs.select(F.array_distinct(F.transform(whole, lambda w: F.translate(w, UPPER, LOWER))).alias("words"))
    row = texts.agg(*[F.sum(F.array_contains("words", w).cast("long")).alias(f"w{i}") for i, w in enumerate(words)]).first()
    return {w: row[i] or 0 for i, w in enumerate(words)}


def _anchor(t: Template) -> str:
    """A word of the key phrase that a matching file must hold; the longest makes the plain search pass the most files by."""
    return max(t.words[t.key[0] : t.key[1]], key=len)


def _with_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, words: an empty array for files that can match no template."""
    anchors = "|".join(sorted({_anchor(t) for t in TEMPLATES}))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.when(text.rlike(f"(?i)(?:{anchors})"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(ANY_WORD)).cast("long").alias("n_words"), words.alias("words"))


def _share(words: Column, start: Column, t: Template) -> Column:
    """The share of a template's words that stand at their places from start on; 0 if the key phrase isn't whole."""
    key = F.array(*[F.lit(w) for w in t.words[t.key[0] : t.key[1]]])
    at = lambda i: F.when(start + i >= 0, F.get(words, start + i))
    same = sum((F.coalesce(at(i) == w, F.lit(False)).cast("int") for i, w in enumerate(t.words)), F.lit(0))
    return F.when((start + t.key[0] >= 0) & (F.slice(words, F.greatest(start + t.key[0] + 1, F.lit(1)), len(key_words(t))) == key), same / float(len(t.words))).otherwise(0.0)


def key_words(t: Template) -> tuple[str, ...]:
    return t.words[t.key[0] : t.key[1]]


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    d = _with_words(docs)
    vocabulary = sorted({w for t in TEMPLATES for w in key_words(t)})
    df = document_frequencies(docs, vocabulary)
    # The index: each template's rarest key words with their places; a match has all of them at one start.
    index = {n: sorted(range(*t.key), key=lambda i, t=t: (df[t.words[i]], i))[:RAREST] for n, t in enumerate(TEMPLATES)}
    posted = sorted({TEMPLATES[n].words[i] for n, places in index.items() for i in places})
    words = F.col("words")
    rare = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*posted))
    d = d.withColumn("hits", rare)
    matches = [F.transform(_starts(n, places), _match(words, n)) for n, places in index.items()]
    d = d.withColumn("found", F.when(F.size("hits") > 0, F.filter(F.flatten(F.array(*matches)), lambda m: m["share"] > 0)).otherwise(F.array().cast("array<struct<t: int, start: int, share: double>>")))
    base = [n for n, t in enumerate(TEMPLATES) if t.base]
    b = F.filter("found", lambda m: m["t"].isin(*base))
    own = F.filter("found", lambda m: ~m["t"].isin(*base) & (m["share"] >= MIN_SHARE))
    names = F.array(*[F.lit(t.label) for t in TEMPLATES])
    text = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: F.get(names, m["t"])))), ",")
    starts = F.transform(b, lambda m: m["start"])
    return d.select(
        "doc_id",
        "n_words",
        F.size(b).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        text(b).alias("base_labels"),
        text(F.concat(b, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def _starts(n: int, places: list[int]) -> Column:
    """Starts of a template that all its posted words agree on: their places intersected by relative position."""
    out = None
    for place in places:
        here = F.transform(F.filter("hits", _is(TEMPLATES[n].words[place])), _less(place))
        out = here if out is None else F.array_intersect(out, here)
    return out


def _is(word: str):
    return lambda h: h["w"] == word


def _less(place: int):
    return lambda h: h["i"] - place


def _match(words: Column, n: int):
    return lambda start: F.struct(F.lit(n).alias("t"), start.alias("start"), _share(words, start, TEMPLATES[n]).alias("share"))
