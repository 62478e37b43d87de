"""BPE encoding and decoding by backtracking over longest token matches.

A word's exact merge result is the only token sequence in which every neighbouring pair could have
survived merging. The encoder takes the longest token at each place, found by an Aho-Corasick
automaton over the whole vocabulary, and steps back to the next shorter one whenever the pair with
its left neighbour isn't compatible. A bit per position marks dead ends, so each is tried once and
the work stays linear in the word. Compatibility of a pair is settled by undoing both tokens' last
merges in order of rank and kept in a table. Decoding slices an offset table over one blob of tokens.

Behaviour: null and empty texts give no tokens; a text of any length is processed whole, a long one in
parts of about PART bytes cut at a space, which no token or normalisation crosses, so memory follows
PART (or the longest run without a space) and the ids; rows are independent, so repeated rows repeat
their result, and an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from stratapack.llm.common import ragged, slices, start, strings

#: Pairs a worker keeps in its compatibility table; a full table is emptied, which changes speed only.
PAIRS = 2_000_000
#: Backtracked words a worker remembers; a full cache is emptied likewise.
WORDS = 500_000
#: Bytes of text encoded at once.
PART = 4 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


END = "\n"
LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4


def character_classes() -> np.ndarray:
    """The class of every code point, as the pre-tokenizer's pattern tells them apart."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(points[m.start()]), ord(points[m.end() - 1]) + 1
            out[a:b] = kind
    return out


def lower(text: str) -> str:
    """Lower case of each character by itself, without rules that look at its neighbours."""
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


class WordBpe:
    """An encoder and decoder for a byte-level vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = self.vocab | self.special
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        # The offset table: token i is blob[offsets[i]:offsets[i + 1]].
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.names])]).tolist()
        self.blob = "".join(self.names)
        # A word is a string of bytes, each as the character of that number, then the end mark: its
        # last symbol is the last byte fused with the mark.
        byte_of = {c: chr(b) for b, c in enumerate(byte_alphabet())}
        size = len(self.names)
        self.left, self.right, self.made = np.arange(size), np.arange(size), np.full(size, -1)
        merged: dict[int, int] = {}
        for r, (x, y) in enumerate(model["merges"]):
            a, b, made = self.vocab[x], self.vocab[y], self.vocab[x + y]
            merged.setdefault(a << 20 | b, r)
            if self.made[made] < 0:
                self.left[made], self.right[made], self.made[made] = a, b, r
        self.pair_keys = np.array(sorted(merged), np.int64)
        self.pair_rank = np.array([merged[k] for k in self.pair_keys.tolist()], np.int64)
        self.automaton = ahocorasick.Automaton()
        self.key_ids: dict[str, int] = {}
        self.length = np.zeros(len(self.names), np.int64)
        for name, i in self.vocab.items():
            ends = name.endswith(self.suffix) and name != self.suffix
            key = "".join([byte_of[c] for c in (name.removesuffix(self.suffix) if ends else name)]) + END * ends
            if self.made[i] >= 0 or len(key.rstrip(END)) == 1:  # other entries can't come out of merges
                self.automaton.add_word(key, i)
                self.key_ids[key] = i
                self.length[i] = len(key)
        self.automaton.make_automaton()
        self.shorter = self._shorter()
        self.hard: dict[str, bytes] = {}
        self.known, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)  # the pair-compatibility table, sorted
        self.classes = character_classes()

    def _shorter(self) -> np.ndarray:
        """For each token the next shorter token that is a prefix of it, -1 if none."""
        out = np.full(len(self.names), -1)
        for key, i in self.key_ids.items():
            n = len(key) - 1
            while n and key[:n] not in self.key_ids:
                n -= 1
            if n:
                out[i] = self.key_ids[key[:n]]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b can stand side by side in a merge result, pair by pair."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.known, key), max(len(self.known) - 1, 0))
        new = self.known[at] != key if len(self.known) else np.ones(len(key), bool)
        if new.any():
            fresh = np.unique(key[new])
            if len(self.known) + len(fresh) > PAIRS:
                fresh, self.known, self.fits = np.unique(key), np.zeros(0, np.int64), np.zeros(0, bool)
            keys = np.concatenate([self.known, fresh])
            order = np.argsort(keys, kind="stable")
            self.fits = np.concatenate([self.fits, self._fit(fresh >> 20, fresh & 0xFFFFF)])[order]
            self.known = keys[order]
            at = np.searchsorted(self.known, key)
        return self.fits[at]

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo both tokens' merges at the seam, the later first (of equals the right one), down to
        symbols; if on the way the seam's pair has a merge that would have come before the one just
        undone, the pair can't last."""
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 60)
        a, b = a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            key = x << 20 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            lost = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit[live])
            out[live[lost]] = False
            rx, ry = self.made[x], self.made[y]
            go = ~lost & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            left = rx > ry
            a[live], b[live] = np.where(left, self.right[x], x), np.where(left, y, self.left[y])
            limit[live] = np.where(left, rx, ry + 1)
        return out

    def backtrack(self, joined: str, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of a string that end with the mark, all a step at a time: tokens in order, and each one's word."""
        longest, length, shorter = np.full(len(joined) + 1, -1), self.length, self.shorter
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        hits = hits[np.argsort(length[hits[:, 1]], kind="stable")]  # of matches that begin together the longest is set last
        longest[hits[:, 0] + 1 - length[hits[:, 1]]] = hits[:, 1]
        dead, chosen, back = np.zeros(len(joined) + 1, bool), np.full(len(joined) + 1, -1), np.zeros(len(joined) + 1, np.int64)
        dead[ends - 1] = True  # the end mark alone is no symbol
        live, at, before, token = np.arange(len(begins)), begins.copy(), np.full(len(begins), -1), longest[begins]
        while len(live):
            x, prev, t = at[live], before[live], token[live]
            some = t >= 0
            to = np.where(some, x + length[t], 0)
            fit = some & ~dead[to]
            seam = np.flatnonzero(fit & (prev >= 0))
            fit[seam] = self.compatible(prev[seam], t[seam])
            go, step = live[fit], to[fit]
            chosen[x[fit]], back[step] = t[fit], x[fit]
            at[go], before[go], token[go] = step, t[fit], longest[step]
            miss = some & ~fit
            token[live[miss]] = shorter[t[miss]]
            pop = live[~some]
            if len(pop):
                dead[at[pop]] = True
                start = back[at[pop]]
                token[pop], at[pop] = shorter[chosen[start]], start
                chosen[start] = -1
                inner = start > begins[pop]
                before[pop] = np.where(inner, chosen[back[start]], -1)
            live = live[at[live] < ends[live]]
        # What is left of choices beyond a step back is off the path: walk from the ends.
        path, owner, x = [], [], ends.copy()
        word = np.arange(len(begins))
        while len(word):
            x = back[x]
            path.append(x)
            owner.append(word)
            on = x > begins[word]
            x, word = x[on], word[on]
        place, owner = np.concatenate([*path, np.zeros(0, np.int64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
        order = np.argsort(place, kind="stable")
        return chosen[place[order]], owner[order]

    def encode_word(self, word: str) -> list[int]:
        """The merge result of one pre-token (already normalised), by backtracking alone."""
        s = word.encode().decode("latin-1") + END
        return self.backtrack(s, np.array([0]), np.array([len(s)]))[0].tolist()

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Many words at once: all their tokens and where each word's begin (one more for the end).

        One pass of the automaton takes the longest token at each place. Words whose neighbours all
        fit have their result; a sequence that covers the word and fits throughout is the only one.
        The others are backtracked.
        """
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words), END)[0].as_buffer().to_pybytes().decode("latin-1") + END
        starts = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)])
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(joined)), np.int64).reshape(-1, 2)
        ids, begins = found[:, 1], found[:, 0] + 1 - self.length[found[:, 1]]
        owner = np.searchsorted(starts, begins, side="right") - 1
        covered = np.bincount(owner, weights=self.length[ids], minlength=n) == np.diff(starts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fit = self.compatible(ids[inner], ids[inner + 1])
        covered[owner[inner[~fit]]] = False
        good = covered[owner]
        ids, owner = ids[good], owner[good]
        bad = np.flatnonzero(~covered)
        if len(bad):
            hard = [joined[x:y] for x, y in zip(starts[bad].tolist(), starts[bad + 1].tolist(), strict=True)]
            new = [w for w in hard if w not in self.hard]
            if new:
                if len(self.hard) + len(new) > WORDS:
                    self.hard.clear()
                    new = hard
                cut = np.concatenate([[0], np.cumsum([len(w) for w in new])])
                more, of = self.backtrack("".join(new), cut[:-1], cut[1:])
                each = np.split(more.astype(np.int32), np.searchsorted(of, np.arange(1, len(new))))
                self.hard.update(zip(new, map(np.ndarray.tobytes, each), strict=True))
            got = [self.hard[w] for w in hard]
            ids = np.concatenate([ids, np.frombuffer(b"".join(got), np.int32)])
            owner = np.concatenate([owner, np.repeat(bad, [len(x) // 4 for x in got])])
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        counts = np.bincount(owner, minlength=n)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces without spaces and special tokens: their tokens and where each piece's begin."""
        texts = pieces.to_pylist()
        hard = pc.match_substring(pieces, "'").to_numpy(zero_copy_only=False)  # contractions take the pattern itself
        plain = pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~plain | hard).tolist():
            p = texts[i] if unicodedata.is_normalized("NFC", texts[i]) else unicodedata.normalize("NFC", texts[i])
            p = lower(p)
            texts[i] = "\n".join(self.pattern.findall(p)) if hard[i] else p
        # A record mark closes each piece; it is no part of a word.
        joined = "\x00\n".join(["", *texts, ""])[2:] if texts else ""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        closing = np.flatnonzero((points[:-1] == 0) & (points[1:] == 10)) if len(points) else np.zeros(0, np.int64)
        if len(closing) != len(texts):  # a text holds the mark itself: cut piece by piece
            cut = [self.pattern.findall(lower(unicodedata.normalize("NFC", p))) for p in pieces.to_pylist()]
            words = pa.array([w for ws in cut for w in ws], pa.string())
            per_piece = np.array([len(ws) for ws in cut], np.int64)
        else:
            kind[closing] = SPACE
            inner_line = kind == SPACE
            first = ~inner_line
            first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
            if hard.any():  # the words of pieces cut by the pattern are whole lines
                bounds = np.concatenate([[0], closing + 2])
                line_start = np.concatenate([[True], points[:-1] == 10])
                for i in np.flatnonzero(hard).tolist():
                    a, b = bounds[i], closing[i]
                    first[a:b] = line_start[a:b] & ~inner_line[a:b]
            at = np.flatnonzero(first)
            # A word ends where the next begins or white space comes first.
            gaps = np.flatnonzero(inner_line)
            nxt = np.concatenate([at[1:], [len(points)]])
            pos = np.searchsorted(gaps, at)
            ends = np.minimum(nxt, gaps[np.minimum(pos, len(gaps) - 1)])
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            byte_at = np.concatenate([[0], np.cumsum(width)])
            raw = np.frombuffer(joined.encode(), np.uint8)
            keep = ragged(byte_at[at], byte_at[ends] - byte_at[at])
            offsets = np.concatenate([[0], np.cumsum(byte_at[ends] - byte_at[at])]).astype(np.int32)
            words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[keep])))
            per_piece = np.diff(np.searchsorted(at, np.concatenate([[0], closing + 2])))
        coded = words.dictionary_encode()
        ids, begins = self.encode_words(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(begins)[index]
        out = ids[ragged(begins[:-1][index], sizes)]
        word_ends = np.concatenate([[0], np.cumsum(sizes)])
        return out, word_ends[np.concatenate([[0], np.cumsum(per_piece)])]

    def encode_piece(self, piece: str) -> list[int]:
        """A text without special tokens, cut by the pattern itself."""
        return self.encode_words(pa.array(self.pattern.findall(lower(unicodedata.normalize("NFC", piece))), pa.string()))[0].tolist()

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special tokens' strings count as those tokens."""
        out: list[int] = []
        at = 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            out += self.encode_piece(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.encode_piece(text[at:])

    def decode(self, ids: list[int]) -> str:
        o, blob = self.offsets, self.blob
        return " ".join([blob[o[i] : o[i + 1]] for i in ids])


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_texts(bpe: WordBpe, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens and where each text's begin (one more for the end)."""
    special = pc.match_substring_regex(texts, "|".join(map(re.escape, bpe.special))) if bpe.special else pa.array([False] * len(texts))
    odd = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
    lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(pc.if_else(special, "", texts)), "\n", " "), " ")
    coded = lists.flatten().dictionary_encode()
    ids, begins = bpe.encode_pieces(coded.dictionary)
    index = coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    sizes = np.diff(begins)[index]
    ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    out = ids[ragged(begins[:-1][index], sizes)]
    if odd:  # texts with special tokens
        cut = np.split(out, ends[1:-1])
        for i in odd:
            cut[i] = np.array(bpe.encode(texts[i].as_py()), np.int32)
        out, ends = np.concatenate(cut), np.concatenate([[0], np.cumsum([len(x) for x in cut])])
    return out, ends


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts as they are, or the parts of a single long one, cut at spaces."""
    if len(texts) != 1 or len(texts[0].as_buffer()) <= PART:
        yield texts
        return
    whole, at = texts[0].as_buffer().to_pybytes(), 0
    while at < len(whole):
        cut = whole.find(b" ", at + PART)
        to = len(whole) if cut < 0 else cut
        yield pa.array([whole[at:to].decode()], pa.string())
        at = to


def digests(path: str, ids_out: bool = False):
    """A mapInArrow function: doc_id, text to the digest columns, and ids if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        names = pa.array(bpe.names, pa.string())
        numbers = pa.array([str(i) for i in range(len(bpe.names))], pa.string())
        for b in slices(batches, "text", PART):
            cols = {"doc_id": b.column("doc_id")}
            found, sizes = [[hashlib.sha256() for _ in range(b.num_rows)] for _ in range(2)], np.zeros(b.num_rows, np.int64)
            kept = []
            for part in parts(strings(b.column("text"))):
                ids, ends = encode_texts(bpe, part)
                at = pa.array(ends.astype(np.int32))
                for digest, table in zip(found, (numbers, names), strict=True):
                    joined = pc.binary_join(pa.ListArray.from_arrays(at, table.take(pa.array(ids))), " ")
                    for i, x in enumerate(joined):
                        if sizes[i] and ends[i + 1] > ends[i]:
                            digest[i].update(b" ")
                        digest[i].update(x.as_buffer())
                sizes += np.diff(ends)
                kept.append(ids)
            cols["n_tokens"] = pa.array(sizes)
            for name, digest in zip(("ids_sha256", "decoded_sha256"), found, strict=True):
                cols[name] = pa.array([x.hexdigest() for x in digest], pa.string())
            if ids_out:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, digests of the ids and of the decoded text.

    with_ids adds the ids themselves. One map over the rows; nothing is shuffled.
    """
    start(spark)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(digests(path, with_ids), schema)
