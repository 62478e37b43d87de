"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over each whole text and stops at anchors only: at-signs,
digits and plus signs, URL schemes, and cues of an identifier ("iban", "account", ...), both in any
case. A deterministic local parser per anchor then expands to the boundaries and validates:

* email: from an at-sign to the left over local-part characters, to the right over a dotted domain;
* ip, card, phone: the run of digits and their separators around a digit or plus, cut by each kind's
  own grammar, then part range, Luhn sum or digit count;
* url: from a scheme over the address's characters, without closing punctuation;
* account: from a cue over separators; the cue says what is valid. After "iban" and "account" an IBAN, in
  one token or in groups, is told by its country's length and the mod-97 sum and ends where they say;
  after "iban" nothing else is valid. "ssn": nine digits, whole or in groups of 3, 2 and 4, without the
  numbers that are never given out. "passport": six to ten letters and digits (the tenth its check digit) with three digits or
  more. "account", "acct" and "user id": a token of letters, digits and hyphens, or the groups of 2 to 6
  characters printed with single spaces or hyphens between them, whichever is longer, of five
  characters or more (three for a user id) with a digit, not all the same. Groups of letters alone end
  it. Numbers without a cue aren't looked for.

Base kinds are email, ip, card and phone; url and account are this method's own and never change
the base spans. Spans are in code points, end exclusive.

Behaviour: null text counts as empty and has no spans; a text of any length is processed whole in
one pass, in time that grows with its length, whatever it holds; rows are independent, so repeated rows repeat their result; an empty table gives an empty
table; extra columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import slices, start, strings, text_or_empty

KINDS = ("email", "ip", "card", "phone")
OWN_KINDS = ("url", "account")
ORDER = {k: i for i, k in enumerate((*KINDS, *OWN_KINDS))}

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "ssn", "passport", "user id")
#: Characters of an IBAN by country.
IBAN_SIZES = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
        "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMERIC = re.compile(r"[0-9.()+\x20-]+")
DIGITS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ADDRESS = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
SEPARATOR = re.compile(r"[\x20:#=.]+(?:(?:no|number)[\x20:#=.]+)?", re.IGNORECASE)
TOKEN = re.compile(r"[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*(?!-*[A-Za-z0-9])")
GROUPS = re.compile(r"(?=[A-Za-z]{0,5}[0-9])[A-Za-z0-9]{2,6}(?:[\x20-](?=[A-Za-z]{0,5}[0-9])[A-Za-z0-9]{2,6}(?![A-Za-z0-9]))+")
#: Nine digits, whole or 3-2-4: no area 000, 666 or 9xx, no group 00, no serial 0000.
SSN = re.compile(r"(?!000|666|9)[0-9]{3}[\x20-]?(?!00)[0-9]{2}[\x20-]?(?!0000)[0-9]{4}(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9])+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def iban_end(text: str, at: int) -> int:
    """Where the valid IBAN that begins here ends; 0 if there is none."""
    size = IBAN_SIZES.get(text[at : at + 2].upper())
    m = IBAN.match(text, at, at + 2 * size) if size else None
    if m is None:
        return 0
    end, held = at, []
    while end < m.end() and len(held) < size:
        if text[end] not in " -":
            held.append(text[end])
        end += 1
    if len(held) < size or (end < len(text) and text[end].isalnum()):
        return 0
    number = "".join(held[4:] + held[:4])
    return end if int("".join([str(int(c, 36)) for c in number])) % 97 == 1 else 0


def number_end(text: str, at: int, least: int) -> int:
    """Where the number of letters and digits that begins here ends, in one token or in groups; 0 if there is none."""
    one, many = TOKEN.match(text, at), GROUPS.match(text, at)
    ends = [one.end()] if one else []
    if many and sum(c not in " -" for c in many.group()) >= 6:
        ends.append(many.end())
    for end in sorted(ends, reverse=True):
        held = [c for c in text[at:end] if c not in " -"]
        if len(held) >= least and any("0" <= c <= "9" for c in held) and len(set(held)) > 1:
            return end
    return 0


def account_span(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The valid number of its cue's kind after a cue that ends here."""
    m = SEPARATOR.match(text, at)
    if m is None:
        return None
    begin, end = m.end(), 0
    if cue in ("iban", "account", "acct"):
        end = iban_end(text, begin)
    if cue == "ssn":
        found = SSN.match(text, begin)
        end = found.end() if found else 0
    elif cue == "passport":
        end = number_end(text, begin, 6)
        held = [c for c in text[begin:end] if c not in " -"]
        end = end if len(held) <= 10 and sum("0" <= c <= "9" for c in held) >= 3 else 0
    elif cue != "iban" and not end:
        end = number_end(text, begin, 3 if cue == "user id" else 5)
    return (begin, end) if end else None


def lowered(text: str) -> str:
    """Lower case, place for place; only the dotted capital I would become two characters."""
    return (text.replace("\u0130", "i") if "\u0130" in text else text).lower()


def build_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, kind in [("@", "@"), ("+", "n"), *((str(i), "n") for i in range(10)), *((s, "url") for s in SCHEMES), *((c, c) for c in CUES)]:
        a.add_word(k, (kind, len(k)))
    a.make_automaton()
    return a


def numeric_spans(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """ip, card and phone within a run that holds all their characters: none can cross its ends."""
    out = []
    for m in DIGITS.finditer(text, a, b):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):  # leftmost matches take the parts of a dotted run in fours
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, end, "ip"))
            at = end + 1
    for m in CARD.finditer(text, a, b):
        d = digits_of(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if text.find("+", a, b) >= 0:
        for m in PHONE.finditer(text, a, b):
            if 10 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans of one text, by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    numbers = emails = urls = accounts = 0  # where the last run or match of each ended
    for end, (kind, size) in automaton.iter(lowered(text)):
        at = end + 1 - size
        if kind == "n":
            if at >= numbers:
                numbers = NUMERIC.match(text, at).end()
                if numbers - at > 6:
                    out += numeric_spans(text, at, numbers)
        elif kind == "@":
            left = at
            while left > emails and text[left - 1] in LOCAL:
                left -= 1
            if left < at and (m := DOMAIN.match(text, end + 1)):
                emails = m.end()
                out.append((left, emails, "email"))
        elif kind == "url":
            if at >= urls and (m := ADDRESS.match(text, end + 1)):
                urls = end + 1 + len(m.group().rstrip(".,;:!?'\")]"))
                if urls > end + 1:
                    out.append((at, urls, "url"))
        elif at >= accounts and (not at or not text[at - 1].isalnum()) and (found := account_span(text, end + 1, kind)):
            accounts = found[1]
            out.append((*found, "account"))
    if len(out) > 1:
        out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, spans (start, end, kind) of all kinds. One map; nothing is shuffled."""
    start(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        for b in slices(batches, "text"):
            found = [find_spans(t, automaton) for t in strings(b.column("text")).to_pylist()]
            rows = [[{"start": x, "end": y, "kind": k} for x, y, k in f] for f in found]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "spans": pa.array(rows, pa.list_(SPAN))})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return d.mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])


def digest_columns(found: DataFrame) -> DataFrame:
    """The spans as counts, joined text and a digest of the base kinds."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, or run of overlapping spans, becomes its first kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span replaced; n_chars, where there is one, follows the text."""
    start(spark)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            done, changed = [], False
            for t in texts:
                spans = find_spans(t, automaton) if t else []
                changed |= bool(spans)
                done.append(redact_text(t, spans) if spans else t)
            if changed:
                at = b.schema.get_field_index("text")
                b = b.set_column(at, b.schema.field(at), pa.array(done, b.schema.field(at).type))
                if "n_chars" in names:
                    at = b.schema.get_field_index("n_chars")
                    kind = b.schema.field(at).type
                    b = b.set_column(at, b.schema.field(at), pc.if_else(pc.is_valid(b.column("text")), pc.utf8_length(b.column("text")).cast(kind), b.column("n_chars")))
            yield b

    return docs.mapInArrow(run, docs.schema)


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in KINDS).encode()).hexdigest()
