"""Secret scans: a keyword automaton first, regular expressions anchored at its hits, then embedded checksums.

One Aho-Corasick pass over the ASCII-lower-cased text finds where a pattern may begin, and where armour may close; each
pattern is then tried at those places only. The keywords of cards are the pairs of digits that a number may begin with.
Runs of hex digits have no keyword: one scan for long runs finds them. The method's own kinds carry a check of their
own contents: token families that end in a CRC-32 of their body, JSON web tokens whose header decodes to JSON with an
algorithm, card numbers that pass the Luhn sum, and armoured private keys that close as they open.

The work is in proportion to the text, whatever it repeats: a run of characters that many hits lie in is measured once,
and an opening finds its closing among the hits of the same pass. A header that is nested beyond what JSON readers take
is no token.

Defined results: a null text is empty. Spans count code points, end exclusive. A text without secrets has zero counts,
the digest of the empty string and an empty list of spans. Repeated rows each keep a row. Other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestrata.llm.common import map_rows, map_texts

# The base kinds of the contract, in its order, with their least lengths.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
# Formats with an embedded check.
CRC_TOKEN = re.compile(r"(?a:(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9]))")
JWT_PART = re.compile(r"(?a:[A-Za-z0-9_-]*)")
LEAST_JWT_HEAD = 11
ARMOUR = re.compile(r"-----(?:BEGIN|END) ((?:[A-Z]+ )*PRIVATE KEY)-----")
NOT_ARMOURED = re.compile(r"[^A-Za-z0-9+/=\s,:-]")
CARD = re.compile(r"(?a:(?<![0-9])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9]))")
KINDS = (*BASE, "crc_token", "jwt", "private_key", "card")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "crc_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "jwt": ("eyj",),
    "private_key": ("-----begin ",),
    "armour_end": ("-----end ",),
    "card": tuple(map(str, range(30, 70))),
}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _crc_ok(m: re.Match) -> bool:
    n, got = zlib.crc32(m[1].encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        got = DIGITS62[r] + got
    return got == m[2]


def _jwt_ok(head: str) -> bool:
    try:
        got = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(got, dict) and "alg" in got


def jwt_spans(text: str, at: list[int]) -> Iterator[tuple[int, int]]:
    """Three dotted runs, the first two of which begin like JSON, whose header decodes; a failing one takes its place too."""
    free, end, last = 0, -1, None
    for p in at:
        if p < free or not text.startswith("eyJ", p):
            continue
        if p >= end:  # all hits of one run share what follows it
            end, last = JWT_PART.match(text, p).end(), None
            if text.startswith(".eyJ", end):
                mid = JWT_PART.match(text, end + 1).end()
                if mid > end + 4 and text.startswith(".", mid) and (to := JWT_PART.match(text, mid + 1).end()) > mid + 1:
                    last = to
        if last is not None and end - p >= LEAST_JWT_HEAD:
            free = last
            if _jwt_ok(text[p:end]):
                yield p, last


def armour_spans(text: str, opens: list[int], closes: list[int]) -> Iterator[tuple[int, int]]:
    """From an opening line to the first closing one of the same label, with nothing but armoured text between."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for p in closes:
        if m := ARMOUR.match(text, p):
            ends.setdefault(m[1], []).append((m.start(), m.end()))
    free, odd = 0, -1
    for p in opens:
        if p < free or not (m := ARMOUR.match(text, p)) or m[1] not in ends:
            continue
        body = m.end()
        k = bisect.bisect_left(ends[m[1]], (body + 1, 0))
        if odd < body:
            found = NOT_ARMOURED.search(text, body)
            odd = found.start() if found else len(text)
        if k < len(ends[m[1]]) and ends[m[1]][k][0] <= odd:
            free = ends[m[1]][k][1]
            yield p, free


def luhn_ok(text: str) -> bool:
    d = [int(c) for c in reversed(text) if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(d[::2]) % 10 == 0 if not d[1::2] else (
        13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    )


PATTERNS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= LEAST_ASSIGN),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST_ACCESS),
    "crc_token": (CRC_TOKEN, _crc_ok),
    "card": (CARD, lambda m: luhn_ok(m[0])),
}


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans, by start and then by the order of kinds."""
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in words.iter(ascii_lower(text)):
        starts.setdefault(kind, []).append(end - n + 1)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found += [(s, e, "jwt") for s, e in jwt_spans(text, starts.get("jwt", []))]
    if "private_key" in starts:
        found += [(s, e, "private_key") for s, e in armour_spans(text, starts["private_key"], starts.get("armour_end", []))]
    for kind, (pattern, holds) in PATTERNS.items():
        free = 0
        for p in sorted(starts.get(kind, [])):
            if p >= free and (m := pattern.match(text, p)):
                free = m.end()  # a match that fails its check still takes its place
                if holds(m):
                    found.append((m.start(), free, kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the spans of all kinds, as `spans array<struct<kind,start,end>>`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = automaton()
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t, words)] for t in b["t"]]
            yield pd.DataFrame({id_col: b[id_col], "found": found})

    return map_texts(docs, run, "found array<struct<kind:string,start:bigint,end:bigint>>", id_col, text_col)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans, per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = automaton()
        for b in batches:
            rows = []
            for t in b["t"]:
                spans = scan(t, words)
                base = [x for x in spans if x[2] in BASE]
                rows.append((*(sum(x[2] == k for x in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, id_col, b[id_col].to_numpy())
            yield out

    return map_texts(docs, run, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", id_col, text_col)


def redact_text(text: str, words: ahocorasick.Automaton) -> str:
    """The text with each run of overlapping secrets replaced by the kind that opens it."""
    out, at = [], 0
    for s, e, k in scan(text, words):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, secrets replaced; `size_col`, where there is one, is recounted for changed texts."""

    def change(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        words = automaton()
        new = [redact_text(t, words) for t in texts]
        changed = [n != t for n, t in zip(new, texts, strict=True)]
        if any(changed):
            for name, values in ((text_col, new), (size_col, [len(n) for n in new])):
                if (i := b.schema.get_field_index(name)) >= 0:
                    old = b.column(i)
                    b = b.set_column(i, b.schema.field(i), pc.if_else(pa.array(changed), pa.array(values).cast(old.type), old))
        return b

    return map_rows(docs, text_col, change)
