"""Secret scans: assignment-aware lexing of source and configuration syntax.

Besides three fixed patterns, texts are lexed into name-literal pairs (`lexing`). Constants are
carried from one assignment to the next, so a secret that is put together from parts, or passed on
through a harmlessly named constant, is reported where its literals stand. Whether literals are
reported depends on how sensitive the target's name is and on what they look like together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import text_table
from tapewright.llm.lexing import Expression, Lexer

#: Kinds of spans, in the order in which those with equal starts are listed. The first three are the fixed patterns.
KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: What stands before and after the colon of an address with a user.
USER = re.compile(r"://[^\s:/@\"'`<>]+:([^\s/@\"'`<>]+)@")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough

#: Stems of sensitive names and their weights.
STEMS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "api_key": 3, "api-key": 3,
    "accesskey": 3, "access_key": 3, "access-key": 3, "privatekey": 3, "private_key": 3, "private-key": 3, "credential": 2,
    "auth": 1, "authorization": 2, "signing_key": 3, "encryption_key": 3, "client_key": 2, "connection_string": 2,
}
#: Literals that only hold a place.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "redacted", "todo", "test", "xxxxxxxx", "your_password", "your_token", "your_api_key"}
STEM = re.compile("|".join(map(re.escape, sorted(STEMS, key=len, reverse=True))), re.IGNORECASE | re.ASCII)
STEM_BYTES = tuple(s.encode() for s in STEMS)
ASSIGN_BYTES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Beginnings of literals that stand for something else.
HOLDERS = ("${", "<", "{{", "%(", "http://", "https://")
#: Length from which on longer values weigh the same.
MOST_CHARS = 1_000_000

_HEX_BYTES = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def name_weight(name: str) -> int:
    """The largest weight of a sensitive stem in the name; 0 if there is none."""
    return max((STEMS[m.lower()] for m in STEM.findall(name)), default=0)


@dataclass
class Looks:
    """What a value looks like: its length (it stops at MOST_CHARS), shares of its characters, whether it has blanks, its first literal."""

    length: float = 0.0
    chars: dict[str, float] = field(default_factory=dict)
    blank: bool = False
    quoted: bool = True
    first: str | None = None
    whole: bool = True  # it is one literal

    @classmethod
    def of(cls, text: str, quoted: bool) -> Looks:
        n = len(text)
        return cls(min(n, MOST_CHARS), {c: k / n for c, k in Counter(text).items()}, any(map(str.isspace, text)), quoted, text)

    def with_(self, more: Looks) -> Looks:
        if not more.length:
            return self
        if not self.length:
            return more
        n = self.length + more.length
        chars = {c: (self.chars.get(c, 0.0) * self.length + more.chars.get(c, 0.0) * more.length) / n for c in self.chars.keys() | more.chars.keys()}
        return Looks(min(n, MOST_CHARS), chars, self.blank or more.blank, self.quoted and more.quoted, self.first, False)

    def weight(self) -> float:
        """0 to 3: how much the value looks like a secret: its length, its kinds of characters and its entropy."""
        if self.length < 6 or self.blank or self.first.startswith(HOLDERS) or (self.whole and self.first.lower() in PLACEHOLDERS):
            return 0.0
        entropy = -sum(p * math.log2(p) for p in self.chars.values())
        kinds = sum(any(map(f, self.chars)) for f in (str.islower, str.isupper, str.isdigit)) + (not all(map(str.isalnum, self.chars)))
        if kinds < 2 or entropy < 2.0 or not (self.quoted or any(map(str.isdigit, self.chars))):
            return 0.0  # a bare value without a digit is a word of prose, or refers to something else
        return min(3.0, (kinds - 1) * 0.5 + min(self.length, 32) / 16 + (entropy - 2) / 2)


def _looks(text: str, asked: Expression, known: dict, parts: dict) -> Looks:
    """Looks of an expression and of all that it leads to, each summed up once; one that leads to itself adds nothing there."""
    stack = [asked]
    while stack:
        e = stack[-1]
        if e not in parts:
            parts[e] = e.parts()
            stack += [o for o in parts[e][1] if o not in parts]
            continue
        stack.pop()
        if e not in known:
            looks = Looks()
            for i, j, quoted in parts[e][0]:
                looks = looks.with_(Looks.of(text[i:j], quoted))
            for o in parts[e][1]:
                looks = looks.with_(known.get(o, Looks()))
            known[e] = looks
    return known[asked]


def lexed_spans(text: str, least: float = 4.0) -> list[tuple[int, int, int]]:
    """Spans of literals that a pair, or constants carried to one, gives to a sensitive name."""
    known, parts = {}, {}
    out, seen = set(), set()
    for name, value in Lexer(text, lambda i, j: bool(STEM.search(text, i, j))).pairs:
        weight = name_weight(name)
        if not weight or value in seen:
            continue
        looks = _looks(text, value, known, parts)
        found = looks.weight()
        if found and weight + found >= least + (not looks.quoted) * 0.25:
            stack = [value]
            while stack:
                e = stack.pop()
                if e not in seen:
                    seen.add(e)
                    out.update((i, 3, j) for i, j, _ in parts[e][0] if j > i)
                    stack += parts[e][1]
    return sorted(out)


def spans(data: bytes) -> list[tuple[int, int, int]]:
    """All spans of a UTF-8 text by start and kind, in code points; an end is exclusive."""
    low = data.lower()
    named, address = any(s in low for s in STEM_BYTES), b"://" in data and b"@" in data
    if not (named or address or b"AKIA" in data or b"h" * 16 in data.translate(_HEX_BYTES)):
        return []  # none of the patterns can match
    text = data.decode("utf-8", "replace")
    lexed = set(lexed_spans(text)) if named else set()
    if address:
        lexed.update((m.start(1), 3, m.end(1)) for m in USER.finditer(text) if Looks.of(m[1], True).weight())
    return sorted([*base_spans(text), *lexed])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs (doc_id long, text string); spans: array of {kind, start, end}.

    A null or empty text has no spans; very long texts are scanned whole; repeated rows come back as
    often as they came; extra columns are ignored; an empty table gives an empty result.
    """

    def each(batches):
        for batch in batches:
            found = [spans(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            made = pa.array([[{"kind": KINDS[k], "start": i, "end": j} for i, k, j in s] for s in found], SPANS_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), made], ["doc_id", "spans"])

    return text_table(docs).mapInArrow(each, f"doc_id long, spans {SPANS_TYPE}")


SPANS_TYPE = "array<struct<kind:string,start:long,end:long>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def joined(spans_column) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the fixed patterns' spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("literal").alias("n_literal"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of a secret in text replaced by `mark`, and n_chars set anew where it changes.

    Overlapping spans become one mark. All other columns, null texts and clean rows stay as they are.
    """

    def cleaned(data: bytes | None) -> bytes | None:
        found = spans(data) if data else []
        if not found:
            return data
        text, out, at = data.decode("utf-8", "replace"), [], 0
        for i, _, j in found:
            if i >= at:
                out += [text[at:i], mark]
            at = max(at, j)
        return "".join([*out, text[at:]]).encode()

    def each(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            old = columns["text"].cast(pa.binary()).to_pylist()
            new = [cleaned(t) for t in old]
            columns["text"] = pa.array(new, pa.binary()).cast(columns["text"].type)
            if "n_chars" in columns:
                sizes = [c if a == b else len(b.decode("utf-8", "replace")) for a, b, c in zip(old, new, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(each, docs.schema)
