"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their scores.

Four fixed patterns (mail addresses, IP addresses, payment cards, phone numbers) always stay. Beside
them other writings are proposed: cards inside longer chains of digits or with other separators,
numbers without a country code, addresses in other alphabets or spelt out, IPv6, bank accounts and
national numbers. Each has a prior score; a checksum (Luhn, mod 97, mod 23, mod 11-10) or a rule of
the kind must hold; words around the span raise or lower the score, and what reaches `least` is kept.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import text_table

#: Kinds of spans, in the order in which those with equal starts are listed. The first four have fixed patterns.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "nir", "dni", "taxid")
EMAIL, IP, CARD, PHONE, IBAN, SSN, NIR, DNI, TAXID = range(len(KINDS))

#: What follows the "@"; what stands before it is looked up from there, so that long words are read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match of the fixed pattern always begins where a run of digits does.
IPV4 = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
INTERNATIONAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WIDE_DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]++)++")
SPELT = re.compile(r"\s?[\[({]\s?(?:at|AT|arroba|chez)\s?[\])}]\s?([A-Za-z0-9-]++(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|punto|point|punkt)\s?[\])}]\s?)[A-Za-z0-9-]++)++)")
SPELT_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
GROUPS = re.compile(r"[0-9]+")
SEPARATED = re.compile(r"(?<![0-9])(?:[0-9]{4}([.\u00a0\u2009\u202f\u2011\u2013/_]|[\x20-]{2})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([.\u00a0\u2009\u202f\u2011\u2013/_]|[\x20-]{2})[0-9]{6}\2[0-9]{4,5})(?![0-9])")
AMERICAN = re.compile(r"(?<![\w+-])(?:\+?1[\x20.-]?)?(?:\([2-9][0-9]{2}\)[\x20-]?|[2-9][0-9]{2}([.\x20-]))[2-9][0-9]{2}[.\x20-][0-9]{4}(?![\w-])")
NATIONAL = re.compile(r"(?<![\w+.-])0[1-9](?:[\x20./-]?[0-9]){6,11}(?![\w-])|(?<![\w+.-])00[1-9](?:[\x20./-]?[0-9]){7,12}(?![\w-])|(?<![\w+.-])[6-9][0-9]{2}[\x20-]?[0-9]{3}[\x20-]?[0-9]{3}(?![\w-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}")
SOCIAL = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
FRENCH = re.compile(r"(?<![\w-])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?(?:2[AB]|[0-9]{2})\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![\w-])")
SPANISH = re.compile(r"(?<![\w-])[XYZ0-9][0-9]{7}-?[A-Z](?![\w-])")
GERMAN = re.compile(r"(?<![\w-])[1-9][0-9]\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{3}(?![\w-])")
WORDS = re.compile(r"[^\W\d_]+")

#: Lengths of account numbers by country.
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: First digits of card issuers, and the lengths of their numbers.
ISSUERS = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12}|62[0-9]{14,17}")
#: The letters of Spanish numbers, by the number modulo 23.
LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
FOREIGN = str.maketrans("XYZ", "012")

#: Words that raise a kind's score when they stand near a span.
RAISING = {
    EMAIL: "mail email e-mail contact correo courriel adresse write",
    IP: "ip address host server client login addr adresse",
    CARD: "card cards visa mastercard amex credit debit payment carte tarjeta karte kreditkarte cvv cvc pan",
    PHONE: "phone tel telephone call mobile cell cellphone fax sms whatsapp téléphone teléfono telefon telefonnummer handy móvil portable anruf llame appelez",
    IBAN: "iban account bank konto compte cuenta bic swift transfer überweisung virement transferencia",
    SSN: "ssn social security taxpayer itin",
    NIR: "nir sécurité sociale sécu insee social",
    DNI: "dni nie nif identidad documento cif",
    TAXID: "steuer steuernummer identifikationsnummer idnr tin steuerid",
}
#: Words that lower every score: such numbers count or name things.
LOWERING = frozenset("order invoice isbn issn version build ticket model part serial page chapter item sku tracking reference ref bestellung rechnung commande facture pedido factura artikel".split())
_RAISING = {k: frozenset(v.split()) for k, v in RAISING.items()}

#: Prior scores of the fixed patterns and of the proposals beside them, and what context adds or takes.
BASE_SCORES = {EMAIL: 0.8, IP: 0.6, CARD: 0.7, PHONE: 0.6}
CONTEXT = 0.25
#: Code points before and after a span in which words count as near.
NEAR = (48, 24)


def luhn(digits: str) -> bool:
    """Whether the digits end in their check digit."""
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def mod97(number: str) -> bool:
    """Whether an account number (capitals and digits) has the right check digits."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def mod11_10(digits: str) -> bool:
    """Whether the last digit is the ISO 7064 mod 11-10 check digit of those before it."""
    p = 10
    for d in digits[:-1]:
        p = ((p + int(d)) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns whose matches pass: leftmost, non-overlapping, no second try."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, EMAIL, found.end()))
        after = found.end() if found else at + 1
        at = text.find("@", after)
    for m in IPV4.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    for m in INTERNATIONAL.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def card_parts(text: str, start: int, end: int):
    """Cards of usual layouts among the groups of a chain of digits: (start, end)."""
    groups = [m.span() for m in GROUPS.finditer(text, start, end)]
    sizes = [j - i for i, j in groups]
    k = 0
    while k < len(groups):
        for n in (1, 4, 5, 3):
            own = sizes[k : k + n]
            laid = len(own) == n and (n == 1 or own == [4, 6, 5] or own == [4, 6, 4] or (n > 3 and own[:3] == [4, 4, 4] and all(s <= 4 for s in own)))
            if laid and 13 <= sum(own) <= 19:
                i, j = groups[k][0], groups[k + n - 1][1]
                d = digits_of(text[i:j])
                if ISSUERS.fullmatch(d) and luhn(d):
                    yield i, j
                    k += n - 1
                    break
        k += 1


def proposed(text: str, digits: bool):
    """(start, kind, end, score) of the writings beside the fixed patterns; each checksum has passed."""
    if "@" in text and not text.isascii():
        at = text.find("@")
        while at >= 0:
            start = at
            while start > 0 and at - start < 64 and (text[start - 1].isalnum() or text[start - 1] in LOCAL):
                start -= 1
            found = WIDE_DOMAIN.match(text, at + 1) if start < at else None
            if found:
                yield start, EMAIL, found.end(), 0.6
            at = text.find("@", at + 1)
    if "[" in text or "(" in text or "{" in text:
        for m in SPELT.finditer(text):
            if local := SPELT_LOCAL.search(text, max(0, m.start() - 64), m.start()):
                yield local.start(), EMAIL, m.end(), 0.6
    if "::" in text or text.count(":") > 6:
        for m in IPV6.finditer(text):
            if sum(bool(g) for g in m[0].split(":")) >= 3 and any("0" <= c <= "9" for c in m[0]):
                try:
                    ipaddress.IPv6Address(m[0])
                except ValueError:
                    continue
                yield m.start(), IP, m.end(), 0.6
    if not digits:
        return
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            for i, j in card_parts(text, m.start(), m.end()):
                yield i, CARD, j, 0.6
    for m in SEPARATED.finditer(text):
        d = digits_of(m[0])
        if ISSUERS.fullmatch(d) and luhn(d):
            yield m.start(), CARD, m.end(), 0.6
    for m in ACCOUNT.finditer(text):
        size, k = ACCOUNT_LENGTHS.get(m[0][:2], 0), 0
        for j, c in enumerate(m[0]):
            k += c not in " -"
            if k == size:
                end = m.start() + j + 1
                if not text[end : end + 1].isalnum() and mod97(m[0][: j + 1].replace(" ", "").replace("-", "")):
                    yield m.start(), IBAN, end, 0.9
                break
    for m in SOCIAL.finditer(text):
        yield m.start(), SSN, m.end(), 0.5
    for m in FRENCH.finditer(text):
        n = m[0].replace(" ", "")
        if 97 - int(n[:-2].replace("2A", "19").replace("2B", "18")) % 97 == int(n[-2:]):
            yield m.start(), NIR, m.end(), 0.6
    for m in AMERICAN.finditer(text):
        yield m.start(), PHONE, m.end(), 0.5 if m[0][0] in "+(" or m[1] != " " else 0.3
    for m in NATIONAL.finditer(text):
        yield m.start(), PHONE, m.end(), 0.3
    for m in SPANISH.finditer(text):
        if LETTERS[int(m[0][:-1].rstrip("-").translate(FOREIGN)) % 23] == m[0][-1]:
            yield m.start(), DNI, m.end(), 0.3
    for m in GERMAN.finditer(text):
        n = digits_of(m[0])
        if max(map(n[:10].count, n[:10])) in (2, 3) and mod11_10(n):
            yield m.start(), TAXID, m.end(), 0.3


def context(text: str, kind: int, start: int, end: int) -> float:
    """What the words near a span add to its score."""
    near = text[max(0, start - NEAR[0]) : start].lower() + " " + text[end : end + NEAR[1]].lower()
    words = set(WORDS.findall(near))
    return CONTEXT * (bool(words & _RAISING[kind]) - bool(words & LOWERING))


def spans(text: str, least: float = 0.5) -> list[tuple[int, int, int, float, bool]]:
    """(start, kind, end, score, whether by a fixed pattern), by start and kind, in code points; an end is exclusive.

    Proposals inside a span that stands already are left out; of those that overlap, the one with the
    higher score stays, then the longer, then the earlier.
    """
    digits = GROUPS.search(text) is not None
    if not digits and "@" not in text and "[" not in text and "(" not in text and "{" not in text and "::" not in text:
        return []
    fixed = base_spans(text)
    scored = [(i, k, j, min(1.0, BASE_SCORES[k] + context(text, k, i, j)), True) for i, k, j in fixed]
    more = []
    for i, k, j, prior in proposed(text, digits):
        if (score := prior + context(text, k, i, j)) >= least:
            more.append((-min(1.0, score), i - j, i, k, j))
    if not more:
        return scored
    starts = [i for i, _, _ in fixed]
    reach, most = [], 0
    for _, _, j in fixed:  # how far the spans up to each one reach
        most = max(most, j)
        reach.append(most)
    taken: list[tuple[int, int]] = []
    for score, _, i, k, j in sorted(more):
        at = bisect_right(starts, i)
        if at and reach[at - 1] >= j:
            continue
        place = bisect_right(taken, (i, j))
        if (place and taken[place - 1][1] > i) or (place < len(taken) and taken[place][0] < j):
            continue
        taken.insert(place, (i, j))
        scored.append((i, k, j, -score, False))
    return sorted(scored)


SPANS_TYPE = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def scan(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, spans) for every row of docs (doc_id long, text string); spans: array of {kind, start, end, score, base}.

    A null or empty text has no spans; very long texts are scanned whole, in time that grows with the
    text; repeated rows come back as often as they came; a null doc_id stays null; extra columns are
    ignored; an empty table gives an empty result. Spans of one start are listed by KINDS, then by end.
    """

    def each(batches):
        for batch in batches:
            found = [spans(t.decode("utf-8", "replace"), least) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            made = pa.array([[{"kind": KINDS[k], "start": i, "end": j, "score": s, "base": b} for i, k, j, s, b in own] for own in found], SPANS_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), made], ["doc_id", "spans"])

    return text_table(docs).mapInArrow(each, f"doc_id long, spans {SPANS_TYPE}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the fixed patterns' spans, and all spans as text, of the rows of scan()."""
    joined = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = (F.size("spans") - F.size(base)).cast("long")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added.alias("n_added"))


def mask(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, such as [email]; n_chars is set anew where that changes a text.

    Overlapping spans become one mark, that of the first. All other columns, null texts and clean
    rows stay as they are.
    """

    def masked(data: bytes | None) -> bytes | None:
        text = data.decode("utf-8", "replace") if data else ""
        found = spans(text, least)
        if not found:
            return data
        out, at = [], 0
        for i, k, j, _, _ in found:
            if i >= at:
                out += [text[at:i], f"[{KINDS[k]}]"]
            at = max(at, j)
        return "".join([*out, text[at:]]).encode()

    def each(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            old = columns["text"].cast(pa.binary()).to_pylist()
            new = [masked(t) for t in old]
            columns["text"] = pa.array(new, pa.binary()).cast(columns["text"].type)
            if "n_chars" in columns:
                sizes = [c if a == b else len(b.decode("utf-8", "replace")) for a, b, c in zip(old, new, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(each, docs.schema)
