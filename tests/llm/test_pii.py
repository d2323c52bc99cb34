import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewright.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    """The contract's patterns as they stand."""
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            passes = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and plain_luhn(digits or "1"),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if passes:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


PARTS = st.sampled_from(["@", ".", "a", "é", "b-c", "%", " ", "-", "1", "25", "255", "256", "0009", "+", "(", ")", "4111111111111111", "378282246310005", "+1 (743) 555-3824", "x@y.de", "1.2.3.4", "\n", "٣"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=24))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_base(text)
    found = pii.spans(text)
    assert [(i, k, j) for i, k, j, _, base in found if base] == plain_base(text)
    assert found == sorted(found)


ADDED = {
    "two cards in one chain": ("pay 4111111111111111 4111111111111111 now", [("card", "4111111111111111"), ("card", "4111111111111111")]),
    "card in dots": ("pay 4111.1111.1111.1111 now", [("card", "4111.1111.1111.1111")]),
    "card in wide blanks": ("pay 3782 822463 10005 now", [("card", "3782 822463 10005")]),
    "card that fails": ("pay 4111.1111.1111.1112 now", []),
    "account": ("to DE89 3704 0044 0532 0130 00 BIC", [("iban", "DE89 3704 0044 0532 0130 00")]),
    "account that fails": ("to DE88 3704 0044 0532 0130 00 BIC", []),
    "account, joined": ("GB82WEST12345698765432.", [("iban", "GB82WEST12345698765432")]),
    "social": ("ssn 536-22-8726.", [("ssn", "536-22-8726")]),
    "social that can't be": ("ssn 666-22-8726.", []),
    "social lowered": ("part 536-22-8726 is sold out", []),
    "international before digits": ("at +1 (826) 555-4081 190.137.223.20 too", [("phone", "+1 (826) 555-4081")]),
    "american": ("(523) 555-1055 is hers", [("phone", "(523) 555-1055")]),
    "national with context": ("Telefon: 030 1234567, bitte", [("phone", "030 1234567")]),
    "national without": ("it is 030 1234567, thanks", []),
    "spelt": ("bob.x [at] mail.example [dot] com", [("email", "bob.x [at] mail.example [dot] com")]),
    "other alphabet": ("josé@exämple.de ok", [("email", "josé@exämple.de")]),
    "ipv6": ("from 2001:db8::8a2e:370:7334 again", [("ip", "2001:db8::8a2e:370:7334")]),
    "times and scopes": ("at 12:30:45, std::abs and Face::Bad", []),
    "french": ("no 1 85 05 78 006 001 77 ok", [("nir", "1 85 05 78 006 001 77")]),
    "spanish": ("DNI 12345678Z", [("dni", "12345678Z")]),
    "spanish without context": ("code 12345678Z", []),
    "german": ("Steuer-Id: 86095742719", [("taxid", "86095742719")]),
    "inside a base span": ("+1 (743) 555-3824", []),
    "prose": ("In 1999, 23 of 45 (at 12.5 %) were 100-200 m tall.", []),
}


@pytest.mark.parametrize("name", ADDED)
def test_added(name):
    text, expected = ADDED[name]
    assert [(pii.KINDS[k], text[i:j]) for i, k, j, _, base in pii.spans(text) if not base] == expected


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.mod11_10("86095742719") and not pii.mod11_10("86095742718")


def test_context_moves_scores():
    score = lambda text: pii.spans(text)[0][3]
    assert score("call +1 743 555 3824") > score("so +1 743 555 3824") > score("order +1 743 555 3824")


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "a@", "@a.", "+1 ", "1-", "::", "ab:", "[at]", "4111 ", "DE89", "a" * 65 + "[at]", "x@y.z1.2.3.4"])
def test_time_grows_with_the_text(unit):
    began = time.perf_counter()
    pii.spans(unit * (400_000 // len(unit)))
    assert time.perf_counter() - began < 6


def test_rows(documents, no_documents):
    rows = pii.digest(pii.scan(documents)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents.collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in rows)
    assert pii.digest(pii.scan(no_documents)).count() == 0
    assert pii.mask(no_documents).count() == 0


def test_digest_against_the_plain_version(spark):
    from tapewright.llm.queries import op13_pii

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kinds = list(PATTERNS)
    for r in op13_pii(spark, sf).collect():
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in kinds] == [sum(b[1] == n for b in base) for n in range(4)]
        joined = ",".join(f"{kinds[k]}:{i}:{j}" for i, k, j in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_mask(spark):
    rows = [(1, "mail bob@x.org or +1 (743) 555-3824 now", 40, "q"), (None, None, None, None), (3, "clean", 5, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kind string")
    out = {r["doc_id"]: (r["text"], r["n_chars"], r["kind"]) for r in pii.mask(docs).collect()}
    text = "mail [email] or [phone] now"
    assert out == {1: (text, len(text), "q"), None: (None, None, None), 3: ("clean", 5, "q")}
