import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.llm import pii as op

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and op.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], op.KINDS.index(x[2])))


def base(text):
    return [x for x in op.spans(text) if x[2] in op.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0012459. -+()@ab_é\n", max_size=60))
def test_base_kinds_equal_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "256.1.1.1", "a.b@c.d-e.f", "@", "+49 (30) 123-4567", " ", ".", "x", "007.08.09.1", "+", "12"]), max_size=8))
def test_base_kinds_equal_the_patterns_on_near_misses(parts):
    assert base("".join(parts)) == brute("".join(parts))


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("my IBAN: DE89 3704 0044 0532 0130 00 please", "iban", "DE89 3704 0044 0532 0130 00"),
        ("see https://joe:pw@host.example/x now", "url", "https://joe:pw@host.example/x"),
        ("Account no. 12345678, thanks", "account", "12345678"),
        ("api_key=abcdEFGH1234", "secret", "abcdEFGH1234"),
    ],
)
def test_kinds_of_the_method(text, kind, value):
    assert (text.index(value), text.index(value) + len(value), kind) in op.spans(text)


@pytest.mark.parametrize("text", ["accountable 12345678", "https://host.example/a", "the token ring is fast", "IBAN DE89 3704 0044 0532 0130 01", "password policy", ""])
def test_no_span(text):
    assert [x for x in op.spans(text) if x[2] not in op.BASE_KINDS] == []


def test_redaction():
    text = "mail a@b.co or +1 (980) 555-6268 x"
    assert op.redacted(text, op.spans(text)) == "mail <EMAIL> or <PHONE> x"


def test_a_long_run_of_digits_takes_linear_time():
    assert op.spans("1" * 200_000) == [] and op.spans("1." * 100_000 + "@" * 1000) is not None


def test_messy_rows_and_empty_tables(messy, empty):
    assert op.find_pii(messy).count() == messy.count() and op.find_pii(empty).count() == 0
    out = op.redact_pii(messy)
    assert out.columns == messy.columns
    assert out.filter(F.col("text").isNull()).count() == messy.filter(F.col("text").isNull()).count()
