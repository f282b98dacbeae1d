"""Personal data by anchor expansion (operator 5).

One Aho-Corasick pass finds anchors: at-signs, URL schemes, plus signs before a
digit, digits with a dot or another digit behind them, and words that announce
an identifier.  A small deterministic parser per kind expands each anchor to the
boundaries of an address or number and validates it.

Base kinds: email, ip (parts up to 255), card (12 to 19 digits, Luhn), phone (9
to 15 digits).  Further kinds: iban (mod 97), url (with a user name in it),
account (six or more digits after an account cue) and secret (a value after a
secret cue).  Spans of one kind do not overlap; those of different kinds may.
Offsets are code points, end exclusive.

Defined results: null and empty texts have no span; repeated rows get equal
spans; redaction of a null text stays null.  Columns of the input stay; columns
named like an output are replaced.
"""

from __future__ import annotations


import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import arrow_column

# ---- fixed values: kinds, cues, character classes -----------------------------------
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "url", "account", "secret"]
ACCOUNT_CUES = ["account", "acct", "konto", "compte", "cuenta", "passport", "ssn"]
SECRET_CUES = ["password", "passwd", "secret", "token", "api_key", "apikey", "api-key"]
IBAN_CUE = "iban"
CUE_FILLERS = ["number", "nummer", "num", "no", "nr", "is"]
# -------------------------------------------------------------------------------------
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
LABEL = DIGITS | LETTERS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SECRET = DIGITS | LETTERS | frozenset("_-+/=.")
CUE_GAP = frozenset(" \t:=#.\"'")


def _finder() -> ahocorasick.Automaton:
    finder = ahocorasick.Automaton()
    finder.add_word("@", ("email", 1))
    finder.add_word("://", ("url", 3))
    for a in sorted(DIGITS):
        finder.add_word(f"+{a}", ("phone", 2))
        finder.add_word(f"{a}.", ("ip", 2))
        for b in sorted(DIGITS):
            for gap in ("", " ", "-"):
                finder.add_word(a + gap + b, ("card", 2 + len(gap)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("iban", [IBAN_CUE])):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                finder.add_word(form, (kind, len(form)))
    finder.make_automaton()
    return finder


def _run(text: str, at: int, kind: frozenset[str]) -> int:
    while at < len(text) and text[at] in kind:
        at += 1
    return at


def _back(text: str, at: int, least: int, kind: frozenset[str]) -> int:
    while at > least and text[at - 1] in kind:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def email(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """``at`` is the at-sign; a label's run is followed by at least one dotted one."""
    start, end = _back(text, at, least, LOCAL), _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    last = end
    while last < len(text) and text[last] == "." and (more := _run(text, last + 1, LABEL)) > last + 1:
        last = more
    return (start, last, True) if last > end else None


def ip(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """``at`` is a digit before a dot; four runs of digits joined by dots."""
    start = _back(text, at + 1, least, DIGITS)
    if start == at + 1:
        return None
    end = at + 1
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (more := _run(text, end + 1, DIGITS)) == end + 1:
            return None
        end = more
    return start, end, all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in text[start:end].split("."))


def card(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """``at`` is the first digit of a chain of digits with at most one space or hyphen between two."""
    if at < least:
        return None
    end = at + 1
    while True:
        step = 1 if end < len(text) and text[end] in " -" else 0
        if end + step < len(text) and text[end + step] in DIGITS:
            end += step + 1
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "")
    return at, end, 12 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """``at`` is a plus sign before a digit; the run behind it ends with its last digit."""
    end = _run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 9 <= sum(x in DIGITS for x in text[at:end]) <= 15


def url(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """``at`` is the colon of ``://``; only addresses with a user name are personal."""
    start = _back(text, at, least, LETTERS)
    if start == at:
        return None
    end = at + 3
    while end < len(text) and not text[end].isspace() and text[end] not in "<>\"'":
        end += 1
    host = text[at + 3 : end].split("/")[0]
    return start, end, "@" in host.strip("@")


def _after_cue(text: str, at: int) -> int | None:
    """Where the value behind a cue begins; the cue must end as a word."""
    if at < len(text) and (text[at].isalnum() or text[at] == "_"):
        return None
    for _ in range(2):
        at = _run(text, at, CUE_GAP)
        word = _run(text, at, LETTERS)
        if text[at:word].lower() in CUE_FILLERS:
            at = _run(text, word, CUE_GAP)
    return at


def account(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    if (start := _after_cue(text, at)) is None or start < least:
        return None
    end = _run(text, start, DIGITS | frozenset(" -"))
    while end > start and text[end - 1] not in DIGITS:
        end -= 1
    return start, end, 6 <= sum(x in DIGITS for x in text[start:end]) <= 34


def secret(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """A value of eight or more characters behind a colon or equals sign."""
    gap = _run(text, at, frozenset(" \""))
    if gap >= len(text) or text[gap] not in ":=":
        return None
    start = _run(text, gap, CUE_GAP)
    end = _run(text, start, SECRET)
    return (start, end, True) if end - start >= 8 and start >= least else None


def iban(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    if (start := _after_cue(text, at)) is None or start < least:
        return None
    end, digits = start, ""
    while end < len(text) and (text[end] in DIGITS or text[end] in LETTERS or text[end] == " " and len(digits) % 4 == 0 and text[end - 1] != " ") and len(digits) < 34:
        digits += text[end].strip()
        end += 1
    for size in range(len(digits), 14, -1):  # letters of the next word may follow the last group
        own = digits[:size].upper()
        if own[:2].isalpha() and own[2:4].isdigit() and int("".join(str(int(x, 36)) for x in own[4:] + own[:4])) % 97 == 1:
            used = start
            while size:
                size -= text[used] != " "
                used += 1
            return start, used, True
    return None


PARSERS = {"email": email, "ip": ip, "card": card, "phone": phone, "url": url, "account": account, "secret": secret, "iban": iban}
_FINDER: list = []


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by the kind's place in ``KINDS``."""
    if not _FINDER:
        _FINDER.append(_finder())
    done, out = dict.fromkeys(KINDS, 0), []
    for last, (kind, length) in _FINDER[0].iter(text):
        first = last - length + 1
        anchor = last + 1 if kind in ("account", "secret", "iban") else first
        if kind != "email" and anchor < done[kind] or kind in ("account", "secret", "iban") and first and text[first - 1].isalnum():
            continue
        if found := PARSERS[kind](text, anchor, done[kind]):
            start, end, valid = found
            done[kind] = max(done[kind], end)
            if valid:
                out.append((start, end, kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """Each span, or group of overlapping ones, becomes the first one's kind in angle brackets."""
    out, at, k = [], 0, 0
    while k < len(found):
        start, end, kind = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][1])
            k += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


@arrow_column("array<struct<start:int,end:int,kind:string>>")
def _spans(text: pa.Array) -> pa.Array:
    return pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in spans(x or "")] for x in (v.as_py() for v in text)], _SPAN)


@arrow_column("string")
def _redacted(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else redacted(x, spans(x)) for x in (v.as_py() for v in text)], pa.string())


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array of (start, end, kind)."""
    return docs.withColumn(out, _spans(F.col(text_col)))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text."""
    return docs.withColumn(text_col, _redacted(F.col(text_col)))


def listed(found: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    if kinds is not None:
        found = F.filter(found, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


