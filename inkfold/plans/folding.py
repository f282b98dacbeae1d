"""The full common clean-up in DuckDB's SQL, which composes characters but has no NFKC.

NFKC is each character's compatibility decomposition, composed again, so the
characters that have one are rewritten from a list before ``nfc_normalize``.
"""

from __future__ import annotations

import unicodedata

#: Characters whose compatibility decomposition is more than the canonical one; beyond these planes there are none.
FOLDED = [c for c in map(chr, range(0xA0, 0x20000)) if unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c)]
#: White space in Unicode's sense, with the four separators that Python counts in.
SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Unicode's letters, marks, digits and joiners: the inside of a class of what a word is made of.
WORD = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"


def _class(chars):
    """A class of characters, neighbours as ranges."""
    spans = []
    for c in map(ord, chars):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


def rewritten(hit, fix):
    """SQL that replaces each match ``h`` of ``hit`` in ``text`` by ``fix``."""
    hits = f"list_transform(regexp_extract_all(text, '{hit}'), lambda h: {fix})"
    return f"CASE WHEN regexp_matches(text, '{hit}') THEN array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{hit}'), {hits}), lambda z: z[1] || coalesce(z[2], '')), '') ELSE text END"


def _literal(text):
    return "'" + text.replace("'", "''") + "'"


_KEYS, _VALUES = _literal("".join(FOLDED)), _literal("\n".join(unicodedata.normalize("NFKD", c) for c in FOLDED))
_HEAD = r"regexp_extract(h, '^[^@]*@[^.]*\.')"
#: Steps over ``text``: decomposed, composed (which ends at a zero byte, so a space that no longer occurs stands for it), one space for each run, tails of addresses in lower case.
COMMON = [
    rewritten(_class(FOLDED), f"string_split({_VALUES}, chr(10))[strpos({_KEYS}, h)]"),
    "replace(nfc_normalize(replace(text, chr(0), chr(12288))), chr(12288), chr(0))",
    f"trim(regexp_replace(text, '{SPACES}+', ' ', 'g'))",
    rewritten(r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+", f"{_HEAD} || lower(substr(h, length({_HEAD}) + 1))"),
]


def through(steps, english=()):
    """SQL that takes the texts of documents through ``steps``, and English ones through ``english`` behind them."""
    steps = [*steps, *(f"CASE WHEN lang = 'en' AND text IS NOT NULL THEN {s} ELSE text END" for s in english)]
    chain = ", ".join(f"t{k + 1} AS (SELECT doc_id, lang, {s} AS text FROM t{k})" for k, s in enumerate(steps))
    return f"WITH t0 AS (SELECT doc_id, lang, text FROM documents), {chain} SELECT doc_id, text FROM t{len(steps)}"
