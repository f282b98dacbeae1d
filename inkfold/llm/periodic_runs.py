"""Periodic runs of words by grammar compression (operator 11).

A run is a stretch of words with smallest period q, at least ``max(12, 2 * q)``
words long, that no neighbouring word extends.  The word ids of some texts at a
time are compressed by Re-Pair in rounds: in each text every pair of symbols that
occurs twice and outranks the pairs overlapping it (more frequent first, then a
fixed shuffle) becomes a nonterminal.  What is left of a text is paired up to a
balanced tree, so every stretch of two or more words crosses the boundary between
the two children of exactly one nonterminal of its derivation.

For each distinct nonterminal the runs that cross its boundary are computed once,
inside its own expansion.  A run of 12 or more words that crosses a boundary holds
a six-word window that starts at most six words before the boundary and returns one
period away; the places of equal windows inside the expansion give the candidate
periods, and common extensions by prefix hashes give start and end.  Of equal
stretches the smallest period stays.  The runs of a nonterminal are then moved to
all places where its derivation puts it, and per text and period only intervals
that no other one contains are kept.  Every run that comes out is compared word by
word, so a hash collision cannot go unseen.

Texts in which no six-word window returns hold no run and are not compressed.
All steps are array operations over the texts of a group (``GROUP_BYTES``); a
longer text stands alone, and memory follows its words.

Defined results: null, empty and blank texts have no words, no runs and an empty
collapsed text; repeated rows get equal results; an empty table gives an empty
result.  Columns of the input stay; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import texts_as_bytes
from .support import OWN

MIN_LENGTH, GRAM = 12, 6
GROUP_BYTES, CANDIDATES = 1 << 18, 1 << 20
STEP = 0x9E3779B97F4A7C15
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RESULT = f"struct<n_words:bigint,runs:{RUNS},collapsed:string>"


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = values.astype(np.uint64) * np.uint64(STEP)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges ``first .. first + count``: the number of the range and the value, one entry per value."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Grammar:
    """Nonterminals over a row of word ids; ``firsts`` bounds the texts, and no pair spans two of them."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray):
        self.size = int(words.max(initial=-1)) + 1  # symbols so far, words first
        self.width = [np.ones(self.size, np.int64)]  # words of a symbol's expansion
        self.half, self.places = [np.zeros(self.size, np.int64)], []  # width of the left child; (symbol, start) of every occurrence
        self.keys, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.symbols, self.starts = words.astype(np.int64), np.arange(len(words))
        self.text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        self.lengths = self.width[0]
        while self._pair_repeated():
            pass
        while self._pair_neighbours():
            pass
        self.half = np.concatenate(self.half)

    def _replace(self, at: np.ndarray) -> None:
        """Make the pairs that begin at ``at`` symbols; equal pairs are one symbol."""
        left, right = self.symbols[at], self.symbols[at + 1]
        pair = left << 32 | right
        fresh, first = np.unique(pair, return_index=True)
        place = np.searchsorted(self.keys, fresh)
        new = np.ones(len(fresh), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != fresh[inside]
        where = first[new]
        self.half.append(self.lengths[left[where]])
        self.width.append(self.lengths[left[where]] + self.lengths[right[where]])
        self.lengths = np.concatenate((self.lengths, self.width[-1]))
        keys, ids = np.concatenate((self.keys, fresh[new])), np.concatenate((self.ids, self.size + np.arange(len(where))))
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids, self.size = keys[order], ids[order], self.size + len(where)
        symbol = self.ids[np.searchsorted(self.keys, pair)]
        self.places.append((symbol, self.starts[at]))
        self.symbols[at] = symbol
        stays = np.ones(len(self.symbols), bool)
        stays[at + 1] = False
        self.symbols, self.starts, self.text = self.symbols[stays], self.starts[stays], self.text[stays]

    def _pair_repeated(self) -> bool:
        if len(self.symbols) < 2:
            return False
        whole = self.text[1:] == self.text[:-1]
        pair = self.symbols[:-1] << 32 | self.symbols[1:]
        known, number = np.unique(pair, return_inverse=True)
        _, group, counts = np.unique(self.text[:-1] * len(known) + number, return_inverse=True, return_counts=True)
        count = np.where(whole, counts[group], 0)
        if not (count > 1).any():
            return False
        rank = np.random.default_rng(1).permutation(len(known))
        order = np.where(count > 1, count << 32 | rank[number], -1)
        # stretches of one pair (a word said again and again) take every second place
        begins = np.flatnonzero(np.concatenate(([True], (order[1:] != order[:-1]) | ~whole[1:] | ~whole[:-1])))
        length = np.diff(np.append(begins, len(order)))
        offset = np.arange(len(order)) - np.repeat(begins, length)
        last = np.repeat(length, length) - 1
        before, after = np.concatenate(([-1], order[:-1])), np.concatenate((order[1:], [-1]))
        taken = (order >= 0) & (offset % 2 == 0) & ((offset > 0) | (before < order)) & ((offset < last) | (after < order))
        self._replace(np.flatnonzero(taken))
        return True

    def _pair_neighbours(self) -> bool:
        if len(self.symbols) < 2:
            return False
        begins = np.flatnonzero(np.concatenate(([True], self.text[1:] != self.text[:-1])))
        length = np.diff(np.append(begins, len(self.text)))
        offset = np.arange(len(self.text)) - np.repeat(begins, length)
        at = np.flatnonzero((offset % 2 == 0) & (offset + 1 < np.repeat(length, length)))
        if len(at):
            self._replace(at)
        return len(at) > 0


class Extensions:
    """How far two places of a row of words agree, by prefix hashes."""

    def __init__(self, words: np.ndarray):
        values = mixed(words + 1)
        factor = np.full(len(words) + 1, STEP | 1, np.uint64)
        factor[0] = 1
        self.powers = np.multiply.accumulate(factor)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.powers[:-1])))

    def _equal(self, a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether words a..b and those ``shift`` further on agree."""
        return (self.sums[b] - self.sums[a]) * self.powers[shift] == self.sums[b + shift] - self.sums[a + shift]

    def _longest(self, limit: np.ndarray, agree) -> np.ndarray:
        got = np.zeros(len(limit), np.int64)
        step = 1 << int(limit.max(initial=0)).bit_length()
        while step:
            more = np.minimum(got + step, limit)
            ok = agree(more)
            got = np.where(ok, more, got)
            step >>= 1
        return got

    def forward(self, at: np.ndarray, shift: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._longest(limit, lambda n: self._equal(at, at + n, shift))

    def backward(self, at: np.ndarray, shift: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._longest(limit, lambda n: self._equal(at - n, at, shift))


def grams(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A number per place: equal windows of one text have the same; places without a whole window have their own."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.arange(len(words))
    h = mixed(words[:n] + 1)
    for k in range(1, GRAM):
        h = h * np.uint64(STEP) + mixed(words[k : k + n] + 1)
    h ^= mixed(text[:n] + 7)
    whole = text[:n] == text[GRAM - 1 :]
    _, number = np.unique(h, return_inverse=True)
    return np.concatenate((np.where(whole, number, n + np.arange(n)), 2 * n + np.arange(GRAM - 1)))


def crossing(node_lo: np.ndarray, node_hi: np.ndarray, cut: np.ndarray, gram: np.ndarray, reach: Extensions) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs across each node's boundary ``cut``, inside ``node_lo .. node_hi``."""
    n = len(gram)
    by_gram = np.argsort(gram, kind="stable")
    sorted_key = gram[by_gram] * (n + 1) + by_gram
    begin = np.maximum(cut - GRAM, node_lo)
    node, at = spread(begin, np.maximum(np.minimum(cut, node_hi - GRAM) - begin + 1, 0))
    a = np.searchsorted(sorted_key, gram[at] * (n + 1) + node_lo[node])
    b = np.searchsorted(sorted_key, gram[at] * (n + 1) + node_hi[node] - GRAM, side="right")
    several = b - a > 1
    node, at, a, b = node[several], at[several], a[several], b[several]
    out, total = [], np.cumsum(b - a)
    done = 0
    while done < len(node):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CANDIDATES, side="right")))
        owner, slot = spread(a[done:upto], b[done:upto] - a[done:upto])
        own, other = node[done:upto][owner], by_gram[slot]
        here = at[done:upto][owner]
        done = upto
        differs = other != here
        own, low, far = own[differs], np.minimum(here, other)[differs], np.abs(other - here)[differs]
        side = (low == here[differs]).astype(np.int64)
        _, first = np.unique((own * (n + 1) + far) * 2 + side, return_index=True)
        own, low, far = own[first], low[first], far[first]
        start = low - reach.backward(low, far, low - node_lo[own])
        end = low + reach.forward(low, far, node_hi[own] - low - far) + far
        good = (end - start >= np.maximum(MIN_LENGTH, 2 * far)) & (start < cut[own]) & (cut[own] < end)
        out.append((own[good], start[good], end[good], far[good]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    own, start, end, period = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((period, end, start, own))
    own, start, end, period = own[order], start[order], end[order], period[order]
    first = np.concatenate(([True], (own[1:] != own[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(own) else np.zeros(0, bool)
    return own[first], start[first], end[first], period[first]


def _exact(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    owner, at = spread(start, end - start - period)
    return bool((words[at] == words[at + period[owner]]).all())


def runs_of(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; ``words`` are ids from zero, starts are in the text."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    if not len(words):
        return none
    gram = grams(words, text)
    twice = np.bincount(gram)[gram] > 1
    active = np.zeros(len(firsts) - 1, bool)
    active[text[twice]] = True
    if not active.any():
        return none
    keep = active[text]
    words, gram, twice, text = words[keep], gram[keep], twice[keep], text[keep]
    sizes = np.where(active, np.diff(firsts), 0)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    _, words = np.unique(words, return_inverse=True)
    _, gram = np.unique(gram, return_inverse=True)

    grammar = Grammar(words, bounds)
    if not grammar.places:
        return none
    symbol = np.concatenate([x for x, _ in grammar.places])
    place = np.concatenate([x for _, x in grammar.places])
    order = np.argsort(symbol, kind="stable")
    symbol, place = symbol[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
    times = np.diff(np.append(first, len(symbol)))
    lo, width, half = place[first], grammar.lengths[symbol[first]], grammar.half[symbol[first]]
    cut = lo + half
    near = np.concatenate(([0], np.cumsum(twice)))
    begin = np.maximum(cut - GRAM, lo)
    wanted = (width >= MIN_LENGTH) & (near[np.minimum(cut + 1, len(words))] > near[begin])
    node = np.flatnonzero(wanted)
    reach = Extensions(words)
    own, start, end, period = crossing(lo[node], lo[node] + width[node], cut[node], gram, reach)
    own = node[own]
    # to all places of the derivation
    owner, slot = spread(first[own], times[own])
    shift = place[slot] - lo[own][owner]
    start, end, period = start[owner] + shift, end[owner] + shift, period[owner]
    t = np.searchsorted(bounds, start, side="right") - 1
    order = np.lexsort((-end, start, period, t))
    t, start, end, period = t[order], start[order], end[order], period[order]
    if not len(t):
        return none
    fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (period[1:] != period[:-1])))
    base = np.cumsum(fresh) * (len(words) + 1)
    top = np.maximum.accumulate(end + base)
    maximal = fresh.copy()
    maximal[1:] |= end[1:] + base[1:] > top[:-1]
    t, start, end, period = t[maximal], start[maximal], end[maximal], period[maximal]
    if not _exact(words, start, end, period):
        raise ArithmeticError("two stretches of words share a hash")
    order = np.lexsort((period, start, t))
    t, start, end, period = t[order], start[order], end[order], period[order]
    return t, start - bounds[t], end - start, period


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) > 0


def scan(texts: list[bytes]) -> Iterator[dict]:
    """Word count, runs and collapsed text of each text; words are runs without ASCII white space."""
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= GROUP_BYTES:
            size += len(texts[upto])
            upto += 1
        cut = [x.split() for x in texts[at:upto]]
        at = upto
        ids: dict[bytes, int] = {}
        words = np.array([ids.setdefault(w, len(ids)) for own in cut for w in own], np.int64)
        firsts = np.cumsum([0, *map(len, cut)])
        t, start, length, period = runs_of(words, firsts)
        bounds = np.searchsorted(t, np.arange(len(cut) + 1))
        for k, own in enumerate(cut):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                gone = dropped(len(own), start[a:b], length[a:b], period[a:b])
                kept = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
            else:
                kept = own
            runs = [{"start": s, "length": n, "period": p} for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)]
            yield {"n_words": len(own), "runs": runs, "collapsed": b" ".join(kept).decode()}


_ARROW = pa.struct([
    ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed``: the text without repeated periods."""

    @F.arrow_udf(RESULT)
    def found(text: pa.Array) -> pa.Array:
        return pa.array(scan(texts_as_bytes(text)), _ARROW)

    out = docs.withColumn(f"{OWN}found", found(F.col(text_col)))
    for name in ("n_words", "runs", "collapsed"):
        out = out.withColumn(name, F.col(f"{OWN}found.{name}"))
    return out.drop(f"{OWN}found")
