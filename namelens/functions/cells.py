"""All comparisons of a block of names with a block of list entries, on arrays.

Texts and tokens are encoded once a block.  Of a long list, a ``Sieve`` compares one text of a name with all its candidates by vectors;
of a short one ``Compared`` takes pairs as index arrays.  Bounds from letters and lengths leave few pairs to the
similarities, which give the same numbers as ``similarity``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd

from namelens.functions.similarity import INITIAL_SCORE, LAST_TOKEN_BOOST, PREFIX_LETTERS, PREFIX_SCORE, PREFIX_WEIGHT, UNMATCHED_COST, _codes, _greedy, _groups, jaro_winkler_pairs
from namelens.schema import ALIAS_SCORE, EXACT_SCORE, INITIALS_SCORE

#: Order of the kinds of match, best first.
SURE, FUZZY, INITIAL = 0, 1, 2
#: How the best match of a pair came about.
EXACT_PRIMARY, EXACT_ALIAS, TRANSLIT_EXACT, BY_TOKEN, BY_STRING, BY_INITIALS = range(6)

#: Pairs of texts that are gathered before their similarities are computed, and pairs of texts in one step.
_PAIRS, _STEP = 250_000, 1 << 16
#: Bytes that a sieve keeps of words and of letters, and the entries from which on it is faster.
_KEPT, _LONG = 1 << 26, 16_384
#: Bits of a word, the longest text that the bit vectors hold.
_BITS = 64
_U = np.uint64


def _windows() -> np.ndarray:
    """For each reach and position, the bits of the positions within reach."""
    out = np.zeros((_BITS, _BITS), _U)
    for reach in range(_BITS):
        for i in range(_BITS):
            low, high = max(0, i - reach), min(_BITS - 1, i + reach)
            out[reach, i] = ((1 << (high + 1)) - 1) & ~((1 << low) - 1)
    return out


_WINDOWS = _windows()


class Spelt:
    """Distinct texts as arrays: characters, lengths and sets of letters."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes, self.lengths = _codes(texts)
        c = self.codes.astype(np.int64)
        letter, digit = (c >= 97) & (c <= 122), (c >= 48) & (c <= 57)
        kind = np.where(letter, c - 97, np.where(digit, c - 22, np.where(c == 32, 36, 37 + c % 27)))
        self.once, self.twice = np.zeros(len(texts), _U), np.zeros(len(texts), _U)
        for i in range(c.shape[1]):
            bit = np.where(i < self.lengths, _U(1) << kind[:, i].astype(_U), _U(0))
            self.twice |= self.once & bit
            self.once |= bit
        self.rest = self.lengths - np.bitwise_count(self.once) - np.bitwise_count(self.twice)
        self.one_byte = np.array([len(t) == 1 and t.isascii() for t in texts], bool)


def _prefix(a: Spelt, i: np.ndarray, b: Spelt, j: np.ndarray) -> np.ndarray:
    """How many of the first letters are the same."""
    same, out = np.ones(len(i), bool), np.zeros(len(i), np.int64)
    shorter = np.minimum(a.lengths[i], b.lengths[j])
    for k in range(min(PREFIX_LETTERS, a.codes.shape[1], b.codes.shape[1])):
        same &= (a.codes[i, k] == b.codes[j, k]) & (k < shorter)
        out += same
    return out


def _most(a: Spelt, i: np.ndarray, b: Spelt, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(most common letters, bound of Jaro-Winkler, equal first letters) of pairs of texts."""
    common = np.bitwise_count(a.once[i] & b.once[j]).astype(np.int64) + np.bitwise_count(a.twice[i] & b.twice[j]) + np.minimum(a.rest[i], b.rest[j])
    prefix = _prefix(a, i, b, j)
    la, lb = a.lengths[i], b.lengths[j]
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / la + common / lb + 1) / 3, 0.0)
    most = np.where((la == 0) & (lb == 0), 1.0, jaro + PREFIX_WEIGHT * prefix * (1 - jaro))
    return common, most, prefix


class Winkler:
    """Jaro-Winkler of pairs of texts of two blocks, on bit vectors of positions."""

    #: Cells of the table of positions at most.
    TABLE = 1 << 24

    def __init__(self, a: Spelt, b: Spelt):
        self.a, self.b = a, b
        inside = lambda s: np.arange(s.codes.shape[1]) < s.lengths[:, None]
        both = np.intersect1d(a.codes[inside(a)], b.codes[inside(b)])
        width = min(b.codes.shape[1], _BITS)
        most = self.TABLE // max(len(b.texts), 1) - 1
        #: Texts of the left with a letter that the table has no room for.
        self.rare = np.zeros(len(a.texts), bool)
        if len(both) > most:
            letters, found = np.unique(b.codes[inside(b)], return_counts=True)
            found = found[np.searchsorted(letters, both)]
            kept = np.sort(np.argsort(-found, kind="stable")[: max(most, 0)])
            self.rare = (np.isin(a.codes, np.delete(both, kept)) & inside(a)).any(axis=1)
            both = both[kept]
        place = lambda s: np.where(inside(s) & np.isin(s.codes, both), np.searchsorted(both, s.codes) + 1, 0)
        self.coded, own = place(a), place(b)
        self.size = len(both) + 1
        self.table = np.zeros((len(b.texts), self.size), _U)
        rows = np.arange(len(b.texts))
        for c in range(width):
            self.table[rows, own[:, c]] |= _U(1 << c)
        self.table[:, 0] = 0
        self.table = self.table.ravel()

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        la, lb = self.a.lengths[i], self.b.lengths[j]
        long = (la > _BITS) | (lb > _BITS) | self.rare[i]
        if long.any():
            some = np.flatnonzero(long)
            out[some] = jaro_winkler_pairs([self.a.texts[x] for x in i[some]], [self.b.texts[x] for x in j[some]])
        some = np.flatnonzero(~long)
        some = some[np.argsort(la[some], kind="stable")]
        for start in range(0, len(some), _STEP):
            part = some[start : start + _STEP]
            out[part] = self._step(i[part], j[part])
        return out

    def _step(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        la, lb = self.a.lengths[i], self.b.lengths[j]
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        base = j * self.size
        free = np.full(len(i), ~_U(0))
        at, hits = [], []
        for k in range(int(la.max(initial=0))):
            there = self.table[base + self.coded[i, k]]
            near = there & _WINDOWS[:, k][reach] & free
            low = near & (~near + _U(1))
            free ^= low
            at.append(there)
            hits.append(low != 0)
        matched = ~free
        m = np.bitwise_count(matched).astype(np.int64)
        differs = np.zeros(len(i), np.int64)
        for there, hit in zip(at, hits):
            low = matched & (~matched + _U(1))
            differs += hit & ((there & low) == 0)
            matched = np.where(hit, matched ^ low, matched)
        transposed = differs // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m > 0, (m / la + m / lb + (m - transposed) / np.maximum(m, 1)) / 3.0, 0.0)
        score = jaro + PREFIX_WEIGHT * _prefix(self.a, i, self.b, j) * (1 - jaro)
        equal = (la == lb) & (m == la) & (differs == 0)
        return np.where(equal, 1.0, np.where(m > 0, score, 0.0))


class Texts:
    """The texts of one side: how they are spelt, and their tokens as numbers in the vocabulary of that side."""

    def __init__(self, texts: list[str]):
        self.spelt = Spelt(texts)
        split = [t.split() for t in texts]
        words = {w: k for k, w in enumerate(sorted({w for x in split for w in x}))}
        self.n_tokens = np.array([len(x) for x in split], np.int64)
        self.tokens = np.full((len(texts), int(self.n_tokens.max(initial=1)) or 1), -1, np.int64)
        for i, x in enumerate(split):
            for k, token in enumerate(x):
                self.tokens[i, k] = words[token]
        self.words = Spelt(list(words))


class Compared:
    """Scores of pairs of texts of two sides."""

    def __init__(self, left: list[str], right: list[str]):
        self.a, self.b = Texts(left), Texts(right)
        known = {w: k for k, w in enumerate(self.b.words.texts)}
        #: The number of a word of the left in the vocabulary of the right, -1 for none.
        self.same = np.array([known.get(w, -1) for w in self.a.words.texts], np.int64)
        known = {t: k for k, t in enumerate(right)}
        #: The same of whole texts.
        self.same_text = np.array([known.get(t, -1) for t in left], np.int64)

    # the tables of these are large, and a sieve has no use for them
    @cached_property
    def string(self) -> Winkler:
        return Winkler(self.a.spelt, self.b.spelt)

    @cached_property
    def token(self) -> Winkler:
        return Winkler(self.a.words, self.b.words)

    def _bounds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Upper bounds of the similarity of tokens."""
        a, b = self.a.words, self.b.words
        common, most, prefix = _most(a, x, b, y)
        shorter = np.minimum(a.lengths[x], b.lengths[y])
        begins = (prefix >= np.minimum(shorter, PREFIX_LETTERS)) & (common >= shorter)
        return np.where(self.same[x] == y, 1.0, np.where(begins, np.maximum(most, PREFIX_SCORE), most))

    def token_pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The similarity of pairs of tokens: equal, initial, prefix, else Jaro-Winkler."""
        a, b = self.a.words, self.b.words
        out = np.zeros(len(x))
        shorter = np.minimum(a.lengths[x], b.lengths[y])
        begins = _prefix(a, x, b, y) >= np.minimum(shorter, PREFIX_LETTERS)
        for k in range(PREFIX_LETTERS, min(a.codes.shape[1], b.codes.shape[1])):
            some = np.flatnonzero(begins & (k < shorter))
            if not len(some):
                break
            begins[some] = a.codes[x[some], k] == b.codes[y[some], k]
        equal = self.same[x] == y
        out[begins] = np.where(a.one_byte[x[begins]] | b.one_byte[y[begins]], INITIAL_SCORE, PREFIX_SCORE)
        out[equal] = 1.0
        rest = np.flatnonzero(~begins & ~equal)
        out[rest] = self.token.scores(x[rest], y[rest])
        return out

    def _exact(self, x: np.ndarray, y: np.ndarray, where: np.ndarray | None) -> np.ndarray:
        """The similarity of tokens of pairs of texts; 0 but at ``where``."""
        width = len(self.b.words.texts)
        ids = (x[:, :, None] * width + y[:, None, :])
        asked = ids.ravel() if where is None else ids[where]
        pairs, back = np.unique(asked, return_inverse=True)
        values = self.token_pairs(pairs // width, pairs % width)[back]
        if where is None:
            return values.reshape(ids.shape)
        out = np.zeros(ids.shape)
        out[where] = values
        return out

    def scores(self, i: np.ndarray, j: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token score, string score) of pairs of texts: what may not reach the threshold is 0, and the string score where the token score does."""
        a, b = self.a, self.b
        token, string = np.zeros(len(i)), np.zeros(len(i))
        na, nb = a.n_tokens[i], b.n_tokens[j]
        least, most = np.minimum(na, nb), np.maximum(na, nb)
        with np.errstate(divide="ignore", invalid="ignore"):
            may = np.flatnonzero((least > 0) & (least / most - UNMATCHED_COST * (most - least) >= threshold - 1e-9))
        for own in _groups((na * (int(nb.max(initial=0)) + 1) + nb)[may]):
            own = may[own]
            nq, nt = int(na[own[0]]), int(nb[own[0]])
            step = max(1, 4 * _STEP // (nq * nt))
            for start in range(0, len(own), step):
                part = own[start : start + step]
                self._tokens(token, part, a.tokens[i[part], :nq], b.tokens[j[part], :nt], threshold[part])
        low = np.flatnonzero(token < threshold)
        for start in range(0, len(low), 4 * _STEP):
            part = low[start : start + 4 * _STEP]
            string[part] = self.reaching(self.string, i[part], j[part], threshold[part])
        return token, string

    def _tokens(self, token: np.ndarray, part: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: np.ndarray) -> None:
        (n, nq), nt = x.shape, y.shape[1]
        most = self._bounds(np.repeat(x, nt, axis=1).ravel(), np.tile(y, nq).ravel()).reshape(n, nq, nt)
        most[:, -1, -1] = np.minimum(most[:, -1, -1] + LAST_TOKEN_BOOST, 1.0)
        best_of = most.max(axis=2)
        total = np.minimum(best_of.sum(axis=1), most.max(axis=1).sum(axis=1))
        wanted = (threshold + UNMATCHED_COST * abs(nq - nt)) * max(nq, nt) - 1e-9
        some = np.flatnonzero(total >= wanted)
        if not len(some):
            return
        # a pair of tokens matters only if the others' best leave it enough to add; where those that matter reach the threshold, all are computed
        alone = wanted[some, None] - (best_of[some].sum(axis=1)[:, None] - best_of[some])
        matter = most[some] >= alone[:, :, None]
        first = self._exact(x[some], y[some], matter)
        near = np.flatnonzero(_greedy(first) >= threshold[some] - 1e-9)
        full = matter.all(axis=(1, 2))[near]
        for own, known in ((near[full], True), (near[~full], False)):
            if len(own):
                token[part[some[own]]] = _greedy(first[own] if known else self._exact(x[some[own]], y[some[own]], None))

    @staticmethod
    def reaching(winkler: Winkler, i: np.ndarray, j: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Jaro-Winkler of the pairs that may reach the threshold, else 0."""
        out = np.zeros(len(i))
        some = np.flatnonzero(_most(winkler.a, i, winkler.b, j)[1] >= threshold - 1e-9)
        out[some] = winkler.scores(i[some], j[some])
        return out


class _Kept:
    """What was made last, by key."""

    def __init__(self, most: int, make: Callable):
        self.most, self.make, self.held = most, make, OrderedDict()

    def __call__(self, key):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = self.make(key)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[key]


class Sorted:
    """Distinct texts in order, of which one text is compared with many by vectors."""

    def __init__(self, spelt: Spelt):
        self.spelt, self.texts = spelt, spelt.texts
        self.lengths = spelt.lengths
        self.rest = spelt.rest.astype(np.uint16)
        rows, columns = np.nonzero(np.arange(min(spelt.codes.shape[1], _BITS)) < spelt.lengths[:, None])
        letters = spelt.codes[rows, columns]
        order = np.argsort(letters, kind="stable")
        self.letters, self.starts = np.unique(letters[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.rows, self.bits = rows[order], _U(1) << columns[order].astype(_U)
        #: The positions of a letter in each text, as bits; None if it is nowhere.
        self.places = _Kept(max(32, _KEPT // (8 * max(len(self.texts), 1))), self._places)
        self.beginning = _Kept(4096, self._beginning)

    def _places(self, letter: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.letters, letter))
        if k == len(self.letters) or self.letters[k] != letter:
            return None
        out = np.zeros(len(self.texts), _U)
        part = slice(self.starts[k], self.ends[k])
        np.bitwise_or.at(out, self.rows[part], self.bits[part])
        return out

    def _beginning(self, text: str) -> tuple[int, int]:
        """From where to where texts begin like that."""
        first = lambda t: t[: len(text)]
        return bisect_left(self.texts, text, key=first), bisect_right(self.texts, text, key=first)

    def matched(self, at: np.ndarray, a: Spelt, x: int, differing: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(matched letters, those in another order) of the texts ``at`` and a text of ``a``, none longer than the bits of a word."""
        size = int(a.lengths[x])
        lengths = self.lengths[at]
        windows = np.ascontiguousarray(_WINDOWS[np.maximum(np.maximum(size, np.arange(_BITS + 1)) // 2 - 1, 0)].T)
        free = np.full(len(at), ~_U(0))
        seen = []
        for k in range(size):
            places = self.places(int(a.codes[x, k]))
            if places is None:
                continue
            there = places.take(at)
            near = windows[k].take(lengths)
            near &= there
            near &= free
            near &= np.negative(near)
            free ^= near
            if differing:
                seen.append((there, near != 0))
        matched = ~free
        m = np.bitwise_count(matched)
        if not differing:
            return m, None
        differs = np.zeros(len(at), np.int64)
        for there, hit in seen:
            low = matched & np.negative(matched)
            differs += hit & ((there & low) == 0)
            matched ^= np.where(hit, low, _U(0))
        return m, differs


class _Row(NamedTuple):
    """A word against a vocabulary: upper bounds of the similarities, and which are the similarities."""

    most: np.ndarray
    exact: np.ndarray


class Candidates:
    """Texts of a sieve, by their numbers in ascending order, with what is asked of them for each text of a name."""

    def __init__(self, sieve: Sieve, at: np.ndarray):
        self.at, spelt = at, sieve.texts
        self.once, self.twice, self.rest, self.lengths = spelt.spelt.once.take(at), spelt.spelt.twice.take(at), spelt.rest.take(at), spelt.lengths.take(at)
        self.n_tokens = sieve.n_tokens.take(at)
        self.groups: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        self.sieve = sieve

    def group(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Those of ``n`` tokens, and their tokens by position."""
        if n not in self.groups:
            some = np.flatnonzero(self.n_tokens == n)
            at = self.at[some]
            self.groups[n] = some, [self.sieve.tokens[k].take(at) for k in range(n)] if len(some) else []
        return self.groups[n]


class Sieve:
    """One text of a name with the candidates of a long list, by vectors."""

    #: Words are no longer than that in the bounds; words of so many texts are compared with the whole vocabulary once.
    LONGEST, FREQUENT = 127, 8

    def __init__(self, compared: Compared):
        self.a, b, self.same_text = compared.a, compared.b, compared.same_text
        self.texts, self.words = Sorted(b.spelt), Sorted(b.words)
        self.n_tokens = b.n_tokens.astype(np.uint16)
        self.counts = [int(n) for n in np.unique(b.n_tokens) if n]
        self.tokens = [np.ascontiguousarray(b.tokens[:, k]) for k in range(b.tokens.shape[1])]
        self.known = {w: k for k, w in enumerate(b.words.texts)}
        self.width = min(int(b.words.lengths.max(initial=0)), self.LONGEST) + 1
        self.by_length = np.minimum(b.words.lengths, self.width - 1) * self.width
        self.rows = _Kept(max(16, _KEPT // (9 * max(len(b.words.texts), 1))), self._row)
        self.uses = np.bincount(self.a.tokens[self.a.tokens >= 0], minlength=len(self.a.words.texts)).tolist()
        self.spare: list[tuple[np.ndarray, np.ndarray]] = []

    def scores(self, x: int, threshold: float, own: Candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places among the candidates, score, whether it is the token score) of those that reach the threshold and are not equal."""
        token, string = np.zeros(len(own.at)), np.zeros(len(own.at))
        self._by_tokens(token, x, threshold, own)
        by_token = (token >= threshold) & (token > 0)
        some = self._by_string(x, threshold, own, by_token)
        string[some] = self._winkler(self.texts, self.a.spelt, x, own.at[some])
        hit = np.flatnonzero((by_token | ((string >= threshold) & (string > 0))) & (own.at != self.same_text[x]))
        return hit, np.where(by_token, token, string)[hit], by_token[hit]

    @staticmethod
    def _winkler(texts: Sorted, a: Spelt, x: int, at: np.ndarray) -> np.ndarray:
        """Jaro-Winkler of a text of ``a`` and the texts ``at``, in ascending order."""
        size, out = int(a.lengths[x]), np.zeros(len(at))
        long = texts.lengths[at] > _BITS if size <= _BITS else np.ones(len(at), bool)
        if long.any():
            out[long] = jaro_winkler_pairs([a.texts[x]] * int(long.sum()), [texts.texts[y] for y in at[long]])
        short = np.flatnonzero(~long)
        at = at[short]
        if not len(at):
            return out
        m, differs = texts.matched(at, a, x, True)
        m, lengths = m.astype(np.int64), texts.lengths[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m > 0, (m / size + m / lengths + (m - differs // 2) / np.maximum(m, 1)) / 3.0, 0.0)
        prefix = np.zeros(len(at), np.int64)
        for k in range(1, min(PREFIX_LETTERS, size) + 1):
            start, stop = np.searchsorted(at, texts.beginning(a.texts[x][:k]))
            if start == stop:
                break
            prefix[start:stop] = k
        score = jaro + PREFIX_WEIGHT * prefix * (1 - jaro)
        equal = (lengths == size) & (m == size) & (differs == 0)
        out[short] = np.where(equal, 1.0, np.where(m > 0, score, 0.0))
        return out

    def _by_string(self, x: int, threshold: float, own: Candidates, known: np.ndarray) -> np.ndarray:
        """The places of those that may reach the threshold as a whole, without those known to match."""
        a, texts = self.a.spelt, self.texts
        size = int(a.lengths[x])
        if not size or not len(own.at):
            return np.zeros(0, np.int64)
        common = np.bitwise_count(own.once & a.once[x]) + np.bitwise_count(own.twice & a.twice[x]) + np.minimum(own.rest, np.uint16(a.rest[x]))
        longest = texts.spelt.codes.shape[1]
        with np.errstate(divide="ignore"):
            of_both = 1 / size + 1 / np.arange(longest + 1)

        def least(prefix: int) -> np.ndarray:
            """How many common letters are needed, by length."""
            jaro = (threshold - 1e-9 - PREFIX_WEIGHT * prefix) / (1 - PREFIX_WEIGHT * prefix)
            out = np.maximum(np.ceil((3 * jaro - 1) / of_both - 1e-6), 1)
            out[0] = longest + 1
            return out.astype(np.uint16)

        wanted = least(0).take(own.lengths)
        for k in range(1, min(PREFIX_LETTERS, size) + 1):
            start, stop = np.searchsorted(own.at, texts.beginning(a.texts[x][:k]))
            if start == stop:
                break
            wanted[start:stop] = least(k).take(own.lengths[start:stop])
        some = np.flatnonzero((common >= wanted) & ~known)
        if size > _BITS or not len(some):
            return some
        long = own.lengths[some] > _BITS
        short = some[~long]
        short = short[texts.matched(own.at[short], a, x)[0] >= wanted[short]]
        return np.sort(np.concatenate([short, some[long]])) if long.any() else short

    def _bounds(self, x: int, at: np.ndarray | slice) -> np.ndarray:
        """Upper bounds of the similarities of a word and the words ``at``."""
        a, words = self.a.words, self.words
        size = int(a.lengths[x])
        if size > self.LONGEST:
            return np.ones(len(self.by_length[at]))
        common = np.bitwise_count(words.spelt.once[at] & a.once[x]) + np.bitwise_count(words.spelt.twice[at] & a.twice[x]) + np.minimum(words.rest[at], np.uint16(a.rest[x]))
        c, lengths = np.arange(self.width), np.maximum(np.arange(self.width), 1)
        bounds = np.where(c > 0, np.minimum((c / size + c / lengths[:, None] + 1) / 3, 1), 0)
        return bounds.ravel().take(self.by_length[at] + np.minimum(common, self.width - 1))

    def _row(self, x: int, at: np.ndarray | None = None) -> _Row:
        """The bounds of a word: of a frequent one all, to be kept, else those of the words ``at``."""
        a, words = self.a.words, self.words
        text, size = a.texts[x], int(a.lengths[x])
        if at is None:
            most, exact = self._bounds(x, slice(None)), np.zeros(len(words.texts), bool)
        else:
            most, exact = self.spare.pop() if self.spare else (np.zeros(len(words.texts)), np.zeros(len(words.texts), bool))
            most[at], exact[at] = self._bounds(x, at), False
        jaro = most[slice(*words.beginning(text[:1]))].copy()
        first = words.beginning(text[:1])[0]
        for k in range(1, min(PREFIX_LETTERS, size) + 1):
            start, stop = words.beginning(text[:k])
            part = jaro[start - first : stop - first]
            most[start:stop] = part + PREFIX_WEIGHT * k * (1 - part)
        # one begins with the other
        start, stop = words.beginning(text)
        most[start:stop], exact[start:stop] = INITIAL_SCORE if a.one_byte[x] else PREFIX_SCORE, True
        for k in range(1, size + 1):
            y = self.known.get(text[:k])
            if y is not None:
                most[y], exact[y] = 1.0 if k == size else INITIAL_SCORE if words.spelt.one_byte[y] else PREFIX_SCORE, True
        return _Row(most, exact)

    def _settle(self, x: int, row: _Row, at: np.ndarray) -> None:
        """Puts the similarities in the place of their bounds."""
        at = at[~row.exact[at]]
        if len(at):
            at = np.unique(at)
            row.most[at] = self._winkler(self.words, self.a.words, x, at)
            row.exact[at] = True

    def _by_tokens(self, token: np.ndarray, x: int, threshold: float, own: Candidates) -> None:
        nq = int(self.a.n_tokens[x])
        tokens = self.a.tokens[x, :nq].tolist()
        # frequent words first, for they are known best
        order = sorted(range(nq), key=lambda i: -self.uses[tokens[i]])
        for nt in self.counts:
            if not nq or min(nq, nt) / max(nq, nt) - UNMATCHED_COST * abs(nq - nt) < threshold - 1e-9:
                continue
            some, columns = own.group(nt)
            wanted = (threshold + UNMATCHED_COST * abs(nq - nt)) * max(nq, nt) - 1e-9
            total = np.full(len(some), float(nq))
            rows: dict[int, _Row] = {}
            for i in order:
                if not len(some):
                    break
                w = tokens[i]
                rows[i] = row = self.rows(w) if self.uses[w] >= self.FREQUENT else self._row(w, np.concatenate(columns))
                # first by the bounds, then by the similarities of those pairs of tokens that matter: the best of the others leave them enough to add
                rest = total - 1
                for settled in (False, True):
                    scores = [row.most.take(c) for c in columns]
                    if i == nq - 1:
                        np.minimum(scores[-1] + LAST_TOKEN_BOOST, 1, out=scores[-1])
                    total = rest + (scores[0] if nt == 1 else np.maximum.reduce(scores))
                    kept = np.flatnonzero(total >= wanted)
                    some, columns, rest, total = some[kept], [c[kept] for c in columns], rest[kept], total[kept]
                    if not settled:
                        alone = wanted - rest
                        self._settle(w, row, np.concatenate([c[v[kept] >= alone] for c, v in zip(columns, scores)]))
            if len(some):
                for i, row in rows.items():
                    self._settle(tokens[i], row, np.concatenate(columns))
                token[some] = _greedy(np.stack([np.stack([rows[i].most.take(c) for c in columns], axis=1) for i in range(nq)], axis=1))
            self.spare += [(row.most, row.exact) for i, row in rows.items() if self.uses[tokens[i]] < self.FREQUENT]


class Side(NamedTuple):
    """Rows of one side of a block with their variants one after another.

    Names have ``lists``, ``scans``, ``threshold`` and ``base``; entries ``list_type``, ``initials`` and ``expanded``.
    """

    rows: pd.DataFrame
    first: np.ndarray
    count: np.ndarray
    text: np.ndarray
    translit: np.ndarray
    alias: np.ndarray


def _distinct(texts) -> tuple[np.ndarray, list[str]]:
    codes, values = pd.factorize(np.asarray(texts, object))
    return codes, list(values)


def best_matches(names: Side, entries: Side) -> Iterator[dict[str, np.ndarray]]:
    """The best match of each pair of a name and an entry that match, in parts, as arrays.

    Keys are name, entry, score, how, q and e (numbers of variants).
    """
    q_code, q_texts = _distinct(names.text)
    e_code, e_texts = _distinct(entries.text)
    primary = np.flatnonzero(~entries.alias)
    # an alias is looked up alone, so what is compared are primary texts, in their order
    p_code, p_texts = _distinct(entries.text[primary])
    in_order = sorted(range(len(p_texts)), key=p_texts.__getitem__)
    place = np.empty(len(p_texts), np.int64)
    place[in_order] = np.arange(len(p_texts))
    p_code, p_texts = place[p_code], [p_texts[k] for k in in_order]
    order = np.argsort(p_code, kind="stable")
    primary, p_code = primary[order], p_code[order]
    compared = Compared(q_texts, p_texts)
    sieve = Sieve(compared) if len(entries.rows) >= _LONG else None
    b_code, b_texts = _distinct(names.rows["base"])
    i_code, i_texts = _distinct(entries.rows["initials"])
    x_code, x_texts = _distinct(entries.rows["expanded"])
    base, initials = Spelt(b_texts), Spelt(i_texts)
    by_initials, by_expanded = cache(lambda: Winkler(base, initials)), cache(lambda: Winkler(base, Spelt(x_texts)))
    ne = len(entries.rows)
    e_row = np.repeat(np.arange(ne), entries.count)
    p_row = e_row[primary]
    of_entry: dict[int, list[int]] = {}
    for v, j in enumerate(p_row.tolist()):
        of_entry.setdefault(j, []).append(v)
    holders: dict[str, list[int]] = {}
    texts_of: dict[str, list[int]] = {}
    for j, keys in enumerate(entries.rows["keys"]):
        for k in keys:
            holders.setdefault(k, []).append(j)
            texts_of.setdefault(k, []).extend(of_entry.get(j, ()))
    held = {k: np.array(v) for k, v in holders.items()}
    texts_held = {k: np.array(v, np.int64) for k, v in texts_of.items()}
    kinds, list_names = _distinct(entries.rows["list_type"])
    wishes: dict[tuple[str, ...], int] = {}
    asked = np.array([wishes.setdefault(tuple(x), len(wishes)) for x in names.rows["lists"]], np.int64)
    wanted = np.array([[not w or x in w for x in list_names] for w in wishes], bool).reshape(len(wishes), len(list_names))
    by_text = pd.Series(np.arange(len(entries.text))).groupby(pd.Series([e_texts[c] for c in e_code], dtype=object)).indices if len(e_code) else {}
    equal_of = [by_text.get(t) for t in q_texts]
    p_kinds = kinds[p_row]
    threshold, scans, q_keys = names.rows["threshold"].to_numpy(float), names.rows["scans"].to_numpy(bool), names.rows["keys"].tolist()
    letters = initials.lengths[i_code]
    most_letters = int(letters.max(initial=0))
    out: list[tuple[np.ndarray, ...]] = []  # (name, entry, rank of the rung, score, rung, q, e, how)
    gathered: list[tuple[int, int, np.ndarray]] = []  # (name, number of its text, numbers of primary texts)

    def near(i: int, of: dict[str, np.ndarray], kind: np.ndarray) -> np.ndarray:
        """The candidates of a name, in the lists that it asks for."""
        there = np.full(len(kind), scans[i])
        for k in () if scans[i] else q_keys[i]:
            if k in of:
                there[of[k]] = True
        if not wanted[asked[i]].all():
            there &= wanted[asked[i]][kind]
        return np.flatnonzero(there)

    def add(i, j, rung, score, q, e, how):
        full = lambda v: np.broadcast_to(np.asarray(v), i.shape)
        out.append((i, j, full(score), full(rung), full(q), full(e), full(how)))

    def best() -> dict[str, np.ndarray]:
        """The best of what was gathered."""
        sizes = [len(v) for _, _, v in gathered]
        if sum(sizes):
            si, q = (np.repeat([g[c] for g in gathered], sizes) for c in (0, 1))
            v = np.concatenate([g[2] for g in gathered])
            sj, x, y, t = p_row[v], q_code[names.first[si] + q], p_code[v], threshold[si]
            token, string = compared.scores(x, y, t)
            same = compared.same_text[x] == y
            by_token = (token >= t) & (token > 0) & ~same
            hit = np.flatnonzero(by_token | ((string >= t) & (string > 0) & ~same))
            add(si[hit], sj[hit], FUZZY, np.where(by_token, token, string)[hit], q[hit], (primary[v] - entries.first[sj])[hit], np.where(by_token, BY_TOKEN, BY_STRING)[hit])
        i, j, score, rung, q, e, how = (np.concatenate(c) for c in zip(*out))
        out.clear()
        gathered.clear()
        # equal texts first; then the better score, the first variant, and initials only if strictly better
        order = np.lexsort((e, q, rung, -score, rung != SURE, j, i))
        i, j = i[order], j[order]
        first = np.ones(len(order), bool)
        first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        take = order[first]
        return {"name": i[first], "entry": j[first], "score": score[take].astype(float), "how": how[take], "q": q[take], "e": e[take]}

    waiting = 0
    # names of one text follow each other, for the sake of what is kept of their words
    for i in np.argsort(b_code, kind="stable").tolist():
        # equal texts
        for q in range(int(names.count[i])):
            v = names.first[i] + q
            some = equal_of[q_code[v]]
            if some is None:
                continue
            j, alias = e_row[some], entries.alias[some]
            kept = wanted[asked[i]][kinds[j]] & (~alias | (threshold[i] <= ALIAS_SCORE))
            some, j, alias = some[kept], j[kept], alias[kept]
            crossed = ~alias & (names.translit[v] | entries.translit[some])
            add(np.full(len(j), i), j, np.where(crossed, FUZZY, SURE), np.where(alias, ALIAS_SCORE, EXACT_SCORE), q, some - entries.first[j], np.where(alias, EXACT_ALIAS, np.where(crossed, TRANSLIT_EXACT, EXACT_PRIMARY)))
        # similar texts of candidate pairs, primary spellings only
        v = near(i, texts_held, p_kinds)
        own = Candidates(sieve, p_code[v]) if sieve else None
        for q in range(int(names.count[i])):
            if sieve:
                some, score, by_token = sieve.scores(int(q_code[names.first[i] + q]), threshold[i], own)
                add(np.full(len(some), i), p_row[v[some]], FUZZY, score, q, primary[v[some]] - entries.first[p_row[v[some]]], np.where(by_token, BY_TOKEN, BY_STRING))
                waiting += len(some)
            else:
                gathered.append((i, q, v))
                waiting += len(v)
        # the question of initials, for the first texts of either side
        size = int(base.lengths[b_code[i]])
        if most_letters and size <= 2 * most_letters:
            j = near(i, held, kinds)
            j = j[(letters[j] > 0) & (size <= 2 * letters[j]) & (letters[j] <= 2 * size)]
            si = np.full(len(j), i)
            fit = np.zeros(0, bool) if not len(j) else Compared.reaching(by_initials(), b_code[si], i_code[j], np.full(len(j), INITIALS_SCORE)) >= INITIALS_SCORE
            si, j = si[fit], j[fit]
            score = by_expanded().scores(b_code[si], x_code[j]) if len(si) else np.zeros(0)
            hit = np.flatnonzero((score >= threshold[i]) & (score > 0))
            add(si[hit], j[hit], INITIAL, score[hit], 0, 0, BY_INITIALS)
        if waiting >= _PAIRS:
            waiting = 0
            yield best()
    if out or waiting:
        yield best()
