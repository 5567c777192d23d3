"""String similarities, on single pairs and on arrays of pairs.

The array forms work on all pairs of a batch at once, one character position at a time, so the cost of
Python is spread over the batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

PREFIX_LETTERS = 4
PREFIX_WEIGHT = 0.1
INITIAL_SCORE = 0.85
PREFIX_SCORE = 0.9
LAST_TOKEN_BOOST = 0.05
UNMATCHED_COST = 0.15


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler by code points, the prefix always counted; 1 for equal texts, 0 if one is empty."""
    return float(jaro_winkler_pairs([a], [b])[0])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    width = int(lengths.max(initial=1)) or 1
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(texts), width), lengths


#: Cells of a comparison matrix at a time.
_CELLS = 4_000_000


def jaro_winkler_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """``jaro_winkler`` of each pair of two lists."""
    out = np.zeros(len(left))
    order = np.argsort([max(len(a), len(b)) for a, b in zip(left, right)], kind="stable")
    start = 0
    while start < len(order):
        widest = max(len(left[order[start]]), len(right[order[start]]), 1)
        stop = start + 1
        while stop < len(order):
            widest = max(widest, len(left[order[stop]]), len(right[order[stop]]))
            if (stop + 1 - start) * widest > _CELLS:
                break
            stop += 1
        some = order[start:stop]
        out[some] = _jaro_winkler([left[i] for i in some], [right[i] for i in some])
        start = stop
    return out


def _jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    a, la = _codes(left)
    b, lb = _codes(right)
    n, width_b = len(left), b.shape[1]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free = np.arange(width_b) < lb[:, None]
    place = np.arange(width_b)
    matched_a = np.zeros(a.shape, bool)
    matched_b = np.zeros(b.shape, bool)
    rows = np.arange(n)
    for i in range(a.shape[1]):
        low, high = max(0, i - int(reach.max())), min(width_b, i + int(reach.max()) + 1)
        if low >= high:
            continue
        part = slice(low, high)
        near = (b[:, part] == a[:, i : i + 1]) & free[:, part] & (np.abs(place[part] - i) <= reach[:, None]) & (i < la)[:, None]
        j = near.argmax(axis=1)
        hit = near[rows, j]
        matched_a[:, i] = hit
        at = j[hit] + low
        free[rows[hit], at] = False
        matched_b[rows[hit], at] = True
    m = matched_a.sum(axis=1)
    # the matched characters of either side in order; those that differ are half-transposed
    ra, rb = np.nonzero(matched_a), np.nonzero(matched_b)
    differs = a[ra] != b[rb]
    transposed = np.bincount(ra[0][differs], minlength=n) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - transposed) / np.maximum(m, 1)) / 3.0, 0.0)
    k = min(PREFIX_LETTERS, a.shape[1], b.shape[1])
    same = (a[:, :k] == b[:, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1) if k else 0
    score = jaro + PREFIX_WEIGHT * prefix * (1 - jaro)
    equal = (la == lb) & ((a[:, : min(a.shape[1], width_b)] == b[:, : min(a.shape[1], width_b)]).all(axis=1))
    return np.where(equal, 1.0, np.where(m > 0, score, 0.0))


def token_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """The similarity of each pair of tokens: equal, initial, prefix, else Jaro-Winkler."""
    out = np.zeros(len(left))
    rest = []
    for i, (a, b) in enumerate(zip(left, right)):
        if a == b:
            out[i] = 1.0
        elif a.startswith(b) or b.startswith(a):
            # an initial is a token of one byte
            out[i] = INITIAL_SCORE if len(a.encode()) == 1 or len(b.encode()) == 1 else PREFIX_SCORE
        else:
            rest.append(i)
    if rest:
        out[rest] = jaro_winkler_pairs([left[i] for i in rest], [right[i] for i in rest])
    return out


def token_pair_score(a: str, b: str) -> float:
    return float(token_pairs([a], [b])[0])


def token_match_pairs(queries: list[tuple[str, ...]], targets: list[tuple[str, ...]]) -> np.ndarray:
    """The order-independent similarity of each pair of token lists.

    In the order of the query each token takes the best free target token, the last with the last a
    little more; unmatched tokens cost.  Pairs with the same numbers of tokens are computed together.
    """
    out = np.zeros(len(queries))
    known: dict[tuple[str, str], int] = {}
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (q, t) in enumerate(zip(queries, targets)):
        if q and t:
            shapes.setdefault((len(q), len(t)), []).append(k)
            for x in q:
                for y in t:
                    known.setdefault((x, y), len(known))
    values = token_pairs([x for x, _ in known], [y for _, y in known]) if known else np.zeros(0)
    for (nq, nt), own in shapes.items():
        index = np.array([[[known[x, y] for y in targets[k]] for x in queries[k]] for k in own])
        out[own] = _greedy(values[index])
    return out


def _greedy(score: np.ndarray) -> np.ndarray:
    """Token match of pairs with the same numbers of tokens, from their token similarities (pair, query, target)."""
    n, nq, nt = score.shape
    score = score.copy()
    score[:, -1, -1] = np.minimum(score[:, -1, -1] + LAST_TOKEN_BOOST, 1.0)
    total, matches, rows = np.zeros(n), np.zeros(n), np.arange(n)
    used = np.zeros((n, nt), bool)
    for i in range(nq):
        row = np.where(used, -1.0, score[:, i, :])
        best = row.argmax(axis=1)
        value = row[rows, best]
        took = value > 0
        used[rows[took], best[took]] = True
        total += np.where(took, value, 0.0)
        matches += took
    return np.maximum(total / max(nq, nt) - (nq + nt - 2 * matches) * UNMATCHED_COST, 0.0)


def token_match(query: list[str], target: list[str]) -> float:
    return float(token_match_pairs([tuple(query)], [tuple(target)])[0])


class Texts:
    """The distinct texts of one side of a batch of pairs, as arrays: characters, letter counts, tokens."""

    def __init__(self, texts: list[str], vocabulary: dict[str, int]):
        self.codes, self.lengths = _codes(texts)
        n = len(texts)
        rows = np.repeat(np.arange(n), self.codes.shape[1])
        inside = (np.arange(self.codes.shape[1]) < self.lengths[:, None]).ravel()
        bins = rows[inside] * _BINS + self.codes.ravel()[inside] % _BINS
        self.counts = np.bincount(bins, minlength=n * _BINS).reshape(n, _BINS).astype(np.int16)
        split = [t.split() for t in texts]
        self.n_tokens = np.array([len(x) for x in split], np.int64)
        self.tokens = np.full((n, int(self.n_tokens.max(initial=1)) or 1), -1, np.int64)
        for i, x in enumerate(split):
            for j, token in enumerate(x):
                self.tokens[i, j] = vocabulary.setdefault(token, len(vocabulary))


#: Classes of characters that are counted together for the bound on common characters.
_BINS = 32


def scored_pairs(left: np.ndarray, right: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token score, string score) of pairs of texts, the latter 0 unless it may reach the threshold and the former does not."""
    left_code, left_texts = pd.factorize(left)
    right_code, right_texts = pd.factorize(right)
    vocabulary: dict[str, int] = {}
    a, b = Texts(list(left_texts), vocabulary), Texts(list(right_texts), vocabulary)
    words = list(vocabulary)
    spelt = Texts(words, {})
    token = np.zeros(len(left))
    shape = a.n_tokens[left_code] * (int(b.n_tokens.max(initial=0)) + 1) + b.n_tokens[right_code]
    for own in _groups(shape):
        nq, nt = int(a.n_tokens[left_code[own[0]]]), int(b.n_tokens[right_code[own[0]]])
        # what matched tokens can add up to at most
        if not nq or not nt:
            continue
        best = min(nq, nt) / max(nq, nt) - UNMATCHED_COST * abs(nq - nt)
        own = own[threshold[own] <= best + 1e-9]
        for part in np.array_split(own, max(1, len(own) * nq * nt // _CELLS * _BINS)):
            x, y = a.tokens[left_code[part], :nq, None], b.tokens[right_code[part], None, :nt]
            most = _token_bounds(spelt, x, y)
            most[:, -1, -1] = np.minimum(most[:, -1, -1] + LAST_TOKEN_BOOST, 1.0)
            best_of = most.max(axis=2)
            total = np.minimum(best_of.sum(axis=1), most.max(axis=1).sum(axis=1))
            wanted = (threshold[part] + UNMATCHED_COST * abs(nq - nt)) * max(nq, nt) - 1e-9
            some = total >= wanted
            if some.any():
                # a pair of tokens matters only if the others' best leave it enough to add; where those that
                # matter reach the threshold, all are computed
                alone = wanted[some, None] - (best_of[some].sum(axis=1)[:, None] - best_of[some])
                ids = (x * len(words) + y)[some]
                first = _greedy(_exact(ids, most[some] >= alone[:, :, None], words))
                near = first >= threshold[part[some]] - 1e-9
                token[part[some][near]] = _greedy(_exact(ids[near], None, words))
    low = np.flatnonzero(token < threshold)
    i, j = left_code[low], right_code[low]
    la, lb = a.lengths[i], b.lengths[j]
    common = np.minimum(a.counts[i], b.counts[j]).sum(axis=1)
    k = min(PREFIX_LETTERS, a.codes.shape[1], b.codes.shape[1])
    prefix = np.cumprod((a.codes[i, :k] == b.codes[j, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None]), axis=1).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / la + common / lb + 1) / 3, 0.0)
    most = np.where((la == 0) & (lb == 0), 1.0, jaro + PREFIX_WEIGHT * prefix * (1 - jaro))
    low = low[most >= threshold[low] - 1e-9]
    string = np.zeros(len(left))
    string[low] = jaro_winkler_pairs([left_texts[x] for x in left_code[low]], [right_texts[x] for x in right_code[low]])
    return token, string


def _exact(ids: np.ndarray, where: np.ndarray | None, words: list[str]) -> np.ndarray:
    """The similarity of pairs of tokens, given by numbers; 0 but at ``where``."""
    asked = ids.ravel() if where is None else ids[where]
    pairs, back = np.unique(asked, return_inverse=True)
    values = token_pairs([words[i // len(words)] for i in pairs], [words[i % len(words)] for i in pairs])[back]
    if where is None:
        return values.reshape(ids.shape)
    out = np.zeros(ids.shape)
    out[where] = values
    return out


def _token_bounds(spelt: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarity of tokens, given by their numbers, from their lengths, letters and beginnings."""
    lx, ly = spelt.lengths[x], spelt.lengths[y]
    shape = np.broadcast_shapes(x.shape, y.shape)
    common = np.zeros(shape, np.int16)
    for k in range(_BINS):
        column = spelt.counts[:, k]
        common += np.minimum(column[x], column[y])
    same, prefix = np.ones(shape, bool), np.zeros(shape, np.int8)
    shorter = np.minimum(lx, ly)
    for k in range(min(PREFIX_LETTERS, spelt.codes.shape[1])):
        column = spelt.codes[:, k]
        same &= (column[x] == column[y]) & (k < shorter)
        prefix += same
    jaro = np.where(common > 0, (common / lx + common / ly + 1) / 3, 0.0)
    most = jaro + PREFIX_WEIGHT * prefix * (1 - jaro)
    # one may begin with the other
    begins = (prefix >= np.minimum(shorter, PREFIX_LETTERS)) & (common >= shorter)
    return np.where(x == y, 1.0, np.where(begins, np.maximum(most, PREFIX_SCORE), most))


def _groups(values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(order) else []
