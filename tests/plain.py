"""Screening written plainly, for comparison: one name against one entry at a time."""

from __future__ import annotations

import unicodedata

from namelens.functions.normalize import ALTERNATIVE, STANDARD, expand_initials, fold_text


def is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


def translit(text: str, table: dict[str, str]) -> str:
    return " ".join("".join(table.get(c, c if c.isspace() else "") for c in text).split())


def list_variants(name: str) -> list[tuple[str, str]]:
    fold = fold_text(name)
    base = " ".join("".join(" " if is_mark(c) else c for c in fold).split())
    out: list[str] = []
    run = ""
    for part in "".join(c for c in fold if not is_mark(c)).split():
        if len(part.encode()) == 1:
            run += part
            continue
        out += ([run] if run else []) + [part]
        run = ""
    compact = " ".join(out + ([run] if run else []))
    own = [(base, "base")] + ([(compact, "no_punct")] if compact != base else [])
    more = [(t, "translit") for text, _ in own if any("Ѐ" <= c <= "ԯ" for c in text) for t in dict.fromkeys([translit(text, STANDARD), translit(text, ALTERNATIVE)]) if t]
    return first_of_each(own + more)


def first_of_each(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for text, label in pairs:
        seen.setdefault(text, label)
    return list(seen.items())


def lower(text: str) -> str:
    """Lower case letter by letter."""
    return text.translate({0x130: "i", 0x3A3: "σ"}).lower()


def letters_of(name: str) -> list[str]:
    return [next((lower(c) for c in part if c.isalpha()), "") for part in name.split()]


def asked_variants(name: str) -> list[tuple[str, str]]:
    parts = name.split()
    extra = []
    if len(parts) >= 2:
        head = " ".join(letters_of(name)[:-1])
        extra.append(head + (" " if head else "") + parts[-1])
        extra.append(" ".join(" ".join(lower(p)) if p.isalpha() and 2 <= len(p.encode()) <= 3 and p.upper() == p else lower(p) for p in parts))
    return first_of_each(list_variants(name) + [(t, "base") for t in extra if t])


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for j, c in enumerate(b) if used[j]]
    t = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + 0.1 * p * (1 - jaro)


def token_pair(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a.startswith(b) or b.startswith(a):
        return 0.85 if 1 in (len(a.encode()), len(b.encode())) else 0.9
    return jaro_winkler(a, b)


def token_match(query: list[str], target: list[str]) -> float:
    """For one query token after the other the free target that scores best; what has no partner costs."""
    if not (query and target):
        return 0.0
    last = (len(query) - 1, len(target) - 1)
    table = [[min(token_pair(q, t) + 0.05 * ((i, j) == last), 1.0) for j, t in enumerate(target)] for i, q in enumerate(query)]
    taken: dict[int, float] = {}
    for row in table:
        open_ones = sorted((-score, j) for j, score in enumerate(row) if j not in taken and score > 0)
        taken.update({j: -negative for negative, j in open_ones[:1]})
    unpaired = len(query) + len(target) - 2 * len(taken)
    return max(sum(taken.values()) / max(len(query), len(target)) - 0.15 * unpaired, 0.0)


def keys(variants: list[tuple[str, str]]) -> set[str]:
    return {t[:2] for text, _ in variants for t in text.split()}


def candidates(name: str, entry: tuple, threshold: float):
    """All ways in which a name matches an entry (id, name, aliases, ...): (class, -score, place, score, type, method), the least first."""
    own = entry[1] or ""
    spelt = [(text, label, False) for text, label in list_variants(own)]
    spelt += [(text, label, True) for alias in entry[2] or [] for text, label in list_variants(alias or "")]
    asked = asked_variants(name)
    for i, (q, q_label) in enumerate(asked):
        for j, (e, e_label, is_alias) in enumerate(spelt):
            if q == e and is_alias:
                yield from [(0, -0.95, (i, j), 0.95, "alias", "exact_alias")] * (threshold <= 0.95)
            elif q == e and "translit" in (q_label, e_label):
                yield (1, -1.0, (0, i, j), 1.0, "fuzzy", "transliterated_exact")
            elif q == e:
                yield (0, -1.0, (i, j), 1.0, "exact", "exact_primary")
            elif not is_alias:
                both = [(token_match(q.split(), e.split()), "token"), (jaro_winkler(q, e), "fuzzy")]
                reached = [(score, method) for score, method in both if score >= threshold and score > 0]
                for score, method in reached[:1]:  # the token score goes first, be it the lower one
                    yield (1, -score, (0, i, j), score, "fuzzy", method)
    initials = "".join(letters_of(own))
    if initials and jaro_winkler(asked[0][0], initials) >= 0.9:
        score = jaro_winkler(asked[0][0], list_variants(expand_initials(initials, own))[0][0])
        if score >= threshold and score > 0:
            yield (1, -score, (1,), score, "initial", None)  # behind equally good texts


def match(name: str, entry: tuple, threshold: float):
    """(score, match_type, method) of a name and an entry, or None."""
    best = min(candidates(name, entry, threshold), key=lambda c: c[:3], default=None)
    return best and best[3:]


def screen(name: str, people: list[tuple], threshold: float, lists=()) -> list[tuple]:
    """[(id, score, match_type, method)] of all entries (id, name, aliases, nationality, list_type), ranked."""
    chosen = [p for p in people if not lists or p[4] in lists]
    asked = asked_variants(name)
    wanted = keys(asked)
    near = [p for p in chosen if wanted & keys([v for s in [p[1] or "", *(p[2] or [])] for v in list_variants(s or "")])]
    if asked[0][0] == "" or not wanted or not near:
        near = chosen
    found = [(p[0], *m) for p in near if (m := match(name, p, threshold))]
    return sorted(found, key=lambda m: (-m[1], m[0]))
