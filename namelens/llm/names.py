"""Names of persons and organisations as bags of folded words, and how well two of them agree.

A spelling is folded to lower-case Latin words: characters in their usual form, Cyrillic and Greek
transliterated, marks dropped, titles, particles and legal forms set aside.  Words are alike by the Dice
coefficient of their letter pairs, as nicknames of each other, as an initial or as an abbreviation.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import regex
import xxhash

from namelens.llm.lookalikes import usual_form

# Transliteration of Cyrillic and Greek letters, titles, particles, legal forms, nicknames.
CYRILLIC = dict(zip("абвгдезийклмнопрстуфхцыэіїєґўј", "a b v g d e z i i k l m n o p r s t u f kh ts y e i i e g u j".split())) | {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "ё": "e"}
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split()))
LATIN = {"ß": "ss", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d", "ħ": "h"}
TITLES = set("mr mrs ms miss dr prof ing eng gen col maj capt sir sheikh shaikh hajji hon rev lt sgt".split())
PARTICLES = set("al el bin ibn ben bint abu ould de la le van von der den du da dos di".split())
LEGAL = set("ltd limited llc ooo jsc ao oao zao pjsc gmbh gesellschaft mbh mit beschrankter haftung sa societe anonyme as anonim sirketi fze free zone establishment co company inc corp corporation plc ag kg bv nv srl spa sarl joint stock liability the".split())
NICKNAMES = [
    group.split()
    for group in (
        "alexander alex sandy sasha sanya shura xander aleksandr oleksandr", "benjamin ben benny", "christopher chris kit topher", "edward ed eddie ted ned teddy", "elizabeth elisabeth liz beth betty eliza lisa lizzie",
        "francisco pancho paco fco francis cisco kiko", "francois franck frank", "guillermo memo gmo william guille", "william will bill billy liam", "jose pepe joseph", "katherine kate kathy kat katie catherine",
        "margaret peggy maggie meg greta", "nicolas nico nick nicholas", "richard rick dick richie", "robert bob bobby rob", "theodore theo ted teddy", "thomas tom tommy", "zoe zoey", "jurgen jorg juergen", "maria mary",
        "anastasiya nastya stasya", "andrey andriy", "bogdan bohdan", "dmitriy dima dmytro mitya", "grigoriy grisha hryhoriy", "igor ihor", "konstantin kostya kostiantyn", "lyudmila lyuda ludmila mila", "mikhail misha mykhailo",
        "nataliya natasha natalia", "nikolay kolya mykola", "oksana ksenia ksenya xana", "pavel pasha pavlo", "ruslan rusik", "sergey serhiy seryozha", "stanislav stas", "svetlana sveta svitlana lana", "tamara toma",
        "vyacheslav slava viacheslav", "yaroslav yarik slava", "yekaterina katya ekaterina kateryna", "yevgeniy zhenya evgeny yevhen", "zakhar zakharko", "mohammed mohd mhd mehmet muhammad mohamed", "abdullah abdallah", "hussein husayn huseyin",
        "mustafa mostafa", "ibrahim ebrahim abraham", "yousef yusuf joseph", "suleiman soleiman", "zaynab zeinab", "jamal gamal djamal", "maryam mariam", "qasim qassem kassem", "bao pao", "qiang chiang", "xiao hsiao", "zhi chih", "guo kuo", "jian chien",
    )
]
#: Words of which the last letters vary with the transliteration.
_ENDINGS = [("off", "ov"), ("eff", "ev"), ("ow", "ov"), ("ew", "ev"), ("iy", "i"), ("yy", "i"), ("yi", "i"), ("ij", "i"), ("ei", "i"), ("ey", "i"), ("ai", "i"), ("ay", "i")]
_LETTERS = [("tch", "ch"), ("dj", "j"), ("dzh", "j"), ("sch", "sh"), ("kh", "h"), ("gh", "g"), ("ph", "f"), ("ck", "k"), ("ts", "c"), ("tz", "c"), ("cz", "c"), ("oe", "o"), ("ue", "u"), ("ae", "a"), ("ou", "u"), ("oo", "u"), ("ee", "i"), ("w", "v"), ("q", "k"), ("x", "ks"), ("y", "i"), ("j", "i")]

_ALIKE: dict[str, set[int]] = {}
for _i, _group in enumerate(NICKNAMES):
    for _w in _group:
        _ALIKE.setdefault(_w, set()).add(_i)

#: Spellings, words and pairs of words of which a worker keeps what was found: enough for those that follow each other, whatever
#: the size of a list.
_TEXTS_KEPT, _WORDS_KEPT, _PAIRS_KEPT = 1 << 12, 1 << 15, 1 << 16

_WORDS = regex.compile(r"[^\p{L}\p{N}]+")
_DOTTED = regex.compile(r"\b(?:\p{L}\.){2,}(?:\p{L}\b)?")


@lru_cache(maxsize=_TEXTS_KEPT)
def fold(value: str) -> tuple[str, ...]:
    """The folded words of a spelling, in order: titles and legal forms as well."""
    text, _ = usual_form(value)
    text = text.casefold()
    text = _DOTTED.sub(lambda m: m.group().replace(".", "") if len(m.group()) > 4 or m.group().replace(".", "") in LEGAL else m.group(), text)
    out = []
    for c in unicodedata.normalize("NFD", text.replace("i̇", "i")):
        if unicodedata.category(c) == "Mn":
            continue
        out.append(CYRILLIC.get(c) if c in CYRILLIC else GREEK.get(c) if c in GREEK else LATIN.get(c, c))
    joined = "".join(out).replace("'", "").replace("’", "")
    return tuple(w for w in _WORDS.split(joined) if w)


@lru_cache(maxsize=_WORDS_KEPT)
def sound(word: str) -> str:
    """A word without the differences that transliteration makes, and without doubled letters."""
    for a, b in _ENDINGS:
        if len(word) > 4 and word.endswith(a):
            word = word[: -len(a)] + b
            break
    for a, b in _LETTERS:
        word = word.replace(a, b)
    out = []
    for c in word:
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and transpositions between two words; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _left_out(word: str) -> set[str]:
    """A word, and the same with each letter left out: two words one error apart have one of these in common."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


#: Few sets are the groups or initials of many words; equal ones are one object.
_ONE: dict[frozenset, frozenset] = {}
_NEAR: dict[str, set[str]] = {}
for _w in _ALIKE:
    if len(_w) >= 4:
        for _part in _left_out(_w):
            _NEAR.setdefault(_part, set()).add(_w)
_LONGEST = max(map(len, _ALIKE))


def _one(found: frozenset) -> frozenset:
    if len(_ONE) >= _WORDS_KEPT:
        _ONE.clear()
    return _ONE.setdefault(found, found)


@lru_cache(maxsize=_WORDS_KEPT)
def nickname_groups(word: str) -> frozenset[int]:
    """The nickname groups of a word, one typing error allowed in longer ones."""
    found = _ALIKE.get(word, set())
    if not found and 4 <= len(word) <= _LONGEST + 1:
        near = set().union(*(_NEAR.get(part, ()) for part in _left_out(word)))
        found = {g for known in near if edits(word, known, 1) <= 1 for g in _ALIKE[known]}
    return _one(frozenset(found))


#: Bits of a word's vector.
BITS = 128
#: Least Dice coefficient of two words that are taken for spellings of one.
CLOSE = 0.5
#: What an initial, a nickname and an abbreviation count beside an equal word.
INITIAL, NICKNAME, ABBREVIATED = 0.6, 0.9, 0.85


@lru_cache(maxsize=_WORDS_KEPT)
def vector(word: str) -> int:
    """The letter pairs of a word by sound, its two ends marked, as a fixed bit vector."""
    s = f"^{sound(word)}$"
    bits = 0
    for i in range(len(s) - 1):
        bits |= 1 << (xxhash.xxh32_intdigest(s[i : i + 2]) % BITS)
    return bits


def dice(a: int, b: int) -> float:
    """The Dice coefficient of two bit vectors."""
    both = a.bit_count() + b.bit_count()
    return 2 * (a & b).bit_count() / both if both else 0.0


@lru_cache(maxsize=_PAIRS_KEPT)
def word_likeness(a: str, b: str) -> float:
    """How alike two words are: 1 equal, 0 not at all; else the Dice coefficient of their vectors."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return INITIAL if a in initials_of(b) or sound(a)[:1] in initials_of(b) else 0.0
    if nickname_groups(a) & nickname_groups(b):
        return NICKNAME
    d = dice(vector(a), vector(b))
    return d if d >= CLOSE else 0.0


@lru_cache(maxsize=_WORDS_KEPT)
def initials_of(word: str) -> frozenset[str]:
    """The letters that a word may be shortened to: its first one, as written and by sound, and those of its nicknames."""
    return _one(frozenset({word[:1], sound(word)[:1]} | {w[0] for g in _ALIKE.get(word, ()) for w in NICKNAMES[g]}))


@lru_cache(maxsize=_WORDS_KEPT)
def abbreviates(a: str, b: str) -> bool:
    """Whether the shorter word abbreviates the longer one: the same first letter, the others in order."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2 or a[0] != b[0] or len(b) - len(a) < 2:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


_SERVANT = regex.compile(r"abd(?:[uea]?[lr]?)")


@lru_cache(maxsize=_TEXTS_KEPT)
def person_words(value: str) -> tuple[str, ...]:
    """The words of a person's spelling but for titles and particles; "Abd al-X" in its many forms is one word."""
    words = [w for w in fold(value) if w not in TITLES and w not in PARTICLES]
    out: list[str] = []
    for w in words:
        if out and _SERVANT.fullmatch(out[-1]):
            out[-1] = "abdul" + regex.sub("^[ae]l(?=..)", "", w)
        elif len(w) > 6 and (m := _SERVANT.match(w)) and len(w) - m.end() >= 3:
            rest = w[m.end() :]
            out.append("abdul" + (rest[1:] if rest[0] == rest[1] else rest))
        else:
            out.append(w)
    return tuple(out) or fold(value)


@lru_cache(maxsize=_TEXTS_KEPT)
def firm_words(value: str) -> tuple[str, ...]:
    words = tuple(w for w in fold(value) if w not in LEGAL and len(w) > 1 and w not in ("for", "of", "and"))
    return words or fold(value)


def words_of(value: str, person: bool) -> tuple[str, ...]:
    return person_words(value) if person else firm_words(value)


def likeness(a: Sequence[str], b: Sequence[str], rare_a: Sequence[bool], rare_b: Sequence[bool], person: bool) -> float:
    """The Dice coefficient of two spellings over their words, each word counting by its length.

    Each word takes its best free partner; two neighbouring words may be one on the other side.  Words
    left over on one side only are missing there and cost nothing; left over on both sides, those of the
    side with fewer letters left count as unlike.  Unless a rare word of either has a partner that is
    rare in the other, spellings are alike only if all of their words are.
    """
    pairs = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s = word_likeness(x, y)
            if s < ABBREVIATED and not person and abbreviates(x, y):
                s = ABBREVIATED
            if s:
                pairs.append((s, min(len(x), len(y)), -abs(i - j), i, j))
    if not pairs:
        return 0.0
    pairs.sort(reverse=True)
    left, right = set(range(len(a))), set(range(len(b)))
    weight = total = 0.0
    told = False
    for s, _, _, i, j in pairs:
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            told = told or (rare_a[i] and rare_b[j] and min(len(a[i]), len(b[j])) > 1)
            w = min(len(a[i]), len(b[j]))
            weight += w
            total += w * s
    for p, q, own, other, rare_p, rare_q in ((a, b, left, right, rare_a, rare_b), (b, a, right, left, rare_b, rare_a)):
        for j in sorted(other):
            for i in sorted(own):
                if i + 1 in own and j in other and len(q[j]) > 3:
                    s = word_likeness(p[i] + p[i + 1], q[j])
                    if s > INITIAL:
                        own -= {i, i + 1}
                        other.discard(j)
                        weight += len(q[j])
                        total += len(q[j]) * s
                        told = told or rare_q[j]
                        break
    if not told and (left or right or total < 0.95 * weight or weight < 6):
        return 0.0
    lost = [sum(max(1, len(p[i]) - 1) for i in own) for p, own in ((a, left), (b, right))]
    return total / (weight + min(lost))
