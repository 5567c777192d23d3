"""Text that looks the same but differs in its characters.

For each word the sets of scripts that its letters may belong to are intersected.  An empty
intersection is a mixed word, and the script in which most letters cannot be anything else wins.
A word of one script whose letters all look like letters of the name's script is a whole-script
stand-in and is respelt too.  What is no matter of script is brought to its usual form: invisible
characters vanish, other blanks become plain ones, compatibility variants and decomposed letters
are replaced by what they stand for.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens.llm.values import name_values

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC_LIKE = dict(zip("АВЕКМНОРСТУХІЇЅЈԌԚԜҮѴӀаеорсухіїѕјһԁԛԝѵӏё", "ABEKMHOPCTYXIÏSJGQWYVIaeopcyxiïsjhdqwvlë"))
GREEK_LIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ", "ABEZHIKMNOPTYXaivopu"))
ARMENIAN_LIKE = dict(zip("ՍՕՏԼսօոհյցզ", "UOSLuonhjgq"))
CHEROKEE_LIKE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHIJKLMPRSTVWZ"))
#: Variants within the Latin script.
LATIN_VARIANTS = {"ɡ": "g", "ɑ": "a", "ɩ": "i", "ʋ": "v", "ꞌ": "'"}
#: Marks with a plainer usual form.
MARK_VARIANTS = {c: "-" for c in "‐‑‒–—―−"} | {c: "'" for c in "‘’ʼʻ′`´"} | {c: '"' for c in "“”„″"}
#: The Cyrillic letters in everyday use that stand in for Latin ones both ways.
CYRILLIC_USUAL = "АВЕКМНОРСТУХІЇаеорсухіїё"
#: Characters with a compatibility form that are themselves the usual ones.
USUAL = set("ªº…№™²³¹¼½¾ำຳ¨¯¸")
#: The scripts that are told apart, and those written together.
SCRIPTS = "Latin Cyrillic Greek Armenian Hebrew Arabic Han Hiragana Katakana Hangul Bopomofo Georgian Cherokee Devanagari Bengali Thai Coptic Ethiopic Tamil".split()
TOGETHER = {"Han": {"Han", "Jpan", "Kore", "Hanb"}, "Hiragana": {"Jpan"}, "Katakana": {"Jpan"}, "Hangul": {"Kore"}, "Bopomofo": {"Hanb"}}

_IN = [(s, regex.compile(rf"\p{{scx={s}}}")) for s in SCRIPTS]
_NEUTRAL = regex.compile(r"\p{sc=Common}|\p{sc=Inherited}")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠎︀-️]")
_BLANK = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}\t\n\r\x0b\x0c\x85--\x20]", regex.V1)
_CONTROL = regex.compile(r"[\p{Cc}--[\t\n\r\x0b\x0c\x85]]", regex.V1)
_INDIC = regex.compile(r"[\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Sinhala}\p{Khmer}]")


@lru_cache(maxsize=1 << 16)
def scripts(c: str) -> frozenset[str] | None:
    """The scripts a letter may belong to; None if it goes with any."""
    if _NEUTRAL.match(c):
        return None
    found: set[str] = set()
    for name, pattern in _IN:
        if pattern.match(c):
            found |= TOGETHER.get(name, {name})
    return frozenset(found or {unicodedata.name(c, "?").split()[0].title()})


def _groups() -> dict[str, dict[str, str]]:
    """For each letter that looks like others: script -> the letter there."""
    alike: dict[str, dict[str, str]] = {}
    for script, table in (("Cyrillic", CYRILLIC_LIKE), ("Greek", GREEK_LIKE), ("Armenian", ARMENIAN_LIKE), ("Cherokee", CHEROKEE_LIKE)):
        for own, latin in table.items():
            group = alike.setdefault(latin, {"Latin": latin})
            if script not in group and (script != "Cyrillic" or own in CYRILLIC_USUAL):
                group[script] = own
            alike[own] = group
    return alike


ALIKE = _groups()


def _may_be(c: str) -> frozenset[str] | None:
    own = scripts(c)
    return own if own is None or c not in ALIKE else own | frozenset(ALIKE[c])


def _respell(word: str, script: str) -> str:
    out = []
    for c in word:
        own = scripts(c)
        out.append(c if own is None or script in own else ALIKE.get(c, {}).get(script, c))
    return "".join(out)


def _word_script(word: str) -> tuple[frozenset[str], str | None]:
    """The intersection of the letters' own scripts, and the script the word should be in."""
    own = [s for s in map(scripts, word) if s is not None]
    if not own:
        return frozenset(), None
    shared = frozenset.intersection(*own)
    if shared:
        return shared, None
    fixed: dict[str, int] = {}  # by letters that can be of no other script
    held: dict[str, int] = {}
    for c in word:
        s = scripts(c)
        if s is not None:
            for x in s:
                held[x] = held.get(x, 0) + 1
                fixed[x] = fixed.get(x, 0) + (c not in ALIKE)
    possible = frozenset.intersection(*[s for s in map(_may_be, word) if s is not None])
    best = max(sorted(held), key=lambda x: (fixed[x], x in possible, held[x], x == "Latin"))
    return shared, best


def usual_form(value: str) -> tuple[str, bool]:
    """The consistent form of a value, and whether a character of it was not the usual one.

    A word whose letters have no script in common counts as such even where no letter is known to stand in for another.

    Case, misspellings and plain blanks within the value are left alone; plain blanks around it are
    cut off in the form only.  Words truly of another script stay as they are.
    """
    if value.isascii() and value.isprintable():
        return value.strip(), False
    text = []
    for i, c in enumerate(value):
        if c.isascii() and c.isprintable():
            text.append(c)
        elif _INVISIBLE.match(c):
            if c in "‌‍" and i and _INDIC.match(value[i - 1]):
                text.append(c)
        elif _BLANK.match(c):
            text.append(" ")
        elif _CONTROL.match(c):
            pass
        elif c in MARK_VARIANTS:
            text.append(MARK_VARIANTS[c])
        elif c in LATIN_VARIANTS:
            text.append(LATIN_VARIANTS[c])
        elif c in USUAL or 0xAC00 <= ord(c) <= 0xD7A3:
            text.append(c)
        else:
            text.append(unicodedata.normalize("NFKC", c))
    form = unicodedata.normalize("NFC", "".join(text))
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(form)]
    judged = [(a, b, w, *_word_script(w)) for a, b, w in words]
    spelt: dict[int, str] = {}
    weight: dict[str, int] = {}
    for k, (_, _, w, shared, best) in enumerate(judged):
        if best is not None:
            spelt[k] = w = _respell(w, best)
            shared = frozenset({best})
        sure = [c for c in w if c not in ALIKE or (s := scripts(c)) is not None and "Latin" in s]
        for s in shared:
            weight[s] = weight.get(s, 0) + len(sure)
    if weight:
        main = max(sorted(weight), key=lambda s: (weight[s], s == "Latin"))
        if weight[main]:
            for k, (_, _, w, shared, best) in enumerate(judged):
                w = spelt.get(k, w)
                own = shared if best is None else frozenset({best})
                if own and main not in own and all(s is None or main in s for s in map(_may_be, w)):
                    spelt[k] = _respell(w, main)
    if len(words) and not any(s is None or "Cyrillic" not in s for _, _, w in words for s in map(scripts, w)) and regex.search("[ЅЈԌԚԜѴӀѕјһԁԛԝѵӏ]", form):
        for k, (_, _, w) in enumerate(words):
            if all(c in ALIKE for c in w):
                spelt[k] = _respell(w, "Latin")
    for k in sorted(spelt, reverse=True):
        a, b, _ = words[k]
        form = form[:a] + spelt[k] + form[b:]
    form = unicodedata.normalize("NFC", form)
    return form.strip(" "), form != value or any(best is not None for *_, best in judged)


_FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("unusual", T.BooleanType())])


@F.pandas_udf(_FORM)
def _usual(values: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple[str, bool]] = {}
    return pd.DataFrame([known.get(v) or known.setdefault(v, usual_form(v)) for v in values], columns=["form", "unusual"])


def usual_forms(people: DataFrame) -> DataFrame:
    """Every name and alias with its consistent form: (id, alias_index, value, form, unusual).

    ``unusual`` tells whether the value held a character that is not the usual one for what is seen.
    Values of printable ASCII characters are their own form and never leave the JVM; null values are
    left out; empty and blank ones have the form ''.  Rows that repeat give repeated rows.
    """
    values = name_values(people)
    plain = F.col("value").rlike(r"^[\x20-\x7e]*\z")
    usual = values.where(plain).select("*", F.trim("value").alias("form"), F.lit(False).alias("unusual"))
    rest = values.where(~plain).withColumn("u", _usual("value")).select("id", "alias_index", "value", "u.form", "u.unusual")
    return usual.unionByName(rest)


def unusual_values(people: DataFrame) -> DataFrame:
    """(id, alias_index) of each value with at least one character that is not the usual one."""
    rest = name_values(people).where(~F.col("value").rlike(r"^[\x20-\x7e]*\z"))
    return rest.withColumn("u", _usual("value")).where("u.unusual").select("id", "alias_index")
