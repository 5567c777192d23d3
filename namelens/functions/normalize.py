"""Names to search variants, as column expressions.

Only the folding of names with characters beyond ASCII leaves the JVM, in Arrow batches; punctuation, transliteration,
tokens, keys and initials are built-in expressions on the folded text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACES = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
SPACE = r"(?U)\s+"
PUNCTUATION = r"[\p{P}\p{S}]"
CYRILLIC = r"[Ѐ-ԯⷠ-ⷿꙀ-ꚟᲀ-᲏]"

# The two transliteration schemes, lower and upper case.
STANDARD = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "yo", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "yu", "я": "ya",
    "А": "a", "Б": "b", "В": "v", "Г": "g", "Ґ": "g", "Д": "d", "Е": "e", "Ё": "yo", "Є": "ye", "Ж": "zh", "З": "z", "И": "i", "І": "i", "Ї": "yi", "Й": "y", "К": "k", "Л": "l",
    "М": "m", "Н": "n", "О": "o", "П": "p", "Р": "r", "С": "s", "Т": "t", "У": "u", "Ф": "f", "Х": "kh", "Ц": "ts", "Ч": "ch", "Ш": "sh", "Щ": "shch", "Ъ": "", "Ы": "y", "Ь": "",
    "Э": "e", "Ю": "yu", "Я": "ya",
}
ALTERNATIVE = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "ji", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "iu", "я": "ia",
    "А": "a", "Б": "b", "В": "v", "Г": "g", "Ґ": "g", "Д": "d", "Е": "e", "Ё": "e", "Є": "ie", "Ж": "zh", "З": "z", "И": "i", "І": "i", "Ї": "ji", "Й": "i", "К": "k", "Л": "l",
    "М": "m", "Н": "n", "О": "o", "П": "p", "Р": "r", "С": "s", "Т": "t", "У": "u", "Ф": "f", "Х": "h", "Ц": "ts", "Ч": "ch", "Ш": "sh", "Щ": "shch", "Ъ": "", "Ы": "y", "Ь": "",
    "Э": "e", "Ю": "iu", "Я": "ia",
}

VARIANT = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("label", T.StringType())])


def fold_text(name: str) -> str:
    """Composed, case-folded, blanks collapsed, marks stripped."""
    s = unicodedata.normalize("NFC", name).casefold()
    s = _SPACES.sub(" ", s).strip(" ")
    s = s.replace("ß", "ss").replace("ł", "l").replace("Ł", "L")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", s)


@F.pandas_udf(T.StringType())
def _fold(names: pd.Series) -> pd.Series:
    return names.map(lambda s: s if s is None else fold_text(s))


def collapse_space(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def _is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def folded(c: Column) -> Column:
    """The folded form of a name; null counts as ''."""
    c = F.coalesce(c, F.lit(""))
    return F.when(_is_ascii(c), collapse_space(F.lower(c))).otherwise(_fold(F.when(~_is_ascii(c), c)))


def base_text(fold: Column) -> Column:
    """Punctuation replaced by blanks."""
    return collapse_space(F.regexp_replace(fold, PUNCTUATION, " "))


def compact_text(fold: Column) -> Column:
    """Punctuation deleted, and consecutive tokens of one byte joined."""
    return F.regexp_replace(collapse_space(F.regexp_replace(fold, PUNCTUATION, "")), r"(?<=(?:^| )[\x00-\x7F]) (?=[\x00-\x7F](?: |$))", "")


def contains_cyrillic(c: Column) -> Column:
    return c.rlike(CYRILLIC)


def _scheme(c: Column, table: dict[str, str]) -> Column:
    """A scheme applied: mapped letters replaced, white space kept, all else dropped."""
    kept = F.regexp_replace(c, rf"(?U)[^\s{''.join(sorted(table))}]", "")
    for letter, latin in sorted(table.items()):
        if len(latin) > 1:
            kept = F.replace(kept, F.lit(letter), F.lit(latin))
    ones = sorted(k for k, v in table.items() if len(v) == 1)
    gone = "".join(sorted(k for k, v in table.items() if not v))
    return collapse_space(F.translate(kept, "".join(ones) + gone, "".join(table[k] for k in ones)))


def transliterate(c: Column) -> Column:
    """The Latin forms of a text by both schemes, distinct and not empty, as an array."""
    return F.filter(F.array_distinct(F.array(_scheme(c, STANDARD), _scheme(c, ALTERNATIVE))), lambda x: x != "")


def tokenize(c: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(c, SPACE), lambda x: x != "")


def is_blank_name(c: Column) -> Column:
    """Whether a name has no letter."""
    return ~c.rlike(r"\p{L}")


def with_variants(df: DataFrame, name: str, to: str, *, query: bool = False) -> DataFrame:
    """``df`` with a column of the search variants of the names in column ``name``: array of (pos, text, tokens, label).

    With ``query`` the variants by initials follow, which only names that are asked for have.  The steps
    are columns of their own, so that none is computed again inside a higher-order function.
    """
    pair = "array<struct<text:string,label:string>>"
    labelled = lambda texts, label: F.transform(texts, lambda x: F.struct(x.alias("text"), F.lit(label).alias("label"))).cast(pair)
    none = F.array().cast(pair)
    raw = F.coalesce(F.col(name), F.lit(""))
    steps = df.withColumn("_fold", folded(raw))
    steps = steps.withColumn("_base", base_text(F.col("_fold"))).withColumn("_compact", compact_text(F.col("_fold")))
    own = F.concat(labelled(F.array("_base"), "base"), F.when(F.col("_compact") != F.col("_base"), labelled(F.array("_compact"), "no_punct")).otherwise(none))
    latin = lambda c: F.when(contains_cyrillic(F.col(c)), transliterate(F.col(c))).otherwise(F.array().cast("array<string>"))
    both = F.when(F.col("_compact") != F.col("_base"), F.concat(latin("_base"), latin("_compact"))).otherwise(latin("_base"))
    pairs = F.concat(own, F.when(contains_cyrillic(F.col("_fold")), labelled(both, "translit")).otherwise(none))
    if query:
        extra = F.filter(F.array(initials_variant(raw), spaced_initials_variant(raw)), lambda x: x != "")
        pairs = F.concat(pairs, labelled(extra, "base"))
    steps = steps.withColumn("_pairs", pairs).withColumn("_texts", F.transform("_pairs", lambda p: p["text"]))
    first = F.filter("_pairs", lambda p, i: F.array_position("_texts", p["text"]) == i + 1)
    steps = steps.withColumn("_pairs", first)
    full = F.transform("_pairs", lambda p, i: F.struct(i.alias("pos"), p["text"].alias("text"), tokenize(p["text"]).alias("tokens"), p["label"].alias("label")))
    return steps.withColumn(to, full.cast(T.ArrayType(VARIANT))).drop("_fold", "_base", "_compact", "_pairs", "_texts")


def _lower(c: Column) -> Column:
    # single letters only: the context-dependent forms of the JVM are kept out
    return F.lower(F.translate(c, "İΣ", "iσ"))


def initials_variant(name: Column) -> Column:
    """First letters of all parts but the last, and the last verbatim; '' for fewer than two parts."""
    parts = tokenize(name)
    letters = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: _lower(F.regexp_extract(x, r"(\p{L})", 1)))
    head = F.array_join(letters, " ")
    text = F.concat(head, F.when(head != "", " ").otherwise(""), F.element_at(parts, -1))
    return F.when(F.size(parts) >= 2, text).otherwise("")


def spaced_initials_variant(name: Column) -> Column:
    """Short upper-case parts split into letters, all in lower case; '' for fewer than two parts."""
    parts = tokenize(name)
    compact = lambda x: x.rlike(r"^\p{L}+$") & F.octet_length(x).between(2, 3) & (F.upper(x) == x)
    spelt = F.transform(parts, lambda x: F.when(compact(x), F.array_join(F.split(_lower(x), ""), " ")).otherwise(_lower(x)))
    return F.when(F.size(parts) >= 2, F.array_join(spelt, " ")).otherwise("")


def initials(name: Column) -> Column:
    """The first letters of a name's parts, in lower case."""
    return F.array_join(F.transform(tokenize(name), lambda x: _lower(F.regexp_extract(x, r"(\p{L})", 1))), "")


def prefix_keys(found: Column) -> Column:
    """The distinct first two characters of the tokens of variants."""
    return F.array_distinct(F.flatten(F.transform(found, lambda v: F.transform(v["tokens"], lambda t: F.substring(t, 1, 2)))))


def expand_initials(letters: str, name: str) -> str:
    """The parts of a name in the order of its initials; an initial without a part stands for itself."""
    parts = [p for p in _SPACES.split(name) if p]
    if not letters or not parts:
        return name
    free, out = list(range(len(parts))), []
    for letter in letters:
        k = next((i for i in free if parts[i][0].lower()[:1] == letter.lower()[:1]), None)
        out.append(letter if k is None else parts[k])
        if k is not None:
            free.remove(k)
    return " ".join(out + [parts[i] for i in free])


@F.pandas_udf(T.StringType())
def _expanded(letters: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else expand_initials(a, n) for a, n in zip(letters, names)])


def expanded_name(name: Column) -> Column:
    """``expand_initials`` of a name by its own initials.

    Where every part begins with a letter the parts keep their order, and the JVM collapses the blanks.
    """
    plain = ~name.rlike(r"(?U)(?:^|\s)[^\p{L}\s]")
    return F.when(plain, collapse_space(name)).otherwise(_expanded(initials(name), F.when(~plain, name)))
