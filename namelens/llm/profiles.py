"""Profiles of watchlist rows for matching: spellings as folded words, and the other attributes in one notation.

Rows with the same profile are matched once, through one representative; the others follow it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens.llm.names import words_of
from namelens.llm.values import alias_array

#: The ISO 3166-1 three-letter codes whose first two letters are not their two-letter code.
THREE_LETTER = {
    "ABW": "AW", "AGO": "AO", "ALA": "AX", "AND": "AD", "ARE": "AE", "ARM": "AM", "ATA": "AQ", "ATF": "TF", "ATG": "AG", "AUT": "AT",
    "BDI": "BI", "BEN": "BJ", "BES": "BQ", "BGD": "BD", "BHS": "BS", "BIH": "BA", "BLR": "BY", "BLZ": "BZ", "BRB": "BB", "BRN": "BN",
    "CAF": "CF", "CHL": "CL", "CHN": "CN", "COD": "CD", "COG": "CG", "COK": "CK", "COM": "KM", "CPV": "CV", "CUW": "CW", "CYM": "KY",
    "DNK": "DK", "ESH": "EH", "EST": "EE", "FLK": "FK", "FRO": "FO", "FSM": "FM", "GIN": "GN", "GLP": "GP", "GNB": "GW", "GNQ": "GQ",
    "GRD": "GD", "GRL": "GL", "GUF": "GF", "GUY": "GY", "IRL": "IE", "IRQ": "IQ", "ISR": "IL", "JAM": "JM", "KAZ": "KZ", "KOR": "KR",
    "LBR": "LR", "LBY": "LY", "MAC": "MO", "MAF": "MF", "MDG": "MG", "MDV": "MV", "MEX": "MX", "MLT": "MT", "MNE": "ME", "MNP": "MP",
    "MOZ": "MZ", "MTQ": "MQ", "MYT": "YT", "NIU": "NU", "PAK": "PK", "PCN": "PN", "PLW": "PW", "PNG": "PG", "POL": "PL", "PRK": "KP",
    "PRT": "PT", "PRY": "PY", "PYF": "PF", "SEN": "SN", "SGS": "GS", "SLB": "SB", "SLV": "SV", "SPM": "PM", "SRB": "RS", "SUR": "SR",
    "SVK": "SK", "SVN": "SI", "SWE": "SE", "SWZ": "SZ", "SYC": "SC", "TCD": "TD", "TKM": "TM", "TUN": "TN", "TUR": "TR", "TUV": "TV",
    "UKR": "UA", "URY": "UY", "WLF": "WF",
}


def date_form(dob: Column) -> Column:
    """A date as yyyy-MM-dd, a year as yyyy, anything else ''."""
    text = F.trim(F.coalesce(dob, F.lit("")))
    day_first = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    turned = F.concat_ws("-", F.regexp_extract(text, day_first, 3), F.lpad(F.regexp_extract(text, day_first, 2), 2, "0"), F.lpad(F.regexp_extract(text, day_first, 1), 2, "0"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).when(text.rlike(day_first), turned).when(text.rlike(r"^\d{4}$"), text).otherwise("")


def country_form(nationality: Column) -> Column:
    """A country as its two-letter code, '' if it is unknown; a text that is no code stays as it is, in upper case."""
    text = F.upper(F.trim(F.coalesce(nationality, F.lit(""))))
    codes = F.create_map(*[F.lit(x) for kv in THREE_LETTER.items() for x in kv])
    return F.when(text == "UNKNOWN", "").when(F.length(text) == 3, F.coalesce(codes[text], F.left(text, F.lit(2)))).otherwise(text)


_SPELLINGS = T.ArrayType(T.ArrayType(T.StringType()))


@F.pandas_udf(_SPELLINGS)
def _spellings(values: pd.Series, person: pd.Series) -> pd.Series:
    out = []
    for own, is_person in zip(values, person):
        found: list[list[str]] = []
        for v in own:
            words = list(words_of(v, bool(is_person))) if v and v.strip() else []
            if words and words not in found:
                found.append(words)
        out.append(found)
    return pd.Series(out)


def profiles(people: DataFrame) -> DataFrame:
    """(id, list_type, person, spellings, named, dob, country, programs) of rows that have an id.

    ``spellings`` holds the words of the name, then of each alias; without any the row matches nothing.
    ``named`` tells whether the first of them is that of the name.  Rows are persons unless their roles
    say ``entity``.
    """
    roles = F.filter(alias_array(F.col("roles")), lambda x: x.isNotNull())
    rows = people.where("id IS NOT NULL").select(
        "id",
        F.coalesce("list_type", F.lit("")).alias("list_type"),
        (~F.array_contains(roles, "entity")).alias("person"),
        F.filter(F.concat(F.array("name"), alias_array(F.col("aliases"))), lambda x: x.isNotNull()).alias("names"),
        F.coalesce(F.col("name").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("named"),
        date_form(F.col("dob")).alias("dob"),
        country_form(F.col("nationality")).alias("country"),
        F.array_sort(F.array_distinct(F.filter(roles, lambda x: ~x.isin("individual", "entity")))).alias("programs"),
    )
    return rows.select("id", "list_type", "person", _spellings("names", "person").alias("spellings"), "named", "dob", "country", "programs")


def copies(rows: DataFrame) -> DataFrame:
    """The profiles with ``pid``, the smallest id of those that are alike but for id and list; one without names is alone."""
    alike = ["person", "spellings", "named", "dob", "country", "programs", F.when(F.size("spellings") == 0, F.col("id"))]
    printed = rows.select("*", F.xxhash64(*alike).alias("print"), F.xxhash64(F.lit(1), *alike).alias("print_2"))
    heads = printed.groupBy("print", "print_2").agg(F.min("id").alias("pid"))
    return printed.join(heads.hint("merge"), ["print", "print_2"]).drop("print", "print_2")


def components(nodes: DataFrame, edges: DataFrame, cut) -> DataFrame:
    """(pid, root): for each node of column ``pid`` the smallest node that edges (a, b) lead to.

    Large-star and small-star steps alternate until nothing changes; each is a shuffle of the edges.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low_2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low_2.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.*").where("a <> b").distinct()
        after = cut(small)
        same = after.join(pairs.hint("merge"), ["a", "b"], "left_anti").isEmpty() and pairs.join(after.hint("merge"), ["a", "b"], "left_anti").isEmpty()
        pairs = after
        if same:
            break
    roots = pairs.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.select(F.col("pid").alias("a")).join(roots.hint("merge"), "a", "left").select(F.col("a").alias("pid"), F.coalesce("root", "a").alias("root"))
