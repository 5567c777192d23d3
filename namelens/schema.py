"""Row types, constants and checks that the whole engine shares."""

from __future__ import annotations

from pyspark.sql import types as T

#: Lists that are screened and counted unless others are named.
DEFAULT_LISTS = ("OFAC", "EU", "UN")
DEFAULT_THRESHOLD = 0.8

PERSON = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("dob", T.DateType()),
        T.StructField("nationality", T.StringType()),
        T.StructField("list_type", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
    ]
)

EXPLAIN = "struct<input_variant:string,matched_variant:string,method:string,normalization:string,is_alias:boolean,is_translit:boolean,token_score:double,string_score:double>"

#: Scores that are fixed: of equal names, of equal aliases, and the least with which initials are expanded.
EXACT_SCORE = 1.0
ALIAS_SCORE = 0.95
INITIALS_SCORE = 0.9


def validate_threshold(threshold: float) -> float:
    """The threshold, if it is greater than 0 and at most 1."""
    if not 0 < threshold <= 1:  # also false for NaN
        raise ValueError("threshold must be greater than 0 and at most 1")
    return threshold
