"""Attributes as fixed bit vectors, and the pairs of records that close vectors lead to.

Words of names are vectors of 128 bits, one for each of their letter pairs by sound.  Close words are found by multi-index
Hamming hashing over the distinct words: two vectors that differ in at most r bits have a half that differs in at
most r / 2, and a vector of few set bits equals another in a half once the few bits that only one of them has are
cleared.  The halves with up to r / 2 bits cleared are therefore keys that miss no such pair.  The radius is that of
a typing error or more: 6 bits for words of 7 letter pairs and more, 4 or 2 for shorter ones.

Dates are vectors of 64 bits: digits of the year, the month, digits of the day.  Two halves, year and day of the
year, are their index: dates that agree up to one digit, in year alone or in the day of the year alone share one.

Records are compared where close words meet further agreement that a match needs in any case: a rare word with the
initial of another word (or where a name has no other), or any word with the date of birth.  A word is rare within
its spelling, relative to the other words there, never by a number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens.llm.names import initials_of, likeness, nickname_groups, vector
from namelens.session import cut_lineage

#: The largest Hamming distance at which words are close, for words of that many letter pairs and more.
RADII = ((7, 6), (5, 4), (0, 2))
#: The words of a spelling that are so many times as frequent as its rarest one at most are rare in it.
RARE_RATIO = 8
#: Spellings that are less alike are no evidence.
LEAST_LIKENESS = 0.6
#: Words of a date of birth that are compared each with each at most.
MANY = 1000

_ENCODED = T.StructType(
    [
        T.StructField("v0", T.LongType()),
        T.StructField("v1", T.LongType()),
        T.StructField("radius", T.IntegerType()),
        T.StructField("groups", T.ArrayType(T.IntegerType())),
        T.StructField("initials", T.ArrayType(T.StringType())),
    ]
)
_HALF = (1 << 64) - 1
_U = np.uint64
#: Words for one bucket of index keys, of which a task holds all; words whose keys are made at a time; keys looked up and pairs in work at a time.
_BUCKET, _WORDS, _LOOKED_UP, _PAIRS = 12_500, 2_048, 1 << 16, 1 << 18
_SENT = "bucket int, words binary, vectors binary, radii binary, left_counts binary, left binary, right_counts binary, right binary"


def radius(pairs: int) -> int:
    """The Hamming radius for a word of so many letter pairs."""
    return next(r for least, r in RADII if pairs >= least)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _cleared(halves: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value): each half of a vector with just so many of its set bits cleared, in every way."""
    place, value = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    size = np.bitwise_count(halves)
    for m in np.unique(size[size >= bits]):
        own = np.flatnonzero(size == m)
        rest, low = halves[own], []
        for _ in range(int(m) if bits else 0):
            low.append(rest & (~rest + _U(1)))
            rest = rest ^ low[-1]
        for some in combinations(low, bits):
            place.append(own)
            value.append(halves[own] ^ sum(some, np.zeros(len(own), _U)))
    return np.concatenate(place), np.concatenate(value)


def _keys(vectors: np.ndarray, radii: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((place, key) of left keys, (place, key) of right keys) of vectors, one in a row of two halves.

    Two vectors within their radius share a left and a right key, or a right and a left one.  A key tells how many bits
    either side has cleared, so that keys meet only if the sum is within half the radius.  Keys are hashes; what
    meets by chance is told apart by the vectors.
    """
    sides: tuple[list, list] = ([], [])
    for i in (0, 1):
        for own in range(RADII[0][1] // 2 + 1):
            place, value = _cleared(vectors[:, i], own)
            for other in range(RADII[0][1] // 2 + 1 - own):
                some = radii[place] // 2 >= own + other
                for side, tag in ((0, (own, other)), (1, (other, own))):
                    if tag[0] >= tag[1]:
                        sides[side].append((place[some], _mixed(value[some] + _U(0x9E3779B97F4A7C15 * (1 + (i << 16 | tag[0] << 8 | tag[1])) & _HALF))))
    return tuple((np.concatenate([p for p, _ in side]), np.concatenate([k for _, k in side])) for side in sides)


def index_keys(word: str) -> tuple[list[int], list[int]]:
    """(left, right) keys of a word's vector: two words within their radius share a left and a right key, or a right and a left one."""
    v = vector(word)
    (_, left), (_, right) = _keys(np.array([[v & _HALF, v >> 64]], _U), np.array([radius(v.bit_count())]))
    return left.tolist(), right.tolist()


@F.pandas_udf(_ENCODED)
def _encoded(words: pd.Series) -> pd.DataFrame:
    out = []
    for w in words:
        v = vector(w)
        out.append((_signed(v & _HALF), _signed(v >> 64), radius(v.bit_count()), sorted(nickname_groups(w)), sorted(initials_of(w))))
    return pd.DataFrame(out, columns=[f.name for f in _ENCODED])


def encoded(words: DataFrame) -> DataFrame:
    """(word, w, v0, v1, radius, groups, initials) of the distinct words in column ``word``; ``w`` numbers them in their order."""
    numbered = cut_lineage(words.orderBy("word").select("word", F.monotonically_increasing_id().alias("w")))
    parts = 2 * words.sparkSession.sparkContext.defaultParallelism  # few bytes make much work here, which sizes alone do not tell
    return cut_lineage(numbered.repartition(parts, "w").withColumn("e", _encoded("word")).select("word", "w", "e.*"))


def _bucketed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The keys of words by bucket: 32 bits of each, those of a word one after another."""
    for batch in (b.slice(start, _WORDS) for b in batches for start in range(0, len(b), _WORDS)):
        own, radii = batch["w"].to_numpy(), batch["radius"].to_numpy()
        vectors = np.column_stack([batch["v0"].to_numpy(), batch["v1"].to_numpy()]).view(_U)
        sides = []
        for place, key in _keys(vectors, radii):
            bucket = (key % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket * len(own) + place)
            sides.append((np.searchsorted(bucket[order], np.arange(buckets + 1)), place[order], (key[order] >> _U(32)).astype(np.uint32)))
        rows = []
        for k in range(buckets):
            parts = [(place[at[k] : at[k + 1]], key[at[k] : at[k + 1]]) for at, place, key in sides]
            held = np.unique(np.concatenate([place for place, _ in parts]))
            counts = [np.bincount(np.searchsorted(held, place), minlength=len(held)).astype(np.int32) for place, _ in parts]
            if len(held):
                rows.append([k, *(x.tobytes() for x in (own[held], vectors[held], radii[held].astype(np.uint8), counts[0], parts[0][1], counts[1], parts[1][1]))])
        names = [c.split()[0] for c in _SENT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.binary() if i else pa.int32()) for i in range(len(names))], names=names)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of words that share a key, a left one of a, and whose vectors are close.

    Of a bucket the keys are held, and of what they meet a bounded number at a time; the keys of a word follow each
    other, so that a pair which meets by several of them comes out once, or once more where such a part ends.
    """
    sent: dict[int, list[dict]] = {}
    for row in (r for b in batches for r in b.to_pylist()):
        sent.setdefault(row.pop("bucket"), []).append(row)
    for bucket in sorted(sent):
        rows = sent.pop(bucket)
        whole = lambda c, kind: np.concatenate([np.frombuffer(r.pop(c), kind) for r in rows])  # noqa: E731, B023
        words, vectors, radii = whole("words", np.int64), whole("vectors", _U).reshape(-1, 2), whole("radii", np.uint8)
        place = lambda side: np.repeat(np.arange(len(words), dtype=np.int32), whole(f"{side}_counts", np.int32))  # noqa: E731, B023
        b, right = place("right"), whole("right", np.uint32)
        order = np.argsort(right)
        b, right = b[order], right[order]
        del order
        a, left = place("left"), whole("left", np.uint32)
        v0, v1 = vectors.T.copy()
        del vectors
        for start in range(0, len(a), _LOOKED_UP):
            for i, j in _close_places(a[start : start + _LOOKED_UP], left[start : start + _LOOKED_UP], b, right, v0, v1, radii):
                yield pa.RecordBatch.from_arrays([pa.array(words[i]), pa.array(words[j])], names=["a", "b"])


def _close_places(a: np.ndarray, left: np.ndarray, b: np.ndarray, right: np.ndarray, v0: np.ndarray, v1: np.ndarray, radii: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words with a left and a right key in common, the right ones in ascending order, that are close."""
    first, last = np.searchsorted(right, left), np.searchsorted(right, left, "right")
    some = np.flatnonzero(last > first)
    a, count = a[some], (last - first)[some]
    ends = np.cumsum(count)
    base, total = first[some] - (ends - count), int(count.sum())
    for start in range(0, total, _PAIRS):
        stop = min(start + _PAIRS, total)
        k = np.arange(np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right") + 1)
        often = np.minimum(ends[k], stop) - np.maximum(ends[k] - count[k], start)
        i, j = np.repeat(a[k], often), b[np.repeat(base[k], often) + np.arange(start, stop)]
        apart = np.bitwise_count(v0[i] ^ v0[j]) + np.bitwise_count(v1[i] ^ v1[j])
        near = np.flatnonzero((apart <= np.minimum(radii[i], radii[j])) & (i != j))
        pairs = np.unique(i[near].astype(np.int64) * len(v0) + j[near])
        if len(pairs):
            yield pairs // len(v0), pairs % len(v0)


def close_numbers(known: DataFrame) -> DataFrame:
    """(w, o) of words that are close, each with itself, in both directions; ``known`` comes from ``encoded``.

    Keys are sent by bucket, those of a word together, and compared on arrays.
    """
    buckets = max(2 * known.sparkSession.sparkContext.defaultParallelism, -(-known.count() // _BUCKET))
    sent = known.where("length(word) > 1").select("w", "v0", "v1", "radius").mapInArrow(partial(_bucketed, buckets=buckets), _SENT)
    near = sent.repartitionById(buckets, "bucket").mapInArrow(_met, "a long, b long")
    nick = known.select("w", F.explode("groups").alias("g"))
    same = nick.select(F.col("w").alias("a"), "g").join(nick.select(F.col("w").alias("b"), "g").hint("merge"), "g").where("a <> b").select("a", "b")
    one_way = near.union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = one_way.select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("o")), F.struct(F.col("b").alias("w"), F.col("a").alias("o")))).alias("p")).select("p.*")
    return both.union(known.select("w", F.col("w").alias("o")))


def close_words(words: DataFrame) -> DataFrame:
    """(word, other) of the distinct words in column ``word`` that are close, each with itself, in both directions.

    Words are close within their radius (that of the shorter one), or as nicknames of each other.
    """
    known = encoded(words)
    pairs = close_numbers(known).join(known.select("w", "word").hint("merge"), "w")
    return pairs.join(known.select(F.col("w").alias("o"), F.col("word").alias("other")).hint("merge"), "o").select("word", "other")


def spelling_table(heads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spelt, spellings, close) of profiles: who bears which spelling, the distinct spellings, and the close words.

    ``spelt`` is (pid, sid, main), ``main`` for the spelling of the name; ``spellings`` is (sid, person, words, codes, rare, unlike),
    ``codes`` having the number, vector and initials of each word, ``rare`` telling whether it is rare in the spelling, and ``unlike`` how
    many bearers have names of which the rarest words are not close; ``close`` comes from ``close_numbers``.  Spellings and words
    are numbered in their order, so that what is shuffled are numbers.
    """
    each = heads.select("pid", "person", "named", F.posexplode("spellings").alias("pos", "words"))
    text = F.concat(F.when(F.col("person"), "p ").otherwise("f "), F.array_join("words", " "))
    each = cut_lineage(each.select("pid", text.alias("text"), "person", "words", ((F.col("pos") == 0) & F.col("named")).alias("main")))
    distinct = each.groupBy("text").agg(F.first("person").alias("person"), F.first("words").alias("words"))
    distinct = cut_lineage(distinct.orderBy("text").select(F.monotonically_increasing_id().alias("sid"), "text", "person", "words"))
    spelt = each.join(distinct.select("sid", "text").hint("merge"), "text").groupBy("pid", "sid").agg(F.max("main").alias("main"))
    spelt, distinct = cut_lineage(spelt), distinct.drop("text")
    words = distinct.select("sid", F.posexplode("words").alias("pos", "word"))
    known = encoded(words.select("word").distinct())
    words = cut_lineage(words.join(known.hint("merge"), "word"))
    # how many profiles bear a word or one close to it
    borne = spelt.join(words.select("sid", "w").hint("merge"), "sid").select("pid", "w").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    close = cut_lineage(close_numbers(known))
    # close words mostly have the first of them in common
    around = close.join(borne.select(F.col("w").alias("o"), "n").hint("merge"), "o").groupBy("w").agg(F.sum("n").alias("n"), F.min("o").alias("standard"))
    code = F.struct("w", "v0", "v1", "radius", "groups", "initials").alias("code")
    counted = words.join(around.hint("merge"), "w").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "n", F.length("word").alias("letters"), "standard", code))).alias("c"))
    full = F.filter("c", lambda x: x["letters"] > 1)
    counted = counted.select("sid", "c", F.array_min(F.transform(full, lambda x: F.struct(x["n"].alias("n"), x["standard"].alias("standard")))).alias("rarest"))
    flags = counted.select("sid", F.transform("c", lambda x: F.coalesce((x["letters"] > 1) & (x["n"] <= RARE_RATIO * F.col("rarest.n")), F.lit(False))).alias("rare"), F.col("rarest.standard").alias("sign"), F.transform("c", lambda x: x["code"]).alias("codes"))
    flags = cut_lineage(flags)
    names = spelt.where("main").join(flags.select("sid", "sign").hint("merge"), "sid").select("pid", "sign")
    bearers = spelt.join(names.hint("merge"), "pid").select("sid", "sign").distinct().groupBy("sid").agg(F.count("sign").alias("unlike"))
    spellings = distinct.join(flags.drop("sign").hint("merge"), "sid").join(bearers.hint("merge"), "sid", "left")
    return spelt, cut_lineage(spellings.withColumn("unlike", F.greatest(F.coalesce("unlike", F.lit(1)), F.lit(1)))), close


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series, rare_a: pd.Series, rare_b: pd.Series, person: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y, p, q, bool(k)) for x, y, p, q, k in zip(a, b, rare_a, rare_b, person)])


def name_pairs(spellings: DataFrame, close: DataFrame) -> DataFrame:
    """(s, t) of distinct spellings, s < t, in which a rare word of either is close and another word has the same initial.

    A spelling of one word is paired with all that hold a close word.
    """
    each = spellings.select("sid", "person", "codes", F.size("words").alias("size"), F.posexplode("rare").alias("pos", "is_rare")).where("is_rare")
    others = F.filter("codes", lambda x, i: i != F.col("pos"))
    initials = F.array_distinct(F.flatten(F.transform(others, lambda x: x["initials"])))
    each = each.select("sid", "person", "size", F.get("codes", "pos")["w"].alias("w"), initials.alias("initials"))
    star = F.array(F.lit("*"))
    right = each.select(F.col("sid").alias("t"), "person", "w", F.explode(F.concat("initials", star)).alias("initial")).distinct()
    left = each.select(F.col("sid").alias("s"), "person", F.col("w").alias("own"), F.explode(F.when(F.col("size") == 1, star).otherwise(F.col("initials"))).alias("initial")).distinct()
    left = left.join(close.select(F.col("w").alias("own"), F.col("o").alias("w")).hint("merge"), "own").drop("own")
    both = left.join(right.hint("merge"), ["person", "w", "initial"])
    return both.where("s <> t").select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct()


def date_key(dob: Column) -> Column:
    """A full date with its day and month in ascending order where they may be swapped; null for anything less."""
    month, day = F.substring(dob, 6, 2), F.substring(dob, 9, 2)
    return F.when(F.length(dob) > 4, F.concat(F.substring(dob, 1, 4), F.lit("-"), F.least(month, day), F.lit("-"), F.greatest(month, day)))


def dated_pairs(entities: DataFrame, spelt: DataFrame, spellings: DataFrame, close: DataFrame, fresh: Column | None = None) -> DataFrame:
    """(s, t), s < t, of the spellings of entities that hold a close word and the same date of birth.

    With ``fresh``, a condition on entities, only pairs with such an entity.  The words of a date are compared by their vectors;
    those of dates that more than ``MANY`` words have are looked up in ``close``, which gives the same pairs.
    """
    dated = entities.select("eid", "person", (fresh if fresh is not None else F.lit(True)).alias("fresh"), F.explode("dobs").alias("dob")).select("eid", "person", "fresh", date_key(F.col("dob")).alias("date")).where("date IS NOT NULL").distinct()
    if fresh is not None:
        dated = cut_lineage(dated)
        dated = dated.join(dated.where("fresh").select("person", "date").distinct().hint("merge"), ["person", "date"], "left_semi")
    words = spellings.select("sid", F.explode(F.filter(F.arrays_zip("words", "codes"), lambda x: F.length(x["words"]) > 2)["codes"]).alias("code"))
    held = cut_lineage(spelt.select("eid", "sid").join(dated.hint("merge"), "eid").join(words.hint("merge"), "sid").select("eid", "sid", "person", "fresh", "date", "code.w", "code.v0", "code.v1", "code.radius", "code.groups").distinct())
    many = cut_lineage(held.groupBy("person", "date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("person", "date"))
    some = held.join(many.hint("merge"), ["person", "date"], "left_anti")
    side = lambda rows, p: rows.select("person", "date", *[F.col(c).alias(f"{c}_{p}") for c in ("eid", "sid", "fresh", "w", "v0", "v1", "radius", "groups")])
    apart = F.bit_count(F.col("v0_1").bitwiseXOR(F.col("v0_2"))) + F.bit_count(F.col("v1_1").bitwiseXOR(F.col("v1_2")))
    alike = (F.col("w_1") == F.col("w_2")) | (apart <= F.least("radius_1", "radius_2")) | F.arrays_overlap("groups_1", "groups_2")
    once = "fresh_1 AND eid_1 <> eid_2 AND sid_1 <> sid_2 AND (sid_1 < sid_2 OR NOT fresh_2)"
    pair = [F.least("sid_1", "sid_2").alias("s"), F.greatest("sid_1", "sid_2").alias("t")]
    found = side(some.where("fresh"), 1).join(side(some, 2).hint("merge"), ["person", "date"]).where(once).where(alike).select(*pair)
    if not many.isEmpty():
        most = held.join(many.hint("merge"), ["person", "date"], "left_semi")
        left = side(most.where("fresh"), 1).join(close.select(F.col("w").alias("w_1"), F.col("o").alias("w_2")).hint("merge"), "w_1").drop("w_1")
        found = found.union(left.join(side(most, 2).hint("merge"), ["person", "date", "w_2"]).where(once).select(*pair))
    return found.distinct()


def scored_names(pairs: DataFrame, spellings: DataFrame) -> DataFrame:
    """(s, t, likeness, unlike) of pairs of spellings that are alike enough to be evidence."""
    own = lambda k, p: spellings.select(F.col("sid").alias(k), F.col("words").alias(f"w{p}"), F.col("rare").alias(f"r{p}"), F.col("unlike").alias(f"u{p}"), *([F.col("person")] if p == 1 else []))
    both = pairs.join(own("s", 1).hint("merge"), "s").join(own("t", 2).hint("merge"), "t")
    return both.withColumn("likeness", _likeness("w1", "w2", "r1", "r2", "person")).where(F.col("likeness") >= LEAST_LIKENESS).select("s", "t", "likeness", F.greatest("u1", "u2").alias("unlike"))


def date_bits(dob: Column) -> Column:
    """A date or a year as a vector of 64 bits: the century and each digit of the year, the month, each digit of the day.

    Day and month are taken in ascending order where both may be months, so that swapped ones are equal.
    """
    y, m, d = F.substring(dob, 1, 4), F.substring(dob, 6, 2).cast("int"), F.substring(dob, 9, 2).cast("int")
    low, high = F.when(d <= 12, F.least(m, d)).otherwise(m), F.when(d <= 12, F.greatest(m, d)).otherwise(d)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    digit = lambda i: F.substring(y, i, 1).cast("int")
    year = bit(F.pmod(F.substring(y, 1, 2).cast("int"), F.lit(4))).bitwiseOR(bit(F.lit(4) + digit(3))).bitwiseOR(bit(F.lit(14) + digit(4))).bitwiseOR(bit(F.lit(24) + F.pmod(F.hash(y), F.lit(12))))
    rest = bit(F.lit(36) + F.pmod(low, F.lit(13))).bitwiseOR(bit(F.lit(49) + F.pmod(F.floor(high / 10), F.lit(4)))).bitwiseOR(bit(F.lit(53) + F.pmod(high, F.lit(10))))
    return F.when(F.length(dob) > 4, year.bitwiseOR(rest)).otherwise(year)


def dice(a: Column, b: Column) -> Column:
    """The Dice coefficient of two vectors of 64 bits."""
    return 2 * F.bit_count(a.bitwiseAND(b)) / (F.bit_count(a) + F.bit_count(b))


def date_dice(a: Column, b: Column) -> Column:
    """The best Dice coefficient over two arrays of date vectors; null if either is empty."""
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: dice(x, y)))))
