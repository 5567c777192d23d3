"""Texts that were cut off when they were stored or transferred.

Two kinds of evidence are joined.  *Lengths*: each text is measured as characters, UTF-8 bytes, UTF-16
units, with entities escaped, as a JSON string and with CRLF newlines, with and without a mark of
omission at its end; a source whose lengths pile up at the top of one of these measures, where those
of an unlimited source thin out, has a storage limit there.  A text that ends just at its source's limit is whole only if it ends a sentence, or in a sign
after which nothing is written.  *Endings*: any other text's last line is whole if
it ends a sentence, or if it is a kind of line (heading, link, footer, caption, price) that also
occurs within documents, where nothing can have cut it.  The lines within all documents are counted
by their shape for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelens.session import cut_lineage

#: Marks of omission set after a cut.
OMISSION = r"(?:\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.{3,}|…|â€¦|&hellip;|вЂ¦)\s*)+$"
#: Ends of a sentence, with what may close after them.
SENTENCE_END = r"""[.!?。！？؟۔।][\s"'»”“’)\]\u203a]*$"""
#: Borders between a sentence and the next one on a line.
SENTENCE_BREAK = r"""[.!?。！？؟۔।]["'»”“’)\]]*\s+(?=\S)"""
#: A sentence of two words or more that a line has before other words: an abbreviation before a number is none.
RUNNING = r"""\S\s+\S*(?:\p{Ll}{2}[.!?؟۔।]|[。！？])["'»”“’)\]]*\s*(?<=[\s。！？])["'“„«(]*\p{L}"""

#: Blanks cut off around lines.
BLANKS = " \t\r\n\x0b\x0c\u0085\u00a0\u2002\u2003\u2009\u200b\u3000\ufeff"
#: What is masked in a line to tell of what kind it is, step by step.
SHAPE_STEPS = (
    (r"(?U)\s+", " "),
    (r"(?<=[\p{L}\p{N}\p{P}\p{S}] |[\"'“„«(>\-–—©|·/])\p{Lu}[\p{L}\p{M}\p{N}'’-]*", "X"),
    (r"X(?: X)+", "X"),
    (r"\p{N}+(?:[.,:\u00a0]\p{N}+)*", "0"),
    (r"0(?: 0)+", "0"),
)
#: Line shapes that are broadcast at a time.
BLOCK_SHAPES = 50_000

#: A length is a storage limit if this many texts of the source, and this share of them, are just that long ...
LIMIT_TEXTS = 5
LIMIT_SHARE = 0.01
#: ... and at most this many times as many are longer.
LONGER_SHARE = 0.2
#: The end of a line that is no fragment, even where the text had to stop.
CLOSED = r"\p{N}\s?(?:[€£¥]|EUR|USD)$"
#: Witnesses, distinct texts, that a kind of line needs to be known: those that hold it within, and those that end in it ...
WHOLE_LINE_DOCS = 2
WHOLE_LAST_DOCS = 3
#: ... and the share of the latter that the former must come to, however large the corpus: fragments stand at ends only.
INNER_SHARE = 0.2
#: Words of a sentence that are masked first; the others only if an opening goes on that far.
FIRST_WORDS = 14
#: Beginnings and separators of footers, menus, signatures and lists, also as damaged by a wrong charset.
LISTED = r"^(?:©|\ufffd|Â©|[—–•*|]|â€”|вЂ”|â€¢|\(c\))\s|\s(?:[|·•]|Â·|â€¢)\s|^©"
#: A caption, one word and a colon before a few words of which the last is a name, or a numbered one.
CAPTION = r"^\S+\s?: (?:\S+ ){0,2}\p{Lu}[\p{L}'’-]+$|^\S+ \p{N}+\s?: (?:\S+ ){0,5}\S+$"
#: A link of up to four words that ends in a mark of omission.
LINK = r"^\p{Lu}\S*(?: \S+){0,3}$"
#: The ends of a line with a price.
PRICE = r"(?:(?:[€$£¥]|â‚¬)\s?\p{N}+(?:[.,]\p{N}+)*|\p{N}+(?:[.,]\p{N}+)*\s?(?:[€$£¥]|â‚¬|kr|Fr|EUR|USD|руб))\.?$"


def last_line(text: Column) -> Column:
    """The last line of a text that is not blank, without blanks around it."""
    return F.btrim(F.substring_index(F.rtrim(F.translate(text, "\r", "\n"), F.lit(BLANKS)), "\n", -1), F.lit(BLANKS))


def without_mark(text: Column) -> Column:
    """A text without the mark of omission at its end and the blanks before it."""
    ends = F.right(text, F.lit(5)).rlike(r"\.{3}|[\])…¦;]")  # any mark ends so, but for a last newline
    return F.when(ends, F.regexp_replace(text, OMISSION, "")).otherwise(text)


def line_shape(line: Column) -> Column:
    """The kind of a line: numbers, and words with a capital that do not begin it, are masked."""
    shape = F.trim(line)
    for pattern, mask in SHAPE_STEPS:
        shape = F.regexp_replace(shape, pattern, mask)
    return shape


def measures(text: Column) -> dict[str, Column]:
    """The lengths of a text under the encodings and escapings in which limits are set."""
    length = F.length(text)
    count = lambda chars: sum((length - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))
    lines = count("\n")
    beyond = length - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]+", ""))
    utf8 = F.octet_length(text) - 2 * count("\ufffd")  # a cut character counts with the byte that is left
    return {
        "characters": length,
        "utf8_bytes": utf8,
        "utf16_units": length + beyond,
        "html_escaped": length + 4 * count("&") + 3 * count("<>") + 5 * count('"') + 4 * count("'"),
        "json_escaped": length + count('\\"\n\r\t'),
        "json_ascii": length + count('\\"\n\r\t') + 5 * (length - F.length(F.regexp_replace(text, r"[^\x00-\x7f]+", ""))) + 6 * beyond,
        "crlf": length + lines - (length - F.length(F.replace(text, F.lit("\r\n"), F.lit("\n")))),
    }


def source_limits(docs: DataFrame) -> DataFrame:
    """The storage limit of each source that has one: (source, measure, marked, length, texts, longer).

    ``marked`` tells whether the lengths are those before a mark of omission.  Of several measures with a
    limit the one with the most texts at it is given; if these are as many, that before a mark, then the
    first by name.
    A null source counts as ''.
    """
    text = F.col("text")
    bare = without_mark(text)
    rows = docs.where(text.isNotNull() & text.rlike(r"(?U)\S")).select(F.coalesce("source", F.lit("")).alias("source"), text, bare.alias("bare"))
    plain = [F.struct(F.lit(k).alias("measure"), F.lit(False).alias("marked"), m.cast("long").alias("length")) for k, m in measures(text).items()]
    marked = [F.struct(F.lit(k).alias("measure"), F.lit(True).alias("marked"), F.when(F.length("bare") < F.length("text"), m.cast("long")).alias("length")) for k, m in measures(F.col("bare")).items()]
    each = rows.select("source", F.explode(F.array(*plain, *marked)).alias("m")).select("source", "m.*").where("length IS NOT NULL")
    lengths = each.groupBy("source", "measure", "marked", "length").agg(F.count(F.lit(1)).alias("texts"))
    own = Window.partitionBy("source", "measure", "marked")
    above = own.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    sized = lengths.select("*", F.coalesce(F.sum("texts").over(above), F.lit(0)).alias("longer"), F.sum("texts").over(own).alias("all_texts"))
    limits = sized.where((F.col("texts") >= LIMIT_TEXTS) & (F.col("texts") >= LIMIT_SHARE * F.col("all_texts")) & (F.col("longer") <= LONGER_SHARE * F.col("texts")))
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("texts"), F.desc("marked"), "measure", F.desc("length")))
    return limits.withColumn("r", first).where("r = 1").select("source", "measure", "marked", "length", "texts", "longer")


def stops_at(text: Column) -> Column:
    """Whether a text is just as long as the storage limit in the columns measure, marked and length."""
    own = lambda t: F.coalesce(*[F.when(F.col("measure") == k, m.cast("long")) for k, m in measures(t).items()])
    bare = without_mark(text)
    size = F.when(~F.col("marked"), own(text)).when(F.length(bare) < F.length(text), own(bare))
    return F.coalesce(F.when(F.col("measure").isNotNull(), size == F.col("length")), F.lit(False))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"[\n\r]+"), lambda x: x.rlike(r"(?U)\S"))


def _unended(line: Column) -> Column:
    return ~line.rlike(SENTENCE_END) | line.rlike(OMISSION) | line.rlike(r"\p{N}\.\s*$")


def whole_lines(docs: DataFrame) -> DataFrame:
    """(shape, docs) of the lines within documents, all but the last one, that end no sentence.

    ``docs`` is how many distinct texts have such a line; copies of a text count once.
    """
    lines = _lines(F.col("text"))
    inner = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("print"), F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))).alias("lines"))
    shapes = inner.select("print", F.explode(F.array_distinct(F.transform(F.filter("lines", _unended), lambda x: F.xxhash64(line_shape(x))))).alias("shape"))
    return shapes.distinct().groupBy("shape").agg(F.count(F.lit(1)).alias("docs"))


def continued(docs: DataFrame, shapes: DataFrame) -> DataFrame:
    """(opening_text) of those line shapes with which whole sentences begin that then go on, be it within the last word.

    The shapes are compared in blocks of a fixed size, each of which is broadcast and held against
    the sentences of all documents.
    """
    wanted = [r.opening_text for r in shapes.select("opening_text").distinct().limit(BLOCK_SHAPES + 1).collect()]
    if len(wanted) <= BLOCK_SHAPES:
        return _continued(docs, wanted)
    numbered = cut_lineage(shapes.select("opening_text").distinct().withColumn("block", F.pmod(F.xxhash64("opening_text"), F.lit(shapes.count() // (BLOCK_SHAPES // 2) + 1))))
    found = None
    for block in range(shapes.count() // (BLOCK_SHAPES // 2) + 1):
        own = _continued(docs, [r.opening_text for r in numbered.where(F.col("block") == block).select("opening_text").collect()])
        found = own if found is None else found.union(own)
    return found


def _continued(docs: DataFrame, wanted: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    steps = [(p.replace("(?U)", ""), m) for p, m in SHAPE_STEPS]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(regex.compile(p), m) for p, m in steps]
        breaks, ends, omits = (regex.compile(p) for p in (SENTENCE_BREAK, SENTENCE_END, OMISSION))
        by_head: dict[str, list[tuple[str, str]]] = {}  # all words but the last -> (the last, the whole)
        heads: set[str] = set()  # first words that any opening has
        parts: set[int] = {hash("")}  # hashes of the first words, of any number, after which any opening goes on
        for opening in shared.value:
            head, _, last = opening.rpartition(" ")
            by_head.setdefault(head, []).append((last, opening))
            heads.add(opening.partition(" ")[0])
            parts.update(hash(opening[:i]) for i, c in enumerate(opening) if c == " ")
        single = "" in by_head
        seen: set[str] = set()
        for batch in batches:
            found: set[str] = set()
            for text in batch.column(0).to_pylist():
                for line in text.replace("\r", "\n").split("\n"):
                    if not line or line.isspace():
                        continue
                    starts = [0] + [m.end() for m in breaks.finditer(line)]
                    whole_end = bool(ends.search(line)) and not omits.search(line)
                    for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(line)])):
                        if n + 1 == len(starts) and not whole_end:
                            break
                        sentence = line[a:b]
                        if not single and sentence.split(maxsplit=1)[0] not in heads and not sentence[:1].isdigit():
                            continue
                        words = sentence.split(maxsplit=FIRST_WORDS)
                        for most in (FIRST_WORDS, len(sentence)) if len(words) > FIRST_WORDS else (FIRST_WORDS,):
                            part = len(words) > FIRST_WORDS and most == FIRST_WORDS
                            shape = " ".join(words[:FIRST_WORDS] if part else sentence.split())
                            for mask, by in masks:
                                shape = mask.sub(by, shape)
                            masked = shape.split(" ")
                            if part:
                                masked.pop()  # what follows it may change it
                            head = ""
                            for k, word in enumerate(masked):
                                for last, opening in by_head.get(head, ()):
                                    if opening not in seen and word.startswith(last) and (word != last or part or k + 1 < len(masked)):
                                        seen.add(opening)
                                        found.add(opening)
                                head = f"{head} {word}" if k else word
                                if hash(head) not in parts:
                                    break
                            else:
                                continue
                            break
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["opening_text"])

    return docs.where("text IS NOT NULL").select("text").mapInArrow(mapped, "opening_text string").distinct()


def endings(docs: DataFrame) -> DataFrame:
    """(doc_id, source, ending, line, cut) of each text that is not blank.

    ``ending`` is ``sentence``, ``line`` (whole without ending a sentence), ``marked`` (an omission mark
    after a cut) or ``open`` (the line breaks off).  A last line that ends no sentence is whole if lines
    of its shape stand within other documents, not much rarer than at ends; or if they end others too while no sentence
    begins like that and goes on; or if it is a price, a caption, or has the marks of a menu, footer or signature; or if
    it is a short link with a mark of omission in a source that sets none after cuts.  None
    of these makes a line whole at the source's storage limit, where a fragment looks the same.  A limit
    counts if so many distinct texts as make one end there: copies of one long text are none.
    """
    limits = cut_lineage(source_limits(docs)).select("source", "measure", "marked", "length")
    text = docs.where(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    rows = text.join(F.broadcast(limits), "source", "left").select("doc_id", "source", last_line(F.col("text")).alias("line"), F.xxhash64("text").alias("print"), stops_at(F.col("text")).alias("at"), F.col("marked").alias("marks"))
    bare = F.trim(without_mark(F.col("line")))
    number = F.col("bare").rlike(r"\p{N}\.$")  # a number cut before its decimals, unless such lines are common
    rows = rows.withColumn("bare", bare).withColumn("sentence", (F.col("bare").rlike(SENTENCE_END) & ~number) | (F.col("bare") == ""))
    asked = ~F.col("sentence") | (F.length("bare") < F.length("line"))
    rows = rows.withColumn("shape", F.when(asked, F.xxhash64(line_shape(F.col("line"))))).withColumn("opening", F.when(asked, line_shape(F.col("bare"))))
    rows = cut_lineage(rows)
    limited = rows.where("at").groupBy("source").agg(F.countDistinct("print").alias("n")).where(F.col("n") >= LIMIT_TEXTS).select("source", F.lit(True).alias("limited"))
    running = F.col("bare").rlike(RUNNING)  # a line with a sentence before the open one is running text, however often it occurs
    own = rows.where("shape IS NOT NULL").groupBy("shape", "print").agg(F.min("opening").alias("opening"), F.max(running).alias("running"))
    last = own.groupBy("shape").agg(F.count_if(~F.col("running")).alias("ends"), F.min("opening").alias("opening_text"))
    kinds = last.join(whole_lines(docs), "shape", "left")
    held = F.coalesce("docs", F.lit(0))
    kinds = kinds.withColumn("inner", (held >= WHOLE_LINE_DOCS) & (held >= INNER_SHARE * F.col("ends")))
    kinds = cut_lineage(kinds.where(F.col("inner") | (F.col("ends") >= WHOLE_LAST_DOCS)))
    doubtful = kinds.where(~F.col("inner"))
    goes_on = continued(docs, doubtful).withColumn("goes_on", F.lit(True))
    known = kinds.join(goes_on, "opening_text", "left").select("shape", "inner", F.col("goes_on").isNull().alias("final"))
    marked = F.length("bare") < F.length("line")
    broken = F.col("bare").rlike(SENTENCE_BREAK)  # a line with a sentence before the open one is running text
    listed = (F.col("bare").rlike(LISTED) | F.col("bare").rlike(CAPTION) | F.col("line").rlike(PRICE)) & ~broken
    link = marked & F.col("bare").rlike(LINK) & ~broken & ~F.coalesce("marks", F.lit(False))  # where the source sets no marks after cuts
    stopped = F.col("at") & F.col("limited").isNotNull() & ~F.col("sentence") & ~F.col("line").rlike(CLOSED)
    ending = (
        F.when(stopped, F.when(marked, "marked").otherwise("open"))
        .when(F.coalesce(F.col("inner") | F.col("final"), F.lit(False)), "line")
        .when(link, "line")
        .when(marked & ~F.col("sentence"), "marked")
        .when(F.col("sentence"), "sentence")
        .when(listed, "line")
        .otherwise("open")
    )
    return rows.join(known, "shape", "left").join(F.broadcast(limited), "source", "left").select("doc_id", "source", ending.alias("ending"), "line").withColumn("cut", F.col("ending").isin("marked", "open"))


def cut_texts(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text was cut off within a word or a sentence.

    Null, empty and blank texts are not cut.  A repeated row gives a row each.
    """
    return endings(docs).where("cut").select("doc_id")


def cut_by_source(docs: DataFrame) -> DataFrame:
    """(source, texts, cut, share, measure, marked, length, at_limit): how often each source cuts texts, and its limit."""
    by_source = endings(docs).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col("cut"), 1)).alias("cut"))
    limits = source_limits(docs).select("source", "measure", "marked", "length", F.col("texts").alias("at_limit"))
    return by_source.join(limits, "source", "left").select("source", "texts", "cut", F.round(F.col("cut") / F.col("texts"), 6).alias("share"), "measure", "marked", "length", "at_limit")
