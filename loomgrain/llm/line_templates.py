"""Line dedup by a tree of log templates, in DataFrame functions alone.

A line's leaf in the tree of fixed depth is its number of words and its first DEPTH words. Words with digits are
variable fields at once, but in a line of which they are more than half, as in a row of numbers: it recurs only as it is. In a leaf, a word stays constant at its place where enough of the leaf's lines have it there,
and is a variable field elsewhere; what is left is the line's template, and one with too few constants among its words without
digits is none. How many lines are enough is asked at each of SUPPORTS, whatever else the leaf holds, and at the share COMMON of it.
A template that MIN_DOCS documents have recurs: its lines go from all documents but the first, that with the least doc_id. What a
higher support makes of lines holds all that a lower one does, so the first of the widest template stays.

Lines of LONG_WORDS words recur from LONG_DOCS documents on; those of fewer than MIN_WORDS words, which recur by chance, from SHORT_DOCS on
and without fields found in leaves; one word alone never. A document is a row: rows that repeat a doc_id and its text
are one document. A null text has no lines and stays null; an empty text stays; a null doc_id comes last. Other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.shared import fresh, written

DEPTH = 3
MIN_WORDS = 5
MIN_DOCS = 3
LONG_WORDS, LONG_DOCS = 50, 2
SHORT_DOCS = 10
#: Lines of a leaf that must have a word at a place for it to be constant there: each of these, and this share or MIN_DOCS.
SUPPORTS = tuple(MIN_DOCS * 4**k for k in range(8))
COMMON = 0.05
#: Share of a template's words without digits that must be constants.
CONSTANT = 0.8
#: Bits of the filters that let only repeated lines be looked up and only lines of shared leaves be cut into words; 2 MB each whatever the input's size.
FILTER_BITS = 24

FIELD = "<*>"
#: From the first sign of a word on, up to a digit in it; nothing is read twice.
_WITH_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def _masked(lines: Column) -> Column:
    """(masked, raw, n_words) of lines: single spaces, words with digits as fields, whether the digits stayed, words. Most lines have nothing to change.

    Each layer's results are read by the next, since nothing is shared inside of one.
    """

    def both(line: Column) -> Column:
        ragged = line.contains("  ") | line.contains("\t") | line.contains("\r")
        spaced = F.trim(F.when(ragged, F.regexp_replace(line, "[\t\r ]+", " ")).otherwise(line))
        return F.struct(spaced.alias("line"), F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, _WITH_DIGIT, FIELD)).alias("masked"))

    def chosen(x: Column) -> Column:
        fields = F.octet_length(x["masked"]) - F.octet_length(F.replace(x["masked"], F.lit(FIELD), F.lit("")))
        raw = F.coalesce(2 * fields > len(FIELD) * _n_words(x["masked"]), F.lit(False))
        return F.struct(x["line"].alias("line"), x["masked"].alias("masked"), raw.alias("raw"))

    def counted(x: Column) -> Column:
        masked = F.when(x["raw"] | x["masked"].isNull(), x["line"]).otherwise(x["masked"])
        return F.struct(masked.alias("masked"), x["raw"].alias("raw"))

    def told(x: Column) -> Column:
        return F.struct(x["masked"].alias("masked"), x["raw"].alias("raw"), _n_words(x["masked"]).alias("n_words"))

    return F.transform(F.transform(F.transform(F.transform(lines, both), chosen), counted), told)


def _has_leaf() -> Column:
    """Not of short lines, nor of those whose digits are words."""
    return (F.col("n_words") >= MIN_WORDS) & ~F.col("raw")


def _leaf() -> Column:
    return F.xxhash64("n_words", F.substring_index("masked", " ", DEPTH))


def _n_words(masked: Column) -> Column:
    return F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, k, pos, masked, raw and n_words of every line of two words or more."""
    # masked and counted inside the array, so that what stands above reads the result and does neither again
    cut = docs.select("doc_id", _key().alias("k"), F.posexplode(_masked(F.split("text", "\n", -1))).alias("pos", "line"))
    return cut.where(F.col("line.n_words") > 1).select("doc_id", "k", "pos", "line.masked", "line.raw", "line.n_words")


def _enough(n_words: Column) -> Column:
    """How many documents make a line of so many words recur."""
    return F.when(n_words >= LONG_WORDS, LONG_DOCS).when(n_words >= MIN_WORDS, MIN_DOCS).otherwise(SHORT_DOCS)


def _recurring(lines: DataFrame, template: str, enough: Column, *of_template: str) -> DataFrame:
    """The templates of ``enough`` documents or more, each with its first document (nulls last), its number of lines and the columns that hang on it."""
    each = lines.select(template, "doc_id", "k", enough.alias("enough"), *of_template).groupBy(template, "doc_id", "k", "enough", *of_template).agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k"))
    first = F.min(order)["k"].alias("first")
    found = each.groupBy(template).agg(F.count("*").alias("n_docs"), first, F.max("enough").alias("enough"), F.sum("n").alias("n_lines"), *(F.max(c).alias(c) for c in of_template))
    return found.where(F.col("n_docs") >= F.col("enough"))


def _among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose hashed ``key`` is one of ``keys``, and few others; none is shuffled, whatever the number of keys.

    What is broadcast is a bit for each key, 2 ** (FILTER_BITS - 6) rows at most. Whoever asks looks up what is left exactly.
    """

    def place(of: Column) -> Column:
        return of.bitwiseAND((1 << FILTER_BITS) - 1)

    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    bits = keys.select(place(F.col(key)).alias("place")).groupBy(F.shiftright("place", 6).alias("at_bits")).agg(F.bit_or(one).alias("bits"))
    at = rows.withColumns({"at_bits": F.shiftright(place(F.col(key)), 6), "bit": F.col(key).bitwiseAND(63).cast("int")})
    return at.join(F.broadcast(bits), "at_bits").where(F.expr("shiftright(bits, bit) & 1L = 1L")).select(*rows.columns)


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, k, pos) of the lines that go."""
    lines = written(_lines(docs).select("doc_id", "k", "pos", F.xxhash64("masked").alias("template"), F.when(_has_leaf(), _leaf()).alias("leaf"), _enough(F.col("n_words")).alias("enough")), "lines")
    # most lines are alone, and are counted but not joined: a template has no more documents than lines
    often = lines.groupBy("template").agg(F.count("*").alias("n"), F.max("enough").alias("enough")).where("n >= enough").select("template")
    repeated = written(_among(lines, often, "template"), "line-repeats")
    same = written(_recurring(repeated, "template", F.col("enough"), "leaf"), "line-templates")
    by_mask = repeated.join(same.select("template", "first"), "template").where("k <> first").select("doc_id", "k", "pos")

    # leaves that enough lines share whose template does not recur as it is: all lines of a leaf, less those of such templates
    each = lines.select("leaf", F.lit(1).cast("long").alias("n")).unionByName(same.select("leaf", (-F.col("n_lines")).alias("n"))).where("leaf is not null")
    leaves = written(each.groupBy("leaf").agg(F.sum("n").alias("n_lines")).where(F.col("n_lines") >= MIN_DOCS), "line-leaves")
    # masked again rather than written with the lines: those of shared leaves are few, all of them are the input's size
    again = _lines(docs).where(_has_leaf()).select("doc_id", "k", "pos", "masked", _leaf().alias("leaf"))
    maybe = _among(again, leaves, "leaf").withColumn("template", F.xxhash64("masked"))
    # a left join, since an anti join would be moved below the filter and shuffle all lines where the templates are too many to broadcast
    recurs = same.select("template", F.lit(True).alias("recurs"))
    cut = maybe.join(leaves, "leaf").join(recurs, "template", "left").where("recurs is null").drop("recurs")
    split = F.split("masked", " ")
    # in a select of their own, which is done once a line; rows that repeat a document have lines apart, whose words must not be mixed
    cut = cut.select("doc_id", "k", "pos", "leaf", "n_lines", "masked", F.size(F.array_remove(split, FIELD)).alias("n_fixed"), F.monotonically_increasing_id().alias("line"))
    cut = cut.select("doc_id", "k", "pos", "leaf", "n_lines", "n_fixed", "line", F.posexplode(split).alias("at", "word")).where(F.col("word") != FIELD)
    # a word is what stands at a place of a leaf, so that it tells the leaf as well
    words = written(cut.select("doc_id", "k", "pos", "n_lines", "n_fixed", "line", F.xxhash64("leaf", "at", "word").alias("word")), "line-words")
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.max("n_lines").alias("n_lines")).where(F.col("n") >= MIN_DOCS)
    enough = [*(F.lit(x) for x in SUPPORTS), F.greatest(F.lit(MIN_DOCS), COMMON * F.col("n_lines"))]
    constant = [F.col("n") >= x for x in enough]
    # a word that too few lines have is a field at any support, and a line of no others has no template
    judged = (
        words.drop("n_lines").join(counts, "word")
        .groupBy("line", "doc_id", "k", "pos", "n_fixed")
        .agg(
            *(F.count(F.when(c, 1)).alias(f"n_{i}") for i, c in enumerate(constant)),
            *(F.bit_xor(F.when(c, F.col("word"))).alias(f"form_{i}") for i, c in enumerate(constant)),
        )
    )
    forms = F.array(*(F.when(F.col(f"n_{i}") >= CONSTANT * F.col("n_fixed"), F.col(f"form_{i}")) for i in range(len(constant))))
    general = written(judged.select("doc_id", "k", "pos", F.explode(F.array_distinct(F.array_compact(forms))).alias("template")), "general-templates")
    by_leaf = general.join(_recurring(general, "template", F.lit(MIN_DOCS)), "template").where("k <> first").select("doc_id", "k", "pos")
    return by_mask.unionByName(by_leaf).distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that stays, and n_lines and n_dropped in place of columns of those names.

    A document of which nothing stays has the empty text.
    """
    own, gone, key, lost = (fresh(docs, x) for x in ("own_key", "gone_id", "gone_key", "gone"))
    out = recurring_lines(docs).groupBy("doc_id", "k").agg(F.collect_set("pos").alias(lost)).select(F.col("doc_id").alias(gone), F.col("k").alias(key), lost)
    joined = docs.withColumn(own, _key()).join(out, F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(own) == F.col(key)), "left")
    # a hashed difference of places, and lines that are cut once: linear in a text of any number of dropped lines
    lines = F.split("text", "\n", -1)
    cut = F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost)).alias("stay"))
    kept = F.transform(F.array(cut), lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in rest),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long").alias("n_dropped"),
    )
