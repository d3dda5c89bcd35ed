"""Quality rules by distribution divergence, in DataFrame functions only (operator 9).

Counts of a document (words are ``[^\\x20\\x09-\\x0D]+``; null text has none):
``n_words``; ``word_chars``, code points in words; ``n_symbols``, characters
of ``[#*$%&|<>]``; ``n_dup_lines``, lines with a word that equal an earlier
line; ``n_repeat_words``, words inside three-word windows that occur twice or
more in the text.  ``base_failed``: under ``MIN_WORDS`` words, or more than
half of the words repeat.

The method: a document's character-class histogram and its histogram over
common words are compared with the references of every language by the
Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts.  The
references are the summed histograms of all documents of a language (or of
``lang`` null, as one more) that pass the base rules; they are summed a
second time without the documents far from the first ones, so that junk does
not blur them.  A document that passes the base rules fails if its character
distance exceeds ``MAX_CHAR`` (``MAX_CHAR_SHORT`` under ``MIN_CHAR`` words, as
a short text strays further by chance) or, where it has at least
``MIN_COMMON`` words, its common-word distance exceeds ``MAX_COMMON``.  With no
reference at all (an empty table) nothing is compared.

Repeated rows and ties change nothing; further columns are ignored; empty
and null texts fail the base rules with all counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import saved

MIN_WORDS = 50
MAX_REPEAT = 50               # per cent of the words
MIN_CHAR, MAX_CHAR, MAX_CHAR_SHORT = 150, 0.19, 0.24
MIN_COMMON, MAX_COMMON = 200, 0.30
TRIM_CHAR, TRIM_COMMON, TRIM_NOISE = 0.30, 0.18, 2.0      # of the first references; noise over the root of the words
SPACE = r"[\x20\x09-\x0D]+"

#: Fixed: function words whose frequencies make the common-word histogram.
COMMON_WORDS = ("the of and to in a is that it on for was be with as this at from or are "
                "der die das und ist nicht mit von zu den ein eine im auf des "
                "le la les de du et un une que qui dans pour par sur est "
                "el los las del y por con para en al se no su como").split()
CHAR_CLASSES = ("lower", "upper", "digit", "mark", "symbol", "sentence")


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    The windows' hashes are sorted with their places; equal neighbours give
    the places of repeated windows, and consecutive places add at most three
    words each: n log n in the length of the text.
    """
    def covered(grams: Column) -> Column:
        # (hash, place) pairs in order; a pair is repeated if a neighbour has its hash
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return _let(pairs, lambda p: _let(
            F.sort_array(F.transform(F.filter(
                F.zip_with(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.struct(a.alias("a"), b["g"].alias("next"))),
                           F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))),
                           lambda ab, c: F.struct(ab["a"]["i"].alias("i"),
                                                  (ab["a"]["g"].eqNullSafe(ab["next"]) | ab["a"]["g"].eqNullSafe(c["g"])).alias("twice"))),
                lambda x: x["twice"]), lambda x: x["i"])),
            lambda at: F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
                                   F.lit(0), lambda s, x: s + x)))

    grams = F.transform(F.slice(words, 1, F.size(words) - 2),
                        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    many = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(many)


def _without(c: str, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` with the base counts and the two histograms (arrays of longs)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # classes are stripped one after the other: only the first pass reads the whole text
    left = (docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("t"))
            .withColumn("words", F.filter(F.split("t", SPACE), lambda w: w != ""))
            .withColumn("t1", _without("t", r"\p{Ll}+"))
            .withColumn("t2", _without("t1", SPACE))
            .withColumn("t3", _without("t2", r"\p{Lu}+"))
            .withColumn("t4", _without("t3", r"\p{N}+"))
            .withColumn("t5", _without("t4", r"[.,;:'\"-]+"))
            .withColumn("t6", _without("t5", r"[#*$%&|<>]+")))
    n = {k: F.length(k).cast("long") for k in ("t", "t1", "t2", "t3", "t4", "t5", "t6")}
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    known = F.array(*map(F.lit, COMMON_WORDS))
    common = _let(F.filter("words", lambda w: F.array_contains(known, w)),
                  lambda hits: F.transform(known, lambda w: (F.size(hits) - F.size(F.array_remove(hits, w))).cast("long")))
    counted = (left.withColumn("lines", lines)
               .select("doc_id", "lang", F.size("words").cast("long").alias("n_words"),
                       (n["t"] - n["t1"] + n["t2"]).alias("word_chars"), (n["t5"] - n["t6"]).alias("n_symbols"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
                       F.array(n["t"] - n["t1"], n["t2"] - n["t3"], n["t3"] - n["t4"], n["t6"], n["t5"] - n["t6"], n["t4"] - n["t5"]).alias("chars"),
                       common.alias("common")))
    rest = F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x)
    return (counted.withColumn("common", F.concat("common", F.array(rest)))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))))


def references(rows: DataFrame) -> DataFrame:
    """One row: ``refs``, an array with the shares of every language, summed over its documents that pass the base rules."""
    def summed(c: str, n: int) -> list[Column]:
        return [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(n)]

    def shares(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))
    sizes = {"chars": len(CHAR_CLASSES), "common": len(COMMON_WORDS) + 1}
    total = rows.where(~F.col("base_failed")).groupBy("lang").agg(*(s for c, n in sizes.items() for s in summed(c, n)))
    each = total.select("lang", *(shares(F.array(*(f"{c}{i}" for i in range(n)))).alias(c) for c, n in sizes.items()))
    return each.agg(F.sort_array(F.collect_list(F.struct("lang", "chars", "common"))).alias("refs"))


def js_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; null without a reference."""
    terms = F.zip_with(shares, reference, lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0))
                       .otherwise(q))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _nearest(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with ``near``: distances to the reference of the nearest language by common words (null without references).

    ``refs`` is one row (a scalar subquery: it reaches the executors as a value,
    not as text of the plan).  Written to the shared folder, as filters and
    several columns use it.
    """
    def share(counts: str, total: str) -> Column:
        return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))

    def distance(shares: Column, reference: Column) -> Column:
        return F.coalesce(js_distance(shares, reference), F.lit(1.0))
    near = _let(share("common", "n_words"), lambda common: _let(share("chars", "word_chars"), lambda chars: F.array_min(F.transform(
        "refs", lambda r: F.struct(distance(common, r["common"]).alias("common_distance"), distance(chars, r["chars"]).alias("char_distance"),
                                   r["lang"].alias("nearest"))))))
    return saved(rows.withColumn("refs", refs.scalar()).withColumn("near", near).drop("refs"), "rule-distances")


def quality_rules(docs: DataFrame, max_char: float = MAX_CHAR, max_char_short: float = MAX_CHAR_SHORT,
                  max_common: float = MAX_COMMON) -> DataFrame:
    """One row per document: the counts, ``char_distance``, ``common_distance``, ``nearest``, ``kept``."""
    rows = saved(features(docs), "rule-features")
    # references are sums over all documents: one short row per language
    first = saved(references(rows), "rule-references")
    close = ((F.col("near.char_distance") <= TRIM_CHAR)
             & (F.col("near.common_distance") <= TRIM_COMMON + TRIM_NOISE / F.sqrt("n_words")))
    refs = references(_nearest(rows, first).where(close))
    refs = saved(refs.select(F.when(F.size("refs") > 0, F.col("refs")).otherwise(first.scalar()).alias("refs")), "rule-references")
    far = ((F.col("near.char_distance") > F.when(F.col("n_words") < MIN_CHAR, max_char_short).otherwise(max_char))
           | ((F.col("n_words") >= MIN_COMMON) & (F.col("near.common_distance") > max_common)))
    return (_nearest(rows, refs)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "near.char_distance", "near.common_distance", "near.nearest",
                    (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept")))
