"""Spelling variants of the corpus vocabulary through permuterm rotations.

A word w is marked with a terminator, w$, and rotated by every i: w[i:] $ w[:i]. Written this way one edit stands at the end of a rotation:

* the rotation that ends in w[i] has, without this last character, the prefix P = w[i+1:] $ w[:i], which skips the edited character. Words that
  share P differ by replacing that character;
* a word without that character has P itself as a full rotation, so it differs by an insertion.

All words one edit apart thus meet in the range of rotations that begin with P and have at most one character more. Rotations are sorted by
P and each range is scanned once. It holds one word for each character of the alphabet and one without, 91 at most, whatever the corpus, so no
range is hot. A pair meets in exactly one range of its replaced position; of an insertion into a run of equal characters the ranges are as
many as the run is long, and it counts where the first of the run is skipped.

Forms are followed to their last by pointer doubling over written tables. A form occurs at least five times as often as its word, so chains
are short (fewer than 27 for counts of 64 bits).

Defined results: null and empty texts have no words; a null doc_id counts as an empty text in the damage key; repeated rows count each time;
an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom.llm.tables import Scratch, field, whole_text

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"
DAMAGE = 199  # one run in so many loses a character
LEAST_LENGTH, LEAST_COUNT = 6, 5
LEAST_RATIO = 5  # a form occurs at least so many times as often


def lowered(run: Column) -> Column:
    """A-Z only; most runs have none."""
    return F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, LOWER)).otherwise(run)


def vocabulary(docs: DataFrame, damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words after damage, with their occurrences; counts combine before the shuffle."""
    runs = docs.select(F.coalesce(field("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(whole_text(), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length).select("id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    damaged = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(h % damage == 0, damaged).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, skipped): each full rotation, and each one without its last character, which is ``skipped``."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    i, word = F.col("i"), F.col("word")
    head, rest = word.substr(F.lit(1), i), word.substr(i + 1, F.length("word"))
    full = F.struct(F.concat(rest, F.lit(END), head).alias("prefix"), F.lit("").alias("skipped"))
    short = F.struct(F.concat(word.substr(i + 2, F.length("word")), F.lit(END), head).alias("prefix"), word.substr(i + 1, F.lit(1)).alias("skipped"))
    both = F.when(i < F.length("word"), F.array(full, short)).otherwise(F.array(full))
    return at.select("word", "n", F.explode(both).alias("r")).select("r.prefix", "word", "n", "r.skipped")


def larger(n: str = "n", word: str = "word") -> Column:
    """Sorts words by larger count, then smaller text."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of words one edit away, and the one of largest count as struct(less = -n, word).

    Each range gives one row per member: how many of its pairs count here, and the best of the others, so pairs are never written out.
    """
    ranges = Window.partitionBy("prefix")
    sorted_ranges = ranges.orderBy(larger()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = rotations(words).select("prefix", "word", "n", "skipped", F.substring("prefix", -1, 1).alias("before"))
    is_full = F.col("skipped") == ""
    first_of_run = F.col("skipped") != F.col("before")  # "before" is the terminator where the first character is skipped
    met = met.select("word", "skipped", "before",
                     F.count("*").over(ranges).alias("members"),
                     F.max(is_full).over(ranges).alias("has_full"),
                     F.sum((~is_full & first_of_run).cast("int")).over(ranges).alias("counted"),
                     F.first(larger()).over(sorted_ranges).alias("top"),
                     F.nth_value(larger(), 2).over(sorted_ranges).alias("second")).filter("members > 1")
    others = F.col("members") - F.col("has_full").cast("int") - 1
    n_near = F.when(is_full, F.col("counted")).otherwise(others + (F.col("has_full") & first_of_run).cast("int"))
    best = F.when(F.col("top")["word"] == F.col("word"), F.col("second")).otherwise(F.col("top"))
    return met.select("word", n_near.alias("n_near"), best.alias("best")).groupBy("word").agg(F.sum("n_near").cast("bigint").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where the chain of forms of each word ends, by doubling the steps until no word moves."""
    jumps = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = scratch.keep(jumps.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        jumps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return jumps


def grouped(docs: DataFrame, damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = LEAST_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(vocabulary(docs, damage, least_length, least_count))
    near = neighbours(words)
    is_form = -F.col("best")["less"] >= ratio * F.col("n")
    judged = scratch.keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best")["word"]).alias("form"), F.when(is_form, -F.col("best")["less"]).alias("form_n")))
    ends = roots(judged.filter("form IS NOT NULL"), scratch)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
