"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than the blanks x20 and x09 to x0D. A text fails the base if it has fewer than ``MIN_WORDS`` words or more than
``MAX_REPEATED`` percent of its words in eight-word windows that occur twice or more; it is kept if it passes the base and every
rule of the table. Windows are compared by 64-bit hashes of their words' hashes.

Defined results: a null text has no words, like an empty one, and fails the base; ratios of a text without words are null and break no rule;
repeated rows have equal results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions.text import let
from wareloom.llm.tables import field, whole_text

BLANKS = " \t\n\x0b\f\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
#: Frequent words of English, French, German and Spanish; fixed values.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you were her all "
    "le la les de des du et un une en que qui dans pour pas sur au avec est par plus "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las y del se por con no su para al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """``top / bottom`` must lie within the bounds, for texts of at least ``words`` words."""

    name: str
    top: str
    bottom: str
    least: float | None = None
    most: float | None = None
    words: int = MIN_WORDS


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("symbol_ratio", "n_symbols", "word_chars", most=0.08),
    Rule("exclamation_ratio", "n_marked_words", "n_words", most=0.4),
    Rule("stop_word_ratio", "n_stop_words", "n_words", least=0.02, words=50),
    Rule("echo_ratio", "n_echo_words", "n_words", most=0.25),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", most=0.6),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", most=0.9, words=50),
)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules refer to."""
    bare = lambda c: F.translate(c, BLANKS, "")
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: bare(line) != "")
    plain = docs.select(field("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    split = plain.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    stop = [F.lit(w) for w in sorted(set(STOP_WORDS))]
    long = lambda c: c.cast("bigint")
    return split.select(
        "doc_id", long(F.size("words")).alias("n_words"), long(F.length(bare(F.col("text")))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("words"))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(*stop)))).alias("n_stop_words"),
        long(F.size(F.filter("words", lambda w: w.endswith("!!")))).alias("n_marked_words"),
        long(F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get(F.col("words"), i - 1))))).alias("n_echo_words"),
        long(F.size(F.filter("lines", lambda line: F.ltrim(line).substr(1, 1).isin("-", "*", "•", "·")))).alias("n_bullet_lines"))


def repeated_words(words: Column) -> Column:
    """Words covered by windows that occur at least twice."""
    def of_hashes(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
        keys = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(positions_of_repeats(k), covered)))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def positions_of_repeats(keys: Column) -> Column:
    """Sorted positions of the keys that are not unique: neighbours in key order are compared."""
    def neighbours(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        same = lambda i, j: F.get(sorted_pairs, i)["k"] == F.get(sorted_pairs, j)["k"]
        repeated = F.filter(sorted_pairs, lambda p, i: F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce(F.when(i > 0, same(i, i - 1)), F.lit(False)))
        return F.when(n > 0, F.sort_array(F.transform(repeated, lambda p: p["i"])))

    return let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), neighbours)


def covered(starts: Column) -> Column:
    """Size of the union of [start, start + WINDOW) over sorted starts."""
    add = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s + WINDOW - acc["end"])).alias("n"), (s + WINDOW).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda acc: acc["n"])


def broken(rule: Rule) -> Column:
    ratio = F.col(rule.top) / F.when(F.col(rule.bottom) > 0, F.col(rule.bottom))
    outside = [ratio < rule.least] if rule.least is not None else []
    outside += [ratio > rule.most] if rule.most is not None else []
    return (F.col("n_words") >= rule.words) & F.coalesce(reduce(lambda a, b: a | b, outside), F.lit(False))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures, whether the base failed, the names of broken rules and the verdict."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    out = measures(docs).select("*", base.alias("base_failed"), failed.alias("broken_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
