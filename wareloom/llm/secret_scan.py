"""Secrets in texts, by linking the parts of multipart credentials. DataFrame functions only.

Three base kinds are reported by themselves: assignments of a password-like name, access keys and long hexadecimal strings. Three weak kinds
(account names, token-like strings, endpoints) are candidates only. A candidate is reported when a complementary part lies in the same
scope, a paragraph, however far away: an account name needs a secret, a token an account or access key, an endpoint both.
The interval join is a sweep: per text and scope the parts are ordered by start, and running maxima of ends before and minima of starts
after tell each candidate whether its scope has a part of each role. No pair of parts is formed, and texts themselves are never shuffled.

Positions are code points, ends exclusive. Matches of a kind are leftmost and do not overlap; those failing the kind's condition are dropped.
Candidates that overlap a base span are dropped too.

Defined results: null text counts as empty; texts without matches have zero counts and empty spans; every row has its own result, repeated
rows and null ids too; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom.functions.text import let
from wareloom.llm.tables import Scratch, field, whole_text


def either_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


_SEPARATOR = "[\"']?\\x20*[:=]\\x20*[\"']?"
_SECRET_NAMES = "|".join(either_case(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
_ACCOUNT_NAMES = "|".join(either_case(w).replace("_", "[_-]?") for w in ("access_key_id", "client_id", "account_id", "user_name", "login"))

# kind, pattern (group 2, if any, is the value), condition on the match m and its value v
BASE = (
    ("assign", f"({_SECRET_NAMES}){_SEPARATOR}([A-Za-z0-9+/_.=-]+)", "length(v) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]{24,}", "length(m) >= 24"),  # shorter runs fail anyway, and a longer match never starts inside a shorter run
)
WEAK = (
    ("account", f"({_ACCOUNT_NAMES}){_SEPARATOR}([A-Za-z0-9._@-]{{3,}})", "length(v) >= 3"),
    ("weak_token", "[A-Za-z0-9+/_=-]{16,}", "m rlike '[0-9]' and m rlike '[a-z]' and (m rlike '[A-Z]' or m rlike '^[0-9a-f]+$')"),
    ("endpoint", "(?:https?|ftp|jdbc|postgresql|postgres|mysql|mongodb|redis|amqp)://[^\\s\"'<>]+", "length(m) >= 10"),
)
KINDS = tuple(k for k, _, _ in BASE + WEAK)
BREAK = len(KINDS)  # the kind number of a scope's end
SCOPE_END = "\\n[\\x20\\t\\r]*\\n"


def _hits(text: Column, number: int, pattern: str, with_value: bool) -> Column:
    """Matches as structs: kind number, code points before it since the previous match, the match and its value."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if with_value else found
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"), value.alias("v"))
    listed = F.transform(zipped, lambda z: F.struct(F.lit(number).alias("kind"), F.length(z["gap"]).alias("gap"), z["m"].alias("m"), z["v"].alias("v")))
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast("array<struct<kind:int,gap:int,m:string,v:string>>"))


def spans(rows: DataFrame) -> DataFrame:
    """``rows(row, text)``, row unique -> row, n_assign, n_access, n_hex, base and spans: arrays of (start, kind, end), ordered."""
    text = F.col("text")
    base = F.concat(*[_hits(text, i, p, k == "assign") for i, (k, p, _) in enumerate(BASE)])
    weak = F.concat(*[_hits(text, i + len(BASE), p, k == "account") for i, (k, p, _) in enumerate(WEAK)])
    # Without an account or a link target nothing can be linked, so most texts need no list of candidates.
    can_link = text.rlike(WEAK[0][1]) | text.rlike(WEAK[2][1]) | text.rlike(BASE[1][1])
    extra = F.when(can_link, F.concat(weak, _hits(text, BREAK, SCOPE_END, False))).otherwise(F.array().cast("array<struct<kind:int,gap:int,m:string,v:string>>"))
    # The outer form keeps texts without matches, and does not build the array twice to test its size.
    parts = rows.select("row", F.posexplode_outer(F.concat(base, extra)).alias("pos", "hit")).select("row", "pos", "hit.*").repartition("row")
    in_kind = Window.partitionBy("row", "kind").orderBy("pos")
    size = F.coalesce(F.length("m"), F.lit(0))
    placed = parts.withColumn("end", (F.sum(F.col("gap") + size).over(in_kind)).cast("int")).withColumn("start", F.col("end") - size)
    good = reduce(lambda done, k: done.when(F.col("kind") == k[0], F.expr(k[1][2])), enumerate(BASE + WEAK), F.when(F.col("kind") == BREAK, F.col("m").isNotNull()))
    # The piece after the last match has no match; a text without any keeps its one empty row.
    kept = placed.select("row", "kind", "start", "end", F.coalesce(F.col("m").isNotNull() & good, F.lit(False)).alias("good"))
    kept = kept.withColumn("kind", F.when(F.col("good"), F.col("kind")))
    in_text = Window.partitionBy("row").orderBy("start", "kind")
    scoped = kept.withColumn("scope", F.sum((F.coalesce(F.col("kind"), F.lit(-1)) == BREAK).cast("int")).over(in_text.rowsBetween(Window.unboundedPreceding, 0)))

    in_scope = Window.partitionBy("row", "scope").orderBy("start", "kind")
    before, after = in_scope.rowsBetween(Window.unboundedPreceding, -1), in_scope.rowsBetween(1, Window.unboundedFollowing)

    def near(*kinds: int) -> Column:
        of = F.col("kind").isin(*kinds)
        left = F.max(F.when(of, F.col("end"))).over(before)
        right = F.min(F.when(of, F.col("start"))).over(after)
        return left.isNotNull() | right.isNotNull()

    own = F.col("kind") < len(BASE)
    overlaps = F.coalesce(F.max(F.when(own, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(own, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    linked = scoped.select("row", "kind", "start", "end", overlaps.alias("overlaps"), near(1, 3).alias("by_id"), near(0, 2).alias("by_secret"), near(0, 2, 4).alias("by_any_secret"))
    report = (own | (~F.col("overlaps") & ((F.col("kind") == 3) & F.col("by_any_secret") | (F.col("kind") == 4) & F.col("by_id")
                                           | (F.col("kind") == 5) & F.col("by_id") & F.col("by_secret"))))
    span = F.struct("start", "kind", "end")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return linked.groupBy("row").agg(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                                     F.sort_array(F.collect_list(F.when(own, span))).alias("base"), F.sort_array(F.collect_list(F.when(report, span))).alias("spans"))


def joined(spans_column: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each row, see :func:`spans`."""
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), field("doc_id").cast("bigint").alias("doc_id")).alias("row"), whole_text().alias("text"))
    return spans(rows).select(F.col("row")["doc_id"].alias("doc_id"), "n_assign", "n_access", "n_hex", "base", "spans")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The input rows and columns; in ``text`` each reported span, or run of overlapping spans, is replaced by a mark.

    Texts that match no base pattern and no account name are passed on untouched. (A token or endpoint needs such a part to be reported.)
    """
    scratch = Scratch(docs.sparkSession, "redact")
    text = whole_text()
    suspect = reduce(lambda a, b: a | b, [text.rlike(p) for _, p, _ in (*BASE, WEAK[0])])
    held = scratch.keep(docs.filter(suspect).select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"), text.alias("text")))
    found = spans(held.select("row", "text")).filter(F.size("spans") > 0).select("row", "spans")
    # Runs of overlapping spans become one; what lies between the runs is kept.
    interval = "array<struct<start:int,end:int>>"
    open_run = lambda acc, start, end: F.struct(acc.alias("done"), start.alias("start"), end.alias("end"))
    closed = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))
    runs = F.aggregate(
        F.expr("slice(spans, 2, size(spans))"), open_run(F.array().cast(interval), F.col("spans")[0]["start"], F.col("spans")[0]["end"]),
        lambda acc, s: F.when(s["start"] < acc["end"], open_run(acc["done"], acc["start"], F.greatest(acc["end"], s["end"]))).otherwise(open_run(closed(acc), s["start"], s["end"])),
        closed)
    pieces = let(runs, lambda r: F.arrays_zip(F.concat(F.array(F.lit(0)), r["end"]).alias("a"), F.concat(r["start"], F.array(F.length("text"))).alias("b")))
    # The text is split into characters once, so that cutting is linear in its length.
    between = let(F.split("text", ""), lambda chars: F.transform(pieces, lambda z: F.array_join(F.slice(chars, z["a"] + 1, z["b"] - z["a"]), "")))
    clean = F.when(F.col("spans").isNotNull(), F.array_join(between, mark)).otherwise(F.col("text"))
    cut = held.join(found, "row", "left").withColumn("clean", clean)
    whole = cut.select(F.col("doc").withField("text", F.col("clean")).alias("doc")).select("doc.*")
    return docs.filter(~suspect).unionByName(whole)
