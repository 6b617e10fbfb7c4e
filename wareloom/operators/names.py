"""Listing names built from verified keywords.

Everything here is per product and bounded: curated keyword lists hold at most ten entries and a name at most nine
tokens, so the greedy chain is one ``aggregate`` over a short array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.rows import explode_built
from wareloom.functions.skew import dealt
from wareloom.functions.text import folded, let, nfkc, no_texts, squash, tokens_fit, tokens_of

TOKENS = "array<string>"


def _padded(tokens: Column) -> Column:
    """Folded tokens as ``" a b c "``, so that containment respects token borders."""
    return F.concat(F.lit(" "), F.array_join(folded(tokens), " "), F.lit(" "))


def contains_run(container: Column, run: Column) -> Column:
    """Whether the tokens of ``run`` occur one after another in ``container``."""
    return _padded(container).contains(_padded(run))


def without_brand(tokens: Column, brand: Column) -> Column:
    """Tokens that are not brand tokens, each kept at most twice."""
    def keep(acc, token):
        seen = F.size(F.filter(acc, lambda a: F.lower(a) == F.lower(token)))
        return F.when(F.array_contains(brand, F.lower(token)) | (seen >= K.NAME_MAX_REPEATS), acc).otherwise(F.array_append(acc, token))
    return F.aggregate(tokens, no_texts(), keep)


def keyword_tokens(keywords: Column, brand: Column) -> Column:
    """Keywords as token lists in order, without brand tokens and without those contained in an earlier kept one."""
    cleaned = F.transform(keywords, lambda k: without_brand(tokens_of(k, normalize=False), brand))

    def keep(acc, tokens):
        inside = F.exists(acc, lambda a: contains_run(a, tokens))
        return F.when((F.size(tokens) == 0) | inside, acc).otherwise(F.concat(acc, F.array(tokens)))

    return F.aggregate(cleaned, F.array().cast("array<array<string>>"), keep)


def _overlap(left: Column, right: Column) -> Column:
    """Longest tail of ``left`` that is a head of ``right``."""
    def fits(n):
        return F.slice(left, F.size(left) - n + 1, n) == F.slice(right, F.lit(1), n)
    sizes = F.filter(F.sequence(F.lit(0), F.least(F.size(left), F.size(right))), lambda n: (n == 0) | fits(n))
    return F.array_max(sizes)


def _joined(chain: Column, other: Column) -> Column:
    """Ways to attach one keyword: ``array<struct<overlap, append, tokens>>`` of those that overlap and fit."""
    def ways(o):
        append = F.concat(chain, F.slice(other, o["a"] + 1, F.greatest(F.size(other) - o["a"], F.lit(0))))
        prepend = F.concat(F.slice(other, F.lit(1), F.greatest(F.size(other) - o["p"], F.lit(0))), chain)
        way = lambda n, kind, tokens: F.when((n > 0) & tokens_fit(tokens), F.struct(n.alias("overlap"), F.lit(kind).alias("append"), tokens.alias("tokens")))
        return F.array_compact(F.array(way(o["a"], 1, append), way(o["p"], 0, prepend)))
    low_chain, low_other = folded(chain), folded(other)
    return let(F.struct(_overlap(low_chain, low_other).alias("a"), _overlap(low_other, low_chain).alias("p")), ways)


def chain_keywords(keywords: Column) -> Column:
    """Greedy chain: start with the first fitting keyword; attach the one with the largest overlap (append before
    prepend, earlier before later); with no overlap left, add the next keyword whole if it fits."""
    empty = no_texts()
    first = F.array_position(F.transform(keywords, lambda k: tokens_fit(k)), F.lit(True)).cast("int")
    state = F.when(first > 0, F.struct(
        F.get(keywords, first - 1).alias("chain"),
        F.filter(keywords, lambda k, i: i != first - 1).alias("rest"))).otherwise(
        F.struct(empty.alias("chain"), F.array().cast("array<array<string>>").alias("rest")))

    def step(s, _):
        options = F.flatten(F.transform(s["rest"], lambda k, i: F.transform(_joined(s["chain"], k), lambda w: F.struct(
            w["overlap"].alias("overlap"), w["append"].alias("append"), (-i).alias("earlier"), w["tokens"].alias("tokens")))))

        def advance(best):
            whole = F.concat(s["chain"], F.get(s["rest"], 0))
            attached = F.struct(best["tokens"].alias("chain"), F.filter(s["rest"], lambda k, i: i != -best["earlier"]).alias("rest"))
            added = F.struct(F.when(tokens_fit(whole), whole).otherwise(s["chain"]).alias("chain"),
                             F.slice(s["rest"], F.lit(2), F.greatest(F.size(s["rest"]) - 1, F.lit(0))).alias("rest"))
            return F.when(best.isNotNull(), attached).otherwise(added)

        return F.when(F.size(s["rest"]) == 0, s).otherwise(let(F.array_max(options), advance))

    return F.aggregate(keywords, state, step)["chain"]


def fitting_head(tokens: Column) -> Column:
    """Longest head of a token list that fits the name bounds."""
    return F.aggregate(tokens, F.struct(no_texts().alias("kept"), F.lit(True).alias("open")), lambda s, t: let(
        F.array_append(s["kept"], t), lambda longer: F.when(s["open"] & tokens_fit(longer), F.struct(longer.alias("kept"), F.lit(True).alias("open")))
        .otherwise(F.struct(s["kept"].alias("kept"), F.lit(False).alias("open")))))["kept"]


def with_tokens(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Compatibility-normalise the texts once: adds ``_brand, _keywords, _refined, _original``; empty ones where not ``wanted``."""
    text = lambda c: F.col(c) if wanted is None else F.when(wanted, F.col(c))
    lists = F.split(nfkc(F.array_join(F.coalesce(text("keywords"), no_texts()), "\x1f")), "\x1f")
    df = df.withColumns({"_kw": lists, "_b": nfkc(text("brand_name")), "_r": nfkc(text("refined_name")), "_o": nfkc(text("original_name"))})
    plain = lambda c: tokens_of(F.col(c), normalize=False)
    return df.withColumns({"_brand": folded(plain("_b")), "_refined": plain("_r"), "_original": plain("_o")}).withColumn(
        "_keywords", keyword_tokens(F.col("_kw"), F.col("_brand"))).drop("_b", "_r", "_o")


def generate_names(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Add ``generated_name`` to rows with ``keywords, refined_name, brand_name, original_name``; only where ``wanted``."""
    df = with_tokens(df, wanted).withColumn("_chain", F.when(F.lit(True) if wanted is None else wanted, chain_keywords(F.col("_keywords"))))
    head = lambda c: fitting_head(without_brand(F.col(c), F.col("_brand")))
    name = F.when(F.size("_chain") > 0, F.col("_chain")).otherwise(
        let(head("_refined"), lambda r: F.when(F.size(r) > 0, r).otherwise(head("_original"))))
    df = df.withColumn("generated_name", F.when(F.col("_chain").isNotNull(), F.array_join(name, " ")))
    return df.drop("_chain", "_keywords", "_refined", "_original", "_brand", "_kw")


def _position(hay: Column, run: Column) -> Column:
    """Token index at which ``run`` starts in the padded folded tokens ``hay``; null when it does not occur."""
    needle = F.concat(F.lit(" "), F.array_join(run, " "), F.lit(" "))

    def index(at):
        before = F.call_function("substring", hay, F.lit(1), at)
        return F.when(at > 0, F.char_length(before) - F.char_length(F.translate(before, " ", "")) - 1)

    return let(F.call_function("instr", hay, needle), index)


def candidate_scores(df: DataFrame) -> DataFrame:
    """One row per (product, candidate) that is clean, fits, uses only allowed tokens and covers a keyword.

    Tokens and hits are built inside the exploded array: as columns above a filter, the optimizer would repeat their patterns in every test.
    """

    joined = F.array_join(F.transform("candidates", lambda c: F.coalesce(c, F.lit(""))), "\x1f")
    df = df.withColumns({
        "_c": F.split(nfkc(joined), "\x1f"), "_k": F.split(nfkc(F.array_join(F.coalesce("keywords", no_texts()), "\x1f")), "\x1f"),
        "_r": nfkc("refined_name"), "_b": nfkc("brand_name")})
    plain = lambda c: tokens_of(c, normalize=False)
    df = df.withColumns({
        "_kt": F.filter(F.transform("_k", lambda k: folded(plain(k))), lambda k: F.size(k) > 0),
        "_brand": folded(plain(F.col("_b"))), "_refined": folded(plain(F.col("_r")))})
    df = df.withColumn("_allowed", F.array_union(F.flatten("_kt"), F.col("_refined")))

    def tokenised(c, i):
        return let(plain(c), lambda t: F.struct(
            i.alias("index"), (squash(c) == F.array_join(t, " ")).alias("clean"), t.alias("tokens"), folded(t).alias("low"), _padded(t).alias("hay")))

    def scored(c):
        grounded = (c["clean"] & tokens_fit(c["tokens"]) & ~F.arrays_overlap(c["low"], F.col("_brand"))
                    & F.forall(c["low"], lambda t: F.array_contains("_allowed", t)))
        hits = F.transform("_kt", lambda k, i: F.struct((F.size("_kt") - i).alias("weight"), F.size(k).alias("n"), _position(c["hay"], k).alias("at")))
        return F.struct(c["index"].alias("index"), F.array_join(c["tokens"], " ").alias("name"),
                        F.when(grounded, F.filter(hits, lambda h: h["at"].isNotNull())).alias("hits"))

    rows = explode_built(df, F.transform(F.transform("_c", tokenised), scored), "product_id", name="c").select("product_id", "c.*")
    add = lambda fn: F.aggregate("hits", F.lit(0), lambda acc, h: (acc + fn(h)).cast("int"))
    length = F.char_length("name")
    preference = F.when(length.between(25, 35), 0).otherwise(-F.least(F.abs(length - 25), F.abs(length - 35)))
    return rows.filter(F.size("hits") > 0).select("product_id", "index", "name", add(lambda h: h["weight"] * h["n"]).alias("coverage"),
                                                  add(lambda h: -h["weight"] * h["at"]).alias("front"), preference.alias("length_score"))


def select_names(df: DataFrame) -> DataFrame:
    """Add ``product_name`` and ``from_candidate``: the strongest grounded candidate, else the generated name.

    Rows need ``product_id, candidates, keywords, refined_name, brand_name, original_name``. Each takes long for its few bytes, so rows are dealt
    before both steps: the tasks that read a small file, or that adaptive execution joins by bytes, would be few.
    """
    score = F.struct("coverage", "front", "length_score", (-F.col("index")).alias("earlier"))
    best = candidate_scores(dealt(df)).groupBy("product_id").agg(F.max_by("name", score).alias("_best"))
    joined = generate_names(dealt(df.join(best, "product_id", "left")), wanted=F.col("_best").isNull())
    return joined.withColumns({"product_name": F.coalesce("_best", "generated_name"), "from_candidate": F.col("_best").isNotNull()}).drop("_best", "generated_name")
