"""Repair of conversation structure: the cheapest edits that make a conversation alternate, by a checkpointed dynamic programme.

The edits read the rows of a conversation in order and end in an accepted role sequence: empty, or an optional system turn followed by one
or more user/assistant pairs. Four states say what has been emitted: nothing (0), a system turn (1), a user turn (2), a pair (3). The value
of a state before a row is the least cost from there to the end; walking forward and always taking the ASCII-least edit that keeps the least
cost gives the ASCII-least audit of all cheapest ones, because each edit letter leads from a state to exactly one other.

Values are not stored for every row. A conversation is cut into blocks of about the square root of the longest conversation's rows:

1. each block gives the least costs between its 16 pairs of states (a min-plus matrix);
2. going backward over the matrices of a conversation gives the value vector at each checkpoint, the only ones that are stored;
3. each block recomputes its own values from the checkpoint behind it and walks forward from each of the four entry states;
4. the exits are chained from the front, which picks one walk of each block.

Rows are put in order by a range sort whose key includes the turn, so a conversation with a third of all rows is spread over many tasks, and
no task holds more than a block or the checkpoints of a conversation, both about the square root of its length. Texts take no part in this:
they meet the surviving rows in one join by digest.

Order: turn (nulls first), then role, then text. Null roles and texts count as one space, and so do null ids and turns in the damage key.
Rows with a null conv_id form one conversation. Equal rows are duplicates of the first. Conversations that lose all rows, and an empty
table, give zeros and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.llm.tables import Scratch, field

BLANKS = " \t\n\x0b\x0c\r"
LEAST_BLOCK = 8  # blocks have at least 2 ** 8 rows
REROLE, DELETE, INSERT, KEPT_TRUNCATED = 2, 3, 2, 1
NEXT = (2, 2, 3, 2)  # the state after an inserted or rewritten turn
STATES = range(4)
END = (0, 2 * INSERT, INSERT, 0)  # least cost from each state to an accepted end
FAR = 1 << 40
FINE, TRUNCATED, GONE = 0, 1, 2  # gone: blank or duplicate
SYSTEM, USER, ASSISTANT, OTHER = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
KEEP = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}  # (state, role) -> state
NAMES = {2: "user", 3: "assistant"}


def step(role: int, fault: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Values before a row from the values after it."""
    extra = KEPT_TRUNCATED * (fault == TRUNCATED)
    here = []
    for q in STATES:
        best = after[q] + DELETE
        if fault != GONE:
            best = min(best, after[NEXT[q]] + REROLE + extra)
            if (q, role) in KEEP:
                best = min(best, after[KEEP[q, role]] + extra)
        here.append(best)
    for _ in range(3):  # inserts lead 0, 1 -> 2 -> 3 -> 2
        here = [min(here[q], here[NEXT[q]] + INSERT) for q in STATES]
    return tuple(here)


@lru_cache(1 << 14)
def transfer(symbols: tuple[int, ...]) -> list[int]:
    """Least cost from each state before the rows (row-major) to each state behind them; inserts behind the last row are not counted."""
    ends = []
    for q in STATES:
        values = tuple(0 if p == q else FAR for p in STATES)
        for symbol in reversed(symbols):
            values = step(symbol & 3, symbol >> 2, values)
        ends.append(values)
    return [min(ends[q][p], FAR) for p in STATES for q in STATES]


def before(matrix: list[int], after: list[int]) -> list[int]:
    return [min(matrix[4 * q + p] + after[p] for p in STATES) for q in STATES]


@lru_cache(1 << 14)
def walk(symbols: tuple[int, ...], after: tuple[int, ...], entry: int, last: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a block from an entry state, and the state they end in."""
    values = [after]
    for symbol in reversed(symbols):
        values.append(step(symbol & 3, symbol >> 2, values[-1]))
    values.reverse()
    audit, q, i = [], entry, 0
    while i < len(symbols):
        role, fault = symbols[i] & 3, symbols[i] >> 2
        here, behind = values[i][q], values[i + 1]
        extra = KEPT_TRUNCATED * (fault == TRUNCATED)
        if behind[q] + DELETE == here:  # letters in ASCII order: D, I, K, R
            audit.append("D")
            i += 1
        elif values[i][NEXT[q]] + INSERT == here:
            audit.append("I")
            q = NEXT[q]
        elif fault != GONE and (q, role) in KEEP and behind[KEEP[q, role]] + extra == here:
            audit.append("K")
            q, i = KEEP[q, role], i + 1
        else:
            audit.append("R")
            q, i = NEXT[q], i + 1
    if last:
        while after[q]:
            audit.append("I")
            q = NEXT[q]
    return "".join(audit), q


def damaged(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text, row): the rows after damage; ``row`` tells equal rows apart and ``key`` is the conversation's."""
    turn, spaced = field("turn"), lambda name: F.coalesce(field(name).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select(key().alias("key"), turn.cast("bigint").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), hit.alias("hit"),
                                F.monotonically_increasing_id().alias("row")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "row", F.explode(copies).alias("copy"))


def key() -> Column:
    """A conversation's key: its id as text, told apart from a null id."""
    return F.coalesce(F.concat(F.lit("="), field("conv_id").cast("string")), F.lit(""))


def digest() -> Column:
    """Equal for rows of equal role and text only."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, turn, at, role, digest, blank, truncated): ``at`` numbers the rows in order, with a gap after each partition of the sort.

    Texts are carried through the sort only where turns repeat within a conversation, since only then they decide the order.
    """
    turns = rows.filter("copy = 0").groupBy("key", "turn").agg(F.count("*").alias("n")).filter("n > 1")
    tied = not turns.isEmpty()
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    light = rows.select("key", "turn", F.col("role").alias("name"), (F.col("text") if tied else F.lit(None).cast("string")).alias("tie"), "row", "copy", role.alias("role"),
                        digest().alias("digest"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"))
    order = ["key", F.col("turn").asc_nulls_first(), "name", "tie", "row", "copy"]
    number = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = light.repartitionByRange(number, *order).sortWithinPartitions(*order)
    return scratch.keep(in_order.select("key", "turn", F.monotonically_increasing_id().alias("at"), "role", "digest", "blank", "truncated"))


def marked(rows: DataFrame) -> DataFrame:
    """Add ``duplicate``: a row that is not blank and has the digest of an earlier one."""
    firsts = rows.filter("NOT blank").groupBy("key", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(firsts, ["key", "digest"], "left").withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))).drop("first")


def blocks(rows: DataFrame, bits: int) -> DataFrame:
    """(key, block, rows): the rows of each block in order, 2 ** bits at most."""
    fault = F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    entry = F.struct("at", (F.col("role") + 4 * fault).cast("int").alias("symbol"), "digest")
    return rows.groupBy("key", F.shiftright("at", bits).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("rows"))


def symbols_of(rows) -> tuple[int, ...]:
    return tuple(r["symbol"] for r in rows)


def _transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for k, block, rows in zip(pdf["key"], pdf["block"], pdf["rows"]):
            symbols = symbols_of(rows)
            roles = [s & 3 for s in symbols]
            out.append((k, block, list(transfer(symbols)), sum(pair not in LEGAL for pair in zip(roles, roles[1:])), roles[0], roles[-1]))
        yield pd.DataFrame(out, columns=["key", "block", "matrix", "illegal", "head", "tail"])


def _checkpoints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Value vectors behind each block, from the last to the first."""
    for pdf in batches:
        out = []
        for k, parts in zip(pdf["key"], pdf["parts"]):
            values, vectors = list(END), []
            for part in reversed(parts):
                vectors.append({"block": part["block"], "after": values, "last": not vectors})
                values = before(part["matrix"], values)
            illegal = sum(p["illegal"] for p in parts) + sum((a["tail"], b["head"]) not in LEGAL for a, b in zip(parts, parts[1:]))
            out.append((k, values[0], illegal, vectors))
        yield pd.DataFrame(out, columns=["key", "cost", "illegal", "vectors"])


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for k, block, rows, after, last in zip(pdf["key"], pdf["block"], pdf["rows"], pdf["after"], pdf["last"]):
            symbols, values = symbols_of(rows), tuple(int(v) for v in after)
            audits, exits = zip(*(walk(symbols, values, q, bool(last)) for q in STATES))
            out.append((k, block, list(audits), list(exits)))
        yield pd.DataFrame(out, columns=["key", "block", "audits", "exits"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for k, parts in zip(pdf["key"], pdf["parts"]):
            q = 0
            for part in parts:
                out.append((k, part["block"], q))
                q = part["exits"][q]
        yield pd.DataFrame(out, columns=["key", "block", "entry"])


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the repaired conversation; ``role`` is null where a row keeps its own, ``digest`` where a row is new."""
    for pdf in batches:
        out = []
        for k, rows, entry, audit in zip(pdf["key"], pdf["rows"], pdf["entry"], pdf["audit"]):
            q, i, place = entry, 0, 0
            for place, letter in enumerate(audit):
                row = rows[i] if i < len(rows) else rows[-1]
                if letter == "K":
                    q = KEEP[q, row["symbol"] & 3]
                    out.append((k, row["at"], place, letter, None, row["digest"]))
                elif letter != "D":
                    q = NEXT[q]
                    out.append((k, row["at"], place, letter, NAMES[q], row["digest"] if letter == "R" else None))
                i += letter != "I"
        yield pd.DataFrame(out, columns=["key", "at", "place", "edit", "role", "digest"])


def gathered(parts: DataFrame, *columns: str) -> DataFrame:
    """(key, parts): what each conversation's blocks say, in order."""
    return parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("parts"))


class Repair:
    """The repair of a table of conversations, as tables by conversation key (``key()``)."""

    def __init__(self, conversations: DataFrame, least_block: int = LEAST_BLOCK):
        self.conversations = conversations
        scratch = Scratch(conversations.sparkSession, "repair")
        self.rows = damaged(conversations)
        in_order = ordered(self.rows, scratch)
        self.marked = scratch.keep(marked(in_order))
        longest = self.marked.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        bits = max(least_block, (longest.bit_length() + 1) // 2)  # at least the square root
        cut = scratch.keep(blocks(self.marked, bits))
        matrices = scratch.keep(cut.mapInPandas(_transfers, "key string, block bigint, matrix array<bigint>, illegal bigint, head int, tail int"))
        self.costs = scratch.keep(gathered(matrices, "matrix", "illegal", "head", "tail").mapInPandas(
            _checkpoints, "key string, cost bigint, illegal bigint, vectors array<struct<block: bigint, after: array<bigint>, last: boolean>>"))
        vectors = self.costs.select("key", F.explode("vectors").alias("v")).select("key", "v.*")
        walks = scratch.keep(cut.join(vectors, ["key", "block"]).mapInPandas(_walks, "key string, block bigint, audits array<string>, exits array<int>"))
        entries = gathered(walks, "exits").mapInPandas(_entries, "key string, block bigint, entry int")
        chosen = walks.join(entries, ["key", "block"]).select("key", "block", "entry", F.element_at("audits", F.col("entry") + 1).alias("audit"))
        self.chosen = scratch.keep(chosen)
        self.lines = cut.join(self.chosen, ["key", "block"]).select("key", "rows", "entry", "audit").mapInPandas(
            _lines, "key string, at bigint, place int, edit string, role string, digest binary")

    def audits(self) -> DataFrame:
        """(key, audit): the edits of each conversation, one letter each."""
        return gathered(self.chosen, "audit").select("key", F.array_join(F.col("parts.audit"), "").alias("audit"))

    def repaired(self) -> DataFrame:
        """(key, at, place, edit, role, text): the repaired conversations; ``at`` and ``place`` give the order."""
        texts = self.rows.filter("copy = 0").select("key", digest().alias("digest"), F.col("role").alias("own"), "text")
        texts = texts.groupBy("key", "digest").agg(F.first("own").alias("own"), F.first("text").alias("text"))
        old = self.lines.filter("digest IS NOT NULL").join(texts, ["key", "digest"]).select("key", "at", "place", "edit", F.coalesce("role", "own").alias("role"), "text")
        return old.unionByName(self.lines.filter("digest IS NULL").select("key", "at", "place", "edit", "role", F.lit("").alias("text")))

    def report(self) -> DataFrame:
        """Counts, cost and audit of every original conversation."""
        flag = lambda c: F.sum(c.cast("bigint"))
        gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        fine = ~F.col("blank") & ~F.col("duplicate")
        counts = self.marked.groupBy("key").agg(gaps.alias("gaps"), flag(F.col("blank")).alias("blank"), flag(F.col("duplicate")).alias("duplicate"),
                                                flag(fine & F.col("truncated")).alias("truncated"))
        every = self.conversations.groupBy(key().alias("key")).agg(F.first(field("conv_id")).alias("conv_id"))
        numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        joined = every.join(counts, "key", "left").join(self.costs.drop("vectors"), "key", "left").join(self.audits(), "key", "left")
        return joined.select("key", "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 of each conversation's lines, which come in order; nothing but the running hash is kept."""
    current, running = None, None
    for batch in batches:
        keys, found = [], []
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
            if running is None or k != current:
                if running is not None:
                    keys.append(current)
                    found.append(running.hexdigest())
                current, running = k, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"key": keys, "sha": found}, schema=HASHES)
    if running is not None:
        yield pa.RecordBatch.from_pydict({"key": [current], "sha": [running.hexdigest()]}, schema=HASHES)


HASHES = pa.schema([("key", pa.string()), ("sha", pa.string())])


def digests(repaired: DataFrame) -> DataFrame:
    """(key, sha) over ``role:text`` lines joined by newlines.

    A hash chain is sequential, so the lines of a conversation pass through one task; they are sorted on disk and streamed.
    """
    lines = repaired.select("key", "at", "place", "role", "text").repartition("key").sortWithinPartitions("key", "at", "place")
    return lines.mapInArrow(_hashes, "key string, sha string")


def audited(conversations: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """The report of every conversation, with the digest of its repaired lines."""
    repair = Repair(conversations, least_block)
    shas = digests(repair.repaired())
    empty = hashlib.sha256(b"").hexdigest()
    return repair.report().join(shas, "key", "left").withColumn("repaired_sha256", F.coalesce("sha", F.lit(empty))).drop("key", "sha")
