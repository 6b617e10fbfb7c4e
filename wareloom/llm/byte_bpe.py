"""Byte-level BPE encoding and decoding with a published vocabulary.

Texts up to ``CHUNK`` characters are encoded as they are. A longer one is cut into chunks that overlap by ``OVERLAP`` characters, and the chunks
are pre-tokenised in parallel, each from its own first character. Where a boundary found from chunk k is also found from chunk k + 1, the
latter has resynchronised: the pattern looks only ahead, so from there on its boundaries are those of the whole text. The text is cut
at the first such boundary of each overlap (a chunk without one stays with its predecessor), the pieces are encoded in parallel, and
their ids are joined in order. Decoding joins the tokens' raw bytes.

Boundaries close to a chunk's end may be due to the cut; they are not used (``MARGIN`` exceeds the pattern's longest look ahead). Nor are
those after white space, which the pattern groups by what follows.

Defined results: a null text counts as empty and has no ids; each row is encoded by itself, repeated rows and null ids too; special tokens'
strings are ordinary text; an empty table gives no rows. Bytes that are no valid UTF-8 do not occur in Spark's strings.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from wareloom.llm.tables import Scratch, field, whole_text

CHUNK = 1 << 15
OVERLAP = 512
MARGIN = 8
SLICE = 256  # rows whose ids or bytes are built at once
RUN = 200_000  # characters of a piece from which its pre-tokens are matched here
#: Unicode's White_Space, which is what the pattern's \s stands for; fixed values.
WHITE_SPACE = r"\t\n\x0b\f\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = frozenset("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
VOCABULARY = "byte_bpe_50k.tiktoken"


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def pre_tokens(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"(?!\S)", f"(?![^{WHITE_SPACE}])").replace(r"\s", f"[{WHITE_SPACE}]"))


_encodings: dict[str, tiktoken.Encoding] = {}


def encoding_of(shared) -> tiktoken.Encoding:
    """One per worker process and broadcast vocabulary."""
    vocabulary = shared.value
    if vocabulary.id not in _encodings:
        _encodings[vocabulary.id] = encoding(vocabulary.ranks)
    return _encodings[vocabulary.id]


class Vocabulary:
    """Ranks under a name of their own, so that workers build their tables once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.id = uuid.uuid4().hex


def encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, table: tiktoken.Encoding) -> np.ndarray:
    if len(text) > RUN:  # the library's own matching has a limit on what one match may try
        return np.fromiter((i for piece in pre_tokens().findall(text) for i in table._encode_single_piece(piece)), np.int32)
    return table.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


def boundaries(text: str, start: int, last: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk at which the text can be cut, in characters of the whole text."""
    found = [m.end() for m in pre_tokens().finditer(text)]
    limit = len(text) if last else len(text) - MARGIN
    return [start + e for e in found if e <= limit and text[e - 1] not in BLANK]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that only few rows' ids and bytes are in memory beside the batch that came in."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def id_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def encoded(rows: DataFrame, shared) -> DataFrame:
    """rows(key, text) -> (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoding_of(shared)
        for part in sliced(batches):
            ids = id_lists([encode_text(text.as_py(), table) for text in part.column("text")])
            yield pa.RecordBatch.from_arrays([part.column("key"), ids], ["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text").mapInArrow(run, f"key {kind}, ids array<int>")


def cuts(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunks(row, start, last, text) -> (row, at): where the pieces of each text begin, 0 included."""

    def zones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [boundaries(t, s, last) for t, s, last in zip(pdf["text"], pdf["start"], pdf["last"])]
            head = [[e for e in found if e < s + OVERLAP] for found, s in zip(ends, pdf["start"])]
            tail = [[e for e in found if e >= s + chunk] for found, s in zip(ends, pdf["start"])]
            yield pd.DataFrame({"row": pdf["row"], "start": pdf["start"], "head": head, "tail": tail})

    found = chunks.mapInPandas(zones, "row bigint, start bigint, head array<bigint>, tail array<bigint>")
    before = F.lag("tail").over(Window.partitionBy("row").orderBy("start"))
    at = F.when(F.col("start") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", before)))
    return found.select("row", at.cast("bigint").alias("at")).filter("at is not null")


def encode(docs: DataFrame, ranks: dict[bytes, int], chunk: int = CHUNK, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids) of each row, and before ``ids`` the columns of ``docs`` that are to be carried along."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(ranks))  # the vocabulary, of fixed size
    rows = docs.select(field("doc_id").cast("bigint").alias("doc_id"), *map(field, carried), whole_text().alias("text"))
    key = F.struct("doc_id", *map(field, carried)) if carried else F.col("doc_id")
    short = encoded(rows.filter(F.length("text") <= chunk).select(key.alias("key"), "text"), shared)
    scratch = Scratch(spark, "bpe")
    long = scratch.keep(rows.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    start = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk)).cast("array<bigint>")).alias("start")
    pieces_of = long.select("row", "text", start).select(
        "row", "start", (F.col("start") + chunk + OVERLAP >= F.length("text")).alias("last"), F.expr(f"substring(text, int(start) + 1, {chunk + OVERLAP})").alias("text"))
    begins = cuts(pieces_of.repartition("row", "start"), chunk).groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    spans = F.posexplode(F.arrays_zip(F.col("ats").alias("a"), F.expr("array_append(slice(ats, 2, size(ats)), bigint(length(text)))").alias("b"))).alias("no", "z")
    pieces = long.join(begins, "row").select("row", key.alias("key"), "text", spans).select(
        F.struct("row", "key", "no").alias("key"), F.expr("substring(text, int(z.a) + 1, int(z.b - z.a))").alias("text"))
    whole = (encoded(pieces.repartition("key"), shared).groupBy(F.col("key")["row"].alias("row"), F.col("key")["key"].alias("key"))
             .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("key")["no"].alias("no"), "ids"))), lambda p: p["ids"])).alias("ids")))
    names = F.col("key.*") if carried else F.col("key").alias("doc_id")
    return short.select(names, "ids").unionByName(whole.select(names, "ids"))


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``rows`` with an array column ``ids``, and the raw bytes of the ids as ``raw``; an unknown id is an error."""
    shared = rows.sparkSession.sparkContext.broadcast([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for part in sliced(batches):
            raw = pa.array([b"".join(map(token, ids.values.to_pylist())) for ids in part.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, raw], [*part.schema.names, "raw"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("raw", BinaryType())]))
