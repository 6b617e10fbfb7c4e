import random
from collections import Counter

import public_tokenizers
import tiktoken

from wareloom.llm import byte_bpe

RANKS = byte_bpe.read_ranks()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "B", "é", "1", "٣", " ", "  ", "\n", "\t", "'s", "'ll", "'", "!", "\x1c", "\x85", "\xa0", " ", "漢", "😀", "<|endoftext|>", "\x00", "²"]


def coded(spark, docs, chunk):
    ids = byte_bpe.encode(docs, RANKS, chunk)
    return byte_bpe.decode(ids, RANKS).collect()


def test_chunked_encoding_equals_the_library_and_round_trips(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6000))) for _ in range(30)]
    texts += ["é" * 5000, " " * 5000, "word " * 3000, "x" * 1999 + "'ll", "\n" * 2000 + "a" + " " * 3000 + "b", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (1000, byte_bpe.CHUNK):
        rows = coded(spark, docs, chunk)
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r.doc_id] or ""
            assert list(r.ids) == LIBRARY.encode_ordinary(text)
            assert bytes(r.raw) == text.encode()


def test_own_pre_tokens_equal_the_library(monkeypatch):
    monkeypatch.setattr(byte_bpe, "RUN", 0)
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20)))
        assert byte_bpe.encode_text(text, LIBRARY).tolist() == LIBRARY.encode_ordinary(text)


def test_one_result_per_row(spark, odd_docs, odd_rows, no_docs):
    rows = coded(spark, odd_docs, 2000)
    assert Counter((r.doc_id, bytes(r.raw)) for r in rows) == Counter((r[0], (r[1] or "").encode()) for r in odd_rows)
    assert coded(spark, no_docs, 2000) == []
