"""Document quality by a byte-level convolutional network, written in numpy.

A filter looks at ``WIDTH`` neighbouring bytes. The text's UTF-8 bytes are cut into cells of ``CELL`` bytes; a chunk is two neighbouring
cells, so chunks overlap by half and together cover the whole document. Each filter's responses are max-pooled within a chunk, a
small hidden layer turns the pooled values into the chunk's logit, and the mean logit of the chunks gives the document's probability.

Training takes at most ``SAMPLE`` labelled documents per class (the documented bound of the fit) and all their chunks: each epoch sees a share of
a document's chunks, ``TRAIN_CHUNKS`` at least, and all epochs together every one; scoring reads every byte of every document. Only the text is an input of a score.

Defined results: a null text counts as empty; an empty text is one chunk of padding and gets that chunk's score; rows are scored one by
one, so repeated rows get equal scores; an empty table gives no rows. Labels that are null are left out of the fit. Without labelled documents of
both classes, as with an empty table, every text gets 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wareloom.llm.tables import field, whole_text

WIDTH = 6
FILTERS = 24
HIDDEN = 16
CELL = 128
BLOCK_CELLS = 1024  # cells whose responses are in memory at once
SAMPLE = 1000
TRAIN_CHUNKS = 6
EPOCHS = 18
THRESHOLD = 0.3


class ByteConvNet:
    """table[w, b]: what byte b at offset w adds to each filter's response; byte 256 is padding and adds nothing."""

    def __init__(self, table, bias, hidden, hidden_bias, out, out_bias):
        self.table, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias = table, bias, hidden, hidden_bias, out, out_bias

    @classmethod
    def initial(cls, seed: int = 7) -> "ByteConvNet":
        r = np.random.default_rng(seed)
        table = (r.normal(0, 0.3, (WIDTH, 257, FILTERS))).astype(np.float32)
        table[:, 256] = 0
        f32 = np.float32
        return cls(table, np.zeros(FILTERS, f32), r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32),
                   r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f32), np.zeros(1, f32))

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Filter responses at each position but the last WIDTH - 1, which only complete the windows before them."""
        n = len(codes) - WIDTH + 1
        total = self.table[0].take(codes[:n], axis=0)
        for w in range(1, WIDTH):
            total += self.table[w].take(codes[w : w + n], axis=0)
        return total

    def cell_maxima(self, codes: np.ndarray, cells: int) -> np.ndarray:
        """codes: cells * CELL byte codes and WIDTH - 1 more."""
        out = np.empty((cells, FILTERS), np.float32)
        for at in range(0, cells, BLOCK_CELLS):
            k = min(BLOCK_CELLS, cells - at)
            part = self.responses(codes[at * CELL : (at + k) * CELL + WIDTH - 1])
            out[at : at + k] = part.reshape(k, CELL, FILTERS).max(axis=1)
        return out

    def chunk_logits(self, pooled: np.ndarray) -> np.ndarray:
        features = np.tanh(pooled + self.bias)
        return np.maximum(features @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias[0]

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        """One probability per text. Texts are taken in groups of at most BLOCK_CELLS cells, or one long text."""
        means, group, sizes = [], [], []
        for text in texts:
            raw = text.encode()
            cells = max(1, -(-len(raw) // CELL))
            if group and sum(sizes) + cells > BLOCK_CELLS:
                means.append(self._mean_logits(group, np.array(sizes)))
                group, sizes = [], []
            group.append(raw)
            sizes.append(cells)
        if group:
            means.append(self._mean_logits(group, np.array(sizes)))
        return 1 / (1 + np.exp(-np.clip(np.concatenate([*means, np.empty(0)]), -60, 60)))

    def _mean_logits(self, texts: list[bytes], cells: np.ndarray) -> np.ndarray:
        """Each text is padded to whole cells plus WIDTH - 1 codes, so no window spans two texts."""
        maxima = np.concatenate([self.cell_maxima(padded(t, k), k) for t, k in zip(texts, cells)])
        first = np.concatenate([[0], np.cumsum(cells)[:-1]])
        # A chunk is a cell and its successor; a text of one cell is one chunk.
        chunks = np.maximum(maxima, np.concatenate([maxima[1:], maxima[-1:]]))
        lasts = first + cells - 1
        chunks[lasts] = maxima[lasts]
        logits = self.chunk_logits(chunks)
        weight = np.ones(len(logits))
        weight[lasts[cells > 1]] = 0  # the last cell is in the chunk that began one cell earlier
        return np.add.reduceat(logits * weight, first) / np.add.reduceat(weight, first)


def padded(text: bytes, cells: int) -> np.ndarray:
    codes = np.full(cells * CELL + WIDTH - 1, 256, np.int16)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    return codes


class Lesson:
    """The chunks of one document, dealt out over the epochs: at least TRAIN_CHUNKS in each, and every chunk in some epoch."""

    def __init__(self, text: bytes, rng: np.random.Generator):
        cells = max(1, -(-len(text) // CELL))
        self.codes = np.concatenate([padded(text, cells), np.full(CELL, 256, np.int16)])
        self.order = rng.permutation(max(1, cells - 1))

    def chunks(self, epoch: int) -> np.ndarray:
        """Rows of byte codes."""
        n = len(self.order)
        size = min(n, max(TRAIN_CHUNKS, -(-n // EPOCHS)))
        starts = self.order[(np.arange(size) + epoch * size) % n]
        return np.stack([self.codes[s * CELL : s * CELL + 2 * CELL + WIDTH - 1] for s in starts])


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> ByteConvNet:
    """Mini-batch Adam on the mean chunk logit of each document; a pooled value passes its gradient to the window that won.

    Without labelled documents of both classes nothing can be learned: the network then gives every text 0.5.
    """
    if len(set(labels)) < 2:
        blank = ByteConvNet.initial(seed)
        blank.out[:] = 0
        return blank
    rng = np.random.default_rng(seed)
    net = ByteConvNet.initial(seed)
    short = [t[a : a + n] for t, y in zip(texts, labels) if y == 1
             for a, n in [(rng.integers(0, max(1, len(t) - 8)), rng.integers(4, 60))]]  # very short good texts are rare in a sample
    lessons = [Lesson(t, rng) for t in [*texts, *short]]
    truth = np.array([*labels, *[1] * len(short)], np.float32)
    names = ("table", "bias", "hidden", "hidden_bias", "out", "out_bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        order = rng.permutation(len(lessons))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            step += 1
            for name, g in gradients(net, [lessons[i].chunks(epoch) for i in batch], truth[batch]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                update = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
                getattr(net, name)[...] -= update
            net.table[:, 256] = 0
    return net


def gradients(net: ByteConvNet, docs: list[np.ndarray], truth: np.ndarray) -> dict[str, np.ndarray]:
    codes = np.concatenate(docs)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    span = codes.shape[1] - WIDTH + 1
    total = net.table[0].take(codes[:, :span], axis=0)
    for w in range(1, WIDTH):
        total += net.table[w].take(codes[:, w : w + span], axis=0)
    won = total.argmax(axis=1)
    pooled = np.take_along_axis(total, won[:, None, :], axis=1)[:, 0]
    features = np.tanh(pooled + net.bias)
    inner = features @ net.hidden + net.hidden_bias
    act = np.maximum(inner, 0)
    logit = act @ net.out + net.out_bias[0]
    share = 1 / np.array([len(d) for d in docs], np.float32)
    mean = np.bincount(owner, logit, len(docs)) * share
    error = (1 / (1 + np.exp(-np.clip(mean, -60, 60))) - truth) / len(docs)
    d_logit = (error * share)[owner].astype(np.float32)
    d_inner = np.outer(d_logit, net.out) * (inner > 0)
    d_pooled = (d_inner @ net.hidden.T) * (1 - features**2)
    d_table = np.zeros_like(net.table)
    rows, filters = np.arange(len(codes))[:, None], np.arange(FILTERS)[None, :]
    for w in range(WIDTH):
        np.add.at(d_table[w], (codes[rows, won + w], np.broadcast_to(filters, won.shape)), d_pooled)
    decay = 1e-4
    return {"table": d_table + decay * net.table, "bias": d_pooled.sum(0), "hidden": features.T @ d_inner + decay * net.hidden,
            "hidden_bias": d_inner.sum(0), "out": act.T @ d_logit + decay * net.out, "out_bias": np.array([d_logit.sum()], np.float32)}


def is_held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> ByteConvNet:
    """Train on at most ``sample`` documents per class that are not held out, chosen by a hash of their id."""
    known = (labels.select(field("doc_id").alias("doc_id"), field(label).cast("int").alias("y"))
             .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))))
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    chosen = known.filter("y = 0").orderBy(*order).limit(sample).unionByName(known.filter("y = 1").orderBy(*order).limit(sample))
    texts = docs.select(field("doc_id").alias("doc_id"), whole_text().alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(*order, "y", "text").limit(2 * sample).collect()  # bounded by the parameter
    return train([r.text.encode() for r in rows], [r.y for r in rows])


def score(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size, whatever the corpus

    def probabilities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": shared.value.scores(pdf["text"])})

    narrow = docs.select(field("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return narrow.mapInPandas(probabilities, "doc_id bigint, score double")


def scored(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """The rows as struct ``doc``, each with its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(DoubleType())
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    return docs.select(F.struct("*").alias("doc"), probability(whole_text()).alias("score"))
