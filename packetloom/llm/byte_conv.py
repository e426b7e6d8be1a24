"""Text quality by a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes in overlapping chunks that cover all of it. Each
byte has a learned vector; a byte whose last eight bytes stood the same way a
short distance before also gets the learned echo vector, so that filters can
see stuttering text, which no filter over bytes alone can. Learned filters run
over every place of a chunk and are max-pooled over it; mean and maximum of the
pooled values over a document's chunks make one logistic score.

Since a byte's vector times a filter's tap is one number, the network runs as
table look-ups: one row per byte value and tap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import doc_bytes, held_out

CHUNK, OVERLAP = 512, 56
STRIDE = CHUNK - OVERLAP
# An echo: as many bytes as ECHO_RUN equal those at one distance of at most ECHO_FAR.
ECHO_RUN, ECHO_FAR = 8, 40
TAPS, VECTOR, FILTERS = 6, 8, 16
PAD = 256
TOKENS = 2 * (PAD + 1)
# Labelled rows per class that a fit may take (drawn by a hash of the id), and
# chunks of one text (spread evenly over all of it) that it learns from.
FIT_ROWS, FIT_CHUNKS = 1_000, 8
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-4
KEEP = 0.3
# Chunks that go through the tables together: their responses fit a core's cache.
BLOCK = 32
PLACES = CHUNK - TAPS + 1


@dataclass
class QualityNet:
    """Byte vectors, echo vector, filter taps and biases; output weights (mean part, maximum part) and bias."""

    vectors: np.ndarray
    echo: np.ndarray
    taps: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, seed: int = 11, bias: float = 0.0) -> QualityNet:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.3, (PAD + 1, VECTOR)), rng.normal(0, 0.3, VECTOR),
            rng.normal(0, 1 / math.sqrt(TAPS * VECTOR), (TAPS, VECTOR, FILTERS)), np.zeros(FILTERS),
            rng.normal(0, 0.1, 2 * FILTERS), bias,
        )

    def tables(self) -> np.ndarray:
        """[tap, token, filter]: what a token adds to a filter's response at a tap."""
        rows = np.concatenate((self.vectors, self.vectors + self.echo))
        rows[[PAD, TOKENS - 1]] = 0
        out = np.einsum("tv,kvf->ktf", rows, self.taps)
        out[0] += self.offsets
        out[0, [PAD, TOKENS - 1]] = -1e4  # a window never starts in the padding
        return out.astype(np.float32)


def chunk_places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start in it) of every chunk; consecutive chunks overlap, the last one reaches the end; empty texts have none."""
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - OVERLAP) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    return owner, (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE


def tokens_of(chunks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Token numbers of byte chunks [chunk, place] that hold ``lengths`` bytes each."""
    flat, column = chunks.ravel(), np.tile(np.arange(CHUNK), len(chunks))
    echo = np.zeros(flat.shape, bool)
    for far in range(1, ECHO_FAR + 1):
        run = flat[far:] == flat[:-far]
        for step in (1, 2, 4):  # runs of two, four, eight
            run = run[step:] & run[:-step]
        reach = far + ECHO_RUN - 1
        run &= column[reach:] >= reach  # not across chunks
        echo[reach:] |= run
    out = chunks.astype(np.int64)
    out[np.arange(CHUNK) >= lengths[:, None]] = PAD
    return out + echo.reshape(chunks.shape) * (PAD + 1)


def responses(tables: np.ndarray, tokens: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """[chunk, place, filter] of at most ``BLOCK`` chunks, in the buffer ``out``; ``spare`` is another one."""
    out, spare = out[: len(tokens)], spare[: len(tokens)]
    for tap in range(TAPS):
        np.take(tables[tap], tokens[:, tap : tap + PLACES], axis=0, out=spare if tap else out, mode="clip")
        if tap:
            out += spare
    return out


def buffers() -> tuple[np.ndarray, np.ndarray]:
    return np.empty((BLOCK, PLACES, FILTERS), np.float32), np.empty((BLOCK, PLACES, FILTERS), np.float32)


def place_max(values: np.ndarray) -> np.ndarray:
    """Maximum over the places, by halving; overwrites ``values``."""
    n = values.shape[1]
    while n > 1:
        half = n // 2
        np.maximum(values[:, :half], values[:, n - half : n], out=values[:, :half])
        n -= half
    return values[:, 0]


def cut_chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array (padded), and text, place in the array and length of every chunk."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    owner, start = chunk_places(sizes)
    body = np.frombuffer(b"".join([*texts, b"\0" * CHUNK]), np.uint8)
    return body, owner, begins[owner] + start, np.minimum(CHUNK, sizes[owner] - start)


def pooled(tables: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """[text, 2 x filter]: mean and maximum over a text's chunks of the filters' largest responses; zeros if empty."""
    body, owner, places, lengths = cut_chunks(texts)
    tops, room = np.empty((len(owner), FILTERS), np.float32), buffers()
    for at in range(0, len(owner), BLOCK):
        part = slice(at, at + BLOCK)
        tokens = tokens_of(body[places[part, None] + np.arange(CHUNK)], lengths[part])
        tops[part] = place_max(responses(tables, tokens, *room))
    np.maximum(tops, 0, out=tops)
    out = np.zeros((len(texts), 2 * FILTERS))
    if len(owner):
        full, first = np.unique(owner, return_index=True)
        counts = np.diff(np.append(first, len(owner)))
        out[full, :FILTERS] = np.add.reduceat(tops.astype(np.float64), first) / counts[:, None]
        out[full, FILTERS:] = np.maximum.reduceat(tops, first)
    return out


def probability(net: QualityNet, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ net.weights + net.bias, -60, 60)))


class _Adam:
    def __init__(self, params: list[np.ndarray]):
        self.params, self.step = params, 0
        self.means, self.squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def move(self, slopes: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for p, g, m, s in zip(self.params, slopes, self.means, self.squares, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**self.step) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8) + DECAY * p)


def train(texts: list[list[bytes]], labels: np.ndarray, seed: int = 11) -> QualityNet:
    """Fit on texts given as lists of chunks; classes weigh alike, the same rows give the same network."""
    net, rng = QualityNet.fresh(seed), np.random.default_rng(seed + 1)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    lengths = [np.array([len(c) for c in t], np.int64) for t in texts]
    tokens = [
        tokens_of(np.frombuffer(b"".join(c.ljust(CHUNK, b"\0") for c in t), np.uint8).reshape(-1, CHUNK), n).astype(np.int16)
        for t, n in zip(texts, lengths, strict=True)
    ]
    bias = np.array([net.bias])
    adam = _Adam([net.vectors, net.echo, net.taps, net.offsets, net.weights, bias])
    order, room = np.arange(len(texts)), buffers()
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            tok = np.concatenate([tokens[i] for i in batch]).astype(np.int64)
            sizes = np.array([len(tokens[i]) for i in batch])
            first = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(batch)), sizes)
            tables = net.tables()
            where = np.concatenate([responses(tables, tok[b : b + BLOCK], *room).argmax(axis=1) for b in range(0, len(tok), BLOCK)])
            # The winning windows alone carry values and slopes on.
            windows = tok[np.arange(len(tok))[:, None, None], where[:, :, None] + np.arange(TAPS)]  # [chunk, filter, tap]
            raw = tables[np.arange(TAPS), windows, np.arange(FILTERS)[None, :, None]].sum(axis=2).astype(np.float64)
            tops = np.maximum(raw, 0)
            mean = np.add.reduceat(tops, first) / sizes[:, None]
            peak = np.maximum.reduceat(tops, first)
            features = np.hstack((mean, peak))
            z = np.clip(features @ net.weights + bias[0], -60, 60)
            slope = (1 / (1 + np.exp(-z)) - labels[batch]) * share[batch] / len(batch)
            back = slope[:, None] * net.weights
            is_peak = tops == peak[owner]
            ties = np.add.reduceat(is_peak.astype(np.float64), first)
            down = back[owner, :FILTERS] / sizes[owner, None] + back[owner, FILTERS:] * is_peak / ties[owner]
            down *= raw > 0
            by_token = np.stack([
                np.bincount((windows[:, :, k] * FILTERS + np.arange(FILTERS)).ravel(), down.ravel(), TOKENS * FILTERS)
                for k in range(TAPS)
            ]).reshape(TAPS, TOKENS, FILTERS)
            by_token[:, [PAD, TOKENS - 1]] = 0
            plain, echoed = by_token[:, : PAD + 1], by_token[:, PAD + 1 :]
            adam.move([
                np.einsum("ktf,kvf->tv", plain + echoed, net.taps),
                np.einsum("ktf,kvf->v", echoed, net.taps),
                np.einsum("tv,ktf->kvf", net.vectors, plain) + np.einsum("tv,ktf->kvf", net.vectors + net.echo, echoed),
                down.sum(axis=0), features.T @ slope, np.array([slope.sum()]),
            ], rate)
    net.bias = float(bias[0])
    if not all(np.isfinite(p).all() for p in adam.params):
        raise ValueError("the network's weights did not converge")
    return net


def _fit_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(quality, chunks) of at most about ``FIT_ROWS`` documents per class that are not held out; class sizes."""
    ids = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    sizes = {r.quality: r.n for r in ids.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw, bound = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.lit(0)
    for value, n in sizes.items():
        bound = F.when(F.col("quality") == value, F.lit(int(min(1.0, FIT_ROWS / n) * (1 << 20)))).otherwise(bound)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                _, starts = chunk_places(np.array([len(text)]))
                if len(starts) > FIT_CHUNKS:
                    starts = starts[np.linspace(0, len(starts) - 1, FIT_CHUNKS).round().astype(int)]
                found.append([text[s : s + CHUNK] for s in starts.tolist()])
            columns = [batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "chunks"])

    # At most about 2 x FIT_ROWS ids: a proven bound for the broadcast; one text for each, however often its id stands there.
    rows = doc_bytes(docs).join(F.broadcast(ids.filter(draw < bound)), "doc_id")
    rows = rows.mapInArrow(spread, "doc_id bigint, quality int, chunks array<binary>")
    return rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("chunks").alias("chunks")), sizes


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityNet:
    """Learn from ``labels`` (doc_id, quality 0/1) that are not held out.

    At most about 2 x ``FIT_ROWS`` rows come to the driver, with at most
    ``FIT_CHUNKS`` chunks each. Equal texts count once. The bias then follows
    the classes' true shares. Without rows of both classes every text gets the
    same score (0.5 without any labels). Null and empty texts teach nothing.
    """
    found, sizes = _fit_rows(docs, labels)
    rows = {}
    for r in sorted(found.collect(), key=lambda r: r.doc_id):
        chunks = tuple(bytes(c) for c in r.chunks)
        if chunks:
            rows.setdefault(chunks, r.quality)
    odds = math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))
    if len(set(rows.values())) < 2:
        net = QualityNet.fresh(bias=odds)
        net.weights[:] = 0
        return net
    net = train([list(t) for t in rows], np.array(list(rows.values()), float))
    net.bias += odds
    return net


def quality_scores(docs: DataFrame, net: QualityNet, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text), in one pass over whole texts.

    Null and empty texts have no chunks and get the score of the bias. A null
    doc_id is not held out. Rows repeated under one doc_id each give a row, an
    empty table gives none, other columns are ignored.
    """
    tables = net.tables()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = probability(net, pooled(tables, texts)) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return doc_bytes(docs).mapInArrow(read, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= keep).cast("int").alias("predicted"),
    )
