"""Importance resampling towards a target distribution of hashed n-grams.

Texts are cut by Arrow kernels: lower-cased, split, flattened and dictionary-
encoded, so that a batch hashes each different word once; shifted dictionary
indices form longer n-grams, of which each different pair (or longer run) is
hashed once. Bucket counts of corpus and target give every bucket's gain, the
gains of a document's features are taken and reduced by its segment of the
batch, and a Gumbel draw without replacement keeps the highest scores.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import doc_text, numbered, pinned

GRAMS, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
# Everything ASCII but digits and lower-case letters parts words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _crcs(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, values), np.int64, len(values))


def _bytes(strings: pa.StringArray) -> list[bytes]:
    """The UTF-8 bytes of strings without nulls, cut from their Arrow buffers."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset :][: len(strings) + 1].tolist() if len(strings) else [0]
    body = data.to_pybytes() if data is not None else b""
    return [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def feature_buckets(texts: pa.Array, grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, features per text, words per text); features of one text stand together."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=GAPS)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # A text that begins or ends with a gap has an empty string there, an empty text one alone.
    real = pc.greater(pc.binary_length(flat), 0)
    words = flat.filter(real).dictionary_encode()
    owner = np.asarray(parents.filter(real)).astype(np.int64)
    names, index = _bytes(words.dictionary), np.asarray(words.indices).astype(np.int64)
    n_words = np.bincount(owner, minlength=len(texts))
    found, owners = [_crcs(names)[index] % buckets], [owner]
    runs, runs_of = index, names
    for n in range(2, grams + 1):
        # A run of n words is one of n - 1 words and the word after it, in the same text.
        inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
        pairs = runs[: len(runs) - 1] * len(names) + index[n - 1 :]
        kinds, number = np.unique(pairs[inside], return_inverse=True)
        runs_of = [runs_of[k // len(names)] + b" " + names[k % len(names)] for k in kinds.tolist()]
        found.append(_crcs(runs_of)[number] % buckets)
        owners.append(owner[: len(owner) - n + 1][inside])
        # Runs that would cross texts keep a place, so that shifts stay aligned; any number will do there.
        runs = np.zeros(len(inside), np.int64)
        runs[inside] = number
        if not len(kinds):
            break
    every, order = np.concatenate(found), np.concatenate(owners)
    if grams > 1:
        by_text = np.argsort(order, kind="stable")
        every, order = every[by_text], order[by_text]
    return every, np.bincount(order, minlength=len(texts)), n_words


def bucket_counts(rows: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows (text); a task sends one row per bucket that it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found, _, _ = feature_buckets(batch.column("text"), grams, buckets)
            total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    per_bucket = rows.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in per_bucket.collect():  # at most one row per bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the thousandfold log ratio of its smoothed shares in target and corpus, rounded down."""
    s, t = corpus.tolist(), target.tolist()
    n, s_all, t_all = len(s), float(sum(s)), float(sum(t))
    ratios = [((b + 1.0) * (s_all + n)) / ((a + 1.0) * (t_all + n)) for a, b in zip(s, t, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """The thousandfold Gumbel noise of a document, rounded down."""
    key = f"{seed}:{'null' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score per row of ``docs``, in one pass over whole texts."""
    names = ["doc_id", "n_features", "n_words", "weight", "score"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, n_words = feature_buckets(batch.column("text"), grams, len(gains))
            some = np.flatnonzero(sizes)
            weight = np.zeros(len(sizes), np.int64)
            if len(some):
                sums = np.add.reduceat(gains[found], (np.cumsum(sizes) - sizes)[some])
                weight[some] = sums // sizes[some]
            noise = np.array([gumbel(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            columns = [pa.array(x, pa.int64()) for x in (sizes, n_words, weight, weight + noise)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return doc_text(docs).mapInArrow(read, ", ".join(f"{c} bigint" for c in names))


def resample(
    docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank per row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Features are all runs of one to ``grams`` words. Of the N documents with at
    least ``least_words`` words the floor(``percent`` * N / 100) highest scores are drawn
    and ranked from 1, ties by doc_id (null first; rows alike in both are
    interchangeable); the others have no rank. Null and empty texts have no
    features, weight 0 and no rank. A null doc_id draws its noise as `null`.
    Repeated rows are documents of their own; empty tables count nothing; other
    columns are ignored.
    """
    rows = doc_text(docs)
    gains = bucket_gains(bucket_counts(rows, grams, buckets), bucket_counts(target.select(F.coalesce("text", F.lit("")).alias("text")), grams, buckets))
    # Five numbers a row; read by the ranking and by the rest.
    weighed = pinned(weigh(docs, gains, grams, seed))
    fit = F.col("n_words") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(weighed.filter(fit).select(*columns), [], [-F.col("score"), F.col("doc_id")])
    drawn = F.col("pos") < F.floor(F.col("size") * percent / 100)
    ranked = ranked.select(*columns, F.when(drawn, F.col("pos") + 1).alias("rank"))
    return ranked.unionByName(weighed.filter(~fit).select(*columns, F.lit(None).cast("bigint").alias("rank")))
