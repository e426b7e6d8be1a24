"""Quality network, Merkle manifest and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm import byte_conv, common, merkle, queries, resample

CHECK = "/root/testdata/sf0.1"


def made(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# Numbering


def test_numbers_follow_keys_and_order_whatever_the_ties(llm_spark):
    rows = [(k, v) for k in (None, "", "a", "b") for v in (3, 1, None, 2, 2, 2)] + [("hot", 7)] * 3000
    found = common.numbered(made(llm_spark, rows, "k string, v int"), ["k"], [F.col("v")]).collect()
    assert len(found) == len(rows)
    for key in (None, "", "a", "b", "hot"):
        mine = sorted((r for r in found if r.k == key), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine))) and {r.size for r in mine} == {len(mine)}
        values = [(r.v is not None, r.v or 0) for r in mine]
        assert values == sorted(values)


# Manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    fields = row["doc_id"], row["source"], row["lang"], n_chars, row["text"]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        run = i // 2 * 2
        steps.append((i % 2, "".join(level[j] for j in range(run, min(run + 2, len(level))) if j != i)))
        i //= 2
    return steps


def plain_manifest(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for k in order:
        langs[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"])))
    trees = [tree([leaf(r, r["n_chars"]) for r in langs[k]]) for k in order]
    top = tree([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for j, k in enumerate(order):
        for i, r in enumerate(langs[k]):
            steps = path(trees[j], i) + path(top, j)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            at = leaf(r, r["n_chars"] + hit if hit else r["n_chars"])
            for slot, sibling in steps:
                at = sha(sibling, at) if slot else sha(at, sibling)
            proof = sha(*(s for _, s in steps))
            out.append((r["doc_id"], trees[j][0][i], trees[j][-1][0], root, proof, at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_manifest_equals_brute_force(llm_spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i * 3, f"text {i}", lang, f"s{i % 3}", i) for lang, n in (("a", 1), ("b", 37), ("é", 64), ("zz", 9)) for i in range(n)]
    docs = made(llm_spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(map(tuple, merkle.verify_manifest(docs).collect()), key=str) == plain_manifest(docs.collect())


def test_manifest_of_odd_rows(llm_spark, odd_docs, no_docs):
    # Nulls in every field, repeated rows, a null language beside an empty one, one single row.
    docs = odd_docs.withColumn("n_chars", F.expr("if(doc_id = 2, null, length(text))")).withColumn("pos", F.lit(1)).withColumn(
        "lang", F.when(F.col("doc_id") == 1, "").otherwise(F.col("lang"))
    )
    assert sorted(map(tuple, merkle.verify_manifest(docs).collect()), key=str) == plain_manifest(docs.collect())
    one = docs.filter("doc_id = 3")
    assert sorted(map(tuple, merkle.verify_manifest(one).collect()), key=str) == plain_manifest(one.collect())
    assert merkle.verify_manifest(docs.limit(0)).count() == 0


def test_changed_rows_fail_and_others_verify(llm_spark, sf_dir, tables):
    found = queries.op12_merkle(llm_spark, sf_dir).collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in found)
    assert {len(r.root) for r in found} == {64} and len({r.root for r in found}) == 1
    assert sorted(map(tuple, found), key=str) == plain_manifest(tables("documents").collect())


# Resampling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, grams, buckets):
    words = WORD.findall((text or "").translate(LOW))
    runs = (" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1))
    return words, [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_sample(rows, target, grams=1, buckets=10_000, least=20, percent=10, seed=2024):
    docs = [(i, *plain_features(t, grams, buckets)) for i, t in rows]
    s = Counter(b for _, _, f in docs for b in f)
    t = Counter(b for x in target for b in plain_features(x, grams, buckets)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, words, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    fit = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is not None, o[0] or 0))
    for k, o in enumerate(fit[: percent * len(fit) // 100]):
        o[4] = k + 1
    return sorted((tuple(o[:5]) for o in out), key=str)


def drawn(docs, target, **how):
    return sorted(map(tuple, resample.resample(docs, target, **how).collect()), key=str)


@pytest.mark.parametrize("grams", [1, 2, 4])
def test_resampling_equals_brute_force(llm_spark, tables, grams):
    docs, target = tables("documents"), tables("benchmark")
    rows, goal = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    assert drawn(docs, target, grams=grams) == plain_sample(rows, goal, grams)
    assert drawn(docs, target, grams=grams, buckets=97, percent=35, seed=5) == plain_sample(rows, goal, grams, 97, percent=35, seed=5)


def test_resampling_of_odd_rows(llm_spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    target = llm_spark.createDataFrame([(None,), ("",), ("Some WORDS of a very long text",)], "text string")
    how = {"least": 3, "percent": 60}
    found = drawn(odd_docs, target, grams=3, least_words=3, percent=60)
    assert found == plain_sample(rows, [None, "", "Some WORDS of a very long text"], 3, **how)
    assert drawn(odd_docs, target.limit(0)) == plain_sample(rows, [])
    assert resample.resample(no_docs, target).count() == 0


def test_features_of_a_batch_depend_on_each_text_alone():
    texts = ["", "a B  a", "...", "9Ü a", "a"]
    for grams in (1, 2, 3, 9):
        found, sizes, words = resample.feature_buckets(pa.array(texts), grams, 1000)
        ends = np.cumsum(sizes)
        for i, text in enumerate(texts):
            want = plain_features(text, grams, 1000)
            assert sorted(found[ends[i] - sizes[i] : ends[i]].tolist()) == sorted(want[1]) and words[i] == len(want[0])


# Quality network


def test_quality_on_held_out_rows(llm_spark):
    docs, labels = (llm_spark.read.parquet(f"{CHECK}/{n}.parquet") for n in ("documents", "labels"))
    scored = byte_conv.quality_scores(docs, byte_conv.fit_quality(docs, labels)).toPandas()
    assert len(scored) == docs.count() and scored.score.between(0, 1).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    test = scored[scored.held_out].merge(labels.toPandas(), on="doc_id")
    assert (test.predicted == test.quality).mean() > 0.98
    good = test[test.quality == 1]
    assert (good.predicted == 1).mean() > 0.99


def test_pooling_equals_a_plain_convolution():
    net = byte_conv.QualityNet.fresh(3)
    tables, rng = net.tables(), np.random.default_rng(4)
    stutter = b"again " * 60 + b"end"
    texts = [b"", b"x", stutter, rng.integers(0, 256, 3000).astype(np.uint8).tobytes(), "é😀".encode() * 200]
    found = byte_conv.pooled(tables, texts)
    rows = np.concatenate((net.vectors, net.vectors + net.echo))
    for text, got in zip(texts, found, strict=True):
        tops = []
        _, starts = byte_conv.chunk_places(np.array([len(text)]))
        assert not len(text) or (starts[0] == 0 and starts[-1] + byte_conv.CHUNK >= len(text))
        assert (np.diff(starts) == byte_conv.STRIDE).all()
        for s in starts.tolist():
            chunk = text[s : s + byte_conv.CHUNK]
            vectors = np.zeros((byte_conv.CHUNK, byte_conv.VECTOR))
            for p in range(len(chunk)):
                echo = any(
                    p - far - 7 >= 0 and chunk[p - 7 : p + 1] == chunk[p - far - 7 : p - far + 1] for far in range(1, byte_conv.ECHO_FAR + 1)
                )
                vectors[p] = rows[chunk[p] + echo * (byte_conv.PAD + 1)]
            at = range(min(len(chunk), byte_conv.PLACES))
            out = [np.einsum("kv,kvf->f", vectors[p : p + byte_conv.TAPS], net.taps) + net.offsets for p in at]
            tops.append(np.maximum(np.max(out, axis=0), 0))
        want = np.concatenate((np.mean(tops, axis=0), np.max(tops, axis=0))) if tops else np.zeros(2 * byte_conv.FILTERS)
        assert np.allclose(got, want, atol=1e-4)


def test_slopes_of_the_network_lower_the_loss():
    rng = np.random.default_rng(1)
    bad = [[b"## " * 40 + bytes(rng.integers(97, 122, 60).astype(np.uint8))] for _ in range(40)]
    good = [[bytes(rng.integers(97, 122, 200).astype(np.uint8))] for _ in range(40)]
    net = byte_conv.train(bad + good, np.array([0.0] * 40 + [1.0] * 40))
    scores = byte_conv.probability(net, byte_conv.pooled(net.tables(), [c[0] for c in bad + good]))
    assert scores[:40].max() < 0.3 and scores[40:].min() > 0.7  # after 36 small steps
    again = byte_conv.train(bad + good, np.array([0.0] * 40 + [1.0] * 40))
    assert np.array_equal(again.taps, net.taps) and again.bias == net.bias


def test_quality_of_odd_rows(llm_spark, tables, odd_docs, no_docs):
    none = byte_conv.fit_quality(odd_docs, tables("labels").limit(0))
    found = byte_conv.quality_scores(odd_docs, none).collect()
    assert len(found) == odd_docs.count() and {r.score for r in found} == {0.5}
    labels = llm_spark.createDataFrame([(i, i % 2) for i in range(99)] + [(None, 1), (4, None), (4, 7)], "doc_id bigint, quality int")
    net = byte_conv.fit_quality(odd_docs, labels)
    found = byte_conv.quality_scores(odd_docs, net).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    by_text = {}
    for r in byte_conv.quality_scores(odd_docs.fillna(""), net).collect():
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_text[4]) == 1 and by_text[0] == by_text[1]  # null and empty alike
    assert byte_conv.quality_scores(no_docs, net).count() == 0
    assert byte_conv.fit_quality(no_docs, labels).weights.any() == np.False_
