"""SimHash near-duplicates through a forest of vantage-point trees.

Only distinct fingerprints are compared. The 64 bits fall into three bands; a
pair within four bits differs by at most one bit in some band.
One tree per band partitions the fingerprints by the Hamming distance to vantage points
inside the band. A fingerprint lives in one leaf; as a query it also visits
every leaf that the triangle inequality cannot rule out at radius one, so the
pairs across a boundary are found in the neighbour shard. Shards go on
splitting inside their task and check the full 64 bits at the bottom.

No radius of a SimHash finds all texts of a similarity, so near duplicates get
more links beside the forest's: a prefix filter over shingles, rare ones first,
and the exact similarity of each pair that it leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import doc_bytes, pinned, rows_by_place
from packetloom.llm.components import connected_components

SHINGLE, SEED, MAX_DISTANCE = 4, 42, 4
# Bands of the forest for fingerprints of links within MAX_DISTANCE.
BANDS = 3
# Near duplicates by similarity of word shingles.
SIMILARITY, SIMILAR_SHINGLE = 0.8, 5
# Texts under one shingle that meet another such block at a time.
BLOCK_TEXTS = 1024
# Shingles that a candidate pair must share within its prefixes, where they are long enough for so many.
MEETINGS = 3
# Texts of the sample that tells frequent shingles, the least count there, and the shingles kept (all bounded).
RARITY_TEXTS, OFTEN, OFTEN_SHINGLES = 4096, 3, 100_000
# Distinct fingerprints that a tree is fitted on (bounded; every one is indexed).
FIT_ROWS = 8192
SHARD_ROWS = 16_384
LEAF_ROWS, MAX_LEVELS = 256, 24
# Comparisons of one task at most, before the shard's queries are sliced.
SLICE_PAIRS = 1 << 30
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, ASCII letters in lower case, a bounded number at a time."""
    tokens = text.lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    n = max(1, len(tokens) - words + 1)
    begins, ends = starts[:n], stops[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        spans = zip(begins[at : at + HASHES_AT_ONCE].tolist(), ends[at : at + HASHES_AT_ONCE].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, words)]))


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; no words: 0."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, row (tells repeated rows apart) and fp (the 64 bits as a signed number) of each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"]
            )

    rows = doc_bytes(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(read, "doc_id bigint, row bigint, fp bigint")


class VantageTree:
    """Top levels of one band's tree: at each node a vantage point and the radius of its ball."""

    def __init__(self, sample: np.ndarray, band: tuple[int, int], depth: int, reach: int):
        low, width = band
        self.mask = np.uint64(((1 << width) - 1) << low)
        self.depth, self.reach = depth, reach
        self.points = np.zeros(1 << depth, np.uint64)
        self.radii = np.full(1 << depth, -1, np.int64)
        rng = np.random.default_rng(low + 1)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            mine = parts.pop(node)
            if not len(mine):
                mine = sample
            self.points[node] = mine[rng.integers(len(mine))]
            far = self.distance(mine, self.points[node])
            self.radii[node] = int(np.median(far))
            inside = far <= self.radii[node]
            parts[2 * node], parts[2 * node + 1] = mine[inside], mine[~inside]

    def distance(self, fps: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.bitwise_count((fps ^ point) & self.mask).astype(np.int64)

    def shards(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold a point within ``reach``; 0 gives the home leaf."""
        row, node = np.arange(len(fps)), np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            far = self.distance(fps[row], self.points[node])
            near_in, near_out = far - reach <= self.radii[node], far + reach > self.radii[node]
            row = np.concatenate((row[near_in], row[near_out]))
            node = np.concatenate((2 * node[near_in], 2 * node[near_out] + 1))
        return row, node


def _joining_links(index: np.ndarray, query: np.ndarray, mask: np.uint64, reach: int, within: int) -> list[tuple[int, int]]:
    """Links (query, index) of a shard that join groups which were apart, from a vantage-point search.

    Every query meets all index entries that the bounds cannot rule out, so
    the links span all pairs within the distance.
    """
    every = np.unique(np.concatenate((index, query)))
    group = np.arange(len(every))
    links: list[tuple[int, int]] = []
    stack = [(np.searchsorted(every, np.sort(index)), np.searchsorted(every, np.sort(query)), 0)]
    while stack:
        idx, qry, level = stack.pop()
        if not len(idx) or not len(qry):
            continue
        if len(idx) > LEAF_ROWS and len(qry) > 8 and level < MAX_LEVELS:
            point = every[idx[len(idx) // 2]]
            far_i = np.bitwise_count((every[idx] ^ point) & mask).astype(np.int64)
            radius = int(np.median(far_i))
            inside = far_i <= radius
            if not inside.all():
                far_q = np.bitwise_count((every[qry] ^ point) & mask).astype(np.int64)
                stack.append((idx[inside], qry[far_q - reach <= radius], level + 1))
                stack.append((idx[~inside], qry[far_q + reach > radius], level + 1))
                continue
        step = max(1, (1 << 20) // len(idx))
        prints = every[idx][None, :]
        for at in range(0, len(qry), step):
            block = every[qry[at : at + step]][:, None]
            # Each pair once: the index side is the smaller fingerprint.
            near = (np.bitwise_count(block ^ prints) <= within) & (prints < block)
            for q in np.flatnonzero(near.any(axis=1)).tolist():
                me = qry[at + q]
                found = idx[near[q]]
                apart, first = np.unique(group[found], return_index=True)
                for label, k in zip(apart.tolist(), first.tolist(), strict=True):
                    if label != group[me]:
                        group[group == label] = group[me]
                        links.append((int(every[me]), int(every[found[k]])))
    return links


def near_links(fps: DataFrame, within: int = MAX_DISTANCE, bands: int = BANDS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span the graph of pairs within ``within`` bits.

    a and b are the fingerprints, or their numbers in a column id if there is one.
    Every pair within the distance is compared; a shard reports only links that
    join groups it had not joined yet, so a dense group gives as many links as
    members, not pairs.
    """
    total = fps.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / SHARD_ROWS)))
    edges = [64 * i // bands for i in range(bands + 1)]
    reach = within // bands
    share = min(1.0, FIT_ROWS / max(1, total))
    # A bounded sample fits the vantage points; all fingerprints are placed.
    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * FIT_ROWS)
    fit = np.sort(np.array([r.fp for r in sample.collect()] or [0], np.int64)).view(np.uint64)
    trees = [VantageTree(fit, (a, b - a), depth, reach) for a, b in pairwise(edges)]

    names = [c for c in ("fp", "id") if c in fps.columns]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            mine = pdf["fp"].to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                for side, far in ((0, 0), (1, tree.reach)):
                    row, leaf = tree.shards(mine, far)
                    carried = {c: pdf[c].to_numpy()[row] for c in names}
                    yield pd.DataFrame({"tree": np.int32(t), "shard": leaf, "side": np.int32(side), **carried})

    kinds = ", ".join(f"{c} bigint" for c in names)
    placed = fps.select(*names).mapInPandas(place, f"tree int, shard bigint, side int, {kinds}")
    sizes = placed.groupBy("tree", "shard").agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("n_index"),
        F.sum("side").alias("n_query"),
    )
    slices = sizes.select(
        "tree", "shard", F.ceil(F.col("n_index") * F.col("n_query") / F.lit(SLICE_PAIRS)).cast("int").alias("slices")
    ).filter("slices > 0")
    # A shard with too many pairs is dealt out by slices of its queries.
    spread = placed.join(slices, ["tree", "shard"]).withColumn(
        "slice",
        F.explode(
            F.when(F.col("side") == 1, F.array(F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))).otherwise(
                F.sequence(F.lit(0), F.col("slices") - 1)
            )
        ),
    )
    masks = [int(t.mask) for t in trees]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["fp"].to_numpy().view(np.uint64)
        query = pdf["side"].to_numpy() == 1
        mask = np.uint64(masks[int(pdf["tree"].iloc[0])])
        links = _joining_links(values[~query], values[query], mask, reach, within)
        both = np.array(links, np.uint64).reshape(-1, 2)
        order = np.argsort(values)
        both = pdf[names[-1]].to_numpy()[order[np.searchsorted(values, both, sorter=order)]]
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    found = spread.groupBy("tree", "shard", "slice").applyInPandas(search, "a bigint, b bigint")
    return found.distinct()


def simhash_groups(docs: DataFrame, within: int = MAX_DISTANCE, words: int = SHINGLE) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text): doc_id, fingerprint, component_id, row, component_row.

    Fingerprints link at ``within`` or fewer differing bits; component_id is the
    smallest doc_id that links reach, the document itself included. Null and
    wordless texts have fingerprint zero and link like any other. Rows repeated
    under one doc_id each give a row; an empty table gives none; a null doc_id
    never names a component that has another id; other columns are ignored.
    ``row`` is the place of the row in the scan, ``component_row`` that of the
    row which names the class.
    """
    rows = pinned(fingerprints(docs, words))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    distinct = pinned(rows.groupBy("fp").agg(F.min(order).alias("least")))
    parts = connected_components(near_links(distinct.select("fp"), within))
    named = distinct.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    classes = named.select("fp", "component").join(least, "component").select("fp", "least")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"),
        "row", F.col("least.row").alias("component_row"),
    )


def _by_rarity(found: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles in one order for all texts: rare ones first, then those in ``often`` (sorted) by their count."""
    if not len(often):
        return found
    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
    return found[np.argsort(np.where(often[at] == found, counts[at], 0), kind="stable")]


def _often(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) that stand in several texts of a bounded sample.

    They only decide the order of shingles, so that frequent ones come last;
    any order gives the same links.
    """
    total = docs.count()
    share = min(1.0, RARITY_TEXTS / max(1, total))
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) < int(share * (1 << 20))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], ["shingle"])

    sample = doc_bytes(docs).withColumn("drawn", drawn).filter("drawn").select("text")
    rows = (
        sample.mapInArrow(read, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= OFTEN).orderBy(F.col("n").desc(), "shingle").limit(OFTEN_SHINGLES).collect()
    )
    found = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r.n for r in rows], np.int64)[order]


def _prefixes(docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """doc_id, row, fp (the fingerprint), mark (names the shingle set), size and prefix (the rarest shingles) of each row.

    Two sets of this similarity share one of their prefixes' shingles: the
    other shingles are fewer than what they must have in common.
    """
    often, counts = _often(docs, words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, sizes, prefixes = batch.column("text").to_pylist(), [], [], []
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            for text in texts:
                found = shingle_set(text, words)
                marks.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                n = len(found) - math.ceil(similarity * len(found) - 1e-6) + 1 if len(found) else 0
                prefixes.append(_by_rarity(found, often, counts)[:n].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(fps), pa.array(marks, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "row", "fp", "mark", "size", "prefix"],
            )

    rows = doc_bytes(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(read, "doc_id bigint, row bigint, fp bigint, mark binary, size bigint, prefix array<bigint>")


def _similar(docs: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) of row numbers of ``docs`` with at least this Jaccard similarity, each compared exactly."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int64()))], ["row", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared > 0 and shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            kept = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("a", "b")], ["a", "b"])

    named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    rows = doc_bytes(docs).withColumn("row", F.monotonically_increasing_id()).join(named, "row").select("row", "text")
    found = pinned(rows.mapInArrow(sets, "row bigint, shingles array<bigint>"))
    both = pairs.join(found.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(
        found.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _enough(shared: str, m: str, n: str, similarity: float) -> Column:
    """Whether sets of m and n shingles with so many shared ones in their prefixes can have the similarity.

    Up to the end of the prefix that ends first all that is shared has been
    counted; after it only the rest of that set can be.
    """
    rest = F.ceil(F.greatest(m, n) * similarity - 1e-6) - 1
    alike = F.least(m, n) >= F.greatest(m, n) * similarity - 1e-6
    return alike & (F.col(shared) + rest >= (F.col(m) + F.col(n)) * (similarity / (1 + similarity)) - 1e-6)


def _candidates(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different parts that can have the similarity, for rows (shingle, at, texts, id, size, part).

    ``met`` has every prefix shingle that two parts share, ``at`` is its place in
    the prefix. All pairs of texts under a shingle meet; those with many texts are
    cut into blocks and each pair of blocks is a group of its own. Sets that
    must have s shingles in common have k of them among their first size - s + k
    ones: of the set that ends there first, s - k are left. So a pair meets
    under rare shingles only, and a group of texts under the limit makes few rows.
    """
    blocks = F.ceil(F.col("texts") / BLOCK_TEXTS).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    side = ("shingle", "at", "i", "j", "id", "size", "part")
    left = dealt.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = dealt.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block"))))
    x, y = left.select(*side).alias("x"), right.select(*side).alias("y")
    m, n = F.col("x.size"), F.col("y.size")
    common = F.ceil((m + n) * (similarity / (1 + similarity)) - 1e-6)
    # No prefix is longer than size - similarity * size + 1.
    needed = F.least(F.lit(MEETINGS), common - F.ceil(F.greatest(m, n) * similarity - 1e-6) + 1)
    pairs = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        & ((F.col("x.i") < F.col("x.j")) | (F.col("x.id") < F.col("y.id"))) & (F.col("x.part") != F.col("y.part"))
        & (F.least(m, n) >= F.greatest(m, n) * similarity - 1e-6)
        & (F.col("x.at") < m - common + needed) & (F.col("y.at") < n - common + needed),
    )
    named = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), needed.alias("needed"))
    counted = named.groupBy("a", "b", "needed").agg(F.count(F.lit(1)).alias("shared"))
    return counted.filter("shared >= needed").select("a", "b")


def _classes(docs: DataFrame, within: int | None, similarity: float, words: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(all rows with their keys, kept_row by keys of the rows that have company, the keys): see ``near_groups``.

    One pass reads the fingerprint and the shingles of each text, and all links
    are between row numbers, so one search for components follows both kinds;
    a second adds the pairs that the first has not joined.
    """
    texts = pinned(_prefixes(docs, similarity, words))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    keys = ["mark"] if within is None else ["mark", "fp"]
    # One row per different set (and fingerprint) and task before the shuffle.
    kinds = texts.groupBy(*keys).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("copies"))
    for key in keys:
        kinds = kinds.withColumn(f"first_{key}", F.min("best").over(Window.partitionBy(key))["row"])
    kinds = pinned(kinds.withColumn("id", F.col("best.row")))
    links = kinds.select(F.col("id").alias("a"), F.explode(F.array(*(f"first_{key}" for key in keys))).alias("b")).filter("a != b")
    if within is not None:
        links = links.union(near_links(kinds.filter("id = first_fp").select("fp", "id"), within))
    # Equal sets are one class from the start.
    sets = texts.groupBy("mark").agg(F.min(order)["row"].alias("id"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    shingle = Window.partitionBy("shingle")
    met = pinned(
        sets.select("id", "size", F.posexplode("prefix").alias("at", "shingle"))
        .withColumn("texts", F.count(F.lit(1)).over(shingle))
        .withColumn("least", F.min(F.struct("id", "size")).over(shingle))
        .filter("texts > 1")
    )
    # First the text before each that most of its shingles name: one comparison per text joins what is plainly one family.
    named = met.filter("least.id < id").groupBy("id", "size", "least").agg(F.count(F.lit(1)).alias("n"))
    near = named.filter(_enough("n", "size", "least.size", similarity))
    stars = near.groupBy("id").agg(F.max(F.struct("n", (-F.col("least.id")).alias("back"))).alias("most"))
    stars = pinned(stars.select(F.col("id").alias("b"), (-F.col("most.back")).alias("a")))
    parts = connected_components(links.union(_similar(docs, stars, similarity, words)))
    known = met.join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id"))
    known = known.drop("node", "component")
    apart = known.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("shingle")
    pairs = pinned(_candidates(known.join(apart, "shingle"), similarity))
    joined = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = connected_components(joined.union(_similar(docs, pairs, similarity, words)))
    placed = kinds.join(parts, F.col("id") == F.col("node"), "left").select(
        *keys, "best", "copies", F.coalesce("component", "id").alias("part")
    )
    least = placed.groupBy("part").agg(F.min("best").alias("least"), F.sum("copies").alias("copies")).filter("copies > 1")
    kept = pinned(placed.drop("copies").join(least, "part").select(*keys, F.col("least.row").alias("kept_row")))
    return texts.select("doc_id", "row", *keys), kept, keys


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_SHINGLE) -> DataFrame:
    """Near-duplicate classes by word shingles: doc_id, row, kept_row for every row that has company, kept ones included.

    Two texts are linked if their sets of ``words``-word shingles have a Jaccard
    similarity of at least ``similarity``; links are followed. Candidates are
    all texts that share a shingle of their prefixes, which no pair of that
    similarity escapes. Equal sets are one class from the start, so copies are
    never compared; each text is then compared with the first text that it
    shares most with, and only pairs which that has not joined meet each other.
    kept_row is the row with the smallest doc_id (then first row) of the class.
    Texts without words equal each other.
    """
    rows, kept, keys = _classes(docs, None, similarity, words)
    return rows.join(kept, keys).select("doc_id", "row", "kept_row")


def near_groups(
    docs: DataFrame, within: int = MAX_DISTANCE, similarity: float = SIMILARITY, words: int = SIMILAR_SHINGLE
) -> DataFrame:
    """Near-duplicate classes of ``docs`` by both kinds of links: doc_id, row, kept_row for every row.

    The vantage-point forest links fingerprints within ``within`` bits, as in
    ``simhash_groups``; the pairs of the similarity that fingerprints tell apart
    are added as in ``similar_groups``. Links of either kind are followed.
    kept_row is the row with the smallest doc_id (then first row) of the class.
    """
    rows, kept, keys = _classes(docs, within, similarity, words)
    return rows.join(kept, keys, "left").select("doc_id", "row", F.coalesce("kept_row", "row").alias("kept_row"))


def drop_near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_SHINGLE, within: int = MAX_DISTANCE
) -> DataFrame:
    """The rows of ``docs`` without those that ``near_groups`` puts behind another row; all columns kept.

    Nulls, empty texts, repeated rows and clashing columns are treated as there
    and never crash; an empty table gives no rows.
    """
    rows, kept, keys = _classes(docs, within, similarity, words)
    return rows_by_place(docs, rows.join(kept, keys).filter("row != kept_row"), "left_anti")
