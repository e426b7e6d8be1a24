"""Merkle manifest of a dataset: a binary hash tree per language, and one over the languages' roots.

Leaves stand in order of doc_id in blocks of 2^LEVELS. Inside a block all
levels are window columns over one sort: at level l a node's digest stands on
its first leaf's row, a lead and a lag by the fixed offset 2^l, masked by the
node's slot and the length of its run, give the sibling, and the first-child
row hashes the parent. The blocks' tops are the leaves of the next round, so a
tree of any size takes a few rounds of bounded windows, whatever share of the
rows one language has. Going back down, each round's siblings join its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import numbered, pinned

# Levels of a round at most: a window holds 2^LEVELS rows.
LEVELS = 8
# Fields of a leaf, in the order they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(changes: dict[str, Column] | None = None) -> Column:
    """Digest of a row's fields, each as length, colon and value (`-` if null)."""
    values = [(changes or {}).get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))


def _levels(nodes: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """``steps`` to the block's top for every node (key, pos, size, digest) and, on the block's first row, its ``top``.

    ``size`` is the number of the key's nodes in this round. A step is the
    sibling (empty: none) and the node's slot in its run; a tree that has come
    down to one node takes no more steps.
    """
    rows = nodes.withColumn("block", F.shiftright("pos", levels)).withColumn("h0", F.col("digest"))
    window = Window.partitionBy(*keys, "block").orderBy("pos")
    for level in range(levels):
        step, h = 1 << level, F.col(f"h{level}")
        first = F.col("pos") % step == 0
        slot = F.shiftright("pos", level) % 2
        at_level = F.shiftright(F.col("size") + (step - 1), level)
        length = F.least(F.lit(2), at_level - F.shiftright("pos", level) + slot)
        rows = rows.withColumns({"ahead": F.lead(h, step).over(window), "behind": F.lag(h, step).over(window)})
        sibling = F.when(slot == 1, F.col("behind")).when(length == 2, F.col("ahead")).otherwise(F.lit(""))
        parent = F.when(at_level == 1, h).when(length == 2, digest(h, F.col("ahead"))).otherwise(digest(h))
        rows = rows.withColumns({
            f"s{level}": F.when(first & (at_level > 1), sibling),
            f"h{level + 1}": F.when(F.col("pos") % (2 * step) == 0, parent),
        }).drop("ahead", "behind", f"h{level}")
    # A node's sibling stands on its first leaf's row, the last one that has one at or before each of its leaves.
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s{i}": F.last(f"s{i}", ignorenulls=True).over(so_far) for i in range(levels)})
    steps = [
        F.when(
            F.col(f"s{i}").isNotNull(),
            F.struct(F.col(f"s{i}").alias("sibling"), (F.shiftright("pos", i) % 2).cast("int").alias("slot")),
        ) for i in range(levels)
    ]
    return rows.withColumn("steps", F.array_compact(F.array(*steps))).withColumnRenamed(f"h{levels}", "top").drop(
        *(f"s{i}" for i in range(levels))
    )


def climb(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``nodes`` with ``steps`` to the key's root, (key, root) per key) of nodes (key, pos, size, digest, more columns).

    ``pos`` counts from 0 without gaps in each key, ``size`` is the key's count.
    ``nodes`` must be cheap to read again.
    """
    most = nodes.agg(F.max("size")).first()[0] or 1
    levels = max(1, min(LEVELS, (most - 1).bit_length()))
    rows = _levels(nodes, keys, levels)
    tops = rows.filter(F.col("pos") % (1 << levels) == 0).select(
        *keys, F.col("block").alias("pos"), F.shiftright(F.col("size") + ((1 << levels) - 1), levels).alias("size"),
        F.col("top").alias("digest"),
    )
    tops, rows = pinned(tops), rows.drop("top")
    if most <= 1 << levels:
        return rows.drop("block"), tops.select(*keys, F.col("digest").alias("root"))
    above, roots = climb(tops, keys)
    above = above.select(
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), F.col("pos").alias("__b"), F.col("steps").alias("rest")
    )
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)] + [F.col("block") == F.col("__b")]
    joined = rows.join(above, same).withColumn("steps", F.concat("steps", "rest"))
    return joined.drop("block", "__b", "rest", *(f"__k{i}" for i in range(len(keys)))), roots


def fold(start: Column, steps: Column) -> Column:
    """The root that a digest and its steps lead to."""
    def up(at: Column, step: Column) -> Column:
        return F.when(step["slot"] == 1, digest(step["sibling"], at)).otherwise(digest(at, step["sibling"]))

    return F.aggregate(steps, start, up)


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, from the leaf's up."""
    return F.sha2(F.array_join(steps["sibling"], "").cast("binary"), 256)


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, lang, leaf, tampered leaf, subroot, root, steps) per row, (lang, subroot, root) per language) of ``docs``.

    Leaves of one language stand by doc_id (null first), equal ids by digest;
    wholly equal rows are leaves side by side and interchangeable. Null fields
    are hashed as such, an empty text as a value of no bytes. A null language is
    one of its own, before all others. An empty table gives no rows.
    """
    leaves = pinned(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        leaf_digest().alias("digest"), F.when(tampered(), leaf_digest({"n_chars": F.col("n_chars") + 1})).alias("changed"),
    ))
    placed = numbered(leaves, ["lang"], [F.col("doc_id"), F.col("digest")])
    leaves, subroots = climb(placed, ["lang"])
    langs, whole = climb(numbered(subroots.withColumnRenamed("root", "digest"), [], [F.col("lang")]), [])
    # One row: the root.
    langs = langs.crossJoin(F.broadcast(whole)).select(
        F.col("lang").alias("__lang"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("rest")
    )
    rows = leaves.join(langs, F.col("lang").eqNullSafe(F.col("__lang")))
    rows = rows.select(
        "doc_id", "lang", F.col("digest").alias("leaf"), "changed", "subroot", "root", F.concat("steps", "rest").alias("steps")
    )
    return rows, langs.select(F.col("__lang").alias("lang"), "subroot", "root")


def tampered() -> Column:
    """Rows whose n_chars the check changes; a null doc_id never is."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0


def verify_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row of ``docs``.

    Some rows are tampered with after the manifest was made: their n_chars grows
    by one (null stays null, such a row still verifies). Each row's leaf, as it
    is then, goes up along the manifest's siblings; ``verified`` tells whether
    it meets the root. Odd rows as in ``manifest``.
    """
    rows, _ = manifest(docs)
    folded = fold(F.coalesce("changed", "leaf"), F.col("steps"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
