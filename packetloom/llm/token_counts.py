"""Edit-aware token counts: a segment tree of pre-token counts per document.

A byte-level BPE never merges across pre-tokens, so a document's count is a sum
over its pre-tokens. The counts are leaves of a sum tree; an edit re-cuts only
the touched text plus boundary context, re-encodes the pre-tokens that changed
and updates the sums above them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
# Counts of words already encoded, per worker; emptied when full.
CACHE_WORDS = 1_000_000
# Pre-tokens per leaf of the tree.
LEAF = 32
# Fixed value: the public pre-token pattern of the vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_counters: dict[str, Counter] = {}


class Counter(dict):
    """Token count of a pre-token, remembered from its first sight."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(public_tokenizers.path(name))
        self.model.encode_special_tokens = True
        self.pattern = regex.compile(PRE_TOKEN)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.model.encode(word, add_special_tokens=False).ids)
        return n

    def counts(self, words: list[str]) -> list[int]:
        if len(self) > CACHE_WORDS:
            self.clear()
        return list(map(self.__getitem__, words))

    @classmethod
    def of(cls, name: str) -> Counter:
        if name not in _counters:
            _counters[name] = cls(name)
        return _counters[name]


class TokenTree:
    """Token counts of one text: leaves of pre-tokens under a Fenwick tree of sums.

    Leaves hold the texts and counts of up to ``LEAF`` pre-tokens at first;
    edits may lengthen or empty a leaf, never move another one.
    """

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        words = counter.pattern.findall(text)
        counts = counter.counts(words)
        self.leaves = [words[i : i + LEAF] for i in range(0, len(words), LEAF)] or [[]]
        sums = [sum(counts[i : i + LEAF]) for i in range(0, len(words), LEAF)] or [0]
        sizes = [sum(map(len, leaf)) for leaf in self.leaves]
        self.n_leaves = 1 << (len(sums) - 1).bit_length()
        # Sum nodes: node i has children 2i and 2i + 1; leaves start at n_leaves.
        self.tokens = self._sums(sums)
        self.chars = self._sums(sizes)
        self.encoded = 0

    def _sums(self, values: list[int]) -> list[int]:
        tree = [0] * self.n_leaves + values + [0] * (self.n_leaves - len(values))
        for i in range(self.n_leaves - 1, 0, -1):
            tree[i] = tree[2 * i] + tree[2 * i + 1]
        return tree

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf that holds the character, its first character)."""
        node, start = 1, 0
        while node < self.n_leaves:
            node *= 2
            if char >= start + self.chars[node] and node + 1 < 2 * self.n_leaves:
                start += self.chars[node]
                node += 1
        return node - self.n_leaves, start

    def _set(self, leaf: int, words: list[str], tokens: int) -> None:
        self.leaves[leaf] = words
        node = leaf + self.n_leaves
        self.tokens[node], self.chars[node] = tokens, sum(map(len, words))
        while node > 1:
            node //= 2
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replace characters [begin, end) of the present text by ``new``.

        The re-cut starts one leaf before the edit and runs until its cuts
        fall on an old pre-token border again for two pre-tokens in a row.
        Cuts depend on the characters at hand and one after a run, so all later
        ones are then the same.
        """
        begin, end = max(0, min(begin, self.length)), max(0, min(end, self.length))
        end = max(begin, end)
        if not self.length:
            first, start = 0, 0
        else:
            first, start = self._leaf_at(min(begin, self.length - 1))
        while first and (begin - start) < 2:
            first -= 1
            start -= self.chars[first + self.n_leaves]
        # One more leaf of context to the left keeps the first border an old one.
        if first:
            first -= 1
            start -= self.chars[first + self.n_leaves]
        last, stop = first, start
        while last < len(self.leaves) and (stop <= end or last == first):
            stop += self.chars[last + self.n_leaves]
            last += 1
        while True:
            # The last two pre-tokens of the window must come out as before.
            old = [w for leaf in self.leaves[first:last] for w in leaf]
            text = "".join(old)
            text = text[: begin - start] + new + text[end - start :]
            ahead = "".join(self.leaves[last][:2]) if last < len(self.leaves) else ""
            words, size = [], 0
            for m in self.counter.pattern.finditer(text + ahead):
                if size >= len(text):
                    break
                words.append(m[0])
                size += len(m[0])
            settled = last >= len(self.leaves) or (size == len(text) and words[-2:] == old[-2:] and stop - len(
                "".join(old[-2:])
            ) >= end)
            if settled:
                break
            stop += self.chars[last + self.n_leaves]
            last += 1
        tokens = self.counter.counts(words)
        self.encoded += len(words)
        # The window's pre-tokens go back over its leaves evenly.
        slots = last - first
        share = -(-len(words) // slots) if words else 0
        for k in range(slots):
            mine = words[k * share : (k + 1) * share]
            self._set(first + k, mine, sum(tokens[k * share : (k + 1) * share]))


def edited_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts before and after a document's edits.

    ``docs`` has doc_id, text and edits: array of (begin, end, new) in code
    points of the text before any edit, in any order; of overlapping edits the
    one that begins first counts (ties: the longer, then the smaller text).
    Returns doc_id, n_tokens, n_edits (applied), n_tokens_after, n_reencoded
    (pre-tokens encoded anew), n_pretokens. Null texts count as empty, null
    edits as none, null members of an edit as its lowest value; rows repeated
    under one doc_id each give a row; other columns are ignored.
    """
    schema = "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_reencoded bigint, n_pretokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(5)]
            for raw, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                for column, value in zip(out, counted(raw.decode("utf-8", "replace"), edits, counter), strict=True):
                    column.append(value)
            names = ["n_tokens", "n_edits", "n_tokens_after", "n_reencoded", "n_pretokens"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", *names]
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        F.col("edits").cast("array<struct<begin:bigint,end:bigint,new:string>>").alias("edits"),
    )
    return rows.mapInArrow(count, schema)


def counted(text: str, edits: list[dict] | None, counter: Counter) -> tuple[int, int, int, int, int]:
    """(tokens, edits applied, tokens after them, pre-tokens encoded anew, pre-tokens) of a text."""
    applied = chosen_edits(edits)
    if not applied:
        words = counter.pattern.findall(text)
        total = sum(counter.counts(words))
        return total, 0, total, 0, len(words)
    tree = TokenTree(text, counter)
    before, pretokens = tree.total, sum(map(len, tree.leaves))
    # From the end, so that earlier positions stay as they were.
    for begin, end, new in reversed(applied):
        tree.edit(begin, end, new)
    return before, len(applied), tree.total, tree.encoded, pretokens


def chosen_edits(edits: list[dict] | None) -> list[tuple[int, int, str]]:
    """Edits without overlaps, by place."""
    plain = [((e["begin"] or 0), (e["end"] or 0), e["new"] or "") for e in edits or [] if e is not None]
    chosen: list[tuple[int, int, str]] = []
    for begin, end, new in sorted(plain, key=lambda e: (e[0], -e[1], e[2])):
        begin = max(0, begin)
        if not chosen or begin >= max(chosen[-1][1], chosen[-1][0] + 1):
            chosen.append((begin, max(begin, end), new))
    return chosen


REDACTED = "[REDACTED]"
# Redaction of the query: e-mail addresses and digit runs of six or more.
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9]{6,}"


def redaction_edits(docs: DataFrame, pattern: str = PERSONAL, new: str = REDACTED) -> DataFrame:
    """doc_id, text and the edits that replace every match of ``pattern`` in the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = regex.compile(pattern)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("new", pa.string())]))
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            edits = [[{"begin": m.start(), "end": m.end(), "new": new} for m in finder.finditer(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(edits, kind)], ["doc_id", "text", "edits"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(find, "doc_id bigint, text string, edits array<struct<begin:bigint,end:bigint,new:string>>")
