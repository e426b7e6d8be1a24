"""Order-preserving packing by dynamic programming over document and sentence cuts.

The documents of a partition form one token stream in their order. Cuts may
fall on document ends (free), sentence ends (a small penalty) or elsewhere (a
large one); a sequence costs its padding as well. With pos the cut positions,

    best[j] = penalty[j] + min over i, pos[j] - pos[i] <= width, of
              best[i] + (width - (pos[j] - pos[i]))

where best[i] + pos[i] does not depend on j, so a monotone queue over the
window gives each minimum in constant amortised time. Lengths that are powers
of two need no padding and are looked up exactly. Blocks of the stream are
solved one after the other; what follows a block's last good cut moves into
the next block, so memory is bounded by the block and the longest document.
"""

from __future__ import annotations

import codecs
import string
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from packetloom.llm.common import doc_bytes

TOKENIZER = "word_bpe_49k.json"
WIDTH = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 18
SEQUENCE_COST, SENTENCE_CUT, HARD_CUT = 16, 2, 16
# Hard cuts are offered at this distance, and anywhere near the stream's end.
HARD_EVERY = 128
# Shortest power of two offered as an unpadded length inside the stream.
LEAST_POWER = 64
CACHE_WORDS = 700_000
# Marks that close a word are a token run of their own; none of them joins the letters before it.
CLOSING = string.punctuation.encode()
SENTENCE_MARKS = (".", "!", "?", "...", '."', '!"', '?"')
_encoders: dict[str, WordIds] = {}


def _byte_letters() -> str:
    """The public byte-level alphabet: printable bytes stand for themselves, others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    known = set(plain)
    return "".join(chr(b if b in known else next(rest)) for b in range(256))


class WordIds(dict):
    """White-space-separated piece -> number of its id list, encoded on first sight.

    White space only separates in this vocabulary, so pieces are independent.
    Plain Latin words with closing marks skip the library's text handling and
    go straight to its BPE model; anything else is encoded as a text.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[bytes, tuple[int, ...]] = {}
        marks = (self.tokenizer.token_to_id(m + "</w>") for m in SENTENCE_MARKS)
        self.marks = np.array([m for m in marks if m is not None], np.uint32)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.words.clear()
        # Id lists of all pieces end to end, and where each begins.
        self.flat, self.begins = array("I"), array("q", [0])

    @classmethod
    def of(cls, name: str) -> WordIds:
        if name not in _encoders:
            _encoders[name] = cls(name)
        return _encoders[name]

    def _plain(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word of Latin letters in lower case."""
        found = self.words.get(word)
        if found is None:
            mapped = codecs.charmap_decode(word, "strict", self.letters)[0]
            found = self.words[word] = tuple([t.id for t in self.model.tokenize(mapped)])
        return found

    def __missing__(self, piece: bytes) -> int:
        stem = piece.rstrip(CLOSING)
        word = b""
        if stem.isalpha():
            # ASCII letters; bytes know no others.
            word = stem.lower()
        elif stem:
            text = stem.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "ɐ" and "İ" not in text:
                word = text.lower().encode()
        if word:
            ids = self._plain(word)
            if len(stem) < len(piece):
                tail = piece[len(stem) :]
                if tail not in self.words:
                    self.words[tail] = tuple(self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids)
                ids = ids + self.words[tail]
        else:
            ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        self[piece] = number = len(self.begins) - 1
        self.flat.extend(ids)
        self.begins.append(len(self.flat))
        return number

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text the ids that the library gives, and the closing id."""
        if len(self) > CACHE_WORDS:
            self.forget()
        # Arrow splits the texts and tells pieces apart; each different one of the batch is looked up once.
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        counts = split.value_lengths().to_numpy()
        pieces = split.flatten().view(pa.binary()).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        number = np.fromiter(map(self.__getitem__, known), np.int64, len(known))[pieces.indices.to_numpy()]
        begins, flat = np.array(self.begins), np.array(self.flat, np.uint32)
        sizes = begins[number + 1] - begins[number]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = flat[np.repeat(begins[number] - stops + sizes, sizes) + np.arange(total)]
        borders = np.concatenate(([0], stops))[np.cumsum(counts)]
        return [np.append(part, np.uint32(END_ID)) for part in np.split(ids, borders[:-1])] if texts else []


@dataclass
class Stream:
    """Documents waiting to be cut: token ids and the (doc_id, first id, length, tokens) of each run."""

    ids: list[np.ndarray] = field(default_factory=list)
    runs: list[tuple[int | None, int, int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        self.ids.append(ids)
        self.runs.append((doc_id, start, len(ids), len(ids) if total is None else total))
        self.size += len(ids)


def cut_candidates(ids: np.ndarray, doc_ends: np.ndarray, marks: np.ndarray, width: int, last: bool) -> tuple:
    """(positions, penalties) where a sequence may end; position 0 comes first."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int64)
    hard = np.arange(HARD_EVERY, n, HARD_EVERY) if n > width else np.empty(0, np.int64)
    penalty[hard] = HARD_CUT
    if last:
        penalty[max(1, n - width) : n] = HARD_CUT
    penalty[np.flatnonzero(np.isin(ids, marks)) + 1] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = 0
    if last:
        penalty[n] = 0
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, width: int, last: bool, size: int) -> list[int]:
    """Cut positions of least cost from 0 to the end (``last``) or to a good cut in the final window."""
    powers = []
    p = 1 if last else LEAST_POWER
    while p < width:
        powers.append(p)
        p *= 2
    exact: dict[int, list[int]] = {}
    for p in powers:
        # Short powers serve the stream's tail only.
        low = np.searchsorted(at, size - 2 * width) if p < LEAST_POWER else 0
        before = np.searchsorted(at, at[low:] - p)
        for j in np.flatnonzero((at[low:] >= p) & (at[before] == at[low:] - p)).tolist():
            exact.setdefault(j + int(low), []).append(int(before[j]))
    pos, pen = at.tolist(), penalty.tolist()
    best, back = [0] * len(pos), [0] * len(pos)
    queue = deque([(0, 0, 0)])  # (best + position, position, index), growing values
    for j in range(1, len(pos)):
        here = pos[j]
        while queue[0][1] < here - width:
            queue.popleft()
        value, _, i = queue[0]
        value += width - here
        if j in exact:
            for k in exact[j]:
                if best[k] < value:
                    value, i = best[k], k
        value += pen[j] + SEQUENCE_COST
        best[j], back[j] = value, i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    end = len(pos) - 1
    if not last:
        window = [j for j in range(len(pos) - 1, 0, -1) if pos[j] > size - width]
        end = min(window, key=lambda j: best[j] / pos[j])
    cuts = [pos[end]]
    while end:
        end = back[end]
        cuts.append(pos[end])
    return cuts[::-1]


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.uint32())),
])


class Packer:
    """Cuts a stream of documents into pieces of numbered sequences."""

    def __init__(self, marks: np.ndarray, width: int, first_sequence: int, with_ids: bool):
        self.marks, self.width, self.sequence, self.with_ids = marks, width, first_sequence, with_ids
        self.stream = Stream()

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.stream.add(doc_id, ids)
        if self.stream.size >= BLOCK_TOKENS:
            yield self.flush(last=False)

    def flush(self, last: bool) -> pa.RecordBatch:
        stream, self.stream = self.stream, Stream()
        if not stream.size:
            return pa.RecordBatch.from_pylist([], schema=PIECES)
        ids = np.concatenate(stream.ids)
        ends = np.cumsum([r[2] for r in stream.runs])
        at, penalty = cut_candidates(ids, ends, self.marks, self.width, last)
        cuts = best_cuts(at, penalty, self.width, last, len(ids))
        borders = np.union1d(cuts, ends[ends <= cuts[-1]]).astype(np.int64)
        begins, stops = (borders[:-1], borders[1:]) if borders[0] == 0 else (np.concatenate(([0], borders[:-1])), borders)
        run = np.searchsorted(ends, begins, "right")
        seq = np.searchsorted(cuts, begins, "right") - 1
        run_begin = np.concatenate(([0], ends[:-1]))
        docs = [stream.runs[r] for r in run]
        pieces = [ids[a:b] for a, b in zip(begins, stops, strict=True)]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in docs], pa.int64()),
                pa.array(np.array([d[1] for d in docs], np.int64) + begins - run_begin[run]),
                pa.array(stops - begins), pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                pa.array([d[3] for d in docs], pa.int64()), pa.array(self.sequence + seq.astype(np.int64)),
                pa.array(begins - np.asarray(cuts, np.int64)[seq]),
                pa.array(pieces if self.with_ids else [None] * len(pieces), pa.list_(pa.uint32())),
            ],
            schema=PIECES,
        )
        self.sequence += len(cuts) - 1
        # Tokens after the last cut open the next block.
        done = cuts[-1]
        for r in range(int(np.searchsorted(ends, done, "right")), len(stream.runs)):
            doc_id, start, length, total = stream.runs[r]
            skip = max(0, done - int(run_begin[r]))
            self.stream.add(doc_id, ids[run_begin[r] + skip : ends[r]], start + skip, total)
        return out


def pack_documents(
    docs: DataFrame, tokenizer: str = TOKENIZER, width: int = WIDTH, with_ids: bool = False
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``width`` ids.

    One row per piece: doc_id, start, length, ids_crc32 (of the unsigned
    little-endian ids), doc_tokens, sequence_id, offset, ids (null unless
    ``with_ids``). The partition number leads the sequence id, so sequences of
    different tasks never clash and a repeated task gives the same rows. Null
    and empty texts are the closing id alone; rows repeated under one doc_id
    are packed each; an empty table gives no rows; other columns are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds.of(tokenizer)
        packer = Packer(encoder.marks, width, TaskContext.get().partitionId() << 40, with_ids)
        for batch in batches:
            encoded = encoder.encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                yield from packer.add(doc_id, ids)
        yield packer.flush(last=True)

    schema = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, ids array<bigint>"
    )
    return doc_bytes(docs).mapInArrow(lambda b: (x.cast(_plain_ids(x.schema)) for x in pack(b)), schema)


def _plain_ids(schema: pa.Schema) -> pa.Schema:
    at = schema.get_field_index("ids")
    return schema.set(at, pa.field("ids", pa.list_(pa.int64())))


def padded_length(length: int, width: int = WIDTH) -> int:
    """What a sequence of ``length`` ids takes after padding."""
    return length if length & (length - 1) == 0 else width
