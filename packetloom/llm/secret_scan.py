"""Secret scan over a trigram inverted index.

Each rule's regex gives a Boolean trigram query (any of several conjunctions
of trigrams that every match must contain). A segment of documents, one Arrow
batch, keeps postings for the trigrams the rules ask for; a query intersects
and unites those postings, and only the candidate documents meet the regex.
Rules without mandatory trigrams scan the whole segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetloom.llm.common import doc_bytes

# (kind, regex, least length of the measured group, that group). Matches run
# leftmost and non-overlapping, then those that are too short are dropped.
BASE_RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
# Further public token formats; they add spans.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
)
# Alternatives a sub-pattern may hold before it counts as unknown.
MAX_STRINGS = 64
Query = frozenset[frozenset[bytes]]
ANY: Query = frozenset([frozenset()])


def _trigrams(strings: set[str]) -> Query:
    """Any of the strings: a conjunction of its trigrams each; one too short needs nothing."""
    out = set()
    for s in strings:
        raw = s.lower().encode()
        out.add(frozenset(raw[i : i + 3] for i in range(len(raw) - 2)))
    return _simple(out)


def _simple(clauses: set[frozenset[bytes]]) -> Query:
    """Drop clauses that another one implies."""
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _and(a: Query, b: Query) -> Query:
    return _simple({x | y for x, y in product(a, b)}) if len(a) * len(b) <= MAX_STRINGS else min(a, b, key=len)


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(all strings the sequence can match or None, query that every match meets)."""
    exact: set[str] | None = {""}
    need = ANY
    run: set[str] = {""}  # strings that end here, since the last unknown part
    for op, arg in nodes:
        part: set[str] | None = None
        inner = ANY
        if op is sre.LITERAL:
            part = {chr(arg)}
        elif op is sre.IN:
            chars = [chr(v) for kind, v in arg if kind is sre.LITERAL]
            part = set(chars) if len(chars) == len(arg) and len(chars) <= 8 else None
        elif op is sre.SUBPATTERN:
            part, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            options = [_walk(x) for x in arg[1]]
            if all(o[0] is not None for o in options):
                part = set().union(*(o[0] for o in options))
            inner = _simple(set().union(*(o[1] for o in options)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            strings, body_need = _walk(body)
            if strings is not None and (low, high) in ((0, 1), (1, 1)):
                part = strings | ({""} if low == 0 else set())
            inner = body_need if low else ANY
        elif op is sre.AT:
            part = {""}
        if part is not None and len(run) * len(part) <= MAX_STRINGS:
            run = {a + b for a in run for b in part}
            exact = None if exact is None else run
            continue
        need = _and(_and(need, _trigrams(run)), inner if part is None else _trigrams(part))
        exact, run = None, {""}
    return exact, _and(need, _trigrams(run))


def trigram_query(pattern: str) -> Query:
    """Disjunction of trigram conjunctions over the ASCII-lower-cased text; ``ANY`` if nothing is mandatory."""
    strings, need = _walk(_parser.parse(pattern))
    return _trigrams(strings) if strings is not None else need


class Segment:
    """Postings of one batch: for each asked trigram the sorted rows that hold it."""

    def __init__(self, texts: list[bytes], asked: list[bytes]):
        self.rows = np.arange(len(texts))
        body = b"\0".join(texts).lower()
        at = np.frombuffer(body, np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        wanted = np.full(1 << 24, -1, np.int16) if len(at) >= 3 else None
        self.postings: dict[bytes, np.ndarray] = {}
        if wanted is None:
            return
        for i, g in enumerate(asked):
            wanted[int.from_bytes(g, "big")] = i
        codes = (at[:-2].astype(np.int32) << 16) | (at[1:-1].astype(np.int32) << 8) | at[2:]
        which = wanted[codes]
        places = np.flatnonzero(which >= 0)
        pairs = np.unique(which[places].astype(np.int64) * (len(texts) + 1) + np.searchsorted(ends, places, "right"))
        gram, row = np.divmod(pairs, len(texts) + 1)
        for i, g in enumerate(asked):
            self.postings[g] = row[gram == i]

    def candidates(self, query: Query) -> np.ndarray:
        if query == ANY:
            return self.rows
        found = []
        for clause in query:
            lists = sorted((self.postings.get(g, self.rows[:0]) for g in clause), key=len)
            hit = lists[0]
            for other in lists[1:]:
                hit = np.intersect1d(hit, other, assume_unique=True)
            found.append(hit)
        return np.unique(np.concatenate(found))


def _finder(pattern: str, least: int, group: int):
    # A run of one class that must have a least length needs no shorter matches.
    plain = re.fullmatch(r"(\[[^\]]+\])\+", pattern)
    return re.compile(f"{plain[1]}{{{least},}}" if plain else pattern), 0 if plain else least, group


def secret_spans(docs: DataFrame, base=BASE_RULES, more=MORE_RULES) -> DataFrame:
    """Spans per document of ``docs`` (doc_id, text): doc_id, one n_<kind> per base rule, base_spans, spans.

    The last two are arrays of (kind, begin, end) in code points, end
    exclusive, by begin and then by the order of the kinds. Null and empty
    texts have no spans; rows repeated under one doc_id each give a row; an
    empty table gives no rows; other columns are ignored.
    """
    rules = [*base, *more]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r[1]) for r in rules]
        asked = sorted({g for q in queries for clause in q for g in clause})
        finders = [_finder(*r[1:]) for r in rules]
        span = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            raw = batch.column("text").to_pylist()
            texts: list[str | None] = [None] * len(raw)
            segment = Segment(raw, asked)
            spans: list[list[tuple]] = [[] for _ in raw]
            for k, (query, (regex, least, group)) in enumerate(zip(queries, finders, strict=True)):
                for i in segment.candidates(query):
                    if texts[i] is None:
                        texts[i] = raw[i].decode("utf-8", "replace")
                    for m in regex.finditer(texts[i]):
                        if m.end(group) - m.start(group) >= least:
                            spans[i].append((m.start(), k, m.end()))
            every = [[(rules[k][0], s, e) for s, k, e in sorted(x)] for x in spans]
            bases = [[(rules[k][0], s, e) for s, k, e in sorted(x) if k < len(base)] for x in spans]
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(y[1] == k for y in x) for x in spans], pa.int64()) for k in range(len(base))]
            as_rows = [[{"kind": a, "begin": b, "end": c} for a, b, c in x] for x in bases]
            columns.append(pa.array(as_rows, pa.list_(span)))
            columns.append(pa.array([[{"kind": a, "begin": b, "end": c} for a, b, c in x] for x in every], pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{r[0]}" for r in base), "base_spans", "spans"])

    spans = "array<struct<kind:string,begin:bigint,end:bigint>>"
    counts = "".join(f"n_{r[0]} bigint, " for r in base)
    return doc_bytes(docs).mapInArrow(scan, f"doc_id bigint, {counts}base_spans {spans}, spans {spans}")


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(span_text(spans).encode()).hexdigest()
