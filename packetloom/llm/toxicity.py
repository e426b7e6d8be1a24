"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, clause
end, other. Four small transducers read them: the insult and threat lexicons
(weights learned from labels), the target window, the negation scope and the
reported-speech clause. Their composition is one transducer whose output on an
insult or threat names the pattern it stands in (plain, at a target, negated,
reported). A clause scores by its patterns; the weights of the patterns are a
logistic regression on labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import doc_bytes, held_out, pinned

# Labelled rows per class that a fit may take (drawn by a hash of the id).
FIT_ROWS = 10_000
LEXICON_TERMS = 4_000
# A term needs this many toxic texts, or this share of them if that is more.
LEAST_SUPPORT, LEAST_SHARE, LEAST_LOG_ODDS = 5, 0.003, 3.0
PREFIXES = (4, 5, 6)
TOKEN = re.compile(r"[^\W_]+|[.!?;:\n]")

# Closed word classes of the four languages.
THREATS = frozenset(
    "kill hurt destroy burn shoot stab beat strangle punish töten umbringen schlagen verletzen erschießen tuer frapper "
    "brûler égorger massacrer matar golpear quemar destruir disparar".split()
)
TARGETS = frozenset(
    "you your yours u they them he him she her dich dir dein deine euch ihr sie er toi ton ta tes vous votre ils elles "
    "tú tu ti usted ustedes vosotros ellos ellas él ella".split()
)
NEGATIONS = frozenset(
    "not never no none nobody cannot without dont isnt wasnt nicht kein keine nie niemals ohne ne pas jamais aucun sans "
    "nunca jamás ningún ninguna sin".split()
)
REPORTS = frozenset(
    "said says say told claimed wrote quoted reported called alleged sagte sagt meinte schrieb behauptete dit disait "
    "affirme écrit rapporte dijo dice afirmó escribió según".split()
)
OTHER, CLAUSE, NEGATION, REPORT, TARGET, THREAT, INSULT = range(7)
SYMBOLS = range(7)
PATTERNS = ("plain", "targeted", "negated", "reported")
NEGATION_SCOPE, TARGET_SCOPE = 3, 4
FEATURES = 10


def _negation(state: int, symbol: int) -> int:
    return 0 if symbol == CLAUSE else NEGATION_SCOPE if symbol == NEGATION else max(0, state - 1)


def _report(state: int, symbol: int) -> int:
    return 0 if symbol == CLAUSE else 1 if symbol == REPORT else state


def _target(state: int, symbol: int) -> int:
    return 0 if symbol == CLAUSE else TARGET_SCOPE if symbol == TARGET else max(0, state - 1)


def compose() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables of the composed transducer, [state, symbol].

    An output is -1, or the pattern of an insult (0-3) or threat (4-7).
    """
    states = list(product(range(NEGATION_SCOPE + 1), range(2), range(TARGET_SCOPE + 1)))
    number = {s: i for i, s in enumerate(states)}
    goes, says = np.zeros((len(states), 7), int), np.full((len(states), 7), -1)
    for (negated, reported, targeted), symbol in product(states, SYMBOLS):
        after = _negation(negated, symbol), _report(reported, symbol), _target(targeted, symbol)
        goes[number[negated, reported, targeted], symbol] = number[after]
        if symbol in (INSULT, THREAT):
            pattern = 2 if negated else 3 if reported else 1 if targeted else 0
            says[number[negated, reported, targeted], symbol] = pattern + 4 * (symbol == THREAT)
    return goes, says


@dataclass
class ToxicModel:
    """Lexicon (term -> log odds; terms ``w:`` whole words, ``p:`` word beginnings), pattern weights and bias."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = 0.0


class _Symbols(dict):
    """word -> (symbol, weight)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__({m: (CLAUSE, 0.0) for m in ".!?;:\n"})
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, float]:
        low = word.lower()
        odds = [self.lexicon[t] for t in _terms(low) if t in self.lexicon]
        if odds:
            found = (INSULT, max(odds))
        elif low in THREATS:
            found = (THREAT, 1.0)
        elif low in NEGATIONS:
            found = (NEGATION, 0.0)
        elif low in REPORTS:
            found = (REPORT, 0.0)
        elif low in TARGETS:
            found = (TARGET, 0.0)
        else:
            found = (OTHER, 0.0)
        if len(self) > 500_000:
            self.clear()
        self[word] = found
        return found


def _terms(word: str) -> list[str]:
    return [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) > n)]


class Grammar:
    """Pattern sums of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.symbols = _Symbols(lexicon)
        goes, says = compose()
        self.goes, self.says = goes.tolist(), says.tolist()

    def features(self, text: str) -> list[float]:
        """Per pattern the clause scores' sum, then the best clause and the log of the number of hits."""
        found = [self.symbols[w] for w in TOKEN.findall(text)]
        sums = [0.0] * FEATURES
        if not any(symbol >= THREAT for symbol, _ in found):
            return sums
        state, clause, best, hits = 0, 0.0, 0.0, 0
        for symbol, weight in found:
            said = self.says[state][symbol]
            if said >= 0:
                sums[said] += weight
                # Negated and reported hits speak less for their clause.
                clause += weight * (1.0, 1.5, 0.5, 0.5)[said % 4]
                hits += 1
            elif symbol == CLAUSE:
                best, clause = max(best, clause), 0.0
            state = self.goes[state][symbol]
        best = max(best, clause)
        return [math.log1p(s) for s in sums[:8]] + [math.log1p(best), math.log1p(hits)]


def _fit_ids(labels: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, toxic) of the labelled rows to learn from: never held out, at most about 2 x ``FIT_ROWS``."""
    train = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col("toxic") == value, F.lit(int(min(1.0, FIT_ROWS / n) * (1 << 20)))).otherwise(share)
    return train.filter(draw < share), min(sizes.get(0, 0), sizes.get(1, 0))


def _fit_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows to learn from, one per id: toxic, text, three min-hashes of five-word shingles."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks: list[list[int]] = [[], [], []]
            for text in batch.column("text").to_pylist():
                words = text.split()
                shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
                for seed, column in enumerate(marks):
                    column.append(min(xxhash.xxh64_intdigest(s, seed) for s in shingles) - 2**63)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "toxic", "text")] + [pa.array(m, pa.int64()) for m in marks],
                ["doc_id", "toxic", "text", "m0", "m1", "m2"],
            )

    # At most about 2 x FIT_ROWS ids: a proven bound for the broadcast, and for the rows, however often an id stands there.
    rows = doc_bytes(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text")
    )
    return rows.mapInArrow(hashed, "doc_id bigint, toxic int, text binary, m0 bigint, m1 bigint, m2 bigint")


def _one_per_family(rows: DataFrame) -> DataFrame:
    """Ids with one row left of each group of near copies, so that no copied text vouches for its own words."""
    ids = rows.select("doc_id", "m0", "m1", "m2")
    for mark in ("m0", "m1", "m2"):
        ids = ids.groupBy(mark).agg(F.min(F.struct("doc_id", "m0", "m1", "m2")).alias("r")).select("r.*")
    return ids.select("doc_id").distinct()


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms whose share among toxic texts stands far above that among others; at most ``LEXICON_TERMS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            both = [pa.array([c[t] for t in terms], pa.int64()) for c in counts]
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *both], ["term", "clean", "toxic"])

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = {w.lower() for w in TOKEN.findall(text.decode("utf-8", "replace"))}
                counts[toxic].update({t for w in words if w[0].isalnum() for t in _terms(w)})
                counts[toxic][""] += 1
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield out()
        yield out()

    per_term = (
        rows.select("toxic", "text").mapInArrow(count, "term string, clean bigint, toxic bigint")
        .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    total = per_term.filter("term = ''").first()
    if total is None or not total.toxic or not total.clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1)) - F.log((F.col("clean") + 0.5) / (total.clean + 1))
    support = max(LEAST_SUPPORT, math.ceil(LEAST_SHARE * total.toxic))
    kept = (
        per_term.filter((F.col("term") != "") & (F.col("toxic") >= support)).withColumn("odds", odds)
        .filter(F.col("odds") >= LEAST_LOG_ODDS)
        .orderBy((F.col("odds") * F.col("toxic")).desc(), "term").limit(LEXICON_TERMS)
    )
    return {r.term: round(min(r.odds, 8.0), 6) for r in kept.select("term", "odds").collect()}


def _pattern_rows(rows: DataFrame, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """The columns ``keep`` (one per name, with its type) and the features of ``text``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            features = [grammar.features(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k.split()[0]) for k in keep] + [pa.array(features, pa.list_(pa.float64()))],
                [*(k.split()[0] for k in keep), "features"],
            )

    return rows.mapInArrow(read, ", ".join([*keep, "features array<double>"]))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Learn lexicon and pattern weights from ``labels`` (doc_id, toxic) that are not held out.

    The fit takes at most about 2 x ``FIT_ROWS`` labelled rows; without rows of
    both classes the model scores every text alike (0.5 without any labels).
    """
    ids, least = _fit_ids(labels)
    if not least:
        counts = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).agg(
            F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))
        ).first()
        return ToxicModel(bias=math.log((counts[1] + 0.5) / (counts[0] - counts[1] + 0.5)))
    # Bounded by the fit rows, like ``ids``; read three times below, so kept.
    rows = pinned(_fit_texts(docs, ids))
    lexicon = learn_lexicon(rows.join(F.broadcast(_one_per_family(rows)), "doc_id"))
    data = _pattern_rows(rows, lexicon, "toxic int").collect()
    if len({r.toxic for r in data}) < 2:
        return ToxicModel(lexicon, bias=-1.0)
    weights = _logistic(np.array([r.features for r in data]), np.array([r.toxic for r in data], float))
    return ToxicModel(lexicon, weights[:-1].tolist(), float(weights[-1]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 100) -> np.ndarray:
    """Ridge logistic regression; the last weight is the bias.

    Newton steps are halved until the penalised loss falls, so that separable
    rows, where plain steps run away, converge as well.
    """
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * v * v))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while (after := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if now - after < 1e-9 * max(1.0, now):
            break
        w, now = w + size * step, after
    if not np.isfinite(w).all():
        raise ValueError("the pattern weights did not converge")
    return w


def _score(model: ToxicModel) -> Column:
    linear = F.lit(float(model.bias))
    for i, weight in enumerate(model.weights):
        linear = linear + F.col("features")[i] * F.lit(float(weight))
    return 1 / (1 + F.exp(-linear))


def toxicity_scores(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text).

    Null and empty texts have no patterns and get the score of the bias.
    A null doc_id is not held out. Rows repeated under one doc_id each give a
    row, an empty table gives none, other columns are ignored.
    """
    rows = _pattern_rows(doc_bytes(docs), model.lexicon, "doc_id bigint").withColumn("score", _score(model))
    return rows.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs`` that score under one half, all columns kept whatever their names, in one pass over the texts.

    Null and empty texts have no patterns and go by the bias alone; long texts
    are read whole; repeated rows and equal texts fare alike. An empty table
    gives no rows.
    """
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *(F.col(c).alias(n) for c, n in names.items())
    )
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    scored = _pattern_rows(rows, model.lexicon, *(f"{n} {kinds[c]}" for c, n in names.items()))
    return scored.filter(_score(model) < 0.5).select(*(F.col(n).alias(c) for c, n in names.items()))
