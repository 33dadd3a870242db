"""Toxicity by a factorization machine over hashed terms.

margin(x) = b + sum_i w_i + sum_{i<j} <v_i, v_j> over the distinct terms of a text. A term is a word of
letters, or its first four or five letters, as a 64-bit hash. The factors v learn pairs (an insult
beside the mention of a group) that additive weights miss. The fit has two passes: the first, without
factors, leaves most weights at exactly zero; the second fits weights and factors of all terms. A term whose
additive weight was zero may still matter in a pair, so it stays, but its factors start near zero: long texts
do not add up the noise of thousands of pairs, and the pairs that the labels show grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfgrid.llm import text as T

PREFIXES = (4, 5)
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit. At most `per_class` labelled rows of each label reach the driver.

    Few rows are gone through more often than `epochs` times, until `steps` batches are done.
    """

    per_class: int = 6000
    max_terms: int = 1 << 17
    min_documents: int = 5
    factors: int = 4
    epochs: int = 12
    steps: int = 360
    batch: int = 256
    rate: float = 0.02
    linear_penalty: float = 1e-3
    factor_penalty: float = 1e-3
    start: float = 0.05
    neutral_start: float = 0.005
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Terms in ascending order with their weights; bounded by `max_terms`."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, found: np.ndarray) -> float:
        """The machine's value for one text's distinct terms."""
        if not self.terms.size or not found.size:
            return float(self.bias)
        place = np.searchsorted(self.terms, found)
        place[place == self.terms.size] = 0
        place = place[self.terms[place] == found]
        vectors = self.factors[place]
        pairs = 0.5 * float((vectors.sum(axis=0) ** 2).sum() - (vectors**2).sum())
        return float(self.bias) + float(self.linear[place].sum()) + pairs


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a whole text: words, and prefixes of longer words."""
    found = []
    for piece in T.pieces(text):
        points = T.letters(piece)
        found.append(T.word_hashes(points))
        inside = np.concatenate([points != 0, [False]])
        first = np.flatnonzero(inside[:-1] & ~np.concatenate([[False], inside[:-2]])) if points.size else np.zeros(0, int)
        for length in PREFIXES:
            # starts of words that are longer than the prefix
            longer = first[first + length < points.size]
            for step in range(1, length + 1):
                longer = longer[inside[longer + step]]
            value = np.zeros(longer.size, np.uint64)
            for step in range(length):
                value = value * np.uint64(0x100000001B3) + points[longer + step].astype(np.uint64)
            found.append(T.mix(value + np.uint64(length << 56)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _locate(rows: list[np.ndarray], names: np.ndarray) -> list[np.ndarray]:
    """Per row, the places in `names` of those terms that are in it."""
    places = []
    for row in rows:
        at = np.searchsorted(names, row)
        at[at == names.size] = 0
        places.append(at[names[at] == row])
    return places


def _descend(places: list[np.ndarray], labels: np.ndarray, starts: np.ndarray, k: int, settings: Settings) -> tuple[float, np.ndarray]:
    """Proximal Adam on the logistic loss; column 0 of the weights is linear, the others are factors.

    `starts` is the deviation of each term's first factors.
    """
    draw = np.random.default_rng(settings.seed)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    size = starts.size
    weights = np.zeros((size, 1 + k))
    weights[:, 1:] = draw.normal(0, 1, (size, k)) * starts[:, None]
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    order = np.arange(len(places))
    batches = -(-order.size // settings.batch)
    for _ in range(max(settings.epochs, -(-settings.steps // batches))):
        draw.shuffle(order)
        for start in range(0, order.size, settings.batch):
            chosen = order[start : start + settings.batch]
            lengths = np.array([places[i].size for i in chosen])
            at = np.concatenate([places[i] for i in chosen])
            owner = np.repeat(np.arange(chosen.size), lengths)
            vectors = weights[at, 1:]
            sums = np.stack([np.bincount(owner, vectors[:, f], chosen.size) for f in range(k)], axis=1) if k else np.zeros((chosen.size, 0))
            squares = np.bincount(owner, (vectors**2).sum(axis=1), chosen.size)
            margin = bias + np.bincount(owner, weights[at, 0], chosen.size) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[chosen]) / chosen.size
            spread = error[owner]
            grad = np.empty_like(weights)
            grad[:, 0] = np.bincount(at, spread, size)
            for f in range(k):
                grad[:, 1 + f] = np.bincount(at, spread * (sums[owner, f] - vectors[:, f]), size)
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            pace = settings.rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
            weights -= pace * first / (1 - 0.9**step)
            bias -= settings.rate * float(error.sum())
            # shrink towards zero: each linear weight, and each factor vector as a whole
            weights[:, 0] = np.sign(weights[:, 0]) * np.maximum(np.abs(weights[:, 0]) - pace[:, 0] * settings.linear_penalty, 0)
            if k:
                norm = np.sqrt((weights[:, 1:] ** 2).sum(axis=1)) + 1e-12
                weights[:, 1:] *= np.maximum(1 - pace[:, 1:].mean(axis=1) * settings.factor_penalty / norm, 0)[:, None]
    return bias, weights


def fit(rows: list[np.ndarray], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Fit on distinct-term lists and 0/1 labels. Without rows the margin is 0; without terms it is the bias."""
    labels, k = np.asarray(labels, float), settings.factors
    if not labels.size:
        return Model(np.zeros(0, np.uint64), 0.0, np.zeros(0), np.zeros((0, k)))
    names, counts = np.unique(np.concatenate([*rows, np.zeros(0, np.uint64)]), return_counts=True)
    kept = counts >= settings.min_documents
    names, counts = names[kept], counts[kept]
    if names.size > settings.max_terms:
        names = np.sort(names[np.argsort(-counts, kind="stable")[: settings.max_terms]])
    places = _locate(rows, names)
    _, linear = _descend(places, labels, np.zeros(names.size), 0, settings)
    starts = np.where(linear[:, 0] != 0, settings.start, settings.neutral_start)
    bias, weights = _descend(places, labels, starts, k, settings)
    used = (weights != 0).any(axis=1)
    return Model(names[used], bias, weights[used, 0], weights[used, 1:])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) == 0


def _map_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [terms(text).view(np.int64) for text in batch.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([x.size for x in lists])]).astype(np.int32)
        values = np.concatenate([*lists, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["toxic", "terms"])


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Up to `per_class` rows of each label, chosen by a hash; texts are read for the chosen rows only."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = docs.select("doc_id").join(marked, "doc_id").distinct()
    chosen = T.first_by_hash(known, "toxic", settings.per_class)
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on labelled documents outside the held-out fifth.

    A document labelled more than once counts as toxic if any label says so.
    """
    rows = training_rows(docs, labels, settings).mapInArrow(_map_terms, "toxic int, terms array<bigint>").toArrow()
    lists = rows.column("terms").combine_chunks()
    bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    labelled = rows.column("toxic").to_numpy()
    rows = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    # Spark may return rows in any order; the fit must not depend on it
    order = sorted(range(len(rows)), key=lambda i: (labelled[i], rows[i].size, rows[i].tobytes()))
    return fit([rows[i] for i in order], labelled[order], settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Null and empty texts get the score of a text without known terms. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.array([model.margin(terms(text or "")) for text in batch.column("text").to_pylist()], float)
            scores = 1 / (1 + np.exp(-np.clip(margins, -40, 40)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
