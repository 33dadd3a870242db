"""Texts as NumPy arrays inside Arrow batches: code points, folded letters, word hashes.

Long texts are taken in pieces cut at white space, so memory is bounded by a piece and not by a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECE = 1 << 18
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """The text in parts of about `limit` characters; each but the last ends before white space."""
    start = 0
    while len(text) - start > limit:
        cut = _SPACE.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """By code point: the lower-case code point of a letter, 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def letters(text: str) -> np.ndarray:
    """Lower-case code points, 0 where there is no letter."""
    return letter_table()[code_points(text)]


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    table[65:91] += 32
    table[0] = 0x110000  # the code point 0 is part of a word
    table[[32, *range(9, 14)]] = 0
    return table


def spaced(text: str) -> np.ndarray:
    """Code points with A-Z lower-cased, 0 for space and the controls 9 to 13."""
    return _word_table()[code_points(text)]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finisher of splitmix64)."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse, for `length` places at least."""
    return _powers(max(2 * PIECE, 1 << int(length).bit_length()))


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(length - 1, x, np.uint64)])) for x in (_MULTIPLIER, inverse))


def word_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash per run of non-zero points, in order.

    A running sum of point times power of the place gives the polynomial of a run as a difference, which
    the inverse power moves to the origin.
    """
    inside = np.zeros(points.size + 2, bool)
    np.not_equal(points, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    if not first.size:
        return np.zeros(0, np.uint64)
    places, inverses = powers(points.size)
    total = np.zeros(points.size + 1, np.uint64)
    np.cumsum(points * places[: points.size], out=total[1:])
    return mix((total[last] - total[first]) * inverses[first] + (last - first).astype(np.uint64))


def hashed_words(text: str, fold=letters) -> np.ndarray:
    """Word hashes of a whole text, piece by piece."""
    return np.concatenate([word_hashes(fold(piece)) for piece in pieces(text)])


def first_by_hash(rows: DataFrame, kind: str, number: int) -> DataFrame:
    """The first `number` rows (doc_id, kind) of each kind in the order of a hash of doc_id.

    The counts of the kinds give the hash below which about twice that many lie; only those rows are
    shuffled and ranked, however frequent a kind is. Rarely a few less than `number` are found.
    """
    share = (F.xxhash64("doc_id").cast("double") / float(1 << 64)) + 0.5
    counts = rows.groupBy(kind).agg(F.count("*").alias("_all")).withColumnRenamed(kind, "_kind")
    near = rows.withColumn("_share", share).join(counts, F.col(kind) == F.col("_kind"))
    near = near.where(F.col("_share") * F.col("_all") <= 2 * number + 100).select("doc_id", kind, "_share")
    place = F.row_number().over(Window.partitionBy(kind).orderBy("_share", "doc_id"))
    return near.withColumn("_place", place).where(F.col("_place") <= number).select("doc_id", kind)
