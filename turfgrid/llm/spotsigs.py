"""Document fingerprints by spot signatures.

A signature starts at a common word (an anchor) and chains the content words that follow it; running text
has many, lists and boilerplate few. The fingerprint of a text is the set of its signatures, 32 hash bits
each, and likeness is the Jaccard coefficient of two sets. A text without signatures is its own single
signature, and an empty text has none.

`near_duplicates` compares a corpus: sets are put in partitions by their length so that two sets of the
wanted likeness lie in the same or in neighbouring partitions, candidates meet on rare signatures, and a
pair is given up as soon as its lengths rule the likeness out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfgrid.llm import text as T
from turfgrid.llm.ordered import in_parts

# Common function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its of on or she that the their they this to was were which will with you "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und von vor war werden wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "al como con cuando de del desde el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por que se si sin sobre su sus también te un una y ya"
)
CHAIN = 3
SPACING = 1
_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lru_cache(maxsize=1)
def _anchors() -> np.ndarray:
    return np.unique(T.hashed_words(ANCHORS))


def signatures(text: str | None, chain: int = CHAIN, spacing: int = SPACING) -> np.ndarray:
    """Distinct 32-bit signatures of a whole text, ascending.

    The chain of an anchor takes every `spacing`-th content word after it, `chain` of them; an anchor too
    near the end for that has no signature.
    """
    if not text:
        return np.zeros(0, np.uint32)
    words = T.hashed_words(text)
    common = np.isin(words, _anchors())
    content = np.flatnonzero(~common)
    at = np.flatnonzero(common)
    follow = np.searchsorted(content, at)
    whole = follow + (chain - 1) * spacing < content.size
    at, follow = at[whole], follow[whole]
    if not at.size:
        points = words if words.size else T.code_points(text).astype(np.uint64)
        value = np.uint64(0)
        for start in range(0, points.size, T.PIECE):
            block = points[start : start + T.PIECE]
            powers, _ = T.powers(block.size)
            value = T.mix(np.array([value], np.uint64))[0] + (T.mix(block) * powers[: block.size]).sum(dtype=np.uint64)
        return (T.mix(np.array([value], np.uint64)) >> np.uint64(32)).astype(np.uint32)
    value = words[at]
    for step in range(chain):
        value = T.mix(value) + words[content[follow + step * spacing]]
    return np.unique((T.mix(value) >> np.uint64(32)).astype(np.uint32))


def fingerprint(found: np.ndarray) -> str:
    """Signatures as text: eight hex digits each."""
    return found.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Jaccard coefficient of two signature sets; two empty sets are alike."""
    if not one.size or not two.size:
        return float(one.size == two.size)
    shared = np.intersect1d(one, two, assume_unique=True).size
    return shared / (one.size + two.size - shared)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row beside the one that follows it in its part."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [field.split()[0] for field in _SCHEMA.split(", ")]
    held = None
    for batch in batches:
        rows = []
        for tail, doc, text in zip(*(batch.column(c).to_pylist() for c in ("tail", "doc_id", "text")), strict=True):
            if tail and held is None:
                continue
            text = text or ""
            own = signatures(text)
            if held is not None:
                before, old, found = held
                half = len(old) // 2
                changed = old[: len(old) - half] + text[:half]
                other = signatures(changed)
                rows.append((before, len(old), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(found), fingerprint(other), likeness(found, other), likeness(found, own)))
            held = None if tail else (doc, text, own)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its text edited with the next document's, and their likeness.

    The edit replaces the last half of the code points by the first as many of the next document, in id
    order (equal ids by text, no id last; after the last the first). Null texts count as empty; the one row
    of a table of one row is its own next; an empty table gives no rows.
    """
    return in_parts(docs, with_next=True).mapInArrow(_edited, _SCHEMA)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [signatures(t).astype(np.int64) for t in batch.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([x.size for x in lists])]).astype(np.int32)
        values = pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "signatures"])


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of class representatives at `least` or more; equal sets count as one class, its smallest id."""
    found = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_signature_rows, "doc_id bigint, signatures array<bigint>")
    sets = found.where(F.size("signatures") > 0).groupBy("signatures").agg(F.min("doc_id").alias("doc_id"))
    size = F.size("signatures")
    # lengths of two alike sets differ by the factor `least` at most, so by one step of this scale
    sets = sets.withColumn("size", size).withColumn("band", F.floor(F.ln(size.cast("double")) / F.lit(float(-np.log(least))) + F.lit(1e-9)))
    grams = sets.select("doc_id", "size", "band", F.explode("signatures").alias("signature"))
    counts = grams.groupBy("signature").agg(F.count("*").alias("times")).where("times > 1")
    ranked = grams.join(counts, "signature", "left").groupBy("doc_id", "size", "band").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "signature"))).alias("rare"))
    prefix = ranked.select("doc_id", "size", "band", F.explode(F.slice("rare", 1, F.col("size") - F.ceil(F.lit(least) * F.col("size")).cast("int") + 1)).alias("first"))
    prefix = prefix.select("doc_id", "size", "band", "first.signature")
    near = prefix.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    one, two = near.alias("x"), prefix.alias("y")
    fits = (F.col("x.size") >= F.lit(least) * F.col("y.size")) & (F.col("y.size") >= F.lit(least) * F.col("x.size"))
    same = (F.col("x.signature") == F.col("y.signature")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.doc_id") != F.col("y.doc_id"))
    pairs = one.join(two, same & fits).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("signatures").alias("__a")), sets.select(F.col("doc_id").alias("b"), F.col("signatures").alias("__b"))
    shared = F.size(F.array_intersect("__a", "__b"))
    value = shared / (F.size("__a") + F.size("__b") - shared)
    return pairs.join(left, "a").join(right, "b").withColumn("likeness", value).where(F.col("likeness") >= least).select("a", "b", "likeness")
