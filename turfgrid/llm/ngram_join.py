"""Jaccard join of word n-gram sets over prefix trees, and the components that its links make.

The sets are kept in one global order: n-grams that nothing else shares, by a sketch over the n-grams of all
documents, then other rare ones, then frequent ones, by hash within a class. A set with enough n-grams of its
own has nothing else in its prefix and is shuffled no further. Two
sets that link share an n-gram of their prefixes (the first n - ceil(t n) + 1). For each shared n-gram the
rest of the prefixes of its sets is stored in a trie; a set walks the trie with one running overlap for all
sets below a node and leaves a subtree as soon as the overlap so far and the n-grams that remain cannot
reach what the threshold needs. What the walk finds must also pass the parity bits of the two whole sets, which
bound their overlap from above, and is then verified on the whole texts.

Nothing is quadratic in a group of copies: equal sets are joined once; a first round links every set to the
most typical set of the n-grams it shares; then only sets in different components meet, and of the
largest component of a group only with the others. A group beyond `block` sets is cut into blocks that
meet in pairs, each pair in a task of its own.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfgrid.llm import text as T
from turfgrid.llm.graph import components
from turfgrid.llm.storage import drop, written
from turfgrid.session import broadcast_if_small

_FREQUENT_BIT = 62
_ROUGH_SHIFT = 32


@dataclass(frozen=True)
class Settings:
    """Link when of * intersection >= least * union, over n-grams of `words` words.

    `frequent`, `together` and `most_frequent` (a bound on a list sent to the tasks) shape the global order
    only; any order gives the same links. `slot_bits` (16 at least) is the size of a sketch of all n-grams, 16 MB at 27. A trie
    holds up to `rest` n-grams of each set; what lies beyond counts as if it were shared.
    """

    words: int = 5
    least: int = 80
    of: int = 100
    frequent: int = 32
    together: int = 4
    slot_bits: int = 27
    most_frequent: int = 1_000_000
    block: int = 1000
    rest: int = 24

    def prefix(self, n: int) -> int:
        return n + (-self.least * n // self.of) + 1

    def needed(self, n: int, m: int) -> int:
        """The smallest intersection with which sets of n and m link."""
        return -(-self.least * (n + m) // (self.of + self.least))

    def sizes_fit(self, n: int, m: int) -> bool:
        return self.of * min(n, m) >= self.least * max(n, m)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct 62-bit n-gram hashes of a whole text, ascending; a shorter text is one n-gram."""
    found = T.hashed_words(text, T.spaced) if text else np.zeros(0, np.uint64)
    if not found.size:
        return np.zeros(0, np.int64)
    width = min(words, found.size)
    value = np.full(found.size - width + 1, width, np.uint64)
    for step in range(width):
        value = value * np.uint64(0xD1342543DE82EF95) + found[step : found.size - width + 1 + step]
    grams = np.sort((T.mix(value) >> np.uint64(2)).view(np.int64))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def _lists(lists: list[np.ndarray], kind=np.int64) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([x.size for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.zeros(0, kind)]).astype(kind)))


def _repeated(settings: Settings):
    """n-grams that `settings.together` rows of a batch or more contain, with the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text, settings.words) for text in batch.column("text").to_pylist()]
            grams = np.sort(np.concatenate([*found, np.zeros(0, np.int64)]))
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if grams.size else np.zeros(0, int)
            times = np.diff(np.concatenate([first, [grams.size]]))
            often = times >= settings.together
            yield pa.RecordBatch.from_arrays([pa.array(grams[first[often]]), pa.array(times[often])], ["gram", "times"])

    return run


def frequent_grams(docs: DataFrame, settings: Settings) -> np.ndarray:
    """The most frequent n-grams, by the counts of those that repeat within a batch of rows."""
    counted = docs.select("text").mapInArrow(_repeated(settings), "gram bigint, times bigint")
    totals = counted.groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= settings.frequent)
    top = totals.orderBy(F.desc("times"), "gram").limit(settings.most_frequent).select("gram").toArrow()
    return np.sort(top.column("gram").to_numpy())


_SETS = "doc_id bigint, n int, key_a bigint, key_b bigint, rare int, own int, prefix array<bigint>, parity binary"
_LEAST_BITS, _MOST_BITS = 64, 1 << 16


def parity(spread: np.ndarray) -> bytes:
    """Per slot of a power of two of slots, about one per n-gram, whether an odd number of hashes falls into it.

    The slots in which two sets differ are no more than the n-grams that only one of them has.
    """
    bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << int(spread.size - 1).bit_length()))
    odd = np.bincount((spread & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: int, size: int, to: int) -> int:
    while size > to:
        size //= 2
        bits = (bits >> size) ^ (bits & ((1 << size) - 1))
    return bits


def may_link(n: int, one: bytes, m: int, two: bytes, settings: Settings) -> bool:
    """Whether two sets of n and m n-grams can share enough for a link, by their parity bits."""
    size = 8 * min(len(one), len(two))
    apart = _folded(int.from_bytes(one, "little"), 8 * len(one), size) ^ _folded(int.from_bytes(two, "little"), 8 * len(two), size)
    return (n + m - apart.bit_count()) // 2 >= settings.needed(n, m)


def _prefixes(frequent: np.ndarray, shared, settings: Settings):
    """Sets with the n-grams of their prefix that others may have; `own` n-grams that no other has come before these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys_a, keys_b, rare, owned, prefixes, bits = [], [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, settings.words)
                sizes.append(found.size)
                spread = T.mix(found)
                keys_a.append(int(spread.sum(dtype=np.uint64).view(np.int64)))
                keys_b.append(int(np.bitwise_xor.reduce(spread).view(np.int64)))
                bits.append(parity(spread) if found.size else b"")
                common = np.zeros(found.size, bool)
                if frequent.size:
                    common = frequent[np.minimum(np.searchsorted(frequent, found), frequent.size - 1)] == found
                rare.append(int(found.size - common.sum()))
                slots = _slot_of(found, settings)
                alone = (shared.value[slots >> 5] >> (slots & 31).astype(np.uint32)) & np.uint32(1) == 0
                alone &= ~common
                length = settings.prefix(found.size) if found.size else 0
                own = min(length, int(alone.sum()))
                owned.append(own)
                ordered = np.concatenate([found[~common & ~alone][: length - own], found[common] + (1 << _FREQUENT_BIT)])
                prefixes.append(ordered[: length - own])
            ints = [pa.array(x, t) for x, t in ((sizes, pa.int32()), (keys_a, pa.int64()), (keys_b, pa.int64()), (rare, pa.int32()), (owned, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *ints, _lists(prefixes), pa.array(bits, pa.binary())], ["doc_id", "n", "key_a", "key_b", "rare", "own", "prefix", "parity"])

    return run


class _Node:
    """A run of n-grams that all sets below share; sets that end here, and children by the next n-gram."""

    __slots__ = ("run", "ends", "children", "smallest", "most_left", "component")


def build_trie(rows: list[tuple[int, int, int, int, tuple[int, ...]]]) -> _Node:
    """Trie of (doc_id, component, n, place, rest): `rest` follows the shared n-gram at `place` of the prefix."""
    rows = sorted(rows, key=lambda r: (r[4], r[0]))
    root = _Node()
    stack = [(root, 0, len(rows), 0)]
    while stack:
        node, low, high, depth = stack.pop()
        first, last = rows[low][4], rows[high - 1][4]
        end = depth
        if high - low == 1:
            end = len(first)
        else:
            while end < len(first) and end < len(last) and first[end] == last[end]:
                end += 1
        node.run, node.children = first[depth:end], []
        node.smallest = min(r[2] for r in rows[low:high])
        node.most_left = max(r[2] - r[3] - 1 for r in rows[low:high])
        kinds = {r[1] for r in rows[low:high]}
        node.component = kinds.pop() if len(kinds) == 1 else None
        at = low
        while at < high and len(rows[at][4]) == end:
            at += 1
        node.ends = rows[low:at]
        while at < high:
            token, start = rows[at][4][end], at
            while at < high and rows[at][4][end] == token:
                at += 1
            child = _Node()
            node.children.append(child)
            stack.append((child, start, at, end))
    return root


def walk_trie(root: _Node, query: tuple[int, int, int, int, tuple[int, ...]], settings: Settings) -> list[int]:
    """Ids of stored sets in other components that may link with the query.

    Up to the lesser of the two prefixes' last n-grams the overlap is counted; beyond it, it is at most the
    n-grams that either set has left.
    """
    own, component, n, place, rest = query
    mine, last = set(rest), rest[-1] if rest else -1
    left = n - place - 1
    found, stack = [], [(root, 0, 0)]
    while stack:
        node, overlap, used = stack.pop()
        if node.component == component:
            continue
        gone = 0
        if node.run:
            overlap += sum(token in mine for token in node.run)
            used += bisect_right(node.run, last)
            gone = bisect_right(rest, node.run[-1])
        if 1 + overlap + min(left - gone, node.most_left - used) < settings.needed(n, node.smallest):
            continue
        for other, kind, m, at, theirs in node.ends:
            gone = bisect_right(rest, theirs[-1]) if theirs else 0
            reach = 1 + overlap + min(left - gone, m - at - 1 - used)
            if kind != component and other != own and settings.sizes_fit(n, m) and reach >= settings.needed(n, m):
                found.append(other)
        stack.extend((child, overlap, used) for child in node.children)
    return found


def _join_groups(settings: Settings):
    """Rows sorted by group, read as a stream; one group of bounded size is held at a time."""

    def pairs(group: list[tuple]) -> set[tuple[int, int]]:
        stored = [r[2:] for r in group if r[1]]
        asking = [r[2:] for r in group if r[0]]
        if not stored or not asking:
            return set()
        known = {r[2]: (r[4], r[7]) for r in group}
        root = build_trie([r[:5] for r in stored])
        found = {(min(q[0], other), max(q[0], other)) for q in asking for other in walk_trie(root, q[:5], settings)}
        return {(a, b) for a, b in found if may_link(*known[a], *known[b], settings)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "one", "two", "asks", "stored", "doc_id", "component", "n", "place")]
            bits = batch.column("parity").to_pylist()
            rests = batch.column("rest")
            bounds, values = rests.offsets.to_numpy(), rests.values.to_numpy()
            for i, (gram, one, two, *row) in enumerate(zip(*columns, strict=True)):
                if key != (gram, one, two):
                    out |= pairs(group)
                    key, group = (gram, one, two), []
                group.append((*row, tuple(values[bounds[i] : bounds[i + 1]].tolist()), bits[i]))
            if len(out) > 10_000:
                yield _pairs_out(out)
                out = set()
        yield _pairs_out(out | pairs(group))

    return run


def _pairs_out(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    listed = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in listed], pa.int64()) for k in (0, 1)], ["a", "b"])


@lru_cache(maxsize=64)
def _recent_shingles(text: str, words: int) -> np.ndarray:
    return shingles(text, words)


def _linked(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                x, y = _recent_shingles(one, settings.words), _recent_shingles(two, settings.words)
                shared = np.intersect1d(x, y, assume_unique=True).size
                keep.append(settings.of * shared >= settings.least * (x.size + y.size - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts link. Only texts that occur in a pair are moved."""
    pairs = written(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.join(broadcast_if_small(ids), "doc_id", "left_semi")
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    links = written(two.select("a", "b", "text_a", "text_b").mapInArrow(_linked(settings), "a bigint, b bigint").distinct(), "verified")
    drop(pairs)
    return links


_CHUNK_BITS = 16
_HELD_GRAMS = 8_000_000


def _packed(slots: np.ndarray) -> bytes:
    """Ascending distinct numbers as steps of one byte; 255 stands for 255 and more to come."""
    steps = np.diff(slots, prepend=-1).astype(np.int64)
    more = steps // 255
    ends = np.cumsum(more + 1) - 1
    out = np.full(int(ends[-1]) + 1 if ends.size else 0, 255, np.uint8)
    out[ends] = steps % 255
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255] - 1


def _slots(settings: Settings):
    """By chunk of slots: those that the n-grams of some rows fall into, and those that several do."""

    def rows(grams: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(_slot_of(np.concatenate(grams), settings))
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if slots.size else np.zeros(0, int)
        times, slots = np.diff(np.concatenate([first, [slots.size]])), slots[first]
        cuts = np.searchsorted(slots, np.arange((1 << settings.slot_bits) + 1, step=1 << _CHUNK_BITS))
        columns: list[list] = [[], [], []]
        for chunk in np.flatnonzero(np.diff(cuts)).tolist():
            here = slots[cuts[chunk] : cuts[chunk + 1]] - (chunk << _CHUNK_BITS)
            again = here[times[cuts[chunk] : cuts[chunk + 1]] > 1]
            for column, value in zip(columns, (chunk, _packed(here), _packed(again)), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.int64)], 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(shingles(text.as_py(), settings.words))
                size += held[-1].size
                if size > _HELD_GRAMS:
                    yield rows(held)
                    held, size = [np.zeros(0, np.int64)], 0
        yield rows(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk, whose rows follow each other: the bits of slots that two rows or more, or one row twice, fall into."""
    chunk, seen, twice = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    for batch in batches:
        for at, once, again in zip(*(batch.column(c).to_pylist() for c in ("chunk", "once", "again")), strict=True):
            if at != chunk:
                if chunk is not None:
                    yield out()
                chunk, seen, twice = at, np.zeros(1 << _CHUNK_BITS, bool), np.zeros(1 << _CHUNK_BITS, bool)
            slots = _unpacked(once)
            twice[slots[seen[slots]]] = True
            twice[_unpacked(again)] = True
            seen[slots] = True
    if chunk is not None:
        yield out()


def _slot_of(grams: np.ndarray, settings: Settings) -> np.ndarray:
    return (T.mix(grams) >> np.uint64(64 - settings.slot_bits)).astype(np.int32)


def shared_slots(docs: DataFrame, settings: Settings) -> np.ndarray:
    """One array of bits of a fixed size: the slots that more than one n-gram of all documents falls into."""
    chunks = docs.select("text").mapInArrow(_slots(settings), "chunk int, once binary, again binary")
    merged = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merged, "chunk int, bits binary").toArrow()
    bits = np.zeros((1 << max(0, settings.slot_bits - _CHUNK_BITS), 1 << (_CHUNK_BITS - 3)), np.uint8)
    for chunk, line in zip(merged.column("chunk").to_pylist(), merged.column("bits").to_pylist(), strict=True):
        bits[chunk] = np.frombuffer(line, np.uint8)
    return bits.reshape(-1).view(np.uint32)


def _likely_shared(sets: DataFrame) -> DataFrame:
    """(doc_id, n, rare, place, gram) of the prefix n-grams in slots that more than one fell into; counted exactly afterwards."""
    placed = sets.select("doc_id", "n", "rare", "own", F.posexplode("prefix").alias("at", "gram"))
    return placed.select("doc_id", "n", "rare", (F.col("own") + F.col("at")).alias("place"), "gram")


def _sizes(settings: Settings) -> list[F.Column]:
    """Per n-gram: how many sets have it, the least and the largest, and a bit for each size class modulo 64."""
    bit = F.expr(f"shiftleft(1L, cast(pmod({_size_class(settings)}, 64) as int))")
    return [F.count("*").alias("__sets"), F.min("n").alias("__least"), F.max("n").alias("__most"), F.bit_or(bit).alias("__classes")]


def _class_width(settings: Settings) -> float:
    return max(math.log(settings.of / settings.least), 0.01) / 8


def _size_class(settings: Settings) -> str:
    return f"cast(floor(ln(n) / {_class_width(settings)!r}) as bigint)"


def _with_demand(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows that have _sizes of their n-gram, with `demand`, 0 to 3; rows whose only partner has no fitting size go.

    Linked sets of n and m share needed(n, m) n-grams, and up to the end of the prefix that ends first all but
    ceil(t * max(n, m)) - 1 of them: n-grams that both prefixes have. That is t (n + m) / (1 + t) - t * max(n, m)
    at least, the most for m = n, and next to nothing for m = n t or n / t. So it is taken for the partner sizes
    that this n-gram offers: the one other set, or the outermost size classes between n t and n / t. `demand` is
    that number in quarters of what it is for m = n, rounded down.
    """
    t, width, own = settings.least / settings.of, _class_width(settings), _size_class(settings)
    # classes own - 9 to own + 9 as bits 0 to 18
    near = f"((shiftrightunsigned(__classes, cast(pmod({own} - 9, 64) as int)) | shiftleft(__classes, cast(64 - pmod({own} - 9, 64) as int))) & {(1 << 19) - 1}L)"
    rows = rows.withColumn("__near", F.expr(near))
    high = f"exp(({own} - 8 + floor(log2(__near + 0.5))) * {width!r})"
    low = f"exp(({own} - 9 + floor(log2((__near & -__near) + 0.5))) * {width!r})"
    other = "(__least + __most - n)"
    rows = rows.where(f"__sets > 2 or {settings.of} * least(n, {other}) >= {settings.least} * greatest(n, {other})")
    rows = rows.withColumn("__high", F.expr(f"if(__sets = 2, greatest(n, {other}), greatest(n, least({high}, n / {t!r})))"))
    rows = rows.withColumn("__low", F.expr(f"if(__sets = 2, least(n, {other}), least(n, greatest({low}, n * {t!r})))"))
    certain = f"least({t!r} * (n + __high) / {(1 + t)!r} - {t!r} * __high, {t!r} * (n + __low) / {(1 + t)!r} - {t!r} * n)"
    demand = F.expr(f"cast(least(3, greatest(0, floor(4 * {certain} / (n * {max(t * (1 - t) / (1 + t), 1e-9)!r})))) as int)")
    return rows.withColumn("demand", demand).drop("__near", "__high", "__low", "__sets", "__most", "__classes")


def _shared(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows whose n-gram another set has that may link by its size, with `demand`."""
    counts = rows.groupBy("gram").agg(*_sizes(settings)).where("__sets > 1")
    return _with_demand(rows.join(counts, "gram"), settings).drop("__least")


def _lively(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows (gram, doc_id, n, demand) that may be among what their set has in common with one that links.

    Such a partner's n-grams all have a demand up to what is certain for its size, so there are as many of them.
    """
    quarter = settings.least * (settings.of - settings.least) / (settings.of * (settings.of + settings.least)) / 4
    upto = [F.count_if(F.col("demand") <= k).alias(f"__upto{k}") for k in range(4)]
    # one less, for rounding
    highest = F.coalesce(*[F.when(F.col(f"__upto{k}") >= F.col("n") * (k * quarter) - 1, F.lit(k)) for k in (3, 2, 1)], F.lit(0))
    enough = rows.groupBy("doc_id", "n").agg(*upto).select("doc_id", "n", highest.alias("__highest"), "__upto0")
    enough = written(enough.where("__highest > 0 or __upto0 > 0").drop("__upto0"), "lively")
    return rows.join(broadcast_if_small(enough), ["doc_id", "n"]).where(F.col("demand") <= F.col("__highest")).drop("__highest", "demand")


def _met(shared: DataFrame, sets: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Pairs from the tries of all n-grams whose sets lie in more than one component."""
    marked = shared.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    marked = marked.withColumn("component", F.coalesce("component", "doc_id")).select("gram", "doc_id", "n", "place", "component")
    apart = marked.groupBy("gram").agg((F.min("component") != F.max("component")).alias("__apart"), *_sizes(settings)).where("__apart")
    marked = _lively(_with_demand(marked.join(apart.drop("__apart"), "gram"), settings), settings)
    # where this n-gram is the first in common, all that is common lies from its place on; the partner is not
    # smaller than the smallest set here, nor than the threshold allows
    least, of = settings.least, settings.of
    partner = f"greatest(__least, ({least} * n + {of - 1}) div {of})"
    marked = marked.where(f"n - place >= ({least} * (n + {partner}) + {of + least - 1}) div {of + least}")
    marked = written(marked.drop("__least"), "met")
    kinds = marked.groupBy("gram", "component").agg(F.count("*").alias("__sets"))
    kinds = kinds.groupBy("gram").agg(F.sum("__sets").alias("__all"), F.max(F.struct("__sets", "component")).alias("__main"))
    kinds = kinds.where(F.col("__all") > F.col("__main.__sets"))
    left = broadcast_if_small(marked.select("doc_id").distinct())
    rows = marked.join(kinds, "gram").join(sets.select("doc_id", "own", "prefix", "parity").join(left, "doc_id", "left_semi"), "doc_id")
    following = F.col("place") - F.col("own") + 1
    length = F.greatest(F.least(F.size("prefix") - following, F.lit(settings.rest)), F.lit(0))
    rest = F.transform(F.slice("prefix", following + 1, length), lambda x: F.shiftright(x, _ROUGH_SHIFT).cast("int"))
    asking = F.ceil((F.col("__all") - F.col("__main.__sets")) / settings.block).cast("int")
    stored = F.ceil(F.col("__all") / settings.block).cast("int")
    rows = rows.withColumn("rest", rest).withColumn("__asking", asking).withColumn("__stored", stored)
    outside = F.col("component") != F.col("__main.component")
    mine, lies = F.pmod(F.hash("doc_id"), F.col("__asking")), F.pmod(F.hash("doc_id"), F.col("__stored"))

    def cell(one, two, asks, is_stored):
        return F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), asks.alias("asks"), F.lit(is_stored).alias("stored"))

    alone = F.array(cell(F.lit(0), F.lit(0), outside, True))
    as_stored = F.transform(F.sequence(F.lit(0), F.col("__asking") - 1), lambda k: cell(k, lies, F.lit(False), True))
    as_asking = F.transform(F.sequence(F.lit(0), F.col("__stored") - 1), lambda k: cell(mine, k, F.lit(True), False))
    cells = F.when(F.col("__stored") == 1, alone).when(outside, F.concat(as_stored, as_asking)).otherwise(as_stored)
    laid = rows.select("gram", "doc_id", "component", "n", "place", "rest", "parity", F.explode(cells).alias("__cell")).select("gram", "__cell.*", "doc_id", "component", "n", "place", "rest", "parity")
    sorted_ = laid.repartition("gram", "one", "two").sortWithinPartitions("gram", "one", "two")
    return sorted_.mapInArrow(_join_groups(settings), "a bigint, b bigint")


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    A text without words has no n-grams, links with nothing and is a component of its own, like a null text.
    Equal texts and repeated rows share a component. An id with several texts is one node with the links of
    each. Rows without an id get the component of texts with the same n-grams, or null. An empty table gives
    no rows; other columns play no part.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(shared_slots(narrow, settings))
    found = written(narrow.mapInArrow(_prefixes(frequent_grams(narrow, settings), shared, settings), _SETS), "sets")
    shared.destroy()
    slim = found.select("doc_id", "n", "key_a", "key_b")
    named = slim.where("n > 0 and doc_id is not null")
    keys = written(named.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("same")), "keys")
    again = named.join(keys, ["key_a", "key_b"]).where("doc_id != same").select("doc_id", "key_a", "key_b")
    again = broadcast_if_small(written(again, "again"))
    sets = found.where("n > 0 and doc_id is not null").join(again, ["doc_id", "key_a", "key_b"], "left_anti")

    shared = written(_shared(written(_likely_shared(sets), "likely"), settings), "shared")
    lively = written(_shared(_lively(shared, settings), settings).drop("demand"), "lively")
    drop(shared)
    shared = lively

    # the set of each n-gram with the fewest rare n-grams of its own is the most typical
    typical = F.min(F.struct((F.col("rare") / F.col("n")).alias("odd"), "doc_id", "n")).alias("typical")
    typical = shared.groupBy("gram").agg(typical)
    fits = F.expr(f"{settings.of} * least(n, typical.n) >= {settings.least} * greatest(n, typical.n)")
    stars = shared.join(typical, "gram").where(fits & (F.col("doc_id") != F.col("typical.doc_id"))).groupBy(F.col("doc_id").alias("b"), F.col("typical.doc_id").alias("a"), "n").agg(F.count("*").alias("times"))
    stars = stars.where(F.expr(f"4 * times * {settings.of} >= n * {settings.of - settings.least}")).select("a", "b")
    # an id with several texts ties their sets together
    differ = (F.min("key_a") != F.max("key_a")) | (F.min("key_b") != F.max("key_b"))
    several = slim.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(differ.alias("differ")).where("differ").select("doc_id")
    tied = slim.join(several, "doc_id").join(keys, ["key_a", "key_b"]).select(F.col("doc_id").alias("a"), F.col("same").alias("b"))
    first = written(verified(stars, narrow, settings).union(tied), "first")
    labels = components(first)
    second = verified(_met(shared, sets, labels, settings), narrow, settings)
    drop(shared)
    if not second.isEmpty():
        old = labels
        labels = components(first.union(second))
        drop(old)

    filled = slim.where("n > 0").join(keys, ["key_a", "key_b"], "left")
    filled = filled.join(labels.withColumnRenamed("id", "same"), "same", "left").select("doc_id", "n", F.coalesce("component", "same", "doc_id").alias("component_id"))
    result = filled.union(slim.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return result.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs`, all columns, with one document left of each component: that of the smallest id.

    Of repeated rows of such an id one stays. Rows without an id stay.
    """
    judged = written(join(docs, settings), "judged")
    gone = judged.where("doc_id != component_id").select("doc_id").distinct()
    repeated = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    if not repeated.isEmpty():
        again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(again)
    return kept.select(docs.columns)
