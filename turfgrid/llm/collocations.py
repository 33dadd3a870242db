"""Phrase collocations by dynamic itemset counting.

The documents lie in shards that are scanned in a cycle, one step a shard. Words are counted from the first step
on. Once both parts of a longer phrase (all but its last and all but its first word) have reached the
threshold in what has been scanned, the phrase is counted from the next step on, along with the shorter ones,
and for one full cycle: each shard exactly once, wherever it began. So most phrases begin within the first
cycle, and phrases with a rare part are never counted.

Which phrases are counted in a step follows from an array of fixed size per length, the step from which each
hash slot is open. A slot that a rare phrase shares with a frequent one only lets more be counted, from a
step that is the same for all shards. While they are counted, phrases are 64-bit keys; the counts of a step lie in
buckets of the key, and totals over steps are added up without a shuffle; a key carries the step that it is counted
from, so a step goes through the counts of the last cycle only. After the last cycle one scan
names the phrases behind the slots of keys that reached the threshold and counts them by name, so keys
that collide do no harm.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.llm.storage import drop, written
from turfgrid.llm.text import mix, word_hashes
from turfgrid.session import scratch_dir
from turfgrid.sources.tables import write_bucketed

SHARDS = 4
LEAST = 10
LONGEST = 3
TOP = 2000
UNKNOWN = "und"
COVERED = 50
_MILLION = 1_000_000
_CLOSED = 255
#: a byte that UTF-8 does not use stands for the end of a piece
_END = 0xFF
_FOLD = bytes(_END if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256)).lower()
#: 0 between words; a byte of a word is never 0, not even the byte 0
_POINTS = np.array([0 if b in (32, _END) else b + 1 for b in range(256)], np.uint64)
_BOUND = re.compile(r"[.,;:!?\x0A-\x0D]")
_BLANK = re.compile(r"[\x20\x09]")
_TEXT_PIECE = 1 << 18
#: what a task holds: characters of a lot, phrases with their texts, keys of a size, rows handed over at once
_LOT = 1 << 19
_HELD = 400_000
_KEYS = 4_000_000
_ROWS = 1 << 16


@dataclass(frozen=True)
class Settings:
    """Phrases of up to `longest` words that occur `least` times in a language.

    `slot_bits` and `name_bits` size the arrays that decide what is counted and named; too small ones cost time only.
    """

    least: int = LEAST
    longest: int = LONGEST
    shards: int = SHARDS
    slot_bits: int = 23
    name_bits: int = 26
    top: int = TOP
    covered: int = COVERED


def text_parts(text: str, longest: int, limit: int = _TEXT_PIECE) -> Iterator[tuple[int, bytes]]:
    """A text as folded UTF-8 in parts of about `limit` characters, each with the number of words it repeats.

    A part ends where a piece ends, or, where a piece is longer than a part, before a blank; then the next
    part begins with the `longest - 1` words before the cut, so that phrases over it are seen once.
    """
    start, again, base = 0, 0, 0
    while True:
        stop, after, repeats = len(text), len(text), 0
        if len(text) - base > 2 * limit:
            found = _BOUND.search(text, base + limit, base + 2 * limit)
            blank = None if found else _BLANK.search(text, base + 2 * limit)
            if found:
                stop = after = found.end()
            elif blank:
                stop = blank.start()
                repeats, after = _words_back(text, start, stop, longest - 1)
        yield again, text[start:stop].encode("utf-8", "replace").translate(_FOLD)
        if stop == len(text):
            return
        start, again, base = after, repeats, stop


def _words_back(text: str, start: int, stop: int, wanted: int) -> tuple[int, int]:
    """How many of the last `wanted` words before `stop` lie in the same piece after `start`, and where they begin."""
    at, got = stop, 0
    while got < wanted:
        end = at
        while end > start and text[end - 1] in " \t":
            end -= 1
        begin = end
        while begin > start and text[begin - 1] not in " \t" and not _BOUND.match(text[begin - 1]):
            begin -= 1
        if begin == end:
            break
        at, got = begin, got + 1
    return got, at


class _Lot:
    """Parts of texts of one language as bytes, looked at together when they are many."""

    def __init__(self):
        self.parts, self.again, self.size = [], [], 0

    def add(self, again: int, data: bytes) -> None:
        self.parts.append(data)
        self.again.append(again)
        self.size += len(data) + 1


def _slots_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _joined(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The key of a phrase from that of its beginning and the hash of its last word."""
    return mix(keys * np.uint64(0xD1342543DE82EF95) + words)


class _Phrases:
    """The words of a lot in order: place, hash, and the piece each stands in; and the phrases that they make.

    Words and phrases are told apart by 64-bit hashes, seeded by the language.
    """

    def __init__(self, lot: _Lot, lang: str, settings: Settings):
        self.settings, self.data = settings, bytes([_END]).join(lot.parts)
        folded = np.frombuffer(self.data, np.uint8)
        ends = folded == _END
        points = _POINTS[folded]
        inside = np.concatenate([[False], points != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.first, self.last = edges[::2], edges[1::2]
        self.hashes = mix(word_hashes(points) + np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
        self.piece = np.cumsum(ends)[self.first] if self.first.size else self.first
        self.fresh = np.ones(self.first.size, bool)
        begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in lot.parts])])
        for part, again in enumerate(lot.again):
            if again:  # the words that a part repeats stand first in it
                low = np.searchsorted(self.first, begins[part])
                self.fresh[low : low + again] = False

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words, the place of each, and how often it occurs; a word that a part repeats is left out."""
        at = np.flatnonzero(self.fresh)
        keys, first, times = np.unique(self.hashes[at], return_index=True, return_counts=True)
        return keys, at[first], times

    def longer(self, opened: list[np.ndarray], step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, places, keys, first step) of phrases from two words on whose parts are open in this step."""
        bits = self.settings.slot_bits
        places, keys = np.arange(self.first.size), self.hashes
        for size in range(2, self.settings.longest + 1):
            since = opened[size - 2][_slots_of(keys, bits)]
            # a phrase and the next, which begins one place later, make one that is a word longer
            together = (np.diff(places) == 1) & (self.piece[places[1:] + size - 2] == self.piece[places[:-1]])
            first = np.flatnonzero(together & (np.maximum(since[:-1], since[1:]) <= step))
            begins = np.maximum(since[first], since[first + 1])
            places = places[first]
            keys = _joined(keys[first], self.hashes[places + size - 1])
            # counted where the last word is not a repeated one
            new = self.fresh[places + size - 1]
            yield size, places[new], keys[new], begins[new]

    def texts(self, places: np.ndarray, size: int) -> list[bytes]:
        """The phrases of `size` words at some places, a blank between words."""
        first, last = self.first[places], self.last[places + size - 1]
        plain = np.ones(places.size, bool)
        for k in range(1, size):
            plain &= self.first[places + k] - self.last[places + k - 1] == 1
        found = [self.data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        for i in np.flatnonzero(~plain).tolist():
            found[i] = b" ".join(found[i].split())
        return found

    def text(self, place: int, size: int) -> str:
        return self.texts(np.array([place]), size)[0].decode()


def _lots(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[str, _Phrases]]:
    """The texts of a task by language, in lots of bounded size."""
    lots: defaultdict[str, _Lot] = defaultdict(_Lot)
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            name = UNKNOWN if lang is None else lang
            for again, data in text_parts(text.as_py() or "", settings.longest):
                lots[name].add(again, data)
                held += len(data) + 1
                if lots[name].size > _LOT:
                    held -= lots[name].size
                    yield name, _Phrases(lots.pop(name), name, settings)
                if held > 8 * _LOT:  # many languages with little text each
                    yield from ((n, _Phrases(lot, n, settings)) for n, lot in lots.items())
                    lots.clear()
                    held = 0
    yield from ((name, _Phrases(lot, name, settings)) for name, lot in lots.items())


class _Named:
    """Phrases of one language and size by key, each with its text and how often it was met; about 60 bytes a phrase."""

    def __init__(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in the order of the keys, with the number of each
        self.names: list[pa.Array] = []
        self.times = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return self.keys.size

    def add(self, phrases: _Phrases, size: int, keys: np.ndarray, places: np.ndarray, times: np.ndarray) -> None:
        """Count distinct keys in ascending order, each with a place where it stands; only new ones are given a text."""
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(keys.size, bool)
        known[spot < len(self)] = self.keys[spot[spot < len(self)]] == keys[spot < len(self)]
        self.times[self.at[spot[known]]] += times[known]
        new = ~known
        number = self.times.size + np.arange(np.count_nonzero(new))
        self.at, self.keys = np.insert(self.at, spot[new], number), np.insert(self.keys, spot[new], keys[new])
        self.times = np.concatenate([self.times, times[new]])
        self.names.append(pa.array(phrases.texts(places[new], size), pa.binary()))

    def columns(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        keys = np.zeros(len(self), np.uint64)
        keys[self.at] = self.keys
        return pa.concat_arrays(self.names).cast(pa.string()), pa.array(keys.view(np.int64)), pa.array(self.times)


def _handed(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded size."""
    batch = pa.RecordBatch.from_arrays(columns, names)
    for start in range(0, batch.num_rows, _ROWS):
        yield batch.slice(start, _ROWS)


_WORDS = "lang string, phrase string, key bigint, n bigint"


def _count_words(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, _Named] = defaultdict(_Named)

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            columns = held.pop(lang).columns()
            return _handed([pa.repeat(lang, len(columns[0])), *columns], ["lang", "phrase", "key", "n"])

        for lang, phrases in _lots(batches, settings):
            keys, places, times = phrases.words()
            held[lang].add(phrases, 1, keys, places, times)
            if len(held[lang]) > _HELD:
                yield from out(lang)
        for lang in list(held):
            yield from out(lang)

    return run


def _count_keys(step: int, opened, settings: Settings):
    """(kind, key, n) of the longer phrases that are counted in this step; `opened` is broadcast.

    `kind` is the phrase's size and, from bit 8 on, the step from which it is counted, the same in all shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[int, list[np.ndarray]] = defaultdict(list)

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, times = np.unique(np.concatenate(held.pop(kind)), return_counts=True)
            return _handed([pa.array(np.full(keys.size, kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(times)], ["kind", "key", "n"])

        for _, phrases in _lots(batches, settings):
            for size, _, keys, begins in phrases.longer(opened.value, step):
                for begin in range(max(0, step - settings.shards + 1), step + 1):
                    held[begin << 8 | size].append(keys[begins == begin])
                if sum(k.size for kind, parts in held.items() if kind & 255 == size for k in parts) > _KEYS:
                    for kind in [kind for kind in held if kind & 255 == size]:
                        yield from out(kind)
        for kind in list(held):
            yield from out(kind)

    return run


def _count_names(reached, settings: Settings):
    """(lang, size, phrase, n) of longer phrases in slots that a key of their size has which reached the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        always = [np.where(_bits(b), np.uint8(0), np.uint8(_CLOSED)) for b in reached.value["open"]]
        held: defaultdict[tuple[str, int], _Named] = defaultdict(_Named)

        def out(lang: str, size: int) -> Iterator[pa.RecordBatch]:
            names, _, times = held.pop((lang, size)).columns()
            columns = [pa.repeat(lang, len(names)), pa.array(np.full(len(names), size, np.int8)), names, times]
            return _handed(columns, ["lang", "size", "phrase", "n"])

        for lang, phrases in _lots(batches, settings):
            for size, places, keys, _ in phrases.longer(always, 0):
                slots = _slots_of(keys, settings.name_bits)
                words = reached.value["named"][size - 2]
                some = np.flatnonzero((words[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1))
                distinct, first, times = np.unique(keys[some], return_index=True, return_counts=True)
                held[lang, size].add(phrases, size, distinct, places[some[first]], times)
                if sum(map(len, held.values())) > 3 * _HELD:
                    yield from out(*max(held, key=lambda own: len(held[own])))
        for lang, size in list(held):
            yield from out(lang, size)

    return run


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def _slot_words(reached: DataFrame, bits: int) -> np.ndarray:
    """The slots of the keys of a table as one array of bits, 64 to a word."""
    slot = F.shiftrightunsigned("key", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")
    words = reached.select(F.shiftrightunsigned(slot, 6).alias("word"), bit.alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _folded(words: np.ndarray, bits: int) -> np.ndarray:
    """The slots of an array of bits in an array of 2^bits slots, where each stands for several of them."""
    marked = _bits(words)
    return np.packbits(marked.reshape(1 << bits, -1).any(axis=1), bitorder="little").view(np.uint64)


def counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, size, phrase, n): all words, and the phrases up to `longest` words that occur `least` times; n is exact.

    The number of steps is the number of shards plus, at most, that number again for each further length, and
    then each shard is read once more for the names. What the driver gets and the tasks hold besides a lot of
    texts are arrays of 2^slot_bits bytes and 2^name_bits bits per length.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "shards")
    # any deal into shards will do: what is written stays
    dealt = docs.select("lang", "text", F.pmod(F.monotonically_increasing_id(), F.lit(settings.shards)).cast("int").alias("shard"))
    dealt.where("text is not null").write.partitionBy("shard").parquet(folder)
    shards = spark.read.schema("lang string, text string, shard int").parquet(folder)
    texts = shards.count()
    buckets = min(20_000, max(8, texts // 4_000))

    opened = [np.full(1 << settings.slot_bits, _CLOSED, np.uint8) for _ in range(settings.longest - 1)]
    bits = max(settings.slot_bits, settings.name_bits)
    # slots of keys that reached the threshold, by size
    marked = {size: np.zeros(1 << (bits - 6), np.uint64) for size in range(2, settings.longest + 1)}

    def mark(size: int, tables: list[DataFrame], since: int) -> None:
        """Mark the keys of a size that are counted from the step `since` or later."""
        of_size = reduce(DataFrame.union, tables).where(f"kind & 255 = {size} and kind >= {since << 8}")
        totals = of_size.groupBy("key").agg(F.sum("n").alias("n"))
        marked[size] |= _slot_words(totals.where(F.col("n") >= settings.least).select("key"), bits)

    words, tables, step, last = None, [], 0, settings.shards
    while step < last:
        shard = shards.where(F.col("shard") == step % settings.shards).select("lang", "text")
        if step < settings.shards:
            scanned = shard.mapInArrow(_count_words(settings), _WORDS)
            total = written((scanned if words is None else words.unionByName(scanned)).groupBy("lang", "phrase", "key").agg(F.sum("n").alias("n")), "words")
            if words is not None:
                drop(words)
            words = total
        if step > 0:
            shipped = spark.sparkContext.broadcast(opened)
            found = shard.mapInArrow(_count_keys(step, shipped, settings), "kind int, key bigint, n bigint")
            path = scratch_dir(spark, "keys")
            counted = found.repartition(buckets, "key").groupBy("key", "kind").agg(F.sum("n").alias("n"))
            tables.append(write_bucketed(counted, path, "key", buckets, laid=True, ordered=False))
            shipped.destroy()
        step += 1
        opened = [x.copy() for x in opened]
        for size in range(1, settings.longest):
            # a length is counted until a cycle after its last slot was opened; then nothing is added to it
            ends = settings.shards if size == 1 else int(opened[size - 2][opened[size - 2] < _CLOSED].max(initial=0)) + settings.shards
            if step > ends or (size > 1 and not tables):
                continue
            if size == 1:
                above = _slot_words(words.where(F.col("n") >= settings.least).select("key"), settings.slot_bits)
            else:
                # what is counted now has begun within a cycle; what was counted out before is marked already
                mark(size, tables[-settings.shards :], max(0, step - settings.shards))
                above = _folded(marked[size], settings.slot_bits)
            new = _bits(above) & (opened[size - 1] == _CLOSED)
            if new.any():
                opened[size - 1][new] = step
                last = max(last, step + settings.shards)  # these are counted for one cycle from here on
    names = words.select("lang", F.lit(1).cast("byte").alias("size"), "phrase", "n")
    if settings.longest == 1 or not tables:
        return names
    mark(settings.longest, tables, 0)
    above = _slot_words(words.where(F.col("n") >= settings.least).select("key"), settings.slot_bits)
    marks = {
        "open": [above, *[_folded(marked[size], settings.slot_bits) for size in range(2, settings.longest)]],
        "named": [_folded(marked[size], settings.name_bits) for size in range(2, settings.longest + 1)],
    }
    shipped = spark.sparkContext.broadcast(marks)
    # a task names many texts, for a phrase is put out by each task that meets it
    tasks = max(2 * spark.sparkContext.defaultParallelism, texts // 20_000)
    named = shards.select("lang", "text").coalesce(tasks).mapInArrow(_count_names(shipped, settings), "lang string, size byte, phrase string, n bigint")
    longer = named.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)
    counted = written(names.unionByName(longer), "counts")
    shipped.destroy()
    for table in tables:
        drop(table)
    return counted


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(counted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from the table of `counts`.

    A phrase that occurs a >= `least` times is cut after each of its words; l and r are the counts of the two
    sides and floor(10^6 a a / (l r)) is the score of the cut, in exact decimals. The lowest-scoring cut
    counts, of equals the first. A phrase inside a longer one with at least `covered` % of its occurrences is left
    out, whether or not that one stays. n is the number of words of the language. Kept are the first `top`
    phrases of each language by score, a, and phrase in byte order.
    """
    known = counted.where(F.col("n") >= settings.least).select("lang", "size", "phrase", F.col("n").alias("a"))
    known = written(known, "phrases")
    totals = counted.where(F.col("size") == 1).groupBy("lang").agg(F.sum("n").alias("n"))
    found = known.where(F.col("size") > 1).withColumn("words", F.split("phrase", " "))

    def side(first, length):
        return F.array_join(F.slice("words", first, length), " ")

    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    for name, short in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(name), F.col("a").alias(short)), ["lang", name])
    wide = "cast({} as decimal(19,0))".format
    score = F.expr(f"(cast({_MILLION} as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})").cast("bigint")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the phrases of two words or more inside each longer one
    inside = F.expr("flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), i -> array_join(slice(words, i, s), ' '))))")
    longer = found.where(F.size("words") > 2).select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {settings.covered} * a")
    first = _ranked(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), settings.top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Collocations of the texts of `docs` (text, lang) by language.

    A null text is empty, a null language is `und`; a language without phrases has no rows. Repeated rows
    count as often as they occur. Other columns play no part.
    """
    return collocations(counts(docs, settings), settings)
