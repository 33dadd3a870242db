"""Spelling variants: exact neighbours at one edit, by a dictionary of pairs of trie nodes.

The words of the corpus make a trie, their reversals another, and the nodes of both are numbered. A word cut
at a place is a pair of integers, the node of what stands before and the node of what stands behind. Two
words of which one has one letter more share the pair that skips this letter in the one and skips nothing
in the other; two words that differ in one letter share the pair that skips it in both. So neighbours meet
in an equi-join of integer pairs, and no strings are compared.

A pair that skips a letter belongs to one word per letter of the alphabet at most, and a pair that skips
nothing to a single word. A key of the join therefore never has more than `ALPHABET + 1` rows, whatever the
corpus; pairs of words are not put out, only each word's number of neighbours and its best one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.llm.storage import drop, written

SHORTEST = 5
LEAST = 3
TIMES = 2
DAMAGE = 97
#: A-Z lower-cased, a-z, U+00C0 to U+00FF
ALPHABET = 26 + 64
PART_WORDS = 100_000
_HELD_WORDS = 400_000
_HELD_NODES = 200_000
_PIECE = 1 << 20
#: bytes of Latin-1: letters stay, all else is a blank
_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_PLACE_BITS = 40


def runs(text: str) -> Iterator[list[bytes]]:
    """Maximal runs of letters, A-Z lower-cased, as Latin-1 bytes; a long text in several lists."""
    start = 0
    while start < len(text):
        # a piece ends behind a character that is no letter, or at the end of the text
        stop = min(start + _PIECE, len(text))
        while stop < len(text) and _is_letter(text[stop - 1]):
            stop += 1
        yield text[start:stop].encode("latin-1", "replace").translate(_LETTERS).lower().split()
        start = stop


def _is_letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"


def _counted(damage: int, shortest: int):
    """Words of `shortest` letters or more with their counts, after the deletions, in bounded tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                head = zlib.crc32(b"" if doc is None else str(doc).encode())
                head = zlib.crc32(b":", head)
                for found in runs(text.as_py() or ""):
                    for word, times in Counter(found).items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
                        if damage and h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= shortest:
                            held[word] += times
                    if len(held) > _HELD_WORDS:
                        yield out()
                        held.clear()
        yield out()

    return run


def words(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, damage: int = DAMAGE) -> DataFrame:
    """(word, n): words of at least `shortest` letters that occur `least` times or more.

    Words are maximal runs of letters with A-Z lower-cased. With `damage` a word whose checksum with its
    document's id is divisible by it loses one letter, as a keyed misprint; 0 leaves all words whole.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = narrow.mapInArrow(_counted(damage, shortest), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cuts(table: DataFrame, column: str, part_words: int) -> list[str]:
    """Limits of ranges of about `part_words` words: every 16th of a sample by hash, one word in part_words / 16."""
    step = max(1, part_words // 16)
    sample = table.where(F.pmod(F.xxhash64(column), F.lit(step)) == 0).select(column)
    return sorted(r[0] for r in sample.collect())[15::16]


def _in_ranges(table: DataFrame, column: str, cuts: list[str]) -> DataFrame:
    """Rows by ranges of the column, one after another in a task, in order within; `part` is the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bisect_right(cuts, w) for w in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], [*batch.schema.names, "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    ranged = table.mapInArrow(run, f"{schema}, part int") if cuts else table.withColumn("part", F.lit(0))
    return ranged.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", column)


class _Trie:
    """Numbers of the nodes that the words of one range pass, while the words come in order.

    A node is new when no earlier word of the range has its string in front. A node whose strings lie in
    several ranges is a proper prefix of a limit between them; it is numbered below zero by the first such
    limit and its depth, which is the same in every range.
    """

    def __init__(self, cuts: list[str]):
        self.cuts = cuts
        self.part = -1

    def _enter(self, part: int) -> None:
        self.part, self.last, self.path, self.count = part, "", np.zeros(1, np.int64), 0
        # the limits at both ends of the range; a prefix of any limit that this range meets is one of these
        self.ends = self.cuts[max(part - 1, 0) : part + 1]
        self.path[0] = self._number("", 1)[0]

    def _number(self, word: str, fresh: int) -> np.ndarray:
        """Numbers for the last `fresh` nodes of a word, by depth."""
        depths = range(len(word) + 1 - fresh, len(word) + 1)
        out = (np.int64(self.part) << _PLACE_BITS) + self.count + np.arange(fresh)
        self.count += fresh
        shared = max((_common(word, c) - (len(c) <= len(word) and word.startswith(c)) for c in self.ends), default=-1)
        for k, depth in enumerate(depths):
            if depth > shared:
                break
            first = bisect_right(self.cuts, word[:depth])  # the first limit above the string itself
            out[k] = -1 - ((first << _PLACE_BITS) + depth)
        return out

    def path_of(self, part: int, word: str) -> np.ndarray:
        """The numbers of the nodes of all beginnings of a word, the empty one first."""
        if part != self.part:
            self._enter(part)
        same = _common(self.last, word)
        if same < len(word):
            self.path = np.concatenate([self.path[: same + 1], self._number(word, len(word) - same)])
        else:
            self.path = self.path[: same + 1]
        self.last = word
        return self.path


def _common(one: str, two: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(one), len(two))
    if one[:high] == two[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if one[low:middle] == two[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _forward(cuts: list[str]):
    """Adds each word's number, which follows code-point order, its reversal and the nodes of its beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, part, place = _Trie(cuts), -1, 0
        for batch in batches:
            rows: list[tuple[int, str, int, str]] = []
            paths: list[np.ndarray] = []
            held = 0
            for at, word, n in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                part, place = at, (place + 1 if at == part else 0)
                rows.append(((at << _PLACE_BITS) + place, word, n, word[::-1]))
                paths.append(trie.path_of(at, word))
                held += len(word)
                if held > _HELD_NODES:
                    yield _numbered_rows(rows, paths)
                    rows, paths, held = [], [], 0
            yield _numbered_rows(rows, paths)

    return run


def _numbered_rows(rows: list[tuple[int, str, int, str]], paths: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    bounds = np.concatenate([[0], np.cumsum([p.size for p in paths])]).astype(np.int32)
    nodes = np.concatenate([*paths, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(nodes))], ["id", "word", "n", "reversed", "begins"])


def _pairs(cuts: list[str]):
    """The node pairs of each word: `kind` 0 skips nothing, 1 a letter equal to the one before it, 2 another letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(cuts)
        for batch in batches:
            begins = batch.column("begins")
            bounds, nodes = begins.offsets.to_numpy(), begins.values.to_numpy()
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            held = 0
            rows = zip(batch.column("part").to_pylist(), batch.column("reversed").to_pylist(), batch.column("id").to_pylist(), batch.column("n").to_pylist(), strict=True)
            for i, (part, word, own, n) in enumerate(rows):
                front = nodes[bounds[i] : bounds[i + 1]]
                back = trie.path_of(part, word)[::-1]  # by place in the word: what stands behind it
                letters = np.frombuffer(word[::-1].encode("latin-1"), np.uint8)
                kinds = np.full(letters.size, 2, np.int8)
                kinds[1:][letters[1:] == letters[:-1]] = 1
                size = front.size + kinds.size
                for column, values in zip(columns, ([front, front[:-1]], [back, back[1:]], [np.full(size, own)], [np.full(size, n)], [np.zeros(front.size, np.int8), kinds]), strict=True):
                    column.extend(values)
                held += size
                if held > _HELD_NODES:
                    yield _pair_rows(columns)
                    columns, held = [[], [], [], [], []], 0
            yield _pair_rows(columns)

    return run


def _pair_rows(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int8)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, k)]).astype(k)) for c, k in zip(columns, kinds, strict=True)], ["begin", "rest", "id", "n", "kind"])


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): per word the number of its neighbours, and the best as struct(-n, id).

    Two words that differ in one letter share one key, and so do two words of which one has a letter more
    when of a run of equal letters only the first is skipped; so the numbers add up over the keys of a word.
    """
    member = F.struct((-F.col("n")).alias("less"), "id", "kind")
    # nearly all pairs stand alone and go before anything is listed
    size = F.count("*").over(Window.partitionBy("begin", "rest"))
    met = pairs.withColumn("size", size).where("size > 1").groupBy("begin", "rest").agg(F.array_sort(F.collect_list(member)).alias("held"))
    # a whole word (kind 0) meets words with a letter more (kind 2); words with a skipped letter meet each other
    near = met.selectExpr("held", "explode(held) as me").selectExpr(
        "me.id as id",
        "filter(held, o -> o.id != me.id and if(me.kind = 0, o.kind = 2, o.kind != 0 or me.kind = 2)) as near",
    ).where("size(near) > 0")
    best = F.struct(F.col("near")[0]["less"].alias("less"), F.col("near")[0]["id"].alias("id"))
    return near.groupBy("id").agg(F.sum(F.size("near")).cast("bigint").alias("n_near"), F.min(best).alias("best"))


def _roots(formed: DataFrame) -> DataFrame:
    """(id, root) of words that have a form: the last word that forms lead to.

    A form is at least `times` as frequent as its word, so a chain has as many links as a count has binary
    digits at most; each round doubles the reach, so the rounds are the logarithm of that.
    """
    links = written(formed, "forms")
    while True:
        beyond = links.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        moved = written(links.join(beyond, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
        drop(links)
        links = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return links


def group(vocabulary: DataFrame, times: float = TIMES, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of distinct words (word, n).

    Near words differ by exactly one letter put in, left out or replaced. A word's form is its most frequent near
    word (of equals the first in code-point order) if that occurs `times` as often at least; `root` is the end
    of the chain of forms, the word itself if it has none. Words hold letters up to U+00FF only. Words
    without neighbours stay, an empty table gives no rows.
    """
    vocabulary = written(vocabulary.select("word", "n"), "words")
    cuts = _cuts(vocabulary, "word", part_words)
    schema = "id bigint, word string, n bigint, reversed string, begins array<bigint>"
    numbered = written(_in_ranges(vocabulary, "word", cuts).select("word", "n", "part").mapInArrow(_forward(cuts), schema), "numbered")
    drop(vocabulary)
    back = _cuts(numbered, "reversed", part_words)
    laid = _in_ranges(numbered.select("id", "n", "reversed", "begins"), "reversed", back)
    pairs = laid.mapInArrow(_pairs(back), "begin bigint, rest bigint, id bigint, n bigint, kind byte")
    near = written(_neighbours(pairs), "near")
    known = numbered.select("id", "word", "n")
    judged = known.join(near, "id", "left").withColumn("form_n", -F.col("best.less"))
    judged = judged.withColumn("form_id", F.when(F.col("form_n") >= times * F.col("n"), F.col("best.id"))).drop("best")
    judged = written(judged, "judged")
    drop(near)
    roots = _roots(judged.where("form_id is not null").select("id", F.col("form_id").alias("root")))
    name = known.select(F.col("id").alias("other"), F.col("word").alias("name"))
    whole = judged.join(roots, "id", "left")
    whole = whole.join(name.select(F.col("other").alias("form_id"), F.col("name").alias("form")), "form_id", "left")
    whole = whole.join(name.select(F.col("other").alias("root"), F.col("name").alias("root_name")), "root", "left")
    return whole.select(
        "word",
        "form",
        F.coalesce("root_name", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("form_id").isNotNull(), F.col("form_n")).alias("form_n"),
    )


def find(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of `docs` (doc_id, text), with keyed misprints put in.

    A null text has no words; a row without an id counts as one whose id is the empty string; repeated rows
    count as often as they occur. Other columns play no part.
    """
    return group(words(docs))
