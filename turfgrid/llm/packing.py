"""Token sequences of a fixed length, packed best-fit by a plan over length counts.

Documents are cut into pieces only where they are longer than a sequence. Best fit (longest first) then runs
over the counts of lengths, at most one number per possible length, so its cost and its memory do not depend
on the number of documents: equal sequences are placed as one run. A plan line says which ranks
within a length go where. Each piece knows its rank within its length, the count of its kind in earlier parts
plus its place in its own part, and takes the slot of that rank. Texts are read once and never shuffled.

A null text is empty and its document holds the end id alone. Rows equal in doc_id or text are documents of
their own. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.llm.storage import written
from turfgrid.llm.text import pieces as text_pieces

LENGTH = 4096
END = 1
_CACHED = 1_000_000
_LONGEST_CACHED = 64
_MARKS = ",.;:!?"
_PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, part int, place bigint"


class WordIds:
    """Ids of texts for a tokenizer that drops white space, with a bounded memory of words.

    Such a tokenizer joins nothing across a space or line feed, so the ids of a text are those of its words.
    Texts that hold the string of an added token go through the plain call, like all texts of any other
    tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = ["don't", "b.", "7", "x"]
        self.by_words = b"".join(self._each(probe)) == self._each([" don't b.\n 7  x\n"])[0]
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = dict(zip(_MARKS, self._each(list(_MARKS)), strict=True))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, many in one call: each is one run, whose last id ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        last = np.flatnonzero(self.ends[ids])
        if last.size != len(words):
            return self._each(words)
        data, bounds = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _learn(self, new: set[str]) -> list[str]:
        """Keep the ids of words not met before. Letters are parted from a mark behind them, and ASCII is lower-cased."""
        plain, other = {}, []
        for word in new:
            mark = word[-1] if word[-1] in self.marks else ""
            stem = word[: len(word) - len(mark)]
            if stem.isalpha():
                plain[word] = (stem.lower() if stem.isascii() else stem, mark)
            else:
                other.append(word)
        stems = list({stem for stem, _ in plain.values()}.difference(self.known))
        found = dict(zip(stems, self._of_letters(stems), strict=True)) if stems else {}
        found.update(zip(other, self._each(other), strict=True))
        self.known.update(found)
        self.known.update((word, self.known[stem] + (self.marks[mark] if mark else b"")) for word, (stem, mark) in plain.items())
        return [*found, *plain]

    def _of_words(self, words: list[str]) -> bytes:
        known = self.known
        if len(known) > _CACHED:
            known.clear()
            known[""] = b""
        new = set(words).difference(known)
        learned = self._learn(new) if new else []
        out = b"".join(map(known.__getitem__, words))
        for word in learned:
            if len(word) > _LONGEST_CACHED:
                known.pop(word, None)
        return out

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text, four bytes each, in parts of bounded size where the words are."""
        if not self.by_words or any(t in text for t in self.added):
            yield self._each([text])[0]
            return
        for piece in text_pieces(text):
            yield self._of_words(piece.replace("\n", " ").split(" "))


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _cut(parts: Iterator[bytes], size: int, end: int) -> Iterator[bytes]:
    """Runs of `size` ids, the last one shorter; the end id follows the last part."""
    held = b""
    for part in parts:
        held = held + part if held else part
        whole = len(held) - len(held) % (4 * size)
        for at in range(0, whole, 4 * size):
            yield held[at : at + 4 * size]
        held = held[whole:]
    yield held + np.array([end], "<u4").tobytes()


def _pieces_of(tokenizer: str, size: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _word_ids(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        rows: list[tuple] = []
        ids: list[bytes] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            if keep_ids:
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            rows.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for number, held in enumerate(_cut(coder.parts(text.as_py() or ""), size, end)):
                    length = len(held) // 4
                    rows.append((doc, number, number * size, length, zlib.crc32(held), part, seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        ids.append(held)
                    if len(rows) >= (1000 if keep_ids else 10_000):
                        yield out()
        yield out()

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place[, ids]): every document's ids, then the end id, cut at `size`.

    `place` counts the pieces of a length within one part. It holds only together with the `part` of the
    same run, so the rows are written once and read back. `tokenizer` is a path that every executor can read.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = f"{_PIECES}, ids array<int>" if keep_ids else _PIECES
    return written(narrow.mapInArrow(_pieces_of(tokenizer, size, end, keep_ids), schema), "pieces")


class Slots(NamedTuple):
    """Ranks `first` to `first + items - 1` of a length: `per` in each sequence from `sequence` on, from `offset` on."""

    length: int
    first: int
    items: int
    per: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], size: int = LENGTH) -> tuple[list[Slots], int]:
    """Best fit, longest first, over the counts of lengths: the plan lines and the number of sequences.

    Sequences that are filled alike are one run (first sequence, number). An item goes where least is left; there
    the next one of its length fits too while there is room, so a run takes `left // length` items at once.
    That gives what best fit over single documents in descending length gives.
    """
    runs: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    lefts: list[int] = []
    lines: list[Slots] = []
    used = 0

    def keep(left: int, first: int, number: int) -> None:
        if left and number:
            if not runs[left]:
                insort(lefts, left)
            runs[left].append((first, number))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(lefts, length)
            if at < len(lefts):
                left = lefts[at]
                first, number = runs[left].pop()
                if not runs[left]:
                    lefts.pop(at)
            else:
                left, first = size, used
                number = -(-todo // (size // length))
                used += number
            per = left // length
            full = min(number, todo // per)
            if full:
                lines.append(Slots(length, rank, full * per, per, first, size - left))
                keep(left - per * length, first, full)
                rank, todo = rank + full * per, todo - full * per
            if todo and full < number:  # fewer than `per` are left: one more sequence
                lines.append(Slots(length, rank, todo, todo, first + full, size - left))
                keep(left - todo * length, first + full, 1)
                full, todo = full + 1, 0
            keep(left, first + full, number - full)
    return lines, used


def _slot_of(lines: list[Slots]):
    """Sequence and offset for each row's length and rank, by a search in the plan's lines."""
    table = np.array(sorted(lines), np.int64).reshape(-1, len(Slots._fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (table[:, 0] << 46) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            line = table[np.searchsorted(starts, (length << 46) + rank, side="right") - 1]
            inside = rank - line[:, 1]
            sequence = line[:, 4] + inside // line[:, 3]
            offset = line[:, 5] + inside % line[:, 3] * length
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def place(cut: DataFrame, size: int = LENGTH) -> DataFrame:
    """The rows of `pieces` with `sequence_id` and `offset`, without part and place.

    Counts by part and length are summed over the earlier parts; only these numbers and the narrow rows of
    pieces meet in a join. The plan is made from at most `size` numbers.
    """
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    lines, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}, size)
    kept = [c for c in cut.columns if c not in ("part", "place")]
    ranked = cut.join(before, ["part", "length"]).select(*kept, (F.col("__before") + F.col("place")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_slot_of(lines), f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, size: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every piece of every document."""
    return place(pieces(docs, tokenizer, size, end, keep_ids), size)


def sequences(docs: DataFrame, tokenizer: str, size: int = LENGTH, end: int = END) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the packed sequences, each of at most `size` ids in order of offset."""
    piece = F.struct("offset", "doc_id", "length", "ids")
    held = pack(docs, tokenizer, size, end, keep_ids=True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("held"))
    return held.select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.length").alias("lengths"))
