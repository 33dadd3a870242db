"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared by their letters and digits, lower-cased. A benchmark item is cut into windows of
`window` characters that overlap by half. A window of m characters occurs in a text with at most k edits
only if the two share m - q + 1 - k q of their q-grams on k + 1 neighbouring diagonals. Shared q-grams are
counted in bands of 2 (k + 1) diagonals that overlap by half, so that every k + 1 neighbours lie in one
band; bands that reach the count are aligned within the band, and those within k edits are matches.

Shorter passages count when they are verbatim: q-grams shared one after another on one diagonal that span
`words` whole words of an item, or a whole item of fewer words. So each passage of an item of `words` words is
found, and with edits each that holds a window. An item under `shortest` letters and digits must stand
between word ends; one under q is looked for by its own length.

Documents are read once for each block of the benchmark. A block has about `block` characters, a bound on
what a task holds; nothing of the documents is shuffled or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfgrid.llm import text as T

SCHEMA = "doc_id bigint, item_id bigint, text_start bigint, text_end bigint, edits int, windows int"
_BITS = 20
#: places of item n count from n times this
_ITEM = np.int64(1 << 32)


@dataclass(frozen=True)
class Settings:
    """`rate` edits per character of a window; items under `shortest` letters and digits are matched exactly."""

    q: int = 8
    window: int = 120
    rate: float = 0.1
    shortest: int = 24
    words: int = 13
    block: int = 1_000_000

    def budget(self, m: int) -> int:
        return min(int(self.rate * m), (m - self.q) // self.q)

    def least_shared(self, m: int) -> int:
        return m - self.q + 1 - self.budget(m) * self.q


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    table = T.letter_table().copy()
    digits = np.array([p for p in range(0x110000) if chr(p).isdigit()])
    table[digits] = digits
    return table


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits, and the place of each in the text."""
    points = _folded()[T.code_points(text)]
    places = np.flatnonzero(points)
    return points[places], places


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram at every place."""
    if points.size < q:
        return np.zeros(0, np.uint64)
    powers, inverses = T.powers(points.size)
    total = np.zeros(points.size + 1, np.uint64)
    np.cumsum(points * powers[: points.size], out=total[1:])
    return T.mix((total[q:] - total[:-q]) * inverses[: points.size - q + 1])


@dataclass(frozen=True)
class Item:
    """An item's letters and digits, and the places among them where its words begin and end."""

    id: int
    points: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, item: int, text: str) -> Item:
        points, places = normalized(text)
        apart = np.flatnonzero(np.diff(places) > 1) + 1
        begins = np.concatenate([[0], apart]).astype(np.int64)
        return cls(item, points, begins, np.concatenate([apart, [points.size]]).astype(np.int64))

    def reach(self, words: int) -> int:
        """The most places that `words` words of the item take."""
        last = np.minimum(np.arange(self.begins.size) + words, self.begins.size) - 1
        return int((self.ends[last] - self.begins).max(initial=0))


@dataclass(frozen=True)
class Index:
    """q-grams of one block of the benchmark in hash order with item and place, and up to three windows of each."""

    settings: Settings
    hashes: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray
    within: np.ndarray
    present: np.ndarray
    texts: list[Item]
    tiny: dict[int, list[tuple[int, int]]]
    windows: list[np.ndarray]
    starts: np.ndarray
    items: list[int]
    budgets: np.ndarray
    least: np.ndarray
    sizes: np.ndarray
    keep: int
    begins: np.ndarray
    ends: np.ndarray
    wanted: np.ndarray

    def hold(self, number: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which places start to end of items hold as many whole words as are wanted of a passage, or the whole of an item of fewer."""
        # each item has as many beginnings as ends of words, so those of the items before cancel out
        whole = np.searchsorted(self.ends, number * _ITEM + end, "right") - np.searchsorted(self.begins, number * _ITEM + start)
        return whole >= self.wanted[number]


def build(items: list[tuple[int, str]], settings: Settings) -> Index:
    texts = [t for t in (Item.of(item, text) for item, text in items if text) if t.points.size]
    windows, starts, owners, within, tiny = [], [], [], [], {}
    lists = [grams(t.points, settings.q) for t in texts]
    for number, (item, found) in enumerate(zip(texts, lists, strict=True)):
        size = item.points.size
        of_gram = np.full((found.size, 3), -1, np.int64)
        if size < settings.q:
            tiny.setdefault(size, []).append((int(grams(item.points, size)[0]), number))
        elif size >= settings.shortest:
            last = max(0, size - settings.window)
            steps = list(range(0, last + 1, settings.window // 2))
            for start in sorted({*steps, last}):
                own = slice(start, max(start, start + min(settings.window, size) - settings.q + 1))
                # neighbours on the stride overlap by half, and the last window is put in besides
                column = 2 if start not in steps else (start // (settings.window // 2)) % 2
                of_gram[own, column] = len(windows)
                windows.append(item.points[start : start + settings.window])
                starts.append(start)
                owners.append(item.id)
        within.append(of_gram)
    hashes = np.concatenate([*lists, np.zeros(0, np.uint64)])
    order = np.argsort(hashes, kind="stable")
    number = np.repeat(np.arange(len(lists)), [x.size for x in lists]).astype(np.int64)
    offsets = np.concatenate([*[np.arange(x.size) for x in lists], np.zeros(0, np.int64)]).astype(np.int64)
    present = np.zeros(1 << _BITS, bool)
    present[hashes >> np.uint64(64 - _BITS)] = True
    sizes = np.array([w.size for w in windows], np.int64)
    budgets = np.array([settings.budget(m) for m in sizes], np.int64)
    keep = 2 * int(sizes.max(initial=0)) + 4 * int(budgets.max(initial=0)) + settings.q
    keep = max([keep, *(t.reach(settings.words) + settings.q + 1 for t in texts)])
    spread = np.concatenate([*within, np.zeros((0, 3), np.int64)])
    least = np.array([settings.least_shared(m) for m in sizes], np.int64)
    begins, ends = (np.concatenate([*[n * _ITEM + places for n, places in enumerate(lists)], np.zeros(0, np.int64)]) for lists in ([t.begins for t in texts], [t.ends for t in texts]))
    wanted = np.array([min(settings.words, t.begins.size) for t in texts], np.int64)
    return Index(settings, hashes[order], number[order], offsets[order], spread[order], present, texts, tiny, windows, np.array(starts, np.int64), owners, budgets, least, sizes, keep, begins, ends, wanted)


def align(window: np.ndarray, points: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """Least edits of the whole window against the text on diagonals low .. low + width - 1, and where it ends.

    Start and end in the text are free. A diagonal is the place in the text minus the place in the window.
    """
    before, after = max(0, -low), max(0, low + width + window.size - points.size)
    padded = np.concatenate([np.zeros(before, np.uint32), points[max(0, low) : max(0, low + width + window.size)], np.zeros(after, np.uint32)])
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, symbol in enumerate(window):
        best = row + (padded[i : i + width] != symbol)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    at = int(row.argmin())
    return int(row[at]), window.size + low + at


def _verbatim(points: np.ndarray, edges: np.ndarray, index: Index, number: np.ndarray, offset: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item number, start, end) of verbatim passages, from the places where q-grams of items stand.

    `edges` says before which places of the text a word ends or begins.
    """
    settings = index.settings
    order = np.lexsort((place, place - offset, number))
    number, offset, place = number[order], offset[order], place[order]
    follows = (np.diff(number) == 0) & (np.diff(place) == 1) & (np.diff(offset) == 1)
    first = np.flatnonzero(np.concatenate([[True], ~follows]))
    last = np.concatenate([first[1:], [number.size]]) - 1
    held = index.hold(number[first], offset[first], offset[last] + settings.q)
    for a, b in zip(first[held].tolist(), last[held].tolist(), strict=True):
        item = index.texts[number[a]]
        low, high = int(offset[a]), int(offset[b]) + settings.q
        start, end = int(place[a]), int(place[b]) + settings.q
        if item.points.size < settings.shortest and not (edges[start] and edges[end]):
            continue
        if np.array_equal(points[start:end], item.points[low:high]):
            yield int(number[a]), start, end


def search(points: np.ndarray, edges: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """Matches (number, start, end, edits) in normalized places; numbers beyond those of the windows are items."""
    settings, matches = index.settings, []
    for size, listed in index.tiny.items():
        here = grams(points, size)
        for wanted, number in listed:
            at = np.flatnonzero(here == np.uint64(wanted))
            matches += [(len(index.windows) + number, int(p), int(p) + size, 0) for p in at[edges[at] & edges[at + size]] if np.array_equal(points[p : p + size], index.texts[number].points)]
    found = grams(points, settings.q)
    likely = np.flatnonzero(index.present[found >> np.uint64(64 - _BITS)]) if found.size and index.hashes.size else np.zeros(0, int)
    if not likely.size:
        return matches
    first = np.searchsorted(index.hashes, found[likely], "left")
    count = np.searchsorted(index.hashes, found[likely], "right") - first
    likely, first, count = likely[count > 0], first[count > 0], count[count > 0]
    if not likely.size:
        return matches
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place, offset = np.repeat(likely, count), index.offsets[at]
    matches += [(len(index.windows) + number, start, end, 0) for number, start, end in _verbatim(points, edges, index, index.owners[at], offset, place)]
    windows = index.within[at]
    held = windows >= 0
    window = windows[held]
    diagonal = np.repeat(place - offset, 3).reshape(-1, 3)[held] + index.starts[window]
    shift = np.int64(1 << 32)
    # a window that shares all its q-grams on one diagonal is there without edits and needs no alignment
    lines, counts = np.unique(window * shift + diagonal + (1 << 20), return_counts=True)
    exact = set()
    for line in lines[counts > index.sizes[lines // shift] - settings.q]:
        number, start = int(line // shift), int(line % shift) - (1 << 20)
        if np.array_equal(points[max(0, start) : start + index.sizes[number]], index.windows[number]):
            matches.append((number, start, start + int(index.sizes[number]), 0))
            exact.add(number)
    rest = ~np.isin(window, list(exact))
    window, diagonal = window[rest], diagonal[rest]
    band = np.floor_divide(diagonal, index.budgets[window] + 1)
    cells, counts = np.unique(np.concatenate([window * shift + band + (1 << 20), window * shift + band - 1 + (1 << 20)]), return_counts=True)
    cells = cells[counts >= index.least[cells // shift]]
    for cell in cells:
        number, band_at = int(cell // shift), int(cell % shift) - (1 << 20)
        budget, pattern = int(index.budgets[number]), index.windows[number]
        low, width = band_at * (budget + 1), 2 * (budget + 1)
        edits, end = align(pattern, points, low, width)
        if edits <= budget:
            # the same from behind gives the start
            _, back = align(pattern[::-1], points[::-1], points.size - pattern.size - low - width + 1, width)
            matches.append((number, max(0, points.size - back), min(end, points.size), edits))
    return matches


def matches_of(text: str | None, index: Index) -> dict[int, tuple[int, int, int, int]]:
    """Per item: start and end in the text (code points, end exclusive), least edits, number of windows and passages."""
    found: dict[int, tuple[int, int, int, set[int]]] = {}
    if not text or not index.texts:
        return {}
    points, places, base = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    for piece in T.pieces(text):
        more, where = normalized(piece)
        before = places[-index.keep - 1 : -index.keep]
        points, places = np.concatenate([points[-index.keep :], more]), np.concatenate([places[-index.keep :], where + base])
        base += len(piece)
        # a piece ends before white space, so its last word ends there
        edges = np.concatenate([[before.size == 0 or places[0] - before[0] > 1], np.diff(places) > 1, [True]]) if places.size else np.zeros(1, bool)
        for number, start, end, edits in search(points, edges, index):
            item = index.items[number] if number < len(index.windows) else index.texts[number - len(index.windows)].id
            one, two = int(places[min(start, places.size - 1)]), int(places[max(0, end - 1)]) + 1
            old = found.get(item, (one, two, edits, set()))
            found[item] = (min(old[0], one), max(old[1], two), min(old[2], edits), old[3] | {number})
    return {item: (a, b, edits, len(windows)) for item, (a, b, edits, windows) in found.items()}


def blocks(benchmark: DataFrame, settings: Settings) -> Iterator[Index]:
    """Indexes of the benchmark, one bounded block at a time."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    number = max(1, -(-total // settings.block))
    for block in range(number if total else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == block).toArrow()
        yield build(sorted(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True)), settings)


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document and benchmark item that it contains, by a window within the edit budget or a verbatim passage.

    Null and empty texts, null items and an empty benchmark give no rows; repeated rows give repeated rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    names = ["doc_id", "item_id", "text_start", "text_end", "edits", "windows"]

    def searcher(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, item, *match) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for item, match in matches_of(text, index).items()]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

        return run

    result = None
    for index in blocks(benchmark, settings):
        part = narrow.mapInArrow(searcher(index), SCHEMA)
        result = part if result is None else result.union(part)
    return result if result is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs`, all columns, whose text contains no benchmark item and no passage of one.

    Rows with a null or empty text stay, repeated rows stay as often as they occur, and an empty benchmark
    leaves all rows.
    """

    def keeper(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [not matches_of(text, index) for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

        return run

    for index in blocks(benchmark, settings):
        docs = docs.mapInArrow(keeper(index), docs.schema)
    return docs
