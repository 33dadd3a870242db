"""Token ids in files of fixed-width bit packing.

A file is a header, the documents' ids and starts, the byte offset of each block, and the blocks. A block
holds `BLOCK` ids of the minimum number of bits that the vocabulary needs, lowest bit first, filled up to
whole bytes. All but the last block have the same length, so an id's place follows from its number, and a
block is unpacked by array operations alone. All numbers are little-endian.

    8 bytes magic | u4 bits | u4 ids per block | u8 documents | u8 ids | u8 blocks
    i8 document id (least value: none) per document | u8 first id per document, and one more | u8 block offsets, and one more
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.llm.ordered import in_parts
from turfgrid.llm.storage import written
from turfgrid.session import scratch_dir

MAGIC = b"TGBITS1\0"
BLOCK = 4096
FILE_IDS = 8_000_000
_HEAD = "<8sIIQQQ"
_NO_ID = -(1 << 63)
_CACHED = 1_000_000
_LONGEST_CACHED = 64
# a single space between two other characters: the tokenizer never joins what lies on its two sides
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")
_MARKS = ",.;:!?"


def width(vocabulary: int) -> int:
    """Bits that hold every id below the vocabulary size."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # whole bytes: the same layout without spreading bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :bits] = spread
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1)


def dump(docs: list[int | None], lists: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """A whole file."""
    starts = np.concatenate([[0], np.cumsum([x.size for x in lists])]).astype("<u8")
    ids = np.concatenate([*lists, np.zeros(0, np.uint32)])
    packed = [pack(ids[at : at + block], bits) for at in range(0, ids.size, block)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype("<u8")
    names = np.array([_NO_ID if d is None else d for d in docs], "<i8")
    head = struct.pack(_HEAD, MAGIC, bits, block, len(docs), ids.size, len(packed))
    return b"".join([head, names.tobytes(), starts.tobytes(), offsets.tobytes(), *packed])


@dataclass(frozen=True)
class TokenFile:
    """A file's directory; ids are read by ranges."""

    source: pa.NativeFile
    bits: int
    block: int
    docs: np.ndarray
    starts: np.ndarray
    offsets: np.ndarray
    data: int

    @classmethod
    def open(cls, source: pa.NativeFile) -> TokenFile:
        magic, bits, block, docs, _, blocks = struct.unpack(_HEAD, source.read_at(struct.calcsize(_HEAD), 0))
        if magic != MAGIC:
            raise ValueError("not a bit-packed token file")
        size = 8 * (docs + docs + 1 + blocks + 1)
        table = source.read_at(size, struct.calcsize(_HEAD))
        names = np.frombuffer(table, "<i8", docs)
        starts = np.frombuffer(table, "<u8", docs + 1, 8 * docs).astype(np.int64)
        offsets = np.frombuffer(table, "<u8", blocks + 1, 8 * (2 * docs + 1)).astype(np.int64)
        return cls(source, bits, block, names, starts, offsets, struct.calcsize(_HEAD) + size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids numbered start to stop - 1, reading only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), self.data + int(self.offsets[first]))
        total, parts = int(self.starts[-1]), []
        for k in range(first, last + 1):
            count = min(self.block, total - k * self.block)
            low = int(self.offsets[k] - self.offsets[first])
            parts.append(unpack(data[low : low + int(self.offsets[k + 1] - self.offsets[k])], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """The tokenizer's ids, with a bounded memory of pieces between single spaces.

    The tokenizer cuts a text before such a space in any case, so the ids of a text are those of its pieces.
    A text that holds the string of an added token goes through the tokenizer as a whole, which takes it as that token.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = width(self.tokenizer.get_vocab_size())
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the sign of a space
        self.marks = dict(zip(_MARKS, self._each(list(_MARKS)), strict=True))
        self.first: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_spaces(self, pieces: list[str]) -> list[bytes]:
        """Ids of " " + piece for each piece, many in one call: an id that begins with a space begins a piece."""
        joined = [" " + " ".join(pieces[at : at + 2000]) for at in range(0, len(pieces), 2000)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        first = np.flatnonzero(self.opens[ids])
        if first.size != len(pieces):
            return self._each([" " + x for x in pieces])
        data, bounds = ids.tobytes(), (4 * np.concatenate([first, [ids.size]])).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self._by_pieces(texts)
        out = self._by_pieces(["" if k in set(whole) else t for k, t in enumerate(texts)])
        for k, ids in zip(whole, self._each([texts[k] for k in whole]), strict=True):
            out[k] = np.frombuffer(ids, "<u4")
        return out

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split(" ") if not _RUN.search(t) else _CUT.split(t) for t in texts]
        heads = [p.pop(0) for p in split]
        if len(self.first) > _CACHED // 4:
            self.first.clear()
        if len(self.other) > _CACHED:
            self.other.clear()
        new = list(set(heads).difference(self.first))
        self.first.update(zip(new, self._each(new), strict=True))
        passing = [x for x in new if len(x) > _LONGEST_CACHED]
        new = set().union(*split).difference(self.other)
        # the tokenizer parts a mark from the letters before it
        marked = [x for x in new if x[-1:] in self.marks and x[:-1].isalpha()]
        new = sorted(new.difference(marked).union(set(x[:-1] for x in marked).difference(self.other)))
        # pieces with a space inside or white space at an end would not stay apart in a joined text
        plain = [x for x in new if x and " " not in x and x.strip() == x]
        odd = [x for x in new if not x or " " in x or x.strip() != x]
        if plain:
            self.other.update(zip(plain, self._after_spaces(plain), strict=True))
        self.other.update(zip(odd, self._each([" " + x for x in odd]), strict=True))
        self.other.update((x, self.other[x[:-1]] + self.marks[x[-1]]) for x in marked)
        out = [np.frombuffer(b"".join([self.first[head], *map(self.other.__getitem__, p)]), "<u4") for head, p in zip(heads, split, strict=True)]
        for piece in passing:
            del self.first[piece]
        for piece in [*new, *marked]:
            if len(piece) > _LONGEST_CACHED:
                del self.other[piece]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _save(folder: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a repeated task leaves the same file."""
    system, path = fs.FileSystem.from_uri(folder)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{path}/{name}")


def _writer(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        part, number, size, docs, lists = None, 0, 0, [], []

        def flush():
            nonlocal number, size, docs, lists
            name = f"part-{part:08d}-{number:05d}.tok"
            _save(folder, name, dump(docs, lists, coder.bits))
            row = [[part], [number], [name], [len(docs)], [size]]
            number, size, docs, lists = number + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "name", "docs", "ids"])

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                coded = coder.encode([t or "" for t in rows.column("text").to_pylist()])
                for at, doc, ids in zip(rows.column("part").to_pylist(), rows.column("doc_id").to_pylist(), coded, strict=True):
                    if docs and (at != part or size >= FILE_IDS):
                        yield flush()
                    if at != part:
                        part, number = at, 0
                    docs.append(doc)
                    lists.append(np.concatenate([ids, np.array([end], np.uint32)]))
                    size += lists[-1].size
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 0) -> DataFrame:
    """Write the ids of every document, each with the end id, in ascending id order; returns the files.

    (part, number, name, docs, ids, start): the order of files is that of part and number; `start` is the
    number of ids in all files before. Null texts are empty; an empty table writes no file. Rows equal in id
    are ordered by text; rows without an id come last. `tokenizer` is a path that every executor can read.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    files = in_parts(docs).drop("tail").mapInArrow(_writer(folder, tokenizer, end), "part int, number int, name string, docs bigint, ids bigint")
    # a row per file of some MB
    before = Window.partitionBy(F.lit(0)).orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return written(files, "files").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_file(f"{path}/{name}") as source:
                    file = TokenFile.open(source)
                    ids = file.ids(0, int(file.starts[-1]))
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(file.starts[:-1], file.starts[1:], strict=True)]
                    docs = pa.array(file.docs, pa.int64(), mask=file.docs == _NO_ID)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(start + file.starts[:-1]), pa.array(np.diff(file.starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("name", "start").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_table(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Write the documents below the shared folder and read them back."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, folder, end), folder)
