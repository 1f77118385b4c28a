"""Best-fit packing of tokenised documents into sequences.

Bounded-space online best-fit: a fixed number of bins is open, kept in stacks by free space, with a bitset of the free
spaces that occur.  A piece goes to the bin with the least space that holds it, found by the lowest bit of the shifted
bitset; where none does, a bin opens, and beyond the fixed number the fullest closes first.

Texts are tokenised and cut where they are read, and only their pieces' places and lengths are written.  The pieces are
packed from there, in tasks of about ``PIECES`` of them or more, however the texts were split: the bins that a task leaves open
at its end are few beside those that it has filled.  Nothing is shuffled, and no bin is opened beyond the bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table, text_docs

CAPACITY = 2048
OPEN_BINS = 1024
#: Id that ends a document.
END = 0
#: Pieces that a task packs, about.
PIECES = 150_000


class Packer:
    """Bounded-space best-fit.  ``add`` and ``finish`` yield closed bins as lists of (item, offset)."""

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, bins
        self.by_space: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open = 0, 0

    def _take(self, space: int) -> list:
        own = self.by_space[space].pop()
        if not self.by_space[space]:
            self.bits ^= 1 << space
        return own

    def _keep(self, space: int, own: list) -> None:
        self.by_space[space].append(own)
        self.bits |= 1 << space

    def add(self, item: object, length: int) -> Iterator[list]:
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            own = self._take(space)
        else:
            space, own = self.capacity, []
            self.open += 1
        own.append((item, self.capacity - space))
        if space == length:
            self.open -= 1
            yield own
        else:
            self._keep(space - length, own)
        if self.open > self.limit:
            self.open -= 1
            yield self._take((self.bits & -self.bits).bit_length() - 1)

    def finish(self) -> Iterator[list]:
        for own in (own for stack in self.by_space for own in stack):
            yield own
        self.__init__(self.capacity, self.limit)


@lru_cache(4)
def encoder(name: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """Ids of a text under a public byte-level BPE vocabulary, as ``tokenizers`` gives them without special tokens added.

    The same vocabulary as ranks is several times as fast in ``tiktoken``, with equal ids where both libraries cut
    texts alike.  Texts with a code point from U+0500 on (where their Unicode tables may differ) or with a special
    token's string go to ``tokenizers`` itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        if (len(data) and data.max() >= 0xD4) or any(s in text for s in special):  # 0xD4 leads U+0500
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECE = [("doc_id", "long", pa.int64()), ("piece", "int", pa.int32()), ("start", "long", pa.int64()), ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64())]
_PLACE = [("sequence_id", "long", pa.int64()), ("offset", "long", pa.int64())]
_IDS = ("ids", "array<int>", pa.list_(pa.int32()))


def _batch(rows: list[tuple], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, _, k) in zip(zip(*rows), columns)], names=[n for n, _, _ in columns])


def _schema(columns: list) -> str:
    return ", ".join(f"{n} {t}" for n, t, _ in columns)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids on request, of every piece of every text."""
    columns = [*_PIECE, *[_IDS] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), np.uint32(END)).astype("<u4", copy=False)
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc_id, piece, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] * with_ids)))
            yield _batch(rows, columns)

    return text_docs(docs).mapInArrow(run, _schema(columns))


def place(pieces: DataFrame, capacity: int = CAPACITY, bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with sequence_id and offset, by bounded-space best-fit in each of the frame's partitions."""
    with_ids = "ids" in pieces.columns
    columns = [*_PIECE, *_PLACE, *[_IDS] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, context = Packer(capacity, bins), TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns)):
                for own in packer.add(item, item[3]):
                    rows.extend((*x[:5], sequence, offset, *x[5:]) for x, offset in own)
                    sequence += 1
            if rows:
                yield _batch(rows, columns)
                rows.clear()
        for own in packer.finish():
            rows.extend((*x[:5], sequence, offset, *x[5:]) for x, offset in own)
            sequence += 1
            if len(rows) > 10_000:
                yield _batch(rows, columns)
                rows.clear()
        if rows:
            yield _batch(rows, columns)

    return pieces.mapInArrow(run, _schema(columns))


def pack(docs: DataFrame, capacity: int = CAPACITY, bins: int = OPEN_BINS, name: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """A row for every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids on request.

    Null texts count as empty and give the end id alone.  Repeated rows and rows without a doc_id are packed each.  Long
    texts are cut into full pieces behind a first one that may be shorter.  An empty table gives no rows; other columns
    are left out.
    """
    pieces = materialize(cut_pieces(docs, capacity, name, with_ids), "pieces")
    return place(pieces.coalesce(max(1, round(pieces.count() / PIECES))), capacity, bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves, from ``pack(..., with_ids=True)``; one row holds at most a sequence."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("x")).select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))


def op6(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
