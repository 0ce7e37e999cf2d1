"""Token ids packed to fixed-length rows by best-fit decreasing.

Documents are tokenised (byte-level BPE from a vocabulary file), an end id is added, and documents
longer than a row are cut into row-long pieces that lose nothing. Within a block of about BLOCK_TOKENS tokens
(or one longer document) the pieces go, longest first, to the open row with the least sufficient
room, which a segment tree over the capacities finds in log steps; without one, a row is opened.

Blocks lie within input partitions: nothing is shuffled, and a lost task repeats its partition. Memory is bounded by bytes: a
block holds BLOCK_TOKENS tokens in at most BLOCK_PIECES pieces as flat arrays (and one longer text), remembered words
take CACHE_BYTES, rows leave in batches of about OUT_BYTES. Each output row holds the padded ids and the positions (restarting
at every segment) as little-endian 16-bit arrays, the cumulative segment lengths, and for each
segment its document and its first token's place there, by which the documents can be put together again.

Defined cases: a null or empty text gives no segment; a long text without spaces is one word, which is not remembered; repeated rows are packed each; a null id is kept as null.
Of an empty table the result is empty. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import register, text_of
from memlake.sources.tables import read_table

#: Vocabulary file (ranks of byte-level BPE), its pre-token pattern and the free id that ends a document (fixed values).
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
#: Tokens in a row.
ROW_TOKENS = 2048
#: Tokens that are packed together, about.
BLOCK_TOKENS = 1 << 21
#: Pieces that are packed together, at most (a text that begins below the bound is taken whole).
BLOCK_PIECES = 100_000
#: Bytes of the words whose ids a worker remembers, about; longer words are not remembered; overhead of an entry.
CACHE_BYTES, CACHED_CHARS, ENTRY_BYTES = 32 << 20, 64, 200
#: Bytes of packed rows that leave a task together, about.
OUT_BYTES = 4 << 20

SCHEMA = ("pack_id bigint, input_ids binary, position_ids binary, cu_seqlens array<int>, "
          "doc_ids array<bigint>, doc_starts array<int>, n_tokens int")


class _Words(dict):
    """The packed ids of a word behind a space; what is not remembered is worked out."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.bytes = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(word) <= CACHED_CHARS and self.bytes < CACHE_BYTES:
            self.bytes += ENTRY_BYTES + len(word) + len(ids)
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def make_encoder(ranks: bytes) -> Callable[[str], np.ndarray]:
    """text -> ids, one encoder (and its remembered words) a worker. A single space always begins a pre-token, so words are encoded apart; texts with
    neighbouring, leading or trailing spaces are encoded whole."""
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def packed(text: str) -> bytes:
        return array("H", bpe.encode_ordinary(text)).tobytes()
    words = _Words(packed)

    def encode(text: str) -> np.ndarray:
        parts = text.split(" ")
        if "" in parts:
            raw = packed(text)
        else:
            raw = packed(parts[0]) + b"".join(map(words.__getitem__, parts[1:]))
        return np.frombuffer(raw, np.uint16)
    return encode


class BestFit:
    """Open rows by room left; `place` takes the fullest row that still has room."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)  # open rows below each node
        self.rows: list[list[int]] = []  # pieces of each row
        self.open: list[list[int]] = [[] for _ in range(size + 1)]  # rows by room

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def _least(self, room: int) -> int:
        """The least capacity of at least `room` with an open row, or -1."""
        i = room + self.leaves
        if self.tree[i]:
            return room
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def place(self, piece: int, length: int) -> None:
        room = self._least(length)
        if room < 0:
            self.rows.append([])
            row, room = len(self.rows) - 1, self.size
        else:
            row = self.open[room].pop()
            self._add(room, -1)
        self.rows[row].append(piece)
        if room > length:
            self.open[room - length].append(row)
            self._add(room - length, 1)


def pack(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: for each row the numbers of its pieces; equal lengths keep their order."""
    fit = BestFit(size)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit.place(i, lengths[i])
    return fit.rows


class _Block:
    """Pieces of documents in flat arrays."""

    def __init__(self):
        self.ids, self.lengths, self.docs, self.starts = array("H"), array("i"), array("q"), array("i")
        self.no_doc = bytearray()  # 1: the document has no id

    def add(self, doc: int | None, ids: np.ndarray, size: int) -> None:
        self.ids.frombytes(ids.tobytes())
        for at in range(0, len(ids), size):
            self.lengths.append(min(size, len(ids) - at))
            self.docs.append(doc or 0)
            self.starts.append(at)
            self.no_doc.append(doc is None)

    def batches(self, size: int, pad: int, first: int) -> Iterator[pa.RecordBatch]:
        """The packed rows, numbered from `first`."""
        ids = np.frombuffer(self.ids, np.uint16)
        lengths = np.frombuffer(self.lengths, np.int32)
        ends = np.cumsum(lengths, dtype=np.int64)
        docs, starts, no_doc = np.frombuffer(self.docs, np.int64), np.frombuffer(self.starts, np.int32), np.frombuffer(self.no_doc, bool)
        rows, held = [], 0
        packed = pack(lengths.tolist(), size)
        for n, members in enumerate(packed):
            rows.append(members)
            held += 4 * size + 16 * len(members)
            if held >= OUT_BYTES or n == len(packed) - 1:
                yield self._batch(rows, size, pad, first + n + 1 - len(rows), ids, lengths, ends, docs, starts, no_doc)
                rows, held = [], 0

    @staticmethod
    def _batch(rows, size, pad, first, ids, lengths, ends, docs, starts, no_doc) -> pa.RecordBatch:
        out, places, cu = np.full((len(rows), size), pad, "<u2"), np.zeros((len(rows), size), "<u2"), []
        for r, members in enumerate(rows):
            at = np.concatenate([[0], np.cumsum(lengths[members])])
            out[r, :at[-1]] = np.concatenate([ids[ends[i] - lengths[i]:ends[i]] for i in members])
            places[r, :at[-1]] = np.arange(at[-1]) - np.repeat(at[:-1], lengths[members])
            cu.append(at.astype(np.int32))
        flat, sizes = np.concatenate(rows), np.array([len(m) for m in rows])
        cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)

        def lists(values, offsets):
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        return pa.RecordBatch.from_arrays([
            pa.array(np.arange(first, first + len(rows))), pa.array([r.tobytes() for r in out], pa.binary()), pa.array([r.tobytes() for r in places], pa.binary()),
            lists(pa.array(np.concatenate(cu)), cut + np.arange(len(rows) + 1)), lists(pa.array(docs[flat], mask=no_doc[flat]), cut),
            lists(pa.array(starts[flat]), cut), pa.array([c[-1] for c in cu], pa.int32())], names=[c.split()[0] for c in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                   size: int = ROW_TOKENS, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed row of `size` tokens (columns: SCHEMA). The driver reads the vocabulary file."""
    if not 1 <= size <= 1 << 16:
        raise ValueError("a row has 1 to 65536 tokens")
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(ranks.value)
        serial = TaskContext.get().partitionId() << 33
        block = _Block()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("body"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                block.add(doc.as_py(), np.append(encode(text), np.uint16(end_id)), size)
                if len(block.ids) >= block_tokens or len(block.lengths) >= BLOCK_PIECES:
                    for out in block.batches(size, end_id, serial):
                        serial += out.num_rows
                        yield out
                    block = _Block()
        if block.lengths:
            yield from block.batches(size, end_id, serial)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("body")).mapInArrow(run, SCHEMA)


@register("op3_token_packing")
def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
