"""Packing by power-of-two decomposition.

A document of n tokens is cut into full pieces of the longest length and then
pieces of the binary digits of the rest, longest first. Every piece is a whole
sequence of a power-of-two length, so nothing is padded and no sequence crosses
documents; pieces of a length share a bucket. One map over the text, no shuffle.

Tokens: white space separates chunks that the tokenizer treats independently, so
each distinct chunk of a slice is encoded once and remembered in a bounded table.
The rest is array gathering.

A null text is an empty one: it has the closing id alone. Repeated rows are packed
each on its own (sequence ids differ). Extra columns do not take part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, slices, tidy

LONGEST = 4096
CLOSING_ID = 2
#: Chunks a worker remembers; the table is emptied beyond it.
REMEMBERED = 400_000
#: Bytes of text encoded together: more text has fewer distinct chunks to its size.
ENCODED_BYTES = 2 << 20
#: Stands between chunks that are encoded in one call.
MARK = "\x01"

_loaded: dict[str, tuple] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of texts by a tokenizer that drops white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark_ids = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._forget()

    @classmethod
    def of(cls, path: str) -> "ChunkEncoder":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks in one call, with a mark between; a chunk that holds the mark goes alone."""
        if len(self.mark_ids) != 1 or any(MARK in x for x in chunks):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64)
        texts = [f" {MARK} ".join(chunks[i : i + 2000]) + f" {MARK}" for i in range(0, len(chunks), 2000)]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark_ids[0])
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def encode(self, texts: pa.Array, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another, and how many each text has."""
        chunks = pc.split_pattern(_spaced(texts), " ")
        per_text = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary
        if len(self.known) > remembered:
            self._forget()
        words = distinct.to_pylist()
        place = np.array([self.known.get(x, -1) for x in words], dtype=np.int64)
        if len(new := np.flatnonzero(place < 0)):
            flat, sizes = self._encode_new([words[i] for i in new])
            place[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.known.update(zip([words[i] for i in new], place[new].tolist(), strict=True))
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        codes = place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64)
        sizes = self.sizes[codes]
        ids = self.flat[ragged((np.cumsum(self.sizes) - self.sizes)[codes], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


def _spaced(texts: pa.Array) -> pa.Array:
    out = texts.fill_null("")
    for c in "\t\n\r":
        out = pc.replace_substring(out, c, " ")
    return out


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Full pieces, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(path: str, keep: list[str], longest: int, with_ids: bool, remembered: int, encoded_bytes: int = ENCODED_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(path)
        for whole in batches:
            for batch in slices(whole, "__text", encoded_bytes):
                ids, counts = encoder.encode(batch.column("__text"), remembered)
                owner, start, length, crc, total, tokens, at = [], [], [], [], [], [], 0
                for i, n in enumerate(counts.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(CLOSING_ID)).astype("<u4")
                    at += n
                    begin = 0
                    for size in piece_lengths(n + 1, longest):
                        piece = own[begin : begin + size]
                        owner.append(i)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(n + 1)
                        if with_ids:
                            tokens.append(piece.astype(np.int32))
                        begin += size
                taken = pa.array(owner, pa.int32())
                arrays = [batch.column(c).take(taken) for c in keep] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                names = [*keep, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, longest: int = LONGEST, with_ids: bool = False, remembered: int = REMEMBERED, encoded_bytes: int = ENCODED_BYTES) -> DataFrame:
    """One row per piece: where it lies in its document, its sequence, and `bucket` (log2 of the length).

    with_ids: also `ids`, the piece's tokens, for write_buckets(). remembered: chunks that a worker keeps, about 200
    bytes each; more of them save time where the worker has the memory. encoded_bytes: of text, encoded together; less of it
    takes less memory. Neither changes the result.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    given = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + ["start long, length long, ids_crc32 long, doc_tokens long"] + ["ids array<int>"] * with_ids)
    return (
        given.mapInArrow(tidy(_packer(path or tokenizer_path(), list(keep), longest, with_ids, remembered, encoded_bytes)), schema)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumn("bucket", F.log2("length").cast("int"))
    )


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """One folder of Parquet per piece length: a batch reader takes equal lengths only."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(folder)
