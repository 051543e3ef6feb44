"""Packing by power-of-two decomposition: pieces of binary lengths, each a sequence of its own."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

#: Letters for which the fast splitter is known to equal the tokenizer's: ASCII and the Latin letters up to U+017F.
_L = "A-Za-zÀ-ÖØ-öø-ſ"
_OTHER = re.compile(rf"[^\x20-\x7e\t\n\r{_L}]")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
CACHE_WORDS = 400_000
BUCKET_ROWS, BUCKET_TOKENS = 8192, 1 << 20  # a bucket of pieces goes out at so many rows or tokens


class Encoder:
    """Byte-level BPE: text -> little-endian 32-bit ids. Words' ids are kept, up to CACHE_WORDS of them.

    The strings of the tokenizer's added tokens have their own ids wherever they stand in a text, as the tokenizer gives them.
    """

    def __init__(self, ranks_path: str | None = None, tokens_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(tokens_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take part of the text around them aren't supported")
        self._added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self._split_added = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self._added, key=len, reverse=True)) or r"(?!)")
        self._encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._kept: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        for token in self._split_added.finditer(text):
            out += [self._plain(text[at : token.start()]), self._added[token[0]]]
            at = token.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def _plain(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self._ids(text)
        kept, out, words = self._kept, [], _SPLIT.finditer(text)
        while part := [m[0] for m in islice(words, 65_536)]:
            for w in set(part).difference(kept):
                kept[w] = self._ids(w)
            out.append(b"".join(map(kept.__getitem__, part)))
            if len(kept) > CACHE_WORDS:
                kept.clear()
        return b"".join(out)


def binary_pieces(tokens: int, most: int) -> list[tuple[int, int]]:
    """(start, length) that cut tokens into lengths that are powers of two, at most `most` (itself one), longest first."""
    out, at = [], 0
    while at < tokens:
        length = min(most, 1 << (tokens - at).bit_length() - 1)
        out.append((at, length))
        at += length
    return out


def pack(docs: DataFrame, text: str = "text", id_: str = "doc_id", most: int = 1024, end_id: int = 0, ranks_path: str | None = None, tokens_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of every document.

    A document is its ids and end_id. Each piece is a sequence by itself: its length is a power of two, so it needs no
    padding, and no sequence crosses documents. A task puts its pieces into one bucket for each length and gives out
    whole buckets, so that a batch of rows has one length; sequence_id is the bucket's number (the power of two, shortest
    first), the partition's and the place in that bucket, so ordering by it brings equal lengths together. Buckets that hold
    BUCKET_TOKENS go out, and all do at the partition's end: a task holds no more than one such bucket a length and a document's pieces.

    A null text is empty and gives one piece, its end_id. Repeated rows and repeated or null ids are packed like
    others. An empty table gives no rows. Nothing is shuffled.
    """
    if most < 1 or most & most - 1:
        raise ValueError("most must be a power of two")
    tune(docs.sparkSession)
    frame = docs.select(F.col(id_).alias("__id"), F.col(text).alias("__text"))
    fields = [T.StructField(id_, docs.schema[id_].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    tail = int(end_id).to_bytes(4, "little")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition = Encoder(ranks_path, tokens_path), TaskContext.get().partitionId()
        buckets: dict[int, list[tuple]] = {}
        ids: dict[int, list[np.ndarray]] = {}
        number: Counter = Counter()
        id_type = pa.null()
        for part in parts:
            id_type = part.schema.field(0).type
            for key, value in zip(part.column(0), part.column(1)):
                raw = encode(value.as_py() or "") + tail
                n, key = len(raw) // 4, key.as_py()
                for start, length in binary_pieces(n, most):
                    piece = raw[4 * start : 4 * (start + length)]
                    bucket = buckets.setdefault(length, [])
                    bucket.append((key, start, length, zlib.crc32(piece), n, (length.bit_length() - 1) << 58 | partition << 36 | number[length], 0))
                    number[length] += 1
                    if with_ids:
                        ids.setdefault(length, []).append(np.frombuffer(piece, "<i4"))
                    if len(bucket) >= BUCKET_ROWS or len(bucket) * length >= BUCKET_TOKENS:
                        yield _batch(bucket, ids.pop(length, []), id_, id_type, with_ids)
                        buckets[length] = []
        for length in sorted(buckets):
            if buckets[length]:
                yield _batch(buckets[length], ids.get(length, []), id_, id_type, with_ids)

    return frame.mapInArrow(run, schema)


def _batch(rows: list[tuple], ids: list[np.ndarray], id_: str, id_type: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
    if with_ids:
        ends = np.cumsum([0, *map(len, ids)])
        arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names=[id_, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, as a trainer with a fixed sequence length a step wants them; the pieces stay with their tasks."""
    pieces.write.partitionBy("length").parquet(path)
