"""Byte-level BPE. A piece's merges run on a segment tree over its byte positions whose root is the leftmost
pair of minimum rank; each merge makes at most three point updates of logarithmic cost."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded pieces that a worker remembers; the memory is emptied when full, results do not depend on it.
CACHE_PIECES = 400_000
#: Longer pieces are not remembered.
CACHE_BYTES = 64
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the lowest rank merges first, of equal ranks the leftmost."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    # leaf i stands for the pair that starts at byte i: rank << 32 | i, so that min() takes the leftmost
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours among the live tokens

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                break
            tree[k] = value

    while tree[1] < _NONE:
        i = tree[1] & 0xFFFFFFFF
        gone = after[i]
        end = after[gone]
        after[i] = end
        if gone < size:
            put(gone, _NONE)
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            put(i, _NONE if r is None else r << 32 | i)
        else:
            put(i, _NONE)
        if (left := before[i]) >= 0:
            r = get(piece[left:end])
            put(left, _NONE if r is None else r << 32 | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Maps a piece (str) to its ids as little-endian unsigned 32-bit integers; fills itself on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        ids = merge_piece(piece.encode(), self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_encoders: dict[tuple, Encoder] = {}


def _encoder(key: tuple, ranks: dict[bytes, int]) -> Encoder:
    """One for each worker process, kept between tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, key[1])
    return _encoders[key]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit, null unless keep_ids),
    ids_sha256, decoded_sha256. decoded_sha256 is taken from the bytes that the ids decode to.

    Null and empty texts have no tokens. Repeated rows give rows each; ids are whole numbers or null; an empty table gives no rows; other columns are
    not read. A very long text is encoded whole, its pieces one by one. The rank file is read by the driver
    and sent to the workers once: its size is that of the vocabulary, whatever the table's."""
    ranks = load_ranks(ranks_path)
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    key = (hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, held.value)
        for batch in batches:
            counts, ids, first, second = [], [], [], []
            for text in batch.column(1):
                packed = encoder.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(packed if keep_ids else None)
                first.append(hashlib.sha256(packed).hexdigest())
                second.append(hashlib.sha256(encoder.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded` (binary) to rows that hold packed ids; null ids decode to null."""
    held = rows.sparkSession.sparkContext.broadcast({r: t for t, r in load_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids_col))
            out = [None if not p.is_valid else b"".join(map(held.value.__getitem__, np.frombuffer(p.as_py(), "<u4").tolist())) for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_texts(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False).drop("ids")
