"""Byte-level BPE by a sentencepiece model that is written straight from a rank vocabulary.

Each entry's bytes are mapped to printable characters (the usual byte alphabet), its score is
minus its rank, and the normaliser is the identity; sentencepiece's merge rule (best score
first, leftmost on ties) is then the rank rule. Texts are cut into pre-tokens, each distinct
pre-token of a slice is encoded once, and decoding maps the pieces back to bytes.

Encoding is a map over rows: no shuffle, memory bounded by a slice of rows and a bounded cache.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Distinct pre-tokens that a task remembers at most, of at most CACHE_CHARS characters each.
CACHE_ROWS = 60_000
CACHE_CHARS = 32
#: New pre-tokens that go to the processor at once.
BATCH = 20_000


def byte_alphabet() -> list[str]:
    """One printable character per byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One field of a protocol-buffer message, by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece comes last."""
    alphabet = byte_alphabet()
    order = sorted(ranks, key=ranks.get)
    if [ranks[b] for b in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte must be in the vocabulary")
    pieces = b"".join(
        _field(1, _field(1, "".join(alphabet[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, token in enumerate(order)
    )
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return pieces + _field(2, trainer) + _field(3, normaliser)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base-64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def _processor(path: str):
    """The processor and the byte table; once per worker process."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(load_ranks(path)))
    return processor, {b: c for b, c in enumerate(byte_alphabet())}


@lru_cache(maxsize=1)
def _pieces(path: str):
    """The bytes of each id, as an Arrow array: the processor's pieces, mapped back."""
    import pyarrow as pa

    processor, table = _processor(path)
    inverse = {ord(c): b for b, c in table.items()}
    return pa.array([bytes(processor.id_to_piece(i).translate(inverse), "latin-1") for i in range(len(processor) - 1)], pa.binary())


def mapped(token: str, table: dict) -> str:
    """The token's bytes in the byte alphabet."""
    if token.isascii() and token.isprintable():
        return token.replace(" ", table[0x20])
    return token.encode().decode("latin-1").translate(table)


def _encoder(path: str, pattern: str, back: bool):
    def make():
        import pyarrow as pa
        import regex

        processor, table = _processor(path)
        cut = regex.compile(pattern).findall
        known: dict[str, bytes] = {}

        def encoded(tokens):
            for i in range(0, len(tokens), BATCH):
                part = tokens[i : i + BATCH]
                for token, ids in zip(part, processor.encode([mapped(t, table) for t in part], num_threads=1), strict=True):
                    yield token, np.array(ids, np.int32).tobytes()

        def run(texts):
            cut_texts = [cut(t) for t in texts]
            fresh = [t for t in set(chain.from_iterable(cut_texts)) if t not in known]
            if len(known) + len(fresh) > CACHE_ROWS:
                known.clear()
                fresh = list(set(chain.from_iterable(cut_texts)))
            known.update(encoded(fresh))
            ids = [b"".join(map(known.__getitem__, tokens)) for tokens in cut_texts]
            del cut_texts
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            for t in [t for t in fresh if len(t) > CACHE_CHARS]:
                del known[t]
            if len(known) > CACHE_ROWS:  # a slice of more distinct pre-tokens than are kept
                known.clear()
            made = [pa.ListArray.from_arrays(pa.array(offsets), flat)]
            return [*made, _bytes_of(flat, offsets, _pieces(path))] if back else made

        return run

    return make


def _bytes_of(ids, offsets: np.ndarray, pieces):
    """Bytes of the ids between each two ``offsets``; the pieces that are taken stand one after the other."""
    import pyarrow as pa

    if len(ids) == 0:
        return pa.array([b""] * (len(offsets) - 1), pa.binary())
    taken = pieces.take(ids)
    at = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at[offsets].tobytes()), taken.buffers()[2]])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None, back: bool = False) -> DataFrame:
    """``docs`` (its ``carry`` columns) with ``ids`` (array<int>), each match of ``pattern`` encoded alone.

    With ``back`` also with ``decoded`` (binary), the ids decoded again as ``decode`` does, in the same pass.

    Null texts are encoded as empty (no ids). Every row stands for itself, so repeated rows, ties
    and null ids need no rule; an empty table gives an empty table; extra columns pass through,
    but for those named like a new one, which gives way.
    """
    return map_rows(docs, _encoder(path, pattern, back), "ids array<int>" + (", decoded binary" if back else ""), [text_col], carry, chars=1_000_000)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ids, joined. Null ids decode to null."""

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            ids = frame.column(0)
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            sizes = np.array([0 if x is None else x for x in ids.value_lengths().to_pylist()], np.int64)
            made = _bytes_of(ids.flatten().cast(pa.int32()), np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), _pieces(path))
            made = pa.array([x if ok else None for x, ok in zip(made.to_pylist(), ids.is_valid().to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*frame.columns[1:], made], names=[*frame.schema.names[1:], "decoded"])

    names = [c for c in encoded.columns if c != "decoded"]
    given = encoded.select(F.col(f"`{ids_col}`").alias("i"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    ddl = T.StructType([*(T.StructField(f"c{k}", encoded.schema[c].dataType) for k, c in enumerate(names)), T.StructField("decoded", T.BinaryType())])
    return given.mapInArrow(run, ddl).toDF(*names, "decoded")


def bpe_digest(decoded: DataFrame, id_col: str = "doc_id", carry: tuple | list = ()) -> DataFrame:
    """Counts and digests of ``encode(docs, back=True)`` or ``decode(encode(docs))``."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *carry,
    )
