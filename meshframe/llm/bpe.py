"""Byte-level BPE through sentencepiece: a model serialised straight from a vocabulary of ranks.

Each byte becomes one character, each vocabulary entry a piece scored by its negative rank, under identity
normalisation: sentencepiece then merges the pair of the best score, leftmost first, which is the pair of
the least rank. Texts are split by a pattern and each match is encoded separately; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshframe.llm import store

#: Byte b is the character of this number plus b: letters without white space, marks or normal forms that matter here.
FIRST = 0x100
_TO_CHARS = {b: FIRST + b for b in range(256)}
#: Pre-tokens kept with their ids in each worker, and the longest one kept.
CACHE, LONGEST = 400_000, 48


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def chars(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 entry and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece 0 is the unknown one, piece i + 1 the entry of the i-th rank."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no entry for the bytes {missing[:5]}: texts could not be decoded")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    entries = sorted(ranks.items(), key=lambda x: x[1])
    pieces = b"".join([piece("<unk>", 0.0, 2), *(piece(chars(raw), float(-rank), 1) for raw, rank in entries)])
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, 0) + b"".join(_field(i, (1 << 64) - 1) for i in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with a model, as made in each worker from the broadcast bytes."""

    def __init__(self, proto: bytes, numbers: list[int], pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.rank = [-1, *numbers]
        back = {FIRST + b: b for b in range(256)}
        raw = [b"", *(self.sp.id_to_piece(i).translate(back).encode("latin-1") for i in range(1, len(self.rank)))]
        self.whole = {x: str(self.rank[i]) for i, x in enumerate(raw) if i}
        self.bytes = {str(self.rank[i]): x for i, x in enumerate(raw) if i}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, str] = {}

    def ids(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        tokens = self.split(text)
        known = self.known
        try:
            return ",".join(map(known.__getitem__, tokens))
        except KeyError:
            pass
        new = list({t for t in tokens if t not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(set(tokens))
        got, hard = {}, []
        for t in new:
            own = self.whole.get(t.encode())  # an entry as a whole is its own id, before any merge
            if own is None:
                hard.append(t)
            else:
                got[t] = own
        for t, pieces in zip(hard, self.sp.encode([chars(t.encode()) for t in hard], out_type=int, num_threads=1), strict=True):
            got[t] = ",".join([str(self.rank[i]) for i in pieces])
        known.update((t, x) for t, x in got.items() if len(t) <= LONGEST)
        return ",".join([known[t] if t in known else got[t] for t in tokens])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[str, Codec] = {}


def _codec(model, pattern: str) -> Codec:
    proto, numbers = model.value
    key = hashlib.md5(proto).hexdigest() + pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(proto, numbers, pattern)
    return _codecs[key]


def broadcast_model(df: DataFrame, path: str):
    """The serialised model for the workers: a vocabulary's size, whatever the input."""
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast((model_proto(ranks), sorted(ranks.values())))


def _encoded(batches: Iterator[pa.RecordBatch], model, pattern: str, names: list[str], ids: bool, digests: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec(model, pattern)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = [codec.ids(t.as_py() or "") for t in part.column(part.schema.get_field_index("text"))]
            out = {c: part.column(part.schema.get_field_index(c)) for c in names}
            out["n_tokens"] = pa.array([x.count(",") + 1 if x else 0 for x in found], pa.int64())
            if ids:
                out["ids"] = pa.array([np.fromstring(x, np.int32, sep=",") for x in found], pa.list_(pa.int32()))
            if digests:
                out["ids_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in found], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)


def _decoded(batches: Iterator[pa.RecordBatch], model, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(model, pattern)
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        raw = [codec.decode(",".join(map(str, x.as_py() or []))) for x in batch.column(at)]
        yield batch.append_column("decoded", pa.array(raw, pa.binary()))


_NEW = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")


def _with_tokens(docs: DataFrame, path: str, pattern: str, ids: bool, digests: bool, new: str) -> DataFrame:
    docs = store.without(docs, *_NEW)
    names, docs = docs.columns, store.plain(docs)
    make = partial(_encoded, model=broadcast_model(docs, path), pattern=pattern, names=docs.columns, ids=ids, digests=digests)
    return store.named(docs.mapInArrow(make, store.extended(docs, new)), names)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of docs (with a string column text), then n_tokens and ids, an array of ranks.

    Null and empty texts have no ids. Columns of docs that clash with the new ones are replaced. Repeated rows
    stay; an empty table gives an empty table. A text of any length is encoded whole.
    """
    return _with_tokens(docs, path, pattern, True, False, "n_tokens long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str = "") -> DataFrame:
    """The columns of df (with ids), then decoded, the bytes; null ids give no bytes. An id that is not in the vocabulary is an error."""
    df = store.without(df, "decoded")
    names, df = df.columns, store.plain(df)
    return store.named(df.mapInArrow(partial(_decoded, model=broadcast_model(df, path), pattern=pattern), store.extended(df, "decoded binary")), names)


def round_trip(docs: DataFrame, path: str, pattern: str, *, ids: bool = False) -> DataFrame:
    """The columns of docs, then n_tokens, the ids if asked for, and SHA-256 of the ids and of what they decode to. Cases as in encode."""
    return _with_tokens(docs, path, pattern, ids, True, f"n_tokens long, {'ids array<int>, ' if ids else ''}ids_sha256 string, decoded_sha256 string")
