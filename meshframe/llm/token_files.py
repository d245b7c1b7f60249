"""Token ids of documents as files of concatenated ids with Elias-Fano boundaries, a data source of Spark.

A file holds, all little-endian: the mark; the ids of its documents, one after another, in 2 or 4 bytes each; the ends of the
documents and then their doc_ids less the least one, as Elias-Fano sequences (see elias_fano); the footer. Nothing has a table of
64-bit offsets: a task that reads some documents selects their bounds from a few bytes and then reads just their ids.

Documents lie in ascending order of doc_id over all files. `index.json` lists the files of a finished write with the number of
documents and ids of each; a reader adds up what comes before. Files of tasks that failed, or were run twice, are not listed.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from meshframe.llm import elias_fano, store
from meshframe.llm.word_encoder import encoder

MARK, INDEX = b"TOKENS01", "index.json"
#: Bytes of an id, documents, ids, documents without doc_id (they come last), least and greatest doc_id.
FOOTER = struct.Struct("<QQQQqq")
#: Bytes of text for a file, files at most, and rows of the sample that places their bounds.
FILE_BYTES, MOST_FILES, SAMPLE = 64 << 20, 16_384, 100_000
#: Documents of a file at most (a fuller one is closed and the next begun), ids that a reading task and a batch aim at.
MOST_DOCUMENTS, READ_IDS, BATCH_IDS = 1 << 22, 8 << 20, 1 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _index(system, folder: str) -> list[dict]:
    with system.open_input_stream(f"{folder}/{INDEX}") as f:
        return json.loads(f.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    """The files of one task."""

    files: list[dict]


class _File:
    """One file while it is written: ids go to storage as they come, only the lengths are held."""

    def __init__(self, system, folder: str, part: int, number: int, width: int):
        self.name, self.part, self.number, self.width = f"ids-{part:06d}-{number:04d}-{uuid.uuid4().hex[:12]}", part, number, width
        self.out = system.open_output_stream(f"{folder}/{self.name}")
        self.out.write(MARK)
        self.lengths: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.documents = self.unnamed = 0

    def add(self, keys: pa.Array, ids: pa.Array) -> None:
        """Documents in their order, those without doc_id last."""
        bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        self.out.write(ids.buffers()[2][bounds[0] : bounds[-1]])
        self.lengths.append(np.diff(bounds) // self.width)
        self.keys.append(keys.drop_null().to_numpy())
        self.documents += len(ids)
        self.unnamed += keys.null_count

    def close(self) -> dict:
        ends = np.cumsum(np.concatenate(self.lengths)).astype(np.uint64)
        keys = np.concatenate(self.keys)
        least, most = (int(keys[0]), int(keys[-1])) if len(keys) else (0, 0)
        self.out.write(elias_fano.dump(ends))
        self.out.write(elias_fano.dump(keys.view(np.uint64) - np.uint64(least % (1 << 64))))
        self.out.write(FOOTER.pack(self.width, self.documents, int(ends[-1]), self.unnamed, least, most))
        self.out.close()
        return {"part": self.part, "number": self.number, "name": self.name, "documents": self.documents, "ids": int(ends[-1])}


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.width, self.most = options["path"], int(options["width"]), int(options.get("documents", MOST_DOCUMENTS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        files: list[dict] = []
        now: _File | None = None
        for batch in iterator:
            part, key, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "doc_id", "ids"))
            numbers = part.to_numpy()
            for own in map(int, np.unique(numbers)):  # rows of a part lie together
                lo, hi = np.searchsorted(numbers, own), np.searchsorted(numbers, own, "right")
                while lo < hi:
                    if now and (now.part != own or now.documents >= self.most):
                        files.append(now.close())
                        now = None
                    if not now:
                        now = _File(system, folder, own, sum(f["part"] == own for f in files), self.width)
                    step = min(hi - lo, self.most - now.documents)
                    now.add(key.slice(lo, step), ids.slice(lo, step))
                    lo += step
        if now:
            files.append(now.close())
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the files of the tasks that count: one small record a file."""
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["part"], f["number"]))
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        try:
            before = _index(system, folder)
        except FileNotFoundError:
            before = []
        with system.open_output_stream(f"{folder}/{INDEX}") as out:
            out.write(json.dumps({"width": self.width, "files": files}).encode())
        for f in before:
            system.delete_file(f"{folder}/{f['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _filesystem(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{folder}/{f['name']}")


@dataclass
class Documents(InputPartition):
    """Documents first to stop - 1 of a file; the ids of all files before it."""

    name: str
    before: int
    first: int
    stop: int

    def __init__(self, name: str, before: int, first: int, stop: int):
        self.name, self.before, self.first, self.stop = name, before, first, stop
        super().__init__((name, first))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.raw = options["path"], options.get("raw", "false").lower() == "true"

    def partitions(self) -> list[Documents]:
        system, folder = _filesystem(self.path)
        out, before = [], 0
        for f in _index(system, folder):
            pieces = min(f["documents"], max(1, -(-f["ids"] // READ_IDS)))
            cuts = [f["documents"] * i // pieces for i in range(pieces + 1)]
            out += [Documents(f["name"], before, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            before += f["ids"]
        return out

    def read(self, partition: Documents | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, folder = _filesystem(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as f:
            yield from (self._batch(*x) for x in _documents(f, partition.first, partition.stop, partition.before))

    def _batch(self, keys: pa.Array, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        ids = ids.astype("<u4", copy=False)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        if self.raw:
            column = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(ids)])
        else:
            column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
        return pa.record_batch({"doc_id": keys, "start": pa.array(starts), "n_tokens": pa.array(lengths), "ids": column})


def _documents(f, first: int, stop: int, before: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, starts, lengths and ids of the documents first to stop - 1 of an open file, about BATCH_IDS ids at a time."""
    size = f.size()
    width, n, total, unnamed, least, most = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
    if f.read_at(len(MARK), 0) != MARK:
        raise ValueError("this is not a file of token ids")
    own = lambda at: lambda offset, count: f.read_at(count, at + offset)
    at = len(MARK) + total * width
    ends = elias_fano.Sequence(n, total, own(at))
    keys = elias_fano.Sequence(n - unnamed, most - least, own(at + ends.at.size))
    start = int(ends.values(first - 1, first)[0]) if first else 0
    for lo in range(first, stop, elias_fano.BLOCK):
        hi = min(stop, lo + elias_fano.BLOCK)
        bounds = np.concatenate(([start], ends.values(lo, hi).astype(np.int64)))
        start, a = int(bounds[-1]), 0
        while a < hi - lo:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BATCH_IDS, "right")) - 1)
            known = keys.values(min(lo + a, n - unnamed), min(lo + b, n - unnamed)) + np.uint64(least % (1 << 64))
            names = pa.concat_arrays([pa.array(known.view(np.int64)), pa.nulls(b - a - len(known), pa.int64())])
            raw = f.read_at(int(bounds[b] - bounds[a]) * width, len(MARK) + int(bounds[a]) * width)
            yield names, bounds[a:b] + before, np.diff(bounds[a : b + 1]), np.frombuffer(raw, f"<u{width}")
            a = b


class TokenFiles(DataSource):
    """Options: path; width, bytes of an id, in writing; raw, in reading: ids are bytes of little-endian unsigned 32-bit integers, not an array."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return f"doc_id long, start long, n_tokens long, ids {'binary' if self.options.get('raw', 'false').lower() == 'true' else 'array<int>'}"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def _encoded(batches: Iterator[pa.RecordBatch], spec, kind: str, special_as_text: bool, end: bytes, bounds: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Part, doc_id, order and ids of each document. Rows alike in doc_id and text may go to any part between equal bounds."""
    own = encoder(spec.value, kind, special_as_text)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = batch.slice(lo, 256)
            keys, orders, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2)
            part = []
            for i, (k, h) in enumerate(zip(keys, orders, strict=True)):
                key = (k is None, k or 0, h)
                left = bisect.bisect_left(bounds, key)
                ties = bisect.bisect_right(bounds, key, left) - left
                part.append(left + (i % (ties + 1) if ties else 0))
            ids = pa.array([own.ids(t.as_py() or "") + end for t in texts], pa.binary())
            yield pa.record_batch({"part": pa.array(part, pa.int32()), "doc_id": rows.column(0), "rank": rows.column(1), "ids": ids})


def _bounds(docs: DataFrame, file_bytes: int) -> list[tuple]:
    """Upper bounds of all parts but the last, so that each has about file_bytes bytes of text, by a bounded sample of (doc_id, rank)."""
    n = docs.count()
    share = min(1.0, SAMPLE / max(n, 1))
    some = docs.select("doc_id", "rank", (F.coalesce(F.octet_length("text"), F.lit(0)) + 4).alias("weight"))
    some = (some.sample(share, 7) if share < 1 else some).limit(2 * SAMPLE).toArrow().to_pylist()
    some = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["rank"], r["weight"]) for r in some)
    upto = np.cumsum([r[3] for r in some], dtype=float)
    files = int(min(MOST_FILES, len(some), max(1, -(-upto[-1] / share // file_bytes)))) if some else 1
    return [some[i][:3] for i in np.searchsorted(upto, upto[-1] * np.arange(1, files) / files)] if files > 1 else []


def write(docs: DataFrame, tokenizer: str, path: str, *, end: int, special_as_text: bool = False, file_bytes: int = FILE_BYTES) -> None:
    """Writes the token ids of docs (doc_id, an integer, and text) to files in the folder path, by a file of the tokenizers library.

    Every text is encoded whole, without the tokens that the file would add around it, and the id `end` is appended. Documents lie in
    ascending order of doc_id, rows of one doc_id by a hash of their texts, rows without doc_id last. Null and empty texts have
    only the end; repeated rows stay; an empty table gives an index without files; other columns aren't read. Strings of special tokens
    in a text are these tokens, or with special_as_text plain text. A folder that was written before has only the new documents.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    known = json.loads(spec)
    largest = max([end, *known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens") or [])])
    width = 2 if largest < 1 << 16 else 4
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rank"), "text")
    bounds = _bounds(rows, file_bytes)
    make = partial(_encoded, spec=spark.sparkContext.broadcast(spec), kind=f"<u{width}", special_as_text=special_as_text, end=np.array([end], f"<u{width}").tobytes(), bounds=bounds)
    found = rows.mapInArrow(make, "part int, doc_id long, rank long, ids binary")
    dealt = found.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_last("doc_id"), "rank")
    dealt.select("part", "doc_id", "ids").write.format(TokenFiles.name()).mode("overwrite").option("width", width).save(path)


def read(spark: SparkSession, path: str, *, raw: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the folder: start counts the ids of all documents before, ids are an array, or with raw bytes."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(TokenFiles.name()).option("raw", str(raw).lower()).load(path)
