"""Rows whose key other rows have too, by one exchange: the exact second filter where a sketch has no room for all keys.

Each task folds its rows first: of a key that it meets more than once it sends one row on, and its owners as they are.
A key that a third of all rows hold is thus one row for each task's buffer. Then equal keys lie next to each other in sorted
partitions, read as a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshframe.llm.words import mix

BUFFER = 1 << 20
SCHEMA = "key long, owner long, place long, sure boolean"
Triples = tuple[np.ndarray, np.ndarray, np.ndarray]


def _batch(key: np.ndarray, owner: np.ndarray, place: np.ndarray, sure: bool) -> pa.RecordBatch:
    return pa.record_batch({"key": pa.array(key.view(np.int64)), "owner": pa.array(owner), "place": pa.array(place), "sure": pa.array(np.full(len(key), sure))})


def _folded(parts: list[Triples], apart: bool) -> Iterator[pa.RecordBatch]:
    key, owner, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, owner, key))
    key, owner, place = key[order], owner[order], place[order]
    if apart:
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        key, owner, place = key[new], owner[new], place[new]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    yield _batch(key[first], owner[first], place[first], False)
    size = np.diff(np.append(first, len(key)))
    again = np.repeat(size > 1, size)
    owner, place = owner[again], place[again]
    if len(owner):
        both = np.unique(np.stack((owner, place)), axis=1)
        yield _batch(mix(mix(both[0].view(np.uint64), 3) + both[1].view(np.uint64), 4), both[0], both[1], True)


def _sent(batches: Iterator[pa.RecordBatch], triples: Callable[[Iterator[pa.RecordBatch]], Iterator[Triples]], apart: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in triples(batches):
        held.append(part)
        size += len(part[0])
        if size >= BUFFER:
            yield from _folded(held, apart)
            held, size = [], 0
    if size:
        yield from _folded(held, apart)


def _met(batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[pa.RecordBatch]:
    """Owners and places of sorted rows that have the key of a neighbour, another owner's if apart."""
    last: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = batch if last is None else pa.concat_batches([last, batch])
        key, owner, place, sure = (joined.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        same = key[1:] == key[:-1]
        if apart:
            same &= owner[1:] != owner[:-1]
        hit = sure.astype(bool)
        hit[1:] |= same
        hit[:-1] |= same
        last = joined.slice(joined.num_rows - 1)  # it meets the next batch too
        yield pa.record_batch({"owner": pa.array(owner[hit]), "place": pa.array(place[hit])})


def repeated(df: DataFrame, triples: Callable[[Iterator[pa.RecordBatch]], Iterator[Triples]], *, apart: bool = False) -> DataFrame:
    """Distinct (owner, place) of the (key, owner, place) that `triples` makes of df's batches and whose key comes again; with apart, under another owner (an owner has each key once, or at any of its places)."""
    sent = df.mapInArrow(partial(_sent, triples=triples, apart=apart), SCHEMA)
    return sent.repartition("key").sortWithinPartitions("key", "owner").mapInArrow(partial(_met, apart=apart), "owner long, place long").distinct()
