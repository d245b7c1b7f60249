"""Substring dedup: words inside word windows that start more than once anywhere are removed.

Two merged sketches come first, both of them overestimates, so none is lost:

1. A window's anchor is the least hash of the short word runs inside it, the first of equal ones. Equal windows have
   equal anchors at different places. Anchor places are a small share of all windows; a window whose anchor has one
   place occurs once.
2. The windows left are counted themselves; a window whose cells hold one count occurs once.

The second pass groups exactly the windows that both sketches let through (96 bits of hashes), pre-aggregated by task.
Groups of one are the sketches' false positives: they come with their text and start, and are few, so only they
go back to the texts. Hot windows only ever meet in counts, and texts are shuffled only if the false positives are
too many to send to all tasks.

Sketches have a bounded size. Where the texts have more anchors than cells, the anchors' places go to an exact exchange instead of
the second sketch: texts are joined with the places of their repeated anchors, and only windows of these are grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import shared, sketch, store
from meshframe.llm.words import NOT_SPACE, chunks, grams

WINDOW = 35
ANCHOR = 8
#: Single windows that the sketches let through are sent to all tasks up to this number (16 MB), else joined.
MOST_BROADCAST = 1_000_000
_PLACE = np.uint64((1 << 26) - 1)
#: Columns of our own beside those of the documents.
KEY, ONCE, SPOTS = "__substrings_text_key", "__substrings_once", "__substrings_spots"


def _anchors(h: np.ndarray, at: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text each, the place of the anchor of each, and the hashes of the short runs."""
    g = grams(h, anchor)
    starts_ok = np.zeros(len(h) + 1, np.int64)
    lo, hi = at[:-1], np.maximum(at[:-1], at[1:] - window + 1)
    np.add.at(starts_ok, lo, 1)
    np.add.at(starts_ok, hi, -1)
    starts = np.flatnonzero(np.cumsum(starts_ok)[:-1])
    if not len(starts):
        return starts, starts, g
    key = (g & ~_PLACE) | (np.arange(len(g), dtype=np.uint64) & _PLACE)
    span, size = window - anchor + 1, 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    place = (key[starts] & _PLACE).astype(np.int64)
    if len(g) > int(_PLACE):  # a text of over 2**26 words
        place += (starts - place + int(_PLACE)) // (int(_PLACE) + 1) * (int(_PLACE) + 1)
    return starts, place, g


def _runs(place: np.ndarray) -> np.ndarray:
    """Where runs of equal places begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True]))) if len(place) else np.zeros(1, np.int64)


def _anchor_hashes(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[np.ndarray]:
    name = None
    for batch in batches:
        name = name or batch.schema.names[0]
        for _, h, at in chunks(iter([batch]), name, NOT_SPACE, False):
            _, place, g = _anchors(h, at, window, anchor)
            if len(place):
                yield g[place[_runs(place)[:-1]]]


def _left(h: np.ndarray, at: np.ndarray, window: int, anchor: int, places, spots: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows whose anchor may have two places: by the sketch, or by the places (spots) of each text's."""
    starts, place, g = _anchors(h, at, window, anchor)
    cuts = _runs(place)
    if len(cuts) < 2:
        return starts, np.zeros(0, np.uint64)
    if spots is None:
        known = places.value.may_repeat(g[place[cuts[:-1]]])
    else:
        marked = np.zeros(len(h) + 1, bool)
        for i, own in enumerate(spots):
            if own.is_valid:
                marked[at[i] + own.values.to_numpy()] = True
        known = marked[place[cuts[:-1]]]
    starts = starts[np.repeat(known, np.diff(cuts))]
    return starts, grams(h, window)[starts] if len(starts) else np.zeros(0, np.uint64)


def _spots(part: pa.RecordBatch) -> pa.Array | None:
    at = part.schema.get_field_index(SPOTS)
    return part.column(at) if at >= 0 else None


def _anchor_places(batches: Iterator[pa.RecordBatch], window: int, anchor: int, places) -> Iterator[shared.Triples]:
    """Hash, text and place in it of the anchors that the sketch lets through."""
    for part, h, at in chunks(batches, "text", NOT_SPACE, False):
        _, place, g = _anchors(h, at, window, anchor)
        place = place[_runs(place)[:-1]]
        place = place[places.value.may_repeat(g[place])] if len(place) else place
        if len(place):
            doc = np.searchsorted(at, place, side="right") - 1
            yield g[place], part.column(part.schema.get_field_index(KEY)).to_numpy()[doc], place - at[doc]


def _window_hashes(batches: Iterator[pa.RecordBatch], window: int, anchor: int, places) -> Iterator[np.ndarray]:
    for batch in batches:
        for _, h, at in chunks(iter([batch]), batch.schema.names[0], NOT_SPACE, False):
            yield _left(h, at, window, anchor, places)[1]


def _candidates(batches: Iterator[pa.RecordBatch], window: int, anchor: int, places, counts) -> Iterator[pa.RecordBatch]:
    for part, h, at in chunks(batches, "text", NOT_SPACE, False):
        starts, a = _left(h, at, window, anchor, places, _spots(part))
        keep = counts.value.may_repeat(a) if counts else np.ones(len(a), bool)
        if keep.any():
            starts = starts[keep]
            doc = np.searchsorted(at, starts, side="right") - 1
            b = (grams(h, window, 7)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.record_batch({KEY: part.column(part.schema.get_field_index(KEY)).take(pa.array(doc)), "start": pa.array(starts - at[doc]), "window_a": pa.array(a[keep].view(np.int64)), "window_b": pa.array(b)})


KEPT = "n_words long, n_removed long, kept string"


def _cut(batches: Iterator[pa.RecordBatch], window: int, anchor: int, places, counts, names: list[str], digest: bool) -> Iterator[pa.RecordBatch]:
    for part, h, at in chunks(batches, "text", NOT_SPACE, False):
        starts, a = _left(h, at, window, anchor, places, _spots(part))
        starts = starts[counts.value.may_repeat(a)] if counts and len(starts) else starts
        first = np.searchsorted(starts, at)
        n_words, n_removed, kept = np.diff(at), [], []
        columns = part.column(part.schema.get_field_index("text")), part.column(part.schema.get_field_index(ONCE))
        for i, (text, once) in enumerate(zip(*columns, strict=True)):
            raw = (text.as_py() or "").encode()
            own = starts[first[i] : first[i + 1]] - at[i]
            if once.is_valid:
                own = own[~np.isin(own, once.values.to_numpy())]
            words = raw.split() if digest or len(own) else []
            if len(own):
                mark = np.zeros(len(words) + 1, np.int64)
                mark[own] += 1
                mark[own + window] -= 1
                words = [words[j] for j in np.flatnonzero(np.cumsum(mark)[:-1] == 0)]
            n_removed.append(int(n_words[i]) - len(words) if len(own) else 0)
            if digest:
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            else:  # untouched texts stay as they are; null stays null
                kept.append((b" ".join(words) if len(own) else raw).decode() if text.is_valid else None)
        yield pa.RecordBatch.from_pydict({**{c: part.column(part.schema.get_field_index(c)) for c in names}, "n_words": pa.array(n_words), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The columns of docs (with a string column text), then n_words, n_removed and kept.

    kept is the text without the words that a repeated window covers: words joined by one space if any was
    removed, else the text as it is. With digest, kept is the SHA-256 of the kept words joined by one space.
    Null and empty texts have no words and are kept as they are. Texts of fewer words than a window lose
    nothing. Repeated rows are copies of each other: with a window or more of words, they go whole. Columns of
    docs that clash with the new ones are replaced. An empty table gives an empty table.
    """
    docs = store.without(docs, "n_words", "n_removed", "kept", KEY, ONCE, SPOTS)
    names, docs = docs.columns, store.plain(docs)
    size, key = sketch.text_bytes(docs, "text"), store.column(KEY)
    anchors = size // (3 * (window - anchor + 2))
    places = sketch.repeats(docs, "text", partial(_anchor_hashes, window=window, anchor=anchor), anchors)
    keyed, counts = docs.withColumn(KEY, F.xxhash64("text")), None
    if sketch.crowded(anchors):
        found = shared.repeated(keyed.select(key, "text"), partial(_anchor_places, window=window, anchor=anchor, places=places))
        spots = store.stored(found.groupBy(F.col("owner").alias(KEY)).agg(F.sort_array(F.collect_list("place")).alias(SPOTS)), "spots")
        keyed = store.stored(keyed.join(store.side(spots, most_broadcast // 64), KEY, "left"), "anchored")
    else:
        counts = sketch.repeats(docs, "text", partial(_window_hashes, window=window, anchor=anchor, places=places), size // 24)
    able = keyed.filter(store.column(SPOTS).isNotNull()) if SPOTS in keyed.columns else keyed
    own = [store.column(c) for c in (KEY, SPOTS) if c in keyed.columns]
    found = able.select(*own, "text").mapInArrow(partial(_candidates, window=window, anchor=anchor, places=places, counts=counts), f"`{KEY}` long, start long, window_a long, window_b int")
    grouped = found.groupBy("window_a", "window_b").agg(F.count("*").alias("n"), F.min(key).alias(KEY), F.min("start").alias("start"))
    once = store.stored(grouped.filter("n = 1").groupBy(key).agg(F.collect_list("start").alias(ONCE)), "once")
    small = (once.agg(F.sum(F.size(store.column(ONCE)))).first()[0] or 0) <= most_broadcast
    marked = keyed.join(F.broadcast(once) if small else once.hint("shuffle_hash"), KEY, "left").drop(key)
    cut = partial(_cut, window=window, anchor=anchor, places=places, counts=counts, names=docs.columns, digest=digest)
    return store.named(marked.mapInArrow(cut, store.extended(docs, KEPT)), names)
