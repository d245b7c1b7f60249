"""Vector codes, ns-bounds and files of token ids against brute force and exact round trips."""

import collections
import hashlib
import json
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshframe.llm import elias_fano, equal_average, ns_clustering, vectors
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def brute_nearest(x, entries):
    d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("most", [3, 500, 1 << 26])
def test_equal_average_search_is_exact(most):
    rng = np.random.default_rng(most)
    for k, n, d in [(1, 5, 3), (256, 700, 16), (40, 300, 1), (17, 1, 4)]:
        entries, x = rng.integers(-most, most, (k, d)), rng.integers(-most, most, (n, d))
        entries[k // 2 :] = entries[: k - k // 2]  # ties of entries
        index, dist, _ = equal_average.search(x, equal_average.Book(entries))
        want = brute_nearest(x, entries)
        assert (index == want[0]).all() and (dist == want[1]).all()


def test_equal_average_search_leaves_out_distant_sums():
    rng = np.random.default_rng(2)
    level = rng.integers(-1000, 1000, (256, 1)) * 50
    entries = level + rng.integers(-20, 20, (256, 16))
    x = entries[rng.integers(0, 256, 4096)] + rng.integers(-30, 30, (4096, 16))
    index, dist, taken = equal_average.search(x, equal_average.Book(entries))
    assert (dist == brute_nearest(x, entries)[1]).all() and taken < 0.4 * len(x) * 256


ODD_SCHEMA = "vec_id long, embedding array<float>, label int, code string, `a.b` int, Cluster int"


def odd_vectors(n=40, d=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.2, d)], int(i) % 3 or None, "x", int(i), 7) for i in rng.permutation(n)]
    rows += [(3, rows[0][1], 1, None, None, None), (None, rows[1][1], 2, "y", 1, 1), rows[5], rows[5]]
    rows += [(100, None, 1, "", 0, 0), (101, [None] * d, 1, "", 0, 0), (102, [float("nan")] * d, 1, "", 0, 0), (103, [float("inf")] + [0.0] * (d - 1), None, "", 0, 0), (104, [0.1] * (d + 1), 1, "", 0, 0), (105, [], 1, "", 0, 0), (106, [0.0] * d, 2, "", 0, 0)]
    return rows


def usable(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(v is not None and np.isfinite(v) for v in r[1])]


def fixed(rows):
    return np.floor(np.array([np.array(r[1], np.float32) for r in rows], float) * 1024).astype(np.int64)


def test_codes_equal_brute_force_on_odd_rows(spark):
    rows, d = odd_vectors(), 8
    df = spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)
    books = equal_average.train(df, entries=16, rounds=3)
    own = sorted(usable(rows, d), key=lambda r: (r[0] is None, r[0] or 0, [np.float32(v) for v in r[1]]))
    x = fixed(own)
    want = [x[:16, 2 * p : 2 * p + 2].copy() for p in range(4)]
    for _ in range(3):
        for p, book in enumerate(want):
            part = x[:, 2 * p : 2 * p + 2]
            code = brute_nearest(part, book)[0]
            for k in set(code):
                book[k] = part[code == k].sum(0) // (code == k).sum()
    assert all((a == b).all() for a, b in zip(books, want, strict=True))
    found = [brute_nearest(x[:, 2 * p : 2 * p + 2], b) for p, b in enumerate(want)]
    expected = collections.Counter((r[0], r[4], "".join(f"{f[0][i]:02x}" for f in found), int(sum(f[1][i] for f in found))) for i, r in enumerate(own))
    coded = equal_average.encode(df, books)
    assert coded.columns == ["vec_id", "embedding", "label", "a.b", "Cluster", "code", "error"]
    got = coded.select("vec_id", "`a.b`", F.lower(F.hex("code")), "error").collect()
    assert collections.Counter(map(tuple, got)) == expected
    sums = collections.Counter()
    for r in coded.collect():
        sums[r["label"]] += r["error"]
    assert {(r["label"], r["label_error"]) for r in equal_average.summed(coded, "label").collect()} == set(sums.items())


def test_codes_of_no_and_few_rows(spark):
    df = spark.createDataFrame(odd_vectors(), ODD_SCHEMA)
    for some in (df.limit(0), df.filter("vec_id in (100, 101, 102)")):
        books = equal_average.train(some)
        assert equal_average.encode(some, books).count() == 0 and equal_average.summed(equal_average.encode(some, books), "label").count() == 0
    two = df.filter("vec_id in (7, 8)")
    assert {r["error"] for r in equal_average.encode(two, equal_average.train(two)).collect()} == {0}
    with pytest.raises(ValueError):
        equal_average.train(df, entries=300)
    with pytest.raises(ValueError):
        vectors.fixed_point(df.filter("vec_id = 106").selectExpr("transform(embedding, x -> float(1e9)) e").toArrow().column(0).combine_chunks(), 1024)


def brute_clusters(x, c, rounds):
    for _ in range(rounds):
        near = brute_nearest(x, c)[0]
        c = np.array([x[near == j].sum(0) // (near == j).sum() if (near == j).any() else c[j] for j in range(len(c))])
    return c, *brute_nearest(x, c)


def test_ns_bounds_give_exact_rounds_with_fewer_distances():
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 100, (12, 16))[rng.integers(0, 12, 3000)] + rng.normal(0, 12, (3000, 16))).astype(np.int64)
    history = x[:8][None].copy()
    own, squared, taken, counted = np.full(3000, -1), np.zeros((3000, 8), np.int64), np.full((3000, 8), -1), 0
    for _ in range(10):
        own, count = ns_clustering.advance(x, own, squared, taken, history, False)
        counted += count
        assert (own == brute_nearest(x, history[-1])[0]).all()
        history = np.concatenate((history, [np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else history[-1][j] for j in range(8)])]))
    own, _ = ns_clustering.advance(x, own, squared, taken, history, True)
    want = brute_clusters(x, x[:8].copy(), 10)
    assert (history[-1] == want[0]).all() and (own == want[1]).all() and (squared[np.arange(3000), own] == want[2]).all()
    assert counted < 0.5 * 10 * x[:, 0].size * 8


def test_total_displacement_is_a_tighter_bound_than_the_sum_of_drifts():
    away = np.array([[[0, 0]], [[30, 40]], [[0, 0]]])  # one centroid that goes and comes back
    x, squared, taken = np.array([[3, 4]]), np.array([[25]]), np.array([[0]])
    own, count = ns_clustering.advance(x, np.array([0]), squared, taken, away, False)
    assert own[0] == 0 and count == 0
    two = np.concatenate((away, np.full((3, 1, 2), 60)), 1)  # summed drifts (100) would need new distances, the total (0) doesn't
    squared, taken = np.array([[25, 57**2 + 56**2]]), np.array([[0, 0]])
    assert ns_clustering.advance(x, np.array([0]), squared, taken, two, False)[1] == 0


@pytest.mark.parametrize(("n", "seed"), [(40, 1), (3, 2), (200, 3)])
def test_clusters_equal_brute_force_on_odd_rows(spark, n, seed):
    rows, d = odd_vectors(n, 8, seed) if n > 5 else odd_vectors(40, 8, seed)[:n], 8
    df = spark.createDataFrame(rows, ODD_SCHEMA).repartition(4)
    found, c = ns_clustering.cluster(df, components=d)
    own = usable(rows, d)
    named = sorted((r for r in own if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), [np.float32(v) for v in r[1]]))
    want, near, dist = brute_clusters(fixed(own), fixed(named[:8]), 10)
    assert (c == want).all() and found.columns == ["vec_id", "embedding", "label", "code", "a.b", "cluster", "distance"]
    got = found.select("vec_id", "`a.b`", "cluster", "distance").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r[0], r[4], int(near[i]), int(dist[i])) for i, r in enumerate(own))


def test_clusters_of_no_rows(spark):
    df = spark.createDataFrame(odd_vectors(), ODD_SCHEMA)
    for some in (df.limit(0), df.filter("vec_id is null"), df.filter("vec_id in (100, 105)")):
        found, c = ns_clustering.cluster(some, components=8)
        assert found.count() == 0 and len(c) == 0 and {"cluster", "distance"} <= set(found.columns)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=700), st.integers(0, 64), st.data())
def test_sorted_sequences_round_trip(values, shift, data):
    v = np.sort(np.array(values, np.uint64) >> np.uint64(min(shift, 63)))
    raw = elias_fano.dump(v)
    read = elias_fano.Sequence(len(v), int(v[-1]), lambda at, n: raw[at : at + n])
    a = data.draw(st.integers(0, len(v)))
    b = data.draw(st.integers(a, len(v)))
    assert read.at.size == len(raw) and (read.values(a, b) == v[a:b]).all() and (read.values(0, len(v)) == v).all()


def test_sequences_take_little_space():
    v = np.sort(np.random.default_rng(1).integers(0, 400 * 100_000, 100_000).astype(np.uint64))
    assert 8 * len(elias_fano.dump(v)) / len(v) < 2.3 + np.log2(400)  # 64-bit offsets take 64 bits a value


public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from meshframe.llm import token_files  # noqa: E402
from meshframe.llm.word_encoder import encoder  # noqa: E402

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
POOL = ["a", "B", "'s", "'S", "'ll", "ll", "'", "1", "23", "É", "é", "é", "ß", "ẞ", "İ", "Σ", "ς", "÷", "×", "<|endoftext|>", "<|", "|>", " ", "\n", "\t", " ", "\x1c", "\x85", "漢", "😀", "ª", "µ", "²", "\x00", "...", "K", "ﬁ", "​", "'re", "RE"]


@pytest.mark.parametrize("plain", [False, True])
def test_words_apart_equal_whole_texts(plain):
    with open(WORD, encoding="utf-8") as f:
        own = encoder(f.read(), "<u2", plain)
    whole = tokenizers.Tokenizer.from_file(WORD)
    whole.encode_special_tokens = plain
    rng = random.Random(4)
    assert own.apart
    for _ in range(3000):
        t = "".join(rng.choices(POOL, k=rng.randint(0, 9)))
        assert own.ids(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), repr(t)


def brute_ids(rows, path, end):
    t = tokenizers.Tokenizer.from_file(path)
    return [(k, [*t.encode(x or "", add_special_tokens=False).ids, end]) for k, x in rows]


ODD = [(None, None), (None, "a b"), (None, "a b"), (5, "  "), (5, "x"), (5, "x"), (-3, "neg <|endoftext|> y"), (2**62, None), (-(2**63), "least"), (7, "long words " * 40_000), (8, "")]


@pytest.mark.parametrize(("path", "end", "file_bytes", "width"), [(WORD, 2, 1 << 20, 2), (WORD, 2, 5, 2), (WORD, 70_000, 30, 4), (BYTE, 50_256, 40, 2)])
def test_token_files_round_trip(spark, tmp_path, path, end, file_bytes, width):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ODD)], "doc_id long, text string, part int").repartition(3)
    for _ in range(2):  # a folder that was written before has only the new files
        token_files.write(docs, path, str(tmp_path), end=end, file_bytes=file_bytes)
    got = token_files.read(spark, str(tmp_path)).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in ODD if k is not None)) + [None] * 3
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == collections.Counter((k, tuple(i)) for k, i in brute_ids(ODD, path, end))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]] and all(r["n_tokens"] == len(r["ids"]) for r in got)
    index = json.loads((tmp_path / token_files.INDEX).read_text())
    assert index["width"] == width and {f["name"] for f in index["files"]} | {token_files.INDEX} == {f for f in os.listdir(tmp_path) if f[0] != "."}
    raw = {r["start"]: r["ids"] for r in token_files.read(spark, str(tmp_path), raw=True).collect()}
    assert all(raw[r["start"]] == np.array(r["ids"], "<u4").tobytes() for r in got)


def test_token_files_close_at_a_number_of_documents(spark, tmp_path):
    spark.dataSource.register(token_files.TokenFiles)
    rows = [(0, i, np.arange(i % 5, dtype="<u2").tobytes()) for i in range(1000)]
    df = spark.createDataFrame(rows, "part int, doc_id long, ids binary").coalesce(1).sortWithinPartitions("doc_id")
    df.write.format("token_files").mode("overwrite").option("width", 2).option("documents", 300).save(str(tmp_path))
    assert len(json.loads((tmp_path / token_files.INDEX).read_text())["files"]) == 4
    got = sorted(token_files.read(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_tokens"], r["start"]) for r in got] == [(i, i % 5, sum(j % 5 for j in range(i))) for i in range(1000)]


def test_token_files_of_no_rows(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), WORD, str(tmp_path), end=2)
    assert token_files.read(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are elsewhere")
def test_token_file_query(spark):
    from meshframe.llm.queries import QUERIES

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    start, want = 0, set()
    for k, ids in brute_ids(docs, WORD, 2):
        want.add((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert set(map(tuple, QUERIES["op13_token_files"](spark, SMALL).collect())) == want
