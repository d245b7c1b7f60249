"""Small cases and brute-force versions for the operators of the subpackage."""

import base64
import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from meshframe.llm import ann, bpe, chat, html, jaccard, leak_join, quality, sampling, shared, sketch, toxicity, warc  # noqa: E402
from meshframe.llm.components import components  # noqa: E402
from meshframe.llm.decontaminate import find_leaks  # noqa: E402
from meshframe.llm.jaccard import similar_components  # noqa: E402
from meshframe.llm.substrings import remove_repeats  # noqa: E402

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}é" if rng.random() < 0.1 else f"W{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with copies, near copies, shared passages, repeats in themselves, nulls, blanks and a very long one."""
    rng = random.Random(3)
    base = prose(rng, 300)
    docs = [prose(rng, rng.randrange(1, 200)) for _ in range(60)] + [base] * 4
    for k in range(40):
        words = base.split()
        for _ in range(k // 3):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(words))
    passage = prose(rng, 60)
    docs += [f"{prose(rng, 40)}\n{passage}\t{prose(rng, rng.randrange(30))}" for _ in range(10)]
    docs += [f"{passage} {passage}", "same " * 90, "one two", "one two", "", "  \t\n ", None, None, "a b c d e", "A B c d E", prose(rng, 60000, 10**6)]
    return [(i, t, "extra", i) for i, t in enumerate(docs)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n long").repartition(5)


# Substring dedup ----------------------------------------------------------------------------------


def brute_removed(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield [x for x, g in zip(w, gone, strict=True) if not g], len(w), sum(gone)


@pytest.mark.parametrize(("window", "anchor", "bits"), [(35, 8, 27), (12, 5, 27), (3, 3, 27), (35, 8, 8), (12, 5, 4)])
def test_substrings_equal_brute_force(spark, corpus, monkeypatch, window, anchor, bits):
    """Also with sketches of 256 and 16 cells, which let nearly everything through."""
    monkeypatch.setattr(sketch, "MOST_BITS", bits)
    monkeypatch.setattr(sketch, "LEAST_BITS", min(bits, 16))
    df = frame(spark, corpus)
    got = {r["doc_id"]: r for r in remove_repeats(df, window=window, anchor=anchor, digest=True).collect()}
    for (i, *_), (kept, n, removed) in zip(corpus, brute_removed([r[1] for r in corpus], window), strict=True):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (n, removed, hashlib.sha256(b" ".join(kept)).hexdigest()), i


def test_substrings_joined_back_and_texts(spark, corpus):
    rows = {r["doc_id"]: r for r in remove_repeats(frame(spark, corpus), most_broadcast=-1).collect()}
    for (i, text, *_), (kept, _, removed) in zip(corpus, brute_removed([r[1] for r in corpus], 35), strict=True):
        assert rows[i]["kept"] == (b" ".join(kept).decode() if removed else text) and rows[i]["n"] == i
    assert remove_repeats(frame(spark, []), digest=True).count() == 0


# Near duplicates ----------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(frame(spark, corpus)).collect()}
    assert got == brute_components([r[:2] for r in corpus])


@pytest.mark.parametrize("size", [3, 8192])
def test_near_duplicates_by_one_pivot_and_small_blocks(spark, corpus, monkeypatch, size):
    """The exact last steps find all links that one pivot leaves, in many blocks, runs and copies of pivots too."""
    monkeypatch.setattr(jaccard, "BLOCK", size)
    monkeypatch.setattr(jaccard, "SIGNATURES", size)
    monkeypatch.setattr(jaccard, "SPOKES", 2)
    some = corpus[50:]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(frame(spark, some), pivots=1, compared=1).collect()}
    assert got == brute_components([r[:2] for r in some])


def test_near_duplicates_with_a_tiny_sketch(spark, corpus, monkeypatch):
    monkeypatch.setattr(sketch, "MOST_BITS", 6)
    monkeypatch.setattr(sketch, "LEAST_BITS", 6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(frame(spark, corpus)).collect()}
    assert got == brute_components([r[:2] for r in corpus])


def test_shared_rows_equal_brute_force(spark, monkeypatch):
    """What the exact filter lets through is what repeats, and nothing else, whatever the buffers: hot keys, copies of owners, single rows."""
    rng = np.random.default_rng(4)
    rows = [(int(k), int(o), int(p)) for k, o, p in zip(rng.integers(0, 400, 3000) ** 2, rng.integers(0, 60, 3000), rng.integers(0, 9, 3000), strict=True)] + [(7, o, 1) for o in range(500, 900)]
    df = spark.createDataFrame(rows, "k long, o long, p long").repartition(6)

    def triples(batches):
        for b in batches:
            yield b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()

    by = collections.defaultdict(list)
    for k, o, p in rows:
        by[k].append((o, p))
    assert {tuple(r) for r in shared.repeated(df, triples).collect()} == {x for v in by.values() if len(v) > 1 for x in v}
    by = {k: [(o, k % 5) for o, _ in v] for k, v in by.items()}  # an owner has a key at one place
    rows = [(k, *x) for k, v in by.items() for x in v]
    df = spark.createDataFrame(rows, "k long, o long, p long").repartition(6)
    assert {tuple(r) for r in shared.repeated(df, triples, apart=True).collect()} == {(o, min(p for x, p in v if x == o)) for v in by.values() if len({o for o, _ in v}) > 1 for o, _ in v}


def test_near_duplicates_at_the_threshold(spark):
    """Pairs on both sides of the similarity, chains, and a component whose nearest member is no link but another one is."""
    rng = random.Random(5)
    rows = []
    for k in range(30):
        base = [f"t{k}w{i}" for i in range(60 + k)]
        for j in range(6):
            own = list(base)
            at = rng.randrange(len(own) - 12)
            own[at : at + 2 + j % 3] = [f"n{k}x{j}y{i}" for i in range(2 + j % 3)]
            rows.append((len(rows), " ".join(own)))
            rows.append((len(rows), " ".join(own[: len(own) - rng.randrange(14)])))
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(df).collect()} == want
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(df, pivots=1, compared=1).collect()} == want


def test_signatures_never_exceed_differences():
    """The bound that prunes pairs, by sets of several sizes and overlaps."""
    rng = np.random.default_rng(2)
    for n in (1, 5, 31, 32, 33, 500, 3000):
        for share in (0.0, 0.5, 0.9, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate((x[: int(len(x) * share)], rng.integers(0, 1 << 63, max(1, int(n * (1.3 - share)))).astype(np.uint64))))
            own, other = (np.frombuffer(jaccard._signature(s), np.uint8)[None, :] for s in (x, y))
            assert jaccard._apart(own, other)[0] <= len(np.setxor1d(x, y))


def test_near_duplicates_of_short_texts_and_nulls(spark):
    rows = [(3, "a b"), (1, "A B"), (2, "a  b "), (None, "q r s"), (7, None), (8, ""), (5, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(df).collect()}
    assert got == {3: (1, 1), 1: (1, 1), 2: (1, 1), None: (1, None), 7: (0, 7), 8: (0, 8), 5: (1, 5)}
    assert similar_components(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 520)] + [(7, 7), (502, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 520)}


# Decontamination ----------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randrange(12, 40), 30)) for k in range(8)] + [(20, "Lone-word"), (21, "two Words!"), (22, "..."), (23, None), (None, prose(rng, 12)), (1, "again under one id " * 4)]
    docs = [prose(rng, 80, 30) for _ in range(15)] + [f"{prose(rng, 5)}. {t}?! {prose(rng, 9)}".upper() for _, t in items if t] + [items[0][1], "", None, "LONE word", "one two words three lone", " ".join(items[1][1].split()[:9])]
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes, most_blocks in ((2_000_000, 1), (300, 1000), (300, 1)):
        rows = find_leaks(df, bench, block_bytes=block_bytes, most_blocks=most_blocks).collect()
        got = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(docs)
        for i, t in enumerate(docs):
            w, hit, named = words(t), set(), set()
            for k, body in items:
                own = words(body)
                n = min(10, len(own))
                windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
                for s in range(len(w) - n + 1 if n else 0):
                    if tuple(w[s : s + n]) in windows:
                        hit.update(range(s, s + n))
                        named.add("" if k is None else str(k))
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(named)), (i, block_bytes, most_blocks)
            assert {x for a, b in got[i]["spans"] for x in range(a, b)} == hit and all(a[1] < b[0] for a, b in zip(got[i]["spans"], got[i]["spans"][1:]))
    assert find_leaks(df, bench.limit(0)).filter("n_hit > 0").count() == 0 and find_leaks(df.limit(0), bench).count() == 0
    assert find_leaks(df, bench.limit(0), most_blocks=0).filter("n_hit > 0").count() == 0 and find_leaks(df.limit(0), bench, most_blocks=0).count() == 0


def test_leaks_of_hot_tokens_and_names(spark, monkeypatch):
    """The joined way with tokens in more places than one task takes, copies, items that share windows, and odd names; both ways give the same rows."""
    monkeypatch.setattr(leak_join, "SPOKES", 3)
    rng = random.Random(12)
    passage = prose(rng, 14)
    docs = [(f"{passage} {prose(rng, 5)}", "k")] * 9 + [(f"{prose(rng, 7)} {passage}, {passage}", "k") for _ in range(12)] + [("tick " * 40, "k"), (passage.upper(), "k"), (None, None), ("", "")]
    df = spark.createDataFrame(docs, "text string, `a.b c` string").withColumn("text_key", F.lit("mine")).repartition(4)
    bench = spark.createDataFrame([("x", passage), ("y", f"{prose(rng, 3)} {passage}"), ("z", "tick tick"), ("x", "tick " * 12), ("w", prose(rng, 400))], "item_id string, text string")
    ways = [sorted((r["text"] or "", r["n_words"], r["n_hit"], r["items"], [tuple(x) for x in r["spans"]]) for r in find_leaks(df, bench, most_blocks=n).collect()) for n in (0, 1)]
    assert ways[0] == ways[1] and len(ways[0]) == len(docs) and sum(r[2] > 0 for r in ways[0]) == 23
    assert {"a.b c", "text_key"} <= set(find_leaks(df, bench, most_blocks=0).columns)


# Byte-level BPE -----------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, corpus):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] for r in corpus[-30:]] + ["<unk> <s> ▁▁ \x00 don't 日本語 😀\r\n\n  x", "a" * 5000, "é" * 300]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    trips = {r["doc_id"]: r for r in bpe.round_trip(df, path, public_tokenizers.PATTERN).collect()}
    for r in rows:
        ids = own.encode_ordinary(texts[r["doc_id"]] or "")
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["ids"] == ids and bytes(r["decoded"]) == raw and r["n_tokens"] == len(ids)
        assert trips[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and trips[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
    assert bpe.round_trip(df.limit(0), path, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.model_proto({b"a": 0})


# Archives -----------------------------------------------------------------------------------------


def test_arc_versions_and_lengths():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nline\n\nhttp://x 1 2 3 4\n"
    for version in (1, 2):
        rows = [("http://a b/c", "1.2.3.4", "20200102030405", "text/html", body), ("dns:x", "1.2.3.4", "20200102", "text/dns", b""), ("http://z", "0.0.0.0", "20200102030405", "text/html", b"plain")]
        info, a, b, c = warc.read_arc(warc.arc_file(version, rows))
        assert info.kind == "warcinfo" and a.url == "http://a b/c" and a.date == "2020-01-02T03:04:05Z" and a.payload == body[body.index(b"\r\n\r\n") + 4 :] and a.kind == "response"
        assert b.kind == "resource" and b.payload == b"" and b.content_type == "text/dns" and c.payload == b"plain"
        text = b"".join(warc.warc_record(r, hashlib.sha256(r.payload).hexdigest(), str(i)) + b"\r\n" for i, r in enumerate((a, b, c)))
        assert [block for _, block in warc.read_warc(text)] == [body, b"", b"plain"]
    for broken in (b"http://x 1.1.1.1 2020 t 10\nshort", b"no line end", b"filedesc://x 0 2020 text/plain 9\n9 0 crawl"):
        with pytest.raises(ValueError):
            list(warc.read_arc(broken))
    with pytest.raises(ValueError):
        list(warc.read_warc(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_archives_round_trip(spark):
    long = "<p>é</p>" * 30
    rows = [(5, "http://a/5", long), (2, "http://a b/2", long), (9, None, long), (None, "http://n", long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 100000 + "\r\n\r\nWARC/1.1\r\n"), (2, "http://a b/2", long)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archived(df, records=2).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    for i, _, h in rows:
        raw = (h or "").encode()
        r = by[i][0]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = h == long and i != 2
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if again else ("response", None))
    assert len(by[2]) == 2 and warc.archived(df.limit(0)).count() == 0


def test_legacy_files_from_storage(spark, tmp_path):
    """Files as others wrote them: plain, gzipped as a whole and by record, both versions; binary payloads, records without HTTP, equal payloads."""
    import gzip

    blob = bytes(range(256)) * 3
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
    one = warc.arc_file(1, [("http://a/1", "1.2.3.4", "19991231235959", "image/png", http + blob), ("dns:a", "1.2.3.4", "19991231", "text/dns", b"a 1.2.3.4")])
    two = warc.arc_file(2, [("http://b/2", "1.2.3.4", "20050607080910", "image/png", http + blob), ("http://b/3", "1.2.3.4", "20050607080911", "text/html", http)])
    cut = two.index(b"http://b/2")
    (tmp_path / "arcs").mkdir()
    (tmp_path / "arcs" / "one.arc").write_bytes(one)
    (tmp_path / "arcs" / "two.arc.gz").write_bytes(gzip.compress(two[:cut]) + gzip.compress(two[cut:]) + b"\0" * 9)
    (tmp_path / "arcs" / "none.arc").write_bytes(b"")
    assert warc.unpacked(gzip.compress(one) + gzip.compress(two)) == one + two
    with pytest.raises(ValueError):
        warc.unpacked(gzip.compress(one)[:-9])
    got = {r["url"]: r for r in warc.read_arcs(spark, str(tmp_path / "arcs")).filter("kind != 'warcinfo'").collect()}
    assert got["http://a/1"]["payload"] == blob and got["http://b/2"]["date"] == "2005-06-07T08:09:10Z" and got["dns:a"]["kind"] == "resource" and got["http://b/3"]["payload"] == b""
    warc.convert_arcs(spark, str(tmp_path / "arcs"), str(tmp_path / "warcs"))
    rows = {r["target_uri"]: r for r in warc.read_archives(spark, str(tmp_path / "warcs")).collect()}
    kinds = sorted(rows[u]["record_type"] for u in ("http://a/1", "http://b/2"))
    assert kinds == ["response", "revisit"] and rows["dns:a"]["record_type"] == "resource" and all(rows[u]["payload_digest"] == hashlib.sha256(blob).hexdigest() for u in ("http://a/1", "http://b/2"))
    for f in (tmp_path / "warcs").glob("*.gz"):
        records = list(warc.read_warc(gzip.decompress(f.read_bytes())))
        assert not records or records[0][0]["WARC-Type"] == "warcinfo"
    # a file of two members, as others write WARC
    raw = b"".join(gzip.compress(x) for x in (warc._opening("2020-01-01T00:00:00Z") + b"\r\n", warc.warc_record(warc.Record("http://c", "0.0.0.0", "2020-01-01T00:00:00Z", "response", "application/http; msgtype=response", http, blob), hashlib.sha256(blob).hexdigest(), "4") + b"\r\n"))
    (tmp_path / "members").mkdir()
    (tmp_path / "members" / "x.warc.gz").write_bytes(raw)
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.read_archives(spark, str(tmp_path / "members")).collect()] == [(4, len(blob))]


# Pages --------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a href="/a">Home page</a></li></ul></nav><!-- ad --><div class="ad">Buy, now. And more!</div>
<div class="cookie-notice"><p>We use cookies, as others do.</p></div>
<article><h1>The &amp; title</h1><p><b>First para&shy;graph,\n with   some text.<br><p>Sec&#111;nd one &lt;b&gt;, longer than the first, with marks; and so on.<p>Short.</p>
<ul><li>An item, yes.</li></ul><aside>Aside, not here.</aside></article>
<section id="comments"><h2>Comments</h2><p>I disagree, very much so, and at some length.</p></section><form>Name <input><button>Go</button></form><footer>&copy; all</footer></body></html>"""


def test_page_text(spark):
    want = "The & title\nFirst para\xadgraph, with some text.\nSecond one <b>, longer than the first, with marks; and so on.\nShort.\nAn item, yes."
    assert html.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>cut off, here is text <a hre"), (5, "u", "plain & simple"), (6, "u", "<nav>only</nav>"), (7, "u", "<p>" * 3000 + "deep, text")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))).collect()}
    assert [got[i]["text"] for i in range(1, 8)] == [want, "", "", "cut off, here is text", "plain & simple", "", "deep, text"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    odd = spark.createDataFrame([(PAGE, "a", 1)], "html string, `n_chars` string, `x``y.z` int")
    assert html.extract(odd).columns == ["x`y.z", "text", "n_chars"] and html.extract(odd.limit(0)).count() == 0


def test_names_that_only_contain_furniture_words():
    """Inside an article, whole names of furniture on elements that hold others go; paragraphs, and names that say more, stay."""
    para = f"<p>{'Words of a long paragraph, ' * 22}to its end.</p>"
    kept = [("p", "notice"), ("div", "share-price"), ("section", "related-work"), ("div", "comment-on-policy"), ("h2", "banner-of-war"), ("ul", "menu-of-the-day"), ("span", "login"), ("p", "widget"), ("div", "story-with-sidebar")]
    gone = [("div", "share-buttons"), ("section", "related-posts"), ("div", "sidebar left"), ("ul", "social-links"), ("div", "ad-slot-2"), ("div", "cookie-notice"), ("ol", "comment-list"), ("div", "newsletter")]
    for outer in ("article", "main"):
        for tags, there in ((kept, True), (gone, False)):
            for tag, name in tags:
                inside = f"<li>Kept or gone, here.</li>" if tag in ("ul", "ol") else "Kept or gone, here."
                for attribute in ("class", "id"):
                    page = f"<html><body class='has-sidebar'><{outer}>{para * 3}<{tag} {attribute}='{name}'>{inside}</{tag}>{para * 3}</{outer}></body></html>"
                    assert ("Kept or gone, here." in html.main_text(page).split("\n")) == there, (tag, name)
    page = f"<body><div class='content-with-sidebar'>{para * 4}</div><div class='sidebar'><p>Beside it, all the time.</p></div><p class='copyright'>Ours, 2020.</p></body>"
    assert html.main_text(page).split("\n") == [t for t in re.split("<[^>]*>", para * 4) if t]


def test_ratios_decide_without_names():
    """Menus, notices and footers without any name or telling tag."""
    para = f"<p>{'Words of a long paragraph, with marks; ' * 14}to its end.</p>"
    links = f"<div><ul>{''.join(f'<li><a href=/{i}>Go to {i}</a></li>' for i in range(25))}</ul></div>"
    small = "<div><span>We use cookies</span></div>"
    for body in (f"{small}{links}<div><div>{para * 6}</div></div>{links}{small}", f"{small}<table><tr><td>{links}</td><td><div>{para * 6}</div></td></tr></table>"):
        assert html.main_text(f"<html><body>{body}</body></html>").split("\n") == [t for t in re.split("<[^>]*>", para * 6) if t]


def test_lists_tables_and_links_of_an_article():
    para = f"<p>{'Words of a long paragraph, ' * 22}to its end.</p>"
    parts = {
        "<ul>{}</ul>": [f"<li>item {i}</li>" for i in range(30)],
        "<table>{}</table>": [f"<tr><td>{i}</td><td>{i * 7}</td></tr>" for i in range(30)],
        "<h2>References</h2><ol>{}</ol>": [f"<li><a href='/{i}'>Reference {i}</a></li>" for i in range(12)],
    }
    lines = lambda x: [t for t in re.split("<[^>]*>", x) if t]
    menu = f"<div><ul>{''.join(f'<li><a href=/{i}>Menu {i}</a></li>' for i in range(20))}</ul></div>"
    for outer in ("article", "main", "div"):
        for shape, rows in parts.items():
            part = shape.format("".join(rows))
            if outer == "div" and "href" in part:
                continue  # without an article element, lists of links are taken for menus
            for inside in (para * 5 + part + para * 4, para * 9 + part):
                got = html.main_text(f"<html><body>{menu}<{outer}><h1>Title</h1>{inside}</{outer}>{menu}</body></html>")
                assert got.split("\n") == ["Title", *lines(inside)]
    between = para * 3 + "<ul><li>one</li><li>two</li></ul>" + para * 3
    assert html.main_text(f"<body>{menu}{between}{menu}</body>").split("\n") == lines(between)


# Nearest neighbours -------------------------------------------------------------------------------


def test_nearest_equal_brute_force_on_few_lists(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:180] = x[100]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [1.0, None] * 4, 0), (1004, [1.0], 0), (None, [1.0] * 8, 0), (3, x[3].tolist(), 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=20, aim=50).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        s = (x.astype(float) * x[q].astype(float)).cumsum(1)[:, -1]
        s[q] = -np.inf
        order = np.lexsort((np.arange(400), -s))[:20]
        assert [v for _, v, _ in sorted(found)] == order.tolist() and [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert np.allclose([c for _, _, c in sorted(found)], s[order], rtol=0, atol=1e-12)


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in ann.nearest(df, df.filter("vec_id = 0")).collect()) == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df.limit(1), df.limit(1)).count() == 0


def test_recall_with_hundreds_of_lists(spark):
    x = np.random.default_rng(4).normal(size=(8000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), aim=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = []
    for i in range(0, 8000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits.append(len(got[i] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_boundary_vectors_have_copies_and_ratio_separates_lists():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10000, 64))
    x = ann._lifted(x / np.linalg.norm(x, axis=1, keepdims=True), 1.0)
    c = ann.balanced_cells(x, 200)
    near, taken = ann.lists_of(x, c)
    assert taken[:, 0].all() and 2 < taken.sum(1).mean() <= ann.COPIES
    # Clusters far from each other: no vector is replicated into another cluster.
    far = 50 * np.eye(64)[:4]
    y = np.repeat(far, 500, 0) + rng.normal(size=(2000, 64))
    assert ann.lists_of(y, far)[1].sum() == len(y)
    # The ratio and number of lists that hold the neighbours of queries leave out most lists.
    d = ann._distances(x[:100], c)
    ratio, place = np.sqrt(d / d.min(1)[:, None]), np.argsort(np.argsort(d, 1), 1)
    s = x[:100, :64] @ x[:, :64].T
    top = np.argsort(-s, 1)[:, 1:21]
    held, at = taken[top], (np.arange(100)[:, None, None], near[top])
    within, most = ann._reach(np.where(held, place[at], 200).min(2).ravel(), np.where(held, ratio[at], np.inf).min(2).ravel())
    assert most < 100 and (ratio <= within).mean() < 0.75


def test_recall_and_balance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(10, 16))[rng.integers(0, 10, 3000)]
    c = ann.balanced_cells(x, 60)
    sizes = np.bincount(((x[:, None] - c[None]) ** 2).sum(2).argmin(1), minlength=60)
    assert len(c) == 60 and sizes.max() < 6 * sizes.mean()
    ids, d = ann.graph_search(x[:100], c, ann.neighbour_graph(c))
    true = ((x[:100, None] - c[None]) ** 2).sum(2)
    assert np.mean(ids[:, 0] == true.argmin(1)) > 0.95 and np.allclose(d, np.take_along_axis(true, ids, 1))
    assert len(ann.balanced_cells(np.ones((50, 4)), 8)) <= 8


# Conversations ------------------------------------------------------------------------------------


def test_preference_pairs(spark):
    t = lambda *x: [(r, s) for r, s in x]
    rows = [
        (1, t(("user", "q"), ("assistant", "good"), ("user", "é")), t(("user", "q"), ("assistant", "bad"))),
        (2, t(("user", "q"), ("assistant", None)), t(("user", "q"), ("assistant", None))),
        (3, t(("system", "s")), t(("user", "s"))),
        (4, None, t((None, "x"))),
        (5, [], []),
    ]
    df = spark.createDataFrame([(*r, "old") for r in rows], "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    got = {r["pair_id"]: r for r in chat.preference_pairs(df).collect()}
    one = got[1]
    assert one["prompt_turns"] == 1 and one["prompt"] == "<|user|>\nq<|end|>\n" and one["chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\né<|end|>\n"
    assert [one["chosen"][s["start"] : s["stop"]] for s in one["chosen_spans"]] == ["good<|end|>\n"] and [one["rejected"][s["start"] : s["stop"]] for s in one["rejected_spans"]] == ["bad<|end|>\n"]
    assert got[2]["prompt_turns"] == 2 and got[2]["chosen"] == got[2]["rejected"] == "" and got[3]["prompt"] == "" and got[3]["chosen_spans"] == []
    assert got[4]["chosen"] == "" and got[4]["rejected"] == "<|unknown|>\nx<|end|>\n" and got[5]["prompt_turns"] == 0
    assert chat.preference_pairs(df.limit(0)).count() == 0


def test_stale_answers(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "x"), (None, 0, None, None)]
    got = {r["conv_id"]: r for r in chat.stale_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [x["text"] for x in got[1]["chosen"]] == ["a", "b", "c", "d"] and [x["text"] for x in got[1]["rejected"]] == ["a", "b", "c", "b"] and len(got) == 3


# Classifiers --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    bad = ["dreck", "pestilent", "vilewort"]
    docs, labels = [], []
    for i in range(900):
        lines = [prose(rng, rng.randrange(3, 12), 200) for _ in range(rng.randrange(1, 8))]
        toxic = rng.random() < 0.3
        if toxic:
            k = rng.randrange(len(lines))
            lines[k] += f" {rng.choice(bad)} you"
        poor = rng.random() < 0.4
        if poor:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        docs.append((i, ". ".join(lines), "z"))
        labels.append((i, 0 if poor else 1 if toxic else 2, int(toxic)))
    return docs + [(10_000, None, "z"), (10_001, "", "z"), (10_002, "...", "z"), (0, docs[0][1], "z")], labels + [(1, None, None), (77_777, 0, 1)]


def auc(rows):
    pos, neg = (np.array([s for s, y in rows if y == v]) for v in (1, 0))
    return np.mean(pos[:, None] > neg[None, :]) + np.mean(pos[:, None] == neg[None, :]) / 2


def test_toxicity_held_out(spark, labelled):
    docs = spark.createDataFrame(labelled[0], "doc_id long, text string, score string")
    labels = spark.createDataFrame(labelled[1], "doc_id long, grade int, toxic int")
    rows = toxicity.score(docs, labels).withColumn("held", sampling.remainder("doc_id") == 2).collect()
    truth = {i: t for i, _, t in labelled[1] if t is not None}
    assert auc([(r["score"], truth[r["doc_id"]]) for r in rows if r["held"] and r["doc_id"] in truth]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and all(r["score"] == 0 for r in rows if r["doc_id"] >= 10_000)
    found = [r["text"][s["start"] : s["stop"]].lower() for r in rows if truth.get(r["doc_id"]) for s in r["offending"]]
    assert np.mean([any(b in x for b in ("dreck", "pestilent", "vilewort")) for x in found]) > 0.9
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect() if r["doc_id"] < 900} and toxicity.score(docs.limit(0), labels).count() == 0


def test_quality_held_out(spark, labelled):
    docs = spark.createDataFrame(labelled[0], "doc_id long, text string, tails string")
    grades = spark.createDataFrame(labelled[1], "doc_id long, grade int, toxic int").select("doc_id", "grade")
    rows = quality.score(docs, grades).withColumn("held", sampling.remainder("doc_id") == 2).collect()
    truth = {i: g for i, g, _ in labelled[1] if g is not None}
    assert auc([(r["tails"][0], int(truth[r["doc_id"]] > 0)) for r in rows if r["held"] and r["doc_id"] in truth]) > 0.97
    assert all(r["tails"][0] >= r["tails"][1] and abs(sum(r["tails"]) - r["expected_grade"]) < 1e-9 for r in rows)
    assert quality.score(docs, grades.limit(0)).count() == len(labelled[0])


def test_ordered_thresholds():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 400)
    bags = [np.repeat([g * 7 + 1, 99], 3).astype(np.int32) for g in y]
    t, theta = quality.fit_cumulative(bags, np.full(400, 2), y, np.ones(400), 4)
    assert (np.diff(t) > 0).all() and (np.diff([theta[g * 7 + 1] for g in range(4)]) > 0).all()


def test_sample_is_bounded_and_not_held_out(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    got = sampling.labelled_sample(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("grade")), each=100, most_bytes=100)
    assert got.groupBy("grade").count().collect().__len__() == 2 and got.count() == 200 and all(r["weight"] > 10 for r in got.collect())
    assert got.select(F.split("text", " ")[1].cast("long").alias("i")).filter(sampling.remainder("i") == 2).count() == 0


def test_stored_tables_can_be_cleared(spark):
    from meshframe.llm import store

    df = store.stored(spark.range(3).toDF("x"), "some")
    assert df.count() == 3 and store.side(df).count() == 3
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path)
    store.clear(spark)
    assert not os.path.exists(path)


# All operators ------------------------------------------------------------------------------------


def test_columns_of_any_name_are_carried(spark):
    """Dots, backticks, blanks, struct fields with blanks, and names that clash; repeated rows, nulls, an empty table."""
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("a`b.c d", T.IntegerType()), T.StructField("s", T.StructType([T.StructField("x y", T.StringType())])), *(T.StructField(c, T.StringType()) for c in ("Score", "kept", "items", "ids", "once", "text_key", "tails"))])
    text = "one two three four five six. " * 9
    docs = spark.createDataFrame([(1, text, 7, ("v",), *"abcdefg"), (1, text, 7, ("v",), *"abcdefg"), (2, None, None, None, *[None] * 7), (None, "", 1, (None,), *"abcdefg")], kind)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    grades = labels.withColumnRenamed("toxic", "grade")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for make in (lambda d: toxicity.score(d, labels), lambda d: quality.score(d, grades), lambda d: find_leaks(d, bench), lambda d: remove_repeats(d), lambda d: bpe.encode(d, path, public_tokenizers.PATTERN)):
        got = make(docs)
        rows = got.collect()
        assert len(rows) == 4 and {"a`b.c d", "s"} <= set(got.columns) and len({c.lower() for c in got.columns}) == len(got.columns)
        assert sorted((r["a`b.c d"] or 0, r["s"] and r["s"]["x y"]) for r in rows)[-1] == (7, "v")
        assert make(docs.limit(0)).count() == 0


def test_scores_equal_brute_force(spark):
    """Noisy-or and tails recomputed in plain Python from the fitted weights."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["vile", "nice", "tree", "lake", "Moon"]) + rng.choice(["", ".", "!", "\n"]) for _ in range(rng.randrange(1, 60)))) for i in range(80)] + [(80, None), (81, ""), (82, "..."), (83, "tree " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.coalesce(F.col("text").contains("vile").cast("int"), F.lit(0)).alias("toxic"))
    bias, theta = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    for i, text in rows:
        clean, bad = 1.0, 0
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = re.findall(r"[^\W\d_]+", sentence.lower())
            for k in range(0, len(words), toxicity.LONGEST):
                z = bias + sum(theta[f] for w in words[k : k + toxicity.LONGEST] for f in toxicity.features(w))
                p = 1 / (1 + np.exp(-z))
                clean *= 1 - p
                bad += p >= toxicity.THRESHOLD
        assert abs(got[i]["score"] - (1 - clean)) < 1e-6 and len(got[i]["offending"]) == bad


def test_tails_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["poor", "fair", "good", "tree!!", "7"]) for _ in range(rng.randrange(1, 50)))) for i in range(90)] + [(90, None), (91, ""), (92, "good " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = docs.select("doc_id", F.when(F.col("text").contains("poor"), 0).when(F.col("text").contains("fair"), 1).otherwise(2).alias("grade"))
    thresholds, theta = quality.fit(docs, grades)
    assert list(thresholds) == sorted(thresholds)
    for r in quality.score(docs, grades).collect():
        tokens = (r["text"] or "").split()
        z = sum(theta[f] for t in tokens for f in quality.features(t)) + theta[quality._AGAIN] * sum(a == b for a, b in zip(tokens, tokens[1:]))
        tails = [1 / (1 + np.exp(c - z / max(1, len(tokens)))) for c in thresholds]
        assert np.allclose(r["tails"], tails, atol=1e-9) and abs(r["expected_grade"] - sum(tails)) < 1e-9
