"""Registered queries that SQL can't express, against brute-force versions on the given tables."""

import base64
import collections
import hashlib
import html as chars
import os
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from meshframe.llm import toxicity  # noqa: E402
from meshframe.llm.queries import QUERIES  # noqa: E402
from test_llm_operators import ALNUM, LOWER, auc, brute_components, brute_removed  # noqa: E402

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="the given tables are elsewhere")


def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


@pytest.mark.parametrize(("name", "label"), [("op1_toxicity", "toxic"), ("op4_ordinal_quality", "quality")])
def test_classifiers_on_held_out_labels(spark, name, label):
    got = QUERIES[name](spark, "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else MEDIUM).collect()
    truth = {r["doc_id"]: r[label] for r in rows(spark, "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else MEDIUM, "labels")}
    assert auc([(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= (toxicity.THRESHOLD if label == "toxic" else 0.5)) for r in got)


def test_bpe_query(spark):
    own, texts = encoding(), {r["doc_id"]: r["text"] or "" for r in rows(spark, MEDIUM, "documents")}
    got = QUERIES["op5_byte_bpe"](spark, MEDIUM).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))


def test_page_query(spark):
    pages = {r["page_id"]: r["html"] for r in rows(spark, MEDIUM, "pages")}
    for r in QUERIES["op9_html_text"](spark, MEDIUM).collect():
        page = pages[r["page_id"]]
        article = page[page.index("<article>") + 9 :].split("</article>")[0]
        lines = re.sub(r"<[^>]*$", "", re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", "\n", article))).split("\n")
        assert r["text"] == "\n".join(x for x in (" ".join(chars.unescape(y).split()) for y in lines) if x)


def test_neighbour_query(spark):
    table = rows(spark, MEDIUM, "embeddings")
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    got = collections.defaultdict(set)
    for r in QUERIES["op10_balanced_lists"](spark, MEDIUM).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits.append(len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert len(got) == len(hits) and np.mean(hits) >= 0.9


def test_pipeline_stages_equal_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SMALL)
        seen[name] = (before, docs.collect(), docs.columns)
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(c == columns for n, (_, _, c) in seen.items() if n != "byte_bpe")

    before, after, _ = seen["toxicity"]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(before), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if scores[r["doc_id"]] < 0.3}
    before, after, _ = seen["ngram_jaccard"]
    groups = brute_components([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {i for i, (_, root) in groups.items() if i == root}
    before, after, _ = seen["substring_dedup"]
    texts = {r["doc_id"]: r for r in after}
    for r, (kept, _, removed) in zip(before, brute_removed([r["text"] for r in before], 35), strict=True):
        want = b" ".join(kept).decode() if removed else r["text"]
        assert texts[r["doc_id"]]["text"] == want and texts[r["doc_id"]]["n_chars"] == (len(want) if removed else r["n_chars"])
    before, after, _ = seen["decontamination"]
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    items = [words(r["text"]) for r in rows(spark, SMALL, "benchmark")]
    windows = {tuple(w[s : s + min(10, len(w))]) for w in items for s in range(max(1, len(w) - 9)) if w}
    clean = {r["doc_id"] for r in before if not any(tuple(w[s : s + n]) in windows for w in [words(r["text"])] for n in {len(x) for x in windows} for s in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in after} == clean
    before, after, _ = seen["byte_bpe"]
    own, kept = encoding(), {r["doc_id"]: r["text"] or "" for r in before}
    assert {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in after} == {i: (len(own.encode_ordinary(t)), sha(t)) for i, t in kept.items()}
    assert pipeline.run(spark, SMALL).count() == len(after)


ODD = ["score", "offending", "n_hit", "n_words", "items", "spans", "kept", "n_removed", "ids", "once", "text_key", "class_key", "root", "carried_0", "a`b", "c.d e", "gone"]


def odd_rows():
    """Repeated rows, one id with two texts, null ids and texts, blanks, a long text."""
    prose = lambda k, n: " ".join(f"{k}word{i}" for i in range(n))
    near = prose("a", 100) + " other end"
    rows = [(1, prose("a", 100)), (1, prose("a", 100)), (1, prose("b", 80)), (2, near), (3, prose("c", 60)), (None, prose("c", 60)), (None, prose("d", 50)), (None, prose("d", 50)), (4, None), (4, None), (None, None), (5, ""), (5, ""), (6, "  "), (7, prose("e", 60_000)), (8, "short"), (8, "short"), (9, "SHORT")]
    return [(i, t, *(f"{c}{k}" for c in ODD)) for k, (i, t) in enumerate(rows)]


def test_pipeline_stages_on_odd_rows_and_names(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in ODD)
    docs = spark.createDataFrame(odd_rows(), kind).repartition(3)
    for name, stage in pipeline.STAGES:
        before, source = docs.collect(), docs
        got = stage(spark, docs, SMALL)
        after = got.collect()
        docs = spark.createDataFrame(after, got.schema)
        if name == "ngram_jaccard":
            words = lambda r: (r["text"] or "").split()
            groups = collections.defaultdict(list)
            roots = brute_components([(k, r["text"]) for k, r in enumerate(before)])
            for k, r in enumerate(before):
                groups[roots[k][1] if words(r) else -1 - k].append(r)
            assert len(after) == len(groups)
            left = collections.Counter((r["doc_id"], r["text"]) for r in after)
            for rows in groups.values():
                best = min(((r["doc_id"] is None, r["doc_id"] or 0) for r in rows))
                assert sum(left[k] for k in {(r["doc_id"], r["text"]) for r in rows if (r["doc_id"] is None, r["doc_id"] or 0) == best}) >= 1
            assert {(r["doc_id"], r["text"]) for r in after} >= {(1, odd_rows()[2][1]), (4, None), (5, "")}
        elif name != "byte_bpe":
            assert collections.Counter(after) == collections.Counter(before)  # no passage repeats once copies are gone
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", *ODD] and all(r[2 + i].startswith(c) and len({x[len(c):] for x, c in zip(r[2:], ODD)}) == 1 for r in after for i, c in enumerate(ODD))
        if name != "toxicity":  # its fit would have no sample
            assert stage(spark, source.limit(0), SMALL).count() == 0
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)
