"""Archives on storage: files closed by bytes, damaged files put aside, large files read as they come."""

import gzip
import hashlib
import os
import random

import pytest

from meshframe.llm import warc

HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"


def _body(n):
    return HTTP + hashlib.sha256(str(n).encode()).digest() * 40


def _arc(version, *numbers):
    return warc.arc_file(version, [(f"http://h/{n}", "1.2.3.4", "20010203040506", "text/html", _body(n)) for n in numbers])


def test_files_are_closed_by_bytes(spark, tmp_path):
    """Small pages, then large ones next to each other, then one that is larger than a file."""
    rng = random.Random(5)
    sizes = [50] * 200 + [1 << 20] * 12 + [5 << 20] + [50] * 20
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefgh", k=64)) * (n // 64 + 1)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    arcs, out, most = str(tmp_path / "arcs"), str(tmp_path / "warcs"), 3 << 20
    warc.write_arcs(df, arcs, file_bytes=most)
    warc.convert_arcs(spark, arcs, out, file_bytes=most)
    for folder, reader in ((arcs, warc.read_arc), (out, warc.read_warc)):
        seen = 0
        for f in sorted(os.listdir(folder)):
            if not f.endswith(".gz"):
                continue
            raw = gzip.decompress(open(f"{folder}/{f}", "rb").read())
            records = list(reader(raw))
            assert len(raw) <= most or len(records) == 2
            seen += len(records) - 1 if records else 0
        assert seen == len(rows)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, out).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows}


def test_damaged_files_are_put_aside(spark, tmp_path):
    whole, cut, packed, none = _arc(1, 1, 2, 3), _arc(2, 4, 5, 6), _arc(1, 7, 8), b"no archive"
    arcs = tmp_path / "arcs"
    arcs.mkdir()
    (arcs / "whole.arc").write_bytes(whole)
    (arcs / "cut.arc").write_bytes(cut[: cut.index(b"http://h/6") + 90])
    members = [gzip.compress(packed[: packed.index(b"http://h/8")]), gzip.compress(packed[packed.index(b"http://h/8") :])]
    (arcs / "packed.arc.gz").write_bytes(members[0] + members[1][:-20])
    (arcs / "none.arc").write_bytes(none)
    (arcs / "huge.arc").write_bytes(b"http://h/9 1.2.3.4 20010203040506 text/html 99999999999999999\nshort")
    with pytest.raises(Exception, match="cut short"):
        warc.convert_arcs(spark, str(arcs), str(tmp_path / "all"), glob="cut.arc")
    warc.convert_arcs(spark, str(arcs), str(tmp_path / "warcs"), broken=str(tmp_path / "broken"))
    uris = sorted(r["target_uri"] for r in warc.read_archives(spark, str(tmp_path / "warcs")).collect())
    assert uris == [f"http://h/{n}" for n in (1, 2, 3, 4, 5, 7)]
    aside = {os.path.basename(r["file"]): (r["records"], r["error"]) for r in spark.read.parquet(str(tmp_path / "broken")).collect()}
    assert {f: n for f, (n, _) in aside.items()} == {"cut.arc": 3, "packed.arc.gz": 2, "none.arc": 0, "huge.arc": 0}
    assert all(e for _, e in aside.values()) and "cut short" in aside["cut.arc"][1] and "without an end" in aside["none.arc"][1]
    warc.convert_arcs(spark, str(arcs), str(tmp_path / "good"), glob="whole.arc", broken=str(tmp_path / "no"))
    assert spark.read.parquet(str(tmp_path / "no")).count() == 0


def test_large_files_are_opened_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "IN_MEMORY", 100)
    arcs = tmp_path / "with blank"
    arcs.mkdir()
    (arcs / "a.arc").write_bytes(_arc(1, 1, 2))
    (arcs / "b.arc.gz").write_bytes(gzip.compress(_arc(2, 3)) + gzip.compress(_arc(1, 4)))
    (arcs / "c.arc").write_bytes(b"")
    assert {r["content"] is None for r in warc._files(spark, str(arcs), None).collect() if not r["path"].endswith("c.arc")} == {True}
    assert sorted(r["url"] for r in warc.read_arcs(spark, str(arcs)).filter("kind = 'response'").collect()) == [f"http://h/{n}" for n in (1, 2, 3, 4)]
    warc.convert_arcs(spark, str(arcs), str(tmp_path / "warcs"))
    got = {r["target_uri"]: r["payload_digest"] for r in warc.read_archives(spark, str(tmp_path / "warcs")).collect()}
    assert got == {f"http://h/{n}": hashlib.sha256(_body(n)[len(HTTP) :]).hexdigest() for n in (1, 2, 3, 4)}


@pytest.mark.parametrize("head", ["filedesc://x", "filedesc://x 0 2020 text/plain 0", "filedesc://x 0 2020 text/plain -4"])
def test_openings_without_a_version(head):
    with pytest.raises(ValueError):
        list(warc.read_arc(f"{head}\n".encode()))
