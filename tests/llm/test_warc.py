"""Archives of several files, rows of any kind, and offsets that lead to each record."""

import gzip
import hashlib
import random

from trialflow.llm import warc


def pages(seed=3):
    rng = random.Random(seed)
    rows = [(i, f"http://h{i % 7}.x/{i}", "".join(rng.choice("ab<é>\n") for _ in range(rng.choice((0, 10, 990, 1500))))) for i in range(120)]
    rows += [(500 + i, "u", rows[i][2]) for i in range(0, 120, 3)]
    return rows + [(900, None, None), (901, "http://a b/", ""), (None, "u", "z" * 1200), (902, "u", "z" * 1200), (903, "u", "\r\n\r\nWARC/1.0\r\n\r\n" * 90), (904, "u", "y" * 300_000)]


def test_archives_of_several_files_give_all_pages_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = pages()
    frame = spark.createDataFrame([(*r, b"x", 1, "p", 2) for r in rows], "page_id long, url string, html string, payload binary, refers_to int, path string, n_records int")
    archives = warc.archive_pages(frame).cache()
    assert archives.count() > 5 and archives.agg({"n_records": "sum"}).first()[0] == len(rows)
    largest = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= warc.REVISIT_BYTES:
            largest[data] = max(i, largest.get(data, i))
    got = {r["page_id"]: r for r in warc.read_archives(archives).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data, r = (html or "").encode(), got[i]
        first = i is None or largest.get(data, i) == i
        if i is not None:
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", largest[data]))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == data


def test_every_offset_is_a_member_of_its_own(spark):
    frame = spark.createDataFrame(pages(4), "page_id long, url string, html string")
    entries = warc.offset_index(warc.archive_pages(frame)).collect()
    assert len(entries) == len(pages(4))
    for r in entries[:40]:
        with open(r["path"].removeprefix("file:"), "rb") as source:
            source.seek(r["offset"])
            record = gzip.decompress(source.read(r["length"]))
        assert r["record_id"].encode() in record and record.startswith(b"WARC/")
