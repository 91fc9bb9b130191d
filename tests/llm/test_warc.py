from __future__ import annotations

import hashlib
import io

import pytest
import zstandard

from seisframe.llm import common, warc

PAGES = [(1, "http://a.example/", "<p>" + "long page " * 150), (2, "http://b.example/ x\n", "<p>" + "long page " * 150), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "é", "é日本" * 400), (9, "u", "<p>" + "long page " * 150), (None, "u", "z" * 1200)]
SCHEMA = "page_id long, url string, html string, same string, first int"


def brute(pages):
    out = set()
    for i, _, html in pages:
        data = (html or "").encode()
        first = max((j for j, _, h in pages if (h or "").encode() == data and j is not None), default=None)
        again = len(data) >= 1000 and i != first
        out.add((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again and first is not None else "response", first if again else None))
    return out


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], SCHEMA).repartition(3)


def test_round_trip(pages):
    assert {tuple(r) for r in warc.round_trip(pages).collect()} == brute(PAGES)


def test_archives_are_readable_record_by_record(pages, spark):
    archives, folder = warc.archive(pages)
    listed = archives.collect()
    assert sum(r.records for r in listed) == len(PAGES)
    for r in listed:
        with open(r.path, "rb") as f:
            data = f.read()
        assert len(data) == r.bytes and data[:4] == (0x184D2A5D).to_bytes(4, "little")
        records = [warc.parse(x)[0] for x in warc.frames(io.BytesIO(data))]
        assert records[0]["warc-type"] == "warcinfo" and len(records) == r.records + 1
    payloads = {r.page_id: r.payload for r in warc.read(archives, folder).where("record_type = 'response'").collect()}
    assert bytes(payloads[7]).decode() == PAGES[6][2] and bytes(payloads[5]) == b""


def test_damage_is_noticed(spark, tmp_path):
    compress = zstandard.ZstdCompressor()
    good = warc.record(1, "u", b"payload", None)
    path = tmp_path / "x.warc.zst"
    path.write_bytes((0x184D2A5D).to_bytes(4, "little") + bytes(4) + compress.compress(good.replace(b"payload", b"pAyload")))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark.createDataFrame([(str(path),)], "path string"), str(tmp_path)).collect()
    with pytest.raises(ValueError, match="cut short"):
        list(warc.frames(io.BytesIO((0x184D2A5D).to_bytes(4, "little") + bytes(4) + compress.compress(good)[:-5])))


def test_dictionary_is_trained_or_raw():
    samples = [warc.record(k, f"http://h{k}.example/", (f"<html><head><title>{k}</title></head>" + "text of a page " * (k % 9)).encode(), None) for k in range(300)]
    assert warc.build_dictionary(samples, 4096)[:4] == b"\x37\xa4\x30\xec"
    assert warc.build_dictionary([b"one"], 4096) == b"one" and warc.build_dictionary([]) == b""


def test_empty_table_and_full_archives(spark, pages):
    nothing = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(nothing).collect() == []
    folder = common.scratch(spark, "small")
    archives = common.staged(warc.write(warc.roles(pages), folder, b"", archive_bytes=1), "archives")
    assert archives.count() == len(PAGES)
    assert {tuple(r)[:5] for r in warc.read(archives, folder).collect()} == brute(PAGES)
