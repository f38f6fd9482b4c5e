from __future__ import annotations

import hashlib
import os

import pytest

from queuemill.llm import warc
from queuemill.session import scratch_path

BIG = "<p>" + "é payload " * 30


@pytest.fixture(scope="module")
def page_rows():
    return [
        (1, "http://a/1", BIG), (2, "http://a/2", BIG), (2, "http://a/2", BIG), (None, "http://a/n", BIG),
        (3, None, "small"), (4, "http://a/4 x\ny", "small"), (5, "http://b", None), (6, "http://b", ""),
        (7, "http://c", "x" * 99), (8, "http://c", "x" * 99), (9, "http://c", "WARC/1.1\r\n\r\n" * 20), (10, "u", BIG * 500),
    ]


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return spark.createDataFrame(page_rows, "page_id long, url string, html string").repartition(3)


def test_round_trip(pages, page_rows):
    wanted = []
    for page_id, _, html in page_rows:
        raw = (html or "").encode()
        revisit = html == BIG and page_id != 1
        digest = hashlib.sha256(raw).hexdigest()
        wanted.append((page_id, len(raw), digest, "revisit" if revisit else "response", 1 if revisit else None))
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(wanted, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark, pages, page_rows):
    folder = scratch_path(spark, "test-warc")
    written = warc.write_warc(pages.selectExpr("*", "1 as digest"), folder, archive_bytes=1_000)
    assert written.count() > 3
    found = warc.read_warc(spark, folder)
    assert found.filter("reason is not null").count() == 0
    texts = {r["page_id"]: r["payload"] for r in found.filter("record_type = 'response'").collect()}
    assert texts[10].decode() == BIG * 500 and texts[5] == b"" and texts[1].decode() == BIG


def archive(packed, count=6):
    parts = []
    for i in range(count):
        payload = f"page {i} ".encode() * 20
        content = warc.record(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), None, False)
        parts.append(warc._member(content) if packed else content)
    return parts


def salvaged(content):
    found = list(warc.salvage(content))
    edges = [(f[0], f[1]) for f in found]
    assert edges[0][0] == 0 and edges[-1][1] == len(content)
    assert all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    names = [int(f[2]["warc-x-page-id"]) if f[2] else f[4] for f in found]
    return names


@pytest.mark.parametrize("packed", [True, False])
def test_sound_archive(packed):
    assert salvaged(b"".join(archive(packed))) == list(range(6))
    assert list(warc.salvage(b"")) == []


@pytest.mark.parametrize("packed", [True, False])
def test_damage_is_quarantined(packed):
    parts = archive(packed)
    middle = bytearray(parts[2])
    middle[len(middle) // 2] ^= 255
    broken = [*parts[:2], bytes(middle), *parts[3:]]
    names = salvaged(b"".join(broken))
    assert [n for n in names if isinstance(n, int)] == [0, 1, 3, 4, 5]
    assert len([n for n in names if isinstance(n, str)]) == 1
    lost_start = b"".join([parts[0][10:], *parts[1:3], b"some noise\n", *parts[3:]])
    assert [n for n in salvaged(lost_start) if isinstance(n, int)] == [1, 2, 3, 4, 5]
    cut_end = b"".join(parts)[:-30]
    assert [n for n in salvaged(cut_end) if isinstance(n, int)] == [0, 1, 2, 3, 4]


def test_false_starts_do_not_end_the_search():
    parts = archive(True)
    content = b"".join([parts[0], warc.MEMBER * 3, parts[1]])
    assert [n for n in salvaged(content) if isinstance(n, int)] == [0, 1]
    plain = archive(False)
    content = b"".join([plain[0], b"WARC/1.1\r\nbroken\r\n\r\nWARC/1.0\r\n", plain[1]])
    assert [n for n in salvaged(content) if isinstance(n, int)] == [0, 1]


def test_gap_rows(spark, tmp_path):
    parts = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(b"".join([parts[0], os.urandom(50), parts[1]]))
    (tmp_path / "b.warc").write_bytes(b"not an archive")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in rows if r["reason"] is None) == [0, 1]
    gaps = {os.path.basename(r["archive"]): r["length"] for r in rows if r["reason"]}
    assert gaps == {"a.warc.gz": 50, "b.warc": 14}


def numbers(content):
    found = list(warc.salvage(content))
    return [int(f[2]["warc-x-page-id"]) for f in found if f[2]], [f[4] for f in found if not f[2]]


def test_many_records_in_one_member():
    plain = archive(False, 400)
    assert numbers(warc._member(b"".join(plain))) == (list(range(400)), [])
    broken = warc._member(b"".join([*plain[:2], plain[2].replace(b"page 2", b"page x"), *plain[3:]]))
    assert numbers(broken) == ([0, 1, *range(3, 400)], ["block digest differs"])
    whole = warc._member(b"".join(plain))
    kept, gaps = numbers(whole[: len(whole) * 2 // 3])
    assert kept == list(range(len(kept))) and 200 < len(kept) < 400 and gaps == ["gzip member is cut off"]
    kept, gaps = numbers(whole[:-8] + bytes(8) + archive(True, 1)[0])
    assert kept == [*range(399), 0] and gaps == ["gzip member is damaged"]
    hurt = bytearray(whole)
    hurt[len(hurt) // 2 : len(hurt) // 2 + 40] = b"\xff" * 40
    kept, gaps = numbers(bytes(hurt))
    assert 100 < len(kept) < 400 and kept[:100] == list(range(100)) and gaps == ["gzip member is damaged"]
