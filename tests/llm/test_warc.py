import base64
import gzip
import hashlib

from tablewright.llm import warc

HTML = [
    (1, "http://a", "<p>one</p>"),
    (2, "http://b", "<p>two</p>\r\n\r\nWARC/1.1\r\nx"),
    (3, "http://c\r\nX: y", "<p>one</p>"),
    (4, None, None),
    (5, "u", ""),
    (None, "n", "<p>one</p>"),
    (6, "long", "é" * 400_000),
    (6, "long", "é" * 400_000),
]


def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in HTML], "page_id long, url string, html string, size string")


def test_round_trip(spark):
    rows = warc.archive_round_trip(pages(spark)).collect()
    assert len(rows) == len(HTML)
    first = {}
    for i, _, html in HTML:
        body = (html or "").encode()
        if i is not None:
            first[body] = min(first.get(body, i), i)
    want = []
    for i, _, html in HTML:
        body = (html or "").encode()
        other = None if first[body] == i else first[body]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if other else "response", other))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_least_and_empty(spark):
    rows = warc.archive_round_trip(pages(spark), least=11).collect()
    assert {r.record_type for r in rows} == {"response"}
    assert warc.archive_round_trip(pages(spark).limit(0)).count() == 0


def record(i, payload, version=b"WARC/1.1"):
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    head = b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n"
    return version + b"\r\n" + head % (i, digest, len(payload)) + b"\r\n" + payload + b"\r\n\r\n"


def ids(found):
    return [int(x.head[b"warc-record-id"][10:-1]) for x in found if x.head is not None]


def gaps(found):
    return [(x.start, x.end) for x in found if x.head is None]


def test_plain_salvage():
    parts = [record(i, b"payload %d" % i * 20) for i in range(6)]
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == list(range(6)) and gaps(warc.salvage(whole)) == []
    at = len(parts[0]) + len(parts[1]) // 2
    broken = whole[:at] + b"\x00" * 7 + whole[at + 7 :]  # a byte of a payload or a header is lost
    found = list(warc.salvage(broken))
    assert ids(found) == [0, 2, 3, 4, 5]
    assert gaps(found) == [(len(parts[0]), len(parts[0]) + len(parts[1]))]
    cut = whole[: len(whole) - 5]
    assert ids(warc.salvage(cut)) == [0, 1, 2, 3, 4] and gaps(warc.salvage(cut))[0][1] == len(cut)
    junk = b"junk" + whole
    assert ids(warc.salvage(junk)) == list(range(6)) and gaps(warc.salvage(junk)) == [(0, 4)]
    assert ids(warc.salvage(b"")) == [] and gaps(warc.salvage(b"nothing")) == [(0, 7)]


def test_gzip_salvage():
    parts = [gzip.compress(record(i, bytes(range(256)) * (i + 1))) for i in range(6)]
    whole = warc.EMPTY_MEMBER.join(parts) + warc.EMPTY_MEMBER
    assert gzip.decompress(whole) == b"".join(map(gzip.decompress, parts))
    assert ids(warc.salvage(whole)) == list(range(6)) and gaps(warc.salvage(whole)) == []
    at = whole.index(parts[2]) + len(parts[2]) // 2
    found = list(warc.salvage(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]))
    assert ids(found) == [0, 1, 3, 4, 5]
    assert gaps(found)[0][0] == whole.index(parts[2]) and gaps(found)[0][1] <= whole.index(parts[3])
    wrong = gzip.compress(record(9, b"abc").replace(b"abc", b"abd"))  # a valid member with a wrong digest
    found = list(warc.salvage(parts[0] + wrong + parts[1]))
    assert ids(found) == [0, 1] and gaps(found) == [(len(parts[0]), len(parts[0]) + len(wrong))]
    assert next(x.reason for x in found if x.head is None) == "payload digest differs"


def test_reader_logs_gaps(spark, tmp_path):
    path = tmp_path / "a.warc"
    path.write_bytes(record(1, b"one") + b"lost" + record(2, b"two"))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r.page_id for r in rows if r.reason is None] == [1, 2]
    gap = next(r for r in rows if r.reason)
    assert gap.bytes == 4 and gap.reason == "no version line"
