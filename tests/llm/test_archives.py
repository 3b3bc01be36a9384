import gzip
import hashlib

from paperloom.llm import archives


def test_reads_both_versions_by_declared_length():
    one = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 71\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = b"HTTP/1.0 404 Gone\r\nX-Page-Id: 5\r\n\r\n<p>\n\nhttp://not.a.header 1 2 text/html 9\n</p>"
    block = b"2 0 Org\n" + " ".join(archives.ARC_FIELDS[2]).encode() + b"\n"
    two = b"filedesc://b.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 b.arc %d\n" % len(block) + block + b"\n"
    first = b"http://x/ 1.2.3.4 19970203040506 text/html %d\n" % len(body) + body + b"\n"
    second = b"http://y/ 1.2.3.4 19970203040506 text/plain 301 abc - 0 b.arc 5\nhello\n"
    size = len(b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n")
    one = one.replace(b"text/plain 71", b"text/plain %d" % size)
    got = list(archives.arc_records("f", gzip.compress(one + first + first + two + second)))
    assert [(r[2], r[3], r[7], r[8]) for r in got] == [(1, "http://x/", 404, "5"), (1, "http://x/", 404, "5"), (2, "http://y/", 301, "")]
    assert got[0][10] == body.partition(b"\r\n\r\n")[2] and got[2][10] == b"hello"
    assert got[0][11] == hashlib.sha1(got[0][10]).hexdigest()
    # What ends within a record gives the whole ones before it.
    assert len(list(archives.arc_records("f", one + first + first[:-9]))) == 1
    assert len(list(archives.arc_records("f", gzip.compress(one + first)[:-12]))) <= 1
    assert list(archives.arc_records("f", b"")) == []


def test_damaged_archives_give_what_is_whole_before():
    good = b"filedesc://a 0.0.0.0 19970101000000 text/plain 7\n1 0 Org" + b"http://x/ 1.2.3.4 19970203040506 text/html 5\nhello\n"
    bad = [
        b"filedesc://a 0.0.0.0 19970101000000 text/plain many\n", b"filedesc://a x 9\nno number", b"filedesc://a x 900\n1 0", b"http://x/ 1 2 3 -5\nhello",
        b"http://x/ 1 2 3 " + b"9" * 30 + b"\n", "http://x/ 1 2 3 ٣\nabc".encode(), b"\xff\xfe\n", b"filedesc://a x \n",
    ]
    for tail in bad:
        assert [r[10] for r in archives.arc_records("f", good + tail)] == [b"hello"], tail
        assert list(archives.arc_records("f", tail)) == []
    packed = gzip.compress(good)
    assert len(list(archives.arc_records("f", packed + b"\x1f\x8bnot gzip at all"))) <= 1
    assert list(archives.arc_records("f", b"\x1f\x8b\xff\xff broken head")) == []
    warc = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    lacking = [warc.replace(b"Content-Length: 2", b"Content-Length: two"), warc.replace(b"Content-Length: 2\r\n", b""), warc.replace(b"WARC-Type: resource\r\n", b""), warc.replace(b"WARC-Record-ID", b"X"), warc[:-6], b"junk"]
    for tail in lacking:
        got = list(archives.warc_records("f", warc + tail))
        assert [(r[1], r[2], r[3], r[4], r[6], r[8]) for r in got] == [("<urn:uuid:1>", "resource", None, None, None, 2)], tail
    assert list(archives.warc_records("f", b"\x1f\x8b\xff\xff")) == []
    revisit = warc.replace(b"resource", b"revisit").replace(b"Content-Length: 2", b"X-Payload-Length: x\r\nContent-Length: 2")
    assert [r[8:] for r in archives.warc_records("f", revisit)] == [(None, None)]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "k", "h") for r in rows], "page_id long, url string, html string, key string, head string")


def test_round_trip_and_revisits(spark):
    big, tail = "é" * 600, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    rows = [(1, "http://a/ b", big), (9, "u", big), (4, "u", big), (2, "u", "short"), (3, "u", "short"), (5, None, None), (None, "u", tail), (6, "-", ""), (7, "u", tail), (8, "u", "y" * 3_000_000), (10, "u", "z" * 1000), (10, "u", "z" * 1000)]
    got = archives.archive_pages(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert len({r.warc_id for r in got}) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.key, []).append(r)
    for page, _, html in rows:
        data = (html or "").encode()
        for r in by["" if page is None else str(page)]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    kind = {k: sorted((r.warc_type, r.refers_to) for r in v) for k, v in by.items()}
    assert kind["9"] == [("response", None)] and kind["1"] == kind["4"] == [("revisit", "9")]
    assert kind["2"] == kind["3"] == kind["5"] == kind["6"] == [("response", None)]
    assert kind["7"] == [("response", None)] and kind[""] == [("revisit", "7")]
    assert kind["10"] == [("response", None), ("revisit", "10")]
    assert all(len(r.warc_date) == 20 and r.warc_id.startswith("<urn:uuid:") for r in got)


def test_empty_table(spark):
    assert archives.archive_pages(pages_of(spark, []).filter("false")).collect() == []
