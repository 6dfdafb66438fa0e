import base64
import hashlib
import zlib

from remedy.llm import op2_warc as o


def member(i, payload, **kw):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    r = o._record(i, "http://x/" + str(i), payload, o.payload_digest(payload), None, False)
    return z.compress(r) + z.flush()


def test_round_trip_with_revisits_nulls_and_clashing_columns(spark):
    rows = [(5, "u", "<p>same</p>", 1), (3, "v\r\n%", "<p>same</p>", 1), (9, None, None, 2), (4, "w", "", 2), (1, "x", "é" * 1000, 3),
            (None, "y", "<p>same</p>", 4), (3, "v\r\n%", "<p>same</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    got = o.read_records(o.write_archives(pages.select("page_id", "url", "html"))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for pid, url, html, _ in rows:
        body = (html or "").encode()
        for r in by[pid]:
            assert r.payload_bytes == len(body)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert r.url == url
    assert [r.record_type for r in by[3]] == ["response", "response"] and by[5][0].refers_to == 3
    assert by[None][0].record_type == "revisit" and by[9][0].refers_to == 4 and by[4][0].refers_to is None
    assert bytes(by[1][0].payload).decode() == "é" * 1000


def test_min_bytes_makes_small_payloads_responses(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "page_id long, url string, html string")
    got = o.read_records(o.write_archives(pages, min_bytes=10)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert o.read_records(o.write_archives(pages)).count() == 0


def test_salvage_recovers_after_damage_and_logs_gaps(spark):
    parts = [member(i, (f"<p>{i}" + "y" * i * 40).encode()) for i in range(30)]
    data = bytearray(b"".join(parts))
    at = sum(map(len, parts[:7]))
    data[at + 30] ^= 0xFF  # inside member 7
    cut = bytes(data[:-6])  # member 29 is cut off
    found = list(o.salvage(cut))
    good = [x["page_id"] for _, _, x in found if isinstance(x, dict)]
    gaps = [(s, e) for s, e, x in found if isinstance(x, str)]
    assert good == [i for i in range(29) if i != 7]
    assert gaps[0] == (at, at + len(parts[7])) and gaps[-1][1] == len(cut)
    covered = sorted((s, e) for s, e, _ in found)
    assert covered[0][0] == 0 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    df = spark.createDataFrame([("a", cut), ("b", b""), ("c", None)], "archive string, content binary")
    assert o.read_gaps(df).count() == len(gaps) and o.read_records(df).count() == len(good)


def test_salvage_plain_records_resume_at_version_line():
    a, b = (o._record(i, None, b"p%d" % i, o.payload_digest(b"p%d" % i), None, False) for i in (1, 2))
    bad = a.replace(b"p1\r\n", b"pX\r\n")  # digest no longer matches
    found = list(o.salvage(bad + b + b"junk"))
    assert [x["page_id"] for _, _, x in found if isinstance(x, dict)] == [2]
    assert [(s, e) for s, e, x in found if isinstance(x, str)] == [(0, len(bad)), (len(bad + b), len(bad + b) + 4)]


def test_salvage_of_members_with_several_records():
    parts = [o._record(i, None, (b"%d" % i) * 700, o.payload_digest((b"%d" % i) * 700), None, False) for i in range(8)]
    bad = list(parts)
    bad[3] = bad[3].replace(b"333", b"3x3", 1)  # its digest no longer matches

    def packed(records, level=6):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(b"".join(records)) + z.flush()

    def ids(data):
        found = list(o.salvage(data))
        assert all(0 <= s < e <= len(data) for s, e, _ in found)
        return [x["page_id"] for _, _, x in found if isinstance(x, dict)], [x for _, _, x in found if isinstance(x, str)]

    tail = member(20, b"later")
    assert ids(packed(parts) + tail) == ([*range(8), 20], [])
    good, gaps = ids(packed(bad) + tail)
    assert good == [0, 1, 2, 4, 5, 6, 7, 20] and len(gaps) == 1 and "digest" in gaps[0]
    for level in (0, 6):
        whole = packed(parts, level)
        crc = whole[:-8] + bytes([whole[-8] ^ 0xFF]) + whole[-7:]
        good, gaps = ids(crc + tail)
        assert good == [*range(8), 20] and len(gaps) == 1
        good, gaps = ids(whole[:len(whole) * 2 // 3])  # cut off
        assert good == list(range(len(good))) and 2 <= len(good) < 8 and gaps
    good, gaps = ids(packed(parts, 0).replace(b"555", b"5x5", 1) + tail)
    assert good == [0, 1, 2, 3, 4, 6, 7, 20] and len(gaps) == 2  # the record, and the CRC
