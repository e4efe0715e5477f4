import hashlib

import pytest

from tablewright.llm import archives as A

PAGES = "page_id long, url string, html string, kind int, digest string"
ODD = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nhttp://a 0.0.0.0 2001 t 5\n\n\r\n\r\n"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"", b"\n\n", b"a\nhttp://b 0.0.0.0 20010203040506 text/html 9\n", "é".encode() * 5, b"filedesc://no 1"]
    raw = A.arc_file([A.arc_record(f"http://h/{i} x", "20010203040506", b, version) for i, b in enumerate(bodies)], "2001", version)
    found = list(A.parse_arc(raw))
    assert [f["body"] for f in found] == bodies
    assert found[1]["url"] == "http://h/1%20x"
    assert set(found[0]) == {*A.ARC_FIELDS[version], "body"}


@pytest.mark.parametrize("raw", [b"http://a 0.0.0.0 2001 t 5\nabc", b"no line end", b"http://a 0.0.0.0 2001 t x\nabc", b"http://a t 3\nabc\n"])
def test_broken_arc_is_refused(raw):
    with pytest.raises(ValueError):
        list(A.parse_arc(raw, 1))


def test_warc_of_an_arc_record():
    arc = {"url": "http://a/", "ip": "1.2.3.4", "date": "20010203040506", "type": "text/html", "body": b"hello\r\n\r\n"}
    raw = A.warc_record(arc) + b"\r\n\r\n" + A.warc_record(arc, "revisit") + b"\r\n\r\n"
    (head, body), (again, nothing) = A.parse_warc(raw)
    assert body == arc["body"]
    assert nothing == b""
    assert head["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert head["WARC-Payload-Digest"] == again["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
    assert again["WARC-Payload-Length"] == "9"
    assert again["WARC-Profile"] == A.SAME_PAYLOAD
    assert A.warc_record(arc) == A.warc_record(dict(arc))
    with pytest.raises(ValueError):
        list(A.parse_warc(A.warc_record(arc)[:-2]))


@pytest.mark.parametrize(("date", "iso"), [("2001", "2001-01-01T00:00:00Z"), ("", "1970-01-01T00:00:00Z"), ("20019999", "1970-01-01T00:00:00Z")])
def test_dates(date, iso):
    assert A.warc_date(date) == iso


def brute(rows, least):
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        first = max((j for j, _, h, *_ in rows if (h or "").encode() == raw and j is not None), default=None)
        again = len(raw) >= least and first is not None and i != first
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_pages_through_archives(spark, tmp_path):
    big = "ü" * 700
    bodies = [ODD, ODD * 20, big, big, None, "", "small", "small", ODD * 20, big, "z" * 999, "z" * 999, "z" * 1000, "z" * 1000, "long " * 40_000]
    rows = [(i * 5, f"http://h/{i}" if i % 4 else None, b, 1, "d") for i, b in enumerate(bodies)]
    rows += [(None, "u", big, 1, "d"), (None, "u", "only null " * 200, 1, "d"), (None, "v", "only null " * 200, 1, "d"), (45, "w", big, 1, "d")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = A.archive_pages(df, str(tmp_path / "w"), per_file=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 1000)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert len(files) >= 5
    assert all(p.read_bytes().startswith(b"WARC/1.0\r\n") for p in files)


def test_pages_whose_url_looks_like_a_version_block(spark, tmp_path):
    rows = [(i, f"filedesc://{i}", body, 1, "d") for i, body in enumerate(["1 a", "z" * 2000, "z" * 2000, "", None])]
    got = A.archive_pages(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 1000)
    raw = A.arc_file([A.arc_record(r[1], "2001", b"2 b") for r in rows], "2001")
    assert [r["url"] for r in A.parse_arc(raw)] == [r[1] for r in rows]


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "MOST_BYTES", 20_000, raising=False)
    rows = [(i, f"http://h/{i}", f"{i} " * 900, 1, "d") for i in range(10, 40)] + [(7, "u", "7 " * 30_000, 1, "d")]
    got = A.archive_pages(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 1000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    assert sizes[-1] < 61_000
    assert all(s <= 20_000 for s in sizes[:-1])


def test_legacy_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for version in (1, 2):
        records = [A.arc_record(f"http://h/{version}/{i}", "20010203040506", f"body {i}\n".encode(), version) for i in range(3)]
        (tmp_path / "in" / f"{version}.arc").write_bytes(A.arc_file(records, "20010203040506", version))
    A.write_warc(A.convert(A.read_arc(spark, str(tmp_path / "in"))), str(tmp_path / "out"))
    got = A.read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted(bytes(r["body"]) for r in got) == sorted(f"body {i}\n".encode() for i in range(3) for _ in (1, 2))
    assert {r["page_id"] for r in got} == {None}


def test_empty(spark):
    assert A.archive_pages(spark.createDataFrame([], PAGES)).collect() == []
