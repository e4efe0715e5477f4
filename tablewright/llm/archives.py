"""Legacy ARC archives converted to WARC: records parsed by their declared lengths, written and read as files."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.shared import pick, scratch_folder, written

#: The fields of a record line, by version of the ARC format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
#: How the version block of an ARC file names them.
FIELD_LINE = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of a record that repeats an earlier payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads below this many bytes are stored each time.
WORTH_A_REVISIT = 1000
#: Records of a WARC file, and its bytes unless a single record has more; a file is read whole by one task.
PER_FILE = 1000
MOST_BYTES = 32 << 20
#: Records and bytes of bodies that are handed on together.
TOGETHER, TOGETHER_BYTES = 200, 8 << 20


def arc_record(url: str, date: str, body: bytes, version: int = 1, mime: str = "text/html", name: str = "pages.arc") -> bytes:
    """A URL record: its line, as many bytes as the line declares, and a line end. White space in the url is
    escaped, since spaces part the fields."""
    plain = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    values = {"url": plain, "ip": "0.0.0.0", "date": date, "type": mime, "length": len(body)}
    values |= {"result": 200, "checksum": hashlib.md5(body).hexdigest(), "location": "-", "offset": 0, "filename": name}
    return " ".join(str(values[f]) for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_file(records: list[bytes], date: str, version: int = 1, name: str = "pages.arc") -> bytes:
    """A whole ARC file: the version block and the records."""
    body = f"{version} 0 tablewright\n{FIELD_LINE[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain " + (f"200 - - 0 {name} " if version == 2 else "")
    return f"{head}{len(body)}\n".encode() + body + b"\n" + b"".join(records)


def parse_arc(raw: bytes, version: int | None = None, file: bool = True) -> Iterator[dict]:
    """The URL records of ARC bytes: the fields of their line, and body.

    The version is read from the version block where a ``file`` begins with one; otherwise ``version`` holds.
    Later records, and records that aren't a file, are URL records whatever their url is. A body is the
    declared number of bytes, whatever they are; line ends between records are skipped. ValueError for a
    line that doesn't have the version's fields, or a body cut short.
    """
    at, begins = 0, file
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no record line at byte {at}")
        values = raw[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        opening, begins = begins and values[0].startswith("filedesc://"), False
        if not values[-1].isdigit():
            raise ValueError(f"no declared length at byte {at}")
        at = end + 1 + int(values[-1])
        body = raw[end + 1 : at]
        if len(body) != int(values[-1]):
            raise ValueError("the last record is cut short")
        if opening:
            stated = body[:1].decode()
            version = int(stated) if stated.isdigit() else version
            continue
        fields = ARC_FIELDS.get(version or 0)
        if fields is None or len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in a record line of version {version}")
        yield dict(zip(fields, values, strict=True)) | {"body": body}


def warc_identifier(url: str, date: str, digest: str) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {digest} {url}')}>"


def warc_date(date: str) -> str:
    """14 digits of an ARC date (fewer: padded with the first month, day and midnight) as an ISO time."""
    digits = "".join(c for c in date if c.isdigit())[:14]
    padded = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(padded, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(arc: dict, kind: str = "response", first: dict[str, str] | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the blank lines that end it.

    Identifier, time, type and digests are made from the ARC line and body. A revisit has no body but the
    length and digest of the one it repeats, and names the record that holds it by ``first``.
    """
    body = arc["body"]
    digest = hashlib.sha1(body).hexdigest()
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": warc_identifier(arc["url"], arc["date"], digest),
        "WARC-Date": warc_date(arc["date"]),
        "WARC-Target-URI": arc["url"],
        "WARC-IP-Address": arc["ip"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(len(body)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": SAME_PAYLOAD} | (first or {})
        body = b""
    head |= {"Content-Type": arc["type"], "Content-Length": str(len(body))} | (extra or {})
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + body


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of every record, by declared length. ValueError if a record is cut short."""
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        size = int(head["Content-Length"])
        at = end + 4 + size
        body = raw[end + 4 : at]
        if len(body) != size:
            raise ValueError("the last record is cut short")
        yield head, body


def as_arc(rows: DataFrame) -> DataFrame:
    """Rows of page_id, url, body as legacy records: version (odd pages 2, the rest 1) and arc (bytes) are added,
    url and body dropped. The date is made from page_id, a second to a page, since pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                ids = part["page_id"].to_pylist()
                versions = [1 + (i or 0) % 2 for i in ids]
                dates = [datetime.fromtimestamp(946_684_800 + (i or 0) % 800_000_000, UTC).strftime("%Y%m%d%H%M%S") for i in ids]
                made = zip(part["url"].to_pylist(), dates, part["body"].to_pylist(), versions, strict=True)
                arcs = pa.array([arc_record(*x) for x in made], pa.binary())
                kept = [part[c] for c in ("page_id", "kind", "first")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(versions, pa.int32()), arcs], names=["page_id", "kind", "first", "version", "arc"])

    schema = "page_id long, kind string, first long, version int, arc binary"
    return rows.select("page_id", "kind", "first", "url", "body").mapInArrow(run, schema)


def convert(records: DataFrame) -> DataFrame:
    """WARC records (column warc) of legacy records: version, arc, kind, first (page_id of the
    record a revisit repeats), page_id. ValueError for a legacy record that isn't exactly one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(low, 200).to_pylist():
                    extra = {} if r["page_id"] is None else {"X-Page-ID": str(r["page_id"])}
                    first = {"X-Refers-To-Page-ID": str(r["first"])} if r["first"] is not None else {}
                    (arc,) = parse_arc(r["arc"], r["version"], file=False)
                    out.append(warc_record(arc, r["kind"], first, extra))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["warc"])

    return records.select("page_id", "version", "arc", "kind", "first").mapInArrow(run, "warc binary")


def write_warc(records: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Archives of at most ``per_file`` records and MOST_BYTES bytes; a larger record has a file of its own.

    The records of a file are one row of Spark's text sink, which writes its bytes and, as line end, the two
    blank lines that close the last record; its commit protocol keeps files of lost tasks out.
    """
    most = MOST_BYTES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for value in batch["warc"]:
                record = value.as_py()
                if held and (len(held) >= per_file or size + len(record) + 4 > most):
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], names=["file"])
                    held, size = [], 0
                held.append(record)
                size += len(record) + 4
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], names=["file"])

    files = records.select("warc").mapInArrow(gather, "file binary")
    writer = files.select(F.col("file").cast("string").alias("value")).write
    writer.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives of a folder: type, page_id, refers_to, length and digest declared, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "page_id", "refers_to", "declared_bytes", "declared_digest", "body"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for raw in batch["content"]:
                found, size = [], 0
                for head, body in parse_warc(memoryview(raw.as_buffer()).tobytes()):
                    found.append(
                        (
                            head["WARC-Type"],
                            _number(head.get("X-Page-ID")),
                            _number(head.get("X-Refers-To-Page-ID")),
                            int(head["WARC-Payload-Length"]),
                            head["WARC-Payload-Digest"].removeprefix("sha1:"),
                            body,
                        )
                    )
                    size += len(body)
                    if len(found) >= TOGETHER or size >= TOGETHER_BYTES:
                        yield rows(found)
                        found, size = [], 0
                if found:
                    yield rows(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "kind string, page_id long, refers_to long, declared_bytes long, declared_digest string, body binary"
    return files.mapInArrow(run, schema)


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def archive_pages(pages: DataFrame, path: str | None = None, per_file: int = PER_FILE, least: int = WORTH_A_REVISIT) -> DataFrame:
    """Write every page to WARC archives below ``path`` by way of legacy records, and read them back.

    Returns page_id, payload_bytes, payload_digest (bare hex SHA-1), record_type, refers_to. Of records with
    equal payloads of at least ``least`` bytes, that of the largest page_id is a response and the others
    revisit it, without a body. A response's length and digest are taken from the body that was read, and a
    difference from what its header declares raises. Null html is an empty payload, a null url an empty one.
    A null page_id is smaller than any number; a group without page_ids is all responses. Rows that repeat
    the largest page_id are responses too. Extra columns are ignored; no rows, no archives and no rows.

    Pages are grouped by digest in an aggregate of ids; the join back meets repeated payloads only.
    """
    spark = pages.sparkSession
    if path is None:
        path = f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = pick(pages, page_id="long", url="string", html="string")
    rows = rows.withColumns({"url": F.coalesce("url", F.lit("")), "body": F.coalesce("html", F.lit("")).cast("binary")})
    rows = rows.withColumns({"digest": F.sha1("body"), "bytes": F.octet_length("body")})
    groups = rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = written(groups.filter("n > 1 AND first IS NOT NULL").select("digest", "bytes", "first"), "repeated")
    placed = rows.join(repeated, ["digest", "bytes"], "left")
    again: Column = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    placed = placed.withColumn("kind", F.when(again, F.lit("revisit")).otherwise(F.lit("response")))
    placed = placed.withColumn("first", F.when(again, F.col("first")))
    write_warc(convert(as_arc(placed)), path, per_file)
    found = read_warc(spark, path)
    response = F.col("kind") == "response"
    whole = found.withColumns(
        {
            "payload_bytes": F.when(response, F.octet_length("body").cast("long")).otherwise(F.col("declared_bytes")),
            "payload_digest": F.when(response, F.sha1("body")).otherwise(F.col("declared_digest")),
        }
    )
    same = (F.col("payload_bytes") == F.col("declared_bytes")) & (F.col("payload_digest") == F.col("declared_digest"))
    checked = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from what its header declares")))
    return whole.select("page_id", "payload_bytes", checked.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Legacy archives of a folder as records for ``convert``: page_id null, version, arc, kind, first null.
    Each file states its own version; a file is read whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"]:
                data = memoryview(raw.as_buffer()).tobytes()
                # A record keeps its line, so that conversion starts from what the file says.
                arcs = [(len(r), " ".join(v for k, v in r.items() if k != "body").encode() + b"\n" + r["body"] + b"\n") for r in parse_arc(data)]
                versions = [1 if n == len(ARC_FIELDS[1]) + 1 else 2 for n, _ in arcs]
                if arcs:
                    yield pa.RecordBatch.from_arrays([pa.array(versions, pa.int32()), pa.array([a for _, a in arcs], pa.binary())], names=["version", "arc"])

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(run, "version int, arc binary")
    return out.select(F.lit(None).cast("long").alias("page_id"), "version", "arc", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("first"))
