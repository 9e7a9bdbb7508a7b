"""WARC archives: a writer, and a splittable reader.

The writer stores each record as a gzip member of its own. The reader's tasks
get byte ranges of the archives. A task scans its range for the gzip magic,
validates a candidate by decoding the head of its record, and owns the records
that start inside its range; the last one may end beyond it. Records found must
form an unbroken chain of members up to the next range, so that an archive
stored inside a payload isn't mistaken for records.

Archives lie in a folder that ``pyarrow.fs`` can open on every executor.

Defined results: null content is written as an empty payload; empty payloads
equal each other like any others. Of rows with equal payloads the one with the
smallest id is the response (a null id comes last; of rows with that same id,
one), the others are revisits of it. Rows are written as they are, repeated ones
included. Other columns are ignored. An empty table gives an empty result. Bytes
that form no record are skipped, as are responses whose payload doesn't match
their digest, and records in so short a chain between damaged bytes that they
may be part of a payload; with ``damaged`` the reader returns a row for each
candidate or response of that kind. Archives of other writers are read as well:
field names have any case, ``record_id`` and ``refers_to_id`` hold whatever ids
they use, a digest may be absent, and the length of a revisit's payload is null
where no field tells it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import shared

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20
CHUNK = 1 << 20
STEP = 16 << 10
STORED = 65_535
HEAD = 1 << 16  # the longest record head that is looked at when a candidate is validated
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its length is in a field of our own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    clean = "".join(c for c in url if c.isprintable() and c != " ")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:x-page:{page}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member, the same for the same data."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Fields (names in lower case) and block of a record; None if it is none."""
    if not data.startswith(b"WARC/1."):
        return None
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = dict(tuple(p.strip() for p in x.split(":", 1)) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    fields = {k.lower(): v for k, v in fields.items()}
    size = fields.get("content-length", "")
    return (fields, rest[: int(size)]) if gap and size.isdigit() and len(rest) >= int(size) else None


def with_responses(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page, url, payload, digest, response (the page that is a revisit's response, else null), first.

    One page of each digest is found by aggregation, which combines on the map
    side; only digests that occur more than once meet their rows again.
    """
    rows = pages.select(
        pages[id_column].cast("long").alias("page"),
        F.coalesce(pages[url_column].cast("string"), F.lit("")).alias("url"),
        F.coalesce(pages[html_column].cast("string"), F.lit("")).cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("row"),  # by place in the files, so the same each time they are read
    ).withColumn("sha", F.sha1("payload"))
    key = F.struct(F.col("page").isNull().alias("no"), "page", "row")
    ids = rows.select("page", "row", F.xxhash64("sha").alias("h"), "sha")  # payloads aren't part of the join on their digests
    best = shared.regrouped(ids, ["h", "sha"], F.min(key), "best", ["row"], pages.count())
    revisits = best.where(F.col("best.row") != F.col("row")).select("row", F.lit(True).alias("again"), F.col("best.page").alias("response"))
    joined = rows.drop("sha").join(revisits, "row", "left")
    return joined.select("page", "url", "payload", F.coalesce("again", F.lit(False)).alias("revisit"), "response")


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write the pages as archives in ``folder``; returns a table of path and size, kept in the same folder.

    A task writes one archive under a name of its attempt; only archives that
    the table names count, so a lost or repeated attempt does no harm.
    """
    rows = with_responses(pages, id_column, url_column, html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        path = f"{top}/{uuid4().hex}.warc.gz"
        size, out = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                payload, page = row["payload"], row["page"]
                kind = "revisit" if row["revisit"] else "response"
                data = member(record(kind, str(page), row["url"], payload, digest_of(payload), str(row["response"])))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "size"])

    table = f"{folder.rstrip('/')}/archives"
    rows.mapInArrow(run, "path string, size long").write.mode("overwrite").parquet(table)
    return pages.sparkSession.read.schema("path string, size long").parquet(table)


class Window:
    """Bytes of a file from a place on, read in chunks and forgotten once passed."""

    def __init__(self, source, size: int, start: int):
        self.source, self.size, self.base, self.data = source, size, start, bytearray()

    def fill(self, upto: int) -> None:
        while self.base + len(self.data) < min(upto, self.size):
            self.source.seek(self.base + len(self.data))
            got = self.source.read(min(CHUNK, self.size - self.base - len(self.data)))
            if not got:
                break
            self.data += got

    def drop(self, before: int) -> None:
        """Forget what lies before; callers never go back."""
        if before - self.base > CHUNK:
            del self.data[: before - self.base]
            self.base = before

    def find(self, place: int, end: int) -> int:
        """The first magic that starts in [place, end), or -1."""
        while place < end:
            self.fill(min(place + CHUNK, end + len(MAGIC)))
            at = self.data.find(MAGIC, place - self.base)
            if at >= 0:
                return self.base + at if self.base + at < end else -1
            reached = self.base + len(self.data) - len(MAGIC) + 1
            if reached <= place:
                return -1
            place = reached
        return -1

    def is_record(self, place: int) -> bool:
        """Whether the head of the member at this place decodes as that of a record."""
        self.fill(place + HEAD)
        d, head, data = zlib.decompressobj(31), b"", bytes(self.data[place - self.base : place - self.base + HEAD])
        try:  # in short steps, so that damage behind the head doesn't hide it
            for k in range(0, len(data), 16):
                head += d.decompress(data[k : k + 16])
                if d.eof or b"\r\n\r\n" in head or len(head) > HEAD:
                    break
        except zlib.error:
            pass
        return head.startswith(b"WARC/1.") and b"\r\nwarc-type:" in head.lower()

    def decode(self, place: int) -> tuple[bytes, int] | None:
        """The whole member at this place and where it ends; None if it is damaged."""
        d, out, at = zlib.decompressobj(31), [], place
        try:
            while not d.eof:
                self.fill(at + STEP)
                part = bytes(self.data[at - self.base : at - self.base + STEP])
                if not part:
                    return None
                out.append(d.decompress(part))
                at += len(part) - len(d.unused_data)
        except zlib.error:
            return None
        return b"".join(out), at


def owned(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """Place, fields and block of each record that starts in [start, end); no fields: a head whose record is damaged or unsure.

    A payload that is an archive itself may lie in its record as it is. Deflate
    stores at most ``STORED`` bytes in a row, so members that follow each other
    for longer than that, or up to the file's end, are no such copy. Until then they are
    held back; if the chain breaks before, the scan goes on behind its first magic.
    """
    window = Window(source, size, start)
    place = start
    while (place := window.find(place, end)) >= 0:
        if not window.is_record(place):
            place += 1
            continue
        at, chain, sure = place, [], place == 0
        while (got := window.decode(at)) and (parsed := parse(got[0])):
            if at < end:
                chain.append((at, *parsed))
            at = got[1]
            sure = sure or at == size or at - place > STORED
            if sure:
                yield from chain
                chain = []
                if at >= end:
                    return
                window.drop(at)
            window.fill(at + len(MAGIC))
            if window.data[at - window.base : at - window.base + len(MAGIC)] != MAGIC:
                break
        if not sure:
            yield place, None, b""
        place = max(at, place + 1) if sure else place + 1


FIELDS = ["archive", "place", "record_type", "page", "url", "payload_digest", "payload_bytes", "refers_to", "record_id", "refers_to_id", "payload"]
SCHEMA = "archive string, place long, record_type string, page long, url string, payload_digest string, payload_bytes long, refers_to long, record_id string, refers_to_id string, payload binary"


def page_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def splits(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, size, start and end of byte ranges that together cover the archives."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    return archives.where("size > 0").select("path", "size", begin.alias("start")).withColumn("end", F.least(F.col("start") + split, F.col("size")))


def row_of(path: str, place: int, f: dict[str, str] | None, block: bytes) -> tuple:
    """Values of ``FIELDS``; record_type damaged for what is no whole record."""
    if f is None:
        return (path, place, "damaged", *[None] * (len(FIELDS) - 3))
    payload = block.partition(b"\r\n\r\n")[2]
    kind, told = f.get("warc-type"), f.get("warc-payload-digest", "")
    if kind == "response" and told.lower().startswith("sha1:") and told[5:].upper() != digest_of(payload):
        kind = "damaged"
    size = f.get("payload-length", "")
    length = int(size) if size.isdigit() else len(payload) if kind != "revisit" else None
    one, other = f.get("warc-record-id"), f.get("warc-refers-to")
    return (path, place, kind, page_of(one), f.get("warc-target-uri"), told.partition(":")[2] or None, length, page_of(other), one, other, payload)


def read(archives: DataFrame, folder: str, split: int = SPLIT, damaged: bool = False) -> DataFrame:
    """Records of archives, a table of path and size (bytes) as ``write`` returns it. damaged: with rows for what was skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(FIELDS, SCHEMA.split(", "))])
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(r["path"]) as source:
                    for place, f, block in owned(source, r["size"], r["start"], r["end"]):
                        row = row_of(r["path"], place, f, block)
                        if row[2] == "damaged" and not damaged:
                            continue
                        rows.append(row)
                        held += len(block)
                        if held > CHUNK * 4:
                            yield pa.RecordBatch.from_pydict(dict(zip(FIELDS, zip(*rows))), schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(FIELDS, zip(*rows))), schema=schema)

    ranges = splits(archives, split)
    # each range is a task's work of its own
    dealt = ranges.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), "path", "start")
    return dealt.mapInArrow(run, T.StructType.fromDDL(SCHEMA))
