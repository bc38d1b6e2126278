"""WARC archives: a writer, and a reader whose tasks share large archives.

The writer makes one gzip member of each record. The reader deals archives out
as byte ranges. A task looks for gzip's magic bytes in its range, takes the
first place whose member decodes to a WARC header, and from there on reads
member after member. It owns the records that start inside its range and reads
the last of them to its end, wherever that is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, batch

SPLIT_BYTES = 8 << 20
FILE_BYTES = 64 << 20
MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
MOST_TASKS = 20_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ID = "urn:millrace:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(
    page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, n_bytes: int, refers_to: int | None, revisit: bool
) -> bytes:
    """One record as a gzip member. A revisit has no payload of its own."""
    block = HTTP if revisit else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>")
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the content block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes archives of about FILE_BYTES; yields what was written. Each attempt
    of a task has names of its own, so only what a successful one yields counts."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())])
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    out, name, size, n = None, "", 0, 0

    def done() -> pa.RecordBatch:
        out.close()
        return batch(schema, [f"{folder}/{name}"], [size], [n])

    for b in batches:
        html = b.column("html")
        for i, r in enumerate(b.drop_columns(["html"]).to_pylist()):
            data = record(payload=html[i].as_py() or b"", **r)
            if out is None:
                name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            out.write(data)
            size += len(data)
            n += 1
            if size >= FILE_BYTES:
                yield done()
                out = None
    if out is not None:
        yield done()


def write(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; returns the written (path, size, records).

    Of pages with equal payloads that with the largest page_id is a response,
    the others are revisits of it. Of repeated rows of that page one is the
    response. Null html is an empty payload. Null page_ids are smaller than any.
    """
    body = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("html"))
    rows = rows.select("*", F.sha1("html").alias("sha1_hex"), F.octet_length("html").cast("long").alias("n_bytes"))
    # Of pages that are alone with their payload nothing is kept here.
    alike = rows.groupBy("sha1_hex").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    alike = alike.where("n > 1").select(F.col("sha1_hex").alias("d"), "winner")
    alike = scratch.save(alike, "alike")
    typed = rows.join(alike, F.col("sha1_hex") == F.col("d"), "left")
    wins = F.col("d").isNull() | F.col("page_id").eqNullSafe(F.col("winner"))
    typed = typed.select(
        "page_id", "url", F.when(wins, F.col("html")).alias("html"), "sha1_hex", "n_bytes",
        F.when(~wins, F.col("winner")).alias("refers_to"), (~wins).alias("revisit"), F.col("d").isNotNull().alias("alike"),
    )
    # Repeated rows of a winning page: their payloads are equal, so that counts will do for all but one.
    won = rows.join(alike, (F.col("sha1_hex") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("winner")))
    again = won.groupBy("sha1_hex").count().where("count > 1").select(F.col("sha1_hex").alias("r"))
    again = scratch.save(again, "again")
    if not again.isEmpty():
        marked = typed.join(again, F.col("sha1_hex") == F.col("r"), "left").where(F.col("r").isNull() | F.col("revisit"))
        same = won.join(again, F.col("sha1_hex") == F.col("r"), "left_semi")
        url = F.coalesce("url", F.lit(""))
        one = same.groupBy("page_id", "sha1_hex", "n_bytes").agg(F.min_by(F.struct("url", "html"), url).alias("x"))
        one = one.select("page_id", "x.url", "x.html", "sha1_hex", "n_bytes", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
        rest = same.groupBy("page_id", "sha1_hex", "n_bytes").agg(F.count("*").alias("n"), F.min("url").alias("url"))
        rest = rest.select(
            "page_id", "url", F.lit(None).cast("binary").alias("html"), "sha1_hex", "n_bytes", F.col("page_id").alias("refers_to"),
            F.lit(True).alias("revisit"), F.explode(F.sequence(F.lit(2).cast("long"), "n")).alias("i"),
        ).drop("i")
        typed = marked.drop("r", "alike").unionByName(one).unionByName(rest)
    folder = f"{scratch.path}/archives"
    rows = typed.select("page_id", "url", "html", "sha1_hex", "n_bytes", "refers_to", "revisit")
    return scratch.save(rows.mapInArrow(lambda x: _write(x, folder), "path string, size long, records long"), "manifest")


class _Ranged:
    """An archive, read forwards by blocks from any place."""

    def __init__(self, path: str, size: int):
        fs, root = pafs.FileSystem.from_uri(path)
        self.file, self.size = fs.open_input_file(root), size
        self.base, self.data = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from place on; fewer at the end of the archive."""
        if not (self.base <= place and place + n <= self.base + len(self.data)):
            self.base, self.data = place, self.file.read_at(min(max(n, BLOCK), max(0, self.size - place)), place)
        lo = place - self.base
        return self.data[lo : lo + n]

    def member(self, place: int, head_only: bool = False) -> tuple[bytes, int]:
        """The member that starts at place and where it ends; raises zlib.error if there is none.

        With head_only just enough is decoded to tell a record's first bytes.
        """
        z, parts, at = zlib.decompressobj(31), [], place
        while not z.eof:
            data = self.at(at, 64 if head_only and at == place else 65_536)
            if not data:
                raise zlib.error("cut off")
            parts.append(z.decompress(data, 5 if head_only else 0))
            if head_only and sum(map(len, parts)) >= 5:
                break
            at += len(data)
        return b"".join(parts), at - len(z.unused_data)


def records(path: str, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of the records that start in [start, end)."""
    file, place = _Ranged(path, size), start
    while place < end:  # the first place whose member decodes to a WARC header
        window = file.at(place, min(BLOCK, size - place))
        hit = window.find(MAGIC)
        if hit < 0:
            if place + len(window) >= size:
                return
            place += max(1, len(window) - len(MAGIC) + 1)
            continue
        place += hit
        if place >= end:
            return
        try:
            if file.member(place, head_only=True)[0].startswith(b"WARC/"):
                data, after = file.member(place)
                fields, block = parse(data)
                break
        except (zlib.error, ValueError, KeyError, UnicodeDecodeError):
            pass
        place += 1
    else:
        return
    while True:
        yield place, fields, block
        place = after
        if place >= end or place >= size:
            return
        data, after = file.member(place)
        fields, block = parse(data)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    )
    for b in batches:
        for r in b.to_pylist():
            rows, held = [], 0
            for place, fields, block in records(r["path"], r["size"], r["start"], r["end"]):
                payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                rows.append((r["path"], place, list(fields.items()), payload))
                held += len(payload) + 500
                if held > 4 << 20:
                    yield batch(schema, *zip(*rows))
                    rows, held = [], 0
            if rows:
                yield batch(schema, *zip(*rows))


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of archives (path, size): path, offset, fields and payload.

    Every byte range is a row of its own, so an archive of any size is read by
    as many tasks as it has ranges. An empty archive has no records.
    """
    n = F.ceil(F.col("size") / split_bytes).cast("int")
    ranges = archives.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    ranges = ranges.select(
        "path", "size", (F.col("i") * F.lit(split_bytes).cast("long")).alias("start"),
        F.least((F.col("i") + 1) * F.lit(split_bytes).cast("long"), "size").alias("end"),
    )
    # A range is a few bytes in a shuffle but megabytes to read, so as many tasks as ranges are asked for.
    total = archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    spread = ranges.repartition(int(min(total, MOST_TASKS)), "path", "start")
    return spread.mapInArrow(_read, "path string, offset long, fields map<string,string>, payload binary")


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").removeprefix(_ID)
        return int(tail) if tail else None

    for b in batches:
        out = []
        for fields, payload in zip(b.column("fields").to_pylist(), b.column("payload")):
            f = dict(fields)
            said = f["warc-payload-digest"].removeprefix("sha1:")
            if f["warc-type"] == "response" and digest(payload.as_py()) != said:
                raise ValueError(f"{f['warc-record-id']}: the payload doesn't match its digest")
            out.append((number(f["warc-record-id"]), int(f["x-payload-length"]), said, f["warc-type"], number(f.get("warc-refers-to"))))
        if out:
            yield batch(schema, *zip(*out))


def roundtrip(spark: SparkSession, pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, reads these back, and returns
    for each page page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every response's payload is read back and held against its digest. Null and
    empty html are the same empty payload. Of repeated rows with the winning
    page_id one is the response and the others revisit it. Null page_ids stay
    null; a revisit of a null page_id refers to null. Empty tables give no rows.
    """
    scratch = Scratch(spark, "warc")
    found = read(write(scratch, pages), split_bytes)
    out = found.mapInArrow(
        _sha, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
    return scratch.finish(out)
