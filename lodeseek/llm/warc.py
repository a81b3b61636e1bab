"""WARC archives: a writer and a splittable reader.

Archives hold one gzip member for each record. Tasks of the reader get byte ranges: a task scans its range
for the magic bytes of gzip, takes a place as a member if its head decodes to a WARC version line, and owns
the records whose members begin inside the range, reading on past its end for the last one. Members follow
one another, so after the first one of a range the next begins where the last ended.

Files are opened by the URI of their folder, so archives may lie in any store that pyarrow knows.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import arrow_map, materialise

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
PIECE_BYTES = 1 << 14
BATCH_BYTES = 4 << 20
BATCH_ROWS = 500
#: Size at which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
#: Fixed date of records: the tables have no fetch time, and archives of equal rows should be equal.
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
RECORDS = "record_type string, page_id string, url string, refers_to string, payload_digest string, path string, start long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store, name


def _record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response, or a revisit that has the head of the response only."""
    revisit = refers_to is not None
    block = _HTTP.format(n=len(payload)).encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, base32_sha1(payload))))}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row to archives in folder, and returns path and size of each archive.

    Of the records with equal payloads of at least least_bytes bytes, those with the smallest id are
    responses and the others revisit that id; smaller payloads are all responses. A null html is an empty
    payload. Rows without an id never are what others refer to, and are responses if no row of their payload
    has an id; repeated rows of the smallest id are all responses. An empty table gives one archive without
    records. Other columns are not read. A record is held in memory, and has to be below 2 GB (a Spark cell). A lost task writes anew under another name: only the archives returned count.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("held"))
    firsts = materialise(firsts.where("held > 1 AND first IS NOT NULL").select("sha", "first"), "op1-firsts")
    rows = rows.join(firsts, "sha", "left")
    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).cast("string")
    rows = rows.select("id", "url", "payload", F.when(F.col("first").isNotNull(), refers).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, written, done = None, "", 0, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, written = store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=READ_BYTES), 0
                member = _member(_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
                out.write(member)
                written += len(member)
                if written >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", written))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", written))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "size"])

    return materialise(arrow_map(rows, run, "path string, size long"), "op1-archives")


def list_archives(spark: SparkSession, folder: str, suffix: str = ".warc.gz") -> DataFrame:
    """path and size of the archives in a folder and below, through Spark's own file systems; no rows if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"))


class _Bytes:
    """Bytes of a file from a place on, read ahead in pieces."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held, self.used = file, at, b"", 0

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        if len(self.held) - self.used < n:
            self.held, self.used = self.held[self.used :], 0
            while len(self.held) < n:
                self.file.seek(self.at + len(self.held))
                more = self.file.read(max(READ_BYTES, n - len(self.held)))
                if not more:
                    break
                self.held += more
        return self.held[self.used : self.used + n]

    def skip(self, n: int) -> None:
        self.used += n
        self.at += n

    def go(self, at: int) -> None:
        self.at, self.held, self.used = at, b"", 0


def _is_member(data: bytes) -> bool:
    """Whether a gzip member that holds a WARC record begins here."""
    try:
        return zlib.decompressobj(31).decompress(data[:4096], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _inflate(source: _Bytes) -> bytes | None:
    """The content of the member at the place, and moves to its end; None if it doesn't decode."""
    pack, parts = zlib.decompressobj(31), []
    while not pack.eof:
        data = source.peek(PIECE_BYTES)
        if not data:
            return None
        try:
            parts.append(pack.decompress(data))
        except zlib.error:
            return None
        source.skip(len(data) - len(pack.unused_data))
    return b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _length(fields: dict[str, str], held: int) -> int:
    """The bytes of a block: as stated, or all there are if nothing usable is stated."""
    stated = fields.get("content-length", "")
    return min(int(stated), held) if stated.isascii() and stated.isdigit() else held


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields and block of the records that begin in bytes start to end of an archive."""
    source, known = _Bytes(file, start), False
    while source.at < end:
        if not known:
            data = source.peek(READ_BYTES)
            at = data.find(MAGIC)
            if at < 0:
                if len(data) < READ_BYTES:
                    return
                source.skip(len(data) - 2)
                continue
            source.skip(at)
            if source.at >= end:
                return
            if not _is_member(source.peek(4096)):
                source.skip(1)
                continue
        place = source.at
        data = source.peek(3)
        if data[:3] != MAGIC:
            if not data:
                return
            known = False
            source.skip(1)
            continue
        record = _inflate(source)
        if record is None:
            # A damaged member: go on behind its first byte.
            known = False
            source.go(place + 1)
            continue
        known = True
        if not record.startswith(b"WARC/1."):
            continue
        head, _, block = record.partition(b"\r\n\r\n")
        fields = _fields(head)
        yield place, fields, block[: _length(fields, len(block))]


def read_warc(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of archives (path, size): the columns of RECORDS.

    The payload of a response is what follows its HTTP head, and its digest is computed from it; a revisit
    has no payload of its own (null), and the digest that it states. Records of other types have their block
    as payload. Damaged members are passed over; a block whose stated length is no number, negative or beyond
    the member is taken whole, and fields that are no header lines are ignored. No archives give no rows.
    """
    spans = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("size", F.lit(1)) - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    count = archives.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    # Two ranges or so a task: names and numbers move, not archives.
    spans = spans.repartition(max(1, int(count)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        names = ["record_type", "page_id", "url", "refers_to", "payload_digest", "path", "start", "payload"]

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for path, start in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                store, name = _open(path)
                with store.open_input_file(name) as file:
                    for place, fields, block in records_in(file, start, start + range_bytes):
                        kind = fields.get("warc-type")
                        payload = None if kind == "revisit" else block
                        if kind == "response" and block.startswith(b"HTTP/"):
                            payload = block.partition(b"\r\n\r\n")[2]
                        stated = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                        digest = stated if payload is None else base32_sha1(payload)
                        rows.append((kind, fields.get("x-page-id"), fields.get("warc-target-uri"), fields.get("x-refers-to-page-id"), digest, path, place, payload))
                        held += len(payload or b"")
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield batch_of()
                            rows, held = [], 0
        yield batch_of()

    return arrow_map(spans, run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records without payload, with payload_bytes of the full payload: a revisit has those of the response it refers to."""
    own = records.select("record_type", "page_id", "refers_to", "payload_digest", F.length("payload").cast("long").alias("own_bytes"))
    own = materialise(own, "op1-records")
    target = own.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest")).agg(F.max("own_bytes").alias("r_bytes"))
    target = materialise(target, "op1-targets")
    joined = own.join(target, (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    return joined.select("record_type", "page_id", "refers_to", "payload_digest", F.coalesce("own_bytes", "r_bytes").alias("payload_bytes"))
