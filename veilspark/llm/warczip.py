"""Web archives in ZIP packages: written per task, then read by ranges through the ZIP directories.

A package holds, stored and not compressed again, ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdx`` (one line per record).  The directory always has its ZIP64 form, so sizes have no limit.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import checkpoint_dir, cut

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Fixed values of the ZIP format: signatures, sizes of the fixed parts, marker of a value held in ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR_SIZE = 30, 46, 22, 56, 20
IN_64, IN_64_SHORT, LONGEST_COMMENT = 0xFFFFFFFF, 0xFFFF, 0xFFFF
DOS_DATE = 33
WRITTEN = "path string, bytes bigint, records bigint"
ENTRY = "path string, offset bigint, length bigint"
RECORD = "path string, offset bigint, type string, url string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def filesystem(uri: str):
    """The store of a path; paths without a scheme are local to it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- writing --------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, streamed one after the other; sizes and checksums follow in descriptors and the directory."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8 | 0x800, 0, 0, DOS_DATE, 0, IN_64, IN_64, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> int:
        at = self.size
        self.put(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        return at

    def close_member(self) -> None:
        self.put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.members.append((self.name, self.start, self.crc, self.size))

    def finish(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self.put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8 | 0x800, 0, 0, DOS_DATE, crc, IN_64, IN_64, len(name), len(extra), 0, 0, 0, 0, IN_64) + name + extra)
        size, n, end64 = self.at - start, len(self.members), self.at
        self.put(END64 + struct.pack("<QHHIIQQQQ", END64_SIZE - 12, 45, 45, 0, 0, n, n, size, start))
        self.put(LOCATOR + struct.pack("<IQI", 0, end64, 1))
        self.put(END + struct.pack("<HHHHIIH", 0, 0, IN_64_SHORT, IN_64_SHORT, IN_64, IN_64, 0))


def one_line(value) -> str:
    """A header value cannot hold line ends or other control characters."""
    return "".join(c if c.isprintable() else " " for c in str(value))


def record(kind: str, url, page_id, refers_to, payload: bytes, digest: bytes, date: str) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{url}:{digest.hex()}')}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, date: str, package_bytes: int):
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches):
        store, root = filesystem(folder)
        state: dict = {"zip": None}

        def start():
            # A name of its own for each attempt: a lost or doubled task never touches a package that is listed.
            state["path"] = f"{root}/{uuid.uuid4().hex}.wacz"
            state["file"] = store.open_output_stream(state["path"])
            state["zip"], state["index"] = ZipWriter(state["file"]), []
            state["zip"].open(DATA)

        def end():
            z = state["zip"]
            z.close_member()
            z.open(INDEX)
            z.write("".join(state["index"]).encode())
            z.close_member()
            z.finish()
            state["file"].close()
            state["zip"] = None
            return pa.RecordBatch.from_pylist([{"path": state["path"], "bytes": z.at, "records": len(state["index"])}], schema=schema)

        for batch in batches:
            for page_id, url, html, top in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state["zip"] is None:
                    start()
                payload = html or b""
                kind = "revisit" if top is not None else "response"
                z = gzip.compress(record(kind, url, page_id, top, payload, hashlib.sha1(payload).digest(), date), 6, mtime=0)
                state["index"].append(f"{state['zip'].write(z)} {len(z)}\n")
                if state["zip"].at >= package_bytes:
                    yield end()
        if state["zip"] is not None:
            yield end()

    return run


def write_packages(pages: DataFrame, folder: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", package_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record per row into packages under ``folder`` and returns ``path, bytes, records``.

    Rows with equal payloads (by length and SHA-1) of at least ``least`` bytes refer to the row with the largest
    id: rows with a smaller id are ``revisit`` records without payload, rows that share the largest id are all ``response``.
    Shorter payloads are always ``response``.  A null payload is empty; a null url or id leaves its header out, and a row without id is always a
    response that nothing refers to.  Other columns are not read.  An empty table writes nothing.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    keyed = rows.select("page_id", F.octet_length("html").alias("len"), F.sha1(F.encode("html", "UTF-8")).alias("sha")).where(f"page_id IS NOT NULL AND len >= {least}")
    groups = keyed.groupBy("sha", "len").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low < top").select("sha", "len", "top")
    # Ids and targets only: payloads go through one shuffle, by id, and never meet by content.
    targets = keyed.join(groups, ["sha", "len"]).where("page_id < top").select(F.col("page_id").alias("id"), F.col("sha").alias("of"), "top").distinct()
    linked = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).join(targets, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left")
    return cut(linked.select("page_id", "url", "html", "top").mapInArrow(_writer(folder, date, package_bytes), WRITTEN))


# --- reading --------------------------------------------------------------------------------------


def directory(read, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of each stored member; ``read(offset, length)`` gives bytes."""
    tail_at = max(0, size - END_SIZE - LONGEST_COMMENT)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if n == IN_64_SHORT or IN_64 in (length, start):
        place = tail_at + at - LOCATOR_SIZE
        locator = read(place, LOCATOR_SIZE)
        if locator[:4] != LOCATOR:
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of directory")
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    table, p, out = read(start, length), 0, {}
    for _ in range(n):
        if table[p : p + 4] != CENTRAL:
            raise ValueError("broken ZIP directory")
        method, = struct.unpack_from("<H", table, p + 10)
        packed, size_, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", table, p + 20)
        local, = struct.unpack_from("<I", table, p + 42)
        name = table[p + CENTRAL_SIZE : p + CENTRAL_SIZE + name_n].decode()
        extra = table[p + CENTRAL_SIZE + name_n : p + CENTRAL_SIZE + name_n + extra_n]
        q = 0
        while q + 4 <= len(extra):
            tag, n_ = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # holds, in this order, those of the values that don't fit their own fields
                values = iter(struct.unpack_from(f"<{n_ // 8}Q", extra, q + 4))
                size_ = next(values) if size_ == IN_64 else size_
                packed = next(values) if packed == IN_64 else packed
                local = next(values) if local == IN_64 else local
            q += 4 + n_
        if method == 0:
            name_l, extra_l = struct.unpack_from("<HH", read(local, LOCAL_SIZE), 26)
            out[name] = (local + LOCAL_SIZE + name_l + extra_l, packed)
        p += CENTRAL_SIZE + name_n + extra_n + note_n
    return out


def parse_record(data: bytes, with_payload: bool = True) -> dict:
    """Headers and payload of one WARC record."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(h["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(h["warc-payload-digest"].split(":")[1])
    kind = h["warc-type"]
    if kind == "response" and hashlib.sha1(payload).digest() != digest:
        raise ValueError("payload and digest differ")
    number = lambda name: int(h[name]) if name in h else None
    return {
        "type": kind, "url": h.get("warc-target-uri"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page"),
        "payload_bytes": len(payload) if kind == "response" else number("x-payload-length"), "payload_digest": digest.hex(),
        "payload": payload if with_payload and kind == "response" else None,
    }


def _locate(folder: str):
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        store, _ = filesystem(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    members = directory(lambda at, n: f.read_at(n, at), size)  # noqa: B023
                    data, (at, n) = members[DATA][0], members[INDEX]
                    lines = [tuple(map(int, x.split())) for x in f.read_at(n, at).decode().splitlines()]
                for lo in range(0, len(lines), 10_000):
                    part = lines[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array([data + x for x, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], schema=schema)

    return run


def _fetch(folder: str, with_payload: bool, together: int):
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def spans(rows):
        """Neighbours of one package are read in one range of at most ``together`` bytes, or one record."""
        group: list = []
        for r in rows:
            if group and (r[0] != group[0][0] or r[1] != group[-1][1] + group[-1][2] or r[1] + r[2] - group[0][1] > together):
                yield group
                group = []
            group.append(r)
        if group:
            yield group

    def run(batches):
        store, _ = filesystem(folder)
        last, f = None, None
        for batch in batches:
            for group in spans(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                path, start = group[0][:2]
                if path != last:
                    if f is not None:
                        f.close()
                    last, f = path, store.open_input_file(path)
                data = f.read_at(group[-1][1] + group[-1][2] - start, start)
                yield pa.RecordBatch.from_pylist(
                    [{"path": path, "offset": at} | parse_record(gzip.decompress(data[at - start : at - start + n]), with_payload) for _, at, n in group], schema=schema)
        if f is not None:
            f.close()

    return run


def read_packages(packages: DataFrame, folder: str, with_payload: bool = True, tasks: int | None = None, together: int = 8 << 20) -> DataFrame:
    """Records of the packages ``(path, bytes)``: the directory and index of each are read first, then ranges of
    records, dealt over the tasks by offset, so one large package is read by many.  A package that is cut short or a
    record whose payload doesn't have its digest fails the job.  No package, no rows."""
    spark = packages.sparkSession
    entries = packages.select("path", "bytes").mapInArrow(_locate(folder), ENTRY)
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(n, "path", F.expr("offset div 4194304")).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(_fetch(folder, with_payload, together), RECORD)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder beside the session's checkpoints, which all executors share."""
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{base.rstrip('/')}/packages-{uuid.uuid4().hex}"


def make_folder(folder: str) -> None:
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)


def archive_round_trip(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Writes ``pages`` into packages and reads them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    folder = folder or new_folder(pages.sparkSession)
    make_folder(folder)
    found = read_packages(write_packages(pages, folder, least), folder, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "url")
