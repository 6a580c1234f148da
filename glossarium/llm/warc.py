"""WARC archives with a two-level capture index.

Writing: each task appends its pages to archives of its own, one gzip member a record, and reports where each record lies; a
payload that several pages share is stored once and the others refer to it.  Indexing: captures are sorted by reversed-host
key over range partitions; each partition writes its lines in compressed blocks and reports the first key of every block, the
sparse directory.  Looking up: a query goes to the partition that its key falls in (their first keys are a short list), is
binary-searched among that partition's directory and then in the one block, and the record is read by its byte range.
Files are named anew by every attempt and only those of attempts that finished are referred to, so a lost task does no harm.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_lookup, settled, shared_dir

#: Payloads of so many bytes are stored once; bytes of an archive; lines of an index block; captures of an index partition, as far as there are
#: not more than PARTITIONS of these, whose first keys (a row each) go to the tasks that route queries.
SHARED_FROM, ARCHIVE, LINES, CAPTURES, PARTITIONS = 1000, 256 << 20, 256, 1 << 17, 1 << 15
#: Captures that a lookup hands on at once.
FOUND = 10_000
#: Ranges of one file that are read together: bytes between them, bytes in all; and the slice of a file that one task reads.
GAP, READ, SLICE = 1 << 16, 4 << 20, 16 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; works for every store that pyarrow knows."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def surt(url: str) -> str:
    """Reversed host, then path and query, in lower case: https://www.A.com/b?c -> com,a)/b?c.  Fragments do not count."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return re.sub(r"\s", "", url.lower())
    if not host:
        return re.sub(r"\s", "", url.lower())
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "", f"{','.join(reversed(host.split('.')))}{port}){rest}".lower())


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit's block is the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), block and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return {"version": lines[0], "headers": headers, "block": block, "payload": block.partition(b"\r\n\r\n")[2]}


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _write(top: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(top)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows: list[list] = [[] for _ in range(5)]
                for page, url, html, digest, refers in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    raw = _member(record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers))
                    out.write(raw)
                    for c, v in zip(rows, (surt(url), page, name, at, len(raw)), strict=True):
                        c.append(v)
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.int64()), pa.array(rows[2]), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], ["key", "page_id", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, top: str) -> DataFrame:
    """Write archives under the folder `top`; returns the captures (key, page_id, file, at, size).

    Of pages with equal payloads of SHARED_FROM bytes or more, that with the largest page_id is a response and the others are
    revisits of it.  A null html is an empty payload, a null url an empty address.  A page without an id is never referred to.
    Every row is a record of its own: of rows that share a page_id and a payload all have the same kind.
    """
    where, base = opened(top)
    where.create_dir(base, recursive=True)
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # equal by SHA-256 and size: unlike texts of one SHA-1 can be made
    page = page.withColumn("payload", F.struct(F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("sum"), F.octet_length("html").alias("size")))
    groups = page.filter(F.col("payload.size") >= SHARED_FROM).groupBy("payload").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    marked = salted_lookup(page, "payload", groups)
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return settled(marked.select("page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("digest"), refers.alias("refers")).mapInArrow(_write(top), "key string, page_id long, file string, at long, size long"), "captures")


def _index(top: str):
    def run(batches):
        where, base = opened(top)
        name, at, held = f"index-{uuid.uuid4().hex}.cdx", 0, []
        out = None

        def block():
            nonlocal at, held, out
            if out is None:
                out = where.open_output_stream(f"{base}/{name}", compression=None)
            raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode("utf-8", "surrogatepass"))
            out.write(raw)
            row = pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([held[0][1]], pa.int64()), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(raw)], pa.int64())], ["key", "page_id", "file", "at", "size"])
            at, held = at + len(raw), []
            return row

        try:
            for b in batches:
                for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(x)
                    if len(held) == LINES:
                        yield block()
            if held:
                yield block()
        finally:
            if out is not None:
                out.close()

    return run


def index(captures: DataFrame, top: str) -> DataFrame:
    """Write the sorted index; returns the sparse directory: first key and page_id, file, place and size of every block.

    Captures without a page_id cannot be told apart by a query and are filed under page_id -1.
    """
    parts = min(max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // CAPTURES)), PARTITIONS)
    lines = captures.select("key", F.coalesce("page_id", F.lit(-1)).alias("page_id"), "file", "at", "size")
    ordered = lines.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return settled(ordered.mapInArrow(_index(top), "key string, page_id long, file string, at long, size long"), "directory")


def _find(top: str):
    """Binary search of queries (null place) among the directory rows of the same index file, then in the block."""

    def run(batches):
        where, base = opened(top)
        found: list[list] = [[] for _ in range(4)]

        def out():
            row = pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64())], ["page_id", "file", "at", "size"])
            for c in found:
                c.clear()
            return row

        queries: dict[str, list] = {}
        directory: dict[str, list] = {}
        for b in batches:
            for part, key, page, at, size in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                (queries if at is None else directory).setdefault(part, []).append((key, page, at, size))
        for part, asked in queries.items():
            blocks = sorted(directory.get(part, []))
            first = [x[:2] for x in blocks]
            asked.sort(key=lambda x: x[:2])
            have, names, places = -1, [], []
            with where.open_input_file(f"{base}/{part}") as f:
                for key, page, _, _ in asked:
                    # captures of one key may begin in the block before the first that starts with it, and go on in later ones
                    k = max(bisect.bisect_left(first, (key, page)) - 1, 0)
                    while k < len(blocks) and first[k] <= (key, page):
                        if k != have:
                            raw = zlib.decompress(f.read_at(blocks[k][3], blocks[k][2])).decode("utf-8", "surrogatepass")
                            lines = [x.split("\t") for x in raw.split("\n")]
                            have, names, places = k, [(x[0], int(x[1])) for x in lines], [(x[2], int(x[3]), int(x[4])) for x in lines]
                        for j in range(bisect.bisect_left(names, (key, page)), bisect.bisect_right(names, (key, page))):
                            for c, v in zip(found, (page, *places[j]), strict=True):
                                c.append(v)
                        if len(found[0]) >= FOUND:
                            yield out()
                        k += 1
            yield out()

    return run


def _route(bounds: list[tuple]):
    """The index file of each query: the last whose first capture is not after it."""
    firsts = [x[:2] for x in bounds]

    def run(batches):
        for b in batches:
            keys = [surt(u) for u in b.column(1).to_pylist()]
            pages = b.column(0).to_pylist()
            part = [bounds[max(bisect.bisect_right(firsts, x) - 1, 0)][2] for x in zip(keys, pages, strict=True)]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(keys, pa.string()), pa.array(pages, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["part", "key", "page_id", "at", "size"])

    return run


def lookup(queries: DataFrame, directory: DataFrame, top: str) -> DataFrame:
    """(page_id, file, at, size) of the captures of queries (page_id, url); queries of one page_id and key are asked once.

    Every capture of a key and page_id is found, in however many blocks they lie; an index partition holds all of them.
    """
    bounds = [(r["key"], r["page_id"], r["file"]) for r in directory.groupBy("file").agg(F.min(F.struct("key", "page_id")).alias("m")).select("m.key", "m.page_id", "file").collect()]  # a row for each index partition
    empty = "page_id long, file string, at long, size long"
    if not bounds:
        return queries.sparkSession.createDataFrame([], empty)
    bounds.sort()
    asked = queries.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    routed = asked.mapInArrow(_route(bounds), "part string, key string, page_id long, at long, size long").dropDuplicates(["part", "key", "page_id"])
    both = routed.unionByName(directory.select(F.col("file").alias("part"), "key", "page_id", "at", "size"))
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(bounds))
    return both.repartition(parts, "part").mapInArrow(_find(top), empty)


def _ranges(top: str):
    def run(batches):
        where, base = opened(top)

        def read(name, want):
            with where.open_input_file(f"{base}/{name}") as f:
                k = 0
                while k < len(want):
                    j, end = k, want[k][1] + want[k][2]
                    while j + 1 < len(want) and want[j + 1][1] - end <= GAP and want[j + 1][1] + want[j + 1][2] - want[k][1] <= READ:
                        j += 1
                        end = max(end, want[j][1] + want[j][2])
                    raw = f.read_at(end - want[k][1], want[k][1])
                    for _, at, size in want[k : j + 1]:
                        yield parse(zlib.decompress(raw[at - want[k][1] : at - want[k][1] + size], 31))
                    k = j + 1

        for b in batches:
            rows = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            out: list[list] = [[] for _ in range(6)]
            at = 0
            while at < len(rows):
                to = at
                while to < len(rows) and rows[to][0] == rows[at][0]:
                    to += 1
                for r in read(rows[at][0], rows[at:to]):
                    h = r["headers"]
                    revisit = h["warc-type"] == "revisit"
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if not revisit and hashlib.sha1(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"{rows[at][0]}: {h['warc-record-id']} does not have its digest")
                    for c, v in zip(out, (_page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _page(h.get("warc-refers-to")), digest, None if revisit else r["payload"].decode("utf-8", "surrogatepass")), strict=True):
                        c.append(v)
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"])

    return run


def read(places: DataFrame, top: str) -> DataFrame:
    """Records at (file, at, size): page_id, url, record_type, refers_to, payload_digest, payload (null for revisits)."""
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.withColumn("slice", F.floor(F.col("at") / SLICE)).repartition(parts, "file", "slice").sortWithinPartitions("file", "at").drop("slice")
    return dealt.mapInArrow(_ranges(top), "page_id long, url string, record_type string, refers_to long, payload_digest string, payload string")


def round_trip(pages: DataFrame, top: str | None = None) -> DataFrame:
    """Write pages, index them, look every page up and read it: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's bytes and digest are those of the response that it refers to, as read from the archive.
    """
    top = top or shared_dir(pages.sparkSession, "warc")
    captures = write(pages, top)
    directory = index(captures, top)
    found = read(lookup(pages, directory, top), top).select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.sha1(F.col("payload").cast("binary"))).alias("payload_digest"))
    found = settled(found, "records")
    whole = found.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to")).agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("of"))
    revisits = salted_lookup(found.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest"), "refers_to", whole)
    revisits = revisits.select("page_id", F.col("of.payload_bytes").alias("payload_bytes"), F.col("of.payload_digest").alias("payload_digest"), "record_type", "refers_to")
    return found.filter("record_type = 'response'").select(*revisits.columns).unionByName(revisits)
