"""Operator 4: WARC archives with a two-level capture index.

Records are gzip members, one each, in archives that tasks write to shared storage. The index holds a line per
record under its reversed-host key; ranges of sorted lines are cut into compressed blocks, laid in index files, and
a sparse directory has each block's first key. A look-up finds the file by range, the block by binary search in the
directory, and then reads ranges: of the index file, and of the archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import open_store, shared_path, slices, text_or_empty, written

#: Payload bytes from which equal payloads are stored once.
LEAST = 1000
#: Lines of an index block.
LINES = 512
#: Look-ups of an index file that one task answers at once.
ASKS = 5000
#: Bits of the set that spares pages without copies a shuffle, and tasks that copies of one payload go to.
BITS = 1 << 20
SALTS = 16
DATE = "2024-01-01T00:00:00Z"


def reversed_host_key(url: str | None) -> str:
    """`http://www.a.example.com:80/P?q#f` -> `com,example,a,www)/P?q`: the sort key of a capture; null: empty."""
    if not url:
        return ""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)(?::(\d+))?([^#]*)", url)
    if not m:
        return _visible(url)
    host, port, rest = m[1].lower(), m[2], m[3] or "/"
    host = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "")
    return _visible(f"{host}){rest if rest.startswith('/') else '/' + rest}")


def _visible(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", text)


def _record(kind: str, record_id: str, url: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": _visible(url), **headers, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the payload's digest and length alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{record_id(refers_to)}>", "X-Refers-To-Page-ID": str(refers_to)}
    body = _record("revisit" if revisit else "response", record_id(page_id), url or "urn:unknown", headers, http if revisit else http + payload)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(body) + z.flush()


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def read_record(member: bytes) -> Record:
    """Parse one gzip member; checks its lengths and, of a response, the payload digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length differs")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    found = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    if headers["WARC-Type"] == "response" and f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}" != headers["WARC-Payload-Digest"]:
        raise ValueError("the payload digest differs")
    return Record(headers["WARC-Type"], headers, found, payload)


def assigned(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, refers_to, revisit. Of equal payloads of at least `least` bytes the largest page_id responds
    (each of its rows, if it is repeated); where no copy has an id, all respond. Null html is an empty payload."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_or_empty(html).alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary")))
    p = p.withColumn("digest", key)
    first = p.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # pages that are short or whose payload is unique need no partner, so they don't move: a bounded set of bits, a broadcast, tells
    # those that may have one, and a full set lets all through; copies of a very common payload go to SALTS tasks
    bit = lambda: F.pmod(F.xxhash64("digest"), F.lit(BITS)).cast("int")
    bits = F.broadcast(first.select(bit().alias("bit")).distinct())
    salted = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    long_ = p.filter("digest is not null")
    may = long_.join(bits, bit() == F.col("bit"), "left_semi").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    alone = p.filter("digest is null").unionByName(long_.join(bits, bit() == F.col("bit"), "left_anti")).withColumn("first", F.lit(None).cast("long"))
    p = may.join(salted, ["digest", "salt"], "left").drop("salt").unionByName(alone)
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    return p.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, out: str, most_bytes: int = 64 << 20, **columns) -> DataFrame:
    """Write a record for each page and return a line for each: key, page_id, path, offset, length.

    Each task writes its own archives, of about most_bytes, under names of its attempt. The lines are committed by
    Spark, so archives of lost or repeated attempts are never looked at.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(out)
        store.create_dir(base, recursive=True)
        f, name, at = None, "", 0
        names = ["key", "page_id", "path", "offset", "length"]
        for b in slices(batches, "html"):
            rows = []
            for page, url, html, refers, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    f, at = store.open_output_stream(f"{base}/{name}", compression=None), 0
                member = write_record(page, url, html.encode(), refers, revisit)
                f.write(member)
                rows.append((reversed_host_key(url), page, name, at, len(member)))
                at += len(member)
                if at >= most_bytes:
                    f.close()
                    f = None
            if f is not None:
                f.flush()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)
        if f is not None:
            f.close()

    return written(assigned(pages, **columns).mapInArrow(write, "key string, page_id long, path string, offset long, length long"), "captures")


def _sort_key(key: str, page_id: int | None) -> str:
    return f"{key} {0 if page_id is None else 1}{(page_id or 0) + (1 << 63):020d}"


def write_index(captures: DataFrame, out: str, lines: int = LINES) -> DataFrame:
    """Sort capture lines by key into compressed blocks. Returns the directory: part, path, first, last, offset, length, n (a row for each block).

    Keys are ranged over tasks together with page ids, so a host with many pages spreads over many files.
    """
    spark = captures.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.concat_ws(" ", "key", F.concat(F.when(F.col("page_id").isNull(), "0").otherwise("1"), F.lpad((F.coalesce("page_id", F.lit(0)).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")))
    c = captures.withColumn("sort", order).repartitionByRange(n, "sort").sortWithinPartitions("sort")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_store(out)
        store.create_dir(base, recursive=True)
        part, name, at = TaskContext.get().partitionId(), f"index-{uuid.uuid4().hex}.gz", 0
        rows, block, f = [], [], None

        def flush() -> None:
            nonlocal block, at, f
            if f is None:
                f = store.open_output_stream(f"{base}/{name}", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress("".join(f"{s}\t{json.dumps(v)}\n" for s, v in block).encode()) + z.flush()
            f.write(member)
            rows.append((part, name, block[0][0], block[-1][0], at, len(member), len(block)))
            at += len(member)
            block = []

        for b in batches:
            for s, *v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block.append((s, v))
                if len(block) == lines:
                    flush()
        if block:
            flush()
        if f is not None:
            f.close()
        types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=["part", "path", "first", "last", "offset", "length", "n"])

    return written(c.select("sort", "page_id", "path", "offset", "length").mapInArrow(write, "part int, path string, first string, last string, offset long, length long, n long"), "directory")


class Ranges:
    """Range reads that keep a few files open."""

    def __init__(self, base: str, keep: int = 16):
        self.store, self.base = open_store(base)
        self.keep, self.open = keep, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.pop(name, None) or self.store.open_input_file(f"{self.base}/{name}")
        self.open[name] = f
        if len(self.open) > self.keep:
            self.open.pop(next(iter(self.open))).close()
        return f.read_at(length, offset)

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def look_up(wanted: DataFrame, directory: DataFrame, archives: str, index: str, exact: bool = False) -> DataFrame:
    """wanted: url, and page_id or null for all captures of the url. URLs that share a key (scheme, fragment) answer for one another
    unless `exact`. A row for each record found: page_id, url as asked
    for, payload_bytes, payload_digest (lower-case hex SHA-1), record_type, refers_to, payload (null for revisits).

    The first level, one row per index file with its first key, is small and shipped to all tasks; look-ups go to
    their file's group, binary-search its directory and read the blocks' and the records' ranges. A look-up that may lie in
    several files goes to each.
    """
    spark = wanted.sparkSession
    tops = [tuple(r) for r in directory.groupBy("part").agg(F.min("first"), F.max("last"), F.count("*")).orderBy("part").collect()]
    slices_ = max(4, -(-max((t[3] for t in tops), default=0) * LINES // ASKS))
    firsts, lasts, numbers = [t[1] for t in tops], [t[2] for t in tops], [t[0] for t in tops]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, lows, highs, urls = [], [], [], []
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = reversed_host_key(url)
                low, high = (_sort_key(key, page),) * 2 if page is not None else (f"{key} ", f"{key} 2")
                for i in range(max(0, bisect_right(firsts, low) - 1), bisect_right(firsts, high)):
                    if lasts[i] >= low:
                        parts.append(numbers[i])
                        lows.append(low)
                        highs.append(high)
                        urls.append(url)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(lows, pa.string()), pa.array(highs, pa.string()), pa.array(urls, pa.string())], names=["part", "low", "high", "url"])

    asked = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(route, "part int, low string, high string, url string")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def find(asks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, pages = Ranges(index), Ranges(archives)
        for b in asks:
            for slot in range(b.num_rows):
                yield from answer(b.column(0)[slot].as_py(), b.column(1)[slot].as_py(), blocks, pages)
        blocks.close()
        pages.close()

    def answer(asks: list[dict], entries: list[dict], blocks: Ranges, pages: Ranges) -> Iterator[pa.RecordBatch]:
        entries = sorted(entries, key=lambda e: e["first"])
        first = [e["first"] for e in entries]
        hits = []
        held: tuple[int, list[str], list[list]] = (-1, [], [])
        for ask in sorted(asks, key=lambda a: a["low"]):
            at = max(0, bisect_right(first, ask["low"]) - 1)
            if at and first[at] == ask["low"]:
                at = max(0, bisect_left(first, ask["low"]) - 1)  # equal keys may begin in the block before
            while at < len(entries) and first[at] <= ask["high"]:
                if held[0] != at:
                    e = entries[at]
                    lines = [x.split("\t", 1) for x in zlib.decompress(blocks.read(e["path"], e["offset"], e["length"]), 31).decode().split("\n")[:-1]]
                    held = at, [x[0] for x in lines], [json.loads(x[1]) for x in lines]
                for i in range(bisect_left(held[1], ask["low"]), bisect_right(held[1], ask["high"])):
                    hits.append((*held[2][i], ask["url"]))
                at += 1
        hits.sort(key=lambda h: (h[1], h[2]))
        rows, size = [], 0
        for page, path, offset, length, url in hits:
            r = read_record(pages.read(path, offset, length))
            if exact and r.headers["WARC-Target-URI"] != _visible(url or "urn:unknown"):
                continue
            digest = base64.b32decode(r.headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            refers = r.headers.get("X-Refers-To-Page-ID")
            rows.append((page, url, int(r.http["Content-Length"]), digest, r.kind, int(refers) if refers else None, r.payload if r.kind == "response" else None))
            size += len(r.payload)
            if size > 4 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    # an ask that many rows make is answered once and joined back by the caller; asks of a file come in groups of bounded size
    asked = asked.distinct().withColumn("slice", F.pmod(F.xxhash64("low"), F.lit(slices_)))
    groups = asked.groupBy("part", "slice").agg(F.collect_list(F.struct("low", "high", "url")).alias("asks"))
    entries = directory.groupBy("part").agg(F.collect_list(F.struct("first", "path", "offset", "length")).alias("entries"))
    return groups.join(entries, "part").select("asks", "entries").mapInArrow(find, schema)


def archive_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive all pages, index them, and look every page up again (see look_up). Rows without a page_id are found by
    their url. Pages that share an id and a url give a row for each record; an empty table gives none."""
    spark = pages.sparkSession
    archives, index = shared_path(spark, "warc"), shared_path(spark, "warc-index")
    directory = write_index(write_archives(pages, archives, page_id=page_id, url=url, html=html), index)
    named = pages.select(F.col(url).cast("string").alias("url"), F.col(page_id).cast("long").alias("page_id"))
    found = look_up(named.filter("page_id is not null"), directory, archives, index, exact=True)
    unnamed = named.filter("page_id is null")
    if unnamed.isEmpty():
        return found
    return found.unionByName(look_up(unnamed, directory, archives, index, exact=True).filter("page_id is null"))
