"""WARC archives with a two-level capture index.

Each task writes its pages as gzip members to an archive of its own in the shared folder. Captures are sorted by
reversed-host key into index parts of compressed blocks; each part has a sparse directory with the first key of every
block, and the parts' first keys make the top. A lookup searches the top, then the part's directory, then the block by
bisection, and reads the record's range of the archive. The top has a row for each index part; directories are read by
the tasks that need them.

Of records with equal payloads of at least ``least_bytes`` bytes, that of the smallest page_id is a response and the
others revisit it. Defined results: null html is an empty payload; a page without id revisits the smallest id of its
payload, or is a response if there is none; repeated rows are written and found each; a page without address has the
key ''; control characters and spaces of a key are escaped before it is sorted. Pages of any length are whole records.
Only address, html and page_id are read, so other columns can't clash. An empty table makes archives and an index
without records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, small_enough, written
from .language import host_of

BLOCK_LINES = 256
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"


def _fs(path: str):
    """File system and path within it; a path without scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _escaped(key: Column) -> Column:
    """Control characters and spaces as %XX, so that no key holds what parts the fields and lines of an index, and the order of keys is that of lines."""
    made = key
    for c in (*range(33), 127):
        made = F.replace(made, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(key.rlike(r"[\x00-\x20\x7f]"), made).otherwise(key)


def key_of(url: Column) -> Column:
    """Reversed host, then path and query: com,example,www)/a?b. Null gives ''."""
    host = F.coalesce(host_of(url), F.lit(""))
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return _escaped(F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit("")))


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, payload: bytes, digest: str, refers_to=None, refers_url=None, date: str = DATE) -> bytes:
    """A record as a gzip member; a revisit has the HTTP header alone as its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = uuid.uuid4().urn if page_id is None else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"WARC-Page: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_header(refers_url or '')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """Type, page, refers_to, digest and the size of the full payload; a response's payload is checked against its digest."""
    data = zlib.decompressobj(31).decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    page, to = fields.get("WARC-Page"), fields.get("WARC-Refers-To")
    return {"record_type": fields["WARC-Type"], "page_id": int(page) if page else None, "refers_to": int(to.removeprefix("<urn:page:").removesuffix(">")) if to else None, "payload_digest": digest, "payload_bytes": size, "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None}


def write_archives(pages: DataFrame, folder: str, url: str = "url", html: str = "html", page_id: str = "page_id", least_bytes: int = 0) -> DataFrame:
    """Write a record a page; captures (key, page_id, file, start, length), as a written table."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.encode("html", "utf-8")), "key": key_of(F.col("url"))})
    long_enough = rows.filter(F.octet_length("html") >= least_bytes)
    same = long_enough.groupBy("sha").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")).filter("n > 1 and first is not null")
    same = written(same.select("sha", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "same")
    ready = rows.join(F.broadcast(same) if small_enough(same, 160) else same, "sha", "left")
    revisits = (F.octet_length("html") >= least_bytes) & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    ready = ready.select("key", "page_id", "url", F.when(revisits, F.col("first")).alias("first"), F.when(revisits, F.col("first_url")).alias("first_url"), F.unhex("sha").alias("sha"), F.col("html").cast("binary").alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _fs(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"  # an attempt's own: what a lost one wrote is never referred to
        out, at = None, 0
        for b in slices(batches, "html"):
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/{name}", compression=None)
            keys, ids, starts, lengths = b.column(0), b.column(1), [], []
            for _, page, address, first, first_url, sha, payload in zip(*[c.to_pylist() for c in b.columns], strict=True):
                member = record(page, address, payload, base64.b32encode(sha).decode(), first, first_url)
                out.write(member)
                starts.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array([name] * len(starts)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "start", "length"])
        if out is not None:
            out.close()

    return written(ready.mapInArrow(write, "key string, page_id long, file string, start long, length long"), "captures")


def _full(key: Column, page: Column) -> Column:
    return F.concat_ws(" ", key, F.coalesce(page.cast("string"), F.lit("-")))


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[bytes, str]]:
    """Write index parts and their directories; the top: first key and name of each part, by key."""
    frame = captures.select(_full(F.col("key"), F.col("page_id")).alias("full"), "file", "start", "length")
    parts = captures.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = frame.repartitionByRange(int(parts), "full", "file", "start").sortWithinPartitions("full", "file", "start")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _fs(folder)
        name, out, at, lines, directory = f"{uuid.uuid4().hex}.index", None, 0, [], []

        def block() -> None:
            nonlocal at
            data = zlib.compress(b"\n".join(lines), 6)
            out.write(data)
            directory.append(lines[0].partition(b"\t")[0] + b"\t%d\t%d" % (at, len(data)))
            at += len(data)
            lines.clear()

        for b in batches:
            for full, file, start, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(f"{full}\t{file}\t{start}\t{length}".encode())
                if len(lines) == block_lines:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            with files.open_output_stream(f"{base}/{name}.directory", compression=None) as d:
                d.write(b"\n".join(directory))
            yield pa.RecordBatch.from_pydict({"first": [directory[0].partition(b"\t")[0]], "name": [name]})

    return sorted((bytes(r["first"]), r["name"]) for r in ordered.mapInArrow(write, "first binary, name string").collect())


class Index:
    """Lookups by a worker; keeps the last part's directory, the last block, and some open archives."""

    def __init__(self, top: list[tuple[bytes, str]], index_folder: str, archive_folder: str):
        self.firsts, self.names = [k for k, _ in top], [n for _, n in top]
        self.files, self.base = _fs(index_folder)
        self.archives, self.archive_base = _fs(archive_folder)
        self.open: OrderedDict[str, object] = OrderedDict()
        self.directories: OrderedDict[str, list[tuple[bytes, int, int]]] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], list[bytes]] = OrderedDict()

    def _keep(self, cache: OrderedDict, key, make, most: int):
        if key in cache:
            cache.move_to_end(key)
        else:
            cache[key] = make()
            if len(cache) > most:
                cache.popitem(last=False)
        return cache[key]

    def _range(self, files, path: str, start: int, length: int) -> bytes:
        f = self._keep(self.open, path, lambda: files.open_input_file(path), 64)
        f.seek(start)
        return f.read(length)

    def _directory(self, name: str) -> list[tuple[bytes, int, int]]:
        def read():
            with self.files.open_input_stream(f"{self.base}/{name}.directory", compression=None) as f:
                rows = [line.split(b"\t") for line in f.read().split(b"\n")]
            return [(k, int(a), int(n)) for k, a, n in rows]

        return self._keep(self.directories, name, read, 4)

    def find(self, full: str) -> list[tuple[str, int, int]]:
        """File, start and length of every capture of the key. Equal keys may go on in later blocks and parts."""
        key = full.encode()
        found: list[tuple[str, int, int]] = []
        part = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while part < len(self.names):
            if self.firsts[part] > key:
                break
            name = self.names[part]
            directory = self._directory(name)
            k = max(bisect.bisect_left(directory, (key,)) - 1, 0)
            while k < len(directory) and directory[k][0] <= key:
                _, start, length = directory[k]
                lines = self._keep(self.blocks, (name, k), lambda: zlib.decompress(self._range(self.files, f"{self.base}/{name}", start, length)).split(b"\n"), 8)  # noqa: B023
                i = bisect.bisect_left(lines, key + b"\t")
                while i < len(lines) and lines[i].startswith(key + b"\t"):
                    _, file, at, n = lines[i].decode().split("\t")
                    found.append((file, int(at), int(n)))
                    i += 1
                k += 1
            part += 1
        return found

    def read(self, file: str, start: int, length: int) -> dict:
        return parse(self._range(self.archives, f"{self.archive_base}/{file}", start, length))


def lookup(keys: DataFrame, top: list[tuple[bytes, str]], index_folder: str, archive_folder: str, with_payload: bool = False) -> DataFrame:
    """The records of every distinct (key, page_id) of ``keys``: page_id, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for. Keys are sorted first, so a task goes along a stretch of the index."""
    spark = keys.sparkSession
    frame = keys.select(_full(F.col("key"), F.col("page_id")).alias("full"))
    ordered = frame.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "full").sortWithinPartitions("full")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 if with_payload else 5]
    kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=False))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = Index(top, index_folder, archive_folder), None
        for b in batches:
            rows, size = [], 0
            for full in b.column(0).to_pylist():
                if full == last:
                    continue
                last = full
                for place in index.find(full):
                    got = index.read(*place)
                    rows.append(got)
                    size += got["payload_bytes"] * with_payload
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds[n]) for n in names})
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds[n]) for n in names})

    return ordered.mapInArrow(search, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def round_trip(spark: SparkSession, pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", least_bytes: int = 0) -> DataFrame:
    """Write archives and index to the shared folder, then find and read every page through the index."""
    root = f"{shared_dir(spark)}/kinfold/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, f"{root}/archives", url, html, page_id, least_bytes)
    top = build_index(captures, f"{root}/index")
    keys = pages.select(key_of(F.col(url)).alias("key"), F.col(page_id).cast("long").alias("page_id"))
    return lookup(keys, top, f"{root}/index", f"{root}/archives")
