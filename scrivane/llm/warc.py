"""WARC archives with a two-level capture index.

Writing: one gzip member a record, files of bounded size in a folder that all executors share. Of records with equal
payloads of at least `min_revisit_bytes`, the one of the least page_id is a response; the others are revisits that refer to it
and hold no payload. Least ids are found by partial aggregation over payload digests, and digests that many rows share
are salted in the join. A file's name holds the task's attempt; the list of records is stored as soon as they are
written, so a repeated task leaves at most a file that no list names.

The index: lines of key, date, place and digest, sorted by reversed-host URL keys (com,example)/path), cut into
blocks of `block_lines`, each compressed for itself. Index files are at most PARTS ranges of keys; a file ends with its own directory, each
block's first key and place. A look-up searches the first keys of the files (PARTS of CUT characters at most), then a file's directory, then the
block, and reads only the block's and the records' byte ranges.

Reading back looks up the keys of all captures: each distinct key is sorted into a task that finds the blocks which may hold it, and the
blocks, with the keys asked of each, are dealt evenly to tasks. So a key that a third of all rows share is read by as many tasks as it
has blocks, and archives are never read as wholes: their records are read by place and length, near ones in one read.

Null html: as empty. A null url: the key "-". Records with a null page_id are responses that none refers to. Rows that repeat the least
page_id of their payload are responses as well. Ties in the index are sorted by page_id.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, shuffle_parts, store, work_dir

MIN_REVISIT_BYTES, BLOCK_LINES, FILE_BYTES, DATE = 0, 1000, 256 << 20, "2024-01-01T00:00:00Z"
#: Index files, and the characters of their first keys that every look-up holds; index blocks a task reads; byte ranges read together.
PARTS, CUT, BLOCKS, GAP, READ = 10_000, 64, 16, 4 << 10, 8 << 20
_NAMES = uuid.UUID("6f2d1c1e-6d7a-5b57-9f3e-0b8a4c1d2e3f")
_RECORDS = "page_id long, url string, file string, place long, length long, type string, refers_to long, digest string"


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: scheme, port 80 or 443, user and fragment go, host in lower case and reversed."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").rstrip(".")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:  # not a URL: its own key
        return url.replace(" ", "%20").replace("\n", "%0A")
    host = host.removeprefix("www.")
    name = host if host.replace(".", "").isdigit() else ",".join(reversed(host.split(".")))
    key = f"{name}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    return key.replace(" ", "%20").replace("\n", "%0A")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return _packed(raw)


def _packed(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the block of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files and return the list of records."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    same = (F.col("page_id").isNotNull()) & (F.octet_length("html") >= min_revisit_bytes)
    firsts = rows.where(same).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = store(firsts, "payloads")
    total = pages.count()
    joined = salted_join(rows.where(same), firsts.select("sha1", "first"), "sha1", firsts.select("sha1", "n"), total, "page_id")
    joined = joined.select("page_id", "url", "html", "first").unionByName(rows.where(~same).select("page_id", "url", "html", F.lit(None).cast("long").alias("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, place, n_files, name = None, 0, 0, ""
        for batch in batches:
            done: list[tuple] = []
            for page_id, url, text, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None or place > file_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n_files}.warc.gz"
                    out, place, n_files = fs.open_output_stream(f"{base}/{name}", compression=None), 0, n_files + 1
                    info = _record("warcinfo", [("WARC-Date", date), ("WARC-Record-ID", record_id(None, name)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    place = len(info)
                payload = text.encode()
                digest = payload_digest(payload)
                revisit = first is not None and first != page_id
                fields = [("WARC-Date", date), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
                fields += [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else []
                fields += [("X-Page-Id", str(page_id))] if page_id is not None else []
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                if revisit:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page", str(first))]
                    raw = _record("revisit", [*fields, ("Content-Type", "application/http; msgtype=response")], http)
                else:
                    raw = _record("response", [*fields, ("Content-Type", "application/http; msgtype=response")], http + payload)
                out.write(raw)
                done.append((page_id, url, name, place, len(raw), "revisit" if revisit else "response", first if revisit else None, digest))
                place += len(raw)
            if done:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], [x.split()[0] for x in _RECORDS.split(", ")])
        if out is not None:
            out.close()

    return store(joined.mapInArrow(run, _RECORDS), "records")


def write_index(records: DataFrame, folder: str, block_lines: int = BLOCK_LINES, date: str = DATE) -> DataFrame:
    """Write index files to `folder` and return the directory (first, file, place, length, lines), a row a block."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("key", pa.array([surt(u) for u in batch.column(1).to_pylist()], pa.string()))

    schema = "first string, file string, place long, length long, lines long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.gz"
        lines: list[str] = []
        blocks: list[tuple] = []
        place = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:

            def flush() -> None:
                nonlocal place
                raw = _packed("".join(lines).encode())
                out.write(raw)
                blocks.append((lines[0].split(" ", 1)[0], name, place, len(raw), len(lines)))
                place += len(raw)
                lines.clear()

            for batch in batches:
                for page_id, url, file, at, length, kind, refers, digest, key in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                    more = {"page_id": page_id, "url": url, "file": file, "place": at, "length": length, "type": kind, "refers_to": refers, "digest": digest}
                    lines.append(f"{key} {date} {json.dumps(more)}\n")
                    if len(lines) >= block_lines:
                        flush()
            if lines:
                flush()
            own = _packed("".join(f"{first} {at} {size}\n" for first, _, at, size, _ in blocks).encode())
            out.write(own)
            out.write(struct.pack("<q", len(own)))
        if blocks:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    with_key = records.mapInArrow(keyed, f"{_RECORDS}, key string")
    parts = min(shuffle_parts(records.sparkSession), PARTS)
    in_order = with_key.repartitionByRange(parts, "key", "page_id", "file", "place").sortWithinPartitions("key", "page_id", "file", "place")
    return store(in_order.mapInArrow(run, schema), "directory")


class Index:
    """Look-ups in the index files of a folder. parts: for each file its first key, cut to CUT characters, and its name.

    Names ascend with the keys. Only the directories of the last few files that were asked for are held.
    """

    def __init__(self, folder: str, parts: list[tuple[str, str]], held: int = 4):
        self.folder, self.held = folder, held
        self.files = sorted(name for _, name in parts)
        first = {name: key[:CUT] for key, name in parts}
        self.first = [first[name] for name in self.files]
        self.fs, self.base = _filesystem(folder)
        self.known: dict[str, tuple[list[str], list[tuple[int, int]]]] = {}

    @classmethod
    def parts_of(cls, directory: DataFrame) -> list[tuple[str, str]]:
        """At most PARTS rows of bounded size."""
        rows = directory.groupBy("file").agg(F.min("first").alias("first")).select(F.substring("first", 1, CUT).alias("first"), "file")
        return [(r["first"], r["file"]) for r in rows.collect()]

    def directory(self, file: str) -> tuple[list[str], list[tuple[int, int]]]:
        """First keys and places of a file's blocks, from the file's end."""
        if file not in self.known:
            with self.fs.open_input_file(f"{self.base}/{file}") as f:
                size = f.size()
                (n,) = struct.unpack("<q", f.read_at(8, size - 8))
                rows = [x.rsplit(" ", 2) for x in zlib.decompress(f.read_at(n, size - 8 - n), 31).decode().split("\n")[:-1]]
            while len(self.known) >= self.held:
                del self.known[next(iter(self.known))]
            self.known[file] = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        return self.known[file]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """The blocks (file, place, length) that may hold a key, ascending."""
        part = max(0, bisect.bisect_left(self.first, key[:CUT]) - 1)
        while part < len(self.files) and self.first[part] <= key:
            first, places = self.directory(self.files[part])
            at = max(0, bisect.bisect_left(first, key) - 1)
            while at < len(first) and first[at] <= key:
                yield self.files[part], *places[at]
                at += 1
            part += 1

    def lines(self, block: tuple[str, int, int]) -> list[str]:
        with self.fs.open_input_file(f"{self.base}/{block[0]}") as f:
            return zlib.decompress(f.read_at(block[2], block[1]), 31).decode().split("\n")[:-1]

    def captures(self, url: str | None) -> list[dict]:
        """All captures of a URL: the blocks that can hold its key, then a binary search in each."""
        key = surt(url)
        return [c for block in self.blocks(key) for c in captures_in(self.lines(block), [key])]


def captures_in(lines: list[str], keys: list[str]) -> list[dict]:
    """The captures of some keys in a block's lines, by binary search."""
    own = [x.split(" ", 1)[0] for x in lines]
    out = []
    for key in keys:
        i = bisect.bisect_left(own, key)
        while i < len(own) and own[i] == key:
            out.append(json.loads(lines[i].split(" ", 2)[2]))
            i += 1
    return out


def read_records(fs: pafs.FileSystem, base: str, captures: list[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and blocks of captured records by their byte ranges, file by file; ranges at most GAP apart are read together, up to READ bytes."""
    captures = sorted(captures, key=lambda c: (c["file"], c["place"]))
    i = 0
    while i < len(captures):
        name = captures[i]["file"]
        with fs.open_input_file(f"{base}/{name}") as f:
            while i < len(captures) and captures[i]["file"] == name:
                begin, end, j = captures[i]["place"], captures[i]["place"] + captures[i]["length"], i + 1
                while j < len(captures) and captures[j]["file"] == name and captures[j]["place"] <= end + GAP and captures[j]["place"] + captures[j]["length"] <= begin + READ:
                    end = captures[j]["place"] + captures[j]["length"]
                    j += 1
                raw = f.read_at(end - begin, begin)
                for c in captures[i:j]:
                    at = c["place"] - begin
                    yield read_record(zlib.decompress(raw[at : at + c["length"]], 31))
                i = j


def read_capture(folder: str, capture: dict) -> tuple[dict[str, str], bytes]:
    """One record by its byte range: its fields and its payload (empty for a revisit)."""
    fields, block = next(read_records(*_filesystem(folder), [capture]))
    return fields, block.partition(b"\r\n\r\n")[2]


def find_blocks(urls: DataFrame, folder: str, parts: list[tuple[str, str]]) -> DataFrame:
    """(file, place, length, keys): the index blocks that may hold captures of the URLs (column url), and the keys to be searched in each."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, parts)
        last, block, asked = None, None, []
        names = ["file", "place", "length", "keys"]

        def rows(done: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        done: list[tuple] = []
        for batch in batches:
            for key in batch.column(0).to_pylist():
                if key == last:
                    continue
                last = key
                for found in index.blocks(key):
                    if found != block:
                        if asked:
                            done.append((*block, asked))
                        block, asked = found, []
                    asked.append(key)
                    if len(done) >= 256:
                        yield rows(done)
                        done = []
        if asked:
            done.append((*block, asked))
        if done:
            yield rows(done)

    # Distinct first, by partial aggregation: a range keeps equal keys together.
    keys = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(keyed, "key string")
    in_order = keys.repartitionByRange(shuffle_parts(urls.sparkSession), "key").sortWithinPartitions("key")
    return in_order.mapInArrow(run, "file string, place long, length long, keys array<string>")


def read_archives(urls: DataFrame, folder: str, index_folder: str, directory: DataFrame) -> DataFrame:
    """Every capture of the URLs, found by the index and read from the archives: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to. Payload digests are computed again and compared with those of the records."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    parts = Index.parts_of(directory)
    found = store(find_blocks(urls, index_folder, parts), "asked-blocks")
    # Blocks are dealt in turn, so that tasks have about as many each.
    n_blocks = found.count()
    n = max(1, min(n_blocks, max(shuffle_parts(urls.sparkSession), math.ceil(n_blocks / BLOCKS)), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        index = Index(index_folder, [])
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for *block, keys in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out: list[tuple] = []
                for fields, body in read_records(fs, base, captures_in(index.lines(tuple(block)), keys)):
                    kind, page = fields["WARC-Type"], fields.get("X-Page-Id")
                    if kind == "response":
                        payload = body.partition(b"\r\n\r\n")[2]
                        size, digest, refers = len(payload), payload_digest(payload), None
                        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                    else:
                        size, digest, refers = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Refers-To-Page"])
                    out.append((None if page is None else int(page), fields.get("WARC-Target-URI"), size, digest, kind, refers))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return found.repartition(n).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages and their index, then look all URLs up in it and read their records back."""
    folder = work_dir(pages.sparkSession, "warc")
    records = write_archives(pages, folder, min_revisit_bytes)
    directory = write_index(records, f"{folder}-index")
    return read_archives(pages.select("url"), folder, f"{folder}-index", directory).drop("url")
