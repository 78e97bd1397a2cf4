"""WARC archives, and a two-level capture index for reading single records out of them.

Archives are files of gzip members, one for each record, written by the tasks into the shared
folder. A task gives each file a name of its own and returns it as a row; only files in the
written manifest exist for the readers, so a task that is run again leaves nothing double.

The index sorts captures by a key of the URL with the host reversed (so one site is
together), range-partitioned, and packs runs of ``BLOCK_LINES`` sorted lines into compressed
blocks. The directory has one small entry for each block: its first and last key. A lookup
bisects the directory, which is sent out in slices of a fixed number of entries, then bisects
the lines of the blocks it names, and reads just the bytes of the records found.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.llm.tables import materialize
from churnloom.sources.storage import scratch_path

DATE = "2000-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 512
DIRECTORY_SLICE = 100_000
KEYS_A_ROW = 4096
_READ = 1 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?(.*)$", re.S)

MANIFEST = "file string, bytes long, records long"
CAPTURE = "url string, record_id string, file string, offset long, length long"
RECORD = (
    "record_id string, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query`` for a URL: sites together, pages of a site in order."""
    match = _URL.match(url or "")
    if not match:
        return url or ""
    _, host, port, rest = match.groups()
    name = ",".join(reversed(host.lower().split(".")))
    port = f":{port}" if port and port not in ("80", "443") else ""
    return f"{name}{port}){rest.partition('#')[0] or '/'}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder in the shared store."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    data = f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _urn(page_id: str) -> str:
    return f"<urn:page:{quote(page_id, safe='')}>"


def _record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    )
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _urn(refers_to))]
        payload = b""
    return _member(headers, http.encode() + payload)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        task, out, done, size, count = TaskContext.get().partitionId(), None, [], 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.page_id, batch.url, batch.html, batch.refers_to):
                if out is None:
                    name = f"part-{task:05d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                            ("WARC-Date", DATE), ("WARC-Filename", name),
                            ("Content-Type", "application/warc-fields")]
                    size += out.write(_member(info, b"format: WARC File Format 1.1\r\n"))
                payload = (html or "").encode()
                refers_to = refers_to if isinstance(refers_to, str) else None
                size += out.write(_record(page_id or "", url or "", payload, sha1_base32(payload), refers_to))
                count += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pd.DataFrame(done, columns=["file", "bytes", "records"], dtype=object)

    return write


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of ``page_id``, ``url``, ``html``; return the manifest.

    Of rows with equal payloads those with the smallest ``page_id`` are responses, the others
    revisits of it. Null html is an empty payload, null ids and URLs are empty strings; a null
    id is after all others. Repeated rows give repeated records, other columns are ignored.
    """
    rows = pages.select("page_id", "url", "html").withColumn(
        "digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    )
    first = materialize(
        rows.groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id"),
        "payloads",
    )
    other = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    typed = rows.join(first, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "html",
        F.when(other, F.col("first_id").cast("string")).alias("refers_to"),
    )
    return materialize(typed.mapInPandas(_writer(folder, archive_bytes), MANIFEST), "manifest")


def _members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream."""
    offset, left = 0, b""
    while True:
        unpack, parts, length = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            data = left or stream.read(_READ)
            left = b""
            if not data:
                if length:
                    raise ValueError(f"archive ends inside the record at {offset}")
                return
            parts.append(unpack.decompress(data))
            length += len(data) - len(unpack.unused_data)
        left = unpack.unused_data
        yield offset, length, b"".join(parts)
        offset += length


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> dict:
    """Fields of a record; the digest of a response's payload is computed and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    record = {"record_type": fields["warc-type"], "record_id": "", "url": "", "refers_to": None,
              "payload_bytes": 0, "payload_digest": "", "payload": None}
    if record["record_type"] not in ("response", "revisit"):
        return record
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    page = lambda urn: unquote(urn[len("<urn:page:") : -1])
    record |= {
        "record_id": page(fields["warc-record-id"]),
        "url": unquote(fields["warc-target-uri"]),
        "payload_bytes": int(_fields(http)["content-length"]),
        "payload_digest": digest,
    }
    if record["record_type"] == "revisit":
        record["refers_to"] = page(fields["warc-refers-to"])
    else:
        record["payload"] = payload
        if sha1_base32(payload) != digest:
            raise ValueError(f"payload of {record['record_id']} does not have its digest")
    return record


def read_captures(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the archives of a manifest through: URL, record id, file, offset and length."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_folder(folder)
        for batch in batches:
            for file in batch.file:
                with store.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    rows = []
                    for offset, length, data in _members(stream):
                        record = parse_record(data)
                        if record["record_type"] in ("response", "revisit"):
                            rows.append((record["url"], record["record_id"], file, offset, length))
                yield pd.DataFrame(rows, columns=["url", "record_id", "file", "offset", "length"], dtype=object)

    files = manifest.select("file")
    # Written, since a sort by key reads its rows twice, and reading the archives is dear.
    return materialize(files.repartition(max(1, files.count())).mapInPandas(read, CAPTURE), "captures")


def _key(url: str) -> Column:
    return F.udf(url_key, "string")(F.col(url))


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The index: ``block``, ``first_key``, ``last_key`` (the directory) and ``data``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, lines, keys = TaskContext.get().partitionId(), 0, [], []

        def packed() -> pd.DataFrame:
            data = zlib.compress("\n".join(lines).encode())
            row = ((shard << 32) | block, keys[0], keys[-1], data)
            return pd.DataFrame([row], columns=["block", "first_key", "last_key", "data"], dtype=object)

        for batch in batches:
            for key, file, offset, length in zip(batch.key, batch.file, batch.offset, batch.length):
                keys.append(key)
                lines.append(f"{quote(key, safe='/:=&?~#+!$,;@()*[]')}\t{file}\t{offset}\t{length}")
                if len(lines) == block_lines:
                    yield packed()
                    block, lines, keys = block + 1, [], []
        if lines:
            yield packed()

    keyed = captures.select(_key("url").alias("key"), "record_id", "file", "offset", "length")
    ordered = keyed.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return materialize(
        ordered.mapInPandas(pack, "block long, first_key string, last_key string, data binary"), "index"
    )


def _route(keys: DataFrame, entries: list[tuple[str, str, int]]) -> DataFrame:
    """``key`` and each ``block`` whose range of keys holds it."""
    firsts = [e[0] for e in entries]
    # Blocks are in key order, so the last keys are in order too.
    lasts = [e[1] for e in entries]
    blocks = [e[2] for e in entries]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, block)
                for key in batch.key
                for block in blocks[bisect.bisect_left(lasts, key) : bisect.bisect_right(firsts, key)]
            ]
            yield pd.DataFrame(rows, columns=["key", "block"], dtype=object)

    return keys.mapInPandas(route, "key string, block long")


def locate(index: DataFrame, urls: DataFrame) -> DataFrame:
    """``file``, ``offset``, ``length`` of all captures of the URLs in a column ``url``."""
    keys = materialize(urls.select(_key("url").alias("key")).distinct(), "keys")
    directory = index.select("first_key", "last_key", "block")
    entries = directory.count()
    slices = -(-entries // DIRECTORY_SLICE) or 1
    routed = None
    for n in range(slices):
        part = directory.where(F.pmod(F.xxhash64("block"), F.lit(slices)) == n)
        found = _route(keys, sorted(tuple(r) for r in part.collect()))
        routed = found if routed is None else routed.unionByName(found)
    wanted = materialize(routed, "routed")
    sizes = wanted.groupBy("block").agg(F.ceil(F.count("*") / KEYS_A_ROW).alias("parts"))
    listed = (
        wanted.join(sizes, "block")
        .groupBy("block", F.pmod(F.xxhash64("key"), "parts").alias("part"))
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data, wanted_keys in zip(batch.data, batch["keys"]):
                lines = [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]
                names = [unquote(line[0]) for line in lines]
                for key in wanted_keys:
                    for line in lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]:
                        rows.append((line[1], int(line[2]), int(line[3])))
            yield pd.DataFrame(rows, columns=["file", "offset", "length"], dtype=object)

    joined = index.select("block", "data").join(listed, "block").select("data", "keys")
    return materialize(joined.mapInPandas(search, "file string, offset long, length long"), "located")


def read_records(located: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at ``file``, ``offset``, ``length``, by range reads in file order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_folder(folder)
        name, handle = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(batch.file, batch.offset, batch.length):
                if file != name:
                    if handle:
                        handle.close()
                    name, handle = file, store.open_input_file(f"{path}/{file}")
                handle.seek(offset)
                record = parse_record(zlib.decompress(handle.read(length), 31))
                rows.append(record if payloads else record | {"payload": None})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")], dtype=object)
        if handle:
            handle.close()

    ordered = located.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(read, RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return scratch_path(spark, "archives")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read and index them, and read every record by its URL.

    Per record: ``page_id`` in its own type, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to``. Empty tables give no archive and no row.
    """
    spark = pages.sparkSession
    folder = folder or archive_folder(spark)
    kind = pages.schema["page_id"].dataType
    manifest = write_archives(pages, folder)
    captures = read_captures(manifest, folder)
    index = build_index(captures)
    records = read_records(locate(index, pages.select("url")), folder, payloads=False)
    own = lambda c: F.expr(f"nullif({c}, '')").cast(kind).alias(c)
    return records.withColumnRenamed("record_id", "page_id").select(
        own("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers_to")
    )
