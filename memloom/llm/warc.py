"""WARC archives: write, normalise from one gzip stream to one member per record, read back.

A crawler's archive is often one gzip stream over the whole file, so no record can be read without
inflating all before it. The normaliser inflates such a stream once, front to back, writes every
record as a gzip member of its own, and writes a sidecar index with each record's offset and
length, so that any record can be read alone.

Files live below the session's shared folder and are reached through ``pyarrow.fs``, so they may lie
in any store that it knows (local and network file systems, HDFS, object stores). Each is written
under a name of its task attempt and then moved to its final name: an attempt that is lost leaves no
half file under a name that is read, and a repeated task writes the same bytes again.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.arrow_text import tidy
from memloom.sources.scratch import drop, materialize, new_path, qualified

#: A raw archive is closed at this many payload bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 16 << 20, 5_000
#: Payloads under this size are always kept whole.
LEAST_REVISIT = 100
#: Date of records unless the caller gives one; a fixed one keeps repeated tasks equal.
DATE = "1970-01-01T00:00:00Z"

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX_COLUMNS = ("offset", "length", "record_type", "page_id")


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (with a scheme: see ``qualified``) and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _publish(store: pafs.FileSystem, made: str, path: str) -> None:
    if store.get_file_info(path).type != pafs.FileType.NotFound:
        store.delete_file(path)
    store.move(made, path)


def _attempt(path: str) -> str:
    return f"{path}.attempt-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def _field(name: str, value) -> str:
    """A header line; control characters of the value are percent-encoded. Nothing for None."""
    return "" if value is None else f"{name}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(value))}\r\n"


def record_bytes(kind: str, page_id: int | None, uri: str | None, payload: bytes, digest: str, payload_bytes: int, date: str = DATE, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of its page and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {uri} {digest} {kind}")
    head = "WARC/1.1\r\n" + _field("WARC-Type", kind) + _field("WARC-Record-ID", f"<urn:uuid:{name}>") + _field("WARC-Date", date) + _field("WARC-Target-URI", uri) + _field("X-Page-Id", page_id)
    if kind == "revisit":
        head += _field("WARC-Profile", _REVISIT) + _field("X-Refers-To-Page-Id", refers_to)
    head += _field("WARC-Payload-Digest", f"sha256:{digest}") + "Content-Type: application/http; msgtype=response\r\n" + _field("Content-Length", len(block)) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an inflated stream, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut short")
        yield head, block


def _payload(block: bytes) -> tuple[int, bytes]:
    """Content length in the HTTP header of a block, and what follows the header."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1]), payload


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def write_monolithic(pages: DataFrame, folder: str, html_column: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a response record into archives of one gzip stream each.

    Returns one row per page: page_id, url, archive (path in ``folder``), ordinal (in the archive),
    payload_bytes, payload_digest. Null html is an empty payload. Lazy: a caller stores the result
    before it reads the files.
    """

    def run(batches):
        store, root = _store(folder)
        part, made = TaskContext.get().partitionId(), 0
        names = ["page_id", "url", "archive", "ordinal", "payload_bytes", "payload_digest"]
        rows, sink, size, path, temporary = [], None, 0, "", ""

        def close():
            nonlocal sink
            sink[1].close()
            sink[0].close()
            sink = None
            _publish(store, temporary, path)
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

        for batch in batches:
            for page_id, uri, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                page_id, uri, payload = page_id.as_py(), uri.as_py(), (html.as_py() or "").encode()
                if sink is None:
                    name = f"part-{part:06d}-{made:05d}.warc.gz"
                    made, size, rows, path = made + 1, 0, [], posixpath.join(root, name)
                    store.create_dir(root, recursive=True)
                    temporary = _attempt(path)
                    raw = store.open_output_stream(temporary, compression=None)
                    sink = raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0)
                digest = hashlib.sha256(payload).hexdigest()
                sink[1].write(record_bytes("response", page_id, uri, payload, digest, len(payload)))
                rows.append((page_id, uri, name, len(rows), len(payload), digest))
                size += len(payload)
                if size >= archive_bytes or len(rows) >= ARCHIVE_RECORDS:
                    yield close()
        if sink is not None:
            yield close()

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_column).cast("string"))
    return columns.mapInArrow(tidy(run), "page_id long, url string, archive string, ordinal long, payload_bytes long, payload_digest string")


def revisit_plan(written: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """For each archive, which of its records become revisits of which page.

    Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id
    (null last; then by archive and place) stays a response. Only digests and numbers are shuffled,
    and only digests that repeat are joined back; a digest that very many pages share is counted
    in part before the shuffle. The list of an archive is bounded by the records of an archive.
    """
    slim = written.select("archive", "ordinal", "payload_digest", F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"), F.col("archive").alias("archive"), F.col("ordinal").alias("ordinal")).alias("at")).where(F.col("payload_bytes") >= least)
    first = slim.groupBy("payload_digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    revisits = slim.join(first, "payload_digest").where("at <> first").select("archive", "ordinal", F.col("first.page_id").alias("refers_to"))
    plan = written.select("archive").distinct().join(revisits, "archive", "left")
    return plan.groupBy("archive").agg(F.sort_array(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "refers_to")))).alias("revisits"))


def normalise(plan: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive of ``plan`` with one gzip member per record, and write its sidecar index.

    Returns one row per archive: archive, records, bytes. The index ``<archive>.idx`` in ``target`` has
    a line of offset, length, type and page_id for each record, tab-separated. The stream is
    inflated once; one record is in memory at a time.
    """

    def run(batches):
        store, into = _store(target)
        _, root = _store(source)
        store.create_dir(into, recursive=True)
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                name = row["archive"]
                turned = {x["ordinal"]: x["refers_to"] for x in row["revisits"] or ()}
                path = posixpath.join(into, name)
                made, index, offset, count = _attempt(path), io.StringIO(), 0, 0
                with store.open_input_stream(posixpath.join(root, name), compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream, store.open_output_stream(made, compression=None) as out:
                    for head, block in read_records(io.BufferedReader(stream, 1 << 20)):
                        page_id, digest = _number(head.get("x-page-id")), head["warc-payload-digest"].removeprefix("sha256:")
                        size, payload = _payload(block)
                        kind = "revisit" if count in turned else "response"
                        record = record_bytes(kind, page_id, head.get("warc-target-uri"), b"" if kind == "revisit" else payload, digest, size, head["warc-date"], turned.get(count))
                        member = gzip.compress(record, 6, mtime=0)
                        out.write(member)
                        index.write(f"{offset}\t{len(member)}\t{kind}\t{'' if page_id is None else page_id}\n")
                        offset, count = offset + len(member), count + 1
                _publish(store, made, path)
                made = _attempt(f"{path}.idx")
                with store.open_output_stream(made, compression=None) as out:
                    out.write(index.getvalue().encode())
                _publish(store, made, f"{path}.idx")
                done.append((name, count, offset))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return plan.mapInArrow(tidy(run), "archive string, records long, bytes long")


def read_back(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, each inflated alone from its place in the sidecar index.

    Returns page_id, payload_bytes, payload_digest (both of the full payload), record_type,
    refers_to, url, html (null for revisits). The digest of a response is computed anew from its payload.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        store, root = _store(folder)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                path = posixpath.join(root, name)
                with store.open_input_stream(f"{path}.idx") as f:
                    index = [x.split("\t") for x in f.read().decode().splitlines()]
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for offset, length, *_ in index:
                        inflated = zlib.decompress(f.read_at(int(length), int(offset)), 31)
                        ((head, block),) = read_records(io.BytesIO(inflated))
                        size, payload = _payload(block)
                        kind, digest, html = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:"), None
                        if kind == "response":
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: the payload at {offset} isn't what its header says")
                            html = payload.decode()
                        rows.append((_number(head.get("x-page-id")), size, digest, kind, _number(head.get("x-refers-to-page-id")), head.get("warc-target-uri"), html))
                        held += len(payload)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("archive").mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def archive_and_read(pages: DataFrame, folder: str | None = None, html_column: str = "html") -> DataFrame:
    """Write ``pages`` to monolithic archives, normalise them, and read every record back.

    ``folder`` (a URI that all executors reach; below the shared folder if None) gets ``warc`` with
    the normalised archives and their indexes; the monolithic ones are removed. Columns as in
    :func:`read_back`. Repeated rows each get a record; an empty table gives no archive.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or new_path(spark, "warc"))
    raw, done = f"{folder}/raw", f"{folder}/warc"
    written = materialize(write_monolithic(pages, raw, html_column), "warc-written")
    plan = materialize(revisit_plan(written), "warc-plan")
    deal = tasks_of(plan.count())
    archives = materialize(normalise(plan.repartition(deal), raw, done), "warc-archives")
    drop(written, plan)
    store, path = _store(raw)
    if store.get_file_info(path).type != pafs.FileType.NotFound:
        store.delete_dir(path)
    return read_back(archives.select("archive").repartition(deal), done)


def tasks_of(archives: int) -> int:
    """Tasks to deal archives over: one each up to 2000, beyond that 16 archives to a task.

    Rows of archives are tiny, so Spark by itself would gather them all in one task; each stands for ``ARCHIVE_BYTES`` of work.
    """
    return max(1, min(archives, 2000), archives // 16)
