"""WARC archives with a Zstandard dictionary.

An archive starts with a skippable frame that holds a dictionary trained on its own records; each record follows as a
frame of its own, so any record can be read by itself with the dictionary. Pages with equal payloads are stored once: the
one with the least id as a response, the others as revisit records that refer to it. Payloads under `least_bytes` are
always stored.

Equal payloads are found by digest; what is shuffled for that is ids and digests, counted map-side, and the join of a hot
digest can be split. Pages then meet their kind of record by id. Archives are rolled by size, so a task holds one archive
at most. Files are written below the shared folder under names with the task attempt, and a manifest, cut by checkpoint,
names the files of attempts that succeeded; readers follow the manifest, so files of lost or repeated tasks do no harm.

Nulls: a null html is empty; a null url leaves the target out; a null id sorts after all others. Rows that repeat id and
payload are records each, of the same kind. An empty table writes no archive and gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, shared_dir

#: Skippable frame that holds a dictionary, by the proposal for .warc.zst files.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def build_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def build_archive(records: list[bytes], *, dictionary_bytes: int = 32 << 10, sample_bytes: int = 2 << 20, level: int = 3) -> bytes:
    """The dictionary is trained on records spread over the archive, `sample_bytes` of them (at most 16 KiB of each)."""
    share = max(1, -(-sum(min(len(r), 16 << 10) for r in records) // sample_bytes))
    sample = [r[: 16 << 10] for r in records[::share]]
    dictionary = None
    if sum(map(len, sample)) > 8 * dictionary_bytes and len(sample) >= 16:
        try:
            dictionary = zstandard.train_dictionary(dictionary_bytes, sample, k=200, d=8)
        except zstandard.ZstdError:  # too uniform to train on
            dictionary = None
    if dictionary is None:  # few or uniform records: their own content serves
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[-dictionary_bytes:].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    inner = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    return SKIPPABLE.to_bytes(4, "little") + len(inner).to_bytes(4, "little") + inner + b"".join(packer.compress(r) for r in records)


def read_archive(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record in a file."""
    if int.from_bytes(raw[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame")
    at = 8 + int.from_bytes(raw[4:8], "little")
    body = zstandard.ZstdDecompressor().decompress(raw[8:at])
    trained = body[:4] == b"\x37\xa4\x30\xec"
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    view = memoryview(raw)
    while at < len(raw):
        one, parts, upto = unpacker.decompressobj(), [], at
        while not one.eof:
            if upto >= len(raw):
                raise ValueError(f"cut off in the record at {at}")
            parts.append(one.decompress(view[upto : upto + (64 << 10)]))
            upto = min(upto + (64 << 10), len(raw))
        yield at, b"".join(parts)
        at = upto - len(one.unused_data)


def plan(pages: DataFrame, *, least_bytes: int = 100) -> DataFrame:
    """page_id, digest, record_type, refers_to, one row for each distinct page and payload."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    rows = rows.groupBy("page_id", "digest").agg(F.first("size").alias("size"))
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "digest", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, directory: str, *, least_bytes: int = 100, archive_bytes: int = 16 << 20, **options) -> DataFrame:
    """Writes archives below directory (a URI) and returns the manifest: path, records, bytes."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    kinds = plan(pages, least_bytes=least_bytes).select(F.col("page_id").alias("id"), F.col("digest").alias("own"), "record_type", "refers_to")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.join(kinds, F.col("page_id").eqNullSafe(F.col("id")) & (F.sha2("html", 256) == F.col("own")))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(directory)
        task, held, size, number = TaskContext.get(), [], 0, 0
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"

        def close() -> pa.RecordBatch:
            raw = build_archive(held, **options)
            name = f"{stem}-{number:05d}.warc.zst"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(raw)
            return pa.RecordBatch.from_pydict({"path": pa.array([f"{directory}/{name}"], pa.string()), "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                held.append(build_record(*(x.as_py() for x in row)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return cut(rows.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(archive, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """One row for each record of the manifest's archives; digests are recomputed from what was read."""
    spark = manifest.sparkSession
    paths = [r["path"] for r in manifest.select("path").collect()]  # one for each archive

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, raw in read_archive(content.as_py()):
                    headers, http, payload = parse_record(raw)
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: damaged payload at {at}")
                    rows.append((_page(headers["WARC-Record-ID"]), length, digest, kind, _page(headers["WARC-Refers-To"]) if kind == "revisit" else None, path.as_py().rpartition("/")[2], at))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RECORDS.split(", ")])

    if not paths:
        return spark.createDataFrame([], RECORDS)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(parse, RECORDS)


def fresh_directory(spark) -> str:
    """A folder for archives below the shared one, as a URI."""
    return re.sub("^file:/+", "file:///", f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
