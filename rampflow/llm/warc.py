"""Dictionary-compressed WARC archives: writer and reader.

Each file starts with a skippable frame that holds a Zstandard dictionary built from the file's own first
records; every record after it is a frame of its own, compressed with that dictionary. Of equal
payloads one record holds the payload (response) and the others point to it (revisit).
"""

from __future__ import annotations

import base64
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, partitions, scratch, small_batches, staged

#: Magic number of the skippable frame that holds a dictionary, by the public WARC-Zstandard proposal.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 32_768
#: Bytes of records that a file holds before compression, if no single record is longer.
FILE_BYTES = 1 << 30
#: Bytes of records that are held until a file's dictionary is built, and of samples taken evenly from them.
HELD_BYTES, TRAINING_BYTES = 12_000_000, 2_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-page")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC record of a payload of ``size`` bytes, which a revisit need not hold. Line breaks in a url are percent-encoded.

    A page's record id follows from its page_id and digest; a record of null id is named by its ``place`` instead.
    """
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{i}/{digest}' if i is not None else f'null/{place}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Payload-Bytes: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    block = _HTTP
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """A trained dictionary, or the records' own bytes where there are too few to train on."""
    import zstandard

    every = max(1, sum(map(len, records)) // TRAINING_BYTES)
    samples = [r[i : i + 65_536] for r in records[::every] for i in range(0, len(r), 65_536)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """One file on an open stream: holds records until the dictionary is built, then writes each as it comes."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.level, self.squeeze = stream, level, None
        self.held: list[bytes] = []
        self.size = self.records = 0

    def add(self, one: bytes) -> None:
        self.size += len(one)
        self.records += 1
        if self.squeeze:
            self.stream.write(self.squeeze.compress(one))
            return
        self.held.append(one)
        if self.size >= HELD_BYTES:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        words = build_dictionary(self.held)
        data = words.as_bytes()
        self.squeeze = zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=True)
        self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        for one in self.held:
            self.stream.write(self.squeeze.compress(one))
        self.held = []

    def close(self) -> None:
        if not self.squeeze:
            self._begin()
        self.stream.close()


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The bytes of one file."""
    out = io.BytesIO()
    writer = ArchiveWriter(out, level)
    for one in records:
        writer.add(one)
    if not writer.squeeze:
        writer._begin()
    return out.getvalue()


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, holding one record at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    data = stream.read(size)
    trained = data[:4] == struct.pack("<I", 0xEC30A437)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind))
    lines = io.BufferedReader(reader.stream_reader(stream, read_across_frames=True), 1 << 20)
    while first := lines.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {}
        while (line := lines.readline()).strip():
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = lines.read(int(head["Content-Length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def arrow_uri(uri: str) -> str:
    """A URI of Spark's by the scheme that Arrow knows: S3 has other names there."""
    return re.sub(r"^s3[an]://", "s3://", uri)


def located(uri: str):
    """(file system, path) of a URI of Spark's."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = located(folder)
        store.create_dir(root, recursive=True)
        task, made = TaskContext.get().taskAttemptId(), []
        writer = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if writer is None:
                    # The attempt is part of the name: a task that runs again writes files of its own.
                    name = f"pages-{task:06d}-{len(made):05d}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(f"{root}/{name}", compression=None))
                    made.append([f"{folder}/{name}", 0])
                payload = b"" if r.payload is None else r.payload
                writer.add(record(r.page_id and int(r.page_id), r.url, payload, int(r.bytes), _base32(r.sha1), r.record_type, r.first_id and int(r.first_id), "/".join(map(str, made[-1]))))
                made[-1][1] += 1
                if writer.size >= FILE_BYTES:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        yield pd.DataFrame(made, columns=["path", "records"])

    return run


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    def number(head: dict[str, str], key: str) -> int | None:
        return int(head[key]) if key in head else None

    def table(out: list[tuple]) -> pd.DataFrame:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        columns = dict(zip(names, zip(*out, strict=True), strict=True)) if out else {n: [] for n in names}
        return pd.DataFrame({n: pd.array(list(v), dtype="Int64") if n in ("page_id", "refers_to") else list(v) for n, v in columns.items()})

    for pdf in batches:
        for path in pdf["path"]:
            store, at = located(path)
            out = []
            with store.open_input_stream(at, compression=None) as f:
                for head, block in read_archive(f):
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Payload-Bytes"])
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    out.append((number(head, "Page-Id"), size, digest, head["WARC-Type"], number(head, "Refers-To-Page-Id")))
                    if len(out) == 10_000:
                        yield table(out)
                        out = []
            yield table(out)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages`` into WARC files under ``folder``; returns (path, records) per file.

    Of rows with equal payloads of ``least`` bytes or more, that of the smallest id is the response and the
    others are revisits of it; rows of that id again (repeated rows, of one record id) are responses too. Null html is the
    empty payload, a null url is about:blank. A row of null id is a revisit where its payload has an id, else
    a response without one. An empty table gives no files; other columns are ignored, whatever their names.
    """
    small_batches(pages.sparkSession)
    folder = folder or scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    rows = rows.withColumn("of", F.concat_ws("/", "sha1", F.sha2("payload", 256), "bytes"))
    first = rows.where(F.col("bytes") >= least).groupBy("of").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # Rows of a heavy payload are revisits but for the first, and move without it.
    is_first = lambda found: found["first_id"].isNull() | F.col("page_id").eqNullSafe(found["first_id"])
    rows = looked_up(rows, staged(first, "warc-first"), "of", "n", "page_id", "left", bare="payload", needed=is_first)
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    text = lambda c: F.col(c).cast("string")  # noqa: E731  pandas would make floats of ids with nulls
    rows = rows.select(text("page_id").alias("page_id"), "url", F.when(~again, F.col("payload")).alias("payload"), "bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, text("first_id")).alias("first_id"))
    return staged(rows.mapInPandas(_write(folder), "path string, records long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """Per record of the archives at ``files.path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads are checked against length and digest; a file that was changed raises an error.
    """
    n = max(1, min(files.count(), 4 * partitions(files.sparkSession)))
    return files.select("path").repartition(n).mapInPandas(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: Base 32 of a SHA-1: five hexadecimal digits are four base-32 digits.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload
)
SELECT p.page_id, octet_length(encode(p.payload))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(p.h, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN p.page_id = g.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> g.first_id THEN g.first_id END AS refers_to
FROM p JOIN g USING (payload)
"""
