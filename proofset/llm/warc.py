"""WARC archives in Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Writing: each task deals its rows into archives of bounded size in the shared folder and returns their paths;
a path counts only once its task has succeeded, so a lost executor leaves at most files that nobody lists.
Reading: the dictionary is loaded from the first frame, every following frame is decoded by itself as one
record, and version, mandatory headers, lengths and payload digests are validated; a bad record raises.

Equal payloads of at least `least_bytes` are written once, by the record with the largest page id; the others
become revisit records that carry digest and length but no payload.

Defined cases: a null payload is an empty one; a null url or id is written as the urn of an unknown page and
comes back as null; rows repeated with the largest id of their group are all responses; an empty table gives
no archives and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.llm.common import new_path, table, utf8, written

# Fixed values of the format.
SKIPPABLE_DICTIONARY = 0x184D2A5D
VERSION = b"WARC/1.1"
MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"

RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
RECORD_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"unknown" if page_id is None else str(page_id).encode())


def _page(urn: bytes) -> int | None:
    if not (urn.startswith(b"<urn:page:") and urn.endswith(b">")):
        raise ValueError(f"not a page's record id: {urn!r}")
    name = urn[10:-1]
    return None if name == b"unknown" else int(name)


def _escaped(url: str) -> str:
    """A url for a header line; one that looks like the urn of a page has its first letter escaped too."""
    plain = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return "%75" + plain[1:] if plain.startswith("urn:page:") else plain


def _unescaped(url: str) -> str:
    return url.replace("%75", "u").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit (refers_to given) keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if refers_to is not None else http + payload
    target = _urn(page_id) if url is None else b"<" + _escaped(url).encode() + b">"
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: " + DATE, b"WARC-Target-URI: " + target, b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _urn(refers_to)]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A record's fields, after validation; the inverse of record()."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[:end].split(b"\r\n")
    if end < 0 or lines[0] != VERSION:
        raise ValueError(f"no {VERSION.decode()} record")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    if missing := [k for k in MANDATORY if k not in head]:
        raise ValueError(f"headers are missing: {missing}")
    length = int(head[b"content-length"])
    if len(raw) != end + 4 + length + 4 or raw[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the record")
    block = raw[end + 4 : end + 4 + length]
    cut = block.find(b"\r\n\r\n")
    if cut < 0 or not block.startswith(b"HTTP/1.1 "):
        raise ValueError("no HTTP headers in the block")
    http = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in block[:cut].split(b"\r\n")[1:])}
    payload, size, digest, kind = block[cut + 4 :], int(http[b"content-length"]), head[b"warc-payload-digest"].removeprefix(b"sha1:").decode(), head[b"warc-type"].decode()
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload does not match its length or digest")
    elif kind != "revisit" or payload or b"warc-refers-to" not in head:
        raise ValueError(f"not a valid {kind} record")
    target = head[b"warc-target-uri"][1:-1]
    url = None if target.startswith(b"urn:page:") else _unescaped(target.decode())
    return _page(head[b"warc-record-id"]), url, kind, _page(head[b"warc-refers-to"]) if kind == "revisit" else None, size, digest, payload if kind == "response" else None


class ArchiveWriter:
    """Archives of about `archive_bytes` each in one folder. The first records of an archive, up to
    `sample_bytes`, train its dictionary; where they are too few or too small for that, the first of their bytes are
    the dictionary themselves."""

    def __init__(self, folder: str, archive_bytes: int, sample_bytes: int = 1 << 20, dictionary_bytes: int = 1 << 15, level: int = 3) -> None:
        self.folder, self.archive_bytes, self.sample_bytes, self.dictionary_bytes, self.level = folder, archive_bytes, sample_bytes, dictionary_bytes, level
        self.made: list[tuple[str, int]] = []
        self.waiting: list[bytes] = []
        self.held = 0
        self.out = None

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if self.held >= self.sample_bytes:
                self._open()
        else:
            self._put(raw)
        if self.out is not None and self.written >= self.archive_bytes:
            self._end()

    def _open(self) -> None:
        from pyarrow import fs as pafs

        fs, at = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.out, self.path, self.written, self.records = fs.open_output_stream(f"{at}/{name}", compression=None), f"{self.folder}/{name}", 0, 0
        try:
            dictionary = zstandard.train_dictionary(self.dictionary_bytes, self.waiting)
        except zstandard.ZstdError:
            dictionary = zstandard.ZstdCompressionDict(b"".join(self.waiting)[: self.dictionary_bytes], zstandard.DICT_TYPE_RAWCONTENT)
        body = dictionary.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(body)) + body)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=True, write_checksum=True)
        for raw in self.waiting:
            self._put(raw)
        self.waiting, self.held = [], 0

    def _put(self, raw: bytes) -> None:
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.written += len(frame)
        self.records += 1

    def _end(self) -> None:
        self.out.close()
        self.made.append((self.path, self.records))
        self.out = None

    def close(self) -> list[tuple[str, int]]:
        if self.waiting:
            self._open()
        if self.out is not None:
            self._end()
        return self.made


def read_archive(uri: str, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The raw records of one archive, a frame at a time; memory holds one chunk and one record. The name's ending must
    not make the file system unpack the file, here as in writing: the frames are read one by one."""
    from pyarrow import fs as pafs

    fs, at = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(at, compression=None) as stream:
        head = stream.read(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if magic != SKIPPABLE_DICTIONARY:
            raise ValueError(f"{uri} does not start with a dictionary frame")
        body = stream.read(size)
        if len(body) != size:
            raise ValueError(f"{uri}: the dictionary is cut off")
        if body.startswith(zstandard.FRAME_HEADER):  # a dictionary may be packed itself
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if size else zstandard.ZstdDecompressor()
        left = b""
        while left or (left := stream.read(chunk)):
            frame, parts = reader.decompressobj(), []
            while True:
                parts.append(frame.decompress(left))
                if frame.eof:
                    left = frame.unused_data
                    break
                if not (left := stream.read(chunk)):
                    raise ValueError(f"{uri}: the last frame is cut off")
            yield b"".join(parts)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, salts: int = 16) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to. The groups are found on narrow rows with
    combining before the shuffle; `salts` copies of each group's line spread a hot payload over tasks."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"))
    groups = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    salted = groups.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))).join(salted, ["payload_digest", "payload_bytes", "salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write what with_revisits() returns; the manifest (path, records) is stored in the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, archive_bytes)
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("page_id", "url", "payload_bytes", "payload_digest", "refers_to")}
            for i, body in enumerate(utf8(b.column("html"))):
                writer.add(record(c["page_id"][i], c["url"][i], body or b"", c["payload_bytes"][i], c["payload_digest"][i], c["refers_to"][i]))
        made = writer.close()
        yield pa.record_batch({"path": pa.array([p for p, _ in made], pa.string()), "records": pa.array([n for _, n in made], pa.int64())})

    return written(rows.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives of a manifest, validated. payload=False leaves the payload column null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path, count in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                seen = 0
                for raw in read_archive(path):
                    fields = parse(raw)
                    seen += 1
                    held += len(raw) if payload else 200
                    rows.append(fields if payload else (*fields[:6], None))
                    if held >= batch_bytes:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), RECORD.types, strict=True)], schema=RECORD)
                        rows, held = [], 0
                if seen != count:
                    raise ValueError(f"{path} holds {seen} records, {count} were written")
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), RECORD.types, strict=True)], schema=RECORD)

    return manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(read, RECORD_DDL)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(with_revisits(table(spark, sf_dir, "pages")), new_path(spark, "warc"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
