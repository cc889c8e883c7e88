"""WARC archives through a chunked record table.

Each payload becomes rows of record and chunk number, a chunk at most ``CHUNK`` bytes, as soon as it is read; its digest is carried
from chunk to chunk. These rows are written, and they are all that is exchanged from then on: decisions join them by record, writer
and reader hold one chunk at a time, whatever a record's size (the source row itself is the one place where a payload is whole).
Each record is a gzip member of its own. Archives lie in a shared folder, under names that hold the attempt of their task;
only those of tasks that ended are in the table of archives, so a task that is lost or repeated adds no second archive.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others revisit it.

Defined cases: a null payload counts as the empty one; a null address is written as ``about:blank``; rows that repeat an id and its payload are all
written, each as what the first of them is; a null id reads back as null, and its record is never revisited; an empty table gives no archive and no
record; columns other than id, address and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, staged, tidy

CHUNK = 1 << 20
#: Bytes of payload that an archive holds, about.
ARCHIVE_BYTES = 256 << 20
URN = "urn:tracelode:record:"
CRLF = b"\r\n"
CHUNK_TYPE = "archive string, record long, record_id string, record_type string, target string, refers_to string, payload_digest string, chunk int, last boolean, data binary"


def chunk_rows(df: DataFrame, id_col: str, url_col: str, payload_col: str, size: int = CHUNK) -> DataFrame:
    """The chunked record table of payloads. The last chunk of a record, which may be its only one and empty, has size and digest."""
    src = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20]", ""), F.lit("about:blank")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    names = ["row", "id", "url", "chunk", "last", "data", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for id_, url, payload in zip(*b.columns, strict=True):
                raw = payload.as_buffer()
                state, about = hashlib.sha1(), (row, id_.as_py(), url.as_py())
                parts = max(1, -(-len(raw) // size))
                for k in range(parts):
                    data = raw.slice(k * size, min(size, len(raw) - k * size))
                    state.update(data)
                    last = k == parts - 1
                    held.append((*about, k, last, data.to_pybytes(), len(raw) if last else None, base32(state.digest()) if last else None))
                    total += len(data)
                    if total >= 4 * size or len(held) >= 1000:
                        yield out()
                        held, total = [], 0
                row += 1
        if held:
            yield out()

    return src.mapInArrow(tidy(run), "row long, id long, url string, chunk int, last boolean, data binary, payload_bytes long, payload_digest string")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def digests(chunked: DataFrame, keep: list[str]) -> DataFrame:
    """One row a record from its adjacent chunks: ``keep``, payload_bytes and payload_digest, the bare base-32 SHA-1."""
    kinds = [f for f in chunked.schema if f.name in keep]
    names = [f.name for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n = hashlib.sha1(), 0
        for b in batches:
            done, sizes, found = [], [], []
            for i, (last, data) in enumerate(zip(b.column(len(names)), b.column(len(names) + 1), strict=True)):
                raw = data.as_buffer() if data.is_valid else b""
                state.update(raw)
                n += len(raw)
                if last.as_py():
                    done.append(i)
                    sizes.append(n)
                    found.append(base32(state.digest()))
                    state, n = hashlib.sha1(), 0
            at = pa.array(done, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(names))), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=[*names, "payload_bytes", "payload_digest"])

    from pyspark.sql import types as T

    schema = T.StructType([*kinds, T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())])
    return chunked.select(*names, "last", "data").mapInArrow(tidy(run), schema)


def decide(records: DataFrame, least: int = 0) -> DataFrame:
    """Add record_type and refers_to to records (id, payload_bytes, payload_digest)."""
    first = records.where((F.col("payload_bytes") >= least) & F.col("id").isNotNull()).groupBy("payload_digest").agg(F.min("id").alias("__first"))
    first = staged(first, "first-records")  # so that the join deals both of its sides anew and may split a common payload
    again = (F.col("payload_bytes") >= least) & F.col("__first").isNotNull() & ~F.col("id").eqNullSafe(F.col("__first"))
    out = records.join(first, "payload_digest", "left")
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("__first"))).drop("__first")


def _folder(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _head(kind: str, record_id: str, target: str, refers_to: str | None, digest: str, size: int, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: " + str(size).encode() + CRLF * 2
    block = len(http) + (size if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + http


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, chunk: int = CHUNK, date: str | None = None) -> DataFrame:
    """Write archives below ``path``; a row each (archive, records). Ids are long. ``date`` is that of the records, by default now."""
    spark = df.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    table = staged(chunk_rows(df, id_col, url_col, payload_col, chunk), "record-chunks")
    chosen = decide(table.where("last").select("row", "id", "payload_bytes", "payload_digest"), least).drop("id")
    again = F.col("record_type") == "revisit"
    # dealt by record first: however the decisions are joined, a record's chunks stay together
    dealt = table.drop("payload_bytes", "payload_digest").repartition(F.col("row"))
    both = dealt.join(chosen.hint("shuffle_hash"), "row").where(~again | (F.col("chunk") == 0))
    both = both.withColumn("last", again | F.col("last")).withColumn("data", F.when(again, F.lit(b"")).otherwise(F.col("data")))
    rows = both.sortWithinPartitions("row", "chunk").select("id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "chunk", "last", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, top = _folder(path)
        fs.create_dir(top, recursive=True)
        task = TaskContext.get()
        out, zipped, written, records, name = None, None, 0, 0, ""
        done: list[tuple[str, int]] = []
        try:
            for b in batches:
                for row in zip(*b.columns, strict=True):
                    id_, url, kind, refers, digest, size, k, last = (x.as_py() for x in row[:8])
                    if out is None:
                        name = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                        out = fs.open_output_stream(name, compression=None)
                    if k == 0:
                        zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
                        out.write(zipped.compress(_head(kind, f"{URN}{'' if id_ is None else id_}", url, None if refers is None else f"{URN}{refers}", digest, size, date)))
                    out.write(zipped.compress(row[8].as_buffer()))
                    if last:
                        out.write(zipped.compress(CRLF * 2) + zipped.flush())
                        written, records = written + size, records + 1
                        if written >= ARCHIVE_BYTES:
                            out.close()
                            done.append((name, records))
                            out, written, records = None, 0, 0
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], names=["archive", "records"])

    found = staged(rows.mapInArrow(tidy(run), "archive string, records long"), "archives")
    discard(spark, table)
    return found


class Stream:
    """Bytes of a gzip file with any number of members, as they are needed."""

    def __init__(self, file, block: int = 1 << 16):
        self.file, self.block = file, block
        self.zip, self.held, self.raw = zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.zip.eof:
                self.raw, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(self.block)
                if not self.raw:
                    return False
            new = self.zip.decompress(self.raw, self.block)
            self.raw = self.zip.unconsumed_tail
            if new:
                self.held += new
                return True

    def line(self) -> bytes:
        while (at := self.held.find(CRLF)) < 0:
            if not self._more():
                out, self.held = self.held, b""
                return out
        out, self.held = self.held[:at], self.held[at + 2 :]
        return out

    def some(self, most: int) -> bytes:
        """At least one byte unless the file ends, at most ``most``."""
        if not self.held:
            self._more()
        out, self.held = self.held[:most], self.held[most:]
        return out

    def ended(self) -> bool:
        return not self.held and not self._more()


def _fields(s: Stream) -> tuple[dict[str, str], int]:
    out, size = {}, 0
    while line := s.line():
        size += len(line) + 2
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out, size + 2


def records_in(file, chunk: int = CHUNK) -> Iterator[tuple]:
    """(record, id, type, target, refers_to, digest, chunk, last, data) of each chunk of an open archive, without HTTP headers."""
    s, number = Stream(file), 0
    bare = lambda x: x[1:-1] if x and x[0] == "<" else x
    while not s.ended():
        first = s.line()
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head, _ = _fields(s)
        left = int(head["content-length"])
        if left and head.get("content-type", "").startswith("application/http"):
            left -= len(s.line()) + 2
            left -= _fields(s)[1]
        about = (number, bare(head.get("warc-record-id")), head.get("warc-type"), bare(head.get("warc-target-uri")), bare(head.get("warc-refers-to")), (head.get("warc-payload-digest") or "").removeprefix("sha1:"))
        k, parts, size = 0, [], 0
        while left:
            got = s.some(min(left, chunk - size))
            if not got:
                raise ValueError("a record is cut short")
            left -= len(got)
            parts.append(got)
            size += len(got)
            if size == chunk and left:
                yield (*about, k, False, b"".join(parts))
                k, parts, size = k + 1, [], 0
        yield (*about, k, True, b"".join(parts))
        number += 1


def read(spark: SparkSession, archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of archives (a column ``archive`` of paths), each read by one task, a chunk at a time."""
    n = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.partition(" ")[0] for x in CHUNK_TYPE.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.bool_(), pa.binary()]
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = _folder(name)
                with fs.open_input_stream(path, compression=None) as file:
                    held, size = [], 0
                    for row in records_in(file, chunk):
                        held.append((name, *row))
                        size += len(row[-1])
                        if size >= 4 * chunk or len(held) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return archives.select("archive").repartition(n).mapInArrow(tidy(run), CHUNK_TYPE)


def records(chunked: DataFrame) -> DataFrame:
    """One row a record of the chunked table: id, record_type, refers_to, payload_bytes, payload_digest; the digest is made anew.

    A revisit has no payload of its own: its size is that of the response it refers to, its digest the one in its header.
    """
    number = lambda c: F.when(F.col(c) != URN, F.expr(f"substring({c}, {len(URN) + 1})")).cast("long")
    keep = ["archive", "record", "record_id", "record_type", "target", "refers_to", "payload_digest"]
    found = digests(chunked.withColumnRenamed("payload_digest", "__told").select(*[c if c != "payload_digest" else "__told" for c in keep], "last", "data"), [c if c != "payload_digest" else "__told" for c in keep])
    found = staged(found.select(number("record_id").alias("id"), "record_type", number("refers_to").alias("refers_to"), F.col("__told").alias("told"), "payload_bytes", "payload_digest"), "records-read")
    whole = found.where("record_type = 'response' and id is not null").groupBy(F.col("id").alias("refers_to"), F.col("payload_digest").alias("told")).agg(F.min("payload_bytes").alias("__n"))
    whole = staged(whole, "records-whole")
    own = found.where("record_type <> 'revisit'")
    again = found.where("record_type = 'revisit'").join(whole, ["refers_to", "told"], "left").select("id", "record_type", "refers_to", "told", F.col("__n").alias("payload_bytes"), F.col("told").alias("payload_digest"))
    return own.unionByName(again).drop("told")


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write archives into the shared folder and read them back."""
    spark = df.sparkSession
    archives = write(df, new_path(spark, "warc"), id_col, url_col, payload_col, least)
    return records(read(spark, archives))
