"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

Tasks write archives of about ``roll`` bytes, a gzip member for each record
(or none, for plain archives), under names that hold the attempt's number, and
return a manifest; only what it lists is read, so that a task that ran twice
leaves no second copy of a record. Of equal payloads of at least ``least``
bytes the one with the smallest id is a response record, the others are
revisits that name it.

The reader checks each record: the member's CRC, the version line, the
Content-Length, the closing line breaks, the block's and the payload's digest.
When a check fails it searches on from the byte after the record's first for
the next member or version line at which a whole record passes, and logs the
bytes between as a gap. It holds one record, and reads an archive in chunks.

Edge cases: a null payload is an empty one; a null url gives no target line; a
null page_id is never the smallest, and its records refer to the response if
there is one; rows that repeat the smallest id are responses each; an empty
table gives no archive and no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep, scratch_path

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 20
#: A version line and headers longer than this are taken for damage; blocks and payloads have no limit but the archive's end.
HEAD_BYTES = 1 << 20
_SALTS = 16
_HEAD = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*\r\n")
_RECORDS = "archive string, kind string, offset bigint, length bigint, reason string, headers map<string,string>, payload binary"


def decide(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of each row."""
    rows = pages.select("page_id", F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # the digest alone is grouped, and summed before it is shuffled
    copies = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # rows of a very common payload meet its first copy in several parts
    copies = copies.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int")).join(copies, ["digest", "salt"], "left")
    return met.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record(row: dict) -> bytes:
    """One WARC record. row: page_id, url, payload, digest, record_type, refers_to."""
    revisit = row["record_type"] == "revisit"
    block = HTTP if revisit else HTTP + row["payload"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:page:{row['page_id']}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"X-Payload-Length: {len(row['payload'])}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(name: str):
    """The file system of a name, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", name))


def write_archives(decided: DataFrame, folder: str, compress: bool = True, roll: int = 32 << 20) -> DataFrame:
    """Writes the archives; returns the manifest (archive, records, bytes), which is itself kept."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        done, out, name, records, size = [], None, "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                store.move(f"{top}/{name}.open", f"{top}/{name}")
                done.append((f"{folder}/{name}", records, size))
                out = None

        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc" + ".gz" * compress
                    out, records, size = store.open_output_stream(f"{top}/{name}.open", compression=None), 0, 0
                raw = record(b.slice(i, 1).to_pylist()[0])
                if compress:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "records", "bytes"])

    return keep(decided.mapInArrow(run, "archive string, records bigint, bytes bigint"), "manifest")


class Source:
    """Bytes of a stream by place; what lies before the last place asked for is let go."""

    def __init__(self, stream):
        self.stream, self.base, self.buf, self.ended = stream, 0, b"", False

    def get(self, at: int, n: int) -> bytes:
        """n bytes from ``at`` on, or as many as there are."""
        while not self.ended and self.base + len(self.buf) < at + n:
            more = self.stream.read(max(CHUNK, len(self.buf) // 2))
            self.ended = not more
            self.buf += more
        return self.buf[at - self.base : at - self.base + n]

    def drop(self, at: int) -> None:
        if at - self.base > CHUNK:
            self.buf, self.base = self.buf[at - self.base :], at

    def find(self, whats: tuple[bytes, ...], at: int) -> int:
        """The next place of one of ``whats`` from ``at`` on, or the end as -1; what lies before is let go."""
        n = CHUNK
        while True:
            self.drop(at)
            part = self.get(at, n)
            if places := [k for what in whats if (k := part.find(what)) >= 0]:
                return at + min(places)
            if len(part) < n:
                return -1
            at += n - max(map(len, whats)) + 1

    def end(self) -> int:
        while not self.ended:
            self.get(self.base + len(self.buf), CHUNK)
            self.drop(self.base + len(self.buf))
        return self.base + len(self.buf)


class Damaged(Exception):
    pass


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a whole record."""
    m = _HEAD.match(raw)
    if not m:
        raise Damaged("version line or headers")
    head: dict[str, str] = {}
    for line in m[0].split(b"\r\n")[1:-2]:
        k, _, v = line.partition(b":")
        head[k.decode("utf-8", "replace").strip()] = v.decode("utf-8", "replace").strip()
    if not head.get("Content-Length", "").isdigit():
        raise Damaged("Content-Length")
    n = int(head["Content-Length"])
    block = raw[m.end() : m.end() + n]
    if len(block) < n or raw[m.end() + n : m.end() + n + 4] != b"\r\n\r\n":
        raise Damaged("block's length")
    told = head.get("WARC-Block-Digest", "")
    if told.startswith("sha256:") and hashlib.sha256(block).hexdigest() != told[7:]:
        raise Damaged("block digest")
    if head.get("WARC-Type") == "response":
        told = head.get("WARC-Payload-Digest", "")
        if told.startswith("sha256:") and hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() != told[7:]:
            raise Damaged("payload digest")
    return head, block


def _plain(src: Source, at: int, end: int | None) -> tuple[int, bytes]:
    n = 4096
    while True:
        part = src.get(at, n)
        m = _HEAD.match(part) if part.startswith(b"WARC/1.") else None
        if m or len(part) < n or n >= HEAD_BYTES or not part.startswith(b"WARC/1."):
            break
        n *= 4
    if not m:
        raise Damaged("version line or headers")
    size = re.search(rb"\r\nContent-Length: *(\d{1,18})\r\n", m[0], re.IGNORECASE)
    if not size:
        raise Damaged("Content-Length")
    n = m.end() + int(size[1]) + 4
    if end is not None and at + n > end:  # known before the bytes are read
        raise Damaged("block's length")
    return n, src.get(at, n)


def _member(src: Source, at: int, end: int | None) -> tuple[int, bytes]:
    z, out, k = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            part = src.get(k, 1 << 16)
            if not part:
                raise Damaged("member is cut off")
            out.append(z.decompress(part))
            k += len(part)
    except zlib.error as e:
        raise Damaged(f"member: {e}") from e
    return k - len(z.unused_data) - at, b"".join(out)


def read_records(stream, end: int | None = None) -> Iterator[dict]:
    """Records (kind, offset, length, headers, block) and gaps (kind, offset, length, reason) of an archive of ``end`` bytes, in order."""
    src = Source(stream)
    at, bad, reason = 0, None, ""
    gzip, plain = b"\x1f\x8b\x08", b"WARC/1."
    if src.get(0, 1) and not src.get(0, len(plain)).startswith((gzip, plain)):
        bad, reason = 0, "no record at the start"
        at = src.find((gzip, plain), 0)
    packed = at >= 0 and src.get(at, 3) == gzip
    while at >= 0 and src.get(at, 1):
        try:
            n, raw = (_member if packed else _plain)(src, at, end)
            head, block = parse(raw)
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            at = src.find((gzip if packed else plain,), at + 1)
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": reason}
            bad = None
        yield {"kind": "record", "offset": at, "length": n, "headers": head, "block": block}
        at += n
        src.drop(at)
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": src.end() - bad, "reason": reason}


def read_archives(archives: DataFrame) -> DataFrame:
    """archive, kind ('record' or 'gap'), offset, length, reason, headers and payload, for each name in ``archive``."""

    def run(batches):
        for b in batches:
            for name in b.column("archive").to_pylist():
                store, path = _store(name)
                end = store.get_file_info(path).size
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, end):
                        payload = r["block"].partition(b"\r\n\r\n")[2] if "block" in r else None
                        rows.append((name, r["kind"], r["offset"], r["length"], r.get("reason"), list(r["headers"].items()) if "headers" in r else None, payload))
                        size += len(payload or b"")
                        if size > 4 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                yield _rows(rows)

    spark = archives.sparkSession
    n = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism))
    return archives.select("archive").repartition(n).mapInArrow(run, _RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["archive", "kind", "offset", "length", "reason", "headers", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The pages written to archives in ``folder`` (or a new one in the shared folder), and read back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = "file://" + folder if folder.startswith("/") else folder.replace("file:/", "file:///")
    return read_archives(write_archives(decide(pages), folder))


def payloads(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of :func:`read_archives`.

    Of a revisit, size and digest are those of the payload that its response
    was read back with. A gap is an error, as its records are lost.
    """
    h = lambda name: F.col("headers")[name]
    page = lambda name: F.regexp_extract(h(name), r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    lost = F.raise_error(F.concat(F.lit("damaged bytes in "), "archive", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "reason"))
    own = read.select(
        F.when(F.col("kind") == "record", page("WARC-Record-ID")).otherwise(lost.cast("bigint")).alias("page_id"),
        h("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("n"),
        F.sha2("payload", 256).alias("digest"),
    )
    own = keep(own, "payloads")
    revisit = F.col("record_type") == "revisit"
    first = own.filter(~revisit & F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("first")).agg(F.min("n").alias("first_n"), F.min("digest").alias("first_digest"))
    first = first.join(own.filter(revisit).select(F.col("refers_to").alias("first")).distinct(), "first", "left_semi")
    first = first.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("part"))
    met = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")).join(first, revisit & (F.col("refers_to") == F.col("first")) & (F.col("salt") == F.col("part")), "left")
    pick = lambda a, b: F.when(revisit, F.col(a)).otherwise(F.col(b))
    return met.select("page_id", pick("first_n", "n").alias("payload_bytes"), pick("first_digest", "digest").alias("payload_digest"), "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"))


SQL = r"""
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
