"""WARC archives and their two-level capture index.

``write_archives`` writes pages as WARC/1.1 records, each a gzip member of its own, so that a record can be read by
offset and length. Of equal payloads of at least 1000 bytes the page with the largest id is the response
and the others are revisit records without a payload.

``build_index`` sorts captures by reversed-host key and packs them into compressed blocks of ``lines`` lines. Each
index part has a sparse directory with the first key of each block, and a master list has one bounded entry a part. A
look-up searches the master list, the part's directory and then one block by bisection, each fetched by
a range read. ``fetch`` reads the records found in order of file and offset, through one sliding window.

Files go to the folder of ``spark.checkpoint.dir`` by ``pyarrow.fs``. Their names hold the attempt's own random part, and
only rows of finished tasks name files, so a lost or repeated task leaves at most a file that nobody reads.

Pages are read and looked up in as many ranges as the archives' bytes ask for (``SHARE`` a task). A digest that more than one page in 4,096
has is dealt over salts by its count; at most 4,096 digests can be that frequent, so their list is broadcast.

Defined cases: null html is an empty payload; a null url has the empty key and no target; rows with a null id are responses and
are found by their url; repeated rows are records of their own, and all rows with the largest id
are responses; equal keys are in order of id; a payload of any length is one record, held whole while it is written or read; an empty table gives
an empty archive; columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_share, map_rows, new_folder, pack, stage, table

LEAST_REVISIT = 1000
LINES = 1000
ROLL = 1 << 30
SHARE = 32 << 20
PREFIX = 1024
WINDOW = 4 << 20
URN = "urn:x-page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The table has no crawl time; records carry this one.
DATE = "1970-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: ``http://a.example.com/x?y`` is ``com,example,a)/x?y``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.lower().strip(".").split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# --- records -------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value: control characters would end the line, so they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = page_id if page_id is not None else f"none:{digest}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8", "surrogatepass").partition(":") for line in lines)}


def parse(data: bytes) -> dict:
    """Fields of one uncompressed record; the payload's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(lines)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    out = {"type": fields["warc-type"], "id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "refers_to": None, "payload": b""}
    if out["type"] == "warcinfo":
        return out
    http, _, payload = block.partition(b"\r\n\r\n")
    out["bytes"] = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    out["digest"] = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    if out["type"] == "revisit":
        out["refers_to"] = _page(fields["warc-refers-to"])
    elif len(payload) != out["bytes"] or hashlib.sha1(payload).hexdigest() != out["digest"]:
        raise ValueError("payload does not match its digest")
    else:
        out["payload"] = payload
    return out


def _page(urn: str) -> int | None:
    m = re.fullmatch(rf"<{URN}(-?\d+)>", urn)
    return int(m[1]) if m else None


# --- writing -------------------------------------------------------------------------------------


def _typed(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and, for revisits, the page that they refer to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    page, url = F.col("page_id").cast("bigint"), F.col("url").cast("string")
    full = pages.select(page.alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    counts = full.where(large).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = stage(counts.where("n > 1 and top is not null"), "digests")
    share = hot_share(groups.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar())
    hot = groups.withColumn("share", share).where("n > share").select("digest", F.ceil(F.col("n") / F.col("share")).cast("int").alias("salts"))
    hot = F.broadcast(stage(hot, "hot"))
    one = F.coalesce("salts", F.lit(1))
    spread = groups.join(hot, "digest", "left").select("top", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"), "digest")
    spread = spread.select("top", F.concat_ws("#", "digest", "salt").alias("key"))
    # Small payloads have keys that match none, one for each row, so that none of them is hot.
    row = F.xxhash64("page_id", "url")
    keyed = full.join(hot, "digest", "left")
    keyed = keyed.withColumn("key", F.when(large, F.concat_ws("#", "digest", F.pmod(row, one))).otherwise(F.concat_ws("-", F.lit("small"), row)))
    joined = keyed.join(spread, "key", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("top") != F.col("page_id"), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, level: int = 6, roll: int = ROLL) -> DataFrame:
    """Writes the archives below ``folder``; ``(key, page_id, file, offset, length)`` of every record."""
    schema = "key string, page_id bigint, file string, offset bigint, length bigint"
    base = f"{folder}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number = pa.string(), pa.int64()
        arrow = pa.schema([("key", text), ("page_id", number), ("file", text), ("offset", number), ("length", number)])
        fs, root = _file_system(base)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, "", 0

        def member(data: bytes) -> bytes:
            return gzip.compress(data, level, mtime=0)

        def rows():
            nonlocal out, name, offset
            for batch in batches:
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if out is None or offset >= roll:
                        if out is not None:
                            out.close()
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, offset = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                        body = b"software: loomlog\r\n"
                        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
                        data = member(info.encode() + body + b"\r\n\r\n")
                        out.write(data)
                        offset += len(data)
                    data = member(record(page_id, url, payload, digest, refers_to))
                    out.write(data)
                    yield escaped(url), page_id, name, offset, len(data)
                    offset += len(data)
            if out is not None:
                out.close()

        yield from pack(rows(), arrow.names, arrow)

    return stage(_typed(pages).mapInArrow(run, schema), "captures", folder)


# --- index ---------------------------------------------------------------------------------------


KEY_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def escaped(url: str | None) -> str:
    """The key as it stands in the index: printable ASCII without spaces, so that byte order and string order are one."""
    return quote(surt(url), safe=KEY_SAFE, errors="replace")


def build_index(captures: DataFrame, folder: str, lines: int = LINES) -> list[tuple[str, str, str]]:
    """Writes blocks and directories below ``folder``; returns the master list, one entry a part, in order of key.

    An entry is the first key (at most PREFIX bytes of it) and the names of the part's two files. The list is as long as there are
    shuffle partitions, so its size is bounded whatever the number of captures.
    """
    base = f"{folder}/index"
    schema = "first string, blocks string, directory string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(base)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        out, offset, directory, held = None, 0, [], []

        def block():
            nonlocal offset
            data = zlib.compress("\n".join(held).encode(), 6)
            out.write(data)
            directory.append(f"{held[0].split(' ', 1)[0]} {offset} {len(data)}")
            offset += len(data)
            held.clear()

        for batch in batches:
            for key, page_id, *place in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.cdx", compression=None)
                held.append(" ".join([key, "-" if page_id is None else str(page_id), *map(str, place)]))
                if len(held) >= lines:
                    block()
        if out is None:
            return
        if held:
            block()
        out.close()
        with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
            f.write(zlib.compress("\n".join(directory).encode(), 6))
        first = directory[0].split(" ", 1)[0][:PREFIX]
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([f"{name}.cdx"]), pa.array([f"{name}.dir"])], names=["first", "blocks", "directory"])

    ordered = captures.select("key", "page_id", "file", "offset", "length")
    ordered = ordered.repartitionByRange("key", "page_id", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    parts = stage(ordered.mapInArrow(run, schema), "parts", folder)
    return sorted(map(tuple, parts.collect()))


class Reader:
    """Look-ups by bisection: master list, directory, block. Keeps the last few directories and blocks."""

    def __init__(self, base: str, parts: list[tuple[str, str, str]], keep: int = 4):
        self.fs, self.root = _file_system(f"{base}/index")
        self.parts = parts
        self.firsts = [p[0] for p in parts]
        self.keep = keep
        self.directories: OrderedDict[int, tuple[list[str], list[tuple[int, int]]]] = OrderedDict()
        self.blocks: OrderedDict[tuple[int, int], tuple[list[str], list[str]]] = OrderedDict()
        self.reads = 0

    def _kept(self, store: OrderedDict, key, make):
        if key in store:
            store.move_to_end(key)
        else:
            store[key] = make()
            if len(store) > self.keep:
                store.popitem(last=False)
        return store[key]

    def directory(self, i: int) -> tuple[list[str], list[tuple[int, int]]]:
        def make():
            with self.fs.open_input_file(f"{self.root}/{self.parts[i][2]}") as f:
                rows = [line.split(" ") for line in zlib.decompress(f.read()).decode().split("\n")]
            return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

        return self._kept(self.directories, i, make)

    def block(self, i: int, j: int) -> tuple[list[str], list[str]]:
        def make():
            offset, length = self.directory(i)[1][j]
            with self.fs.open_input_file(f"{self.root}/{self.parts[i][1]}") as f:
                self.reads += 1
                rows = zlib.decompress(f.read_at(length, offset)).decode().split("\n")
            return [r.split(" ", 1)[0] for r in rows], rows

        return self._kept(self.blocks, (i, j), make)

    def find(self, key: str) -> Iterator[tuple[int | None, str, int, int]]:
        """(page id, file, offset, length) of all captures of an escaped key."""
        # The first place that can hold the key is the block before the first one that begins with it.
        i = max(0, bisect_left(self.firsts, key[:PREFIX]) - 1)
        while i < len(self.parts) and self.firsts[i] <= key:
            firsts, _ = self.directory(i)
            j = max(0, bisect_left(firsts, key) - 1)
            while j < len(firsts) and firsts[j] <= key:
                keys, rows = self.block(i, j)
                for r in rows[bisect_left(keys, key) : bisect_right(keys, key)]:
                    _, page_id, file, offset, length = r.split(" ")
                    yield None if page_id == "-" else int(page_id), file, int(offset), int(length)
                j += 1
            i += 1


def ranges(captures: DataFrame, share: int = SHARE) -> int:
    """How many tasks read the archives back: one for ``share`` bytes, and no fewer than run at a time."""
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return max(captures.sparkSession.sparkContext.defaultParallelism, -(-size // share))


def look_up(wanted: DataFrame, folder: str, parts: list[tuple[str, str, str]], tasks: int) -> DataFrame:
    """``(page_id, file, offset, length)`` of the captures of each distinct ``(url, page_id)`` of ``wanted``."""

    def rows(batch):
        reader = Reader(folder, parts)
        last, found = None, {}
        for url, page_id in batch:
            key = escaped(url)
            if key != last:
                last, found = key, {}
                for capture in reader.find(key):
                    found.setdefault(capture[0], []).append(capture)
            yield from found.get(page_id, ())

    asked = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("bigint").alias("page_id")).distinct()
    asked = asked.repartitionByRange(tasks, "url", "page_id").sortWithinPartitions("url", "page_id")
    found = map_rows(asked, rows, "page_id bigint, file string, offset bigint, length bigint", ["url", "page_id"])
    # Urls that differ may share a key, and then a null id finds the same record from each of them.
    return stage(found.distinct(), "places", folder)


class Window:
    """Reads of rising offsets of a file, through one buffer."""

    def __init__(self, fs, root: str):
        self.fs, self.root = fs, root
        self.name, self.file, self.start, self.data = None, None, 0, b""

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
            self.start, self.data = 0, b""
        if not self.start <= offset or offset + length > self.start + len(self.data):
            self.start = offset
            self.data = self.file.read_at(max(length, WINDOW), offset)
        at = offset - self.start
        return self.data[at : at + length]

    def close(self):
        if self.file is not None:
            self.file.close()


def fetch(found: DataFrame, folder: str, tasks: int) -> DataFrame:
    """``(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to)`` of records, by range reads in order of file and offset."""

    def rows(batch):
        window = Window(*_file_system(f"{folder}/warc"))
        try:
            for name, offset, length in batch:
                r = parse(gzip.decompress(window.read(name, offset, length)))
                yield r["id"], r["url"], r["type"], r["payload"], r["bytes"], r["digest"], r["refers_to"]
        finally:
            window.close()

    ordered = found.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"
    return map_rows(ordered, rows, schema, ["file", "offset", "length"])


def round_trip(pages: DataFrame, folder: str | None = None, lines: int = LINES) -> DataFrame:
    """Pages written, indexed, looked up one and all, and read back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    parts = build_index(captures, folder, lines)
    tasks = ranges(captures)
    return fetch(look_up(pages, folder, parts, tasks), folder, tasks)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM m
"""
