"""WARC: a deterministic sharded writer, and its reader.

Pages are put in the order of their ids (then of their digests) and cut in ranges of about equal bytes, at exact quantiles of
the bytes, so that neither a distant id nor many null ids fill one range; the cuts depend on the data alone. Each range is
written by one task, which starts a new file whenever the compressed size passes a limit. Headers, record ids and digests
are made anew from the records. Files are written under temporary names; the task reports them as manifest rows; only
those that a completed task has reported get their final names, in tasks of their own, and the manifest names, sizes and
digests them. A task that runs twice leaves an unnamed file behind, which goes at the end, never a second shard.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is the response, the others
are revisits that refer to it; smaller payloads are all responses.

Defined results: null html is an empty payload; null url is ``urn:null``; rows with a null id come first; ids may be any longs;
repeated rows each get a record (those of one id and one payload in one range); a very long payload is a record like any
other and has to fit a task; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import new_path, small_batches, spent, written

MOST_RANGES = 1 << 16
MANIFEST = "range int, part int, temporary string, records long, bytes long, sha256 string"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame) -> DataFrame:
    """(id, url, body, digest) of every page."""
    return pages.select(
        F.col("page_id").cast("long").alias("id"), F.coalesce(F.col("url").cast("string"), F.lit("urn:null")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body")
    ).withColumn("digest", F.sha2("body", 256))


def roles(narrow: DataFrame, least: int = 100) -> DataFrame:
    """(id, digest, first) of the records (id, digest, size) whose payload recurs; ``first`` is the id of the response."""
    narrow = narrow.filter(F.col("size") >= least).select("id", "digest")
    groups = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = written(groups.select("digest", "first"), "warc-groups")  # settled first, so that Spark can split a hot payload's rows in the join
    return narrow.join(groups, "digest").select("id", "digest", "first").distinct()


#: Names of stores by which Spark knows them, and Arrow.
STORES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _store(root: str) -> tuple[fs.FileSystem, str]:
    scheme, mark, rest = root.partition("://")
    return fs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}://{rest}" if mark else f"file://{root.removeprefix('file:')}")


def _record(kind: str, page: int | None, url: str, body: bytes, digest: str, first: int | None, date: str, nth: int) -> bytes:
    name = "" if page is None else str(page)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if kind == "response" else http
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{_record_id(name, url, digest, nth)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {name}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {'' if first is None else first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(name: str, url: str, digest: str, nth: int) -> uuid.UUID:
    return uuid.UUID(bytes=hashlib.sha256(f"{name}\n{url}\n{digest}\n{nth}".encode()).digest()[:16], version=5)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _write(root: str, roll: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        attempt, sink, rows, now = uuid.uuid4().hex, None, [], None
        seen: tuple = ()
        shared: tuple | None = None
        nth = copy = 0

        def closed():
            sink.close()
            rows.append((*now[:5], now[5].hexdigest()))

        for batch in batches:
            for place, page, url, body, digest, first, role in zip(*(batch.column(c).to_pylist() for c in ("range", "id", "url", "body", "digest", "first", "role")), strict=True):
                if role:
                    shared = (page, digest, first)
                    continue
                many = shared is not None and shared[:2] == (page, digest)
                first = shared[2] if many else None
                copy = copy + 1 if seen[:2] == (page, digest) else 0  # of repeated rows of the smallest id the first is the response
                nth = nth + 1 if seen == (page, digest, url) else 0
                seen = (page, digest, url)
                kind = "revisit" if many and (page != first or copy) else "response"
                if now is None or now[0] != place or now[4] >= roll:
                    if now is not None:
                        closed()
                    part = now[1] + 1 if now is not None and now[0] == place else 0
                    name = f"_temporary/{attempt}-{place:05d}-{part:05d}.warc.gz"
                    store.create_dir(f"{base}/_temporary", recursive=True)
                    sink = store.open_output_stream(f"{base}/{name}")
                    now = [place, part, name, 0, 0, hashlib.sha256()]
                member = _member(_record(kind, page, url, body, digest, first, date, nth))
                sink.write(member)
                now[3] += 1
                now[4] += len(member)
                now[5].update(member)
        if now is not None:
            closed()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["range", "part", "temporary", "records", "bytes", "sha256"])

    return run


def _key() -> F.Column:
    """A text in the order of (id, digest), null ids first: with equal ids no more than the rows of one digest stay together."""
    sign = F.when(F.col("id") < 0, F.lit("0")).otherwise(F.lit("1"))
    return F.concat(F.when(F.col("id").isNull(), F.lit("-")).otherwise(F.concat(sign, F.lpad(F.hex("id"), 16, "0"))), F.substring("digest", 1, 12))


def cuts(narrow: DataFrame, range_bytes: int, most: int = MOST_RANGES) -> list[str]:
    """The first key of each range but the first, ranges of about equal bytes (at most ``most`` of them), exact whatever the partitioning.

    From (id, digest, size): keys are sorted in slices, a slice's bytes are added up on top of those of the slices before.
    """
    sizes = narrow.groupBy(_key().alias("key")).agg(F.sum(F.col("size") + 512).alias("size"))
    sliced = written(sizes.repartitionByRange("key").withColumn("slice", F.spark_partition_id()), "warc-sizes")
    per_slice = sliced.groupBy("slice").agg(F.sum("size").alias("total")).withColumn("ahead", F.coalesce(F.sum("total").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_slice = written(per_slice, "warc-slices")  # a row per partition
    range_bytes = max(range_bytes, -(-(per_slice.agg(F.sum("total")).first()[0] or 0) // most))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sliced.withColumn("inside", inside).join(per_slice.select("slice", "ahead"), "slice")
    first = placed.groupBy(F.floor((F.col("ahead") + F.col("inside")) / range_bytes).alias("place")).agg(F.min("key").alias("key"))
    found = [r["key"] for r in first.orderBy("place").select("key").collect()]  # a row per range
    spent(sliced, per_slice)
    return found[1:]


def range_of(keys: list[str]) -> F.Column:
    """How many of the sorted ``keys`` are not above a row's own: a binary search in a constant array."""
    if not keys:
        return F.lit(0)
    array, n = F.split(F.lit(",".join(keys)), ","), len(keys)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= n) & (F.get(array, a + s - 1) <= F.col("key")), a + s).otherwise(a))


def _publish(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Give finished files their final names; a repeated attempt finds them in place."""
        store, base = _store(root)
        for batch in batches:
            names = [f"shard-{a:05d}-{b:05d}.warc.gz" for a, b in zip(batch.column("range").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            for name, temporary in zip(names, batch.column("temporary").to_pylist(), strict=True):
                if store.get_file_info(f"{base}/{temporary}").type == fs.FileType.File:
                    store.move(f"{base}/{temporary}", f"{base}/{name}")
                elif store.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(f"{temporary} and {name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(batch.column(c) for c in ("records", "bytes", "sha256"))], ["name", "records", "bytes", "sha256"])

    return run


def write_archive(pages: DataFrame, path: str | None = None, least: int = 100, range_bytes: int = 32 << 20, roll: int = 4 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``; returns the manifest that was written there.

    A task writes a range of about ``range_bytes`` of payload, in files of about ``roll`` compressed bytes; raise both for a large archive.
    """
    spark = small_batches(pages).sparkSession
    path = path or new_path(spark, "warc")
    rows = records(pages)
    narrow = written(rows.select("id", "digest", F.length("body").cast("long").alias("size")), "warc-payloads")
    place = range_of(cuts(narrow, range_bytes))
    # bodies move once: the narrow rows that settle who refers to whom travel to the same places, ahead of them
    told = roles(narrow, least).select("id", F.lit("").alias("url"), F.lit(b"").alias("body"), "digest", "first", F.lit(True).alias("role"))
    both = rows.select("id", "url", "body", "digest", F.lit(None).cast("long").alias("first"), F.lit(False).alias("role")).unionByName(told)
    placed = both.withColumn("key", _key()).withColumn("range", place).drop("key")
    ranges = int(narrow.agg(F.sum(F.col("size") + 512)).first()[0] or 0) // range_bytes + 1
    files = placed.repartitionByRange(min(ranges, MOST_RANGES), "range").sortWithinPartitions("range", F.asc_nulls_first("id"), "digest", F.desc("role"), "url").mapInArrow(_write(path, roll, date), MANIFEST)
    files = written(files, "warc-files")
    manifest = written(files.repartition(max(1, min(ranges // 64, 1000)), "temporary").mapInArrow(_publish(path), "name string, records long, bytes long, sha256 string"), "warc-manifest")
    manifest.orderBy("name").write.mode("overwrite").json(f"{path}/manifest")
    store, base = _store(path)
    if store.get_file_info(f"{base}/_temporary").type == fs.FileType.Directory:
        store.delete_dir_contents(f"{base}/_temporary")  # of attempts that failed
    spent(narrow, files)
    return manifest.withColumn("path", F.concat(F.lit(f"{path}/"), "name"))


def _records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped file, one member in memory at a time."""
    store, name = _store(path)
    with store.open_input_stream(name) as source:
        rest, unpack, out = b"", zlib.decompressobj(31), []
        while data := rest or source.read(1 << 20):
            out.append(unpack.decompress(data))
            rest = unpack.unused_data
            if unpack.eof:
                head, _, block = b"".join(out).partition(b"\r\n\r\n")
                headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
                yield headers, block[: int(headers["Content-Length"])]
                unpack, out = zlib.decompressobj(31), []


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    number = lambda x: int(x) if x else None
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, held = [], 0
            for head, block in _records(path):
                http, _, body = block.partition(b"\r\n\r\n")
                kind = head["WARC-Type"]
                size = next(int(x[15:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
                digest = hashlib.sha256(body).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:")
                rows.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], kind, len(body) if kind == "response" else size, digest, number(head.get("X-Refers-To-Page-ID")), body if kind == "response" else None))
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archive(manifest: DataFrame) -> DataFrame:
    """The records of the files that a manifest names, a file per task."""
    spark: SparkSession = manifest.sparkSession
    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), 10_000)), "path").mapInArrow(_read, READ) if not paths.isEmpty() else spark.createDataFrame([], READ)
