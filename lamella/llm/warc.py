"""WARC archives: written from pages, read back, and assembled into captures."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.shared import delete_path, new_path, small_batches, written


RECORD = "record_id string, type string, concurrent_to array<string>, headers map<string,string>, block_bytes bigint, payload binary, payload_bytes bigint, payload_digest string"
END = "\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A whole record; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(END)) for name, value in [("WARC-Type", kind), *headers]]
    given = [F.coalesce(line, F.lit("")) for line in lines]
    return F.concat(F.lit("WARC/1.1" + END), *given, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block, F.lit(END + END))


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, "[\r\n]", " ")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 32 << 20) -> None:
    """Writes three records for each row of ``pages`` (``page_id, url, html``): a response or revisit, its request, and metadata.

    The payload is the html in UTF-8, empty if null. Of pages with equal payloads of at least
    ``min_bytes``, that with the smallest id is the response and the others are revisits without
    a payload, which name its record in WARC-Refers-To; rows that repeat the smallest id are
    responses too, and so are all if no id is known. Request and metadata name the response in
    WARC-Concurrent-To. Urls are written without line ends; a null url leaves out the target URI.

    Files are called ``.warc.gz`` and have a gzip member for each record. A task begins a new file when the
    one it writes has ``file_bytes`` compressed bytes, so none is larger than that and one page's
    records. They are written by Spark's text writer, so archives go to any file system, whole and
    once, also if executors are lost; then each gets its name. Copies of one payload meet in a
    minimum that is aggregated before the shuffle; it is written, so that the join back is one of
    two plain exchanges, which Spark splits if it is skewed. ``pages`` is read twice and numbers
    its rows both times: pass a table.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.monotonically_increasing_id().alias("_row")).withColumn("_sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = own.filter(F.octet_length("html") >= min_bytes).groupBy("_sha1").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "_row"))).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts, _ = written(groups.filter("n > 1 AND first IS NOT NULL").select("_sha1", F.col("first.page_id").alias("first"), F.col("first._row").alias("first_row")), "firsts")
    known = own.join(firsts, "_sha1", "left")
    revisit = F.col("first").isNotNull() & (F.octet_length("html") >= min_bytes) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    known = known.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    # the row's number makes record ids unique where page ids repeat
    ids = [_uuid(F.lit(k), F.col("_row"), F.col("page_id")) for k in ("response", "request", "metadata")]
    when = F.lit("2024-01-01T00:00:00Z")
    target = one_line(F.col("url"))
    base = [("WARC-Target-URI", target), ("WARC-Date", when)]
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=UTF-8" + END + "Content-Length: "), size, F.lit(END + END))
    response = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", ids[0]),
            *base,
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_sha1")))),
            ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(F.col("revisit"), _uuid(F.lit("response"), F.col("first_row"), F.col("first")))),
        ],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1" + END + END))
    request = _record(F.lit("request"), [("WARC-Record-ID", ids[1]), *base, ("WARC-Concurrent-To", ids[0]), ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    facts = F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(END)), F.lit(""))
    metadata = _record(F.lit("metadata"), [("WARC-Record-ID", ids[2]), *base, ("WARC-Concurrent-To", ids[0]), ("Content-Type", F.lit("application/warc-fields"))], facts)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = 0, 0
        for batch in batches:
            files, out = [], []
            for records in zip(*batch.columns, strict=True):
                packed = b"".join(member(r.as_buffer()) for r in records)
                if held and held + len(packed) > file_bytes:
                    file, held = file + 1, 0
                held += len(packed)
                files.append(file)
                out.append(packed[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(out, pa.binary())], names=["file", "value"])

    rows = known.select(*[c.cast("binary").alias(n) for n, c in (("request", request), ("response", response), ("metadata", metadata))])
    # the last byte of each row's members is left to the text writer, as the end of a line
    packed = rows.mapInArrow(members, "file int, value binary").select("file", F.col("value").cast("string"))
    with small_batches(spark, 200):
        packed.write.partitionBy("file").option("lineSep", LAST).text(path)
    named(spark, path)


#: The last byte of a gzip member that holds less than 16 MB, as the most significant of its length.
LAST = "\0"


def member(record: bytes | memoryview) -> bytes:
    """A gzip member of the record; a record of 16 MB or more is followed by an empty member, so that all end with ``LAST``."""
    out = gzip.compress(record, 6, mtime=0)
    return out if out[-1:] == LAST.encode() else out + gzip.compress(b"", mtime=0)


def named(spark: SparkSession, path: str) -> None:
    """Moves the text files below ``path`` to names that end in ``.warc.gz``; only names pass through the driver."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listFiles(jvm_path(path), True)
    listed = []
    while found.hasNext():
        listed.append(found.next().getPath())
    for at in listed:
        if at.getName().endswith(".txt"):
            folder = at.getParent().getName().replace("file=", "")
            if not files.rename(at, jvm_path(path, f"{at.getName().removesuffix('.txt')}-{folder}.warc.gz")):
                raise OSError(f"{at} could not be renamed")


def base32(digest: Column) -> Column:
    """Upper-case base32 (RFC 4648) of 20 bytes, five bits at a time from the digits in base 2."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    hexed = F.hex(digest)
    quints = []
    for k in range(0, 40, 5):  # 5 hex digits are 20 bits, 4 letters
        value = F.conv(F.substring(hexed, k + 1, 5), 16, 10).cast("int")
        quints += [F.substring(letters, F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*quints)


def plain_bytes(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, plain or compressed (whole or by member), in parts of at most a megabyte."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        one = zlib.decompressobj(31)
        while not one.eof:
            chunk = one.unconsumed_tail
            if not chunk:
                chunk = data[at : at + (1 << 16)]
                at += len(chunk)
            part = one.decompress(chunk, 1 << 20)
            if not chunk and not part:  # the archive ends within a member
                return
            yield part
        at -= len(one.unused_data)


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of an archive; no more than one record is held unpacked."""
    held, parts = bytearray(), plain_bytes(data)

    def until(ready) -> bool:
        while not ready():
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while until(lambda: held.find(b"WARC/") >= 0):
        del held[: held.find(b"WARC/")]
        if not until(lambda: held.find(b"\r\n\r\n") >= 0):
            return
        end = held.find(b"\r\n\r\n")
        lines = held[:end].decode("utf-8", "replace").split(END)[1:]
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
        size = int(dict(headers).get("content-length", 0))
        until(lambda: len(held) >= end + 4 + size)
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def _payload(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``, lengths and digests computed from the bytes read.

    A task holds an archive as it is stored, whose size ``write_archives`` bounds, and unpacks it
    record by record. A revisit has no payload of its own: its payload is empty and its digest
    the one that it states.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for listed, block in parse(content):
                    headers = dict(listed)
                    kind = headers.get("warc-type", "")
                    payload = _payload(kind, headers, block)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if kind == "revisit":
                        digest, payload = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, b""
                    linked = [v for k, v in listed if k == "warc-concurrent-to"]
                    out.append((headers.get("warc-record-id"), kind, linked, headers, len(block), payload, len(payload), digest))
                    held += len(payload) + 1000
                    if held > 8_000_000:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("content")
    return files.mapInPandas(records, RECORD)


MAIN = ("response", "revisit", "resource")


def captures_of(records: DataFrame) -> DataFrame:
    """``record_id, capture``: for each record that isn't a response, revisit or resource, those that it belongs to.

    It belongs to one that it names, or that names it, as concurrent, directly or over any number
    of other such records. Direct links take two joins of ids; only links between two
    records that are no captures, if there are any, are followed in rounds, until a round reaches no
    new record. A null id links with nothing; repeated links count once.
    """
    links = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    main, _ = written(records.filter(F.col("type").isin(*MAIN) & F.col("record_id").isNotNull()).select("record_id").distinct(), "anchors")
    is_main = lambda end: main.select(F.col("record_id").alias(end), F.lit(True).alias(f"{end}_main"))
    links, _ = written(links.join(is_main("a"), "a", "left").join(is_main("b"), "b", "left"), "links")
    direct = links.filter("a_main AND b_main IS NULL").selectExpr("b AS record_id", "a AS capture")
    reached = direct.union(links.filter("b_main AND a_main IS NULL").selectExpr("a AS record_id", "b AS capture")).distinct()
    between = links.filter("a_main IS NULL AND b_main IS NULL").select("a", "b")
    if between.isEmpty():
        return reached
    between, _ = written(between.union(between.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "between")
    reached, _ = written(reached, "reached")
    fresh = reached
    while not fresh.isEmpty():
        onward = fresh.join(between, F.col("record_id") == F.col("a")).select(F.col("b").alias("record_id"), "capture").distinct()
        fresh, _ = written(onward.join(reached, ["record_id", "capture"], "left_anti"), "reached")
        reached = reached.union(fresh)
    return reached


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, response, requests, metadata``.

    A capture is a response, revisit or resource with the records that ``captures_of`` finds to belong to
    it. ``response`` is the struct of its own record, payload included; ``requests`` and ``metadata``
    are arrays of such structs, ordered by record id (empty if there are none). Records without
    a capture give no row, captures without an id one row each without others; an empty table gives
    an empty table. Ids and links alone are joined to find captures; payloads move once. ``records`` is read
    more than once: pass a written table.
    """
    main = F.col("type").isin(*MAIN)
    fields = F.struct("record_id", "type", "headers", "payload", "payload_bytes", "payload_digest")
    others = records.filter(~main).join(captures_of(records), "record_id").select("capture", fields.alias("r"))
    grouped = others.groupBy("capture").agg(F.collect_list("r").alias("all"))

    def of(kind: str) -> Column:
        found = F.filter(F.coalesce("all", F.array().cast("array<struct<record_id:string,type:string,headers:map<string,string>,payload:binary,payload_bytes:bigint,payload_digest:string>>")), lambda r: r["type"] == kind)
        return F.array_sort(found, lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))

    # the struct is made above the join, so that fields of it that nothing asks for are not joined
    captures = records.filter(main).select("record_id", "type", "headers", "payload", "payload_bytes", "payload_digest")
    joined = captures.join(grouped, F.col("record_id") == F.col("capture"), "left")
    return joined.select("record_id", fields.alias("response"), of("request").alias("requests"), of("metadata").alias("metadata"))


def fact(field: Column, name: str) -> Column:
    """The value of a line ``name: value`` in a metadata record's block; null if it has none."""
    return F.get(F.regexp_extract_all(field.cast("string"), F.lit(rf"(?m)^{name}: ([^\r\n]+)"), F.lit(1)), F.lit(0))


def pages_through_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per page, from archives that were written and read again: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    The page's id comes from the capture's metadata record. A response's length and digest are those
    that were computed from its bytes when they were read. A revisit is resolved through the record that it names in
    WARC-Refers-To: length, digest and page are that response's. Null html is empty; rows with a
    null or repeated id keep a row each; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    records, _ = written(read_archives(spark, path), "records")
    delete_path(spark, path)
    own = assemble(records).select(
        "record_id",
        F.col("response.type").alias("record_type"),
        F.element_at("response.headers", F.lit("warc-refers-to")).alias("_refers"),
        fact(F.try_element_at("metadata", F.lit(1))["payload"], "pageId").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
    )
    captures, _ = written(own, "captures")
    origin = captures.filter("record_type = 'response'").select(F.col("record_id").alias("_refers"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    again = captures.filter("record_type = 'revisit'").join(origin, "_refers", "left").select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))
    return captures.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(again)
