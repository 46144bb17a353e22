"""WARC archives: written from pages, read back record by record, and assembled to one nested row per capture."""

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm.shared import Scratch, join_hot, small_batches

#: A record ends with two line ends, and the next one starts with its version: what text files of records are split at.
BETWEEN = "\r\n\r\nWARC/"
#: base32's digits are those of base 32 numbers under other names.
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD = "page-id"

RECORD = "file string, record_id string, type string, target_uri string, date string, concurrent_to array<string>, headers map<string,string>, http_start string, http_headers map<string,string>, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, digest_ok boolean, truncated boolean"


def sha1_base32(data: Column) -> Column:
    """The SHA-1 digest in upper-case base32: each 5 hexadecimal digits are 4 of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), *BASE32)


def in_header(value: Column) -> Column:
    """A value without line ends, which would end a header: they are percent-encoded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def pages_with_digests(pages: DataFrame) -> DataFrame:
    """page_id as text, url, payload, its length and digest."""
    payload = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    return pages.select(pages["page_id"].cast("string").alias("page_id"), pages["page_id"].alias("order"), in_header(pages["url"].cast("string")).alias("url"), payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", sha1_base32(F.col("payload")))


def block(*lines: tuple[str, Column | str | None]) -> Column:
    """Header lines; those with null values are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")), F.lit("")) for name, v in lines])


def record(kind: Column | str, ident: Column, lines: list[tuple[str, Column | str]], body: Column) -> Column:
    """One record, without the two line ends behind it."""
    head = F.concat(F.lit(f"{VERSION}\r\n"), block(("WARC-Type", kind), ("WARC-Record-ID", ident), *lines, ("Content-Length", F.octet_length(body).cast("string"))), F.lit("\r\n"))
    return F.concat(head.cast("binary"), body)


def write_archives(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", least_bytes: int = 0, compression: str = "gzip") -> None:
    """Writes a request, a response or revisit, and a metadata record for each row (page_id, url, html) to archives under path.

    Of rows with equal payloads (equal SHA-1 digests) of at least least_bytes bytes, those with the largest page_id are
    responses and the others revisits without a payload; null page_ids come before all others. A null html is an
    empty payload. Spark's writer makes the files, so they can be in any store it knows, and lost tasks leave nothing
    behind. Only pages that share their payload are matched with others: (digest, page_id) of those, never the payloads
    of the rest.
    """
    scratch = Scratch(pages.sparkSession)
    known = pages_with_digests(pages)
    shared = known.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(F.struct("order", "url")).alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.cut(shared.select("payload_digest", "n", F.col("last.order").alias("last"), F.col("last.url").alias("last_url")))
    rows = join_hot(known, shared, "payload_digest", "n", pages.count())
    rows = rows.withColumn("revisit", F.col("n").isNotNull() & ~F.col("order").eqNullSafe(F.col("last")))
    made = lambda kind: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.lit(kind), "page_id", "row").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    rows = rows.withColumn("row", F.monotonically_increasing_id().cast("string")).withColumn("ident", made("response"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", date)]
    host = F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    place = F.regexp_replace("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    place = F.when(F.startswith(place, F.lit("/")), place).otherwise(F.concat(F.lit("/"), F.coalesce(place, F.lit(""))))
    asked = F.concat(F.lit("GET "), place, F.lit(" HTTP/1.1\r\n"), block(("Host", host)), F.lit("\r\n")).cast("binary")
    said = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), block(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("payload_bytes").cast("string"))), F.lit("\r\n")).cast("binary")
    told = block((PAGE_FIELD, F.coalesce(F.col("page_id"), F.lit("")))).cast("binary")
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))
    response = record("response", F.col("ident"), [*common, ("Content-Type", "application/http;msgtype=response"), digest], F.concat(said, F.col("payload")))
    revisit = record("revisit", F.col("ident"), [*common, ("Content-Type", "application/http;msgtype=response"), digest, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", F.col("last_url")), ("WARC-Refers-To-Date", date)], said)
    beside = [("WARC-Concurrent-To", F.col("ident"))]
    request = record("request", made("request"), [*common, *beside, ("Content-Type", "application/http;msgtype=request")], asked)
    metadata = record("metadata", made("metadata"), [*common, *beside, ("Content-Type", "application/warc-fields")], told)
    records = rows.select(F.explode(F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)).alias("value"))
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def fields(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line, and names (in small letters) with values; a line that starts with a blank goes on with the one before."""
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return first, out


class Records:
    """Pieces of files, in order, to records. Lengths decide where a record ends: BETWEEN may also stand in its block."""

    schema = RECORD

    def row(self, file: str, head: bytes, body: bytes, truncated: bool) -> dict:
        _, named = fields(head)
        first = dict(reversed(named))
        start, http, told_fields, payload = None, {}, {}, body
        if first.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            top, _, payload = body.partition(b"\r\n\r\n")
            start, pairs = fields(top)
            http = dict(reversed(pairs))
        elif first.get("content-type", "").lower() == "application/warc-fields":
            told_fields = dict(reversed(fields(b"\r\n" + body)[1]))
        kind = first.get("warc-type")
        told = first.get("warc-payload-digest", "")
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324
        if kind == "revisit":
            digest, ok = told.rpartition(":")[2].upper() or None, None
        else:
            ok = told.rpartition(":")[2].upper() == digest if told.lower().startswith("sha1:") else None
        return {
            "file": file, "record_id": first.get("warc-record-id"), "type": kind, "target_uri": first.get("warc-target-uri"), "date": first.get("warc-date"), "concurrent_to": [v for k, v in named if k == "warc-concurrent-to"],
            "headers": list(first.items()), "http_start": start, "http_headers": list(http.items()), "fields": list(told_fields.items()), "payload": None if kind == "revisit" else payload, "payload_bytes": None if kind == "revisit" else len(payload), "payload_digest": digest, "digest_ok": ok, "truncated": truncated,
        }

    def take(self, file: str, data: bytes, last: bool) -> tuple[dict | None, bytes]:
        """A record off the start of data and what is left, or none if more is needed."""
        head, found, rest = data.partition(b"\r\n\r\n")
        if not found and not last:
            return None, data
        length = next((v for k, v in fields(head)[1] if k == "content-length"), "0")
        length = int(length) if length.isdigit() else 0
        if len(rest) < length and not last:
            return None, data
        return self.row(file, head, rest[:length], len(rest) < length or not found), rest[length:].lstrip(b"\r\n")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("headers", pa.map_(pa.string(), pa.string())), ("http_start", pa.string()), ("http_headers", pa.map_(pa.string(), pa.string())), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("truncated", pa.bool_())])
        at, data = None, b""

        def drain(last: bool) -> Iterator[dict]:
            nonlocal data
            while data.strip(b"\r\n") if last else data:
                row, data = self.take(at[0], data, last)
                if row is None:
                    return
                yield row

        for batch in batches:
            out = []
            for file, start, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "piece")), strict=True):
                if (file, start) != at:
                    if at:
                        out += drain(True)
                    at, data = (file, start), piece if piece.startswith(b"WARC/") else b"WARC/" + piece
                else:  # what is left is a record whose block goes on after BETWEEN
                    data = data + BETWEEN.encode() + piece if data else b"WARC/" + piece
                out += drain(False)
            yield pa.RecordBatch.from_pylist(out, schema)
        if at:
            yield pa.RecordBatch.from_pylist(list(drain(True)), schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path, as Spark's text reader streams them: no task holds more than some records.

    Compressed files (also those with one gzip member for each record) are read from start to end by one task each, so
    records are cut by their lengths alone. Uncompressed ones are split: a record in whose block another one's beginning
    stands is cut off if a split falls between, and then `truncated`. A block that is shorter than its Content-Length
    is truncated too. `digest_ok` tells whether the payload has the digest that its record names (null without one).
    """
    small_batches(spark)
    pieces = spark.read.option("lineSep", BETWEEN).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(Records(), Records.schema)


def capture_of(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(record_id, capture): the response or revisit that a request or metadata record of ids (record_id, type, concurrent_to) goes with, by concurrent-to identifiers in either direction, directly or by a record between."""
    main = ids.where("type in ('response', 'revisit')").select(F.col("record_id").alias("capture")).distinct()
    links = ids.select("record_id", F.explode("concurrent_to").alias("other"))
    links = links.unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    links = links.join(ids.where("type in ('request', 'metadata')").select("record_id").distinct(), "record_id", "left_semi")
    direct = scratch.cut(links.join(main, F.col("other") == F.col("capture")).groupBy("record_id").agg(F.min("capture").alias("capture")))
    onward = links.join(direct, "record_id", "left_anti").join(direct.select(F.col("record_id").alias("other"), "capture"), "other").groupBy("record_id").agg(F.min("capture").alias("capture"))
    return direct.unionByName(onward)


def assemble(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One nested row per capture: capture_id, main (the response or revisit), request and metadata, each as a struct of `keep` columns (all of them if none are named), n_requests and n_metadata.

    Of several requests or metadata records of a capture the one with the least record_id is in its row; the others
    have rows of their own with the capture's id and nothing else, and records without a capture have rows without
    `main`, so no record is lost and no group is gathered. Other kinds of records (warcinfo, resource, conversion) and
    records without an id are left out.
    """
    scratch = Scratch(records.sparkSession)
    keep = keep or records.columns
    kinds = {"main": ("response", "revisit"), "request": ("request",), "metadata": ("metadata",)}
    own = records.where(F.col("type").isin(*(k for v in kinds.values() for k in v)) & F.col("record_id").isNotNull())
    own = scratch.cut(own.select("record_id", "type", "concurrent_to", F.struct(*keep).alias("record")))
    found = capture_of(own.select("record_id", "type", "concurrent_to"), scratch)
    own = own.select("record_id", "type", "record").join(found, "record_id", "left").withColumn("capture_id", F.coalesce("capture", "record_id"))
    of = {name: F.col("type").isin(*v) for name, v in kinds.items()}
    parts = [F.min_by(F.when(c, F.col("record")), F.when(c, F.col("record_id"))).alias(name) for name, c in of.items()]
    counts = [F.count(F.when(of[name], 1)).alias(to) for name, to in (("request", "n_requests"), ("metadata", "n_metadata"))]
    firsts = [F.min(F.when(of[name], F.col("record_id"))).alias(f"first_{name}") for name in ("request", "metadata")]
    out = scratch.cut(own.groupBy("capture_id").agg(*parts, *counts, *firsts))
    crowded = scratch.cut(out.where("n_requests > 1 or n_metadata > 1").select("capture_id", "first_request", "first_metadata", (F.col("n_requests") + F.col("n_metadata")).alias("n")))
    out = out.drop("first_request", "first_metadata")
    if not crowded.limit(1).count():
        return out
    more = join_hot(own.where(~of["main"]), crowded, "capture_id", "n", own.count())
    more = more.where(F.col("n").isNotNull() & (F.col("record_id") != F.when(of["request"], F.col("first_request")).otherwise(F.col("first_metadata"))))
    row = [F.when(c, F.col("record")).alias(name) for name, c in of.items()]
    return out.unionByName(more.select("capture_id", *row, *[F.lit(0).cast("long").alias(c) for c in ("n_requests", "n_metadata")]))


def page_captures(captured: DataFrame) -> DataFrame:
    """For captures of write_archives: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit finds its response by the payload's digest."""
    scratch = Scratch(captured.sparkSession)
    page_id = F.nullif(F.col("metadata.fields")[PAGE_FIELD], F.lit("")).cast("long").alias("page_id")
    rows = scratch.cut(captured.where("main is not null").select(page_id, *[F.col(f"main.{c}").alias(c) for c in ("type", "payload_digest", "payload_bytes")]))
    revisit = F.col("type") == "revisit"
    groups = rows.groupBy("payload_digest").agg(F.max(F.when(~revisit, F.col("page_id"))).alias("answer"), F.max("payload_bytes").alias("bytes"), F.count(F.when(revisit, 1)).alias("n")).where("n > 0")
    out = join_hot(rows, scratch.cut(groups), "payload_digest", "n", rows.count())
    return out.select("page_id", F.when(revisit, F.col("bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.when(revisit, F.col("answer")).alias("refers_to"))


def archived_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes pages as archives (to path, or to the shared folder), reads them back and gives one row per page.

    Null html is an empty payload, a null url has no target, null page_ids stay null; rows repeated with their page_id
    are all of the same record type; an empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    path = path or f"{scratch.dir}/archives"
    write_archives(pages, path, least_bytes=least_bytes)
    records = read_records(pages.sparkSession, path)
    return page_captures(assemble(records, ["type", "payload_bytes", "payload_digest", "fields"]))
