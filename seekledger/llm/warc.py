"""WARC archives: writing, reading back, and reassembly of segmented records.

``write_archives`` frames each payload as an HTTP response in chunked transfer coding, cuts blocks
over ``segment_bytes`` into a first record and continuation records, and writes gzip archives with
Spark's text writer (a record is one "line": all of it but its last line feed). ``read_archives``
streams each archive line by line through one task, whatever its size, and gives one row per record.
``reassemble`` groups continuation records by their origin, orders them by segment number, checks
that numbers are complete and that the total length agrees, and ``decode`` takes the chunked framing
off. Unsegmented records move through no shuffle. ``read_measured`` does all of this and parses each
archive once: unsegmented records are decoded where they are read, only blocks of segments are written.

Cases: null payloads are written as empty ones; an empty table gives an empty folder and no rows;
payloads may hold any bytes, record delimiters included, as only lengths end a record; a record
that is cut off, a missing or repeated segment and a wrong total give ``complete = false``;
extra columns are ignored; each row is a record with a name of its own, also where ids repeat or are
null: the id stands in a header field beside the name, and revisits refer to one record by its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.llm.scratch import written

#: Format names (fixed by the format).
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def _bytes(text: str | Column) -> Column:
    return F.encode(F.lit(text) if isinstance(text, str) else text, "UTF-8")


def _piece(data: Column, start: Column, length: int) -> Column:
    return F.substring(data, start, F.lit(length))


def chunked(payload: Column, chunk_bytes: int) -> Column:
    """The payload in chunked transfer coding: hex length, chunk, and a closing empty chunk."""
    starts = F.when(
        F.octet_length(payload) > 0, F.sequence(F.lit(1), F.octet_length(payload), F.lit(chunk_bytes))
    ).otherwise(F.array().cast("array<int>"))

    def frame(start: Column) -> Column:
        chunk = _piece(payload, start, chunk_bytes)
        return F.concat(_bytes(F.lower(F.hex(F.octet_length(chunk)))), _bytes(_CRLF), chunk, _bytes(_CRLF))

    body = F.aggregate(F.transform(starts, frame), _bytes(""), lambda a, x: F.concat(a, x))
    return F.concat(body, _bytes("0" + _CRLF + _CRLF))


def file_rows() -> Column:
    """A unique ``row`` of a table read from files: its file and its place in it."""
    return F.concat(F.sha1(F.col("_metadata.file_path").cast("binary")), F.lit("-"), F.col("_metadata.row_index"))


def mark_revisits(payloads: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``id, url, payload`` -> ``+ payload_digest, record_type, refers_to, name, refers_name``. Among
    equal payloads of at least ``min_bytes`` the largest id is the response and the others refer to it.

    A column ``row``, unique and the same whenever the rows are read, tells rows of one id apart; without
    one the rows are numbered and written first. A record is named by its id, and by its row too where
    the id is null or repeated.
    """
    if "row" not in payloads.columns:
        row = F.monotonically_increasing_id().cast("string").alias("row")
        payloads = written(payloads.select("id", "url", "payload", row), "payloads")
    data = payloads.withColumn("payload", F.coalesce(F.col("payload"), _bytes("")))
    data = data.withColumn("payload_digest", F.sha1("payload"))
    seen = written(data.select("row", "id", "payload_digest", F.octet_length("payload").alias("_size")), "pages_seen")
    again = seen.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1")
    again = again.select("id", F.lit(True).alias("_again"))
    large = seen.filter(F.col("_size") >= min_bytes)
    chosen = large.groupBy("payload_digest", "_size").agg(F.max(F.struct("id", "row")).alias("_chosen"), F.count("*").alias("_n"))
    # most payloads are single: only repeated ones meet their rows again
    repeated = chosen.filter("_n > 1 AND _chosen.id IS NOT NULL").select(
        "payload_digest", "_size", F.col("_chosen.id").alias("_id"), F.col("_chosen.row").alias("_row")
    )
    repeated = repeated.join(again.select(F.col("id").alias("_id"), F.col("_again").alias("_many")), "_id", "left")
    revisit = F.col("_id").isNotNull() & (F.col("_id") != F.col("id"))
    marks = seen.join(repeated, ["payload_digest", "_size"], "left").join(again, "id", "left").select(
        "row", "_again",
        F.when(revisit, F.col("_id")).alias("refers_to"),
        F.when(revisit, _name(F.col("_id"), F.col("_row"), F.col("_many"))).alias("refers_name"),
    )
    # payloads meet the few marked rows by their own unique row: no group of copies comes together
    marked = data.join(marks.filter("_again OR refers_to IS NOT NULL"), "row", "left")
    return marked.select(
        "id", "url", "payload", "payload_digest",
        F.when(F.col("refers_to").isNotNull(), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "refers_to", _name(F.col("id"), F.col("row"), F.col("_again")).alias("name"), "refers_name",
    )


def _name(id_: Column, row: Column, repeated: Column) -> Column:
    one = F.when(id_.isNotNull() & ~F.coalesce(repeated, F.lit(False)), F.lit("")).otherwise(F.concat(F.lit(";row="), row))
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), one, F.lit(">"))


def write_archives(
    marked: DataFrame,
    path: str,
    date: str = "2020-01-01T00:00:00Z",
    segment_bytes: int = 32_768,
    chunk_bytes: int = 8_192,
    records_per_file: int = 100_000,
) -> None:
    """One response or revisit record per row of ``mark_revisits``, as gzip archives in ``path``."""
    http = "HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, _bytes(http + _CRLF)).otherwise(
        F.concat(_bytes(http + "Transfer-Encoding: chunked" + _CRLF + _CRLF), chunked(F.col("payload"), chunk_bytes))
    )
    rows = marked.select("id", "url", "payload_digest", "record_type", "refers_to", "name", "refers_name", block.alias("block"))
    total = F.octet_length("block")
    segments = rows.select(
        "*", total.alias("total"),
        F.posexplode(F.sequence(F.lit(1), F.greatest(total, F.lit(1)), F.lit(segment_bytes))).alias("k", "start"),
    ).withColumn("part", _piece(F.col("block"), F.col("start"), segment_bytes))
    first, many = F.col("k") == 0, F.col("total") > segment_bytes
    last = F.col("start") + segment_bytes > F.col("total")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit(_CRLF))
    when = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    own = F.when(first, F.col("name")).otherwise(
        F.concat(F.regexp_replace("name", ">$", ":"), (F.col("k") + 1).cast("string"), F.lit(">"))
    )
    head = F.concat(
        F.lit(VERSION + _CRLF),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")),
        when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        when(first & F.col("id").isNotNull(), line("WARC-Page-ID", F.col("id"))),
        when(first & is_revisit, F.concat(F.lit("WARC-Profile: " + PROFILE + _CRLF), line("WARC-Refers-To", F.coalesce("refers_name", F.lit(""))))),
        when(first & F.col("refers_to").isNotNull(), line("WARC-Refers-To-Page-ID", F.col("refers_to"))),
        when(many, line("WARC-Segment-Number", F.col("k") + 1)),
        when(many & ~first, line("WARC-Segment-Origin-ID", F.col("name"))),
        when(many & last, line("WARC-Segment-Total-Length", F.col("total"))),
        F.lit("Content-Type: application/http; msgtype=response" + _CRLF),
        line("Content-Length", F.octet_length("part")),
        F.lit(_CRLF),
    )
    record = F.concat(_bytes(head), F.col("part"), _bytes(_CRLF + "\r"))
    segments.select(record.cast("string").alias("value")).write.option("compression", "gzip").option(
        "lineSep", "\n"
    ).option("maxRecordsPerFile", records_per_file).text(path)


RECORD = (
    "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
    "origin_id string, segment int, total_length long, page_id string, refers_page string, complete boolean, block binary"
)
_FIELDS = (
    "warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to",
    "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length", "warc-page-id", "warc-refers-to-page-id",
)
_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "origin_id")]
    + [("segment", pa.int32()), ("total_length", pa.int64()), ("page_id", pa.string()), ("refers_page", pa.string())]
    + [("complete", pa.bool_()), ("block", pa.binary())]
)
_START = re.compile(rb"WARC/1\.\d\r?\n")
_BATCH_BYTES = 8 << 20


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _take(data: bytes, at: int, final: bool) -> tuple[tuple, int] | None:
    """The record that starts at or after ``at`` and where it ends; None if more bytes are needed."""
    start = _START.search(data, at)
    if start is None:
        return None
    end = data.find(b"\r\n\r\n", start.start())
    if end < 0:
        return None
    head = dict(
        (key.strip().lower(), value.strip())
        for key, _, value in (x.partition(":") for x in data[start.end() : end].decode("utf-8", "replace").split("\r\n"))
    )
    length = _number(head.get("content-length")) or 0
    body, stop = end + 4, end + 4 + length
    if stop > len(data) and not final:
        return None
    fields = [head.get(name) for name in _FIELDS]
    fields[6], fields[7] = _number(fields[6]), _number(fields[7])
    return (*fields, stop <= len(data), data[body:stop]), min(stop, len(data))


def _parse(batches: Iterator[pa.RecordBatch], schema: pa.Schema = _SCHEMA, finish=None) -> Iterator[pa.RecordBatch]:
    """``finish`` makes a row of ``schema`` of each record; without it the record is the row."""
    out: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[] for _ in schema]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rest, file = b"", None

    def records(data: bytes, final: bool) -> bytes:
        nonlocal size
        at = 0
        while (found := _take(data, at, final)) is not None:
            record, at = found
            out.append(finish(record) if finish else record)
            size += len(record[-1])
        return data[at:]

    pending: list[bytes] = []
    held = 0
    for batch in batches:
        files = batch.column(1).to_numpy(zero_copy_only=False)
        lines = batch.column(0).to_pylist()
        bounds = [0, *(i + 1 for i in range(len(files) - 1) if files[i] != files[i + 1]), len(files)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            if files[a] != file:
                records(rest + b"".join(pending), True)
                rest, pending, held, file = b"", [], 0, files[a]
            text = b"\n".join(lines[a:b]) + b"\n"
            pending.append(text)
            held += len(text)
            if held >= max(1 << 20, len(rest)):  # a long record is joined a few times only
                rest = records(rest + b"".join(pending), False)
                pending, held = [], 0
        if size >= _BATCH_BYTES:
            yield made()
            out.clear()
            size = 0
    records(rest + b"".join(pending), True)
    yield made()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.xxhash64(F.input_file_name()).alias("file"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives in ``path`` (columns: ``RECORD``). gzip is not
    splittable, so an archive passes through one task in order and only the record at hand is held."""
    return _lines(spark, path).mapInArrow(_parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """First records with their whole block; ``complete`` is false where segments are missing or
    the total length differs."""
    whole = records.filter("segment IS NULL").drop("origin_id", "segment", "total_length")
    return whole.unionByName(_joined(records.filter("segment IS NOT NULL")).select(whole.columns))


def _joined(segments: DataFrame) -> DataFrame:
    parts = segments.withColumn("origin", F.coalesce("origin_id", "record_id"))
    head = lambda name: F.max(F.when(F.col("segment") == 1, F.col(name))).alias(name)
    pieces = F.array_sort(F.collect_list(F.struct("segment", "block")))
    joined = parts.groupBy("origin").agg(
        *(head(n) for n in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "page_id", "refers_page")),
        F.max("total_length").alias("total"),
        F.min("complete").alias("all_complete"),
        pieces.alias("pieces"),
    )
    block = F.aggregate("pieces.block", _bytes(""), lambda a, x: F.concat(a, x))
    numbers = F.sequence(F.lit(1), F.size("pieces"))
    return joined.withColumn("block", block).withColumn(
        "complete",
        F.coalesce(
            F.col("all_complete") & (F.col("pieces.segment") == numbers) & (F.octet_length("block") == F.col("total")),
            F.lit(False),
        ),
    )


def _decode(block: bytes | None) -> tuple[bytes, bool]:
    """Payload of an HTTP message, and whether its framing was sound."""
    head, blank, body = (block or b"").partition(b"\r\n\r\n")
    if not blank:
        return b"", False
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body, True
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9A-Fa-f]+)\s*(?:;.*)?", body[at:end]) if end >= 0 else None
        if size is None:
            return b"".join(out), False
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out), True
        chunk = body[end + 2 : end + 2 + n]
        out.append(chunk)
        at = end + 2 + n
        if len(chunk) < n or body[at : at + 2] != b"\r\n":
            return b"".join(out), False
        at += 2


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [_decode(x) for x in batch.column("block").to_pylist()]
        names = [n for n in batch.schema.names if n != "block"]
        yield pa.record_batch(
            [*(batch.column(n) for n in names), pa.array([p for p, _ in pairs], pa.binary()), pa.array([o for _, o in pairs], pa.bool_())],
            names=[*names, "payload", "framed"],
        )


def decode(records: DataFrame) -> DataFrame:
    """``block`` -> ``payload`` (chunked framing removed) and ``framed`` (the framing was sound)."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in records.schema if f.name != "block"]
    return records.mapInArrow(_decode_batches, ", ".join([*kept, "payload binary", "framed boolean"]))


def _parse_and_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment = _SCHEMA.get_field_index("segment")
    schema = _SCHEMA.append(pa.field("payload", pa.binary())).append(pa.field("framed", pa.bool_()))

    def finish(record: tuple) -> tuple:
        return (*record, None, None) if record[segment] is not None else (*record[:-1], None, *_decode(record[-1]))

    return _parse(batches, schema, finish)


def _measured(decoded: DataFrame) -> DataFrame:
    size = F.octet_length("payload").cast("long")
    return decoded.select("*", size.alias("payload_bytes"), F.sha1("payload").alias("digest")).drop("payload")


def read_measured(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in ``path``, reassembled and decoded, with ``payload_bytes`` and ``digest`` in
    place of the payload. What is written on the way are the records without payloads, and the blocks of segments."""
    read = _lines(spark, path).mapInArrow(_parse_and_decode, f"{RECORD}, payload binary, framed boolean")
    records = written(_measured(read), "records")
    whole = records.filter("segment IS NULL").drop("origin_id", "segment", "total_length", "block")
    joined = _joined(records.filter("segment IS NOT NULL").drop("framed", "payload_bytes", "digest"))
    kept = joined.select(*(c for c in whole.columns if c not in ("framed", "payload_bytes", "digest")), "block")
    return whole.unionByName(written(_measured(decode(kept)), "reassembled"))


def resolve(decoded: DataFrame) -> DataFrame:
    """``+ payload_bytes, digest``: of the payload, or of the response that a revisit refers to. Of records with a
    payload, or of those of ``read_measured``."""
    responses = _measured(decoded) if "payload" in decoded.columns else decoded
    own = responses.filter("refers_to IS NULL OR record_type != 'revisit'")
    revisits = responses.filter("refers_to IS NOT NULL AND record_type = 'revisit'").drop("payload_bytes", "digest")
    # a record that is there twice (an archive read twice) counts once, by its sound copy
    best = F.max(F.struct((F.col("complete") & F.col("framed")).alias("sound"), "payload_bytes", "digest")).alias("t")
    target = responses.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(best)
    target = target.select("refers_to", "t.payload_bytes", "t.digest")
    return own.unionByName(revisits.join(target, "refers_to", "left").select(own.columns))
