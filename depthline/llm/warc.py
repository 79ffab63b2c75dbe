"""WARC archives: writing with revisit records, reading back, and a merged capture index.

Archives are plain WARC 1.1 files, written by Spark's text sink: a record is one
value and the two line ends that close a record are the separator of the sink.
Reading goes by Content-Length, so payloads may hold any bytes. Every archive
gives a run of captures sorted by URL key and time; runs are merged range by
range with a tree of losers, which yields one ordered capture history.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depthline.session import fresh_path, materialise

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
_FIRST_CAPTURE = 1_700_000_000


@dataclass(frozen=True)
class Rule:
    """`least_bytes`: payloads below it never become revisits. `per_file`: records of one archive.

    Digests of repeated payloads are broadcast up to `broadcast_rows` of them
    (some 80 bytes each), else joined by a shuffle that moves the payloads too.
    """

    least_bytes: int = 0
    per_file: int = 500
    broadcast_rows: int = 200_000


def digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a payload."""
    hex_ = F.sha1(payload.cast("binary"))
    letters = []
    for g in range(4):
        five_bytes = F.conv(F.substring(hex_, g * 10 + 1, 10), 16, 10).cast("bigint")
        for k in range(8):
            place = F.shiftright(five_bytes, 35 - 5 * k).bitwiseAND(31)
            letters.append(F.substring(F.lit(_BASE32), place + 1, F.lit(1)))
    return F.concat(*letters)


def plan_records(pages: DataFrame, rule: Rule) -> DataFrame:
    """Each page with its payload, digest and the page that holds an equal payload.

    Pages with equal payloads share a response, the one with the largest
    page_id; only digests and ids are shuffled to find it.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\x00-\\x20\\x7f]", "").alias("url"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
    )
    kept = (
        rows.filter(F.col("payload_bytes") >= rule.least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    kept = materialise(kept, "holders")
    if kept.count() <= rule.broadcast_rows:
        kept = F.broadcast(kept)
    both = rows.join(kept, ["payload_digest", "payload_bytes"], "left")
    return both.withColumn("refers_to", F.when(F.col("holder") != F.col("page_id"), F.col("holder"))).drop("holder")


def _headers(*lines: tuple[str, Column]) -> Column:
    return F.concat(*[x for name, value in lines for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))])


def _uuid(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), page_id.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(planned: DataFrame) -> Column:
    """One WARC record as text, without the two line ends that close it.

    Pages carry no time; a capture's time is a fixed first second plus page_id.
    A revisit keeps the HTTP header of its capture, with the length of the full
    payload, and no payload.
    """
    page, refers = F.col("page_id"), F.col("refers_to")
    date = F.date_format(
        F.to_utc_timestamp(F.timestamp_seconds(F.lit(_FIRST_CAPTURE) + F.coalesce(page, F.lit(0))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"),
        _headers(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    body = F.when(refers.isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    revisit = _headers(
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", _uuid(refers)),
        ("X-Refers-To-Page", refers.cast("string")),
    )
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _headers(
            ("WARC-Type", F.when(refers.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
            ("WARC-Record-ID", _uuid(F.coalesce(page, F.lit(-1)))),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("X-Page", F.coalesce(page.cast("string"), F.lit(""))),
        ),
        F.when(refers.isNull(), F.lit("")).otherwise(revisit),
        _headers(
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(body).cast("string")),
        ),
        F.lit("\r\n"),
        body,
    )


def write(pages: DataFrame, path: str, rule: Rule | None = None) -> None:
    """Write one record per row of `pages(page_id, url, html)` under `path`, and never twice the same payload.

    A null html is an empty payload, a null url an empty target; control
    characters and spaces are taken out of targets. Rows that repeat a page_id
    are written each. A null page_id is written without a page header and never
    a response that others refer to, unless every equal payload is such a row.
    """
    rule = rule or Rule()
    planned = plan_records(pages, rule)
    planned.select(record(planned).alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", rule.per_file).text(path)


def url_key(url: str) -> str:
    """Sortable key of a URL: host labels from the last to the first, then path and query; lower case."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    place = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{place}){parts.path or '/'}{'?' + query if query else ''}".lower()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        at = start + int(headers["Content-Length"])
        yield headers, data[start:at]
        at += 4


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_CAPTURE = "run long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A capture of each record below `path`; those of an archive are one run, sorted by URL key, time and page.

    The payload of a response is measured and digested anew, and must agree
    with the digest in its header. Whole archives are read at once, so `Rule.per_file` bounds the memory.
    """
    names = [x.split(" ")[0] for x in _CAPTURE.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number = int.from_bytes(hashlib.md5(batch["path"][k].as_py().encode()).digest()[:7])
                rows = []
                for headers, block in parse(batch["content"][k].as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    if headers["WARC-Type"] == "response":
                        if payload_digest(payload) != named or len(payload) != length:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                    page = int(headers["X-Page"]) if headers["X-Page"].strip() else None
                    refers = headers.get("X-Refers-To-Page")
                    key = url_key(headers.get("WARC-Target-URI", ""))
                    rows.append((number, key, headers["WARC-Date"], page, length, named, headers["WARC-Type"], int(refers) if refers else None))
                rows.sort(key=_place)
                yield pa.RecordBatch.from_pydict(
                    dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}, schema=_ARROW
                )

    return files.mapInArrow(run, _CAPTURE)


_ARROW = pa.schema([(n.split(" ")[0], pa.int64() if n.endswith("long") else pa.string()) for n in _CAPTURE.split(", ")])


def _place(row: tuple) -> tuple:
    """Order of captures: URL key, time, page (none first), run."""
    return (row[1], row[2], -1 if row[3] is None else row[3], row[0])


class LoserTree:
    """K-way merge of sorted runs: inner nodes hold the loser of their match, the winner leaves at the top."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs] or [None]
        self.keys = [None if h is None else _place(h) for h in self.heads]
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._rise(leaf)

    def _beats(self, x: int, y: int) -> bool:
        if self.keys[x] is None or self.keys[y] is None:
            return self.keys[y] is None and (self.keys[x] is not None or x < y)
        return (self.keys[x], x) < (self.keys[y], y)

    def _rise(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:  # still filling: wait here for the other side
                self.loser[node] = winner
                return
            if self._beats(self.loser[node], winner):
                winner, self.loser[node] = self.loser[node], winner
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[top := self.loser[0]] is not None:
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self.keys[top] = None if self.heads[top] is None else _place(self.heads[top])
            self._rise(top)


def histories(captures: DataFrame) -> DataFrame:
    """Captures in one global order of URL key, time and page, with `capture_range` and `capture_no`.

    Rows go to ranges of that order, so that a URL with many captures is split
    over ranges; each range merges its part of the runs. `capture_range` and then
    `capture_no` number the order.
    """
    placed = captures.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("run")
    part = placed.withColumn("capture_range", F.spark_partition_id().cast("long"))
    names = _ARROW.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple]] = {}
        number = 0
        for batch in batches:
            for row in zip(*(batch[n].to_pylist() for n in names)):
                runs.setdefault(row[0], []).append(row)
            number = batch["capture_range"][0].as_py() if batch.num_rows else number
        for r in runs.values():
            r.sort(key=_place)  # rows of a run may come by several shuffle files
        merged = list(LoserTree([iter(r) for r in runs.values()]))
        for i in range(0, len(merged), 10_000):
            some = merged[i : i + 10_000]
            columns = [pa.array(c, t) for c, t in zip(zip(*some), _ARROW.types)]
            columns += [pa.array([number] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "capture_range", "capture_no"])

    return part.mapInArrow(run, f"{_CAPTURE}, capture_range long, capture_no long")


def archived(pages: DataFrame, rule: Rule | None = None, path: str | None = None) -> DataFrame:
    """Write `pages` as archives, read them back and give their capture histories.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    captured, capture_range, capture_no. Archives go to `path`, by default a
    fresh one below the shared folder.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, rule)
    captures = materialise(read_runs(spark, path), "captures")  # the ranges are sampled from it, so it must not be parsed twice
    return histories(captures).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_range", "capture_no"
    )
