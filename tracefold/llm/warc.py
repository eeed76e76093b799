"""WARC archives: writing, reading, and revisit resolution.

``write_archive`` writes records as gzip WARC files, ``read_archive`` streams them back and
checks every payload against its digest. ``deduplicate`` keeps one response of equal payloads
and turns the others into revisits: the headers alone are shuffled by payload digest, each
group names its original, and records and decisions meet by record id, which no group makes
hot (payloads are shuffled for that only if there are more than ``FEW_REVISITS`` revisits).
Revisit records of the given archive are joined to their originals first and follow them when
these become revisits themselves. The new archive has fresh record ids, dates and digests.

A file is read in order by one task and never held: gzip files are not split, so the reader
sees their pieces in turn and needs the memory of one record. Only Spark reads and writes
the files, so they may lie in any store it knows.

Edge cases: a null payload is empty; equal empty payloads are equal payloads. A null or blank
URL becomes ``about:blank``, line ends and spaces in a URL are percent-encoded. Records with a
null page id are responses of last choice. Repeated rows are records of their own: one stays a
response, the others revisit it. A revisit whose original is not in the archive stays a revisit
with the reference it had. A cut file, or a payload that its digest does not fit, stops the job
with the record's name. An empty table gives an empty archive. Other columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.operators.ordering import salted_join
from tracefold.sources.sinks import new_path, stored

VERSION = b"WARC/1.1"
#: What ends a header and, once more, a record; files are read in pieces between these.
CUT = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-31T00:00:00Z"
#: Records of one file at most; a file is one task when read.
FILE_RECORDS = 20_000
#: Revisits (about 300 bytes each) up to which they are broadcast to the payloads.
FEW_REVISITS = 50_000
#: Records that a task hands to Spark at once.
HANDED_ON = 256

RECORD = ("record_id string, uri string, date string, page_id long, record_type string, "
          "refers_id string, refers_uri string, refers_date string, payload binary, "
          "payload_digest string")
HEADS = ("record_id string, uri string, date string, page_id long, record_type string, "
         "refers_id string, refers_uri string, refers_date string, payload_bytes long, "
         "payload_digest string, sha256 string, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(row: dict) -> bytes:
    """One WARC record without its last line end. A response holds its payload, a revisit the
    HTTP header alone."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    revisit = row["record_type"] == "revisit"
    if revisit:
        block = http + b"\r\n"
        named = row["payload_digest"]
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
        named = digest(payload)
    head = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Target-URI": row["uri"], "WARC-Date": row["date"],
        "WARC-Payload-Digest": f"sha1:{named}", "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if pd.notna(row["page_id"]):
        head["Page-Id"] = str(int(row["page_id"]))
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{row['refers_id']}>",
                 "WARC-Refers-To-Target-URI": row["refers_uri"],
                 "WARC-Refers-To-Date": row["refers_date"]}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items() if pd.notna(v))]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n"


def write_archive(records: DataFrame, path: str, file_records: int = FILE_RECORDS,
                  level: str = "BEST_SPEED") -> None:
    """Write ``records`` (columns of RECORD) as gzip WARC files under ``path``; ``level`` is
    Hadoop's name of a zlib level."""
    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names = list(part.columns)
            for at in C.chunks(len(part), HANDED_ON):
                rows = part.iloc[at].itertuples(index=False)
                yield pd.DataFrame({"record": [_record(dict(zip(names, r, strict=True)))
                                               for r in rows]})

    # the bytes go into the file as they are: the string column is never decoded
    records.mapInPandas(made, "record binary").select(
        F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option(
        "compression", "gzip").option("zlib.compress.level", level).option(
        "maxRecordsPerFile", file_records).text(path)


class _Reader:
    """Records out of the pieces of files, as their bytes come in."""

    def __init__(self, keep_payload: bool) -> None:
        self.keep_payload = keep_payload
        self.file: int | None = None
        self.pieces: list[bytes] = []
        self.size = 0
        self.head: dict[str, str] = {}
        self.block_at = self.need = -1

    def feed(self, file: int, piece: bytes) -> Iterator[dict]:
        if file != self.file:
            self.done()
            self.file = file
        self.pieces += [piece, CUT]
        self.size += len(piece) + len(CUT)
        while self.size:
            if self.need < 0:
                if not self.begin():
                    return
            if self.size < self.need:
                return
            data = b"".join(self.pieces)
            whole, rest = data[:self.need], data[self.need:]
            if not whole.endswith(CUT):
                raise ValueError(f"record {self.head.get('warc-record-id')} is longer than its "
                                 "Content-Length")
            self.pieces, self.size, self.need = [rest] if rest else [], len(rest), -1
            row = self.record(self.head, whole[self.block_at:-len(CUT)])
            if row is not None:
                yield row

    def begin(self) -> bool:
        """Read the next record's header, if its bytes are there."""
        data = b"".join(self.pieces).lstrip(b"\r\n")
        self.pieces, self.size = [data], len(data)
        at = data.find(CUT)
        if at < 0:
            return False
        version, *lines = data[:at].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {version[:80]!r}")
        parted = (line.partition(":") for line in lines)
        self.head = {name.strip().lower(): value.strip() for name, _, value in parted}
        self.block_at = at + len(CUT)
        self.need = self.block_at + int(self.head["content-length"]) + len(CUT)
        return True

    def record(self, head: dict[str, str], block: bytes) -> dict | None:
        kind = head.get("warc-type")
        if kind not in ("response", "revisit"):
            return None  # warcinfo and the like carry no payload to resolve
        _, parted, payload = block.partition(b"\r\n\r\n")
        if not parted and not block.startswith(b"HTTP/"):
            payload = block
        named = head.get("warc-payload-digest", "").removeprefix("sha1:")
        row = {
            "record_id": head["warc-record-id"].strip("<>"), "uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"), "page_id": head.get("page-id"), "record_type": kind,
            "refers_id": head.get("warc-refers-to", "").strip("<>") or None,
            "refers_uri": head.get("warc-refers-to-target-uri"),
            "refers_date": head.get("warc-refers-to-date"), "payload_bytes": None,
            "payload_digest": named or None, "sha256": None, "payload": None}
        row["page_id"] = None if row["page_id"] is None else int(row["page_id"])
        if kind == "response":
            found = digest(payload)
            if named and named != found:
                raise ValueError(f"record {row['record_id']} does not fit its digest")
            row |= {"payload_bytes": len(payload), "payload_digest": found,
                    "sha256": hashlib.sha256(payload).hexdigest()}
            if self.keep_payload:
                row["payload"] = payload
        return row

    def done(self) -> None:
        if b"".join(self.pieces).strip(b"\r\n"):
            raise ValueError(f"record {self.head.get('warc-record-id')}, the last of its file, is "
                             "cut short")


def read_archive(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Response and revisit records of the gzip WARC files under ``path`` (columns of HEADS)."""
    names = [c.split()[0] for c in HEADS.split(", ")]

    def table(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(
            {"page_id": "Int64", "payload_bytes": "Int64"})

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, rows = _Reader(keep_payload), []
        for part in parts:
            for file, piece in zip(part["file"], part["piece"], strict=True):
                rows.extend(reader.feed(file, piece))
                if len(rows) >= HANDED_ON:
                    yield table(rows)
                    rows = []
        reader.done()
        yield table(rows)

    try:
        pieces = spark.read.option("lineSep", CUT.decode()).text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HEADS)
    return pieces.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast(
        "binary").alias("piece")).mapInPandas(parsed, HEADS)


def fresh_id(old: Column) -> Column:
    """A record id that follows from the old one, so that repeated jobs write the same."""
    hexed = F.sha2(F.concat(F.lit("deduplicated:"), old), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(
        F.substring(hexed, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_id -> original (record_id, uri, date, page_id, digest) for every record that
    revisits another; ``heads`` is a stored table of headers.

    Of the responses with equal payloads of ``least_bytes`` or more, the one with the largest
    page id is the original (then the smallest record id); equal means by length, SHA-1 and
    SHA-256.
    """
    answers = heads.where("record_type = 'response'")
    given = salted_join(
        heads.where("record_type = 'revisit'").select("record_id", "refers_id"),
        answers.select(F.col("record_id").alias("refers_id"), "sha256", "payload_bytes"),
        ["refers_id"], F.col("record_id"), "inner").select(
        "record_id", "sha256", "payload_bytes", F.lit(True).alias("given"))
    every = stored(answers.select("record_id", "sha256", "payload_bytes", F.lit(False).alias(
        "given")).unionByName(given), "payload-heads")
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id")
    # max_by would leave ties open: among the largest page ids the smallest record id decides
    best = answers.groupBy("sha256", "payload_bytes").agg(F.max(rank).alias("best"), F.count(
        "*").alias("n")).where(f"n > 1 AND payload_bytes >= {int(least_bytes)}")
    tied = salted_join(stored(answers.select("sha256", "payload_bytes", "record_id", "uri", "date",
                                             "page_id", "payload_digest"), "answers"),
                       best, ["sha256", "payload_bytes"], F.col("record_id"), "inner").where(
        F.col("page_id").eqNullSafe(F.col("best.page_id")))
    shared = tied.groupBy("sha256", "payload_bytes").agg(F.min(F.struct(
        "record_id", "uri", "date", "page_id", "payload_digest")).alias("original"))
    # a payload that stands once can still be revisited by records given as revisits
    single = given.where(F.col("given")).select("sha256", "payload_bytes").distinct().join(
        answers, ["sha256", "payload_bytes"]).groupBy("sha256", "payload_bytes").agg(
        F.count("*").alias("n"), F.min(F.struct(
            "record_id", "uri", "date", "page_id", "payload_digest")).alias("original")).where(
        f"n = 1 OR payload_bytes < {int(least_bytes)}").drop("n")
    originals = stored(shared.unionByName(single), "originals")
    found = salted_join(every, originals, ["sha256", "payload_bytes"], F.col("record_id"),
                        "inner")
    return found.where((F.col("record_id") != F.col("original.record_id")) & (
        F.col("given") | (F.col("payload_bytes") >= least_bytes))).select("record_id", "original")


def deduplicate(spark: SparkSession, source: str, target: str, date: str = DATE,
                least_bytes: int = 0, few_revisits: int = FEW_REVISITS) -> None:
    """Write the archive at ``source`` to ``target`` with equal payloads kept once."""
    heads = stored(read_archive(spark, source).drop("payload"), "warc-heads")
    decided = stored(revisits(heads, least_bytes), "revisits")
    # few revisits go to the records; many are met by record id, which moves the payloads once
    few = decided.count() <= few_revisits
    records = read_archive(spark, source, keep_payload=True).join(
        F.broadcast(decided) if few else decided.hint("shuffle_hash"), "record_id", "left")
    original = F.col("original")
    there = original.isNotNull()
    lost = F.col("record_type") == "revisit"  # refers to a record of some other archive
    write_archive(records.select(
        fresh_id(F.col("record_id")).alias("record_id"), "uri", F.lit(date).alias("date"),
        "page_id", F.when(there | lost, "revisit").otherwise("response").alias("record_type"),
        F.when(there, fresh_id(original["record_id"])).otherwise(F.col("refers_id")).alias(
            "refers_id"),
        F.when(there, original["uri"]).otherwise(F.col("refers_uri")).alias("refers_uri"),
        F.when(there, F.lit(date)).otherwise(F.col("refers_date")).alias("refers_date"),
        F.when(~there, F.col("payload")).alias("payload"),
        F.coalesce(original["payload_digest"], "payload_digest").alias("payload_digest"),
    ), target)


def resolved(heads: DataFrame) -> DataFrame:
    """``heads`` (stored) with length, digest and page id (``refers_to``) of the original where
    a revisit's original is in the archive."""
    answers = heads.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("whole_bytes"),
        F.col("page_id").alias("refers_to"))
    return salted_join(heads, answers, ["refers_id"], F.col("record_id")).withColumn(
        "payload_bytes", F.coalesce("payload_bytes", "whole_bytes")).drop("whole_bytes")


def page_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record (columns of RECORD) per row of ``pages`` (page_id, url, html)."""
    def named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(record_id=[
                uuid.uuid5(uuid.NAMESPACE_URL, f"{row}:{uri}").urn
                for row, uri in zip(part["row"], part["uri"], strict=True)]).drop(columns="row")

    url = F.coalesce("url", F.lit(""))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        url, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"),
        F.when(F.trim(url) == "", "about:blank").otherwise(safe).alias("uri"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return rows.mapInPandas(
        named, "page_id long, uri string, payload binary, record_id string").select(
        "record_id", "uri", F.lit(date).alias("date"), "page_id", F.lit("response").alias(
            "record_type"),
        *(F.lit(None).cast("string").alias(c) for c in (
            "refers_id", "refers_uri", "refers_date")),
        "payload", F.lit(None).cast("string").alias("payload_digest"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as an archive, deduplicate it into another, read that one back."""
    spark = pages.sparkSession
    first, second = new_path(spark, "warc"), new_path(spark, "warc-deduplicated")
    write_archive(page_records(pages), first)
    deduplicate(spark, first, second, least_bytes=least_bytes)
    return resolved(stored(read_archive(spark, second).drop("payload"), "warc-read"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = " || ".join(f"substr('{_BASE32}', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))


@C.query("op12_warc", f"""WITH p AS (SELECT page_id, row_number() OVER () AS r,
    strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
  o AS (SELECT *, first_value(r) OVER g AS top, first_value(page_id) OVER g AS top_page FROM p
    WINDOW g AS (PARTITION BY h, payload_bytes ORDER BY page_id DESC NULLS LAST, r)),
  parts AS (SELECT h, i, CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) AS v
    FROM (SELECT DISTINCT h FROM p), range(8) t(i)),
  d AS (SELECT h, string_agg({_FIVE}, '' ORDER BY i) AS payload_digest FROM parts GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN r = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r <> top THEN top_page END AS refers_to FROM o JOIN d USING (h)""")
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(C.table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
