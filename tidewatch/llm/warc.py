r"""WARC archives: written record by record, read back and assembled to one nested row per capture.

A capture is a request, a response or revisit, and a metadata record; request and metadata name the response's record id in
WARC-Concurrent-To. Records end with CR LF CR LF, which is what Spark's text writer puts after each, so files are committed by Spark
and appear whole or not at all on any file system it reaches.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import new_path, small_side, stored

CRLF = "\r\n"
#: Payloads shorter than this are stored each time.
REVISIT_BYTES = 100
#: Bytes of an archive file before compression, about: so many pages of mean size.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(kind: Column, record: Column, block: Column, *named: tuple[str, Column], type_: str) -> Column:
    """Header and block of a record; named fields whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record, F.lit(">")), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in named]
    lines += [F.lit(f"Content-Type: {type_}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def _urn(row: Column, part: str) -> Column:
    """urn:uuid of a row's record: a digest, so a task that runs again names its records as before."""
    h = F.md5(F.concat_ws("|", row, F.lit(part)).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def write_warc(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """pages (page_id, url, html) -> WARC files under path: three records a page.

    The payload is html in UTF-8 (null: empty). Of equal payloads of at least `least` bytes, that of the smallest page_id (null last; of
    repeated rows the first by the number that the stored table gives them) is the response and the others are revisits that name it. Line breaks in a url
    become %0D or %0A; a null url is about:blank. A null page_id is left out of the metadata. Very long payloads are whole records; an empty table gives files without
    records; other columns of pages are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("about:blank")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html"))
    rows = rows.withColumn("url", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    # Rows are numbered once, in a stored table: numbers given twice could differ after a lost executor. Payloads are not shuffled after that.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    name = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", F.col("row").cast("string"))
    narrow = rows.select("row", "page_id", "digest", "bytes", F.struct(F.col("page_id").isNull().alias("null"), "page_id", "row", name.alias("name")).alias("who"))
    # Only digests that occur twice take part, and of their pages only numbers and names. They are stored, so that a join too large to broadcast can split a frequent one.
    twice = narrow.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("who").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    again = narrow.join(small_side(stored(twice, "digests")), F.col("digest") == F.col("d")).where(F.col("first.row") != F.col("row")).select(F.col("row").alias("r"), F.col("first.page_id").alias("first_id"), F.col("first.name").alias("first_name"))
    n, size = narrow.agg(F.count(F.lit(1)), F.sum(F.col("bytes").cast("long") + 1000)).first()
    rows = rows.withColumn("name", name).join(small_side(stored(again, "revisits")), F.col("row") == F.col("r"), "left")
    revisit = F.col("r").isNotNull()
    response = _urn(F.col("name"), "response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    target = ("WARC-Target-URI", F.col("url"))
    main = _header(
        F.when(revisit, "revisit").otherwise("response"), response, F.concat(http, F.when(revisit, "").otherwise(F.col("html"))), target, ("WARC-Payload-Digest", digest),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), _urn(F.col("first_name"), "response"), F.lit(">")))), ("WARC-Profile", F.when(revisit, PROFILE)), type_="application/http; msgtype=response",
    )
    along = ("WARC-Concurrent-To", F.concat(F.lit("<"), response, F.lit(">")))
    request = _header(F.lit("request"), _urn(F.col("name"), "request"), F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF * 2}")), target, along, type_="application/http; msgtype=request")
    said = F.concat_ws("", F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.when(revisit, F.concat(F.lit("refers_to: "), F.col("first_id").cast("string"), F.lit(CRLF))))
    metadata = _header(F.lit("metadata"), _urn(F.col("name"), "metadata"), said, target, along, type_="application/warc-fields")
    out = rows.select(F.concat_ws(CRLF * 2, main, request, metadata).alias("value"))
    # A reader holds a file, so files are bounded.
    out.write.option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES * (n or 1) // max(1, size or 1))).text(path, lineSep=CRLF * 2)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an uncompressed stream; one block in memory at a time."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.rstrip(b"\r\n").decode("utf-8", "replace")
            if text[:1] in " \t" and last:
                fields[last] += " " + text.strip()
            else:
                last, _, value = text.partition(":")
                last = last.strip().lower()
                fields[last] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("record ends early")
        yield fields, block


RECORDS = "record_id string, kind string, concurrent_to string, refers_to string, target_uri string, date string, declared_digest string, http_length long, payload_bytes long, payload_digest string, page_id long, refers_to_page long"


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under path (plain or gzip); payload_bytes and payload_digest are of the bytes that are there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
        for df in batches:
            for raw in df["content"]:
                raw = bytes(raw)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                out, held = [], 0
                for f, block in parse_records(stream):
                    kind, strip = f.get("warc-type", ""), lambda k, f=f: f[k].strip("<>") if k in f else None
                    length = page = refers = payload = None
                    if kind in ("response", "revisit") and f.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        for h in head.split(b"\r\n")[1:]:
                            k, _, v = h.partition(b":")
                            length = int(v) if k.strip().lower() == b"content-length" else length
                    elif kind == "metadata":
                        said = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(CRLF) if ": " in x)
                        page, refers = (int(said[k]) if k in said else None for k in ("page_id", "refers_to"))
                    full = kind == "response" and payload is not None
                    row = (strip("warc-record-id"), kind, strip("warc-concurrent-to"), strip("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-payload-digest"), length, len(payload) if full else None, hashlib.sha256(payload).hexdigest() if full else None, page, refers)
                    out.append(row + ((payload if full else None,) if with_payload else ()))
                    held += len(block) * with_payload + 1
                    if len(out) >= 5000 or held > 8 << 20:
                        yield _typed(out, names)
                        out, held = [], 0
                if out:
                    yield _typed(out, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, RECORDS + ", payload binary" * with_payload)


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names)
    for c in ("http_length", "payload_bytes", "page_id", "refers_to_page"):
        df[c] = df[c].astype("Int64")
    return df


def captures(records: DataFrame) -> DataFrame:
    """records -> one row per capture: capture_id and the structs request, main (response or revisit) and metadata; null where one is missing.

    Request and metadata join the record they are concurrent to; two that name one record leave the one with the smaller record id, and so do repeated records.
    A capture is three records, so no group is large. An empty table gives none; further columns go along in the structs.
    """
    key = F.when(F.col("kind").isin("request", "metadata"), F.coalesce("concurrent_to", "record_id")).otherwise(F.col("record_id"))
    whole = F.struct(*records.columns)
    pick = lambda *kinds: F.min_by(F.when(F.col("kind").isin(*kinds), whole), F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    return records.groupBy(key.alias("capture_id")).agg(pick("request").alias("request"), pick("response", "revisit").alias("main"), pick("metadata").alias("metadata"))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    whole = captures(read_records(spark, path)).where("main is not null")
    declared = F.replace(F.col("main.declared_digest"), F.lit("sha256:"))
    return whole.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("main.payload_bytes", "main.http_length").alias("payload_bytes"), F.coalesce(F.col("main.payload_digest"), declared).alias("payload_digest"),
        F.col("main.kind").alias("record_type"), F.col("metadata.refers_to_page").alias("refers_to"),
    )


SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select sha256(h) as d, min(page_id) as first from p where strlen(h) >= 100 group by 1)
select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f on f.d = sha256(h)
"""
