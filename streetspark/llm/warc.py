"""WARC as a content-addressed archive.

``write_archive`` stores every payload's bytes once, under its SHA-256, in
``blobs``, and the exact head of every record (WARC header, HTTP header) in
``heads`` with the digest of the payload that it belongs to. ``read_archive``
verifies each blob against its digest, once, and ``records`` joins heads and
blobs to the original records, byte for byte. ``export_files`` and
``import_files`` write and read them as WARC/1.1 files.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page_id is the response and the others are revisits that refer to it;
if several rows have that page_id, each is a response. Smaller payloads
are responses. Nulls: a null payload is empty; a null url is an empty target;
a null page_id comes back null and is less than any other; if all page_ids of
equal payloads are null, all are responses. Empty table: empty archive. Extra
columns are not archived.
"""

from __future__ import annotations

import gzip
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, shared_dir, stored

CRLF = "\r\n"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 without padding: 160 bits are 4 times 40."""
    h = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), DIGITS, BASE32)


def _urn(page_id: Column, sha256: Column, number: Column) -> Column:
    """A record's id: by page, payload and number, as rows may be repeated."""
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("")), sha256, number.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def heads_of(pages: DataFrame, least: int) -> DataFrame:
    """(sha256, head) per page: which record is the response is settled on digests alone."""
    x = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20").alias("url"),
        F.sha2("payload", 256).alias("sha256"),
        base32_sha1(F.col("payload")).alias("sha1"),
        F.length("payload").cast("long").alias("n"),
    )
    last = x.groupBy("sha256").agg(F.max("page_id").alias("of"))
    x = hot_join(stored(x, "warc-facts"), stored(last, "warc-responses"), "sha256")
    # rows that repeat a page and its payload are numbered, so that no record's id is there twice
    x = x.withColumn("number", F.row_number().over(Window.partitionBy("page_id", "sha256").orderBy("url")))
    revisit = (F.col("n") >= least) & F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2)
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"), F.col("sha256"), F.col("number"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(
            revisit,
            F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("of"), F.col("sha256"), F.lit(1))), line("WARC-Refers-To-Page-ID", F.col("of").cast("string"))),
        ).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit(CRLF),
        http,
    )
    return x.select("sha256", head.alias("head"))


def write_archive(pages: DataFrame, path: str, least: int = 0) -> str:
    """``pages`` has page_id, url and payload (binary)."""
    pages = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    blobs = pages.groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.first("payload").alias("payload"))
    blobs.write.parquet(f"{path}/blobs")
    heads_of(pages, least).write.parquet(f"{path}/heads")
    return path


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(heads, blobs); a blob whose bytes do not have its digest is an error."""
    heads = spark.read.schema("sha256 string, head string").parquet(f"{path}/heads")
    blobs = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/blobs")
    same = F.sha2("payload", 256) == F.col("sha256")
    wrong = F.raise_error(F.concat(F.lit("payload does not have its digest: "), F.col("sha256")))
    return heads, blobs.select("sha256", F.when(same, F.col("payload")).otherwise(wrong).alias("payload"))


def field(name: str, head: str = "head") -> Column:
    """A field of the WARC header; '' if there is none."""
    return F.regexp_extract(head, rf"^WARC/1\.1(?:\r\n(?!\r\n)[^\r\n]*)*?\r\n{name}: ([^\r\n]*)\r\n", 1)


def records(heads: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every record as its original bytes: a response's payload comes from the blobs, a revisit has none."""
    kept = heads.withColumn("type", field("WARC-Type"))
    j = kept.where("type = 'response'").join(blobs, "sha256")
    full = j.select(F.concat(F.encode("head", "utf-8"), F.col("payload")).alias("record"))
    return full.unionAll(kept.where("type = 'revisit'").select(F.encode("head", "utf-8").alias("record")))


def export_files(heads: DataFrame, blobs: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files: records end with two line ends. Text is written as it is, so any bytes pass."""
    lines = records(heads, blobs).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def parse(data: bytes) -> list[dict]:
    """The records of a WARC file, which may be compressed, whole or record by record. Names of fields are taken without regard to case."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:end].decode().split(CRLF)
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}
        block = data[end : end + int(head["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        out.append({"fields": head, "http": http.decode() + CRLF * 2, "payload": payload})
        at = end + len(block) + 4
    return out


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: warc_type, record_id, target_uri, page_id, refers_to, payload_digest, payload."""

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                found = parse(content)
                get = lambda k: [x["fields"].get(k.lower()) for x in found]
                yield pd.DataFrame(
                    {
                        "warc_type": get("WARC-Type"),
                        "record_id": get("WARC-Record-ID"),
                        "target_uri": get("WARC-Target-URI"),
                        "page_id": get("WARC-Page-ID"),
                        "refers_to": get("WARC-Refers-To"),
                        "payload_digest": get("WARC-Payload-Digest"),
                        "payload": [x["payload"] for x in found],
                    }
                )

    schema = "warc_type string, record_id string, target_uri string, page_id string, refers_to string, payload_digest string, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(rows, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages")
    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    path = write_archive(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    heads, blobs = read_archive(spark, path)
    facts = blobs.select("sha256", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    number = lambda name: F.when(field(name) != "", field(name).cast("long"))
    return heads.join(facts, "sha256").select(
        number("WARC-Page-ID").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To-Page-ID").alias("refers_to"),
    )


def op1_sql() -> str:
    chunk = "('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT"
    return f"""
WITH x AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
y AS (SELECT page_id, t, h, max(page_id) OVER (PARTITION BY t) AS last FROM x)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', (1 + (({chunk} >> (35 - 5 * (i % 8))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM y"""
