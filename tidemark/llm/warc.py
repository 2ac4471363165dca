"""Content-addressed WARC archive.

Payload bytes are stored once per SHA-256 in ``payloads``; the exact header
block of every record is kept in ``records`` with its payload's digest.
Records are reconstructed by joining the two.  Everything is DataFrame work;
a payload shared by a third of all records is collapsed map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, work_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits make four base32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``path/records`` and ``path/payloads`` (Parquet).

    Of the records with one payload of at least ``min_bytes`` bytes, that with
    the largest key is a response and the others revisit it; smaller payloads
    are all responses.  A null body is empty.  Rows that repeat the largest
    key are all responses; a null key sorts lowest.  Null URLs give an empty
    target.  A payload of any length is one row of one file.  Rows that repeat a
    key share a record id, as the key is all that names a record.  Other columns
    are ignored; an empty table gives empty tables.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    payloads = rows.groupBy("digest").agg(F.max_by("payload", F.coalesce("key", F.lit(-(1 << 63)))).alias("payload"))
    payloads.write.parquet(f"{path}/payloads")
    slim = rows.select("key", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    first = slim.groupBy("digest").agg(F.max("key").alias("first_key"))
    d = slim.join(first, "digest")
    revisit = (F.col("n") >= min_bytes) & F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    clean = F.regexp_replace("url", r"[\r\n]", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("key"))),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), ident(F.col("first_key")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
    ]
    d.select("key", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).alias("header"), "digest").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: key, header, record_type, refers_to, payload_bytes,
    payload_digest, verified (the stored bytes have the digest they are stored
    under), and block: the payload of a response, nothing for a revisit.

    A payload goes to its responses alone, so one that very many records revisit
    is not copied to each of them; they meet its length and digests only.
    """
    p = spark.read.parquet(f"{path}/payloads").select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), (F.sha2("payload", 256) == F.col("digest")).alias("verified"))
    r = spark.read.parquet(f"{path}/records")
    grab = lambda pattern: F.nullif(F.regexp_extract("header", pattern, 1), F.lit(""))
    r = r.select("key", "header", "digest", grab(r"\r\nWARC-Type: (\w+)\r\n").alias("record_type"), grab(r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n").cast("long").alias("refers_to"))
    whole = r.filter("record_type = 'response'").join(p, "digest").withColumnRenamed("payload", "block")
    again = r.filter("record_type = 'revisit'").join(p.drop("payload"), "digest").withColumn("block", F.lit(b""))
    return whole.unionByName(again)


def rebuild(archive: DataFrame) -> DataFrame:
    """The original records, exact bytes, in the column ``record``."""
    return archive.withColumn("record", F.concat(F.encode("header", "UTF-8"), F.col("block"), F.lit(b"\r\n\r\n")))


def parse_records(records: DataFrame) -> DataFrame:
    """What the bytes of records say: adds r_type, r_refers_to, r_digest, r_block
    (as many bytes as the header says) and r_exact (header, block and the two
    line ends are all there is)."""
    # The header ends at the first empty line; it has no other.
    head = F.concat(F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1), F.lit("\r\n\r\n"))
    d = records.withColumn("r_head", head)
    say = lambda name, value: F.nullif(F.regexp_extract("r_head", rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    size = say("Content-Length", r"(\d+)").cast("int")
    d = d.withColumns({"r_type": say("WARC-Type", r"(\w+)"), "r_refers_to": say("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long"), "r_digest": say("WARC-Payload-Digest", r"sha1:(\w+)"), "r_size": size})
    block = F.substring("record", F.octet_length("r_head") + 1, F.col("r_size"))
    return d.withColumns({"r_block": block, "r_exact": F.octet_length("record") == F.octet_length("r_head") + F.col("r_size") + 4}).drop("r_head", "r_size")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, rebuilt from the archive; a response's length and
    digest are those of the block in its record."""
    path = work_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    d = parse_records(rebuild(read_archive(spark, path)))
    own = F.col("r_type") == "response"
    n = F.when(own, F.octet_length("r_block").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(own, base32_sha1(F.col("r_block"))).otherwise(F.col("r_digest"))
    fine = F.col("verified") & F.col("r_exact") & (digest == F.col("payload_digest")) & (digest == F.col("r_digest"))
    return d.select(F.col("key").alias("page_id"), n.alias("payload_bytes"), digest.alias("payload_digest"), F.col("r_type").alias("record_type"), F.col("r_refers_to").alias("refers_to"), fine.alias("verified"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, sha256(b) AS k FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS first_id FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::BIGINT, 1), '' ORDER BY i)
   FROM range(0, 32) AS r(i)) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
  true AS verified
FROM m
"""
