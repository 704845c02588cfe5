"""WARC derivatives: metadata and plain-text conversion records of responses.

Everything is column expressions over one row of a response, so there is no shuffle and a
task holds one page at a time. The records of a response refer to it by its record id and
carry its target, date, headers and payload digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import table

#: The alphabet of base 32 (RFC 4648), that of conv(), named entities, tags that end a line.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
LINE_TAGS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|blockquote|pre|main|aside|form|hr|dd|dt|dl)\b[^>]*>"
HIDDEN = r"(?is)<!--.*?-->|<head\b.*?</head[^>]*>|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>"
TAGS = r"<[a-zA-Z/!?][^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = r"(?i)<html[^>]*\blang=\"([^\"]*)\""
LINKS = r"(?i)<a[ \t\r\n][^>]*?href=\"([^\"]*)\""
BLANKS = r"[ \t\r\f\x0B]+"
BREAKS = r" ?\n[ \n]*"
#: Stands for the date where the source has none.
NO_DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """sha1: and the base 32 digest, as WARC-Block-Digest and WARC-Payload-Digest have it."""
    digest = F.sha1(data.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), DIGITS32, BASE32))


def urn(*parts: Column) -> Column:
    """A record id that is the same for the same parts."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), BREAKS, "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """The visible text: no head, scripts, styles, comments or tags; block tags end lines; named entities resolved."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), LINE_TAGS, "\n"), TAGS, "")
    return tidy(resolved(text))


def resolved(text: Column) -> Column:
    """The named entities' characters in their places, &amp; last."""
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> responses: key, record_id, target_uri, date, http_headers, payload."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    url = F.coalesce("url", F.lit(""))
    return pages.select(F.col("page_id").alias("key"), urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"), url.alias("target_uri"), F.lit(NO_DATE).alias("date"), head.alias("http_headers"), html.alias("payload"))


def responses_of_warc(files: DataFrame) -> DataFrame:
    """Files as spark.read.format("binaryFile") gives them (path, content), plain or .gz -> responses.

    One file is one row, so files should be of the usual size (about 1 GB at most). Records
    that are not responses, or are cut short, are left out; key is path and record number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, at, k = [], 0, 0
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    fields = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                    size = int(fields.get("Content-Length", 0))
                    block = data[end + 4 : end + 4 + size]
                    if fields.get("WARC-Type") == "response" and len(block) == size:
                        head, _, body = block.partition(b"\r\n\r\n")
                        rows.append((f"{path}#{k}", fields.get("WARC-Record-ID", ""), fields.get("WARC-Target-URI", ""), fields.get("WARC-Date", NO_DATE), head.decode("utf-8", "replace"), body.decode("utf-8", "replace")))
                    at, k = end + 4 + size + 4, k + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["key", "record_id", "target_uri", "date", "http_headers", "payload"])

    return files.select("path", "content").mapInArrow(run, "key string, record_id string, target_uri string, date string, http_headers string, payload string")


def derive(responses: DataFrame) -> DataFrame:
    """Responses -> two rows each, a metadata and a conversion record.

    Columns: key, record_type, record_id, refers_to, target_uri, date, content_type,
    content_length (bytes of the block), payload_digest (of the source's payload),
    block_digest, header (the record's head), block. Null headers and payloads count as
    empty, and so do pages without text, which give an empty block. Repeated rows give
    repeated records with equal ids.
    """
    r = responses.select("key", "record_id", "target_uri", F.coalesce("date", F.lit(NO_DATE)).alias("date"), F.coalesce("http_headers", F.lit("")).alias("h"), F.coalesce("payload", F.lit("")).alias("p"))
    head, sep = F.concat(F.lit("source-header: "), F.regexp_replace("h", "\r\n", "\r\nsource-header: ")), F.lit("\r\n")
    links = F.concat_ws("", F.expr("transform(links, x -> concat('outlink: ', replace(x, '&amp;', '&'), '\r\n'))"))
    r = r.select("*", sha1_base32(F.col("p")).alias("payload_digest"), tidy(resolved(F.regexp_extract("p", TITLE, 1))).alias("title"), F.regexp_extract("p", LANGUAGE, 1).alias("language"), F.regexp_extract_all("p", F.lit(LINKS), F.lit(1)).alias("links"), plain_text(F.col("p")).alias("text"))
    meta = F.concat(F.lit("title: "), "title", sep, F.lit("language: "), "language", sep, F.lit("source-payload-digest: "), "payload_digest", sep, head, sep, links)
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    r = r.select("key", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.explode(kinds).alias("k")).select("key", "refers_to", "target_uri", "date", "payload_digest", "k.*")
    r = r.select("*", urn(F.col("record_type"), F.col("refers_to")).alias("record_id"), sha1_base32(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    return r.select("key", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "payload_digest", "block_digest", F.concat_ws("\r\n", *lines).alias("header"), "block")


def as_warc(records: DataFrame) -> DataFrame:
    """(header, block) -> value: whole records, ready for ``write.text`` with an empty line separator."""
    return records.select(F.concat("header", F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n")).alias("value"))


def op3_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    done = derive(responses_of_pages(table(spark, sf_dir, "pages")))
    return done.select(
        F.col("key").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "payload_digest", "block_digest",
        F.sha2(F.concat("header", F.lit("\r\n\r\n"), "block").cast("binary"), 256).alias("record_sha256"),
    )


def _sql_digest(text: str) -> str:
    """DuckDB: the base 32 digest of a text."""
    h = f"sha1({text})"
    each = [f"substr('{BASE32}', 1 + ((('0x' || substr({h}, {1 + 5 * g}, 5))::INTEGER >> {5 * (3 - k)}) & 31), 1)" for g in range(8) for k in range(4)]
    return "'sha1:' || " + " || ".join(each)


def _sql_urn(text: str) -> str:
    return f"(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' FROM (SELECT md5({text}) AS h))"


def _sql_tidy(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '{BLANKS}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), ' ' || chr(10))"


def _sql_text(html: str) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace({html}, '{HIDDEN}', '', 'g'), '{LINE_TAGS}', chr(10), 'g'), '{TAGS}', '', 'g')"
    return _sql_tidy(_sql_resolved(text))


def _sql_resolved(text: str) -> str:
    for name, value in ENTITIES:
        text = f"replace({text}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return text


_NL = "chr(13) || chr(10)"
ORACLE = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS p,
    'HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL} || 'Content-Length: ' || strlen(coalesce(html, '')) AS h
  FROM pages),
s AS (
  SELECT *, {_sql_urn("'response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri")} AS refers_to, {_sql_digest("p")} AS payload_digest,
    {_sql_tidy(_sql_resolved(f"regexp_extract(p, '{TITLE}', 1)"))} AS title, regexp_extract(p, '{LANGUAGE}', 1) AS language,
    list_aggregate(list_transform(regexp_extract_all(p, '{LINKS}', 1), lambda x: 'outlink: ' || replace(x, '&amp;', '&') || {_NL}), 'string_agg', '') AS links, {_sql_text("p")} AS text
  FROM r),
k AS (
  SELECT page_id, refers_to, target_uri, payload_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || title || {_NL} || 'language: ' || language || {_NL} || 'source-payload-digest: ' || payload_digest || {_NL}
      || 'source-header: ' || replace(h, {_NL}, {_NL} || 'source-header: ') || {_NL} || coalesce(links, '') AS block
  FROM s
  UNION ALL
  SELECT page_id, refers_to, target_uri, payload_digest, 'conversion', 'text/plain; charset=utf-8', text FROM s),
d AS (
  SELECT *, {_sql_urn("record_type || '|' || refers_to")} AS record_id, {_sql_digest("block")} AS block_digest, strlen(block) AS content_length FROM k)
SELECT page_id, record_type, record_id, refers_to, target_uri, content_type, content_length, payload_digest, block_digest,
  sha256('WARC/1.1' || {_NL} || 'WARC-Type: ' || record_type || {_NL} || 'WARC-Record-ID: ' || record_id || {_NL} || 'WARC-Date: {NO_DATE}' || {_NL}
    || 'WARC-Target-URI: ' || target_uri || {_NL} || 'WARC-Refers-To: ' || refers_to || {_NL} || 'WARC-Block-Digest: ' || block_digest || {_NL}
    || 'Content-Type: ' || content_type || {_NL} || 'Content-Length: ' || content_length || {_NL} || {_NL} || block) AS record_sha256
FROM d"""

QUERIES = {"op3_warc_derivatives": op3_warc_derivatives}
ORACLES: dict[str, str] = {"op3_warc_derivatives": ORACLE}
