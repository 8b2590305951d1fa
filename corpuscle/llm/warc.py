"""WARC derivatives: metadata and plain-text conversion records for response records, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The capture date of tables that have none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Fixed patterns of the text extraction, in the order in which they are applied; they mean the same to Java and to RE2.
DROPPED = r"(?is)<script[^<>]*>.*?</script[^<>]*>|<style[^<>]*>.*?</style[^<>]*>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|h[1-6]|tr|td|th|table|section|article|nav|header|footer|title|main|aside|blockquote|pre)(?:[ \t\r\n/][^<>]*)?>"
TAGS = r"<[^<>]*>"
BLANKS, LINES = r"[ \t\r\f]+", r" ?\n[ \n]*"
TITLE = r"(?is)<title[^<>]*>(.*?)</title>"
LANG = r"(?is)<html[^<>]* lang=\"([^\"]*)\""
LINKS = r"(?i)<a [^<>]*href=\"([^\"]*)\""
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def record_id(*parts: Column | str) -> Column:
    """A record identifier that the same input always gets: the MD5 of its parts, laid out as a UUID."""
    hexed = F.md5(F.concat_ws("|", *parts))
    return F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def plain_text(html: Column) -> Column:
    """The text of a page: scripts, styles and comments out, block tags as line ends, other tags out, blanks joined."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, " "), BREAKS, "\n"), TAGS, "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINES, "\n")).alias("text")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """Response records of crawled pages: ``(<id_col>, record_id, target_uri, warc_date, headers, payload, payload_digest)``.

    A null page is an empty payload, a null url an empty target. The identifier follows from id, url and payload, so
    repeated rows give the same record.
    """
    url, payload = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).alias(id_col), url.alias("target_uri"), payload.alias("payload")).withColumn("payload_digest", _digest(F.col("payload")))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), _size(F.col("payload")).cast("string"), F.lit("\r\n"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return own.select(id_col, record_id(key, "target_uri", "payload_digest").alias("record_id"), "target_uri", F.lit(date).alias("warc_date"), headers.alias("headers"), "payload", "payload_digest")


def derivatives(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two records for each response: its metadata and its plain text.

    Both name the response in ``refers_to`` and carry its target, date, headers and payload digest unchanged; each has
    its own identifier, length and block digest, and the metadata record names the conversion in its block. Empty
    payloads give records with empty title and text. Repeated responses give repeated records; other columns are left.
    """
    own = records.select(id_col, F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), "payload")
    own = own.withColumn("text", plain_text(F.col("payload"))).withColumn("converted_id", record_id("refers_to", F.lit("conversion")))
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n]+", " "))
    links = F.size(F.array_distinct(F.regexp_extract_all("payload", F.lit(LINKS), F.lit(1))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    fields = F.concat(line("title", title), line("language", F.regexp_extract("payload", LANG, 1)), line("outlinks", links.cast("string")), line("sourceDigest", F.col("source_digest")), line("conversion", F.col("converted_id")), line("conversionLength", _size(F.col("text")).cast("string")))
    meta = F.struct(F.lit("metadata").alias("warc_type"), record_id("refers_to", F.lit("metadata")).alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block"))
    text = F.struct(F.lit("conversion").alias("warc_type"), F.col("converted_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block"))
    both = own.select(id_col, "refers_to", "target_uri", "warc_date", "source_headers", "source_digest", F.inline(F.array(meta, text)))
    return both.withColumns({"content_length": _size(F.col("block")), "block_digest": _digest(F.col("block"))})


def serialized(records: DataFrame) -> DataFrame:
    """Derivative records as one string each, in the WARC 1.1 format, ready for a text sink with an empty line separator."""
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")) for name, c in head]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("value"))


def _sql_text(html: str) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace({html}, '{DROPPED}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g')"
    for entity, plain in ENTITIES:
        quoted = plain.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return rf"trim(regexp_replace(regexp_replace({text}, '{BLANKS}', ' ', 'g'), '{LINES}', chr(10), 'g'), ' ')"


_UUID = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') target_uri, coalesce(html, '') payload FROM pages),
q AS (SELECT *, 'sha256:' || sha256(payload) source_digest FROM p),
r AS (SELECT *, {_UUID.format("concat_ws('|', coalesce(page_id::VARCHAR, ''), target_uri, source_digest)")} refers_to, {_sql_text("payload")} txt,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) source_headers FROM q),
s AS (SELECT *, {_UUID.format("concat_ws('|', refers_to, 'conversion')")} conversion_id, chr(13) || chr(10) crlf FROM r),
t AS (
  SELECT page_id, refers_to, target_uri, '{NO_DATE}' warc_date, source_headers, source_digest, 'metadata' warc_type,
    {_UUID.format("concat_ws('|', refers_to, 'metadata')")} record_id, 'application/warc-fields' content_type,
    'title: ' || trim(regexp_replace(regexp_extract(payload, '{TITLE}', 1), '[ \\t\\r\\n]+', ' ', 'g'), ' ') || crlf || 'language: ' || regexp_extract(payload, '{LANG.replace(chr(92) + chr(34), chr(34))}', 1) || crlf
    || 'outlinks: ' || len(list_distinct(regexp_extract_all(payload, '{LINKS.replace(chr(92) + chr(34), chr(34))}', 1))) || crlf || 'sourceDigest: ' || source_digest || crlf
    || 'conversion: ' || conversion_id || crlf || 'conversionLength: ' || strlen(txt) || crlf AS block FROM s
  UNION ALL
  SELECT page_id, refers_to, target_uri, '{NO_DATE}', source_headers, source_digest, 'conversion', conversion_id, 'text/plain; charset=utf-8', txt FROM s)
SELECT *, strlen(block)::BIGINT content_length, 'sha256:' || sha256(block) block_digest FROM t
"""
