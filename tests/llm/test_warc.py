from __future__ import annotations

import hashlib

from corpuscle.llm import queries, warc


def test_records_are_linked_and_digests_hold(spark, tiny):
    source = {r["page_id"]: r for r in warc.responses(spark.read.parquet(f"{tiny}/pages.parquet")).collect()}
    rows = queries.op2_warc_derivatives(spark, tiny).collect()
    assert len(rows) == 2 * len(source)
    assert len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        s = source[r["page_id"]]
        assert (r["refers_to"], r["target_uri"], r["source_headers"], r["source_digest"]) == (s["record_id"], s["target_uri"], s["headers"], s["payload_digest"])
        assert r["source_digest"] == "sha256:" + hashlib.sha256(s["payload"].encode()).hexdigest()
        assert r["content_length"] == len(r["block"].encode())
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    ids = {r["record_id"]: r for r in rows if r["warc_type"] == "conversion"}
    for r in rows:
        if r["warc_type"] == "metadata":
            fields = dict(line.split(": ", 1) for line in r["block"].split("\r\n") if line)
            assert ids[fields["conversion"]]["refers_to"] == r["refers_to"]


def test_odd_pages(spark):
    html = "<html lang=\"de\"><title> A\n b </title><script>no</script><p>x &amp;lt; y<br/>z<a href=\"/q\">l</a></p><!-- c --></html>"
    pages = spark.createDataFrame([(1, "http://a", html, "t"), (1, "http://a", html, "t"), (2, None, None, "t"), (None, "", "", "t"), (3, "u", "<" * 200_000, "t")], "page_id long, url string, html string, text string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 10
    text = next(r["block"] for r in rows if r["page_id"] == 1 and r["warc_type"] == "conversion")
    assert "no" not in text and "x &lt; y\nzl" in text
    meta = next(r["block"] for r in rows if r["page_id"] == 1 and r["warc_type"] == "metadata")
    assert "title: A b\r\n" in meta and "language: de\r\n" in meta and "outlinks: 1\r\n" in meta
    assert {r["block"] for r in rows if r["page_id"] == 2 and r["warc_type"] == "conversion"} == {""}
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


def test_serialized_records_have_the_format(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>")], "page_id long, url string, html string")
    for r in warc.serialized(warc.derivatives(warc.responses(pages))).collect():
        head, _, rest = r["value"].partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert head.startswith("WARC/1.1\r\n") and rest.endswith("\r\n\r\n")
        assert int(fields["Content-Length"]) == len(rest[:-4].encode())
