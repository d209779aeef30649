"""Page text and WARC archives: fixtures, round trips, broken archives."""

import struct

import pytest
import zstandard

from carrierbook.llm import html_text, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u\r\nX: y", "same"), (2, None, "same"), (3, "v", "other"), (None, "n", "same"), (5, "w", None), (6, "w", "")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, sha string, refers_to string")


# --- op 3 -----------------------------------------------------------------------------------------

@pytest.mark.parametrize(("html", "text"), [
    ("", ""),
    ("plain", "plain"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<ol start=3><li>a<li>b<ul><li>c</ul></ol>", "3. a\n4. b\n   - c"),
    ("<table><tr><th>name<th>n<tr><td>long cell<td>1</table>", "name      | n\nlong cell | 1"),
    ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na | b"),
    ("<td>x</td>", "x"),
    ("<head><title>t</title><style>p{}</style></head><body>b</body>", "b"),
    ("<script>var t='</p>';</script>a<!-- c -->b<template>no</template>", "ab"),
    ("<p hidden>no</p><p style='Display : none'>no</p><span style='visibility:hidden'>no</span>yes", "yes"),
    ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
    ("a &amp; b &lt;i&gt; &#233;", "a & b <i> é"),
    ("<b>x <i> y</b></i>  z", "x y z"),
    ("</div></p>a", "a"),
])
def test_visible_text(html, text):
    assert html_text.visible_text(html).strip("\n") == text


@pytest.mark.parametrize(("html", "text"), [
    ("<html><head><title>t</title><h1>x</h1><p>text", "x\n\ntext"),
    ("<head><meta charset=utf-8><style>a{}</style><noscript><img></noscript>\n words<p>more", "words\n\nmore"),
    ("<head><link><script>1</script></html>late", "late"),
    ("<head><title>on <script> and <b></title><p>x", "x"),
    ("<head></head><body>a<head>b", "ab"),
])
def test_omitted_head_end(html, text):
    assert html_text.visible_text(html).strip("\n") == text


@pytest.mark.parametrize(("html", "text"), [
    ("Note<textarea>\nfirst &amp; <b>\n  second</textarea>end", "Note first & <b>\n  second end"),
    ("<textarea>left open<p>", "left open<p>"),
    ("in <select><option>one<option selected>two<option>three</select>.", "in two ."),
    ("<select><option disabled>no<optgroup disabled><option>no</optgroup><optgroup label=g><option>a &lt; b</select>", "a < b"),
    ("<select><option hidden selected>Choose<option>one</select>", "Choose"),
    ("<select multiple><optgroup label=g><option>a<option label=l>b<option hidden>c</select>", "g\na\nl"),
    ("<select><option>one<input>after", "one after"),
    ("<p>so <math><mi>E</mi><mo>=</mo><semantics><mi>m</mi><annotation>tex</annotation></semantics><mphantom>no</mphantom></math> holds", "so E=m holds"),
    ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs>no<text>A <tspan>b</tspan></text><text>C</text></svg>", "A b\nC"),
    ("<svg><foreignObject><p>inner</p></foreignObject><g/><source/><p>outer</p>", "inner\n\nouter"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><p>no</div>x", "yes\n\nx"),
    ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>x", "x"),
    ("<p style='visibility:visible!important;visibility:hidden'>a<i style='visibility:collapse'>no", "a"),
    ("<table><tr><td style='visibility:hidden'>gone<td>b<tr><td>c<td>d</table>", "  | b\nc | d"),
    ("<ol><li style='visibility:hidden'>no<li>b</ol>", "2. b"),
])
def test_all_visible_text(html, text):
    assert html_text.visible_text(html).strip("\n") == text


def test_deep_and_long_pages():
    assert html_text.visible_text("<div>" * 20_000 + "deep") == "deep"
    assert len(html_text.visible_text("<p>word " * 20_000)) > 100_000


def test_extract_rows(pages, spark):
    found = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert found == {1: "same", 2: "same", 3: "other", None: "same", 5: "", 6: ""}
    assert html_text.extract(pages.limit(0)).count() == 0
    given = spark.read.parquet(f"{SF}/pages.parquet")
    assert html_text.extract(given).count() == given.count()


# --- op 4 -----------------------------------------------------------------------------------------

def test_warc_round_trip(pages):
    records = warc.resolve(warc.read(warc.write(pages, archive_bytes=500))).collect()
    by = {r["page_id"]: r for r in records}
    assert len(records) == 6
    assert (by[2]["record_type"], by[2]["refers_to"], by[2]["payload"]) == ("response", None, "same")
    assert [(by[k]["record_type"], by[k]["refers_to"], by[k]["payload_bytes"]) for k in (1, None)] == [("revisit", 2, 4)] * 2
    assert by[5]["refers_to"] == 6 and by[6]["record_type"] == "response" and by[6]["payload_bytes"] == 0
    assert by[1]["payload_digest"] == by[2]["payload_digest"] and len(by[1]["payload_digest"]) == 32
    assert by[1]["url"] == "u%0D%0AX:%20y" and by[2]["url"] is None


def test_warc_small_payloads_are_responses(pages):
    records = warc.read(warc.write(pages, least_bytes=5)).collect()
    assert {r["page_id"] for r in records if r["record_type"] == "revisit"} == set()


def test_warc_files(spark, pages, tmp_path):
    given = spark.read.parquet(f"{SF}/pages.parquet")
    archives = warc.write(given, archive_bytes=100_000)
    warc.write_files(archives, f"file://{tmp_path}").collect()
    back = warc.from_files(spark, str(tmp_path))
    joined = warc.read(back).where("record_type = 'response'").join(given, "page_id")
    assert joined.where("payload <> html").count() == 0 and warc.read(back).count() == given.count()
    assert warc.write(pages.limit(0)).count() == 0


def _records(n=40):
    return [warc._record(k, "http://x.example/", f"<p>page {k} {'w' * k}</p>".encode(),
                         warc.base32_sha1(f"<p>page {k} {'w' * k}</p>".encode()), None) for k in range(n)]


def test_warc_dictionary_frame():
    records = _records()
    content = warc.archive(records)
    magic, size = struct.unpack("<II", content[:8])
    assert magic == 0x184D2A5D and size > 0
    assert list(warc.frames(content)) == records
    trained = zstandard.ZstdDecompressor().decompress(content[8:8 + size])
    with pytest.raises(zstandard.ZstdError):  # the records need the dictionary
        zstandard.ZstdDecompressor().decompress(content[8 + size:])
    assert len(trained) <= warc.DICTIONARY_BYTES
    assert list(warc.frames(warc.archive(records[:2]))) == records[:2]  # too few to train on


def test_warc_broken_archives():
    content = warc.archive(_records())
    for broken in (b"", content[4:], content[:-3], content[:50], content[:-30] + b"\0" * 30):
        with pytest.raises(warc.WarcError):
            list(warc.frames(broken))
    record = _records(1)[0]
    for broken in (record.replace(b"WARC/1.1", b"WARC/9.9"), record[:-4], record + b"x", record.replace(b"page 0", b"page 1"),
                   record.replace(b"WARC-Date", b"X-Date"), record.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(warc.WarcError):
            warc.parse(broken)


# --- op 3: hard pages -----------------------------------------------------------------------------

HARD_PAGES = {
    "end tags without a start": "<b>" * 20_000 + "</i>" * 20_000 + "x",
    "end tags out of a table": "<i><table><td>" + "<b>" * 20_000 + "</i>" * 20_000 + "x",
    "blocks in deep elements": "<b>" * 20_000 + "<div>x" * 20_000,
    "one long cell": "<table><tr><td>" + "y" * 100_000 + "<td>z" + "<tr><td>a<td>b" * 2_000,
    "deep lists": "<ul><li>x" * 4_000,
    "wide and deep spans": "<table><tr>" + "<td colspan=100 rowspan=99>a" * 300 + "<tr><td>b" * 2_000,
}


@pytest.mark.parametrize("name", HARD_PAGES)
def test_hard_pages_take_linear_time_and_space(name):
    import time

    page = HARD_PAGES[name]
    begin = time.process_time()
    text = html_text.visible_text(page)
    assert time.process_time() - begin < 2 and len(text) < 10 * len(page)


def test_row_spans_details_dialogs_and_display():
    shown = html_text.visible_text
    assert shown("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>") == "A | B\n  | C\nD | E"
    assert shown("<details><summary>S</summary>body</details><details open><summary>T</summary>more</details>") == "S\nT\nmore"
    assert shown("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    assert shown("<p style='display:none;display:block'>yes<p style='display:block;display:none'>no") == "yes"
    assert shown("<input type=submit value=Go><input value=no>").strip() == "Go"
