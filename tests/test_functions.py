import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import jsonops as J
from folioforge.functions import locations as S
from folioforge.functions import text as X
from folioforge.operators import convert as V
from folioforge.operators import enrich as N
from folioforge.operators import records as R
from folioforge.sources import html, sinks
from folioforge.sources import packages as P

SCHEMA = {
    "type": "object",
    "required": ["plot"],
    "properties": {"plot": {"type": "string"}, "beds": {"type": "array", "items": {"type": "object", "required": ["crop"], "properties": {"rows": {"type": "integer"}, "crop": {"type": ["string", "null"]}}}}, "soil": {"enum": ["clay", "loam", 3]}},
}


def test_schema_messages():
    # fixed values: the wording of the messages
    assert J.violation({"plot": "A", "beds": [{"crop": None, "rows": 2}, {"crop": "oats", "rows": "two"}]}, SCHEMA) == "$.beds[1].rows should be integer"
    assert J.violation({"beds": []}, SCHEMA) == "$.plot is required"
    assert J.violation({"plot": "A", "soil": "3"}, SCHEMA) == "$.soil is not one of the allowed values"
    assert J.violation({"plot": "A", "beds": [{"crop": 7}]}, SCHEMA) == "$.beds[0].crop should be string or null"
    assert J.violation({"plot": "A", "beds": [{"crop": "rye", "rows": 4.0}], "soil": 3}, SCHEMA) is None
    for bad in ('{"type": "array"}', "[1]", '{"type": "object", "x": ' + "[" * 40 + "]" * 40 + "}", '{"type": "object", "x": "' + "y" * 20_000 + '"}'):
        with pytest.raises(ValueError):
            J.check_schema(bad)
    closed = J.strict({"type": "object", "properties": {"format": {"type": "string", "format": "date"}}})
    assert closed == {"type": "object", "properties": {"format": {"type": "string"}}, "additionalProperties": False}
    assert J.find_upload({"a": [{"b": "data:image/png"}]}) == "data:" and J.find_upload({"a": [{"blob": 1}]}) == "blob" and J.find_upload({"a": "b"}) is None
    assert J.json_path("a.0.b[2]") == "$.a[0].b[2]"


def test_html_tables_links_and_blocks():
    text, title, links = html.convert("<html><head><title>T &amp; U</title><style>x</style></head><body><h1>Head</h1><p>one <b>two</b> <a href='/x'>go</a><table><tr><td>1<td>2|3</tr></table><ul><li>a<li>b</ul>")
    assert title == "T & U" and links == ["/x"]
    assert "# Head" in text and "[go](/x)" in text and "2\\|3" in text and "- a" in text and "x" not in title


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="http://w" xmlns:r="http://r"'


def test_docx():
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    styles = f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>'
    row = P.extract(_zip({"word/document.xml": body, "word/styles.xml": styles}), "x.docx")
    assert row["format"] == "docx" and "## Head" in row["content"] and "**bold**" in row["content"] and "| a |" in row["content"]


def test_xlsx():
    sheet = '<worksheet><sheetData><row><c r="B1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row></sheetData></worksheet>'
    row = P.extract(_zip({"xl/workbook.xml": f'<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="i"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="i" Target="s.xml"/></R>', "xl/s.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>v</t></si></sst>"}))
    assert row["format"] == "xlsx" and "|  | v | TRUE |" in row["content"] and row["pages"] == 1


def test_epub_and_refusals():
    row = P.extract(_zip({"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="o.opf"/></c>', "o.opf": '<p><item id="a" href="a.html" media-type="application/xhtml+xml"/><itemref idref="a"/></p>', "a.html": "<h1>One</h1>"}))
    assert row["content"].strip() == "# One"
    assert P.extract(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")["error"][0] == "unsupported_format"
    assert P.extract(b"PK\x03\x04broken")["error"][0] == "corrupt_document"
    assert P.extract(_zip({"word/document.xml": b"a" * (20 << 20)}))["error"][0] == "archive_limit_exceeded"
    assert P.extract(b"%PDF-1.4 /Type /Pages /Count 7")["pages"] == 7


P_NS = 'xmlns:p="http://p" xmlns:a="http://a" xmlns:r="http://r"'


def test_pptx_follows_the_slide_list():
    def slide(title, *lines):
        shapes = f'<p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:sp>' if title else ""
        body = "".join(f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>' for lvl, t in lines)
        return f"<p:sld {P_NS}>{shapes}<p:sp>{body}</p:sp></p:sld>"

    parts = {
        "ppt/presentation.xml": f'<p:presentation {P_NS}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="r1" Target="slides/b.xml"/><Relationship Id="r2" Target="slides/a.xml"/></R>',
        "ppt/slides/a.xml": slide("", (0, "last")),
        "ppt/slides/b.xml": slide("Harvest", (0, "oats &amp; rye"), (1, "early")),
    }
    row = P.extract(_zip(parts), "x.pptx")
    assert row["format"] == "pptx" and row["pages"] == 2
    assert row["content"].strip() == "## Slide 1: Harvest\n\n- oats & rye\n  - early\n\n## Slide 2\n\n- last"
    assert [s[1:] for s in row["segments"]] == [("slide", 1, 1), ("slide", 2, 2)] and row["content"][row["segments"][1][0] :].startswith("## Slide 2")


O_NS = 'xmlns:office="o" xmlns:text="t" xmlns:table="b" xmlns:draw="d" xmlns:xlink="x"'


def _odf(kind, body):
    return P.extract(_zip({"mimetype": f"application/vnd.oasis.opendocument.{kind}", "content.xml": f"<office:document-content {O_NS}><office:body>{body}</office:body></office:document-content>"}))


def test_odf():
    row = _odf("text", '<office:text><text:h text:outline-level="2">Beds</text:h><text:p>a<text:s text:c="3"/>b <text:a xlink:href="https://x.y">go</text:a></text:p><text:list><text:list-item><text:p>one</text:p><text:list><text:list-item><text:p>two</text:p></text:list-item></text:list></text:list-item></text:list></office:text>')
    assert row["format"] == "odt" and row["content"].strip() == "## Beds\n\na   b [go](https://x.y)\n\n- one\n\n  - two"
    row = _odf("spreadsheet", '<office:spreadsheet><table:table table:name="Crops"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"><text:p>v</text:p></table:table-cell><table:table-cell/></table:table-row></table:table></office:spreadsheet>')
    assert row["format"] == "ods" and row["content"].startswith("## Crops") and row["content"].count("| v | v |") == 2 and row["pages"] == 1
    row = _odf("presentation", "<office:presentation><draw:page><text:p>hello</text:p></draw:page><draw:page/></office:presentation>")
    assert row["format"] == "odp" and row["pages"] == 2 and "## Slide 1\n\nhello\n\n## Slide 2" in row["content"]


def test_package_images():
    big, tiny = P.png(bytes(range(256)) * 48, 64, 64, 3) + bytes(300), P.png(bytes(30 * 30 * 3), 30, 30, 3) + bytes(300)
    ns = 'xmlns:w="w" xmlns:r="http://r" xmlns:a="a" xmlns:p="p"'
    draw = '<w:drawing><w:docPr descr="a [wide] field"/><a:blip r:embed="{}"/></w:drawing>'
    rels = '<R><Relationship Id="i" Target="media/a.png"/><Relationship Id="j" Target="media/b.png"/><Relationship Id="k" Target="media/none.png"/></R>'
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t>{draw.format(i)}</w:r></w:p>" for t, i in (("one", "i"), ("two", "j"), ("three", "k"), ("four", "i")))
    data = _zip({"word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels, "word/media/a.png": big, "word/media/b.png": tiny})
    row = P.extract(data, "x.docx", images=True)
    name = f"images/{row['images'][0]['id']}.png"
    assert row["content"].split("\n\n") == [f"one![a wide field]({name})", "two", "three", f"four![a wide field]({name})"] and [x["bytes"] for x in row["images"]] == [big]
    assert P.extract(data, "x.docx")["content"] == "one\n\ntwo\n\nthree\n\nfour"
    slides = {"ppt/presentation.xml": f'<p:x {ns}><p:sldId r:id="s"/><p:sldId r:id="t"/></p:x>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="s" Target="slides/1.xml"/><Relationship Id="t" Target="slides/2.xml"/></R>',
              "ppt/slides/1.xml": f'<p:sld {ns}><p:pic><p:cNvPr descr=""/><a:blip r:embed="i"/></p:pic></p:sld>', "ppt/slides/2.xml": f"<p:sld {ns}/>", "ppt/slides/_rels/1.xml.rels": '<R><Relationship Id="i" Target="../media/a.png"/></R>', "ppt/media/a.png": big}
    row = P.extract(_zip(slides), "x.pptx", images=True)
    assert row["content"].startswith("## Slide 1\n\n![image](images/") and row["content"][row["segments"][1][0] :] == "## Slide 2"
    odt = _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f'<o:d {O_NS} xmlns:o="o"><office:body><text:p>hi <draw:frame><draw:image xlink:href="./Pictures/a.png"/></draw:frame></text:p></office:body></o:d>', "Pictures/a.png": big})
    assert P.extract(odt, images=True)["content"] == f"hi ![image]({name})"


def test_image_kinds_and_sizes():
    pad = bytes(300)
    heads = {"gif": b"GIF89a" + bytes([40, 0, 50, 0]), "bmp": b"BM" + bytes(16) + (40).to_bytes(4, "little") + (-50 & 0xFFFFFFFF).to_bytes(4, "little"), "webp": b"RIFF    WEBPVP8X" + bytes(8) + (39).to_bytes(3, "little") + (49).to_bytes(3, "little"),
             "jpg": b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x32\x00\x28"}
    for kind, head in heads.items():
        assert P.image_size(head + pad) == (kind, 40, 50), kind
    for kind, head in {"tif": b"II\x2a\0", "wmf": b"\xd7\xcd\xc6\x9a", "jp2": b"\xff\x4f\xff\x51", "emf": bytes(40) + b" EMF", "svg": b"<?xml?><svg>"}.items():
        assert P.image_size(head + pad) == (kind, None, None) and P.keep_image(head + pad)
    assert P.image_kind(b"WEBPWEBPWEBP") is None and not P.keep_image(b"%PDF" + pad)
    with pytest.raises(P.Refused):
        P.pixels_allowed(heads["gif"] + pad, 1999)
    assert P.pixels_allowed(heads["gif"] + pad, 2000) == (40, 50)


def test_placed_images_shift_segments():
    big = P.png(bytes(range(256)) * 48, 64, 64, 3) + bytes(300)
    small = P.png(bytes(10 * 10 * 3), 10, 10, 3) + bytes(300)
    mark = lambda key, alt="": P.OPEN + key + (P.ALT + alt if alt else "") + P.CLOSE
    text = "one " + mark("a", "a [nice]  field") + "\ntwo " + mark("b") + mark("a") + mark("c") + mark("?") + "\nthree"
    content, moved, kept, notes = P.place_images(text, [(0, "page", 1, 1), (text.index("two"), "page", 2, 2), (text.index("three"), "page", 3, 3)], {"a": big, "b": small, "c": b"no image" + bytes(300)})
    name = f"images/{kept[0]['id']}.png"
    assert content == f"one ![a nice field]({name})\ntwo ![image]({name})\nthree" and len(kept) == 1
    assert [content[s[0] :][:3] for s in moved] == ["one", "two", "thr"] and kept[0]["segment"] == ("page", 1, 1)
    assert notes == ["1 embedded object(s) were not recognised as images and were skipped"]


def test_locations(spark):
    cases = {
        "s3://AK:se%2Fcret@Bucket/a.pdf?region=eu&session_token=tok": "s3://bucket/a.pdf?region=eu",
        "s3://b/a.pdf?session_token=tok": "s3://b/a.pdf",
        "s3://b/a.pdf?session_token=x&region=us#f": "s3://b/a.pdf?region=us#f",
        "https://u:p@Host.org/A?q=1#f": "https://host.org/A?***",
        "http://localhost": "http://localhost/",
        "/tmp/a?b": "/tmp/a?b",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.s for r in rows.select("url", S.sanitize(F.col("url")).alias("s")).collect()} == cases
    got = {r.url: r for r in rows.select("url", S.scheme(F.col("url")).alias("scheme"), S.parse_s3(F.col("url")).alias("p"), S.forbidden(F.col("url")).alias("no")).collect()}
    first = got["s3://AK:se%2Fcret@Bucket/a.pdf?region=eu&session_token=tok"].p
    assert (first.bucket, first.key, first.region, first.access_key, first.secret_key, first.session_token, first.error) == ("bucket", "a.pdf", "eu", "AK", "se/cret", "tok", None)
    assert got["http://localhost"].scheme == "https" and got["/tmp/a?b"].p.error == "not an S3 location"
    wrong = spark.createDataFrame([("s3://a/b:c@d/e",), ("s3://b/",), ("s3:///k",), ("s3://b/k?x=1",), ("s3://:s@b/k",), ("/proc/1/mem",), ("/procs",)], "url string")
    found = wrong.select(S.parse_s3(F.col("url"))["error"].alias("e"), S.forbidden(F.col("url")).alias("no")).collect()
    assert all(r.e for r in found) and [r.no for r in found][-2:] == [True, False]


def test_entities_ocr_and_keys(spark):
    rows = spark.createDataFrame([("&#72;&#x49; &amp;lt; &nbsp;&bogus; &#xD800; &lt;",), ("&amp;#72; &mdash;",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.decode_entities(F.col("t"))).collect()] == ["HI &lt;  &bogus; &#xD800; <", "&#72; —", None]
    good = "plain words of a page " * 4
    pages = spark.createDataFrame([(good, 0), (good, 1), (good * 4, 1), (good + "\ufffd" * 9, 0), ("short", 0), ("-" * 50 + good[:30], 0)], "t string, n int")
    assert [r[0] for r in pages.select(X.needs_ocr(F.col("t"), F.col("n"))).collect()] == [False, True, False, True, True, True]
    texts = spark.createDataFrame([("x/a.txt", good, "text"), ("y/b_c.txt", good, "text"), ("y/d.txt", "# Head\n\n" + good, "markdown")], "path string, text string, format string")
    got = {r.path: r for r in V.convert(texts).collect()}
    assert got["x/a.txt"].cache_key == got["y/b_c.txt"].cache_key != got["y/d.txt"].cache_key
    assert [got[k].title for k in sorted(got)] == ["a", "b c", "Head"]
    keys = texts.limit(1).select(*[V.cache_key(F.col("text"), F.col("format"), o, p, m) for o, p, m in ((V.Options(), "", ""), (V.Options(priority="low"), "", ""), (V.Options(), "p", ""), (V.Options(), "", "p"), (V.Options(chunk_size=300), "", ""))]).first()
    assert keys[0] == keys[1] and len(set(keys)) == 4


def test_settings_endpoints_and_migrations(spark):
    got = R.Settings.of({"FOLIOFORGE_MAX_PDF_PAGES": " 12 ", "FOLIOFORGE_LOCAL_PDF": "0", "OTHER": "x", "FOLIOFORGE_MODEL": ""})
    assert (got.max_pdf_pages, got.local_pdf, got.model) == (12, False, "mock")
    for bad in ({"FOLIOFORGE_MAX_PDF_PAGES": "many"}, {"FOLIOFORGE_LOCAL_PDF": "maybe"}):
        with pytest.raises(ValueError):
            R.Settings.of(bad)
    known = {"p": ("https://p.example/v1", "default")}
    assert R.endpoint("p", None, None, known) == ("https://p.example/v1", "default")
    assert R.endpoint("p", "https://p.example/v1/", "own", known) == ("https://p.example/v1", "own")
    assert R.endpoint("p", "https://evil.example", None, known) == ("https://evil.example", None)
    steps = {1: ["a", "b"], 2: ["c"], 3: ["c", "d"]}
    assert R.migrated(0, [], steps) == (3, ["a", "b", "c", "d"]) == R.migrated(*R.migrated(0, [], steps), steps)
    files = spark.createDataFrame([(f"f{k}", k) for k in range(30)], "path string, modificationTime int")
    assert R.swept(files, F.lit(9), 5).count() == 5 and {r.path for r in R.swept(files, F.lit(9)).collect()} == {f"f{k}" for k in range(10)}


def test_images():
    data = P.png(bytes(40 * 40 * 3), 40, 40, 3)
    assert P.image_size(data) == ("png", 40, 40)
    assert P.keep_image(data + bytes(300)) and not P.keep_image(data[:100])


def test_model_calls():
    assert N.call(N.Mock(fail=2), "x")[1] == ["rate_limited", "rate_limited", "ok"]
    assert N.extract(N.Mock(), "text", SCHEMA)[0]["soil"] == "clay"
    assert N.extract(N.Mock(), " ", SCHEMA)[1] == "skipped"


def test_options():
    assert V.Options(chunk_size=10).size == 128 and V.Options().overlap == 76
    for bad in (V.Options(words_per_page=0), V.Options(execution="sync", priority="low"), V.Options(ocr="off", pdf_skip_local_processing=True), V.Options(translate_to="a b")):
        with pytest.raises(ValueError):
            bad.validate()


def test_columns(spark):
    row = spark.range(1).select(
        X.bcp47(F.lit("deu")).alias("a"), X.redact_keys(F.lit("key (sk-12345678) ok")).alias("b"), X.column_index(F.lit("AA10")).alias("c"), X.trim_unicode(F.lit(" x\t")).alias("d"),
        X.duration_ms(F.lit("5m")).alias("e"), X.size_bytes(F.lit("2KiB")).alias("f"), J.template({"a": "$.k.0", "b": "$$x"}, F.lit('{"k":[7]}')).alias("g"), X.words(F.lit("don't stop 3.14 now")).alias("h"),
    ).first()
    assert row.a == "de" and row.b == "key *** ok" and row.c == 26 and row.d == "x" and row.e == 300_000 and row.f == 2048 and json.loads(row.g) == {"a": 7, "b": "$x"} and row.h == 4


def test_files_and_archives(spark, tmp_path):
    df = spark.createDataFrame([("a/x.md", "one"), ("y.md", "two")], "name string, content string")
    sinks.write_files(df, str(tmp_path))
    assert (tmp_path / "a/x.md").read_text() == "one"
    assert zipfile.ZipFile(io.BytesIO(sinks.archive("n", "c", "s", {"de": "d"}))).namelist() == ["n.md", "summary.md", "n.de.md"]


def test_convert_and_extract(spark, tmp_path):
    docs = spark.createDataFrame([("a/one.md", "# Title\n\nSome words here.\n", "markdown"), ("a/one.md", "# Title\n\nSome words here.\n", "markdown"), ("b/empty.txt", "", "text")], "path string, text string, format string")
    rows = V.convert(docs).orderBy("path").collect()
    assert len(rows) == 3 and rows[0].title == "Title" and rows[0].words == 4 and rows[2].feature_status["summary"] == "skipped"
    (tmp_path / "p.html").write_text("<html><title>T</title><p>x</p>")
    got = P.extracted(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert got.title == "T" and got.content == "x\n" and got.error is None


def test_stream_of_jobs(spark, tmp_path):
    from folioforge.streaming import jobs

    rows = spark.createDataFrame([(1, "low", 1), (2, "normal", 2)], "job_id long, priority string, enqueued_at long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):  # the second start finds nothing new
        jobs.run(jobs.source(spark, str(tmp_path / "in"), rows.schema), lambda df, n: seen.extend(r.job_id for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [2, 1]


def test_cursors_and_signatures(spark):
    from folioforge.operators import oplog, signing

    log, seen, token = spark.range(1, 31).withColumnRenamed("id", "seq"), [], None
    while True:
        high, last = signing.opened(token, {"a": 1}, b"k") if token else (30, None)
        page = [r.seq for r in oplog.keyset_page(log, 7, high, last).collect()]
        seen += page[:7]
        if len(page) <= 7:
            break
        token = signing.cursor(high, page[6], {"a": 1}, b"k")
    assert seen == list(range(30, 0, -1))
    for bad, filters in ((token, {"a": 2}), (token[:-2] + "xx", {"a": 1}), ("", {"a": 1})):
        with pytest.raises(ValueError):
            signing.opened(bad, filters, b"k")
    assert signing.signature(1, b"x", b"k").startswith("sha256=") and signing.signature(1, b"x", b"k") != signing.signature(2, b"x", b"k")
