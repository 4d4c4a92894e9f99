import zlib

import pytest

from folioforge.sources import packages as P
from folioforge.sources import pdf
from folioforge.sources import transcribe as T

PROSE = "The orchard is pruned late in winter, before the sap rises again."


def stream(body, extra=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), extra, body)


def page_body(*lines):
    return b"BT /F1 12 Tf 72 700 Td " + b" ".join(b"(%s) Tj 0 -14 Td" % x.encode("cp1252") for x in lines) + b" ET"


def made(pages, extra=(), resources=b"<< /Font << /F1 4 0 R >> >>", packed=False, trailer=b""):
    """A PDF of content streams; objects from 100 on are `extra`. packed: catalog, tree and font in an object stream."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    core = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources %s >>" % (len(pages), kids, resources), 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    rest = {}
    for k, body in enumerate(pages):
        core[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        rest[11 + 2 * k] = stream(zlib.compress(body), b"/Filter /FlateDecode")
    rest |= {100 + k: x for k, x in enumerate(extra)}
    end = b"trailer << /Root 1 0 R %s >>" % trailer
    if packed:
        head, inner = b"", b""
        for n, x in core.items():
            head, inner = head + b"%d %d " % (n, len(inner)), inner + x + b" "
        core = {50: stream(zlib.compress(head + inner), b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(core), len(head))), 51: stream(b"", b"/Type /XRef /Root 1 0 R")}
        end = b""
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in (core | rest).items()) + end + b"\n%%EOF"


class Reader:
    def __init__(self, most=99):
        self.most, self.calls = most, []

    def transcribe(self, data, first, last):
        self.calls.append((first, last))
        return f"```markdown\nseen {first}-{last}\n```", last - first + 1 > self.most


@pytest.mark.parametrize("packed", [False, True])
def test_native_text(packed):
    data = made([page_body(PROSE, "It is raked in au-", "tumn (after rain)".replace("(", "\\(").replace(")", "\\)")), page_body(PROSE)], packed=packed)
    row = T.extract(data, "x.pdf")
    assert row["error"] is None and row["pages"] == 2 and not row["partial"]
    assert row["content"] == f"{PROSE} It is raked in autumn (after rain)\n\n{PROSE}\n\n"
    assert [s[1:] for s in row["segments"]] == [("page", 1, 1), ("page", 2, 2)] and row["content"][row["segments"][1][0] :].startswith("The")


def test_strings_and_maps():
    assert [x for _, x, _ in pdf.operations(rb"(a\(b\)\101\n(c)) <4 1 42> [1 -2.5 /N#41 << /K 3 0 R >>] Tj true")][0] == [b"a(b)A\n(c)", b"AB", [1, -2.5, "NA", {"K": 3}]]
    assert pdf.cmap(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0005> <0006> <0061> <0007> <0008> [<00e9> <0066006a>] endbfrange") == (2, {3: "A", 5: "a", 6: "b", 7: "é", 8: "fj"})
    mapped = made([b"BT /F1 9 Tf [<00030005> -300 <0007>] TJ 1 0 0 1 50 40 Tm <0008> Tj ET"], [stream(b"1 begincodespacerange <0000> <ffff> endcodespacerange 4 beginbfchar <0003> <0041> <0005> <0062> <0007> <00e9> <0008> <0078> endbfchar"), b"<< /Type /Font /Subtype /Type0 /ToUnicode 100 0 R >>"], b"<< /Font << /F1 101 0 R >> >>")
    one = pdf.Pdf(mapped)
    assert pdf.page_text(one, one.pages()[0]) == "Ab é\nx\n"


def test_scanned_pages():
    data = made([page_body(PROSE), b"", b"", page_body(PROSE), page_body("7")])
    assert T.extract(data)["error"][0] == "provider_not_configured"
    reader = Reader()
    row = T.extract(data, reader=reader)
    assert reader.calls == [(2, 3), (5, 5)] and row["content"] == f"{PROSE}\n\nseen 2-3\n\n{PROSE}\n\nseen 5-5\n\n"
    assert [s[2:] for s in row["segments"]] == [(1, 1), (2, 3), (4, 4), (5, 5)]
    row = T.extract(data, rules=T.Rules(ocr="off"))
    assert row["error"][0] == "scanned_pages" and "[(2, 3), (5, 5)]" in row["error"][1]
    row = T.extract(data, rules=T.Rules(ocr="off", allow_partial=True))
    assert row["partial"] and len(row["segments"]) == 5 and row["content"].endswith("7\n\n") and len(row["warnings"]) == 1
    reader = Reader(1)
    row = T.extract(data, rules=T.Rules(ocr="on", max_output_tokens=4000), reader=reader)
    assert reader.calls == [(1, 4), (1, 2), (1, 1), (2, 2), (3, 4), (3, 3), (4, 4), (5, 5)] and len(row["segments"]) == 5 and not row["partial"]
    row = T.extract(data, rules=T.Rules(ocr="on"), reader=Reader(0))
    assert row["partial"] and row["warnings"][0] == "page 1 transcription was truncated at the model output limit"


def test_refused_and_damaged():
    assert T.extract(made([page_body(PROSE)] * 3), rules=T.Rules(most_pages=2))["error"][0] == "too_many_pages"
    assert T.extract(made([page_body(PROSE)], trailer=b"/Encrypt << /V 1 >>"))["error"] == ("corrupt_document", "encrypted PDFs are not supported for native extraction", "extraction")
    assert T.extract(b"%PDF-1.4 nothing")["error"][0] == "corrupt_document"
    whole = made([page_body(PROSE)])
    for cut in range(20, len(whole), 7):
        T.extract(whole[:cut])
    assert T.extract(whole.replace(b"stream\nx", b"stream\ny"), reader=Reader())["content"] == "seen 1-1\n\n"


def test_unknown_filters_count_as_scanned():
    data = made([page_body(PROSE)]).replace(b"/Filter /FlateDecode", b"/Filter /LZWDecode  ")
    assert T.extract(data, rules=T.Rules(ocr="off"))["error"][0] == "scanned_pages"


def test_page_images():
    raw = bytes(range(256)) * 48
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x40\x00\x40" + bytes(400)
    size = b"/Subtype /Image /Width 64 /Height 64 /BitsPerComponent 8"
    rows = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(raw[k : k + 192], raw[k - 192 : k] if k else bytes(192), strict=True)) for k in range(0, len(raw), 192))
    extra = [
        stream(zlib.compress(raw), size + b"/ColorSpace /DeviceRGB /Filter /FlateDecode"), stream(jpeg, size + b"/ColorSpace /DeviceRGB /Filter /DCTDecode"),
        stream(b"fax", size + b"/ColorSpace /DeviceGray /Filter /CCITTFaxDecode"), stream(zlib.compress(rows), size + b"/ColorSpace [/ICCBased 104 0 R] /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors 3 /Columns 64 >>"),
        stream(b"icc", b"/N 3"),
    ]
    resources = b"<< /Font << /F1 4 0 R >> /XObject << /A 100 0 R /B 101 0 R /C 102 0 R /D 103 0 R >> >>"
    long = [PROSE] * 5
    data = made([page_body(*long), page_body(*long)], extra, resources)
    row = T.extract(data, rules=T.Rules(images=True))
    assert [x["ext"] for x in row["images"]] == ["png", "jpg"] and row["images"][0]["bytes"] == P.png(raw, 64, 64, 3) and row["images"][1]["bytes"] == jpeg
    assert row["content"].count("![image](images/") == 6 and row["warnings"] == ["2 PDF image(s) use an encoding that is not extracted"]
    assert [row["content"][s[0] :][:3] for s in row["segments"]] == ["The", "The"] and row["content"].index("![image]") < row["segments"][1][0]
    assert T.extract(made([page_body(PROSE)], extra, resources))["error"][0] == "provider_not_configured"  # little text beside images


def test_images_and_the_stage(spark):
    picture = P.png(bytes(40 * 40 * 3), 40, 40, 3)
    assert T.extract(picture, reader=Reader())["content"] == "seen 1-1" and T.extract(picture, rules=T.Rules(ocr="off"))["error"][0] == "ocr_required"
    assert T.extract(picture, rules=T.Rules(most_pixels=99), reader=Reader())["error"][0] == "image_too_large"
    from folioforge.operators.enrich import Mock

    files = spark.createDataFrame([("a.pdf", made([page_body(PROSE), b""])), ("b.png", picture), ("c.txt", b"plain"), ("d.pdf", b"%PDF-")], "path string, content binary")
    got = {r.path: r for r in T.extracted(files, reader=Mock()).collect()}
    assert got["a.pdf"].content == f"{PROSE}\n\nMock pages 2 to 2\n\n" and got["b.png"].pages == 1 and got["c.txt"].content == "plain" and got["d.pdf"].error.code == "corrupt_document"
