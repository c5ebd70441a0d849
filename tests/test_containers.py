import io
import zipfile

from pyspark.sql import functions as F

from inkstone.functions.search import find_previous
from inkstone.sources.archives import archive_members
from inkstone.sources.containers import charset, container_texts, unescape

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, text in members.items():
            file.writestr(name.replace("__", "/").replace("_D_", "."), text)
    return out.getvalue()


DOCX = packed(
    word__document_D_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>漢</w:t><w:tab/><w:t>字</w:t><w:br/></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    word__footnotes_D_xml=f'<w:footnotes {W}><w:footnote w:type="separator" w:id="-1"><w:p><w:r><w:t>no</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    word__header2_D_xml=f"<w:hdr {W}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>",
)
ODT = packed(
    content_D_xml='<o xmlns:text="t" xmlns:table="b"><text:h>甲</text:h><text:p>x<text:s text:c="3"/>y<text:tab/>z<text:line-break/></text:p>'
    "<table:table-row><table:table-cell><text:p>1</text:p></table:table-cell><table:table-cell><text:p>2</text:p></table:table-cell></table:table-row></o>"
)
EPUB = packed(**{
    "META-INF__container_D_xml": '<container><rootfiles><rootfile full-path="OPS/a.opf"/></rootfiles></container>',
    "OPS__a_D_opf": '<package><manifest><item id="n" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c" href="../OPS/c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="c"/><itemref idref="none"/></spine></package>',
    "OPS__n_D_xhtml": "<html><body>nav</body></html>",
    "OPS__c_D_xhtml": "<html><head><title>t</title></head><body><h1>One</h1><p>a­  b&nbsp;c<br/>d</p>\n<script>x</script><p>e</p></body></html>",
})


def texts(spark, *files, **more):
    df = spark.createDataFrame(list(files), "path string, content binary")
    return {r.path: (r.kind, r.text, r.error) for r in container_texts(df, **more).collect()}


def test_texts(spark):
    got = texts(spark, ("a.docx", DOCX), ("b.odt", ODT), ("c.epub", EPUB))
    assert got["a.docx"] == ("docx", "漢\t字\n\na\tb\nnote\nhead\n", None)
    assert got["b.odt"] == ("odt", "甲\nx   y\tz\n\n1\t2\n", None)
    assert got["c.epub"] == ("epub", "One\n\nab c\nd\n\ne\n\n".replace("ab", "a b"), None)
    assert texts(spark, ("a.docx", DOCX), headings=True)["a.docx"][1].startswith("=== word/document.xml ===\n漢")


def test_errors_stay_with_their_files(spark):
    cut = bytearray(ODT)
    cut[60] ^= 0xFF  # within the member's data, so that its checksum is wrong
    no_root = packed(**{"META-INF__container_D_xml": "<container/>"})
    rows = [("a.DOCX", DOCX), ("b.odt", ODT), ("c.epub", EPUB), ("d.epub", b"no zip"), ("e.txt", DOCX), ("f.odt", None), (None, ODT), ("g.docx", packed(word__document_D_xml="<")), ("h.odt", bytes(cut)), ("i.epub", no_root)]
    got = texts(spark, *rows)
    kinds = {k: v[0] for k, v in got.items()}
    assert kinds == {"a.DOCX": "docx", "b.odt": "odt", "c.epub": "epub", "d.epub": None, "e.txt": None, "f.odt": None, None: None, "g.docx": "docx", "h.odt": "odt", "i.epub": "epub"}
    assert got["g.docx"][1:] == (None, "not well formed: word/document.xml")
    assert got["b.odt"][1].startswith("甲\n")
    assert got["d.epub"][2].startswith("BadZipFile") and got["h.odt"][1] is None and got["h.odt"][2] and got["i.epub"][1:] == (None, "no rootfile")
    assert got["e.txt"] == (None, None, None)


def test_members_keep_their_order(spark):
    names = [f"m{k * 7 % 10}.xml" for k in range(10)] + ["m3.xml"]
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as file:
        for k, n in enumerate(names):
            file.writestr(n, str(k))
        file.writestr("folder/", "")
    df = spark.createDataFrame([("x.zip", body.getvalue())], "path string, content binary")
    got = archive_members(df, r"\.xml$").collect()
    assert [r.member for r in sorted(got, key=lambda r: r.ordinal)] == names and all(r.error is None for r in got)
    assert [bytes(r.content).decode() for r in sorted(got, key=lambda r: r.ordinal)[:3]] == ["0", "1", "2"]


def test_nested_tables_and_markup(spark):
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>i1</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl>"
    xml = f'<?xml version="1.0"?><w:document {W}><w:body><!-- <w:t>no</w:t> --><w:tbl><w:tr><w:tc><w:p><w:t>x &gt; y&#x6F22;&amp;lt;</w:t></w:p>{inner}<w:p/></w:tc><w:tc><w:p><w:t xml:space="preserve"> z </w:t></w:p></w:tc></w:tr><w:tr/></w:tbl><w:p><w:t><![CDATA[<a>&amp;]]></w:t><w:cr/></w:p></w:body></w:document>'
    got = texts(spark, ("a.docx", packed(word__document_D_xml=xml, word__Header1_D_XML="<x><t>H</t></x>")))
    assert got["a.docx"] == ("docx", "x > y漢&lt;\ni1\t\t z \n\n<a>&amp;\n\nH\n", None)
    odt = packed(content_D_xml='<?xml version="1.0"?>\n<o xmlns:text="t" xmlns:table="b"><table:table-row>\n <table:table-cell/> <table:table-cell><text:p>a</text:p>\n</table:table-cell>\n</table:table-row><text:p>&#128512;<text:s/>&nope;&#0;</text:p></o>'.replace("&nope;", ""), mimetype="application/vnd.oasis.opendocument.text")
    assert texts(spark, ("b.odt", odt))["b.odt"][0] == "odt"
    wrong = packed(content_D_xml="<o/>", mimetype="application/zip")
    assert texts(spark, ("b.odt", wrong))["b.odt"] == (None, None, None)


def test_references(spark):
    df = spark.createDataFrame([("a &amp;lt; &#65;&#x1F600; &eacute;&unknown; & &#1114112; &#xD800;",), ("none",)], "t string")
    assert [r[0] for r in df.select(unescape(F.col("t"))).collect()] == ["a &lt; A\U0001f600 é&unknown; & &#1114112; &#xD800;", "none"]


def test_charset():
    assert [charset(x) for x in ("utf8", " CP936", "cp950", "Big5-HKSCS", None)] == ["UTF-8", "GBK", "Big5", "Big5-HKSCS", "UTF-8"]


def test_find_previous(spark):
    df = spark.createDataFrame([("ab ab ab",), ("none",), ("",), (None,)], "t string")
    got = lambda c, **k: [tuple(r[0]) for r in df.select(find_previous(F.col("t"), "AB", c, match_case=False, **k)).collect()]
    assert got(5) == [("FOUND", 3), ("NO_MATCH", -1), ("NO_MATCH", -1), ("NO_MATCH", -1)]
    assert got(1)[0] == ("WRAPPED", 6) and got(2)[0] == ("FOUND", 0)
