import gzip
import io
import json
import struct
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from folioloom.plans import facade
from folioloom.sinks.store import ObjectStore, VectorStore, inspect, kind
from folioloom.sources import media, office, parse, readers, routing
from folioloom.streaming import streams


def kinds(found):
    return [(x["type"], x["content"]) for x in found]


def test_text():
    got = list(parse.parse_text("第一行文本\n第二行文本\n\n  第四行文本 "))
    assert [(x["content"], x["start_line"]) for x in got] == [("第一行文本", 1), ("第二行文本", 2), ("第四行文本", 4)]


def test_csv():
    (t,) = parse.parse_csv("a;b;;\n1;2;;\n;;;\n3; x ;;\n")
    assert t["content"] == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | x |" and t["end_line"] == 3 and t["metadata"]["delimiter"] == ";"
    assert list(parse.parse_csv("\n \n")) == []


def test_json():
    got = list(parse.parse_json(json.dumps({"a": {"b": 1}, "l": [1, "x", {"k": None}], "t": [{"p": 1}, {"q": 2}], "e": []})))
    assert [(x["content"].split("\n")[0], x["selector"]) for x in got] == [("b: 1", "$.a.b"), ("1", "$.l[0]"), ("x", "$.l[1]"), ("k: None", "$.l[2].k"), ("| p | q |", "$.t")]
    assert got[4]["content"].split("\n")[2:] == ["| 1 |  |", "|  | 2 |"]
    assert kinds(parse.parse_json("3")) == [("text", "3")]


def test_html():
    html = (
        "<html><head><title> T </title></head><body><nav>dropped <a>x</a></nav><h1> A <b>b</b></h1><div id='m'><p>one <i>two</i><img src='i.png' alt=''></p><p></p></div>"
        "<ul><li>x</li><li> </li></ul><ol><li>y<ul><li>z</li></ul></li></ol><table><tr><th>h</th></tr><tr><td>1</td></tr></table>"
        "<pre><code class='a language-py'>x &lt; 1\n</code></pre><blockquote>q<br>r</blockquote><hr><script>var p='</p>';</script></body></html>"
    )
    got = list(parse.parse_html(html))
    assert kinds(got) == [
        ("heading", "A b"), ("image", "i.png"), ("paragraph", "one two"), ("list_item", "x"), ("list_item", "y z"), ("table", "| h |\n| --- |\n| 1 |"), ("code", "x < 1\n"), ("blockquote", "q\nr"), ("hr", "---"),
    ]
    assert got[2]["selector"] == "div#m > p:nth-of-type(1)" and got[0]["selector"] == "html > body > h1" and got[6]["metadata"]["language"] == "py"
    assert parse.html_title(html) == "T"
    # An unclosed paragraph holds what follows up to its own end.
    assert kinds(parse.parse_html("<p><b>a<br><p>b</p><p>c</p>")) == [("paragraph", "a b c")]
    assert kinds(parse.parse_html("")) == []


MARKDOWN = """# Title *one*

Intro **bold** and `code`
second line.

---

> quoted
> text

- item one
- item two
  - nested

3. three
4. four

```python
x = 1

y = 2
```

    indented

![alt](src.png "t") after

| a | b |
| --- | :-: |
| 1 | 2 |
| 3 |

<div>
html
</div>

Setext
======
"""


def test_markdown():
    got = list(parse.parse_markdown(MARKDOWN))
    assert kinds(got) == [
        ("heading", "Title one"), ("text", "Intro bold and code\nsecond line."), ("hr", "---"), ("blockquote", "quoted\ntext"), ("list_item", "item one"), ("list_item", "item two"), ("list_item", "nested"),
        ("list_item", "three"), ("list_item", "four"), ("code", "x = 1\n\ny = 2\n"), ("code", "indented\n"), ("image", "alt"), ("text", "after"), ("table", "a | b\n--- | ---\n1 | 2\n3 | "), ("html", "<div>\nhtml\n</div>"), ("heading", "Setext"),
    ]
    assert (got[0]["start_line"], got[0]["end_line"], got[0]["level"]) == (1, 1, 1) and (got[1]["start_line"], got[1]["end_line"]) == (3, 4)
    assert got[7]["metadata"] == {"ordered": True, "start": 3} and got[9]["metadata"] == {"language": "python"} and "start_line" not in got[11] and got[13]["metadata"]["headers"] == ["a", "b"]
    assert [(x["type"], x["start_line"]) for x in parse.parse_markdown("# 标题一\n\n这是一个段落内容。\n\n- 列表项1\n- 列表项2")] == [("heading", 1), ("text", 3), ("list_item", 5), ("list_item", 6)]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t> n </t></is></c></row><row r="2"/><row r="3"><c r="B3"><v>2.5</v></c></row><row r="4"><c r="A4" t="b"><v>1</v></c><c r="D4"/></row>'
    data = zipped({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="员工" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel, "xl/sharedStrings.xml": f"<sst {s}><si><t>a</t><t>b</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>"})
    (t,) = office.parse_xlsx(data)
    assert t["content"] == "| ab | n |\n| --- | --- |\n|  | 2.5 |\n| True |  |" and t["selector"] == "员工!A1:B3"


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=%s/></w:pPr>' % chr(34).join(['', style, '']) if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('h')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl>"
    styles = f'<w:styles {w}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    got = list(office.parse_docx(zipped({"word/document.xml": f"<w:document {w}><w:body>{p('Top', 'H1')}{table}{p(' ')}{p('body')}</w:body></w:document>", "word/styles.xml": styles})))
    assert kinds(got) == [("heading", "Top"), ("paragraph", "body"), ("table", "| h |\n| --- |\n| 1 |")] and got[1]["selector"] == "body > p[3]"


def test_pptx():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>'
    box = '<a:xfrm><a:off x="0" y="100"/><a:ext cx="500" cy="400"/></a:xfrm>'
    text = lambda t, b="": f"<p:txBody><a:p><a:r><a:rPr{b}/><a:t>{t}</a:t></a:r></a:p></p:txBody>"
    shapes = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr>{box}</p:spPr>{text("Title")}</p:sp><p:grpSp><p:sp><p:spPr/>{text("in", " b=%s1%s" % (chr(34), chr(34)))}</p:sp></p:grpSp>'
    shapes += f'<p:graphicFrame><p:xfrm><a:off x="0" y="0"/><a:ext cx="1000" cy="1000"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc>{text("h").replace("p:txBody", "a:txBody")}</a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    deck = f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst><p:sldSz cx="1000" cy="1000"/></p:presentation>'
    got = list(office.parse_pptx(zipped({"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rel, "ppt/slides/slide1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"})))
    assert kinds(got) == [("heading", "Title"), ("paragraph", "in"), ("table", "| h |\n| --- |")]
    assert got[0]["bbox"] == [0.0, 0.1, 0.5, 0.5] and got[1]["raw_content"] == "<b>in</b>" and got[2]["page_number"] == 1


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9)
    assert media.image_size(png) == ("PNG", 7, 9) and media.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("GIF", 3, 4)
    assert media.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 8) == ("JPEG", 6, 5)
    with pytest.raises(ValueError):
        media.image_size(b"nothing")
    assert [x["start_time"] for x in media.segments([(0.123, 1.0, " hi "), (1, 2, " ")])] == [0.12]


def test_what_images_say():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 7, 9, 8, 6) + b"\0" * 8
    (got,) = media.parse_image(png, "a.png")
    assert got["content"] == "Image: a.png (7x9, PNG, RGBA)" and got["metadata"]["file_size_bytes"] == len(png) and "exif" not in got["metadata"]
    words = b"A camera\0"
    inner = struct.pack("<HHHIHHHHII", 2, 34855, 3, 1, 200, 0, 33434, 5, 1, 0) + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<IH", 8, 3) + struct.pack("<HHII", 271, 2, len(words), 50) + struct.pack("<HHIHH", 274, 3, 1, 6, 0) + struct.pack("<HHII", 34665, 4, 1, 60)
    tiff = (tiff.ljust(50, b"\0") + words).ljust(60, b"\0") + inner
    app1 = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", 5, 6, 1) + b"\0" * 8
    (got,) = media.parse_image(jpeg, "b.jpg")
    assert got["content"] == "Image: b.jpg (6x5, JPEG, L)"
    assert got["metadata"]["exif"] == {"Make": "A camera", "Orientation": "6", "ExifOffset": "60", "ISOSpeedRatings": "200"}
    assert media.exif(jpeg[:30]) == {} and media.image_mode(b"GIF89a" + struct.pack("<HH", 3, 4)) == "P"
    bmp = b"BM" + b"\0" * 16 + struct.pack("<iiHH", 2, 3, 1, 24)
    assert media.image_mode(bmp) == "RGB"


def test_folder_and_failures(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "doc1.txt").write_text("hello\nworld", encoding="utf-8")
    (tmp_path / "sub" / "doc2.json").write_text('{"a": 1}', encoding="utf-8")
    (tmp_path / "sub" / "bad.json").write_text("{", encoding="utf-8")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / ".git" / "dummy.txt").write_text("no", encoding="utf-8")
    (tmp_path / "other.bin").write_bytes(b"x")
    found, failed = readers.load_batch(spark, str(tmp_path))
    assert sorted((r.file_name, r.content) for r in found.collect()) == [("doc1.txt", "hello"), ("doc1.txt", "world"), ("doc2.json", "a: 1")]
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in failed.collect()) == ["bad.json", "scan.pdf"]


def test_folder_with_names_that_spark_passes_by(spark, tmp_path):
    for name in ("a.txt", "_intro.txt", "_posts/p.txt", ".note.txt", "sub/.deep/q.txt", "sub/_x.txt", ".venv/no.txt", "sub/.git/no.txt", "_posts/.idea/no.txt", "_bad.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{" if "bad" in name else name, encoding="utf-8")
    found, failed = readers.load_batch(spark, str(tmp_path))
    assert sorted(r.content for r in found.collect()) == [".note.txt", "_intro.txt", "_posts/p.txt", "a.txt", "sub/.deep/q.txt", "sub/_x.txt"]
    assert [r.file_path.rsplit("/", 1)[1] for r in failed.collect()] == ["_bad.json"]
    assert sorted(r.name for r in readers.files(spark, str(tmp_path), recursive=False).collect()) == [".note.txt", "_bad.json", "_intro.txt", "a.txt"]
    assert readers.load_batch(spark, str(tmp_path / "_intro.txt"))[0].first().content == "_intro.txt"


def test_texts_that_fail_and_deep_pages(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None)], "id long, t string")
    found, failed = readers.parse_texts(rows, "json", "id", "t")
    assert [r.content for r in found.collect()] == ["a: 1"] and sorted(r.file_path for r in failed.collect()) == ["2", "3"]
    deep = "<div>" * 20_000 + "<p>at the bottom</p>" + "</i>" * 20_000
    pages = spark.createDataFrame([(1, deep), (2, "<p>x</p>" * 20_000)], "id long, t string")
    found, failed = readers.parse_texts(pages, "html", "id", "t")
    assert failed.count() == 0 and {(r.doc_id, r["count"]) for r in found.groupBy("doc_id").count().collect()} == {("1", 1), ("2", 20_000)}
    assert list(parse.parse_html(deep))[0]["selector"].startswith("div > div")


def test_archives(spark, tmp_path):
    good = tmp_path / "a.zip"
    good.write_bytes(zipped({"zip_doc1.txt": "one", "folder/zip_doc2.txt": "two", "__pycache__/x.txt": "no"}))
    found, failed = readers.load_batch(spark, str(good))
    assert sorted((r.doc_id, r.content) for r in found.collect()) == [("a.zip/folder/zip_doc2.txt", "two"), ("a.zip/zip_doc1.txt", "one")] and failed.count() == 0
    evil = tmp_path / "evil.zip"
    evil.write_bytes(zipped({"../../x.txt": "no"}))
    found, failed = readers.load_batch(spark, str(evil))
    assert found.count() == 0 and "unsafe" in failed.first().error
    tar = tmp_path / "t.tar.gz"
    with tarfile.open(tar, "w:gz") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 5
        t.addfile(info, io.BytesIO(b"tared"))
    (tmp_path / "note.txt.gz").write_bytes(gzip.compress(b"zipped"))
    assert readers.load_batch(spark, str(tar))[0].first().content == "tared"
    assert readers.load_batch(spark, str(tmp_path / "note.txt.gz"))[0].first().content == "zipped"
    with pytest.raises(ValueError):
        readers.load_batch(spark, "http://example.org/a.txt")


def test_routing(spark):
    assert len(routing.supported_extensions()) == 33 or len(routing.FORMATS) == len(routing.supported_extensions())
    df = spark.createDataFrame([("a/B.TXT",), ("x.tar.gz",), (".git",), ("n",), ("v.webm",)], "p string")
    assert [tuple(r) for r in df.select(routing.extension(F.col("p")), routing.file_format(F.col("p"))).collect()] == [(".txt", "txt"), (".gz", None), ("", None), ("", None), (".webm", "video")]


def test_text_elements_like_parser(spark):
    texts = {"a": "x\n\n y \r\nz\x0bw", "b": "", "c": None}
    got = readers.text_elements(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).orderBy("doc_id", "element_idx").collect()
    assert [(r.doc_id, r.content, r.location.start_line) for r in got] == [("a", x["content"], x["start_line"]) for x in parse.parse_text(texts["a"])]


def test_ingest_and_search(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "alpha beta gamma\ndelta epsilon"), ("d2", "something else entirely")], "doc_id string, text string")
    store = VectorStore(spark, str(tmp_path / "kb"), "faiss")
    assert facade.ingest(readers.text_elements(docs), store, "kb1") == (2, 2)
    assert facade.ingest(readers.text_elements(docs), store, "kb1", once=True) == (2, 0)
    assert facade.ingest(readers.text_elements(docs), store, "kb1") == (2, 2)
    top = facade.search(store, "kb1", "something else entirely", 2).collect()
    assert top[0].page_content == "something else entirely" and round(top[0].score, 6) == 1.0
    assert facade.search(store, "missing", "x").count() == 0 and inspect(store.read("kb1")).first().dimension == 1536
    with pytest.raises(ValueError):
        store.read("../evil")
    assert kind("postgres") == "pgvector" and kind("unheard of") == "chroma"


def test_object_store(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "objects"))
    put = lambda *rows: store.put(spark.createDataFrame(list(rows), "key string, value string"))
    put(("a", "1"), ("b/c", "2"))
    time.sleep(0.01)
    put(("a", "3"))
    time.sleep(0.01)
    store.delete(spark.createDataFrame([("b/c",)], "key string"))
    assert {r.key: r.value for r in store.get().collect()} == {"a": "3"}
    put(("t", "1"), ("t", "2"))
    assert store.get_one("t") == "2" and store.get_one("b/c") is None and store.get_one("none") is None
    assert store.exists("a") and not store.exists("b/c") and not store.exists("none")
    with pytest.raises(Exception, match="no object key"):
        put(("../x", "1"))


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "call 13812345678 now\n.."), ("d2", "text of two")], "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "landing"))
    store = VectorStore(spark, str(tmp_path / "kb"))
    stream = streams.cleaned(streams.elements(spark, str(tmp_path / "landing")))
    for _ in range(2):  # a second run finds nothing new
        streams.ingest(stream, store, "live", str(tmp_path / "checkpoint")).awaitTermination(120)
    got = sorted(r.page_content for r in store.read("live").collect())
    assert got == ["call 138****5678 now", "text of two"]
