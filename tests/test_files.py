import io
import struct
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievelake.functions import images, metadata
from sievelake.functions.metadata import CorruptFile, clean, inspect
from sievelake.operators import files
from sievelake.operators.images import detect_images, read_images
from sievelake.options import MetadataOptions, load_config
from sievelake.plans.queries import queries
from sievelake.sources import sink
from sievelake.sources.files import classify, list_files, output_path, read_files, read_texts, write_texts

O = MetadataOptions()  # noqa: E741


def chunk(kind, body=b""):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*more, pixels=None):
    rows = pixels if pixels is not None else np.zeros((1, 1, 4), np.uint8)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 6, 0, 0, 0)
    return metadata.PNG_SIGN + chunk(b"IHDR", head) + b"".join(more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND")


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*more):
    return b"\xff\xd8" + b"".join(more) + segment(0xDA, b"\0" * 6) + b"scan\xff\x00data\xff\xd9"


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind, body=b"", large=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if large else struct.pack(">I4s", len(body) + 8, kind) + body


def heif(*children):
    return box(b"ftyp", b"heic\0\0\0\0mif1heic") + box(b"meta", bytes(4) + box(b"hdlr", bytes(20)) + b"".join(children)) + box(b"mdat", b"image")


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_0", "."), body)
    return out.getvalue()


CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Ann</dc:creator><dc:title>T</dc:title><cp:lastModifiedBy>Bob</cp:lastModifiedBy></cp:coreProperties>'
OPF = '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier>id</dc:identifier><dc:creator>Ann</dc:creator><meta property="p">v</meta></metadata></package>'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    return package({"[Content_Types].xml": '<Types><Override PartName="/docProps/app.xml" ContentType="x"/></Types>', "docProps/core.xml": CORE, "docProps/app.xml": "<a/>", "word/document.xml": "<w:document><w:ins >x</w:ins></w:document>"})


def epub():
    return package({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>', "c.opf": OPF, "text.html": "kept"})


FILES = [
    (".jpg", jpeg(segment(0xE0, b"JFIF\0"), segment(0xE1, b"Exif\0\0x"), segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0x"), segment(0xED, b"Photoshop"), segment(0xE2, b"ICC_PROFILE\0"), segment(0xFE, b"hi ")), [("EXIF", "APP1/Exif"), ("XMP", "APP1/XMP"), ("IPTC", "APP13/Photoshop"), ("COM", "Comment")]),
    (".png", png(chunk(b"tEXt", b"Author\0A"), chunk(b"eXIf", b"x"), chunk(b"tIME", bytes(7)), chunk(b"iCCP", b"x")), [("XMP/Text", "tEXt"), ("EXIF", "eXIf"), ("PNG", "tIME")]),
    (".webp", webp((b"VP8X", b"\x2c" + bytes(9)), (b"EXIF", b"abc"), (b"XMP ", b"x"), (b"ICCP", b"x"), (b"VP8 ", b"data")), [("EXIF", "EXIF"), ("XMP", "XMP ")]),
    (".heic", heif(box(b"Exif", b"secret"), box(b"uuid", metadata.EXIF_UUID + b"secret"), box(b"uuid", metadata.XMP_UUID + b"x"), box(b"uuid", bytes(16)), box(b"colr", b"nclx"), box(b"colr", b"prof"), box(b"mime", b"Application/rdf+xml\0x", large=True)), [("EXIF", "Exif"), ("EXIF", "uuid/EXIF"), ("XMP", "uuid/XMP"), ("XMP", "mime/XMP")]),
    (".mp4", box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"x") + box(b"udta", b"secret") + box(b"meta", bytes(4) + box(b"keys", b"k") + box(b"ilst", b"secret"))) + box(b"udta", b"y") + box(b"mdat", b"film"), [("USER_DATA", "udta"), ("QUICKTIME_META", "keys"), ("QUICKTIME_META", "ilst"), ("USER_DATA", "udta")]),
    (".html", b'<html><head><meta charset="utf-8"><META Name="Author" content="A"><meta property="article:author" content="B"><!-- c --></head><body><xmp>x<b>y</b></xmp><dc:title>t</dc:title>z</body></html>', [("HTML/meta", "Author"), ("HTML/meta", "article:author"), ("XMP", "xmp"), ("RDF/DC", "dc:title")]),
    (".rtf", rb"{\rtf1{\info{\title My \'e9 doc}{\author Ann}{\creatim\yr2024\mo1\dy15}\version2}{\b bold \\ }}", [("RTF/info", "title"), ("RTF/info", "author"), ("RTF/info", "creatim"), ("RTF/info", "version")]),
    (".docx", docx(), [("Core", "Creator"), ("Core", "Title"), ("Core", "LastModifiedBy"), ("Extended", "app.xml"), ("Revisions", "TrackedChanges")]),
    (".xlsx", package({"[Content_Types].xml": "<Types/>", "docProps/core.xml": CORE, "xl/comments1.xml": "<c/>", "xl/persons/p.xml": "<p/>"}), [("Core", "Creator"), ("Core", "Title"), ("Core", "LastModifiedBy"), ("Comments", "WorksheetComments+ThreadedComments"), ("Comments", "CommentAuthorsPart")]),
    (".epub", epub(), [("OPF/dc", "identifier"), ("OPF/dc", "creator"), ("OPF/meta", "p")]),
]


@pytest.mark.parametrize("ext,data,entries", FILES, ids=[f[0] for f in FILES])
def test_inspect_and_clean(ext, data, entries):
    assert [e[:2] for e in inspect(data, ext)] == entries
    out, gone = clean(data, ext, O)
    left = {e[:2] for e in inspect(out, ext)}
    assert left <= {("Revisions", "TrackedChanges"), ("OPF/dc", "identifier"), ("Comments", "WorksheetComments+ThreadedComments"), ("Comments", "CommentAuthorsPart")}
    assert b"secret" not in out and clean(out, ext, O)[0] == out or ext == ".epub"
    if ext in (".heic", ".mp4"):
        assert len(out) == len(data) and out[-5:] == data[-5:]
    if ext == ".jpg":
        assert out.endswith(b"scan\xff\x00data\xff\xd9") and b"ICC_PROFILE" in out
        assert b"ICC_PROFILE" not in clean(data, ext, MetadataOptions(preserve_color_profile=False))[0]
    if ext == ".webp":
        assert out[20] == 0x20 and struct.unpack("<I", out[4:8])[0] == len(out) - 8


def test_provenance_manifests_are_listed_and_kept():
    for ext, data in ((".png", png(chunk(b"caBX", b"manifest"))), (".jpg", jpeg(segment(0xEB, b"JP manifest")))):
        assert [e[0] for e in inspect(data, ext)] == ["C2PA"]
        assert clean(data, ext, O)[0] == data


@pytest.mark.parametrize("ext,data", [(".png", png()[:50]), (".png", b"x"), (".jpg", b"GIF"), (".webp", webp((b"EXIF", b"abc"))[:-3]), (".heic", heif()[:60]), (".docx", b"PK"), (".epub", docx()), (".rtf", b"{x"), (".pdf", b"x"), (".mp4", b"")])
def test_corrupt(ext, data):
    with pytest.raises(CorruptFile):
        inspect(data, ext)


def test_pdf():
    data = b"%PDF-1.4\n1 0 obj<</Author (A \\(x\\))/Title <feff0041>/Producer ()>>endobj <?xpacket begin=''?>"
    assert inspect(data, ".pdf") == [("Info", "Title", "A"), ("Info", "Author", "A (x)"), ("XMP", "XMP", "Embedded XMP metadata packet")]
    with pytest.raises(LookupError):
        clean(data, ".pdf", O)


def test_pdf_text_is_no_field():
    page = b"%PDF-1.4\n1 0 obj<</ModDate (D:2024)>>endobj 2 0 obj<</Length 30>>stream\nsee /Author (Mallory)\nendstream\n3 0 obj<</Type/Metadata>>stream\n<?xpacket?>\nendstream"
    assert inspect(page, ".pdf") == [("Info", "ModifiedDate", "D:2024"), ("XMP", "XMP", "Embedded XMP metadata packet")]


def test_pdf_streams_are_read_whole():
    """Fields far into a large stream, behind a long dictionary, over the end of a step, and in what a damaged stream still gives."""
    pad = b"x" * 3_000_000
    stream = lambda body, more=b"": b"5 0 obj<<" + more + b"/Filter/FlateDecode>>stream\n" + zlib.compress(body) + b"\nendstream endobj\n"
    assert inspect(b"%PDF-1.4\n" + stream(pad + b"/Author (Ann)", b"/X (" + b"y" * 5000 + b")"), ".pdf") == [("Info", "Author", "Ann")]
    assert inspect(b"%PDF-1.4\n" + stream(pad[: (1 << 20) - 8] + b"/Author (Ann)"), ".pdf") == [("Info", "Author", "Ann")]
    assert inspect(b"%PDF-1.4\n" + stream(b"/Author (Ann)" + np.random.default_rng(0).bytes(200_000))[:-90_000], ".pdf") == [("Info", "Author", "Ann")]
    assert inspect(b"%PDF-1.4\n1 0 obj<</Title <414>>>", ".pdf") == [("Info", "Title", "A@")]


@pytest.mark.parametrize("ext,data", [(f[0], f[1]) for f in FILES] + [(".pdf", b"%PDF-1.4\n1 0 obj<</Author (A)/Title <feff0041>>>endobj 2 0 obj<</Filter/FlateDecode>>stream\n" + zlib.compress(b"/Creator (x)") + b"\nendstream")])
def test_damaged_bytes_give_rows(ext, data):
    """Whatever the bytes, a reader and a cleaner end well or say that the file is damaged."""
    rng = np.random.default_rng(len(data))
    for _ in range(150):
        bad = bytearray(data)
        for at in rng.integers(0, len(bad), rng.integers(1, 12)):
            bad[at] = rng.integers(256)
        bad = bytes(bad[: rng.integers(len(bad))] if rng.random() < 0.3 else bad)
        for run in (inspect, lambda d, e: clean(d, e, MetadataOptions(strip_comments=True, accept_revisions=True))):
            try:
                run(bad, ext)
            except (CorruptFile, LookupError):
                pass


def test_encrypted_and_endless_archives_are_damaged():
    data = bytearray(docx())
    for at in (data.find(b"PK\x03\x04") + 6, data.find(b"PK\x01\x02") + 8):
        data[at] |= 1
    z = zipfile.ZipFile(io.BytesIO(bytes(data)))
    with pytest.raises(RuntimeError):
        z.read(z.namelist()[0])
    with pytest.raises(CorruptFile):
        clean(bytes(data), ".docx", O)
    deep = "<a>" * 100_000 + "</a>" * 100_000
    with pytest.raises(CorruptFile):
        clean(package({"[Content_Types].xml": "<Types/>", "word/document.xml": deep}), ".docx", MetadataOptions(accept_revisions=True))


WORDS = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="urn:x"><w:body><w:p w:rsidR="00A1" w14:id="7"><w:commentRangeStart w:id="0"/><w:ins w:author="Ann"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:author="Ann"><w:r><w:delText>old</w:delText></w:r></w:del><w:moveTo><w:r><w:t>moved</w:t></w:r></w:moveTo><w:moveFrom><w:r><w:t>gone</w:t></w:r></w:moveFrom><w:r><w:t>kept</w:t></w:r><w:commentRangeEnd w:id="0"/></w:p></w:body></w:document>'


def test_comments_and_revisions_go_if_asked():
    rels = '<Relationships><Relationship Id="1" Target="comments.xml"/><Relationship Id="2" Target="styles.xml"/><Relationship Id="3" Target="people.xml"/></Relationships>'
    data = package({"[Content_Types].xml": '<Types><Override PartName="/word/comments.xml" ContentType="x"/><Override PartName="/word/styles.xml" ContentType="x"/></Types>', "word/document.xml": WORDS, "word/comments.xml": "<c/>", "word/people.xml": "<p>Ann</p>", "word/styles.xml": "<s/>", "word/_rels/document.xml.rels": rels})
    parts = lambda d: {n: zipfile.ZipFile(io.BytesIO(d)).read(n).decode() for n in zipfile.ZipFile(io.BytesIO(d)).namelist()}
    assert parts(clean(data, ".docx", O)[0])["word/document.xml"] == WORDS
    out = parts(clean(data, ".docx", MetadataOptions(strip_comments=True))[0])
    assert not {"word/comments.xml", "word/people.xml"} & set(out) and "comment" not in out["word/document.xml"] and "old" in out["word/document.xml"]
    assert "comments" not in out["[Content_Types].xml"] + out["word/_rels/document.xml.rels"] and "styles.xml" in out["word/_rels/document.xml.rels"]
    out, gone = clean(data, ".docx", MetadataOptions(accept_revisions=True))
    body = parts(out)["word/document.xml"]
    assert [x in body for x in ("new", "moved", "kept", "old", "gone", "Ann", "rsid", "w14:id")] == [True] * 3 + [False] * 4 + [True]
    assert [e[0] for e in gone] == ["Revisions"] and inspect(out, ".docx") == []
    sheet = package({"[Content_Types].xml": "<Types/>", "xl/comments1.xml": "<c/>", "xl/threadedComments/t.xml": "<c/>", "xl/persons/p.xml": "<p/>", "xl/worksheets/s.xml": "<s/>", "xl/worksheets/_rels/s.xml.rels": '<R><Relationship Target="../comments1.xml"/></R>'})
    out, gone = clean(sheet, ".xlsx", MetadataOptions(strip_comments=True))
    assert set(parts(out)) == {"[Content_Types].xml", "xl/worksheets/s.xml", "xl/worksheets/_rels/s.xml.rels"} and "comments1" not in parts(out)["xl/worksheets/_rels/s.xml.rels"] and len(gone) == 2
    slides = package({"[Content_Types].xml": "<Types/>", "ppt/comments/c.xml": "<c/>", "ppt/commentAuthors.xml": "<c/>", "ppt/slides/s.xml": "<s/>"})
    assert set(parts(clean(slides, ".pptx", MetadataOptions(strip_comments=True))[0])) == {"[Content_Types].xml", "ppt/slides/s.xml"}


@pytest.mark.parametrize("xmp,iptc,stays", [(True, True, False), (False, True, False), (True, False, False), (False, False, True)])
def test_png_texts_stay_only_if_neither_is_asked(xmp, iptc, stays):
    out, _ = clean(png(chunk(b"tEXt", b"Author\0A")), ".png", MetadataOptions(strip_xmp=xmp, strip_iptc=iptc))
    assert (b"Author" in out) == stays


def test_listing_reads_no_more_than_fits(spark, tmp_path):
    for name, body in {"a.PNG": png(), "b.jpeg": b"x" * 5000, "c.exe": b"z" * 9000}.items():
        (tmp_path / name).write_bytes(body)
    rows = {r.path.rpartition("/")[2]: r for r in list_files(spark, str(tmp_path), max_bytes=1000).collect()}
    assert {k: r.content is None for k, r in rows.items()} == {"a.PNG": False, "b.jpeg": True} and rows["b.jpeg"].length == 5000
    done = {r.path.rpartition("/")[2]: (r.status, r.error_code) for r in files.clean_all(list_files(spark, str(tmp_path), max_bytes=1000, supported_only=False)).collect()}
    assert done == {"a.PNG": ("succeeded", None), "b.jpeg": ("failed", "PAYLOAD_TOO_LARGE"), "c.exe": ("skipped", None)}


def test_texts_in_and_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("two\nlines")
    texts = read_texts(spark, str(tmp_path))
    assert [r.text for r in texts.collect()] == ["two\nlines"]
    write_texts(texts.select(F.lit("one line").alias("text")), str(tmp_path / "out"))
    assert [r.text.strip() for r in read_texts(spark, str(tmp_path / "out")).collect()] == ["one line"]


def test_batch(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.png": png(chunk(b"tEXt", b"k\0v")), "b.md": b"# h", "c": b"x\xe2\x80\x8by", "d.exe": b"z", "e.jpg": b"bad", "f.cleaned.png": b"", "sub/g.txt": b"t"}.items():
        (tmp_path / name).write_bytes(body)
    listed = list_files(spark, str(tmp_path), recursive=True, supported_only=False)
    rows = {r.path.rpartition("/")[2]: r for r in files.clean_all(listed).collect()}
    assert {k: (r.pipeline, r.status) for k, r in rows.items()} == {"a.png": ("metadata", "succeeded"), "b.md": ("markdown", "succeeded"), "c": ("text", "succeeded"), "d.exe": ("unsupported", "skipped"), "e.jpg": ("metadata", "failed"), "g.txt": ("text", "succeeded")}
    assert bytes(rows["a.png"].content) == png() and bytes(rows["b.md"].content) == b"h\n" and bytes(rows["c"].content) == b"xy"
    assert {r.path.rpartition("/")[2] for r in list_files(spark, str(tmp_path)).collect()} == {"a.png", "e.jpg"}
    found = files.inspect_files(list_files(spark, str(tmp_path))).collect()
    assert {(r.key, r.error_code) for r in found} == {("tEXt", None), (None, "METADATA_STRIP_FAILED")}


@pytest.mark.parametrize("path,pipeline", [("a/b.MD", "markdown"), ("x.markdown", "markdown"), ("x.JPG", "metadata"), ("x.jfif", "metadata"), ("x.3g2", "metadata"), ("x.xhtml", "metadata"), ("a.b/c", "text"), ("x.log", "text"), ("x.tar.gz", "unsupported"), ("x.avif", "metadata")])
def test_routing(spark, path, pipeline):
    assert spark.range(1).select(classify(F.lit(path)).alias("p")).first().p == pipeline


def test_output_path(spark):
    rows = spark.createDataFrame([("a/b.c.txt",), ("a.d/b",)], "p string").select(output_path(F.col("p")).alias("o")).collect()
    assert [r.o for r in rows] == ["a/b.c.cleaned.txt", "a.d/b.cleaned"]


def picture(alpha=255):
    x = np.full((48, 48, 4), 128, np.uint8)
    x[..., 3] = 255
    x[10:30, 10:30, 3] = alpha
    return x


def test_pictures_of_one_size_are_looked_at_together(monkeypatch):
    rng = np.random.default_rng(3)
    alpha = np.kron(rng.choice([90, 255], (60, 4, 5, 1)), np.ones((1, 5, 4, 1), int)).astype(np.uint8)
    stack = np.concatenate([rng.integers(0, 255, (60, 20, 20, 3), np.uint8), alpha], 3)
    calls = []
    monkeypatch.setattr(images, "components", lambda found, real=images.components: calls.append(1) or real(found))
    got = images.found_in([(x.tobytes(), x.shape) for x in stack], 0.4)
    assert len(calls) == 1 and got == [images.regions(images.to_rgba(x)) for x in stack] and sum(map(len, got)) > 60
    with pytest.raises(ValueError):
        images.found_in([(b"123", (1, 1, 4))], 0.4)


def test_regions(spark, tmp_path):
    assert images.regions(picture(90), 0.3) == [{"x": 10, "y": 10, "width": 20, "height": 20, "confidence": 1.0}]
    assert images.regions(picture(), 0.3) == [] == images.regions(picture(90), 0)
    x = picture()
    x[2:8, 2:8, :3] = 200
    x[9, 9, :3] = x[8, 8, :3] = 200
    assert images.regions(x) == [{"x": 2, "y": 2, "width": 8, "height": 8, "confidence": round(0.5 + 0.5 * 38 / 64, 3)}]
    (tmp_path / "a.png").write_bytes(png(pixels=picture(90)))
    (tmp_path / "b.png").write_bytes(b"bad")
    rows = detect_images(read_images(spark, str(tmp_path))).collect()
    assert [(r.region, r.x, r.y, r.width, r.height) for r in rows] == [(0, 10, 10, 20, 20)]


def test_config(tmp_path):
    p = tmp_path / "config.yaml"
    p.write_text("text: {vendors: false, unknown: 1}\nimage: {threshold: 0.7}\nmarkdown:\n  strip-links: true\n")
    c = load_config(str(p))
    assert not c.text.vendors and c.image.threshold == 0.7 and c.markdown.strip_links
    p.write_text("text: [")
    assert load_config(str(p)).text.vendors


def cleaned_rows(spark, rows):
    return spark.createDataFrame([(p, s, None if c is None else bytearray(c)) for p, s, c in rows], "output_path string, status string, content binary")


def test_files_are_written_under_their_names(spark, tmp_path):
    rows = [("file:/in/a/x.cleaned.txt", "succeeded", b"one"), ("/in/b/x.cleaned.txt", "succeeded", b""), ("/in/c.cleaned.bin", "failed", None), ("/other/d.cleaned", "succeeded", bytes(range(256)) * 5000), ("/in/e.cleaned", "skipped", None)]
    folder = f"file://{tmp_path}/out"
    for _ in range(2):
        sink.write_files(cleaned_rows(spark, rows).repartition(3), folder, base="/in")
        found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
        assert found == {"a/x.cleaned.txt": b"one", "b/x.cleaned.txt": b"", "other/d.cleaned": bytes(range(256)) * 5000}
    assert not list((tmp_path / "out").glob("_temporary*"))
    sink.write_files(cleaned_rows(spark, []), f"file://{tmp_path}/none")
    assert not list(tmp_path.glob("none/*"))


@pytest.mark.parametrize("names", [("/in/a", "/in/a"), ("/in/a", "file:/in/a"), ("/in/../b", "/in/c"), ("/", "/in/c")])
def test_names_that_cannot_be_written(spark, tmp_path, names):
    with pytest.raises(ValueError, match="one name|leave the folder"):
        sink.write_files(cleaned_rows(spark, [(n, "succeeded", b"x") for n in names]), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_a_task_that_is_killed_leaves_no_second_copy(tmp_path):
    """Its attempt's folder doesn't count; the one that ran to its end does."""
    row = lambda n, c: Row(name=n, content=c)

    def killed():
        yield row("a/x", b"half")
        raise RuntimeError("killed")

    writer = sink.FileWriter(f"file://{tmp_path}/out", "job")
    with pytest.raises(RuntimeError):
        writer.write(killed())
    lost = writer.write(iter([row("a/x", b"whole"), row("a/y", b"y")]))  # a copy that ran beside the one that counts
    done = [writer.write(iter([row("a/x", b"whole"), row("a/y", b"y")])), writer.write(iter([]))]
    assert lost.folder != done[0].folder and not (tmp_path / "out" / "a").exists()
    writer.commit(done)
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["out/a/x", "out/a/y"]
    writer.write(iter([row("b", b"1")]))
    writer.abort(done)
    assert not (tmp_path / "out" / "b").exists() and not list(tmp_path.glob("out/_temporary*"))


def test_tasks_move_the_files_and_may_run_again(spark, tmp_path, monkeypatch):
    moved = []
    monkeypatch.setattr(sink, "move", lambda *ends, real=sink.move: moved.append(ends) or real(*ends))
    folder = f"file://{tmp_path}/out"
    sink.write_files(cleaned_rows(spark, [(f"/in/a/{i}", "succeeded", b"x") for i in range(40)]).repartition(4), folder, base="/in")
    # none by the driver
    assert not moved and len(list((tmp_path / "out" / "a").iterdir())) == 40 and not list(tmp_path.glob("out/_temporary*"))
    writer = sink.FileWriter(folder, "job")
    done = writer.write(iter([Row(name="b/x", content=b"1"), Row(name="b/y", content=b"2")]))
    assert [sink.move(done.folder, folder) for _ in range(2)] == [2, 0]
    assert sorted(p.name for p in (tmp_path / "out" / "b").iterdir()) == ["x", "y"]


def test_written_files_are_listed_by_tasks_and_read_by_name(spark, tmp_path):
    folder, listing = f"file://{tmp_path}/out", f"file://{tmp_path}/names"
    rows = [(f"/in/a/{i}", "succeeded", b"x" * i) for i in range(40)] + [("/in/\u00fc \n%20", "succeeded", b""), ("/in/big", "succeeded", bytes(1 << 24)), ("/in/none", "failed", None)]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "older").write_bytes(b"not written now")
    sink.write_files(cleaned_rows(spark, rows).repartition(4), folder, base="/in", listing=listing)
    listed = spark.read.schema(sink.LISTING).parquet(listing)
    want = {p.removeprefix("/in/"): c for p, _, c in rows if c is not None}
    assert sorted((r.name, r.length) for r in listed.collect()) == sorted((n, len(c)) for n, c in want.items())
    assert sorted((r.name, r.length, bytes(r.content)) for r in read_files(listed, folder).collect()) == sorted((n, len(c), c) for n, c in want.items())
    sink.write_files(cleaned_rows(spark, []), folder, listing=listing + "-2")
    assert read_files(spark.read.schema(sink.LISTING).parquet(listing + "-2"), folder).count() == 0
    assert not list(tmp_path.glob("out/_temporary*"))


def test_a_task_that_moves_again_lists_the_same(tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "MOVED_AT_ONCE", 2)
    folder = f"file://{tmp_path}/out"
    done = sink.FileWriter(folder, "job").write(iter([Row(name=f"b/{i}", content=b"x" * i) for i in range(5)]))
    # one that ends before its last files
    assert next(sink.move_listed(done.folder, folder)) == [("b/0", 0), ("b/1", 1)]
    for _ in range(2):
        assert [f for some in sink.move_listed(done.folder, folder) for f in some] == [(f"b/{i}", i) for i in range(5)]
        assert sorted(p.name for p in (tmp_path / "out" / "b").iterdir()) == list("01234")
    # without rows, no list
    assert list(sink.move_listed(sink.FileWriter(folder, "job").write(iter([])).folder, folder)) == []


def test_the_driver_lists_no_written_files(spark, sf):
    found = queries()["written_files"](spark, sf)
    assert found.count() > 50 and len(found.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_failing_job_writes_nothing(spark, tmp_path):
    bad = F.udf(lambda i: 1 // (i - 7) and bytearray(b"x"), "binary")
    rows = spark.range(20).repartition(4).select(F.concat(F.lit("/in/"), F.col("id").cast("string")).alias("output_path"), bad("id").alias("content"))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        sink.write_files(rows, f"file://{tmp_path}/out")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_one_bad_file_fails_no_batch(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xe9 \xe2\x80\x8bx")
    (tmp_path / "b.md").write_bytes(b"# caf\xe9\n")
    rows = {Path(r.path).name: r for r in files.clean_all(list_files(spark, str(tmp_path), supported_only=False)).collect()}
    assert {n: (r.status, bytes(r.content)) for n, r in rows.items()} == {"a.txt": ("succeeded", "caf\ufffd x".encode()), "b.md": ("succeeded", "caf\ufffd\n".encode())}
