"""Metadata of files: what they carry, and privacy clean-up of the formats that can be cut safely.

A format is a walk over its pieces: (start, end, entry), where an entry names metadata and None is
content. Inspection lists the entries; cleaning leaves out those that the options take. Provenance
manifests (C2PA) are listed and always kept. Boxes of ISO media files are overwritten by free space of
the same size, so that offsets into the media data stay right.
"""

from __future__ import annotations

import io
import lzma
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import schemas
from sievelake.options import MetadataOptions
from sievelake.functions.vectorised import in_slices, vectorised

Entry = tuple[str, str, str]


class CorruptFile(ValueError):
    """A file whose structure can't be walked."""


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    entry: Entry | None = None
    kind: str = ""  # the option that takes it; "always" and "never" need none


def _ascii(data: bytes) -> str:
    return data.decode("ascii", "replace").replace("\ufffd", "?")


def _signature(data: bytes) -> str:
    return bytes(b for b in data[:32] if 32 <= b < 127).decode()


# ---------------------------------------------------------------- JPEG


def walk_jpeg(data: bytes) -> Iterator[Piece]:
    if data[:2] != b"\xff\xd8":
        raise CorruptFile("no JPEG")
    yield Piece(0, 2)
    at = 2
    while at + 1 < len(data):
        marker = data[at + 1]
        if data[at] != 0xFF or (marker not in (0x01, *range(0xD0, 0xDA)) and at + 3 >= len(data)):
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD9:
            yield Piece(at, at + 2)
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            raise CorruptFile("JPEG segment under two bytes")
        end = min(len(data), at + 2 + size)
        yield Piece(at, end, *_jpeg_entry(marker, data[at + 4 : end]))
        at = end
        if marker == 0xDA:
            break
    if at < len(data):
        yield Piece(at, len(data))


def _jpeg_entry(marker: int, body: bytes) -> tuple[Entry | None, str]:
    sign = _signature(body)
    if marker == 0xE1:
        if sign.startswith("Exif"):
            return ("EXIF", "APP1/Exif", "EXIF metadata block"), "exif"
        if sign.startswith("http://ns.adobe.com/xap") or "xmpmeta" in sign:
            return ("XMP", "APP1/XMP", "XMP packet"), "xmp"
        return ("APP1", "APP1", sign), "app1"
    if marker == 0xED:
        return ("IPTC", "APP13/Photoshop", "IPTC/Photoshop resource block"), "iptc"
    if marker == 0xEB:
        return ("C2PA", "APP11/JUMBF", "C2PA JUMBF manifest box"), "never"
    if marker == 0xE2:
        return (("ICC", "APP2/ICC_PROFILE", "ICC color profile"), "icc") if sign.startswith("ICC_PROFILE") else (("APP2", "APP2", sign), "maker")
    if marker == 0xFE:
        return ("COM", "Comment", _ascii(body[:120]).strip()), "always"
    if 0xE3 <= marker <= 0xEF:
        return ("APPn", f"APP{marker - 0xE0}", sign), "maker"
    return None, ""


# ---------------------------------------------------------------- PNG, WebP

PNG_SIGN = b"\x89PNG\r\n\x1a\n"
# Names and descriptions of chunks.
PNG_CHUNKS = {
    "eXIf": (("EXIF", "eXIf", "EXIF chunk"), "exif"),
    "tEXt": (("XMP/Text", "tEXt", "tEXt textual metadata"), "text"),
    "zTXt": (("XMP/Text", "zTXt", "zTXt textual metadata"), "text"),
    "iTXt": (("XMP/Text", "iTXt", "iTXt textual metadata"), "text"),
    "tIME": (("PNG", "tIME", "Last-modification time"), "exif"),
    "caBX": (("C2PA", "caBX", "C2PA manifest chunk"), "never"),
    "iCCP": (("ICC", "iCCP", "ICC color profile"), "icc"),
}
# End of fixed values.


def walk_png(data: bytes) -> Iterator[Piece]:
    if data[:8] != PNG_SIGN:
        raise CorruptFile("no PNG")
    yield Piece(0, 8)
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">i4s", data[at : at + 8])
        end = at + 12 + size
        if size < 0 or end > len(data):
            raise CorruptFile("PNG chunk beyond the file")
        kind = _ascii(kind)
        yield Piece(at, end, *PNG_CHUNKS.get(kind, (None, "")))
        at = end
        if kind == "IEND":
            break


WEBP_CHUNKS = {b"EXIF": (("EXIF", "EXIF", "EXIF metadata block"), "exif", 0x08), b"XMP ": (("XMP", "XMP ", "XMP packet"), "xmp", 0x04), b"ICCP": (("ICC", "ICCP", "ICC color profile"), "icc", 0x20)}


def walk_webp(data: bytes) -> Iterator[Piece]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise CorruptFile("no WebP")
    yield Piece(0, 12)
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        end = at + 8 + size + size % 2
        if end > len(data):
            raise CorruptFile("WebP chunk beyond the file")
        yield Piece(at, end, *WEBP_CHUNKS.get(data[at : at + 4], (None, ""))[:2])
        at = end


def mend_webp(before: bytes, pieces: list[Piece], after: bytes) -> bytes:
    """With the size and the flags of what is gone set right."""
    out = bytearray(after)
    out[4:8] = (len(out) - 8).to_bytes(4, "little")
    at = out.find(b"VP8X", 12)
    if at >= 0:
        gone = {before[p.start : p.start + 4] for p in pieces}
        for kind, (_, _, flag) in WEBP_CHUNKS.items():
            if kind in gone:
                out[at + 8] &= ~flag & 0xFF
    return bytes(out)


# ---------------------------------------------------------------- ISO media: HEIF, AVIF, MP4

EXIF_UUID = bytes.fromhex("8532c9a23b9a11e4b6a20401e0cbbfce")
XMP_UUID = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")


@dataclass(frozen=True)
class Box:
    kind: str
    start: int
    body: int
    end: int


def boxes(data: bytes, at: int, end: int) -> Iterator[Box]:
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise CorruptFile("box beyond its parent")
        yield Box(data[at + 4 : at + 8].decode("latin-1"), at, at + head, at + size)
        at += size


def _box_entry(data: bytes, b: Box, where: str = "") -> tuple[Entry | None, str]:
    body = data[b.body : b.end]
    if b.kind == "Exif":
        return ("EXIF", "Exif", "EXIF box"), "exif"
    if b.kind == "uuid" and body[:16] == EXIF_UUID:
        return ("EXIF", "uuid/EXIF", f"EXIF data in {where}UUID box"), "exif"
    if b.kind == "uuid" and body[:16] == XMP_UUID:
        return ("XMP", "uuid/XMP", f"XMP packet in {where}UUID box"), "xmp"
    if b.kind == "colr" and body[:4] in (b"rICC", b"prof"):
        return ("ICC", "colr/ICC", f"ICC color profile ({body[:4].decode()})"), "icc"
    if b.kind == "mime" and body[:64].split(b"\0")[0].lower() == b"application/rdf+xml":
        return ("XMP", "mime/XMP", "XMP packet in mime box"), "xmp"
    return None, ""


def walk_heif(data: bytes) -> Iterator[Piece]:
    if data[4:8] != b"ftyp":
        raise CorruptFile("no ISO media file")
    for top in boxes(data, 0, len(data)):
        if top.kind == "meta":
            if top.end - top.body < 4:
                raise CorruptFile("meta box without version")
            for b in boxes(data, top.body + 4, top.end):
                entry, kind = _box_entry(data, b)
                if entry:
                    yield Piece(b.start, b.end, entry, kind)


def walk_mp4(data: bytes) -> Iterator[Piece]:
    if data[4:8] not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
        raise CorruptFile("no ISO media file")
    for top in boxes(data, 0, len(data)):
        if top.kind == "udta":
            yield Piece(top.start, top.end, ("USER_DATA", "udta", "user-data box (root level)"), "always")
        elif top.kind == "uuid":
            entry, kind = _box_entry(data, top, "top-level ")
            if entry:
                yield Piece(top.start, top.end, entry, kind)
        elif top.kind == "meta":
            yield from _mp4_meta(data, top)
        elif top.kind == "moov":
            for b in boxes(data, top.body, top.end):
                if b.kind == "udta":
                    yield Piece(b.start, b.end, ("USER_DATA", "udta", "user-data box"), "always")
                elif b.kind == "meta":
                    yield from _mp4_meta(data, b)


def _mp4_meta(data: bytes, meta: Box) -> Iterator[Piece]:
    # a full box has a version before its children; QuickTime's has none
    first = meta.body if data[meta.body + 4 : meta.body + 8] in (b"hdlr", b"keys", b"ilst") else meta.body + 4
    for b in boxes(data, first, meta.end):
        entry, kind = _box_entry(data, b)
        if b.kind in ("keys", "ilst"):
            entry, kind = ("QUICKTIME_META", b.kind, "QuickTime key namespace index" if b.kind == "keys" else "QuickTime title/author/album data list"), "always"
        if entry:
            yield Piece(b.start, b.end, entry, kind)


# ---------------------------------------------------------------- PDF (listed only), HTML, RTF

# Fields of the information dictionary.
PDF_INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
#: Where the name that is told isn't the file's.
PDF_NAMES = {"ModDate": "ModifiedDate"}
# End of fixed values.
_PDF_FIELDS = {k: re.compile(rb"/" + k.encode() + rb"\s*(?:\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>)", re.S) for k in PDF_INFO}
#: Bytes that are unpacked at a time, and how far a field may reach over their end.
PDF_STEP, PDF_REACH = 1 << 20, 1 << 16


def _unpacked(data: memoryview) -> Iterator[bytes]:
    """A deflated stream piece by piece, each with the end of the one before; up to where it is damaged."""
    unpack, at, tail = zlib.decompressobj(), 0, b""
    try:
        while not unpack.eof and (unpack.unconsumed_tail or at < len(data)):
            raw = unpack.unconsumed_tail
            if not raw:
                raw, at = bytes(data[at : at + PDF_REACH]), at + PDF_REACH
            out = unpack.decompress(raw, PDF_STEP)
            if out:
                yield tail + out
                tail = (tail + out)[-PDF_REACH:]
    except zlib.error:
        return


def _pdf_streams(data: bytes) -> Iterator[memoryview]:
    """Deflated streams, by the dictionary that stands before each."""
    for m in re.finditer(rb"(?<!end)stream\r?\n", data):
        if b"/FlateDecode" in data[data.rfind(b"obj", 0, m.start()) + 3 : m.start()]:
            yield memoryview(data)[m.end() :]


def _pdf_value(m: re.Match) -> str:
    if m[1] is not None:
        raw = re.sub(rb"\\([()\\])", rb"\1", m[1])
    else:
        digits = re.sub(rb"\s", b"", m[2]).decode()
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def inspect_pdf(data: bytes) -> list[Entry]:
    """The fields of the information dictionary, in plain objects or in deflated streams, and whether there is an XMP packet. Encrypted ones aren't read."""
    if b"%PDF-" not in data[:1024]:
        raise CorruptFile("no PDF")
    found: dict[str, str] = {}
    xmp = False

    def look(part: bytes, whole: bytes) -> None:
        nonlocal xmp
        xmp = xmp or b"<?xpacket" in whole or b"<x:xmpmeta" in whole
        for key, pattern in _PDF_FIELDS.items():
            if key not in found and (m := pattern.search(part)):
                found[key] = _pdf_value(m)

    # what stands in a plain stream is a page's text or a packet, not the dictionary
    look(re.sub(rb"(?<!end)stream\r?\n.*?endstream", b"", data, flags=re.S), data)
    for stream in _pdf_streams(data):
        for part in _unpacked(stream):
            look(part, part)
    return [("Info", PDF_NAMES.get(k, k), found[k]) for k in PDF_INFO if found.get(k, "").strip()] + [("XMP", "XMP", "Embedded XMP metadata packet")] * xmp


# Names that identify someone or something.
#: Names of meta elements that identify someone or something.
META_NAMES = frozenset([
    "author", "generator", "copyright", "description", "keywords", "dcterms.creator", "dcterms.author", "dc.creator", "dc.publisher",
    "dc.rights", "dc.title", "dc.description", "article:author", "twitter:creator", "application-name", "revised", "owner",
])
RTF_WORDS = frozenset([
    "title", "subject", "author", "manager", "company", "category", "keywords", "comment", "doccomm", "hlinkbase",
    "generator", "operator", "version", "edmins", "nofpages", "nofwords", "nofchars", "nofcharsws", "id",
])
RTF_TIMES = frozenset(["creatim", "revtbl", "printim", "buptim"])
# End of fixed values.


class _Html(HTMLParser):
    """Pieces of a page, in characters."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0]
        for m in re.finditer("\n", text):
            self.lines.append(m.end())
        self.pieces: list[Piece] = []
        self.open: tuple[str, int, Entry] | None = None
        self.depth = 0
        self.text = text
        self.feed(text)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        start = self._at()
        end = start + len(self.get_starttag_text() or "")
        if self.open:
            self.depth += tag == self.open[0]
            return
        if tag == "meta":
            given = {k: v or "" for k, v in reversed(attrs)}
            key = given.get("name") or given.get("property") or given.get("http-equiv") or ""
            if key.lower() in META_NAMES:
                self.pieces.append(Piece(start, end, ("HTML/meta", key, given.get("content", "")), "always"))
            return
        entry = None
        if tag in ("x:xmpmeta", "xmpmeta", "xmp"):
            entry = ("XMP", tag, "XMP metadata block")
        elif tag == "rdf:rdf" or tag.startswith(("dc:", "dcterms:")):
            entry = ("RDF/DC", tag, "RDF/Dublin Core metadata node")
        if entry:
            self.open, self.depth = (tag, start, entry), 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[0] == tag:
            self._close(self._at() + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        if self.open and tag == self.open[0]:
            end = self.text.find(">", self._at())
            self._close(len(self.text) if end < 0 else end + 1)

    def _close(self, end: int) -> None:
        self.depth -= 1
        if not self.depth:
            tag, start, entry = self.open
            self.pieces.append(Piece(start, end, entry, "always"))
            self.open = None


def html_pieces(text: str) -> list[Piece]:
    return _Html(text).pieces


_RTF = re.compile(r"\\'(?:..)?|\\([A-Za-z]+)(-?\d*)|\\.?", re.S)
_RTF_TIME = re.compile(r"(?:[ \t\r\n]*\\(?:yr|mo|dy|hr|min|sec)(?![A-Za-z])-?\d*)*[ \t\r\n]*")


def rtf_pieces(text: str) -> list[Piece]:
    if not text.startswith("{\\rtf"):
        raise CorruptFile("no RTF")
    out, at = [], 0
    while m := _RTF.search(text, at):
        at = m.end()
        if m[1] in RTF_WORDS:
            value = m[2]
            if not value and text[at : at + 1] == " ":
                end = re.compile(r"[\\{}]").search(text, at)
                end = end.start() if end else len(text)
                value, at = text[at + 1 : end], end
            out.append(Piece(m.start(), at, ("RTF/info", m[1], value), "always"))
        elif m[1] in RTF_TIMES:
            at = _RTF_TIME.match(text, at).end()
            out.append(Piece(m.start(), at, ("RTF/info", m[1], "<compound>"), "always"))
    return out


# ---------------------------------------------------------------- zipped XML: EPUB, OOXML

# Properties of office files and their names here.
CORE = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
DC, TERMS, OPF = "{http://purl.org/dc/elements/1.1/}", "{http://purl.org/dc/terms/}", "{http://www.idpf.org/2007/opf}"
CORE_FIELDS = [
    ("Creator", f"{DC}creator"), ("Title", f"{DC}title"), ("Subject", f"{DC}subject"), ("Keywords", f"{CORE}keywords"), ("Description", f"{DC}description"),
    ("LastModifiedBy", f"{CORE}lastModifiedBy"), ("Category", f"{CORE}category"), ("ContentStatus", f"{CORE}contentStatus"), ("Revision", f"{CORE}revision"),
    ("Identifier", f"{DC}identifier"), ("Language", f"{DC}language"), ("Version", f"{CORE}version"), ("Created", f"{TERMS}created"), ("Modified", f"{TERMS}modified"), ("LastPrinted", f"{CORE}lastPrinted"),
]
# End of fixed values.
COMMENT_PARTS = {
    ".pptx": [("PowerPointCommentPart", re.compile(r"ppt/comments/.*\.xml$")), ("PowerPointAuthorsPart", re.compile(r"ppt/(?:commentAuthors|authors)\.xml$"))],
    ".xlsx": [("WorksheetComments+ThreadedComments", re.compile(r"xl/(?:comments[^/]*|threadedComments/.*)\.xml$")), ("CommentAuthorsPart", re.compile(r"xl/persons/.*\.xml$"))],
    ".docx": [],
}
#: Word's comments and those who wrote them, which its own inspection doesn't list.
WORD_COMMENTS = re.compile(r"word/(?:comments[^/]*|people)\.xml$")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: An archive that unpacks to more isn't read.
ARCHIVE_BYTES = 2 << 30
#: Nesting beyond this would exhaust the stack.
XML_DEPTH = 200


def _archive(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in z.infolist()) > ARCHIVE_BYTES:
        raise CorruptFile("archive unpacks to too much")
    return z


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data:
        raise CorruptFile("entities in XML")
    depth = 0
    parser = ElementTree.iterparse(io.BytesIO(data), ["start", "end"])
    for event, _ in parser:
        depth += 1 if event == "start" else -1
        if depth > XML_DEPTH:
            raise CorruptFile("XML nested too deep")
    return parser.root


def inspect_ooxml(data: bytes, extension: str) -> list[Entry]:
    with _archive(data) as z:
        names = set(z.namelist())
        if "[Content_Types].xml" not in names:
            raise CorruptFile("no OOXML package")
        out = []
        if "docProps/core.xml" in names:
            root = _xml(z.read("docProps/core.xml"))
            out += [("Core", label, e.text) for label, tag in CORE_FIELDS if (e := root.find(tag)) is not None and (e.text or "").strip()]
        out += [("Extended", "app.xml", "Extended properties (Company, Application, etc.)")] * ("docProps/app.xml" in names)
        out += [("Custom", "custom.xml", "Custom properties")] * ("docProps/custom.xml" in names)
        for label, pattern in COMMENT_PARTS[extension]:
            n = sum(bool(pattern.match(x)) for x in names)
            out += [("Comments", label, f"{n} part(s)")] * bool(n)
        if extension == ".docx" and "word/document.xml" in names:
            n = len(re.findall(rb"<w:(?:ins|del|moveFrom|moveTo)[ >]", z.read("word/document.xml")))
            out += [("Revisions", "TrackedChanges", f"{n} tracked change(s)")] * bool(n)
        return out


def _rezip(data: bytes, change: Callable[[str, bytes], bytes | None]) -> bytes:
    """The archive with each entry changed or, at None, left out."""
    out = io.BytesIO()
    with _archive(data) as z, zipfile.ZipFile(out, "w") as to:
        for info in z.infolist():
            body = change(info.filename, z.read(info))
            if body is not None:
                fresh = zipfile.ZipInfo(info.filename, info.date_time)
                fresh.compress_type, fresh.external_attr = info.compress_type, info.external_attr
                to.writestr(fresh, body)
    return out.getvalue()


def _without_parts(data: bytes, gone: Callable[[str], bool]) -> bytes:
    """Content types and relationships less those of parts that go, told by their file names."""

    def one(m: re.Match) -> bytes:
        target = re.search(rb"(?:PartName|Target)\s*=\s*[\"']([^\"']*)", m[0])
        return b"" if target and gone(target[1].decode("utf-8", "replace")) else m[0]

    return re.sub(rb"<(?:Relationship|Override)\b[^>]*?/>", one, data)


def _serialised(root: ElementTree.Element, source: bytes) -> bytes:
    """With the prefixes that the source gives its namespaces, as attributes may name them."""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(source), ["start-ns"]):
        if not re.fullmatch(r"ns\d+|xml", prefix):
            ElementTree.register_namespace(prefix, uri)
    return ElementTree.tostring(root, xml_declaration=True, encoding="utf-8")


def clean_word(body: bytes, o: MetadataOptions) -> bytes:
    """A part of a Word file without marks of comments, and with tracked changes accepted: what was inserted stays, what was deleted goes, and so do the marks of who saved when."""
    root = _xml(body)
    drop = {f"{W}{x}" for x in ("commentRangeStart", "commentRangeEnd", "commentReference")} if o.strip_comments else set()
    unwrap: set[str] = set()
    if o.accept_revisions:
        drop |= {f"{W}{x}" for x in ("del", "moveFrom", "moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd", "rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange", "rsids")}
        unwrap = {f"{W}ins", f"{W}moveTo"}

    def walk(e: ElementTree.Element) -> None:
        out: list[ElementTree.Element] = []
        for child in e:
            if child.tag in drop:
                continue
            walk(child)
            out += list(child) if child.tag in unwrap else [child]
        e[:] = out
        if o.accept_revisions:
            for k in [k for k in e.attrib if k.startswith(f"{W}rsid")]:
                del e.attrib[k]

    walk(root)
    return _serialised(root, body)


def clean_ooxml(data: bytes, extension: str, o: MetadataOptions) -> bytes:
    """Without core, extended and custom properties. Comments with their authors and tracked changes go only if the options say so."""
    patterns = [*(p for _, p in COMMENT_PARTS[extension]), *([WORD_COMMENTS] if extension == ".docx" else [])]

    def gone(name: str) -> bool:
        """By the end of a path, as relationships are relative to their part."""
        name = name.lstrip("./")
        if name.endswith(("docProps/app.xml", "docProps/custom.xml")):
            return True
        folder = {".docx": "word/", ".pptx": "ppt/", ".xlsx": "xl/"}[extension]
        return o.strip_comments and any(p.match(name) or p.match(folder + name) for p in patterns)

    def change(name: str, body: bytes) -> bytes | None:
        if name == "docProps/core.xml":
            root = _xml(body)
            for e in list(root):
                root.remove(e)
            return ElementTree.tostring(root, xml_declaration=True, encoding="utf-8")
        if gone(name):
            return None
        if name.endswith(".rels") or name == "[Content_Types].xml":
            return _without_parts(body, gone)
        if extension == ".docx" and (o.strip_comments or o.accept_revisions) and re.fullmatch(r"word/(?:document|settings|header\d*|footer\d*|footnotes|endnotes)\.xml", name):
            return clean_word(body, o)
        return body

    return _rezip(data, change)


def _package(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    if "mimetype" not in names or z.read("mimetype").strip() != b"application/epub+zip" or "META-INF/container.xml" not in names:
        raise CorruptFile("no EPUB")
    found = _xml(z.read("META-INF/container.xml")).find(".//{*}rootfile")
    if found is None or found.get("full-path") not in names:
        raise CorruptFile("EPUB without package")
    return found.get("full-path")


def _epub_entries(metadata: ElementTree.Element) -> list[tuple[ElementTree.Element, Entry | None]]:
    out = []
    for e in metadata:
        if e.tag.startswith(DC):
            value = (e.text or "").strip()
            out.append((e, ("OPF/dc", e.tag.removeprefix(DC), value) if value else None))
        elif e.tag == f"{OPF}meta":
            out.append((e, ("OPF/meta", e.get("property") or e.get("name") or "meta", e.get("content") or e.text or "")))
    return out


def inspect_epub(data: bytes) -> list[Entry]:
    with _archive(data) as z:
        metadata = _xml(z.read(_package(z))).find(f"{OPF}metadata")
        return [x for _, x in _epub_entries(metadata) if x] if metadata is not None else []


def clean_epub(data: bytes) -> bytes:
    """Without metadata but for an identifier, which follows from the file's bytes, so that a task that runs again gives the same."""
    with _archive(data) as z:
        package = _package(z)
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(zlib.crc32(data)) + str(len(data)))}"

    def change(entry: str, body: bytes) -> bytes:
        if entry != package:
            return body
        for prefix, uri in (("", OPF), ("dc", DC), ("dcterms", TERMS)):
            ElementTree.register_namespace(prefix, uri[1:-1])
        root = _xml(body)
        metadata = root.find(f"{OPF}metadata")
        if metadata is None:
            return body
        for e, _ in _epub_entries(metadata):
            if e.tag == f"{DC}identifier":
                e.text = name
            else:
                metadata.remove(e)
        if metadata.find(f"{DC}identifier") is None:
            ElementTree.SubElement(metadata, f"{DC}identifier").text = name
        return ElementTree.tostring(root, xml_declaration=True, encoding="utf-8")

    return _rezip(data, change)


# ---------------------------------------------------------------- routing

WALKS: dict[str, Callable[[bytes], Iterator[Piece]]] = {
    **dict.fromkeys((".jpg", ".jpeg", ".jpe", ".jfif"), walk_jpeg),
    ".png": walk_png,
    ".webp": walk_webp,
    **dict.fromkeys((".heic", ".heif", ".avif"), walk_heif),
    **dict.fromkeys((".mp4", ".mov", ".m4v", ".m4a", ".m4b", ".m4p", ".3gp", ".3g2"), walk_mp4),
}
HTML, OOXML = (".html", ".htm", ".xhtml"), tuple(COMMENT_PARTS)
EXTENSIONS = tuple(sorted({*WALKS, ".pdf", *HTML, ".rtf", ".epub", *OOXML}))
MARKDOWN, TEXT = (".md", ".markdown"), (".txt", ".text", ".log")


#: What readers raise on bytes that aren't what the extension says: bad numbers and texts, places out of range, broken, encrypted or unknown archives, endless nesting.
DAMAGE = (ValueError, ArithmeticError, LookupError, RuntimeError, EOFError, OSError, AssertionError, struct.error, zlib.error, lzma.LZMAError, zipfile.BadZipFile, ElementTree.ParseError)


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def taken(piece: Piece, o: MetadataOptions) -> bool:
    return {"exif": o.strip_exif, "app1": o.strip_exif or o.strip_xmp, "xmp": o.strip_xmp, "iptc": o.strip_iptc, "text": o.strip_xmp or o.strip_iptc, "maker": o.strip_maker_notes, "icc": not o.preserve_color_profile, "always": True}.get(piece.kind, False)


def _shown(piece: Piece, o: MetadataOptions) -> bool:
    return piece.entry is not None and (piece.kind == "never" or taken(piece, o))


def inspect(data: bytes, extension: str) -> list[Entry]:
    """What default cleaning would take, and provenance manifests."""
    try:
        if extension in WALKS:
            return [p.entry for p in WALKS[extension](data) if _shown(p, MetadataOptions())]
        if extension in HTML:
            return [p.entry for p in html_pieces(_decoded(data))]
        if extension == ".rtf":
            return [p.entry for p in rtf_pieces(_decoded(data))]
        if extension == ".pdf":
            return inspect_pdf(data)
        if extension == ".epub":
            return inspect_epub(data)
        if extension in OOXML:
            return inspect_ooxml(data, extension)
    except DAMAGE as e:
        raise e if isinstance(e, CorruptFile) else CorruptFile(f"{type(e).__name__}: {e}") from e
    raise LookupError(f"no reader for {extension!r}")


def clean(data: bytes, extension: str, o: MetadataOptions) -> tuple[bytes, list[Entry]]:
    """The file without the metadata that the options take, and what that was. PDF has no cleaner."""
    try:
        if extension in WALKS:
            pieces = list(WALKS[extension](data))
            gone = [p for p in pieces if p.entry and taken(p, o)]
            if WALKS[extension] in (walk_heif, walk_mp4):
                out = bytearray(data)
                for p in gone:
                    head = 16 if int.from_bytes(data[p.start : p.start + 4], "big") == 1 else 8
                    out[p.start + 4 : p.start + 8] = b"free"
                    out[p.start + head : p.end] = bytes(p.end - p.start - head)
                return bytes(out), [p.entry for p in gone]
            out = b"".join(data[p.start : p.end] for p in pieces if p not in gone)
            return mend_webp(data, gone, out) if extension == ".webp" else out, [p.entry for p in gone]
        if extension in (*HTML, ".rtf"):
            text, at, out = _decoded(data), 0, []
            pieces = html_pieces(text) if extension in HTML else rtf_pieces(text)
            for p in pieces:
                out.append(text[at : p.start])
                at = p.end
            return "".join([*out, text[at:]]).encode("utf-8", "surrogateescape"), [p.entry for p in pieces]
        if extension == ".epub":
            return clean_epub(data), inspect_epub(data)
        if extension in OOXML:
            taken_ = ("Core", "Extended", "Custom", *["Comments"] * o.strip_comments, *["Revisions"] * o.accept_revisions)
            return clean_ooxml(data, extension, o), [e for e in inspect_ooxml(data, extension) if e[0] in taken_]
    except DAMAGE as e:
        raise e if isinstance(e, CorruptFile) else CorruptFile(f"{type(e).__name__}: {e}") from e
    raise LookupError(f"no cleaner for {extension!r}")


def _entries(found: list[Entry]) -> list[dict]:
    return [dict(zip(("container", "key", "value"), e, strict=True)) for e in found]


def _error(e: Exception) -> tuple[str, str]:
    return ("METADATA_STRIP_FAILED" if isinstance(e, CorruptFile) else "UNSUPPORTED_FORMAT"), str(e)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


@vectorised(schemas.INSPECTED)
def _inspect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for contents, extensions in batches:
        rows = []
        for data, ext in zip(contents, extensions, strict=True):
            try:
                rows.append((None, None, None) if data is None else (_entries(inspect(bytes(data), ext)), None, None))
            except (CorruptFile, LookupError) as e:
                rows.append((None, *_error(e)))
        yield pd.DataFrame(rows, columns=["entries", "error_code", "error_message"])


def inspect_metadata(content: Column, extension: Column) -> Column:
    """struct(entries, error_code, error_message); a file that can't be read has an error, not a failed task."""
    return _inspect(content, extension)


def cleaner(options: MetadataOptions | None = None):
    """A UDF of content and extension."""
    o = options or MetadataOptions()

    @F.pandas_udf(schemas.FILE_CLEAN)
    @in_slices
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, extensions in batches:
            rows = []
            for data, ext in zip(contents, extensions, strict=True):
                if data is None:
                    rows.append((None,) * 6)
                    continue
                try:
                    out, gone = clean(bytes(data), ext, o)
                    rows.append((out, _entries(gone), len(data), len(out), None, None))
                except (CorruptFile, LookupError) as e:
                    rows.append((None, None, len(data), None, *_error(e)))
            yield pd.DataFrame(rows, columns=["content", "removed", "input_bytes", "output_bytes", "error_code", "error_message"]).astype({"input_bytes": "Int64", "output_bytes": "Int64"})

    return run


def clean_metadata(content: Column, extension: Column, options: MetadataOptions | None = None) -> Column:
    """struct (see ``schemas.FILE_CLEAN``); a file that can't be cleaned has an error and no content."""
    return cleaner(options)(content, extension)
