"""Markdown clean-up that leaves fenced code alone, and its findings.

Fences carry state from line to line: a fold over a text's lines tells what each line is (``line_roles``), so that findings are a Column
expression. Whole documents are cleaned in Python batches; single line rules are also expressions (see ``line_rules``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import schemas
from sievelake.functions import hygiene
from sievelake.functions.codepoints import BOX, FORCED, java_class, python_class
from sievelake.options import MarkdownOptions
from sievelake.functions.vectorised import in_slices, vectorised

# Patterns of markdown syntax and of machine-made notices.
FRONTMATTER = r"\A---\r?\n(?s:.*?)\r?\n---[ \t]*\r?\n?"
HTML_COMMENT = r"<!--(?s:.*?)-->"
LINK_COMMENT = r"^\s*\[//\]:\s*#\s*\(.*\)\s*$"
HEADING = r"^(#{1,6})[ \t]+(.*)$"
BLOCKQUOTE = r"^\s*>[ \t]?"
RULE = r"^\s*(?:-[ \t]*(?:-[ \t]*){2,}|\*[ \t]*(?:\*[ \t]*){2,}|_[ \t]*(?:_[ \t]*){2,})$"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]*)\]\([^)]*\)"
TAG = r"</?[a-zA-Z][a-zA-Z0-9-]*(?:\s[^>]*)?/?>"
TASK = r"^(\s*)[-*+][ \t]+\[[ xX]\][ \t]?"
BULLET = r"^(\s*)([-*+])[ \t]+"
EMPTY_ITEM = r"^\s*[-*+][ \t]*$"
EMPHASIS = r"(\*\*|__|\*|_)(.+?)\1"
INLINE_CODE = r"`([^`]+)`"
MENTION = r"(?<!\S)[@#][A-Za-z0-9_]+"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_RULE = r"^\s*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?\s*$"
MAKERS = "Generated|Created|Written|Made|Produced"
TOOLS = "ChatGPT|GPT-4|GPT-4o|Claude|Claude Code|Gemini|Bard|Copilot|Anthropic|OpenAI|Google AI|an AI assistant|AI"
CO_AUTHORS = "Claude|Copilot|ChatGPT|Gemini"
ROBOT = "\U0001f916"
DISCLAIMERS = (
    r"As an AI(?: language)? model,?|I'm sorry,? but|I am sorry,? but|I cannot(?: and will not)?|I'm unable to"
    r"|Please note that I,? as an AI|It's important to note that as an AI|Disclaimer:\s*As an AI"
)
# End of fixed values.

#: Where a signature starts: what stands before it goes too. The rest of the document follows without a pattern of its own.
SIGNATURE = (
    rf"(?i)(?:\n[ \t]*)*\n?(?:-{{2,}}\s*\n)?[ \t]*(?:{ROBOT}\s*)?"
    rf"(?:_?(?:{MAKERS})\s+(?:with|by|using)\s+\[?(?:{TOOLS})\b|Co-Authored-By:\s*(?:{CO_AUTHORS})|{ROBOT}\s*Generated with)"
)
BOILERPLATE = rf"(?im)^[ \t]*(?:{DISCLAIMERS})\b.*(?:\r?\n)?"

_P = {k: regex.compile(v) for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and k not in ("MAKERS", "TOOLS", "CO_AUTHORS", "ROBOT", "DISCLAIMERS")}
_FENCE = regex.compile(r" {0,3}(`{3,}|~{3,})")
_FORCED = regex.compile(python_class(FORCED))
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass
class Segment:
    """Lines of prose, or of a fenced block with its opening and, unless it runs to the end, closing line."""

    lines: list[str]
    fence: str | None = None
    closing: str | None = None


def segments(text: str) -> list[Segment]:
    """Prose and fenced blocks. A fence has up to three blanks and three or more marks; it closes with as many of the same and nothing else."""
    out: list[Segment] = []
    mark = None
    for line in text.split("\n"):
        if mark is None:
            m = _FENCE.match(line)
            if m:
                mark = m[1]
                out.append(Segment([], fence=line))
            else:
                if not out or out[-1].fence is not None:
                    out.append(Segment([]))
                out[-1].lines.append(line)
            continue
        bare = line[min(3, len(line) - len(line.lstrip(" "))) :]
        marks = len(bare) - len(bare.lstrip(mark[0]))
        if marks >= len(mark) and not bare[marks:].strip(_SPACES):
            out[-1].closing, mark = line, None
        else:
            out[-1].lines.append(line)
    return out


def is_separator(line: str) -> bool:
    """A line of box-drawing characters but for two at most."""
    line = line.strip(_SPACES)
    n = sum(BOX[0] <= c <= BOX[1] for c in line)
    return len(line) >= 3 and n >= max(3, len(line) - 2)


@dataclass
class Report:
    removed: list[tuple] = field(default_factory=list)
    artifacts: list[tuple] = field(default_factory=list)

    def log(self, kind: str, position: int, length: int, what: str) -> None:
        self.removed.append((kind, position, length, what))

    def found(self, kind: str, what: str, line: int = 0) -> None:
        self.artifacts.append((kind, what, line, 0))


def _drop(pattern: str, kind: str, what: str) -> Callable[[str, Report], str]:
    """Removes every match and logs it."""

    def rule(line: str, report: Report) -> str:
        def one(m) -> str:
            report.log(kind, m.start(), m.end() - m.start(), what)
            return ""

        return _P[pattern].sub(one, line)

    return rule


_images, _tags, _mentions, _comments = _drop("IMAGE", "image", "Image"), _drop("TAG", "html-tag", "HTML or XML tag"), _drop("MENTION", "mention", "Mention"), _drop("HTML_COMMENT", "comment", "HTML comment")


def transform_line(line: str, o: MarkdownOptions, report: Report) -> str | None:
    """A line of prose under the options; None drops it."""
    whole = (0, len(line))
    if is_separator(line):
        return report.log("separator-line", *whole, "Box-drawing line")
    if o.strip_hr and _P["RULE"].search(line):
        return report.log("hr", *whole, "Horizontal rule")
    if o.strip_comments and _P["LINK_COMMENT"].search(line):
        return report.log("comment", *whole, "Link-reference comment")
    if o.strip_images:
        line = _images(line, report)
    if o.strip_links:
        line = _P["LINK"].sub(r"\1", line)
    if o.strip_html or o.strip_xml_tags:
        line = _tags(line, report)
    if o.strip_task_lists and (m := _P["TASK"].search(line)):
        report.log("task-list", 0, m.end(), "Task-list box")
        rest = line[m.end() :].strip(_SPACES)
        if not rest:
            return None
        line = f"{m[1]}- {rest}"
    if o.strip_headings and (m := _P["HEADING"].search(line)):
        report.log("heading", 0, len(m[1]), "Heading marker")
        line = m[2]
    if o.strip_blockquotes and (m := _P["BLOCKQUOTE"].search(line)):
        report.log("blockquote", 0, m.end(), "Blockquote prefix")
        line = line[m.end() :]
    if o.strip_table_syntax and _P["TABLE_ROW"].search(line):
        if _P["TABLE_RULE"].search(line):
            return None
        line = "  ".join(c.strip(_SPACES) for c in line.strip(_SPACES).strip("|").split("|"))
        report.log("table", 0, 0, "Table row")
    if o.normalize_lists and (m := _P["BULLET"].search(line)) and m[2] != "-":
        line = f"{m[1]}- {line[m.end() :]}"
    if o.strip_bold_italic:
        line = _P["EMPHASIS"].sub(r"\2", line)
    if o.strip_inline_code:
        line = _P["INLINE_CODE"].sub(r"\1", line)
    if o.strip_mentions:
        line = _mentions(line, report)
    if o.unwrap_empty_lists and _P["EMPTY_ITEM"].search(line):
        return report.log("empty-list-item", 0, len(line), "Empty list item")
    return line.rstrip(_SPACES) if o.strip_trailing_ws else line


def _prose(lines: list[str], o: MarkdownOptions, report: Report) -> list[str]:
    block = "\n".join(lines)
    if o.strip_comments:
        block = _comments(block, report)
    if o.apply_layer_a and o.strip_unicode:
        block, log, _ = hygiene.clean(block)
        report.removed += log
    else:
        block = _FORCED.sub("", block)
    lines = block.split("\n")
    for i, line in enumerate(lines, 1):
        if is_separator(line):
            report.found("invisible-separator", "Box-drawing line", i)
    return [x for line in lines if (x := transform_line(line, o, report)) is not None]


def _sign_off(text: str, report: Report) -> str:
    m = _P["SIGNATURE"].search(text)
    if not m:
        return text
    report.log("ai-signature", m.start(), len(text) - m.start(), "Signature of an AI tool")
    report.found("ai-signature", "Signature of an AI tool")
    return text[: m.start()].rstrip(_SPACES) + "\n"


def _disclaim(text: str, report: Report) -> str:
    def one(m) -> str:
        report.log("ai-boilerplate", m.start(), m.end() - m.start(), "Disclaimer of an AI tool")
        report.found("ai-boilerplate", "Disclaimer of an AI tool")
        return ""

    return _P["BOILERPLATE"].sub(one, text)


def unify_newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def clean(text: str, o: MarkdownOptions | None = None) -> tuple[str, Report, int, int, bool]:
    """Cleaned markdown, the report, code blocks found and preserved, whether front matter went."""
    o, report = o or MarkdownOptions(), Report()
    text = unify_newlines(text)
    front = _P["FRONTMATTER"].match(text) if o.strip_frontmatter else None
    if front:
        report.log("frontmatter", 0, front.end(), "Front matter")
        report.found("frontmatter", "Front matter", 1)
        text = text[front.end() :]
    found = kept = 0
    out: list[str] = []
    for s in segments(text):
        if s.fence is None:
            out += _prose(s.lines, o, report)
            continue
        found += 1
        lines = []
        for line in s.lines:
            bare, n = _FORCED.subn("", line)
            if n:
                report.log("code-invisible", 0, n, f"{n} invisible in code")
                report.found("code-block-invisible", "Invisible character in code")
            lines.append(bare)
        if o.strip_code_fences:
            report.log("code-fence", 0, 0, "Code fence")
            out += lines
        else:
            kept += 1
            out += [s.fence, *lines, *([] if s.closing is None else [s.closing])]
    text = "".join(f"{line}\n" for line in out)
    if o.strip_ai_signatures:
        text = _sign_off(text, report)
    text = regex.sub(r"\n{3,}", "\n\n", _disclaim(text, report)).strip("\n")
    return text + "\n" * o.strip_trailing_ws, report, found, kept, bool(front)


def detect(text: str) -> list[tuple]:
    """(type, description, line, column) of artifacts; signatures and disclaimers have line 0."""
    report, at = Report(), 0
    text = unify_newlines(text)
    for s in segments(text):
        for i, line in enumerate(s.lines):
            if s.fence is not None and _FORCED.search(line):
                report.found("code-block-invisible", "Invisible character in code", at + i + 2)
            elif s.fence is None and is_separator(line):
                report.found("invisible-separator", "Box-drawing line", at + i + 1)
        at += len(s.lines) + (0 if s.fence is None else 1 + (s.closing is not None))
    _sign_off(text, report)
    _disclaim(text, report)
    return report.artifacts


def cleaner(options: MarkdownOptions | None = None):
    """A UDF of a text."""

    @F.pandas_udf(schemas.MARKDOWN_CLEAN)
    @in_slices
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, items = ("type", "position", "length", "description"), ("type", "description", "line", "column")
        for s in batches:
            rows = []
            for t in s:
                if t is None:
                    rows.append((None,) * 6)
                    continue
                cleaned, report, found, kept, front = clean(t, options)
                rows.append((cleaned, [dict(zip(names, r, strict=True)) for r in report.removed], [dict(zip(items, a, strict=True)) for a in report.artifacts], found, kept, front))
            yield pd.DataFrame(rows, columns=["cleaned", "removed", "artifacts", "code_blocks_found", "code_blocks_preserved", "frontmatter_removed"]).astype({"code_blocks_found": "Int32", "code_blocks_preserved": "Int32", "frontmatter_removed": "boolean"})

    return run


def clean_markdown(text: Column, options: MarkdownOptions | None = None) -> Column:
    """A struct (see ``schemas.MARKDOWN_CLEAN``); fields are null for a null text."""
    return cleaner(options)(F.make_valid_utf8(text))


@vectorised(f"array<{schemas.ARTIFACT}>", texts=True)
def _detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = ("type", "description", "line", "column")
    for s in batches:
        yield s.map(lambda t: None if t is None else [dict(zip(names, a, strict=True)) for a in detect(t)])


@vectorised(f"array<{schemas.SEGMENT}>", texts=True)
def markdown_segments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Prose and code blocks of a text."""
    for s in batches:
        yield s.map(lambda t: None if t is None else [{"seg": i, "kind": "text" if x.fence is None else "code", "fence": x.fence, "closing": x.closing, "lines": x.lines} for i, x in enumerate(segments(unify_newlines(t)))])


def java(pattern: str) -> str:
    """The same pattern for Spark: Unicode classes, and a dot that stops at line feeds only."""
    return f"(?dU){pattern}"


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, HTML_COMMENT, "")


def without_signature(text: Column) -> Column:
    """Up to a signature. Only where it starts is matched, so that long tails can't exhaust the stack."""
    start = F.regexp_instr(text, F.lit(java(SIGNATURE)))
    # regexp_instr counts UTF-16 units: what precedes the match is taken by splitting, not by position
    head = F.element_at(F.split(text, java(SIGNATURE), 2), 1)
    return F.when(start > 0, F.concat(F.regexp_replace(head, r"(?U)\s+\z", ""), F.lit("\n"))).otherwise(text)


def without_boilerplate(text: Column) -> Column:
    return F.regexp_replace(text, f"(?dU){BOILERPLATE}", "")


_BOX = rf"\x{{{ord(BOX[0]):X}}}-\x{{{ord(BOX[1]):X}}}"


def separator_line(line: Column) -> Column:
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    box = F.regexp_count(bare, F.lit(rf"[\x{{{ord(BOX[0]):X}}}-\x{{{ord(BOX[1]):X}}}]"))
    return (F.length(bare) >= 3) & (box >= 3) & (box >= F.length(bare) - 2)


#: What a line is: prose, a fence that opens, code, a fence that closes.
PROSE, OPENS, CODE, CLOSES = "pock"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
_BLANK = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in _SPACES) + "]"


def line_roles(lines: Column) -> Column:
    """A letter for each line: a fold whose state is the mark of the fence that is open."""
    start = F.struct(F.lit("").alias("mark"), F.lit("").alias("block"), F.from_json(F.lit("[]"), "array<string>").alias("out"))

    def add(acc: Column, line: Column) -> Column:
        opening = F.regexp_extract(line, FENCE, 1)
        # as many of the same marks or more, and nothing else
        closing = F.regexp_extract(line, rf"^ {{0,3}}(`+|~+){_BLANK}*$", 1)
        closes = (F.length(closing) >= F.length(acc["mark"])) & (F.left(closing, F.lit(1)) == F.left(acc["mark"], F.lit(1)))
        outside = acc["mark"] == ""
        role = F.when(outside, F.when(opening == "", PROSE).otherwise(OPENS)).when(closes, CLOSES).otherwise(CODE)
        mark = F.when(outside, opening).when(closes, "").otherwise(acc["mark"])
        block, full = F.concat(acc["block"], role), F.length(acc["block"]) >= 1023
        return F.struct(mark.alias("mark"), F.when(full, "").otherwise(block).alias("block"), F.when(full, F.array_append(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lines, start, add, lambda acc: F.array_join(F.array_append(acc["out"], acc["block"]), ""))


def told_lines(text: Column) -> Column:
    """array<struct<line, role>> of a text with unified newlines; texts without a fence need no fold."""
    lines = F.split(text, "\n", -1)
    roles = F.when(F.rlike(text, F.lit(f"(?m){FENCE}")), line_roles(lines)).otherwise(F.repeat(F.lit(PROSE), F.size(lines)))
    return F.arrays_zip(lines.alias("line"), F.split(roles, "").alias("role"))


def detect_markdown(text: Column) -> Column:
    """Artifacts (type, description, line, column) of a text, null for a null one; signatures and disclaimers have line 0. Without Python. Bytes that aren't UTF-8 count as replacement characters."""
    text = newlines(F.make_valid_utf8(text))
    found = lambda kind, what, line=0: F.struct(F.lit(kind).alias("type"), F.lit(what).alias("description"), (F.lit(line) if isinstance(line, int) else line).cast("int").alias("line"), F.lit(0).alias("column"))
    none = F.from_json(F.lit("[]"), f"array<{schemas.ARTIFACT}>")

    def of_line(x: Column, i: Column) -> Column:
        hidden = (x["role"] == CODE) & F.rlike(x["line"], F.lit(java_class(FORCED)))
        drawn = (x["role"] == PROSE) & separator_line(x["line"])
        return F.when(hidden, found("code-block-invisible", "Invisible character in code", i + 1)).when(drawn, found("invisible-separator", "Box-drawing line", i + 1))

    by_line = F.when(F.rlike(text, F.lit(rf"{java_class(FORCED)}|[{_BOX}]")), F.array_compact(F.transform(told_lines(text), of_line))).otherwise(none)
    signed = F.when(F.rlike(text, F.lit(java(SIGNATURE))), F.array(found("ai-signature", "Signature of an AI tool"))).otherwise(none)
    disclaimed = F.array_repeat(found("ai-boilerplate", "Disclaimer of an AI tool"), F.regexp_count(text, F.lit(f"(?dU){BOILERPLATE}")))
    return F.when(text.isNotNull(), F.concat(by_line, signed, disclaimed))


def code_invisible(line: Column) -> Column:
    return F.regexp_replace(line, java_class(FORCED), "")


def line_rules(line: Column) -> dict[str, Column]:
    """Single rules as Column expressions, by name: what a line becomes, or whether it goes."""
    text = {
        "image": F.regexp_replace(line, IMAGE, ""),
        "link": F.regexp_replace(line, LINK, "$1"),
        "tag": F.regexp_replace(line, java(TAG), ""),
        "heading": F.regexp_replace(line, java(HEADING), "$2"),
        "blockquote": F.regexp_replace(line, java(BLOCKQUOTE), ""),
        "bullet": F.regexp_replace(line, java(r"^(\s*)[*+][ \t]+"), "$1- "),
        "task": F.regexp_replace(line, java(TASK), "$1- "),
        "emphasis": F.regexp_replace(line, java(EMPHASIS), "$2"),
        "inline_code": F.regexp_replace(line, INLINE_CODE, "$1"),
        "mention": F.regexp_replace(line, java(MENTION), ""),
        "trailing": F.regexp_replace(line, r"(?U)\s+$", ""),
    }
    dropped = {k: F.rlike(line, F.lit(java(p))) for k, p in (("rule", RULE), ("link_comment", LINK_COMMENT), ("empty_item", EMPTY_ITEM), ("table_row", TABLE_ROW), ("table_rule", TABLE_RULE))}
    return text | dropped | {"separator": separator_line(line)}
