"""The queries in DuckDB SQL."""

from __future__ import annotations

from sievelake.functions.codepoints import BIDI, EMOJI, FORCED, FULLWIDTH, HOMOGLYPHS, JOINERS, STRIPPED, SUBSTITUTED, TEMPLATE_TOKENS, VARIATION, ZERO_WIDTH, java_class, span
from sievelake.functions.hygiene import ONE_TO_ONE
from sievelake.functions.markdown import BLOCKQUOTE, BOILERPLATE, CO_AUTHORS, EMPTY_ITEM, FRONTMATTER, HEADING, HTML_COMMENT, IMAGE, INLINE_CODE, LINK, LINK_COMMENT, MAKERS, RULE, TABLE_ROW, TABLE_RULE, TAG, TASK, TOOLS
from sievelake.plans.planted import DOCUMENTS_SQL, planted_sql, quoted

STRIP, SUBST = java_class(STRIPPED), java_class("".join(SUBSTITUTED))
ZW, BI, JO, VS, FW, HG, EM = java_class(ZERO_WIDTH), java_class(BIDI), java_class(JOINERS), span(VARIATION), span(FULLWIDTH), java_class("".join(HOMOGLYPHS)), java_class(EMOJI)[:-1] + r"\x{10000}-\x{10FFFF}]"


def count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def strip(text: str = "text") -> str:
    return f"regexp_replace({text}, {quoted(STRIP)}, '', 'g')"


def substitute(text: str = "text") -> str:
    return f"replace(translate({text}, {quoted(''.join(ONE_TO_ONE))}, {quoted(''.join(ONE_TO_ONE.values()))}), chr(8230), '...')"


def matches(cls: str) -> str:
    return f"regexp_full_match(ch, {quoted(cls)})"


def runs(cls: str, least: int, first: str | None = None) -> str:
    """Islands of characters of a class, from the first of class ``first`` on."""
    start = f"min(i) FILTER (WHERE {matches(first or cls)})"
    return f"(SELECT doc_id, {start} AS i, max(i) - {start} + 1 AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM odd WHERE {matches(cls)}) GROUP BY doc_id, island HAVING max(i) - {start} + 1 >= {least})"


def singles(test: str, length: str = "1") -> str:
    return f"(SELECT doc_id, i, {length} AS length FROM odd WHERE {test})"


def beside_letter(cls: str) -> str:
    return singles(f"{matches(cls)} AND (regexp_matches(coalesce(p, ''), '^[A-Za-z]$') OR regexp_matches(coalesce(n, ''), '^[A-Za-z]$'))")


def beside_text(pattern: str) -> str:
    """Matches of a pattern that starts with a bracket, at the places of brackets."""
    return f"(SELECT doc_id, i, length(regexp_extract(rest, {quoted(pattern)})) AS length FROM brackets WHERE regexp_matches(rest, {quoted(pattern)}))"


EDGE = r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}\p{L}\p{Nd}]"
EMOJI_MORE = EM[:-1] + r"\x{200D}]"
TOKENS = "^(?:" + "|".join(t.replace("[", r"\[").replace("]", r"\]") for t in TEMPLATE_TOKENS) + ")"
THINK = "^</?[tT][hH][iI][nN][kK]>?"
#: vendor, pattern, confidence, matches (doc_id, i, length).
MATCHES = [
    ("Claude", "homoglyph-substitution", 0.85, beside_letter(HG)),
    ("Claude", "zero-width-sequence", 0.9, runs(ZW, 2)),
    ("Gemini", "variation-selector", 0.8, runs(VS, 1)),
    ("Gemini", "synthid-token-marker", 0.6, singles(f"{matches(ZW)} AND (p IS NULL OR regexp_full_match(p, {quoted(EDGE)})) AND (n IS NULL OR regexp_full_match(n, {quoted(EDGE)}))")),
    ("OpenAI", "mid-stream-joiner", 0.7, singles(f"i > 1 AND {matches(JO)}")),
    ("OpenAI", "bidi-override", 0.75, runs(BI, 1)),
    ("DeepSeek", "reasoning-block", 0.95, beside_text(THINK)),
    ("DeepSeek", "fullwidth-punctuation", 0.7, beside_letter(FW)),
    ("Grok", "emoji-burst", 0.6, runs(EMOJI_MORE, 3, EM)),
    ("Grok", "em-dash-cluster", 0.7, runs(r"[\x{2014}]", 3)),
    ("Mistral", "template-leak", 0.99, beside_text(TOKENS)),
]
#: Characters with their neighbours; only odd ones can be part of a match.
CHARS = r"""chars AS (SELECT doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS ch FROM (SELECT doc_id, string_split(text, '') AS cs FROM planted)),
near AS (SELECT *, lag(ch) OVER w AS p, lead(ch) OVER w AS n FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
odd AS MATERIALIZED (SELECT * FROM near WHERE ch > '~' OR ch IN ('<', '[')),
brackets AS MATERIALIZED (SELECT doc_id, i, substr(text, i, 8) AS rest FROM odd JOIN planted USING (doc_id) WHERE ch IN ('<', '['))"""
FOUND = " UNION ALL ".join(f"SELECT doc_id, '{v}' AS vendor, '{p}' AS pattern, {c}::DOUBLE AS confidence, i - 1 AS position, length FROM {rows}" for v, p, c, rows in MATCHES)


def with_documents(body: str) -> str:
    return f"WITH {DOCUMENTS_SQL} {body}"


def md5(text: str) -> str:
    return f"md5({text})"


LINE_SQL = r"""
, lines AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS line_no FROM planted)
SELECT doc_id, line_no,
  regexp_replace(line, '!\[[^\]]*\]\([^)]*\)', '', 'g') AS image,
  regexp_replace(line, '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS link,
  regexp_replace(line, '</?[a-zA-Z][a-zA-Z0-9-]*(?:\s[^>]*)?/?>', '', 'g') AS tag,
  regexp_replace(line, '^(#{1,6})[ \t]+(.*)$', '\2') AS heading,
  regexp_replace(line, '^\s*>[ \t]?', '') AS blockquote,
  regexp_replace(line, '^(\s*)[*+][ \t]+', '\1- ') AS bullet,
  regexp_replace(line, '^(\s*)[-*+][ \t]+\[[ xX]\][ \t]?', '\1- ') AS task,
  regexp_replace(line, '\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*|_(.+?)_', '\1\2\3\4', 'g') AS emphasis,
  regexp_replace(line, '`([^`]+)`', '\1', 'g') AS inline_code,
  regexp_replace(line, '(^|\s)[@#][A-Za-z0-9_]+', '\1', 'g') AS mention,
  regexp_replace(line, '[\s\x{A0}]+$', '') AS trailing,
  regexp_matches(line, '^\s*(?:-[ \t]*(?:-[ \t]*){2,}|\*[ \t]*(?:\*[ \t]*){2,}|_[ \t]*(?:_[ \t]*){2,})$') AS rule,
  regexp_matches(line, '^\s*\[//\]:\s*#\s*\(.*\)\s*$') AS link_comment,
  regexp_matches(line, '^\s*[-*+][ \t]*$') AS empty_item,
  regexp_matches(line, '^\s*\|.*\|\s*$') AS table_row,
  regexp_matches(line, '^\s*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?\s*$') AS table_rule,
  length(trim(line)) >= 3 AND len(regexp_extract_all(line, '[\x{2500}-\x{257F}]')) >= greatest(3, length(trim(line)) - 2) AS separator
FROM lines
"""

SIGNATURE = rf"(?is)(?:\n[ \t]*)*\n?(?:-{{2,}}\s*\n)?[ \t]*(?:\x{{1F916}}\s*)?(?:_?(?:{MAKERS})\s+(?:with|by|using)\s+\[?(?:{TOOLS})\b|Co-Authored-By:\s*(?:{CO_AUTHORS})|\x{{1F916}}\s*Generated with).*$"
BOILER = BOILERPLATE

PNG = """
WITH p AS (SELECT *, p_partkey % 7 = 0 AS broken, p_partkey % 2 = 0 AS named, p_partkey % 5 = 0 AS signed FROM part)
"""
EXT = "list_value('.md', '.PNG', '.txt', '', '.exe', '.html', '.tar.gz', '.Docx')[p_partkey % 8 + 1]"


FULL = "".join(chr(c) for c in range(ord(FULLWIDTH[0]), ord(FULLWIDTH[1]) + 1))
FOLDED = "".join(chr(ord(c) - 0xFEE0) for c in FULL)


def compatible(text: str) -> str:
    """NFKC as far as the planted texts need it: fullwidth forms."""
    return f"translate({text}, {quoted(FULL)}, {quoted(FOLDED)})"


def folded(keep: str, change: str) -> str:
    """Texts put together again from their characters: one beside an ASCII letter is changed, others are as ``keep`` says."""
    return f"(SELECT doc_id, string_agg(CASE WHEN {keep} THEN '' WHEN {change} AND (regexp_matches(coalesce(p, ''), '^[A-Za-z]$') OR regexp_matches(coalesce(n, ''), '^[A-Za-z]$')) THEN translate(ch, {quoted(''.join(HOMOGLYPHS) + FULL)}, {quoted(''.join(HOMOGLYPHS.values()) + FOLDED)}) ELSE ch END, '' ORDER BY i) AS t FROM near GROUP BY doc_id)"


SPLIT_LINES = r"""lines AS (SELECT doc_id, line, line_no, count(*) FILTER (WHERE fence) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences, fence
 FROM (SELECT doc_id, line, line_no, regexp_matches(line, '^ {0,3}(`{3,}|~{3,})') AS fence FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM planted))))"""
#: A fence opens where an odd number of them has come; prose is what stands after an even number, but for the fence itself.
SEGMENTS = r""", parts AS (SELECT doc_id, fences, fences % 2 = 1 OR fence AS code, line, fence FROM lines),
grouped AS (SELECT doc_id, CASE WHEN code THEN (fences + 1) // 2 * 2 - 1 ELSE fences END AS block, code, max(line) FILTER (WHERE fence AND fences % 2 = 1) AS opening, count(*) FILTER (WHERE NOT fence) AS n FROM parts GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INT AS seg, CASE WHEN code THEN 'code' ELSE 'text' END AS kind, opening AS fence, n AS lines FROM grouped"""
ARTIFACTS = rf"""SELECT doc_id, 'code-block-invisible' AS type, line_no AS line FROM lines WHERE fences % 2 = 1 AND NOT fence AND regexp_matches(line, {quoted(java_class(FORCED))})
UNION ALL SELECT doc_id, 'invisible-separator', line_no FROM lines WHERE fences % 2 = 0 AND NOT fence AND length(trim(line)) >= 3 AND len(regexp_extract_all(line, '[\x{{2500}}-\x{{257F}}]')) >= greatest(3, length(trim(line)) - 2)
UNION ALL SELECT doc_id, 'ai-signature', 0 FROM planted WHERE regexp_matches(text, {quoted(SIGNATURE)})
UNION ALL SELECT doc_id, 'ai-boilerplate', 0 FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(BOILER)})) FROM planted)"""
MEDIA = "WITH p AS (SELECT *, p_partkey % 5 AS f, p_partkey % 2 = 0 AS second, p_partkey % 3 = 0 AS third, '/m/' || p_partkey || (['.jpg', '.webp', '.mp4', '.heic', '.rtf'])[p_partkey % 5 + 1] AS path FROM part)"
ENTRIES = [
    ("f = 0 AND second", "'EXIF', 'APP1/Exif', 'EXIF metadata block'"), ("f = 0 AND third", "'XMP', 'APP1/XMP', 'XMP packet'"), ("f = 0", "'COM', 'Comment', p_name"),
    ("f = 1 AND second", "'EXIF', 'EXIF', 'EXIF metadata block'"), ("f = 1 AND third", "'XMP', 'XMP ', 'XMP packet'"), ("f = 2 AND second", "'USER_DATA', 'udta', 'user-data box'"),
    ("f = 3 AND second", "'EXIF', 'Exif', 'EXIF box'"), ("f = 3 AND third", "'XMP', 'uuid/XMP', 'XMP packet in UUID box'"), ("f = 4", "'RTF/info', 'author', p_name"),
]


# without back references and looks behind
OTHER_BULLET, PLAIN_MENTION = r"^(\s*)[*+][ \t]+", r"(^|\s)[@#][A-Za-z0-9_]+"
PLAIN_EMPHASIS = r"\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*|_(.+?)_"


def markdown_sql(every: bool) -> str:
    """The whole clean-up, with all options or the default ones: each rule is a step over the lines of prose, which counts what it removes."""
    tidy = compatible(substitute(strip("b")))
    sep = "length(trim(l)) >= 3 AND len(regexp_extract_all(l, '[\\x{2500}-\\x{257F}]')) >= greatest(3, length(trim(l)) - 2)"
    forced = java_class(FORCED)
    steps = []
    def step(name, src, expr, items="0"):
        steps.append(f"{name} AS (SELECT * REPLACE ({expr} AS l, it + {items} AS it) FROM {src})")
    src="kept"
    def rule(name, expr, items="0"):
        nonlocal src
        step(name, src, expr, items); src=name
    rule("r1", f"regexp_replace(l, {quoted(IMAGE)}, '', 'g')", count(IMAGE, 'l'))
    if every: rule("r2", f"regexp_replace(l, {quoted(LINK)}, '\\1', 'g')")
    rule("r3", f"regexp_replace(l, {quoted(TAG)}, '', 'g')", count(TAG, 'l'))
    if every:
        rule("r4", f"CASE WHEN regexp_matches(l, {quoted(TASK)}) THEN CASE WHEN trim(regexp_replace(l, {quoted(TASK)}, '')) = '' THEN NULL ELSE regexp_extract(l, {quoted(TASK)}, 1) || '- ' || trim(regexp_replace(l, {quoted(TASK)}, '')) END ELSE l END", f"regexp_matches(l, {quoted(TASK)})::INT")
    rule("r5", f"regexp_replace(l, {quoted(HEADING)}, '\\2')", f"coalesce(regexp_matches(l, {quoted(HEADING)})::INT, 0)")
    if every:
        rule("r6", f"regexp_replace(l, {quoted(BLOCKQUOTE)}, '')", f"coalesce(regexp_matches(l, {quoted(BLOCKQUOTE)})::INT, 0)")
        rule("r7", f"CASE WHEN regexp_matches(l, {quoted(TABLE_ROW)}) THEN CASE WHEN regexp_matches(l, {quoted(TABLE_RULE)}) THEN NULL ELSE array_to_string(list_transform(string_split(trim(trim(l), '|'), '|'), lambda c: trim(c)), '  ') END ELSE l END", f"coalesce((regexp_matches(l, {quoted(TABLE_ROW)}) AND NOT regexp_matches(l, {quoted(TABLE_RULE)}))::INT, 0)")
    rule("r8", f"regexp_replace(l, {quoted(OTHER_BULLET)}, '\\1- ')")
    if every:
        rule("r9", f"regexp_replace(l, {quoted(PLAIN_EMPHASIS)}, '\\1\\2\\3\\4', 'g')")
        rule("r10", f"regexp_replace(l, {quoted(INLINE_CODE)}, '\\1', 'g')")
    rule("r11", f"regexp_replace(l, {quoted(PLAIN_MENTION)}, '\\1', 'g')", f"coalesce({count(PLAIN_MENTION, 'l')}, 0)")
    rule("r12", f"CASE WHEN regexp_matches(l, {quoted(EMPTY_ITEM)}) THEN NULL ELSE l END", f"coalesce(regexp_matches(l, {quoted(EMPTY_ITEM)})::INT, 0)")
    rule("r13", "rtrim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(160))")
    code_keep = "NOT fence" if every else "TRUE"
    return f"""WITH {DOCUMENTS_SQL.replace('planted AS', 'raw AS', 1)},
uni AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM raw),
planted AS (SELECT doc_id, regexp_replace(text, {quoted(FRONTMATTER)}, '') AS text FROM uni), fronts AS (SELECT doc_id, regexp_matches(text, {quoted(FRONTMATTER)}) AS front FROM uni),
{SPLIT_LINES},
roles AS (SELECT doc_id, line_no, line, fence, fences % 2 = 1 OR fence AS code, CASE WHEN fences % 2 = 1 OR fence THEN (fences + 1) // 2 * 2 - 1 ELSE fences END AS block FROM lines),
codes AS (SELECT doc_id, block, line_no AS p, 0 AS p2, CASE WHEN fence THEN line ELSE regexp_replace(line, {quoted(forced)}, '', 'g') END AS l, (NOT fence AND regexp_matches(line, {quoted(forced)}))::INT AS it, (NOT fence AND regexp_matches(line, {quoted(forced)}))::INT AS art FROM roles WHERE code AND ({code_keep} OR NOT fence)),
blocks AS (SELECT doc_id, block, min(line_no) AS p, string_agg(line, chr(10) ORDER BY line_no) AS t FROM roles WHERE NOT code GROUP BY ALL),
uncommented AS (SELECT *, regexp_replace(t, {quoted(HTML_COMMENT)}, '', 'g') AS b, {count(HTML_COMMENT, 't')} AS comments FROM blocks),
tidied AS (SELECT *, {tidy} AS c, {count(STRIP,'b')} + {count(SUBST,'b')} + ({tidy} <> {substitute(strip('b'))})::INT AS hyg FROM uncommented),
prose AS (SELECT doc_id, block, p, generate_subscripts(string_split(c, chr(10)), 1) AS p2, unnest(string_split(c, chr(10))) AS l, 0 AS it, 0 AS art FROM tidied),
marked AS (SELECT * REPLACE (({sep})::INT AS art), CASE WHEN {sep} OR regexp_matches(l, {quoted(RULE)}) OR regexp_matches(l, {quoted(LINK_COMMENT)}) THEN 1 ELSE 0 END AS gone FROM prose),
kept AS (SELECT * FROM marked WHERE gone = 0),
{', '.join(steps)},
lines_left AS (SELECT doc_id, p, p2, l, it, art FROM codes UNION ALL SELECT doc_id, p, p2, l, it, art FROM {src} UNION ALL SELECT doc_id, p, p2, NULL, gone, art FROM marked WHERE gone = 1),
joined AS (SELECT doc_id, coalesce(string_agg(l || chr(10), '' ORDER BY p, p2) FILTER (WHERE l IS NOT NULL), '') AS t, sum(it)::BIGINT AS it, sum(art)::BIGINT AS art FROM lines_left GROUP BY doc_id),
items AS (SELECT doc_id, sum(comments + hyg)::BIGINT AS n FROM tidied GROUP BY doc_id),
signed AS (SELECT *, regexp_matches(t, {quoted(SIGNATURE)})::INT AS sg, CASE WHEN regexp_matches(t, {quoted(SIGNATURE)}) THEN rtrim(regexp_replace(t, {quoted(SIGNATURE)}, ''), ' ' || chr(9) || chr(10)) || chr(10) ELSE t END AS s FROM joined),
done AS (SELECT *, {count(BOILER,'s')} AS bp, trim(regexp_replace(regexp_replace(s, {quoted(BOILER)}, '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) || chr(10) AS cleaned FROM signed),
counts AS (SELECT doc_id, count(DISTINCT block) FILTER (WHERE code)::INT AS blocks FROM roles GROUP BY doc_id)
SELECT doc_id, md5(cleaned) AS cleaned_md5, {'' if every else 'it + coalesce(items.n, 0) + front::INT + sg + bp AS removed, art + front::INT + sg + bp AS artifacts, '}blocks AS code_blocks_found, {'0' if every else 'blocks'} AS code_blocks_preserved{'' if every else ', front AS frontmatter_removed'}
FROM done JOIN fronts USING (doc_id) JOIN counts USING (doc_id) LEFT JOIN items USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    tokens = " + ".join(count(t.replace("[", r"\[").replace("]", r"\]"), "text") for t in TEMPLATE_TOKENS)
    return {
        "hygiene_strip": with_documents(f"SELECT doc_id, {strip()} AS cleaned, {count(STRIP)} AS stripped FROM planted"),
        "hygiene_substitute": with_documents(f"SELECT doc_id, {substitute()} AS cleaned, {count(SUBST)} AS substituted FROM planted"),
        "hygiene_confidence": with_documents(f", n AS (SELECT doc_id, text, {count(STRIP)} + {count(SUBST)} AS items FROM planted) SELECT doc_id, items, CASE WHEN items > 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + items * 0.05::DOUBLE) ELSE 0.0::DOUBLE END AS confidence, md5({substitute(strip())}) AS cleaned_md5 FROM n"),
        "hygiene_nfkc": with_documents(f"SELECT doc_id, md5({compatible(substitute(strip()))}) AS normalised_md5 FROM planted"),
        "clean_text": f"WITH {DOCUMENTS_SQL.replace('planted AS', 'raw AS', 1)}, planted AS (SELECT doc_id, lang, source, {compatible(substitute(strip()))} AS text FROM raw), {CHARS}, found AS ({FOUND}), folded AS {folded('false', matches(HG))}, marks AS (SELECT doc_id, count(*) AS n, count(DISTINCT vendor) AS vendors, max(confidence) AS c FROM found GROUP BY doc_id), done AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {quoted(VS)}, '', 'g'), {quoted(THINK[1:])}, '', 'g'), '({EM}){EM}*', '\\1', 'g'), {quoted(TOKENS[1:])}, '', 'g') AS t FROM folded), items AS (SELECT r.doc_id, {count(STRIP, 'r.text')} + {count(SUBST, 'r.text')} + (p.text <> {substitute(strip('r.text'))})::INT AS n FROM raw r JOIN planted p USING (doc_id)) SELECT doc_id, md5(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g')) AS cleaned_md5, items.n + coalesce(vendors, 0) + regexp_matches(t, '[ \\t]{{2,}}')::INT AS removed, coalesce(marks.n, 0) AS detections, greatest(coalesce(c, 0.0::DOUBLE), CASE WHEN items.n > 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + items.n * 0.05::DOUBLE) ELSE 0.0::DOUBLE END) AS confidence FROM done JOIN items USING (doc_id) LEFT JOIN marks USING (doc_id)",
        "remove_markup": with_documents(f", {CHARS}, claude AS {folded(matches(ZW), matches(HG))}, deep AS {folded('false', matches(FW))} SELECT doc_id, md5(claude.t) AS claude_md5, md5(regexp_replace(deep.t, {quoted(THINK[1:])}, '', 'g')) AS deepseek_md5, md5(regexp_replace(regexp_replace(text, '({EM}){EM}*', '\\1', 'g'), '\\x{{2014}}+', chr(8212), 'g')) AS grok_md5, md5(regexp_replace(text, {quoted(TOKENS[1:])}, '', 'g')) AS mistral_md5 FROM planted JOIN claude USING (doc_id) JOIN deep USING (doc_id)"),
        "markdown_clean": markdown_sql(every=False),
        "markdown_strip_all": markdown_sql(every=True),
        "markdown_segments": with_documents(f", {SPLIT_LINES}{SEGMENTS}"),
        "markdown_detect": with_documents(f", {SPLIT_LINES} {ARTIFACTS}"),
        "media_inspect": f"{MEDIA} " + " UNION ALL ".join(f"SELECT path, {entry}, NULL FROM p WHERE {where}" if i else f"SELECT path, {entry.split(', ')[0]} AS container, {entry.split(', ')[1]} AS key, {entry.split(', ')[2]} AS value, NULL AS error_code FROM p WHERE {where}" for i, (where, entry) in enumerate(ENTRIES)),
        "media_clean": f"{MEDIA} SELECT path, CASE f WHEN 0 THEN 1 + second::INT + third::INT WHEN 2 THEN second::INT WHEN 4 THEN 1 ELSE second::INT + third::INT END AS removed, CASE f WHEN 0 THEN 4 + strlen(p_name) + 11 * second::INT + 34 * third::INT WHEN 1 THEN 12 * (second::INT + third::INT) WHEN 4 THEN 8 + strlen(p_name) ELSE 0 END AS bytes_less, NULL AS error_code FROM p",
        "image_regions": "SELECT p_partkey, p_partkey % 7 AS x, p_partkey % 5 AS y, p_partkey % 11 + 2 AS width, p_partkey % 13 + 2 AS height, 1.0::DOUBLE AS confidence FROM part WHERE (p_partkey % 11 + 2) * (p_partkey % 13 + 2) >= 16",
        "signal_bursts": with_documents(f", {CHARS}, found AS ({FOUND}), events AS (SELECT source, doc_id * 60 AS t, count(*) AS n FROM found JOIN planted USING (doc_id) GROUP BY ALL), cut AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source ORDER BY t) < 1830 THEN 0 ELSE 1 END AS new FROM events), ses AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY t) AS s FROM cut) SELECT source, min(t) AS session_start, max(t) + 1830 AS session_end, sum(n)::BIGINT AS matches FROM ses GROUP BY source, s"),
        "hygiene_log": with_documents(f", {CHARS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS item, CASE WHEN {matches(STRIP)} THEN 'unicode-strip' ELSE 'unicode-substitute' END AS type, i - 1 AS position, 1 AS length FROM odd WHERE {matches(STRIP)} OR {matches(SUBST)}"),
        "codepoint_inventory": with_documents(f", c AS (SELECT lang, unnest(regexp_extract_all(text, {quoted(f'{STRIP}|{SUBST}')})) AS ch FROM planted) SELECT lang, upper(printf('%04x', ord(ch))) AS codepoint, count(*) AS occurrences FROM c GROUP BY lang, ch"),
        "collapse_whitespace": with_documents(r"SELECT doc_id, md5(regexp_replace(text, '[ \t]{2,}', ' ', 'g')) AS cleaned_md5 FROM planted"),
        "word_tokens": with_documents(r", w AS (SELECT lang, len(regexp_extract_all(text, '\p{L}[\p{L}''\-]*')) AS n FROM planted) SELECT lang, sum(n)::BIGINT AS words, max(n) AS most FROM w GROUP BY lang"),
        "signal_counts": with_documents(f", {CHARS}, found AS ({FOUND}) SELECT lang, source, vendor, pattern, count(*) AS matches, count(DISTINCT doc_id) AS texts FROM found JOIN planted USING (doc_id) GROUP BY ALL"),
        "detect_text": with_documents(f", {CHARS} {FOUND}"),
        "remove_controls": with_documents(f"SELECT doc_id, md5(regexp_replace(text, {quoted(f'{JO}|{BI}')}, '', 'g')) AS controls_md5, md5(regexp_replace(text, {quoted(f'{VS}|{ZW}')}, '', 'g')) AS selectors_md5 FROM planted"),
        "markdown_lines": with_documents(LINE_SQL),
        "markdown_blocks": with_documents(rf"SELECT doc_id, md5(regexp_replace(text, '\A---\r?\n(?s:.*?)\r?\n---[ \t]*\r?\n?', '')) AS frontmatter_md5, md5(regexp_replace(text, '<!--(?s:.*?)-->', '', 'g')) AS comments_md5, md5(CASE WHEN regexp_matches(text, {quoted(SIGNATURE)}) THEN rtrim(regexp_replace(text, {quoted(SIGNATURE)}, ''), ' ' || chr(9) || chr(10)) || chr(10) ELSE text END) AS signature_md5, md5(regexp_replace(text, {quoted(BOILER)}, '', 'g')) AS boilerplate_md5 FROM planted"),
        "html_metadata": "SELECT 'HTML/meta' AS container, key, value, count(*) AS files FROM pages, (VALUES ('Generator', 'site builder'), ('article:author', 'A. Writer')) v(key, value) WHERE page_id % 3 = 0 GROUP BY ALL",
        "png_inspect": PNG + "SELECT '/i/' || p_partkey || '.png' AS path, 'XMP/Text' AS container, 'tEXt' AS key, 'tEXt textual metadata' AS value, NULL AS error_code FROM p WHERE named AND NOT broken UNION ALL SELECT '/i/' || p_partkey || '.png', 'C2PA', 'caBX', 'C2PA manifest chunk', NULL FROM p WHERE signed AND NOT broken UNION ALL SELECT '/i/' || p_partkey || '.png', NULL, NULL, NULL, 'METADATA_STRIP_FAILED' FROM p WHERE broken",
        "png_clean": PNG + "SELECT '/i/' || p_partkey || '.png' AS path, '/i/' || p_partkey || '.cleaned.png' AS output_path, CASE WHEN NOT broken THEN named::INT END AS removed, CASE WHEN NOT broken THEN CASE WHEN named THEN 19 + strlen(p_name) ELSE 0 END END AS bytes_less, CASE WHEN broken THEN 'METADATA_STRIP_FAILED' END AS error_code FROM p",
        "classify_files": f"WITH f AS (SELECT {EXT} AS ext, '/in.d/' || p_partkey || {EXT} AS path FROM part) SELECT path, CASE WHEN ext = '.md' THEN 'markdown' WHEN ext IN ('.PNG', '.html', '.Docx') THEN 'metadata' WHEN ext IN ('.txt', '') THEN 'text' ELSE 'unsupported' END AS pipeline, ext IN ('.PNG', '.html', '.Docx') AS supported, regexp_replace(path, '(\\.[^./]+)$', '') || '.cleaned' || regexp_extract(path, '(\\.[^./]+)$', 1) AS output_path FROM f",
        "batch_outcomes": f"WITH f AS (SELECT {EXT} AS ext, p_partkey FROM part) SELECT CASE WHEN ext = '.md' THEN 'markdown' WHEN ext IN ('.PNG', '.html', '.Docx') THEN 'metadata' WHEN ext IN ('.txt', '') THEN 'text' ELSE 'unsupported' END AS pipeline, CASE WHEN ext = '.Docx' OR ext = '.PNG' AND p_partkey % 16 <> 1 THEN 'failed' WHEN ext IN ('.exe', '.tar.gz') THEN 'skipped' ELSE 'succeeded' END AS status, count(*) AS files FROM f GROUP BY ALL",
        "written_files": rf"""WITH f AS (SELECT {EXT} AS ext, p_partkey AS k, p_name FROM part),
 chunk AS (SELECT *, unhex('89504E470D0A1A0A0000000D49484452' || repeat('00', 17)) || CASE WHEN k % 5 = 0 THEN unhex('00000004636142586A756D6200000000') ELSE ''::BLOB END || unhex('0000000049454E4400000000') AS png FROM f)
 SELECT k || CASE WHEN ext = '.tar.gz' THEN '.tar' ELSE '' END || '.cleaned' || ext AS name, octet_length(body) AS length, md5(body) AS content_md5
 FROM (SELECT k, ext, CASE ext WHEN '.md' THEN encode(p_name || chr(10)) WHEN '.PNG' THEN png ELSE encode('# ' || p_name || chr(10)) END AS body FROM chunk WHERE ext IN ('.md', '.txt', '', '.html') OR ext = '.PNG' AND k % 16 = 1)""",
        "custom_signals": """WITH items AS (SELECT item_id::VARCHAR AS pattern, array_to_string(string_split(text, ' ')[:8], ' ') AS lit FROM benchmark),
 found AS (SELECT lang, pattern, (length(d.text) - length(replace(d.text, lit, ''))) // length(lit) AS n FROM documents d JOIN items ON contains(d.text, lit))
 SELECT lang, 'benchmark' AS vendor, pattern, sum(n)::BIGINT AS matches, count(*) AS texts FROM found GROUP BY lang, pattern""",
        "custom_matches": with_documents(r"""SELECT doc_id, 'heading' AS pattern, 0.5::DOUBLE AS confidence, strpos(text, '# Head') - 1 AS position, 6 AS length FROM planted WHERE contains(text, '# Head')
 UNION ALL SELECT doc_id, 'rule', 0.4::DOUBLE, list_sum(list_transform(pieces[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(runs[:i - 1], lambda x: length(x))), 0), length(runs[i])
 FROM (SELECT doc_id, string_split_regex(text, '\*{3,}') AS pieces, regexp_extract_all(text, '\*{3,}') AS runs, unnest(range(1, len(regexp_extract_all(text, '\*{3,}')) + 1)) AS i FROM planted)"""),
        "last_click": "WITH c AS (SELECT user_id, ts, max(struct_pack(e := event_id, v := value)) AS s FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT p.event_id, p.user_id, s.e AS click_id, s.v AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts",
        "purchases_after_errors": "SELECT p.event_id, e.event_id AS error_id FROM events p JOIN events e ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.event_type = 'error' AND e.ts <= p.ts AND p.ts < e.ts + INTERVAL 12 HOUR",
        "turn_tokens": "WITH t AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT conv_id, turn AS started, next AS ended, '[INST]' AS token FROM t WHERE turn % 2 = 0 AND next % 2 = 1",
        "lateral_matches": with_documents(f", {CHARS}, found AS ({FOUND}) SELECT lang, vendor, pattern, count(*) AS matches, count(DISTINCT doc_id) AS texts FROM found JOIN planted USING (doc_id) GROUP BY ALL"),
        "signals_by_label": with_documents(f"SELECT quality, toxic, count(*) AS documents, sum(CASE WHEN {count(STRIP)} > 0 THEN 1 ELSE 0 END)::BIGINT AS with_hidden FROM planted JOIN labels USING (doc_id) GROUP BY quality, toxic"),
        "top_sources": with_documents(f"SELECT source, count(*) AS documents, sum({count(STRIP)})::BIGINT AS invisible, round(sum({count(STRIP)})::DOUBLE / count(*), 6) AS rate FROM planted GROUP BY source ORDER BY rate DESC, source LIMIT 5"),
        "conversation_tokens": f"WITH t AS (SELECT conv_id, turn, role, {planted_sql('(conv_id + turn)', 'text')} AS text FROM conversations), c AS (SELECT conv_id, turn, role, {tokens} AS tokens FROM t) SELECT conv_id, turn, role, tokens, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c",
        "signal_rollup": with_documents(f"SELECT lang, source, count(*) AS documents, sum({count(STRIP)})::BIGINT AS invisible, sum({count(SUBST)})::BIGINT AS substituted FROM planted GROUP BY ROLLUP (lang, source)"),
        "json_rows": with_documents(f"SELECT to_json(struct_pack(doc_id := doc_id, lang := lang, invisible := {count(STRIP)}))::VARCHAR AS value FROM planted"),
        "event_budgets": """WITH n AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400 AS window_start, event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS place FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL)
 SELECT user_id, window_start, event_id, place, 0::BIGINT AS rejected FROM n WHERE place <= 3 UNION ALL SELECT user_id, window_start, NULL, NULL, count(*) FROM n WHERE place > 3 GROUP BY ALL""",
        "stream_rates": with_documents(f", {CHARS}, found AS ({FOUND}) SELECT (doc_id * 60) // 7200 * 7200 AS window_start, vendor, pattern, count(*) AS matches FROM found GROUP BY ALL"),
    }
