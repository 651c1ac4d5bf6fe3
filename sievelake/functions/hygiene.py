"""Unicode hygiene: invisible characters, look-alike punctuation, compatibility forms.

Column functions stay in generated code. Only compatibility normalisation and the removal log need
Python, and only for rows with a character outside ASCII: see ``operators.text``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import schemas
from sievelake.functions.codepoints import ELLIPSIS, STRIP_NAMES, STRIPPED, SUBSTITUTED, java_class, narrowed, python_class
from sievelake.functions.vectorised import vectorised

STRIP_CLASS = narrowed(java_class(STRIPPED))
SUBSTITUTE_CLASS = narrowed(java_class("".join(SUBSTITUTED)))
HYGIENE_CLASS = narrowed(java_class(STRIPPED + "".join(SUBSTITUTED)))
ONE_TO_ONE = {k: v for k, v in SUBSTITUTED.items() if k != ELLIPSIS}
BEYOND_ASCII = r"[^\x00-\x7F]"
BLANKS = r"[ \t]{2,}"
_WORK = re.compile(python_class("".join(STRIP_NAMES) + "".join(SUBSTITUTED)))


def _settled(c: str) -> bool:
    """Whether compatibility normalisation leaves a character alone whatever stands beside it."""
    return c not in _SECONDS and not unicodedata.combining(c) and unicodedata.is_normalized("NFKC", c) and not 0x1160 <= ord(c) <= 0x11FF and not 0xD800 <= ord(c) <= 0xDFFF and unicodedata.category(c) != "Cn"


#: Characters that a composition can end in.
_SECONDS = {chr(int(p[1], 16)) for c in range(0x20000) if len(p := unicodedata.decomposition(chr(c)).split()) == 2 and not p[0].startswith("<")}


def _quick_class(least: int = 32) -> str:
    """All characters that aren't in a run of at least ``least`` which normalisation leaves alone: a text without any is normalised already."""
    safe, start = [], None
    for c in range(0x10000):
        if _settled(chr(c)) and c != 0xFFFD:
            start = c if start is None else start
        elif start is not None:
            safe, start = safe + [(start, c - 1)] * (c - start >= least), None
    return "[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in safe) + "]"


#: A text without such a character is in compatibility form. Code points beyond the basic plane and replacement characters are counted in.
QUICK_CLASS = _quick_class()
#: The same for Java, which looks at all spans only for a character outside the first two: ASCII and Latin letters, as most text is.
QUICK_NARROWED = f"[[{QUICK_CLASS[1 : QUICK_CLASS.index('}', QUICK_CLASS.index('-', QUICK_CLASS.index('-') + 1)) + 1]}]&&{QUICK_CLASS}]"


def strip_invisible(text: Column) -> Column:
    """Without the strippable code points; null stays null."""
    return F.regexp_replace(text, STRIP_CLASS, "")


def substitute_punctuation(text: Column) -> Column:
    """Spaces, dashes, quotes, primes and ellipses in ASCII."""
    plain = F.translate(text, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))
    # a look costs much less than the work, which few texts need
    return F.when(F.rlike(text, F.lit(SUBSTITUTE_CLASS)), F.replace(plain, F.lit(ELLIPSIS), F.lit("..."))).otherwise(text)


def tidy(text: Column) -> Column:
    """Stripped and substituted: hygiene short of compatibility normalisation."""
    return substitute_punctuation(strip_invisible(text))


def count_invisible(text: Column) -> Column:
    return F.regexp_count(text, F.lit(STRIP_CLASS))


def count_substituted(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SUBSTITUTE_CLASS))


def has_hygiene_work(text: Column) -> Column:
    return F.rlike(text, F.lit(HYGIENE_CLASS))


def beyond_ascii(text: Column) -> Column:
    """Only such rows can change or match by characters alone."""
    return F.rlike(text, F.lit(BEYOND_ASCII))


def may_change(text: Column) -> Column:
    """Whether compatibility normalisation may change a text. Only such texts need Python."""
    return F.rlike(text, F.lit(QUICK_NARROWED))


def confidence(items: Column) -> Column:
    """0 if nothing was removed, else half and a twentieth for each item, 1 at most."""
    return F.when(items > 0, F.least(F.lit(1.0), 0.5 + items * 0.05)).otherwise(0.0)


def collapse_whitespace(text: Column) -> Column:
    """Runs of blanks as one space."""
    return F.regexp_replace(text, BLANKS, " ")


def tokenize_words(text: Column) -> Column:
    """Letters, then letters, apostrophes and hyphens."""
    return F.regexp_extract_all(text, F.lit(r"(\p{L}[\p{L}'\-]*)"), 1)


def utf16_positions(text: str):
    """A function from an index in ``text`` to UTF-16 units."""
    wide = [i for i, c in enumerate(text) if c > "\uffff"] if not text.isascii() and max(text) > "\uffff" else []
    return (lambda i: i + bisect_left(wide, i)) if wide else (lambda i: i)


def clean(text: str) -> tuple[str, list[tuple], float]:
    """Cleaned text, removal log and confidence of one text."""
    if text.isascii():
        return text, [], 0.0
    at, out, log, last = utf16_positions(text), [], [], 0
    for m in _WORK.finditer(text):
        i, c = m.start(), m[0]
        out.append(text[last:i])
        last = i + 1
        if c in STRIP_NAMES:
            log.append(("unicode-strip", at(i), 1, STRIP_NAMES[c]))
        else:
            out.append(SUBSTITUTED[c])
            log.append(("unicode-substitute", at(i), 1, f"U+{ord(c):04X} to {SUBSTITUTED[c]!r}"))
    tidied = "".join([*out, text[last:]])
    normal = unicodedata.normalize("NFKC", tidied)
    if normal != tidied:
        log.append(("nfkc-normalization", 0, 0, "NFKC normalization"))
    return normal, log, min(1.0, 0.5 + 0.05 * len(log)) if log else 0.0


@vectorised("string", texts=True)
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    return _nfkc(text)


@vectorised(schemas.HYGIENE, texts=True)
def _hygiene(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = [(None, None, None) if t is None else clean(t) for t in s]
        yield pd.DataFrame(rows, columns=["cleaned", "removed", "confidence"])


def hygiene(text: Column) -> Column:
    """struct(cleaned, removed, confidence): strip, substitute, then normalise. Fields are null for a null text."""
    return _hygiene(text)
