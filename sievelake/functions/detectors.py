"""Heuristic detectors of hidden or machine-made marks, and the clean-up of corpus junk.

A detector is a pattern over a text, so that its matches, their places and their number are Column expressions. Detectors are in a ``Registry``, which is a value: one with more detectors can be given
to every operator and goes to the executors with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import schemas
from sievelake.functions.codepoints import BIDI, EM_DASH, EMOJI, FULLWIDTH, HOMOGLYPHS, JOINERS, TEMPLATE_TOKENS, VARIATION, ZERO_WIDTH, java_class, narrowed, span
from sievelake.functions.hygiene import utf16_positions
from sievelake.functions.spans import located
from sievelake.functions.vectorised import in_slices

LETTER = "[A-Za-z]"
WIDE = r"\x{10000}-\x{10FFFF}"
_EMOJI = f"{java_class(EMOJI)[:-1]}{WIDE}]"
#: The characters of matches, as classes that Java and Python read alike.
CLASSES = {
    "homoglyph": java_class("".join(HOMOGLYPHS)),
    "zero": java_class(ZERO_WIDTH),
    "joiner": java_class(JOINERS),
    "bidi": java_class(BIDI),
    "full": span(FULLWIDTH),
    "variation": span(VARIATION),
    "emoji": _EMOJI,
    "emoji_more": rf"{_EMOJI[:-1]}\x{{200D}}]",
    "dash": java_class(EM_DASH),
}
_TOKENS = "|".join(regex.escape(t) for t in TEMPLATE_TOKENS)
_THINK = r"</?[tT][hH][iI][nN][kK\x{212A}]>?"
#: White space, letters and decimal digits of the basic plane: what a marker may stand between.
_EDGE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{L}\p{Nd}&&[^\x{10000}-\x{10FFFF}]]"
#: What can't be part of a match, but for brackets.
_COMMON = r"[\x00-;=-Z\\-\x{390}]+"


def beside_letter(one: str) -> str:
    """The rare class first, then its neighbours, so that most characters are passed over at a glance."""
    return f"{one}(?:(?<={LETTER}{one})|(?={LETTER}))"


@dataclass(frozen=True)
class Detector:
    """``form`` is the pattern, with a name for each of CLASSES, in a syntax that Java and Python share; ``needs`` is the class that any match has a character of, if
    there is one; ``least`` is the least length of a match in UTF-16 units. Any match contains ``literal``, if given: then texts without it cost next to nothing."""

    vendor: str
    pattern: str
    confidence: float
    form: str
    needs: str | None = None
    least: int = 1
    keep: Callable[[str, int, int], bool] | None = None
    literal: str | None = None

    @classmethod
    def of_literal(cls, vendor: str, pattern: str, confidence: float, literal: str) -> Detector:
        """Finds a text as it is."""
        if not literal:
            raise ValueError("an empty text is found everywhere")
        return cls(vendor, pattern, confidence, regex.escape(literal, special_only=True).replace("%", "%%"), literal=literal)

    @property
    def name(self) -> str:
        return f"{self.vendor}_{self.pattern}".lower().replace("-", "_")

    @property
    def java(self) -> str:
        return self.form % {k: narrowed(v) for k, v in CLASSES.items()}

    @property
    def carriers(self) -> str:
        return CLASSES.get(self.needs, self.needs)

    def count(self, text: Column) -> Column:
        """Matches in a text, as a Column expression."""
        if self.least > 1:
            found = F.regexp_extract_all(text, F.lit(f"({self.java})"), 1)
            return F.size(F.filter(found, lambda m: F.octet_length(F.encode(m, "UTF-16BE")) >= 2 * self.least))
        found = F.regexp_count(text, F.lit(self.java))
        return found if self.literal is None else F.when(F.contains(text, F.lit(self.literal)), found).otherwise(0)


    def matches(self, text: Column) -> Column:
        """All matches of a text with positions, as a Column expression."""
        spans = located(text, self.java)
        if self.least > 1:
            spans = F.filter(spans, lambda m: m["length"] >= self.least)
        return F.transform(spans, lambda m: F.struct(F.lit(self.vendor).alias("vendor"), F.lit(self.pattern).alias("pattern"), F.lit(float(self.confidence)).alias("confidence"), m["position"].alias("position"), m["length"].alias("length")))


def _is_edge(c: str) -> bool:
    return c <= "\uffff" and (c.isspace() and c not in "\x1c\x1d\x1e\x1f" or unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"))


def _isolated(text: str, start: int, end: int) -> bool:
    return (start == 0 or _is_edge(text[start - 1])) and (end == len(text) or _is_edge(text[end]))


DETECTORS = [
    Detector("Claude", "homoglyph-substitution", 0.85, beside_letter("%(homoglyph)s"), "homoglyph"),
    Detector("Claude", "zero-width-sequence", 0.9, "%(zero)s{2,}", "zero"),
    Detector("Gemini", "variation-selector", 0.8, "%(variation)s+", "variation"),
    Detector("Gemini", "synthid-token-marker", 0.6, rf"%(zero)s(?:(?<={_EDGE}%(zero)s)|(?<!(?s:.)%(zero)s))(?:(?={_EDGE})|(?!(?s:.)))", "zero", keep=_isolated),
    Detector("OpenAI", "mid-stream-joiner", 0.7, "%(joiner)s(?<=(?s:.)%(joiner)s)", "joiner"),
    Detector("OpenAI", "bidi-override", 0.75, "%(bidi)s+", "bidi"),
    Detector("DeepSeek", "reasoning-block", 0.95, _THINK, "<"),
    Detector("DeepSeek", "fullwidth-punctuation", 0.7, beside_letter("%(full)s"), "full"),
    Detector("Grok", "emoji-burst", 0.6, "%(emoji)s%(emoji_more)s*", "emoji", least=3),
    Detector("Grok", "em-dash-cluster", 0.7, "%(dash)s{3,}", "dash"),
    Detector("Mistral", "template-leak", 0.99, _TOKENS, r"[<\[]"),
]
_ANY = "[" + "".join(v[1:-1] for v in CLASSES.values()) + "]"


def _python(java: str) -> str:
    return regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", java)


def plain(form: str) -> str:
    """A pattern for Python."""
    return _python(form % CLASSES)


#: No match of the detectors above is possible without this: a cheap filter before Python.
CANDIDATE = f"{narrowed(_ANY)}|{_THINK}|{_TOKENS}"
_PASSED = regex.compile(_python(_COMMON))


@dataclass(frozen=True)
class Registry:
    """Detectors in their order, and a remover for vendors that have one. ``few`` detectors of the caller's are expressions in counts and filters; more are looked for in
    Python, where one pass over a text finds the literals of all."""

    detectors: tuple[Detector, ...]
    removers: tuple[tuple[str, Callable[[str], str]], ...] = ()
    few: int = 64

    def with_detectors(self, *more: Detector, removers: dict[str, Callable[[str], str]] | None = None) -> Registry:
        """With more detectors, after the ones there are, and removers that replace others of their vendor."""
        names = [d.name for d in (*self.detectors, *more)]
        if len(set(names)) < len(names):
            raise ValueError("two detectors of one vendor have the same pattern name")
        return Registry((*self.detectors, *more), tuple((dict(self.removers) | (removers or {})).items()), self.few)

    def with_table(self, patterns: DataFrame, most: int = 100_000) -> Registry:
        """With a detector for each row (vendor, pattern, confidence, literal) of a table of at most ``most`` rows, in the order of their names."""
        rows = patterns.select("vendor", "pattern", F.col("confidence").cast("double"), "literal").filter("literal <> ''").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} patterns")
        return self.with_detectors(*[Detector.of_literal(*r) for r in sorted(rows)])

    def only(self, *vendors: str) -> Registry:
        """With the detectors and removers of some vendors: the others' read nothing."""
        return Registry(tuple(d for d in self.detectors if d.vendor in vendors), tuple((v, r) for v, r in self.removers if v in vendors), self.few)

    @property
    def vendors(self) -> list[str]:
        return list(dict.fromkeys(d.vendor for d in self.detectors))

    @property
    def added(self) -> list[Detector]:
        return [d for d in self.detectors if d not in _BUILT_IN]

    @property
    def wide(self) -> bool:
        return len(self.added) > self.few

    def candidate(self, text: Column) -> Column:
        """Whether any match is possible, as far as an expression can tell."""
        if self.wide:
            return text.isNotNull()
        out = F.rlike(text, F.lit(CANDIDATE)) if len(self.added) < len(self.detectors) else F.lit(False)
        for d in self.added:
            out = out | (F.contains(text, F.lit(d.literal)) if d.literal else F.rlike(text, F.lit(d.carriers if d.needs else d.java)))
        return out

    def remove(self, vendor: str, text: str) -> str:
        run = dict(self.removers).get(vendor)
        return run(text) if run else text


@lru_cache(8)
def _compiled(registry: Registry) -> tuple[list[tuple], ahocorasick.Automaton | None]:
    """Detectors with their compiled patterns, and the automaton of their literals."""
    known = [(d, regex.compile(plain("%(zero)s" if d.keep is _isolated else d.form)), d.needs and regex.compile(_python(d.carriers))) for d in registry.detectors]
    automaton = ahocorasick.Automaton()
    by_literal: dict[str, list[int]] = {}
    for i, (d, *_) in enumerate(known):
        if d.literal:
            by_literal.setdefault(d.literal, []).append(i)
    for literal, places in by_literal.items():
        automaton.add_word(literal, places)
    if by_literal:
        automaton.make_automaton()
    return known, automaton if by_literal else None


def find(text: str, vendors: tuple[str, ...] | None = None, registry: Registry | None = None) -> list[tuple[str, str, float, int, int]]:
    """(vendor, pattern, confidence, position, length) of all matches, by detector and position."""
    known, automaton = _compiled(registry or REGISTRY)
    at, out = utf16_positions(text), []
    rare = _PASSED.sub("", text)
    held = {i for _, places in automaton.iter(text) for i in places} if automaton else set()
    for i, (d, pattern, carrier) in enumerate(known):
        if vendors and d.vendor not in vendors or (i not in held if d.literal else carrier and not carrier.search(rare if d in _BUILT_IN else text)):
            continue
        for m in pattern.finditer(text):
            start, end = at(m.start()), at(m.end())
            if end - start >= d.least and (d.keep is None or d.keep(text, *m.span())):
                out.append((d.vendor, d.pattern, d.confidence, start, end - start))
    return out


_FOLD = regex.compile(plain(f"%(zero)s|{beside_letter('%(homoglyph)s')}"))
_INVISIBLE = regex.compile(plain("%(variation)s|%(zero)s"))
_CONTROLS = regex.compile(plain("%(joiner)s|%(bidi)s"))
_REASONING = regex.compile(plain(f"{_THINK}|{beside_letter('%(full)s')}"))
_BURSTS = regex.compile(plain("(%(emoji)s)(?:%(emoji)s)*|%(dash)s+"))
_TEMPLATE = regex.compile(_TOKENS)


def _drop_tokens(text: str) -> str:
    """Without template tokens; a space stands where two other characters would meet."""
    out: list[str] = []
    last = ""
    end = 0
    for m in _TEMPLATE.finditer(text):
        out.append(text[end : m.start()])
        last = out[-1][-1:] or last
        end = m.end()
        after = text[end : end + 1]
        if last and not last.isspace() and after and not after.isspace():
            out.append(" ")
            last = " "
    return "".join([*out, text[end:]])


REMOVERS: dict[str, Callable[[str], str]] = {
    "Claude": lambda t: _FOLD.sub(lambda m: HOMOGLYPHS.get(m[0], ""), t),
    "Gemini": lambda t: _INVISIBLE.sub("", t),
    "OpenAI": lambda t: _CONTROLS.sub("", t),
    "DeepSeek": lambda t: _REASONING.sub(lambda m: "" if m[0][0] == "<" else chr(ord(m[0]) - 0xFEE0), t),
    "Grok": lambda t: _BURSTS.sub(lambda m: m[1] or EM_DASH, t),
    "Mistral": _drop_tokens,
}
_BUILT_IN = frozenset(DETECTORS)
#: What operators use unless they are given another.
REGISTRY = Registry(tuple(DETECTORS), tuple(REMOVERS.items()))


def detector(registry: Registry | None = None):
    """A UDF of a text; the registry goes with it. In SQL, and where there are very many detectors."""

    @F.pandas_udf(f"array<{schemas.MATCH}>")
    @in_slices
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("vendor", "pattern", "confidence", "position", "length")
        for s in batches:
            yield s.map(lambda t: None if t is None else [dict(zip(names, m, strict=True)) for m in find(t, registry=registry)])

    return run


def needed(d: Detector, text: Column, rest: Column) -> Column:
    """Whether a detector needs to read a text, of which ``rest`` is what ``rare`` leaves."""
    if d not in _BUILT_IN:
        return F.contains(text, F.lit(d.literal)) if d.literal else F.rlike(text, F.lit(d.carriers if d.needs else d.java))
    return F.rlike(rest, F.lit(narrowed(d.carriers) if "{" in d.carriers else d.carriers))


def detect(text: Column, registry: Registry | None = None, rest: Column | None = None) -> Column:
    """All matches of a text with positions, by detector and position; null for a null text. Without Python, unless the registry is wide: ``rest`` is ``rare(text)``
    where that is at hand. Bytes that aren't UTF-8 count as replacement characters."""
    registry, text = registry or REGISTRY, F.make_valid_utf8(text)
    if registry.wide:
        return detector(registry)(text)
    rest = rare(text) if rest is None else rest
    none = F.from_json(F.lit("[]"), f"array<{schemas.MATCH}>")
    # arrays of one detector's matches each, most of them empty
    return F.when(text.isNotNull(), F.concat(*[F.when(needed(d, text, rest), d.matches(text)).otherwise(none) for d in registry.detectors]))


def is_candidate(text: Column, registry: Registry | None = None) -> Column:
    return (registry or REGISTRY).candidate(text)


def rare(text: Column) -> Column:
    """What is left of a text without the characters that no match needs: short for most."""
    return F.regexp_replace(text, _COMMON, "")


def counts(text: Column, rest: Column | None = None, registry: Registry | None = None) -> Column:
    """A struct with the number of matches of each detector, without Python. A detector reads a text only if ``rest``, by default ``rare(text)``, has what its matches need."""
    rest = rare(text) if rest is None else rest

    def of(d: Detector) -> Column:
        if d not in _BUILT_IN:
            return d.count(text)
        return F.when(needed(d, text, rest), d.count(text)).when(text.isNotNull(), 0)

    return F.struct(*[of(d).alias(d.name) for d in (registry or REGISTRY).detectors])


def remover(vendor: str) -> Callable[[Column], Column]:
    """A Column function that normalises what a vendor's detectors mark."""
    return lambda text: removers(vendor)(text)[vendor]


def removers(*vendors: str) -> Callable[[Column], Column]:
    """A Column function that gives a struct with a text for each vendor, as ``remover`` does; a text goes to Python once for all of them. Fields are null for a null text."""
    runs = [(v, REMOVERS[v]) for v in vendors]

    @F.pandas_udf(", ".join(f"`{v}` string" for v in vendors))
    @in_slices
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame({v: s.map(lambda t, run=run: t if t is None else run(t)) for v, run in runs})

    return lambda text: udf(F.make_valid_utf8(text))
