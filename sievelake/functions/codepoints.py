"""Character sets and tables that the text functions share, all as escapes."""

from __future__ import annotations

import re

# They must equal the published sets for results to agree.
#: Removed outright.
STRIPPED = (
    "\u200b\u200c\u200d\u200e\u200f"
    "\u2060\u2061\u2062\u2063\u2064"
    "\ufeff\u00ad\u061c\u180e\ufffe\uffff\uffef"
    "\u202a\u202b\u202c\u202d\u202e"
    "\u2066\u2067\u2068\u2069"
)
#: Removed even where other cleaning is off.
FORCED = "".join(c for c in STRIPPED if c not in "\ufffe\uffff\uffef")
ELLIPSIS = "\u2026"
#: Replaced one by one.
SUBSTITUTED = {
    "\u00a0": " ", "\u2007": " ", "\u202f": " ",
    "\u2013": "-", "\u2014": "-", "\u2015": "-",
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u2032": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"', "\u2033": '"',
    ELLIPSIS: "...",
}
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\ufeff"
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
JOINERS = "\ufeff\u2060"
VARIATION = ("\ufe00", "\ufe0f")
FULLWIDTH = ("\uff01", "\uff5e")
BOX = ("\u2500", "\u257f")
EM_DASH = "\u2014"
#: Look-alikes of ASCII letters: Cyrillic, then Greek.
HOMOGLYPHS = {
    "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041a": "K", "\u041c": "M", "\u041d": "H", "\u041e": "O",
    "\u0420": "P", "\u0421": "C", "\u0422": "T", "\u0425": "X", "\u0430": "a", "\u0435": "e", "\u043e": "o",
    "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0455": "s", "\u0456": "i", "\u0458": "j",
    "\u0391": "A", "\u0392": "B", "\u0395": "E", "\u0396": "Z", "\u0397": "H", "\u0399": "I", "\u039a": "K",
    "\u039c": "M", "\u039d": "N", "\u039f": "O", "\u03a1": "P", "\u03a4": "T", "\u03a5": "Y", "\u03a7": "X",
    "\u03b1": "a", "\u03bf": "o",
}
#: Emoji of the basic plane; all code points above it count as emoji too.
EMOJI = (
    "\u2600\u2601\u2602\u2603\u2604\u2605\u260e\u2611\u2614\u2615\u2618\u261d\u2620\u2622\u2623\u2626\u262a\u262e\u262f"
    "\u2638\u2639\u263a\u2640\u2642\u2648\u2649\u2654\u2660\u2663\u2665\u2666\u2668\u267b\u267e\u267f\u2692\u2694\u2696\u2697"
    "\u2699\u269b\u269c\u26a0\u26a1\u26aa\u26ab\u26b0\u26b1\u26bd\u26be\u26c4\u26c5\u26c8\u26ce\u26cf\u26d1\u26d3\u26d4\u26e9\u26ea"
    "\u26f0\u26f1\u26f2\u26f3\u26f4\u26f5\u26f7\u26f8\u26f9\u26fa\u2702\u2705\u2708\u2709\u270a\u270b\u270c\u270d\u270e\u270f"
    "\u2712\u2714\u2716\u271d\u2721\u2728\u2733\u2734\u2744\u2747\u274c\u274e\u2753\u2754\u2755\u2757\u2763\u2764\u2795\u2796\u2797"
    "\u27a1\u27b0\u27bf\u2934\u2935\u2b05\u2b06\u2b07\u2b1b\u2b1c\u2b50\u2b55\u3030\u303d\u3297\u3299\ufe0f"
)
TEMPLATE_TOKENS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
#: Names of stripped code points in removal logs.
STRIP_NAMES = {
    "\u200b": "Zero-Width Space", "\u200c": "Zero-Width Non-Joiner", "\u200d": "Zero-Width Joiner",
    "\u200e": "Left-to-Right Mark", "\u200f": "Right-to-Left Mark", "\u2060": "Word Joiner",
    **dict.fromkeys("\u2061\u2062\u2063\u2064", "Invisible Function Application character"),
    "\ufeff": "Byte Order Mark / Zero-Width No-Break Space", "\u00ad": "Soft Hyphen", "\u061c": "Arabic Letter Mark",
    "\u180e": "Mongolian Vowel Separator", **dict.fromkeys("\ufffe\uffff\uffef", "Invalid Unicode character"),
    **dict.fromkeys("\u202a\u202b\u202c\u202d\u202e", "Bidirectional formatting character"),
    **dict.fromkeys("\u2066\u2067\u2068\u2069", "Bidirectional isolate character"),
}
# End of fixed values.


def spans(chars: str) -> list[tuple[int, int]]:
    """Runs of code points that follow each other, first and last."""
    out: list[tuple[int, int]] = []
    for c in sorted(set(map(ord, chars))):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def java_class(chars: str) -> str:
    """A character class of code points that Java, RE2 and Python's regex read alike, in ASCII."""
    return "[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans(chars)) + "]"


def narrowed(cls: str) -> str:
    """The class for Java, which then looks at the single spans only within the whole's: most text lies outside it."""
    points = [int(x, 16) for x in re.findall(r"\\x\{([0-9A-F]+)\}", cls)]
    return rf"[\x{{{min(points):X}}}-\x{{{max(points):X}}}&&{cls}]"


def span(ends: tuple[str, str]) -> str:
    return rf"[\x{{{ord(ends[0]):X}}}-\x{{{ord(ends[1]):X}}}]"


def python_class(chars: str) -> str:
    return "[" + "".join(rf"\U{ord(c):08x}" for c in chars) + "]"
