"""The functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sievelake.functions import detectors, hygiene, images, markdown, metadata, tables
from sievelake.operators.text import clean_udf
from sievelake.options import TextOptions

#: SQL name: what makes the function.
FUNCTIONS = {
    "hygiene": hygiene._hygiene.udf,
    "nfkc": hygiene._nfkc.udf,
    "detect_text": detectors.detector,
    "clean_text": lambda: clean_udf(TextOptions()),
    "clean_markdown": markdown.cleaner,
    "detect_markdown": markdown._detect.udf,
    "markdown_segments": markdown.markdown_segments.udf,
    "inspect_metadata": metadata._inspect.udf,
    "clean_metadata": metadata.cleaner,
    "detect_regions": images.detector,
}


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


EXTENSION = r"lower(regexp_extract(path, r'(\.[^./\\]+)$', 1))"
#: Functions that are expressions, which the optimiser sees through: arguments, type and body.
EXPRESSIONS = {
    "strip_invisible": ("text STRING", "STRING", f"regexp_replace(text, r'{hygiene.STRIP_CLASS}', '')"),
    "count_invisible": ("text STRING", "INT", f"regexp_count(text, r'{hygiene.STRIP_CLASS}')"),
    "substitute_punctuation": ("text STRING", "STRING", "replace(translate(text, {0}, {1}), {2}, '...')"),
    "classify": (
        "path STRING",
        "STRING",
        f"CASE WHEN path IS NULL THEN NULL WHEN {EXTENSION} IN ({_list(metadata.MARKDOWN)}) THEN 'markdown' WHEN {EXTENSION} IN ({_list(metadata.EXTENSIONS)}) THEN 'metadata' WHEN {EXTENSION} IN ({_list((*metadata.TEXT, ''))}) THEN 'text' ELSE 'unsupported' END",
    ),
}


def _literal(text: str) -> str:
    """A string in SQL, with escapes for all but plain characters."""
    return "'" + "".join(c if c.isalnum() and c.isascii() or c in " -." else f"\\u{ord(c):04x}" for c in text) + "'"


def register(spark: SparkSession) -> list[str]:
    """Register all under their names; returns these."""
    for name, make in FUNCTIONS.items():
        spark.udf.register(name, make())
    for name, (arguments, kind, body) in EXPRESSIONS.items():
        if name == "substitute_punctuation":
            body = body.format(*map(_literal, ("".join(hygiene.ONE_TO_ONE), "".join(hygiene.ONE_TO_ONE.values()), hygiene.ELLIPSIS)))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return [*FUNCTIONS, *EXPRESSIONS, *tables.register(spark)]
