"""Option records, and the configuration file that sets their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class TextOptions:
    """Which layers of text cleaning run. ``collapse_whitespace`` turns runs of blanks into one space, last."""

    unicode: bool = True
    vendors: bool = True
    collapse_whitespace: bool = False


@dataclass(frozen=True)
class MarkdownOptions:
    strip_headings: bool = True
    strip_code_fences: bool = False
    strip_inline_code: bool = False
    strip_links: bool = False
    strip_images: bool = True
    strip_bold_italic: bool = False
    strip_blockquotes: bool = False
    strip_hr: bool = True
    strip_html: bool = True
    strip_comments: bool = True
    strip_task_lists: bool = False
    strip_table_syntax: bool = False
    normalize_lists: bool = True
    unwrap_empty_lists: bool = True
    strip_xml_tags: bool = True
    strip_frontmatter: bool = True
    strip_ai_signatures: bool = True
    strip_mentions: bool = True
    strip_unicode: bool = True
    strip_trailing_ws: bool = True
    apply_layer_a: bool = True

    @classmethod
    def strip_all(cls) -> MarkdownOptions:
        return cls(**{f.name: True for f in fields(cls)})


@dataclass(frozen=True)
class MetadataOptions:
    """What file cleaning takes out. Provenance manifests always stay. Comments with their authors, and tracked changes, of office files are content, and stay unless asked for."""

    strip_exif: bool = True
    strip_xmp: bool = True
    strip_iptc: bool = True
    strip_maker_notes: bool = True
    preserve_color_profile: bool = True
    strip_comments: bool = False
    accept_revisions: bool = False


@dataclass(frozen=True)
class ImageOptions:
    threshold: float = 0.4


@dataclass(frozen=True)
class Config:
    text: TextOptions = field(default_factory=TextOptions)
    markdown: MarkdownOptions = field(default_factory=MarkdownOptions)
    metadata: MetadataOptions = field(default_factory=MetadataOptions)
    image: ImageOptions = field(default_factory=ImageOptions)


def _merged(default: Any, given: Any) -> Any:
    if not isinstance(given, dict):
        return default
    out = {}
    for f in fields(default):
        value, at = getattr(default, f.name), given.get(f.name, given.get(f.name.replace("_", "-")))
        if is_dataclass(value):
            out[f.name] = _merged(value, at)
        elif at is not None and type(at) in (type(value), *([int] if isinstance(value, float) else [])):
            out[f.name] = type(value)(at)
    return replace(default, **out)


def load_config(path: str | None = None, folders: tuple[str, ...] = (".",)) -> Config:
    """From ``path``, else the first config.yaml or config.yml in ``folders``. Unknown keys are ignored; a missing or malformed file gives the defaults."""
    candidates = [Path(path)] if path else [Path(d) / n for n in ("config.yaml", "config.yml") for d in folders]
    for p in candidates:
        if p.is_file():
            try:
                import yaml

                return _merged(Config(), yaml.safe_load(p.read_text(encoding="utf-8")))
            except (ImportError, ValueError, OSError, yaml.YAMLError):
                return Config()
    return Config()
