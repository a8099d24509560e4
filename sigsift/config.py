"""Scan options and the fixed lists behind their defaults."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from sigsift.catalog import HIGH, LOW, RULES, SEVERITY_LABELS, Rule

# Extensions by language.
LANGUAGE_EXTENSIONS = {
    "php": (".php", ".inc", ".module"),
    "js": (".js", ".jsx", ".mjs"),
    "ts": (".ts", ".tsx"),
}
# Directory names left out at any depth.
DEFAULT_EXCLUDES = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "build", "dist",
    ".DS_Store", "Thumbs.db",
)
# Extensions that are never scanned.
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot",
    ".otf", ".zip", ".tar", ".gz", ".rar", ".pdf", ".doc", ".docx", ".mp3", ".mp4", ".avi", ".mov",
    ".exe", ".dll", ".so", ".dylib", ".mo",
)
# Limits.  Those of ``SINGLE_MACHINE`` are what a scanner of one package at a time keeps to; none holds unless it is asked for.
SINGLE_MACHINE = {
    "max_file_kb": 2048, "max_text_bytes": 2 * 1024 * 1024, "header_bytes": 64 * 1024, "nul_probe_bytes": 8192, "max_matches": 100,
    "max_signals": 5,
}
MAX_ARCHIVE_BYTES = 512 * 1024 * 1024
MAX_BINARY = 2**31 - 1
CONTEXT_LINES = 3
SUPPRESS_LINES = 10
REVIEW_BATCH = 5

DEFAULT_EXTENSIONS = tuple(e for group in LANGUAGE_EXTENSIONS.values() for e in group)
PHP_EXTENSIONS = LANGUAGE_EXTENSIONS["php"]
SCRIPT_EXTENSIONS = LANGUAGE_EXTENSIONS["js"] + LANGUAGE_EXTENSIONS["ts"]


def _dotted(extensions: Iterable[str]) -> tuple[str, ...]:
    return tuple((e if e.startswith(".") else "." + e).lower() for e in extensions)


@dataclass(frozen=True)
class ScanConfig:
    """Options of one scan job.

    ``exclude_dirs`` and ``include_ext`` add to the defaults; ``only_exclude_dirs``
    and ``only_ext`` stand in for them.  ``quick`` raises the threshold to HIGH
    whatever ``severity_threshold`` says.  ``php_only`` wins over ``include_ext``.
    ``wide_lines`` adds that many lines either side to each finding, for review.

    Whole files are scanned and all matches kept.  These cuts are off (None) and
    leave a row in ``skipped`` or ``scan_errors`` wherever they take something
    away: ``max_file_kb`` leaves larger files out, ``max_text_bytes`` and
    ``header_bytes`` read the first bytes only for findings and for package names,
    ``nul_probe_bytes`` takes a file with a NUL in its first bytes for binary,
    ``max_matches`` keeps a rule's first matches in a file, ``max_signals`` names
    the first signals of the heuristic.  ``max_archive_bytes`` refuses archives
    that declare more, each with an error row; uploads and the gate have it on.
    """

    severity_threshold: int = LOW
    max_file_kb: int | None = None
    max_text_bytes: int | None = None
    header_bytes: int | None = None
    nul_probe_bytes: int | None = None
    max_archive_bytes: int | None = None
    max_signals: int | None = None
    exclude_dirs: tuple[str, ...] = ()
    include_ext: tuple[str, ...] = ()
    only_exclude_dirs: tuple[str, ...] | None = None
    only_ext: tuple[str, ...] | None = None
    php_only: bool = False
    js_only: bool = False
    deep: bool = False
    quick: bool = False
    context_lines: int = CONTEXT_LINES
    max_matches: int | None = None
    wide_lines: int = 0
    rules: tuple[Rule, ...] = RULES

    def __post_init__(self):
        if self.php_only and self.js_only:
            raise ValueError("php_only and js_only exclude each other")
        for name in (*SINGLE_MACHINE, "max_archive_bytes"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1, or None for no limit")
        if self.context_lines < 0 or self.wide_lines < 0:
            raise ValueError("context_lines and wide_lines cannot be negative")
        if self.severity_threshold not in SEVERITY_LABELS:
            raise ValueError(f"unknown severity {self.severity_threshold}")

    @property
    def threshold(self) -> int:
        return HIGH if self.quick else self.severity_threshold

    @property
    def max_bytes(self) -> int:
        """The largest file that is scanned; no value of Spark's holds more than ``MAX_BINARY``."""
        return MAX_BINARY if self.max_file_kb is None else min(MAX_BINARY, self.max_file_kb * 1024)

    @property
    def cuts(self) -> bool:
        """Whether a scan may leave notes about parts it left out."""
        return any(getattr(self, n) is not None for n in SINGLE_MACHINE if n != "max_file_kb")

    @property
    def excluded(self) -> tuple[str, ...]:
        base = DEFAULT_EXCLUDES if self.only_exclude_dirs is None else tuple(self.only_exclude_dirs)
        return tuple(dict.fromkeys(base + tuple(self.exclude_dirs)))

    @property
    def extensions(self) -> tuple[str, ...]:
        if self.php_only:
            return PHP_EXTENSIONS
        if self.js_only:
            return SCRIPT_EXTENSIONS
        base = DEFAULT_EXTENSIONS if self.only_ext is None else _dotted(self.only_ext)
        return tuple(dict.fromkeys(base + _dotted(self.include_ext)))

    @property
    def mode(self) -> str:
        return "deep" if self.deep else "standard"

    def with_options(self, **changes) -> "ScanConfig":
        return replace(self, **changes)
