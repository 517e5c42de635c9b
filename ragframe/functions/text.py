"""String building blocks (Column -> Column). All run in the JVM; none needs
Python. Those with lambda functions are interpreted, the others generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Sentence splitter (look-behinds for ".", "?" and the two-character "!:";
# no split after "e.g."-like or "Mr."-like endings; runs of control or
# format characters always split):
#   (?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!\:)\s+|\p{Cc}+|\p{Cf}+
# Fenced code block:  ``` ?[Pp]ython\n(?:(?!```)[\S\s])+\n```
# Marker format:      【{n}†source】
# Image placeholder prefix: "<image: "
# ---------------------------------------------------------------------------
SENTENCE_PATTERN_REF = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!\:)\s+|\p{Cc}+|\p{Cf}+"
CODE_BLOCK_PATTERN_REF = r"``` ?[Pp]ython\n(?:(?!```)[\S\s])+\n```"
MARKER_OPEN, MARKER_CLOSE = "【", "†source】"
IMAGE_PREFIX = "<image: "

# Java flags: (?U) Unicode classes for \w and \s (same sets as the Python
# ``regex`` module), (?d) makes "." stop only at "\n" as in Python.
SENTENCE_PATTERN = "(?Ud)" + SENTENCE_PATTERN_REF
NEWLINE_PATTERN = "\n"
CODE_BLOCK_PATTERN = CODE_BLOCK_PATTERN_REF

# Python's str.strip()/isspace(): Unicode White_Space plus U+001C..U+001F.
# Written out so the same class works in Java regex and in RE2 (DuckDB).
PY_SPACE_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]"

# Private-use character put in front of every separator before a split. Where
# a text has it, it is escaped by others of the same class, which no pattern
# tells apart from it, and comes back in the units.
SENTINEL = "\ue000"
_ESCAPE, _ESCAPED_ESCAPE, _ESCAPED_SENTINEL = "\ue001", "\ue001\ue002", "\ue001\ue003"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: Spark's trim() strips only U+0020."""
    return F.regexp_replace(c, f"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$", "")


def py_lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PY_SPACE_CLASS}+", "")


def split_keep(text: Column, pattern: str) -> Column:
    """Lossless split: array of units where unit i>0 starts with the separator
    that preceded it, so ``array_join(units, '')`` gives the text back.
    Empty text gives ``['']``; a leading separator gives a first unit ``''``."""
    escaped = _replace(_replace(text, _ESCAPE, _ESCAPED_ESCAPE), SENTINEL, _ESCAPED_SENTINEL)
    units = F.split(F.regexp_replace(escaped, pattern, SENTINEL + "$0"), SENTINEL, -1)
    return F.transform(units, lambda u: _replace(_replace(u, _ESCAPED_SENTINEL, SENTINEL), _ESCAPED_ESCAPE, _ESCAPE))


def sentence_units(text: Column) -> Column:
    return split_keep(text, SENTENCE_PATTERN)


def newline_units(text: Column) -> Column:
    return split_keep(text, NEWLINE_PATTERN)


def sanitise_unicode(c: Column) -> Column:
    """Keep characters that are letters or numbers (Python ``isalnum``) or '_'."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")


def sanitise_ascii(c: Column) -> Column:
    """Keep ASCII letters, digits and '_' (idempotent)."""
    return F.regexp_replace(c, r"[^a-zA-Z0-9_]", "")


def newline_to_space(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def file_id_from_path(path: Column) -> Column:
    """Base name without its last extension, with Python ``splitext`` rules:
    leading dots never start an extension ('.docx' stays '.docx')."""
    b = basename(path)
    has_ext = b.rlike(r"^\.*[^.].*\.[^.]*$")
    return F.when(has_ext, F.regexp_extract(b, r"^(.*)\.[^.]*$", 1)).otherwise(b)


def marker(n: Column) -> Column:
    return F.concat(F.lit(MARKER_OPEN), n.cast("string"), F.lit(MARKER_CLOSE))


def clean_code_block(c: Column) -> Column:
    """Strip '`', ' ', '\\n' at both ends; drop a leading 'python' (any case)
    and the whitespace after it."""
    s = F.regexp_replace(c, r"^[` \n]+|[` \n]+$", "")
    return F.when(F.lower(s).startswith("python"),
                  py_lstrip(F.substring(s, 7, 1 << 30))).otherwise(s)


def code_blocks(c: Column) -> Column:
    """All fenced python blocks of a model answer, in order."""
    return F.regexp_extract_all(c, F.lit(CODE_BLOCK_PATTERN), 0)


def section_markers(answer: Column) -> Column:
    """Marker numbers listed in the last code block that starts with
    ``sections`` (after cleanup). Null when there is no such block, empty
    array when the list is empty. Never evaluates model text."""
    blocks = F.transform(code_blocks(answer), clean_code_block)
    secs = F.filter(blocks, lambda b: b.startswith("sections"))
    last = F.try_element_at(secs, F.lit(-1))
    nums = F.regexp_extract_all(last, F.lit(r"【(\d+)†source】"), 1)
    return F.when(last.isNull(), F.lit(None)).otherwise(
        F.transform(nums, lambda x: x.cast("int")))


def strictly_increasing_prefix(arr: Column) -> Column:
    """Longest leading run of strictly increasing values (later markers that
    are out of order, repeated or unknown stop all later emissions)."""
    ok = F.transform(arr, lambda x, i: (i == 0) | (x > F.get(arr, i - 1)))
    bad = F.array_position(ok, F.lit(False))
    return F.when(bad == 0, arr).otherwise(F.slice(arr, 1, bad - 1))


def description_lines(text: Column) -> Column:
    """Model answer of 'name: description' lines -> array of lines."""
    return F.split(py_strip(text), "\n", -1)
