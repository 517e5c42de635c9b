from pyspark.sql import functions as F

from ragframe.functions.text import (clean_code_block, file_id_from_path, py_strip, sanitise_ascii,
                                     sanitise_unicode, section_markers, strictly_increasing_prefix)
from ragframe.operators.sections import listed_markers


def _one(spark, col_fn, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r.o for r in df.select(col_fn(F.col("v")).alias("o")).collect()]


def test_name_edges(spark):
    assert _one(spark, sanitise_unicode, ["Café-名_1½!"]) == ["Café名_1½"]
    assert _one(spark, sanitise_ascii, ["Café-名_1½!"]) == ["Caf_1"]
    s = "Café-名_1½!"
    assert _one(spark, sanitise_unicode, [s])[0] == "".join(c for c in s if c.isalnum() or c == "_")


def test_path_edges(spark):
    paths = ["wordDoc/a.b.docx", "x/.docx", "noext", "..a.b", "a.", "dir/"]
    import os
    exp = [os.path.splitext(os.path.basename(p))[0] for p in paths]
    assert _one(spark, file_id_from_path, paths) == exp


def test_strip_is_python_strip(spark):
    vals = ["  a  ", "\t\t", " text ", "\x1cx\x1f", "", " 　y "]
    assert _one(spark, py_strip, vals) == [v.strip() for v in vals]


def test_clean_code_block(spark):
    vals = ["```python\nsections = []\n```", "``` Python\n  sections = [1]\n```", "`` x ``",
            "PYTHON\tsections"]
    exp = []
    for v in vals:
        r = v.strip("` \n")
        if r.lower().startswith("python"):
            r = r[6:].lstrip()
        exp.append(r)
    assert _one(spark, clean_code_block, vals) == exp


MARKER_EDGES = [
    "```python\nsections = ['【0†source】', '【3†source】']\n```",
    "no block at all",
    "```python\nsections = []\n```",
    "```python\nsections = ['【1†source】']\n```\ntext\n```python\nsections = ['【2†source】', '【5†source】']\n```",
    "```Python\nsections = ['【4†source】']\n```",
    "```python\nother = ['【4†source】']\n```",
    "``` python\nsections = ['【7†source】']\n```",
]


def test_marker_edges_match_python_parser(spark):
    got = _one(spark, section_markers, MARKER_EDGES)
    assert got == [listed_markers(a) for a in MARKER_EDGES]
    assert got[1] is None and got[2] == []            # null != empty
    assert got[3] == [2, 5]                           # last block wins


def test_increasing_prefix(spark):
    got = _one(spark, strictly_increasing_prefix, [[0, 3, 2, 5], [1, 1], [], [4, 6, 9]], "array<int>")
    assert got == [[0, 3], [1], [], [4, 6, 9]]


def test_word_pattern_separators_equal_python_isspace():
    import regex
    from ragframe.functions.tokens import WORD_PATTERN
    pat = regex.compile(WORD_PATTERN)
    sep = {c for c in range(0x10000) if not pat.fullmatch(chr(c))}
    assert sep == {c for c in range(0x10000) if chr(c).isspace()}
