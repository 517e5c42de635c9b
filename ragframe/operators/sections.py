"""Semantic chunking: paragraphs -> marked excerpts -> boundary decisions ->
sections of at least ``min_chars`` characters.

A document is one row; paragraph lists live in that row, so numbering,
grouping and section assembly are projections (no shuffle). The only
sequential dependency across groups (a model deciding boundaries, with
carried-over paragraphs) runs per document in ``semantic_chunks``.
"""

from __future__ import annotations

import re
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import (CODE_BLOCK_PATTERN_REF, IMAGE_PREFIX, MARKER_CLOSE, MARKER_OPEN, marker,
                                     py_strip, strictly_increasing_prefix)
from ragframe.operators.cuts import runs, section_cuts, sections_at
from ragframe.operators.numbering import global_offsets
from ragframe.operators.partitioning import spread

# Fixed values of the reference: excerpt groups of 150 (Word) / 40 (PDF)
# paragraphs, grown by half the original size when no boundary is found;
# a pending section is emitted only when longer than 128 characters.
WORD_GROUP = 150
PDF_GROUP = 40
MIN_SECTION_CHARS = 128

BoundaryRule = Callable[[Column, Column], Column]


def heading_rule(marker_no: Column, text: Column) -> Column:
    """Deterministic boundary rule standing in for the model: a paragraph
    starts a section when it is the first one or is short (heading-like)."""
    return (marker_no == 0) | (F.length(text) < 60)


def kept_paragraphs(text: Column, drop_images: bool = True, lines_per_page: int | None = None) -> Column:
    """Document text -> array<struct<para_idx, text, page>> of kept paragraphs
    (stripped, non-blank, and without image placeholders in Word mode)."""
    raw = F.split(text, "\n", -1)
    items = F.transform(raw, lambda p, i: F.struct(
        i.alias("para_idx"), py_strip(p).alias("text"),
        ((i / F.lit(lines_per_page)).cast("int") + 1 if lines_per_page else F.lit(None).cast("int"))
        .alias("page")))
    keep = (lambda x: (x["text"] != "") & ~x["text"].startswith(IMAGE_PREFIX)) if drop_images \
        else (lambda x: x["text"] != "")
    return F.filter(items, keep)


def paragraphs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               drop_images: bool = True, lines_per_page: int | None = None) -> DataFrame:
    """``(id, para_idx, marker_no, marker, text[, page])`` for kept
    paragraphs, numbered from 0 in document order."""
    d = spread(df).select(id_col, kept_paragraphs(F.col(text_col), drop_images, lines_per_page)
                          .alias("_p"))
    out = (d.select(id_col, F.posexplode_outer("_p").alias("marker_no", "_x"))
           .filter(F.col("marker_no").isNotNull()))
    cols = [id_col, F.col("_x.para_idx").cast("long").alias("para_idx"),
            F.col("marker_no").cast("long").alias("marker_no"),
            marker(F.col("marker_no")).alias("marker"), F.col("_x.text").alias("text")]
    if lines_per_page:
        cols.append(F.col("_x.page").cast("long").alias("page_number"))
    return out.select(*cols)


def excerpt_groups(df: DataFrame, group_size: int = PDF_GROUP, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """D2 without carry-over: consecutive groups of ``group_size`` kept
    paragraphs, each line ``marker text``, lines joined by newlines."""
    lines = F.transform(kept_paragraphs(F.col(text_col)), lambda x, i: F.concat(marker(i), F.lit(" "), x["text"]))
    d = spread(df).select(id_col, lines.alias("_l"))
    first = F.when(F.size("_l") > 0, F.sequence(F.lit(0), F.size("_l") - 1, F.lit(group_size)))
    groups = F.transform(first, lambda a: F.array_join(F.slice("_l", a + 1, group_size), "\n"))
    d = d.select(id_col, groups.alias("_g"))
    return d.select(id_col, F.posexplode_outer("_g").alias("group_no", "excerpt")) \
            .filter(F.col("group_no").isNotNull()) \
            .withColumn("group_no", F.col("group_no").cast("long"))


def _assembled(rows: DataFrame, id_col: str, paras: Column, min_chars: int, pdf: bool) -> DataFrame:
    """(id, section_no, content, first_marker, n_paras[, page_number]) from array<struct<m, text, start,
    page>>: a start ends the section before it when that has more than ``min_chars`` characters."""
    d = rows.select(id_col, paras.alias("_p"))
    codes = F.transform("_p", lambda p: F.length(p["text"]).cast("long") * 2 + F.when(p["start"], F.lit(1)).otherwise(F.lit(0)))
    d = d.select(id_col, "_p", sections_at(codes, min_chars, merge_tail=pdf).alias("_cuts"))
    sections = runs("_p", "_cuts", lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda p: p["text"]), "\n").alias("content"), F.get(ps, 0)["m"].alias("first_marker"),
        F.size(ps).alias("n_paras"), F.get(ps, 0)["page"].alias("page")))
    out = (d.select(id_col, F.posexplode_outer(sections).alias("section_no", "_x"))
           .filter(F.col("section_no").isNotNull()))
    cols = [id_col, F.col("section_no").cast("long").alias("section_no"), F.col("_x.content").alias("content"),
            F.col("_x.first_marker").cast("long").alias("first_marker"), F.col("_x.n_paras").cast("long").alias("n_paras")]
    if pdf:
        cols.append(F.col("_x.page").cast("long").alias("page_number"))
    return out.select(*cols)


def assemble_sections(df: DataFrame, rule: BoundaryRule = heading_rule, *, id_col: str = "doc_id",
                      text_col: str = "text", min_chars: int = MIN_SECTION_CHARS,
                      mode: str = "word", lines_per_page: int | None = None) -> DataFrame:
    """D4 + D6 (Word: the tail is its own section) or D7 + D8 (PDF: the tail
    joins the previous section; a section's page is its first paragraph's).
    Boundaries come from ``rule(marker_no, text)``."""
    pdf = mode == "pdf"
    kept = kept_paragraphs(F.col(text_col), drop_images=not pdf,
                           lines_per_page=lines_per_page if pdf else None)
    paras = F.transform(kept, lambda x, i: F.struct(
        i.alias("m"), x["text"].alias("text"), rule(i, x["text"]).alias("start"),
        x["page"].alias("page")))
    return _assembled(spread(df), id_col, paras, min_chars, pdf)


def sections_from_rows(rows: DataFrame, rule: BoundaryRule = heading_rule, *, starts: DataFrame | None = None,
                       id_col: str = "doc_id", idx_col: str = "para_idx", text_col: str = "text",
                       page_col: str | None = None, min_chars: int = MIN_SECTION_CHARS, mode: str = "word") -> DataFrame:
    """D4 + D6 - D8 over paragraph rows, as Word files and page blocks give
    them: a text may hold line breaks and still be one paragraph. Blank ones
    and, in Word mode, image placeholders are left out before numbering.

    ``starts`` has (id, ``markers`` array<int>) as listed in model answers; of
    each list the leading increasing run of known markers counts, and it takes
    the place of ``rule``. A document without an answer is one section. One
    shuffle gathers a document's paragraphs in its row."""
    pdf = mode == "pdf"
    page = F.col(page_col).cast("int") if page_col else F.lit(None).cast("int")
    kept = rows.select(F.col(id_col).alias("_id"), F.col(idx_col).alias("_i"), py_strip(F.col(text_col)).alias("_t"), page.alias("_p"))
    kept = kept.where(F.col("_t") != "") if pdf else kept.where((F.col("_t") != "") & ~F.col("_t").startswith(IMAGE_PREFIX))
    docs = kept.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_t", "_p"))).alias("_rows"))
    if starts is None:
        begins = lambda i, t: rule(i, t)
    else:
        own = starts.select(F.col(id_col).alias("_id"), strictly_increasing_prefix(F.col("markers")).alias("_starts"))
        docs = docs.join(own, "_id", "left").withColumn("_starts", F.coalesce("_starts", F.array().cast("array<int>")))
        # an unknown marker ends the run; the ones before it are all smaller
        begins = lambda i, t: F.array_contains("_starts", i)
    paras = F.transform("_rows", lambda x, i: F.struct(
        i.alias("m"), x["_t"].alias("text"), begins(i, x["_t"]).alias("start"), x["_p"].alias("page")))
    return _assembled(docs.withColumnRenamed("_id", id_col), id_col, paras, min_chars, pdf)


def global_markers(sections: DataFrame, *, id_col: str = "doc_id",
                   section_col: str = "section_no") -> DataFrame:
    """Number sections over all documents of a run (document order, then
    section order) and render the marker; the per-document number stays."""
    counts = sections.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    offs = global_offsets(counts, [id_col], "_n").select(id_col, "offset")
    out = sections.join(offs, id_col)
    g = (F.col("offset") + F.col(section_col)).cast("long")
    return out.withColumn("global_no", g).withColumn("reference_marker", marker(g)).drop("offset")


# ---------------------------------------------------------------------------
# Model-driven boundaries with carry-over, one document per call.
# ---------------------------------------------------------------------------

def listed_markers(answer: str | None) -> list[int] | None:
    """Markers of the last fenced block that assigns ``sections``; None without
    one. For use inside tasks, where ``functions.text.section_markers`` can't run."""
    bodies = (re.sub(r"(?i)\Apython\s*", "", m.group().strip("` \n"))
              for m in re.finditer(CODE_BLOCK_PATTERN_REF, answer or ""))
    lists = [b for b in bodies if b.startswith("sections")]
    mark = re.escape(MARKER_OPEN) + r"(\d+)" + re.escape(MARKER_CLOSE)
    return [int(n) for n in re.findall(mark, lists[-1])] if lists else None


def leading_starts(markers: list[int], first: int, n: int) -> np.ndarray:
    """Positions, among the ``n`` paragraphs from marker ``first`` on, of the
    leading run of markers that are known and increase."""
    at = np.asarray(markers, dtype=np.int64) - first
    good = (at >= 0) & (at < n) & (np.diff(at, prepend=-1) > 0)
    return at[:len(at) if good.all() else int(good.argmin())]


def cut_by_model(texts: list[str], boundary_fn, group_size: int, min_chars: int, max_retries: int = 2) -> list[int]:
    """Paragraph numbers at which sections begin, asked of the model excerpt by
    excerpt. An excerpt begins at the last cut, so undecided paragraphs are
    seen again; an excerpt that gives no cut makes those after it longer."""
    cuts, size, n = [0], group_size, len(texts)
    lengths = np.array([len(t) for t in texts])
    end = 0
    while end < n:
        begin, end = cuts[-1], min(cuts[-1] + size, n)
        excerpt = "\n".join(f"{MARKER_OPEN}{begin + i}{MARKER_CLOSE} {t}" for i, t in enumerate(texts[begin:end]))
        answers = (listed_markers(boundary_fn(excerpt)) for _ in range(max_retries + 1))
        listed = next((a for a in answers if a is not None), [])
        new = section_cuts(lengths[begin:end], leading_starts(listed, begin, end - begin), min_chars)
        cuts += [begin + c for c in new]
        if not new:
            size += group_size // 2
    return cuts


def sections_by_model(paras, boundary_fn, group_size, min_chars, pdf):
    """paras: list of (text, page). (content, first paragraph, number of
    paragraphs, page) of each section; in PDF mode the tail joins the one before."""
    cuts = cut_by_model([t for t, _ in paras], boundary_fn, group_size, min_chars) if paras else []
    if pdf and len(cuts) > 1:
        cuts.pop()
    return [("\n".join(t for t, _ in paras[a:b]), a, b - a, paras[a][1])
            for a, b in zip(cuts, [*cuts[1:], len(paras)], strict=True)]


def semantic_chunks(df: DataFrame, boundary_fn: Callable[[str], str], *, id_col: str = "doc_id",
                    text_col: str = "text", mode: str = "word", group_size: int | None = None,
                    min_chars: int = MIN_SECTION_CHARS, lines_per_page: int | None = None) -> DataFrame:
    """Sections decided by a model that sees marked excerpts of pending
    paragraphs. Documents are independent and processed in parallel
    (``mapInPandas`` over document rows, no shuffle); within a document the
    groups are sequential because undecided paragraphs carry over."""
    import pandas as pd

    pdf = mode == "pdf"
    g0 = group_size or (PDF_GROUP if pdf else WORD_GROUP)
    schema = (f"{id_col} long, section_no long, content string, first_marker long, n_paras long"
              + (", page_number long" if pdf else ""))

    def run(batches):
        for b in batches:
            rows = []
            for did, text in zip(b[id_col], b[text_col]):
                paras = []
                for idx, line in enumerate((text or "").split("\n")):
                    t = line.strip()
                    if not t or (not pdf and t.startswith(IMAGE_PREFIX)):
                        continue
                    page = (idx // lines_per_page + 1) if (pdf and lines_per_page) else None
                    paras.append((t, page))
                secs = sections_by_model(paras, boundary_fn, g0, min_chars, pdf)
                for k, (c, f, n, pg) in enumerate(secs):
                    rows.append((did, k, c, f, n) + ((pg,) if pdf else ()))
            cols = [id_col, "section_no", "content", "first_marker", "n_paras"] + (["page_number"] if pdf else [])
            yield pd.DataFrame(rows, columns=cols)

    return spread(df.select(id_col, text_col)).mapInPandas(run, schema)


# Our own wording of the boundary instruction.
SECTION_INSTRUCTION = ("Each line above starts with a paragraph marker. Decide which paragraphs open "
                       "a new section (a change of topic, not just a new paragraph). Reply with a "
                       "Python code block that assigns the list of those markers, as strings, to "
                       "a variable named sections.")


def section_prompt(excerpt: Column) -> Column:
    """Boundary prompt for one marked excerpt."""
    return F.concat(excerpt, F.lit("\n\n" + SECTION_INSTRUCTION))


def per_file_lines(sections: DataFrame, *, file_col: str = "doc_id",
                   section_col: str = "section_no", content_col: str = "content") -> DataFrame:
    """K6 rows: one line per section, ``【k†source】 content`` with the
    per-file number k."""
    return sections.select(file_col, section_col,
                           F.concat(marker(F.col(section_col)), F.lit(" "), F.col(content_col)).alias("line"))


def write_per_file(lines: DataFrame, path: str, file_col: str = "doc_id") -> None:
    """K6 sink: one CSV folder per file (mirrors the input tree by key), lines in
    section order. Only the folders of the files in ``lines`` are replaced."""
    from ragframe.sources.files import CSV_WRITE
    (lines.repartition(file_col).sortWithinPartitions(file_col, "section_no").select(file_col, "line")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**CSV_WRITE)
     .partitionBy(file_col).csv(path))


def rule_model(min_len: int = 60):
    """Stand-in boundary model: answers with a fenced python block listing
    the markers of first or short (heading-like) paragraphs of the excerpt."""
    line = re.compile(r"^【(\d+)†source】 (.*)$")

    def answer(excerpt: str) -> str:
        ms = []
        for ln in excerpt.split("\n"):
            m = line.match(ln)
            if m and (int(m.group(1)) == 0 or len(m.group(2)) < min_len):
                ms.append(f"'【{m.group(1)}†source】'")
        return "Here you go:\n```python\nsections = [" + ", ".join(ms) + "]\n```"

    return answer
