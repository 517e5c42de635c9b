"""Checks of chunking and sections on inputs the SQL oracle cannot express.

Nothing here builds chunks. A result is checked against what makes it the only
right one: the pieces join to the text, oversize pieces stand alone, no chunk
is over the limit, and every break is forced because the next piece would not
have fitted."""

from __future__ import annotations

import math
from itertools import pairwise

import regex

from ragframe.functions.text import SENTENCE_PATTERN_REF

SENT = regex.compile(SENTENCE_PATTERN_REF)


def chars4(s: str) -> int:
    return math.ceil(len(s) / 4)


def slices(text: str, cuts: list[int]) -> list[str]:
    return [text[a:b] for a, b in pairwise([0, *cuts, len(text)])]


def sentence_pieces(text: str, pattern=SENT) -> list[str]:
    """A piece begins where a separator begins."""
    return slices(text, [m.start() for m in pattern.finditer(text)])


def word_pieces(text: str, n: int) -> list[str]:
    """A piece begins at every n-th space."""
    return slices(text, [i for i, c in enumerate(text) if c == " "][n - 1::n])


def char_pieces(text: str, n: int) -> list[str]:
    return slices(text, list(range(n, len(text), n)))


def leaves(pieces: list[str], limit: int, finer: list) -> list[tuple[str, bool]]:
    """(text, whether a break must come before it), oversize pieces taken apart;
    a last empty leaf says whether a break must come after the last."""
    out, alone = [], False
    for p in pieces:
        if chars4(p) > limit and finer:
            inner = leaves(finer[0](p), limit, finer[1:])
            out += [(t, b or i == 0) for i, (t, b) in enumerate(inner[:-1])]
            alone = True
        else:
            out.append((p, alone))
            alone = False
    return [*out, ("", alone)]


def first_run(parts: list[tuple[str, bool]], at: int, limit: int) -> int:
    """Where the run of leaves that starts at ``at`` has to end."""
    room, end = limit - chars4(parts[at][0]), at + 1
    while end < len(parts) - 1 and not parts[end][1] and chars4(parts[end][0]) <= room:
        room -= chars4(parts[end][0])
        end += 1
    return end


def splitters(limit: int) -> list:
    return [lambda t: word_pieces(t, limit), lambda t: char_pieces(t, 4 * limit)]


def assert_packed(text: str, chunks: list[str], limit: int, pattern=SENT, finer: list | None = None) -> None:
    parts = leaves(sentence_pieces(text, pattern), limit, splitters(limit) if finer is None else finer)
    assert "".join(t for t, _ in parts) == text == "".join(chunks)
    at = 0
    for c in chunks:
        end = first_run(parts, at, limit)
        assert c == "".join(t for t, _ in parts[at:end]), (text, c)
        at = end
    assert at == len(parts) - 1


def assert_overlapped(plain: list[str], overlapped: list[str], limit: int, overlap: float, pattern=SENT) -> None:
    """Each chunk goes on with the first run of the next one, under the overlap's own limit; pieces stay those of the whole."""
    own = int(limit * overlap)
    assert len(plain) == len(overlapped)
    for i, (p, o) in enumerate(zip(plain, overlapped, strict=True)):
        head = ""
        if i + 1 < len(plain):
            parts = leaves(sentence_pieces(plain[i + 1], pattern), own, splitters(limit))
            head = "".join(t for t, _ in parts[:first_run(parts, 0, own)])
        assert o == p + head, i


def assert_sections(paragraphs: list[str], starts: list[bool], sections: list[str], min_chars: int = 128) -> None:
    """Sections join to the paragraphs; each but the first opens at a start, each
    but the last is long enough, and none goes past a start once it is."""
    assert "\n".join(sections) == "\n".join(paragraphs)
    at = 0
    for k, s in enumerate(sections):
        end = at + s.count("\n") + 1
        length = 0
        for i in range(at, end):
            assert i == at or not (starts[i] and length > min_chars)
            length += len(paragraphs[i])
        assert (at == 0 or starts[at]) and (k == len(sections) - 1 or length > min_chars)
        at = end
    assert at == len(paragraphs)
