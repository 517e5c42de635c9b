"""DuckDB oracle SQL fragments shared by several queries (text only; the
driver runs it as the reference answer)."""

from __future__ import annotations


def tok(expr: str) -> str:
    """chars4 token count in DuckDB."""
    return f"CAST(ceil(length({expr}) / 4.0) AS BIGINT)"


# Character classes written out for RE2 (DuckDB): Unicode White_Space, and
# the word characters of the Python ``regex`` module's \w.
_WS = r"[\t\n\x0b\x0c\r\x85\p{Z}]"
_WORD = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]"


def newline_units_sql(src: str, keys: list[str], text: str, prefix: str) -> str:
    """CTE ``{prefix}u(keys, ui, t)``: newline units, separator in front."""
    k = ", ".join(keys)
    p = prefix
    return f"""
{p}u0 AS (SELECT {k}, string_split({text}, chr(10)) AS parts FROM {src}),
{p}u1 AS (SELECT {k}, parts, unnest(range(1, len(parts) + 1)) AS i FROM {p}u0),
{p}u AS (SELECT {k}, i - 1 AS ui,
            CASE WHEN i = 1 THEN parts[i] ELSE chr(10) || parts[i] END AS t FROM {p}u1)"""


def sentence_units_sql(src: str, keys: list[str], text: str, prefix: str) -> str:
    r"""CTE ``{prefix}u(keys, ui, t)``: the sentence splitter without
    look-behind. Separators are (a) a whole run of white space whose start
    follows '.', '?' or '!:' and is not preceded by ``\w.\w?`` or
    ``[A-Z][a-z].``; (b) maximal runs of control characters outside (a);
    (c) maximal runs of format characters. Units start at separators."""
    k = ", ".join(keys)
    p = prefix
    return rf"""
{p}s0 AS (SELECT {k}, string_split({text}, '') AS cs, length({text}) AS n FROM {src}),
{p}s1 AS (SELECT {k}, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM {p}s0 WHERE n > 0),
{p}s2 AS (SELECT *, regexp_matches(c, '^{_WS}$') AS ws, regexp_matches(c, '^\p{{Cc}}$') AS cc,
                 regexp_matches(c, '^\p{{Cf}}$') AS cf, regexp_matches(c, '^{_WORD}$') AS w FROM {p}s1),
{p}s3 AS (SELECT *, lag(c, 1) OVER win AS c1, lag(c, 2) OVER win AS c2, lag(c, 3) OVER win AS c3,
                 lag(w, 2) OVER win AS w2, lag(w, 4) OVER win AS w4, lag(ws, 1) OVER win AS pws
          FROM {p}s2 WINDOW win AS (PARTITION BY {k} ORDER BY i)),
{p}s4 AS (SELECT *, ws AND NOT coalesce(pws, false) AS run_start,
                 ws AND NOT coalesce(pws, false)
                 AND coalesce(c1 IN ('.', '?') OR (c1 = ':' AND c2 = '!'), false)
                 AND NOT coalesce(w4 AND c3 = '.' AND w2, false)
                 AND NOT coalesce(regexp_matches(c3, '^[A-Z]$') AND regexp_matches(c2, '^[a-z]$')
                                  AND c1 = '.', false) AS a_start
          FROM {p}s3),
{p}s5 AS (SELECT *, sum(CASE WHEN run_start THEN 1 ELSE 0 END)
                     OVER (PARTITION BY {k} ORDER BY i ROWS UNBOUNDED PRECEDING) AS run_id FROM {p}s4),
{p}s6 AS (SELECT *, ws AND bool_or(a_start) OVER (PARTITION BY {k}, run_id) AS in_a FROM {p}s5),
{p}s7 AS (SELECT *, CASE WHEN in_a THEN 1 WHEN cc THEN 2 WHEN cf THEN 3 ELSE 0 END AS typ FROM {p}s6),
{p}s8 AS (SELECT *, typ > 0 AND typ IS DISTINCT FROM lag(typ) OVER (PARTITION BY {k} ORDER BY i) AS sep_start
          FROM {p}s7),
{p}s9 AS (SELECT {k}, i, c, sum(CASE WHEN sep_start THEN 1 ELSE 0 END)
                 OVER (PARTITION BY {k} ORDER BY i ROWS UNBOUNDED PRECEDING) AS ui FROM {p}s8),
{p}u AS (
  SELECT {k}, ui, string_agg(c, '' ORDER BY i) AS t FROM {p}s9 GROUP BY ALL
  UNION ALL SELECT {k}, 0 AS ui, '' AS t FROM {p}s0 WHERE n = 0
  UNION ALL SELECT {k}, 0 AS ui, '' AS t FROM {p}s9 WHERE i = 1 AND ui = 1)"""


def leaves_sql(src: str, keys: list[str], text: str, limit: int, word_limit: int,
               char_limit: int, prefix: str, units: str = "newline") -> str:
    """CTEs expanding the units of ``src.text`` into packed leaves with
    ``li`` order and ``brk`` flag. Produces CTE ``{prefix}lb``."""
    k = ", ".join(keys)
    p = prefix
    unit_sql = (sentence_units_sql if units == "sentence" else newline_units_sql)(src, keys, text, prefix)
    return unit_sql + f""",
{p}un AS (SELECT *, {tok('t')} AS n FROM {p}u),
{p}w0 AS (SELECT {k}, ui, string_split(t, ' ') AS ws FROM {p}un WHERE n > {limit}),
{p}w1 AS (SELECT {k}, ui, ws, unnest(range(0, len(ws), {word_limit})) AS s FROM {p}w0),
{p}w AS (SELECT {k}, ui, s // {word_limit} AS wi,
            CASE WHEN s = 0 THEN '' ELSE ' ' END
            || array_to_string(ws[s + 1 : s + {word_limit}], ' ') AS t FROM {p}w1),
{p}wn AS (SELECT *, {tok('t')} AS n FROM {p}w),
{p}c0 AS (SELECT {k}, ui, wi, t, unnest(range(0, length(t), {char_limit})) AS s
          FROM {p}wn WHERE n > {limit}),
{p}c AS (SELECT {k}, ui, wi, s // {char_limit} AS ci, substr(t, s + 1, {char_limit}) AS t FROM {p}c0),
{p}lv0 AS (
  SELECT {k}, ui, 0 AS wi, 0 AS ci, false AS uo, false AS wo, t FROM {p}un WHERE n <= {limit}
  UNION ALL SELECT {k}, ui, wi, 0, true, false, t FROM {p}wn WHERE n <= {limit}
  UNION ALL SELECT {k}, ui, wi, ci, true, true, t FROM {p}c),
{p}lv AS (SELECT *, {tok('t')} AS n,
            row_number() OVER (PARTITION BY {k} ORDER BY ui, wi, ci) - 1 AS li FROM {p}lv0),
{p}lb AS (
  SELECT *, coalesce(
     (ui <> lag(ui) OVER w AND (uo OR lag(uo) OVER w))
     OR (ui = lag(ui) OVER w AND wi <> lag(wi) OVER w AND (wo OR lag(wo) OVER w)), false) AS brk
  FROM {p}lv WINDOW w AS (PARTITION BY {k} ORDER BY li))"""


def fold_sql(keys: list[str], limit: int, prefix: str) -> str:
    """Recursive CTE ``{prefix}f`` running the greedy fold over ``{prefix}lb``
    (requires WITH RECURSIVE)."""
    k = ", ".join(keys)
    p = prefix
    on = " AND ".join(f"l.{c} = f.{c}" for c in keys)
    fk = ", ".join(f"l.{c}" for c in keys)
    return f"""
{p}f({k}, li, cid, cur) AS (
  SELECT {k}, li, 0, n FROM {p}lb WHERE li = 0
  UNION ALL
  SELECT {fk}, l.li,
         CASE WHEN l.brk OR f.cur + l.n > {limit} THEN f.cid + 1 ELSE f.cid END,
         CASE WHEN l.brk OR f.cur + l.n > {limit} THEN l.n ELSE f.cur + l.n END
  FROM {p}f f JOIN {p}lb l ON {on} AND l.li = f.li + 1)"""


def chunks_sql(keys: list[str], prefix: str) -> str:
    """CTE ``{prefix}chunks(keys, chunk_no, chunk)`` from the fold."""
    k = ", ".join(keys)
    p = prefix
    on = " AND ".join(f"l.{c} = f.{c}" for c in keys)
    fk = ", ".join(f"f.{c}" for c in keys)
    return f"""
{p}chunks AS (
  SELECT {fk}, CAST(f.cid AS BIGINT) AS chunk_no, string_agg(l.t, '' ORDER BY l.li) AS chunk
  FROM {p}f f JOIN {p}lb l ON {on} AND l.li = f.li
  GROUP BY {fk}, f.cid)"""


def heads_sql(keys: list[str], limit: int, prefix: str) -> str:
    """CTE ``{prefix}head(keys, head)``: the first packed piece, i.e. leaves up
    to the first break or the first running total above ``limit``."""
    k = ", ".join(keys)
    p = prefix
    return f"""
{p}hb AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY li ROWS UNBOUNDED PRECEDING) AS cs
          FROM {p}lb),
{p}stop AS (SELECT {k}, min(li) AS stop_li FROM {p}hb WHERE li > 0 AND (brk OR cs > {limit})
            GROUP BY {k}),
{p}head AS (SELECT {k}, string_agg(t, '' ORDER BY li) AS head
            FROM {p}hb LEFT JOIN {p}stop USING ({k})
            WHERE stop_li IS NULL OR li < stop_li GROUP BY {k})"""
