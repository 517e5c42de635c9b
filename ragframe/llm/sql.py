"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from ragframe.llm import chat, licenses, phrases, sharding


def license_scan() -> str:
    values = ", ".join(f"({i}, '{t.label}', '{t.text}', {t.exact})"
                       for i, t in enumerate(licenses.BASE_PHRASES + licenses.NOTICES))
    return rf"""
WITH templates(tid, label, txt, exact) AS (VALUES {values}),
template_words AS (
  SELECT tid, label, exact, unnest(string_split(txt, ' ')) AS w,
         generate_subscripts(string_split(txt, ' '), 1) - 1 AS i FROM templates),
template_rolled AS (
  SELECT tid, label, exact, i AS tpos,
         CASE WHEN exact THEN w || ' ' || lead(w) OVER t
              ELSE w || ' ' || lead(w) OVER t || ' ' || lead(w, 2) OVER t || ' ' || lead(w, 3) OVER t END AS gram
  FROM template_words WINDOW t AS (PARTITION BY tid ORDER BY i)),
template_grams AS (
  SELECT *, count(*) OVER (PARTITION BY tid) AS n_grams FROM template_rolled WHERE gram IS NOT NULL),
docs AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
doc_words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM docs),
rolled AS (
  SELECT doc_id, i AS p, w || ' ' || lead(w) OVER d AS g2,
         w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d AS g4
  FROM doc_words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
hits AS (
  SELECT doc_id, p, tid, label, exact, n_grams, tpos FROM rolled JOIN template_grams ON exact AND gram = g2
  UNION ALL
  SELECT doc_id, p, tid, label, exact, n_grams, tpos FROM rolled JOIN template_grams ON NOT exact AND gram = g4),
diagonals AS (
  SELECT doc_id, tid, p - tpos AS diagonal, min(p) AS start FROM hits GROUP BY ALL),
spans AS (
  SELECT *, sum(jump) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal)
                        <= {licenses.MERGE_SLACK}
                   AND tid >= {len(licenses.BASE_PHRASES)} THEN 0 ELSE 1 END AS jump
    FROM diagonals)),
merged AS (
  SELECT h.doc_id, h.tid, h.label, h.exact, s.span, min(s.start) AS start,
         count(DISTINCT h.tpos)::DOUBLE / max(h.n_grams) AS coverage
  FROM hits h JOIN spans s ON s.doc_id = h.doc_id AND s.tid = h.tid AND s.diagonal = h.p - h.tpos
  GROUP BY ALL),
judged AS (
  SELECT *, coverage >= CASE WHEN exact THEN 1.0 ELSE {licenses.MIN_COVERAGE} END AS verified FROM merged),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE verified AND exact) AS n_base,
         min(start) FILTER (WHERE verified AND exact) AS first_word,
         max(start) FILTER (WHERE verified AND exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified AND exact) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified) AS labels,
         max(coverage) FILTER (WHERE verified OR NOT exact) AS score
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id
"""


def chat_perspectives() -> str:
    n = chat.SEGMENT_TURNS
    system = ", ".join(f"'{r}'" for r in chat.SYSTEM_ROLES)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), '{chat.NO_NAME}') AS role, coalesce(text, '') AS text,
         coalesce(floor(turn / {n}), 0)::BIGINT AS segment FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role, text) AS rn FROM t),
people AS (SELECT DISTINCT conv_id, role AS assistant FROM t WHERE role NOT IN ({system})),
lines AS (
  SELECT t.conv_id, p.assistant, t.segment, ((rn - 1) // {n})::BIGINT AS part, rn, role, text,
         CASE WHEN role = assistant THEN '<|assistant|>' WHEN role IN ({system}) THEN '<|' || role || '|>'
              ELSE '<|user name=' || role || '|>' END || chr(10) AS head, text || '<|end|>' || chr(10) AS tail
  FROM numbered t JOIN people p ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(tail))
            OVER (PARTITION BY conv_id, assistant, segment, part ORDER BY rn) AS ends FROM lines)
SELECT conv_id, assistant, segment, part, count(*)::BIGINT AS n_turns,
       count(*) FILTER (WHERE role = assistant)::BIGINT AS n_masked,
       string_agg(head || tail, '' ORDER BY rn) AS rendered,
       coalesce(list((ends - length(tail))::BIGINT ORDER BY rn) FILTER (WHERE role = assistant), []) AS mask_start,
       coalesce(list((ends - 1)::BIGINT ORDER BY rn) FILTER (WHERE role = assistant), []) AS mask_end
FROM placed GROUP BY conv_id, assistant, segment, part
"""


def collocations() -> str:
    upper = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
    depth = phrases.DEPTH
    lengths = ", ".join(f"({i})" for i in range(1, depth + 1))
    return rf"""
WITH texts AS (
  SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS txt
  FROM documents),
pieces AS (
  SELECT lang, unnest(regexp_split_to_array(txt, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
word_lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, words, unnest(list_transform(range(1, len(ws) - words + 2),
                                            lambda i: array_to_string(ws[i:i + words - 1], ' '))) AS phrase
  FROM word_lists, (VALUES {lengths}) AS lengths(words) WHERE len(ws) >= words),
counted AS MATERIALIZED (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
candidates AS MATERIALIZED (
  SELECT lang, words, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counted
  WHERE words > 1 AND f >= {phrases.MIN_COUNT}),
sides AS (
  SELECT lang, phrase, a, k, unnest([array_to_string(ws[1:k], ' '), array_to_string(ws[k + 1:words], ' ')]) AS side,
         unnest([1, 2]) AS which
  FROM candidates, (VALUES {lengths}) AS cuts(k) WHERE k < words),
scored AS (
  SELECT s.lang, s.phrase, a, k, max(f) FILTER (WHERE which = 1) AS l, max(f) FILTER (WHERE which = 2) AS r,
         ({phrases.SCALE}::HUGEINT * a) // (max(f) FILTER (WHERE which = 1) + max(f) FILTER (WHERE which = 2)) AS score
  FROM sides s JOIN counted c ON c.lang = s.lang AND c.phrase = s.side GROUP BY s.lang, s.phrase, a, k),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(ws[first_word:first_word + size - 1], ' ') AS phrase, max(a) AS around
  FROM candidates, (VALUES {lengths}) AS places(first_word), (VALUES {lengths}) AS sizes(size)
  WHERE size > 1 AND size < words AND first_word + size - 1 <= words GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN around x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE x.around IS NULL OR 100 * x.around < {phrases.ABSORB} * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= {phrases.TOP}
"""


def shards() -> str:
    k = sharding.SHARDS
    # fixed values: the reflected CRC-32 of each half byte
    half_bytes = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        half_bytes.append(i)
    step = lambda crc, nibble: f"xor(CAST([{', '.join(map(str, half_bytes))}] AS BIGINT[])[(xor({crc}, {nibble}) & 15) + 1], {crc} >> 4)"
    last = lambda byte: f"list_max(list_filter(ends, lambda e: e <= {byte}))"
    nxt = lambda byte: f"list_min(list_filter(ends, lambda e: e >= {byte}))"
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, text, (coalesce(strlen(text), 0) + {sharding.ROW_BYTES})::BIGINT AS size, coalesce(sha256(text), '') AS digest
  FROM documents),
halves AS (
  SELECT digest, list_transform(string_split(hex(encode(any_value(text))), ''), lambda h: ('0x' || h)::BIGINT) AS hs
  FROM sized WHERE text <> '' GROUP BY digest),
swapped AS (
  SELECT digest, list_transform(range(1, len(hs) + 1), lambda i: CASE WHEN i % 2 = 1 THEN hs[i + 1] ELSE hs[i - 1] END) AS nibbles
  FROM halves),
sums AS (
  SELECT digest, xor(list_reduce(list_prepend(4294967295::BIGINT, nibbles), lambda c, h: {step('c', 'h')}), 4294967295::BIGINT) AS crc
  FROM swapped),
groups AS (
  SELECT digest, CASE WHEN count(doc_id) = count(*) THEN min(doc_id) END AS first_id, sum(size)::BIGINT AS bytes
  FROM sized GROUP BY digest),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, digest) AS r, sum(bytes) OVER () AS total,
         coalesce(sum(bytes) OVER (ORDER BY bytes DESC, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS larger
  FROM groups),
judged AS (
  SELECT *, coalesce(r < {k} AND bool_and(bytes * ({k} + 1 - r) > total - larger) OVER (ORDER BY r), false) AS alone FROM ranked),
placed AS (
  SELECT digest, bytes, sum(bytes) OVER (ORDER BY first_id NULLS FIRST, digest)::BIGINT AS e FROM judged WHERE NOT alone),
known AS (
  SELECT list_prepend(0::BIGINT, list(e ORDER BY e)) AS ends, max(e) AS total, max(bytes) AS largest,
         {k} - (SELECT count(*) FROM judged WHERE alone)::BIGINT AS k FROM placed),
search(low, high) AS (
  SELECT greatest(largest, (total + k - 1) // k)::BIGINT, ((total + k - 1) // k + largest)::BIGINT FROM known
  UNION ALL
  SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END FROM (
    SELECT low, high, middle, list_reduce(list_prepend(0::BIGINT, range(k)), lambda pos, step: {last('pos + middle')}) = total AS fits
    FROM (SELECT low, high, (low + high) // 2 AS middle FROM search WHERE low < high), known)),
capacity AS (SELECT low AS c FROM search WHERE low = high LIMIT 1),
earliest AS (
  SELECT list_reduce(list_prepend([total], list_transform(range(k - 1), lambda i: []::BIGINT[])),
                     lambda found, more: list_prepend({nxt('found[1] - c')}, found)) AS es FROM known, capacity),
cutting(j, pos) AS (
  SELECT 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT j + 1, least(greatest(CASE WHEN aim - before <= after - aim THEN before ELSE after END, es[j + 1]), farthest) FROM (
    SELECT j, es, aim, {last('aim')} AS before, {nxt('aim')} AS after, {last('pos + c')} AS farthest FROM (
      SELECT j, pos, ends, c, es, (pos + (total - pos + k - j - 1) // (k - j))::BIGINT AS aim
      FROM cutting, known, capacity, earliest WHERE j < k - 1))),
shard_of AS (
  SELECT digest, (r - 1)::INT AS shard, 0 AS start FROM judged WHERE alone
  UNION ALL
  SELECT digest, ((SELECT count(*) FROM judged WHERE alone) + (SELECT count(*) FROM cutting WHERE j > 0 AND pos <= e - bytes))::INT,
         e - bytes FROM placed)
SELECT doc_id, size, CASE WHEN text = '' THEN 0 ELSE crc END::BIGINT AS text_crc32, '{sharding.LAW}' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY start, doc_id NULLS FIRST) - 1)::BIGINT AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM sized JOIN shard_of USING (digest) LEFT JOIN sums USING (digest)
"""
