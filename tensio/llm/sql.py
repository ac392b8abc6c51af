"""DuckDB SQL of the operators that SQL can state, in formulations of their own."""

from __future__ import annotations

from tensio.llm import licenses, repetition
from tensio.llm.license_rules import all_rules, spaced


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan() -> str:
    """Every rule on every text that holds its gate; overlaps by comparing matches of a text."""
    rules = all_rules()
    values = ",\n".join(f"({r.number}, {_quoted(r.label)}, {r.priority}, {_quoted(spaced(r.gate))}, {_quoted(spaced(r.pattern))})" for r in rules)
    base = ", ".join(str(n) for n in licenses.base_rules(rules))
    weight = " ".join(f"WHEN {p} THEN {w:.1f}" for p, w in licenses.WEIGHTS.items())
    return rf"""
WITH rules(rule, label, priority, gate, pattern) AS (VALUES {values}),
split AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
spaced AS (SELECT row_no, doc_id, words, coalesce(array_to_string(list_transform(words, lambda w: ' ' || w || ' '), ''), '') AS body FROM split),
hits AS (
  SELECT row_no, rule, label, priority, regexp_extract_all(body, pattern) AS hit, string_split_regex(body, pattern) AS piece
  FROM spaced JOIN rules ON contains(body, gate)),
each AS (
  SELECT row_no, rule, label, priority, i,
         (length(hit[i]) - length(replace(hit[i], ' ', ''))) // 2 AS size, (length(piece[i]) - length(replace(piece[i], ' ', ''))) // 2 AS before
  FROM (SELECT *, unnest(generate_series(1, len(hit))) AS i FROM hits)),
placed AS (
  SELECT row_no, rule, label, priority, row_number() OVER () AS id, size,
         CAST(sum(size + before) OVER (PARTITION BY row_no, rule ORDER BY i) AS BIGINT) AS stop
  FROM each),
judged AS (
  SELECT d.*, d.stop - d.size AS start,
         NOT EXISTS (
           SELECT 1 FROM placed e
           WHERE e.row_no = d.row_no AND e.id <> d.id AND e.stop - e.size <= d.stop - d.size AND e.stop >= d.stop
             AND CASE WHEN e.size > d.size THEN e.priority <= d.priority ELSE (e.priority, e.rule) < (d.priority, d.rule) END) AS kept
  FROM placed d),
summed AS (
  SELECT row_no, count(*) FILTER (rule IN ({base})) AS n_base, min(start) FILTER (rule IN ({base})) AS first_word, max(start) FILTER (rule IN ({base})) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rule IN ({base})) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept OR rule IN ({base})) AS labels,
         min(priority) FILTER (kept) AS best
  FROM judged GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(CASE best {weight} END, 0.0) AS DOUBLE) AS score
FROM spaced LEFT JOIN summed USING (row_no)
"""


def lexical_search() -> str:
    """Every document that shares a term with an item is scored; no index, no bounds."""
    return r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
total AS (SELECT count(*) AS nd, CAST(sum(len(words)) AS BIGINT) AS nt FROM docs WHERE len(words) > 0),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (
  SELECT row_no, doc_id, n, term, count(*) AS tf
  FROM (SELECT row_no, doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM docs) SEMI JOIN wanted USING (term) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, nd),
scored AS (
  SELECT item_id, row_no, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term), total GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""


def source_audit() -> str:
    """Terms of each document, without chunks; shares of every source and kept term in full."""
    return r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT row_no, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
  FROM groups g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM cells),
usual AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total, any_value(v) AS v FROM cells GROUP BY lang, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
  ON d.lang = a.lang AND d.s = a.source AND d.o = b.source),
words AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def substring_dedup(size: int = 35) -> str:
    """Windows as joined words, counted over all documents; no sketch, no hashes."""
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS words FROM documents),
windows AS (
  SELECT row_no, i, array_to_string(words[i : i + {size - 1}], ' ') AS gram
  FROM (SELECT row_no, words, unnest(generate_series(1, len(words) - {size - 1})) AS i FROM docs WHERE len(words) >= {size})),
again AS (SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY gram) > 1),
gone AS (SELECT DISTINCT row_no, unnest(generate_series(i, i + {size - 1})) AS i FROM again),
placed AS (SELECT row_no, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM docs),
kept AS (
  SELECT row_no, count(*) AS n_removed_not, string_agg(word, ' ' ORDER BY i) AS rest
  FROM placed ANTI JOIN gone USING (row_no, i) GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_removed_not, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row_no)
"""


def quality_rules() -> str:
    """Every n-gram of every length as joined words; covered words one by one."""
    sizes = list(repetition.MAX_COVERAGE)
    covered = ",\n".join(
        rf"""later{n} AS (
  SELECT row_no, i FROM (SELECT row_no, i, array_to_string(words[i : i + {n - 1}], ' ') AS gram
    FROM (SELECT row_no, words, unnest(generate_series(1, len(words) - {n - 1})) AS i FROM docs WHERE len(words) >= {n}))
  QUALIFY {"count(*) OVER (PARTITION BY row_no, gram) > 1" if n == 3 else "row_number() OVER (PARTITION BY row_no, gram ORDER BY i) > 1"}),
in{n} AS (SELECT DISTINCT row_no, unnest(generate_series(i, i + {n - 1})) AS i FROM later{n}),
sum{n} AS (SELECT row_no, {"count(*)" if n == 3 else "CAST(sum(length(word)) AS BIGINT)"} AS v FROM in{n} JOIN placed USING (row_no, i) GROUP BY row_no)"""
        for n in [3, *sizes]
    )
    columns = ", ".join(f"coalesce(sum{n}.v, 0) AS dup_chars_{n}" for n in sizes)
    joins = " ".join(f"LEFT JOIN sum{n} ON sum{n}.row_no = d.row_no" for n in [3, *sizes])
    worse = " OR ".join(
        [f"n_dup_lines > {repetition.MAX_DUP_LINES}::DOUBLE * n_lines", f"dup_line_chars > {repetition.MAX_DUP_LINE_CHARS}::DOUBLE * word_chars"]
        + [f"dup_chars_{n} > {share}::DOUBLE * word_chars" for n, share in repetition.MAX_COVERAGE.items()]
    )
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
placed AS (SELECT row_no, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM docs),
chars AS (SELECT row_no, CAST(sum(length(word)) AS BIGINT) AS v FROM placed GROUP BY row_no),
lines AS (
  SELECT row_no, line, row_number() OVER (PARTITION BY row_no, line ORDER BY i) > 1 AS dup
  FROM (SELECT row_no, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM (SELECT row_no, string_split(t, chr(10)) AS l FROM docs))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
line_sums AS (SELECT row_no, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, CAST(coalesce(sum(length(line)) FILTER (dup), 0) AS BIGINT) AS dup_line_chars FROM lines GROUP BY row_no),
{covered},
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(chars.v, 0) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(sum3.v, 0) AS n_repeat_words, {columns}
  FROM docs d LEFT JOIN chars ON chars.row_no = d.row_no LEFT JOIN line_sums ON line_sums.row_no = d.row_no {joins}),
judged AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND NOT ({worse}) AS kept FROM judged
"""
