"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

The others have no SQL: byte windows (1) are expected to be too slow in it, and tokens (2), models (3, 5, 10) and window
similarities (7) are no SQL; tests hold these against plain versions.
"""

from __future__ import annotations

from orbitframe.llm.jaccard_join import PERCENT, SHINGLE
from orbitframe.llm.quality_rules import MAX_COVERED_PERCENT, MAX_LONGEST, MAX_REPEAT_PERCENT, MIN_WORDS
from orbitframe.llm.quality_rules import WINDOW as REPEAT
from orbitframe.llm.secret_scan import BASE, RULES, Rule
from orbitframe.llm.word_repeats import WINDOW

WORDS = r"[^\x20\x09-\x0D]+"


def _found(rule: Rule, no: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    before, within = "list_sum(list_transform(parts[1:i], lambda x: length(x)))", "coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT r, {no} AS no, '{rule.kind}' AS kind, CAST({before} + {within} AS BIGINT) AS s, CAST({before} + {within} AS BIGINT) + length(whole[i]) AS e
FROM (SELECT r, string_split_regex(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {rule.group}) AS tested FROM d WHERE regexp_matches(t, '{pattern}')) AS m,
  unnest(range(1, len(whole) + 1)) AS u(i) WHERE length(tested[i]) >= {rule.least}"""


SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(rule, i) for i, rule in enumerate(RULES))}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (no = {i}) AS n_{x.kind}" for i, x in enumerate(BASE))},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) FILTER (no < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g AS a JOIN g AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT x AS id, x AS seen FROM e UNION SELECT c.id, e.y FROM c JOIN e ON e.x = c.seen),
m AS (SELECT id, min(seen) AS least FROM c GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
v AS (SELECT r, i, md5(array_to_string(w[i:i + {REPEAT - 1}], ' ')) AS h FROM d, unnest(range(1, len(w) - {REPEAT - 2})) AS u(i)),
k AS (SELECT r, i, h FROM v QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
s AS (SELECT r, count(DISTINCT i + j) AS n FROM k, range({REPEAT}) AS u(j) GROUP BY r),
o AS (SELECT a.r, b.i - a.i AS gap, a.i FROM k AS a JOIN k AS b ON a.r = b.r AND a.h = b.h AND a.i < b.i),
z AS (SELECT r, gap, i - row_number() OVER (PARTITION BY r, gap ORDER BY i) AS island FROM o),
x AS (SELECT r, max(n) AS n FROM (SELECT r, count(*) + {REPEAT - 1} AS n FROM z GROUP BY r, gap, island) GROUP BY r),
y AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORDS}') GROUP BY r),
a AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda q: length(q))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(y.n, 0) AS n_dup_lines, coalesce(s.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS longest_repeat FROM d LEFT JOIN s USING (r) LEFT JOIN x USING (r) LEFT JOIN y USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * n_repeat_words <= {MAX_COVERED_PERCENT} * n_words AND longest_repeat <= {MAX_LONGEST} AS kept FROM a"""

SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
v AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
late AS (SELECT r, i FROM v QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
gone AS (SELECT DISTINCT r, i + j AS i FROM late, range({WINDOW}) AS u(j)),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)"""
