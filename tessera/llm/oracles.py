"""The operators' queries in DuckDB's SQL, where SQL can say the same."""

from __future__ import annotations

from tessera.llm import mixing, quality, topk

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _at(share: str) -> str:
    """When the share of a schedule has passed: the area 5 falls from 6 to 4, 2 is level, 1 rises from 0.5 to 1.5."""
    return (
        f"CASE weight WHEN 5 THEN least(2 * (5 * {share}) / (6 + sqrt(36 - 4 * (5 * {share}))), 1) WHEN 2 THEN least(2 * (2 * {share}) / (2 + sqrt(4 + 0 * {share})), 1) "
        f"ELSE least(2 * (1 * {share}) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * (1 * {share}))), 1) END"
    )


#: Documents in the drawn order, running sums in one window for each source; targets by trying every
#: number of sources held at the limit; the last pass filled by recursion over sizes.
MIX = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, source, len({WORDS})::BIGINT AS size, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS drawn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3 / weight, source NULLS LAST) AS rank FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(source_size * 3) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN z IS NULL THEN (source_size * 3)::DOUBLE ELSE least((source_size * 3)::DOUBLE, z * weight) END AS target
  FROM l CROSS JOIN (SELECT min_by(level, rank) FILTER (WHERE level <= source_size * 3 / weight) AS z FROM l)),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY drawn, doc_id, size, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, floor(target)::BIGINT - passes * source_size AS room FROM p),
b AS (SELECT *, coalesce(sum(CASE WHEN size <= room THEN size END) OVER (PARTITION BY source ORDER BY drawn, doc_id, size, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fit_before FROM r),
w AS (SELECT *, size > 0 AND size <= room AND fit_before + size <= room AS within, size > 0 AND passes < 3 AS may FROM b),
g AS (SELECT source, any_value(target) AS target, any_value(room) AS room, (any_value(room) - coalesce(sum(size) FILTER (WHERE within), 0))::BIGINT AS gap FROM w GROUP BY source),
h AS (SELECT source, size, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS r FROM w WHERE may AND NOT within GROUP BY source, size),
fold(source, r, "left", size, take, spare) AS (SELECT source, 0::BIGINT, gap, 0::BIGINT, 0::BIGINT, NULL::BIGINT FROM g
  UNION ALL SELECT f.source, h.r, f."left" - least(h.n, f."left" // h.size) * h.size, h.size, least(h.n, f."left" // h.size), CASE WHEN least(h.n, f."left" // h.size) < h.n THEN h.size ELSE f.spare END
  FROM fold f JOIN h ON h.source IS NOT DISTINCT FROM f.source AND h.r = f.r + 1),
ended AS (SELECT source, arg_max("left", r) AS "left", max_by(struct_pack(x := spare), r).x AS spare FROM fold GROUP BY source),
one AS (SELECT e.source, target, room, coalesce(spare - "left" < "left", false) AS over, CASE WHEN coalesce(spare - "left" < "left", false) THEN spare - "left" ELSE "left" END AS miss, spare FROM ended e JOIN g ON g.source IS NOT DISTINCT FROM e.source),
h2 AS (SELECT w.source, size, count(*) AS n, row_number() OVER (PARTITION BY w.source ORDER BY size DESC) AS r FROM w JOIN one ON one.source IS NOT DISTINCT FROM w.source WHERE may AND miss > 0.01 * one.target GROUP BY w.source, size),
fold2(source, k, r, "left", size, take, spare) AS (SELECT h2.source, h2.r, h2.r - 1, g.room, 0::BIGINT, 0::BIGINT, NULL::BIGINT FROM h2 JOIN g ON g.source IS NOT DISTINCT FROM h2.source WHERE h2.r <= 64
  UNION ALL SELECT f.source, f.k, h2.r, f."left" - least(h2.n, f."left" // h2.size) * h2.size, h2.size, least(h2.n, f."left" // h2.size), CASE WHEN least(h2.n, f."left" // h2.size) < h2.n THEN h2.size ELSE f.spare END
  FROM fold2 f JOIN h2 ON h2.source IS NOT DISTINCT FROM f.source AND h2.r = f.r + 1),
ended2 AS (SELECT source, k, arg_max("left", r) AS "left", max_by(struct_pack(x := spare), r).x AS spare FROM fold2 GROUP BY source, k),
two AS (SELECT source, arg_min(struct_pack(k := k, over := coalesce(spare - "left" < "left", false), spare := spare, miss := CASE WHEN coalesce(spare - "left" < "left", false) THEN spare - "left" ELSE "left" END),
  struct_pack(a := CASE WHEN coalesce(spare - "left" < "left", false) THEN spare - "left" ELSE "left" END, b := k)) AS t FROM ended2 GROUP BY source),
z AS (SELECT one.source, coalesce(t.miss < one.miss, false) AS again, t.k AS k, CASE WHEN coalesce(t.miss < one.miss, false) THEN t.over ELSE one.over END AS over, CASE WHEN coalesce(t.miss < one.miss, false) THEN t.spare ELSE one.spare END AS spare
  FROM one LEFT JOIN two ON two.source IS NOT DISTINCT FROM one.source),
takes AS (SELECT source, size, sum(take) AS take FROM (SELECT f.source, size, take FROM fold f JOIN z ON z.source IS NOT DISTINCT FROM f.source WHERE NOT again AND take > 0
  UNION ALL SELECT f.source, size, take FROM fold2 f JOIN z ON z.source IS NOT DISTINCT FROM f.source WHERE again AND f.k = z.k AND take > 0
  UNION ALL SELECT source, spare, 1 FROM z WHERE over) GROUP BY source, size),
q AS (SELECT w.*, again, may AND (again OR NOT within) AS open, row_number() OVER (PARTITION BY w.source, size, may AND (again OR NOT within) ORDER BY drawn, doc_id, id) AS n FROM w JOIN z ON z.source IS NOT DISTINCT FROM w.source),
y AS (SELECT q.*, (within AND NOT again) OR (open AND coalesce(n <= take, false)) AS last FROM q LEFT JOIN takes ON takes.source IS NOT DISTINCT FROM q.source AND takes.size = q.size),
c AS (SELECT *, CASE WHEN size > 0 THEN passes + last::BIGINT ELSE 0 END AS copies,
  coalesce(sum(CASE WHEN last THEN size END) OVER (PARTITION BY source ORDER BY drawn, doc_id, size, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS last_start,
  passes * source_size + coalesce(sum(CASE WHEN last THEN size END) OVER (PARTITION BY source), 0)::BIGINT AS read FROM y),
m AS (SELECT *, ((CASE WHEN passes > 0 THEN start ELSE last_start END)::BIGINT + size / 2) / read AS first_share, ((CASE WHEN last THEN passes * source_size + last_start ELSE (passes - 1) * source_size + start END)::BIGINT + size / 2) / read AS last_share FROM c),
i AS (SELECT m.*, weight FROM m JOIN s ON s.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, CASE WHEN copies > 0 THEN {_at('first_share')} END AS first_position, CASE WHEN copies > 0 THEN {_at('last_share')} END AS last_position FROM i"""

TOP_K = f"""WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {topk.K}"""

#: The template's overhead by role, and one character for each control string of a text that doesn't survive as it is.
_CONTROL = r"(<\\*(/s>|<SYS>>|</SYS>>)|\[\\*(/?INST\]|/ROLE\]|ROLE[ \]]))"
_ESCAPED = r"(<\\+(/s>|<SYS>>|</SYS>>)|\[\\+(/?INST\]|/ROLE\]|ROLE[ \]]))"
CHAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 WHEN '' THEN 13 ELSE 14 + len(url_encode(role)) END AS frame,
  regexp_matches(text, '{_ESCAPED}') OR CASE role WHEN 'user' THEN contains(text, ' [/INST]') WHEN 'system' THEN contains(text, '<</SYS>>')
    WHEN 'assistant' THEN contains(text, '</s>') OR starts_with(text, '[INST] ') OR starts_with(text, '<<SYS>>') OR regexp_matches(text, '^\[ROLE( [A-Za-z0-9_.~%-]*)?\]') ELSE contains(text, '[/ROLE]') END AS hard FROM c),
u AS (SELECT *, len(text) + frame + CASE WHEN hard THEN len(regexp_extract_all(text, '{_CONTROL}')) ELSE 0 END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id"""

#: Windows meet by their words; a word goes if any window over it starts in a smaller document.
SUBSTRING = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {WORDS} AS w FROM documents),
x AS (SELECT id, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
k AS (SELECT id, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM x),
m AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
gone AS (SELECT DISTINCT id, unnest(range(i, i + 13)) AS p FROM k JOIN m USING (h) WHERE first < doc_id),
e AS (SELECT id, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
a AS (SELECT e.id, count(*) AS n_words, count(gone.id) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE gone.id IS NULL), '') AS kept
  FROM e LEFT JOIN gone ON gone.id = e.id AND gone.p = e.p GROUP BY e.id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (id)"""


def _quality() -> str:
    """The statistics, then EM over vote patterns as a recursive query, a round a step."""
    rules, first = quality.RULES, quality.beginning()
    m = len(rules)
    k = len(first) // (1 + 3 * m)
    a = quality.PRIOR_DOCUMENTS
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good, _ in rules)
    start = "[" + ", ".join(f"{x!r}::DOUBLE" for x in first) + "]"
    at = lambda c, j: k + (c * m + j) * 3
    logs = ", ".join(f"ln(th[{c + 1}])" + "".join(f" + ln(th[{at(c, j) + 2} + v[{j + 1}]])" for j in range(m)) + f" AS l{c}" for c in range(k))
    top = f"greatest({', '.join(f'l{c}' for c in range(k))})"
    total = " + ".join(f"exp(l{c} - {top})" for c in range(k))
    shares = ", ".join(f"exp(l{c} - {top}) / ({total}) AS p{c}" for c in range(k))
    out = [f"(sum(n * p{c}) + {a} * {first[c]!r}) / (sum(n) + {a})" for c in range(k)]
    for c in range(k):
        for j in range(m):
            for v in range(3):
                out.append(f"(coalesce(sum(n * p{c}) FILTER (WHERE v[{j + 1}] = {v - 1}), 0) + {a} * {first[at(c, j) + v]!r}) / (sum(n * p{c}) + {a})")
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
x AS (SELECT id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
k AS (SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(w[i:i + 4], ' ')) AS c FROM x),
cover AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 5)) AS p FROM k WHERE c > 1) GROUP BY id),
b AS (SELECT d.id, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: len(y))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_capitals, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cover USING (id)),
st AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM b),
vt AS (SELECT *, [{votes}] AS v FROM st),
ps AS (SELECT v, count(*)::DOUBLE AS n FROM vt GROUP BY v),
em AS (SELECT 0 AS k, {start} AS th
  UNION ALL SELECT k + 1, (SELECT [{", ".join(out)}] FROM (SELECT v, n, {shares} FROM (SELECT v, n, {logs} FROM ps))) FROM em WHERE k < 40),
po AS (SELECT v, p0 AS posterior FROM (SELECT v, {shares} FROM (SELECT v, {logs} FROM ps CROSS JOIN (SELECT th FROM em WHERE k = 40)))),
r AS (SELECT vt.*, posterior, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM vt JOIN po USING (v))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept FROM r"""


ORACLES = {
    "op1_quality_rules": _quality(),
    "op4_curriculum_mix": MIX,
    "op5_substring_index": SUBSTRING,
    "op8_norm_sorted_top_k": TOP_K,
    "op10_chat_format": CHAT,
}
assert len(mixing.SCHEDULES) == 3  # MIX has their areas
