"""The queries of this subpackage in SQL, for an independent engine."""

from __future__ import annotations

from groveline.llm import decontaminate, kernels, lines, secrets
from groveline.llm.quality import RULES, STOP_WORDS

# A word, as an expression of the other engine.
_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole}::DOUBLE ELSE 0 END"


def _quality() -> str:
    stops = _quoted([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)])
    chars = "length(regexp_replace(t, '{}', '', 'g'))"
    failed = []
    for rule in RULES:
        sides = [f"{rule.feature} < {rule.low}::DOUBLE"] if rule.low is not None else []
        sides += [f"{rule.feature} > {rule.high}::DOUBLE"] if rule.high is not None else []
        failed.append(
            f"CASE WHEN ({' OR '.join(sides)}) AND n_words >= {rule.from_words}"
            f" THEN ['{rule.feature}'] ELSE [] END"
        )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
listed AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM texts),
placed AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM listed),
grams AS (
  SELECT r, p, word, lag(word) OVER (PARTITION BY r ORDER BY p) AS prior,
    lead(word, 4) OVER (PARTITION BY r ORDER BY p) AS last,
    string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g
  FROM placed),
counted AS (
  SELECT r, p, CASE WHEN last IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY r, g, last IS NULL) END AS met
  FROM grams),
covered AS (
  SELECT r, max(met) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 1 AS hit
  FROM counted),
repeated AS (SELECT r, count(*) FILTER (WHERE hit) AS n_repeat_words FROM covered GROUP BY r),
per_word AS (
  SELECT r, count(*) FILTER (WHERE word IN {stops}) AS n_stop_words,
    count(*) FILTER (WHERE word = prior) AS n_same_words FROM grams GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, {chars.format("[\\x20\\x09-\\x0D]+")} AS word_chars,
    {chars.format("[^#*$%&|<>]+")} AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, {chars.format("[^!]+")} AS n_exclamations,
    {chars.format("\\P{L}+")} AS n_letters, coalesce(n_stop_words, 0) AS n_stop_words,
    coalesce(n_same_words, 0) AS n_same_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09\\x0D]*$'))) AS n_ellipsis_lines
  FROM listed LEFT JOIN repeated USING (r) LEFT JOIN per_word USING (r)),
ratios AS (
  SELECT *, {_ratio("word_chars", "n_words")} AS mean_word_length,
    {_ratio("n_symbols", "n_words")} AS symbols_per_word,
    {_ratio("n_exclamations", "n_words")} AS exclamations_per_word,
    {_ratio("n_letters", "word_chars")} AS letter_ratio,
    {_ratio("n_same_words", "n_words")} AS same_word_ratio,
    {_ratio("n_stop_words", "n_words")} AS stop_word_ratio,
    {_ratio("n_dup_lines", "n_lines")} AS dup_line_ratio,
    {_ratio("n_bullet_lines", "n_lines")} AS bullet_line_ratio,
    {_ratio("n_ellipsis_lines", "n_lines")} AS ellipsis_line_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counts),
judged AS (SELECT *, list_concat({", ".join(failed)}) AS failed FROM ratios)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept,
  array_to_string(failed, ',') AS failed
FROM judged"""


def _secrets() -> str:
    def literal(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    parts, base = [], []
    for number, rule in enumerate(secrets.RULES):
        pattern = literal(rule.pattern)
        parts.append(
            f"SELECT r, {number} AS k, '{rule.kind}' AS kind,"
            f" unnest(regexp_extract_all(t, {pattern})) AS m,"
            f" unnest(string_split_regex(t, {pattern})) AS gap,"
            f" unnest(range(len(string_split_regex(t, {pattern})))) AS i,"
            f" {rule.least} AS least, {pattern} AS pattern, {rule.group} AS grp FROM texts"
        )
        if rule.base:
            base.append(number)
    met = "\nUNION ALL ".join(parts)
    lengths = " ".join(
        f"WHEN {i} THEN length(regexp_extract(m, {literal(r.pattern)}, {r.group}))"
        for i, r in enumerate(secrets.RULES)
    )
    is_base = f"k IN ({', '.join(map(str, base))})"
    told = "string_agg(told, ',' ORDER BY s, k)"
    counts = ", ".join(
        f"count(*) FILTER (WHERE k = {i}) AS n_{secrets.RULES[i].kind}" for i in base
    )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
met AS ({met}),
placed AS (
  SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r, k ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM met WINDOW w AS (PARTITION BY r, k ORDER BY i)),
held AS (
  SELECT r, k, s, kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT AS told FROM placed
  WHERE m IS NOT NULL AND CASE k {lengths} END >= least),
listed AS (
  SELECT r, {told} AS spans, {told} FILTER (WHERE {is_base}) AS base_spans, {counts}
  FROM held GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{secrets.RULES[i].kind}, 0) AS n_{secrets.RULES[i].kind}" for i in base)},
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (r)"""


def _lines() -> str:
    trimmed = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    # names of copies: the first value, then the least name among pages with the same value
    ring = "18446744073709551616::HUGEINT"
    shingle = " + ".join(
        f"coalesce(lead(v, {i}) OVER w, 0) * {f}" for i, f in enumerate(kernels.WORD_FACTORS)
    )
    names, before = [], "sigs"
    for k, s in enumerate(("s1", "s2", "s3", "s0")):
        names.append(
            f"named{k} AS (SELECT * REPLACE (min(copy) OVER (PARTITION BY source, {s}) AS copy) FROM {before})"
        )
        before = f"named{k}"
    return f"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
words AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p, len(w) AS n
  FROM (SELECT r, regexp_extract_all(text, '{_WORD}') AS w FROM pages)),
valued AS (
  SELECT r, p, n, ('0x' || substr(md5(word), 1, 8))::BIGINT::HUGEINT * 4294967296
    + ('0x' || substr(md5(word), 9, 8))::BIGINT AS v FROM words),
shingles AS (
  SELECT r, p, n, ({shingle}) % {ring} AS v FROM valued WINDOW w AS (PARTITION BY r ORDER BY p)),
minima AS (
  SELECT r, {", ".join(f"min(v * {m} % {ring}) AS s{k}" for k, m in enumerate(kernels.ORDER_FACTORS))}
  FROM shingles WHERE p = 0 OR p + {len(kernels.WORD_FACTORS)} <= n GROUP BY r),
sigs AS (
  SELECT r, source, coalesce(s0, 0) AS copy, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1,
    coalesce(s2, 0) AS s2, coalesce(s3, 0) AS s3
  FROM pages LEFT JOIN minima USING (r)
  WHERE source IS NOT NULL),
{", ".join(names)},
split AS (
  SELECT r, source, unnest(string_split(text, chr(10))) AS x,
    unnest(range(len(string_split(text, chr(10))))) AS i FROM pages),
cut AS (SELECT r, source, i, x, {trimmed} AS line FROM split),
shares AS (
  SELECT c.source, line, count(DISTINCT copy) AS n FROM cut c JOIN {before} USING (r) WHERE line <> '' GROUP BY ALL),
totals AS (SELECT source, count(DISTINCT copy) AS pages FROM {before} GROUP BY ALL),
frequent AS (
  SELECT source, line FROM shares JOIN totals USING (source)
  WHERE n >= {lines.MIN_PAGES} AND n > {lines.RATIO}::DOUBLE * pages),
marked AS (
  SELECT c.*, f.line IS NOT NULL AS dropped FROM cut c LEFT JOIN frequent f
  ON c.source = f.source AND c.line = f.line),
joined AS (
  SELECT r, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text,
    count(*) FILTER (WHERE dropped) AS n FROM marked GROUP BY r)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE j.text END AS text,
  coalesce(j.n, 0) AS boilerplate_lines
FROM pages p LEFT JOIN joined j USING (r)"""


def _warc() -> str:
    bits = "('0x' || substr(hex, i * 5 + 1, 5))::INT"
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({bits} >> {15 - 5 * k}) & 31) + 1, 1)"
        for k in range(4)
    )
    return f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT html, min(page_id) AS first_id FROM bodies GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: {letters}), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM bodies JOIN first USING (html)"""


def _decontamination() -> str:
    """Exact similarity of the windows at all starts, without fingerprints."""

    def shingles(name: str, table: str, key: str) -> str:
        return f"""
{name}_words AS (
  SELECT r, {key}, unnest(w) AS word, unnest(range(len(w))) AS p FROM (
    SELECT row_number() OVER () AS r, {key},
      regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})),
{name}_runs AS (
  SELECT r, {key}, p, lead(word, 4) OVER w AS last,
    string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g
  FROM {name}_words WINDOW w AS (PARTITION BY r ORDER BY p)),
{name} AS (
  SELECT r, {key}, p, g, count(*) OVER (PARTITION BY r) AS most FROM {name}_runs WHERE last IS NOT NULL)"""

    return f"""
WITH {shingles("texts", "documents", "doc_id")},
{shingles("items", "benchmark", "item_id")},
counts AS (SELECT r AS i, item_id, most AS size, g, count(*) AS n FROM items GROUP BY ALL),
hits AS (SELECT t.r, i, t.most, size, t.p, t.g, c.n FROM texts t JOIN counts c USING (g)),
-- a good window holds as many shared shingles as this, so its text does
pairs AS (
  SELECT r, i, size, most FROM hits GROUP BY ALL HAVING count(*) >= {decontaminate.SIMILARITY}::DOUBLE * size - 1e-9),
windows AS (
  SELECT DISTINCT r, i, size, greatest(s, 0) AS start, least(s + size, most) AS stop
  FROM (SELECT r, i, size, most, unnest(range(1 - size, most)) AS s FROM pairs)),
contents AS (
  SELECT w.r, w.i, w.size, start, stop, h.g, least(count(*), any_value(h.n)) AS n
  FROM windows w JOIN hits h ON h.r = w.r AND h.i = w.i AND h.p >= start AND h.p < stop GROUP BY ALL),
shared AS (SELECT r, i, size, start, stop, sum(n) AS common FROM contents GROUP BY ALL),
held AS (
  SELECT *, common::DOUBLE / (stop - start + size - common) AS similarity FROM shared
  WHERE common::DOUBLE / (stop - start + size - common) >= {decontaminate.SIMILARITY}::DOUBLE),
best AS (
  SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY similarity DESC, start DESC, stop) = 1)
SELECT doc_id, item_id, start::BIGINT AS start_word, (stop - start + 4)::BIGINT AS n_words,
  round(similarity, 6) AS similarity
FROM best JOIN (SELECT DISTINCT r, doc_id FROM texts) USING (r) JOIN (SELECT DISTINCT i, item_id FROM counts) USING (i)"""


_GOOD = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _neighbours() -> str:
    """All pairs; the index visits every entry of a table as small as that of this check."""
    return f"""
WITH vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(
    list_transform(list_zip(q.v, c.v), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda s, x: s + x)) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10"""


def _negatives() -> str:
    return f"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_GOOD}),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id % 50 = 0 AND r.vec_id IS DISTINCT FROM a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id,
  positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3"""


def _manifest() -> str:
    def part(value: str) -> str:
        return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return f"sha256({' || '.join(part(f) for f in fields)})"

    # a byte at a time, eight shifts each
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),"
        " lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],"
        " lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295::BIGINT)"
    )

    def levels(name: str, of: str) -> str:
        """Nodes (g, level, i, n, h) of the trees over rows (g, i, n, h)."""
        return f"""
{name} AS (
  SELECT g, 0 AS level, i, n, h FROM {of}
  UNION ALL
  SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name}
  WHERE n > 1 GROUP BY g, level, i // 3, n)"""

    def siblings(name: str, nodes: str) -> str:
        """For each leaf (g, i) and level what stands before and after its ancestor in the run."""
        return f"""
{name} AS (
  SELECT l.g, l.i, a.level, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i < a.i), '') AS before,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i > a.i), '') AS after
  FROM (SELECT g, i FROM {nodes} WHERE level = 0) l
  JOIN {nodes} a ON a.g IS NOT DISTINCT FROM l.g AND a.n > 1 AND a.i = l.i // (3 ** a.level)::BIGINT
  JOIN {nodes} s ON s.g IS NOT DISTINCT FROM l.g AND s.level = a.level AND s.i // 3 = a.i // 3
  GROUP BY l.g, l.i, a.level)"""

    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source AS g, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM leaves),
{levels("nodes", "placed")},
subroots AS (SELECT g AS source, h AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT source, 0 AS g, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n,
    subroot AS h FROM subroots),
{levels("uppers", "tops")},
{siblings("paths", "nodes")},
{siblings("upper_paths", "uppers")},
whole AS (
  SELECT g, i, level, before, after FROM paths
  UNION ALL
  SELECT t.source, p.i, 1000 + u.level, u.before, u.after
  FROM placed p JOIN tops t ON t.source IS NOT DISTINCT FROM p.g JOIN upper_paths u ON u.i = t.i),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY level) AS k FROM whole),
proofs AS (
  SELECT g, i, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM steps GROUP BY g, i),
folded AS (
  SELECT g, i, 0 AS k, other AS h FROM placed
  UNION ALL
  SELECT f.g, f.i, f.k + 1, sha256(s.before || f.h || s.after) FROM folded f
  JOIN steps s ON s.g IS NOT DISTINCT FROM f.g AND s.i = f.i AND s.k = f.k + 1),
ends AS (SELECT g, i, arg_max(h, k) AS h FROM folded GROUP BY g, i),
root AS (SELECT h AS root FROM uppers WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root, coalesce(proof, sha256('')) AS proof_sha256,
  e.h AS folded_root, e.h = root AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.g
JOIN ends e ON e.g IS NOT DISTINCT FROM p.g AND e.i = p.i
LEFT JOIN proofs r ON r.g IS NOT DISTINCT FROM p.g AND r.i = p.i, root"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": _manifest(),
        "op12_nearest_neighbours": _neighbours(),
        "op13_hard_negatives": _negatives(),
        "op1_decontamination": _decontamination(),
        "op8_warc": _warc(),
        "op7_line_dedup": _lines(),
        "op4_secret_scan": _secrets(),
        "op2_quality_rules": _quality(),
    }
