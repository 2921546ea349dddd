"""SQL builders for the checks of queries: steps of greedy algorithms unrolled into common table expressions."""

from __future__ import annotations

from ..functions.stemmer import STEP2, STEP3, STEP4

POINTS = "p AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS VARCHAR) AS label FROM embeddings)"
_COSINE = "least(1.0, greatest(-1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"
DISTANCE = {
    "euclidean": "list_distance({a}, {b})",
    "sq_euclidean": "pow(list_distance({a}, {b}), 2)",
    "manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
    "cosine_full": f"acos({_COSINE}) / pi()",
    "cosine_half": f"2 * acos({_COSINE}) / pi()",
}


def traversal(k: int) -> str:
    """CTEs c(step, id, vec, radius) of the farthest-point traversal from the least id."""
    out = [POINTS, "c0 AS MATERIALIZED (SELECT 0 AS step, id, vec, CAST(NULL AS DOUBLE) AS radius FROM p ORDER BY id LIMIT 1)", "m0 AS MATERIALIZED (SELECT p.id, p.vec, list_distance(p.vec, c0.vec) AS md FROM p, c0)"]
    for i in range(1, k):
        out.append(f"c{i} AS MATERIALIZED (SELECT {i} AS step, id, vec, md AS radius FROM m{i - 1} ORDER BY md DESC, id LIMIT 1)")
        out.append(f"m{i} AS MATERIALIZED (SELECT m.id, m.vec, least(m.md, list_distance(m.vec, c.vec)) AS md FROM m{i - 1} m, c{i} c)")
    out.append("c AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(k)) + ")")
    return ",\n".join(out)


def parted(parts: int, tau: int, rows_per_part: int) -> str:
    """CTEs of the traversal in each part, pid = id modulo the number of parts that the table needs: c(pid, step, id, vec), and n(pid, id, vec, center_id, d), rows with their nearest centre."""
    out = [POINTS, f"q AS MATERIALIZED (SELECT id % (SELECT greatest({parts}, CAST(ceil(count(*) / {rows_per_part}.0) AS BIGINT)) FROM p) AS pid, id, vec, label FROM p)", "c0 AS MATERIALIZED (SELECT pid, 0 AS step, id, vec FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY id) AS r FROM q) WHERE r = 1)", "m0 AS MATERIALIZED (SELECT q.pid, q.id, q.vec, c.id AS cid, list_distance(q.vec, c.vec) AS md FROM q JOIN c0 c USING (pid))"]
    for i in range(1, tau):
        out.append(f"c{i} AS MATERIALIZED (SELECT pid, {i} AS step, id, vec FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY md DESC, id) AS r FROM m{i - 1}) WHERE r = 1)")
        out.append(f"m{i} AS MATERIALIZED (SELECT pid, m.id, m.vec, CASE WHEN list_distance(m.vec, c.vec) < m.md THEN c.id ELSE m.cid END AS cid, least(m.md, list_distance(m.vec, c.vec)) AS md FROM m{i - 1} m JOIN c{i} c USING (pid))")
    out.append("c AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(tau)) + ")")
    out.append(f"n AS MATERIALIZED (SELECT m.pid, m.id, m.vec, m.cid AS center_id, m.md AS d, q.label FROM m{tau - 1} m JOIN q USING (id))")
    return ",\n".join(out)


def matching(k: int, parts: int = 4, tau: int = 16, rows_per_part: int = 100_000) -> str:
    """CTEs of the greedy matching of the kernels of all parts: t(step, a, b, d)."""
    out = [f"WITH {parted(parts, tau, rows_per_part)}", "e AS MATERIALIZED (SELECT x.id AS a, y.id AS b, list_distance(x.vec, y.vec) AS d FROM c x JOIN c y ON x.id < y.id)", "t0 AS MATERIALIZED (SELECT 0 AS step, * FROM e ORDER BY d DESC, a, b LIMIT 1)"]
    for i in range(1, k // 2):
        used = f"(SELECT a FROM t{i - 1} UNION ALL SELECT b FROM t{i - 1})"
        out.append(f"t{i} AS MATERIALIZED (SELECT * FROM t{i - 1} UNION ALL (SELECT {i} AS step, * FROM e WHERE a NOT IN {used} AND b NOT IN {used} ORDER BY d DESC, a, b LIMIT 1))")
    out.append(f"m AS MATERIALIZED (SELECT a AS id FROM t{k // 2 - 1} UNION ALL SELECT b FROM t{k // 2 - 1})")
    out.append("f AS MATERIALIZED (SELECT e.* FROM e WHERE a IN (SELECT id FROM m) AND b IN (SELECT id FROM m))")
    return ",\n".join(out)


WORDS = r"w AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+')) AS word FROM documents) WHERE length(word) >= 2 GROUP BY doc_id, word)"


def porter(words: str) -> str:
    """CTEs up to stems(word, stem) of ``words(word)`` by the published rules, with patterns for a stem's measure; a
    consonant y is Y meanwhile, and only Y."""
    c, v = "[^aeiouy][^aeiouy]*", "[aeiouy]+"
    some, once, twice, vowel = f"^({c})?{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?{v}{c}{v}{c}", f"^({c})?[aeiouy]"
    short = "[^aeiouy][aeiouy][^aeiouywxY]$"

    def marked(w: str) -> str:
        # twice, for in yyy the middle one is a vowel and matches may not overlap
        return f"regexp_replace(regexp_replace(regexp_replace({w}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), '([^aeiouyY]y)y', '\\1Y', 'g')"

    def has(w: str, pattern: str) -> str:
        return f"regexp_matches({w}, '{pattern}')"

    def cut(step: str, before: str, suffixes: list[str]) -> str:
        ends = "|".join(suffixes)
        return f"{step} AS (SELECT word, w, x, w[:length(w) - length(x)] AS base FROM (SELECT word, w, regexp_extract(w, '({ends})$', 1) AS x FROM {before}))"

    def mapped(rules: dict[str, str]) -> str:
        return "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"

    steps = [
        f"s0 AS (SELECT word, {marked('word')} AS w FROM (SELECT DISTINCT word FROM {words}) WHERE length(word) > 2)",
        f"s1 AS (SELECT word, CASE WHEN {has('w', '(sses|ies)$')} THEN w[:length(w) - 2] WHEN {has('w', '[^s]s$')} THEN w[:length(w) - 1] ELSE w END AS w FROM s0)",
        cut("c1", "s1", ["eed", "ed", "ing"]),
        f"b1 AS (SELECT word, x <> '' AND x <> 'eed' AND {has('base', vowel)} AS gone, CASE WHEN x = 'eed' THEN CASE WHEN {has('base', some)} THEN w[:length(w) - 1] ELSE w END WHEN x <> '' AND {has('base', vowel)} THEN base ELSE w END AS w FROM c1)",
        f"d1 AS (SELECT word, CASE WHEN NOT gone THEN w WHEN {has('w', '(at|bl|iz)$')} THEN w || 'e' WHEN w[-1] = w[-2] AND {has('w', '[^aeiouylsz]$')} THEN w[:length(w) - 1] WHEN {has('w', once)} AND {has('w', short)} THEN w || 'e' ELSE w END AS w FROM b1)",
        f"e1 AS (SELECT word, CASE WHEN {has('w', '[yY]$')} AND {has('w[:length(w) - 1]', vowel)} THEN w[:length(w) - 1] || 'i' ELSE w END AS w FROM d1)",
        cut("c2", "e1", list(STEP2)),
        f"s2 AS (SELECT word, CASE WHEN x <> '' AND {has('base', some)} THEN base || {mapped(STEP2)} ELSE w END AS w FROM c2)",
        cut("c3", "s2", list(STEP3)),
        f"s3 AS (SELECT word, CASE WHEN x <> '' AND {has('base', some)} THEN base || {mapped(STEP3)} ELSE w END AS w FROM c3)",
        cut("c4", "s3", STEP4),
        f"s4 AS (SELECT word, CASE WHEN x <> '' AND {has('base', twice)} AND (x <> 'ion' OR {has('base', '[st]$')}) THEN base ELSE w END AS w FROM c4)",
        cut("c5", "s4", ["e"]),
        f"s5 AS (SELECT word, CASE WHEN x <> '' AND ({has('base', twice)} OR {has('base', once)} AND NOT {has('base', short)}) THEN base ELSE w END AS w FROM c5)",
        f"stems AS (SELECT word, lower(CASE WHEN {has('w', 'll$')} AND {has('w', twice)} THEN w[:length(w) - 1] ELSE w END) AS stem FROM s5 UNION ALL SELECT DISTINCT word, word FROM {words} WHERE length(word) <= 2)",
    ]
    return ", ".join(steps)
