"""What the queries have to return, in DuckDB's SQL, where SQL can say it."""

from __future__ import annotations

from .mixing import DIMENSIONS, LEAST, MOST, MOST_SWEEPS, SWEEPS, TOLERANCE, TOPICS
from .queries import MIX_KEEP, MIX_SEED, URL_RULES

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _urls() -> str:
    rules = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in URL_RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH rules(verdict, rule) AS (VALUES {rules}),
    named AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, rule[position('/' IN rule):] AS p FROM rules),
    rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url[position('://' IN url) + 3:], '^[^?#]*') ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/]*'), '{upper}', '{lower}') AS host, regexp_extract(coalesce(r, ''), '/.*$', 0, 's') AS path FROM rest),
    fits AS (SELECT page_id, verdict, rule FROM parts, named WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)"""


def _rules() -> str:
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t),
    win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM spots),
    cover AS (SELECT doc_id, count(DISTINCT i + d)::BIGINT AS n_repeat_words FROM win, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
    dup AS (SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_upper
        FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id)),
    bits AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
        + 16 * (2 * n_upper > word_chars)::BIGINT + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT AS fail_bits FROM m)
    SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM bits"""


def _nearest() -> str:
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 5"""


def _near_duplicates() -> str:
    return """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w)),
    n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc, other) AS (SELECT a, b FROM edges UNION SELECT doc, b FROM reach JOIN edges ON other = a)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, coalesce(m, w.doc_id) >= w.doc_id AS kept
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc, min(other) AS m FROM reach GROUP BY 1) r ON r.doc = w.doc_id"""


def _mixing(temper: float = 0.5) -> str:
    """The marginals' targets, then rounds of factors as a recursion over the
    cells; a row of it also tells how far off the marginals were at the last
    two ends of ``SWEEPS`` rounds."""
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{name}'" for name, p in TOPICS)
    wants = []
    for d in DIMENSIONS:
        wants.append(f"""h_{d} AS (SELECT {d}, sum(tokens)::DOUBLE AS have, pow(sum(tokens)::DOUBLE, {temper}) AS m FROM cells GROUP BY 1),
        s_{d} AS (SELECT {d}, have, m / sum(m) OVER () AS share FROM h_{d}),
        j_{d} AS (SELECT *, row_number() OVER (ORDER BY have / share, {d}) AS j FROM s_{d}),
        c_{d} AS (SELECT *, (b.budget - coalesce(sum(have) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM j_{d}, budget b),
        k_{d} AS (SELECT coalesce(arg_min(c, j) FILTER (WHERE c * share < have), 1e300) AS c FROM c_{d}),
        t_{d} AS (SELECT {d}, least(have, k.c * share) AS want_{d}, k.c * share >= have AS full_{d} FROM s_{d}, k_{d} k)""")
    keep = "source, language, topic, tokens, want_source, full_source, want_language, full_language, want_topic, full_topic"
    step = "it"
    for d in DIMENSIONS:
        whole, part = (f"sum({x}) OVER (PARTITION BY {d})" for x in ("CASE WHEN ratio >= 1 THEN tokens ELSE 0 END::DOUBLE", "CASE WHEN ratio < 1 THEN tokens * ratio ELSE 0.0::DOUBLE END"))
        inner = f"SELECT *, {whole} AS whole, {part} AS part, min(ratio) OVER (PARTITION BY {d}) AS lowest FROM {f'({step})' if ' ' in step else step}"
        if step == "it":
            inner += f" WHERE k < {MOST_SWEEPS} AND (k % {SWEEPS} <> 0 OR k = 0 OR (off > {TOLERANCE} AND off <= 0.9 * was))"
        new = f"CASE WHEN full_{d} THEN ratio / least(1.0::DOUBLE, lowest) WHEN want_{d} > whole AND part > 0 THEN ratio * ((want_{d} - whole) / part) ELSE ratio * (want_{d} / (whole + part)) END"
        step = f"SELECT {keep}, k, off, was, least({MOST}, greatest({LEAST}, {new})) AS ratio FROM ({inner})"
    gaps = ", ".join(f"abs(sum(tokens * least(1.0::DOUBLE, ratio)) OVER (PARTITION BY {d}) - want_{d})" for d in DIMENSIONS)
    gone = f"SELECT *, max(gap) OVER () / (SELECT budget FROM budget) AS o FROM (SELECT *, greatest({gaps}) AS gap FROM ({step}))"
    ends = f"(k + 1) % {SWEEPS} = 0"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS language, CASE {topic} ELSE 'prose' END AS topic, len({_WORDS})::BIGINT AS n_tokens FROM documents),
    cells AS MATERIALIZED (SELECT source, language, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
    budget AS MATERIALIZED (SELECT {MIX_KEEP}::DOUBLE * sum(tokens)::DOUBLE AS budget FROM cells), {", ".join(wants)},
    it AS (SELECT {keep}, 0 AS k, 1e300::DOUBLE AS off, 1e300::DOUBLE AS was, 1.0::DOUBLE AS ratio FROM cells JOIN t_source USING (source) JOIN t_language USING (language) JOIN t_topic USING (topic)
        UNION ALL SELECT {keep}, k + 1, CASE WHEN {ends} THEN o ELSE off END, CASE WHEN {ends} THEN CASE WHEN k + 1 = {SWEEPS} THEN 1e300::DOUBLE ELSE off END ELSE was END, ratio FROM ({gone})),
    p AS (SELECT source, language, topic, least(1.0::DOUBLE, ratio) AS p FROM it WHERE k = (SELECT max(k) FROM it))
    SELECT doc_id, source, language, topic, n_tokens, round(coalesce(p, 1.0), 6) AS probability,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{MIX_SEED}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < coalesce(p, 1.0) AS sampled
    FROM docs LEFT JOIN p USING (source, language, topic)"""


ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": _urls(),
    "op4_near_dup": _near_duplicates(),
    "op5_quality_rules": _rules(),
    "op6_maxscore": _nearest(),
    "op8_mixing": _mixing(),
}
