"""What the queries have to return, in DuckDB's SQL over the same tables."""

from __future__ import annotations

DIM, K = 64, 10


def _rows(cosine: bool = True) -> str:
    """base(id, label, v): vectors in stored form, with a norm of their own."""
    if not cosine:
        return "base AS (SELECT vec_id AS id, label, embedding AS v FROM embeddings)"
    return f"raw AS (SELECT vec_id AS id, label, embedding AS e FROM embeddings), base AS (SELECT id, label, {_norm('e')} AS v FROM raw)"


def _norm(e: str) -> str:
    ss = f"list_dot_product({e}::DOUBLE[], {e}::DOUBLE[])"
    return f"list_transform({e}, lambda x: (x::DOUBLE * (CASE WHEN {ss} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / sqrt({ss}) END))::FLOAT)"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _l2(a: str, b: str) -> str:
    square = f"list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
    return f"-list_reduce(list_prepend(0.0::DOUBLE, {square}), lambda x, y: x + y)"


_Q = "q AS (SELECT v FROM base WHERE id = 0)"


def _top(score: str, k: int = K, where: str = "true", cosine: bool = True) -> str:
    return f"WITH {_rows(cosine)}, {_Q} SELECT b.id, {score} AS score FROM base b, q WHERE {where} ORDER BY score DESC, b.id LIMIT {k}"


def _batch(score: str, k: int, cosine: bool = True) -> str:
    return f"""{_rows(cosine)}, pairs AS (SELECT a.id AS query_id, b.id, {score} AS score FROM base a, base b WHERE a.id % 20 = 0),
    truth AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank, id, score FROM pairs QUALIFY rank <= {k})"""


def _sharded(shard: str) -> str:
    return f"""WITH {_rows()}, {_Q}, s AS (SELECT b.id, {shard} AS shard, {_dot("b.v", "q.v")} AS score FROM base b, q)
    SELECT shard, id, score FROM s ORDER BY score DESC, id LIMIT {K}"""


# documents with attributes: quality is missing (no label), null (toxic) or a number
_DOCS = """docs AS (SELECT d.doc_id AS id, d.lang, d.source, d.n_chars, [d.lang, d.source] AS tags, l.doc_id IS NOT NULL AS has_key, CASE WHEN l.toxic = 1 THEN NULL ELSE l.quality END AS quality
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _docs(where: str) -> str:
    return f"WITH {_DOCS} SELECT id FROM docs WHERE {where}"


_SEEDED = f"""{_rows()}, heads AS (SELECT id AS list_id, v FROM base WHERE id < 16),
    near AS (SELECT b.id, h.list_id, {_dot("b.v", "h.v")} AS s FROM base b, heads h),
    best AS (SELECT id, list_id FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN id = list_id THEN 0 ELSE 1 END, s DESC, list_id) = 1)"""


def _probed(k: int, queries: str = "a.id % 20 = 0") -> str:
    return f"""{_SEEDED}, probes AS (SELECT a.id AS query_id, h.list_id FROM base a, heads h WHERE {queries} QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_dot("a.v", "h.v")} DESC, h.list_id) <= 4),
    scored AS (SELECT p.query_id, b.id, {_dot("a.v", "b.v")} AS score FROM probes p JOIN best x USING (list_id) JOIN base b ON b.id = x.id JOIN base a ON a.id = p.query_id),
    found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank, id, score FROM scored QUALIFY rank <= {k})"""


def _truth(k: int) -> str:
    return f"""pairs AS (SELECT a.id AS query_id, b.id, {_dot("a.v", "b.v")} AS score FROM base a, base b WHERE a.id % 20 = 0),
    truth AS (SELECT query_id, id FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


_RECALL = f"{_probed(K)}, {_truth(K)}, recalls AS (SELECT t.query_id, count(f.id) / {K}.0::DOUBLE AS recall FROM truth t LEFT JOIN found f USING (query_id, id) GROUP BY ALL)"
_SIZES = f"{_SEEDED}, sizes AS (SELECT h.list_id, count(b.id)::BIGINT AS size FROM heads h LEFT JOIN best b USING (list_id) GROUP BY ALL)"

# incoming rows of the change queries
_NEW = "new AS (SELECT vec_id * 2 AS id, list_transform(embedding, lambda x: -x) AS v, vec_id AS ord FROM embeddings)"
_LOG = """log AS (SELECT event_id AS seq, user_id AS id, props, value, CASE event_type WHEN 'error' THEN 'remove' WHEN 'click' THEN 'setMeta' WHEN 'view' THEN 'setMeta' ELSE 'upsert' END AS type FROM events),
    a AS (SELECT *, max(CASE WHEN type = 'remove' THEN seq END) OVER (PARTITION BY id) AS gone FROM log),
    b AS (SELECT *, min(CASE WHEN type = 'upsert' THEN seq END) OVER (PARTITION BY id) AS born FROM a WHERE gone IS NULL OR seq > gone),
    folded AS (SELECT id, (arg_max_null(value, seq) FILTER (WHERE type = 'upsert'))::FLOAT::DOUBLE AS v0, arg_max_null(props, seq) AS props FROM b WHERE seq >= born GROUP BY id)"""
_META = "replace(props, ' ', '')"

_MOD = "4294967296.0::DOUBLE"


def _times(x: str, factor: int) -> str:
    p = f"({x})::DOUBLE * {factor}::DOUBLE"
    return f"({p} - floor({p} / {_MOD}) * {_MOD})::BIGINT"


def _hash_steps(name: str, source: str, x: str, keep: str) -> str:
    """CTEs that add ``name``, the placement hash of ``x``."""
    return f"""{name}1 AS (SELECT {keep}, xor({x}, ({x}) >> 16) AS h FROM {source}),
    {name}2 AS (SELECT {keep}, {_times("h", 0x7FEB352D)} AS h FROM {name}1), {name}3 AS (SELECT {keep}, xor(h, h >> 15) AS h FROM {name}2),
    {name}4 AS (SELECT {keep}, {_times("h", 0x846CA68B)} AS h FROM {name}3), {name}5 AS (SELECT {keep}, xor(h, h >> 16) AS {name} FROM {name}4)"""


def _placed(ids: str, pgs: int, replicas: int, targets: int) -> str:
    """placed(id, pg, p0, p1): places of the targets."""
    steps = f"ids AS ({ids}), {_hash_steps('ha', 'ids', 'id', 'id')}, pgs AS (SELECT id, ha % {pgs} AS pg, ((ha % {pgs}) * 2654435761) & 4294967295 AS base FROM ha5), {_hash_steps('hb', 'pgs', 'base', 'id, pg, base')}"
    if replicas < 2:
        return f"{steps}, placed AS (SELECT id, pg, hb % {targets} AS p0 FROM hb5)"
    steps += f", {_hash_steps('hc', 'hb5', '((base + 1) & 4294967295)', 'id, pg, hb')}"
    return f"{steps}, placed AS (SELECT id, pg, hb % {targets} AS p0, CASE WHEN hc % {targets} = hb % {targets} THEN (hc + 1) % {targets} ELSE hc % {targets} END AS p1 FROM hc5)"


_DOC_IDS = "SELECT doc_id AS id FROM documents"
_TOKENS = """tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_.-]+'), lambda t: t <> '')) AS t FROM documents),
    words AS (SELECT DISTINCT t FROM tok),
    hashed AS (SELECT t, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) & 2147483647) % 64 AS slot FROM words),
    slots AS (SELECT doc_id, slot::BIGINT AS slot, count(*)::BIGINT AS n FROM tok JOIN hashed USING (t) GROUP BY ALL)"""


def _moves(formula: str) -> str:
    return f"""manifest AS (SELECT DISTINCT pg, 'db.pg' || pg || '.part0' AS name, 't' || p0 AS source FROM placed),
    wanted AS (SELECT name, source, 't' || {formula} AS target FROM manifest)
    SELECT name, source, target FROM wanted WHERE source <> target"""


def _moves_by_placement() -> str:
    first = _placed(_DOC_IDS, 64, 1, 3)
    return f"""WITH {first}, m AS (SELECT DISTINCT pg, p0, (pg * 2654435761) & 4294967295 AS base FROM placed), {_hash_steps("hd", "m", "base", "pg, p0")}
    SELECT 'db.pg' || pg || '.part0' AS name, 't' || p0 AS source, 't' || (hd % 4) AS target FROM hd5 WHERE p0 <> hd % 4"""


def embed_query(text: str) -> list[float]:
    from .sources.text import hash_embed

    return hash_embed(text, DIM)


def _knn_text() -> str:
    from .queries import QUERY_TEXT

    weights = ", ".join(f"({k}, {int(x)})" for k, x in enumerate(embed_query(QUERY_TEXT)))
    return f"WITH {_TOKENS}, w(slot, x) AS (VALUES {weights}) SELECT d.doc_id AS id, coalesce(sum(s.n * w.x), 0)::DOUBLE AS score FROM documents d LEFT JOIN slots s USING (doc_id) LEFT JOIN w USING (slot) GROUP BY ALL ORDER BY score DESC, id LIMIT {K}"


ORACLE_SQL: dict[str, str] = {
    # search
    "knn_cosine_topk": _top(_dot("b.v", "q.v")),
    "knn_dot_topk": _top(_dot("b.v", "q.v"), cosine=False),
    "knn_l2_topk": _top(_l2("b.v", "q.v"), cosine=False),
    "find_one": _top(_dot("b.v", "q.v"), 1, "label IN (1, 2)"),
    "knn_filtered": _top(_dot("b.v", "q.v"), K, "label IN (1, 3)"),
    "knn_post_filter": f"WITH {_rows()}, {_Q}, h AS (SELECT b.id, label, {_dot('b.v', 'q.v')} AS score FROM base b, q ORDER BY score DESC, id LIMIT 50) SELECT id, score FROM h WHERE label < 5",
    "knn_batch": f"WITH {_batch(_dot('a.v', 'b.v'), K)} SELECT * FROM truth",
    "knn_batch_l2": f"WITH {_batch(_l2('a.v', 'b.v'), K, False)} SELECT * FROM truth",
    "knn_sharded_hash": _sharded("(b.id % 4)::INTEGER"),
    "knn_sharded_range": _sharded("((row_number() OVER (ORDER BY b.id) - 1) % 4)::INTEGER"),
    "normalize_vectors": f"WITH t AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x * 3.0::FLOAT)::FLOAT) AS e FROM embeddings), n AS (SELECT id, {_norm('e')} AS v FROM t) SELECT id, d, v[d + 1]::DOUBLE AS x FROM n, (SELECT unnest(range(64))::BIGINT AS d)",
    # filters
    "expr_match_scalar": _docs("lang = 'en'"),
    "expr_match_list": _docs("source IN ('src1', 'src2')"),
    "expr_match_type_strict": _docs("coalesce(quality = 0, false)"),
    "expr_match_array_overlap": _docs("list_has_any(tags, ['fr', 'src7'])"),
    "expr_range": _docs("n_chars >= 500 AND n_chars > 400 AND n_chars < 2000 AND n_chars <= 3000"),
    "expr_exists": _docs("quality IS NOT NULL"),
    "expr_not_exists": _docs("quality IS NULL"),
    "expr_is_null": _docs("has_key AND quality IS NULL"),
    "expr_is_not_null": _docs("NOT (has_key AND quality IS NULL)"),
    "expr_bool_must_not_should_min": _docs("n_chars > 100 AND NOT coalesce(quality = 0, false) AND (lang IN ('de', 'fr'))::INT + (n_chars < 1000)::INT + (quality IS NOT NULL)::INT >= 2"),
    "expr_has_id_and_must": _docs("id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 7) AND lang IN ('en', 'de')"),
    "expr_meta_path": "SELECT event_id AS id FROM events WHERE (props->>'$.k')::INT >= 10 AND (props->>'$.k')::INT < 20",
    "attr_postings_eq": _docs("source = 'src3'"),
    "attr_postings_exists": _docs("has_key"),
    "attr_postings_range": _docs("n_chars >= 1000 AND n_chars < 4000"),
    "attr_preselect": _docs("n_chars >= 500 AND (lang = 'es' OR coalesce(quality = 1, false)) AND source <> 'src0'"),
    # inverted-file index
    "ivf_assign": f"WITH {_SEEDED} SELECT id, list_id FROM best",
    "ivf_search": f"WITH {_probed(5)} SELECT query_id, rank, id, score FROM found",
    "ivf_search_one": f"WITH {_probed(5, 'a.id = 0')} SELECT id, score FROM found",
    "ivf_kmeans_step": f"""WITH {_rows()}, heads AS (SELECT id AS list_id, v FROM base WHERE id < 16), near AS (SELECT b.id, b.v, h.list_id, {_dot("b.v", "h.v")} AS s FROM base b, heads h),
        best AS (SELECT id, v, list_id FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, list_id) = 1)
        SELECT list_id, count(*)::BIGINT AS n, d, round(sum(v[d + 1]::DOUBLE) / count(*), 6) AS mean FROM best, (SELECT unnest(range(64))::BIGINT AS d) GROUP BY list_id, d""",
    "ivf_recall": f"WITH {_RECALL} SELECT query_id, recall FROM recalls",
    "ivf_recall_report": f"""WITH {_probed(5)}, {_truth(5)}, t AS (SELECT query_id, list(id ORDER BY id) AS want FROM truth GROUP BY 1), f AS (SELECT query_id, list(id ORDER BY id) AS got FROM found GROUP BY 1)
        SELECT query_id, len(list_intersect(want, got)) / 5.0::DOUBLE AS recall, coalesce(array_to_string(list_filter(want, lambda x: NOT list_contains(got, x)), ','), '') AS missing, coalesce(array_to_string(list_filter(got, lambda x: NOT list_contains(want, x)), ','), '') AS extra FROM t JOIN f USING (query_id)""",
    # graphs: only the exact mode has one right answer
    "hnsw_hard": _top(_dot("b.v", "q.v"), K, "label IN (0, 1, 2)"),
    # changes
    "crud_insert_only": f"""WITH {_NEW}, fresh AS (SELECT n.id, n.v, row_number() OVER (ORDER BY n.ord) - 1 AS r FROM new n WHERE n.id NOT IN (SELECT vec_id FROM embeddings))
        SELECT vec_id AS id, vec_id AS pos, embedding[1]::DOUBLE AS v0 FROM embeddings UNION ALL SELECT id, (SELECT max(vec_id) FROM embeddings) + 1 + r, v[1]::DOUBLE FROM fresh""",
    "crud_insert_only_report": f"WITH {_NEW} SELECT id, CASE WHEN id IN (SELECT vec_id FROM embeddings) THEN 'skipped' ELSE 'created' END AS outcome FROM new",
    "crud_upsert": f"""WITH {_NEW}, fresh AS (SELECT n.id, n.v, row_number() OVER (ORDER BY n.ord) - 1 AS r FROM new n WHERE n.id NOT IN (SELECT vec_id FROM embeddings))
        SELECT e.vec_id AS id, e.vec_id AS pos, coalesce(n.v, e.embedding)[1]::DOUBLE AS v0, CASE WHEN n.id IS NULL THEN e.label ELSE -1 END::BIGINT AS label FROM embeddings e LEFT JOIN new n ON n.id = e.vec_id
        UNION ALL SELECT id, (SELECT max(vec_id) FROM embeddings) + 1 + r, v[1]::DOUBLE, -1 FROM fresh""",
    "crud_upsert_report": f"WITH {_NEW} SELECT id, CASE WHEN id IN (SELECT vec_id FROM embeddings) THEN 'updated' ELSE 'created' END AS outcome FROM new",
    "crud_upsert_errors": "SELECT vec_id AS id, 'dim mismatch: got ' || least(64, 60 + label) || ', want 64' AS error FROM embeddings WHERE label < 4",
    "crud_remove_many": "SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'removed' ELSE 'missing' END AS outcome FROM (SELECT DISTINCT doc_id FROM labels)",
    "crud_remaining": "SELECT vec_id AS id, vec_id AS pos FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "crud_set_meta": f"""WITH m AS (SELECT user_id AS id, arg_max({_META}, event_id) AS meta FROM events GROUP BY 1)
        SELECT vec_id AS id, coalesce(m.meta, '{{"label":' || label || '}}') AS meta FROM embeddings LEFT JOIN m ON m.id = vec_id""",
    "crud_set_vector": f"WITH {_NEW} SELECT e.vec_id AS id, e.vec_id AS pos, coalesce(n.v, e.embedding)[1]::DOUBLE AS v0 FROM embeddings e LEFT JOIN new n ON n.id = e.vec_id",
    "get_has_size": "SELECT doc_id AS id, doc_id IN (SELECT vec_id FROM embeddings) AS has, (SELECT count(*) FROM embeddings)::BIGINT AS size FROM labels",
    # change log
    "wal_fold": f"WITH {_LOG} SELECT id, v0, {_META} AS meta FROM folded",
    "wal_fold_with_attrs": f"WITH {_LOG} SELECT id, v0, (props->>'$.k')::BIGINT AS k FROM folded",
    "wal_stream_fold": f"WITH {_LOG} SELECT id, v0, props AS meta FROM folded",
    # placement and snapshots
    "crush_locate": f"WITH {_placed(_DOC_IDS, 64, 2, 3)} SELECT id, pg, 't' || p0 AS first, 't' || p1 AS second FROM placed",
    "segment_layout": f"""WITH {_placed("SELECT vec_id AS id FROM embeddings", 8, 1, 3)}, sized AS (SELECT id, pg, 12 + length('{{"label":' || label || '}}') + 256 AS bytes FROM placed JOIN embeddings ON vec_id = id),
        cut AS (SELECT *, floor(coalesce(sum(bytes) OVER (PARTITION BY pg ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096)::BIGINT AS part FROM sized)
        SELECT id, pg, part, (8 + coalesce(sum(bytes) OVER (PARTITION BY pg, part ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", bytes::BIGINT AS bytes, 'pg' || pg || '.part' || part AS segment FROM cut""",
    "rebalance_plan_placement": _moves_by_placement(),
    "rebalance_plan_plain": f"WITH {_placed(_DOC_IDS, 64, 1, 3)}, {_moves('(((pg * 2654435761) & 4294967295) % 4)')}",
    "rebalance_apply": f"""WITH {_placed(_DOC_IDS, 64, 1, 3)}, m AS (SELECT DISTINCT pg, (pg * 2654435761) & 4294967295 AS base FROM placed), {_hash_steps("hd", "m", "base", "pg")}
        SELECT 'db.pg' || pg || '.part0' AS name, 't' || (hd % 4) AS target, 0::BIGINT AS misplaced FROM hd5""",
    "keep_on_lists": _top(_dot("b.v", "q.v"), K, "b.id % 2 = 1"),
    "keep_on_graph": _top(_dot("b.v", "q.v"), K, "b.id % 2 = 1"),
    "meta_after_index": f"WITH {_rows()}, {_Q} SELECT b.id, {_dot('b.v', 'q.v')} AS score, CASE WHEN b.id % 3 = 0 THEN 99 ELSE label END::BIGINT AS label FROM base b, q ORDER BY score DESC, b.id LIMIT {K}",
    "saved_lists_search": _top(_dot("b.v", "q.v")),
    "log_of_writes": f"""WITH {_rows()}, {_NEW},
        up AS (SELECT coalesce(n.id, b.id) AS id, coalesce(n.v, b.v)[1]::DOUBLE AS v0, '{{"label":' || CASE WHEN n.id IS NULL THEN b.label ELSE -1 END || '}}' AS meta FROM base b FULL JOIN new n ON n.id = b.id),
        m AS (SELECT user_id AS id, arg_max({_META}, event_id) AS meta FROM events GROUP BY 1)
        SELECT up.id, v0, coalesce(m.meta, up.meta) AS meta FROM up LEFT JOIN m USING (id) WHERE up.id NOT IN (SELECT doc_id FROM labels)""",
    "snapshot_roundtrip": "SELECT vec_id AS id, vec_id AS pos, embedding[1]::DOUBLE AS v0, label::BIGINT AS label FROM embeddings",
    "snapshot_asof_read": """WITH e AS (SELECT event_id, event_type, epoch_ms(ts) AS ms FROM events)
        SELECT r.event_id AS read_id, (SELECT 'm' || c.event_id FROM e c WHERE c.event_type = 'purchase' AND c.ms <= r.ms ORDER BY c.ms DESC, 'm' || c.event_id DESC LIMIT 1) AS manifest FROM e r WHERE r.event_type = 'view'""",
    # text, listings, seeds
    "hash_embed_documents": f"WITH {_TOKENS} SELECT doc_id, slot, n FROM slots",
    "hash_embed_knn": _knn_text(),
    "list_vector_then_tail": f"""WITH {_rows()}, {_Q}, h AS (SELECT b.id, row_number() OVER (ORDER BY {_dot("b.v", "q.v")} DESC, b.id)::BIGINT AS rank FROM base b, q QUALIFY rank <= 500)
        SELECT base.id, base.id AS pos, rank FROM base LEFT JOIN h USING (id)""",
    "list_page": "SELECT vec_id AS id, vec_id AS pos FROM embeddings ORDER BY vec_id LIMIT 30 OFFSET 60",
    "meta_substring": f"SELECT event_id AS id FROM events WHERE contains(event_id::VARCHAR, '77') OR contains(lower({_META}), '77')",
    "meta_equals": "SELECT event_id AS id FROM events WHERE props->>'$.k' = '42'",
    "vector_preview": "SELECT vec_id AS id, array_to_string(list_transform(embedding[1:3], lambda x: printf('%.3f', x::DOUBLE)), ', ') AS preview FROM embeddings",
    "seed_table": """SELECT i + 1 AS id, i AS pos, (i % 64) + 1 AS axis, 'item-' || (i + 1) AS key, i AS idx, 'g' || (i % 64) AS "group",
        'b' || CASE WHEN i % 64 >= 36 THEN '1' || substr('0123456789abcdefghijklmnopqrstuvwxyz', ((i % 64) - 36 + 1)::INT, 1) ELSE substr('0123456789abcdefghijklmnopqrstuvwxyz', (i % 64 + 1)::INT, 1) END AS bucket FROM (SELECT unnest(range(500))::BIGINT AS i)""",
    "fit_vector": "WITH t AS (SELECT vec_id AS id, embedding[1:30 + label * 10] AS v FROM embeddings) SELECT id, 64::BIGINT AS n, coalesce(v[64], 0)::DOUBLE AS last, v[30]::DOUBLE AS v29 FROM t",
    # statistics and maintenance
    "stats_lists": f"WITH {_SIZES} SELECT list_id, size FROM sizes",
    "stats_ivf": f"WITH {_SIZES} SELECT sum(size)::BIGINT AS n, count(*)::BIGINT AS nlist, round(avg(size), 6) AS avg_size, max(size) AS max_size, arg_min(list_id, (-size, list_id)) AS hotspot FROM sizes",
    "rules_alerts": f"""WITH {_SIZES}, e AS (SELECT count(*) AS n FROM events), s AS (SELECT max(size) AS m, avg(size) AS a, arg_min(list_id, (-size, list_id)) AS k FROM sizes)
        SELECT 'bf.large-dataset' AS code, 'warn' AS severity, n || ' rows: an index would pay' AS message FROM e WHERE n >= 10000
        UNION ALL SELECT 'ivf.imbalance', 'info', 'ivf.list[' || k || '] size=' || m FROM s WHERE m > 2 * a""",
    "diagnose_ivf": f"""WITH {_RECALL}, sizes AS (SELECT h.list_id, count(b.id)::BIGINT AS size FROM heads h LEFT JOIN best b USING (list_id) GROUP BY ALL), s AS (SELECT max(size) AS m, avg(size) AS a, arg_min(list_id, (-size, list_id)) AS k FROM sizes), r AS (SELECT avg(recall) AS recall FROM recalls)
        SELECT ((m > 2 * a)::INT + (recall < 0.6)::INT)::BIGINT AS suggestions, CASE WHEN m > 2 * a THEN 'ivf.list[' || k || '] size=' || m ELSE '' END AS hotspots, round(recall, 6) AS recall FROM s, r""",
    "consistency_check": "SELECT vec_id AS id, 'missing_in_index' AS problem FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
    "consistency_repair": f"WITH {_SEEDED} SELECT id, list_id, 0::BIGINT AS problems FROM best",
    "compact_after_delete": "SELECT vec_id AS id, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels))::BIGINT AS removed FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "rebuild_switch_strategy": _top(_dot("b.v", "q.v")),
}
