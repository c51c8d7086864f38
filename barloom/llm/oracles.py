"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from barloom.llm.site_lines import MAX_RATIO, MIN_PAGES

BLANKS = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"



def _hex(k: int) -> str:
    return f"('0x' || hx[{8 * k - 7}:{8 * k}])::BIGINT"


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, leaves: str) -> str:
    """All nodes of the trees over `leaves` (g, idx, n, h), level by level."""
    return f"""{name} AS (
    SELECT 0 AS level, g, idx, n, h FROM {leaves}
    UNION ALL
    SELECT level + 1, g, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1
    GROUP BY level, g, idx // 2, n)"""


def _climb(name: str, rows: str, tree: str) -> str:
    """Every row folded with its siblings up to its tree's root, where n is 1."""
    return f"""{name} AS (
    SELECT r, g, idx, n, 0 AS level, f, sibs FROM {rows}
    UNION ALL
    SELECT c.r, c.g, c.idx // 2, (c.n + 1) // 2, c.level + 1,
        sha256(CASE WHEN c.idx % 2 = 0 THEN c.f || coalesce(s.h, '') ELSE coalesce(s.h, '') || c.f END),
        c.sibs || coalesce(s.h, '')
    FROM {name} c LEFT JOIN {tree} s ON s.level = c.level AND s.g = c.g AND s.idx = xor(c.idx, 1) WHERE c.n > 1)"""


ORACLES = {
    "op1_cap_filter_near_dup": """
WITH RECURSIVE v AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, embedding::DOUBLE[] AS e,
        embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
    FROM embeddings),
links AS (
    SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.n <> b.n AND a.good AND b.good AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
    SELECT n AS a, n AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
part AS (SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.n = r.b GROUP BY r.a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n_links, 0)::BIGINT AS n_links, p.component_id, v.vec_id IS NOT DISTINCT FROM p.component_id AS kept
FROM v JOIN part p ON p.a = v.n LEFT JOIN degree d ON d.a = v.n
""",
    "op9_site_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
per_page AS (
    SELECT DISTINCT n, source, trim(line, {BLANKS}) AS line
    FROM (SELECT n, source, unnest(lines) AS line FROM d WHERE source IS NOT NULL)),
often AS (
    SELECT p.source, line FROM per_page p JOIN pages USING (source) WHERE line <> ''
    GROUP BY p.source, line, pages HAVING count(*) >= {MIN_PAGES} AND count(*) > CAST({MAX_RATIO} AS DOUBLE) * pages),
dropped AS (SELECT source, list(line) AS gone FROM often GROUP BY source),
j AS (SELECT d.*, coalesce(gone, []) AS gone FROM d LEFT JOIN dropped USING (source))
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines,
    coalesce(len(list_filter(lines, lambda x: list_contains(gone, trim(x, {BLANKS})))), 0)::BIGINT AS n_dropped,
    CASE WHEN text IS NOT NULL THEN
        coalesce(array_to_string(list_filter(lines, lambda x: NOT list_contains(gone, trim(x, {BLANKS}))), chr(10)), '') END AS text
FROM j
""",
    "op11_piece_table_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hx FROM documents),
u AS (
    SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units, len(units) AS n,
        least({_hex(1)} % (n + 1), {_hex(2)} % (n + 1)) AS a, greatest({_hex(1)} % (n + 1), {_hex(2)} % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_hex(3)} % 100 >= 100
            THEN 'plain' WHEN {_hex(4)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d),
p AS (
    SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid,
        coalesce(array_to_string(units[b + 1:], ''), '') AS suf
    FROM u),
o AS (
    SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out
    FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars, sha256(out) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN out
        WHEN 'psm' THEN split_part(split_part(out, '<S>', 1), '<P>', 2) || split_part(out, '<M>', 2)
            || split_part(split_part(out, '<S>', 2), '<M>', 1)
        ELSE split_part(split_part(out, '<P>', 2), '<M>', 1) || split_part(out, '<M>', 2)
            || split_part(split_part(out, '<P>', 1), '<S>', 2) END) AS restored_sha256
FROM o
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE tab AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
    FROM (SELECT unnest(range(256))::BIGINT AS i)),
d AS (
    SELECT *, doc_id::VARCHAR AS key, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS raised,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda k: ascii(key[k])::BIGINT)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit
    FROM documents, tab),
leaves AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, leaf AS h,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY lang) AS n, CASE WHEN hit THEN raised ELSE leaf END AS f, '' AS sibs
    FROM d),
{_tree("nodes", "leaves")},
tops AS MATERIALIZED (SELECT g AS lang_g, -1 AS g, g AS idx, (SELECT count(DISTINCT g) FROM leaves) AS n, h FROM nodes WHERE n = 1),
{_tree("upper", "tops")},
{_climb("climb", "leaves", "nodes")},
there AS MATERIALIZED (SELECT c.r, -1 AS g, c.g AS idx, t.n, c.f, c.sibs FROM climb c JOIN tops t ON t.lang_g = c.g WHERE c.n = 1),
{_climb("ascent", "there", "upper")},
root AS (SELECT h FROM upper WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, root.h AS root, sha256(a.sibs) AS proof_sha256, a.f AS folded_root, a.f = root.h AS verified
FROM ascent a JOIN leaves l USING (r) JOIN tops t ON t.lang_g = l.g, root WHERE a.n = 1
""",
    "op13_vector_file_top_k": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM p) WHERE rank <= 5
""",
}
