"""The same results in DuckDB SQL, for the operators that SQL can express."""

from .secrets import BASE, RULES

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: doc_id, w: the words of each document.
WORDS = rf"SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents"
#: doc_id, g: the distinct five-word shingles of each document.
SHINGLES = """SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM words"""

OP9 = f"""WITH RECURSIVE words AS ({WORDS}), sets AS ({SHINGLES}),
posted AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM posted a JOIN posted b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc_id AS node, doc_id AS c FROM sets UNION SELECT r.node, e.b FROM reached r JOIN edges e ON r.c = e.a),
lowest AS (SELECT node, min(c) AS component_id FROM reached GROUP BY node)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest ON node = doc_id"""


_CUT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP2 = f"""WITH items AS (SELECT item_id, {_CUT} AS w FROM benchmark),
  docs AS (SELECT doc_id, {_CUT} AS w FROM documents),
  item_sets AS (SELECT item_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM items),
  doc_sets AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM docs),
  a AS (SELECT item_id, len(g) AS n_item, unnest(g) AS g FROM item_sets), b AS (SELECT doc_id, unnest(g) AS g FROM doc_sets)
  SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_item::BIGINT AS n_item, count(*)::DOUBLE / n_item AS containment
  FROM a JOIN b USING (g) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= 75 * n_item"""


#: Forty hexadecimal digits are eight groups of twenty bits, each four letters.
_BASE32 = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), 'string_agg', '')"""
OP4 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, h, sha1(h) AS hex FROM p),
  r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS lead FROM s)
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to FROM r"""


def _op8() -> str:
    """Matches and the pieces between them give the offsets."""
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""SELECT rid, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m,
            regexp_extract_all(t, '{pattern}', {r.group}) AS g, regexp_split_to_array(t, '{pattern}') AS p, {r.least} AS least
          FROM texts WHERE regexp_matches(t, '{pattern}')""")
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    matched AS ({" UNION ALL ".join(parts)}),
    placed AS (SELECT rid, k, kind, m[i] AS hit, g[i] AS checked, least,
        list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matched)),
    spans AS (SELECT *, concat(kind, ':', start::BIGINT, ':', (start + length(hit))::BIGINT) AS s FROM placed WHERE length(checked) >= least),
    summed AS (SELECT rid, {counts}, sha256(coalesce(string_agg(s, ',' ORDER BY start, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
        string_agg(s, ',' ORDER BY start, k) AS spans FROM spans GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)},
      coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN summed USING (rid)"""


OP8 = _op8()

OP5 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
  reached AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT r.node, p.b FROM reached r JOIN pairs p ON r.c = p.a),
  lowest AS (SELECT node, min(c) AS component_id FROM reached GROUP BY node),
  counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
  FROM embeddings JOIN lowest ON node = vec_id LEFT JOIN counted ON a = vec_id"""
