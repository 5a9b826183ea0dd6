"""The definitions of the results in SQL, where SQL can express them on small tables; written from the definitions, not from the operators."""

from __future__ import annotations


def _plain(x: str) -> str:
    """The runs of letters or digits of a text without letter case and accents, as a list."""
    return f"regexp_extract_all(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'd'))), '[\\p{{L}}\\p{{N}}]+')"


def _grams(relation: str, key: str, n: int) -> str:
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT {key}, {_plain('text')} AS w FROM {relation} WHERE text <> '') WHERE len(w) >= {n}"


#: Documents and items with ten words in a row in common.
LEAKS = f"WITH i AS ({_grams('eval_items', 'item_id', 10)}), d AS ({_grams('documents', 'doc_id', 10)}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"


def _edits(a: str, b: str) -> str:
    row = f"list_reduce(range(1, len({b}) + 1), lambda new, j: list_append(new, least(row[j + 1] + 1, new[j] + 1, row[j] + CASE WHEN {a}[i] = {b}[j] THEN 0 ELSE 1 END)), [i])"
    return f"list_last(list_reduce(range(1, len({a}) + 1), lambda row, i: {row}, range(0, len({b}) + 1)))"


#: Evaluation rows whose words a training row has, or has but for two edits; lines near in that way share one third of their words at its place or two beside it, so those meet first.
OVERLAP = f"""WITH r AS (SELECT DISTINCT row_id, split, {_plain('text')} AS w FROM synth_manifest WHERE text <> ''), e AS (SELECT row_id, w, array_to_string(w, ' ') AS n FROM r WHERE split IN ('validation', 'test') AND len(w) > 0), t AS (SELECT DISTINCT array_to_string(w, ' ') AS n, w FROM r WHERE split = 'train' AND len(w) > 0),
x AS (SELECT DISTINCT n, w FROM e WHERE len(w) >= 8), c AS (SELECT n, w, k, array_to_string(w[len(w) * k // 3 + 1:len(w) * (k + 1) // 3], ' ') AS piece FROM x, range(0, 3) q(k)),
g AS (SELECT DISTINCT n, w, unnest(list_transform(flatten([list_transform(range(1, len(w) - m + 2), lambda i: [i, m]) for m in range(2, 21)]), lambda p: array_to_string(w[p[1]:p[1] + p[2] - 1], ' '))) AS piece FROM t WHERE len(w) >= 8),
m AS (SELECT DISTINCT c.n, c.w AS a, g.w AS b FROM c JOIN g USING (piece) WHERE abs(len(c.w) - len(g.w)) <= 2 AND c.n <> g.n), near AS (SELECT DISTINCT n FROM m WHERE {_edits('a', 'b')} <= 2)
SELECT DISTINCT row_id FROM e WHERE n IN (SELECT n FROM t) OR n IN (SELECT n FROM near)"""

#: Ids as written by connected components: each round takes the smallest label over shared normal ids and shared source files.
GROUPS = r"""WITH RECURSIVE b AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(lower(doc_id), '[^\p{L}\p{N}]', '', 'g'), '^([^0-9]*)0+([0-9])', '\1\2') AS nid, lower(regexp_extract(image_path, '([^/\\]*)$', 1)) AS name FROM synth_manifest WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, nid, regexp_replace(CASE WHEN regexp_matches(name, '^.*?[\s_\-]*p[0-9]+[\s_\-]*line[\s_\-]*[0-9]+.*$') THEN regexp_extract(name, '^(.*?)[\s_\-]*p[0-9]+[\s_\-]*line[\s_\-]*[0-9]+.*$', 1) ELSE regexp_replace(name, '\.[a-z0-9]{1,5}$', '') END, '[^\p{L}\p{N}]+', '', 'g') AS file FROM b),
k AS (SELECT DISTINCT doc_id, 'i' || nid AS key FROM f WHERE nid <> '' UNION SELECT DISTINCT doc_id, 'f' || file FROM f WHERE file <> ''),
e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (key)),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS doc_id, min(b) AS group_id, count(*) AS n FROM r GROUP BY 1) SELECT doc_id, group_id FROM g WHERE n > 1"""
