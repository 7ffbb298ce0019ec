"""DuckDB SQL that gives the rows of this folder's queries, where SQL can."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_copies(size: int, least: int) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i + 1 : i + {size}], ' ') AS s FROM d, unnest(range(greatest(1, len(w) - {size - 1}))) AS u(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= {least} * (x.n + y.n - k)),
pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN reach ON reach.a = d.rid JOIN d o ON o.rid = reach.b GROUP BY d.rid, d.doc_id, n.n
"""


OP4 = near_copies(4, 85)

OP6 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM d, unnest(range(len(w) - 49)) AS u(i)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE m < doc_id),
word AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS k FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(x) AS k, array_to_string(x, ' ') AS s FROM (SELECT item_id, w[i + 1 : i + 8] AS x FROM b, unnest(range(greatest(1, len(w) - 7))) AS u(i) WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM d, size, unnest(range(len(w) - k + 1)) AS u(i)),
hit AS (SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, s)),
covered AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
