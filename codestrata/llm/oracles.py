"""DuckDB SQL for the pN_ queries that SQL can express on whole tables."""

_TERMS = r"list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce({0}, ''), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '\p{{L}}+'), lambda x: lower(x)), lambda x: length(x) >= 3)"

P1_FOUND = """
WITH f AS (SELECT DISTINCT file_id, text FROM files WHERE length(text) >= 400),
g AS (SELECT file_id, hash(substring(text, i, 400)) AS h FROM (SELECT file_id, text, unnest(range(1, length(text) - 398)) AS i FROM f)),
k AS (SELECT DISTINCT file_id, h FROM g),
m AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
s AS (SELECT k.* FROM k JOIN m USING (h))
SELECT DISTINCT a.file_id AS file_a, b.file_id AS file_b FROM s a JOIN s b ON a.h = b.h AND a.file_id < b.file_id
"""

P2_FOUND = """
WITH d AS (SELECT DISTINCT repo, sha, path FROM commit_files WHERE repo IS NOT NULL AND sha IS NOT NULL AND path IS NOT NULL),
s AS (SELECT repo, sha FROM d GROUP BY repo, sha HAVING count(*) BETWEEN 2 AND 30),
b AS (SELECT d.* FROM d JOIN s USING (repo, sha)),
n AS (SELECT repo, count(*) AS n FROM s GROUP BY repo),
f AS (SELECT repo, path, count(*) AS k FROM b GROUP BY repo, path),
p AS (SELECT x.repo, x.path AS path_a, y.path AS path_b, count(*) AS n_ab FROM b x JOIN b y ON x.repo = y.repo AND x.sha = y.sha AND x.path < y.path GROUP BY ALL)
SELECT p.repo, path_a, path_b FROM p JOIN n USING (repo) JOIN f fa ON fa.repo = p.repo AND fa.path = path_a JOIN f fb ON fb.repo = p.repo AND fb.path = path_b
WHERE n_ab >= 6 AND n_ab * n >= 3 * fa.k * fb.k
"""

P4_FOUND = (
    "WITH u AS (SELECT 'file' AS record_kind, CAST(file_id AS VARCHAR) AS record_key, symbol AS text FROM (SELECT DISTINCT * FROM symbols)"
    " UNION ALL SELECT 'file', CAST(file_id AS VARCHAR), doc FROM (SELECT DISTINCT * FROM file_facts)"
    " UNION ALL SELECT 'commit', sha, subject FROM (SELECT DISTINCT sha, subject FROM commits)),"
    f" t AS (SELECT record_kind, record_key, unnest({_TERMS.format('text')}) AS term FROM u WHERE record_key IS NOT NULL),"
    " tf AS (SELECT record_kind, record_key, term, count(*) AS tf FROM t GROUP BY ALL),"
    " df AS (SELECT record_kind, term, count(*) AS df FROM tf GROUP BY ALL)"
    " SELECT record_kind, record_key, term FROM tf JOIN df USING (record_kind, term) WHERE df BETWEEN 2 AND 5 AND (record_kind = 'commit' OR tf >= 3)"
)

P1_SHARED = """
WITH f AS (SELECT DISTINCT file_id, path, text FROM files),
g AS (SELECT file_id, i, hash(substring(text, i, 400)) AS h FROM (SELECT file_id, text, unnest(range(1, length(text) - 398)) AS i FROM f WHERE length(text) >= 400)),
m AS (SELECT h FROM g GROUP BY h HAVING min(file_id) <> max(file_id)),
s AS (SELECT file_id, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM g JOIN m USING (h) WINDOW w AS (PARTITION BY file_id ORDER BY i)),
t AS (SELECT file_id, CAST(sum(least(400, coalesce(after - i, 400))) AS BIGINT) AS shared_chars, count(*) FILTER (before IS NULL OR i - before > 400) AS spans FROM s GROUP BY file_id)
SELECT file_id, path, length(text) AS chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(spans, 0) AS spans FROM f LEFT JOIN t USING (file_id)
"""

P2_COUNTS = P2_FOUND.partition("SELECT p.repo, path_a")[0] + (
    "SELECT p.repo, path_a, path_b, n, fa.k AS n_a, fb.k AS n_b, n_ab, round(n_ab * n / (fa.k * fb.k), 6) AS lift FROM p JOIN n USING (repo) JOIN f fa ON fa.repo = p.repo AND fa.path = path_a JOIN f fb ON fb.repo = p.repo AND fb.path = path_b"
)

P4_TERMS = (
    P4_FOUND.partition(" t AS (")[0]
    + f" a AS (SELECT record_kind, record_key, {_TERMS.format('text')} AS ts FROM u WHERE record_key IS NOT NULL), t AS (SELECT record_kind, record_key, unnest(ts) AS term FROM a),"
    " tf AS (SELECT record_kind, record_key, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT record_kind, term, count(*) AS df FROM tf GROUP BY ALL), rc AS (SELECT record_kind, count(DISTINCT record_key) AS records FROM tf GROUP BY ALL),"
    " e0 AS (SELECT row_number() OVER () AS u, record_kind, record_key, ts FROM a), e1 AS (SELECT u, record_kind, record_key, unnest(ts) AS x, unnest(range(1, len(ts) + 1)) AS i FROM e0),"
    " e AS (SELECT DISTINCT p.record_kind, p.record_key, p.x AS term, q.x AS other FROM e1 p JOIN e1 q ON p.u = q.u AND abs(p.i - q.i) BETWEEN 1 AND 3 AND p.x <> q.x), dg AS (SELECT record_kind, record_key, term, count(*) AS neighbours FROM e GROUP BY ALL)"
    " SELECT record_kind, record_key, term, tf, coalesce(neighbours, 0) AS neighbours, df, records, round((1 + coalesce(neighbours, 0)) * ln((records + 1) / df), 6) AS weight FROM tf JOIN df USING (record_kind, term) JOIN rc USING (record_kind) LEFT JOIN dg USING (record_kind, record_key, term)"
)

_LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST) AS rn FROM metrics WHERE file_id IS NOT NULL) WHERE rn = 1"

P7_FOUND = f"""
WITH l AS ({_LATEST}), k AS (SELECT repo, ceil(count(*) / 10.0) AS k FROM l GROUP BY repo),
m AS (SELECT file_id, repo, 1 AS q, CAST(pagerank AS DOUBLE) AS v FROM l UNION ALL SELECT file_id, repo, 2, fan_in FROM l
UNION ALL SELECT file_id, repo, 3, churn_commits FROM l UNION ALL SELECT file_id, repo, 4, loc FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY repo, q ORDER BY v DESC) AS place FROM m WHERE v IS NOT NULL)
SELECT file_id FROM r JOIN k USING (repo) WHERE place <= k GROUP BY file_id HAVING count(*) >= 3
"""

P7_ORDER = f"""
WITH l AS ({_LATEST}), k AS (SELECT repo, count(*) AS n FROM l GROUP BY repo),
m AS (SELECT file_id, repo, 1 AS q, CAST(pagerank AS DOUBLE) AS v FROM l UNION ALL SELECT file_id, repo, 2, fan_in FROM l
UNION ALL SELECT file_id, repo, 3, churn_commits FROM l UNION ALL SELECT file_id, repo, 4, loc FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY repo, q ORDER BY v DESC) - 1 AS above FROM m WHERE v IS NOT NULL),
z AS (SELECT m.file_id, m.repo, list_sort(list(coalesce((n - above) / n, 0.0))) AS v FROM m JOIN k USING (repo) LEFT JOIN r ON r.file_id = m.file_id AND r.q = m.q GROUP BY m.file_id, m.repo)
SELECT file_id, repo, round(v[1], 6) AS p1, round(v[2], 6) AS p2, round(v[3], 6) AS p3, round(v[4], 6) AS p4, row_number() OVER (PARTITION BY repo ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, v[4] DESC, file_id) AS place FROM z
"""

P8_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dw AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)
"""

P9_FOUND = """
WITH d AS (SELECT DISTINCT doc_id, lower(trim(source)) AS source, text FROM documents),
z AS (SELECT source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM d),
s AS (SELECT source, sum(n) AS n FROM z GROUP BY source)
SELECT t.source FROM (SELECT DISTINCT lower(trim(source)) AS source, target_share, max_repeats FROM source_targets) t LEFT JOIN s USING (source)
WHERE coalesce(s.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM z)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_shared": P1_SHARED, "p2_counts": P2_COUNTS, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p4_terms_of_records": P4_TERMS, "p7_found": P7_FOUND, "p7_order": P7_ORDER, "p8_found": P8_FOUND, "p9_found": P9_FOUND}
