"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '{WORD}'))::BIGINT AS size,
  (('0x'||substr(md5('11:'||coalesce(doc_id::VARCHAR,'')||':'||md5(coalesce(text,''))),1,13))::UBIGINT::DOUBLE + 0.5e0)/4503599627370496e0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
w AS (SELECT *, ([5e0,2e0,1e0])[(place-1)%3+1] AS weight FROM s),
r AS (SELECT *, (sum(source_size) OVER () - (sum(3*source_size) OVER o - 3*source_size))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS unit, row_number() OVER o AS turn
  FROM w WINDOW o AS (ORDER BY source_size/weight, place)),
f AS (SELECT unit FROM r WHERE NOT (3*source_size < unit*weight) ORDER BY turn LIMIT 1),
t AS (SELECT source, source_size, least((3*source_size)::DOUBLE, coalesce(f.unit,0e0)*weight) AS target FROM r LEFT JOIN f ON true),
k AS (SELECT source, length(bin(size))::DOUBLE AS weight, sum(size)::DOUBLE AS words FROM d GROUP BY 1, 2),
l AS (SELECT k.*, target, sum(words) OVER o - words AS heavier, sum(weight*words) OVER (PARTITION BY k.source) - sum(weight*words) OVER o + weight*words AS rest
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY k.source ORDER BY weight DESC)),
x AS (SELECT source, arg_max((target-3*heavier)/rest, weight) AS factor FROM l WHERE rest > 0 AND (target-3*heavier)/rest*weight < 3 GROUP BY source),
e AS (SELECT d.*, source_size, target, CASE WHEN size <= 0 THEN 0e0 WHEN factor IS NULL THEN 3e0 ELSE least(3e0, factor*length(bin(size))::DOUBLE) END AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
p AS (SELECT *, floor(e) AS whole, e-floor(e) AS p, (u/(1e0-u))/((e-floor(e))/(1e0-(e-floor(e)))) AS rank FROM e),
y AS (SELECT *, CASE WHEN p <= 0 OR whole >= 3 THEN 1e0 ELSE least(rank/(1e0+rank), 1e0-1e0/1099511627776e0) END AS y FROM p),
n AS (SELECT *, target - sum(whole*size) OVER (PARTITION BY source) AS need, sum(CASE WHEN y<1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY y, u, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM y)
SELECT doc_id, size, source_size, target, ((whole + (y<1 AND before + size/2e0 <= need)::INT)*size)::BIGINT AS taken, (whole + (y<1 AND before + size/2e0 <= need)::INT)::INT AS copies FROM n"""

OP5 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w)-33)) AS p, w FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p+34], ' ')) AS h FROM p),
r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p+35)) AS pos FROM k WHERE h IN (SELECT h FROM r)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w)+1)) AS pos FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS text, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id=gone.doc_id AND words.pos=gone.pos WHERE gone.pos IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w)-coalesce(n,0))::BIGINT AS n_removed, sha256(coalesce(kept.text,'')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP9 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role='assistant'),0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role='assistant'),'')) AS loss_sha256,
  sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*\|')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

OP10 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w),10) AS n, unnest(range(1, greatest(len(w)-10,0)+2)) AS p, w FROM b WHERE len(w) > 0),
ik AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p+n-1],' ') AS k FROM iw),
dp AS (SELECT doc_id, n, unnest(range(1, len(w)-n+2)) AS p, w FROM d, (SELECT DISTINCT n FROM ik) WHERE len(w) >= n),
hit AS (SELECT doc_id, p, dp.n, item_id FROM dp JOIN ik ON dp.n=ik.n AND array_to_string(w[p:p+dp.n-1],' ')=ik.k),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p,p+n)) AS pos FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items, sha256(coalesce(ids,'')) AS items_sha256, coalesce(n_hit,0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP11 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang,'') AS lang, coalesce(source,'') AS source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
o AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, g.source, k.term, coalesce(c.n,0) AS n, 1 + (1000000000::HUGEINT*(coalesce(c.n,0)+2)) // (coalesce(s.n,0)+2*v.v) AS p, 1 + (1000000000::HUGEINT*(k.n+2)) // (v.n+2*v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p-b.p)*(a.p-b.p)) // (a.p+b.p)) AS value FROM p a JOIN p b ON a.lang=b.lang AND a.term=b.term AND a.source<>b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value,0)::BIGINT AS value FROM g a JOIN g b ON a.lang=b.lang AND a.source<>b.source LEFT JOIN f ON f.lang=a.lang AND f.source=a.source AND f.item=b.source
  UNION ALL SELECT lang, source, 'term', term, (((p-q)*(p-q)) // (p+q))::BIGINT FROM p WHERE n>0 AND p>q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM x QUALIFY part='pair' OR rank <= 10"""


def _nearest(vectors: str, centroids: str) -> str:
    distance = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1]-z[2])*(z[1]-z[2])))::BIGINT"
    return f"(SELECT r, vec_id, e.v, unnest(min(struct_pack(d := {distance}, k := c.k))) FROM {vectors} e, {centroids} c GROUP BY r, vec_id, e.v)"


def _moved(assigned: str, centroids: str) -> str:
    """Floor of the mean of each component; a centroid without vectors stays."""
    cells = f"SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM {assigned}) GROUP BY k, i"
    means = f"SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM ({cells}) GROUP BY k"
    return f"(SELECT c.k, coalesce(m.v, c.v) AS v FROM {centroids} c LEFT JOIN ({means}) m ON m.k = c.k)"


OP12 = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64*x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM e ORDER BY h, v LIMIT 16)),
a1 AS MATERIALIZED {_nearest("e", "c0")}, c1 AS MATERIALIZED {_moved("a1", "c0")},
a2 AS MATERIALIZED {_nearest("e", "c1")}, c2 AS MATERIALIZED {_moved("a2", "c1")},
a3 AS MATERIALIZED {_nearest("e", "c2")}, c3 AS MATERIALIZED {_moved("a3", "c2")},
a4 AS MATERIALIZED {_nearest("e", "c3")}
SELECT vec_id, a4.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a4.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a4 JOIN c3 ON c3.k = a4.k"""
