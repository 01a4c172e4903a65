"""DuckDB SQL for the queries, over the same parquet tables."""

from __future__ import annotations

from ..operators import sketch
from ..operators.similarity import COEFFICIENTS
from .queries import BASKET_SIZE, CHUNKS, FEW, PARTITIONS, SHARED, SIMILAR, SUPPORT, TRIPLE_SUPPORT, YEAR

REVIEWS = """reviews AS (SELECT o_custkey AS "user", l_partkey AS business, (1 + l_quantity::BIGINT % 5)::DOUBLE AS stars, o_orderdate AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CITIES = """city_stars AS (SELECT n_name AS city, round(avg(1 + l_quantity::BIGINT % 5), 6) AS stars
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"""
BASKETS = "baskets AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT basket) AS n FROM baskets)"
SINGLES = "SELECT item AS items, count(*) AS n FROM baskets GROUP BY item"
PAIRS = "SELECT a.item || ',' || b.item AS items, count(*) AS n FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item < b.item GROUP BY 1"
TRIPLES = "SELECT a.item || ',' || b.item || ',' || c.item AS items, count(*) AS n FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item < b.item JOIN baskets c ON c.basket = a.basket AND b.item < c.item GROUP BY 1"
def _sets(size: int, rows: str = "baskets", more: str = "") -> str:
    """Itemsets of ``size`` items and their counts."""
    names = [f"t{i}" for i in range(size)]
    joins = "".join(f" JOIN {rows} {b} ON {a}.basket = {b}.basket AND {a}.item < {b}.item" for a, b in zip(names, names[1:], strict=False))
    return f"SELECT {more}{" || ',' || ".join(f'{n}.item' for n in names)} AS items, count(*) AS n FROM {rows} t0{joins} GROUP BY ALL"


#: At these supports no set of four is frequent, in no chunk either, and so none larger; sets of four and five are counted to show it.
ALL_SETS = " UNION ALL ".join(_sets(k) for k in range(1, 6))
SON = f"""{BASKETS}, chunks AS (SELECT basket % {CHUNKS} AS chunk, item, basket FROM baskets),
  local AS ({" UNION ALL ".join(_sets(k, "chunks", "t0.chunk, ") for k in range(1, 6))}),
  candidates AS (SELECT DISTINCT items FROM local WHERE n >= {SUPPORT} * (SELECT n FROM n) / {CHUNKS})"""
WORDS = """sets AS (SELECT DISTINCT doc_id AS item, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS token FROM documents),
  words AS (SELECT * FROM sets WHERE token <> ''),
  idx AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx, count(*) OVER () AS m FROM (SELECT DISTINCT token FROM words)),
  arrays AS (SELECT item, list_sort(list(token)) AS tokens FROM words GROUP BY item),
  members AS (SELECT item, min(item) OVER (PARTITION BY tokens) AS head, tokens FROM arrays),
  heads AS (SELECT item, tokens FROM members WHERE item = head)"""
SIGS = f"{WORDS}, sigs AS (SELECT item, " + ", ".join(f"min(({a} * idx + 1) % m) AS h{i}" for i, a in enumerate(COEFFICIENTS)) + " FROM words JOIN idx USING (token) GROUP BY item)"
BANDS = f"{SIGS}, bands AS (" + " UNION ALL ".join(f"SELECT item, {i // 2} AS band, h{i} AS s1, h{i + 1} AS s2 FROM sigs" for i in range(0, 20, 2)) + ")"
CANDIDATES = f"{BANDS}, candidates AS (SELECT DISTINCT x.item AS a, y.item AS b FROM bands x JOIN bands y USING (band, s1, s2) WHERE x.item < y.item AND x.item IN (SELECT item FROM heads) AND y.item IN (SELECT item FROM heads))"
JACCARD = "len(list_intersect(x.tokens, y.tokens))::DOUBLE / (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens)))"
EXACT = f"""hw AS (SELECT item, unnest(tokens) AS token, len(tokens) AS size FROM heads),
  exact AS (SELECT a, b, c::DOUBLE / (sa + sb - c) AS similarity FROM (SELECT x.item AS a, y.item AS b, x.size AS sa, y.size AS sb, count(*) AS c FROM hw x JOIN hw y ON x.token = y.token AND x.item < y.item GROUP BY ALL) WHERE c::DOUBLE / (sa + sb - c) >= {SIMILAR})"""
LSH = f"{CANDIDATES}, lsh AS (SELECT a, b, {JACCARD} AS similarity FROM candidates JOIN heads x ON x.item = a JOIN heads y ON y.item = b WHERE {JACCARD} >= {SIMILAR})"
ALL_LINKS = f"{WORDS}, {EXACT} SELECT a, b, round(similarity, 6) AS similarity FROM exact UNION ALL SELECT head, item, 1 FROM members WHERE item <> head"
RATINGS = f"""{REVIEWS}, ratings AS (SELECT "user", business AS item, avg(stars) AS rating FROM reviews GROUP BY ALL),
  train AS (SELECT * FROM ratings WHERE ("user" * 31 + item) % 10 <> 0), test AS (SELECT * FROM ratings WHERE ("user" * 31 + item) % 10 = 0)"""
COSINES = f"""{RATINGS}, ip AS (SELECT DISTINCT t."user", t.item AS a, r.item AS b, r.rating FROM test t JOIN train r ON r."user" = t."user" AND r.item <> t.item),
  cos AS (SELECT a, b, sum(x.rating * y.rating) / sqrt(sum(x.rating * x.rating) * sum(y.rating * y.rating)) AS sim
    FROM (SELECT DISTINCT a, b FROM ip) JOIN train x ON x.item = a JOIN train y ON y.item = b AND y."user" = x."user" GROUP BY a, b),
  sums AS (SELECT "user", a AS item, sum(rating * sim) AS num, sum(abs(sim)) AS den FROM ip JOIN cos USING (a, b) GROUP BY ALL),
  item_cf AS (SELECT t."user", t.item, CASE WHEN den > 0 THEN num / den ELSE 0 END AS prediction FROM test t LEFT JOIN sums USING ("user", item))"""
USER_CF = """mean AS (SELECT "user", avg(rating) AS mean FROM train GROUP BY ALL),
  centred AS (SELECT t."user", item, rating - mean AS d FROM train t JOIN mean USING ("user")),
  up AS (SELECT t."user", t.item, c."user" AS v, c.d AS dv_item FROM test t JOIN centred c USING (item)),
  common AS (SELECT p."user", p.item, p.v, x.d AS du, y.d AS dv
    FROM up p JOIN centred x ON x."user" = p."user" AND x.item <> p.item JOIN centred y ON y."user" = p.v AND y.item = x.item),
  us AS (SELECT "user", item, v, sum(du * dv) AS num, sqrt(sum(du * du) * sum(dv * dv)) AS den FROM common GROUP BY ALL),
  scored AS (SELECT up.*, CASE WHEN num <> 0 AND den <> 0 THEN num / den ELSE 0 END AS sim FROM up LEFT JOIN us USING ("user", item, v)),
  usums AS (SELECT "user", item, sum(dv_item * sim) AS num, sum(abs(sim)) AS den FROM scored GROUP BY ALL),
  user_cf AS (SELECT t."user", t.item, CASE WHEN den > 0 THEN mean + num / den ELSE 0 END AS prediction FROM test t LEFT JOIN usums USING ("user", item) LEFT JOIN mean USING ("user"))"""
EDGES = f"""up AS (SELECT DISTINCT user_id AS u, (props::JSON->>'$.k')::BIGINT AS g FROM events),
  edges AS (SELECT x.u AS src, y.u AS dst, count(*) AS n FROM up x JOIN up y ON x.g = y.g AND x.u < y.u GROUP BY ALL HAVING count(*) >= {SHARED}),
  links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), vs AS (SELECT DISTINCT src AS id FROM links)"""


def _lpa(rounds: int = 5) -> str:
    parts = [EDGES, "l0 AS (SELECT id, id AS label FROM vs)"]
    for i in range(1, rounds + 1):
        parts.append(f"""l{i} AS (SELECT id, label FROM (SELECT dst AS id, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS r
    FROM links JOIN l{i - 1} ON src = id GROUP BY dst, label) WHERE r = 1)""")
    return ",\n  ".join(parts)


def _betweenness(levels: int = 16) -> str:
    parts = [EDGES, "p0 AS (SELECT id AS s, id AS v, 0 AS d, 1::DOUBLE AS c FROM vs)", "f0 AS (SELECT * FROM p0)"]
    for i in range(1, levels + 1):
        parts.append(f"f{i} AS (SELECT s, dst AS v, {i} AS d, sum(c) AS c FROM f{i - 1} JOIN links ON v = src WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} q WHERE q.s = f{i - 1}.s AND q.v = dst) GROUP BY s, dst)")
        parts.append(f"p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL SELECT * FROM f{i})")
    p = f"p{levels}"
    return ",\n  ".join(parts) + f"""
SELECT e.src, e.dst, round(sum(CASE WHEN a.s IS NULL THEN 0 ELSE a.c * b.c / t.c END), 6) AS betweenness
FROM edges e JOIN {p} a ON a.v = e.src JOIN {p} b ON b.v = e.dst JOIN {p} t ON t.s = a.s AND t.v = b.s AND a.d + 1 + b.d = t.d GROUP BY e.src, e.dst"""


FEATURES = "dims AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS dim FROM embeddings)"
SUMMARIES = f"""{FEATURES}, s AS (SELECT label, dim, count(*) AS n, sum(x) AS sum, sum(x) / count(*) AS centroid,
  sqrt(greatest(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)), 0)) AS std FROM dims GROUP BY ALL)"""
EV = "ev AS (SELECT event_id, ts, user_id, event_type, (props::JSON->>'$.k')::BIGINT AS tag FROM events)"


def _x(m: int) -> str:
    """Digits of the user id as one big integer of bytes, modulo m."""
    return f"list_reduce(list_transform(range(1, len(user_id::VARCHAR) + 1), lambda i: ascii(substr(user_id::VARCHAR, i, 1))::BIGINT), lambda a, x: (a * 256 + x) % {m}, 0::BIGINT)"


def _bloom() -> str:
    hashes = ", ".join(f"({a} * x + {b}) % {sketch.BLOOM_BITS}" for a, b in sketch.BLOOM_HASHES)
    return f"""WITH {EV}, first AS (SELECT user_id, min((ts, event_id)) AS seen FROM ev GROUP BY user_id),
  v AS (SELECT user_id, seen, strftime(seen[1], '%Y-%m-%d') AS batch, {_x(sketch.BLOOM_BITS)} AS x FROM first),
  places AS (SELECT user_id, seen, batch, unnest(list_distinct([{hashes}])) AS bit FROM v),
  bits AS (SELECT bit, min(seen) AS s FROM places GROUP BY bit),
  judged AS (SELECT user_id, batch, min((s < seen)::INTEGER) AS fp FROM places JOIN bits USING (bit) GROUP BY user_id, batch),
  per AS (SELECT batch, sum(fp) AS f, sum(1 - fp) AS t FROM judged GROUP BY batch),
  run AS (SELECT batch, (sum(f) OVER w)::BIGINT AS fp, (sum(t) OVER w)::BIGINT AS tn FROM per WINDOW w AS (ORDER BY batch))
SELECT batch, fp, tn, round(fp / (fp + tn), 6) AS fpr FROM run"""


WINDOWS = f"{EV}, win AS (SELECT *, strftime(date_trunc('day', ts) - to_days(k::INTEGER), '%Y-%m-%d') AS window_start FROM ev, range(3) AS t(k))"


def _fm() -> str:
    maxima = ", ".join(f"max(z(({a} * x + {b}) % {sketch.FM_BITS})) AS z{i}" for i, (a, b) in enumerate(sketch.FM_HASHES))
    for i, (a, b) in enumerate(sketch.FM_HASHES):
        v = f"({a} * x + {b}) % {sketch.FM_BITS}"
        maxima = maxima.replace(f"max(z({v})) AS z{i}", f"max(CASE WHEN {v} = 0 THEN 1 ELSE length(bin({v})) - length(rtrim(bin({v}), '0')) END) AS z{i}")
    means = ", ".join("round_even((" + " + ".join(f"pow(2::DOUBLE, z{i})" for i in range(g, g + 5)) + ") / 5, 0)" for g in range(0, 45, 5))
    return f"""WITH {WINDOWS}, vals AS (SELECT DISTINCT window_start, user_id FROM win), hashed AS (SELECT window_start, {_x(sketch.FM_BITS)} AS x FROM vals),
  per AS (SELECT window_start, {maxima} FROM hashed GROUP BY window_start)
SELECT window_start, list_sort([{means}])[5]::BIGINT AS estimate FROM per"""


DISTINCT = f"WITH {WINDOWS} SELECT window_start, count(DISTINCT user_id) AS n_distinct FROM win GROUP BY window_start"
RESERVOIR = f"{EV}, res AS (SELECT event_id, tag, md5(event_id::VARCHAR || '{sketch.SEED}') AS priority FROM ev WHERE tag IS NOT NULL ORDER BY priority, event_id LIMIT {sketch.RESERVOIR})"

TWEETS = f"""tags AS (
    SELECT event_id::VARCHAR || '-0' AS event_id, (props::JSON->>'$.k') AS tag FROM events WHERE (props::JSON->>'$.k') IS NOT NULL
    UNION ALL SELECT event_id::VARCHAR || '-1', event_type FROM events WHERE event_type IS NOT NULL),
  res AS (SELECT * FROM tags ORDER BY md5(event_id || '{sketch.SEED}'), event_id LIMIT {sketch.RESERVOIR}),
  c AS (SELECT tag, count(*) AS n FROM res GROUP BY tag), r AS (SELECT dense_rank() OVER (ORDER BY n DESC)::INTEGER AS tier, tag, n FROM c)"""

ORACLES = {
    "review_count": f"WITH {REVIEWS} SELECT count(*) AS n_review FROM reviews",
    "reviews_in_year": f"WITH {REVIEWS} SELECT count(*) AS n_review FROM reviews WHERE year(date) = {YEAR}",
    "distinct_users": f'WITH {REVIEWS} SELECT count(DISTINCT "user") AS n_user FROM reviews',
    "distinct_businesses": f"WITH {REVIEWS} SELECT count(DISTINCT business) AS n_business FROM reviews",
    "top10_users": f'WITH {REVIEWS} SELECT "user", count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10',
    "top10_businesses": f"WITH {REVIEWS} SELECT business, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "partition_item_counts": f"WITH {REVIEWS} SELECT business % {PARTITIONS} AS partition, count(*) AS n_items FROM reviews GROUP BY 1",
    "avg_stars_by_city": f"WITH {CITIES} SELECT * FROM city_stars ORDER BY stars DESC, city",
    "top10_cities": f"WITH {CITIES} SELECT * FROM city_stars ORDER BY stars DESC, city LIMIT 10",
    "baskets_case1": f"WITH {BASKETS} SELECT basket, item FROM baskets",
    "baskets_case2": f"WITH {BASKETS} SELECT item AS basket, basket AS item FROM baskets",
    "baskets_min_size": f"WITH {BASKETS} SELECT basket, item FROM baskets WHERE basket IN (SELECT basket FROM baskets GROUP BY basket HAVING count(*) > {BASKET_SIZE})",
    "frequent_singles": f"WITH {BASKETS} SELECT items, n FROM ({SINGLES}) WHERE n >= {SUPPORT} * (SELECT n FROM n)",
    "frequent_pairs": f"WITH {BASKETS} SELECT items, n FROM ({PAIRS}) WHERE n >= {SUPPORT} * (SELECT n FROM n)",
    "frequent_triples": f"WITH {BASKETS} SELECT items, n FROM ({TRIPLES}) WHERE n >= {TRIPLE_SUPPORT} * (SELECT n FROM n)",
    "son_candidates": f"WITH {SON} SELECT items FROM candidates",
    "son_frequent": f"WITH {SON} SELECT items, n FROM ({ALL_SETS}) WHERE n >= {SUPPORT} * (SELECT n FROM n) AND items IN (SELECT items FROM candidates)",
    "fpgrowth_itemsets": f"WITH {BASKETS} SELECT items, n FROM ({ALL_SETS}) WHERE n >= {TRIPLE_SUPPORT} * (SELECT n FROM n)",
    "frequent_itemsets": f"WITH {BASKETS} SELECT items, n FROM ({ALL_SETS}) WHERE n >= {TRIPLE_SUPPORT} * (SELECT n FROM n)",
    "minhash_signatures": f"WITH {SIGS} SELECT * FROM sigs",
    "lsh_bands": f"WITH {BANDS} SELECT * FROM bands",
    "lsh_candidates": f"WITH {CANDIDATES} SELECT * FROM candidates",
    "document_classes": f"WITH {WORDS} SELECT item, head FROM members",
    "jaccard_lsh_pairs": f"WITH {ALL_LINKS}",
    "jaccard_exact_pairs": f"WITH {ALL_LINKS}",
    "lsh_precision_recall": f"WITH {LSH}, {EXACT}, hit AS (SELECT count(*) AS n FROM lsh JOIN exact USING (a, b)) SELECT round(coalesce((SELECT n FROM hit) / nullif((SELECT count(*) FROM lsh), 0), 0), 6) AS precision, round(coalesce((SELECT n FROM hit) / nullif((SELECT count(*) FROM exact), 0), 0), 6) AS recall",
    "user_avg_ratings": f'WITH {RATINGS} SELECT "user", round(avg(rating), 6) AS avg_rating, count(*) AS n FROM train GROUP BY 1',
    "item_avg_ratings": f"WITH {RATINGS} SELECT item, round(avg(rating), 6) AS avg_rating, count(*) AS n FROM train GROUP BY 1",
    "item_cosine_first": f"""WITH {COSINES}, ranked AS (SELECT a, b, x.rating AS ra, y.rating AS rb, row_number() OVER (PARTITION BY a, b ORDER BY x."user") AS r
    FROM (SELECT DISTINCT a, b FROM ip) JOIN train x ON x.item = a JOIN train y ON y.item = b AND y."user" = x."user")
  SELECT a, b, round(sum(ra * rb) / sqrt(sum(ra * ra) * sum(rb * rb)), 6) AS sim FROM ranked WHERE r <= {FEW} GROUP BY a, b""",
    "item_cosine": f"WITH {COSINES} SELECT a, b, round(sim, 6) AS sim FROM cos",
    "user_cf": f'WITH {RATINGS}, {USER_CF} SELECT "user", item, round(prediction, 6) AS prediction FROM user_cf',
    "item_cf": f'WITH {COSINES} SELECT "user", item, round(prediction, 6) AS prediction FROM item_cf',
    "cf_rmse": f"""WITH {COSINES}, {USER_CF} SELECT method, round(sqrt(avg((prediction - rating) * (prediction - rating))), 6) AS rmse, count(*) AS n
FROM (SELECT 'item' AS method, * FROM item_cf UNION ALL SELECT 'user', * FROM user_cf) JOIN test USING ("user", item) GROUP BY method""",
    "co_graph_edges": f"WITH {EDGES} SELECT * FROM edges",
    "co_graph_vertices": f"WITH {EDGES} SELECT * FROM vs",
    "adjacency": f"WITH {EDGES} SELECT src AS id, dst AS neighbour FROM links",
    "lpa_labels": f"WITH {_lpa()} SELECT id, label FROM l5",
    "lpa_communities": f"WITH {_lpa()} SELECT label, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM l5 GROUP BY label",
    "connected_components": f"""WITH RECURSIVE {EDGES}, reach AS (SELECT id, id AS r FROM vs UNION SELECT dst, r FROM reach JOIN links ON id = src)
SELECT id, min(r) AS component FROM reach GROUP BY id""",
    "edge_betweenness": f"WITH {_betweenness()}",
    "edge_betweenness_joins": f"WITH {_betweenness()}",
    "modularity": f"""WITH {_lpa()}, m AS (SELECT count(*) AS m FROM edges),
  placed AS (SELECT a.label AS la, b.label AS lb FROM edges JOIN l5 a ON a.id = src JOIN l5 b ON b.id = dst),
  per AS (SELECT label, sum(inside) AS l, count(*) AS d FROM (SELECT la AS label, CASE WHEN la = lb THEN 0.5 ELSE 0 END AS inside FROM placed UNION ALL SELECT lb, CASE WHEN la = lb THEN 0.5 ELSE 0 END FROM placed) GROUP BY label)
SELECT round(coalesce(sum(l / m - (d / (2 * m)) * (d / (2 * m))), 0)::DOUBLE, 6) AS modularity FROM per, m""",
    "cluster_summaries": f"WITH {SUMMARIES} SELECT label, n, dim, round(sum, 6) AS sum, round(centroid, 6) AS centroid, round(std, 6) AS std FROM s",
    "mahalanobis_assign": f"""WITH {SUMMARIES}, d AS (SELECT id, s.label, count(*) AS dims, sqrt(sum(CASE WHEN std > 0 THEN pow((x - centroid) / std, 2) WHEN x = centroid THEN 0 ELSE 'inf'::DOUBLE END)) AS d
    FROM dims JOIN s USING (dim) GROUP BY id, s.label),
  best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS r FROM d)
SELECT id, CASE WHEN d < 2 * sqrt(dims) THEN label ELSE -1 END::INTEGER AS cluster, CASE WHEN d < 2 * sqrt(dims) THEN round(d, 6) END AS distance FROM best WHERE r = 1""",
    "cluster_merge_candidates": f"""WITH {SUMMARIES}, p AS (SELECT x.label AS a, y.label AS b, count(*) AS dims, sqrt(sum(pow((x.centroid - y.centroid) / x.std, 2))) AS da, sqrt(sum(pow((x.centroid - y.centroid) / y.std, 2))) AS db
    FROM s x JOIN s y ON x.dim = y.dim AND x.label < y.label GROUP BY ALL)
SELECT a, b, round(least(da, db), 6) AS distance FROM p WHERE least(da, db) < 2 * sqrt(dims)""",
    "bloom_fpr": _bloom(),
    "stream_bloom": _bloom(),
    "fm_estimate_windows": _fm(),
    "stream_fm": _fm(),
    "exact_distinct_windows": DISTINCT,
    "stream_window_distinct": DISTINCT,
    "tumbling_counts": f"WITH {EV} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM ev GROUP BY ALL",
    "reservoir_sample": f"WITH {RESERVOIR} SELECT * FROM res",
    "stream_reservoir": f"WITH {RESERVOIR} SELECT * FROM res",
    "hashtag_tiers": f"WITH {TWEETS} SELECT * FROM r WHERE tier <= 3",
    "stream_hashtag_tiers": f"WITH {TWEETS} SELECT * FROM r WHERE tier <= 3",
    "top_tags_tiers": f"WITH {RESERVOIR}, c AS (SELECT tag, count(*) AS n FROM res GROUP BY tag), r AS (SELECT dense_rank() OVER (ORDER BY n DESC)::INTEGER AS tier, tag, n FROM c) SELECT * FROM r WHERE tier <= 3",
}
ORACLES["lsh_item_cf"] = ORACLES["item_cf"]  # no two parts of these tables are similar enough, so every item uses all
