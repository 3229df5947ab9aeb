"""Relational operators of the recommender as SQL over derived views: (name, Spark text, oracle text or None if both run the same)."""

from __future__ import annotations

from ..plans.views import CATALOG, METRICS, RATINGS, SPLIT, STATS, TOP10

R, RS = f"WITH {RATINGS}", f"WITH {RATINGS}, {SPLIT}"
RST, RSTT = f"{RS}, {STATS}", f"{RS}, {STATS}, {TOP10}"
RSM, C, RC = f"{RSTT}, {METRICS}", f"WITH {CATALOG}", f"WITH {RATINGS}, {CATALOG}"

#: A title's first two words name its franchise
_SERIES = "concat(split_part(title, ' ', 1), ' ', split_part(title, ' ', 2))"
_MEMBERS = f"{RC}, members AS (SELECT item_id, count(*) AS members, avg(rating) AS mean FROM ratings GROUP BY item_id), items AS (SELECT c.*, coalesce(m.members, 0) AS members, m.mean, {_SERIES} AS series FROM catalog c LEFT JOIN members m ON c.item_id = m.item_id)"
_LIKED = "liked AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS k FROM ratings)"

#: Adjusted cosine over the training fold. Ratings are centred by user and divided by the user's deviation (1 at least);
#: a pair is summed once and mirrored; negative similarities are clamped and the best 200 neighbours stay. Work is the sum of
#: the squares of users' numbers of ratings.
_SIM = """training AS (SELECT r.user_id, r.item_id, r.rating FROM ratings r LEFT JOIN split s ON r.user_id = s.user_id AND r.item_id = s.item_id WHERE coalesce(s.fold, 'train') = 'train'),
centred AS (SELECT user_id, item_id, (rating - avg(rating) OVER (PARTITION BY user_id)) / greatest(stddev_pop(rating) OVER (PARTITION BY user_id), 1e0) AS z FROM training),
norms AS (SELECT item_id, sqrt(sum(z * z)) AS norm FROM centred GROUP BY item_id HAVING sqrt(sum(z * z)) > 1e-8),
unit AS (SELECT c.user_id, c.item_id, c.z / n.norm AS z FROM centred c JOIN norms n ON c.item_id = n.item_id),
pairs AS (SELECT a.item_id AS a, b.item_id AS b, round(sum(a.z * b.z), 6) AS score, count(*) AS common FROM unit a JOIN unit b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id),
edges AS (SELECT a AS item_id, b AS neighbor_id, common, score FROM pairs WHERE score > 0 UNION ALL SELECT b, a, common, score FROM pairs WHERE score > 0),
neighbours AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbor_id) AS rank FROM edges) e WHERE rank <= 200)"""

SQL: dict[str, str] = {
    # profiling and gates
    "rating_profile": f"{R} SELECT count(*) AS pairs, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, min(rating) AS low, max(rating) AS high, round(avg(rating), 6) AS mean, count_if(rating >= 8) AS positives, count_if(rating < 1 OR rating > 10) AS invalid FROM ratings",
    "rating_distribution": f"{R} SELECT rating, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (), 6) AS share FROM ratings GROUP BY rating",
    "metadata_profile": f"{C} SELECT count(*) AS row_count, count(DISTINCT item_id) AS ids, count(*) - count(DISTINCT item_id) AS duplicates, count_if(title IS NULL) AS null_titles, min(year) AS first_year, max(year) AS last_year, count(DISTINCT type) AS types, count(DISTINCT title) AS titles FROM catalog",
    "rating_quality_gates": f"{RC} SELECT count(*) > 0 AS has_rows, bool_and(r.rating BETWEEN 1 AND 10) AS in_range, bool_and(r.user_id IS NOT NULL) AS has_user, bool_and(c.item_id IS NOT NULL) AS no_orphans, count(DISTINCT r.user_id) >= 100 AS enough_users, count(*) > 0 AND bool_and(r.rating BETWEEN 1 AND 10) AND bool_and(c.item_id IS NOT NULL) AS passed FROM ratings r LEFT JOIN catalog c ON r.item_id = c.item_id",
    "orphan_split": f"{RC}, part_of AS (SELECT item_id FROM catalog WHERE item_id % 10 <> 3) SELECT count_if(s.item_id IS NULL) AS orphans, count_if(s.item_id IS NOT NULL) AS kept, count(*) AS scanned FROM ratings r LEFT JOIN part_of s ON r.item_id = s.item_id",
    # split (F31-F33, W4 native, A29)
    "class_counts": f"{RS} SELECT class, count(*) AS n, count(DISTINCT user_id) AS users FROM classed GROUP BY class",
    "holdout_sizes": f"{RS} SELECT user_id, n AS positives, count_if(fold = 'train') AS train, count_if(fold = 'validation') AS validation, count_if(fold = 'test') AS test FROM split GROUP BY user_id, n",
    "split_rows": f"{RS} SELECT user_id, item_id, rating, fold FROM split",
    "split_audit": f"{RS} SELECT count(*) AS positives, count_if(fold = 'train') AS train, count_if(fold = 'validation') AS validation, count_if(fold = 'test') AS test, count(DISTINCT user_id) AS users, count(*) = count_if(fold = 'train') + count_if(fold = 'validation') + count_if(fold = 'test') AS adds_up FROM split",
    "activity_segment": f"{RS} SELECT segment, count(*) AS users, round(avg(train), 6) AS mean_train FROM (SELECT user_id, train, CASE WHEN train = 0 THEN 'none' WHEN train <= 4 THEN 'sparse' WHEN train <= 19 THEN 'medium' ELSE 'heavy' END AS segment FROM (SELECT user_id, count_if(fold = 'train') AS train FROM split GROUP BY user_id) a) b GROUP BY segment",
    "stratified_sample": f"{RS} SELECT user_id, segment, k FROM (SELECT user_id, segment, row_number() OVER (PARTITION BY segment ORDER BY md5(concat('7:', CAST(user_id AS STRING))), user_id) AS k FROM (SELECT user_id, CASE WHEN count_if(fold = 'train') <= 4 THEN 'sparse' WHEN count_if(fold = 'train') <= 19 THEN 'medium' ELSE 'heavy' END AS segment FROM split GROUP BY user_id) a) b WHERE k <= 50",
    # statistics
    "item_stats": f"{RST} SELECT item_id, CAST(positives AS BIGINT) AS positives, observed, CAST(total AS BIGINT) AS total FROM stats",
    "bayes_quality": f"{RST}, mu AS (SELECT sum(total) * 1e0 / sum(observed) AS mu FROM stats) SELECT item_id, round(least(greatest((total + 50 * mu) / (observed + 50) / 10, 0e0), 1e0), 6) AS quality FROM stats, mu",
    "user_centering": f"{R} SELECT item_id, count(*) AS n, round(sum(z), 6) AS residual FROM (SELECT item_id, (rating - avg(rating) OVER (PARTITION BY user_id)) / greatest(stddev_pop(rating) OVER (PARTITION BY user_id), 1e0) AS z FROM ratings) c GROUP BY item_id",
    "dense_index": f"{R} SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM ratings) i",
    "popularity_rank": f"{RST} SELECT item_id, pop_rank FROM ranked",
    "popularity_bucket": f"{RST} SELECT item_id, pop_rank, bucket FROM bucketed",
    "normalized_popularity": f"{RST}, peak AS (SELECT max(positives) AS peak FROM stats) SELECT item_id, round(ln(1 + positives) / ln(1 + peak), 6) AS popularity FROM stats, peak",
    "quality_bonus": f"{_MEMBERS} SELECT item_id, round(7e-1 * (members * coalesce(mean, 0e0) + 50 * 55e-1) / (members + 50) / 10 + 18e-2 * ln(1 + members) / ln(1 + max(members) OVER ()) + 12e-2 * (1 - (row_number() OVER (ORDER BY members DESC, item_id) - 1) * 1e0 / count(*) OVER ()), 6) AS bonus FROM items",
    "novelty_score": f"{_MEMBERS}, t AS (SELECT sum(members) + count(*) AS total, max(members) AS peak FROM items) SELECT item_id, round(-log2((members + 1) * 1e0 / total), 6) AS novelty, round(1 - ln(1 + members) / ln(1 + peak), 6) AS less_famous FROM items, t",
    # catalogue queries
    "catalog_facets": f"{C} SELECT type, count(*) AS n, count(DISTINCT studio) AS studios, min(year) AS first_year, max(year) AS last_year, min_by(item_id, item_id) AS cover FROM catalog GROUP BY type",
    "catalog_order": f"{_MEMBERS} SELECT item_id, row_number() OVER (ORDER BY mean IS NULL, mean DESC, score DESC, members DESC, item_id) AS place FROM items",
    "field_rank": f"{_MEMBERS} SELECT item_id, title, score, place FROM (SELECT item_id, title, score, row_number() OVER (ORDER BY score IS NULL, score DESC, lower(title), item_id) AS place FROM items) x WHERE place <= 100",
    "search_page": f"{_MEMBERS} SELECT item_id, title, total FROM (SELECT item_id, title, row_number() OVER (ORDER BY members DESC, item_id) AS k, count(*) OVER () AS total FROM items WHERE lower(title) LIKE '%a%') x WHERE k BETWEEN 21 AND 40",
    "prefix_search": f"{_MEMBERS} SELECT item_id, title, k FROM (SELECT item_id, title, row_number() OVER (ORDER BY CASE WHEN lower(title) LIKE 's%' THEN 0 ELSE 1 END, members DESC, item_id) AS k FROM items WHERE lower(title) LIKE '%s%') x WHERE k <= 50",
    "hard_filter": f"{C} SELECT item_id, title, studio, year FROM catalog WHERE score >= 5 AND year BETWEEN 1980 AND 2010 AND episodes <= 26 AND studio IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23') AND lower(title) NOT LIKE '%black%'",
    "exclude_series": f"{_MEMBERS} SELECT item_id, title FROM items WHERE series NOT IN (SELECT series FROM items WHERE item_id % 50 = 7)",
    "series_collapse": f"{_MEMBERS} SELECT item_id, series FROM (SELECT item_id, series, row_number() OVER (PARTITION BY series ORDER BY members DESC, item_id) AS k FROM items) x WHERE k = 1",
    "series_cap2": f"{_MEMBERS} SELECT item_id, series, k FROM (SELECT item_id, series, row_number() OVER (PARTITION BY series ORDER BY members DESC, item_id) AS k FROM items) x WHERE k <= 2",
    "franchise_bridge": f"{_MEMBERS} SELECT series, studio, count(*) AS n FROM items GROUP BY series, studio HAVING count(*) >= 2",
    "metadata_refresh": f"{C}, fresh AS (SELECT item_id + 20 AS item_id, CASE WHEN item_id % 4 = 0 THEN '' ELSE concat(title, ' new') END AS title FROM catalog) SELECT coalesce(c.item_id, f.item_id) AS item_id, coalesce(nullif(f.title, ''), c.title) AS title, c.item_id IS NULL AS cold_start FROM catalog c FULL OUTER JOIN fresh f ON c.item_id = f.item_id",
    "train_only_items": f"{RS}, {STATS}, {CATALOG} SELECT c.item_id, c.title, CAST(coalesce(s.positives, 0) AS BIGINT) AS members, coalesce(round(s.total * 1e0 / s.observed, 6), 0e0) AS score, coalesce(s.pop_rank, -1) AS pop_rank FROM catalog c LEFT JOIN ranked s ON c.item_id = s.item_id",
    # vectors and neighbours
    "item_item_cosine_topk": f"{RS}, {_SIM} SELECT item_id, neighbor_id, common, score, rank FROM neighbours",
    "neighbour_vote": f"""{RS}, {_SIM},
        votes AS (SELECT s.user_id, n.neighbor_id AS item_id, sum(CAST(round(n.score * 1000000) AS BIGINT)) / 1e6 AS vote FROM split s JOIN neighbours n ON s.item_id = n.item_id WHERE s.fold = 'train' GROUP BY s.user_id, n.neighbor_id),
        placed AS (SELECT v.user_id, v.item_id, v.vote, row_number() OVER (PARTITION BY v.user_id ORDER BY v.vote DESC, v.item_id) AS rank FROM votes v LEFT JOIN training k ON v.user_id = k.user_id AND v.item_id = k.item_id WHERE k.item_id IS NULL)
        SELECT user_id, item_id, vote, rank FROM placed WHERE rank <= 10""",
    # candidates
    "candidate_union_max": f"{RSTT}, {_LIKED}, two AS (SELECT user_id, item_id, (11 - rank) / 10e0 AS score, 'popular' AS source FROM top UNION ALL SELECT user_id, item_id, (6 - k) / 5e0 AS score, 'liked' AS source FROM liked WHERE k <= 5) SELECT user_id, item_id, max(score) AS score, count(DISTINCT source) AS sources FROM two GROUP BY user_id, item_id",
    "interleave_union": f"{RSTT}, {_LIKED}, two AS (SELECT user_id, item_id, rank AS k, 1 AS source FROM top UNION ALL SELECT user_id, item_id, k, 2 AS source FROM liked WHERE k <= 10), once AS (SELECT user_id, item_id, min(2 * k + source) AS place FROM two GROUP BY user_id, item_id) SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM once",
    "budget_union": f"{RSTT}, {_LIKED}, two AS (SELECT user_id, item_id, rank AS place FROM top UNION ALL SELECT user_id, item_id, 10 + k AS place FROM liked WHERE k <= 10), once AS (SELECT user_id, item_id, min(place) AS place FROM two GROUP BY user_id, item_id) SELECT user_id, item_id, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM once) x WHERE rank <= 12",
    "window_paging": f"{_MEMBERS} SELECT item_id, page, row_number() OVER (PARTITION BY page ORDER BY score DESC, item_id) AS in_page FROM (SELECT item_id, score, CAST(floor((row_number() OVER (ORDER BY members DESC, item_id) - 1) / 300) AS BIGINT) AS page FROM items) x WHERE page < 4",
    "rerank_zscore": f"{R} SELECT user_id, item_id, round((rating - avg(rating) OVER w) / CASE WHEN stddev_pop(rating) OVER w = 0 THEN 1e0 ELSE stddev_pop(rating) OVER w END, 6) AS z, round(1e0 / row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id), 6) AS reciprocal FROM ratings WINDOW w AS (PARTITION BY user_id)",
    "set_differences": f"{RC} SELECT 'rated only' AS part, count(*) AS n FROM (SELECT item_id FROM ratings EXCEPT SELECT item_id FROM catalog WHERE item_id % 2 = 0) a UNION ALL SELECT 'both', count(*) FROM (SELECT item_id FROM ratings INTERSECT SELECT item_id FROM catalog WHERE item_id % 2 = 0) b",
    # evaluation
    "popular_top10": f"{RSTT} SELECT user_id, item_id, rank FROM top",
    "metrics_by_segment": f"{RSM}, seg AS (SELECT user_id, CASE WHEN count_if(fold = 'train') <= 4 THEN 'sparse' WHEN count_if(fold = 'train') <= 19 THEN 'medium' ELSE 'heavy' END AS segment FROM split GROUP BY user_id), every AS (SELECT 'sparse' AS segment UNION ALL SELECT 'medium' UNION ALL SELECT 'heavy'), placed AS (SELECT s.segment, m.* FROM metrics m JOIN seg s ON m.user_id = s.user_id) SELECT g.segment, count(p.user_id) AS users, round(coalesce(avg(ndcg10), 0e0), 6) AS ndcg10, round(coalesce(avg(recall10), 0e0), 6) AS recall10, round(coalesce(avg(hit10), 0e0), 6) AS hit10, round(coalesce(avg(mrr10), 0e0), 6) AS mrr10 FROM every g LEFT JOIN placed p ON g.segment = p.segment GROUP BY g.segment",
    "metrics_by_bucket": f"{RSTT} SELECT b.bucket, count(*) AS relevant, count(t.item_id) AS found, round(count(t.item_id) * 1e0 / count(*), 6) AS recall10 FROM split s JOIN bucketed b ON s.item_id = b.item_id LEFT JOIN top t ON t.user_id = s.user_id AND t.item_id = s.item_id WHERE s.fold = 'test' GROUP BY b.bucket",
    "coverage_novelty": f"{RSTT}, n AS (SELECT count(DISTINCT item_id) AS n, sum(positives) AS total FROM stats) SELECT round(count(DISTINCT t.item_id) * 1e0 / max(n.n), 6) AS coverage, round(avg(-log2((s.positives + 1) * 1e0 / (n.total + n.n))), 6) AS novelty FROM top t JOIN stats s ON t.item_id = s.item_id, n",
    "exposure_by_bucket": f"{RSTT} SELECT b.bucket, count(*) AS shown, round(count(*) * 1e0 / sum(count(*)) OVER (), 6) AS share FROM top t JOIN bucketed b ON t.item_id = b.item_id GROUP BY b.bucket",
    "popularity_bias": f"{RSTT}, p AS (SELECT k.user_id, avg(ln(1 + s.positives)) AS profile FROM known k JOIN stats s ON k.item_id = s.item_id GROUP BY k.user_id), q AS (SELECT t.user_id, avg(ln(1 + s.positives)) AS shown FROM top t JOIN stats s ON t.item_id = s.item_id GROUP BY t.user_id) SELECT round(avg(q.shown), 6) AS shown, round(avg(p.profile), 6) AS profile, round(avg(q.shown - p.profile), 6) AS bias FROM q JOIN p ON q.user_id = p.user_id",
    "exposure_gini": f"{RSTT}, x AS (SELECT s.item_id, count(t.user_id) AS n FROM stats s LEFT JOIN top t ON s.item_id = t.item_id GROUP BY s.item_id), y AS (SELECT n, row_number() OVER (ORDER BY n, item_id) AS i, count(*) OVER () AS m FROM x) SELECT count(*) AS items, CAST(sum(n) AS BIGINT) AS shown, round(sum((2 * i - m - 1) * n) * 1e0 / (max(m) * sum(n)), 6) AS gini FROM y",
    "concentration_shares": f"{RST}, y AS (SELECT positives, row_number() OVER (ORDER BY positives DESC, item_id) AS i, count(*) OVER () AS m FROM stats) SELECT round(sum(CASE WHEN i <= ceil(m * 1e-2) THEN positives ELSE 0 END) * 1e0 / sum(positives), 6) AS top1, round(sum(CASE WHEN i <= ceil(m * 5e-2) THEN positives ELSE 0 END) * 1e0 / sum(positives), 6) AS top5, round(sum(CASE WHEN i <= ceil(m * 1e-1) THEN positives ELSE 0 END) * 1e0 / sum(positives), 6) AS top10, round(sum(CASE WHEN i <= ceil(m * 2e-1) THEN positives ELSE 0 END) * 1e0 / sum(positives), 6) AS top20 FROM y",
    "candidate_recall": f"{RSTT} SELECT d.depth, count(*) AS relevant, count_if(b.pop_rank <= d.depth) AS found, round(count_if(b.pop_rank <= d.depth) * 1e0 / count(*), 6) AS recall FROM split s JOIN ranked b ON s.item_id = b.item_id, (SELECT 100 AS depth UNION ALL SELECT 300 UNION ALL SELECT 500 UNION ALL SELECT 1000) d WHERE s.fold = 'test' GROUP BY d.depth",
    "intra_list_diversity": f"{RSTT}, {CATALOG}, c AS (SELECT t.user_id, t.rank, k.studio, k.type FROM top t JOIN catalog k ON t.item_id = k.item_id) SELECT user_id, round(avg(d), 6) AS diversity FROM (SELECT a.user_id, 1 - (CASE WHEN a.studio = b.studio THEN 1 ELSE 0 END + CASE WHEN a.type = b.type THEN 1 ELSE 0 END) * 1e0 / (4 - CASE WHEN a.studio = b.studio THEN 1 ELSE 0 END - CASE WHEN a.type = b.type THEN 1 ELSE 0 END) AS d FROM c a JOIN c b ON a.user_id = b.user_id AND a.rank < b.rank) p GROUP BY user_id",
    # rating scale, cross-tabs, percentiles
    "status_crosstab": "SELECT o_orderstatus AS status, count_if(q < 10) AS low, count_if(q >= 10 AND q < 30) AS mid, count_if(q >= 30) AS high, count(*) AS n FROM (SELECT o_orderstatus, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY o_orderstatus",
    "rating_scale_stats": f"{R}, u AS (SELECT user_id, count(*) AS n, avg(rating) AS mean, stddev_pop(rating) AS sd, avg(CASE WHEN rating >= 8 THEN 1e0 ELSE 0e0 END) AS high FROM ratings GROUP BY user_id) SELECT count(*) AS users, round(avg(mean), 6) AS mean, round(avg(sd), 6) AS sd, round(avg(high), 6) AS high, round(percentile_cont(5e-1) WITHIN GROUP (ORDER BY mean), 6) AS median_mean FROM u",
    "percentiles": "SELECT event_type, round(percentile_cont(5e-1) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(95e-2) WITHIN GROUP (ORDER BY value), 6) AS p95, count(*) AS n FROM events GROUP BY event_type",
    "jaccard_affinity": f"{R}, p AS (SELECT user_id, item_id FROM ratings WHERE rating = 10), n AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id) SELECT a.user_id, b.user_id AS other, count(*) AS common, round(count(*) * 1e0 / (max(x.n) + max(y.n) - count(*)), 6) AS jaccard FROM p a JOIN p b ON a.item_id = b.item_id AND a.user_id < b.user_id JOIN n x ON x.user_id = a.user_id JOIN n y ON y.user_id = b.user_id GROUP BY a.user_id, b.user_id HAVING count(*) >= 2",
    # state over events (T1 approximate, T8, C1)
    "latest_event": "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1",
    "session_windows": "SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT user_id, value, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS is_new FROM events) a) b GROUP BY user_id, session",
    "rate_limit_tumbling": "SELECT user_id, minute, n, n > 3 AS limited FROM (SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY user_id, date_trunc('minute', ts)) x",
    "rollup_events": "SELECT event_type, month, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT event_type, date_trunc('month', ts) AS month, value FROM events) x GROUP BY ROLLUP (event_type, month)",
    "request_truncation": f"{R} SELECT user_id, count_if(k <= 20) AS kept, count_if(k > 20) AS dropped FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS k FROM ratings) x GROUP BY user_id",
    "history_counters": f"{RC} SELECT r.user_id, c.studio, count(*) AS n FROM ratings r JOIN catalog c ON r.item_id = c.item_id WHERE r.rating >= 8 GROUP BY r.user_id, c.studio",
    "user_preferences": f"{RC}, f AS (SELECT r.user_id, 'studio' AS field, c.studio AS token, ln(1 + count(*)) AS w FROM ratings r JOIN catalog c ON r.item_id = c.item_id WHERE r.rating >= 8 GROUP BY r.user_id, c.studio UNION ALL SELECT r.user_id, 'type', c.type, ln(1 + count(*)) FROM ratings r JOIN catalog c ON r.item_id = c.item_id WHERE r.rating >= 8 GROUP BY r.user_id, c.type) SELECT user_id, field, token, round(w / sum(w) OVER (PARTITION BY user_id, field) / 2, 6) AS weight FROM f",
    "constraint_satisfaction": f"{RSTT}, {CATALOG} SELECT round(avg(CASE WHEN c.score >= 5 THEN 1e0 ELSE 0e0 END), 6) AS score_ok, round(avg(CASE WHEN c.year >= 1980 THEN 1e0 ELSE 0e0 END), 6) AS year_ok, count(*) AS n FROM top t JOIN catalog c ON t.item_id = c.item_id",
}
