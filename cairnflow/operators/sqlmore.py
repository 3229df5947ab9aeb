"""More relational operators: filters by people and family, catalogue builds, features, candidate models, requests, sessions.

Texts run on Spark and, by registry.DIALECT's few replacements, on the oracle. Joins have equality keys; sides without one hold a
fixed number of rows. People are suppliers, who belong to the items that they supply."""

from __future__ import annotations

from ..plans.views import CATALOG, METRICS, QUALITY10, RATINGS, SPLIT, STATS, TOP10, metrics

R, C, RC = f"WITH {RATINGS}", f"WITH {CATALOG}", f"WITH {RATINGS}, {CATALOG}"
RS, RST, RSTT = f"WITH {RATINGS}, {SPLIT}", f"WITH {RATINGS}, {SPLIT}, {STATS}", f"WITH {RATINGS}, {SPLIT}, {STATS}, {TOP10}"
_CAST = "people AS (SELECT DISTINCT l_partkey AS item_id, l_suppkey AS person_id FROM lineitem)"
_SERIES = "concat(split_part(title, ' ', 1), ' ', split_part(title, ' ', 2))"
_FEATURES = """feats AS (SELECT item_id, concat('studio:', lower(studio)) AS feature, 8e0 AS w FROM catalog UNION ALL SELECT item_id, concat('type:', replace(lower(type), ' ', '-')), 7e0 FROM catalog
UNION ALL SELECT item_id, concat('decade:', CAST(year - year % 10 AS STRING), 's'), 3e0 FROM catalog UNION ALL SELECT item_id, concat('word:', split_part(lower(title), ' ', 1)), 2e0 FROM catalog)"""
#: of each user's positives by studio and by type, as shares
_TASTE = """likes AS (SELECT k.user_id, c.studio, c.type FROM known k JOIN ratings r ON k.user_id = r.user_id AND k.item_id = r.item_id AND r.rating >= 8 JOIN catalog c ON k.item_id = c.item_id),
total AS (SELECT user_id, count(*) AS n FROM likes GROUP BY user_id),
by_studio AS (SELECT user_id, studio, count(*) AS n FROM likes GROUP BY user_id, studio), by_type AS (SELECT user_id, type, count(*) AS n FROM likes GROUP BY user_id, type),
quality AS (SELECT s.item_id, (s.total + 50 * m.mu) / (s.observed + 50) / 10 AS q, ln(1 + s.positives) / ln(1 + m.peak) AS pop, s.positives FROM stats s, (SELECT sum(total) * 1e0 / sum(observed) AS mu, max(positives) AS peak FROM stats) m),
signals AS (SELECT t.user_id, t.item_id, t.rank, c.studio AS studio_name, coalesce(bs.n, 0) * 1e0 / u.n AS studio, coalesce(bt.n, 0) * 1e0 / u.n AS type, q.q, q.pop FROM top t JOIN catalog c ON t.item_id = c.item_id JOIN quality q ON t.item_id = q.item_id
  JOIN total u ON t.user_id = u.user_id LEFT JOIN by_studio bs ON bs.user_id = t.user_id AND bs.studio = c.studio LEFT JOIN by_type bt ON bt.user_id = t.user_id AND bt.type = c.type)"""
_TURNS = "turns AS (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS t FROM conversations)"
_SEGMENT = "seg AS (SELECT user_id, CASE WHEN count_if(fold = 'train') <= 4 THEN 'sparse' WHEN count_if(fold = 'train') <= 19 THEN 'medium' ELSE 'heavy' END AS segment FROM split GROUP BY user_id)"

SQL: dict[str, str] = {
    # scalars over columns
    "score_distribution": f"{R} SELECT item_id, " + ", ".join(f"count_if(rating = {i}) AS r{i}" for i in range(1, 11)) + " FROM ratings GROUP BY item_id",
    "rating_weights": f"{R} SELECT user_id, item_id, (rating - 7) / 3e0 AS linear, round(sqrt(rating - 7e0), 6) AS root, round(ln(rating - 6e0), 6) AS logarithmic FROM ratings WHERE rating >= 8",
    "rank_score": f"{R} SELECT user_id, item_id, round((n - k) * 1e0 / n, 6) AS score FROM (SELECT item_id, rating, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS k FROM ratings) x",
    "feature_tokens": f"{C} SELECT item_id, concat('decade:', CAST(year - year % 10 AS STRING), 's') AS decade, replace(lower(type), ' ', '-') AS type_slug, CASE WHEN length(title) > 20 THEN concat(rtrim(substr(title, 1, 17)), '...') ELSE title END AS short, least(greatest(coalesce(score / 10, 0e0), 0e0), 1e0) AS positive FROM catalog",
    "truncated_texts": "SELECT doc_id, CASE WHEN length(text) > 220 THEN concat(rtrim(substr(text, 1, 217)), '...') ELSE text END AS short FROM documents",
    # filters (P3-P5, P7-P13)
    "required_people": f"WITH {_CAST}, {CATALOG}, req AS (SELECT s_suppkey AS person_id FROM supplier WHERE s_suppkey <= 2) SELECT c.item_id, c.title FROM catalog c JOIN (SELECT p.item_id FROM people p JOIN req q ON p.person_id = q.person_id GROUP BY p.item_id HAVING count(*) = (SELECT count(*) FROM req)) x ON c.item_id = x.item_id",
    "family_filter": f"{C}, items AS (SELECT item_id, title, {_SERIES} AS series FROM catalog) SELECT item_id, series FROM items WHERE series IN (SELECT series FROM items WHERE item_id % 97 = 1) AND series NOT IN (SELECT series FROM items WHERE item_id % 89 = 2)",
    "title_exclusion": f"{C}, q AS (SELECT DISTINCT lower(title) AS wanted FROM catalog WHERE item_id % 200 = 5 UNION ALL SELECT 'no such title' AS wanted) SELECT q.wanted, count(c.item_id) AS excluded, count(c.item_id) = 0 AS missed FROM q LEFT JOIN catalog c ON lower(c.title) = q.wanted GROUP BY q.wanted",
    "eligibility_recheck": f"{RSTT}, {CATALOG} SELECT t.user_id, count(*) AS shown, count_if(c.score >= 5 AND c.year >= 1960) AS eligible FROM top t LEFT JOIN catalog c ON t.item_id = c.item_id GROUP BY t.user_id",
    "public_projection": f"WITH {_CAST}, {CATALOG}, cut AS (SELECT item_id, person_id, row_number() OVER (PARTITION BY item_id ORDER BY person_id) AS k FROM people) SELECT c.item_id, c.title, c.studio, max(CASE WHEN k = 1 THEN person_id END) AS person1, max(CASE WHEN k = 2 THEN person_id END) AS person2, max(CASE WHEN k = 3 THEN person_id END) AS person3, max(CASE WHEN k = 4 THEN person_id END) AS person4 FROM catalog c LEFT JOIN (SELECT * FROM cut WHERE k <= 4) p ON c.item_id = p.item_id GROUP BY c.item_id, c.title, c.studio",
    "serving_projection": f"{C} SELECT item_id, nullif(trim(title), '') AS title, nullif(studio, '') AS studio, nullif(episodes, 0) AS episodes FROM catalog",
    "path_routing": f"WITH {_TURNS} SELECT conv_id, turn, CASE WHEN regexp_like(t, '(only|without|except|before|after|at least|(19|20)[0-9][0-9])') THEN 'constraint_rich' ELSE 'fast' END AS path FROM turns WHERE role = 'user'",
    "collaborative_routing": f"{RS} SELECT c.c_custkey AS user_id, CASE WHEN coalesce(p.n, 0) = 0 THEN 'none' WHEN p.n < 5 THEN 'sparse_fallback' ELSE 'als' END AS route FROM customer c LEFT JOIN (SELECT user_id, count(*) AS n FROM split WHERE fold = 'train' GROUP BY user_id) p ON c.c_custkey = p.user_id",
    # joins (J1-J5, J7, J14, J15)
    "catalog_build": f"WITH {_CAST}, {CATALOG} SELECT c.item_id, c.title, count(DISTINCT p.person_id) AS people, count(DISTINCT n.n_nationkey) AS nations, count(DISTINCT r.r_regionkey) AS regions, min(n.n_name) AS first_nation FROM catalog c LEFT JOIN people p ON c.item_id = p.item_id LEFT JOIN supplier s ON p.person_id = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY c.item_id, c.title",
    "entity_lookup": f"WITH {_CAST} SELECT p.item_id, n.n_name AS name, count(*) AS n FROM people p JOIN supplier s ON p.person_id = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE lower(n.n_name) NOT IN ('unknown', 'none', '') GROUP BY p.item_id, n.n_name",
    "archive_enrich": f"{C}, legacy AS (SELECT item_id, score + 1 AS score, episodes * 2 AS members FROM catalog WHERE item_id % 3 = 0) SELECT a.item_id, coalesce(l.score, a.score) AS score, greatest(a.episodes, coalesce(l.members, 0)) AS members, l.item_id IS NOT NULL AS matched FROM catalog a LEFT JOIN legacy l ON a.item_id = l.item_id",
    "legacy_append": f"{C}, archive AS (SELECT item_id, title FROM catalog WHERE item_id % 3 <> 0) SELECT item_id, title, 'archive' AS origin FROM archive UNION ALL SELECT c.item_id, c.title, 'legacy' FROM catalog c LEFT JOIN archive a ON c.item_id = a.item_id WHERE a.item_id IS NULL",
    "synopsis_coverage": f"{C} SELECT count(c.item_id) AS items, count_if(c.item_id IS NOT NULL AND d.doc_id IS NOT NULL) AS covered, count_if(c.item_id IS NULL) AS orphans, round(count_if(c.item_id IS NOT NULL AND d.doc_id IS NOT NULL) * 1e0 / count(c.item_id), 6) AS share FROM catalog c FULL OUTER JOIN documents d ON c.item_id = d.doc_id",
    "key_alignment": f"{RST}, {CATALOG} SELECT c.item_id, CAST(coalesce(s.positives, 0) AS BIGINT) AS positives FROM catalog c LEFT JOIN stats s ON c.item_id = s.item_id",
    "negative_pairs": f"{RS}, neg AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat('n:', CAST(user_id AS STRING), ':', CAST(item_id AS STRING))), item_id) AS k FROM classed WHERE class <> 'positive') SELECT s.user_id, s.item_id AS positive_id, n.item_id AS negative_id FROM split s JOIN neg n ON s.user_id = n.user_id AND n.k <= 8 WHERE s.fold = 'test'",
    "people_overlap": f"{RSTT}, {_CAST}, liked AS (SELECT DISTINCT s.user_id, p.person_id FROM split s JOIN people p ON s.item_id = p.item_id WHERE s.fold = 'validation') SELECT t.user_id, t.item_id, count(*) AS shared FROM top t JOIN people p ON t.item_id = p.item_id JOIN liked l ON l.user_id = t.user_id AND l.person_id = p.person_id GROUP BY t.user_id, t.item_id",
    # features and indexes
    "feature_vectors": f"{C}, {_FEATURES} SELECT item_id, feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS w FROM feats",
    "common_features": f"{C}, {_FEATURES} SELECT feature, w, place FROM (SELECT feature, sum(w) AS w, row_number() OVER (ORDER BY sum(w) DESC, feature) AS place FROM feats GROUP BY feature) x WHERE place <= 384",
    "entity_index": "WITH e AS (SELECT 'person' AS kind, lower(replace(s_name, '#', ' ')) AS key, CAST(s_suppkey AS BIGINT) AS id FROM supplier UNION ALL SELECT 'place', lower(n_name), CAST(n_nationkey AS BIGINT) FROM nation UNION ALL SELECT 'place', lower(r_name), NULL FROM region UNION ALL SELECT 'studio', lower(p_brand), NULL FROM part) SELECT kind, key, count(*) AS mentions, count(DISTINCT id) AS ids, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM e GROUP BY kind, key",
    "people_index": f"WITH {_CAST} SELECT p.person_id, lower(replace(s.s_name, '#', ' ')) AS name, count(DISTINCT p.item_id) AS items, min(p.item_id) AS first_item FROM people p JOIN supplier s ON p.person_id = s.s_suppkey GROUP BY p.person_id, lower(replace(s.s_name, '#', ' '))",
    "comparison_plan": f"{RSTT}, {QUALITY10}, {METRICS}, {metrics('others', 'best')}, m AS (SELECT 1 AS i, 'popularity' AS model, count(*) AS users, avg(ndcg10) AS ndcg, avg(recall10) AS recall FROM metrics UNION ALL SELECT 2, 'quality', count(*), avg(ndcg10), avg(recall10) FROM others) SELECT a.model AS base, b.model AS challenger, a.users, round(b.ndcg - a.ndcg, 6) AS ndcg10, round(b.recall - a.recall, 6) AS recall10 FROM m a JOIN m b ON a.i < b.i AND a.users = b.users",
    "item_features": f"{C}, rare AS (SELECT studio, count(*) AS n FROM catalog GROUP BY studio), f AS (SELECT item_id, concat('item:', CAST(item_id AS STRING)) AS token FROM catalog UNION ALL SELECT c.item_id, CASE WHEN r.n < 75 THEN 'studio:other' ELSE concat('studio:', c.studio) END FROM catalog c JOIN rare r ON c.studio = r.studio UNION ALL SELECT item_id, concat('type:', type) FROM catalog) SELECT item_id, token, round(1e0 / count(*) OVER (PARTITION BY item_id), 6) AS w FROM f",
    # evaluation arms
    "list_composition": f"{RSTT}, {CATALOG} SELECT CASE WHEN s.fold = 'test' THEN 'test positive' WHEN r.item_id IS NOT NULL THEN 'rated' ELSE 'unrated' END AS kind, count(*) AS n, round(avg(t.rank * 1e0), 6) AS mean_rank FROM top t LEFT JOIN ratings r ON r.user_id = t.user_id AND r.item_id = t.item_id LEFT JOIN split s ON s.user_id = t.user_id AND s.item_id = t.item_id GROUP BY CASE WHEN s.fold = 'test' THEN 'test positive' WHEN r.item_id IS NOT NULL THEN 'rated' ELSE 'unrated' END",
    "candidate_oracle": f"{RST}, found AS (SELECT s.user_id, count(*) AS relevant, count_if(b.pop_rank <= 300) AS found FROM split s JOIN ranked b ON s.item_id = b.item_id WHERE s.fold = 'test' GROUP BY s.user_id) SELECT count(*) AS users, round(avg(least(found, 10) * 1e0 / least(relevant, 10)), 6) AS ceiling FROM found",
    "conditional_rank": f"{RST} SELECT b.bucket, count(*) AS n, min(b.pop_rank) AS best, max(b.pop_rank) AS worst, round(avg(b.pop_rank * 1e0), 6) AS mean_rank FROM split s JOIN bucketed b ON s.item_id = b.item_id WHERE s.fold = 'test' AND b.pop_rank <= 1000 GROUP BY b.bucket",
    "small_profile_cells": f"WITH {RATINGS}, {SPLIT}, {STATS}, {TOP10}, {METRICS}, k AS (SELECT 3 AS k UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20) SELECT k.k, count(*) AS users, round(avg(m.ndcg10), 6) AS mean, round(196e-2 * coalesce(stddev_samp(m.ndcg10), 0e0) / sqrt(count(*)), 6) AS half_width FROM metrics m JOIN (SELECT user_id, count(*) AS n FROM split WHERE fold = 'train' GROUP BY user_id) p ON m.user_id = p.user_id JOIN k ON p.n >= k.k GROUP BY k.k",
    "watched_arms": f"{RST}, h AS (SELECT item_id, pop_rank FROM ranked WHERE pop_rank <= 20), seen AS (SELECT r.user_id, h.item_id, r.rating FROM h JOIN ratings r ON h.item_id = r.item_id) SELECT 'none' AS arm, count(DISTINCT user_id) * 20 AS shown FROM ratings UNION ALL SELECT 'positives', max(u.n) * 20 - count_if(s.rating >= 8) FROM seen s, (SELECT count(DISTINCT user_id) AS n FROM ratings) u UNION ALL SELECT 'all rated', max(u.n) * 20 - count(*) FROM seen s, (SELECT count(DISTINCT user_id) AS n FROM ratings) u",
    "series_policy": f"{RSTT}, {CATALOG}, x AS (SELECT t.user_id, t.rank, row_number() OVER (PARTITION BY t.user_id, {_SERIES} ORDER BY t.rank) AS k FROM top t JOIN catalog c ON t.item_id = c.item_id) SELECT user_id, count(*) AS free, count_if(k <= 2) AS cap2, count_if(k = 1) AS one FROM x GROUP BY user_id",
    "feed_depth": f"{RS}, {_SEGMENT}, d AS (SELECT r.user_id, s.segment, ceil(count(*) / 18e0) AS pages FROM ratings r JOIN seg s ON r.user_id = s.user_id GROUP BY r.user_id, s.segment) SELECT segment, count(*) AS users, round(percentile_cont(5e-1) WITHIN GROUP (ORDER BY pages), 6) AS p50, round(percentile_cont(95e-2) WITHIN GROUP (ORDER BY pages), 6) AS p95 FROM d GROUP BY segment",
    "list_overlap": f"{RSTT}, {CATALOG}, {_TASTE}, other AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(studio + type + q, 9) DESC, item_id) AS k FROM signals) SELECT user_id, count_if(rank <= 5 AND k <= 5) / 5e0 AS overlap FROM (SELECT s.user_id, s.rank, o.k FROM signals s JOIN other o ON s.user_id = o.user_id AND s.item_id = o.item_id) x GROUP BY user_id",
    "popularity_penalty": f"{RST}, m AS (SELECT sum(total) * 1e0 / sum(observed) AS mu, max(positives) AS peak FROM stats), lam AS (SELECT 0e0 AS lam UNION ALL SELECT 5e-2 UNION ALL SELECT 2e-1 UNION ALL SELECT 5e-1), s AS (SELECT l.lam, b.item_id, b.bucket, round((b.total + 50 * m.mu) / (b.observed + 50) / 10 - l.lam * ln(1 + b.positives) / ln(1 + m.peak), 9) AS score FROM bucketed b, m, lam l) SELECT lam, bucket, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lam ORDER BY score DESC, item_id) AS k FROM s) x WHERE k <= 100 GROUP BY lam, bucket",
    "sampled_protocol": f"{RST}, neg AS (SELECT pop_rank AS neg_rank FROM (SELECT pop_rank, row_number() OVER (ORDER BY md5(concat('99:', CAST(item_id AS STRING))), item_id) AS k FROM ranked) x WHERE k <= 99), test AS (SELECT s.user_id, s.item_id, b.pop_rank FROM split s JOIN ranked b ON s.item_id = b.item_id WHERE s.fold = 'test'), placed AS (SELECT b.item_id, 1 + count_if(n.neg_rank < b.pop_rank) AS place FROM (SELECT DISTINCT item_id, pop_rank FROM test) b, neg n GROUP BY b.item_id) SELECT count(*) AS n, round(avg(CASE WHEN t.pop_rank <= 10 THEN 1e0 ELSE 0e0 END), 6) AS full_hit10, round(avg(CASE WHEN p.place <= 10 THEN 1e0 ELSE 0e0 END), 6) AS sampled_hit10 FROM test t JOIN placed p ON t.item_id = p.item_id",
    # models and ranking
    "lexical_search": f"{C}, q AS (SELECT 1 AS query_id, 'almond' AS a, 'metal' AS b UNION ALL SELECT 2, 'green', 'brand#13' UNION ALL SELECT 3, 'blue', 'steel'), s AS (SELECT q.query_id, c.item_id, CASE WHEN lower(c.title) = concat(q.a, ' ', q.b) THEN 100 WHEN lower(c.title) LIKE concat('%', q.a, ' ', q.b, '%') THEN 35 WHEN lower(c.studio) = q.b THEN 18 ELSE 0 END + CASE WHEN lower(c.title) LIKE concat('%', q.a, '%') THEN 12 ELSE 0 END + CASE WHEN lower(c.type) LIKE concat('%', q.b, '%') THEN 4 ELSE 0 END + CASE WHEN lower(c.title) LIKE concat('%', q.b, '%') THEN 12 ELSE 0 END AS score FROM catalog c, q) SELECT query_id, item_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM s WHERE score > 0) x WHERE place <= 20",
    "search_fallback": f"{C}, q AS (SELECT 1 AS query_id, 'a' AS key UNION ALL SELECT 2, 'zzzz'), hits AS (SELECT q.query_id, c.item_id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.score DESC, c.item_id) AS k FROM catalog c JOIN q ON lower(c.title) LIKE concat('%', q.key, '%')), best AS (SELECT item_id, k FROM (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS k FROM catalog) y WHERE k <= 10) SELECT query_id, item_id, k, 'lexical' AS how FROM hits WHERE k <= 10 UNION ALL SELECT q.query_id, b.item_id, b.k, 'fallback' FROM q LEFT JOIN (SELECT DISTINCT query_id FROM hits) h ON q.query_id = h.query_id, best b WHERE h.query_id IS NULL",
    "profile_features": f"{RS}, {CATALOG}, {_FEATURES} SELECT user_id, feature, w FROM (SELECT s.user_id, f.feature, sum(f.w) AS w, row_number() OVER (PARTITION BY s.user_id ORDER BY sum(f.w) DESC, f.feature) AS k FROM split s JOIN feats f ON s.item_id = f.item_id WHERE s.fold = 'train' GROUP BY s.user_id, f.feature) x WHERE k <= 5",
    "hybrid_score": f"{RSTT}, {CATALOG}, {_TASTE} SELECT user_id, item_id, round((3e-1 * studio + 2e-1 * type + 1e-1 * q + 5e-2 * pop) / ((CASE WHEN studio > 0 THEN 3e-1 ELSE 0e0 END) + (CASE WHEN type > 0 THEN 2e-1 ELSE 0e0 END) + 15e-2), 6) AS score FROM signals",
    "session_score": f"{RSTT}, {CATALOG}, {_TASTE} SELECT user_id, item_id, round(3e-1 * studio + 28e-2 * type + 12e-2 * q + 1e-1 * (1 - pop) + 8e-2 / rank, 6) AS score FROM signals",
    "rerank_features": f"{RSTT}, {CATALOG}, {_TASTE} SELECT user_id, item_id, round(studio, 6) AS studio, round(type, 6) AS type, round(q, 6) AS quality, round(pop, 6) AS popularity, round((q - avg(q) OVER (PARTITION BY user_id)) / CASE WHEN stddev_pop(q) OVER (PARTITION BY user_id) < 1e-9 THEN 1e0 ELSE stddev_pop(q) OVER (PARTITION BY user_id) END, 4) AS quality_z, round(1e0 / rank, 6) AS reciprocal FROM signals",
    "explanations": f"{RSTT}, {CATALOG}, {_TASTE} SELECT user_id, item_id, concat(CASE WHEN studio > 0 THEN concat('by ', studio_name, '; ') ELSE '' END, CASE WHEN type > 0 THEN 'a kind you like; ' ELSE '' END, CASE WHEN pop >= 9e-1 THEN 'popular; ' ELSE '' END) AS reasons FROM signals",
    "oracle_model": f"{RS} SELECT user_id, item_id, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS rank FROM split WHERE fold = 'test') x WHERE rank <= 10",
    # set operations
    "ordered_unique": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS place FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type) x",
    "family_bridge_union": f"{C}, items AS (SELECT item_id, studio, {_SERIES} AS series FROM catalog) SELECT series, item_id FROM items WHERE item_id % 4 = 0 UNION SELECT a.series, b.item_id FROM items a JOIN items b ON a.series = b.series AND a.studio = b.studio WHERE a.item_id % 4 = 0",
    "profile_union": f"{RC}, two AS (SELECT r.user_id, lower(c.studio) AS name, r.item_id AS pos FROM ratings r JOIN catalog c ON r.item_id = c.item_id WHERE r.rating = 10 UNION ALL SELECT r.user_id, lower(upper(c.type)), 1000000000 + r.item_id FROM ratings r JOIN catalog c ON r.item_id = c.item_id WHERE r.rating = 9) SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY min(pos), name) AS place FROM two GROUP BY user_id, name",
    # requests (N2-N6, N8-N10)
    "numeric_extract": f"WITH {_TURNS} SELECT conv_id, turn, try_cast(nullif(regexp_extract(t, '(?:at least|over|above) ([0-9]+)', 1), '') AS INT) AS low, try_cast(nullif(regexp_extract(t, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1), '') AS INT) AS year, try_cast(nullif(regexp_extract(t, '([0-9]+) (?:episodes|parts|steps)', 1), '') AS INT) AS parts FROM turns",
    "rank_intent": f"WITH {_TURNS} SELECT conv_id, turn, CASE WHEN t LIKE '%popular%' THEN 'popularity' WHEN t LIKE '%best%' OR t LIKE '%top%' THEN 'score' WHEN t LIKE '%new%' THEN 'year' END AS field, CASE WHEN t LIKE '%worst%' OR t LIKE '%least%' THEN 'asc' ELSE 'desc' END AS direction FROM turns",
    "negation_scope": f"WITH {_TURNS} SELECT conv_id, turn, regexp_like(t, '(^|[^a-z])(not|no|without|never)[^a-z][^.,;!?]{{0,60}}[a-z]') AS negated, regexp_like(t, '(^|[^a-z])(movie|series|data|text|code)s?([^a-z]|$)') AS formatted FROM turns",
    "residual_query": f"WITH {_TURNS} SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '(please|show me|can you|find|give me)', ' ' GLOBAL), '[^a-z0-9]+', ' ' GLOBAL)) AS query FROM turns WHERE role = 'user'",
    "constraint_inherit": f"WITH {_TURNS}, c AS (SELECT conv_id, turn, CASE WHEN t LIKE '%only%' THEN 'only' WHEN t LIKE '%any%' THEN 'any' END AS said FROM turns), g AS (SELECT *, count(said) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM c) SELECT conv_id, turn, max(said) OVER (PARTITION BY conv_id, part) AS holds FROM g",
    "preference_patch": f"WITH {_TURNS} SELECT conv_id, turn, nullif(regexp_extract(t, '(?:like|love|want) ([a-z]+)', 1), '') AS liked, nullif(regexp_extract(t, '(?:hate|avoid|never) ([a-z]+)', 1), '') AS disliked FROM turns WHERE role = 'user'",
    "entity_ambiguity": f"{C} SELECT lower(title) AS name, count(*) AS candidates, min(item_id) AS best, count(*) > 1 AS ambiguous FROM catalog GROUP BY lower(title)",
    "result_reference": f"WITH {_TURNS} SELECT conv_id, turn, CASE WHEN t LIKE '%first%' THEN 1 WHEN t LIKE '%second%' THEN 2 WHEN t LIKE '%third%' THEN 3 WHEN t LIKE '%last%' THEN -1 END AS place FROM turns",
    # state (T1, T2, T4, T7, T8, F37)
    "sliding_count": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '60' SECOND PRECEDING AND CURRENT ROW) AS n FROM events",
    "session_state": "SELECT user_id, max(CASE WHEN k = 1 THEN event_id END) AS last_event, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, event_id, n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM (SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id, event_type) x) y GROUP BY user_id",
    "retention": "WITH s AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id) SELECT s.user_id, s.last_ts < m.newest - INTERVAL '1' DAY AS expired FROM s, (SELECT max(last_ts) AS newest FROM s) m",
    "circuit_breaker": "SELECT event_id, user_id, value < 20 AND coalesce(lag(value, 1) OVER w < 20 AND lag(value, 2) OVER w < 20, false) AS opened FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "hopping_windows": "SELECT event_type, hop, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) AS hop FROM events UNION ALL SELECT event_type, date_trunc('hour', ts) - INTERVAL '1' HOUR FROM events) x GROUP BY event_type, hop",
}
