"""Demand, click-through, content, query, feedback, user and request reports."""

from __future__ import annotations

from sightline.plans.report import AS_OF, WEEK, WEEK_BEFORE, Report

CTR = "COUNT(*) AS impressions, CAST(SUM(clicked) AS BIGINT) AS clicks, ROUND(SUM(clicked) / COUNT(*), 6) AS ctr"
#: Expected clicks of an impression: the click-through of its rank over all impressions.
BASE = "SELECT i.*, b.base FROM {impr} i JOIN (SELECT rank, SUM(clicked) / COUNT(*) AS base FROM {impr} GROUP BY rank) b ON i.rank = b.rank"
ADJUSTED = "ROUND(CASE WHEN SUM(base) > 0 THEN (SELECT SUM(clicked) / COUNT(*) FROM {impr}) * SUM(clicked) / SUM(base) ELSE 0 END, 6) AS rank_adjusted_ctr"
DAYS = "SELECT CAST(d AS DATE) AS day FROM (SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-30', INTERVAL 1 DAY)) AS d)"
DAYS_DUCKDB = "SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d)"
CUR, PREV = f"created_at >= ts'{WEEK}' AND created_at < ts'{AS_OF}'", f"created_at >= ts'{WEEK_BEFORE}' AND created_at < ts'{WEEK}'"


def filled(sql: str) -> Report:
    """A report over all days of the month; ``[days]`` is the calendar."""
    return Report(sql.replace("[days]", f"({DAYS})"), sql.replace("[days]", f"({DAYS_DUCKDB})"))


ITEM = f"COUNT(*) AS impressions, CAST(SUM(clicked) AS BIGINT) AS clicks, ROUND(SUM(clicked) / COUNT(*), 6) AS ctr, {ADJUSTED}, ROUND(AVG(rank), 6) AS average_rank, COUNT(DISTINCT query_text) AS queries_seen, COUNT(DISTINCT CASE WHEN clicked = 1 THEN query_text END) AS queries_clicked"

REPORTS: dict[str, Report] = {
    "rank_baselines": Report(f"SELECT rank, {CTR} FROM {{impr}} GROUP BY rank"),
    "overview_summary": Report("""
SELECT s.searches, s.searches_with_results, s.searches_with_answer, i.impressions, i.clicks AS unique_outbound_clicks, i.views AS unique_detail_page_views,
  ROUND(i.clicks / GREATEST(i.impressions, 1), 6) AS overall_ctr, ROUND(i.views / GREATEST(i.impressions, 1), 6) AS detail_assist_rate,
  ROUND(CASE WHEN i.views > 0 THEN i.clicks / i.views ELSE 0 END, 6) AS detail_to_outbound_rate, ROUND(s.searches_with_results / GREATEST(s.searches, 1), 6) AS hit_rate
FROM (SELECT COUNT(*) AS searches, COUNT(*) FILTER (WHERE result_count > 0) AS searches_with_results, COUNT(*) FILTER (WHERE include_answer) AS searches_with_answer FROM {qlog}) s
CROSS JOIN (SELECT COUNT(*) AS impressions, CAST(SUM(clicked) AS BIGINT) AS clicks, CAST(SUM(viewed) AS BIGINT) AS views FROM {impr}) i"""),
    "metric_values": Report(f"""
WITH m AS (
  SELECT COUNT(*) FILTER (WHERE {CUR}) AS c_requests, COUNT(*) FILTER (WHERE {PREV}) AS p_requests,
    CAST(COALESCE(SUM(credits) FILTER (WHERE {CUR}), 0) AS BIGINT) AS c_credits, CAST(COALESCE(SUM(credits) FILTER (WHERE {PREV}), 0) AS BIGINT) AS p_credits,
    COUNT(*) FILTER (WHERE result_count = 0 AND {CUR}) AS c_zero, COUNT(*) FILTER (WHERE result_count = 0 AND {PREV}) AS p_zero
  FROM {{qlog}}
), long AS (
  SELECT 'requests' AS metric, c_requests AS cur, p_requests AS prev, CAST(2000 AS BIGINT) AS target FROM m
  UNION ALL SELECT 'credits_used', c_credits, p_credits, CAST(2500 AS BIGINT) FROM m
  UNION ALL SELECT 'zero_result_queries', c_zero, p_zero, CAST(NULL AS BIGINT) FROM m
)
SELECT metric, cur, prev, cur - prev AS delta, ROUND(CASE WHEN prev <> 0 THEN (cur - prev) / prev END, 6) AS delta_ratio, target, cur - target AS target_gap, ROUND(cur / target, 6) AS attainment_ratio,
  CASE WHEN target IS NULL THEN 'neutral' WHEN cur >= target THEN 'good' ELSE 'bad' END AS tone
FROM long"""),
    "answer_ctr_gap": Report("""
WITH g AS (SELECT COUNT(*) FILTER (WHERE include_answer) AS impressions_with, COUNT(*) FILTER (WHERE NOT include_answer) AS impressions_without,
  CAST(COALESCE(SUM(clicked) FILTER (WHERE include_answer), 0) AS BIGINT) AS clicks_with, CAST(COALESCE(SUM(clicked) FILTER (WHERE NOT include_answer), 0) AS BIGINT) AS clicks_without FROM {impr})
SELECT *, ROUND(clicks_with / GREATEST(impressions_with, 1) - clicks_without / GREATEST(impressions_without, 1), 6) AS ctr_gap FROM g"""),
    "surface_breakdown": Report(f"""
SELECT COALESCE(q.surface, 'Legacy') AS surface, q.searches, i.impressions, i.clicks, i.ctr FROM (SELECT surface, COUNT(*) AS searches FROM {{qlog}} GROUP BY surface) q
LEFT JOIN (SELECT surface, {CTR} FROM {{impr}} GROUP BY surface) i ON COALESCE(q.surface, '') = COALESCE(i.surface, '')"""),
    "trend_series": filled(f"""
SELECT c.day, COALESCE(q.searches, 0) AS searches, COALESCE(i.impressions, 0) AS impressions, COALESCE(i.clicks, 0) AS clicks, COALESCE(i.views, 0) AS detail_views, COALESCE(i.ctr, 0) AS ctr
FROM [days] c LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS searches FROM {{qlog}} GROUP BY CAST(created_at AS DATE)) q ON c.day = q.day
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, {CTR}, CAST(SUM(viewed) AS BIGINT) AS views FROM {{impr}} GROUP BY CAST(ts AS DATE)) i ON c.day = i.day"""),
    "top_videos_by_clicks": Report(f"SELECT video, {ITEM} FROM ({BASE}) GROUP BY video ORDER BY clicks DESC, video LIMIT 10"),
    "top_videos_by_ctr": Report(f"SELECT video, {ITEM} FROM ({BASE}) GROUP BY video HAVING COUNT(*) >= 15 ORDER BY ctr DESC, video LIMIT 10"),
    "top_results_by_ctr": Report(f"SELECT video, creator, {ITEM} FROM ({BASE}) GROUP BY video, creator HAVING COUNT(*) >= 20 ORDER BY ctr DESC, video, creator LIMIT 10"),
    "high_impr_low_click_videos": Report(f"SELECT video, {CTR} FROM {{impr}} GROUP BY video HAVING COUNT(*) >= 10 AND SUM(clicked) / COUNT(*) < (SELECT SUM(clicked) / COUNT(*) / 2 FROM {{impr}}) ORDER BY impressions DESC, video LIMIT 10"),
    "cross_query_winners": Report("SELECT creator, COUNT(DISTINCT query_text) AS queries_clicked, COUNT(*) AS clicks FROM {impr} WHERE clicked = 1 GROUP BY creator ORDER BY queries_clicked DESC, clicks DESC, creator LIMIT 10"),
    "creators_by_clicks": Report(f"SELECT creator, COUNT(DISTINCT video) AS videos, {ITEM} FROM ({BASE}) GROUP BY creator ORDER BY clicks DESC, creator LIMIT 10"),
    "creators_by_ctr": Report(f"SELECT creator, COUNT(DISTINCT video) AS videos, {ITEM} FROM ({BASE}) GROUP BY creator HAVING COUNT(*) >= 30 ORDER BY ctr DESC, creator LIMIT 10"),
    "creator_share_leaders": Report("""
WITH g AS (SELECT creator, COUNT(*) AS impressions, CAST(SUM(clicked) AS BIGINT) AS clicks FROM {impr} GROUP BY creator), t AS (SELECT COUNT(*) AS impressions, SUM(clicked) AS clicks FROM {impr})
SELECT g.creator, ROUND(g.impressions / t.impressions, 6) AS impression_share, ROUND(g.clicks / t.clicks, 6) AS outbound_share, ROUND(g.clicks / t.clicks - g.impressions / t.impressions, 6) AS share_delta FROM g CROSS JOIN t"""),
    "top_queries": Report("""
SELECT q.query_text, q.searches, q.zero_results, q.answer_searches, q.average_latency_ms, COALESCE(i.impressions, 0) AS impressions, COALESCE(i.clicks, 0) AS clicks, ROUND(COALESCE(i.clicks / i.impressions, 0), 6) AS ctr
FROM (SELECT query_text, COUNT(*) AS searches, COUNT(*) FILTER (WHERE result_count = 0) AS zero_results, COUNT(*) FILTER (WHERE include_answer) AS answer_searches, ROUND(AVG(latency_ms), 4) AS average_latency_ms FROM {qlog} GROUP BY query_text) q
LEFT JOIN (SELECT query_text, COUNT(*) AS impressions, CAST(SUM(clicked) AS BIGINT) AS clicks FROM {impr} GROUP BY query_text) i ON q.query_text = i.query_text
ORDER BY searches DESC, query_text LIMIT 10"""),
    "zero_result_queries": Report("SELECT query_text, COUNT(*) AS zero_results FROM {qlog} WHERE result_count = 0 GROUP BY query_text ORDER BY zero_results DESC, query_text LIMIT 10"),
    "weak_queries": Report(f"SELECT query_text, {CTR} FROM {{impr}} GROUP BY query_text HAVING COUNT(*) >= 10 ORDER BY ctr, impressions DESC, query_text LIMIT 10"),
    "strong_queries": Report(f"SELECT query_text, {CTR} FROM {{impr}} GROUP BY query_text HAVING COUNT(*) >= 10 ORDER BY ctr DESC, impressions DESC, query_text LIMIT 10"),
    "rank_adjusted_ctr": Report(f"SELECT video, {ADJUSTED} FROM ({BASE}) GROUP BY video"),
    "feedback_summary": Report("SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE rating = 1) AS likes, COUNT(*) FILTER (WHERE rating = -1) AS dislikes, COUNT(DISTINCT user_id) AS unique_users, ROUND(COUNT(*) FILTER (WHERE rating = 1) / GREATEST(COUNT(*), 1), 6) AS like_rate, CAST(SUM(rating) AS BIGINT) AS net FROM {fb}"),
    "feedback_top_videos": Report("SELECT video, COUNT(*) FILTER (WHERE rating = 1) AS likes, COUNT(*) FILTER (WHERE rating = -1) AS dislikes, CAST(SUM(rating) AS BIGINT) AS net FROM {fb} GROUP BY video ORDER BY net DESC, likes DESC, video LIMIT 10"),
    "feedback_top_results": Report("SELECT result_id, CAST(SUM(rating) AS BIGINT) AS net FROM {fb} GROUP BY result_id ORDER BY net DESC, result_id LIMIT 10"),
    "feedback_bottom_results": Report("SELECT result_id, CAST(SUM(rating) AS BIGINT) AS net FROM {fb} GROUP BY result_id ORDER BY net, result_id LIMIT 10"),
    "admin_summary": Report(f"""
SELECT 'total_users' AS metric, COUNT(*) AS value FROM {{usr}}
UNION ALL SELECT 'new_users', COUNT(*) FROM {{qlog}} WHERE event_type = 'signup' AND {CUR}
UNION ALL SELECT 'active_users', COUNT(DISTINCT user_id) FROM {{qlog}} WHERE {CUR}
UNION ALL SELECT 'requests', COUNT(*) FROM {{qlog}} WHERE {CUR}
UNION ALL SELECT 'credits_used', CAST(COALESCE(SUM(credits), 0) AS BIGINT) FROM {{qlog}} WHERE {CUR}
UNION ALL SELECT 'pending_jobs', COUNT(*) FROM {{job}} WHERE status IN ('pending', 'retrying')
UNION ALL SELECT 'failed_jobs', COUNT(*) FROM {{job}} WHERE status = 'failed'
UNION ALL SELECT 'assets', COUNT(*) FROM {{unit}}"""),
    "users_summary": Report("SELECT tier, region, COUNT(*) AS users FROM {usr} GROUP BY GROUPING SETS ((tier), (region), ())"),
    "daily_signups": filled("SELECT c.day, COALESCE(s.signups, 0) AS signups FROM [days] c LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS signups FROM {qlog} WHERE event_type = 'signup' GROUP BY CAST(created_at AS DATE)) s ON c.day = s.day"),
    "most_active_users": Report("""
SELECT q.user_id, u.name, u.tier, q.request_count, q.credits_used, q.last_request_at FROM (SELECT user_id, COUNT(*) AS request_count, CAST(SUM(credits) AS BIGINT) AS credits_used, MAX(created_at) AS last_request_at FROM {qlog} GROUP BY user_id) q
LEFT JOIN {usr} u ON q.user_id = u.user_id ORDER BY request_count DESC, q.user_id LIMIT 10"""),
    "recent_users": Report("SELECT user_id, MAX(created_at) AS signed_up_at FROM {qlog} WHERE event_type = 'signup' GROUP BY user_id ORDER BY signed_up_at DESC, user_id LIMIT 10"),
    "requests_summary": Report("SELECT COUNT(*) AS requests, ROUND(SUM(credits) / COUNT(*), 6) AS average_credits, ROUND(COUNT(*) FILTER (WHERE result_count = 0) / COUNT(*), 6) AS zero_result_rate, ROUND(COUNT(*) FILTER (WHERE include_answer) / COUNT(*), 6) AS answer_usage_rate FROM {qlog}"),
    "credit_breakdown": Report("""
WITH w AS (SELECT user_id, CAST(FLOOR(GREATEST(balance, 0)) AS BIGINT) AS total, tier FROM {usr}), p AS (SELECT user_id, total, LEAST(total, 3000) AS included, LEAST(GREATEST(total - 3000, 0), 1000) AS bonus FROM w)
SELECT user_id, total, included, bonus, GREATEST(total - included - bonus, 0) AS other, ROUND(included / GREATEST(total, 1), 6) AS included_share FROM p"""),
    "usage_stats": Report("""
WITH d AS (SELECT CAST(created_at AS DATE) AS day, CAST(SUM(credits) AS BIGINT) AS credits, COUNT(*) AS requests FROM {qlog} GROUP BY CAST(created_at AS DATE)), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY day DESC) AS n FROM d)
SELECT CAST(FLOOR(AVG(credits) + 0.5) AS BIGINT) AS average, MAX(credits) AS peak, ROUND(SUM(credits) / SUM(requests), 2) AS credits_per_request FROM r WHERE n <= 7"""),
    "avg_daily_credits": filled("SELECT CAST(FLOOR(SUM(COALESCE(q.credits, 0)) / COUNT(*) + 0.5) AS BIGINT) AS average FROM [days] c LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, SUM(credits) AS credits FROM {qlog} GROUP BY CAST(created_at AS DATE)) q ON c.day = q.day"),
    "trend_totals": Report("""
WITH d AS (SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS requests, CAST(SUM(credits) AS BIGINT) AS credits FROM {qlog} GROUP BY CAST(created_at AS DATE)), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY credits DESC, day) AS n FROM d)
SELECT CAST(SUM(credits) AS BIGINT) AS total, CAST(SUM(requests) AS BIGINT) AS secondary_total, MAX(CASE WHEN n = 1 THEN day END) AS peak_day, MAX(credits) AS peak FROM r"""),
    "count_guard": Report("SELECT COUNT(*) AS others FROM {usr} WHERE tier = 'BUILDING' AND user_id <> 1"),
    "referral_summary": Report("SELECT region, LEAST(COUNT(*), 100) AS referred, CAST(SUM(CASE WHEN balance > 0 THEN 200 ELSE 0 END) AS BIGINT) AS credits_earned FROM {usr} GROUP BY region"),
    "last_n_days": Report("SELECT day, requests FROM (SELECT day, requests, ROW_NUMBER() OVER (ORDER BY day DESC) AS n FROM (SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS requests FROM {qlog} GROUP BY CAST(created_at AS DATE))) WHERE n <= 14"),
    "query_log_page": Report(f"SELECT request_id, user_id, query_text, surface, result_count, created_at FROM {{qlog}} WHERE {CUR} AND contains(lower(query_text), 'query 1') AND surface = 'api' ORDER BY created_at DESC, request_id LIMIT 50 OFFSET 50"),
    "query_log_lookup": Report("SELECT * FROM {qlog} WHERE request_id = 17"),
    "rate_limit_1s": Report("SELECT user_id, date_trunc('second', created_at) AS second, COUNT(*) AS requests, CASE WHEN COUNT(*) > 1 THEN 429 ELSE 200 END AS status FROM {qlog} GROUP BY user_id, date_trunc('second', created_at)", "SELECT user_id, CAST(date_trunc('second', created_at) AS TIMESTAMP) AS second, COUNT(*) AS requests, CASE WHEN COUNT(*) > 1 THEN 429 ELSE 200 END AS status FROM {qlog} GROUP BY ALL"),
    "click_dedup": Report("SELECT user_id, video, MIN(request_id) AS first_request, COUNT(*) AS clicks FROM {impr} WHERE clicked = 1 GROUP BY user_id, video"),
    "daily_trend": Report("SELECT CAST(window.start AS DATE) AS day, event_type, n FROM (SELECT window(created_at, '1 day') AS window, event_type, COUNT(*) AS n FROM {qlog} GROUP BY window(created_at, '1 day'), event_type)", "SELECT CAST(created_at AS DATE) AS day, event_type, COUNT(*) AS n FROM {qlog} GROUP BY CAST(created_at AS DATE), event_type"),
    "user_sessions": Report("SELECT user_id, window.start AS started_at, n FROM (SELECT user_id, session_window(created_at, '30 minutes') AS window, COUNT(*) AS n FROM {qlog} GROUP BY user_id, session_window(created_at, '30 minutes'))", """
SELECT user_id, MIN(created_at) AS started_at, COUNT(*) AS n FROM (SELECT user_id, created_at, SUM(new) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT user_id, created_at, CASE WHEN created_at - LAG(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM {qlog})) GROUP BY user_id, s"""),
}
