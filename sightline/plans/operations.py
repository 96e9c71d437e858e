"""Jobs, workers, sources, content, retrieval, text functions and table changes."""

from __future__ import annotations

from sightline.plans.report import JOBS_AS_OF, Report

STATUS = ", ".join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "running", "retrying", "completed", "failed"))
LATEST = "SELECT *, ROW_NUMBER() OVER (PARTITION BY {0} ORDER BY created_at DESC, job_id DESC) AS n FROM {{job}}"
SOON = f"created_at >= ts'2001-05-01 00:00:00' AND created_at < ts'{JOBS_AS_OF}'"

REPORTS: dict[str, Report] = {
    "content_summary": Report("SELECT unit_type, COUNT(*) AS units, COUNT(DISTINCT video) AS videos FROM {unit} GROUP BY unit_type"),
    "stale_sources": Report(f"SELECT s.source_id, s.name, j.last_job_at, COALESCE(j.jobs, 0) AS jobs_in_range, COALESCE(j.jobs, 0) = 0 AS is_stale FROM {{src}} s LEFT JOIN (SELECT source_id, MAX(created_at) AS last_job_at, COUNT(*) FILTER (WHERE {SOON}) AS jobs FROM {{job}} GROUP BY source_id) j ON s.source_id = j.source_id"),
    "workers_summary": Report(f"""
WITH s AS (SELECT COUNT(*) AS created, {STATUS}, AVG(processing_ms) FILTER (WHERE status = 'completed') AS average_ms FROM {{job}})
SELECT created, completed, failed, pending + retrying AS backlog, pending + running + retrying AS queue_depth, ROUND(completed / NULLIF(completed + failed, 0), 6) AS completion_rate, ROUND(failed / NULLIF(completed + failed, 0), 6) AS failure_rate, ROUND(average_ms, 2) AS average_processing_ms FROM s"""),
    "job_status_counts": Report(f"SELECT COUNT(*) AS total, {STATUS} FROM {{job}}"),
    "source_health": Report(f"SELECT source_id, COUNT(*) AS jobs_created, {STATUS}, MAX(created_at) AS last_job_at FROM {{job}} GROUP BY source_id"),
    "failed_steps": Report("SELECT step, COUNT(*) AS failure_count, MAX(finished_at) AS last_failed_at FROM {step} WHERE status = 'failed' GROUP BY step"),
    "queue_depth": Report("SELECT COUNT(*) FILTER (WHERE status IN ('pending', 'running', 'retrying')) AS queue_depth, CAST(CASE WHEN COUNT(*) > 0 THEN FLOOR(100 * COUNT(*) FILTER (WHERE status = 'completed') / COUNT(*) + 0.5) ELSE 0 END AS BIGINT) AS completion_percent FROM {job}"),
    "source_progress": Report("SELECT source_id, COUNT(*) AS total, CAST(FLOOR(100 * COUNT(*) FILTER (WHERE status = 'completed') / NULLIF(COUNT(*), 0) + 0.5) AS BIGINT) AS completion_percent FROM {job} GROUP BY source_id"),
    "recent_videos_per_source": Report(f"SELECT source_id, job_id, video, created_at, n FROM ({LATEST.format('source_id')}) WHERE n <= 3"),
    "latest_job_per_video": Report(f"SELECT video, job_id, status AS last_job_status, created_at AS last_job_at FROM ({LATEST.format('video')}) WHERE n = 1"),
    "latest_log_per_step": Report("SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM {thread}) WHERE n <= 4"),
    "running_step": Report("SELECT job_id, MIN(step) FILTER (WHERE status = 'running') AS running_step, MIN(step) FILTER (WHERE status = 'failed') AS failed_step FROM {step} GROUP BY job_id"),
    "scene_boundaries": Report("""
SELECT source_id, scene, COUNT(*) AS jobs, MIN(created_at) AS started_at FROM (
  SELECT source_id, created_at, SUM(gap) OVER (PARTITION BY source_id ORDER BY created_at, job_id ROWS UNBOUNDED PRECEDING) AS scene FROM (
    SELECT source_id, created_at, job_id, CAST(CASE WHEN datediff(created_at, LAG(created_at) OVER (PARTITION BY source_id ORDER BY created_at, job_id)) > 20 THEN 1 ELSE 0 END AS BIGINT) AS gap FROM {job}))
GROUP BY source_id, scene""", """
SELECT source_id, CAST(scene AS BIGINT) AS scene, COUNT(*) AS jobs, MIN(created_at) AS started_at FROM (
  SELECT source_id, created_at, SUM(gap) OVER (PARTITION BY source_id ORDER BY created_at, job_id ROWS UNBOUNDED PRECEDING) AS scene FROM (
    SELECT source_id, created_at, job_id, CASE WHEN date_diff('day', LAG(created_at) OVER (PARTITION BY source_id ORDER BY created_at, job_id), created_at) > 20 THEN 1 ELSE 0 END AS gap FROM {job}))
GROUP BY source_id, scene"""),
    "jobs_sorted": Report("SELECT job_id, status, created_at FROM {job} ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'retrying' THEN 1 WHEN 'pending' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END, created_at DESC, job_id LIMIT 50"),
    "jobs_page": Report("SELECT job_id, status, created_at FROM {job} WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 25 OFFSET 25"),
    "source_sort": Report("SELECT source_id, name, COALESCE(subscribers, 0) AS subscribers FROM {src} ORDER BY subscribers DESC, source_id LIMIT 30"),
    "failed_jobs_with_source": Report("SELECT j.job_id, COALESCE(s.name, CAST(j.source_id AS STRING), '—') AS label, j.created_at FROM {job} j LEFT JOIN {src} s ON j.source_id = s.source_id WHERE j.status = 'failed'"),
    "job_steps_full": Report("""
SELECT COALESCE(o.step, s.step) AS step, o.label, COALESCE(s.runs, 0) AS runs FROM (SELECT CAST(1 AS BIGINT) AS step, 'fetch' AS label UNION ALL SELECT 2, 'detect' UNION ALL SELECT 3, 'transcribe' UNION ALL SELECT 9, 'persist') o
FULL JOIN (SELECT step, COUNT(*) AS runs FROM {step} GROUP BY step) s ON o.step = s.step"""),
    "exists_flags": Report("SELECT u.user_id, EXISTS (SELECT 1 FROM {qlog} q WHERE q.user_id = u.user_id) AS has_requests, EXISTS (SELECT 1 FROM {job} j WHERE j.video = u.user_id) AS has_jobs FROM {usr} u"),
    "insert_if_absent": Report("SELECT q.user_id, MIN(q.created_at) AS first_seen FROM {qlog} q LEFT ANTI JOIN (SELECT user_id FROM {usr} WHERE user_id % 2 = 0) u ON q.user_id = u.user_id GROUP BY q.user_id", "SELECT q.user_id, MIN(q.created_at) AS first_seen FROM {qlog} q WHERE NOT EXISTS (SELECT 1 FROM {usr} u WHERE u.user_id % 2 = 0 AND q.user_id = u.user_id) GROUP BY q.user_id"),
    "upsert_latest": Report("""
SELECT user_id, name, version FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY version DESC) AS n FROM (
  SELECT user_id, name, 0 AS version FROM {usr} UNION ALL SELECT user_id + 10, concat('new ', name), 1 FROM {usr} WHERE user_id % 3 = 0)) WHERE n = 1"""),
    "upsert_keep_old": Report("SELECT COALESCE(o.user_id, n.user_id) AS user_id, COALESCE(n.name, o.name) AS name, COALESCE(n.tier, o.tier) AS tier FROM {usr} o FULL JOIN (SELECT user_id + 5 AS user_id, CASE WHEN user_id % 2 = 0 THEN name END AS name, tier FROM {usr} WHERE user_id % 4 = 0) n ON o.user_id = n.user_id"),
    "delete_cascade": Report("""
WITH gone AS (SELECT video FROM {fb} GROUP BY video HAVING SUM(rating) < 0), every AS (SELECT 'unit' AS kind, video FROM {unit} UNION ALL SELECT 'job', video FROM {job})
SELECT kind, COUNT(g.video) AS deleted, COUNT(*) - COUNT(g.video) AS remaining FROM every e LEFT JOIN gone g ON e.video = g.video GROUP BY kind"""),
    "cascade_remaining": Report("SELECT j.job_id, j.video FROM {job} j LEFT ANTI JOIN (SELECT video FROM {fb} GROUP BY video HAVING SUM(rating) < 0) g ON j.video = g.video", "SELECT job_id, video FROM {job} WHERE video NOT IN (SELECT video FROM {fb} GROUP BY video HAVING SUM(rating) < 0)"),
    "discovery_filter": Report("SELECT COUNT(*) AS found, COUNT(*) FILTER (WHERE n_chars < 180 OR doc_id % 7 = 0) AS filtered, COUNT(*) FILTER (WHERE n_chars >= 180 AND doc_id % 7 <> 0) AS jobs FROM {script}"),
    "account_user_join": Report("SELECT u.user_id, u.tier, COUNT(*) AS jobs FROM {usr} u JOIN (SELECT concat('  CUSTOMER#', lpad(CAST(video AS STRING), 9, '0'), ' ') AS account FROM {job}) j ON lower(trim(j.account)) = lower(trim(u.name)) GROUP BY u.user_id, u.tier"),
    "worker_liveness": Report("""
WITH h AS (SELECT user_id AS worker, MAX(created_at) AS last_heartbeat FROM {qlog} WHERE created_at < ts'2024-01-30 12:00:00' GROUP BY user_id)
SELECT worker, last_heartbeat, CASE WHEN last_heartbeat >= ts'2024-01-30 11:59:00' THEN 'online' WHEN last_heartbeat >= ts'2024-01-30 11:55:00' THEN 'stale' ELSE 'offline' END AS state FROM h"""),
    "slugify": Report("SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-'), '^-|-$', '') AS slug FROM {script}", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM {script}"),
    "error_preview": Report("SELECT doc_id, left(substring_index(text, chr(10), 1), 96) AS preview FROM {script}", "SELECT doc_id, left(split_part(text, chr(10), 1), 96) AS preview FROM {script}"),
    "key_hash": Report("SELECT user_id, sha2(name, 256) AS key_hash, substring(name, 1, 8) AS key_prefix FROM {usr}", "SELECT user_id, sha256(name) AS key_hash, substring(name, 1, 8) AS key_prefix FROM {usr}"),
    "percent_used": Report("SELECT user_id, CAST(GREATEST(0, LEAST(100, FLOOR(100 * balance / 5000 + 0.5))) AS BIGINT) AS percent, CAST(GREATEST(LEAST(5000 - balance, 5000), 0) AS DOUBLE) AS used, CASE tier WHEN 'BUILDING' THEN 'Pro' WHEN 'MACHINERY' THEN 'Monthly' ELSE 'Free' END AS tier_label FROM {usr}"),
    "tracked_urls": Report("SELECT page_id, lower(parse_url(url, 'HOST')) AS host, regexp_extract(url, '://[^/?#]+/([^/?#]*)', 1) AS first_part FROM {url}", "SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/?#]+/([^/?#]*)', 1) AS first_part FROM {url}"),
    "docs_union": Report("SELECT lang AS kind, COUNT(*) AS n FROM {script} GROUP BY lang UNION ALL SELECT unit_type, COUNT(*) FROM {unit} GROUP BY unit_type UNION ALL SELECT role, COUNT(*) FROM {thread} GROUP BY role"),
    "unknown_steps": Report("SELECT DISTINCT s.step FROM {step} s LEFT ANTI JOIN (SELECT CAST(1 AS BIGINT) AS step UNION ALL SELECT 2 UNION ALL SELECT 3) k ON s.step = k.step", "SELECT DISTINCT step FROM {step} WHERE step NOT IN (1, 2, 3)"),
    "library_search": Report("SELECT doc_id, speaker, lang, n_chars FROM {script} WHERE contains(lower(text), 'the') AND speaker = 'src0' ORDER BY n_chars DESC, doc_id LIMIT 8"),
    "transcript_filters": Report("SELECT doc_id, speaker, lang, n_chars FROM {script} WHERE speaker = 'src3' AND n_chars BETWEEN 500 AND 5000"),
}
