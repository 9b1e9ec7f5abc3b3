"""SQL twins of the llm queries."""

from __future__ import annotations

#: Latest row of every score_id, with the attack by its spelling.
LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY ingested_at DESC) AS rn FROM member_scores)
  WHERE rn = 1),
named AS (
  SELECT l.score_id, l.target_id, l.record_id, l.member_prob, a.attack_name
  FROM latest l JOIN attack_names a ON lower(trim(l.attack_name)) = lower(trim(a.spelling))
  WHERE l.member_prob IS NOT NULL AND NOT isnan(l.member_prob))
"""

P2_FOUND = f"""
WITH {LATEST}
SELECT target_id, attack_name, score_id FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id, attack_name ORDER BY member_prob DESC, record_id, score_id) AS place FROM named)
WHERE place <= 5
"""


#: One row of every record, NaN as null; then all pairs across splits, compared position by position.
RECORDS = """
rows AS (
  SELECT record_id, target_id, split, source, list_transform(features, lambda x: CASE WHEN isnan(x) THEN NULL ELSE x END) AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM records) WHERE rn = 1),
pairs AS (
  SELECT a.record_id AS ours, b.record_id AS theirs
  FROM rows a JOIN rows b ON a.target_id = b.target_id AND a.split = 'train' AND b.split <> 'train' AND len(a.f) = len(b.f)
  WHERE 8 * len(list_filter(range(1, len(a.f) + 1), lambda i:
    NOT coalesce(abs(a.f[i] - b.f[i]) <= 0.020000001, a.f[i] IS NULL AND b.f[i] IS NULL))) <= len(a.f))
"""

P1_FOUND = f"WITH {RECORDS} SELECT least(ours, theirs) AS record_a, greatest(ours, theirs) AS record_b FROM pairs"

P1_REPORT = f"""
WITH {RECORDS},
counted AS (SELECT theirs, count(*) AS n FROM pairs GROUP BY theirs)
SELECT split, source, count(*) AS n_records, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs
FROM rows LEFT JOIN counted ON record_id = theirs
WHERE split <> 'train' AND len(f) > 0 GROUP BY split, source
"""


#: Order statistics as bounds, then the same closeness score by score in long form.
P3_FOUND = f"""
WITH {LATEST},
wanted AS (SELECT target_id, max(top_n) AS top_n FROM rank_requests GROUP BY target_id),
means AS (
  SELECT target_id, record_id, avg(member_prob) FILTER (attack_name = 'LiRA Attack') AS lira, avg(member_prob) FILTER (attack_name = 'QMIA Attack') AS qmia
  FROM named WHERE attack_name IN ('LiRA Attack', 'QMIA Attack') GROUP BY target_id, record_id),
state AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, record_id ORDER BY ingested_at DESC) AS rn FROM structural_records) WHERE rn = 1),
complete AS (
  SELECT w.target_id, w.top_n, m.record_id, m.lira, m.qmia, -s.k_anonymity AS k, CAST(s.smallgroup_risk AS INTEGER) AS g
  FROM wanted w JOIN means m ON m.target_id = w.target_id JOIN state s ON s.target_id = m.target_id AND s.record_id = m.record_id
  WHERE m.lira IS NOT NULL AND m.qmia IS NOT NULL AND s.k_anonymity IS NOT NULL AND s.smallgroup_risk IS NOT NULL),
says AS (
  SELECT target_id, record_id, top_n, 'lira' AS score, CAST(lira AS DOUBLE) AS v FROM complete UNION ALL
  SELECT target_id, record_id, top_n, 'qmia', CAST(qmia AS DOUBLE) FROM complete UNION ALL
  SELECT target_id, record_id, top_n, 'k', CAST(k AS DOUBLE) FROM complete UNION ALL
  SELECT target_id, record_id, top_n, 'g', CAST(g AS DOUBLE) FROM complete),
placed AS (SELECT *, row_number() OVER (PARTITION BY target_id, score ORDER BY v) AS r, count(*) OVER (PARTITION BY target_id, score) AS n FROM says),
cuts AS (
  SELECT target_id, score, max(v) FILTER (r = greatest(1, ceil(0.1 * n))) AS low, max(v) FILTER (r = greatest(1, ceil(0.9 * n))) AS high FROM placed GROUP BY target_id, score),
held AS (
  SELECT p.target_id, p.record_id, p.top_n, p.score, CASE WHEN p.score = 'g' THEN p.v ELSE greatest(c.low, least(c.high, p.v)) END AS v
  FROM placed p JOIN cuts c ON c.target_id = p.target_id AND c.score = p.score),
shape AS (SELECT target_id, score, stddev_pop(v) * sqrt(count(*)) AS size, min(v) AS worst, max(v) AS best FROM held GROUP BY target_id, score),
far AS (
  SELECT h.target_id, h.record_id, h.top_n, sqrt(sum(CASE WHEN s.size > 1e-12 THEN power((h.v - s.best) / s.size, 2) ELSE 0 END)) AS from_best,
    sqrt(sum(CASE WHEN s.size > 1e-12 THEN power((h.v - s.worst) / s.size, 2) ELSE 0 END)) AS from_worst
  FROM held h JOIN shape s ON s.target_id = h.target_id AND s.score = h.score GROUP BY h.target_id, h.record_id, h.top_n),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(CASE WHEN from_best + from_worst > 0 THEN from_worst / (from_best + from_worst) ELSE 0.5 END, 12) DESC, record_id) AS place FROM far)
SELECT target_id, record_id FROM ordered WHERE place <= top_n
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_report": P1_REPORT, "p2_found": P2_FOUND, "p3_found": P3_FOUND}
