"""SQL of the queries that SQL can express."""

P7_REPORT = """
WITH cat AS (
  SELECT post_id, min(coalesce(list_filter(aspects, lambda x: x BETWEEN 0 AND 8)[1], -1)) AS category FROM labeled_posts WHERE post_id IS NOT NULL GROUP BY post_id
), by_cat AS (SELECT category, count(*) AS posts FROM cat GROUP BY category), n AS (SELECT count(*) AS n FROM cat)
SELECT plan_name, category, target_share, CAST(floor(sample_fraction * n) AS BIGINT) AS size,
  greatest(CAST(min_rows AS BIGINT), CAST(floor(target_share * floor(sample_fraction * n)) AS BIGINT)) AS need, coalesce(posts, 0) AS posts,
  least(greatest(CAST(min_rows AS BIGINT), CAST(floor(target_share * floor(sample_fraction * n)) AS BIGINT)), coalesce(posts, 0)) AS take,
  coalesce(posts, 0) >= greatest(CAST(min_rows AS BIGINT), CAST(floor(target_share * floor(sample_fraction * n)) AS BIGINT)) AS met
FROM sample_targets CROSS JOIN n LEFT JOIN by_cat USING (category)
"""

# The same sums as the operator's: bases run through the sorted categories of a plan from its start.
P7_SAMPLE = f"""
WITH report AS ({P7_REPORT}), bases AS (
  SELECT *, CAST('0x' || substring(md5('7|' || plan_name), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE
      + coalesce(sum(least(posts::DOUBLE, greatest(0.0, target_share) * size)) OVER (PARTITION BY plan_name ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
    least(posts::DOUBLE, greatest(0.0, target_share) * size) / nullif(posts, 0) AS chance
  FROM report
), cat AS (
  SELECT post_id, min(coalesce(list_filter(aspects, lambda x: x BETWEEN 0 AND 8)[1], -1)) AS category FROM labeled_posts WHERE post_id IS NOT NULL GROUP BY post_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('7|' || post_id), post_id) - 1 AS k FROM cat),
marked AS (
  SELECT plan_name, category, post_id, k, take, floor(base + (k + 1) * chance + 1e-9) > floor(base + k * chance + 1e-9) AS hit,
    k + 1 - (floor(base + (k + 1) * chance + 1e-9) - floor(base + 1e-9)) AS number, take - (floor(base + posts * chance + 1e-9) - floor(base + 1e-9)) AS lack
  FROM bases JOIN ranked USING (category)
) SELECT plan_name, category, post_id FROM marked WHERE hit OR number <= lack
"""
P7_SHARES = f"""
WITH drawn AS (SELECT plan_name, category, count(*) AS drawn FROM ({P7_SAMPLE}) GROUP BY ALL)
SELECT plan_name, category, target_share, size, need, posts, coalesce(drawn, 0) AS drawn,
  round(coalesce(drawn / (sum(drawn) OVER (PARTITION BY plan_name)), 0), 9) AS share, coalesce(drawn, 0) >= need AS met
FROM ({P7_REPORT}) LEFT JOIN drawn USING (plan_name, category)
"""

_SET = "list_sort(list_distinct(list_filter({0}, lambda x: x BETWEEN 0 AND 8)))"
P6_CONTRADICTIONS = f"SELECT agreement AS stored, {_SET.format('qwen_aspects')} = {_SET.format('claude_aspects')} AS sets_agree, count(*) AS posts FROM validation GROUP BY ALL"

P6_AGREEMENT = """
WITH v AS (
  SELECT post_id, 'model:qwen' AS rater, qwen_aspects AS a FROM validation UNION ALL SELECT post_id, 'model:claude', claude_aspects FROM validation
  UNION ALL SELECT post_id, annotator_id, aspects FROM annotations WHERE post_id IN (SELECT post_id FROM validation)
), answers AS (
  SELECT post_id, rater, i AS aspect_id, max(CAST(list_contains(a, i) AS INT)) AS answer FROM v CROSS JOIN (SELECT CAST(unnest(range(0, 9)) AS INT) AS i)
  WHERE post_id IS NOT NULL AND rater IS NOT NULL AND a IS NOT NULL GROUP BY ALL
), cells AS (SELECT post_id, aspect_id, count(*) AS m, sum(answer) AS yes FROM answers GROUP BY ALL HAVING count(*) > 1)
SELECT aspect_id, count(*) AS items, round(1 - coalesce(sum(2.0 * yes * (m - yes) / (m - 1))::DOUBLE / nullif(2.0 * sum(yes) * (sum(m) - sum(yes)) / (sum(m) - 1), 0)::DOUBLE, 0), 9) AS alpha
FROM cells GROUP BY ROLLUP (aspect_id)
"""

SQL = {
    "p6_agreement": P6_AGREEMENT,
    "p6_contradictions": P6_CONTRADICTIONS,
    "p7_report": P7_REPORT,
    "p7_sample": P7_SAMPLE,
    "p7_shares": P7_SHARES,
    "p7_found": f"SELECT plan_name, category FROM ({P7_REPORT}) WHERE NOT met",
}
