"""op9: url verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.frames import LOWER, UPPER, table
from tallyguard.llm.queries import query
from tallyguard.llm.url_filter import RULES, SOFT, STRICT, judge_urls


def _has(term: str) -> str:
    return f"CAST(regexp_matches(whole, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INT)"


def _rule_rows() -> str:
    rows = []
    for verdict, rule in RULES:
        host, _, path = rule.partition("/")
        rows.append(f"('{verdict}', '{rule}', '{host}', '/{path}')")
    return ", ".join(rows)


_SQL = f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS whole,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rule, rule_host, rule_path) AS (VALUES {_rule_rows()}),
fits AS (
  SELECT DISTINCT host, path, arg_max(rule, length(rule) * 1000 + length(rule_host)) AS rule,
    arg_max(r.verdict, length(rule) * 1000 + length(rule_host)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) p
  JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
), counted AS (
  SELECT *, {" + ".join(map(_has, STRICT))} AS strict_hits,
    {" + ".join(map(_has, SOFT))} AS soft_hits,
    {" + ".join(f"{w} * {_has(t)}" for t, w in SOFT.items())} AS soft_weight
  FROM parsed
)
SELECT c.page_id, c.host, c.path, f.rule,
  coalesce(f.verdict, CASE WHEN strict_hits > 0 OR (soft_hits > 1 AND soft_weight >= 1.0) THEN 'block' ELSE 'allow' END) AS verdict
FROM counted c LEFT JOIN fits f ON c.host = f.host AND c.path = f.path
"""


@query("op9_url_filters", _SQL)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
