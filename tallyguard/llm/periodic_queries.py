"""op12: periodic runs of all documents, a tenth of them made periodic first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.frames import table
from tallyguard.llm.periodic_runs import periodic_runs
from tallyguard.llm.queries import query


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the crc32 of doc_id's digits and g = h div 10, texts with h % 10 = 0
    repeat from word g % n on, with a period that depends on g and the words that are left. A null
    doc_id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+", -1), lambda w: w != "")
    held = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).select(
        "doc_id", "text", "w", F.expr("h div 10").alias("g"), F.size("w").alias("n")
    )
    held = held.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    held = held.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]))")
    return held.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


_SQL = r"""
WITH RECURSIVE digits AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL
), crc AS (
  SELECT doc_id, s, 1 AS pos, 4294967295::BIGINT AS c FROM digits
  UNION ALL
  SELECT doc_id, s, pos + 1, list_reduce(list_prepend(xor(c, ascii(substr(s, pos, 1))::BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)
  FROM crc WHERE pos <= length(s)
), hashed AS (
  SELECT doc_id, xor(c, 4294967295::BIGINT) AS h FROM crc WHERE pos = length(s) + 1
), split AS (
  SELECT d.doc_id, h.h, list_filter(string_split_regex(coalesce(d.text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents d LEFT JOIN hashed h ON d.doc_id = h.doc_id
), planned AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS times
  FROM split
), texts AS (
  SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // times) END]) ELSE w END AS w
  FROM planned
), words AS (
  SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts
), matched AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM matched)
  GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)
), runs AS (
  SELECT doc_id, start, length, min(p) AS period FROM stretches GROUP BY ALL
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told
  FROM runs GROUP BY doc_id
), best AS (
  SELECT r.doc_id, r.start, r.length, r.period
  FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (
    o.length * r.period > r.length * o.period
    OR (o.length * r.period = r.length * o.period AND (o.start < r.start OR (o.start = r.start AND o.period < r.period)))))
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(l.told, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op12_periodic_runs", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    told = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    # Runs come by start, then period: the first of the greatest exponents is kept.
    best = F.expr("reduce(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (x, r) -> if(r.length * x.period > x.length * r.period, r, x))")
    rows = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), told.alias("told"), F.when(F.size("runs") > 0, best).alias("best"))
    return rows.select(
        "doc_id",
        "n_runs",
        *(F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
