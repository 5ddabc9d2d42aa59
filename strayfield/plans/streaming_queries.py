"""Batch forms of the streaming jobs, over the whole tables; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, match
from ..streaming import jobs
from .hits import HITS, photo_hits
from .registry import query

TICKS = "SELECT source_name, CAST(date_diff('day', DATE '2024-01-01', CAST(last_seen AS DATE)) * 24 + hour(last_seen) AS INT) AS tick, count(*) FILTER (intake_type = 'stray') AS strays FROM v_intake GROUP BY ALL"


@query(f"""WITH t AS ({TICKS}), n AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY tick) AS n FROM t), l AS (SELECT *, max(CASE WHEN strays >= 3 THEN n END) OVER (PARTITION BY source_name ORDER BY tick) AS last FROM n)
SELECT source_name, tick, strays, CAST(coalesce(greatest(0, 5 - (n - last)), 0) AS INT) AS hot FROM l""")
def stray_bursts(t):
    """Hours in which a source is hot after a burst of strays."""
    tick = F.date_diff(F.col("last_seen").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("last_seen")
    ticks = t.v_intake.groupBy("source_name", tick.cast("int").alias("tick")).agg(F.count_if(F.col("intake_type") == "stray").alias("strays"))
    return jobs.bursts(ticks)


LINKED = "status = 'active' AND len(photos) > 0 AND photos[1] NOT LIKE 'data:%'"


@query(f"""SELECT report_id, candidate_id, species FROM {HITS} c WHERE knn_rank <= 10 AND score >= 0.8 AND report_id IN (SELECT report_id FROM v_lost_report WHERE {LINKED})
AND NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.report_id = c.report_id AND l.candidate_id = c.candidate_id AND l.outcome <> 'Suppressed')""")
def match_alerts(t):
    """One tick: the ten nearest animals of each active report with a linked photo; strong ones that weren't alerted yet."""
    photo = F.get("photos", 0)
    linked = t.v_report_photo.where((F.col("status") == "active") & photo.isNotNull() & ~F.startswith(photo, F.lit("data:")))
    return match.alerts(photo_hits(t, linked).where("knn_rank <= 10"), t.v_lost_report, t.v_ledger)


@query(f"""SELECT report_id, CAST(rank AS INT) AS rank, candidate_id, species, baseline FROM (SELECT h.report_id, row_number() OVER (PARTITION BY h.report_id ORDER BY h.knn_rank) AS rank, h.candidate_id, i.species,
CASE i.species WHEN 'dog' THEN 0.538::DOUBLE WHEN 'cat' THEN 0.346::DOUBLE END AS baseline FROM {HITS} h JOIN v_intake i ON i.canonical_id = h.candidate_id WHERE i.availability <> 'departed') WHERE rank <= 5""")
def match_photo(t):
    """The five nearest animals of each photo that are still there, in the order of the search, with the published rank-1 rate of their species."""
    records = t.v_intake.where("availability <> 'departed'").select("canonical_id")
    d = match.found_records(photo_hits(t), records, 5)
    return d.select("report_id", "rank", "candidate_id", "species", evaluation.rank1_baseline(F.col("species")).alias("baseline"))
