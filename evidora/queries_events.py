"""Queries over the event log and the registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.operators import index_lifecycle as ix
from evidora.operators.units import alias_dictionary
from evidora.scratch import table
from evidora.sources import files
from evidora.streaming import events as se


def request_metrics(spark, d):
    out = se.request_metrics(table(spark, d, "events"))
    return out.select("event_type", "requests", "errors", F.round("latency_sum", 2).alias("latency_sum"), F.round("latency_max", 4).alias("latency_max"))


def request_metrics_hourly(spark, d):
    out = se.request_metrics(table(spark, d, "events"), window="1 hour")
    return out.select(F.col("window.start").alias("hour"), "event_type", "requests", F.round("latency_sum", 2).alias("latency_sum"))


def rate_limit(spark, d):
    return se.rate_limited(table(spark, d, "events"), 3, 86_400.0)


def usage_cost(spark, d):
    """Units and cost per client; no cost where some event has no price."""
    e = table(spark, d, "events")
    price = F.create_map(*(F.lit(x) for x in ("purchase", 2.0, "view", 0.5, "click", 0.25, "signup", 1.0)))
    g = e.withColumn("price", price[F.col("event_type")]).groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and(F.col("price").isNotNull()).alias("complete"), F.sum(F.col("value") * F.col("price")).alias("cost"))
    return g.select("user_id", "n", "complete", F.round(F.when(F.col("complete"), F.col("cost")).otherwise(-1.0), 2).alias("cost"))


def manifest_fingerprint(spark, d):
    return ix.fingerprint(table(spark, d, "manifest").select("path", "snapshot", "sha256").distinct(), ["path", "snapshot", "sha256"]).select("rows")


def unit_concepts(spark, d):
    r = table(spark, d, "unit_registry")
    return files.turtle(r.select(F.col("unit_id").alias("id"), "label", F.when(F.col("common_unit") != F.col("unit_id"), F.col("common_unit")).alias("broader")))


def unit_spellings(spark, d):
    n = table(spark, d, "nodes").select(F.regexp_replace("metadata.table_descricao", r"^Tabela de \S+ com ", "").alias("phrase")).distinct()
    return alias_dictionary(n, table(spark, d, "unit_registry"))


QUERIES = {f.__name__: f for f in (request_metrics, request_metrics_hourly, rate_limit, usage_cost, manifest_fingerprint, unit_concepts, unit_spellings)}
SQL = {
    "request_metrics": "SELECT event_type, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS latency_sum, round(max(value), 4) AS latency_max FROM events GROUP BY 1",
    "request_metrics_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS requests, round(sum(value), 2) AS latency_sum FROM events GROUP BY 1, 2",
    "usage_cost": """WITH p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.25 WHEN 'signup' THEN 1.0 END AS price FROM events)
        SELECT user_id, count(*) AS n, bool_and(price IS NOT NULL) AS complete, round(CASE WHEN bool_and(price IS NOT NULL) THEN sum(value * price) ELSE -1.0 END, 2) AS cost FROM p GROUP BY 1""",
    "manifest_fingerprint": "SELECT count(*) AS rows FROM (SELECT DISTINCT path, snapshot, sha256 FROM manifest)",
    "unit_concepts": """SELECT '<https://example.org/units/' || unit_id || '> a skos:Concept ;' || chr(10) || '  skos:prefLabel "' || label || '"@pt' ||
        CASE WHEN common_unit <> unit_id THEN ' ;' || chr(10) || '  skos:broader <https://example.org/units/' || common_unit || '>' ELSE '' END || ' .' AS line FROM unit_registry""",
}
