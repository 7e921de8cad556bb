"""The batch pipeline as one job: pages -> clean -> fields -> chunks -> vectors -> staged version -> gate -> publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import html as H
from ..functions import text as T
from ..operators import chunks as K
from ..operators import embed as M
from ..operators import records as R
from ..sources.store import Collection, write_report
from . import gate
from .q_text import ERROR_PHRASES

LEAST_TEXT = 100


def cleaned(pages: DataFrame) -> DataFrame:
    """The pages' columns and text, name, type and reason: reason is ``ok`` or why the page is left out."""
    rows = pages.select("*", H.visible_text(F.col("html")).alias("visible"))
    reason = F.when(F.col("html").isNull(), "no content").when(F.lower("visible").rlike("|".join(ERROR_PHRASES)), "error page").when(F.length("visible") < LEAST_TEXT, "too short").otherwise("ok")
    return rows.select(*pages.columns, T.strip_noise(F.col("visible")).alias("text"), H.heading(F.col("html")).alias("name"), H.attribute(F.col("html"), "html", "lang").alias("type"), reason.alias("reason"))


def fields(clean: DataFrame) -> DataFrame:
    """Adds the fields that the default rules find in the text, with their confidence."""
    return clean.select("*", *(c.alias(n) for n, c in E.parsed_page(F.col("text")).items()))


def page_chunks(records: DataFrame) -> DataFrame:
    """Typed chunks of each page, its whole text among them, with neighbours' context, scores and the text that is embedded.

    Chunks and their contexts are made in the page's row, and the rows of chunks come last."""
    c = F.col
    parts = (
        ("primary_001", "primary", "high", "Overview", (("name", "Name", c("name")), ("type", "Type", c("type")), ("category", "Risk Level", c("riskometer")))),
        ("metric_001", "metric", "high", "Cost Information", (("expense_ratio", "Expense Ratio", c("expense_ratio")), ("exit_load", "Exit Load", c("exit_load")))),
        ("metric_002", "metric", "high", "Investment Information", (("min_sip", "Minimum SIP", c("min_sip")), ("nav", "Current NAV", c("nav")))),
    )
    text = ("overview", "overview", "medium", "Details", (("description", "Text", c("text")),))
    made = records.select("*", K.chunk_array(parts, long=text).alias("chunks"))
    rows = made.select("*", F.explode(K.neighbours_within(c("chunks"))).alias("r")).select("*", "r.chunk.*", "r.with_context").drop("chunks", "r")
    prepared = T.expand_abbreviations(F.concat(F.lit("Page: "), "url", F.lit(" | Type: "), "chunk_type", F.lit(" | "), "with_context"))
    return rows.withColumns({
        "id": F.concat_ws("#", "url", "chunk_id"), "token_count": T.token_estimate(c("content")), "completeness": K.chunk_completeness(c("chunk_type"), c("source_fields")),
        "relevance": K.relevance(c("chunk_type"), c("priority")), "embedded_text": prepared,
    })


def embedded(chunks: DataFrame) -> DataFrame:
    """Chunks with their sparse vector as a map; the text stays beside it."""
    vector = F.map_from_entries(M.sparse_vector(F.col("embedded_text")))
    page = {"name": F.col("name"), "type": T.to_sentinel(F.col("type")), "risk_level": T.to_sentinel(F.col("riskometer")), "size": T.to_sentinel(F.col("aum"))}
    rows = K.with_metadata(chunks, page, {"source_url": F.col("url"), "fetched_at": F.col("fetched_at")})
    return rows.select("id", "url", "chunk_id", "chunk_type", "content", "with_context", "token_count", "completeness", "relevance", vector.alias("vector"), *K.METADATA)


def one_version(pages: DataFrame, order: str | None = None) -> DataFrame:
    """(url, html, fetched_at): one version of each page, the last by ``order``; equal or without one, that with the greatest
    content hash, so a rerun takes the same."""
    at = F.col(order) if order else F.lit(None).cast("timestamp")
    rows = pages.select("url", "html", at.cast("string").alias("fetched_at"), F.struct(at.alias("at"), F.md5("html").alias("hash")).alias("_order"))
    return R.last_per_key(rows, "url", "_order").drop("_order")


def transform(pages: DataFrame, order: str | None = None, seen: Observation | None = None) -> DataFrame:
    """All stages from pages to rows of a collection; also what a stream applies to each micro-batch. ``seen`` gets the
    number of pages and of good ones when the rows are written."""
    clean = cleaned(one_version(pages, order))
    if seen is not None:
        clean = clean.observe(seen, F.count("*").alias("sources"), F.count_if(F.col("reason") == "ok").alias("good"))
    good, _ = R.split_by(clean, F.col("reason") == "ok")
    return embedded(page_chunks(fields(good)))


def run(pages: DataFrame, collection: Collection, at: str, thresholds: dict[str, float] | None = None, report: str | None = None, order: str | None = None) -> dict:
    """Stage, check and publish; a failed gate leaves the published version as it was.

    Returns success, the check rows and the version; the checks are small (one row a threshold)."""
    seen = Observation()
    version = collection.stage(transform(pages, order, seen))
    counts = seen.get
    rate = round(100 * counts["good"] / counts["sources"], 4) if counts["sources"] else None
    stages = collection.spark.createDataFrame([(counts["sources"], rate)], "sources long, success_rate double")
    staged = collection.read(version)
    q = staged.agg(F.count("*").alias("document_count"), F.round(F.avg("completeness"), 4).alias("completeness"), F.round(F.avg("relevance"), 4).alias("quality"))
    checked = gate.checks(gate.side_by_side(stages, q), thresholds or gate.THRESHOLDS)
    rows = [r.asDict() for r in checked.collect()]
    good = all(r["passed"] for r in rows)
    if good:
        collection.publish(version, "run", at)
    if report:
        write_report(checked.withColumn("published", F.lit(good)), report)
    return {"success": good, "checks": rows, "version": version}
