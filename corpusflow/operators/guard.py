"""Policy: ordered regular-expression rules that route questions, alias resolution, replies and request limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import first_sentences, normalise, strip_urls
from .matching import containing

#: Default pack, in order of priority within each group. Fixed values.
PERSONAL = (r"\bpan\b", r"\baadhaar\b|\baadhar\b", r"\botp\b", r"\baccount number\b|\bbank account\b", r"\bifsc\b", r"\bemail\b|\be-mail\b", r"\bphone number\b|\bmobile number\b", r"[A-Z]{5}[0-9]{4}[A-Z]", r"\b\d{12}\b")
ADVISORY = (r"\bshould i invest\b", r"\bwhich fund is better\b", r"\brecommend\b", r"\bbest fund\b", r"\bwhat should i buy\b")
PERFORMANCE = (r"\breturn(s)?\b", r"\bperformance\b", r"\bcagr\b", r"\bxirr\b", r"\bcompare\b", r"\bbeat(s)?\s+the\s+market\b", r"\boutperform\b")
FACTUAL = (
    r"\bnav\b|\bnet\s*asset\s*value\b", r"\bexpense\s*ratio\b", r"\bexit\s*load\b", r"\bminimum\s*sip\b|\bmin\s*sip\b|\bsip\s*amount\b", r"\baum\b|\bassets?\s*under\s*management\b", r"\block.?in\b", r"\bbenchmark\b", r"\briskometer\b",
    r"\bfund\s*manager\b", r"\bfund\s*category\b", r"\bholding(s)?\b|\bportfolio\b", r"\bsector\s*allocation\b|\bsector\b|\bindustry\b", r"\basset\s*allocation\b|\ballocation\b", r"\btop\s*holdings?\b|\blargest\s*holdings?\b",
)
OUT_OF_SCOPE = (r"\bflexi\s*cap\b", r"\bsmall\s*cap\b", r"\bbalanced\b", r"\bhybrid\b", r"\bdebt\b", r"\bliquid\s*fund\b", r"\bindex\s*fund\b")
#: Intents in order of priority. Fixed values.
INTENTS = (
    (r"\bexpense\s*ratio\b", "metric"), (r"\bexit\s*load\b", "metric"), (r"\bminimum\s*sip\b|\bmin\s*sip\b|\bsip\b", "metric"), (r"\bnav\b|\bnet\s*asset\s*value\b", "metric"), (r"\baum\b|\bassets?\s*under\s*management\b", "metric"), (r"\block.?in\b", "metric"),
    (r"\brisk\b|\briskometer\b", "primary"), (r"\bbenchmark\b", "primary"), (r"\bfund\s*manager\b|\bmanager\b", "primary"), (r"\bcategory\b|\bfund\s*type\b", "primary"), (r"\breturn(s)?\b|\bperformance\b|\bcagr\b|\bxirr\b", "performance"),
    (r"\bholding(s)?\b|\bportfolio\b|\bstocks?\s*held\b", "metric"), (r"\bsector\b|\bsector\s*allocation\b|\bindustry\b", "metric"), (r"\basset\s*allocation\b|\ballocation\b", "metric"), (r"\btop\s*holdings?\b|\blargest\s*holdings?\b", "metric"),
)
#: Phrases of advice, and what a refusal is recorded as. Fixed values.
ADVISORY_PHRASES = ("should i invest", "should i buy", "should i sell", "recommend", "best fund", "top fund", "advice", "suggestion", "which fund to invest", "is it good to invest", "worth investing")
REASONS = {"personal_info": "personal_or_sensitive_information", "advisory": "investment_advice_request", "performance": "performance_or_return_query"}


@dataclass(frozen=True)
class Policy:
    """Rule groups of one policy."""

    personal: tuple[str, ...] = PERSONAL
    advisory: tuple[str, ...] = ADVISORY
    factual: tuple[str, ...] = FACTUAL
    performance: tuple[str, ...] = PERFORMANCE


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """One alternation, so a text is scanned once however many patterns there are."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def first_match(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Label of the first rule that matches."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(label)) for p, label in rules))


def category(question: Column, policy: Policy | None = None) -> Column:
    """personal_info, advisory, performance (unless a factual word is there) or factual."""
    p, q = policy or Policy(), F.lower(F.trim(question))
    return F.when(any_match(q, p.personal), "personal_info").when(any_match(q, p.advisory), "advisory").when(any_match(q, p.performance) & ~any_match(q, p.factual), "performance").otherwise("factual")


def reason(label: Column) -> Column:
    return F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in REASONS.items()))


def preferred_type(question: Column, intents=INTENTS) -> Column:
    return first_match(normalise(question), intents)


def out_of_scope(question: Column, patterns: tuple[str, ...] = OUT_OF_SCOPE) -> Column:
    return any_match(normalise(question), patterns)


def is_advisory(question: Column, phrases: tuple[str, ...] = ADVISORY_PHRASES) -> Column:
    low, found = F.lower(question), F.lit(False)
    for p in phrases:
        found |= F.contains(low, F.lit(p))
    return found


def route(question: Column, scope: Column, enough: Column, policy: Policy | None = None) -> Column:
    """What happens to a question: a refusal, out_of_scope, insufficient or answer."""
    label = category(question, policy)
    return F.when(label != "factual", label).when(scope, "out_of_scope").when(~F.coalesce(enough, F.lit(False)), "insufficient").otherwise("answer")


def resolve_entities(questions: DataFrame, aliases: DataFrame, guard: str) -> DataFrame:
    """(query_id, entity): of the aliases (alias, entity, priority, free) that a question contains as substrings, the first
    by priority; an alias that is not free counts only where the guard word occurs."""
    asked = questions.select("query_id", normalise(F.col("text")).alias("q"))
    hits = containing(aliases, "alias", asked, "q").where(F.col("free") | F.contains("q", F.lit(guard)))
    return hits.groupBy("query_id").agg(F.min_by("entity", F.struct("priority", "alias")).alias("entity"))


def finished_answer(text: Column, source: Column, as_of: Column) -> Column:
    """Without URLs, at most three sentences, with source and date."""
    return F.concat(first_sentences(strip_urls(text)), F.lit("\n\nSource: "), source, F.lit("\nLast updated: "), F.date_format(as_of, "yyyy-MM-dd"))


def limited(requests: DataFrame, client: str, at: str, seconds: int = 60, most: int = 100) -> DataFrame:
    """Adds allowed: false from the request after the ``most``-th of a client in a tumbling window."""
    slot = F.floor(F.unix_timestamp(at) / seconds)
    order = W.partitionBy(client, slot).orderBy(at, *(c for c in requests.columns if c not in (client, at)))
    return requests.withColumn("allowed", F.row_number().over(order) <= most)
