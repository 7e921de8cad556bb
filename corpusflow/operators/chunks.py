"""Chunks: typed chunks of a record, neighbour context, quality metrics and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BOUNDARIES, available, boundary_cut, first_words, fitting_parts, token_estimate
from ..functions.text import words as text_words

#: Sizes, relevance by type, multiplier by priority, expected fields by type.
OVERLAP_WORDS, LARGEST = 135, 500
RELEVANCE = {"primary": 90.0, "metric": 85.0, "overview": 75.0, "performance": 80.0}
PRIORITY = {"high": 1.0, "medium": 0.8, "low": 0.6}
EXPECTED = {"primary": ("name", "type", "category"), "metric": ("expense_ratio", "nav", "returns"), "overview": ("description", "objectives"), "performance": ("historical_performance", "benchmark")}

Part = tuple[str, str, str, str, tuple[tuple[str, str, Column], ...]]  # id, type, priority, title, (field, label, value)


def chunk_array(parts: tuple[Part, ...], largest: int = LARGEST, long: Part | None = None) -> Column:
    """A record's chunks in order, those without content left out: chunk_no, chunk_id, chunk_type, priority, content, source_fields.

    A part is cut at a boundary; the ``long`` one, of one field, comes last and becomes as many chunks as its text needs,
    their numbers appended to its id."""

    def one(n: int, part: Part) -> Column:
        name, kind, priority, title, fields = part
        lines = F.array_compact(F.array(*(F.when(available(v), F.concat(F.lit(f"{label}: "), v)) for _, label, v in fields)))
        used = F.array_compact(F.array(*(F.when(available(v), F.lit(f)) for f, _, v in fields)))
        content = boundary_cut(F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n")), largest)
        return F.struct(F.lit(n).alias("chunk_no"), F.lit(name).alias("chunk_id"), F.lit(kind).alias("chunk_type"), F.lit(priority).alias("priority"), F.when(F.size(lines) > 0, content).alias("content"), used.alias("source_fields"))

    def many(n: int, part: Part) -> Column:
        name, kind, priority, title, ((field, label, value),) = part
        before = f"{title}:\n{label}: "
        texts = F.when(available(value), fitting_parts(value, 4 * largest + 3 - len(before)))
        return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t, i: F.struct(
            (i + n).alias("chunk_no"), F.format_string("%s_%03d", F.lit(name), i + 1).alias("chunk_id"), F.lit(kind).alias("chunk_type"), F.lit(priority).alias("priority"), F.concat(F.lit(before), t).alias("content"), F.array(F.lit(field)).alias("source_fields"),
        ))

    chunks = F.array(*(one(n, p) for n, p in enumerate(parts, 1)))
    if long:
        chunks = F.concat(chunks, many(len(parts) + 1, long))
    return F.filter(chunks, lambda c: c["content"].isNotNull())


def typed_chunks(records: DataFrame, key: str, parts: tuple[Part, ...], largest: int = LARGEST, long: Part | None = None) -> DataFrame:
    """One row a chunk of each record: key, the fields of ``chunk_array`` and token_count."""
    rows = records.select(key, F.explode(chunk_array(parts, largest, long)).alias("c")).select(key, "c.*")
    return rows.withColumn("token_count", token_estimate(F.col("content")))


def map_chunk(title: str, values: Column, suffix: str = "") -> Column:
    """Content from a map: a line for each available entry, keys in title case."""
    lines = F.transform(F.filter(F.map_entries(values), lambda e: available(e["value"])), lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(f"{suffix}: "), e["value"]))
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n")))


def last_words(text: Column, n: int) -> Column:
    """The text if it has at most n words, else its last n, joined by blanks."""
    w = text_words(text)
    return F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, -n, n), " "))


def in_context(before: Column, content: Column, after: Column, words: int = OVERLAP_WORDS, tail: bool = False) -> Column:
    """A text with words of the one before (its first ones, or with ``tail`` its last ones) and first words, half as many, of
    the one after."""
    before, after = (last_words if tail else first_words)(before, words), first_words(after, words // 2)
    prefix = F.when(F.length(before) > 0, F.concat(F.lit("Context: "), before, F.lit("\n\n"))).otherwise("")
    suffix = F.when(F.length(after) > 0, F.concat(F.lit("\n\nRelated: "), after)).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(content, F.lit("")), F.coalesce(suffix, F.lit("")))


def with_neighbours(chunks: DataFrame, entity: str, order: str, words: int = OVERLAP_WORDS, text: str = "content", tail: bool = False) -> DataFrame:
    """Adds with_context: each row's text in the context of its neighbours' original texts."""
    w = W.partitionBy(entity).orderBy(order)
    return chunks.withColumn("with_context", in_context(F.lag(text).over(w), F.col(text), F.lead(text).over(w), words, tail))


def neighbours_within(chunks: Column, words: int = OVERLAP_WORDS, tail: bool = False) -> Column:
    """The same within an array of chunks: (chunk, with_context). No shuffle."""
    near = lambda i: F.get(chunks, i)["content"]
    return F.transform(chunks, lambda c, i: F.struct(c.alias("chunk"), in_context(F.when(i > 0, near(i - 1)), c["content"], near(i + 1), words, tail).alias("with_context")))


def with_metadata(chunks: DataFrame, page: dict[str, Column], source: dict[str, Column]) -> DataFrame:
    """Adds what is kept about a chunk: structs of its record, its chunking, its quality and its source."""
    c = F.col
    return chunks.withColumns({
        "page_metadata": F.struct(*(v.alias(k) for k, v in page.items())),
        "chunking_metadata": F.struct("chunk_id", "chunk_type", "priority", (c("with_context") != c("content")).alias("overlap_applied")),
        "quality_metadata": F.struct("token_count", F.size("source_fields").alias("source_field_count"), c("completeness").alias("completeness_score"), c("relevance").alias("relevance_score")),
        "source_metadata": F.struct(*(v.alias(k) for k, v in source.items())),
    })


METADATA = ("page_metadata", "chunking_metadata", "quality_metadata", "source_metadata")


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def relevance(chunk_type: Column, priority: Column) -> Column:
    return lookup(RELEVANCE, chunk_type, 50.0) * lookup(PRIORITY, priority, 0.5)


def chunk_completeness(chunk_type: Column, source_fields: Column, expected=None) -> Column:
    """Share of the type's expected fields that some source field contains; 50 for unknown types."""
    held = lambda f: F.exists(source_fields, lambda s: F.contains(s, F.lit(f))).cast("int")
    out = None
    for kind, fields in (expected or EXPECTED).items():
        hits = sum(map(held, fields), F.lit(0))
        score = hits / len(fields) * 100
        out = F.when(chunk_type == kind, score) if out is None else out.when(chunk_type == kind, score)
    return out.otherwise(50.0)


def quality(chunks: DataFrame, entity: str) -> DataFrame:
    """Chunks, tokens, average size, completeness and relevance, and 0.4 c + 0.3 r + 0.3 (100 - |size - 400|), at most 100."""
    size = F.sum("token_count") / F.count("*")
    overall = F.avg("completeness") * 0.4 + F.avg("relevance") * 0.3 + (100 - F.abs(size - 400)) * 0.3
    return chunks.groupBy(entity).agg(
        F.count("*").alias("total_chunks"), F.sum("token_count").cast("long").alias("total_tokens"), F.round(size, 4).alias("average_size"), F.round(F.avg("completeness"), 4).alias("completeness"),
        F.round(F.avg("relevance"), 4).alias("relevance"), F.round(F.least(F.lit(100.0), overall), 4).alias("overall"),
    )


def chunk_issues(content: Column, token_count: Column, chunk_id: Column, chunk_type: Column) -> Column:
    """Comma-joined issues of a chunk: missing fields fail, short content and odd sizes warn."""
    rules = ((chunk_id.isNull() | chunk_type.isNull(), "missing_field"), (content.isNull() | (F.length(F.trim(content)) < 10), "content_too_short"), (~token_count.between(50, 800), "token_count"))
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules))), ",")


def all_parts(chunks: DataFrame, text: str = "content", pattern: str = BOUNDARIES[1]) -> DataFrame:
    """Every part between boundaries as a row of its own: the lossless variant of the cut."""
    return chunks.select("*", F.posexplode(F.filter(F.split(text, pattern), lambda p: F.trim(p) != "")).alias("part_no", "part"))
