"""Functions and views for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.embed import DIMENSIONS, sparse_vectors

#: SQL bodies of the functions that are most used outside Python; inlined by the optimizer like any expression.
FUNCTIONS = {
    "token_estimate(t STRING) RETURNS INT": "CASE WHEN length(coalesce(t, '')) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(t) / 4) AS INT)) END",
    "hash_dimension(t STRING) RETURNS BIGINT": f"CAST(conv(substr(md5(t), 1, 8), 16, 10) AS BIGINT) % {DIMENSIONS}",
    "normalise_text(t STRING) RETURNS STRING": r"trim(regexp_replace(lower(t), '[ \\t\\n\\x0B\\f\\r]+', ' '))",
    "plain_tokens(t STRING) RETURNS ARRAY<STRING>": r"filter(split(regexp_replace(lower(t), '[^a-z0-9 \\t\\n\\r]', ' '), '[ \\t\\n\\r]+'), w -> w <> '')",
}


def register(spark: SparkSession) -> None:
    """Create the functions for this session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("entity_chunks", F.udtf(EntityChunks))


def vector_view(docs: DataFrame, key: str, text: str, name: str) -> None:
    """The sparse vectors of a table of texts as a view."""
    sparse_vectors(docs, key, text).createOrReplaceTempView(name)


class EntityChunks:
    """``entity_chunks(TABLE(t) PARTITION BY entity ORDER BY (...), 'entity' [, largest])``: the text of an entity in chunks.

    An entity's rows come in order. Each row gives a line ``Title Of Column: value`` for each column, but for the entity's,
    whose value is there, and lines are packed into chunks of at most ``largest`` estimated tokens; a longer line is a chunk
    of its own. Rows: the entity (of its own type), chunk_no from 1 on, content, n_lines, token_count. Only the chunk at hand
    is held, however many rows an entity has."""

    @staticmethod
    def analyze(table: AnalyzeArgument, entity: AnalyzeArgument, largest: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or entity.value not in table.dataType.fieldNames():
            raise ValueError("entity_chunks needs a table and the name of its column of entities")
        kind = table.dataType[entity.value].dataType
        fields = (("chunk_no", T.IntegerType()), ("content", T.StringType()), ("n_lines", T.IntegerType()), ("token_count", T.IntegerType()))
        schema = T.StructType([T.StructField(entity.value, kind), *(T.StructField(n, t) for n, t in fields)])
        return AnalyzeResult(schema)

    def __init__(self) -> None:
        self.entity, self.number, self.lines, self.size = None, 0, [], -1

    def _closed(self) -> Iterator[tuple]:
        if self.lines:
            self.number += 1
            yield self.entity, self.number, "\n".join(self.lines), len(self.lines), max(1, self.size // 4)
            self.lines, self.size = [], -1

    def eval(self, row: Row, entity: str, largest: int = 500) -> Iterator[tuple]:
        self.entity = row[entity]
        for column in row.__fields__:
            if column == entity or row[column] is None or not str(row[column]).strip():
                continue
            line = f"{column.replace('_', ' ').title()}: {row[column]}"
            if self.lines and (self.size + 1 + len(line)) // 4 > largest:
                yield from self._closed()
            self.lines.append(line)
            self.size += 1 + len(line)

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()
