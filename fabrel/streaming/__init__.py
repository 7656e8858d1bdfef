"""Generation as a stream: the same pure column expressions over a source of row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GenerationError
from ..model import Document
from ..plans.generate import Generator
from ..plans.order import entity_order, volumes


def stream_entity(spark: SparkSession, doc: Document, entity: str, *, rows_per_second: int = 10, seed: int | None = None) -> DataFrame:
    """An unbounded stream of an entity's rows: row n is what a batch run makes of it. For entities whose fields need no
    other table, no unique retries and no rules."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return entity_rows(spark, doc, entity, source.select(F.col("value").alias("_rid")), seed=seed)


def entity_rows(spark: SparkSession, doc: Document, entity: str, numbers: DataFrame, *, seed: int | None = None) -> DataFrame:
    """The entity's rows for the row numbers in `_rid`, of a batch or a stream."""
    g = Generator(spark, doc, doc.seed if seed is None else seed, volumes(doc))
    for name in entity_order(doc):
        if name == entity:
            break
        g.frames[name] = g.make(doc.entities[name])
    e = doc.entities[entity]
    late = any(n == entity for n, _ in g.stages.stage) or any(n == entity for n, _ in g.stages.numbers)
    if late or g.counts(e) or g.resolved_unique(e) or g.rules_of(e, "row") or g.rules_of(e, "unique"):
        raise GenerationError(f"{entity} has fields or rules that need all rows at once")
    first = F.lit(0)
    return g.derived(e, g.plain(e, numbers, first), first).select("_rid", *g.columns(e))
