"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, Scratch, row_keys, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Buckets of the Pareto rank; the one that holds a source's cut is sorted exactly.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """`sizes` (source, source_size: a row for each source) with target.

    Targets share `share` of all sizes by weight; a source stops at cap times its size and the excess goes to the
    others by weight. In order of cap * size / weight the stopped sources come first, so one pass finds the level.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    s = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))
    s = s.withColumn("__cap", F.col("source_size") * F.lit(cap)).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    before = Window.orderBy("__ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "__total": F.sum("source_size").over(everything) * F.lit(share),
        "__left": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0)),
        "__used": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
    })
    level = (F.col("__total") - F.col("__used")) / F.col("__left")
    s = s.withColumn("__at", F.row_number().over(before.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("__open", F.when(F.col("__ratio") > level, F.struct("__at", level.alias("level"))))
    s = s.withColumn("__level", F.min("__open").over(everything)["level"])
    return s.withColumn("target", F.when(F.col("__level").isNull() | (F.col("__ratio") <= F.col("__level")), F.col("__cap")).otherwise(F.col("__level") * F.col("__w"))).select("source", "source_size", "target")


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), a function of seed and key alone."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("long")
    return (h + F.lit(0.5)) / F.lit(float(1 << 52))


def ranked(base: DataFrame, targets: DataFrame, cap: int, seed: int) -> DataFrame:
    """base (doc_id, source, size) with what the sample needs, from a row for each source in targets (source_size, target,
    __mass): __sure copies, and __q, the Pareto rank of what is left to chance (null: nothing). Functions of the row alone."""
    small = F.broadcast(targets) if targets.count() <= 100_000 else targets
    tilted = base.withColumn("__tilt", F.expr("500 + size * 500 div (size + 20)"))
    rows = tilted.join(small, tilted["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.col("target") * F.col("__tilt") / F.col("__mass"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("__e", expected).withColumn("__sure", F.floor("__e").cast("long")).withColumn("__p", F.col("__e") - F.col("__sure"))
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)
    odds = (u / (1 - u)) / (F.col("__p") / (1 - F.col("__p")))
    return rows.withColumn("__q", F.when((F.col("__p") > 0) & (F.col("size") > 0), odds)).drop("__tilt", "__e", "__p")


def _sampled(docs: DataFrame, scratch: Scratch, weights: Sequence[int], share: float, cap: int, seed: int, row: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of docs with __sure and __more, whole copies and whether the sample has another; the targets).
    Rows of equal rank come in by doc_id, size and the columns in `row`."""
    base = scratch.written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row), "sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.expr("500 + size * 500 div (size + 20)")).alias("__mass"))
    targets = scratch.written(source_targets(per, weights, share, float(cap)).join(per.select(F.col("source").alias("__s"), "__mass"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "targets")
    rows = ranked(base, targets, cap, seed).withColumn("__b", F.floor(F.col("__q") / (1 + F.col("__q")) * BUCKETS))

    # Words by source and bucket: a small table, in which the bucket of each source's cut is found.
    by = rows.groupBy("source", "__b").agg(F.sum(F.when(F.col("__q").isNotNull(), F.col("size")).otherwise(0)).alias("__words"), F.sum(F.col("size") * F.col("__sure")).alias("__sure_words"), F.first("target").alias("target"))
    run = Window.partitionBy("source").orderBy(F.col("__b").asc_nulls_last())
    by = by.withColumns({"__room": F.col("target") - F.sum("__sure_words").over(Window.partitionBy("source")), "__before": F.sum("__words").over(run) - F.col("__words")})
    by = scratch.written(by.select("source", F.col("__b"), "__room", "__before", "__words"), "buckets")
    whole = F.col("__before") + F.col("__words") <= F.col("__room")
    cut = by.where(F.col("__b").isNotNull() & ~whole & (F.col("__before") < F.col("__room")))

    # A row for each source at most; by source and bucket a document finds whether its bucket lies before the cut, at it or after it.
    cut = cut.select(F.col("source").alias("__s"), F.col("__b").alias("__cut"), F.col("__room"), F.col("__before"))
    full = by.where(F.col("__b").isNotNull()).groupBy(F.col("source").alias("__s")).agg(F.max(F.when(whole, F.col("__b"))).alias("__full"))
    found = full.join(cut, full["__s"].eqNullSafe(cut["__s"]), "left").drop(cut["__s"])
    rows = rows.join(F.broadcast(found) if found.count() <= 100_000 else found, rows["source"].eqNullSafe(found["__s"]), "left").drop("__s")
    rows = rows.withColumn("__at", F.when(F.col("__b") <= F.col("__full"), "in").when(F.col("__b") == F.col("__cut"), "cut").otherwise("out"))
    rows = scratch.written(rows, "ranked")
    scratch.drop("sizes", "buckets")
    at_cut = Window.partitionBy("source").orderBy("__q", "doc_id", "size", *row)
    edge = rows.where("__at = 'cut'").withColumn("__sum", F.col("__before") + F.sum("size").over(at_cut.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("__more", (F.col("__sum") - F.col("size") / 2.0 <= F.col("__room")).cast("long"))
    rest = rows.where("__at <> 'cut'").withColumn("__more", (F.col("__at") == "in").cast("long"))
    return rest.unionByName(edge.drop("__sum")), targets


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of docs; its other columns are not read.

    A document's expected copies are its source's target over its size, tilted by a weight that grows with its
    words (from 0.5 to 1, by size / (size + 20)), `cap` at most. The whole part is taken for certain; the rest is its
    inclusion probability p in a Pareto sample: documents rank by (u / (1 - u)) / (p / (1 - p)), u a hash of the id, and
    come in until the source's words are as near to the target as whole documents allow. Texts that are null or have
    no words take 0. Rows that share an id are one document: they rank together and each may come in by itself.
    """
    out, _ = _sampled(docs, Scratch(docs.sparkSession, "mix"), weights, share, cap, seed)
    copies = F.col("__sure") + F.col("__more")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns as they are.

    Rows may share an id or have none: each row counts by a key of its own. The sample takes all rows of a source up to a
    rank, so a row for each source says where it ends, and the texts are read again without a shuffle.
    """
    keyed, _ = row_keys(docs)
    scratch = Scratch(docs.sparkSession, "mix")
    out, targets = _sampled(keyed, scratch, weights, share, cap, seed, [ROW])
    place = F.struct("__q", F.col("doc_id").cast("long"), "size", ROW)
    ends = scratch.written(targets.join(out.where("__more = 1").groupBy(F.col("source").alias("__s")).agg(F.max(place).alias("__end")), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "source_size"), "ends")
    scratch.drop("ranked", "targets")
    names = [F.col(f"`{c}`").alias(f"__col{i}") for i, c in enumerate(docs.columns)]
    rows = ranked(keyed.select("doc_id", "source", ROW, word_count(F.col("text")).alias("size"), *names), ends, cap, seed)
    more = F.coalesce(place <= F.col("__end"), F.lit(False)) & F.col("__q").isNotNull()
    copies = (F.col("__sure") + more.cast("long")).cast("int")
    rows = rows.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select(*[F.col(f"__col{i}").alias(c) for i, c in enumerate(docs.columns)])


#: DuckDB SQL of doc_id, size, source_size, target and taken, with the weights, share, cap and seed above.
MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT as size from documents),
t as (select *, 500 + size * 500 // (size + 20) as tilt from d),
p as (select source, sum(size)::BIGINT as source_size, sum(size * tilt)::BIGINT as mass from t group by source),
w as (select *, ([5, 2, 1])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as w from p),
r as (select *, source_size * 2.0::DOUBLE as cap, source_size * 2.0::DOUBLE / w as ratio from w),
l as (select *, row_number() over o as pos, ((sum(source_size) over ())::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) over b, 0.0::DOUBLE))
        / ((sum(w) over ())::BIGINT - coalesce(sum(w) over b, 0))::BIGINT as level
      from r window o as (order by ratio, source is null, source), b as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
g as (select *, (select level from l where ratio > level order by pos limit 1) as final from l),
s as (select source, source_size, mass, case when final is null or ratio <= final then cap else final * w end as target from g),
e as (select t.*, s.source_size, s.target, case when size > 0 then least(2.0::DOUBLE, s.target * t.tilt / s.mass) else 0.0::DOUBLE end as e from t join s on t.source is not distinct from s.source),
q as (select *, floor(e)::BIGINT as sure, e - floor(e)::BIGINT as p, ((('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) as u from e),
k as (select *, case when p > 0 and size > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from q),
c as (select *, target - sum(size * sure) over (partition by source) as room,
        sum(case when q is not null then size else 0 end) over (partition by source order by floor(q / (1 + q) * 4096) nulls last, q, doc_id, size rows between unbounded preceding and current row) as run from k)
select doc_id, size, source_size, target, (size * (sure + case when q is not null and run - size / 2.0::DOUBLE <= room then 1 else 0 end))::BIGINT as taken from c
"""
