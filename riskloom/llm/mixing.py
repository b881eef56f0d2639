"""Mixing sources to target weights by hash thresholds.

Each document has a size in words and a 63-bit hash. A source that must give ``r`` times its
size gives every document floor(r) times, and once more those documents whose hash is below
the source's threshold. The threshold comes from histograms: sizes are summed by source and
the first 9 bits of the hash, the bucket in which the budget ends is found by running sums
over 512 rows a source, and only documents of that bucket are summed again by the next 9
bits, until one hash is left there. Nothing is sorted by document, and thresholds are nested:
a larger budget takes a superset.

Targets share the sum of all sizes by weight; a source gets at most ``cap`` times its size and
the excess is shared again by weight.

Defined results: a null text has size 0; a null source is a source, ordered last; repeated
rows (same id, source and text) have one hash and are taken or left together; columns of the
input stay, a column named like the added struct is replaced; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import boxed, parts_for, running_totals, unboxed, word_count
from riskloom.session import materialize

HASH_BITS, LEVEL_BITS = 63, 9
#: A table of sources up to this many rows is broadcast; above it, joins shuffle.
BROADCAST_SOURCES = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, int]:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target``; and the number of sources."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    sources = materialize(sources.withColumn("last", F.col("source").isNull()), "sources")
    n = sources.count()
    ranked = running_totals(sources, ["last", "source"], "one", "rank", parts_for(n, 100_000))
    turn = F.array(*map(F.lit, weights))
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = materialize(ranked.withColumn("limit", F.col("source_size") * cap), "weights")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    share = total / weight if total else 0.0
    while total:  # two numbers a round; the share for weight 1 only rises, and each rise caps a source more
        over = ranked.where(F.col("limit") < F.col("weight") * F.lit(share))
        taken, gone = over.agg(F.coalesce(F.sum("limit"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if gone == weight or (new := (total - taken) / (weight - gone)) <= share:
            break
        share = new
    target = F.least(F.col("weight") * F.lit(share), F.col("limit")).cast("double")
    return ranked.select("source", "source_size", "weight", target.alias("target")), n


def hash_thresholds(sizes: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """For each source of ``budgets`` (``source``, ``budget``) the ``threshold`` below which the
    sizes of ``sizes`` (``source``, ``size``, ``hash``) sum to the budget as nearly as one
    document allows."""
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget"), F.lit(False).alias("done"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        above, here = HASH_BITS - LEVEL_BITS * (level - 1), HASH_BITS - LEVEL_BITS * level
        inside = sizes.alias("d").join(_small(state.where("NOT done"), n_sources).alias("s"),
                                       F.col("d.source").eqNullSafe(F.col("s.source")))
        if level > 1:
            inside = inside.where(F.shiftright("d.hash", above) == F.col("s.prefix"))
        hist = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("d.hash", here).alias("bucket")).agg(
            F.sum("d.size").alias("held"), F.min("d.hash").alias("low"), F.max("d.hash").alias("high"),
            F.first("s.budget").alias("budget"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("held").over(upto)).where(F.col("upto") > F.col("budget"))
        edge = hist.groupBy("source").agg(F.min_by(F.struct("bucket", "held", "upto", "low", "high", "budget"), "bucket").alias("e"))
        single = F.col("e.low") == F.col("e.high")
        rest = F.col("e.budget") - (F.col("e.upto") - F.col("e.held"))
        # a single hash left: it goes in if that brings the sum nearer to the budget
        prefix = F.when(single, F.col("e.low") + (2 * rest > F.col("e.held")).cast("long")).otherwise(F.col("e.bucket"))
        found = edge.select("source", prefix.alias("prefix"), rest.alias("budget"), single.alias("done"))
        open_, old = state.where("NOT done"), state.where("done")
        # no bucket goes over the budget: only where nothing is wanted beyond what is there
        none = open_.join(found, open_.source.eqNullSafe(found.source), "left_anti").select(
            "source", F.lit(None).cast("long").alias("prefix"), "budget", F.lit(True).alias("done"))
        state = materialize(old.unionByName(found).unionByName(none), "thresholds")
        if not state.where("NOT done").head(1):
            break
    return state.select("source", F.col("prefix").alias("threshold"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, added: str = "mix") -> DataFrame:
    """``docs`` plus the struct ``added``: ``size``, ``source_size``, ``target`` (of its source) and
    ``copies`` (0 to ``cap``), the number of times the mix takes the document."""
    row = "row_in"
    key = F.xxhash64(*[F.col(f"{row}.`{c}`") for c in (id_col, source_col, text_col)])
    df = boxed(docs, row).select(row, F.col(f"{row}.`{source_col}`").alias("source"), word_count(F.col(f"{row}.`{text_col}`")).alias("size"),
                                 F.shiftrightunsigned(key, 1).alias("hash"))
    sizes = materialize(df.select("source", "size", "hash"), "sizes")
    targets, n = source_targets(sizes, weights, cap)
    full = F.least(F.floor(F.try_divide("target", "source_size")), F.lit(cap))
    targets = materialize(targets.withColumn("full", F.coalesce(full, F.lit(0))), "targets")
    budgets = targets.select("source", (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"))
    marks = hash_thresholds(sizes, budgets, n)
    plan = targets.join(marks.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    plan = _small(plan.withColumnRenamed("source", "source_"), n)
    out = df.join(plan, F.col("source").eqNullSafe(F.col("source_")))
    once_more = F.when(F.col("full") < cap, (F.col("hash") < F.col("threshold")).cast("int")).otherwise(0)
    copies = (F.col("full") + F.coalesce(once_more, F.lit(0))).cast("int")
    return unboxed(out.withColumn(added, F.struct("size", "source_size", "target", copies.alias("copies"))), [added], row)


def take(mixed: DataFrame, added: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return (mixed.where(F.col(f"{added}.copies") > 0)
            .withColumn(added, F.explode(F.sequence(F.lit(1), F.col(f"{added}.copies")))).drop(added))
