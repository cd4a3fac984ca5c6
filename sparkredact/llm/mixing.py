"""Mixing sources to target weights by temperature, in DataFrame functions alone.

Weights are source token shares raised to an exponent and normalised. The exponent is found by repeated section of
[0, 1]: the smallest one at which no source repeats more than ``max_repeats`` times as often as the least repeated, or
the largest at which the weights' entropy reaches a target. Each section is one aggregation over the table
of sources, of which only the grid's few rows reach the driver.

The weights become draws by budgeted block permutations. A source with budget b and T tokens is seen b // T
times whole, and then once as far as the budget goes, each time in another hash order. Draws are laid into blocks that
hold each source's weight of the block's tokens. Cumulative token counts are taken in two levels, over hash buckets of
bounded size and inside them, so no task has to hold a source, however large; totals of many buckets are added up in
stretches. Documents without words are spread over the blocks.

``mix`` lists the draws. ``mixed_documents`` gives the documents themselves: a draw's place in its source's share of the
mixture is the epoch and, inside it, the hash order; blocks are stretches of that place, dealt out and sorted, so what is
written is a permutation of blocks each of which holds every source in its weight, but for the hashes' scatter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Workspace

#: Points of one section of the exponent's interval, and sections (33^5 steps in all).
POINTS, SECTIONS = 33, 5
#: Tokens of a hash bucket, and of a block of the mixture.
BUCKET_TOKENS, BLOCK_TOKENS = 1 << 18, 1 << 20
#: Tokens of a block in which documents are written, smaller so that even tasks result.
SLICE_TOKENS = 1 << 17
#: Buckets whose totals one window adds up; sources up to which the plan is broadcast, and shares of each hot source beyond.
STRETCH, MOST_SOURCES, SHARES = 4096, 1 << 16, 64


@dataclass(frozen=True)
class Target:
    """What the weights have to meet: a repetition limit, or a share of the largest possible entropy."""

    max_repeats: float | None = 2.0
    entropy: float | None = None
    #: Tokens of the mixture; None: as few as let every document be drawn once.
    budget: int | None = None
    seed: int = 7


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{WHITE}]+")).cast("long")


def _unit(*columns) -> Column:
    """A hash of columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _exponent(sources: DataFrame, total: int, target: Target) -> float:
    low, high = 0.0, 1.0
    share = F.col("tokens") / F.lit(float(total))
    for _ in range(SECTIONS):
        grid = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
        at = sources.select(share.alias("q"), "tokens", F.explode(F.array(*map(F.lit, grid))).alias("a"))
        at = at.select("a", "q", "tokens", F.pow("q", "a").alias("w"))
        rows = at.groupBy("a").agg(
            F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("tokens")).alias("most"), F.min(F.col("w") / F.col("tokens")).alias("least"), F.count("*").alias("n")
        )
        fits = {}
        for r in rows.select("a", (F.log("z") - F.col("wl") / F.col("z")).alias("h"), F.log("n").alias("top"), (F.col("most") / F.col("least")).alias("ratio"), (F.col("most") / F.col("z")).alias("rate")).collect():
            if target.entropy is not None:
                fits[r["a"]] = r["h"] >= target.entropy * r["top"] - 1e-12
            else:
                repeats = r["ratio"] if target.budget is None else r["rate"] * target.budget
                fits[r["a"]] = repeats <= target.max_repeats * (1 + 1e-12)
        fitting = [a for a in grid if fits.get(a)]
        if not fitting:
            raise ValueError("no exponent in [0, 1] meets the target")
        if target.entropy is not None:  # falls with the exponent
            low = max(fitting)
            high = min([a for a in grid if a > low], default=low)
        else:
            high = min(fitting)
            low = max([a for a in grid if a < high], default=high)
    return low if target.entropy is not None else high


def _measured(docs: DataFrame, source_col: str, text_col: str, id_col: str, target: Target) -> DataFrame:
    """doc_id, source (null: empty), tokens and the text's hash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), words(F.col(text_col)).alias("tokens"), F.xxhash64(text_col, F.lit(target.seed)).alias("salt")
    )


def source_plan(measured: DataFrame, space: Workspace, target: Target) -> DataFrame:
    """source, tokens, weight, budget, epochs (whole ones), rest (tokens of the partial one), buckets: a row for each source."""
    sources = space.keep(measured.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "sources")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return sources.select("source", "tokens", *(F.lit(0.0).alias(c) for c in ("weight", "budget")), *(F.lit(0).cast("long").alias(c) for c in ("epochs", "rest", "buckets")))
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(_exponent(sources, total, target)))
    weighted = sources.withColumn("power", power)
    z, longest = weighted.agg(F.sum("power"), F.max(F.col("tokens") / F.col("power"))).first()
    budget = float(target.budget if target.budget is not None else z * longest)
    parts = weighted.select("source", "tokens", (F.col("power") / z).alias("weight"), (F.col("power") / z * budget).alias("budget"))
    epochs = F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-9)).cast("long")
    parts = parts.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.round(F.col("budget") - F.col("epochs") * F.col("tokens")).cast("long"), F.lit(0).cast("long")))
    return parts.withColumn("buckets", F.ceil(F.col("tokens") / F.lit(BUCKET_TOKENS)).cast("long"))


def _order(target: Target, epoch: Column) -> Column:
    return _unit("doc_id", "salt", epoch, F.lit(target.seed))


def _cumulated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``before``: tokens of all rows of the keys that come earlier in the order of ``at``."""
    inside = Window.partitionBy(*keys, "bucket").orderBy("at", "doc_id", "salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "bucket").agg(F.sum("tokens").alias("n")).withColumn("stretch", F.floor(F.col("bucket") / F.lit(STRETCH)))
    along = Window.partitionBy(*keys, "stretch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = totals.groupBy(*keys, "stretch").agg(F.sum("n").alias("n")).select(*keys, "stretch", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("start"))
    bases = totals.select(*keys, "bucket", "stretch", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("inner"))
    bases = bases.join(stretches, [*keys, "stretch"]).select(*keys, "bucket", (F.col("start") + F.col("inner")).alias("base"))
    return rows.join(bases, [*keys, "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("base")


def _planned(rows: DataFrame, source: Column, salt: Column, plan: DataFrame) -> DataFrame:
    """rows with the plan of their source (its columns null without one); no task gets all rows of a source."""
    plan = plan.withColumnRenamed("source", "mix_source")
    if plan.count() <= MOST_SOURCES:
        return rows.join(F.broadcast(plan), source == F.col("mix_source"), "left").drop("mix_source")
    shares = plan.withColumn("mix_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return rows.join(shares, (source == F.col("mix_source")) & (F.pmod(salt, F.lit(SHARES)) == F.col("mix_share")), "left").drop("mix_source", "mix_share")


def mix(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each draw: doc_id, source, epoch, block, place (in the block, from 0), tokens, weight (of the source).

    Tokens are words. A null source is a source of its own name, the empty string. Documents without words weigh
    nothing and are drawn once, in epoch 0 and any block. Repeated rows are drawn apart. An empty table gives an empty result; other
    columns are ignored.
    """
    space = Workspace(docs.sparkSession, "mixing")
    measured = space.keep(_measured(docs, source_col, text_col, id_col, target), "measured")
    plan = space.keep(source_plan(measured, space, target), "plan")
    rows = _planned(measured, F.col("source"), F.col("salt"), plan.drop("tokens")).fillna({"epochs": 0, "rest": 0, "buckets": 1})
    blocks = F.lit(_blocks(plan, BLOCK_TOKENS))
    silent = rows.filter("tokens = 0").withColumn("at", _order(target, F.lit(0)))
    silent = silent.select("doc_id", "source", F.lit(0).cast("long").alias("epoch"), F.floor(F.col("at") * blocks).alias("block"), "tokens", "weight", "at")
    drawn = rows.filter("tokens > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1))))
    drawn = drawn.withColumn("at", _order(target, F.col("epoch"))).withColumn("bucket", F.floor(F.col("at") * F.col("buckets")))
    placed = _cumulated(drawn, ["source", "epoch"]).filter("epoch < epochs OR before < rest")
    whole = F.when(F.col("epochs") > 0, F.col("budget") - F.col("rest")).otherwise(0.0) / F.greatest("epochs", F.lit(1))
    block = F.floor((F.col("epoch") * whole + F.col("before")) / (F.col("weight") * F.lit(float(BLOCK_TOKENS)))).cast("long")
    placed = placed.select("doc_id", "source", "epoch", block.alias("block"), "tokens", "weight", "at").unionByName(silent)
    place = F.row_number().over(Window.partitionBy("block").orderBy("at", "doc_id", "source", "epoch")).cast("long") - 1
    return placed.select("doc_id", "source", "epoch", "block", place.alias("place"), "tokens", "weight")


def mixed_documents(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as it is drawn, with the columns of docs, in blocks of the mixture.

    Each source's partial epoch becomes a bound on the hash order, found from bucket totals and the one bucket in which the
    budget runs out. Rows without words stay once; a null source is a source of its own. With no fixed budget every row
    stays, repeated rows each. Texts are shuffled once, by block. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "mixing")
    measured = space.keep(_measured(docs, source_col, text_col, id_col, target), "measured")
    plan = space.keep(source_plan(measured, space, target), "plan")
    own, salt = F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.xxhash64(text_col, F.lit(target.seed))
    partial = _planned(measured.filter("tokens > 0"), F.col("source"), F.col("salt"), plan.select("source", "epochs", "rest", "buckets")).filter("rest > 0")
    partial = partial.withColumn("at", _order(target, F.col("epochs"))).withColumn("bucket", F.floor(F.col("at") * F.col("buckets")))
    bounds = _cumulated(partial, ["source"]).filter("before < rest").groupBy("source").agg(F.max("at").alias("bound"))
    known = space.keep(plan.select("source", "epochs", (F.col("budget") / F.col("tokens")).alias("repeats")).join(bounds, "source", "left"), "known")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, own.alias("mix_own"), words(F.col(text_col)).alias("tokens"), F.col(id_col).cast("long").alias("doc_id"), salt.alias("salt"))
    rows = _planned(keyed, F.col("mix_own"), F.col("salt"), known)
    within = F.coalesce((_order(target, F.col("epochs")) <= F.col("bound")).cast("int"), F.lit(0))
    copies = F.when(F.col("tokens") == 0, 1).otherwise(F.coalesce("epochs", F.lit(0)).cast("int") + within)
    drawn = rows.select("row", "doc_id", "salt", "repeats", F.posexplode(F.array_repeat(F.lit(0), copies)).alias("epoch", "copy")).withColumn("epoch", F.col("epoch").cast("long"))
    place = F.least((F.col("epoch") + _order(target, F.col("epoch"))) / F.greatest(F.coalesce("repeats", F.lit(1.0)), F.lit(1e-9)), F.lit(1 - 1e-9))
    drawn = drawn.select("row", place.alias("place")).withColumn("block", F.floor(F.col("place") * F.lit(_blocks(plan, SLICE_TOKENS))))
    return drawn.repartition("block").sortWithinPartitions("block", "place").select("row.*")


def _blocks(plan: DataFrame, size: int) -> int:
    """Blocks of the mixture."""
    return max(1, int((plan.agg(F.sum("budget")).first()[0] or 0) // size))
