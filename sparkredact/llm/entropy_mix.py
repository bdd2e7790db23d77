"""Mixing sources to target weights by entropy balancing.

Rates of documents lie between 0 and ``most`` copies and are as near to one copy
each as the token constraints allow: the convex dual has one multiplier per
source, and a document's rate is ``most`` times the logistic function of the
multiplier times its size, an exponential tilt with a ceiling.  Newton steps on
the dual read the number of documents of each size of a source.  Rates are rounded by a hash of the document,
and the rest of each source's target is met by flipping documents small enough
to fit, chosen by hash bins whose sums are known before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkredact.functions.binding import let
from sparkredact.llm.common import word_count, write_table

NEWTON_STEPS = 24
ROUNDS = 6
BINS = 1024


def _running(rows: DataFrame, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with running sums up to and including each, in the given order.

    Ranges of the order are summed apart; only the totals of the ranges, as many
    as there are shuffle partitions, meet in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = write_table(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), name)
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(totals), "_range").withColumns(
        {k: F.col(f"_{k}") + F.sum(c).over(inside) for k, c in sums.items()}).drop("_range", *(f"_{k}" for k in sums))


def targets(sources: DataFrame, share: float, weights: list[int], most: int) -> DataFrame:
    """``sources`` (source, total) with their target: weights by code point of the name, null last, and a cap.

    Where the cap bites the excess goes to the others by weight; the level at
    which none is above is found on the sources in order of cap to weight.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = _running(sources, order, {"place": F.lit(1)}, "ranked")
    chosen = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", chosen.cast("double")).withColumn("cap", most * F.col("total").cast("double"))
    whole = sources.agg(F.sum("total")).first()[0] or 0
    levels = _running(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), [F.col("ratio"), *order],
                      {"caps": F.col("cap"), "spent": F.col("weight")}, "levels")
    total_weight = levels.agg(F.sum("weight")).first()[0] or 0.0
    # A source is capped if at its ratio the level would give it no less than its cap.
    at = levels.withColumn("need", F.col("caps") + F.col("ratio") * (F.lit(total_weight) - F.col("spent")))
    capped = at.where(F.col("need") <= share * whole).agg(F.max("caps"), F.max("spent")).first()
    left = total_weight - (capped[1] or 0.0)
    level = (share * whole - (capped[0] or 0.0)) / left if left > 0 else float("inf")
    return levels.select("source", "total", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _rate(most: int, tilt: str | Column = "tilt", size: str | Column = "size", mean: str | Column = "mean") -> Column:
    tilt, size, mean = (F.col(c) if isinstance(c, str) else c for c in (tilt, size, mean))
    x = F.least(F.greatest(tilt * size / mean, F.lit(-60.0)), F.lit(60.0))
    return most / (1 + F.exp(-x))


def _unit(*columns) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def _bin(k: Column) -> Column:
    return F.pmod(F.xxhash64("id", "size", k), F.lit(BINS))


def _fits(copies: Column, way: Column, gap: Column, most: int) -> Column:
    return (F.col("size") > 0) & (F.col("size") <= gap) & _free(copies, way, most)


def _free(copies: Column, way: Column, most: int) -> Column:
    return F.when(way > 0, copies < most).otherwise(copies > 0)


def _copies(most: int) -> Column:
    """Copies of a document: its rate rounded by hash, then the flips of each round of its source."""
    copies = F.when(F.col("target") >= most * F.col("total"), F.lit(most)).otherwise(
        F.least(F.floor(_rate(most) + _unit("id", "size", F.lit(-1))), F.lit(most)))
    copies = F.when(F.col("size") > 0, copies).otherwise(1).cast("int")
    return F.aggregate("rounds", copies, lambda now, r: F.when(
        (_fits(now, r.way, r.gap, most) & (_bin(r.k) <= r.last)) | ((F.col("size") == r.size) & (_key() == r.key)), now + r.way).otherwise(now))


def _key() -> Column:
    return F.xxhash64("id", "size", F.lit(-2))


def _join(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Parameters of a source to its documents; null is a source as well."""
    plan = plan.withColumnRenamed("source", "_of")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def _with(plan: DataFrame, more: DataFrame) -> DataFrame:
    """Columns of ``more`` (source, ...) to the sources that have them; null is a source as well."""
    return plan.join(more.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")


def _newton(r: Column, most: int) -> Column:
    """The states (tilt, lo, hi, open) after each Newton step of a source: ``r`` has its
    target, mean and ``sizes`` (size, n), the number of its documents of each size."""
    def sums(tilt):
        def add(now, h):
            return let(_rate(most, tilt, h["size"], r["mean"]), lambda rate: F.struct(
                (now["taken"] + h["n"] * h["size"] * rate).alias("taken"),
                (now["slope"] + h["n"] * h["size"] * (h["size"] / F.greatest(r["mean"], F.lit(1e-9))) * rate * (1 - rate / most)).alias("slope")))
        return F.aggregate(r["sizes"], F.struct(F.lit(0.0).alias("taken"), F.lit(0.0).alias("slope")), add)

    def moved(now, s):
        def to(miss):
            lo, hi = F.when(miss < 0, now["tilt"]).otherwise(now["lo"]), F.when(miss > 0, now["tilt"]).otherwise(now["hi"])
            step = now["tilt"] - miss / F.greatest(s["slope"], F.lit(1e-12))
            tilt = F.when(F.abs(miss) <= 1e-9 * r["target"], now["tilt"]).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
            return F.struct(tilt.alias("tilt"), lo.alias("lo"), hi.alias("hi"), (F.abs(miss) > 1e-5 * r["target"]).alias("open"))
        return let(s["taken"] - r["target"], to)

    def step(states, _):
        return let(F.element_at(states, -1), lambda now: let(sums(now["tilt"]), lambda s: F.array_append(states, moved(now, s))))

    first = F.array(F.struct(F.lit(0.0).alias("tilt"), F.lit(-64.0).alias("lo"), F.lit(64.0).alias("hi"), F.lit(True).alias("open")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), first.cast("array<struct<tilt: double, lo: double, hi: double, open: boolean>>"), step)


def tilted(sized: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``plan`` (source, total, target, mean) with ``tilt``, after as many Newton steps
    as the slowest source takes.

    The dual reads no more of a source than how many documents have each size, one
    array a source that ends with its longest text; all steps are one query over it."""
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("sizes"))
    r = F.struct("target", "mean", "sizes")
    rows = _with(plan, sizes).withColumn("states", F.when(F.col("sizes").isNotNull() & (F.col("total") > 0), let(r, lambda x: _newton(x, most))))
    rows = write_table(rows.drop("sizes"), "duals")
    # states[0] is the start; the first step that leaves no source open is the last.
    opened = rows.where("states is not null").select(F.posexplode("states.open").alias("step", "open")).groupBy("step").agg(F.max("open").alias("open"))
    last = opened.where("step > 0 and not coalesce(open, false)").agg(F.min("step")).first()[0] or NEWTON_STEPS
    return rows.select("source", "total", "target", "mean", F.coalesce(F.get("states", F.lit(last))["tilt"], F.lit(0.0)).alias("tilt"))


def solve(sized: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> DataFrame:
    """``sized`` (id, source, size) to the parameters of each source that ``_copies`` reads."""
    sources = write_table(sized.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.when(F.col("size") > 0, 1)).alias("filled")), "sources")
    plan = targets(sources.drop("filled"), share, list(weights), most)
    plan = plan.join(sources.withColumnsRenamed({"source": "_of", "total": "_total"}), F.col("source").eqNullSafe(F.col("_of"))).drop("_of", "_total")
    plan = plan.select("source", "total", "target", (F.col("total") / F.greatest("filled", F.lit(1))).alias("mean"))
    plan = tilted(sized, plan, most)
    none = F.array().cast("array<struct<k: int, way: int, gap: double, last: int, size: bigint, key: bigint>>")
    plan = plan.select("source", "total", "target", "mean", "tilt", none.alias("rounds"))

    for k in range(ROUNDS):
        # What is missing now, by source; then what each bin of fitting documents would add.
        now = _join(sized, plan).withColumn("copies", _copies(most))
        taken = now.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        miss = F.col("target") - F.coalesce("taken", F.lit(0))
        gaps = write_table(_with(plan, taken).withColumn("way", F.when(miss < 0, -1).otherwise(1)).withColumn("gap", F.abs(miss)).drop("taken"), "gaps")
        now = _join(sized, gaps).withColumn("copies", _copies(most))
        bins = (now.where(_fits(F.col("copies"), F.col("way"), F.col("gap"), most)).groupBy("source", _bin(F.lit(k)).alias("bin"))
                .agg(F.sum("size").alias("sum"), F.first("gap").alias("gap")))
        upto = F.sum("sum").over(Window.partitionBy("source").orderBy("bin"))  # at most BINS rows a source
        last = bins.withColumn("upto", upto).groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("bin"))).alias("last"), F.count("*").alias("bins"))
        # Where nothing fits and much is missing: the smallest document beyond the gap; the next round goes the other way.
        beyond = (now.where((F.col("size") > F.col("gap")) & (F.col("gap") > 0.002 * F.col("target")) & _free(F.col("copies"), F.col("way"), most))
                  .groupBy("source").agg(F.min(F.struct("size", _key().alias("key"))).alias("beyond")))
        plan = _with(_with(gaps, last), beyond)
        beyond = [F.when(F.col("bins").isNull(), F.col(f"beyond.{c}")).cast("long").alias(c) for c in ("size", "key")]
        flips = F.struct(F.lit(k).alias("k"), "way", "gap", F.coalesce("last", F.lit(-1)).cast("int").alias("last"), *beyond)
        plan = write_table(plan.select("source", "total", "target", "mean", "tilt", F.concat("rounds", F.array(flips)).alias("rounds")), "flips")
    return plan


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (copies times size).

    Null texts have size 0; documents of size 0 cost nothing and keep one copy.
    A source without words has target 0.  Repeated rows are documents each.  An
    empty table gives no row.  Equal inputs give equal results: rounding goes by
    a hash of id and size.
    """
    sized = write_table(_sized(docs, id_col, text_col, source_col), "sizes")
    plan = solve(sized, share, weights, most)
    return (_join(sized, plan).withColumn("copies", _copies(most))
            .select("id", "source", "size", F.col("total").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it; texts are not shuffled."""
    most = options.get("most", 2)
    plan = solve(write_table(_sized(docs, id_col, text_col, source_col), "sizes"), **options)
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    sized = docs.select(row, docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    taken = _join(sized, plan).withColumn("copies", _copies(most)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
