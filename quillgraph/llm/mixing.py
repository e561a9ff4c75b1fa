"""Mixing sources to target weights.

Each listed source gets its share of the total size. A source is read in complete epochs as often as
its budget allows, at most ``max_repeats`` times; what is left of the budget is filled with documents
in Efraimidis-Spirakis order: the key of a document is -ln(u) / quality with u uniform (a hash of its
id), so documents of higher quality come sooner. The running token sum of a source is taken over range
partitions of (source, key) with a carry for each, so that no source has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.prefix import prefix_sums
from ..scratch import Table


def source_name(c: Column | str) -> Column:
    """One spelling of a source: lower case without outer blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def letter_quality(text: Column) -> Column:
    """A quality weight in [0.05, 1]: the share of letters among the characters that are not blank."""
    shown = F.char_length(F.regexp_replace(text, r"[\s\p{Z}]+", ""))
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, shown), F.lit(0.05)))


def _sized(documents: DataFrame, size: Column) -> DataFrame:
    return documents.select(source_name("source").alias("source"), size.alias("tokens"))


def _plan(sized: DataFrame, weights: DataFrame) -> DataFrame:
    w = (
        weights.where((F.col("weight") > 0) & ~F.isnan("weight") & F.col("source").isNotNull())
        .select(source_name("source").alias("source"), F.struct(F.col("weight").cast("double").alias("weight"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats")).alias("w"))
        .groupBy("source").agg(F.max("w").alias("w")).select("source", "w.*")
    )
    own = sized.groupBy("source").agg(F.sum("tokens").alias("own"), F.max("tokens").alias("largest"))
    all_ = Window.partitionBy()  # the declared sources only
    p = w.join(own, "source", "left").fillna(0, ["own", "largest"])
    p = p.withColumn("share", F.col("weight") / F.sum("weight").over(all_)).withColumn("budget", F.col("share") * F.sum("own").over(all_))
    return p.withColumn("feasible", F.col("budget") <= F.col("max_repeats") * F.col("own"))


def plan_mixture(documents: DataFrame, weights: DataFrame, size: Column) -> DataFrame:
    """(source, weight, max_repeats, own, largest, share, budget, feasible) of each source with a weight above 0.

    own: tokens of its documents, each once; largest: those of its largest; budget: its share of the total of all these sources;
    feasible: budget <= max_repeats x own. Null, 0, negative and NaN weights leave a source out; a
    null max_repeats counts as 1, a negative one as 0. Of repeated sources the row of largest weight
    counts. A source without documents has own 0 and is never feasible. Documents with a null or an
    unlisted source do not count. Weights are a table the user declares, one row a source.
    """
    return _plan(_sized(documents, size), weights)


def mixture(documents: DataFrame, weights: DataFrame, size: Column, quality: Column | None = None, *, id: str = "doc_id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The plan (see ``plan_mixture``) and the mix (see ``mix``); texts are read once for both."""
    quality = letter_quality(F.col("text")) if quality is None else quality
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id)), 11) + 0.5) / F.lit(float(1 << 53))
    rows = documents.select(F.col(id).alias("doc_id"), source_name("source").alias("source"), size.cast("long").alias("tokens"), (-F.log(uniform) / quality).alias("key"))
    # null ids share a key, but not a place: the row number within its task parts them
    drawn = Table(rows.where((F.col("tokens") > 0) & F.col("source").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "drawn").df
    plan = Table(_plan(drawn, weights), "plan").df
    told = plan.select(
        "source", F.col("max_repeats").cast("long").alias("cap"),
        F.when(F.col("feasible"), F.floor(F.try_divide("budget", "own"))).otherwise(F.col("max_repeats")).cast("long").alias("epochs"), "budget", "own",
    )
    told = told.withColumn("rest", F.when(F.col("epochs") < F.col("cap"), F.col("budget") - F.col("epochs") * F.col("own")).otherwise(0.0)).drop("budget", "own", "cap")
    listed = drawn.join(F.broadcast(told.select("source")), "source", "left_semi")
    kept = listed.select("source", "tokens", "key", "row", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"))
    summed, _ = prefix_sums(kept, ["source"], ["key", "doc_id", "row"], "tokens", ["doc_id", "nameless"])
    copies = F.col("epochs") + F.when(F.col("before") + F.col("tokens") <= F.col("rest"), 1).otherwise(0)
    used = summed.join(F.broadcast(told), "source").select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "source", "tokens", copies.cast("int").alias("copies"))
    return plan, used.where(F.col("copies") > 0)


def mix(documents: DataFrame, weights: DataFrame, size: Column, quality: Column | None = None, *, id: str = "doc_id", seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document comes in the mix; those with no copy are left out.

    ``quality``: weights above 0 (default ``letter_quality`` of ``text``). Documents of size 0 are
    left out. The same tables and seed give the same mix. A source misses its budget by less than
    its next document, or because ``max_repeats`` binds (``plan_mixture`` has it not feasible).
    Repeated rows of a document each count as a document; empty tables give no rows.
    """
    return mixture(documents, weights, size, quality, id=id, seed=seed)[1]


def short_sources(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source): the sources that stay below their budget though the mix uses all their documents as often as it may."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
    r = plan.join(got, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    return r.where((F.col("reached") >= F.col("max_repeats") * F.col("own")) & (F.col("reached") < F.col("budget"))).select("source")


def mixture_check(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, feasible, over, met): documents used more than max_repeats times, and whether the source reaches
    its budget to within its largest document, or all of its documents as often as it may."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("most"))
    r = plan.join(got, "source", "left").fillna(0, ["reached", "most"])
    near = (F.col("reached") <= F.col("budget")) & (F.col("budget") - F.col("reached") < F.greatest("largest", F.lit(1)))
    full = F.col("reached") == F.col("max_repeats") * F.col("own")
    return r.select("source", "feasible", F.when(F.col("most") > F.col("max_repeats"), F.col("most")).otherwise(0).cast("int").alias("over"), F.when(F.col("feasible"), near | full).otherwise(full).alias("met"))


def mixture_report(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, weight, share, documents, tokens, reached, feasible): the shares that the mix reaches."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    r = plan.join(got, "source", "left").fillna(0, ["documents", "tokens"])
    return r.select("source", "weight", "share", "documents", "tokens", (F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy()))).alias("reached"), "feasible")
