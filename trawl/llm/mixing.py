"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every document has an exponential key divided by its quality weight. A source whose
target is t times its size gives floor(t) complete epochs of all its documents; the
rest of the budget goes to its documents in order of their keys, a prefix sum of
sizes saying where it is spent.
"""

from pyspark.sql import DataFrame, Window, functions as F

from trawl.session import written

WORDS = r"[^\x20\x09-\x0D]+"
HEX = 13  # hex digits of a key: they fit a double


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=(1, 2, 3), cap=3) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn and share all
    sizes by them; no target passes ``cap`` times its source's size, and the excess is
    shared again by weight. A source is held at its cap exactly when the level lies above
    cap * size / weight, so one sort by that ratio finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    sources = sources.withColumn("weight", weight)
    ratio = F.col("source_size") * F.lit(cap) / F.col("weight")
    every = Window.partitionBy()
    up_to = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = lambda c: F.coalesce(F.sum(c).over(up_to), F.lit(0))
    level = (F.sum("source_size").over(every) - cap * before("source_size")) / (
        F.sum("weight").over(every) - before("weight")
    )
    sources = sources.withColumn("ratio", ratio).withColumn("level", level)
    # the first source that stays below its cap fixes the level for all after it
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    return sources.withColumn("settled", settled["level"]).select(
        "source",
        "source_size",
        F.round(
            F.least(
                (F.col("source_size") * cap).cast("double"),
                F.coalesce(F.col("settled") * F.col("weight"), F.lit(0.0)),
            ),
            6,
        ).alias("target"),
    )


def unit(seed, *columns):
    """A number in (0, 1) from an MD5 of the columns."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))
    return (F.conv(F.substring(digest, 1, HEX), 16, 10).cast("double") + 0.5) / float(16**HEX)


def mix_sources(
    docs: DataFrame, quality: DataFrame | None = None, seed=11, weights=(1, 2, 3), cap=3,
    id_col="doc_id", text_col="text", source_col="source", stretch_rows=10_000,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, epochs, taken.

    ``quality`` (id, weight > 0) scales a document's chance in the fractional epoch;
    documents it does not name weigh 1. ``taken`` is ``size`` times the number of times
    that the document enters the mix, so documents are never cut. The one at the end of a budget
    enters if at least half of it fits. Null text has size 0 and is never
    taken; a null source is a source of its own, ordered last. Null ids share one
    key; rows that tie in all of key, id and size are interchangeable. An empty table gives an
    empty result. The result depends on rows and seed only.
    """
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    if quality is not None:
        quality = quality.filter("id is not null and weight > 0").groupBy("id").agg(
            F.max("weight").cast("double").alias("weight")
        )
        slim = slim.join(quality, "id", "left")
    else:
        slim = slim.withColumn("weight", F.lit(None).cast("double"))
    slim = written(slim, "sized")
    targets = source_targets(
        slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap
    ).select(
        F.col("source").alias("from"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long").alias("epochs"),
    ).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    stretches = max(1, -(-slim.count() // stretch_rows))
    drawn = unit(seed, F.col("id"))
    keyed = (
        slim.withColumn("u", drawn)
        .withColumn("key", -F.log("u") / F.coalesce("weight", F.lit(1.0)))
        # the key's order in stretches, so that no task sorts a whole source
        .withColumn("stretch", F.floor((1 - F.exp(-F.col("key"))) * stretches).cast("int"))
        .select("id", "source", "size", "key", "stretch")
    )
    ahead = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        keyed.groupBy("source", "stretch").agg(F.sum("size").alias("sum"))
        .withColumn("begin", F.coalesce(F.sum("sum").over(ahead), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("from")))
        .select("from", F.col("stretch").alias("at"), "begin", "source_size", "target", "epochs", "budget")
    )
    within = Window.partitionBy("source", "stretch").orderBy("key", "id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    end = F.col("begin") + F.col("upto")
    return (
        keyed.withColumn("upto", F.sum("size").over(within))
        .join(begins, F.col("source").eqNullSafe(F.col("from")) & (F.col("stretch") == F.col("at")))
        .withColumn("extra", (end - F.col("size") / 2 <= F.col("budget")).cast("long"))
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            "epochs",
            (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken"),
        )
    )
