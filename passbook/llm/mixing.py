"""Mixing sources to target weights: hash order, distributed prefix sums, exact budgets.

Every document gets a hash-random key. Within a source, documents stand in the order of
their keys, and the source's budget is the first so many words of that order; a budget
above the source's size starts over, so that each further epoch is a prefix again. The
place of a document comes from prefix sums in two steps: keys are cut into ranges, the
sums of the ranges are accumulated, and rows are accumulated within their range only, so
no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.session import saved, shared_dir

#: Weights of sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: No target is above so many times its source's size.
MOST = 2


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key() -> Column:
    """One number for all that tells documents apart: id, source and text."""
    return F.xxhash64("doc_id", "source", "text")


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares by weight, none above its ceiling.

    Resharing what is above a ceiling ends where the ceilings that hold are those with the
    least ceiling for each unit of weight, and the rest share what is left by weight. One
    row for each source; the sources themselves are the only thing in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("i", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("ceiling", F.lit(float(most)) * F.col("source_size"))
    )
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), "i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rest = F.sum(F.col("source_size")).over(whole) * F.lit(float(share)) - F.coalesce(
        F.sum("ceiling").over(before), F.lit(0.0)
    )
    level = ranked.withColumn("level", rest / F.sum("weight").over(after))
    # The first source, by ratio, that its share does not fill sets the level for all after it.
    holds = F.max(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.col("level"))).over(whole)
    target = F.least(F.coalesce(F.col("held") * F.col("weight"), F.col("ceiling")), F.col("ceiling"))
    return level.withColumn("held", holds).select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    seed: str = "mix",
    share: float = SHARE,
    weights: tuple = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target and taken words.

    Returns (doc_id, size, source_size, target, source, row_key, epochs, cut, taken): each
    row is taken ``epochs`` times whole and, where the budget ends in it, ``cut`` words more.
    Budgets are targets without their fraction, so a source's taken words are its budget.

    Null or empty texts have size 0 and are taken 0 words. A null source is a source like
    others, last in order. Rows that repeat a doc_id are documents of their own; equal rows
    share what falls on them. No rows in, no rows out. Other columns are ignored.
    """
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id",
        "source",
        row_key().alias("row_key"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("sort_key"),
    )
    sized = saved(sized, shared_dir(spark, "mix"))
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    most_rows = rows.agg(F.max("n")).first()[0] or 0
    # About as many ranges as rows in a range, so that both stay small tasks.
    digits = 1
    while 16 ** (2 * digits) < most_rows:
        digits += 1
    cells = sized.withColumn("cell", F.substring("sort_key", 1, digits))
    aimed = targets(rows.select("source", "source_size"), share, weights, most)
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy("source", "cell")
        .agg(F.sum("size").alias("cell_size"))
        .withColumn("base", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
        .drop("cell_size")
    )
    facts = saved(
        offsets.alias("o")
        .join(aimed.alias("a"), F.col("o.source").eqNullSafe(F.col("a.source")))
        .select("o.source", "cell", "base", "source_size", "target"),
        shared_dir(spark, "mix-ranges"),
    )
    inner = (
        Window.partitionBy("source", "cell")
        .orderBy("sort_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    joined = (
        cells.alias("d")
        .join(
            facts.alias("f"),
            F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.cell") == F.col("f.cell")),
        )
        .select("d.doc_id", "size", "source_size", "target", "d.source", "row_key", "sort_key", "d.cell", "base")
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - F.col("epochs") * F.col("source_size") - F.col("start")
    return (
        joined.withColumn("start", start)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("cut", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("cut"))
        .select("doc_id", "size", "source_size", "target", "source", "row_key", "epochs", "cut", "taken")
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once for each epoch, and
    the one in which a source's budget ends once more with the words that are left.

    Documents without words are kept once: they take nothing of a budget. Nulls are values
    like others; equal rows are told apart by number. Columns beside doc_id, source and text
    are passed on; n_chars follows a text that is cut.
    """
    names = docs.columns
    plan = (
        mix(docs, seed, **options)
        .groupBy("row_key")
        .agg(F.sort_array(F.collect_list(F.struct("epochs", "cut"))).alias("__plan"))
        .withColumnRenamed("row_key", "__key")
    )
    same = Window.partitionBy("__key").orderBy("__size")
    joined = (
        docs.withColumn("__size", n_words(F.col("text")))
        .withColumn("__key", row_key())
        .withColumn("__n", F.row_number().over(same))
        .join(plan, "__key")
        .withColumn("__plan", F.element_at("__plan", F.col("__n")))
        .withColumns({"__epochs": F.col("__plan.epochs"), "__cut": F.col("__plan.cut")})
    )
    whole = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.col("__epochs"))
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")),
        F.array_repeat(F.col("__cut"), F.when(F.col("__cut") > 0, 1).otherwise(0)),
    )
    part = F.array_join(
        F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(F.col("__copy"), F.lit(1)).cast("int")),
        " ",
    )
    taken = joined.withColumn("__copy", F.explode(copies))
    text = F.when((F.col("__copy") < 0) | (F.col("__copy") >= F.col("__size")), F.col("text")).otherwise(part)
    fields = [text.alias(c) if c == "text" else F.col(c) for c in names]
    if "n_chars" in names:
        fields[names.index("n_chars")] = F.when(
            (F.col("__copy") < 0) | (F.col("__copy") >= F.col("__size")), F.col("n_chars")
        ).otherwise(F.length(part).cast("long")).alias("n_chars")
    return taken.select(*fields)
