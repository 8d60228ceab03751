"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, numbered, part_count, staged

WEIGHTS = (5, 2, 1)  # by source in code point order, repeating
SHARE = 1.5  # the mix's words, as a share of all words
MOST = 2  # times a source's words at most
UNIT = 24  # expected copies are counted in units of 2 ** -UNIT
ROWS_EACH = 1 << 14


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (no_source, name, source_size), one row a source, with each one's ``target``.

    Words to share are split by weight; a source above ``most`` times its own words stops there
    and the excess is split again among the rest, until none is above.  Each round is one sum
    over the sources; only sums reach the driver.
    """
    ranked = numbered(sizes, [F.col("no_source"), F.col("name")], [], "place", 1 + sizes.count() // ROWS_EACH)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", weight.cast("long")).drop("place"), "sources")
    cap, total = F.col("source_size") * most, ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        above = cap < F.col("weight") * F.lit(level)
        found = ranked.agg(
            F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.sum(above.cast("long"))
        ).first()
        if found[2] in (stopped, None) or not found[1]:
            break
        stopped, level = found[2], (total * share - found[0]) / found[1]
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``.

    Within a source every document expects ``target / source_size`` copies.  Prefix sums of
    these, plus one offset per source drawn from ``seed``, cross integers; a document is emitted
    once per integer crossed on its step.  Documents stand by size, largest first, then id, so
    the words taken differ from the target by about one document.  Sums are whole numbers of
    ``2 ** -UNIT``: no rounding adds a copy.

    A null or empty text has size 0 and is drawn like any other; a null source is a source of its
    own, last in order; repeated rows are rows; rows that tie in size and id are interchangeable.
    Input columns with the names above are replaced.  An empty table stays empty.
    """
    spark, extra = docs.sparkSession, ["size", "source_size", "target", "copies", "taken"]
    held = docs.drop(*[c for c in extra if c not in (id_col, text_col, source_col)])
    group = ["no_source", "name"]
    rows = held.select(  # the documents' own columns travel as one, so no name of theirs can clash
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("tie"),
        F.struct("*").alias("own"),
    )
    sizes = rows.groupBy(*group).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    unit = 1 << UNIT
    rate = F.floor(F.try_divide(F.col("target") * unit, F.col("source_size")))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("no_source").cast("string"), F.lit(":"), F.col("name")))
    offset = F.conv(F.substring(draw, 1, UNIT // 4), 16, 10).cast("long")
    targets = targets.withColumns({"rate": F.coalesce(rate, F.lit(0)), "start": offset}).drop("weight")
    order = [F.col("no_source"), F.col("name"), F.col("size").desc(), F.col("tie")]
    placed = numbered(rows, order, group, "place", part_count(spark, rows.count(), ROWS_EACH))
    steps = lambda n: F.shiftright(n * F.col("rate") + F.col("start"), UNIT)
    copies = steps(F.col("place")) - steps(F.col("place") - 1)
    mixed = placed.join(targets, group).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    own = [F.col("own").getField(c).alias(c) for c in held.columns]
    return mixed.select(*own, *extra)


def emitted(mixed: DataFrame) -> DataFrame:
    """Every document as many times as it has copies, without the columns of the plan."""
    repeated = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.drop("__copy", "size", "source_size", "target", "copies", "taken")
