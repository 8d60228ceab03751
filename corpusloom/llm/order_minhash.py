"""Order MinHash fingerprints in Spark expressions only: likeness that follows edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import part_count

UNIT = r"[^\x20\x09-\x0D]{1,16}"  # a symbol: a word, or 16 characters of a longer one
K = 3  # symbols of a k-mer
SKETCHES = 64
PICKED = 2  # k-mers of a sketch
ROWS_EACH = 1 << 13

HASH_BITS, PLACE_BITS = 31, 32
PLACE = (1 << PLACE_BITS) - 1


def _packed(hashed: Column, place: Column) -> Column:
    """31 bits of a hash above a place from 1: a positive number that sorts by the hash."""
    return F.shiftleft(F.shiftrightunsigned(hashed, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def with_signature(df: DataFrame, text_col: str, name: str, k: int = K, sketches: int = SKETCHES, picked: int = PICKED) -> DataFrame:
    """``df`` with ``name``: ``sketches`` numbers of 32 bits.

    K-mers of the text are numbered by occurrence and hashed once.  Sketch j orders them by the
    distance of their hash above j / ``sketches`` of the hash range, wrapping round: one sort serves
    all orders.  It takes the ``picked`` least k-mers, puts them in text order and hashes the tuple.
    Each order alone is uniformly random, so two sketches agree as often as in Order MinHash on
    average; but orders that start in one gap between k-mers are the same one, so in texts of fewer
    k-mers than sketches the likeness spreads more than with independent orders.

    A text of fewer than ``k`` symbols is one k-mer; null, empty and blank texts have the
    signature of no k-mers.  If there are fewer k-mers than ``picked``, they are taken again.
    Columns beginning with ``__`` are used and dropped.
    """
    zero = F.lit(0).cast("long")
    df = df.withColumn("__units", F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(UNIT), F.lit(0)))
    size = F.size("__units")
    unit = lambda i: F.get(F.col("__units"), i.cast("int"))
    kmers = F.transform(
        F.sequence(F.lit(0), size - k), lambda i: _packed(F.xxhash64(*[unit(i + d) for d in range(k)]), i + 1)
    )
    short = F.array(_packed(F.xxhash64(F.col("__units")), F.lit(1)))
    none = F.array().cast("array<long>")
    df = df.withColumn("__seen", F.sort_array(F.when(size >= k, kmers).when(size > 0, short).otherwise(none)))
    # Equal k-mers stand together, in text order: where a run begins, and how long it is.
    last = F.size("__seen")
    at = lambda name, i: F.get(F.col(name), i)
    new = lambda i: (i == 0) | (_hash(at("__seen", i)) != _hash(at("__seen", i - 1)))
    every = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__runs", F.filter(every, new))
    df = df.withColumn("__first", F.transform("__runs", lambda i: at("__seen", i)))
    run = F.size("__runs")
    ends = F.concat(F.slice(F.col("__runs"), 2, F.greatest(run - 1, F.lit(0))), F.array(last))
    spans = F.arrays_zip(F.col("__runs").alias("a"), ends.alias("b"))
    spans = F.filter(spans, lambda s: s["b"] - s["a"] > 1)
    again = lambda s, i: _packed(
        F.xxhash64(_hash(at("__seen", i)), i - s["a"]), at("__seen", i).bitwiseAND(F.lit(PLACE))
    )
    repeats = F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["a"] + 1, s["b"] - 1), lambda i: again(s, i))))
    step = 1 << (HASH_BITS - (sketches - 1).bit_length())
    marks = F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), lambda j: F.shiftleft(j.cast("long") * step, PLACE_BITS))
    df = df.withColumn("__kmers", F.sort_array(F.when(run < last, F.concat("__first", repeats)).otherwise(F.col("__first"))))
    # Marks sorted in among the k-mers: places are from 1, so a mark is what has place 0.
    df = df.withColumn("__marked", F.sort_array(F.concat("__kmers", marks)))
    # (They are the argument of the function, not in its body: Spark may move them in there.)
    is_mark = lambda x, i: F.when(x.bitwiseAND(F.lit(PLACE)) == zero, i).otherwise(-1)
    found = F.filter(F.transform("__marked", is_mark), lambda i: i >= 0)
    df = df.withColumn("__at", found)
    text_order = lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), HASH_BITS).bitwiseOR(_hash(x))
    pick = lambda p, j, d: text_order(at("__kmers", F.pmod(p - j + d, last)))
    code = (1 << HASH_BITS) - 1
    ordered = lambda p, j: F.transform(
        F.sort_array(F.array(*[pick(p, j, d) for d in range(picked)])), lambda x: x.bitwiseAND(F.lit(code))
    )
    sketch = F.transform("__at", lambda p, j: F.xxhash64(ordered(p, j)).bitwiseAND(F.lit(PLACE)))
    empty = F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), lambda j: zero)
    df = df.withColumn(name, F.when(last > 0, sketch).otherwise(empty))
    return df.drop("__units", "__seen", "__runs", "__first", "__kmers", "__marked", "__at")


def written(signature: Column | str) -> Column:
    """A signature as text: eight hexadecimal digits a sketch."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column | str, b: Column | str) -> Column:
    """The share of sketches that agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a)


def with_next(rows: DataFrame, order: list[str], carried: list[str], id_col: str, prepare) -> DataFrame:
    """``prepare(rows)`` with ``next_<c>`` of the row after, by ``order``; after the last comes the first.

    Rows are prepared and dealt by quantiles of the id, once; each range also gets a copy of the
    next range's first row, so no range needs its neighbour.  Null ids are a range of their own,
    the first.  Ids may repeat, but a range holds all rows of an id.
    """
    spark = rows.sparkSession
    parts = part_count(spark, rows.count(), ROWS_EACH)
    cuts = rows.where(F.col(id_col).isNotNull()).approxQuantile(id_col, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    inside = F.size(F.filter(bounds, lambda b: b < F.col(id_col)))
    rows = rows.withColumn("__range", F.when(F.col(id_col).isNull(), -1).otherwise(inside))
    least = F.min(F.struct(*order)).alias("least")
    heads = sorted(rows.groupBy("__range").agg(least).collect(), key=lambda r: r["__range"])  # one row a range
    moved = [(h["__range"], heads[i - 1]["__range"], *h["least"]) for i, h in enumerate(heads)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "__range int, __to int, " + ", ".join(f"__{c} {kinds[c]}" for c in order)
    moved = spark.createDataFrame(moved, schema)
    same = [rows["__range"] == moved["__range"], *[rows[c].eqNullSafe(moved[f"__{c}"]) for c in order]]
    extra = rows.join(F.broadcast(moved), same).select(*[rows[c] for c in rows.columns if c != "__range"], F.col("__to").alias("__range"))
    extra = extra.dropDuplicates(["__range"]).withColumn("__extra", F.lit(1))
    both = prepare(rows.withColumn("__extra", F.lit(0)).unionByName(extra))
    along = Window.partitionBy("__range").orderBy("__extra", *order)
    both = both.withColumn("__next", F.lead(F.struct(*carried)).over(along)).where("__extra = 0")
    return both.select(*[c for c in both.columns if c[:2] != "__"], *[F.col(f"__next.{c}").alias(f"next_{c}") for c in carried])


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text replaces the last quarter of the code points (rounded down) by as many from
    the start of the next document.  Documents follow each other by id, null ids first, rows of
    one id by the hash of their text.  A null text is empty; a single document follows itself; an
    empty table has no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    signed = lambda df: with_signature(df, "text", "signature")
    paired = with_next(rows, ["doc_id", "tie"], ["text", "signature"], "doc_id", signed)
    length, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - cut), F.substring("next_text", F.lit(1), cut))
    paired = paired.withColumn("n_chars", length.cast("long")).withColumn("edited", edited)
    paired = with_signature(paired, "edited", "edited_signature")
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("signature").alias("fingerprint"),
        written("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
    )
