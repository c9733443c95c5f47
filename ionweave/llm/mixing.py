"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate that brings its share of characters to its target weight.
A document's number of copies is the inverse of the Poisson distribution with that mean at a number
drawn from a hash of seed and id; the copies are exploded and shuffled globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import row_fields, stored, whole_row

BITS = 13  # hexadecimal digits of the hash that make a number: 52 bits, exact in a double
ROWS_TO_BROADCAST = 10_000
SALTS = 64
#: Highest mean of one draw; a higher rate is the sum of several draws, whose counts are again Poisson distributed.
DRAW_RATE = 200.0


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts, joined by ``|``; missing parts are empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS), 16, 10).cast("bigint").cast("double") / float(16**BITS)


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, 2, ... copies, to where a double no longer changes."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(steps, start, lambda s, k: F.struct(
        (s["p"] * rate / k).alias("p"),
        F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf")))["cdf"]


def poisson_count(u: Column, table: Column) -> Column:
    """The smallest k whose cumulative probability is above ``u``."""
    return F.size(F.filter(table, lambda c: c <= u))


def copies_of(seed: int, doc_id: Column, draws: Column, table: Column) -> Column:
    """Sum of ``draws`` counts from ``table``, the first at the hash of seed and id, the others with their number too."""
    more = F.aggregate(F.sequence(F.lit(2), F.greatest(draws, F.lit(2))), F.lit(0).cast("long"),
                       lambda n, k: n + poisson_count(unit(F.lit(seed), doc_id, k), table))
    first = poisson_count(unit(F.lit(seed), doc_id), table)
    return F.when(draws > 1, first + more).otherwise(first)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``(source, chars, rate, draws, cdf)``: mean copies per document that bring each source to its target share of characters.

    ``weights`` names target weights (a source not named gets none); without it the weight of a source is its
    characters to the power ``temperature``.  ``epochs`` scales the total.  Rates are rounded to 9 digits and
    have no upper limit: ``cdf`` is that of the rate over ``draws``, the number of draws of a mean of at most 200 that are
    added up.  A source without characters, and the documents without source unless named ``""``, follow the same
    rule: no characters, rate 0.
    """
    sizes = stored(docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars")), "source-sizes")
    if weights is None:
        weight = F.pow("chars", F.lit(float(temperature)))
    else:
        named = F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))])
        weight = F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    total = sizes.agg(F.sum("chars").alias("c"), F.sum("weight").alias("w")).first()
    share = F.col("weight") / F.lit(total["w"] or 1.0) * F.lit((total["c"] or 0.0) * epochs) / F.col("chars")
    rate = F.when(F.col("chars") > 0, F.round(share, 9)).otherwise(0.0)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW_RATE)).cast("int")
    rates = sizes.select("source", "chars", rate.alias("rate")).withColumn("draws", draws)
    return stored(rates.withColumn("cdf", poisson_table(F.col("rate") / F.col("draws"))), "source-rates")


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in globally random order, and ``copy`` from 1 on.

    * The count depends on the seed, the id and the rate only.  Rows that share an id are repeated alike; a missing
      id counts as the empty text; a missing source is a source of its own; a source without a rate is left out.
    * Texts may be missing or empty; they take part as rows, but add no characters to their source.
    * An empty table stays empty.  Further columns are kept; ``copy`` is replaced.

    Rates are broadcast behind a check of their number; beyond it, documents are salted, so that a source with a
    third of all rows is spread.  The one shuffle of the texts deals rows out by a hash of id and copy, and sorts
    by it: every partition is a random part in random order.
    """
    names = [name for name in docs.columns if name != "copy"]
    docs = docs.select("doc_id", "source", whole_row(docs.select(names)).alias("row"))
    table = rates.select(F.col("source").alias("_source"), F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf"))
    same = docs["source"].eqNullSafe(table["_source"])
    if table.limit(ROWS_TO_BROADCAST + 1).count() <= ROWS_TO_BROADCAST:
        rows = docs.join(F.broadcast(table), same)
    else:
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn("_salt_of", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        rows = salted.join(table, salted["source"].eqNullSafe(table["_source"]) & (salted["_salt_of"] == table["_salt"]))
    count = copies_of(seed, F.col("doc_id"), F.col("_draws"), F.col("_cdf")).cast("int")
    copies = F.explode(F.sequence(F.lit(1), F.col("_n")))
    rows = rows.withColumn("_n", count).filter("_n > 0").withColumn("copy", copies)
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    return rows.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order").select(*row_fields(names), "copy")
