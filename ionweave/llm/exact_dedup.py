"""Exact dedup by deterministic naming of text blocks.

Every text, without its blanks, is cut into fixed-size blocks.  Distinct blocks are sorted
and numbered; the number is the block's name.  Then adjacent names are paired, distinct
pairs are sorted and numbered, and so on, until one name stands for a whole text.  Two texts
have the same identity exactly if they are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import spread_join, stored

BLOCK_CHARS = 4096
#: Rows alike in id, text and length travel as one row with a count; they are told apart again in runs of this many.
COPY_RUN = 65_536


def _named(distinct: DataFrame, *order: str, name: str) -> DataFrame:
    """The rows with integer names in sort order, as a table, so that names are fixed."""
    ranged = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("name", F.monotonically_increasing_id()), name)


def _blocks(rows: DataFrame, block_chars: int, block_hash) -> DataFrame:
    cut = F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = F.when(F.col("_norm") == "", F.array(F.lit(""))).otherwise(cut)
    return (rows.select("_id", "_sha", "_chars", F.size(cut).alias("n"), F.posexplode(cut).alias("pos", "block"))
            .withColumn("h", block_hash(F.col("block"))))


def block_identities(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """``(_id, _sha, level, name)``; equal ``(level, name)`` means equal texts.

    ``blocks`` has ``(_id, _sha, n, pos, block, h)``, and ``places`` the same without the texts, as a table.
    Blocks are sorted by a 64-bit hash, and by their text where blocks differ but hash alike, so texts cross the
    network once, pre-aggregated, to find the distinct blocks.
    """
    texts = blocks.groupBy("h", "block").agg(F.count("*").alias("rows"))
    hashes = stored(texts.groupBy("h").agg(F.count("*").alias("k"), F.sum("rows").alias("rows")), "block-hashes")
    simple = _named(hashes.filter("k = 1").select("h", "rows"), "h", name="block-names")
    slim = places.select("_id", "_sha", "n", "pos", "h")
    state = spread_join(slim, simple, ["h"], "rows", places.count()).select("_id", "_sha", "n", "pos", "name")
    clashes = hashes.filter("k > 1").select("h")
    if not clashes.isEmpty():  # different blocks with one hash: names by text, below all others
        told = _named(texts.join(clashes, "h").select("h", "block"), "h", "block", name="block-clashes")
        told = told.withColumn("name", -1 - F.col("name"))
        state = state.unionByName(blocks.join(told, ["h", "block"]).select("_id", "_sha", "n", "pos", "name"))
    state, level, done = stored(state.withColumn("level", F.lit(0)), "names-0"), 0, []
    while True:
        done.append(state.filter("n = 1").select("_id", "_sha", "level", "name"))
        rest = state.filter("n > 1")
        if rest.isEmpty():
            break
        level += 1
        left = F.max(F.when(F.col("pos") % 2 == 0, F.col("name")))
        right = F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
        pairs = (rest.groupBy("_id", "_sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                 .agg(left.alias("a"), right.alias("b"))
                 .withColumn("two", F.col("b").isNotNull()).withColumn("b", F.coalesce("b", "a")))
        pairs = stored(pairs, f"pairs-{level}")
        distinct = pairs.groupBy("a", "b", "two").agg(F.count("*").alias("rows"))
        names = _named(distinct, "a", "b", "two", name=f"pair-names-{level}")
        state = stored(spread_join(pairs, names, ["a", "b", "two"], "rows", pairs.count())
                       .select("_id", "_sha", "n", "pos", "name", F.lit(level).alias("level")), f"names-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def duplicate_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row; one row of every group is ``kept``.

    Texts are equal when identical without the blanks space, tab, LF, VT, FF and CR.  Of equal texts
    the longest original stays (code points), then the smallest id.

    * A missing text is the empty text; all empty texts are one group.
    * Rows with the same id are documents of their own, repeated rows too: each comes back, and of equally good ones with the
      smallest id one is kept.  A missing id comes after all others; where all ids of a group are missing, ``keep_id`` is.
    * A text of any length is a row of its blocks, and is named in as many rounds as the number of its blocks has bits.
    * An empty table gives an empty table; further columns are not read.

    Hot blocks, pairs and groups are counted with partial sums, and joined back where their rows are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm: Column = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    base = docs.select(F.col("doc_id").alias("_id"), F.length(text).alias("_chars"), norm.alias("_norm"))
    base = base.withColumn("_sha", F.sha2(F.col("_norm"), 256))
    # A document is known by its id and digest here; documents of one id and one digest share their identity.
    blocks = _blocks(base, block_chars, block_hash)
    places = stored(blocks.drop("block"), "block-places")
    named = block_identities(blocks, places).dropDuplicates(["_id", "_sha"]).withColumnsRenamed({"_id": "_nid", "_sha": "_nsha"})
    docs_of = places.filter("pos = 0").groupBy("_id", "_sha", "_chars").agg(F.count("*").alias("_copies"))
    rows = docs_of.join(named, F.col("_id").eqNullSafe(F.col("_nid")) & (F.col("_sha") == F.col("_nsha")))
    rows = stored(rows.select("_id", "_sha", "_chars", "_copies", "level", "name"), "identities")
    best = F.min(F.struct((-F.col("_chars")).alias("less"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    groups = rows.groupBy("level", "name").agg(F.sum("_copies").alias("group_size"), F.count("*").alias("_rows"), best.alias("best"))
    out = spread_join(rows, stored(groups, "identity-groups"), ["level", "name"], "_rows", rows.count())
    best_row = F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_chars") == -F.col("best.less"))
    run = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {COPY_RUN}")))
    out = out.withColumn("_run", run).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(COPY_RUN), F.col("_copies") - F.col("_run") * COPY_RUN))))
    return out.select(
        F.col("_id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size",
        (best_row & (F.col("_run") == 0) & (F.col("_copy") == 1)).alias("kept"), F.col("_sha").alias("text_sha256"))
