"""Line dedup: drop lines that many documents share, except in one of them.

Lines are exploded, normalised and hashed; documents are counted per hash; lines over the
threshold go, and the rest is put together by position.  Only hashes and positions are
shuffled for counting; the texts move once, for the reassembly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import BLANKS, ascii_lower, spread_join, stored, whole_row


def _lines(text):
    return F.split(text, "\n", -1)


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines`` and ``n_dropped`` added.

    A line's key is the line without blanks at its ends, A-Z lower-cased.  A key of at least
    ``min_chars`` code points in at least ``min_docs`` documents loses all its lines but those
    of the largest ``doc_id`` that has it.

    * A missing or empty text is one empty line, and comes back as the empty text.
    * Rows that share an id are one document for the count; rows without id are one document,
      below every other.  Each row keeps its own lines; repeated rows are treated alike.
    * An empty table stays empty.  Further columns are kept; ``n_lines`` and ``n_dropped`` are replaced.
    * Keys are compared by two 64-bit hashes together.

    A key in a third of all documents is pre-aggregated for the count, and joined back where
    its rows are.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text, names = F.coalesce(F.col("text"), F.lit("")), docs.columns
    lines = docs.select("doc_id", F.xxhash64(text).alias("_row"), F.posexplode(_lines(ascii_lower(text))).alias("_pos", "_line"))
    keyed = lines.withColumn("_key", F.btrim("_line", F.lit(BLANKS))).filter(F.length("_key") >= min_chars)
    keyed = stored(keyed.select("doc_id", "_row", "_pos", F.xxhash64("_key").alias("_a"),
                                F.xxhash64(F.lit(1), "_key").alias("_b")), "line-keys")
    shared = (keyed.groupBy("_a", "_b", "doc_id").agg(F.count("*").alias("_n")).groupBy("_a", "_b")
              .agg(F.count("*").alias("_docs"), F.sum("_n").alias("_rows"), F.max("doc_id").alias("_keeper")).filter(F.col("_docs") >= min_docs))
    shared = stored(shared, "shared-lines")
    gone = (spread_join(keyed, shared, ["_a", "_b"], "_rows", keyed.count()).filter(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
            .groupBy("doc_id", "_row").agg(F.collect_set("_pos").alias("_gone")))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_of"), "_gone")
    rows = docs.select(whole_row(docs).alias("row"), "doc_id", F.xxhash64(text).alias("_row"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["_row"] == gone["_of"]), "left")
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    split = _lines(text)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "_gone"), lambda i: split[i])
    left = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    return rows.select(*[left if name == "text" else F.col("row")[name].alias(name) for name in names],
                       F.size(split).cast("bigint").alias("n_lines"),
                       F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"))
