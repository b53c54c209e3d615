"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical without ASCII blanks ([\\x20\\x09-\\x0D]). A group
that is alone at one step takes no part in the next, so the 32-byte digests are compared
and shuffled only for rows whose length and prefix another row shares. All grouping is by
aggregates with map-side combine and joins on the digest, so a group with a third of all
rows is one aggregate row, and its members are never gathered in one task.

Defined cases: null text counts as empty; empty texts equal each other and texts of blanks;
a null doc_id ranks after every other; repeated rows are one group of which one row stays;
an empty table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut

BLANKS = "[\\x20\\x09-\\x0D]+"
KEY = ("doc_id", "chars", "length", "prefix")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id, stays.
    ``digest_all`` fills text_sha256 for every row (read in the first pass); without it
    texts are read again, and hashed, only for the groups that survive the first two steps.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.regexp_replace(text, BLANKS, "")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), plain.alias("_plain")).select(
        "doc_id",
        F.length("_text").alias("chars"),
        F.length("_plain").alias("length"),
        F.xxhash64(F.substring("_plain", 1, prefix_chars)).alias("prefix"),
        (F.unhex(F.sha2("_plain", 256)) if digest_all else F.lit(None).cast("binary")).alias("digest"),
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))

    # Steps 1 and 2: only (length) and then (length, prefix) groups of two rows or more go on.
    # Both look at counted kinds, so a group of many rows is one row here.
    kinds = rows.groupBy("length", "prefix").agg(F.count("*").alias("n"))
    lengths = rows.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length")
    prefixes = kinds.join(lengths, "length", "left_semi").filter("n > 1").select("length", "prefix")
    alive = rows.join(cut(prefixes), ["length", "prefix"], "left_semi")  # cut, so that a large group's rows can be split
    if not digest_all:
        # Rows that share all of KEY differ in nothing but the digest: any one-to-one match of them is right.
        copy = lambda order: F.row_number().over(Window.partitionBy(*KEY).orderBy(order))
        wanted = alive.drop("digest").withColumn("copy", copy("row"))
        ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
        full = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), plain.alias("_plain")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        full = full.select("doc_id", F.length("_text").alias("chars"), F.length("_plain").alias("length"), F.xxhash64(F.substring("_plain", 1, prefix_chars)).alias("prefix"), F.unhex(F.sha2("_plain", 256)).alias("digest")).withColumn("copy", copy("digest"))
        same = [wanted[c].eqNullSafe(full[c]) for c in (*KEY, "copy")]
        alive = wanted.join(full, same).select(*[wanted[c] for c in (*KEY, "row")], full["digest"])

    # Step 3: the full digest decides.
    best = F.max_by(F.struct("doc_id", "row"), F.struct("chars", F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("row")))
    groups = alive.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")).filter("n > 1")
    groups = cut(groups)
    found = rows if digest_all else rows.drop("digest").join(alive.select("row", "digest"), "row", "left")
    out = found.join(groups, "digest", "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
