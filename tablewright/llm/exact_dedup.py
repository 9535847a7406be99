"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at the rows that still share their key with another row. Lengths and prefix hashes are numbers taken
during the scan; the full text is hashed only for rows whose length and prefix are shared, and no text is shuffled unless
the table of shared keys is too large to be sent to every task.

Rules: null text counts as empty; texts are equal when identical after lower-casing A-Z. The row with the largest id stays
(null is the smallest id). Rows that repeat an id together with an equal text are marked alike; ``drop_exact_duplicates``
leaves one of them. An empty table gives an empty result. Other columns are untouched; names starting with ``__dedup`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import ascii_lower, small_side, stored

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 512
LENGTH, PREFIX, FULL, ID = "__dedup_length", "__dedup_prefix", "__dedup_full", "__dedup_id"
SHARED, KEEP, SIZE, KEPT = "__dedup_shared", "__dedup_keep", "__dedup_size", "__dedup_kept"


def full_hash(text: str | Column) -> Column:
    """Hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(text), 256)


def _keyed(docs: DataFrame, text: str, prefix_chars: int) -> DataFrame:
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {LENGTH: F.octet_length(plain), PREFIX: F.xxhash64(ascii_lower(F.substring(plain, 1, prefix_chars)))}
    )


def shared_texts(docs: DataFrame, id_col: str, text: str, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per text that several rows share: length, prefix hash, full hash, the id that stays, rows."""
    plain = docs.select(F.col(id_col).alias(ID), F.col(text).alias("text"))
    lengths = plain.groupBy(F.octet_length(F.coalesce("text", F.lit(""))).alias(LENGTH)).count().filter("count > 1")
    lengths = small_side(stored(lengths.select(LENGTH), "dedup-lengths"))
    keyed = _keyed(plain, "text", prefix_chars)
    prefixes = keyed.join(lengths, LENGTH, "left_semi").groupBy(LENGTH, PREFIX).count().filter("count > 1")
    prefixes = small_side(stored(prefixes.select(LENGTH, PREFIX), "dedup-prefixes"))
    survivors = keyed.join(prefixes, [LENGTH, PREFIX], "left_semi")
    groups = (
        survivors.select(ID, LENGTH, PREFIX, full_hash("text").alias(FULL))
        .groupBy(LENGTH, PREFIX, FULL)
        .agg(F.max(ID).alias(KEEP), F.count(F.lit(1)).alias(SIZE))
        .filter(F.col(SIZE) > 1)
    )
    return stored(groups, "dedup-groups")


def _marked(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    groups = shared_texts(docs, id_col, text)
    # The keys of shared prefixes decide first; the full hash is only taken of rows that have one of them.
    shared = groups.select(LENGTH, PREFIX).distinct().withColumn(SHARED, F.lit(True))
    shared = small_side(stored(shared, "dedup-keys"))
    keyed = _keyed(docs, text, PREFIX_CHARS).join(shared, [LENGTH, PREFIX], "left")
    other = F.concat(F.lit("-"), F.col(PREFIX).cast("string"))  # no full hash, and spread over the tasks of a join
    keyed = keyed.withColumn(FULL, F.when(F.col(SHARED), full_hash(text)).otherwise(other))
    found = keyed.join(small_side(groups.drop(LENGTH, PREFIX)), FULL, "left")
    single = F.col(SIZE).isNull()
    found = found.withColumns(
        {
            KEEP: F.when(single, F.col(id_col)).otherwise(F.col(KEEP)),
            SIZE: F.when(single, F.lit(1).cast("long")).otherwise(F.col(SIZE)),
        }
    )
    return found.select(*docs.columns, KEEP, SIZE, FULL, F.col(id_col).eqNullSafe(F.col(KEEP)).alias(KEPT))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with keep_id, group_size and kept for every row; columns of these names are replaced."""
    new = {KEEP: "keep_id", SIZE: "group_size", KEPT: "kept"}
    old = [F.col(c) for c in docs.columns if c not in new.values()]
    return _marked(docs, id_col, text).select(*old, *(F.col(c).alias(name) for c, name in new.items()))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one per text, with the columns of ``docs``."""
    found = _marked(docs, id_col, text).filter(KEPT)
    alone = found.filter(F.col(SIZE) == 1)
    chosen = found.filter(F.col(SIZE) > 1).dropDuplicates([FULL])
    return alone.select(*docs.columns).unionByName(chosen.select(*docs.columns))
