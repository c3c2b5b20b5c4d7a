"""Line deduplication across documents with DataFrame expressions alone.

Each line is normalised and hashed; lines found in many documents leave all of
them but one. Only hashes are counted and joined: the texts are shuffled once,
to meet the list of the lines they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spreading import salted_join
from .text import ascii_lower

BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; none, or an empty text, is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated lines taken out of the text.

    A line's key is the line without blanks at its ends and in lower case
    (A-Z). A key of at least ``min_chars`` code points that is found in at
    least ``min_docs`` documents leaves all documents but the one with the
    largest id. ``n_lines`` (before) and ``n_dropped`` are added; columns of
    these names are replaced.

    Rows with the same id are one document: a key counts once for them, and all
    of them lose or keep its lines. A row without id takes no part and keeps its
    lines. A null text has one empty line and stays null; a text that loses
    every line becomes empty. An empty table gives an empty one.
    """
    key = docs[id_col]
    long_keys = F.array_distinct(
        F.transform(
            F.filter(F.transform(lines_of(docs[text_col]), line_key), lambda k: F.length(k) >= min_chars),
            _hash,
        )
    )
    held = docs.where(key.isNotNull()).select(key.alias("_id"), F.explode(long_keys).alias("_line"))
    spread = (
        held.groupBy("_line")
        .agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_stays"))
        .where(F.col("_n") >= min_docs)
        .select("_line", "_stays")
    )
    losses = (
        salted_join(held, spread, ["_line"], ["_id"])
        .where(F.col("_id") != F.col("_stays"))
        .groupBy("_id")
        .agg(F.collect_set("_line").alias("_lost"))
    )
    joined = docs.join(losses, key == losses["_id"], "left")
    lines = lines_of(joined[text_col])

    def stays(line: Column) -> Column:
        k = line_key(line)
        return (F.length(k) < min_chars) | ~F.array_contains(joined["_lost"], _hash(k))

    changed = joined["_lost"].isNotNull()
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    shaped = joined.select(
        *[joined[c] for c in others],
        joined[text_col].alias("_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(changed, F.filter(lines, stays)).alias("_kept"),
    )
    dropped = F.when(F.col("_kept").isNotNull(), F.col("n_lines") - F.size("_kept")).otherwise(0)
    text = F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col("_text"))
    columns = [
        text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c == text_col or c in others
    ]
    return shaped.select(*columns, "n_lines", dropped.cast("long").alias("n_dropped"))
