"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a document are one window. A window that occurs elsewhere in
the corpus is kept where it stands first, in the order of (doc_id, line); at each later place
its three lines are covered. Covered positions are merged into runs and cut out.

Nothing but 16-byte window hashes and positions is shuffled to find repeats, and their counts
are combined before the shuffle, so a window that half of all documents hold costs each task
one row. What is to be cut returns to its document as one array of positions: by a broadcast
where the table of these arrays is small, so that no text is shuffled, else by a join that has
one row per document on either side.

Defined results: null text stays null and has no lines; an empty text has one empty line; a
document of fewer than three lines has no window and stays as it is; a window of three blank
lines never counts, as such lines are layout that nearly all texts share and say nothing about
a passage. Rows that share a doc_id (null included) and text are the same document,
each returned with the same result; among rows with one doc_id and different texts, windows are
ordered by the text's hash after the doc_id, and null comes before all ids. Extra columns stay,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.kit import cut, free_name, named, small

WINDOW = 3


def _windows(lines: Column, size: int) -> Column:
    """array<struct<h1, h2, pos>>: two independent 64-bit hashes of each window that isn't blank."""
    seeded = lambda seed: F.transform(lines, lambda x: F.xxhash64(F.lit(seed), x))
    blank = F.transform(lines, lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) == "")
    packed = F.struct(seeded(1).alias("a"), seeded(2).alias("b"), blank.alias("blank"))
    at = lambda p, field, i: F.get(p[field], i)

    def one(p: Column, i: Column) -> Column:
        spans = range(size)
        return F.struct(
            F.xxhash64(*(at(p, "a", i + F.lit(k)) for k in spans)).alias("h1"),
            F.xxhash64(*(at(p, "b", i + F.lit(k)) for k in spans)).alias("h2"),
            i.cast("int").alias("pos"),
            (~_all([at(p, "blank", i + F.lit(k)) for k in spans])).alias("counts"),
        )

    made = F.transform(F.array(packed), lambda p: F.transform(F.sequence(F.lit(0), F.size(lines) - size), lambda i: one(p, i)))
    return F.when(F.size(lines) >= size, F.filter(made[0], lambda w: w["counts"]))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out & x
    return out


def _without(lines: Column, starts: Column, size: int) -> Column:
    """``lines`` without the windows at ``starts`` (ascending): covered runs merged, then sliced out."""
    touching = lambda x, before: x <= before + F.lit(size)
    run_from = F.filter(starts, lambda x, i: (i == 0) | ~touching(x, F.get(starts, i - 1)))
    run_to = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | ~touching(F.get(starts, i + 1), x))
    gap_from = F.concat(F.array(F.lit(0)), F.transform(run_to, lambda x: x + F.lit(size)))
    gap_to = F.concat(run_from, F.array(F.size(lines)))
    pieces = F.zip_with(gap_from, gap_to, lambda a, b: F.slice(lines, a + F.lit(1), F.greatest(b - a, F.lit(0))))
    return F.flatten(pieces)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with ``text_col`` deduplicated, and the columns n_lines and n_removed (bigint).

    n_lines counts the lines before, n_removed those cut out. If all lines go, the text is empty.
    """
    cut_id, cut_key, lines, starts = (free_name(docs, x) for x in ("cut_id", "cut_key", "cut_lines", "cut_at"))
    text, text_key = named(text_col), F.xxhash64(named(text_col), F.lit(0))
    windows = docs.select(named(id_col).alias("id"), text_key.alias("key"), F.split(text, "\n", -1).alias("lines"))
    windows = windows.select("id", "key", F.explode(_windows(F.col("lines"), size)).alias("w")).select("id", "key", "w.h1", "w.h2", "w.pos")

    place = F.struct("id", "key", "pos")
    # The cut keeps both sides of the next join plain shuffles, which Spark splits where a window is hot.
    repeated = cut(
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"),
        "windows",
    )
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    cuts = cut(later.groupBy("id", "key").agg(F.sort_array(F.collect_set("pos")).alias("at")), "cuts")
    cuts = small(cuts).select(F.col("id").alias(cut_id), F.col("key").alias(cut_key), F.col("at").alias(starts))

    split = F.split(text, "\n", -1)
    joined = docs.join(cuts, named(id_col).eqNullSafe(F.col(cut_id)) & text_key.eqNullSafe(F.col(cut_key)), "left")
    joined = joined.withColumn(lines, F.when(F.col(starts).isNotNull(), _without(split, F.col(starts), size)))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long")
    n_kept = F.when(F.col(lines).isNull(), n_lines).otherwise(F.size(lines).cast("long"))
    out = {c: named(c) for c in docs.columns}
    out[text_col] = F.when(F.col(lines).isNull(), text).otherwise(F.array_join(lines, "\n"))
    return joined.select(*(v.alias(c) for c, v in out.items()), n_lines.alias(free_name(docs, "n_lines")), (n_lines - n_kept).alias(free_name(docs, "n_removed")))
