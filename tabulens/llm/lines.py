"""Deletion of repeated line runs with a suffix array over line ids.

Every text is a sequence of lines (blank lines are left out of it). Suffixes are ranked by
distributed prefix doubling: rank 0 orders lines, rank k + 1 orders pairs of ranks 2^k lines
apart. Suffixes that agree on m lines form an interval of the suffix array whose longest common
prefix is at least m; ranks at the largest power of two within m, taken at both ends of the m
lines, name the interval. A run counts as repeated if it has at least `min_words` words. Every
such run is the union of its shortest qualifying stretches, one from each of its lines forwards
and one backwards, and equal lines give equal stretches; so the intervals of these stretches
reveal all maximal runs, and the depth of the array never exceeds `min_words` lines.

The first copy (smallest document id, then line) stays, lines of later copies are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _sequence(docs: DataFrame, id_col: str) -> DataFrame:
    """(key, no, owner, line, id, n): the non-blank lines of every different text; key is the
    text's digest, owner its smallest document id, no the place among the non-blank lines, line
    the place among all, id the line's digest, n its words."""
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("owner"), F.md5(text.cast("binary")).alias("key"), F.split(text, "\n", -1).alias("l"))
    part = F.transform("l", lambda x, i: F.struct(i.alias("line"), F.md5(x.cast("binary")).alias("id"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    rows = rows.select("owner", "key", F.posexplode(F.filter(part, lambda s: s["n"] > 0)).alias("no", "s")).select("owner", "key", "no", "s.*")
    return rows.groupBy("key", "no").agg(F.min("owner").alias("owner"), F.first("line").alias("line"), F.first("id").alias("id"), F.first("n").alias("n"))


def _rank(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Different values of `cols` with an increasing number `rank` in their order."""
    different = pairs.select(*cols).distinct()
    return cut_lineage(different.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id()))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start, m, first): stretches of m lines of the text `key` that are later copies, and
    where the first copy stands (its document and place). Their union gives all repeated runs."""
    seq = cut_lineage(_sequence(docs, id_col))
    again = seq.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    again = cut_lineage(again)  # a plain table on this side lets Spark split a line that fills much of the other
    d = seq.join(again, "id")
    own = Window.partitionBy("key").orderBy("no")
    d = d.withColumn("island", F.col("no") - F.row_number().over(own))  # neighbours that all occur twice
    isle = Window.partitionBy("key", "island")
    d = d.withColumn("total", F.sum("n").over(isle)).where(F.col("total") >= min_words)
    d = cut_lineage(d.select("key", "island", "no", "owner", "line", "id", "n"))

    # shortest stretches with min_words words from each line on, and up to each line
    step = isle.orderBy("no")
    d = d.withColumn("upto", F.sum("n").over(step.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = F.collect_list(F.struct("upto", "no")).over(step.rowsBetween(0, min_words - 1))
    back = F.collect_list(F.struct("upto", "n", "no")).over(step.rowsBetween(-(min_words - 1), 0))
    d = d.withColumns({"ahead": ahead, "back": back})
    first = F.get(F.filter("ahead", lambda x: x["upto"] - F.col("upto") + F.col("n") >= min_words), F.lit(0))["no"]
    last = F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(F.filter("back", lambda x: F.col("upto") - x["upto"] + x["n"] >= min_words), lambda x: x["no"])), -1)
    d = cut_lineage(d.select("key", "island", "no", "owner", "id", first.alias("stop"), last.alias("begin")))
    runs = d.where("stop is not null").select("key", "owner", F.col("no").alias("start"), (F.col("stop") - F.col("no") + 1).alias("m"))
    runs = runs.unionByName(d.where("begin is not null").select("key", "owner", F.col("begin").alias("start"), (F.col("no") - F.col("begin") + 1).alias("m"))).distinct()
    deepest = runs.agg(F.max("m")).first()[0] or 1

    # prefix doubling, as deep as the longest stretch needs
    ranks = cut_lineage(d.select("key", "island", "no", "id").join(_rank(d, ["id"]).withColumnRenamed("rank", "r0"), "id").drop("id"))
    k = 0
    while 2 << k <= deepest:
        ahead = F.lead(f"r{k}", 1 << k).over(step)
        both = ranks.withColumn("p", F.col(f"r{k}")).withColumn("q", F.coalesce(ahead, F.lit(-1)))
        both = cut_lineage(both)
        ranks = cut_lineage(both.join(_rank(both, ["p", "q"]).withColumnRenamed("rank", f"r{k + 1}"), ["p", "q"]).drop("p", "q"))
        k += 1
    at = ranks.select("key", "no", F.array(*[f"r{j}" for j in range(k + 1)]).alias("r"))
    level = F.floor(F.log2(F.col("m"))).cast("int")
    runs = runs.withColumn("level", level).withColumn("tail", F.col("start") + F.col("m") - F.expr("shiftleft(1, level)"))
    runs = runs.join(at.select("key", F.col("no").alias("start"), F.col("r").alias("x")), ["key", "start"]).withColumn("x", F.get("x", F.col("level")))
    runs = runs.join(at.select("key", F.col("no").alias("tail"), F.col("r").alias("y")), ["key", "tail"]).withColumn("y", F.get("y", F.col("level")))
    runs = cut_lineage(runs.withColumn("here", F.struct(F.coalesce("owner", F.lit((1 << 63) - 1)).alias("owner"), "key", "start")).select("key", "start", "m", "x", "y", "here"))
    interval = runs.groupBy("m", "x", "y").agg(F.min("here").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    interval = cut_lineage(interval)
    return runs.join(interval, ["m", "x", "y"]).where("here <> first").select("key", "start", "m", "first")


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with cleaned `text`, and n_lines (non-blank lines before) and n_removed.

    A row whose text another row with a smaller id also has is a later copy as a whole: all its
    lines go if they have min_words words together. Rows with equal id and text count as one
    document and get the same result; rows with a null id come last. Null texts stay null, with
    0 lines; empty texts and blank lines stay. Ids are integers. Columns of `docs` that are called
    n_lines or n_removed are replaced.
    """
    text = F.col("text").cast("string")
    runs = repeated_runs(docs, id_col, min_words)
    lost = runs.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("no")).distinct()
    lost = lost.groupBy("key").agg(F.collect_set("no").alias("_lost"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), text.alias("text"), F.md5(text.cast("binary")).alias("_key"), F.col(id_col).cast("long").alias("_id"))
    text = F.col("text")
    copies = keyed.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("_first"), F.count_distinct("_id").alias("_ids"), F.count_if(F.col("_id").isNull()).alias("_none"))
    copies = copies.where("_ids > 1 or _none > 0 or _first is null").select("_key", "_first")
    marks = lost.withColumnRenamed("key", "_key").join(copies, "_key", "full").withColumn("_copied", F.lit(True))
    d = keyed.join(marks, "_key", "left")
    all_lines = F.split(text, "\n", -1)
    d = d.withColumn("_lines", all_lines)
    filled = F.filter(F.transform(F.col("_lines"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    d = d.withColumn("_filled", filled)
    whole = F.coalesce(F.col("_first").isNotNull() & (F.col("_id").isNull() | (F.col("_id") > F.col("_first"))), F.lit(False)) & (F.regexp_count(text, F.lit(WORD)) >= min_words)
    d = d.withColumn("_gone", F.when(whole, F.col("_filled")).when(F.col("_lost").isNotNull(), F.transform("_lost", lambda p: F.get("_filled", p))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get("_lines", i))
    out = {c: F.col("_row").getField(c) for c in rest} | {"text": F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(text)}
    return d.select(*[v.alias(c) for c, v in out.items()], F.coalesce(F.size("_filled"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
