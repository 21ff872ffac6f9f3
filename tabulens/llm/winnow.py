"""Benchmark decontamination by winnowing.

Of every sliding window of `WINDOW` consecutive k-grams the one with the smallest hash (the
rightmost on ties) is kept. Two texts that share `SPAN` = K + WINDOW - 1 words share a kept
k-gram at the same place of that span, so a join on kept hashes finds every shared span. Hits
are then extended word by word, which also settles hash collisions. Items shorter than a span
have a single window, their whole text; documents are searched for it at every place.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

K, WINDOW = 6, 8
SPAN = K + WINDOW - 1
BROADCAST_ROWS = 1_000_000  # benchmark fingerprints (about 40 bytes each) that are broadcast at most
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words; letters in either case belong to words
PLACE = (1 << 30) - 1  # a text has fewer words than this
MARK = -1  # a row with this fingerprint stands for the document itself
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def words(text: Column) -> Column:
    """Words as they are written; compare them with A-Z lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK, -1), "")


def _gram(hashes: Column, at: Column, k: int) -> Column:
    """Hash of k words and their place in one long: a smaller hash first, then the later place."""
    h = F.xxhash64(F.lit(k), *[F.get(hashes, at + j) for j in range(k)])
    return F.shiftleft(h.bitwiseAND(F.lit((1 << 33) - 1)), 30) + (F.lit(PLACE) - at)


def _places(n: Column, k: int) -> Column:
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def fingerprints(d: DataFrame, short: list[int], whole: bool = False, mark: bool = False) -> DataFrame:
    """Rows of d (with array `words`) times kept k-grams: adds f (hash) and at (word place).

    `short` lists the lengths of the benchmark's short items, whose grams are kept at every
    place; with `whole` (the items themselves) a short text gives its one gram only. With `mark`
    every row also gives one with f = MARK, which is no hash.
    """
    # a word's hash ignores case in full: it can only bring more candidates, never lose one
    d = d.withColumn("_h", F.transform("words", lambda x: F.xxhash64(F.lower(x)))).withColumn("_n", F.size("_h"))
    d = d.withColumn("_g", F.transform(_places(F.col("_n"), K), lambda i: _gram(F.col("_h"), i, K)))
    spans = _places(F.size("_g"), WINDOW)
    kept = F.array_distinct(F.transform(spans, lambda i: F.array_min(F.slice(F.col("_g"), i + 1, WINDOW))))
    every = lambda n: F.transform(_places(F.col("_n"), n), lambda i: _gram(F.col("_h"), i, n))
    parts = [kept, *(F.when(F.col("_n") == n, every(n)).otherwise(F.array().cast("array<bigint>")) if whole else every(n) for n in short)]
    if mark:
        parts.append(F.array(F.lit(MARK).cast("bigint")))
    d = d.withColumn("_p", F.explode(F.concat(*parts) if len(parts) > 1 else kept))
    return d.withColumn("f", F.shiftright("_p", 30)).withColumn("at", (F.lit(PLACE) - F.col("_p").bitwiseAND(F.lit(PLACE))).cast("int")).drop("_h", "_n", "_g", "_p")


def _extend(hit: DataFrame) -> DataFrame:
    """Hits (words, item_words, at, item_at, item_n) to word ranges start (in), stop (out) of the
    document; looks at the neighbourhood that a span with this k-gram can reach. Marks stay, without a range."""
    fold = lambda x: F.translate(x, _UPPER, _LOWER)
    reach = F.least(F.lit(SPAN), F.col("item_n"))
    lo = F.greatest(F.lit(0), F.col("item_at") - (SPAN - K))
    hi = F.least(F.col("item_n"), F.col("item_at") + SPAN)
    same = lambda j: F.coalesce(fold(F.get("words", j + F.col("at") - F.col("item_at"))) == F.get("item_words", j), F.lit(False))
    hit = hit.withColumns({"lo": lo, "hi": hi}).withColumn("miss", F.filter(F.sequence(F.col("lo"), F.col("hi") - 1), lambda j: ~same(j)))
    hit = hit.withColumns({
        "a": F.coalesce(F.array_max(F.filter("miss", lambda j: j <= F.col("item_at"))) + 1, F.col("lo")),
        "b": F.coalesce(F.array_min(F.filter("miss", lambda j: j > F.col("item_at"))), F.col("hi"))})
    shift = F.col("at") - F.col("item_at")
    return hit.where((F.col("f") == MARK) | (F.col("b") - F.col("a") >= reach)).withColumns({"start": F.col("a") + shift, "stop": F.col("b") + shift})


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str) -> DataFrame:
    """(id_col, text_key, item_id, start, stop, n_words, times) from one pass over the documents: the ranges of
    shared_spans, and for every id and text one row without a range, with its words and the number of its rows."""
    items = cut_lineage(benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.transform(words(F.col("text").cast("string")), lambda x: F.translate(x, _UPPER, _LOWER)).alias("words"))
                        .where(F.size("words") > 0).withColumn("own", F.md5(F.array_join("words", " ").cast("binary"))).distinct())
    short = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # fewer than SPAN values
    grams = fingerprints(items, short, whole=True).select("f", F.col("at").alias("item_at"), "item_id", "own", F.size("words").alias("item_n"))
    text = F.col("text").cast("string")
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), words(text).alias("words"))
    slim = cut_lineage(grams)
    texts = items.select("own", F.col("words").alias("item_words")).distinct()
    n_words = F.size("words").cast("long")
    if slim.count() <= BROADCAST_ROWS:
        marked = slim.unionByName(slim.sparkSession.range(1).select(F.lit(MARK).cast("bigint").alias("f")), allowMissingColumns=True)
        hit = fingerprints(d, short, mark=True).join(F.broadcast(marked), "f").join(F.broadcast(texts), "own", "left")
        got = _extend(hit).withColumn("n_words", F.when(F.col("f") == MARK, n_words))
    else:
        near = fingerprints(d, short).select("id", "text_key", "f", "at").join(slim, "f")
        hit = near.join(d.withColumnRenamed("id", "_id").withColumnRenamed("text_key", "_key"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).drop("_id", "_key")
        got = _extend(hit.join(texts, "own")).select("id", "text_key", "item_id", "start", "stop").unionByName(d.select("id", "text_key", n_words.alias("n_words")), allowMissingColumns=True)
    return got.groupBy(F.col("id").alias(id_col), "text_key", "item_id", "start", "stop", "n_words").agg(F.count("*").cast("int").alias("times"))


def shared_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(id_col, text_key, item_id, start, stop): ranges of document words that stand in a window
    of an item. Ranges may overlap; their union is complete. text_key tells apart texts with one id."""
    return _found(docs, benchmark, id_col, item_col).where("start is not null").select(id_col, "text_key", "item_id", "start", "stop")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row per document row: (id_col, n_words, n_hit, n_items, items, contaminated).

    n_hit counts the document's words inside occurrences of item windows, each once; items are
    the ids (as sorted strings) with an occurrence. contaminated: n_hit > 0 and 20 n_hit >= n_words.
    Null and empty texts have no words and are never hit; items without words are skipped, items
    with a null id count, but have no id to be listed; an empty benchmark hits nothing. Rows with
    the same id and text get the same result.
    """
    both = cut_lineage(_found(docs, benchmark, id_col, item_col))
    spans = both.where("start is not null")
    own = Window.partitionBy(id_col, "text_key").orderBy("start", "stop")
    ranges = spans.select(id_col, "text_key", "start", "stop").distinct()
    ranges = ranges.withColumn("before", F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    hits = ranges.groupBy(id_col, "text_key").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce("before", F.lit(0))))).alias("n_hit"))
    listed = spans.select(id_col, "text_key", "item_id").distinct().groupBy(id_col, "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count("*").alias("n_items"))
    found = hits.join(listed.withColumnsRenamed({id_col: "_id", "text_key": "_key"}), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), "n_hit", "n_items", "items")
    every = both.where("start is null").select(id_col, "text_key", "n_words", "times")
    out = every.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))  # rows with one id and text share a result
    out = out.select(id_col, "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs` that are not contaminated."""
    bad = contamination(docs, benchmark, id_col).where("contaminated").select(F.col(id_col).alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    # the columns travel in one struct, so that none can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")
