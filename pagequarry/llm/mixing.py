"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

A document's size is its number of words, its key an exponential variate divided by its quality weight.  Within
a source, keys rise and sizes are summed up to the source's budget of words: complete epochs come first, then the
documents with the least keys, the last of them in part.  Keys come from a hash of the row, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, fresh, join_classes, present, written

WORD = r"[^\x20\x09-\x0D]+"
SHARES, MOST_EPOCHS, SEED = (5, 2, 1), 3, 2024
#: Rows of a source that are sorted together, bins that its range of keys is cut into at a time, sources that may be broadcast.
BIN_ROWS, BINS, FEW_SOURCES = 5_000, 1_024, 10_000


def size_of(text: Column) -> Column:
    return F.regexp_count(present(text), F.lit(WORD)).cast("long")


def quality_of(text: Column) -> Column:
    """The share of letters among a text's code points, from 0.05 to 1."""
    letters = F.length(F.regexp_replace(present(text), r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.lit(1), F.length(present(text))))


def key_of(doc_id: Column, text: Column, quality: Column, seed: int = SEED) -> Column:
    """-ln(u) / quality for a u in (0, 1) that depends on the seed, the id and the text only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / quality


def source_key(source: Column) -> Column:
    """A join key that null has too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def places(sources: DataFrame) -> DataFrame:
    """One row per source, with its place (from 0) in code point order, null last: ranges of sources are numbered apart."""
    part = F.spark_partition_id().alias("part")
    dealt = written(sources.repartitionByRange(F.asc_nulls_last("source")).select("*", part), "ranges")
    offsets, n = [], 0
    for p, rows in sorted(map(tuple, dealt.groupBy("part").agg(F.count("*")).collect())):
        offsets.append((p, n))
        n += rows
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    first = F.broadcast(sources.sparkSession.createDataFrame(offsets, "part int, first long"))
    return dealt.withColumn("place", place).join(first, "part").withColumn("place", F.col("place") - 1 + F.col("first")).drop("part", "first")


def targets(sources: DataFrame, shares: tuple[int, ...] = SHARES, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source (source, source_size, ...) -> adds weight and target.

    Sources in code point order, null last, weigh shares, repeating, and share the sum of all sizes; none gets
    over most times its own size, and what is over is shared again by weight until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, shares)), (F.col("place") % len(shares) + 1).cast("int")).cast("double")
    out = places(sources).withColumn("weight", weight).withColumn("most", (F.col("source_size") * most).cast("double"))
    out = written(out.drop("place"), "weighted")
    total, weights = out.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, full, was = (total or 0.0) / (weights or 1.0), 0, -1
    while full != was:
        over = F.col("weight") * level >= F.col("most")
        was, (full, held, free) = full, out.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        level = (total - (held or 0.0)) / free if free else level
    return out.withColumn("target", F.least("most", F.col("weight") * level)).drop("most")


def cut_ranges(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """source_key, low, high, before, rest, copies: the range of keys in which each source's cut lies, BIN_ROWS rows of it or
    one key, and the words of the keys below.

    All sources are narrowed at once: the words of BINS bins of the range name the bin to go on with, whatever the
    distribution of the keys.
    """
    ends = slim.groupBy("source_key").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    state = goal.filter("rest > 0").select("source_key", "rest", "copies").join(ends, "source_key")
    state, done = written(state.withColumn("before", F.lit(0).cast("long")), "ranges"), []
    wide = (F.col("n") > BIN_ROWS) & (F.col("low") < F.col("high"))
    run = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        done.append(state.filter(~wide))
        open_ = state.filter(wide)
        if open_.isEmpty():
            break
        inside = join_classes(slim, open_, "source_key", "copies").filter("key BETWEEN low AND high")
        bin_ = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        words = [F.sum("size").alias("words"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")]
        totals = inside.withColumn("bin", bin_).groupBy("source_key", "rest", "bin", F.col("before").alias("start")).agg(*words)
        totals = totals.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        found = totals.filter("before < rest AND rest <= before + words").select("source_key", "rest", "low", "high", "n", "before")
        state = written(found.join(open_.select("source_key", "copies"), "source_key").select(*state.columns), "ranges")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def plan(sized: DataFrame, shares: tuple[int, ...] = SHARES, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_key, size, key) -> per source: source_size, target, epochs, cut_key, cut_words, copies."""
    sums = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("copies"))
    goal = targets(sums, shares, most).withColumn("budget", F.round("target").cast("long"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget DIV source_size")).otherwise(F.lit(0)).cast("long"))
    goal = written(goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "goal")
    slim = sized.filter("size > 0").select("source_key", "size", "key")
    near = join_classes(slim, cut_ranges(slim, goal), "source_key", "copies").filter("key BETWEEN low AND high")
    ties = near.groupBy("source_key", "key", "before", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    run = Window.partitionBy("source_key").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    cut = ties.filter("before < rest AND rest <= before + words").select("source_key", F.col("key").alias("cut_key"), F.expr("(rest - before) DIV rows").alias("cut_words"))
    return written(goal.join(cut, "source_key", "left").select("source_key", "source_size", "target", "epochs", "cut_key", "cut_words", "copies"), "plan")


def with_plan(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows with their source's plan: broadcast where the sources are counted to be few."""
    if made.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return rows.join(F.broadcast(made.drop("copies")), "source_key")
    return join_classes(rows, made, "source_key", "copies")


def taken(size: Column) -> Column:
    """Words taken of a row joined with its source's plan: rows with one key and text share the cut."""
    part = F.when(F.col("key") < F.col("cut_key"), size).when(F.col("key") == F.col("cut_key"), F.least(size, "cut_words")).otherwise(0)
    return (F.col("epochs") * size + F.coalesce(part, F.lit(0))).cast("long")


def sized(docs: DataFrame, quality: Column | None = None, seed: int = SEED) -> DataFrame:
    text = present(F.col("text"))
    quality = quality_of(F.col("text")) if quality is None else quality
    return docs.withColumns({"size": size_of(F.col("text")), "key": key_of(F.col("doc_id"), text, quality, seed), "source_key": source_key(F.col("source"))})


def mix(docs: DataFrame, shares: tuple[int, ...] = SHARES, most: int = MOST_EPOCHS, quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of docs (doc_id, text, source).

    A null or wordless text has size 0 and takes nothing; a null source is a source of its own, the last.  Rows
    alike in id and text share what is left where the cut falls on them.  An empty table gives no rows; further columns
    are ignored.  quality: the sampling weight, a column over docs, above 0.
    """
    slim = written(sized(docs.select("doc_id", "text", "source"), quality, seed).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "source_key", "size", "key"), "sized")
    made = plan(slim, shares, most)
    return with_plan(slim, made).select("doc_id", "source", "size", "source_size", "target", taken(F.col("size")).alias("taken"))


def mixture(docs: DataFrame, shares: tuple[int, ...] = SHARES, most: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the columns of docs, a row for each time a document is taken, the last perhaps in part.

    A document cut short keeps its first words, joined by single blanks, and its n_chars follows where there is one.
    Nulls, ties, repeated rows and empty tables are as in mix(); columns that clash with the names used here are carried.
    """
    names = docs.columns
    own = {"size", "key", "source_key", "source_size", "target", "epochs", "cut_key", "cut_words", "copies", "taken", "turn", "words"}
    renamed = {c: fresh(f"{c}_of_docs", names) for c in names if c.lower() in own}
    kept = docs.withColumnsRenamed(renamed)
    rows = sized(kept, seed=seed)
    slim = written(rows.select("source", "source_key", "size", "key"), "sized")
    made = plan(slim, shares, most)
    discard(slim)
    met = with_plan(rows, made).withColumn("taken", taken(F.col("size"))).filter("taken > 0")
    words = F.expr("CASE WHEN turn * size <= taken THEN size ELSE taken - (turn - 1) * size END")
    met = met.withColumn("turn", F.explode(F.expr("sequence(1L, (taken + size - 1) DIV size)"))).withColumn("words", words)
    short = F.col("words") < F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")
    met = met.withColumn("text", F.when(short, first).otherwise(F.col("text")))
    if "n_chars" in names:
        met = met.withColumn("n_chars", F.when(short, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return met.select(*[F.col(renamed.get(c, c)).alias(c) for c in names])
