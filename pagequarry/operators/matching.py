"""Joins of a page's boxes, terms and rows: matches by overlap, differences, caches, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, geometry as G, text as T
from ..runtime import written


def iou_pairs(blocks: DataFrame, rows: DataFrame, least: float = X.IOU_MATCH) -> DataFrame:
    """page_num, block, row, same, score: pairs of a page that overlap enough; a row without a box pairs by id."""
    b = blocks.select("page_num", F.col("ord").alias("block"), F.col("box").alias("b"))
    r = rows.select("page_num", F.col("ord").alias("row"), F.col("box").alias("r"))
    same = F.col("block") == F.col("row")
    score = F.when(F.col("r").isNull(), F.when(same, F.lit(least))).otherwise(G.iou(F.col("b"), F.col("r")))
    return b.join(r, "page_num").select("page_num", "block", "row", same.alias("same"), score.alias("score")).filter(F.col("score") >= least)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """page_num, block, row: best pair first, each side used once.

    Order: score, same id, block and row, all descending.  A fold over the page's sorted pairs.
    """
    item = F.struct("score", "same", "block", "row")
    pages = pairs.groupBy("page_num").agg(F.reverse(F.array_sort(F.collect_list(item))).alias("all"))
    start = F.array().cast("array<struct<block:bigint,row:bigint>>")

    def take(used: Column, p: Column) -> Column:
        clash = F.exists(used, lambda u: (u["block"] == p["block"]) | (u["row"] == p["row"]))
        pair = F.struct(p["block"].cast("long").alias("block"), p["row"].cast("long").alias("row"))
        return F.when(clash, used).otherwise(F.concat(used, F.array(pair)))

    return pages.select("page_num", F.explode(F.aggregate("all", start, take)).alias("m")).select("page_num", "m.block", "m.row")


def unmatched(rows: DataFrame, matches: DataFrame, has_text: Column) -> DataFrame:
    """page_num, n_rows: rows with text that no block took."""
    free = rows.filter(has_text).join(matches.select("page_num", F.col("row").alias("ord")), ["page_num", "ord"], "left_anti")
    return free.groupBy("page_num").agg(F.count("*").alias("n_rows"))


def review_changes(old: DataFrame, new: DataFrame, moved_by: float = X.MOVED_POINTS) -> DataFrame:
    """page_num, ord, change of every box on a page that has edited rows: removed, drawn, moved or kept."""
    pages = new.select("page_num").distinct()
    o = old.join(pages, "page_num", "left_semi").select("page_num", "ord", F.col("box").alias("o"))
    n = new.select("page_num", "ord", F.col("box").alias("n"))
    far = [F.abs(F.col(f"o.{c}") - F.col(f"n.{c}")) > moved_by for c in ("x0", "y0", "x1", "y1")]
    change = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "drawn").when(far[0] | far[1] | far[2] | far[3], "moved").otherwise("kept")
    return o.join(n, ["page_num", "ord"], "full_outer").select("page_num", "ord", change.alias("change"))


def valid_term(src: Column, tgt: Column) -> Column:
    """Terms that can't corrupt text: not too short, not digits, not a no-op, 30 characters at most."""
    k, v = T.strip(src), T.strip(tgt)
    sized = (F.length(k) > 0) & (F.length(v) > 0) & (F.length(k) <= 30) & (F.length(v) <= 30) & (k != v)
    digits = F.regexp_replace(k, " ", "").rlike(r"^\p{Nd}+\z")
    long_enough = F.when(T.has_cjk(k), F.length(k) >= 2).otherwise((F.length(k) >= 3) & (T.letters(k) >= 3))
    return F.coalesce(sized & ~digits & long_enough, F.lit(False))


def load_terms(terms: DataFrame) -> DataFrame:
    """Valid terms, one per key, keys and values stripped: curated before glossary before automatic ones.

    Of one tier the last entry wins, but the first of the glossary.
    """
    good = terms.filter(valid_term(F.col("src"), F.col("tgt"))).withColumns({"src": T.strip(F.col("src")), "tgt": T.strip(F.col("tgt"))})
    tier = F.when(F.col("tier") == "curated", 0).when(F.col("tier") == "glossary", 1).otherwise(2)
    best = Window.partitionBy("src").orderBy(tier, F.when(F.col("tier") == "glossary", F.col("ord")).otherwise(-F.col("ord")))
    return good.withColumn("turn", F.row_number().over(best)).filter("turn = 1").drop("turn")


def exact_terms(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Blocks whose stripped text is a curated term, with its translation."""
    curated = terms.filter("tier = 'curated'").select(F.col("src").alias("key"), "tgt")
    return blocks.withColumn("key", T.strip(F.col("text"))).join(curated, "key").drop("key")


def term_hits(texts: DataFrame, terms: list[tuple[str, str]], ignore_case: bool = False) -> DataFrame:
    """The rows of texts (text) once for each term that occurs in them, as src.

    terms is a validated dictionary held by the driver.  Its patterns are tested in one pass over each text, each only
    where its key occurs at all, so nothing is joined and a text is read once however many terms there are.
    """
    low = F.lower("text") if ignore_case else F.col("text")

    def found(key: str) -> Column:
        if T.holds_cjk(key):
            return F.when(F.col("text").contains(key), F.lit(key))
        k = key.lower() if ignore_case else key
        return F.when(F.col("term_text").contains(k) & F.col("term_text").rlike(T.bounded(k)), F.lit(key))

    hits = F.array_compact(F.array(*[found(k) for k, _ in terms]))
    return texts.withColumn("term_text", low).withColumn("src", F.explode_outer(hits)).filter("src IS NOT NULL").drop("term_text")


#: Terms whose patterns are held by the driver; terms, and MB of them, that are broadcast at once.
FEW_TERMS, TERMS_AT_ONCE, TERMS_MB = 64, 100_000, 32
_WIDE = r"[^\x00-\x7f]"
_WIDE_PAIR = rf"(?s){_WIDE}.|.{_WIDE}"


def _wide_pairs(text: Column) -> Column:
    """Every two neighbouring characters that aren't both ASCII."""
    pairs = F.regexp_extract_all(text, F.lit(rf"(?s)(?=({_WIDE}.|.{_WIDE}))"), F.lit(1))
    return F.when(text.rlike(_WIDE), pairs).otherwise(F.array().cast("array<string>"))


def term_join(texts: DataFrame, terms: DataFrame, ignore_case: bool = False) -> DataFrame:
    """The rows of texts (text) once for each term (src, ...) that occurs in them, with the term's columns.

    term_hits() for dictionaries of any size: a term is looked up by the first run of ASCII letters and digits in it,
    which stands whole in any text that holds the term, or by its first two neighbouring characters that aren't both
    ASCII; then it is verified.  With ignore_case, keys without CJK match in either case.  The terms are counted: a few
    are tested by term_hits(), others broadcast in as many parts as they need, so no text is ever shuffled.  Of one src
    one row counts.
    """
    if len(few := terms.select("src").distinct().limit(FEW_TERMS + 1).collect()) <= FEW_TERMS:
        hits = term_hits(texts, [(r.src, "") for r in few if r.src], ignore_case)
        return hits.join(F.broadcast(terms.dropDuplicates(["src"])), "src")
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    src, t = F.col("src"), F.col("text")
    cjk = T.has_cjk(src)
    key = F.when(cjk, src).otherwise(fold(src))
    run, pair = F.regexp_extract(key, "[A-Za-z0-9]+", 0), F.regexp_extract(key, _WIDE_PAIR, 0)
    anchor = F.when(cjk | (run == ""), F.when(pair != "", pair).otherwise(F.substring(key, 1, 2))).otherwise(run)
    keyed = terms.dropDuplicates(["src"]).withColumns({"term_key": key, "term_cjk": cjk, "anchor": anchor})
    runs = F.regexp_extract_all(fold(t), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    pairs = [_wide_pairs(t), _wide_pairs(fold(t))] if ignore_case else [_wide_pairs(t)]
    seen = texts.withColumn("anchor", F.explode_outer(F.array_distinct(F.concat(runs, *pairs))))  # outer: else computed twice
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), "term_key", F.lit(r"\E(?![A-Za-z0-9])"))
    whole = F.col("term_key") == F.col("anchor")  # a run is bounded by what it is
    holds = F.when(F.col("term_cjk"), t.contains(F.col("term_key"))).when(whole & F.col("anchor").rlike(r"^[A-Za-z0-9]+\z"), True).otherwise(F.regexp_like(fold(t), pattern))
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    parts = max(1, -(-n // TERMS_AT_ONCE), -(-size // (TERMS_MB << 20)))
    keyed = keyed if parts == 1 else written(keyed.withColumn("part", F.pmod(F.xxhash64("src"), F.lit(parts))), "terms")
    found = None
    for k in range(parts):
        some = keyed if parts == 1 else keyed.filter(F.col("part") == k).drop("part")
        hits = seen.join(F.broadcast(some), "anchor").filter(holds).drop("anchor", "term_key", "term_cjk")
        found = hits if found is None else found.unionByName(hits)
    return found


def hints(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term_join() in either case with both tiers (ord, src, tgt, tier): of one key the curated value, at the automatic one's place."""
    key = Window.partitionBy("src")
    value = F.max_by("tgt", F.struct((F.col("tier") != "auto").cast("int"), F.col("ord"))).over(key)
    place = F.min(F.struct((F.col("tier") != "auto").cast("int").alias("late"), "ord")).over(key)
    one = terms.withColumns({"tgt": value, "place": place, "turn": F.row_number().over(key.orderBy("ord"))}).filter("turn = 1")
    return term_join(texts, one.select("src", "tgt", F.col("place").alias("ord")), ignore_case=True)


def grounded_terms(proposed: DataFrame, known: DataFrame, hits: DataFrame, translations: DataFrame) -> DataFrame:
    """Proposed (src, tgt) that are valid, new, and occur in a source text (hits: src) and a translation (tgt)."""
    fresh = proposed.filter(valid_term(F.col("src"), F.col("tgt"))).join(known.select("src"), "src", "left_anti")
    return fresh.join(hits.select("src").distinct(), "src", "left_semi").join(translations.select("tgt").distinct(), "tgt", "left_semi")


def cache_split(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """blocks with translated_text and from_cache: cache is (cache_key, cached) by the hash of the stripped text."""
    raw = T.strip(F.col("text"))
    keyed = blocks.withColumn("cache_key", F.when(raw != "", T.cache_key(raw)))
    return keyed.join(cache, "cache_key", "left").withColumn("from_cache", F.col("cached").isNotNull()).withColumnRenamed("cached", "translated_text")


def cache_entries(blocks: DataFrame) -> DataFrame:
    """cache_key, cached: one entry per distinct stripped text that has a translation, the last by page and id."""
    raw, out = T.strip(F.col("text")), T.strip(F.coalesce("translated_text", F.lit("")))
    good = blocks.filter((raw != "") & (out != "")).select(T.cache_key(raw).alias("cache_key"), F.struct("page_num", "id", out.alias("cached")).alias("e"))
    return good.groupBy("cache_key").agg(F.max("e").alias("e")).select("cache_key", "e.cached")


def write_back(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """blocks with translated_text by (page_num, id), empty where there is none."""
    return blocks.join(translations.select("page_num", "id", "translated_text"), ["page_num", "id"], "left").fillna({"translated_text": ""})


def assemble(base: DataFrame, delta: DataFrame, key: str = "page_num") -> DataFrame:
    """Pages of delta, and of base where delta has none."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def overlap_text(boxes: DataFrame, strings: DataFrame) -> DataFrame:
    """page_num, ord, text: the strings (page_num, n, box, text) whose boxes overlap a box, in order, joined by blanks."""
    b = boxes.select("page_num", "ord", F.col("box").alias("b"))
    s = strings.select("page_num", "n", F.col("box").alias("s"), "text")
    hit = b.join(s, "page_num").filter(G.intersection(F.col("b"), F.col("s")) > 0)
    return hit.groupBy("page_num", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))


def page_range(spec: str, pages: DataFrame, n_pages: Column, web: bool = True) -> DataFrame:
    """Pages that a range like "1-3, 5" names; unreadable parts are passed over, and none named means all."""
    text = spec or ""
    if web:
        text = text.translate(str.maketrans("，－—", ",--"))
    parts = F.filter(F.transform(F.split(F.lit(text), ","), T.strip), lambda p: p != "")
    number = lambda p: T.strip(p).try_cast("int")
    halves = F.transform(parts, lambda p: F.split(p, "-"))
    read = F.transform(halves, lambda h: F.struct(number(h[0]).alias("a"), number(F.element_at(h, -1)).alias("b"), F.size(h).alias("n")))
    spans = F.filter(read, lambda r: (r["n"] <= 2) & r["a"].isNotNull() & r["b"].isNotNull())
    named = F.exists(spans, lambda r: (F.col("page_num") >= r["a"]) & (F.col("page_num") <= r["b"]) & (F.col("page_num") >= 1) & (F.col("page_num") <= n_pages))
    nothing = ~F.exists(spans, lambda r: F.greatest(r["a"], F.lit(1)) <= F.least(r["b"], n_pages))
    return pages.filter(named | nothing)
