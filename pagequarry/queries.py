"""Registered queries, one or more for each family of operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import check as K, fixed as X, geometry as G, text as T
from .operators import batching as B, cascade as C, layout as L, lettering as Y, matching as M, policy as Q, review as V
from .plans import relations as R
from .runtime import new_path, spread, written
from .sources import files as S, replies as P
from .streaming import pages as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The curated terms of the sample dictionary that pass validation, in order.
TERMS = [("魔術師", "魔法师"), ("魔術", "魔术"), ("Theo", "西奥"), ("The", "那"), ("Thing", "物"), ("那", "这"), ("der", "该"), ("tion", "词")]
PAGE_SPECS = ["1-3, 5，8－9", "", "abc", "0,99", "-3", "1-2-3", "48-60,2", "7", "9-3", " 4 - 6 "]
PAGES = 50


def query(f: Query) -> Query:
    QUERIES[f"q_{f.__name__}"] = f
    return f


@query
def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = C.classify(R.blocks(spark, sf_dir), TERMS)
    return routed.groupBy("lang", "route").agg(F.count("*").alias("n_blocks"), F.sum(F.length("cleaned_text")).alias("n_chars"))


@query
def clean_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", T.clean_input(F.col("text"), TERMS).alias("cleaned_text"))


@query
def meaningful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", T.is_meaningful(F.col("text")).alias("meaningful"))


@query
def gibberish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", T.is_gibberish(F.col("text")).alias("gibberish"))


@query
def noise_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", F.coalesce(T.noise_reason(F.col("text")), F.lit("text")).alias("reason"))


@query
def noise_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", F.coalesce(T.local_noise_reason(F.col("text")), F.lit("text")).alias("reason"))


@query
def polish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    draft = F.when(F.col("id") % 2 == 0, "你好吗").otherwise("是")
    return R.blocks(spark, sf_dir).select("page_num", "id", T.worth_polishing(F.col("text"), draft).alias("polish"))


@query
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.when(F.col("lang") == "es", "Korean").otherwise("English")
    return R.blocks(spark, sf_dir).groupBy("lang", T.source_language(F.col("text"), declared).alias("detected")).agg(F.count("*").alias("n_blocks"))


@query
def clean_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", T.clean_output(F.col("text")).alias("cleaned"))


@query
def lettering_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", T.lettering_marks(F.col("text")).alias("marked"))


@query
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.blocks(spark, sf_dir)
    return b.select("page_num", "id", T.is_refusal(F.col("text")).alias("refusal"), T.accepted(F.col("text")).alias("accepted"), T.is_chinese_target(F.col("lang")).alias("chinese"))


@query
def term_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = R.sample_terms(spark).select("src", "tgt")
    parts = R.read(spark, sf_dir, "part").select(F.col("p_name").alias("src"), F.col("p_brand").alias("tgt"))
    return sample.unionByName(parts).select("src", "tgt", M.valid_term(F.col("src"), F.col("tgt")).alias("valid"))


@query
def load_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.load_terms(R.sample_terms(spark)).select("src", "tgt", "tier")


@query
def term_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_terms(R.blocks(spark, sf_dir), M.load_terms(R.sample_terms(spark))).select("page_num", "id", "tgt")


def _tiers(spark: SparkSession) -> DataFrame:
    """The sample's valid terms by tier, curated ones over automatic ones of the same key kept apart."""
    good = R.sample_terms(spark).filter(M.valid_term(F.col("src"), F.col("tgt")))
    return good.select("ord", T.strip(F.col("src")).alias("src"), T.strip(F.col("tgt")).alias("tgt"), "tier")


@query
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame(TERMS, "src string, tgt string")
    return M.term_join(R.blocks(spark, sf_dir).select("page_num", "id", "text"), terms).select("page_num", "id", "src")


@query
def term_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of both tiers that the prompt of a page names, in either case; curated values win."""
    hits = M.hints(R.blocks(spark, sf_dir).select("page_num", "id", "text"), _tiers(spark))
    return hits.groupBy("src", "tgt", F.col("ord").cast("struct<late:int,ord:int>").alias("place")).agg(F.count("*").alias("n_blocks")).select("src", "tgt", F.col("place.late").alias("late"), "n_blocks")


@query
def term_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = R.sample_terms(spark).select("src", "tgt").unionByName(spark.createDataFrame([("thing", "东西"), ("stop", "停"), ("nothere", "无")], "src string, tgt string"))
    keys = proposed.filter(M.valid_term(F.col("src"), F.col("tgt")))
    hits = M.term_join(R.blocks(spark, sf_dir).select("page_num", "id", "text"), keys.select("src").distinct())
    said = spark.createDataFrame([("停",), ("东西",), ("西奥",), ("词",)], "tgt string")
    known = M.load_terms(R.sample_terms(spark).filter("ord < 5"))
    return M.grounded_terms(proposed, known, hits, said).distinct()


@query
def term_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", T.fold_terms(F.col("text"), TERMS).alias("folded"))


@query
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = T.strip(F.col("text"))
    digests = {"cache_key": T.cache_key(raw), "md5": F.md5(raw), "sha1": F.substring(F.sha1(raw), 1, 10), "dedup_key": T.dedup_key(F.col("text"))}
    return R.blocks(spark, sf_dir).select("page_num", "id", *[c.alias(n) for n, c in digests.items()])


@query
def series_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("図書館の大魔術師 第5巻.pdf",), ("One_Piece_Vol.12.pdf",), ("Title 05.pdf",), ("1984.pdf",), ("a/b/[tag] Some.Name ch 3.v2.pdf",), ("x 3巻.zip",), (".hidden",), ("Ｔｉｔｌｅ ０５.pdf",), ("Foo Ｖｏｌ．１２.pdf",), ("ﾀｲﾄﾙ　第③巻.pdf",)], "name string")
    names = names.unionByName(R.read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" Vol."), "p_size", F.lit(".pdf")).alias("name"))).distinct()
    key = T.series_key(T.without_extension(F.col("name")))
    return names.select("name", key.alias("series"), T.safe_file_name(key).alias("file"))


@query
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.read(spark, sf_dir, "part").select(F.col("p_size").alias("page_num")).distinct()
    parts = [M.page_range(s, pages, F.lit(PAGES), web).select(F.lit(k).alias("spec"), F.lit(web).alias("web"), "page_num") for k, s in enumerate(PAGE_SPECS) for web in (True, False)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_texts(R.blocks(spark, sf_dir)).select("page_num", "id")


@query
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = R.blocks(spark, sf_dir)
    cache = M.cache_entries(blocks.filter("lang = 'en'").withColumn("translated_text", F.concat(F.lit("译"), T.strip(F.col("text")))))
    return M.cache_split(blocks, cache).select("page_num", "id", "from_cache", F.sha2("translated_text", 256).alias("translated_sha256"))


@query
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = R.blocks(spark, sf_dir)
    done = blocks.filter("id % 3 = 0").select("page_num", "id", F.concat(F.lit("译"), "text").alias("translated_text"))
    out = M.write_back(blocks, done)
    return out.groupBy("page_num").agg(F.count("*").alias("n_blocks"), F.sum(F.length("translated_text")).alias("n_chars"))


@query
def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's lines, the curated terms that occur in them, and the hint of a retry."""
    blocks = R.blocks(spark, sf_dir).select("page_num", "id", "text")
    terms = spark.createDataFrame([(k, *t) for k, t in enumerate(TERMS)], "ord int, src string, tgt string")
    out = C.prompts(blocks, M.term_join(blocks, terms, ignore_case=True), "再译一次。")
    return out.select("page_num", F.sha2("prompt", 256).alias("prompt_sha256"), F.length("prompt").cast("long").alias("n_chars"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated lines: the sample's, against a source, and every turn of the conversations against all of it but its last word."""
    sample = R.sample_lines(spark).select(F.lit(-1).cast("long").alias("page_num"), F.col("id").cast("long"), F.lit("OK!? Don't").alias("raw"), "text")
    said = spread(R.read(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("page_num"), F.col("turn").cast("long").alias("id"), F.regexp_replace("text", "[^ ]+$", "").alias("raw"), F.concat(F.lit("好"), "text").alias("text"))
    return sample.unionByName(said)


@query
def find_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.issues(F.col("text"), F.col("raw"))
    one = _lines(spark, sf_dir).select("page_num", "id", F.explode(F.array(found)).alias("f"))
    return one.select("page_num", "id", F.array_join("f.hard", "").alias("hard"), F.array_join("f.soft", "").alias("soft"), K.retry_characters(F.col("f")).alias("hint"))


@query
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("page_num", "id", K.sanitized(F.col("text"), F.col("raw")).alias("clean"))


@query
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.check_report(_lines(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n_lines"), F.sum(F.length("removed")).alias("n_removed"))


@query
def check_and_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    retry = lambda bad: bad.select("page_num", "id", F.when(F.col("id") % 2 == 0, "好的").when(F.col("hint").contains("こ"), "Нет").otherwise("不").alias("reply"))
    out = C.check_and_fix(_lines(spark, sf_dir), retry)
    return out.groupBy(F.coalesce("action", F.lit("fine")).alias("action"), "retries").agg(F.count("*").alias("n_lines"))


@query
def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flagged(_lines(spark, sf_dir))


@query
def warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.concat(F.lit("page "), F.col("page_num"), F.lit(" #"), F.col("id"))
    return C.warning(C.flagged(_lines(spark, sf_dir)), ["page_num", "id"], where)


@query
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dictionary translators in a row: the first knows a third of the blocks, the second half of the rest."""
    first = lambda left: left.select("page_num", "id", F.when((F.col("page_num") + F.col("id")) % 3 == 0, "好。").alias("reply"))
    second = lambda left: left.select("page_num", "id", F.when(F.col("id") % 2 == 0, "对不起").otherwise("行!?").alias("reply"))

    def broken(left: DataFrame) -> DataFrame:
        raise RuntimeError("no such model")

    out = C.translate(C.classify(R.blocks(spark, sf_dir), TERMS), [("broken", broken), ("first", first), ("second", second)], TERMS)
    return out.groupBy("translation_engine", F.when(F.col("translation_engine") == "digits", "#").otherwise(F.col("translated_text")).alias("translated_text")).agg(F.count("*").alias("n_blocks"))


@query
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = R.boxes(spark, sf_dir)
    return M.iou_pairs(boxes, R.moved_boxes(boxes)).select("page_num", "block", "row", "same", F.round("score", 6).alias("score"))


@query
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = R.boxes(spark, sf_dir)
    return M.greedy_match(M.iou_pairs(boxes, R.moved_boxes(boxes)))


@query
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = R.boxes(spark, sf_dir)
    moved = R.moved_boxes(boxes)
    return M.unmatched(moved, M.greedy_match(M.iou_pairs(boxes, moved)), F.col("was") % 2 == 1)


@query
def review_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = R.boxes(spark, sf_dir)
    edited = R.moved_boxes(boxes).filter("page_num % 3 = 0")
    return M.review_changes(boxes, edited).groupBy("page_num", "change").agg(F.count("*").alias("n_boxes"))


@query
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = R.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_num"), "o_orderstatus")
    base = orders.select("page_num", F.concat(F.lit("old"), "o_orderstatus").alias("path"))
    delta = orders.filter("o_orderstatus = 'O'").select("page_num", F.concat(F.lit("new"), "o_orderstatus").alias("path"))
    return M.assemble(base, delta)


@query
def overlap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = R.boxes(spark, sf_dir)
    strings = R.moved_boxes(boxes).select("page_num", F.col("was").alias("n"), "box", F.concat(F.lit("s"), F.col("was")).alias("text"))
    return M.overlap_text(boxes, strings)


@query
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flat(R.boxes(spark, sf_dir).filter(G.detected(F.col("conf") / 100, F.col("box"))))


@query
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.suppress(R.boxes(spark, sf_dir)).select("page_num", "ord")


@query
def drop_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drop_contained(R.boxes(spark, sf_dir)).select("page_num", "ord")


@query
def nested_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nested_duplicates(R.boxes(spark, sf_dir).withColumn("user_edited", F.col("conf") % 5 == 0)).select("page_num", "ord")


@query
def fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fuse(R.boxes(spark, sf_dir))


@query
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(R.boxes(spark, sf_dir), 140.0)


@query
def merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_regions(R.boxes(spark, sf_dir), 150)


@query
def grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grid_order(R.boxes(spark, sf_dir)).select("page_num", "ord", "id")


@query
def page_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_medians(R.boxes(spark, sf_dir)).select("page_num", "ord", "median_height", "page_direction")


@query
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    px = G.scaled(b, F.lit(1.7), F.lit(300), F.lit(400))
    back = G.unletterboxed(b["x0"] * 1.0, b["y0"] * 1.0, (b["x1"] - b["x0"]) * 1.0, (b["y1"] - b["y0"]) * 1.0, F.lit(0.5), F.lit(12.0), F.lit(0.0), F.lit(200), F.lit(300))
    on = G.lettering_on(b["x0"] % 256, b["y0"] % 256, b["x1"] % 256)
    return R.boxes(spark, sf_dir).select("page_num", "ord", "conf", *[px[c].cast("long").alias(f"px_{c}") for c in ("x0", "y0", "x1", "y1")], *[back[c].alias(f"pt_{c}") for c in ("x0", "y0", "x1", "y1")], on.alias("lettering"))


@query
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, gap = F.col("box"), F.col("conf")
    vote = F.when(F.col("page_num") % 3 == 0, "vertical").when(F.col("page_num") % 3 == 1, "horizontal")
    return R.boxes(spark, sf_dir).select("page_num", "ord", G.orientation(b, gap % 7, F.floor(gap / 7) % 7, vote).alias("direction"))


@query
def font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([("0",), ("-1",), ("NaN",), ("2",), ("999",), ("12.34",), ("abc",), (None,)], "given string")
    parts = R.read(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("given")).distinct()
    return given.unionByName(parts).select("given", G.clean_font_size(F.col("given")).alias("points"))


@query
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours in which a user did something with a value over 10."""
    e = R.read(spark, sf_dir, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), (F.col("value") > 10).alias("on"))
    profile = e.groupBy("user_id", "hour").agg(F.max("on").alias("inked")).filter("inked")
    return L.runs(profile, "user_id", "hour", "inked")


@query
def pack_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pack_before(R.turns(spark, sf_dir))


@query
def pack_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pack_after(R.turns(spark, sf_dir))


@query
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_stream as a stream over the same files: the pages of a document may come in any of them, in any order."""
    source = "conv_id long, turn long, role string, text string"
    n = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", " ")) % 9)
    come = W.page_stream(spark, sf_dir, source, "conversations.parquet").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_num"), n.cast("long").alias("lines"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page_num", "lines")).cast("long")
    numbered = written(W.drain(come, "stream_come", "doc long, page_num long, lines long").withColumn("place", place), "numbered")
    pages = W.page_stream(spark, numbered.path, "doc long, page_num long, lines long, place long").select("doc", F.col("place").alias("page_num"), "lines")
    batches = W.drain(W.packed_in_order(pages), "stream_batches", W.BATCHES).select(F.col("doc").alias("of"), F.col("page_num").alias("at"), "batch")
    return numbered.join(batches, F.col("doc").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at"))).select("doc", "page_num", "lines", "batch")


@query
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.slices(R.blocks(spark, sf_dir), "page_num", ["id"]).select("page_num", "id", "slice")


@query
def halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.blocks(spark, sf_dir).groupBy("page_num").agg(F.count("*").alias("lines")).withColumnRenamed("page_num", "batch")
    return B.halves(lines).select("batch", F.col("part").cast("long").alias("part"), "part_lines")


@query
def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stage_stats(R.stats(spark, sf_dir))


@query
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = R.stats(spark, sf_dir)
    parts = calls.groupBy("tag", "part").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("completion_tokens"), F.sum((~F.col("ok")).cast("long")).alias("failed"))
    return B.merge_stats(parts)


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.throughput(R.stats(spark, sf_dir).select(F.col("tokens").alias("chars"), "seconds"))
    return out.select(F.round("chars_per_sec", 4).alias("chars_per_sec"), "acceptance_rate", F.round("latency_ms", 4).alias("latency_ms"), "chars")


@query
def engine_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = C.classify(R.blocks(spark, sf_dir), TERMS)
    return B.engine_counts(routed.withColumn("translation_engine", F.when(F.col("route") != "translate", F.col("route"))))


@query
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = R.read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    web = B.progress(F.col("n"), F.col("a"), F.col("b"), F.col("n"))
    cli = B.progress(F.col("n"), F.col("a"), F.col("b"), F.col("n"), 15, (15, 35, 30))
    return done.select("task", web.alias("web"), cli.alias("cli"))


REPLIES = [
    (1, '```json\n[{"id": 1, "trans": " 好 ", "sfx": false}, {"id": 2, "trans": "", "sfx": true}]\n```'), (2, '{"blocks": [{"id": 1, "trans": "是"}], "n": "1"}'),
    (3, '{"id": 3, "trans": "单"}'), (4, "not json"), (5, '```\n[{"id": 5, "trans": "五"}]\n```'), (6, ""),
]


@query
def reply_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of the corpus with the reply to its page, if any."""
    replies = spark.createDataFrame(REPLIES, "page_num long, reply string")
    out = P.corrections(R.blocks(spark, sf_dir).select("page_num", "id"), replies)
    return out.select("page_num", "id", "is_sfx", "translated_text")


STREAM = [
    (1, 1, 'data: {"choices":[{"delta":{"content":"你"}}]}'), (1, 2, ""), (1, 3, "data: {broken"), (1, 4, 'data: {"choices":[{"delta":{"content":"好"},"finish_reason":"stop"}]}'),
    (1, 5, 'data: {"choices":[],"usage":{"completion_tokens":7}}'), (1, 6, "data: [DONE]"), (1, 7, 'data: {"choices":[{"delta":{"content":"x"}}]}'), (2, 1, 'data:{"choices":[{"delta":{"content":"a"}}]}'), (2, 2, ": comment"),
]


@query
def streamed_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's calls and one call per conversation, a line per turn."""
    said = R.read(spark, sf_dir, "conversations")
    line = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.col("role"), F.lit('"}}]}'))
    calls = said.select((F.col("conv_id") + 1000).alias("call"), F.col("turn").cast("long").alias("n"), line.alias("line"))
    return P.streamed_reply(spark.createDataFrame(STREAM, "call long, n long, line string").unionByName(calls))


EDITS = [
    (1, '{"pages": {"3": [{"id": 1, "bbox": [0, 0, 10, 10], "text": "a", "raw": "r", "edited": true, "direction": "vertical", "font_size": "200"}, {"id": 1, "bbox": [0, 0, 0.5, 10]}], "4": []}}'),
    (2, '{"pages": {"0": [{"id": 1, "bbox": [0, 0, 10, 10]}], "x": []}}'), (3, "no"), (4, '{"pages": {"1": [{"id": "z", "bbox": [0, 0, 10, 10]}, {"id": 2}, {"id": 3, "bbox": [1, 2, 3]}, {"id": 4, "bbox": [1, 2, 30, 40], "direction": "odd"}]}}'),
]


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's documents and one per page of boxes."""
    b = F.col("box")
    row = F.struct(F.col("ord").cast("string").alias("id"), F.array(*[b[c].cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("bbox"), F.col("conf").cast("string").alias("font_size"))
    pages = R.boxes(spark, sf_dir).groupBy("page_num").agg(F.collect_list(row).alias("rows"))
    body = F.to_json(F.struct(F.create_map(F.lit("1"), F.col("rows")).alias("pages")))
    return spark.createDataFrame(EDITS, "doc long, body string").unionByName(pages.select((F.col("page_num") + 1000).alias("doc"), body.alias("body")))


@query
def editor_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.violations(P.editor_rows(_edits(spark, sf_dir)))


@query
def editor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = P.editor_rows(_edits(spark, sf_dir)).filter("problem IS NULL AND id IS NOT NULL")
    return P.blocks_of_rows(good).select("doc", "page_num", "id", "width", "height", "center_x", "center_y", "user_edited", "direction", "font_size_pt")


@query
def script_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the boxes as a script sheet and read it back."""
    b = R.boxes(spark, sf_dir)
    blocks = b.select("page_num", F.col("ord").alias("id"), F.concat(F.lit('=1+"'), F.col("ord"), F.lit("\nx")).alias("raw"), F.when(F.col("ord") % 2 == 0, "译").otherwise("").alias("translated"), F.col("box").alias("bbox"))
    path = new_path(spark, "script")
    S.write_script(blocks, path)
    return S.read_script(spark, path).select("page_num", "id", "raw", "text", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1"))


@query
def layout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages with runtime fields as JSON and read what is left."""
    b = F.struct("ord", F.col("conf").alias("_conf"), "box")
    pages = R.boxes(spark, sf_dir).groupBy("page_num").agg(F.array_sort(F.collect_list(b)).alias("blocks")).withColumn("_mask", F.lit("m"))
    path = new_path(spark, "layout")
    S.write_layout(pages, path)
    back = spark.read.schema("page_num long, _mask string, blocks array<struct<ord:bigint,_conf:bigint,box:struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>>").json(path)
    hidden = F.col("_mask").isNotNull() | F.exists("blocks", lambda x: x["_conf"].isNotNull())
    return back.select("page_num", F.size("blocks").cast("long").alias("n_blocks"), F.aggregate("blocks", F.lit(0).cast("long"), lambda s, x: s + x["box"]["x1"]).alias("sum_x1"), hidden.alias("hidden"))


@query
def fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.read(spark, sf_dir, "orders")
    pages = o.select(F.col("o_orderkey").alias("page_num"), (F.col("o_custkey") % 3).alias("images"), (F.col("o_orderkey") % 60).alias("chars"), (F.col("o_custkey") % 5).alias("valid_blocks"))
    return S.fast_or_deep(pages).groupBy("path_taken").agg(F.count("*").alias("n_pages"))


@query
def union_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct hard characters of a page's lines, in order of lines."""
    found = T.let(K.issues(F.col("text"), F.col("raw")), lambda f: f["hard"])
    lines = _lines(spark, sf_dir).select("page_num", F.struct("id", found.alias("hard")).alias("x")).groupBy("page_num").agg(F.array_sort(F.collect_list("x")).alias("l"))
    return lines.select("page_num", F.array_join(F.array_distinct(F.flatten(F.transform("l", lambda x: x["hard"]))), "").alias("hard"))


@query
def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.wrapped(F.col("text"), 12)
    return R.blocks(spark, sf_dir).select("page_num", "id", F.array_join(lines, "\n").alias("lines"))


@query
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.blocks(spark, sf_dir).groupBy("page_num", "lang").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("l"))
    text = T.joined_lines(F.transform("l", lambda x: x["text"]), F.col("lang") == "xx")
    return pages.select("page_num", F.md5(text).alias("text_md5"), T.one_of(F.col("lang"), ["en", "fr"], "other").alias("lang"))


@query
def box_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    size = F.lit(300), F.lit(250)
    at = G.window(b, *size, 64)
    return R.boxes(spark, sf_dir).select("page_num", "ord", G.character_shape(w, h, *size).alias("character"), G.line_shape(w, h, *size).alias("line"), *[at[c].cast("long").alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")])


@query
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine counts of pages merged over batches."""
    e = R.read(spark, sf_dir, "events")
    engine = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    parts = e.groupBy((F.col("event_id") % 20).alias("batch"), engine.alias("engine")).agg(F.count("*").alias("n_blocks"))
    return B.merge_engine_counts(parts)


@query
def ocr_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page in the crops that one call recognises."""
    return B.slices(R.boxes(spark, sf_dir), "page_num", ["ord"], 16).groupBy("slice").agg(F.count("*").alias("n_boxes"))


@query
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary files written and read: an object, a list, a broken file, none; the parts' names are an object too."""
    parts = R.read(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.struct(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value")).alias("e"))
    bodies = [("terms", '{"Theo": "西奥", "魔術": "魔术"}'), ("list", "[1, 2]"), ("broken", '{"a": '), ("blank", "")]
    whole = parts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e")))).alias("value"))
    out = S.read_dictionary(spark, new_path(spark, "none"), "none")
    for name, body in [*bodies, ("parts", None)]:
        path = new_path(spark, name)
        (whole if body is None else spark.createDataFrame([(body,)], "value string")).coalesce(1).write.text(path)
        out = out.unionByName(S.read_dictionary(spark, path, name))
    return out.select("src", "tgt", "tier")


@query
def text_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache written, read back and merged with new entries, the new ones over the old."""
    blocks = R.blocks(spark, sf_dir)
    path = new_path(spark, "cache")
    S.write_cache(M.cache_entries(blocks.filter("lang = 'en'").withColumn("translated_text", F.concat(F.lit("旧"), T.strip(F.col("text"))))), path)
    new = M.cache_entries(blocks.filter("id % 2 = 0").withColumn("translated_text", F.concat(F.lit("新"), T.strip(F.col("text")))))
    merged = M.assemble(S.read_cache(spark, path), new, "cache_key")
    return merged.select("cache_key", F.sha2("cached", 256).alias("cached_sha256"))


@query
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each script the blocks of a language have."""
    names = [*(n for n, _ in K.SCRIPTS), "symbol"]
    each = R.blocks(spark, sf_dir).select("lang", F.explode(F.array(K.script_counts(F.col("text")))).alias("n"))  # explode: computed once
    sums = each.groupBy("lang").agg(*[F.sum(f"n.{c}").alias(c) for c in names])
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("script"), F.col(c).alias("n_tokens")) for c in names])).alias("x")
    return sums.select("lang", one).select("lang", "x.script", "x.n_tokens").filter("n_tokens > 0")


@query
def vertical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(spark, sf_dir).select("page_num", "id", F.array_join(L.vertical_columns(F.col("text"), 7), "|").alias("columns"))


@query
def gap_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other boxes of the page each box overlaps or nearly touches."""
    a = R.boxes(spark, sf_dir).select("page_num", "ord", "box")
    b = a.select("page_num", F.col("ord").alias("other"), F.col("box").alias("o"))
    near = a.join(b, "page_num").filter((F.col("ord") != F.col("other")) & G.overlaps(F.col("box"), F.col("o")))
    return near.groupBy("page_num", "ord").agg(F.count("*").alias("n_near"))


def _blocks_with_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes as rendered blocks with derived settings, and the translations of two thirds of them."""
    b = R.boxes(spark, sf_dir)
    m = F.col("conf")
    blocks = b.select(
        "page_num", F.col("ord").alias("id"), F.when(m % 17 != 0, F.col("box")).alias("box"), F.concat(F.lit("t"), m).alias("text"), F.when(m % 2 == 0, F.concat(F.lit("c"), m)).alias("cleaned_text"),
        F.when(m % 3 == 0, "vertical").when(m % 3 == 1, "").alias("direction"), F.when(m % 5 == 0, "file:a.ttf").alias("font"),
        F.when(m % 7 == 0, m.cast("double")).alias("font_size_pt"), F.when(m % 4 == 0, m / 2).alias("glyph_pt"),
    )
    said = b.filter("conf % 3 <> 2").select("page_num", F.col("ord").alias("id"), F.when(m % 6 == 0, " ").otherwise(F.concat(F.lit("译"), m)).alias("translated_text"))
    return blocks, said


@query
def renderable(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, said = _blocks_with_boxes(spark, sf_dir)
    return V.drawn(M.write_back(blocks, said)).select("page_num", "id", "translated_text")


@query
def editor_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, said = _blocks_with_boxes(spark, sf_dir)
    return V.shown(blocks, said).select("page_num", "id", F.col("box.x0").alias("x0"), "raw", "text", "direction", "font", "font_size", "glyph_pt")


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changes() between the blocks and what a user made of every third page."""
    blocks, said = _blocks_with_boxes(spark, sf_dir)
    m = F.col("conf")
    rows = R.moved_boxes(R.boxes(spark, sf_dir)).filter("page_num % 3 = 0").join(R.boxes(spark, sf_dir).select("page_num", F.col("ord").alias("was"), "conf"), ["page_num", "was"])
    text = F.when(m % 3 != 2, F.when(m % 6 == 0, " ").when(m % 11 == 0, "改").otherwise(F.concat(F.lit("译"), m))).otherwise("")
    rows = rows.select(
        "page_num", F.col("ord").alias("id"), "box", text.alias("text"), F.when(m % 13 == 0, "").otherwise("r").alias("raw"), F.when(m % 2 == 0, "vertical").otherwise("").alias("direction"),
        F.when(m % 10 == 0, "file:a.ttf").otherwise("").alias("font"), F.when(m % 14 == 0, m.cast("double")).otherwise(0.0).alias("font_size"),
    )
    whole = blocks.withColumn("box", F.coalesce("box", F.struct(*[F.lit(0).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])))
    return V.changes(whole, rows, said)


@query
def review_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir)


@query
def read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read again after an edit: a dictionary reads every box but each fourth, and translates what it read."""
    boxes = _edited(spark, sf_dir).filter("need_ocr").join(R.boxes(spark, sf_dir).select("page_num", F.col("ord").alias("id"), "box"), ["page_num", "id"])
    recognise = lambda b: b.select("page_num", "id", F.when(F.col("box.x0") % 4 == 0, "  ").otherwise(F.concat(F.lit(" x"), "box.x0")).alias("raw"))
    translate = lambda t: t.select("page_num", "id", F.concat(F.lit("译"), "text").alias("translated_text"))
    return V.read_again(boxes, recognise, translate)


@query
def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines in a row and the strings that overlap."""
    boxes = written(R.boxes(spark, sf_dir), "boxes")  # each step reads them again
    first = lambda b: b.select("page_num", "ord", F.when(F.col("box.x0") % 3 == 0, F.concat(F.lit("word "), F.col("box.y0") % 9)).otherwise("").alias("text"))
    second = lambda b: b.select("page_num", "ord", F.when(F.col("box.x0") % 3 == 1, F.when(F.col("box.y0") % 2 == 0, "=|=|").otherwise(F.concat(F.lit("line "), "ord"))).alias("text"))
    strings = R.moved_boxes(boxes).select("page_num", F.col("was").alias("n"), "box", F.concat(F.lit("s"), F.col("was")).alias("text"))
    return Y.read_boxes(boxes, [("first", first), ("second", second)], strings)


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box, position, inked: a profile of 60 positions for each customer's hundredth."""
    c = R.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("box"))
    at = c.select("box", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("position"))
    period = 8 + F.col("box") % 23
    return at.select("box", F.col("position").cast("long").alias("position"), ((F.col("position") + F.col("box")) % period < F.col("box") % 19).alias("inked"))


@query
def glyph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = Y.glyph_sizes(_ink(spark, sf_dir), "box", "position", "inked")
    return sizes.select("box", "glyph", Y.page_bounds(F.col("glyph"), F.col("box") % 12 + 1).cast("long").alias("most"))


@query
def area_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    size = Y.area_sizes(F.col("conf"), b["x1"] - b["x0"], b["y1"] - b["y0"], F.col("ord") * 7 % 40)
    return R.boxes(spark, sf_dir).select("page_num", "ord", size["low"].cast("long").alias("low"), size["high"].cast("long").alias("high"))


@query
def split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ink of a box: the items of an order, one after another, with gaps of either kind."""
    b = R.boxes(spark, sf_dir)
    width, gap = 2 + F.col("conf") % 14, F.when(F.col("conf") % 4 == 0, 30).otherwise(2 + F.col("conf") % 3)
    order = Window.partitionBy("page_num").orderBy("ord")
    at = b.withColumn("start", F.sum(width + gap).over(order) - width)
    return Y.split_columns(at.select("page_num", F.lit(1).alias("ord"), "start", (F.col("start") + width).alias("stop"), F.col("box.y0").alias("low"), F.col("box.y1").alias("high")))


@query
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fonts of three sources, and which font of an order's priority is known."""
    p = R.read(spark, sf_dir, "part")
    fonts = p.select((F.col("p_partkey") % 3).alias("source"), F.col("p_partkey").alias("place"), F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("/"), "p_partkey").alias("path"), (F.col("p_size") % 4 != 0).alias("covers"))
    asked = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("none").alias("font"))
    found = Y.catalogue(fonts)
    return Y.known_font(asked, found).groupBy("font").agg(F.count("*").alias("n")).join(found.withColumnRenamed("id", "font"), "font", "left")


@query
def spread_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.read(spark, sf_dir, "events").select("event_type", F.round(F.col("value") % 256, 2).alias("value"))
    out = Y.shares(e, "event_type", "value", 40.0, 90.0)
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p95", "deviation", "white", "middle", "dark")])


@query
def polished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of which those worth it are polished, every second with a reply in Han script."""
    draft = F.when(F.col("id") % 3 == 0, "你好吗你好").when(F.col("id") % 3 == 1, "是").otherwise("")
    blocks = R.blocks(spark, sf_dir).select("page_num", "id", F.col("text").alias("cleaned_text"), draft.alias("translated_text"), F.lit("web").alias("translation_engine"))
    step = lambda d: d.select("page_num", "id", F.when(F.col("id") % 2 == 0, "好。。").otherwise("no").alias("reply"))
    return C.polish(blocks, step).groupBy("translated_text", "translation_engine").agg(F.count("*").alias("n_blocks"))


@query
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a run: pages that failed, lines that were flagged, lines that were repaired."""
    lines = _lines(spark, sf_dir)
    failed = R.read(spark, sf_dir, "nation").filter("n_nationkey % 7 = 0").select(F.col("n_nationkey").alias("page_num"))
    found, report = written(C.flagged(lines), "flagged"), written(C.check_report(lines), "report")
    messages = [("failed", C.failed_pages_warning(failed)), ("none failed", C.failed_pages_warning(failed.limit(0))), ("flagged", C.flagged_warning(found)), ("language", C.language_warning(report))]
    out = None
    for kind, message in messages:
        row = message.select(F.lit(kind).alias("kind"), "warning")
        out = row if out is None else out.unionByName(row)
    return out


@query
def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as binaries, their lines as pages: pages that can't be read go aside and the pages after them go on."""
    docs = spread(R.read(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))

    def split(content: bytes, pages: list[int] | None):
        for k, line in enumerate(content.decode().split("\n"), 1):
            if pages is None or k in pages:
                yield k, (ValueError("odd page") if len(line) % 5 == 0 else lambda line=line: [{"n": len(line)}])

    good, failed = S.good_and_failed(S.split_pages(docs, split, "n long"))
    pages = good.select("path", "page_num", "n", F.lit("").alias("error")).unionByName(failed.select("path", "page_num", F.lit(None).cast("long").alias("n"), "error"))
    return pages.groupBy("path").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_chars"), F.count_if(F.col("error") != "").alias("n_failed"), F.max("error").alias("error"))


@query
def sorted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written in order: the place of each in the files, taken in order of their names."""
    path = new_path(spark, "pages")
    S.write_pages(R.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_num"), "o_orderstatus"), path)
    back = spark.read.parquet(path).select("page_num", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = back.groupBy("file").agg(F.count("*").alias("n"))
    first = files.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return back.join(F.broadcast(first), "file").select("page_num", (F.col("first") + F.col("row") + 1).alias("place"))


@query
def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of conversations, numbered, arriving in files in no order; gated behind the stream that numbers their lines."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page_num", "lines"))
    pages = R.turns(spark, sf_dir).select("doc", place.cast("long").alias("page_num"), "lines")
    path = new_path(spark, "arriving")
    rows = max(200, pages.count() // 500)  # a file, so that there are many files, but not the more the larger the table
    pages.repartition(8, F.xxhash64("doc", "page_num")).write.option("maxRecordsPerFile", rows).parquet(path)
    schema = "doc long, page_num long, lines long"
    stages = [
        ("counted", lambda: W.page_stream(spark, path, schema).select("doc", "page_num", (F.col("lines") + 1).alias("lines")), schema),
        ("packed", lambda: W.packed_in_order(done_stream("counted")), W.BATCHES),
    ]
    made: dict[str, str] = {}

    def done_stream(name: str) -> DataFrame:
        return W.page_stream(spark, made[name], schema)

    return W.gated(stages, made)["packed"]


ERRORS = ["RuntimeError: CUDA out of memory.", "OnnxError: 887A0005 device", "ValueError: bad page", "", None, "Failed to Allocate 3 MB", "padml"]


@query
def memory_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's errors and the parts' comments as error texts."""
    sample = spark.createDataFrame([(k, e) for k, e in enumerate(ERRORS)], "n long, message string")
    parts = R.read(spark, sf_dir, "part").select((F.col("p_partkey") + 100).alias("n"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("cuDNN "), "p_name")).otherwise(F.col("p_name")).alias("message"))
    return sample.unionByName(parts).select("n", Q.out_of_memory(F.col("message")).alias("oom"))


@query
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models placed on suppliers as hosts: costs are measured on their orders, defaults where none is plausible."""
    hosts = R.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"), F.when(F.col("s_suppkey") % 11 != 0, F.abs("s_acctbal")).alias("free"), (F.col("s_suppkey") % 4 * 100).alias("reserve"))
    defaults = spark.createDataFrame([(f"m{k}", 300 + 150 * k) for k in range(7)], "model string, need long")
    seen = R.read(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey") % 7).alias("model"), F.col("p_partkey").alias("n"), (F.col("p_retailprice") * (F.col("p_partkey") % 9)).alias("delta")).filter("model <> 'm3'")
    costs = Q.measured_costs(defaults, seen)
    models = hosts.select("host", F.explode(F.array(*[F.lit(f"m{k}") for k in range(7)])).alias("model")).join(F.broadcast(costs), "model").withColumn("priority", F.substring("model", 2, 1).cast("int"))
    models = models.withColumns({"capable": (F.col("host") + F.col("priority")) % 5 != 0, "resident": (F.col("host") + F.col("priority")) % 6 == 0})
    return Q.placement(models, hosts)


@query
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as statuses of a task."""
    e = R.read(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    state = F.when(F.col("event_id") % 29 == 0, "complete").when(F.col("event_id") % 31 == 0, "failed").when(F.col("event_id") % 5 < 2, "review").otherwise("processing")
    rows = e.select(F.col("user_id").alias("task"), n.cast("long").alias("n"), F.floor(n / 3).cast("long").alias("percent"), state.alias("status"))
    return Q.progress_events(rows)


@query
def placed_lettering(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("conf")
    boxes = R.boxes(spark, sf_dir).withColumns({"n_chars": m % 23, "most": F.when(m % 3 == 0, m % 40).otherwise(0), "forced": F.when(m % 19 == 0, 14).otherwise(0)})
    return Y.place(boxes)
