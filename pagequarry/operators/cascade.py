"""Routing of blocks, cascades of translators, and the check that repairs their output.

A translator is any function (DataFrame with page_num, id, cleaned_text) -> DataFrame (page_num, id, reply); a
model runs inside it as an iterator pandas UDF.  Each step of a cascade sees only what the steps before left.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import check as K, fixed as X, text as T
from ..runtime import written

logger = logging.getLogger(__name__)
Translator = Callable[[DataFrame], DataFrame]


def route(text: Column, cleaned: Column, terms: Sequence[str]) -> Column:
    """glossary, empty, single, noise, number or translate: where a block goes, the first rule that holds."""
    return (
        F.when(T.strip(text).isin(list(terms)), "glossary").when(cleaned == "", "empty")
        .when((F.length(cleaned) < 2) & ~T.has_cjk(cleaned), "single").when(T.noise_reason(cleaned).isNotNull(), "noise")
        .when(cleaned.rlike(r"^\p{Nd}{1,4}\z"), "number").otherwise("translate")
    )


def classify(blocks: DataFrame, terms: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """blocks with cleaned_text and route."""
    cleaned = blocks.withColumn("cleaned_text", F.explode(F.array(T.clean_input(F.col("text"), terms))))  # explode: computed once
    return cleaned.withColumn("route", route(F.col("text"), F.col("cleaned_text"), [k for k, _ in terms]))


def translate(classified: DataFrame, steps: Sequence[tuple[str, Translator]], terms: Sequence[tuple[str, str]] = (), attempts: int = 2) -> DataFrame:
    """page_num, id, translated_text, translation_engine: glossary, digits, then the first step with a reply in Han script.

    A step that raises is tried again, `attempts` times in all, and then passed over.
    """
    direct = F.create_map(*[F.lit(x) for kv in terms for x in kv]) if terms else None
    given = F.when(F.col("route") == "number", F.col("cleaned_text"))
    if direct is not None:
        given = given.when(F.col("route") == "glossary", F.try_element_at(direct, T.strip(F.col("text"))))
    classified = written(classified.select("page_num", "id", "text", "cleaned_text", "route"), "classified")
    fixed = classified.filter("route <> 'translate'").select("page_num", "id", F.coalesce(given, F.lit("")).alias("translated_text"), engine_label(F.col("route")).alias("translation_engine"))
    left = classified.filter("route = 'translate'").select("page_num", "id", "cleaned_text")
    done = fixed
    for name, step in steps:
        found = replies(left, name, step, terms, attempts)
        if found is None:
            continue
        done = done.unionByName(found)
        left = left.join(found.select("page_num", "id"), ["page_num", "id"], "left_anti")
    return done.unionByName(left.select("page_num", "id", F.lit("").alias("translated_text"), F.lit("untranslated").alias("translation_engine")))


def replies(left: DataFrame, name: str, step: Translator, terms: Sequence[tuple[str, str]], attempts: int) -> DataFrame | None:
    """What a step's replies are worth, written; None if every attempt raised."""
    for _ in range(attempts):
        try:
            reply = T.clean_output(F.col("reply"), terms)
            found = step(left).withColumn("reply", F.explode(F.array(reply))).filter(T.accepted(F.col("reply")) & ~T.is_refusal(F.col("reply")))
            return written(found.select("page_num", "id", F.col("reply").alias("translated_text"), F.lit(name).alias("translation_engine")), "replies")
        except Exception as e:  # a translator may fail in any way; what it leaves goes to the next
            logger.warning("translator %s failed: %s", name, e)
    return None


def polish(blocks: DataFrame, step: Translator, name: str = "polished") -> DataFrame:
    """blocks (page_num, id, cleaned_text, translated_text, translation_engine) with drafts worth it replaced by the step's replies.

    step: (page_num, id, cleaned_text, translated_text) -> (page_num, id, reply); a draft without a reply in Han script stays.
    """
    worth = T.worth_polishing(F.col("cleaned_text"), F.col("translated_text")) & (F.col("translated_text") != "")
    asked = blocks.filter(worth).select("page_num", "id", "cleaned_text", "translated_text")
    better = step(asked).select("page_num", "id", T.clean_output(F.col("reply")).alias("better")).filter(T.accepted(F.col("better")))
    out = blocks.join(better, ["page_num", "id"], "left")
    engine = F.when(F.col("better").isNotNull(), name).otherwise(F.col("translation_engine"))
    return out.withColumns({"translated_text": F.coalesce("better", "translated_text"), "translation_engine": engine}).drop("better")


def prompts(lines: DataFrame, hints: DataFrame, extra: str = "") -> DataFrame:
    """page_num, prompt: a line for each block (page_num, id, text) in order, the page's terms (page_num, ord, src, tgt), the extra hint."""
    line = F.concat(F.lit("ID: "), F.col("id"), F.lit(" | 原文: "), T.strip(F.col("text")))
    said = lines.groupBy("page_num").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("l"))
    term = F.concat(F.lit("- "), F.col("src"), F.lit(" -> "), F.col("tgt"))
    known = hints.groupBy("page_num").agg(F.array_sort(F.collect_set(F.struct("ord", term.alias("line")))).alias("g"))
    of = lambda c: F.transform(c, lambda x: x["line"])
    parts = F.concat(of("l"), F.coalesce(of("g"), F.array().cast("array<string>")), F.array(F.lit(extra)) if extra else F.array().cast("array<string>"))
    return said.join(known, "page_num", "left").select("page_num", F.array_join(parts, "\n").alias("prompt"))


def engine_label(route_: Column) -> Column:
    return F.when(route_ == "noise", "effect filter").when(route_ == "number", "digits").when(route_ == "glossary", "glossary").otherwise("untranslated")


def check_report(lines: DataFrame) -> DataFrame:
    """Lines (page_num, id, raw, text) that have issues: before, after, action (cleaned or emptied), removed."""
    found = T.let(K.issues(F.col("text"), F.col("raw")), lambda f: F.array_join(F.concat(f["hard"], f["soft"]), ""))
    fixed = F.array(F.struct(found.alias("removed"), K.sanitized(F.col("text"), F.col("raw")).alias("after")))
    one = lines.select("page_num", "id", F.col("text").alias("before"), F.explode(fixed).alias("x"))  # explode: each computed once
    action = F.when(F.col("x.after") == "", "emptied").otherwise("cleaned")
    return one.filter("x.removed <> ''").select("page_num", "id", "before", "x.after", action.alias("action"), "x.removed")


def check_and_fix(lines: DataFrame, retry: Callable[[DataFrame], DataFrame] | None, target: str = "Simplified Chinese", rounds: int = 2) -> DataFrame:
    """Lines (page_num, id, raw, text) with fixed text, retries and action (null where nothing was wrong).

    Lines with hard issues go to retry, (page_num, id, raw, text, hint) -> (page_num, id, reply), at most `rounds` times;
    what is still wrong is removed.  hint, alike in all rows, names the first hard characters of all these lines.  A
    retry that raises or replies nothing ends the retries.  Nothing is checked unless the target is Chinese.
    """
    low = target.lower()
    now = lines.withColumn("retries", F.lit(0))
    if not ("chinese" in low or low.startswith("zh") or "中文" in low):
        return now.withColumn("action", F.lit(None).cast("string"))
    hard = lambda: T.let(K.issues(F.col("text"), F.col("raw")), lambda f: F.size(f["hard"]) > 0)
    for k in range(1, rounds + 1 if retry else 1):
        bad = written(now.filter(hard()), "bad_lines")
        if bad.isEmpty():
            break
        hint = retry_hint(bad)
        try:
            replies = written(retry(bad.select("page_num", "id", "raw", "text", F.lit(hint).alias("hint"))).select("page_num", "id", "reply"), "replies")
        except Exception as e:  # a translator may fail in any way: the lines are cleaned instead
            logger.warning("retry %s failed: %s", k, e)
            break
        if replies.isEmpty():
            break
        better = F.coalesce(F.col("reply").rlike(X.WIDE_HAN), F.lit(False))
        again = bad.join(replies, ["page_num", "id"], "left").withColumns({"text": F.when(better, F.col("reply")).otherwise(F.col("text")), "retries": F.lit(k)}).drop("reply")
        now = written(now.join(bad.select("page_num", "id"), ["page_num", "id"], "left_anti").unionByName(again.select(*now.columns)), "lines")
    wrong = T.let(K.issues(F.col("text"), F.col("raw")), lambda x: (F.size(x["hard"]) > 0) | (F.size(x["soft"]) > 0))
    now = now.withColumn("has", F.explode(F.array(wrong)))  # explode: each computed once
    now = now.withColumn("clean", F.explode(F.array(F.when(F.col("has"), K.sanitized(F.col("text"), F.col("raw"))))))
    had = F.col("has") | (F.col("retries") > 0)  # what was tried again was wrong before
    action = (
        F.when(~had, F.lit(None)).when(F.col("has"), F.when(F.col("clean") == "", "emptied").otherwise("cleaned"))
        .when(F.col("retries") > 0, "retranslated").otherwise("cleaned")
    )
    return now.withColumns({"action": action, "text": F.when(F.col("has"), F.col("clean")).otherwise(F.col("text"))}).drop("has", "clean")


def retry_hint(bad: DataFrame, most: int = X.HINT_CHARS) -> str:
    """What a retry is told: the first hard characters of all lines, each once, in order of page and line."""
    hard = T.let(K.issues(F.col("text"), F.col("raw")), lambda f: f["hard"])
    chars = bad.select("page_num", "id", F.posexplode(hard).alias("place", "c")).groupBy("c").agg(F.min(F.struct("page_num", "id", "place")).alias("first"))
    named = "".join(r["c"] for r in chars.orderBy("first").limit(most).collect())
    return f"上一次译文含有不允许的字符：{named}。请只用简体中文和常规中文标点重新翻译。"


def flagged(lines: DataFrame) -> DataFrame:
    """page_num, id, chars of lines that have issues; the text is left as typed."""
    chars = T.let(K.issues(F.col("text"), F.col("raw")), lambda f: F.array_join(F.concat(f["hard"], f["soft"]), ""))
    return lines.select("page_num", "id", F.explode(F.array(chars)).alias("chars")).filter("chars <> ''")


def first_places(rows: DataFrame, order: list[str], where: Column, most: int = X.REPORT_ROWS, joint: str = ", ") -> DataFrame:
    """One row: n, and the first `most` places as text.  A top-k, so only `most` rows meet."""
    first = rows.orderBy(*order).limit(most).select(F.lit(0).alias("n"), F.struct(*order, where.alias("place")).alias("x"))
    both = first.unionByName(rows.select(F.lit(1).alias("n"), F.lit(None).cast(first.schema["x"].dataType).alias("x")))
    places = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["place"]), joint)
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), places.alias("places"))


def warning(rows: DataFrame, order: list[str], where: Column, most: int = X.REPORT_ROWS) -> DataFrame:
    """One row: n, and the first `most` places as text."""
    return first_places(rows, order, where, most)


def failed_pages_warning(failed: DataFrame) -> DataFrame:
    """One row: the warning that names the pages (page_num) that could not be read; empty if there are none."""
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("page_num")), lambda p: p.cast("string")), ", ")
    n = F.count("page_num")
    return failed.agg(F.when(n > 0, F.concat(n, F.lit(" 页提取失败，已保留原页未翻译: 第 "), numbers, F.lit(" 页"))).otherwise("").alias("warning"))


def flagged_warning(found: DataFrame, most: int = X.REPORT_ROWS) -> DataFrame:
    """One row: the warning that names the first lines of flagged() with their first six characters."""
    where = F.concat(F.lit("第"), F.col("page_num"), F.lit("页#"), F.col("id"), F.lit("（"), F.substring("chars", 1, 6), F.lit("）"))
    one = first_places(found, ["page_num", "id"], where, most, "、")
    text = F.concat(F.lit("校对译文含非简体中文字符或符号（未自动修改）: "), "places", more(F.col("n"), most))
    return one.select(F.when(F.col("n") > 0, text).otherwise("").alias("warning"))


def language_warning(report: DataFrame, most: int = X.REPORT_ROWS) -> DataFrame:
    """One row: how many lines of a report (page_num, id, action, removed) went which way, and the first of them."""
    took = F.when(F.col("removed") != "", F.concat(F.lit("（去掉「"), "removed", F.lit("」）"))).otherwise("")
    where = F.concat(F.lit("第"), F.col("page_num"), F.lit("页#"), F.col("id"), took)
    rows = report.filter("action IS NOT NULL")
    one = first_places(rows.select("page_num", "id", where.alias("where")), ["page_num", "id"], F.col("where"), most, "、")
    kinds = [(F.count_if(F.col("action") == a), said) for a, said in X.ACTIONS]
    parts = rows.agg(F.array_join(F.array_compact(F.array(*[F.when(n > 0, F.concat(n, F.lit(f" {said}"))) for n, said in kinds])), "，").alias("parts"))
    both = one.withColumn("parts", F.lit(None).cast("string")).unionByName(parts.select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("places"), "parts"))
    both = both.agg(F.max("n").alias("n"), F.max("places").alias("places"), F.max("parts").alias("parts"))
    text = F.concat(F.lit("语言检查: "), "parts", F.lit("："), "places", more(F.col("n"), most))
    return both.select(F.when(F.col("n") > 0, text).otherwise("").alias("warning"))


def more(n: Column, most: int) -> Column:
    return F.when(n > most, F.concat(F.lit(" 等共 "), n, F.lit(" 行"))).otherwise("")
