"""Structured text from outside: model replies, event streams of tokens, the editor's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, geometry as G

_EDITOR = "struct<pages:map<string,array<struct<id:string,bbox:array<double>,text:string,raw:string,edited:boolean,direction:string,font:string,font_size:string>>>>"


def reply_items(reply: Column) -> Column:
    """array<map<string,string>> of a model's JSON reply, with or without a code fence.

    A list stands for itself, an object for its first list or else for one item; anything else has none.
    """
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*(?:```|\z)", 1)
    body = F.trim(F.when(reply.contains("```"), fenced).otherwise(reply))
    items = lambda c: F.from_json(c, "array<map<string,string>>")
    values = F.map_values(F.from_json(body, "map<string,string>"))
    first = F.get(F.filter(values, lambda v: F.ltrim(v).startswith("[")), 0)
    one = F.from_json(body, "map<string,string>")
    whole = F.when(body.startswith("["), items(body)).when(first.isNotNull(), items(first)).when(body.startswith("{") & one.isNotNull(), F.array(one))
    return F.coalesce(whole, F.array().cast("array<map<string,string>>"))


def corrections(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """blocks (page_num, id) with is_sfx and translated_text from replies (page_num, reply), by id; missing ones are empty."""
    item = F.explode(reply_items(F.col("reply"))).alias("i")
    found = replies.select("page_num", item).select("page_num", F.col("i")["id"].try_cast("long").alias("id"), F.col("i")["trans"].alias("trans"), F.col("i")["sfx"].try_cast("boolean").alias("sfx"))
    one = found.groupBy("page_num", "id").agg(F.first("trans").alias("trans"), F.first("sfx").alias("sfx"))
    out = blocks.join(one, ["page_num", "id"], "left")
    return out.withColumns({"is_sfx": F.coalesce("sfx", F.lit(False)), "translated_text": F.trim(F.coalesce("trans", F.lit("")))}).drop("trans", "sfx")


def streamed_reply(lines: DataFrame) -> DataFrame:
    """call, content, finish_reason, completion_tokens of event-stream lines (call, n, line).

    Only `data:` lines before [DONE] that hold JSON count; without a usage record the parts are counted.
    """
    data = lines.filter(F.col("line").startswith("data:")).withColumn("body", F.trim(F.substring("line", 6, 1 << 30)))
    end = data.groupBy("call").agg(F.min(F.when(F.col("body") == "[DONE]", F.col("n"))).alias("end"))
    live = data.join(end, "call").filter(F.col("end").isNull() | (F.col("n") < F.col("end")))
    choice = "array<struct<delta:struct<content:string>,finish_reason:string>>"
    j = live.withColumn("j", F.from_json("body", f"struct<choices:{choice},usage:struct<completion_tokens:bigint>>"))
    part = F.array_join(F.transform("j.choices", lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    j = j.select("call", "n", part.alias("part"), F.get("j.choices", F.lit(0))["finish_reason"].alias("finish"), F.col("j.usage.completion_tokens").alias("tokens"))
    parts = F.array_sort(F.collect_list(F.struct("n", "part")))
    out = j.groupBy("call").agg(
        F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("content"), F.max_by("finish", F.when(F.col("finish").isNotNull(), F.col("n"))).alias("finish_reason"),
        F.max_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("n"))).alias("used"), F.count_if(F.col("part") != "").alias("counted"),
    )
    return out.select("call", "content", "finish_reason", F.coalesce("used", "counted").alias("completion_tokens"))


def editor_rows(documents: DataFrame) -> DataFrame:
    """Rows of the editor's JSON (doc, body) with what is wrong with each: doc, page_num, id, bbox, text, raw, ..., problem.

    An unreadable document and a page without a number give a row of their own with a problem.
    """
    pages = documents.select("doc", F.from_json("body", _EDITOR)["pages"].alias("pages"))
    entries = F.when(F.size("pages") > 0, F.map_entries("pages"))
    page = pages.select("doc", F.explode_outer(entries).alias("e"))
    named, listed = F.col("e").isNotNull().alias("named"), F.col("e.value").isNotNull().alias("listed")
    row = page.select("doc", named, listed, F.col("e.key").alias("key"), F.explode_outer("e.value").alias("r"))  # no row carries its page
    size = F.size("r.bbox")
    finite = F.forall("r.bbox", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    w, h = F.get("r.bbox", F.lit(2)) - F.get("r.bbox", F.lit(0)), F.get("r.bbox", F.lit(3)) - F.get("r.bbox", F.lit(1))
    number, id_ = F.col("key").try_cast("int"), F.col("r.id").try_cast("long")
    problem = (
        F.when(~F.col("named"), "no pages").when(number.isNull() | (number < 1), "page").when(~F.col("listed"), "rows")
        .when(F.col("r").isNull(), F.lit(None)).when(id_.isNull() | F.col("r.bbox").isNull(), "incomplete")
        .when((size != 4) | ~finite | (w < 1) | (h < 1), "box").when(F.length("r.text") > X.EDITOR_TEXT, "text too long")
    )
    known = F.when(F.col("r.direction").isin(X.DIRECTIONS), F.col("r.direction")).otherwise("")
    out = row.select(
        "doc", number.alias("page_num"), id_.alias("id"), F.col("r.bbox").alias("bbox"), F.coalesce("r.text", F.lit("")).alias("text"),
        F.substring(F.coalesce("r.raw", F.lit("")), 1, X.EDITOR_TEXT).alias("raw"), F.coalesce("r.edited", F.lit(False)).alias("edited"),
        known.alias("direction"), G.clean_font_size(F.col("r.font_size")).alias("font_size"), problem.alias("problem"),
    )
    return out


def violations(rows: DataFrame) -> DataFrame:
    """doc, page_num, id, problem: broken rows, ids that repeat on a page, documents with too many rows.

    The rows are read once: one shuffle by document and one sort serve all counts.
    """
    document, same = Window.partitionBy("doc"), Window.partitionBy("doc", "page_num", "id")
    k = rows.select("doc", "page_num", "id", "problem").repartition("doc")
    k = k.withColumns({"turn": F.row_number().over(same.orderBy("problem")), "n": F.count(F.lit(1)).over(same)})
    k = k.withColumns({"first": F.row_number().over(document.orderBy("page_num", "id")), "of_doc": F.count("id").over(document)})
    none = F.lit(None)
    say = lambda when, problem, page=F.col("page_num"), id_=F.col("id"): F.when(when, F.struct(page.cast("int").alias("page_num"), id_.cast("long").alias("id"), problem.alias("problem")))
    found = F.array_compact(F.array(
        say(F.col("problem").isNotNull(), F.col("problem")), say(F.col("id").isNotNull() & (F.col("n") > 1) & (F.col("turn") == 1), F.lit("id repeats")),
        say((F.col("of_doc") > X.EDITOR_ROWS) & (F.col("first") == 1), F.lit("too many rows"), none, none),
    ))
    return k.select("doc", F.explode_outer(found).alias("x")).filter("x IS NOT NULL").select("doc", "x.page_num", "x.id", "x.problem")


def blocks_of_rows(rows: DataFrame) -> DataFrame:
    """Editor rows as blocks: derived sizes and centres; rows without a box can't be placed and go."""
    b = [F.get("bbox", F.lit(k)) for k in range(4)]
    return rows.filter("bbox IS NOT NULL").select(
        "doc", "page_num", "id", F.col("raw").alias("text"), F.struct(*[x.alias(n) for x, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)]).alias("box"),
        (b[2] - b[0]).alias("width"), (b[3] - b[1]).alias("height"), ((b[0] + b[2]) / 2).alias("center_x"), ((b[1] + b[3]) / 2).alias("center_y"),
        F.col("edited").alias("user_edited"), F.nullif("direction", F.lit("")).alias("direction"), F.nullif("font_size", F.lit(0.0)).alias("font_size_pt"),
    )
