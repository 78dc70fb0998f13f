"""Review of a rendered document: what the editor is shown, what its rows change, which boxes are read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, text as T
from ..runtime import written

_CORNERS = ("x0", "y0", "x1", "y1")


def drawn(blocks: DataFrame) -> DataFrame:
    """Blocks that get new lettering: those without a translation keep the original."""
    return blocks.filter(T.strip(F.coalesce("translated_text", F.lit(""))) != "")


def shown(blocks: DataFrame, translations: DataFrame, direction: str = "horizontal") -> DataFrame:
    """page_num, id, box, raw, text, direction, font, font_size, glyph_pt of the blocks that have a box, as the editor loads them.

    blocks: page_num, id, box, text, cleaned_text, direction, font, font_size_pt, glyph_pt; translations: page_num, id, translated_text.
    """
    said = translations.select("page_num", "id", F.col("translated_text").alias("said"))
    return blocks.filter("box IS NOT NULL").join(said, ["page_num", "id"], "left").select(
        "page_num", "id", "box", F.coalesce("cleaned_text", "text", F.lit("")).alias("raw"), F.coalesce("said", F.lit("")).alias("text"),
        _or(F.col("direction"), direction).alias("direction"), F.coalesce("font", F.lit("")).alias("font"),
        F.coalesce("font_size_pt", F.lit(0.0)).alias("font_size"), F.coalesce("glyph_pt", F.lit(0.0)).alias("glyph_pt"),
    )


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def changes(old: DataFrame, rows: DataFrame, translations: DataFrame, direction: str = "horizontal", moved_by: float = X.MOVED_POINTS) -> DataFrame:
    """page_num, id, change (removed, drawn or kept), moved, typed, turned, sized, refont, user_edited, need_ocr.

    old: blocks (page_num, id, box, direction, font, font_size_pt); rows: the edited rows (page_num, id, box, text, raw,
    direction, font, font_size) of changed pages, all rows of each.  A page that old doesn't have is passed over.  Read
    again are boxes that moved while their translation was left alone, and boxes drawn without any text.
    """
    pages = rows.select("page_num").distinct()
    o = old.join(pages, "page_num", "left_semi").select("page_num", "id", F.struct("box", "direction", "font", "font_size_pt").alias("o"))
    known = old.select("page_num").distinct()
    n = rows.join(known, "page_num", "left_semi").select("page_num", "id", F.struct("box", "text", "raw", "direction", "font", "font_size").alias("n"))
    said = translations.select("page_num", "id", F.col("translated_text").alias("said"))
    both = o.join(n, ["page_num", "id"], "full_outer").join(said, ["page_num", "id"], "left")
    change = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "drawn").otherwise("kept")
    kept = F.col("change") == "kept"
    far = F.greatest(*[F.abs(F.col(f"n.box.{c}") - F.col(f"o.box.{c}")) for c in _CORNERS]) > moved_by
    flags = {
        "moved": far, "typed": F.coalesce("n.text", F.lit("")) != F.coalesce("said", F.lit("")),
        "turned": _or(F.col("n.direction"), direction) != _or(F.col("o.direction"), direction),
        "sized": F.coalesce("n.font_size", F.lit(0.0)) != F.coalesce("o.font_size_pt", F.lit(0.0)),
        "refont": F.coalesce("n.font", F.lit("")) != F.coalesce("o.font", F.lit("")),
    }
    out = both.withColumn("change", change).withColumns({k: F.coalesce(kept & c, F.lit(False)) for k, c in flags.items()})
    empty = (T.strip(F.coalesce("n.text", F.lit(""))) == "") & (T.strip(F.coalesce("n.raw", F.lit(""))) == "")
    edited = (F.col("change") == "drawn") | F.col("moved") | F.col("typed") | F.col("turned") | F.col("sized") | F.col("refont")
    again = F.col("moved") & ~F.col("typed") | (F.col("change") == "drawn") & empty
    return out.withColumns({"user_edited": edited, "need_ocr": again}).select("page_num", "id", "change", *flags, "user_edited", "need_ocr")


def read_again(boxes: DataFrame, recognise: Callable[[DataFrame], DataFrame], translate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """page_num, id, text, translated_text, blank: boxes (page_num, id, box) read and translated once more.

    recognise: (page_num, id, box) -> (page_num, id, raw); translate: (page_num, id, text) -> (page_num, id,
    translated_text).  A box in which nothing is read is blank: it keeps the original lettering and is not translated.
    """
    raw = recognise(boxes.select("page_num", "id", "box")).select("page_num", "id", T.strip(F.coalesce("raw", F.lit(""))).alias("read"))
    found = written(boxes.select("page_num", "id").join(raw, ["page_num", "id"], "left").select("page_num", "id", F.coalesce("read", F.lit("")).alias("text")), "read")
    said = translate(found.filter("text <> ''")).select("page_num", "id", "translated_text")
    out = found.join(said, ["page_num", "id"], "left")
    return out.select("page_num", "id", "text", F.coalesce("translated_text", F.lit("")).alias("translated_text"), (F.col("text") == "").alias("blank"))
