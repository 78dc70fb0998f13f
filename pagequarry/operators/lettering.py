"""Reading boxes and sizing their lettering: chains of engines, glyph sizes, boxes cut by their profile, font catalogues."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, text as T
from ..runtime import written
from . import layout as L, matching as M

Engine = Callable[[DataFrame], DataFrame]


def read_boxes(boxes: DataFrame, engines: Sequence[tuple[str, Engine]], strings: DataFrame | None = None, fallback: str = "overlap") -> DataFrame:
    """page_num, ord, text, ocr_engine: the first engine that reads anything in a box, else the strings that overlap it.

    boxes: page_num, ord, box; an engine: (page_num, ord, box) -> (page_num, ord, text).  Each engine is asked for what
    the ones before left; boxes in which none finds text that means something go, as do texts that repeat on a page.
    """
    left = boxes.filter("box.x1 > box.x0 AND box.y1 > box.y0").select("page_num", "ord", "box")
    done = None
    for name, engine in engines:
        found = engine(left).select("page_num", "ord", "text").filter("text <> ''").withColumn("ocr_engine", F.lit(name))
        found = written(found, "recognised")
        done = found if done is None else done.unionByName(found)
        left = left.join(found.select("page_num", "ord"), ["page_num", "ord"], "left_anti")
    if strings is not None:
        near = M.overlap_text(left, strings).select("page_num", "ord", T.strip(F.col("text")).alias("text"))
        near = near.filter("text <> ''").withColumn("ocr_engine", F.lit(fallback))
        done = near if done is None else done.unionByName(near)
    good = done.filter(T.is_meaningful(F.col("text")))
    return L.first_texts(good.withColumnRenamed("ord", "id")).withColumnRenamed("id", "ord").select("page_num", "ord", "text", "ocr_engine")


def glyph_sizes(profiles: DataFrame, group: str, position: str, flag: str, least: int = X.LEAST_RUN, share: float = X.MAIN_RUN) -> DataFrame:
    """group, glyph: the median of a profile's main runs, cut off to whole pixels; 0 where there is none.

    Runs under `least` are slivers; of the others only those of at least `share` of the widest count.
    """
    run = (F.col("stop") - F.col("start")).alias("run")
    wide = L.runs(profiles, group, position, flag).select(group, run).filter(F.col("run") >= least)
    widest = F.max("run").over(Window.partitionBy(group))
    main = wide.withColumn("widest", widest).filter(F.col("run") >= F.col("widest") * share)
    sizes = main.groupBy(group).agg(F.floor(F.median("run")).cast("long").alias("glyph"))
    return profiles.select(group).distinct().join(sizes, group, "left").fillna({"glyph": 0})


def page_bounds(glyph: Column, page_glyph: Column) -> Column:
    """A block's largest size: its own, within the page's typical size times its bounds; the page's where it has none."""
    low, high = ((page_glyph * k).cast("int") for k in X.PAGE_BOUNDS)
    return F.when(glyph > 0, F.least(F.greatest(glyph, low), high)).otherwise(high)


def area_sizes(n_chars: Column, width: Column, height: Column, most: Column, least: int = 10) -> Column:
    """struct(low, high): the sizes to try for a text in a box, from its area; most 0 means no bound of its own."""
    w, h = (F.greatest(side - (side * 0.15).cast("int"), F.lit(20)) for side in (width, height))
    by_area = F.sqrt(w * h / (F.greatest(n_chars, F.lit(1)) * 1.25)).cast("int")
    high = F.least((by_area * 1.5).cast("int"), w, h, F.lit(120))
    high = F.when(most > 0, F.least(high, most)).otherwise(high)
    low = F.lit(max(6, least))
    return F.struct(low.alias("low"), F.greatest(high, low).alias("high"))


def fitting_size(n: int, width: float, height: float, most: int, least: int = X.LEAST_SIZE) -> int:
    """The largest size, found by halving, at which n characters as wide as high fill lines within a box's usable part."""
    w, h = max(width - int(width * 0.15), 20), max(height - int(height * 0.15), 20)
    high = min(int(int(math.sqrt(w * h / (max(n, 1) * 1.25))) * 1.5), int(w), int(h), 120)
    low = best = max(6, least)
    high = min(high, most) if most > 0 else high
    while low <= high:
        size = (low + high) // 2
        lines, wide = unit_lines(n, w, size)
        if lines * size * 1.25 <= h and wide <= w + 5:
            best, low = size, size + 1
        else:
            high = size - 1
    return best


def unit_lines(n: int, width: float, size: int) -> tuple[int, float]:
    """How many lines n characters of a size take, and how wide the widest is."""
    per = max(1, int(width // size))
    return -(-max(n, 1) // per), min(max(n, 1), per) * size


def place(boxes: DataFrame) -> DataFrame:
    """page_num, ord, size, left, top, right, bottom: the lettering of a page's boxes, in order, no two closer than a gap.

    boxes: page_num, ord, box, n_chars, most (a box's largest size, 0 for none), forced (a size the user chose, or 0).
    A box that meets lettering placed before it shrinks by two until it doesn't, down to the least size; a forced size
    is never shrunk.  Characters count as wide as high, fonts being out of scope.
    """

    def work(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in rows:
            bw, bh, n, cap = r["x1"] - r["x0"], r["y1"] - r["y0"], int(r["n_chars"]), int(r["most"])
            for _ in range(X.PLACE_TRIES):
                size = int(r["forced"]) or fitting_size(n, bw, bh, cap)
                lines, wide = unit_lines(n, max(bw - int(bw * 0.15), 20), size)
                tall = lines * size * 1.25
                left, top = r["x0"] + (bw - wide) / 2, r["y0"] + max(0.0, (bh - tall) / 2)
                own = {"ord": r["ord"], "size": size, "left": left, "top": top, "right": left + wide, "bottom": top + tall}
                if r["forced"] or size <= X.LEAST_SIZE or not any(_near(own, p) for p in out):
                    break
                cap = max(X.LEAST_SIZE, size - 2)
            out.append(own)
        return out

    return L.by_page(boxes, work, "ord long, size long, left double, top double, right double, bottom double", ["n_chars", "most", "forced"])


def _near(a: dict, b: dict, gap: float = 2.0) -> bool:
    return a["left"] < b["right"] + gap and b["left"] < a["right"] + gap and a["top"] < b["bottom"] + gap and b["top"] < a["bottom"] + gap


def split_columns(columns: DataFrame) -> DataFrame:
    """page_num, ord, part, start, stop, low, high: the groups that a box's columns of ink fall into.

    columns: page_num, ord, start, stop (across the reading direction), low, high (along it).  A group ends before a gap
    far over the usual one, or before a column that hardly overlaps the last.  Narrow columns (furigana) don't end a
    group; they join the nearest.  Boxes with fewer than two main columns are one group.
    """
    box = Window.partitionBy("page_num", "ord")
    width = F.col("stop") - F.col("start")
    c = columns.withColumn("width", width).withColumn("widest", F.max("width").over(box))
    c = c.withColumn("main_w", F.median(F.when(F.col("width") >= 0.45 * F.col("widest"), F.col("width"))).over(box))
    c = c.withColumn("narrow", F.col("width") < 0.45 * F.col("main_w"))
    tall = F.max(F.when(~F.col("narrow"), F.col("high") - F.col("low"))).over(box)
    long = (F.col("high") - F.col("low") >= 0.6 * tall) & (F.col("width") >= 0.3 * F.col("widest"))
    c = c.withColumn("narrow", F.col("narrow") & ~long)
    order = Window.partitionBy("page_num", "ord").orderBy("start")
    m = c.filter(~F.col("narrow")).withColumn("gap", F.col("start") - F.lag("stop").over(order)).withColumn("usual", F.median("gap").over(box))
    overlap = F.least(F.lag("high").over(order), F.col("high")) - F.greatest(F.lag("low").over(order), F.col("low"))
    shorter = F.least(F.lag("high").over(order) - F.lag("low").over(order), F.col("high") - F.col("low"))
    wide_gap = (F.col("gap") > F.greatest(1.8 * F.col("usual"), 0.6 * F.col("main_w"))) & (F.col("gap") > F.col("usual") + 4)
    cut = F.coalesce(wide_gap | (shorter > 0) & (overlap < 0.5 * shorter), F.lit(False))
    m = m.withColumn("cut", cut.cast("long")).withColumn("part", F.sum("cut").over(order) + 1)
    edges = [F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("low").alias("low"), F.max("high").alias("high")]
    groups = m.groupBy("page_num", "ord", "part").agg(*edges)
    first = m.groupBy("page_num", "ord", "part").agg(F.min("start").alias("first_start"), F.max("stop").alias("last_stop"))
    middle = (F.col("start") + F.col("stop")) / 2
    away = F.least(F.abs(middle - F.col("first_start")), F.abs(middle - F.col("last_stop")))
    near = c.filter("narrow").join(first, ["page_num", "ord"]).withColumn("place", F.row_number().over(Window.partitionBy("page_num", "ord", "start").orderBy(away, "part")))
    joined = near.filter("place = 1").select("page_num", "ord", "part", "start", "stop", "low", "high")
    return groups.unionByName(joined).groupBy("page_num", "ord", "part").agg(*edges)


def catalogue(fonts: DataFrame) -> DataFrame:
    """id, name, path of usable fonts (source, place, id, name, path, covers): of one id the first source's first."""
    best = Window.partitionBy("id").orderBy("source", "place", "path")
    return fonts.filter("covers").withColumn("turn", F.row_number().over(best)).filter("turn = 1").select("id", "name", "path")


def known_font(rows: DataFrame, fonts: DataFrame) -> DataFrame:
    """rows with font, empty where the catalogue doesn't have it."""
    ids = fonts.select(F.col("id").alias("font"), F.lit(True).alias("known_font"))
    kept = F.when(F.col("known_font"), F.col("font")).otherwise("")
    return rows.join(ids, "font", "left").withColumn("font", kept).drop("known_font")


def shares(values: DataFrame, group: str, value: str, dark: float = 85.0, white: float = 170.0) -> DataFrame:
    """group, p95, deviation, white, middle, dark: how the values of a group are spread."""
    v = F.col(value)
    part = lambda c: F.avg(c.cast("double"))
    return values.groupBy(group).agg(
        F.percentile(v, F.lit(0.95)).alias("p95"), F.stddev_pop(v).alias("deviation"),
        part(v > white).alias("white"), part((v >= dark) & (v <= white)).alias("middle"), part(v < dark).alias("dark"),
    )
