"""Working relations of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..runtime import spread

#: Lines of scripts that the tables don't hold, as (id, text).
SAMPLE_LINES = [
    (1, "こんにちは"), (2, "こん"), (3, "魔術師の塔"), (4, "안녕하세요"), (5, "え...!?"), (6, "はい、"), (7, "やめて~"),
    (8, "你好。。"), (9, "50%折扣, 3.5折"), (10, "Привет"), (11, "えっ OK吗"), (12, "※注意*"), (13, "BAM!"), (14, "see details below"),
    (15, "Mr."), (16, "……"), (17, "RMMBBL"), (18, "a|b"), (19, "@cross the sky TMP 5"), (20, "ok"), (21, "x"), (22, "1234"), (23, "12345"),
    (24, "   "), (25, "a/b/c/d/e/f/g/h/i"), (26, "WHIPP"), (27, "4T"), (28, "KAFNA TEPEL said"), (29, "你 好 吗；是键(Kafna)——"), (30, "好的。注：这里的语气词"),
    (31, "Theo!"), (32, "Theology xTheo theo"), (33, "魔術"), (34, "don't stop"), (35, "**##**"), (36, "été sky why"), (37, "对不起，我无法提供"), (38, ""),
    (39, "Don't 说 OK don't"), (40, "（好～）:12:30, x+y"),
]

#: Dictionary entries as (ord, src, tgt, tier): curated ones are applied, automatic ones are hints only.
SAMPLE_TERMS = [
    (1, "魔術師", "魔法师", "curated"), (2, "魔術", "魔术", "curated"), (3, "Theo", "西奥", "curated"), (4, "The", "那", "curated"),
    (5, "Thing", "物", "curated"), (6, "那", "这", "curated"), (7, "der", "该", "curated"), (8, "K", "凯", "curated"), (9, "SO", "所", "curated"),
    (10, "魔", "法", "curated"), (11, "12", "十二", "curated"), (12, "abc", "abc", "curated"), (13, "  tion ", " 词 ", "curated"),
    (14, "The", "其", "auto"), (15, "wh", "何", "auto"), (16, "les", "些", "auto"), (17, "que", "哪", "auto"), (18, "塔", "塔楼", "auto"),
    (19, "x" * 31, "长", "auto"), (20, "", "空", "auto"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_LINES, "id int, text string")


def sample_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_TERMS, "ord int, src string, tgt string, tier string")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text block per line of a document, and the sample lines on page -1."""
    docs = spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("page_num"), "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = docs.select("page_num", (F.col("pos") + 1).cast("long").alias("id"), "text", "lang")
    return lines.unionByName(sample_lines(spark).select(F.lit(-1).cast("long").alias("page_num"), F.col("id").cast("long"), "text", F.lit("xx").alias("lang")))


def box(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_num, ord, box, conf: whole coordinates from the keys of lineitem, some four boxes a page."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    i = read(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(order).cast("long"))
    x0, y0 = (F.col("l_partkey") * 7 + F.col("ord") * 13) % 160, (F.col("l_suppkey") * 11 + F.col("l_orderkey") * 3) % 200
    w, h = 20 + F.col("l_partkey") % 90, 15 + (F.col("l_orderkey") + F.col("ord") * 17) % 80
    conf = ((F.col("l_partkey") * 31 + F.col("ord") * 7) % 101).cast("long")
    return i.select(F.col("l_orderkey").alias("page_num"), "ord", box(x0, y0, w, h).alias("box"), conf.alias("conf"))


def moved_boxes(boxes: DataFrame) -> DataFrame:
    """The boxes a user has moved a little, with some deleted and some renumbered."""
    dx, dy = (F.col("page_num") + F.col("ord")) % 9 - 4, (F.col("page_num") * 3 + F.col("ord")) % 7 - 3
    new = F.struct((F.col("box.x0") + dx).alias("x0"), (F.col("box.y0") + dy).alias("y0"), (F.col("box.x1") + dx).alias("x1"), (F.col("box.y1") + dy).alias("y1"))
    renamed = F.when(F.col("page_num") % 13 == 0, F.col("ord") + 1).otherwise(F.col("ord"))
    return boxes.filter((F.col("page_num") + F.col("ord")) % 10 != 0).select("page_num", renamed.alias("ord"), new.alias("box"), F.col("ord").alias("was"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page_num, lines: the turns of a conversation as pages of a document, their lines counted; a null text has none."""
    c = read(spark, sf_dir, "conversations")
    n = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", " ")) % 9)
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_num"), n.cast("long").alias("lines"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag, seconds, tokens, ok: one call of a stage per event."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("tag"), F.col("user_id").alias("part"), F.round("value", 2).alias("seconds"), (F.col("event_id") % 97).alias("tokens"), (F.col("event_id") % 11 != 0).alias("ok"))
