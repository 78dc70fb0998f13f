"""Literal cases of the text, check and box rules."""

import re
import time

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import check as K, fixed as X, geometry as G, text as T
from pagequarry.operators import batching as B, cascade as C, layout as L, lettering as Y, matching as M, policy as Q, review as V
from pagequarry.sources import files as S, replies as P


def values(spark, rows, expression):
    """expression over each text of rows, in order."""
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, text string")
    return [r.v for r in frame.select("k", expression(F.col("text")).alias("v")).orderBy("k").collect()]


def cases(spark, expression, pairs):
    assert values(spark, [a for a, _ in pairs], expression) == [b for _, b in pairs]


def test_cleaning(spark):
    cases(spark, T.clean_input, [("@cross the sky\nTMP 5", "across the 5"), ("été sky why", ""), ("  a\t b ", "a b"), ("魔術師 xyz", "魔術師")])
    cases(spark, T.clean_output, [("你好。。", "你好……"), ("是键(Kafna)——", "是关键"), ("好的。注：语气词", "好的"), ("一；二;三@", "一，二，三"), ("__好：", "好"), ("", "")])
    cases(spark, T.lettering_marks, [("え...!?", "え……！？"), ("はい、", "はい"), ("やめて~", "やめて～"), ("你  好", "你 好"), ("……。。。", "……")])


def test_noise(spark):
    noisy = lambda c: T.noise_reason(c).isNotNull()
    cases(spark, noisy, [("BAM!", True), ("see details below", True), ("Mr.", False), ("……", True), ("こん", False), ("こんにちは", False), ("", True), ("hello there", False)])
    cases(spark, T.is_meaningful, [("*", False), ("ok", True), ("zz", False), ("！？", True), ("a=b=c=d=", False), ("   ", False), ("Hello, world", True)])
    cases(spark, T.is_gibberish, [("RMMBBL", True), ("tmp", False), ("a|b c d", True), ("Bcdfg hello", False), ("Bcdfg ###", True)])


def test_rules_cost_a_few_scans_of_a_text(spark):
    """Each in multiples of one scan by pattern; binding cheap tests first took them down from 20 to 60."""
    lines = spark.range(4000, numPartitions=4).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.substring(F.md5((F.col("id") + k).cast("string")), 1, 7))).alias("text"))
    lines = lines.select(F.translate("text", "0123456789", "aeioulmnst").alias("text")).cache()

    def seconds(c):
        def once():
            began = time.perf_counter()
            lines.select(F.xxhash64(c)).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - began
        return min(once() for _ in range(4))

    text = F.col("text")
    scan = seconds(F.regexp_replace(text, r"[^\p{L}]", ""))
    terms = [(k, "译") for k in ("Theo", "The", "Thing", "der", "tion")]
    for rule in (T.clean_output(text), T.clean_input(text, terms), T.is_gibberish(text), T.noise_reason(text), T.strip(text)):
        assert seconds(rule) < 10 * scan
    lines.unpersist()


def test_odd_white_space_and_words(spark):
    assert [chr(k) for k in range(0x110000) if re.match(re.sub(r"\\x\{?([0-9a-f]+)\}?", lambda m: f"\\U{int(m[1], 16):08x}", X.WHITE), chr(k))] == list(T.WHITE_CHARS)
    spaced = [a + w + b for w in T.WHITE_CHARS for a, b in (("a", "b"), ("", "b"), ("a", ""), ("a ", " b"))]
    cases(spark, T.squeezed, [(s, " ".join(s.split())) for s in spaced])
    cases(spark, T.strip, [(s, s.strip()) for s in spaced])
    cases(spark, T.clean_input, [("O.O.M here", "here"), ("o-o-m x", "x"), ("\u0131t\u0131 a", "a"), ("it\u0131s a", "it\u0131s a"), ("tm1p tmpa", "tmpa"), ("b1c2d 日bcd bc e", "日bcd bc e"), ("für é", "é"), ("@@ 12,3", "aa 12,3"), ("", ""), (None, None)])
    cases(spark, T.clean_output, [("好 . , ", "好"), ("好 @ ", "好"), (" ,_ 好（注：x", "好"), ("a (b-c d) e", "a e"), ("好  的", "好 的"), ("好~!?,、", "好～！？"), ("。。。。好......", "……好……")])
    cases(spark, T.is_gibberish, [("##/ a/b", False), ("###/ #/", True), ("zwölf fünf", True), ("bcdf日 gfds x a", False), ("bc1d2f3g hello", False), ("bc1d2f3g xkcd9", True)])
    cases(spark, T.noise_reason, [("BAM bam bam bam", None), ("b-a.m! hello you", "effect"), ("1 2 3 a", "symbols"), ("ab/cd/ef/gh ijklmnop", "path"), ("ab/cd/ef ghijklmnopa", None)])


def test_titles_and_names(spark):
    key = lambda c: T.series_key(T.without_extension(c))
    cases(spark, key, [("図書館の大魔術師 第5巻.pdf", "図書館の大魔術師"), ("One_Piece_Vol.12.pdf", "One Piece"), ("Title 05.pdf", "Title"), ("1984.pdf", "")])
    cases(spark, T.safe_file_name, [("A/B?", "a_b_"), ("", "_default"), (" .x. ", "x"), ("n" * 90, "n" * 80)])


def test_terms(spark):
    pairs = [("K", "凯", False), ("SO", "所", False), ("Theo", "西奥", True), ("魔", "法", False), ("魔術", "魔术", True), ("12", "十二", False), ("a", "a", False), (None, "x", False)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, src string, tgt string, want boolean")
    assert frame.filter(M.valid_term(F.col("src"), F.col("tgt")) != F.col("want")).count() == 0
    fold = lambda c: T.fold_terms(c, [("A1X", "BBB"), ("BBB", "C$C\\")])
    cases(spark, fold, [("A1X", "C$C\\"), ("xA1X", "xA1X"), ("A1X A1X!", "C$C\\ C$C\\!")])
    hits = M.term_hits(spark.createDataFrame([(t,) for t in ("Theology", "Theo!", "xTheo", "theo", "魔術師")], "text string"), [("Theo", ""), ("魔術", "")])
    assert sorted((r.text, r.src) for r in hits.collect()) == [("Theo!", "Theo"), ("魔術師", "魔術")]
    assert M.term_hits(spark.createDataFrame([("theo",)], "text string"), [("Theo", "")], ignore_case=True).count() == 1


@pytest.mark.parametrize(("text", "source", "hard", "soft", "clean"), [
    ("えっ OK吗", "OK!?", "えっ", "", "OK吗"), ("※注意*", "", "", "※*", "注意"), ("50%折扣, 3.5折", "", "", "", "50%折扣， 3.5折"),
    ("Привет", "", "Привет", "", ""), ("你好。。", "", "", "", "你好。"), ("Don't 说", "don't", "", "", "Don’t 说"), ("好♪ 12:30", "", "", "", "好♪ 12:30"), ("한 好", "", "한", "", "好"), (None, None, "", "", ""),
])
def test_language_check(spark, text, source, hard, soft, clean):
    frame = spark.createDataFrame([(text, source)], "t string, s string")
    found = K.issues(F.col("t"), F.col("s"))
    r = frame.select(F.array_join(found["hard"], "").alias("h"), F.array_join(found["soft"], "").alias("s"), K.sanitized(F.col("t"), F.col("s")).alias("c")).first()
    assert (r.h, r.s, r.c) == (hard, soft, clean)
    if "’" in clean:  # a converted apostrophe splits the word that the source has
        return
    again = frame.select(K.sanitized(K.sanitized(F.col("t"), F.col("s")), F.col("s")).alias("c")).first().c
    assert again == clean


def test_odd_characters_in_their_places(spark):
    lines = [
        ("1%2 a% 3+ +b 4×5 ×", "a b", "", "%+×", ""), ("好1.5 1. .5 a.b 1,2,3 10:30-40 -x", "a b x", "", "", "好1.5 1。 。5 a。b 1,2,3 10:30-40 —x"),
        ("好Жab", "ab", "Ж", "", "好ab"), ("好abЖcd", "abcd", "abЖcd", "", "好"), ("好abЖcd", "ab cd", "Ж", "", "好abcd"), ("好\u212a k", "K", "", "", "好\u212a k"), ("好\u212a k", "x", "\u212ak", "", "好"),
        ("好#$&*<=>@[]^_{|}`", "", "", "#$&*<=>@[]^_{|}`", "好"), ("好don't Don't can't", "don't", "cant", "", "好don’t Don’t ’"), ("好\x01\x7f\U0001D538", "", "\U0001D538", "\x01\x7f", "好"), ("。，好、，", "", "", "", "好"), ("好。。、、x" + "y" * 9000, "", "xy", "", "好。"),
    ]
    frame = spark.createDataFrame([(k, t, s) for k, (t, s, *_) in enumerate(lines)], "k int, t string, s string")
    found = K.issues(F.col("t"), F.col("s"))
    got = frame.select("k", F.array_join(found["hard"], "").alias("h"), F.array_join(found["soft"], "").alias("s"), K.sanitized(F.col("t"), F.col("s")).alias("c")).orderBy("k").collect()
    assert [(r.h, r.s) for r in got] == [(h, s) for _, _, h, s, _ in lines]
    assert [r.c for r in got] == [c for *_, c in lines]


def test_scripts_are_counted_as_tokens(spark):
    texts = ["Don't 'quote' été ²3٣", "あゝ漢ー ㄱ한 K\u212a Ж\t\n\u3000!?", "", "''a'b''", "\U00020000\U0001F600", "a b " * 5000]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = frame.select("k", F.explode(F.array(K.script_counts(F.col("text")))).alias("n")).select("k", "n.*").orderBy("k").collect()
    assert [{c: r[c] for c in r.__fields__ if c != "k" and r[c]} for r in got] == [
        {"latin": 5, "space": 3, "symbol": 1, "digit": 3}, {"hangul": 2, "kana": 3, "cjk": 1, "script": 1, "symbol": 2, "space": 6, "latin": 2}, {}, {"latin": 1, "symbol": 2},
        {"cjk": 1, "symbol": 1}, {"latin": 10000, "space": 10000},
    ]


def test_check_and_fix_retries_hard_lines_only(spark):
    rows = [(1, 1, "", "好"), (1, 2, "", "好カ"), (1, 3, "", "カ"), (1, 4, "", "好※")]
    seen = []

    def retry(bad):
        seen.append(sorted(r.id for r in bad.collect()))
        return bad.select("page_num", "id", F.when(F.col("id") == 2, "行").otherwise("x").alias("reply"))

    out = {r.id: (r.text, r.retries, r.action) for r in C.check_and_fix(spark.createDataFrame(rows, "page_num long, id long, raw string, text string"), retry).collect()}
    assert out == {1: ("好", 0, None), 2: ("行", 1, "retranslated"), 3: ("", 2, "emptied"), 4: ("好", 0, "cleaned")}
    assert seen == [[2, 3], [3]]
    same = C.check_and_fix(spark.createDataFrame(rows, "page_num long, id long, raw string, text string"), retry, "English")
    assert sorted(r.text for r in same.collect()) == sorted(r[3] for r in rows)


def test_font_sizes(spark):
    cases(spark, G.clean_font_size, [("0", 0.0), ("-1", 0.0), ("NaN", 0.0), ("2", 4.0), ("999", 150.0), ("12.34", 12.3), (None, 0.0)])


def packed(spark, pack, lines):
    frame = spark.createDataFrame([(1, k, n) for k, n in enumerate(lines)], "doc long, page_num long, lines long")
    return [r.batch for r in pack(frame).orderBy("page_num").collect()]


def test_packing(spark):
    assert packed(spark, B.pack_before, [5, 5, 4, 9, 1, 12, 3]) == [0, 0, 1, 2, 2, 3, 4]
    assert packed(spark, B.pack_after, [5, 5, 4, 9, 1, 12, 3]) == [0, 0, 0, 1, 1, 1, 2]
    assert packed(spark, B.pack_before, [0, 13]) == [0, 1]
    halves = B.halves(spark.createDataFrame([(1, 25), (2, 12)], "batch long, lines long")).collect()
    assert [r.part_lines for r in halves if r.batch == 1] == [13, 12] and [r.part_lines for r in halves if r.batch == 2] == [1] * 12


def test_vertical_columns(spark):
    cases(spark, lambda c: L.vertical_columns(c, 3), [("你好吗！再见", ["你好吗！", "再见"]), ("", [""]), (None, [""]), ("你好吗！？再见了。", ["你好吗！？", "再见了。"])])
    cases(spark, lambda c: L.vertical_columns(c, 2), [("一\n二三", ["一", "二三"]), (" \r\n ", [""]), ("！一二", ["！一", "二"])])


def test_local_noise_takes_unicode_white_space(spark):
    noisy = lambda c: T.local_noise_reason(c).isNotNull()
    cases(spark, noisy, [("ABC\u3000DE", True), ("ABC DE", True), ("12\u2003AB", True), ("ABC DEf", False), ("こんにちは", True), ("²³", False), ("Hello there", False), ("x", True)])
    cases(spark, T.local_noise_reason, [("ABCDEFG HIJK", None), ("AB CDEFG", "pattern"), ("ABCD", "capitals"), ("a" + "!" * 9, "symbols")])


def test_titles_are_composed(spark):
    key = lambda c: T.series_key(T.without_extension(c))
    cases(spark, key, [("Ｔｉｔｌｅ ０５.pdf", "Title"), ("Foo Ｖｏｌ．１２.pdf", "Foo"), ("ﾀｲﾄﾙ　第③巻.pdf", "タイトル"), ("Ovol 3.pdf", "Ovol"), ("x/[a] B【完】.zip", "B"), (None, None)])


def test_declared_korean(spark):
    frame = spark.createDataFrame([("hello", "Korean"), ("hello", "English"), ("こんにちは", None)], "t string, d string")
    assert [r.v for r in frame.select(T.source_language(F.col("t"), F.col("d")).alias("v")).collect()] == ["ko", "en", "auto"]


def test_terms_of_a_table_are_found_as_by_patterns(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["Theology", "Theo!", "xTheo", "theo", "魔術師", "Mr. Theo-Rose", "(Rose)", "привет мир", "Привет", "a.b", "", "Jean-Luc left", "jean-LUC"])], "k long, text string")
    terms = [("Theo", "西奥"), ("魔術", "魔术"), ("Rose", "罗斯"), ("Привет", "你好"), ("Jean-Luc", "让"), ("Theo-Rose", "两")]
    table = spark.createDataFrame(terms, "src string, tgt string")
    for case in (False, True):
        want = sorted((r.k, r.src) for r in M.term_hits(texts, terms, ignore_case=case).collect())
        assert sorted((r.k, r.src) for r in M.term_join(texts, table, ignore_case=case).collect()) == want and len(want) > 6
    tiers = spark.createDataFrame([(1, "Theo", "西奥", "curated"), (2, "Theo", "其", "auto"), (3, "left", "左", "auto")], "ord int, src string, tgt string, tier string")
    assert sorted((r.k, r.tgt) for r in M.hints(texts, tiers).collect()) == [(1, "西奥"), (3, "西奥"), (5, "西奥"), (11, "左")]


def test_texts_are_not_shuffled_to_find_terms(spark, monkeypatch):
    rows = [(1, "Theo and Rose"), (1, "Theo and Rose"), (2, "xab魔法 Kelvin \u212aelvin"), (3, "rose"), (4, None)]
    texts = spark.createDataFrame(rows, "k long, text string")
    terms = spark.createDataFrame([("Theo", "西奥"), ("Rose", "罗斯"), ("ab魔", "甲"), ("\u212aelvin", "乙"), ("Mary Sue", "丙")], "src string, tgt string")
    want = [(1, "Rose"), (1, "Rose"), (1, "Theo"), (1, "Theo"), (2, "ab魔")]
    for at_once in (100_000, 2):
        monkeypatch.setattr(M, "TERMS_AT_ONCE", at_once)
        found = M.term_join(texts, terms)
        assert sorted((r.k, r.src) for r in found.filter("tgt <> '乙'").collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 1
        assert sorted((r.k, r.src) for r in M.term_join(texts, terms, ignore_case=True).collect()) == sorted([*want, (2, "\u212aelvin"), (3, "Rose")])



LINES = "page_num long, id long, raw string, text string"


def test_a_retry_is_told_why_and_may_fail(spark):
    rows = spark.createDataFrame([(1, 1, "", "好カ"), (1, 2, "", "キカ好"), (2, 1, "", "ж好")], LINES)
    told = []

    def broken(bad):
        told.append(bad.first().hint)
        raise RuntimeError("no model")

    out = {(r.page_num, r.id): (r.text, r.retries, r.action) for r in C.check_and_fix(rows, broken).collect()}
    assert out == {(1, 1): ("好", 0, "cleaned"), (1, 2): ("好", 0, "cleaned"), (2, 1): ("好", 0, "cleaned")}
    assert len(told) == 1 and "：カキж。" in told[0]
    silent = C.check_and_fix(rows, lambda bad: bad.select("page_num", "id", F.lit("好").alias("reply")).limit(0))
    assert {r.retries for r in silent.collect()} == {0}


def test_a_translator_that_fails_is_passed_over(spark):
    blocks = C.classify(spark.createDataFrame([(1, 1, "hello there friend")], "page_num long, id long, text string"))
    calls = []

    def flaky(left):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("busy")
        return left.select("page_num", "id", F.lit("你好").alias("reply"))

    def broken(left):
        raise ValueError

    assert [(r.translated_text, r.translation_engine) for r in C.translate(blocks, [("broken", broken), ("flaky", flaky)]).collect()] == [("你好", "flaky")]


def test_polish_and_prompt(spark):
    rows = [(1, 1, "What do you think you are doing", "你在做什么", "web"), (1, 2, "NO WAY MAN", "没门", "web"), (1, 3, "What on earth is it that you say", "", "none"), (1, 4, "Let me go home now please sir", "让我回家", "web")]
    frame = spark.createDataFrame(rows, "page_num long, id long, cleaned_text string, translated_text string, translation_engine string")
    step = lambda d: d.select("page_num", "id", F.when(F.col("id") == 1, "你究竟在干什么。。").otherwise("nope").alias("reply"))
    assert sorted((r.id, r.translated_text, r.translation_engine) for r in C.polish(frame, step).collect()) == [(1, "你究竟在干什么……", "polished"), (2, "没门", "web"), (3, "", "none"), (4, "让我回家", "web")]
    hints = spark.createDataFrame([(1, 2, "B", "乙"), (1, 1, "A", "甲"), (1, 1, "A", "甲")], "page_num long, ord int, src string, tgt string")
    lines = spark.createDataFrame([(1, 2, " two "), (1, 1, "one"), (2, 1, "x")], "page_num long, id long, text string")
    assert {r.page_num: r.prompt for r in C.prompts(lines, hints, "again").collect()} == {1: "ID: 1 | 原文: one\nID: 2 | 原文: two\n- A -> 甲\n- B -> 乙\nagain", 2: "ID: 1 | 原文: x\nagain"}


def test_warnings(spark):
    one = lambda frame: frame.first().warning
    pages = spark.createDataFrame([(9,), (2,)], "page_num long")
    assert one(C.failed_pages_warning(pages)) == "2 页提取失败，已保留原页未翻译: 第 2, 9 页" and one(C.failed_pages_warning(pages.limit(0))) == ""
    found = spark.createDataFrame([(1, k, "カキクケコサシ") for k in range(9)], "page_num long, id long, chars string")
    said = one(C.flagged_warning(found))
    assert said.startswith("校对译文含非简体中文字符或符号（未自动修改）: 第1页#0（カキクケコサ）、第1页#1") and said.endswith("第1页#7（カキクケコサ） 等共 9 行") and one(C.flagged_warning(found.limit(0))) == ""
    report = spark.createDataFrame([(1, 1, "cleaned", "カ"), (1, 2, "retranslated", ""), (2, 1, "emptied", "ж"), (2, 2, None, "")], "page_num long, id long, action string, removed string")
    assert one(C.language_warning(report)) == "语言检查: 1 行重译后合格，1 行已清理非法字符，1 行清理后无中文，保留原文：第1页#1（去掉「カ」）、第1页#2、第2页#1（去掉「ж」）"
    assert one(C.language_warning(report.filter("action IS NULL"))) == ""


BLOCK = "page_num long, id long, box struct<x0:double,y0:double,x1:double,y1:double>, direction string, font string, font_size_pt double"
ROW = "page_num long, id long, box struct<x0:double,y0:double,x1:double,y1:double>, text string, raw string, direction string, font string, font_size double"


def test_changes_of_a_review(spark):
    box, far = (0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 12.0)
    old = spark.createDataFrame([(1, k, box, "vertical" if k == 4 else None, "file:a" if k == 6 else None, 12.0 if k == 5 else None) for k in range(1, 9)] + [(2, 1, box, None, None, None)], BLOCK)
    rows = [
        (1, 1, box, "译", "r", "", "", 0.0), (1, 2, far, "译", "r", "horizontal", None, None), (1, 3, far, "new", "r", None, "", 0.0), (1, 4, box, "译", "", "", "", 0.0), (1, 5, box, "译", "", "", "", 0.0),
        (1, 6, box, "译", "", "", "", 0.0), (1, 7, (0.0, 0.0, 11.0, 10.0), "译", "", "", "", 0.0), (1, 20, box, " ", "\t", "", "", 0.0), (1, 21, box, "", "seen", "", "", 0.0), (9, 1, box, "", "", "", "", 0.0),
    ]
    said = spark.createDataFrame([(1, k, "译") for k in range(1, 9)], "page_num long, id long, translated_text string")
    out = {(r.page_num, r.id): r for r in V.changes(old, spark.createDataFrame(rows, ROW), said).collect()}
    flags = ("moved", "typed", "turned", "sized", "refont")
    assert {k: (r.change, [f for f in flags if r[f]], r.need_ocr) for k, r in out.items()} == {
        (1, 1): ("kept", [], False), (1, 2): ("kept", ["moved"], True), (1, 3): ("kept", ["moved", "typed"], False), (1, 4): ("kept", ["turned"], False), (1, 5): ("kept", ["sized"], False),
        (1, 6): ("kept", ["refont"], False), (1, 7): ("kept", [], False), (1, 8): ("removed", [], False), (1, 20): ("drawn", [], True), (1, 21): ("drawn", [], False),
    }
    assert {k for k, r in out.items() if r.user_edited} == {(1, k) for k in (2, 3, 4, 5, 6, 20, 21)}


def test_boxes_are_read_again(spark):
    boxes = spark.createDataFrame([(1, 1, (1, 1, 2, 2)), (1, 2, (5, 1, 6, 2))], "page_num long, id long, box struct<x0:int,y0:int,x1:int,y1:int>")
    read = lambda b: b.filter("box.x0 = 1").select("page_num", "id", F.lit(" hi ").alias("raw"))
    said = lambda t: t.select("page_num", "id", F.concat(F.lit("译"), "text").alias("translated_text"))
    assert sorted(map(tuple, V.read_again(boxes, read, said).collect())) == [(1, 1, "hi", "译hi", False), (1, 2, "", "", True)]


def test_first_engine_that_reads_anything(spark):
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    boxes = spark.createDataFrame([(1, k, (k * 10, 0, k * 10 + 5, 5)) for k in range(1, 6)] + [(1, 9, (7, 0, 7, 5))], f"page_num long, ord long, box {box}")
    asked = []

    def engine(name, known):
        def run(left):
            asked.append((name, sorted(r.ord for r in left.collect())))
            return left.select("page_num", "ord", F.coalesce(*[F.when(F.col("ord") == k, t) for k, t in known.items()], F.lit("")).alias("text"))
        return run

    strings = spark.createDataFrame([(1, 1, (40, 0, 42, 9), "over"), (1, 2, (41, 0, 43, 9), "lap"), (1, 3, (50, 8, 55, 9), "away")], f"page_num long, n long, box {box}, text string")
    out = Y.read_boxes(boxes, [("a", engine("a", {1: "first text"})), ("b", engine("b", {1: "no", 2: "first text!", 3: "=|="}))], strings)
    assert sorted((r.ord, r.text, r.ocr_engine) for r in out.collect()) == [(1, "first text", "a"), (4, "over lap", "overlap")]
    assert asked == [("a", [1, 2, 3, 4, 5]), ("b", [2, 3, 4, 5])]


def test_glyph_sizes(spark):
    ink = lambda text: [c == "#" for c in text]
    profiles = {1: "##########..######..#########...####", 2: "#####.####", 3: "......", 4: "####################.......###########......############"}
    rows = [(b, k, v) for b, t in profiles.items() for k, v in enumerate(ink(t))]
    got = {r.box: r.glyph for r in Y.glyph_sizes(spark.createDataFrame(rows, "box long, position long, inked boolean"), "box", "position", "inked").collect()}
    assert got == {1: 9, 2: 0, 3: 0, 4: 16}  # 10, 6, 9; none of six; none; 20 and 12 (11 is under 0.6 of 20)
    frame = spark.createDataFrame([(0, 10), (5, 10), (12, 10), (30, 10)], "g int, p int")
    assert [r.v for r in frame.select(Y.page_bounds(F.col("g"), F.col("p")).alias("v")).collect()] == [16, 8, 12, 16]


def test_sizes_from_areas(spark):
    frame = spark.createDataFrame([(10, 100, 100, 0), (10, 100, 100, 12), (0, 10, 10, 0), (1, 900, 900, 0)], "n int, w int, h int, most int")
    got = [tuple(r.v) for r in frame.select(Y.area_sizes(*map(F.col, ("n", "w", "h", "most"))).alias("v")).collect()]
    assert got == [(10, 36), (10, 12), (10, 20), (10, 120)]  # sqrt(85 * 85 / 12.5) is 24, one and a half times


def test_boxes_cut_by_their_columns(spark):
    rows = [
        (1, 0, 10, 0, 100), (1, 13, 23, 0, 100), (1, 26, 36, 0, 100), (1, 60, 70, 0, 100), (1, 72, 75, 10, 30),  # a gap, and furigana beside the last
        (2, 0, 10, 0, 40), (2, 12, 22, 60, 100), (3, 0, 10, 0, 100),
    ]
    out = Y.split_columns(spark.createDataFrame([(1, o, *r) for o, *r in rows], "page_num long, ord long, start long, stop long, low long, high long"))
    assert sorted((r.ord, r.part, r.start, r.stop, r.low, r.high) for r in out.collect()) == [(1, 1, 0, 36, 0, 100), (1, 2, 60, 75, 0, 100), (2, 1, 0, 10, 0, 40), (2, 2, 12, 22, 60, 100), (3, 1, 0, 10, 0, 100)]


def test_first_source_of_a_font_wins(spark):
    fonts = spark.createDataFrame([(2, 1, "x", "system", "/s", True), (1, 1, "x", "env", "/e", True), (0, 1, "x", "none", "/n", False), (0, 2, "y", "file", "/f", True)], "source int, place int, id string, name string, path string, covers boolean")
    kept = Y.catalogue(fonts)
    assert sorted(r.name for r in kept.collect()) == ["env", "file"]
    asked = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "k int, font string")
    assert sorted((r.k, r.font) for r in Y.known_font(asked, kept).collect()) == [(1, "x"), (2, ""), (3, "")]


def test_pages_after_a_bad_one_go_on(spark):
    docs = spark.createDataFrame([("a", b"one|!|three|?"), ("b", b"x")], "path string, content binary")

    def split(content, pages):
        for k, t in enumerate(content.decode().split("|"), 1):
            yield k, (ValueError("broken") if t == "!" else (lambda: 1 / 0) if t == "?" else [{"text": t}])

    good, failed = S.good_and_failed(S.split_pages(docs, split, "text string"))
    assert sorted((r.path, r.page_num, r.text) for r in good.collect()) == [("a", 1, "one"), ("a", 3, "three"), ("b", 1, "x")]
    assert sorted((r.path, r.page_num, r.error) for r in failed.collect()) == [("a", 2, "ValueError: broken"), ("a", 4, "ZeroDivisionError: division by zero")]


def test_small_documents_share_a_frame(spark, monkeypatch):
    """One frame a document cost a millisecond each; a large document's rows are not held together either."""
    docs = spark.createDataFrame([(str(k), b"x|y") for k in range(500)] + [("long", b"|".join([b"z" * 50] * 900))], "path string, content binary").coalesce(1)
    made = []

    class Documents:
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            made.extend(run(iter([docs.toPandas()])))

    def split(content, pages):
        for k, t in enumerate(content.decode().split("|"), 1):
            yield k, [{"text": t}]

    S.split_pages(Documents(), split, "text string")
    assert len(made) == 1 and len(made[0]) == 1900
    monkeypatch.setattr(S, "FRAME_ROWS", 100)
    made.clear()
    S.split_pages(Documents(), split, "text string")
    assert {len(f) for f in made} == {100} and len(made) == 19


def test_packing_of_null_documents_and_lines(spark):
    frame = spark.createDataFrame([(None, 1, 7), (None, 2, 7), (2**60 + 1, 1, None), (2**60 + 1, 2, 12)], "doc long, page_num long, lines long")
    assert sorted(((r.doc or 0, r.page_num, r.lines, r.batch) for r in B.pack_before(frame).collect())) == [(0, 1, 7, 0), (0, 2, 7, 1), (2**60 + 1, 1, 0, 0), (2**60 + 1, 2, 12, 0)]


def test_violations_read_the_rows_once(spark, monkeypatch):
    monkeypatch.setattr(X, "EDITOR_ROWS", 3)
    rows = [(1, 1, 1, None), (1, 1, 1, "box"), (1, 1, 2, "box"), (1, 1, 2, "box"), (1, 2, None, "incomplete"), (2, 1, 1, None), (2, 1, 2, None), (2, 1, 3, None), (2, 1, None, None), (None, 1, 5, None), (None, 1, 5, None), (3, None, None, "no pages")]
    found = P.violations(spark.createDataFrame(rows, "doc long, page_num int, id long, problem string"))
    want = [(1, 1, 1, "box"), (1, 1, 1, "id repeats"), (1, 1, 2, "box"), (1, 1, 2, "box"), (1, 1, 2, "id repeats"), (1, 2, None, "incomplete"), (1, None, None, "too many rows"), (None, 1, 5, "id repeats"), (3, None, None, "no pages")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_model_replies(spark):
    items = lambda c: F.to_json(P.reply_items(c))
    cases(spark, items, [('```json\n[{"id": 1}]\n```', '[{"id":"1"}]'), ('{"b": [{"id": 2}]}', '[{"id":"2"}]'), ('{"id": 3}', '[{"id":"3"}]'), ("no", "[]"), ("", "[]")])


def test_bad_documents_go_aside(spark):
    docs = spark.createDataFrame([("a", b"one|two"), ("b", b"!"), ("c", b"three")], "path string, content binary")

    def split(content, pages):
        if content == b"!":
            raise ValueError("broken")
        for k, t in enumerate(content.decode().split("|"), 1):
            if pages is None or k in pages:
                yield k, [{"text": t}]

    good, failed = S.good_and_failed(S.split_pages(docs, split, "text string"))
    assert sorted((r.path, r.page_num, r.text) for r in good.collect()) == [("a", 1, "one"), ("a", 2, "two"), ("c", 1, "three")]
    assert [(r.path, r.error) for r in failed.collect()] == [("b", "ValueError: broken")]
    assert S.good_and_failed(S.split_pages(docs, split, "text string", [2]))[0].count() == 1


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "terms.json").write_text('{"Theo": "西奥", "K": "凯"}', encoding="utf-8")
    (tmp_path / "list.json").write_text("[1, 2]")
    (tmp_path / "glossary.json").write_text('[{"src": "Theo", "tgt": "别", "lang": "en"}, {"src": "Rose", "tgt": "罗斯"}]', encoding="utf-8")
    terms = S.read_dictionary(spark, str(tmp_path / "terms.json"), "curated").unionByName(S.read_glossary(spark, str(tmp_path / "glossary.json")))
    assert sorted((r.src, r.tgt) for r in M.load_terms(terms).collect()) == [("Rose", "罗斯"), ("Theo", "西奥")]
    assert S.read_dictionary(spark, str(tmp_path / "list.json"), "auto").count() == 0 == S.read_dictionary(spark, str(tmp_path / "none.json"), "auto").count()
    assert S.read_cache(spark, str(tmp_path / "none")).count() == 0
    entries = spark.createDataFrame([("k", "v")], "cache_key string, cached string")
    S.write_cache(entries, str(tmp_path / "cache"))
    assert S.read_cache(spark, str(tmp_path / "cache")).collect() == entries.collect()


def test_policies(spark):
    cases(spark, Q.out_of_memory, [("CUDA Out Of Memory", True), ("fine", False), (None, False), ("DirectML lost", True)])
    now, calls = [0.0], []

    def step(left):
        calls.append(now[0])
        if len(calls) < 4:
            raise OSError("down")
        return left

    guarded = Q.Breaker(step, clock=lambda: now[0])
    frame = spark.range(1)
    for at, fails in ((0, OSError), (1, OSError), (2, RuntimeError), (300, RuntimeError), (302, OSError), (303, RuntimeError)):
        now[0] = at
        with pytest.raises(fails):
            guarded(frame)
    now[0] = 700
    assert guarded(frame) is frame and guarded.failed == 0 and calls == [0, 1, 302, 700]
    models = spark.createDataFrame([(1, "a", 1, True, False, 500), (1, "b", 2, False, False, 10), (1, "c", 3, True, True, 900), (1, "d", 4, True, False, 600), (1, "e", 5, True, False, 300), (2, "a", 1, True, False, 1)], "host int, model string, priority int, capable boolean, resident boolean, need int")
    hosts = spark.createDataFrame([(1, 1000.0, 200), (2, None, 0)], "host int, free double, reserve int")
    assert sorted((r.host, r.model) for r in Q.placement(models, hosts).collect() if r.device == "gpu") == [(1, "a"), (1, "c"), (1, "e")]
    defaults, seen = spark.createDataFrame([("a", 5), ("b", 6)], "model string, need long"), spark.createDataFrame([("a", 1, 50.0), ("a", 2, 200.0), ("a", 3, 7000.0), ("b", 1, 10.0)], "model string, n int, delta double")
    assert sorted(map(tuple, Q.measured_costs(defaults, seen).collect())) == [("a", 240), ("b", 6)]


def test_what_a_client_is_told(spark):
    states = [(0, "queued"), (0, "queued"), (5, "processing"), (5, "review"), (5, "review"), (5, "processing"), (5, "processing"), (9, "complete"), (10, "processing")]
    rows = spark.createDataFrame([(1, k, p, s) for k, (p, s) in enumerate(states)] + [(2, 0, 0, "failed"), (2, 1, 1, "complete")], "task long, n long, percent long, status string")
    assert sorted(map(tuple, Q.progress_events(rows).collect())) == [(1, 0, "progress", 0), (1, 2, "progress", 5), (1, 3, "review", 5), (1, 5, "progress", 5), (1, 7, "complete", 9), (2, 0, "error", 0)]


def test_lettering_is_placed_clear_of_what_stands(spark):
    rows = [(1, 1, (0, 0, 100, 100), 4, 0, 0), (1, 2, (40, 40, 140, 140), 4, 0, 0), (1, 3, (0, 0, 100, 100), 4, 0, 14), (1, 4, (300, 300, 340, 340), 0, 0, 0), (None, 1, (0, 0, 100, 100), 4, 12, 0)]
    frame = spark.createDataFrame(rows, "page_num long, ord long, box struct<x0:int,y0:int,x1:int,y1:int>, n_chars int, most int, forced int")
    got = {(r.page_num, r.ord): r for r in Y.place(frame).collect()}
    first = got[1, 1]
    # 85 usable of 100: two lines of two characters of 34 are 85 high; the rest of the way up, 35 and more, doesn't fit
    assert (first.size, first.left, first.top, first.right, first.bottom) == (34, 16.0, 7.5, 84.0, 92.5)
    second = got[1, 2]
    assert second.size < 34 and not (second.left < first.right + 2 and second.top < first.bottom + 2) or second.size <= 9
    assert got[1, 3].size == 14 and got[None, 1].size == 12 and got[1, 4].size == 27


def test_masks_of_pages(spark):
    docs = spark.createDataFrame([("a", b"xy")], "path string, content binary")
    split = lambda content, pages: ((k, [{"page_width": 1.0 * k, "page_height": 2.0, "mask": content[:k]}]) for k in (1, 2) if pages is None or k in pages)
    assert [(r.page_num, r.page_width, bytes(r.mask)) for r in S.split_masks(docs, split, [2]).collect()] == [(2, 2.0, b"xy")]
