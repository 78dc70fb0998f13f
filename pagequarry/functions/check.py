"""The language check of translated lines: which characters don't belong, and the line without them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import fixed as X
from .text import WHITE, WHITE_CHARS, gated, let, replaced, strip

_WORD = r"([A-Za-z][A-Za-z']*)"
_DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
_FINE = X.EMOTIVE + X.SENTENCE_MARKS + X.EMOJI[1:-1] + X.WIDE_HAN[1:-1] + WHITE[1:-1] + _DIGIT[1:-1]
_MARKS = "".join(sorted({*X.ASCII_MARKS, *X.DIGIT_MARKS}))
_ONLY_DIGIT_MARKS = "".join(c for c in X.DIGIT_MARKS if c not in X.ASCII_MARKS)
#: A character that doesn't belong, whatever the source says: not fine, no mark, or one of arithmetic without a digit
#: beside it.  The common ASCII characters are passed over first.
_ODD = rf"(?=[^A-Za-z0-9 {re.escape(''.join(X.ASCII_MARKS))}])(?:[^A-Za-z{_FINE}{re.escape(_MARKS)}]|[{re.escape(_ONLY_DIGIT_MARKS)}](?<!{_DIGIT}.)(?!{_DIGIT}))"
#: The Kelvin sign is no Latin word, but its lower case is one that a source may have.
_KELVIN = r"\x{212A}"
_GONE = "\x01"


#: Classes of characters, the first that holds one counts; what none holds is a symbol.
SCRIPTS = [("kana", X.KANA), ("hangul", X.HANGUL), ("cjk", X.WIDE_HAN), ("space", WHITE), ("digit", _DIGIT), ("latin", r"[\p{IsLatin}&&\p{L}]"), ("script", r"\p{L}")]


def script_counts(text: Column) -> Column:
    """struct of kana, hangul, cjk, space, digit, latin, script, symbol: how many tokens of each class text has.

    Tokens are Latin words and single other characters.  Words and blanks are counted first and at once; of the few
    characters that remain each class is taken out in turn.
    """
    latin = F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)))
    space = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    rest = F.regexp_replace(text, "(?:[A-Za-z][A-Za-z']*+| )++", "")
    bound = F.struct(rest.alias("rest"), latin.alias("latin"), space.alias("space"))
    return let(bound, lambda b: _counted(b["rest"], SCRIPTS, {"latin": b["latin"], "space": b["space"]}))


def _counted(rest: Column, classes: list[tuple[str, str]], known: dict[str, Column]) -> Column:
    """struct of the number of characters of each class, besides known ones."""
    def after(rest: Column, k: int, found: list[Column]) -> Column:
        if k == len(classes):
            return F.struct(*found, F.length(rest).alias("symbol"))
        name, chars = classes[k]
        n = lambda left: (F.length(rest) - F.length(left) + known.get(name, F.lit(0))).alias(name)
        return let(F.regexp_replace(rest, f"{chars}+", ""), lambda left: after(left, k + 1, [*found, n(left)]))

    return after(rest, 0, [])


def _said(source: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(_WORD), F.lit(1)), F.lower)


def _bound(text: Column, source: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(text, words of the source), both computed once, and outside of what use makes of them."""
    both = F.struct(F.coalesce(text, F.lit("")).alias("text"), _said(source).alias("said"))
    return let(both, lambda b: use(b["text"], b["said"]))


def _unknown(found: Column, said: Column) -> Column:
    """Those of the tokens found that the source hasn't, in lower case."""
    return F.array_except(F.transform(found, F.lower), said)


def issues(text: Column, source: Column) -> Column:
    """struct(hard, soft): the characters that don't belong, each once, in order.

    Latin words that the source has too are fine; digits excuse a symbol of arithmetic on either side.  Only words and
    odd characters are looked at, each once.
    """
    found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"([A-Za-z][A-Za-z']*|{_ODD})"), F.lit(1)))
    hard = lambda t: t.rlike(rf"\p{{L}}|{X.KANA}|{X.HANGUL}")
    chars = lambda ts: F.array_distinct(F.flatten(F.transform(ts, lambda t: F.filter(F.split(F.replace(t, F.lit("'"), F.lit("")), ""), lambda c: c != ""))))
    parted = lambda bad: F.struct(chars(F.filter(bad, hard)).alias("hard"), chars(F.filter(bad, lambda t: ~hard(t))).alias("soft"))
    wrong = lambda ts, said: let(_unknown(ts, said), lambda low: F.when(F.size(low) == 0, F.array().cast("array<string>")).otherwise(F.filter(ts, lambda t: F.array_contains(low, F.lower(t)))))
    return _bound(text, source, lambda t, said: let(found(t), lambda ts: let(wrong(ts, said), parted)))


def sanitized(text: Column, source: Column) -> Column:
    """text without those characters, ASCII marks in their Chinese form; empty if no Han script is left."""
    return _bound(text, source, _sanitized)


def _sanitized(t: Column, said: Column) -> Column:
    t = F.regexp_replace(t, rf"(?!{_KELVIN})(?:{_ODD})", _GONE)  # gone at last, as words must not meet
    t = replaced(t, [kv for kv in X.ASCII_MARKS.items() if kv[0] not in "'" + X.DIGIT_MARKS])
    for m, wide in X.ASCII_MARKS.items():
        if m in X.DIGIT_MARKS:  # stays between digits
            free = rf"{re.escape(m)}(?:(?<!{_DIGIT}.)|(?!{_DIGIT}))"
            t = gated(t, lambda x, m=m: x.contains(m), lambda x, free=free, wide=wide: F.regexp_replace(x, free, wide))
    words = lambda x: F.regexp_extract_all(x, F.lit(f"([A-Za-z][A-Za-z']*|{_KELVIN})"), F.lit(1))
    parts = lambda x: F.regexp_extract_all(x, F.lit(f"([A-Za-z][A-Za-z']*|{_KELVIN}|[^A-Za-z{_KELVIN}]+)"), F.lit(1))
    put = lambda low: lambda p: F.when(F.array_contains(low, F.lower(p)), F.regexp_replace(p, "[^']+", "")).otherwise(p)
    known = lambda x: let(_unknown(words(x), said), lambda low: F.when(F.size(low) == 0, x).otherwise(F.array_join(F.transform(parts(x), put(low)), "")))
    t = replaced(let(t, known), [("'", X.ASCII_MARKS["'"]), (_GONE, "")])
    t = gated(t, lambda x: x.rlike("[ 　]{2}"), lambda x: F.regexp_replace(x, "[ 　]{2,}", " "))
    t = gated(t, lambda x: x.rlike("[，。、：；]{2}"), lambda x: F.regexp_replace(x, r"([，。、：；])\1+", "$1"))
    t = strip(F.ltrim(F.rtrim(t, F.lit("，、：；—" + WHITE_CHARS)), F.lit("，。、：；—" + WHITE_CHARS)))
    return let(t, lambda t: F.when(t.rlike(X.WIDE_HAN), t).otherwise(""))


def retry_characters(found: Column) -> Column:
    """The first twelve offending characters, hard ones first: what a retry's hint names."""
    return let(found, lambda f: F.substring(F.array_join(F.concat(f["hard"], f["soft"]), ""), 1, 12))
