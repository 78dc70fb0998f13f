"""Text rules as column expressions: filters, cleaning, punctuation and keys.  All run inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import fixed as X

Text = Column

#: X.WHITE as a property, which the JVM tests faster than that list, and its characters.
WHITE = r"[\p{IsWhite_Space}\x1c-\x1f]"
WHITE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def gated(c: Text, test: Callable[[Text], Column], use: Callable[[Text], Text]) -> Text:
    """use(c) where a cheap test of c holds, c elsewhere: spares most texts a slow pattern."""
    return let(c, lambda x: F.when(test(x), use(x)).otherwise(x))


def strip(c: Text) -> Text:
    return F.trim(c, F.lit(WHITE_CHARS))


def squeezed(c: Text) -> Text:
    """The words of c joined by single blanks."""
    odd = lambda x: x.contains("  ") | x.rlike("[^ -~]") & x.rlike(rf"[{WHITE[1:-1]}&&[^ ]]")  # noqa: E731  ASCII is passed over fast
    return gated(strip(c), odd, lambda x: F.regexp_replace(x, f"{WHITE}+", " "))


def words(c: Text) -> Column:
    """Words between white space, as str.split() gives them."""
    return F.array_remove(F.split(squeezed(c), " "), "")


def voiceless(least: int) -> str:
    """The pattern of a word of a squeezed text with `least` letters or more, none of them a vowel or CJK."""
    spoken = X.VOWEL[1:-1] + X.CJK[1:-1]
    return rf"(?=[^ {X.VOWEL[1:-1]}]{{{least},}}+ )(?:[^\p{{L}} ]*+[\p{{L}}&&[^{spoken}]]){{{least},}}+[^\p{{L}} ]*+(?= )"


def only(c: Text, chars: str) -> Text:
    """What remains of c of a character class, given without its brackets."""
    return F.regexp_replace(c, f"[^{chars}]+", "")


def count_of(c: Text, char: str) -> Column:
    """How often a character stands in c."""
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def letters(c: Text) -> Column:
    return F.length(only(c, r"\p{L}"))


def has_cjk(c: Text) -> Column:
    return c.rlike(X.CJK)


def has_vowel(c: Text) -> Column:
    return c.rlike(X.VOWEL)


def all_upper(c: Text) -> Column:
    """str.isupper(): some letter with case, none of them lower."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def any_part(c: Text, parts: Sequence[str]) -> Column:
    return reduce(Column.__or__, [c.contains(p) for p in parts])


def is_meaningful(text: Text) -> Column:
    """Whether a block found on a page is text rather than decoration."""
    return let(strip(text), _meaningful)


def _meaningful(t: Text) -> Column:
    n = F.length(t)
    real = has_cjk(t) | t.rlike(r"[\x{3000}-\x{303f}\x{ff01}-\x{ff5e}!?…―〜]")
    odd = (n <= 3) & ~real & ~t.rlike(r"^[\p{L}\p{N}]+\z")
    stray = (n < 3) & t.rlike(r"^\p{L}+\z") & ~has_cjk(t) & ~F.lower(t).isin(X.SHORT_WORDS)
    symbols = F.length(only(t, r"=+|\\/_*<>\[\]{}"))
    plain = F.length(only(t, rf"\p{{L}}\p{{N}}{WHITE[1:-1]},.!?'\-"))
    return (n > 0) & ~odd & ~stray & (symbols <= n * 0.25) & (real | (plain / n >= 0.60))


def is_gibberish(text: Text) -> Column:
    """Whether text is a misreading: no vowels, structural symbols, or most words like that."""
    return let(strip(text), _gibberish)


def _gibberish(t: Text) -> Column:
    """Cheap tests go first: few words have no vowel, few texts hold a symbol."""
    symbols = lambda w: F.length(only(w, r"{}\[\]|\\<>/#*"))
    mute = lambda w: ~has_vowel(w) & ~has_cjk(w) & (letters(w) >= 4)
    bad = lambda every: F.size(F.when(t.rlike("[/#*]"), F.filter(every, lambda w: mute(w) | (symbols(w) > F.length(w) * 0.5))).otherwise(F.filter(every, mute)))
    most = lambda every: let(bad(every), lambda n: F.when(F.size(every) == 1, n > 0).otherwise(n / F.size(every) > 0.5))
    return (
        F.when(t == "", True).when(F.length(t) <= 3, False)
        .when(~has_vowel(t) & t.rlike(r"\p{L}") & ~has_cjk(t), True).when(t.rlike(r"[{}\[\]|\\<>]"), True)
        .otherwise(let(words(t), most))
    )


def noise_reason(text: Text) -> Text:
    """Why a block is noise, null if it isn't: the first rule that holds."""
    return let(strip(text), lambda t: let(F.lower(t), lambda low: _noise(t, low, F.length(t))))


def _noise(t: Text, low: Text, n: Column) -> Text:
    letter = letters(t)
    first_words = F.split(low, f"{WHITE}+", 4)  # four where there are more than three
    effect = lambda ws: (F.size(ws) <= 3) & F.exists(ws, lambda w: F.regexp_replace(w, r"\P{L}+", "").isin(X.EFFECTS))
    return (
        F.when(t == "", "blank").when((n < 2) & ~has_cjk(t), "single").when(_gibberish(t), "gibberish")
        .when(any_part(low, X.LINK_PARTS), "link").when((n > 15) & (count_of(t, "/") > 2), "path")
        .when(~has_vowel(t) & t.rlike(r"\p{L}") & ~has_cjk(t) & ~low.isin(X.VOWELLESS_WORDS), "vowelless")
        .when(let(first_words, effect), "effect")
        .when(~has_cjk(t) & let(letter, lambda k: (k == 0) | (k / n < 0.35)), "symbols")
    )


def local_noise_reason(text: Text) -> Text:
    """The offline translator's rules, which match sound effects as substrings."""
    return let(strip(text), lambda t: let(letters(t), lambda letter: _local_noise(t, F.length(t), letter)))


def _local_noise(t: Text, n: Column, letter: Column) -> Text:
    return (
        F.when(n < 2, "short").when(all_upper(t) & (n <= 6) & ~t.rlike(WHITE), "capitals")
        .when(any_part(F.lower(t), X.LOCAL_EFFECTS), "effect")
        .when(reduce(Column.__or__, [t.rlike(p) for p in X.LOCAL_PATTERNS]), "pattern")
        .when((letter > 0) & (letter / n < 0.4), "symbols")
    )


def source_language(text: Text, declared: Text | None = None) -> Text:
    """ko where Korean is declared, else en if over 0.6 of the letters are ASCII, else auto."""
    n = letters(text)
    korean = F.coalesce(declared == "Korean", F.lit(False)) if declared is not None else F.lit(False)
    return F.when(korean, "ko").when((n > 0) & (F.length(only(text, "A-Za-z")) / n > 0.6), "en").otherwise("auto")


def worth_polishing(raw: Text, draft: Text) -> Column:
    all_words = words(raw)
    capitals = F.size(F.filter(all_words, lambda w: all_upper(w) & (F.length(w) > 2)))
    digits = F.regexp_replace(raw, " ", "").rlike(r"^\p{Nd}+\z")
    short = (F.length(only(draft, X.HAN[1:-1])) >= 3) & (F.size(all_words) <= 6)
    return ~(digits | (F.coalesce(capitals / F.nullif(F.size(all_words), F.lit(0)), F.lit(0)) > 0.5) | short)


def holds_cjk(key: str) -> bool:
    return bool(re.search(r"[一-鿿぀-ヿ가-힣]", key))


def bounded(key: str) -> str:
    """The pattern of a key that doesn't stand inside a longer ASCII word; it begins with the key, which is found fast."""
    k = re.escape(key)
    return rf"{k}(?<![A-Za-z0-9]{k})(?![A-Za-z0-9])"


def fold_terms(c: Text, terms: Sequence[tuple[str, str]]) -> Text:
    """Replace terms one after another: a later one sees what an earlier one wrote.

    Keys with CJK match anywhere, others not inside a longer ASCII word.
    """
    quote = lambda v: v.replace("\\", "\\\\").replace("$", "\\$")

    def fold(t: Text, term: tuple[str, str]) -> Text:
        key, value = term
        if holds_cjk(key):
            return F.replace(t, F.lit(key), F.lit(value))
        return let(t, lambda x: F.when(x.contains(key), F.regexp_replace(x, bounded(key), quote(value))).otherwise(x))

    return reduce(fold, terms, c)


def clean_input(text: Text, terms: Sequence[tuple[str, str]] = ()) -> Text:
    """Recognised text ready for translation: one line, misread @, terms, without vowel-less and dropped words."""
    folded = fold_terms(F.replace(squeezed(text), F.lit("@"), F.lit("a")), terms)
    if any(v != " ".join(v.split()) or not v for _, v in terms):
        folded = squeezed(folded)

    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    return F.trim(F.regexp_replace(padded, f" (?:{voiceless(3)}|{_OTHER}{_spelled(X.DROPPED_WORDS)})", ""))


_OTHER = r"[^\p{L} ]*+"


def _spelled(words: Sequence[str]) -> str:
    """The pattern of what begins with the letters of an upper-case word, in either case, whatever else than letters stands between them."""
    either = lambda c: f"[{c}{c.lower()}{'\u0131' if c == 'I' else ''}]"  # noqa: E731  dotless i has that upper case too
    firsts = sorted({w[0] for w in words if w})
    after = [f"{either(c)}{_OTHER}{_spelled([w[1:] for w in words if w[:1] == c])}" for c in firsts]
    return f"(?:{'|'.join([*after, *(['(?= )'] if '' in words else [])])})"


def ellipses(c: Text) -> Text:
    return gated(c, lambda x: any_part(x, ["..", "。。", "…", "・・・", "‥"]), lambda x: F.regexp_replace(x, X.ELLIPSIS, "……"))


def replaced(c: Text, pairs: Sequence[tuple[str, str]]) -> Text:
    """c with literal parts replaced, one after another."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), pairs, c)


def lettering_marks(text: Text) -> Text:
    """Punctuation as it is lettered: ellipses, full-width marks, no comma at the end, single blanks in Han text."""
    t = replaced(ellipses(text), [("!?", "！？"), ("?!", "！？"), ("？！", "！？"), ("!", "！"), ("?", "？"), ("~", "～"), ("〜", "～")])
    t = gated(t, lambda x: x.contains("…………"), lambda x: F.regexp_replace(x, "(?:……){2,}", "……"))
    t = F.rtrim(t, F.lit("，、,"))
    t = gated(t, lambda x: x.rlike(X.HAN + WHITE), lambda x: F.regexp_replace(x, rf"(?<={X.HAN}){WHITE}+(?={X.HAN})", " "))
    return strip(t)


def clean_output(text: Text, terms: Sequence[tuple[str, str]] = ()) -> Text:
    """A translator's reply without notes, bracketed English, stray marks and known mistakes."""
    t = strip(gated(ellipses(text), lambda x: x.contains("注"), lambda x: F.regexp_replace(x, X.NOTE, "")))
    bracketed = rf"{WHITE}*\([A-Za-z][A-Za-z\-{WHITE[1:-1]}]*\)"
    t = strip(gated(t, lambda x: x.contains("("), lambda x: F.regexp_replace(x, bracketed, "")))
    t = replaced(t, [("；", "，"), (";", "，"), ("@", "")])
    t = strip(F.rtrim(t, F.lit("。.，,_—-:：" + WHITE_CHARS)))
    t = replaced(F.ltrim(t, F.lit("_—-:：，," + WHITE_CHARS)), X.CORRECTIONS)
    return lettering_marks(strip(fold_terms(t, terms)))


def is_refusal(reply: Text) -> Column:
    return any_part(reply, X.REFUSALS)


def is_chinese_target(language: Text) -> Column:
    low = F.lower(F.coalesce(language, F.lit("")))
    return low.contains("chinese") | low.startswith("zh") | low.contains("中文")


def accepted(reply: Text) -> Column:
    """A translation counts if it holds Han script."""
    return F.coalesce(reply.rlike(X.HAN), F.lit(False))


def dedup_key(text: Text) -> Text:
    return only(text, r"\p{L}\p{N}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}")


def cache_key(text: Text) -> Text:
    return F.substring(F.sha2(text, 256), 1, X.CACHE_KEY)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, for which there is no expression; null stays null."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def series_key(title: Text) -> Text:
    """A series' name from a title without its extension: normalised, without volume marks, tags or trailing number."""
    title = nfkc(title)
    for mark in X.VOLUME_MARKS:
        title = F.regexp_replace(title, mark, " ")
    title = F.concat(F.lit(" "), F.regexp_replace(title, r"[_\-~～・.]+", " "))
    return F.array_join(words(F.regexp_replace(title, rf"{WHITE}+[0-9]+{WHITE}*\z", "")), " ")


def without_extension(name: Text) -> Text:
    base = F.regexp_replace(name, r"^.*/", "")
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*\z", "")


def safe_file_name(key: Text) -> Text:
    safe = F.regexp_replace(F.lower(key), r'[<>:"/\\|?*\x00-\x1f]', "_")
    safe = F.substring(F.regexp_replace(safe, r"^[ .]+|[ .]+\z", ""), 1, 80)
    return F.when(safe == "", "_default").otherwise(safe)


def joined_lines(lines: Column, japanese: Column) -> Text:
    return F.when(japanese, F.array_join(lines, "")).otherwise(F.array_join(lines, " "))


def wrapped(text: Text, width: int) -> Column:
    """Lines of width characters, each as wide as the next; closing marks hang on the line before them.

    A typed line break starts a line; blank lines go unless there is nothing else.
    """
    typed = F.filter(F.split(text, r"\r\n|\r|\n"), lambda p: strip(p) != "")
    line = F.lit(rf"(?s)(.{{{width}}}[{X.CLOSING}]*|.+)")
    lines = F.flatten(F.transform(typed, lambda p: F.regexp_extract_all(p, line, F.lit(1))))
    return let(lines, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.regexp_replace(text, r"^[\r\n]+|[\r\n]+\z", ""))))


def one_of(value: Text, allowed: Sequence[str], default: str) -> Text:
    return F.when(value.isin(list(allowed)), value).otherwise(default)
