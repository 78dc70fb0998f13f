"""Secret scans through a trigram inverted index.

From each rule's expression a Boolean trigram query is derived: trigrams that every match must hold, joined by
AND along the expression and by OR over its branches.  Each batch of texts is an index segment of its own: the
postings of the trigrams that any rule asks for are built from the folded bytes, the queries intersect and unite
them, and a rule's expression then runs over the whole text of its candidates.  A rule whose query demands
nothing scans every text.  Segments need no shuffle, and no posting list outgrows a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import computed, fresh
from .tokens import LOWER

#: Strings a run of an expression may stand for before it is turned into trigrams.
MOST_STRINGS, MOST_CHOICES = 64, 8
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    """kind, its expression, the group that must be least long, and whether it is a base kind."""

    kind: str
    expression: str
    group: int = 0
    least: int = 0
    base: bool = False


def either_case(word: str) -> str:
    """An expression for an ASCII word in either case; (?i) would add letters beyond ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


BASE = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", "[0-9a-f]+", 0, 32, True),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,10}://[^\s/:@]{1,64}:[^\s/@]{3,64}@"),
)
RULES = BASE + MORE

# A query is True (demands nothing), a trigram, or ("and" | "or", queries).


def both(queries: list) -> object:
    queries = [q for q in dict.fromkeys(queries) if q is not True]
    return True if not queries else queries[0] if len(queries) == 1 else ("and", *queries)


def either(queries: list) -> object:
    queries = list(dict.fromkeys(queries))
    return True if True in queries else queries[0] if len(queries) == 1 else ("or", *queries)


def of_strings(strings: set[str]) -> object:
    """What a text that holds one of the strings must hold."""
    grams = lambda s: [b[k : k + 3] for b in (s.encode(),) for k in range(len(b) - 2)]
    return either([both(grams(s)) for s in sorted(strings)])


# An expression is a list of branches, a branch a list of (kind, value): one of few characters ("chars", set), any of many
# ("any", None), a place ("place", None), a group ("group", branches) or a repetition ("repeat", (least, most or None, item)).


class Parser:
    """The part of regular expressions that rules use; anything else is refused."""

    def __init__(self, expression: str) -> None:
        self.text, self.at = expression, 0

    def parse(self) -> list:
        out = self.branches()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return out

    def take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def next(self) -> str:
        if self.at == len(self.text):
            raise ValueError(f"{self.text!r} ends too soon")
        self.at += 1
        return self.text[self.at - 1]

    def branches(self) -> list:
        out = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.take("|"):
                out.append([])
            else:
                out[-1].append(self.repeated(self.item()))
        return out

    def item(self) -> tuple:
        c = self.next()
        if c == "(":
            if self.text.startswith("?", self.at) and not self.take("?:"):
                raise ValueError(f"a group of another kind at {self.at} in {self.text!r}")
            inner = self.branches()
            if not self.take(")"):
                raise ValueError(f"an open group in {self.text!r}")
            return "group", inner
        if c == "[":
            return self.char_class()
        if c in "*+?{":
            raise ValueError(f"nothing to repeat at {self.at} in {self.text!r}")
        if c == "\\":
            char = self.escape()
            return ("any", None) if char is None else ("place", None) if char == "" else ("chars", {char})
        return ("any", None) if c == "." else ("place", None) if c in "^$" else ("chars", {c})

    def escape(self) -> str | None:
        """The character that an escape stands for, None for a class of many, nothing for a place."""
        c = self.next()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        if c in "sSdDwW":
            return None
        if c in "bBAZ":
            return ""
        if c.isalnum():
            if c not in "tnrfv":
                raise ValueError(f"an escape of another kind at {self.at} in {self.text!r}")
            return {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v"}[c]
        return c

    def char_class(self) -> tuple:
        other, chars, few, first = self.take("^"), [], True, True
        while first or not self.take("]"):
            c = self.next()
            first = False
            if c == "\\":
                c = self.escape()
            if not c:
                few = False
            elif self.text.startswith("-", self.at) and not self.text.startswith("-]", self.at):
                self.at += 1
                end = self.next()
                chars += map(chr, range(ord(c), ord(self.escape() if end == "\\" else end) + 1))
            else:
                chars.append(c)
        return ("chars", set(chars)) if few and not other else ("any", None)

    def repeated(self, item: tuple) -> tuple:
        if self.take("*"):
            item = "repeat", (0, None, item)
        elif self.take("+"):
            item = "repeat", (1, None, item)
        elif self.take("?"):
            return "repeat", (0, 1, item)
        elif bounds := re.compile(r"\{(\d+)(,(\d*))?\}").match(self.text, self.at):
            self.at = bounds.end()
            low = int(bounds[1])
            item = "repeat", (low, low if bounds[2] is None else int(bounds[3]) if bounds[3] else None, item)
        else:
            return item
        if self.take("?") or self.take("+"):
            raise ValueError(f"a repetition of another kind at {self.at} in {self.text!r}")
        return item


def trigram_query(expression: str) -> object:
    """The trigrams, of folded bytes, without which the expression can't match."""
    return _any_of(Parser(expression).parse())


def _any_of(branches: list) -> object:
    return either([_query(b) for b in branches])


def _query(items: list) -> object:
    exact, query = _sequence(items)
    return both([query, of_strings(exact)])


def _whole(item: tuple) -> set[str] | None:
    """The strings, folded, that an item stands for, if they are few and known."""
    kind, value = item
    if kind == "chars":
        chars = {c.translate(_FOLD) for c in value}
        return chars if len(chars) <= MOST_CHOICES else None
    if kind == "group":
        every = [_joined(b) for b in value]
        strings = None if None in every else set().union(*every)
        return strings if strings is not None and len(strings) <= MOST_STRINGS else None
    if kind == "repeat" and value[:2] in ((0, 1), (1, 1)):
        inner = _whole(value[2])
        return None if inner is None else inner | {""} if value[0] == 0 else inner
    return None


def _joined(items: list) -> set[str] | None:
    exact = {""}
    for item in items:
        part = _whole(item)
        if part is None or len(exact) * len(part) > MOST_STRINGS:
            return None
        exact = {a + b for a in exact for b in part}
    return exact


def _sequence(items: list) -> tuple[set[str], object]:
    """(strings that the sequence's end stands for, what the parts before demand)."""
    exact, demands = {""}, []

    def stop(then: object = True) -> None:
        nonlocal exact
        demands.extend((of_strings(exact), then))
        exact = {""}

    def extend(strings: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(strings) > MOST_STRINGS:
            stop()
        exact = {a + b for a in exact for b in strings}

    for item in items:
        kind, value = item
        if (strings := _whole(item)) is not None:
            extend(strings)
        elif kind == "group":
            stop(_any_of(value))
        elif kind == "repeat" and value[0] > 0:  # once at least, whatever follows
            if (strings := _whole(value[2])) is not None:
                extend(strings)
                stop()
            else:
                stop(_any_of(value[2][1]) if value[2][0] == "group" else True)
        elif kind != "place":  # unknown text
            stop()
    return exact, both(demands)


def trigrams_of(query: object) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set() if query is True else set().union(*(trigrams_of(q) for q in query[1:]))


class Index:
    """The rules' queries, and the postings of one segment of texts at a time."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.queries = {r.kind: trigram_query(r.expression) for r in rules}
        self.grams = sorted(set().union(*map(trigrams_of, self.queries.values())))
        self.number = np.full(1 << 24, -1, np.int16)
        self.number[[int.from_bytes(g, "big") for g in self.grams]] = np.arange(len(self.grams))

    def postings(self, texts: list[str]) -> dict[bytes, np.ndarray]:
        """For each trigram asked for, whether each text holds it."""
        held = np.zeros((len(self.grams), len(texts)), bool)
        blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
        k = 0
        while k < len(blobs):
            n, size = k, 0
            while n < len(blobs) and (n == k or size + len(blobs[n]) <= 1 << 20):
                size += len(blobs[n])
                n += 1
            data = LOWER[np.frombuffer(b"\0\0".join(blobs[k:n]) + b"\0\0", np.uint8)].astype(np.uint32)
            which = self.number[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
            at = np.flatnonzero(which >= 0)
            starts = np.cumsum([0, *(len(b) + 2 for b in blobs[k : n - 1])])
            held[which[at], k + np.searchsorted(starts, at, "right") - 1] = True
            k = n
        return dict(zip(self.grams, held, strict=True))

    def candidates(self, query: object, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.ones(n, bool)
        if isinstance(query, bytes):
            return postings[query]
        join = np.logical_and if query[0] == "and" else np.logical_or
        return join.reduce([self.candidates(q, postings, n) for q in query[1:]])


def matches(rule: Rule) -> Callable[[str], list[tuple[int, int]]]:
    """The spans of a rule's leftmost matches that don't overlap, without those whose group is too short."""
    found = re.compile(rule.expression)
    if re.fullmatch(r"\[[^]]+\]\+", rule.expression) and rule.least:
        # runs of one class: the long ones can be asked for at once
        found = re.compile(f"{rule.expression[:-1]}{{{rule.least},}}")
    return lambda text: [m.span() for m in found.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanner(rules: tuple[Rule, ...]) -> Callable[[list], list[list[tuple[int, int, str, int]]]]:
    """Finds (start, place of the rule, kind, stop) in each text of a batch, sorted."""
    index, tests = Index(rules), [(r.kind, matches(r)) for r in rules]

    def scan(texts: list[str | None]) -> list[list[tuple[int, int, str, int]]]:
        texts = [t or "" for t in texts]
        spans: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        postings = index.postings(texts)
        for order, (kind, test) in enumerate(tests):
            for k in np.flatnonzero(index.candidates(index.queries[kind], postings, len(texts))):
                spans[k] += [(a, order, kind, b) for a, b in test(texts[k])]
        return [sorted(s) for s in spans]

    return scan


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text) -> doc_id, spans by start and then in the order of rules; code points, stop exclusive.

    One row per row of docs, repeated ones too; null and empty texts have no spans, an empty table gives no rows.  Of
    spans that start together the rule named first comes first.  Columns other than doc_id and text are ignored.
    """

    def setup() -> Callable[[list], tuple]:
        scan = scanner(rules)
        return lambda texts: ([[{"kind": kind, "start": a, "stop": b} for a, _, kind, b in s] for s in scan(texts)],)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return computed(slim, "text", ["doc_id"], "spans array<struct<kind:string,start:int,stop:int>>", setup)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as text), spans (all of them as text)."""
    base = [r.kind for r in rules if r.base]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(F.encode(joined(F.filter("spans", lambda s: s["kind"].isin(base))), "UTF-8"), 256)
    return find(docs, rules).select("doc_id", *map(count, base), digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows and columns of docs, each span of a secret in text replaced by [kind]; overlapping spans by the first's.

    n_chars, where there is one, follows the text; null texts stay null.
    """

    def redact(text: str | None, spans: list[tuple[int, int, str, int]]) -> str | None:
        out, at = [], 0
        for a, _, kind, b in spans:
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if spans else None

    def setup() -> Callable[[list], tuple]:
        scan = scanner(rules)
        return lambda texts: ([redact(t, s) for t, s in zip(texts, scan(texts), strict=True)],)

    clean = fresh("text_without_secrets", docs.columns)
    rows = computed(docs, "text", docs.columns, f"`{clean}` string", setup)
    new = F.col(clean)
    changed = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length(new).cast(docs.schema["n_chars"].dataType), "n_chars")
    return rows.withColumns(changed).select(*docs.columns)
