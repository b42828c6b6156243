"""Secret scans through a trigram index.

For each rule a Boolean trigram query is derived from its regular expression: a
text that the rule matches holds all trigrams of at least one alternative. A
slice of texts is indexed once (trigram -> texts, only for trigrams that some
query asks for), the postings are intersected and united as the query says, and
the rule itself runs over the candidates only. A rule without a mandatory
trigram runs over every text.

The index folds A-Z to lower case, so one index serves rules of either kind;
that only ever adds candidates.

Results by case: null and empty texts have no spans; spans count code points,
the end is exclusive; one rule's spans never overlap, those of two rules may;
spans are ordered by start, then by the rules' order; repeated rows keep their
rows; further columns are passed on, one called like an output is replaced.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from touchline.llm._arrow import map_columns
from touchline.llm._words import _LOWER, text_slices

#: So many alternatives of a literal run are followed before they count as unknown.
MOST_STRINGS = 40

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters or more; group 0 is the whole match."""

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 0
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


#: The three base rules first; the order is the order of spans that start together.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]+", least=24, base=True),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{4,64}@"),
)

# A query is True (any text), or ("tri", code), ("and", [..]), ("or", [..]).
Query = bool | tuple


def trigrams(text: str) -> Query:
    raw = text.encode().lower()
    codes = sorted({raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)})
    return _all([("tri", c) for c in codes])


def _all(queries: list[Query]) -> Query:
    left = [q for q in dict.fromkeys(map(_frozen, queries)) if q is not True]
    return True if not left else left[0] if len(left) == 1 else ("and", tuple(left))


def _any(queries: list[Query]) -> Query:
    left = list(dict.fromkeys(map(_frozen, queries)))
    return True if not left or True in left else left[0] if len(left) == 1 else ("or", tuple(left))


def _frozen(q: Query) -> Query:
    return q


def _of_strings(strings: set[str]) -> Query:
    return _any([trigrams(s) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The finite set of strings that a part can match (None: not finite or too many), and its query."""
    exact: set[str] = {""}
    whole = True
    needs: list[Query] = []

    def flush() -> None:
        nonlocal exact
        needs.append(_of_strings(exact))
        exact = {""}

    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        flush()
        whole = False
        if strings is not None:
            exact = strings
        else:
            needs.append(query)
    if whole:
        return exact, _of_strings(exact)
    flush()
    return None, _all(needs)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}, True
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST_STRINGS:
                found |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (found, True) if len(found) <= 8 else (None, True)
    if name == "SUBPATTERN":
        return _walk(arg[-1])
    if name == "BRANCH":
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), True
        return None, _any([q for _, q in parts])
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        strings, query = _walk(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        if low == high and strings is not None and len(strings) == 1 and low <= 64:
            return {next(iter(strings)) * low}, True
        return None, query if low else True
    if name == "AT":
        return {""}, True
    return None, True


@lru_cache(maxsize=256)
def query_of(pattern: str) -> Query:
    """The trigram query that every text with a match satisfies."""
    return _walk(sre.parse(pattern))[1]


def _codes(q: Query) -> set[int]:
    if q is True:
        return set()
    return {q[1]} if q[0] == "tri" else set().union(*map(_codes, q[1]))


class Scanner:
    """Rules compiled for a worker, with the table of trigrams that they ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), query_of(r.pattern)) for r in rules]
        codes = set().union(*(_codes(q) for _, _, q in self.rules))
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[list(codes)] = True

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        if len(data) < 3:
            return {}
        low = _LOWER[data].astype(np.uint32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(self.wanted[codes])
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(codes[at][inside].astype(np.int64) << 32 | row[inside])
        codes, row = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        return dict(zip(codes[cuts].tolist(), np.split(row, cuts[1:])))

    def candidates(self, q: Query, index: dict[int, np.ndarray], rows: int) -> np.ndarray:
        if q is True:
            return np.arange(rows)
        if q[0] == "tri":
            return index.get(q[1], np.zeros(0, np.int64))
        parts = [self.candidates(x, index, rows) for x in q[1]]
        out = parts[0]
        for p in sorted(parts[1:], key=len):
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per row its spans: start, place of the rule, end."""
        rows = len(offsets) - 1
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
        index = self.postings(data, offsets)
        raw = data.tobytes()
        texts: dict[int, str] = {}
        for place, (rule, pattern, query) in enumerate(self.rules):
            for k in self.candidates(query, index, rows).tolist():
                text = texts.get(k)
                if text is None:
                    text = texts[k] = raw[offsets[k] : offsets[k + 1]].decode()
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[k].append((m.start(), place, m.end()))
        for spans in found:
            spans.sort()
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds ``spans``: kind, start and end of every secret."""

    def run(batch: pa.RecordBatch) -> Iterator:
        s = scanner(rules)
        for piece in text_slices(batch.column(batch.schema.get_field_index(text))):
            found = s.scan(piece.data, piece.offsets)
            rows = [[{"kind": rules[p].kind, "start": a, "end": b} for a, p, b in xs] for xs in found]
            yield piece.first, piece.first + piece.rows, [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return map_columns(docs, run, [T.StructField(spans, SPANS)])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", hide: str = "[{kind}]") -> DataFrame:
    """Replaces ``text`` by the same without its secrets; overlapping spans become one. Null stays null."""

    def run(batch: pa.RecordBatch) -> Iterator:
        s = scanner(rules)
        column = batch.column(batch.schema.get_field_index(text))
        for piece in text_slices(column):
            raw = piece.data.tobytes()
            out: list[str | None] = []
            for k, spans in enumerate(s.scan(piece.data, piece.offsets)):
                if not column[piece.first + k].is_valid:
                    out.append(None)
                    continue
                t = raw[piece.offsets[k] : piece.offsets[k + 1]].decode()
                parts, at, n = [], 0, 0
                while n < len(spans):
                    start, place, end = spans[n]
                    while n < len(spans) and spans[n][0] < end:
                        end = max(end, spans[n][2])
                        n += 1
                    parts += [t[at:start], hide.format(kind=rules[place].kind)]
                    at = end
                out.append("".join(parts) + t[at:] if parts else t)
            yield piece.first, piece.first + piece.rows, [pa.array(out, pa.string())]

    fields = [T.StructField(text, T.StringType())]
    return map_columns(docs, run, fields).select(*docs.columns) if len(set(docs.columns)) == len(docs.columns) else map_columns(docs, run, fields)


def digests(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, and all spans spelled out."""
    base = [r.kind for r in rules if r.base]
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(spelled(F.filter("spans", lambda x: x.kind.isin(base))), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
