"""Secrets in texts by way of a trigram inverted index.

Documents are cut into segments. A segment's row holds its texts and, in a column of its own, the postings of its
trigrams: for each three bytes that occur (letters A-Z folded to lower case), the ordinals of the documents that
hold them. Segments are stored; questions of other rules read the same index, and which documents
can match is told from the postings alone, without the texts.

From each rule's regular expression follows a Boolean trigram query: what strings a match must contain, as
alternatives of trigrams that occur together. Postings of an alternative are intersected, alternatives united,
and only the documents left are verified with the expression itself. A rule without mandatory trigrams (a long
run of hex digits, say) reads every text. Texts and postings of a segment lie in one row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import pack, unpack
from .scratch import bounded, staged
from .textbytes import LOWER, Texts, merged
from .workers import lean

SEGMENT = 2 << 20  # bytes of text a segment holds, unless one document is longer
INDEX = "n_docs int, ids array<long>, postings binary, texts binary"
SPANS = "array<struct<kind: string, start: long, end: long>>"
STRINGS, ALTERNATIVES, CLASS = 48, 64, 8  # sizes beyond which a query becomes weaker, never wrong

# -- what a match must contain ----------------------------------------------------------------------

Query = frozenset[frozenset[bytes]]  # alternatives of trigrams that occur together
ANY: Query = frozenset([frozenset()])


def either(a: Query, b: Query) -> Query:
    """A document fits one of the two; alternatives that ask for more than another one go."""
    every = a | b
    return frozenset(x for x in every if not any(y < x for y in every))


def both(a: Query, b: Query) -> Query:
    """A document fits the two; past the bound on alternatives only the more selective one is asked."""
    if len(a) * len(b) > ALTERNATIVES:
        return max((a, b), key=lambda q: min(map(len, q)))
    return either(frozenset(x | y for x in a for y in b), frozenset())


def holding(strings: Iterable[bytes]) -> Query:
    """A document holds at least one of the strings."""
    return either(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings), frozenset())


@dataclass(frozen=True)
class Part:
    """What is known of the strings a part of an expression matches.

    ``whole`` lists all of them (None: too many); each begins with one of ``heads``, ends with one of ``tails``, and
    a document with a match fits ``need``.
    """

    whole: frozenset[bytes] | None
    heads: frozenset[bytes]
    tails: frozenset[bytes]
    need: Query

    @classmethod
    def of(cls, strings: Iterable[bytes]) -> "Part":
        own = frozenset(strings)
        return cls(own, own, own, ANY)

    @cached_property
    def query(self) -> Query:
        ends = both(holding(self.heads), holding(self.tails))
        return both(self.need, holding(self.whole) if self.whole is not None else ends)

    def opened(self) -> "Part":
        """The same without the list: heads and tails keep two bytes, their trigrams go into the query."""
        return Part(None, frozenset(h[:2] for h in self.heads), frozenset(t[-2:] for t in self.tails), self.query)

    def then(self, other: "Part") -> "Part":
        if self.whole is not None and other.whole is not None and len(self.whole) * len(other.whole) <= STRINGS:
            return Part.of(a + b for a in self.whole for b in other.whole)
        heads = frozenset(a + b for a in self.whole for b in other.heads) if self.whole is not None else self.heads
        tails = frozenset(a + b for a in self.tails for b in other.whole) if other.whole is not None else other.tails
        seam = holding(a + b for a in self.tails for b in other.heads)
        return Part(None, heads, tails, both(both(self.query, other.query), seam)).opened()

    def or_else(self, other: "Part") -> "Part":
        if self.whole is not None and other.whole is not None and len(self.whole | other.whole) <= STRINGS:
            return Part.of(self.whole | other.whole)
        a, b = self.opened(), other.opened()
        return Part(None, a.heads | b.heads, a.tails | b.tails, either(a.need, b.need))


NOTHING, UNKNOWN = Part.of([b""]), Part(None, frozenset([b""]), frozenset([b""]), ANY)


def _characters(codes: Iterable[int], flags: int) -> Part:
    """One character of a set; beside ASCII, other letters may be a letter's other case."""
    out = set()
    for code in codes:
        if flags & re.IGNORECASE and (code > 127 or (not flags & re.ASCII and chr(code).lower() in "iks")):
            return UNKNOWN
        out.add(chr(code).lower().encode() if code < 128 else chr(code).encode("utf-8", "surrogatepass"))
    return Part.of(out)


def _class(items: list, flags: int) -> Part:
    codes: list[int] = []
    for op, value in items:
        if op is parser.LITERAL:
            codes.append(value)
        elif op is parser.RANGE and value[1] - value[0] < 2 * CLASS:
            codes += range(value[0], value[1] + 1)
        else:
            return UNKNOWN
        if len(codes) > 2 * CLASS:
            return UNKNOWN
    own = _characters(codes, flags)
    return own if own.whole is None or len(own.whole) <= CLASS else UNKNOWN


def _part(items: Iterable, flags: int) -> Part:
    out = NOTHING
    for op, value in items:
        if op is parser.LITERAL:
            own = _characters([value], flags)
        elif op is parser.IN:
            own = _class(value, flags)
        elif op is parser.SUBPATTERN:
            own = _part(value[3], (flags | value[1]) & ~value[2])
        elif op is parser.ATOMIC_GROUP:
            own = _part(value, flags)
        elif op is parser.BRANCH:
            own, *rest = (_part(branch, flags) for branch in value[1])
            for other in rest:
                own = own.or_else(other)
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _part(inner, flags)
            own = NOTHING
            for _ in range(min(least, 4)):
                own = own.then(one)
            if (least, most) == (0, 1):
                own = one.or_else(NOTHING)
            elif least == 0:
                own = UNKNOWN
            elif most != least or least > 4:
                own = own.opened()
        elif op in (parser.AT, parser.ASSERT, parser.ASSERT_NOT):
            own = NOTHING  # takes no room; what it looks at is left to verification
        else:
            own = UNKNOWN
        out = out.then(own)
    return out


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams (lower case) of which every document with a match holds one in full."""
    tree = parser.parse(pattern)
    return _part(tree, tree.state.flags).query


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap, whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    @property
    def scans(self) -> bool:
        """No trigram is mandatory, so every text is read."""
        return frozenset() in self.query

    @property
    def tightened(self) -> str:
        """For a run of one class, the least length goes into the expression: the same matches, found faster."""
        tree = list(parser.parse(self.pattern))
        run = len(tree) == 1 and tree[0][0] is parser.MAX_REPEAT and tree[0][1][:2] == (1, parser.MAXREPEAT)
        return f"{self.pattern[:-1]}{{{self.least},}}" if run and self.group == 0 and self.least > 1 and self.pattern.endswith("]+") else self.pattern

    @cached_property
    def _compiled(self) -> re.Pattern:
        return re.compile(self.tightened)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self._compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


def any_case(word: str) -> str:
    """An expression for a word with its ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The base kinds, in the order in which equal starts are listed; formats of well-known issuers follow.
BASE = (
    Rule("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + ADDED

# -- the index --------------------------------------------------------------------------------------


def _postings(texts: Texts) -> bytes:
    """Trigrams in order, how many documents each has, and those as ordinals, differences within a posting list."""
    data, offsets, count = LOWER[texts.data].astype(np.int64), texts.offsets, max(len(texts), 1)
    own = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = own[2:] == own[:-2]
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:])[inside] * count + own[2:][inside]
    code.sort()
    code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
    gram, doc = code // count, code % count
    first = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    step = np.diff(doc, prepend=0)
    step[at] = doc[at]
    kind = np.uint8 if count <= 256 else np.uint32
    return pack(np.array([len(texts)], np.int64), gram[at].astype(np.uint32), np.diff(np.append(at, len(gram))).astype(np.uint32), step.astype(kind))


class Postings:
    """Posting lists of one segment."""

    def __init__(self, cell: bytes):
        (self.count,), self.grams, sizes, self.steps = unpack(cell)
        self.bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def of(self, gram: bytes) -> np.ndarray:
        """Ordinals of the documents that hold a trigram."""
        code = int.from_bytes(gram, "big")
        at = int(np.searchsorted(self.grams, code))
        if at == len(self.grams) or self.grams[at] != code:
            return np.zeros(0, np.int64)
        return np.cumsum(self.steps[self.bounds[at] : self.bounds[at + 1]], dtype=np.int64)

    def fitting(self, query: Query) -> np.ndarray:
        """Documents that fit a query: intersections of posting lists, shortest first, and their union."""
        found = [np.zeros(0, np.int64)]
        for grams in query:
            if not grams:
                return np.arange(self.count)
            first, *rest = sorted(map(self.of, grams), key=len)
            for other in rest:
                if not len(first):
                    break
                first = np.intersect1d(first, other, assume_unique=True)
            found.append(first)
        return np.unique(np.concatenate(found))


def _segments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in merged(batches, most=most):
            ids = texts.rows.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(texts)], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([_postings(texts)], pa.binary()),
                    pa.array([pack(texts.data, texts.offsets)], pa.binary()),
                ],
                ["n_docs", "ids", "postings", "texts"],
            )

    return run


def trigram_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The stored index of whole texts: a row a segment, with ``n_docs, ids, postings, texts``.

    A null text counts as empty; null and repeated ids are kept, because a document's place in its segment tells rows apart. A
    text longer than a segment is one of its own. Other columns are ignored; an empty table gives no segments.
    """
    bounded(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(source.mapInArrow(lean(_segments(segment)), INDEX), "trigrams")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, kind`` for every document that may match a rule; reads ids and postings only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for ids, cell in zip(rows.column(0), rows.column(1), strict=True):
                own = Postings(cell.as_py())
                for rule in rules:
                    found = ids.values.take(pa.array(own.fitting(rule.query)))
                    yield pa.RecordBatch.from_arrays([found, pa.array([rule.kind] * len(found), pa.string())], ["doc_id", "kind"])

    return index.select("ids", "postings").mapInArrow(lean(run), "doc_id long, kind string")


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for ids, postings, cell in zip(rows.column(0), rows.column(1), rows.column(2), strict=True):
                own = Postings(postings.as_py())
                data, offsets = unpack(cell.as_py())
                asked = np.zeros((own.count, len(rules)), bool)
                for k, rule in enumerate(rules):
                    asked[own.fitting(rule.query), k] = True
                found: list[tuple[int, int, int]] = []
                sizes = np.zeros(own.count, np.int64)
                for i in np.flatnonzero(asked.any(axis=1)).tolist():
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
                    hits = sorted((start, k, end) for k in np.flatnonzero(asked[i]).tolist() for start, end in rules[k].spans(text))
                    sizes[i] = len(hits)
                    found += hits
                start, k, end = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                kinds = pa.array([r.kind for r in rules], pa.string()).take(pa.array(k))
                spans = pa.StructArray.from_arrays([kinds, pa.array(start), pa.array(end)], ["kind", "start", "end"])
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.values, pa.ListArray.from_arrays(bounds, spans)], ["doc_id", "spans"])

    return run


def scan_secrets(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` of every indexed document.

    ``spans`` are all matches of all rules as (kind, start, end) in code points, end exclusive, by start and then in the
    order of the rules; documents without matches have an empty list.
    """
    return index.select("ids", "postings", "texts").mapInArrow(lean(_scan(rules)), f"doc_id long, spans {SPANS}")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index ``docs`` and scan it: ``doc_id, spans``, one row for every row of ``docs``.

    Null and empty texts have no spans. Rows with a null id and rows that repeat one are answered each for itself. See
    :func:`trigram_index` and :func:`scan_secrets`.
    """
    return scan_secrets(trigram_index(docs, id_col, text_col), rules)


def secret_digests(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts and digests of :func:`find_secrets`: spans as ``kind:start:end``, comma-joined; the hash is over base kinds."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in base]
    return found.select("doc_id", *counts, F.sha2(listed(of(*(r.kind for r in base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _oracle(rules: tuple[Rule, ...], base: tuple[Rule, ...]) -> str:
    """SQL over whole texts: what lies between matches and the matches themselves give the places."""
    found = []
    for order, rule in enumerate(rules):
        p = rule.tightened.replace("'", "''")
        found.append(
            f"select row_id, '{rule.kind}' as kind, {order} as place, k, list_sum([length(x) for x in s[1:k]]) + coalesce(list_sum([length(x) for x in m[1:k-1]]), 0) as a, length(m[k]) as n from "
            f"(select row_id, regexp_split_to_array(text, '{p}') as s, regexp_extract_all(text, '{p}', 0) as m, regexp_extract_all(text, '{p}', {rule.group}) as g, unnest(range(1, len(m) + 1)) as k from texts) "
            f"where length(g[k]) >= {rule.least}"
        )
    kinds = ", ".join(f"'{r.kind}'" for r in base)
    one = "kind || ':' || a::bigint || ':' || (a + n)::bigint"
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in base)
    return f"""
    with texts as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
    found as ({" union all ".join(found)})
    select doc_id, {counts},
      sha256(coalesce(string_agg({one}, ',' order by a, place) filter (where kind in ({kinds})), '')) as base_sha256,
      coalesce(string_agg({one}, ',' order by a, place), '') as spans
    from texts left join found using (row_id) group by row_id, doc_id"""


ORACLE_SECRETS = _oracle(RULES, BASE)
