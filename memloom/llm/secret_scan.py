"""Secret scans through a trigram inverted index.

1. From each rule's pattern a Boolean query over trigrams is derived that every text with a match fulfils (over texts in ASCII lower case).
2. One pass over the texts notes which of the asked trigrams a text has, and runs the rules whose pattern has no
   mandatory trigram over it whole. Only numbers and these spans are kept.
3. The index: for each trigram and block of 4,096 rows a posting list. Blocks bound the lists of trigrams that very many texts hold.
4. Rules' queries intersect and unite the posting lists block by block; what is left are candidates.
5. The texts of candidates, and no others, are verified with the pattern itself.

Candidates are named by two 64-bit hashes of their text, so copies of a text are one candidate, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.arrow_text import tidy
from memloom.sources.scratch import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, whether letters of either case match, and the least length of a group of it (0: the whole)."""

    kind: str
    pattern: str
    either_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


# The base rules. A run of 24 or more hexadecimal digits is written as such: shorter runs are no match to be dropped then.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
# Publicly documented forms of tokens.
ADDED = [
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
]
RULES = (*BASE, *ADDED)

#: A query is a list of clauses that must all hold; a clause is a list of sets of trigrams, of which one must be there whole.
Query = list[list[frozenset[str]]]

#: Trigrams of a set at most: any part of a necessary condition is one. Those with fewer letters and blanks are rarer and stay.
MOST_TRIGRAMS = 6
#: Literal strings that a part of a pattern is written out as at most.
MOST_STRINGS = 64
_ROW_BITS, BLOCK_BITS = 33, 12


def _exact(item, most: int = MOST_STRINGS) -> list[str] | None:
    """All strings that an item of a parsed pattern stands for, in lower case; None if there are too many."""
    kind, value = item
    if kind is sre.LITERAL:
        return [chr(value).lower() if value < 128 else chr(value)]
    if kind is sre.IN:
        out = set()
        for what, x in value:
            if what is sre.LITERAL:
                out.add(chr(x).lower() if x < 128 else chr(x))
            elif what is sre.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() if c < 128 else chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return sorted(out) if len(out) <= 8 else None
    if kind is sre.SUBPATTERN:
        return _exact_sequence(value[-1])
    if kind is sre.BRANCH:
        found = [_exact_sequence(x) for x in value[1]]
        out = None if any(x is None for x in found) else sorted({s for x in found for s in x})
        return out if out is not None and len(out) <= most else None
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 2:
        one = _exact_sequence(value[2])
        out = None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)}
        return sorted(out) if out is not None and len(out) <= most else None
    return [""] if kind is sre.AT else None


def _exact_sequence(items) -> list[str] | None:
    out = [""]
    for item in items:
        found = _exact(item)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = [a + b for a in out for b in found]
    return out


def _clause(strings: Iterable[str]) -> list[frozenset[str]]:
    """The trigram sets of the strings, those that hold another one left out; nothing if a string has no trigram."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii()) for s in strings}
    if frozenset() in sets:
        return []
    rare = lambda t: (sum(c.isalpha() or c == " " for c in t), t)
    sets = {frozenset(sorted(x, key=rare)[:MOST_TRIGRAMS]) for x in sets}
    return sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)


def trigram_query(pattern: str) -> Query:
    """What the lower-case text of every match of a pattern holds; an empty list if no trigram is mandatory."""

    def of(items) -> Query:
        query, strings = [], [""]
        for item in items:
            found = _exact(item)
            if found is not None and len(strings) * len(found) <= MOST_STRINGS:
                strings = [a + b for a in strings for b in found]
                continue
            query.append(_clause(strings))
            strings = [""]
            kind, value = item
            if found is not None:
                strings = found
            elif kind is sre.SUBPATTERN:
                query += of(value[-1])
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                query += of(value[2])
        return [x for x in (*query, _clause(strings)) if x]

    return of(sre_parser.parse(pattern, re.ASCII))


def spans_of(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost spans of a rule that don't overlap, without those whose group is too short."""
    return [m.span() for m in pattern.finditer(text) if len(m.group(rule.group)) >= rule.least]


_SPANS = "array<struct<kind:int,first:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.int64()), ("end", pa.int64())]))


def _note(rules: list[Rule], whole: list[int], trigrams: list[str]):
    """Tasks that give for each text the asked trigrams it has and the spans of the rules in ``whole``."""

    def run(batches):
        patterns, asked = {k: rules[k].compiled() for k in whole}, [(n, x.encode()) for n, x in enumerate(trigrams)]
        for batch in batches:
            has, spans = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                low = text.encode().lower()
                has.append([n for n, x in asked if x in low])
                spans.append([{"kind": k, "first": a, "end": b} for k in whole for a, b in spans_of(rules[k], patterns[k], text)])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "h1", "h2")), pa.array(has, pa.list_(pa.int32())), pa.array(spans, _SPAN_TYPE)], names=["id", "h1", "h2", "has", "spans"])

    return run


def _verify(rules: list[Rule]):
    """Tasks that give the spans of the rules whose candidate a text is."""

    def run(batches):
        patterns = [x.compiled() for x in rules]
        for batch in batches:
            spans = []
            for text, asked in zip(batch.column("text"), batch.column("rules").to_pylist(), strict=True):
                text = text.as_py() or ""
                spans.append([{"kind": k, "first": a, "end": b} for k in asked for a, b in spans_of(rules[k], patterns[k], text)])
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(spans, _SPAN_TYPE)], names=["h1", "h2", "found"])

    return run


def posting_lists(noted: DataFrame) -> DataFrame:
    """The index: ``trigram, block, rows`` of texts with ``row`` and ``has``. A list holds up to 4,096 sorted rows."""
    one = noted.select("row", F.explode("has").alias("trigram"))
    return one.groupBy("trigram", F.shiftright("row", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list("row")).alias("rows"))


def candidates(index: DataFrame, queries: dict[int, Query], trigrams: list[str]) -> DataFrame:
    """``row, rules``: the rows that fulfil the query of a rule, and the numbers of these rules."""
    number = {x: n for n, x in enumerate(trigrams)}
    empty = F.array().cast("array<bigint>")
    posting = lambda x: F.coalesce(F.try_element_at("lists", F.lit(number[x])), empty)

    def all_of(parts: list[Column]) -> Column:
        out = parts[0]
        for x in parts[1:]:
            out = F.array_intersect(out, x)
        return out

    def any_of(parts: list[Column]) -> Column:
        out = parts[0]
        for x in parts[1:]:
            out = F.array_union(out, x)
        return out

    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    def hits_of(rule: int, query: Query) -> Column:
        rows = all_of([any_of([all_of([posting(t) for t in sorted(x)]) for x in clause]) for clause in query])
        return F.transform(rows, lambda row: F.struct(F.lit(rule).alias("rule"), row.alias("row")))

    hits = blocks.select(F.explode(F.concat(*(hits_of(k, query) for k, query in queries.items()))).alias("x")).select("x.*")
    return hits.groupBy("row").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def scan(docs: DataFrame, rules: Iterable[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id column and ``spans``, an array of (kind: number of the rule, first, end) in code points, end
    exclusive, by start, then by rule.

    Spans of a rule are leftmost and don't overlap; those of different rules may. Null texts count as empty. Rows that repeat an id are rows of
    their own; a null id is kept. Two texts count as equal when two 64-bit hashes are. An empty table gives no rows.
    """
    rules = list(rules)
    queries = {k: trigram_query(x.pattern) for k, x in enumerate(rules)}
    whole = [k for k, x in queries.items() if not x]
    queries = {k: x for k, x in queries.items() if x}
    trigrams = sorted({t for x in queries.values() for clause in x for one in clause for t in one})

    text = F.coalesce(text_column, F.lit(""))
    hashed = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    kind = f"id {docs.schema[id_column].dataType.simpleString()}, h1 long, h2 long, has array<int>, spans {_SPANS}"
    noted = hashed.mapInArrow(tidy(_note(rules, whole, trigrams)), kind)
    noted = materialize(noted.withColumn("row", F.monotonically_increasing_id()), "noted-texts")
    if not queries:
        return noted.select(F.col("id").alias(id_column), "spans")

    index = materialize(posting_lists(noted), "postings")
    wanted = candidates(index, queries, trigrams).join(noted.select("row", "h1", "h2"), "row")
    wanted = materialize(wanted.groupBy("h1", "h2").agg(F.any_value("rules").alias("rules")), "candidates")
    texts = hashed.drop("id").join(wanted, ["h1", "h2"])
    found = texts.mapInArrow(tidy(_verify(rules)), f"h1 long, h2 long, found {_SPANS}")
    found = materialize(found.where(F.size("found") > 0).groupBy("h1", "h2").agg(F.any_value("found").alias("found")), "secrets")
    order = lambda a, b: F.when((a.first < b.first) | ((a.first == b.first) & (a.kind < b.kind)), -1).otherwise(1)
    both = F.concat("spans", F.coalesce("found", F.array().cast(_SPANS)))
    out = noted.join(found, ["h1", "h2"], "left").withColumn("spans", F.when(F.size(both) > 1, F.array_sort(both, order)).otherwise(both))
    return out.select(F.col("id").alias(id_column), "spans")


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.first.cast("string"), x.end.cast("string"))), ",")


def secrets(docs: DataFrame, added: Iterable[Rule] = ADDED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` of the base spans, and all ``spans`` as text."""
    rules = [*BASE, *added]
    kinds = [x.kind for x in rules]
    found = scan(docs, rules, id_column, text_column)
    base = F.filter("spans", lambda x: x.kind < len(BASE))
    number = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long")
    return found.select(id_column, *(number(k).alias(f"n_{x.kind}") for k, x in enumerate(BASE)), F.sha2(joined(base, kinds), 256).alias("base_sha256"), joined(F.col("spans"), kinds).alias("spans"))


def _either(pattern: str) -> str:
    """A pattern whose letters outside classes match in either case, written out."""
    out, inside, escaped = "", False, False
    for c in pattern:
        plain = c.isalpha() and c.isascii() and not inside and not escaped
        out += f"[{c.upper()}{c.lower()}]" if plain else c
        inside, escaped = (c == "[" or inside) and c != "]", c == "\\" and not escaped
    return out


def duckdb_sql(rules: Iterable[Rule] = RULES) -> str:
    """The same rows in DuckDB SQL: places come from the lengths of what stands between matches."""
    parts = []
    for k, rule in enumerate(rules):
        pattern = _either(rule.pattern.replace(r"\x20", " ")) if rule.either_case else rule.pattern
        pattern = pattern.replace("'", "''")
        got = f"length(regexp_extract(m[i], '{pattern}', {rule.group})) >= {rule.least}"
        parts.append(f"""SELECT doc_id, {k} AS kind, '{rule.kind}' AS name, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: {got}), lambda i:
      {{'s': (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT, 'n': length(m[i])}})) AS p
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}'))""")
    union = "\n  UNION ALL ".join(parts)
    names = [x.kind for x in BASE]
    counts = ", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in names)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  s AS (SELECT doc_id, kind, name, p.s AS s, name || ':' || p.s || ':' || (p.s + p.n) AS x FROM ({union})),
  a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{x}" for k, x in enumerate(names))}, string_agg(x, ',' ORDER BY s, kind) AS spans,
    string_agg(x, ',' ORDER BY s, kind) FILTER (kind < {len(names)}) AS base FROM s GROUP BY 1)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""
