"""Heuristic quality rules: a table of thresholds compiled into one Spark projection.

Only built-in functions: no shuffle, no Python, one pass over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.columns import set_aside

# Frequent function words.
STOP_WORDS = {
    "en": "a an and are as at be by for from has have in is it not of on or that the this to was we with you",
    "de": "auf aus das dem den der des die ein eine einen er es für im in ist mit nicht sich sie und von war zu",
    "fr": "au aux avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une",
    "es": "al como con de del el en es la las lo los más no para por que se ser su un una y",
}

#: White space of the word rule, and the symbols of the symbol rule.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``measure`` (SQL over the statistics) must lie in [low, high]; None leaves a side open. Null passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The default table. Texts in the four languages of STOP_WORDS keep well inside each bound.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 1.5, 20.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.3),
    Rule("exclamations_per_word", "n_exclamations / n_words", None, 0.3),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.3),
    Rule("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.3),
)

MIN_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20


def _count_of(text: Column, characters: str) -> Column:
    """How many of the characters of ``text`` are in ``characters``."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def _repeated_words(windows: str, words: str) -> list[tuple[str, Column]]:
    """Steps to the number of words that lie in windows found twice or more.

    ``windows`` holds a 64-bit hash for each window. Texts whose windows all differ stop at the
    first step; in others, windows are sorted by hash, those equal to a neighbour give their
    positions, and each position adds the words up to the next one, a window's length at most.
    """
    place = F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.array_sort(F.expr(f"transform({windows}, (h, i) -> struct(h AS h, i AS i))")),
    )
    found = F.expr("array_sort(transform(filter(sequence(0, size(_place) - 1), j -> coalesce(get(_place, j - 1).h = get(_place, j).h, false) OR coalesce(get(_place, j + 1).h = get(_place, j).h, false)), j -> get(_place, j).i))")
    total = F.expr(f"coalesce(aggregate(sequence(0, size(_found) - 1), 0L, (n, j) -> n + least({WINDOW}, coalesce(get(_found, j + 1) - get(_found, j), {WINDOW}))), 0L)")
    return [("_place", place), ("_found", found), ("n_repeat_words", total)]


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the statistics of each whole text as further columns (all long).

    n_words, word_chars, n_symbols, n_exclamations, n_stop_words, n_lines (with a word),
    n_dup_lines, n_bullet_lines, n_ellipsis_lines, n_repeat_words. Null counts as an empty text.
    Columns of ``docs`` with these names are replaced.
    """
    inside = "".join(f"\\{c}" if c == "-" else c for c in SPACES)
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    quoted = ", ".join(f"'{w}'" for w in stop)
    out = docs.withColumn("_text", F.coalesce(F.col(text_column), F.lit("")))
    out = out.withColumn("_words", F.filter(F.split("_text", f"[{inside}]+"), lambda w: w != ""))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    steps = ", ".join(f"get(_words, i + {k})" for k in range(WINDOW))
    out = out.withColumn("_windows", F.expr(f"CASE WHEN size(_words) >= {WINDOW} THEN transform(sequence(0, size(_words) - {WINDOW}), i -> xxhash64({steps})) END"))
    long = lambda c: c.cast("long")
    out = out.withColumns({
        "n_words": long(F.size("_words")),
        "word_chars": long(F.char_length(F.translate("_text", SPACES, ""))),
        "n_symbols": long(_count_of(F.col("_text"), SYMBOLS)),
        "n_exclamations": long(_count_of(F.col("_text"), "!")),
        "n_stop_words": long(F.size(F.expr(f"filter(_words, w -> lower(trim(TRAILING '.,;:!?' FROM w)) IN ({quoted}))"))),
        "n_lines": long(F.size("_lines")),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_bullet_lines": long(F.size(F.expr("filter(_lines, x -> substring(ltrim(x), 1, 1) IN ('-', '*', '•'))"))),
        "n_ellipsis_lines": long(F.size(F.expr("filter(_lines, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')"))),
    })
    for name, column in _repeated_words("_windows", "_words"):
        out = out.withColumn(name, column)
    return out.drop("_text", "_words", "_lines", "_windows", "_place", "_found")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that fail, as one array column over the statistics of :func:`measure`."""
    failed = []
    for rule in rules:
        value = F.expr(f"try_divide({rule.measure.split('/')[0]}, {rule.measure.split('/')[1]})") if "/" in rule.measure else F.expr(rule.measure)
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < F.lit(float(rule.low)))
        if rule.high is not None:
            out = out | (value > F.lit(float(rule.high)))
        failed.append(F.when(F.coalesce(out, F.lit(False)), F.lit(rule.name)))
    return F.array_compact(F.array(*failed))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``failed_rules`` and ``kept``.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows.
    kept is false if base_failed, else whether no rule of the table fails. An empty or null text
    fails the base rule. Rows are judged one by one: repeated rows are all returned, and an empty
    table gives no rows.
    """
    # the partition number is not deterministic to the optimizer, which so leaves filters on the verdict above
    # the statistics; pushed below, they would copy the statistics' expressions many times over
    out = measure(docs, text_column).withColumn("_fence", F.spark_partition_id())
    out = out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"))
    out = out.withColumn("failed_rules", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & (F.col("_fence") >= 0)).drop("_fence")


#: Names that :func:`apply_rules` uses for itself.
ADDED = "n_words word_chars n_symbols n_exclamations n_stop_words n_lines n_dup_lines n_bullet_lines n_ellipsis_lines n_repeat_words base_failed failed_rules kept _fence _text _words _lines _windows _place _found".split()


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`apply_rules` keeps, with all their columns, whatever the names."""
    clear, back = set_aside(docs, ADDED)
    return back(apply_rules(clear, rules).where("kept"))


def duckdb_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same statistics and verdict over ``documents`` in DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    gone = lambda chars: "length(t) - length(regexp_replace(t, '[" + chars + "]', '', 'g'))"
    sides = []
    for rule in rules:
        over, under = rule.measure.split("/")
        for bound, sign in ((rule.low, "<"), (rule.high, ">")):
            if bound is not None:
                sides.append(f"coalesce({over}::DOUBLE / nullif({under}, 0) {sign} {float(bound)!r}::DOUBLE, false)")
    return rf"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM parts)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows), (SELECT unnest(range(0, 5)) AS k)
  WHERE n > 1 GROUP BY doc_id),
stats AS (
  SELECT p.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    ({gone("#*$%&|<>")})::BIGINT AS n_symbols,
    ({gone("!")})::BIGINT AS n_exclamations,
    len(list_filter(words, lambda w: lower(rtrim(w, '.,;:!?')) IN ({stop})))::BIGINT AS n_stop_words,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(lines, lambda x: ltrim(x, ' ')[1:1] IN ('-', '*', '•')))::BIGINT AS n_bullet_lines,
    len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::BIGINT AS n_ellipsis_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(sides)}) AS kept
FROM judged"""
