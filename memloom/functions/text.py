"""Text measures as Spark columns: tokens, overlap scores, answer scores, chunks.

Every function takes and gives columns, so that all of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens per word that prompts are estimated with.
TOKENS_PER_WORD = 1.3

# The patterns that tokens follow.
LEXICAL = "[\\x{4e00}-\\x{9fff}]|[a-z0-9]+(?:[-_.][a-z0-9]+)*"
WORD = "[A-Za-z0-9]+"
#: Every character that counts as white space when a text is split into words.
SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
#: The same class for the DuckDB twins.
SPACE_SQL = SPACE.replace("\\s", "\\s\\x{b}")


def lexical_tokens(text: Column) -> Column:
    """Lower-case retrieval tokens: single ideographs, and words that may hold ``-``, ``_`` and ``.``."""
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL), 0)


def word_tokens(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), F.lower)


def token_set(text: Column) -> Column:
    """The distinct word tokens."""
    return F.array_distinct(word_tokens(text))


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lexical_score(query: Column, text: Column) -> Column:
    """Shared tokens over the geometric mean of both set sizes; 0 for a query without tokens."""
    q, t = token_set(query), token_set(text)
    shared = F.size(F.array_intersect(q, t)).cast("double")
    return shared / F.sqrt((F.greatest(F.lit(1), F.size(q)) * F.greatest(F.lit(1), F.size(t))).cast("double"))


def approx_tokens(text: Column) -> Column:
    """Estimated prompt tokens of a text, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.size(words(text)) * F.lit(TOKENS_PER_WORD))).cast("long")


def budget_chunks(text: Column, most: int) -> Column:
    """The text's words in chunks of about ``most`` tokens; one empty chunk for an empty text."""
    size = max(1, int(most / TOKENS_PER_WORD))
    w = words(text)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w)), F.lit(size))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))


def normalize_answer(text: Column) -> Column:
    """Lower case without commas, ASCII punctuation and articles; single spaces."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, ",", "")), "\\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "\\b(a|an|the|and)\\b", " "), "\\s+", " "))


def answer_tokens(text: Column) -> Column:
    """Tokens of the normalised answer."""
    return F.filter(F.split(normalize_answer(text), " "), lambda w: w != "")


def _shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: both sorted by token, counted once per distinct token."""
    count = lambda array, token: F.size(F.filter(array, lambda x: x == token))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def f1_of_tokens(p: Column, g: Column) -> Column:
    """F1 of two token arrays as multisets; 0 if they share none."""
    shared = _shared_count(p, g).cast("double")
    both = (F.size(p) + F.size(g)).cast("double")
    return F.coalesce(F.lit(2.0) * shared / F.nullif(both, F.lit(0.0)), F.lit(0.0))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the token multisets of two answers: 2 PR / (P + R) = 2 shared / (sizes together)."""
    return f1_of_tokens(answer_tokens(prediction), answer_tokens(gold))


def exact_match(prediction: Column, gold: Column) -> Column:
    """1 if both answers have the same set of tokens, else 0."""
    key = lambda x: F.array_sort(F.array_distinct(answer_tokens(x)))
    return (key(prediction) == key(gold)).cast("double")


def multi_answer_f1(prediction: Column, gold: Column) -> Column:
    """Both sides split at commas: the mean over gold parts of the best F1 of a predicted part; 0 if a side has no part."""
    parts = lambda x: F.transform(F.filter(F.transform(F.split(x, ","), F.trim), lambda y: y != ""), answer_tokens)
    p, g = parts(prediction), parts(gold)
    best = F.transform(g, lambda y: F.array_max(F.transform(p, lambda x: f1_of_tokens(x, y))))
    return F.coalesce(F.aggregate(best, F.lit(0.0), lambda n, x: n + x) / F.nullif(F.size(g), F.lit(0)), F.lit(0.0))


# Phrases of a refusal.
REFUSALS = ("no information available", "not mentioned")


def refuses(prediction: Column) -> Column:
    """Whether an answer says that the memory doesn't tell."""
    lower = F.lower(prediction)
    return lower.contains(REFUSALS[0]) | lower.contains(REFUSALS[1])


def category_exact_match(category: Column, prediction: Column, gold: Column) -> Column:
    """Exact match by category: of category 3 the first part of the gold answer counts, of category 5 a refusal."""
    first = F.when(category == 3, F.trim(F.element_at(F.split(gold, ";"), 1))).otherwise(gold)
    return F.when(category == 5, refuses(prediction).cast("double")).otherwise(exact_match(prediction, first))


def category_score(category: Column, prediction: Column, gold: Column) -> Column:
    """The score of an answer by its question's category (1 to 5); any other category raises."""
    refusal = refuses(prediction)
    return (
        F.when(category == 1, multi_answer_f1(prediction, gold))
        .when(category.isin(2, 4), token_f1(prediction, gold))
        .when(category == 3, token_f1(prediction, F.trim(F.element_at(F.split(gold, ";"), 1))))
        .when(category == 5, refusal.cast("double"))
        .otherwise(F.raise_error(F.lit("unknown question category")).cast("double"))
    )
