"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds turn its score s
into P(grade >= k) = sigmoid(s - t_k), with t_1 < t_2 < ... . The expected grade is the sum of the
tail probabilities, and a tail probability selects documents.

Features of a text: its distinct words in lower case without outer punctuation, weighted by
log(1 + count), and the beginnings of its words; the shapes of words that are no plain words (``X!``,
``x%`` ...), weighted by their share of all words; the share of words that repeat the one before.
All are hashed into one space. Features that few training texts hold, or that all grades use alike,
get no weight, so a long text gathers no noise from its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.arrow_text import WordValues, row_blocks, text_bytes, tidy
from memloom.llm.columns import set_aside
from memloom.sources.scratch import drop, materialize

#: Size of the hashed space.
BITS = 18
#: Rated rows that training takes at most: those with the smallest hash of their id.
MAX_TRAINING_ROWS = 6_000
#: Training texts that must hold a feature before it gets a weight.
MIN_TEXTS = 8
#: Lengths of the word beginnings that are features: inflected forms of a word share them.
PREFIXES = (4, 5)
#: A feature gets a weight only if its share of some grade is so many standard deviations off what chance gives.
LEAST_Z = 5.0
#: ... and so many times what chance gives: words that all grades use carry no weight.
LEAST_LIFT = 3.0
#: Probability of the highest grade from which a document is kept: under one half, so that clean documents stay.
LEAST_GOOD = 0.3
#: A shape's share of the words counts this much; a word's log count counts 1.
SHAPE_SCALE = 8.0

#: Features of the whole text, in the last places of the space; and the share of distinct words under which a text has few.
REPEATS, FEW, LEAST_DISTINCT = (1 << BITS) - 2, (1 << BITS) - 1, 0.2


def _shape(word: str) -> str:
    """Runs of letters as x, Xx, X or xX; digits as 9; each other run of one character as that character.

    Plain words, with a full stop or comma behind them or not, have no shape: every text is full of them.
    """
    out = []
    for run in re.findall(r"[^\W\d_]+|\d+|(?:[\W_])", word):
        if run[0].isdigit():
            kind = "9"
        elif run.isalpha():
            kind = "x" if run.islower() else "Xx" if run[0].isupper() and run[1:].islower() else "X" if run.isupper() else "xX"
        else:
            kind = run
        if not out or out[-1] != kind:
            out.append(kind)
    shape = "".join(out[:4])
    return "" if shape.rstrip(".,") in ("x", "Xx") else shape


def word_features(word: bytes) -> bytes:
    """Hashed numbers of a word's features: its shape first, then its form and its first 4 and 5 letters (0: none)."""
    text = word.decode("utf-8", "replace")
    form = text.lower().strip(".,;:!?\"'()[]#*$%&|<>")
    kinds = [("s", _shape(text)), ("w", form), *(("p", form[:n]) for n in PREFIXES if len(form) > n)]
    numbers = [xxhash.xxh3_64_intdigest(f"{kind} {x}".encode()) % ((1 << BITS) - 3) + 1 if x else 0 for kind, x in kinds]
    return np.array(numbers + [0] * (2 + len(PREFIXES) - len(numbers)), "<u4").tobytes()


_KNOWN = WordValues(word_features)


def batch_features(texts: pa.Array):
    """For ranges of rows in turn: first row, row behind the last, and (row, feature, value) arrays by row."""
    data, offsets = text_bytes(texts)
    for row, end in row_blocks(offsets):
        values, rows = _KNOWN.of(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], f"S{4 * (2 + len(PREFIXES))}")
        numbers = np.ascontiguousarray(values).view("<u4").reshape(len(rows), 2 + len(PREFIXES)).astype(np.uint64)
        n_words = np.bincount(rows, minlength=end - row)
        owner = rows.astype(np.uint64) << np.uint64(32)
        shapes, shape_counts = np.unique((owner | numbers[:, 0])[numbers[:, 0] > 0], return_counts=True)
        parts = [numbers[:, k] for k in range(1, numbers.shape[1])]
        # words equal to the one before them, and a text of few distinct words
        again = np.flatnonzero((numbers[1:, 1] == numbers[:-1, 1]) & (rows[1:] == rows[:-1]) & (numbers[1:, 1] > 0)) + 1
        repeats = np.bincount(rows[again], minlength=end - row) / np.maximum(1, n_words)
        own = np.unique(owner | numbers[:, 1])
        few = np.maximum(0, LEAST_DISTINCT - np.bincount((own >> np.uint64(32)).astype(np.int64), minlength=end - row) / np.maximum(1, n_words)) * (n_words > 0)
        forms, form_counts = np.unique(np.concatenate([(owner | x)[x > 0] for x in parts]), return_counts=True)
        shares = SHAPE_SCALE * shape_counts / np.maximum(1, n_words[(shapes >> np.uint64(32)).astype(np.int64)])
        whole = [(np.flatnonzero(x), SHAPE_SCALE * x[x > 0], number) for x, number in ((repeats, REPEATS), (few, FEW))]
        pairs = np.concatenate([forms, shapes, *((at.astype(np.uint64) << np.uint64(32)) | np.uint64(number) for at, _, number in whole)])
        who = (pairs >> np.uint64(32)).astype(np.int64)
        value = np.concatenate([np.log1p(form_counts), shares, *(x for _, x, _ in whole)])
        order = np.argsort(who, kind="stable")
        yield row, end, who[order], (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)[order], value[order].astype(np.float32)


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights and rising thresholds; grades run from 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def telling(found: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which features get a weight, from the texts of each grade that hold each (grades x features) and the texts of each grade."""
    held, shares = found.sum(axis=0), (texts / max(1, texts.sum()))[:, None]
    lift = (found / np.maximum(held * shares, 1e-9)).max(axis=0)
    off = (np.abs(found - held * shares) / np.sqrt(np.maximum(held * shares * (1 - shares), 1e-9))).max(axis=0)
    return (held >= MIN_TEXTS) & (off >= LEAST_Z) & (lift >= LEAST_LIFT)


def fit_ordinal(rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, size: int, l2: float = 1e-4, steps: int = 300, rate: float = 0.1) -> OrdinalModel:
    """Full-batch Adam on the mean negative log likelihood of the grades.

    Thresholds are t_1 and logarithms of the gaps, so they stay ordered. Classes weigh alike
    whatever their number of rows.
    """
    n = len(grades)
    found = np.array([np.bincount(features[(grades == k)[rows]], minlength=size) for k in range(n_grades)])
    use = telling(found, np.bincount(grades, minlength=n_grades))[features]
    rows, features, values = rows[use], features[use], values[use].astype(np.float64)
    names, column = np.unique(features, return_inverse=True)
    weight = n / np.maximum(1, np.bincount(grades, minlength=n_grades))[grades]
    weight /= weight.sum()
    theta = np.zeros(len(names) + n_grades - 1)
    theta[len(names)] = -0.5 * (n_grades - 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        w, t = theta[: len(names)], np.cumsum(np.concatenate([theta[len(names) : len(names) + 1], np.exp(theta[len(names) + 1 :])]))
        score = np.bincount(rows, values * w[column], minlength=n)
        # P(g) = F(t_{g+1} - s) - F(t_g - s), with F(-inf) = 0 and F(inf) = 1
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        low, high = sigmoid(edges[grades] - score), sigmoid(edges[grades + 1] - score)
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low) / p * weight, high * (1 - high) / p * weight
        d_score = d_high - d_low
        gradient = np.zeros_like(theta)
        gradient[: len(names)] = np.bincount(column, values * d_score[rows], minlength=len(names)) + l2 * w
        d_t = np.bincount(grades, -d_high, minlength=n_grades)[: n_grades - 1] + np.bincount(grades, d_low, minlength=n_grades)[1:]
        after = np.cumsum(d_t[::-1])[::-1]
        gradient[len(names)] = after[0]
        gradient[len(names) + 1 :] = after[1:] * np.exp(theta[len(names) + 1 :])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[names] = theta[: len(names)]
    return OrdinalModel(weights, np.cumsum(np.concatenate([theta[len(names) : len(names) + 1], np.exp(theta[len(names) + 1 :])])))


def rated_features(rated: DataFrame, text_column: str = "text", grade_column: str = "grade") -> DataFrame:
    """``grade, features, weights`` (arrays) of each row."""

    def run(batches):
        for batch in batches:
            for row, end, owner, feature, value in batch_features(batch.column(1)):
                at = pa.array(np.searchsorted(owner, np.arange(end - row + 1)).astype(np.int32))
                columns = pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *columns], names=["grade", "features", "weights"])

    return rated.select(F.col(grade_column).cast("int").alias("grade"), text_column).mapInArrow(tidy(run), "grade int, features array<int>, weights array<float>")


def train(rated: DataFrame, n_grades: int, text_column: str = "text", grade_column: str = "grade") -> OrdinalModel:
    """Fit on the rows of ``rated``, a bounded number of them (see :func:`classify`).

    Without any rated row the model has zero weights and grades alike. Spark counts in how many texts of each
    grade a feature stands; only features that tell grades apart come to the driver: a number for each
    place of the hashed space at most, for each row those that it holds. Texts never do.
    """
    size = 1 << BITS
    sets = materialize(rated_features(rated, text_column, grade_column), "rated-features")
    texts = np.zeros(n_grades, np.int64)
    for r in sets.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect():
        texts[r.grade] = r.n
    if not texts.sum():
        return OrdinalModel(np.zeros(size, np.float32), np.arange(n_grades - 1, dtype=float) - (n_grades - 2) / 2)
    counts = sets.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(*(F.count_if(F.col("grade") == k).alias(f"n{k}") for k in range(n_grades)))
    counts = counts.where(" + ".join(f"n{k}" for k in range(n_grades)) + f" >= {MIN_TEXTS}").toArrow()
    found = np.zeros((n_grades, size), np.int64)
    for k in range(n_grades):
        found[k, counts["feature"].to_numpy()] = counts[f"n{k}"].to_numpy()
    use = sets.sparkSession.sparkContext.broadcast(telling(found, texts))

    def chosen(batches):
        for batch in batches:
            rows = []
            for grade, features, weights in zip(*batch.columns, strict=True):
                x, w = features.values.to_numpy(), weights.values.to_numpy()
                keep = use.value[x]
                rows.append((grade.as_py(), x[keep].astype("<u4").tobytes(), w[keep].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["grade", "features", "weights"])

    got = sets.mapInArrow(tidy(chosen), "grade int, features binary, weights binary").collect()
    drop(sets)
    got.sort(key=lambda x: (x.grade, x.features, x.weights))  # whatever order tasks end in
    sizes, grades = [len(x.features) // 4 for x in got], np.array([x.grade for x in got])
    features = np.frombuffer(b"".join(x.features for x in got), "<u4").astype(np.int32)
    values = np.frombuffer(b"".join(x.weights for x in got), "<f4")
    del got
    return fit_ordinal(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), features, values, grades, n_grades, size)


def added_columns(k: int) -> list[str]:
    """Names of the columns that :func:`score` adds for thresholds 1 .. k."""
    return ["expected_grade", *(f"tail_{i}" for i in range(1, k + 1)), "kept", "_text"]


def score(docs: DataFrame, model: OrdinalModel, keep_at: int, least: float = LEAST_GOOD, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Expected grade and tail probabilities of every whole text.

    Returns the ``carry`` columns, ``expected_grade``, ``tail_1`` .. ``tail_K`` (double) and ``kept``: whether
    P(grade >= keep_at) is at least ``least``. A carried column named as an added one is left out. A null or empty text
    has no features and gets the probabilities of the thresholds alone. Repeated rows are all returned, an empty table
    gives no rows. The model (a vector of 2^18 floats) is broadcast.
    """
    k = len(model.thresholds)
    carry = tuple(x for x in carry if x.lower() not in added_columns(k))
    schema = T.StructType([*(docs.schema[x] for x in carry), T.StructField("expected_grade", T.DoubleType()), *(T.StructField(f"tail_{i}", T.DoubleType()) for i in range(1, k + 1))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for row, end, owner, feature, value in batch_features(batch.column(len(carry))):
                tails = fitted.tails(np.bincount(owner, value * fitted.weights[feature], minlength=end - row))
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns[: len(carry)]), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, i]) for i in range(k))], names=schema.names)

    return docs.select(*carry, F.col(text_column).alias("_text")).mapInArrow(tidy(run), schema).withColumn("kept", F.col(f"tail_{keep_at}") >= least)


def sample_of_ratings(labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``doc_id, grade`` of at most ``most`` rated documents, those with the smallest hash of their id.

    Grades: 0 toxic, 1 poor, 2 good. Null labels and ids are left out; a document rated
    several times counts once, with its worst rating.
    """
    grades = labels.select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 2 END").alias("grade"))
    grades = grades.where("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    return grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def classify(docs: DataFrame, labels: DataFrame, least: float = LEAST_GOOD, most: int = MAX_TRAINING_ROWS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on the rated documents among ``docs`` and score all of them: see :func:`score`, with 3 grades.

    Kept are documents whose probability of the highest grade is at least ``least``. The sample of
    ratings has ``most`` rows at most and is broadcast; of rows that repeat a rated id one trains, that
    with the smallest text.
    """
    sample = F.broadcast(sample_of_ratings(labels, most))
    rated = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    return score(docs, train(rated, n_grades=3), keep_at=2, least=least, carry=carry)


def kept_documents(docs: DataFrame, labels: DataFrame, least: float = LEAST_GOOD, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns, whatever the names."""
    clear, back = set_aside(docs, added_columns(2))
    return back(classify(clear, labels, least, most, carry=tuple(clear.columns)).where("kept"))
