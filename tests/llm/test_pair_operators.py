"""Components, joins and near-duplicates against brute force, with hot groups, nulls and repeated rows."""

import inspect
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memloom.llm import itq_neardup, line_dedup, ngram_jaccard
from memloom.llm import queries as q
from memloom.llm.blocks import bucket_blocks
from memloom.llm.components import components

SF = "/root/testdata/sf0.001"


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


class TestComponents:
    def test_random_paths_and_stars(self, spark):
        random.seed(5)
        edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(random.randint(500, 900), random.randint(500, 900)) for _ in range(250)] + [(7, 7), (None, 3), (1000, 1001), (1001, 1000)]
        random.shuffle(edges)
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        real = [(a, b) for a, b in edges if a is not None and a != b]
        assert got == union_find({x for e in real for x in e}, real)

    def test_no_edges(self, spark):
        assert components(spark.createDataFrame([], "a long, b long")).count() == 0

    def test_no_side_that_grows_is_broadcast(self, spark):
        plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
        members = spark.range(4000).selectExpr("id % 500 AS group", "id")
        assert "Broadcast" not in plan(bucket_blocks(members, 1024))
        rows = spark.range(200).selectExpr("id AS vec_id", "array(float(1 + id div 4), float(1 + id div 2), 1F) AS embedding", "0 AS label")
        assert "Broadcast" not in plan(itq_neardup.near_duplicates(rows))
        compared, classes = spark.range(100).selectExpr("id", "1L AS links", "id - id % 5 AS root"), spark.range(100).selectExpr("id AS node", "id AS rep")
        assert "Broadcast" not in plan(ngram_jaccard.linked(compared, classes))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(line, edits):
    line = list(line)
    for _ in range(edits):
        at, kind = random.randint(0, len(line)), random.random()
        if kind < 0.33:
            line.insert(at, random.choice("abé"))
        elif kind < 0.66 and line:
            line.pop(min(at, len(line) - 1))
        elif line:
            line[min(at, len(line) - 1)] = random.choice("abé")
    return "".join(line)


class TestLineDedup:
    @pytest.mark.parametrize("tau", [1, 2, 3])
    def test_edit_distance(self, spark, tau):
        random.seed(tau)
        rows = [(a, edited(a, random.randint(0, 4))) for a in ("".join(random.choice("abé😀") for _ in range(random.randint(0, 25))) for _ in range(400))]
        rows += [("x" * 5000 + "a" + "y" * 5000, "x" * 5000 + "y" * 5000), ("", ""), ("", "ab")]
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.expr(line_dedup.within_edits("a", "b", tau)).alias("w")).collect()
        assert all(r.w == ((levenshtein(r.a, r.b) if len(r.a) < 1000 else 1) <= tau) for r in got)

    def expected(self, docs, tau, least):
        first, order = {}, []
        for doc, text in docs:
            for no, line in enumerate(text.split("\n")):
                if len(line) >= least and line not in first:
                    first[line] = (doc, no)
                    order.append(line)
        near = {b for i, b in enumerate(order) if any(abs(len(a) - len(b)) <= tau and levenshtein(a, b) <= tau for a in order[:i])}
        return {doc: "\n".join(x for no, x in enumerate(text.split("\n")) if len(x) < least or (first[x] == (doc, no) and x not in near)) for doc, text in docs}

    @pytest.mark.parametrize("tau", [1, 2])
    def test_lines_with_many_variants(self, spark, tau):
        random.seed(9)
        base = ["".join(random.choice("ab é") for _ in range(n)) for n in (8, 9, 12, 15, 22, 30)]
        docs = [(i, "\n".join(edited(random.choice(base), random.randint(0, 3)) for _ in range(random.randint(0, 5)))) for i in range(60)]
        got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), tau=tau, least=6)
        assert {r.doc_id: r.text for r in got.collect()} == self.expected(docs, tau, 6)

    def test_one_line_in_a_third_of_all_texts_and_a_large_family(self, spark):
        common, word = "the very common line of the corpus", "a line of a large family number"
        docs = [(i, common if i % 3 == 0 else f"{word} {i:06d}{i * 7919 % 100_003:06d}") for i in range(600)]
        got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert {i: r.text for i, r in got.items()} == self.expected(docs, 2, line_dedup.MIN_CHARS)

    def test_odd_rows_and_clashing_columns(self, spark):
        long = "word " * 100_000
        rows = [(1, None, "a"), (2, "", "b"), (3, "same line of text, long enough", "c"), (3, "same line of text, long enough", "c"), (None, "same line of text, long enough\nshort", "d"), (4, long, "e"), (5, long, "f")]
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, line string")).collect()
        texts = Counter((r.doc_id, r.text, r.line, r.n_dropped_lines) for r in got)
        assert texts == Counter({(1, None, "a", 0): 1, (2, "", "b", 0): 1, (3, "", "c", 1): 2, (None, "same line of text, long enough\nshort", "d", 0): 1, (4, long, "e", 0): 1, (5, "", "f", 1): 1})
        assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0

    def test_helper_columns_of_a_caller_and_the_size_of_the_filter(self, spark, monkeypatch):
        line = "a line of text that is long enough"
        rows = [(1, line, 5, "i", "g"), (2, line + "\nb", 6, "i", "g")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped_lines int, _id string, _gone string")
        got = line_dedup.dedup_lines(docs)
        assert got.columns == ["doc_id", "text", "_id", "_gone", "n_dropped_lines"]
        assert sorted(map(tuple, got.collect())) == [(1, line, "i", "g", 0), (2, "b", "i", "g", 1)]
        assert line_dedup.filter_bits(0) == line_dedup.filter_bits(1 << 18) == 1 << 24 and line_dedup.filter_bits(1 << 25) == 1 << 28 and line_dedup.filter_bits((1 << 25) + 1) is None
        random.seed(1)
        base = ["".join(random.choice("ab é") for _ in range(n)) for n in (12, 15, 22, 30)]
        docs = [(i, "\n".join(edited(random.choice(base), random.randint(0, 3)) for _ in range(4))) for i in range(40)]
        monkeypatch.setattr(line_dedup, "filter_bits", lambda keys: None)  # no filter at all
        got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least=6)
        assert {r.doc_id: r.text for r in got.collect()} == self.expected(docs, 2, 6)

    def test_short_lines_go_as_exact_repeats_only(self, spark):
        docs = [(1, "By To.\nBy To.\n\n \nBy To!"), (2, "\n \t\nBy To.\nBy Ti."), (3, "é"), (4, "é\n\nz")]
        got = {r.doc_id: (r.text, r.n_dropped_lines) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == {1: ("By To.\n\n \nBy To!", 1), 2: ("\n \t\nBy Ti.", 1), 3: ("é", 0), 4: ("\nz", 1)}

    def test_given_documents_and_no_python(self, spark):
        docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
        out = q.op9_segment_line_dedup(spark, SF)
        assert {r.doc_id: r.text for r in out.collect()} == self.expected_fast(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan

    def expected_fast(self, docs):
        lines = {x for _, t in docs for x in t.split("\n") if len(x) >= line_dedup.MIN_CHARS}
        by_bag = defaultdict(list)
        for x in lines:
            by_bag[len(x)].append((x, Counter(x)))
        close = defaultdict(list)
        for x in lines:
            bag = Counter(x)
            for n in range(len(x) - 2, len(x) + 3):
                close[x] += [y for y, other in by_bag[n] if y != x and sum(((bag - other) + (other - bag)).values()) <= 4 and levenshtein(x, y) <= 2]
        first = {}
        for doc, text in docs:
            for no, x in enumerate(text.split("\n")):
                first.setdefault(x, (doc, no))
        # of equal lines of any length, blank ones excepted, the first stays
        return {doc: "\n".join(x for no, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (doc, no) and not any(first[y] < first[x] for y in close[x]))) for doc, t in docs}


def shingles(text):
    words = [w for w in (text or "").replace("\x0b", " ").split() if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def check_links(docs, got, threshold=0.8):
    sets, holders, shared = {i: shingles(t) for i, t in docs}, defaultdict(list), Counter()
    pairs = []
    for i in sorted(sets):
        found = Counter(j for g in sets[i] for j in holders[g])
        for g in sets[i]:
            holders[g].append(i)
        pairs += [(i, j) for j, k in found.items() if k >= threshold * (len(sets[i]) + len(sets[j]) - k) - 1e-9]
    for i, j in pairs:
        shared[i] += 1
        shared[j] += 1
    roots = union_find(sets, pairs)
    assert {r.doc_id: r.n_links for r in got} == {i: shared[i] for i in sets}
    assert {r.doc_id: r.component_id for r in got} == roots
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return len(pairs)


class TestNgramJoin:
    def test_given_documents(self, spark):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
        assert check_links(docs, q.op6_bayesian_ngram_join(spark, SF).collect()) > 0

    def test_a_hot_group_of_near_copies(self, spark, monkeypatch):
        random.seed(2)
        monkeypatch.setattr(ngram_jaccard, "BLOCK", 40)  # several blocks
        base = [f"w{random.randint(0, 999)}" for _ in range(120)]
        docs = []
        for i in range(300):
            words = list(base) if i % 3 else [f"v{random.randint(0, 999)}" for _ in range(80)]
            for _ in range(random.randint(0, 3)):
                words[random.randrange(len(words))] = f"x{random.randint(0, 9)}"
            docs.append((i, " ".join(words)))
        docs += [(300 + i, docs[i][1]) for i in range(40)]
        got = ngram_jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
        assert check_links(docs, got) > 5_000

    def test_odd_rows(self, spark):
        long = " ".join(str(i % 50_021) for i in range(200_000))
        docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one\ttwo "), (6, "one two three"), (7, long), (8, long + " end"), (9, "a a a a a a a a"), (10, "a a a a a")]
        frame = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(None, "one two", 0)], "doc_id long, text string, n_links int")
        got = ngram_jaccard.near_duplicates(frame).collect()
        check_links(docs, [r for r in got if r.doc_id is not None])
        (lost,) = [r for r in got if r.doc_id is None]
        assert lost.n_links == 0 and lost.kept
        assert ngram_jaccard.near_duplicates(frame.where("doc_id > 99")).count() == 0

    def test_repeated_ids_and_rows(self, spark):
        random.seed(11)
        words = lambda seed, n=80: " ".join(f"{seed}{random.randint(0, 9999)}" for _ in range(n))
        t, u, v = words("t"), words("u"), words("v")
        rows = [(3, t), (5, t + " end"), (5, u), (7, "x " + u), (7, "x " + u), (9, v), (9, v), (9, v + " "), (9, v + " z"), (11, words("w")), (11, words("w")), (12, words("q"))]
        rows += [(random.randint(20, 26), f"{random.choice((t, u, v))} {random.choice('abc')}") for _ in range(40)]
        frame = spark.createDataFrame([(i, x, k, "h") for k, (i, x) in enumerate(rows)], "doc_id long, text string, row int, h1 string").repartition(3)
        sets = [shingles(x) for _, x in rows]
        pairs = [(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        links = Counter(x for p in pairs for x in p)
        root = union_find(range(len(rows)), pairs)
        least = {r: min(rows[k][0] for k in root if root[k] == r) for r in set(root.values())}
        expected = Counter((rows[k][0], links[k], least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows)))
        got = ngram_jaccard.near_duplicates(frame).collect()
        assert Counter((r.doc_id, r.n_links, r.component_id, r.kept) for r in got) == expected
        left = ngram_jaccard.one_of_each_group(frame)
        assert left.columns == frame.columns
        left = left.collect()
        assert sorted(root[r.row] for r in left) == sorted(set(root.values()))  # one row of each group
        assert all(r.doc_id == least[root[r.row]] and r.text == rows[r.row][1] and r.h1 == "h" for r in left)

    def test_texts_that_share_boilerplate_only_are_not_grouped(self, spark):
        random.seed(4)
        common = " ".join(f"c{i}" for i in range(100))
        docs = [(i, common + " " + " ".join(f"w{i}_{k}" for k in range(100))) for i in range(600)]
        rng = ngram_jaccard.least_matches()
        marks = np.array([ngram_jaccard.signature(ngram_jaccard.grams_of(np.array([xxhash.xxh3_64_intdigest(w) for w in t.split()], np.uint64))) for _, t in docs])
        i, j = np.triu_indices(600, 1)
        shared = (marks[i].reshape(-1, 32, 5) == marks[j].reshape(-1, 32, 5)).all(axis=2)
        assert shared.any(axis=1).mean() > 0.01  # they do meet in buckets
        assert not len(ngram_jaccard.likely_pairs(marks, np.zeros(600, int), i, j, rng)[0])  # and none goes on from there
        got = ngram_jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert all(r.n_links == 0 and r.kept for r in got)

    def test_long_near_copies_in_blocks_bounded_by_grams(self, spark, monkeypatch):
        from memloom.llm.blocks import bucket_blocks

        monkeypatch.setattr(ngram_jaccard, "HEAVIEST", 20_000)
        random.seed(3)
        base = [f"w{random.randint(0, 10**6)}" for _ in range(4000)]
        docs = []
        for i in range(80):
            words = list(base)
            for _ in range(random.choice([1, 5, 30])):
                words[random.randrange(len(words))] = f"x{random.randint(0, 10**6)}"
            docs.append((i, " ".join(words)))
        docs += [(100 + i, " ".join(f"y{i}_{k}" for k in range(3000))) for i in range(5)]
        sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
        pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        links = Counter(x for p in pairs for x in p)
        got = ngram_jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
        assert {r.doc_id: r.n_links for r in got} == {i: links[i] for i in sets} and len(pairs) > 1000
        assert {r.doc_id: r.component_id for r in got} == union_find(sets, pairs)
        members = spark.createDataFrame([(1, i, 4000) for i in range(80)] + [(2, 500, 90_000), (2, 501, 10)], "group long, id long, size long")
        blocks = bucket_blocks(members, 1024, "size", 20_000).groupBy("group", "block").agg(F.sum("size").alias("s"), F.count("id").alias("n")).collect()
        assert max(r.s for r in blocks if r.group == 1) <= 3 * 20_000 and sum(r.n for r in blocks) == 82

    def test_pruning_bounds(self):
        least = ngram_jaccard.least_matches()
        rng = np.random.default_rng(1)
        for n, m in least.items():
            assert (rng.binomial(n, 0.8, 200_000) < m).mean() < 1e-4 and m > 0.3 * n


class TestEmbeddings:
    def brute(self, rows):
        ok = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
        groups = defaultdict(list)
        for i, v, label in ok:
            groups[label, len(v)].append((i, v / np.linalg.norm(v)))
        return [(a[0], b[0]) for g in groups.values() for k, a in enumerate(g) for b in g[:k] if a[1] @ b[1] >= 0.98]

    def check(self, rows, got):
        """Number of pairs, and recall; groups and verdicts must be those of the links if none is lost."""
        pairs = self.brute(rows)
        links = Counter(x for p in pairs for x in p)
        found = {r.vec_id: r.n_links for r in got}
        assert all(found[i] <= links[i] for i in found if i is not None)
        assert sum(found.values()) >= 0.9 * 2 * len(pairs)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
        if sum(found.values()) == 2 * len(pairs):
            assert {r.vec_id: r.component_id for r in got} == union_find(found, pairs)
        return len(pairs), sum(found.values()) / max(1, 2 * len(pairs))

    def test_clusters_and_odd_vectors(self, spark, monkeypatch):
        monkeypatch.setattr(itq_neardup, "BLOCK", 40)
        rng = np.random.default_rng(8)
        centres = rng.standard_normal((40, 64))
        rows = []
        for i in range(600):
            v = centres[i % 40 if i % 3 else 0] + rng.standard_normal(64) * rng.choice([0.02, 0.1, 0.16])
            rows.append((i, [float(np.float32(x)) for x in v], i % 2))
        rows += [(1000 + i, rows[3][1], 1) for i in range(30)]
        nan, inf = float("nan"), float("inf")
        rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 64, 1), (2003, [nan] + [1.0] * 63, 1), (2004, [inf] + [1.0] * 63, 1), (2005, [None] + [1.0] * 63, 1), (2006, rows[3][1], None), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (None, rows[3][1], 1)]
        got = itq_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
        assert len(got) == len(rows)
        n, recall = self.check([r for r in rows if r[0] is not None], [r for r in got if r.vec_id is not None])
        assert n > 1000 and recall > 0.97
        alone = {r.vec_id: (r.n_links, r.kept) for r in got if r.vec_id in (None, 2000, 2001, 2002, 2003, 2004, 2005, 2006)}
        assert set(alone.values()) == {(0, True)}
        assert {r.vec_id: r.component_id for r in got}[2008] == 2007

    def test_isolated_pairs_just_over_the_threshold(self, spark):
        rng = np.random.default_rng(3)
        rows = []
        for k in range(600):
            a, b = rng.standard_normal((2, 64))
            a /= np.linalg.norm(a)
            b -= (a @ b) * a
            cos = rng.uniform(0.9801, 0.983)
            rows += [(2 * k, [float(np.float32(x)) for x in a], 0), (2 * k + 1, [float(np.float32(x)) for x in cos * a + np.sqrt(1 - cos * cos) * b / np.linalg.norm(b)], 0)]
        n, recall = self.check(rows, itq_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect())
        print("recall of isolated pairs", recall)
        assert n >= 590 and recall > 0.95

    @pytest.mark.parametrize("width, mean_cosine, wide_from", [(64, 0.982, 1 << 26), (64, 0.8, 1), (64, 0.9, 1 << 26), (64, 0.95, 1 << 26), (64, 0.95, 1), (384, 0.9, 1 << 26), (384, 0.95, 1 << 26)])
    def test_vectors_that_share_a_direction(self, spark, width, mean_cosine, wide_from):
        rng = np.random.default_rng(12)
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        base = unit(rng.standard_normal((500, width - 1)))
        base = np.concatenate([np.full((500, 1), np.sqrt(mean_cosine)), np.sqrt(1 - mean_cosine) * base], axis=1) @ np.linalg.qr(rng.standard_normal((width, width)))[0]
        aside = rng.standard_normal((200, width))
        aside = unit(aside - np.einsum("ij,ij->i", aside, base[:200])[:, None] * base[:200])
        cosine = rng.uniform(0.9801, 0.99, (200, 1))
        both = np.concatenate([base, cosine * base[:200] + np.sqrt(1 - cosine**2) * aside])
        rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(both)]
        got = itq_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4), wide_from=wide_from).collect()
        n, recall = self.check(rows, got)
        assert n >= 200 and recall >= 0.95

    def test_loose_clusters_without_links_and_repeated_ids(self, spark):
        rng = np.random.default_rng(5)
        centres = rng.standard_normal((4, 64))
        rows = [(i, (centres[i % 4] + 0.45 * rng.standard_normal(64)).tolist(), 0) for i in range(800)]
        assert not self.brute(rows)
        got = itq_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert all(r.n_links == 0 and r.kept for r in got)
        a, b = rng.standard_normal((2, 64)).tolist()
        rows = [(3, a, 0), (5, a, 0), (5, b, 0), (7, b, 0), (7, b, 0), (9, (-np.array(a)).tolist(), 0)]
        got = itq_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter([(3, 1, 3, True), (5, 1, 3, False), (5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False), (9, 0, 9, True)])

    def test_very_large_and_small_components(self, spark):
        rng = np.random.default_rng(6)
        base = rng.standard_normal((5, 16))
        rows = [(i, (base[i % 5] * (1e200, 1e-200, 1.0)[i % 3]).tolist(), 0) for i in range(30)] + [(100, [1e308, 1e308] + [0.0] * 14, 0), (101, [5e-324] * 16, 0)]
        got = {r.vec_id: r.n_links for r in itq_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        assert all(got[i] == 5 for i in range(30)) and got[100] == got[101] == 0

    def test_the_sample_is_that_of_a_full_sort(self, spark):
        rows = [(i % 700, [float(i), 1.0]) for i in range(900)]
        classes = spark.createDataFrame(rows, "rep long, embedding array<double>").repartition(6)
        want = [r.embedding for r in classes.orderBy(F.xxhash64("rep", "embedding"), "rep").limit(60).collect()]
        few, stored = itq_neardup.sampled(classes, 60)
        assert [r.embedding for r in few.collect()] == want and 60 <= stored[0].count() < 300
        same = spark.createDataFrame([(1, [1.0]) for _ in range(500)], "rep long, embedding array<double>")
        assert len(itq_neardup.sampled(same, 60)[0].collect()) == 60  # all hashes equal: the whole table is sorted

    def test_the_driver_learns_nothing(self, spark, monkeypatch):
        driver, learn = os.getpid(), itq_neardup.learn_rotation

        def elsewhere(*args):
            assert os.getpid() != driver
            return learn(*args)

        monkeypatch.setattr(itq_neardup, "learn_rotation", elsewhere)
        rng = np.random.default_rng(2)
        rows = [(i, rng.standard_normal(16 if i % 3 else 8).tolist(), 0) for i in range(90)] + [(100, [1.0] * 16, 0), (101, [1.0] * 15 + [1.01], 0)]
        got = itq_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert {r.vec_id: r.component_id for r in got}[101] == 100

    def test_no_number_of_vectors_changes_the_keys(self):
        assert inspect.signature(itq_neardup.near_duplicates).parameters["wide_from"].default is None
        assert not [x for x in vars(itq_neardup) if x.startswith("WIDE")]

    def test_given_vectors_and_empty_table(self, spark):
        got = q.op4_itq_near_duplicates(spark, SF).collect()
        rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
        self.check(rows, got)
        assert itq_neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p
    from memloom.llm import ordinal_quality, packing
    from memloom.sources.scratch import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert docs.columns == columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
            assert seen[name].keys() <= {r.doc_id for r in before.select("doc_id").collect()}
    kept = {r.doc_id for r in ordinal_quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert seen["quality classifier"].keys() == kept
    for name in ("line dedup", "n-gram Jaccard join"):
        assert len(seen[name]) > 0.8 * len(seen["quality rules"])
    lines = Counter(x for t in seen["line dedup"].values() for x in t.split("\n") if len(x) >= line_dedup.MIN_CHARS)
    assert max(lines.values()) == 1
    last = seen["n-gram Jaccard join"]
    check_links(list(last.items()), [type("R", (), {"doc_id": i, "n_links": 0, "component_id": i, "kept": True}) for i in last])
    rows = docs.collect()
    assert {r.doc_id for r in rows} == last.keys()
    assert packing.SMALLEST < 1024 and Counter(r.doc_id for r in rows).keys() == last.keys()
    assert sum(r.length for r in p.run(spark, SF).collect()) == sum(r.length for r in rows)


def test_pipeline_on_empty_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
