"""Prefix trie, Merkle manifest and secret scans against SQL and brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from memloom.llm import merkle, prefix_trie, secret_scan
from memloom.llm import queries as q
from memloom.llm.ranks import positions, running_sums
from tests.compare import compare

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_octopus_manifest", "op13_trigram_secrets"])
def test_same_as_sql(spark, name):
    assert compare(spark, q.queries()[name], q.oracle_sql()[name], SF) > 0


class TestRanks:
    def test_one_key_with_most_rows(self, spark):
        random.seed(1)
        rows = [(i, "a" if random.random() < 0.7 else random.choice("bcd"), random.randint(0, 20)) for i in range(3000)]
        frame = spark.createDataFrame(rows, "row long, k string, x int").repartition(7)
        got = {r.row: r.pos for r in positions(frame, "k", ["x", "row"], "t").collect()}
        groups = defaultdict(list)
        for i, k, x in rows:
            groups[k].append((x, i))
        assert got == {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g))}

    def test_sums_across_blocks(self, spark):
        random.seed(2)
        rows = [(k, i, random.randint(0, 9)) for k, n in (("a", 1000), ("b", 5), ("c", 64)) for i in range(n)]
        got = {(r.k, r.i): r.s for r in running_sums(spark.createDataFrame(rows, "k string, i long, x long"), "k", "i", {"s": "x"}, block=64).collect()}
        want, total = {}, defaultdict(int)
        for k, i, x in rows:
            total[k] += x
            want[k, i] = total[k]
        assert got == want


def trie_of(turns):
    """The trie by brute force: (conv, turn, role, text) -> rows."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((-1 if t is None else t, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves[key] = sum(leaves[x] for x in kids[key]) if kids[key] else 1
        saved[key] = (len(members[key]) - 1) * words + sum(saved[x] for x in kids[key])
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], sha(",".join(str(c) for c in members[k] if len(built[c]) == len(k)))) for k in members)


TURNS = "conv_id long, turn long, role string, text string, depth string"


class TestPrefixTrie:
    def rows(self):
        random.seed(6)
        say = lambda: random.choice(["hi there", "", None, "ok", "a b\tc", "été\xa0x"])
        rows = [(c, t, random.choice(["user", "bot", None]), say(), "z") for c in range(0, 130) if c % 7 for t in range(random.randint(1, 5))]
        rows += [(200 + c, t, "user", "the one text", "z") for c in range(90) for t in range(3)]
        rows += [(400, t, "user", f"turn {t}", "z") for t in range(300)] + [(401, t, "user", f"turn {t}", "z") for t in range(299)]
        rows += [(500, None, "user", "first", "z"), (500, 4, "user", "second", "z"), (None, 1, "user", "x", "z"), (7003, 0, "user", "x", "z"), (601, 1, None, "w " * 100_000, "z")]
        return rows

    def check(self, spark, rows, **options):
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), **options)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(trie_of([r[:4] for r in rows]), key=str)

    def test_brute_force(self, spark):
        self.check(spark, self.rows())

    def test_fingerprints_that_meet_are_found_and_parted(self, spark):
        rows = [r for r in self.rows() if r[0] is None or r[0] < 400]
        placed = positions(prefix_trie.stored_turns(spark.createDataFrame(rows, TURNS)), "conv_id", ["turn", "h1", "h2", "row"], "t")
        prefixes = prefix_trie.rebuilt_prefixes(placed, 0, 5)
        nodes = prefix_trie.trie_nodes(prefixes)
        assert nodes.count() < len(trie_of([r[:4] for r in rows]))
        assert prefix_trie.differing(nodes, prefixes, spark.createDataFrame(rows, TURNS)).count() > 0
        self.check(spark, rows, modulus=5)
        with pytest.raises(ValueError, match="fingerprints"):
            prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), modulus=5, draws=1)

    def test_repeated_rows_turnless_and_empty(self, spark):
        rows = [(1, 0, "u", "a", ""), (1, 0, "u", "a", ""), (20, 0, "u", "a", ""), (21, 0, "u", "b", "")]
        self.check(spark, rows)
        lone = next(c for c in range(1, 500) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
        self.check(spark, [(lone, 0, "u", "a", "")])
        assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def manifest_of(rows):
    """Rows of the manifest by brute force."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda x: None if x is None else "".join(c.lower() if c.isascii() else c for c in x)
    leaf = lambda r: sha("".join(map(field, r)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in names}
    top = levels([built[k][-1][0] for k in names])

    def way(tree, at, value):
        siblings = []
        for level in tree[:-1]:
            first = at - at % 8
            run = list(level[first : first + 8])
            siblings += run[: at - first] + run[at - first + 1 :]
            run[at - first] = value
            value, at = sha("".join(run)), at // 8
        return siblings, value

    out = []
    for k in names:
        for at, (*_, own, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            claim = leaf((*r[:4], low(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            a, sub = way(built[k], at, claim)
            b, folded = way(top, names.index(k), sub)
            out.append((r[0], own, built[k][-1][0], top[-1][0], sha("".join(a + b)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string"


class TestMerkle:
    def docs(self):
        random.seed(8)
        text = lambda: random.choice([None, "", "Ärger UND Straße", "plain", "ABC" * 1000, "ßİ"])
        lang = lambda i: "en" if i % 3 else random.choice([None, "", "de", "é", "zz"])
        rows = [(i, random.choice(["a", None]), lang(i), random.choice([None, -5, i]), f"{i} {text()}") for i in range(2000)]
        rows += [(None, "a", "en", 1, "x"), (None, None, None, None, None), (5, "a", "en", 1, "x"), (5, "a", "en", 1, "x"), (5, "a", "en", 1, "Y" * 200_000)]
        return rows + [(9000 + i, "a", f"l{i:02}", 1, "Alone") for i in range(60)]

    def test_brute_force(self, spark):
        rows = self.docs()
        random.Random(3).shuffle(rows)
        got = merkle.verified_manifest(spark.createDataFrame([(*r, "own") for r in rows], DOCS)).collect()
        assert sorted(map(tuple, got), key=str) == manifest_of(rows)

    @pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65, 513])
    def test_sizes(self, spark, n):
        rows = [(i, "a", "en", 1, f"T{i}") for i in range(n)]
        got = merkle.verified_manifest(spark.createDataFrame([(*r, "own") for r in rows], DOCS)).collect()
        assert sorted(map(tuple, got), key=str) == (manifest_of(rows) if n else [])

    def test_proofs_of_a_few_leaves_fetch_the_fewest_nodes(self, spark):
        rows = [(i, "a", "en", 1, f"T{i}") for i in range(1300)]
        manifest = merkle.build(merkle.leaves_of(spark.createDataFrame([(*r, "own") for r in rows], DOCS)))
        few = manifest.leaves.where("pos IN (0, 3, 700, 1299)")
        got = {r.id: (r.proof_sha256, r.folded_root) for r in merkle.prove(manifest, few.withColumn("claim", F.col("leaf"))).collect()}
        want = {r[0]: (r[4], manifest.root) for r in manifest_of(rows) if r[0] in (0, 3, 700, 1299)}
        assert got == want
        # 0 and 3 share a run and all above it; level 3 has three nodes
        assert len(merkle.missing_coordinates([0, 3], 1300)) == 6 + 7 + 7 + 2
        assert set(merkle.missing_coordinates([0, 9], 64)) == {(0, x) for x in [*range(1, 9), *range(10, 16)]} | {(1, x) for x in range(2, 8)}


class TestSecrets:
    RULES = [*secret_scan.RULES, secret_scan.Rule("url", r"(https?|ftp)://[^/:@\x20]+:[^/:@\x20]+@")]

    def test_queries(self):
        query = secret_scan.trigram_query
        sets = lambda x: [{"".join(sorted(s)) for s in clause} for clause in x]
        assert sets(query("AKIA[A-Z0-9]+")) == [{"akikia"}]
        assert query("[0-9a-f]{24,}") == query("a|[0-9]+") == query("(abc)?d") == query("ab.cd") == []
        assert query("ABC.*def") == [[frozenset(["abc"])], [frozenset(["def"])]]
        assert query("(ab|xy)c+d") == [[frozenset(["abc"]), frozenset(["xyc"])]] or query("(ab|xy)c+d") == []
        assert query("(foo[0-9]+)+") == [[frozenset(["foo"])]]
        assert all(query(x.pattern) for x in secret_scan.RULES if x.kind != "hex")

    def test_index_loses_nothing(self, spark):
        random.seed(9)
        bits = ["password", "PassWd: ", "secret", "ToKen =", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "ghp_", "A" * 36, "xoxb-", "https://", "me:pw@", "\n", "ſecret: abcdefg", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", ".", "b_c-d123"]
        texts = ["".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(1500)] + [None, "", "x " * 100_000 + "token=abcdefgh", "password = hunter22"] * 2
        rows = [(i if i % 50 else None, t, "own") for i, t in enumerate(texts)] + [(9000 + i, "secret: 'abc/def='", "own") for i in range(700)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(5)
        got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in secret_scan.scan(frame, self.RULES).collect())

        def brute(text):
            found = []
            for k, rule in enumerate(self.RULES):
                found += [(k, *m.span()) for m in rule.compiled().finditer(text or "") if len(m.group(rule.group)) >= rule.least]
            return sorted(found, key=lambda x: (x[1], x[0]))

        assert got == sorted((str(i), brute(t)) for i, t, _ in rows)
        assert {s[0] for _, spans in got for s in spans} >= {0, 1, 2, 3, 4, 8, 9}

    def test_base_rules(self, spark):
        hexa = "0123456789abcdef"
        rows = [(1, "é token=abc password: 'abcdef' AKIA" + "A" * 16 + " AKIAB " + hexa + "01234567" + "g" + hexa), (2, None), (2, "SECRET=a_b.c-d")]
        got = sorted(map(tuple, secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        one = "assign:12:29,access:31:51,hex:58:82"
        assert got == [(1, 1, 1, 1, sha(one), one), (2, 0, 0, 0, sha(""), ""), (2, 1, 0, 0, sha("assign:0:14"), "assign:0:14")]

    def test_empty_table_and_no_index(self, spark):
        empty = spark.createDataFrame([], "doc_id long, text string")
        assert secret_scan.secrets(empty).count() == 0
        rows = spark.createDataFrame([(1, "f" * 30)], "doc_id long, text string")
        assert [tuple(s) for r in secret_scan.scan(rows, [secret_scan.BASE[2]]).collect() for s in r.spans] == [(0, 0, 30)]
