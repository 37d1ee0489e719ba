"""Merkle manifest of a dataset, and proofs for many of its rows at once (octopus multiproof).

Every row is a leaf, every language a tree of its leaves in order of id, and the roots of these trees are the leaves
of one more tree. A node is the digest of up to eight consecutive nodes below it.

* Leaves are placed by ranges (``ranks.positions``), so a language of any size spreads over tasks.
* Nodes are derived three levels at a time from blocks of 512 consecutive nodes, each block one row.
* For proofs, leaves are gathered in leaf partitions of up to 512 places. Each works out, level by level, the smallest union of
  coordinates of nodes that its proofs need and that it can't derive from its own leaves; fetches these once;
  derives the interior nodes that its proofs share; and expands every single proof in its own task.

The digest of a row is worked out where the row is read; only digests go through shuffles.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.arrow_text import tidy
from memloom.llm.prefix_trie import crc32_sql
from memloom.llm.ranks import positions
from memloom.sources.scratch import drop, materialize

#: Nodes below a node, and levels that a block holds above its own.
FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: Columns of a row that its leaf covers, in order.
COVERED = ["doc_id", "source", "lang", "n_chars", "text"]

#: Trees are named by their language behind a mark, the tree without language by the empty text, so that names sort null first.
NAMED = "="


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lower-case hex) of fields: ``-`` for null, else the length in bytes, ``:`` and the value as text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Manifest:
    """``leaves``: the rows with ``pos``. ``nodes``: tree, level, pos, hash of all nodes, the leaves being level 0. ``trees``: tree, n (leaves),
    subroot, top_pos. The tree of subroots is called ``TOP`` and has ``n_trees`` leaves; ``root`` is its root, None without rows.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


#: Name of the tree of subroots; no language's name starts like this.
TOP = "*"


def _sizes(n: Column, levels: int) -> list[Column]:
    """The number of nodes of a tree of n leaves at each level."""
    out = [n]
    for _ in range(levels):
        out.append(F.floor((out[-1] + FANOUT - 1) / F.lit(FANOUT)))
    return out


def _above(hashes: Column) -> Column:
    """The digests of runs of ``FANOUT`` neighbours."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / F.lit(FANOUT)).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(hashes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def interior(leaves: DataFrame, counts: DataFrame, largest: int) -> DataFrame:
    """``tree, level, pos, hash`` of ``leaves`` (tree, pos, hash) as level 0, and of the nodes above them. ``counts``: tree, n; the largest n is ``largest``.

    Blocks of 512 neighbours give three levels at once, so the rounds are few, and each reads 1/512 of the one before.
    """
    made, level = [], 0
    rows = leaves.join(counts, "tree").select("tree", "n", "pos", "hash")
    while largest > 1:
        blocks = rows.groupBy("tree", "n", F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("x"))
        lists = blocks.select("tree", "n", "block", F.col("x.hash").alias("h0"))
        for k in range(LEVELS):
            lists = lists.withColumn(f"h{k + 1}", _above(F.col(f"h{k}")))
        sizes = _sizes(F.col("n"), LEVELS)
        entry = lambda k: F.transform(F.when(sizes[k - 1] > 1, F.col(f"h{k}")).otherwise(F.array().cast("array<string>")), lambda h, i: F.struct(F.lit(level + k).alias("level"), (F.col("block") * FANOUT ** (LEVELS - k) + i).alias("pos"), h.alias("hash")))  # noqa: B023, E731
        found = lists.select("tree", sizes[LEVELS].alias("n"), F.explode(F.concat(*(entry(k) for k in range(1, LEVELS + 1)))).alias("x")).select("tree", "n", "x.*")
        made.append(materialize(found, "nodes"))
        level += LEVELS
        largest = -(-largest // BLOCK)
        rows = made[-1].where(F.col("level") == level)
    out = leaves.select("tree", F.lit(0).alias("level"), "pos", "hash")
    for nodes in made:
        out = out.unionByName(nodes.select("tree", "level", "pos", "hash"))
    return out


def height(n: Column) -> Column:
    """The level of the root of a tree of n leaves."""
    powers = F.array(*(F.lit(FANOUT**k).cast("long") for k in range(1, 21)))
    return F.when(n <= 1, 0).otherwise(1 + F.size(F.filter(powers, lambda x: x < n)))


def build(leaves: DataFrame) -> Manifest:
    """The manifest of stored leaves: ``tree`` (name), ``id``, ``leaf``, ``row`` (different numbers) and others.

    Leaves of a tree are in order of id, null first, equal ids of the digest.
    """
    placed = materialize(positions(leaves, "tree", ["id", "leaf", "row"], "leaves-in-order"), "placed-leaves")
    counts = materialize(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "trees")
    size = counts.agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("trees")).first()
    numbered = placed.select("tree", "pos", F.col("leaf").alias("hash"))
    below = interior(numbered, counts, size.largest or 0)
    roots = counts.withColumns({"level": height(F.col("n")), "pos": F.lit(0).cast("long")}).join(below, ["tree", "level", "pos"])
    roots = materialize(roots.select(F.lit(TOP).alias("top"), "tree", "n", F.col("hash").alias("subroot")), "subroots")
    trees = positions(roots, "top", ["tree"], "trees-in-order")
    trees = materialize(trees.select("tree", "n", "subroot", F.col("pos").alias("top_pos")), "placed-trees")
    tops = trees.select(F.lit(TOP).alias("tree"), F.col("top_pos").alias("pos"), F.col("subroot").alias("hash"))
    above = interior(tops, tops.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), size.trees)
    root = above.orderBy(F.col("level").desc()).first()
    drop(counts, roots)
    return Manifest(placed, below.unionByName(above), trees, size.trees, root and root.hash)


def _height(n: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // FANOUT), level + 1
    return level


def missing_coordinates(places: list[int], n: int) -> list[tuple[int, int]]:
    """The fewest (level, place) of a tree of n leaves that proofs of the leaves at ``places`` need and that can't be derived from those leaves."""
    have, need, level = sorted(set(places)), [], 0
    while n > 1:
        own, parents = set(have), sorted({x // FANOUT for x in have})
        need += [(level, x) for p in parents for x in range(p * FANOUT, min(n, (p + 1) * FANOUT)) if x not in own]
        have, n, level = parents, -(-n // FANOUT), level + 1
    return need


def _coordinates(batches):
    """The missing coordinates of each leaf partition: in its own tree, and above it in the tree of subroots."""
    for batch in batches:
        out = []
        for tree, part, n, top_pos, n_trees, leaves in zip(*(batch.column(x).to_pylist() for x in ("tree", "part", "n", "top_pos", "n_trees", "places")), strict=True):
            out += [(tree, part, tree, level, pos) for level, pos in missing_coordinates(leaves, n)]
            out += [(tree, part, TOP, level, pos) for level, pos in missing_coordinates([top_pos], n_trees)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["tree", "part", "of", "level", "pos"])


def _digest(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


class _Path:
    """Nodes of a tree of n leaves that a leaf partition knows: fetched ones, and interior ones that it derives from its leaves."""

    def __init__(self, n: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.n, self.known = n, fetched | {(0, x): h for x, h in leaves.items()}
        have, size, level = sorted(leaves), n, 0
        while size > 1:
            have = sorted({x // FANOUT for x in have})
            for p in have:
                self.known[level + 1, p] = _digest([self.known[level, x] for x in range(p * FANOUT, min(size, (p + 1) * FANOUT))])
            size, level = -(-size // FANOUT), level + 1
        self.root = self.known[level, 0]

    def siblings(self, place: int) -> list[str]:
        """The other nodes of each run on the way to the root, level by level."""
        out, size, level = [], self.n, 0
        while size > 1:
            first = place - place % FANOUT
            out += [self.known[level, x] for x in range(first, min(size, first + FANOUT)) if x != place]
            place, size, level = place // FANOUT, -(-size // FANOUT), level + 1
        return out

    def fold(self, place: int, value: str) -> str:
        """The root that a leaf of ``value`` at ``place`` gives with the siblings of that place. From where the node is the known one, so is the rest."""
        size, level = self.n, 0
        while size > 1 and self.known[level, place] != value:
            first = place - place % FANOUT
            value = _digest([value if x == place else self.known[level, x] for x in range(first, min(size, first + FANOUT))])
            place, size, level = place // FANOUT, -(-size // FANOUT), level + 1
        return self.root if size > 1 else value


def _expand(batches):
    """The proof of every leaf of each leaf partition, and the root that its claim folds to."""
    for batch in batches:
        columns = [[] for _ in PROOF]
        for tree, n, top_pos, n_trees, rows, fetched in zip(*(batch.column(x).to_pylist() for x in ("tree", "n", "top_pos", "n_trees", "rows", "fetched")), strict=True):
            own, top = {}, {}
            for x in fetched or ():
                (top if x["of"] == TOP else own)[x["level"], x["pos"]] = x["hash"]
            path = _Path(n, {x["pos"]: x["leaf"] for x in rows}, own)
            above = _Path(n_trees, {top_pos: path.root}, top)
            upper = above.siblings(top_pos)
            for x in rows:
                proof, folded = _digest(path.siblings(x["pos"]) + upper), above.fold(top_pos, path.fold(x["pos"], x["claim"]))
                for column, value in zip(columns, (tree, x["pos"], x["id"], x["leaf"], proof, folded), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PROOF.values(), strict=True)], names=list(PROOF))


PROOF = {"tree": pa.string(), "pos": pa.int64(), "id": pa.int64(), "leaf": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string()}


def prove(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """Proofs of some leaves or all: ``wanted`` has tree, pos, id, leaf and ``claim`` (the leaf that is claimed), each place once.

    Returns tree, pos, id, leaf, ``proof_sha256`` (digest of the siblings up to the root) and ``folded_root``, what the claim and the
    siblings give. Nodes asked for by very many leaf partitions are those near the root; Spark splits these keys of the join.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "leaf", "claim")))
    parts = wanted.groupBy("tree", F.floor(F.col("pos") / F.lit(BLOCK)).alias("part")).agg(rows.alias("rows"))
    parts = parts.join(manifest.trees.select("tree", "n", "top_pos"), "tree").withColumn("n_trees", F.lit(manifest.n_trees).cast("long"))
    parts = materialize(parts, "leaf-partitions")
    asked = parts.select("tree", "part", "n", "top_pos", "n_trees", F.col("rows.pos").alias("places"))
    asked = materialize(asked.mapInArrow(tidy(_coordinates), "tree string, part long, of string, level int, pos long"), "coordinates")
    levels = asked.select("level").distinct()  # as many as a tree is high
    nodes = manifest.nodes.withColumnRenamed("tree", "of").join(F.broadcast(levels), "level", "left_semi")
    fetched = asked.join(nodes, ["of", "level", "pos"]).groupBy("tree", "part").agg(F.collect_list(F.struct("of", "level", "pos", "hash")).alias("fetched"))
    whole = parts.join(fetched, ["tree", "part"], "left").select("tree", "n", "top_pos", "n_trees", "rows", "fetched")
    return whole.mapInArrow(tidy(_expand), "tree string, pos long, id long, leaf string, proof_sha256 string, folded_root string")


def leaves_of(documents: DataFrame) -> DataFrame:
    """``tree, id, leaf, claim, row`` of documents, a stored table. A claim is the leaf of the row, or of the row with its text's A to Z in lower
    case where 3 divides the unsigned CRC-32 of the id's digits.
    """
    fields = [F.col(x) for x in COVERED]
    leaf = leaf_digest(fields)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claim = F.when(tampered, leaf_digest([*fields[:-1], lower_ascii(F.col("text"))]))
    rows = documents.select(F.coalesce(F.concat(F.lit(NAMED), "lang"), F.lit("")).alias("tree"), F.col("doc_id").alias("id"), leaf.alias("leaf"), claim.alias("claim"))
    return materialize(rows.withColumn("claim", F.coalesce("claim", "leaf")).withColumn("row", F.monotonically_increasing_id()), "leaves")


def verified_manifest(documents: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a row that may be tampered with still folds to the root.

    ``documents``: doc_id, source, lang, n_chars, text, each of which may be null; others are left alone. Returns per row: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified. Rows of a language without id come first; rows that repeat an id are leaves of their own in
    order of their digest. A null id is never tampered with. An empty table gives no rows.
    """
    manifest = build(leaves_of(documents.select(*COVERED)))
    proofs = prove(manifest, manifest.leaves)
    out = proofs.join(manifest.trees.select("tree", "subroot"), "tree").withColumn("root", F.lit(manifest.root).cast("string"))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(x=x) for x in (*COVERED[:-1], text))})"


#: The same rows in DuckDB SQL.
DUCKDB_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {crc32_sql('doc_id')} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim FROM documents),
  l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
  a AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM l
    UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM a WHERE n > 1 GROUP BY tree, level, n, pos // 8),
  s AS (SELECT tree, h AS subroot, level AS top, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
  b AS (SELECT 0 AS level, pos, subroot AS h, n FROM s
    UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM b WHERE n > 1 GROUP BY level, n, pos // 8),
  w AS (SELECT l.tree, l.pos, l.doc_id, l.leaf, coalesce(l.claim, l.leaf) AS claim, s.subroot, s.pos AS top_pos, s.top FROM l JOIN s USING (tree)),
  x AS (SELECT w.tree, w.pos, a.level, a.pos AS place, a.h FROM w JOIN a ON a.tree = w.tree AND a.level < w.top AND a.pos // 8 = w.pos // (8 ** (a.level + 1))::BIGINT
    UNION ALL SELECT w.tree, w.pos, w.top + b.level, b.pos, b.h FROM w JOIN b ON b.n > 1 AND b.pos // 8 = w.top_pos // (8 ** (b.level + 1))::BIGINT),
  y AS (SELECT w.tree, w.pos, x.level, x.place, x.h, x.place = CASE WHEN x.level < w.top THEN w.pos // (8 ** x.level)::BIGINT ELSE w.top_pos // (8 ** (x.level - w.top))::BIGINT END AS own FROM w JOIN x ON x.tree = w.tree AND x.pos = w.pos),
  p AS (SELECT tree, pos, sha256(coalesce(string_agg(h, '' ORDER BY level, place) FILTER (NOT own), '')) AS proof FROM y GROUP BY ALL),
  r AS (SELECT tree, pos, level, coalesce(string_agg(h, '' ORDER BY place) FILTER (NOT own AND place < mine), '') AS lo, coalesce(string_agg(h, '' ORDER BY place) FILTER (NOT own AND place > mine), '') AS hi
    FROM (SELECT *, max(place) FILTER (own) OVER (PARTITION BY tree, pos, level) AS mine FROM y) GROUP BY ALL),
  f AS (SELECT tree, pos, 0 AS level, claim AS v FROM w
    UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(r.lo || f.v || r.hi) FROM f JOIN r ON r.tree = f.tree AND r.pos = f.pos AND r.level = f.level),
  g AS (SELECT tree, pos, max_by(v, level) AS folded FROM f GROUP BY ALL)
SELECT w.doc_id, w.leaf, w.subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, g.folded AS folded_root, g.folded = t.h AS verified
FROM w JOIN g ON g.tree = w.tree AND g.pos = w.pos LEFT JOIN p ON p.tree = w.tree AND p.pos = w.pos, (SELECT h FROM b WHERE n = 1) t"""
