"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the head of a base conversation and a suffix of its own. Its texts are never put together:

1. Each turn is an element of a monoid, (length, value) with (k, v)(m, w) = (k + m, v + B^k w) modulo a prime,
   for four multipliers B. Running sums give the products of all stored prefixes.
2. A prefix of a rebuilt conversation is the product of a head of the base and a segment of the conversation, which comes
   from two stored prefixes by subtraction and a shift. Equal products at equal depth are one node of the trie.
3. Nodes are verified through the turns that they refer to: all members of a node must have one parent, and where they refer to
   different stored turns, those turns' roles and texts are compared. If any differ, the multipliers are changed.
4. The nodes whose smallest member is c lie on one path, from some depth down to the end of c. So sums over subtrees
   are sums over members: what hangs on such a path counts at every prefix of c above it, and running sums count along it.

Rows are numbers; texts are read for hashing, and those of nodes of several stored turns once more.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.ranks import positions, running_sums
from memloom.sources.scratch import drop, materialize

#: The fingerprints' modulus, and the number of multipliers: 124 bits.
MODULUS, WAYS = (1 << 31) - 1, 4
#: Turns of a head at most.
HEAD = 3
#: Conversations that share a base.
FAMILY = 20
#: Draws of multipliers, each used when those before it let different prefixes meet.
DRAWS = 3

NODE = ["depth", "f1", "f2"]


def multipliers(draw: int, modulus: int) -> list[int]:
    """The multipliers of a draw."""
    numbers = random.Random(draw)
    return [numbers.randrange(2, modulus - 1) for _ in range(WAYS)]


def power(base: int, exponent: Column, modulus: int) -> Column:
    """``base`` to a power (0 or more) modulo a prime, by squares."""
    squares = [base % modulus]
    while len(squares) < 48:
        squares.append(squares[-1] ** 2 % modulus)
    table = F.array(*(F.lit(x).cast("long") for x in squares))
    bits = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(exponent, F.lit(1)))).cast("int"))
    step = lambda product, i: F.when(F.getbit(exponent, i) == 1, product * F.get(table, i) % modulus).otherwise(product)
    return F.aggregate(bits, F.lit(1).cast("long"), step)


def _names(what: str) -> list[str]:
    return [f"{what}{i}" for i in range(WAYS)]


def _packed(values: list[Column]) -> tuple[Column, Column]:
    """Four residues of 31 bits as two numbers."""
    join = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
    return join(values[0], values[1]), join(values[2], values[3])


def stored_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, h1, h2, words, row``: the turns as numbers, from the tasks that read them. A stored table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return materialize(slim.withColumn("row", F.monotonically_increasing_id()), "turns")


def rebuilt_prefixes(placed: DataFrame, draw: int, modulus: int = MODULUS) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: ``conv_id, depth, f1, f2, p1, p2`` (node and parent), the words of its
    last turn, ``ends`` (the conversation is no longer), and the stored turn: ``ref_conv, ref_turn, h1, h2``.

    ``placed``: stored turns with ``pos``. Depth 0 has no turn.
    """
    bases = multipliers(draw, modulus)
    element = [F.pmod(F.xxhash64(F.lit(i), "h1", "h2"), F.lit(modulus)) for i in range(WAYS)]
    terms = placed.withColumns({f"t{i}": element[i] * power(bases[i], F.col("pos"), modulus) % modulus for i in range(WAYS)})
    summed = running_sums(terms, "conv_id", "pos", {f"s{i}": f"t{i}" for i in range(WAYS)})
    summed = summed.withColumns({f"s{i}": F.col(f"s{i}") % modulus for i in range(WAYS)})
    summed = materialize(summed.select("conv_id", "pos", "turn", "h1", "h2", "words", *_names("t"), *_names("s")), "products")

    first = F.when(F.col("pos") < HEAD, F.struct("pos", "turn", "h1", "h2", "words", *_names("s")))
    convs = summed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(first)).alias("own"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD + 1)).cast("int")
    convs = convs.withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    heads = convs.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("_head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("_head", F.lit(1), F.col("h")), F.slice("own", 1, 0)))
    convs = convs.withColumn("k", F.size("head"))
    at = lambda array, place, i: F.coalesce(F.get(F.col(array), place - 1)[f"s{i}"], F.lit(0))
    convs = convs.select(
        "conv_id", "base", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        *(at("head", F.col("k"), i).alias(f"a{i}") for i in range(WAYS)), *(at("own", F.col("h"), i).alias(f"o{i}") for i in range(WAYS)),
    )
    convs = materialize(convs, "conversations")

    zero = F.lit(0).cast("long")
    number = F.lit(None).cast("long")
    root = convs.select("conv_id", "length", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), number.alias("p1"), number.alias("p2"), zero.alias("words"), number.alias("ref_conv"), F.lit(None).cast(placed.schema["turn"].dataType).alias("ref_turn"), number.alias("h1"), number.alias("h2"))

    item = convs.select("conv_id", "length", "base", "head", F.explode("head").alias("x"))
    f, p = _packed([F.col(f"x.s{i}") for i in range(WAYS)]), _packed([F.when(F.col("x.pos") > 0, F.get("head", (F.col("x.pos") - 1).cast("int"))[f"s{i}"]).otherwise(0) for i in range(WAYS)])
    shared = item.select("conv_id", "length", (F.col("x.pos") + 1).alias("depth"), f[0].alias("f1"), f[1].alias("f2"), p[0].alias("p1"), p[1].alias("p2"), "x.words", F.col("base").alias("ref_conv"), F.col("x.turn").alias("ref_turn"), "x.h1", "x.h2")

    own = summed.join(convs.drop("base", "head"), "conv_id").where("pos >= h")
    back = [F.array(*(F.lit(pow(b, -e, modulus)).cast("long") for e in range(HEAD + 1))) for b in bases]
    product = lambda i, upto: (F.col(f"a{i}") + F.get(back[i], F.col("h") - F.col("k")) * F.pmod(upto - F.col(f"o{i}"), F.lit(modulus))) % modulus
    f, p = _packed([product(i, F.col(f"s{i}")) for i in range(WAYS)]), _packed([product(i, F.col(f"s{i}") - F.col(f"t{i}")) for i in range(WAYS)])
    suffix = own.select("conv_id", "length", (F.col("pos") + 1 - F.col("h") + F.col("k")).alias("depth"), f[0].alias("f1"), f[1].alias("f2"), p[0].alias("p1"), p[1].alias("p2"), "words", F.col("conv_id").alias("ref_conv"), F.col("turn").alias("ref_turn"), "h1", "h2")
    rows = root.unionByName(shared).unionByName(suffix).withColumn("ends", F.col("depth") == F.col("length")).drop("length")
    rows = materialize(rows, "prefixes")
    drop(summed, convs)
    return rows


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """The nodes: key, parent's key, members, words, how many members end there, and how far their members agree."""
    return prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.sum(F.col("ends").cast("long")).alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end_id"),
        *(F.min(x).alias(f"{x}") for x in ("p1", "p2")), *(F.max(x).alias(f"_{x}") for x in ("p1", "p2")),
        F.min("ref_conv").alias("_ref_low"), F.max("ref_conv").alias("_ref_high"),
    )


def differing(nodes: DataFrame, prefixes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes whose members aren't equal: of two parents, or of stored turns with different role or text.

    A conversation's turn is one stored turn at a depth, so only nodes of turns of several conversations fetch texts.
    """
    parents = nodes.where("p1 <> _p1 OR p2 <> _p2").select(*NODE)
    several = nodes.where("_ref_low < _ref_high").select(*NODE)
    refs = prefixes.join(several, NODE, "left_semi").select(*NODE, "ref_conv", "ref_turn", "h1", "h2").distinct()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    stored = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").alias("_turn"), role.alias("role"), text.alias("text"), F.xxhash64(F.lit(1), role, text).alias("_h1"), F.xxhash64(F.lit(2), role, text).alias("_h2"))
    same = (F.col("ref_conv") == F.col("_conv")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("ref_turn").eqNullSafe(F.col("_turn"))
    read = refs.join(stored, same).groupBy(*NODE).agg(F.min("role").alias("r"), F.max("role").alias("_r"), F.min("text").alias("t"), F.max("text").alias("_t"))
    return parents.unionByName(read.where("r <> _r OR t <> _t").select(*NODE))


def _lists(batches):
    """The ids of each node in a batch as one text. Rows are sorted by node and id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(x).to_numpy() for x in NODE]
        change = np.zeros(batch.num_rows, bool)
        for x in columns:
            change[1:] |= x[1:] != x[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        ids = batch.column("conv_id").to_pylist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[starts]) for x in columns), batch.column("conv_id").take(pa.array(starts)), pa.array(texts)], names=[*NODE, "first", "ids"])


def _digests(batches):
    """The digest of each node's texts, joined by commas. Rows are sorted by node and first id."""
    key, state = None, None
    row = lambda: pa.RecordBatch.from_pylist([dict(zip(NODE, key, strict=True)) | {"digest": state.hexdigest()}], schema=pa.schema([*((x, pa.int64()) for x in NODE), ("digest", pa.string())]))
    for batch in batches:
        for *node, text in zip(*(batch.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
            if node != key:
                if key is not None:
                    yield row()
                key, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key is not None:
        yield row()


def end_digests(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``depth, f1, f2, digest`` of the nodes where several members end: SHA-256 of their ids in order, joined by commas.

    Ids are sorted and joined by ranges, so a node of very many members spreads over tasks; only the joined texts
    of a node go through one digest, a batch of some thousand ids at a time.
    """
    several = nodes.where("n_ends > 1").select(*NODE)
    ends = prefixes.where("ends").select(*NODE, "conv_id").join(several, NODE, "left_semi")
    kind = "depth long, f1 long, f2 long"
    lists = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_lists, f"{kind}, first long, ids string")
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, f"{kind}, digest string")


def prefix_trie(turns: DataFrame, modulus: int = MODULUS, draws: int = DRAWS) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    ``turns``: conv_id, turn, role, text. Conversations are ordered by turn, null first, equal ones by a hash of their content; a null role
    or text counts as empty; rows with a null conv_id are left out; a repeated row is a turn of its own. Conversation c is rebuilt
    from the first h turns of conversation c - c % 20, h being crc32 of c's digits % 4, and its own turns after the first h.
    Returns per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. An empty table gives no rows, not even the root, which has no members then. Lengths and numbers of
    members are not bounded. Different prefixes that meet in one fingerprint are found and parted by other multipliers; a
    ValueError is raised when no draw parts them.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    slim = stored_turns(rows)
    placed = positions(slim, "conv_id", ["turn", "h1", "h2", "row"], "places").drop("row")
    for draw in range(draws):
        prefixes = rebuilt_prefixes(placed, draw, modulus if draw == 0 else MODULUS)
        nodes = materialize(trie_nodes(prefixes), "nodes")
        if differing(nodes, prefixes, rows).isEmpty():
            break
        drop(prefixes, nodes)
    else:
        raise ValueError("different prefixes have equal fingerprints")

    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = nodes.join(kids, NODE, "left").select(*NODE, "conv_id", "p1", "p2", "n_convs", "n_ends", "end_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    valued = materialize(valued, "valued-nodes")
    paths = valued.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("all_leaf"), F.sum("saved").alias("all_saved"))
    joining = prefixes.select("conv_id", *NODE).join(paths, "conv_id").where("depth < top").groupBy(*NODE).agg(F.sum("all_leaf").alias("in_leaf"), F.sum("all_saved").alias("in_saved"))
    along = running_sums(valued, "conv_id", "depth", {"upto_leaf": "leaf", "upto_saved": "saved"}).join(paths, "conv_id")
    below = lambda x: F.col(f"all_{x}") - F.col(f"upto_{x}") + F.col(x) + F.coalesce(f"in_{x}", F.lit(0))
    parents = valued.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = along.join(joining, NODE, "left").join(end_digests(valued, prefixes), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    alone = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).otherwise(F.sha2(F.col("end_id").cast("string"), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", below("leaf").alias("n_leaves"), below("saved").alias("saved_tokens"), F.coalesce("digest", alone).alias("ends_sha256"))


# CRC-32 in DuckDB: a fold over the bits of the digits, lowest bit of each byte first. Fixed value: the reversed polynomial.
CRC32 = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(({x})::VARCHAR, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch)::BIGINT >> b) & 1)))), lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)::BIGINT)"


def crc32_sql(x: str) -> str:
    """The unsigned CRC-32 of a number's digits in DuckDB SQL."""
    return f"xor({CRC32.format(x=x)}, 4294967295)"


#: The same rows in DuckDB SQL, prefixes being lists of texts, for conversations whose turns are numbered once each.
DUCKDB_SQL = f"""
WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  h AS (SELECT c.conv_id, c.l, b.l AS base, {crc32_sql('c.conv_id')} % 4 AS h FROM t c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20),
  r AS (SELECT conv_id, list_concat(coalesce(base, [])[1:h], l[h + 1:]) AS l FROM h),
  p AS (SELECT conv_id, d AS depth, sha256(l[1:d]::JSON::VARCHAR) AS k, sha256(l[1:d - 1]::JSON::VARCHAR) AS pk, d = len(l) AS ends,
    CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
    FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM r)),
  n AS (SELECT depth, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY ALL),
  c AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
  v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.depth = n.depth AND c.k = n.k),
  s AS (SELECT p.depth, p.k, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens
    FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.k = v.k LEFT JOIN v u ON u.depth = v.depth - 1 AND u.k = v.pk"""
