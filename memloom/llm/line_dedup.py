"""Removing repeated and nearly repeated lines by a segment-partition edit join.

Two lines within ``tau`` edits share at least one of tau + 1 segments: cut the shorter line into
tau + 1 even segments, and one of them stands unchanged in the longer line, shifted by few places.
So each line is indexed under its segments (keyed by its length and the segment's number) and
probes, for each length from its own down to tau less, the few substrings that the shift allows.
Lines that meet under a key are verified with a banded bit-parallel edit distance, after their
common ends are cut off.

Everything is a DataFrame or SQL expression; no Python runs on executors. Keys are 64-bit hashes;
only keys that two different lines share keep their rows, and only their lines' texts are
fetched; a bitmap of them, sized by their number and broadcast if that is within a bound, sorts out most others without a shuffle. Lines under a key are dealt into blocks of bounded size and compared block by block inside
an expression, so no row is made for a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.columns import set_aside
from memloom.sources.scratch import materialize

#: Edits within which a line repeats another; shortest line that the edit probes take (code points).
TAU, MIN_CHARS = 2, 24
#: Lines of a block.
BLOCK = 128


def segment(i: str, tau: int, length: str) -> tuple[str, str]:
    """SQL of the first place (from 0) and the length of segment ``i`` (from 1) of a line of ``length``.

    The last (length mod tau + 1) segments are one longer than the others.
    """
    base, longer = f"(({length}) div {tau + 1})", f"(({length}) % {tau + 1})"
    return f"(({i} - 1) * {base} + greatest(0, {i} - 1 - ({tau + 1} - {longer})))", f"({base} + if({i} > {tau + 1} - {longer}, 1, 0))"


def probe_shifts(i: int, difference: int, tau: int) -> range:
    """Shifts of segment i at which a line that is ``difference`` longer need be probed.

    Some alignment of at most tau edits has at most i - 1 of them before its first unchanged
    segment i and at most tau + 1 - i behind it.
    """
    return range(max(1 - i, difference - (tau + 1 - i)), min(i - 1, difference + (tau + 1 - i)) + 1)


def keyed_lines(source: DataFrame, tau: int, least: int) -> DataFrame:
    """``key, own, h1, h2`` of every line: own is 1 for keys that it is indexed under, 0 for those it only probes.

    One small expression for each (line, probe) row: written out for all probes of a line, it would be
    too long a method for the JVM to compile.
    """
    every = [(d, i, shift) for d in range(tau + 1) for i in range(1, tau + 2) for shift in probe_shifts(i, d, tau)]
    probe = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for d, i, shift in every)))
    # in ASCII a place is a byte: no need to walk along the line from its start for every probe
    plain = F.expr("CASE WHEN octet_length(line) = len THEN cast(line AS binary) END")
    rows = lines_of(source, least, "line", "len").withColumn("plain", plain).withColumn("p", probe)
    at, size = segment("p.i", tau, "(len - p.d)")
    part = f"int({at} + p.shift + 1), int({size})"
    key = f"xxhash64(p.i, len - p.d, coalesce(substring(plain, {part}), cast(substring(line, {part}) AS binary)))"
    return rows.select(F.expr(key).alias("key"), F.expr("if(p.d = 0 AND p.shift = 0, 1, 0)").alias("own"), "h1", "h2")


#: Words of 64 bits in a row of the filter of shared keys; its bits at least (2 MB) and at most (32 MB).
ROW_WORDS, LEAST_FILTER_BITS, MOST_FILTER_BITS = 512, 1 << 24, 1 << 28


def filter_bits(keys: int) -> int | None:
    """Bits of a filter of so many keys, a power of two: 64 a key where the bounds allow; None if they leave less than 8, which would sort out too little."""
    bits = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, 1 << (64 * keys - 1).bit_length())) if keys else LEAST_FILTER_BITS
    return bits if bits >= 8 * keys else None


def _slot(bits: int, key: str = "key") -> dict[str, str]:
    """SQL of the row, word and bit of a key in a filter of so many bits."""
    slot = f"pmod({key}, {bits}L)"
    return {"row": f"int({slot} div {64 * ROW_WORDS})", "word": f"int({slot} % {64 * ROW_WORDS} div 64)", "bit": f"int({slot} % 64)"}


def key_filter(keys: DataFrame, bits: int) -> DataFrame:
    """A bitmap of ``keys`` (column ``key``): ``row`` and ``words``, at most bits / (64 ROW_WORDS) rows."""
    at = _slot(bits)
    words = keys.groupBy(F.expr(at["row"]).alias("row"), F.expr(at["word"]).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {at['bit']}))").alias("bits"))
    rows = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return rows.select("row", F.expr(f"transform(sequence(0, {ROW_WORDS - 1}), w -> coalesce(try_element_at(m, w), 0L))").alias("words"))


_POWERS = "array(" + ", ".join(str(1 << e) for e in range(22, -1, -1)) + ")"


def within_edits(a: str, b: str, tau: int = TAU) -> str:
    """SQL: whether the edit distance of two strings is at most ``tau``.

    Common ends are found by doubling steps and cut off. The rest runs through the bit-parallel
    recurrence on a band of 2 tau + 1 diagonals: bit k of column j stands for row j - tau + k, ``vp``
    and ``vn`` hold the vertical differences, ``d`` the distance on the lower edge of the band and
    then on the last row. A band all of whose values exceed tau changes no more.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    first = full & ~((1 << tau) - 1)
    match = " + ".join(f"if(coalesce(get(t.x, s.j + {k - tau}) = c, false), {1 << k}, 0)" for k in range(width))
    step = f"""
      CASE WHEN s.d - bit_count(s.vp) > {tau} THEN s ELSE
        get(transform(array({match}), pm ->
        get(transform(array(((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {full}), d0 ->
        get(transform(array((s.vn | ~(d0 | s.vp)) & {full}), hp ->
          named_struct(
            'j', s.j + 1,
            'vp', ((d0 & s.vp) | ~(shiftright(d0, 1) | hp)) & {full},
            'vn', shiftright(d0, 1) & hp,
            'd', CASE WHEN s.j + 1 + {tau} <= t.m THEN s.d + 1 - (shiftright(d0, {2 * tau}) & 1)
                 ELSE s.d + (shiftright(hp, t.m - s.j - 1 + {tau}) & 1) - (shiftright(d0 & s.vp, t.m - s.j - 1 + {tau}) & 1) END)
        ), 0)), 0)), 0) END"""
    band = f"""
      exists(array(named_struct('x', split(u.x, ''), 'y', split(u.y, ''), 'm', char_length(u.x))), t ->
        aggregate(t.y, named_struct('j', 0, 'vp', {first}, 'vn', 0, 'd', least({tau}, t.m)), (s, c) -> {step}, s -> s.d <= {tau}))"""
    ends = f"aggregate({_POWERS}, 0, (n, k) -> if(n + k <= {{limit}} AND {{left}} = {{right}}, n + k, n))"
    prefix = ends.format(limit="p.m", left="substring(p.a, n + 1, k)", right="substring(p.b, n + 1, k)")
    suffix = ends.format(limit="q.m - q.n", left="substring(q.a, q.la - n - k + 1, k)", right="substring(q.b, q.lb - n - k + 1, k)")
    return f"""
    CASE WHEN abs(char_length({a}) - char_length({b})) > {tau} THEN false ELSE
      exists(array(named_struct('a', {a}, 'b', {b}, 'la', char_length({a}), 'lb', char_length({b}), 'm', least(char_length({a}), char_length({b})))), p ->
      exists(array(named_struct('a', p.a, 'b', p.b, 'la', p.la, 'lb', p.lb, 'm', p.m, 'n', {prefix})), q ->
      exists(array(named_struct('q', {suffix})), e ->
      exists(array(named_struct('x', substring(q.a, q.n + 1, q.la - q.n - e.q), 'y', substring(q.b, q.n + 1, q.lb - q.n - e.q))), u ->
        u.x = '' OR u.y = '' OR {band})))) END"""


def lines_of(docs: DataFrame, least: int, *more: str, short: bool = False) -> DataFrame:
    """``id, rid, no, h1, h2`` and ``more`` of every line of at least ``least`` code points, and with ``short`` of shorter ones that are not blank.

    rid is a hash of id and text, so that rows that repeat an id are told apart; (h1, h2) stands
    for the line.
    """
    exploded = docs.select("id", F.xxhash64("id", "text").alias("rid"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    taken = (F.col("len") >= least) | F.col("line").rlike(r"\S") if short else F.col("len") >= least
    exploded = exploded.withColumn("len", F.char_length("line")).where(taken)
    return exploded.select("id", "rid", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *more)


def _near_repeats(source: DataFrame, first: DataFrame, tau: int, least: int) -> DataFrame:
    """``h1, h2`` of lines within ``tau`` edits of a different line that comes before them.

    ``first``: h1, h2 and ``at``, the place of the first row of each line.
    """
    keyed = keyed_lines(source, tau, least)
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("own").alias("own")).where("low <> high AND own = 1").select("key")
    shared = materialize(shared, "line-keys")
    # few keys are shared: a bitmap of them drops most other rows before any shuffle, the join drops the rest
    likely, bits = keyed, filter_bits(shared.count())
    if bits:
        at, bitmap = _slot(bits), F.broadcast(materialize(key_filter(shared, bits), "line-filter"))
        set_there = F.expr(f"(shiftright(get(words, {at['word']}), {at['bit']}) & 1) = 1")
        likely = keyed.join(bitmap, (F.expr(at["row"]) == F.col("row")) & set_there).select("key", "own", "h1", "h2")
    hits = likely.groupBy("key", "h1", "h2").agg(F.max("own").alias("own")).join(shared, "key")
    hits = materialize(hits, "line-hits")

    wanted = hits.select("h1", "h2").distinct().join(first, ["h1", "h2"]).select("h1", "h2", "at")
    wanted = materialize(wanted, "line-wanted")
    texts = lines_of(source, least, "line").withColumn("at", F.struct("id", "rid", "no")).select("h1", "h2", "at", "line").join(wanted, ["h1", "h2", "at"])
    texts = materialize(texts.dropDuplicates(["h1", "h2"]), "line-texts")

    sizes = hits.groupBy("key").agg(F.ceil(F.sum("own") / BLOCK).cast("int").alias("n_own"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_all"))
    members = hits.join(texts, ["h1", "h2"]).join(sizes, "key")
    members = materialize(members.withColumn("member", F.struct("at", "h1", "h2", "line", "own")), "line-members")
    block = lambda n: F.pmod("h1", F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = members.where("own = 1").select("key", block("n_own").alias("x"), spread("n_all").alias("y"), "member").groupBy("key", "x", "y").agg(F.sort_array(F.collect_list("member")).alias("own"))
    every = members.select("key", block("n_all").alias("y"), spread("n_own").alias("x"), "member").groupBy("key", "x", "y").agg(F.sort_array(F.collect_list("member")).alias("every"))
    close = within_edits("r.line", "v.line", tau)
    # two lines that are both indexed under the key are compared by the first part already
    later = f"""concat(
      filter(every, v -> exists(own, r -> r.at < v.at AND {close})),
      filter(own, v -> exists(every, r -> r.own = 0 AND r.at < v.at AND {close})))"""
    return own.join(every, ["key", "x", "y"]).select(F.explode(F.expr(later)).alias("v")).select("v.h1", "v.h2").distinct()


def dedup_lines(docs: DataFrame, tau: int = TAU, least: int = MIN_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with lines dropped from their texts that repeat an earlier line, and ``n_dropped_lines`` (long).

    Lines are what stands between line feeds. Lines are in order of the id (null first), then of their place;
    of equal lines all but the first go, and a line goes if a different line within ``tau`` edits
    first stands before its own first place. Lines shorter than ``least`` code points go only as equal lines,
    and stay if they are blank. Lines are taken as equal when two 64-bit hashes are. Null texts stay null, and a text may become empty. Rows equal in id
    and text are treated alike. An empty table gives no rows. Further columns pass through, whatever their names;
    one named as the added one is replaced.
    """
    given, names = docs, ["n_dropped_lines", "_own", "_id", "_rid", "_gone", "_lines"]
    docs, _ = set_aside(given, names)
    id_column, text_column = (docs.columns[given.columns.index(x)] for x in (id_column, text_column))
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    places = lines_of(source, least, short=True)
    # a struct of place is no plain number: sorted, not hashed, but these rows are slim
    first = materialize(places.groupBy("h1", "h2").agg(F.min(F.struct("id", "rid", "no")).alias("at"), F.count(F.lit(1)).alias("n")), "line-first")
    near = materialize(_near_repeats(source, first, tau, least), "line-near").withColumn("near", F.lit(True))

    marked = first.join(near, ["h1", "h2"], "left").where("n > 1 OR near")
    gone = places.join(marked, ["h1", "h2"]).where(F.col("near") | (F.struct("id", "rid", "no") != F.col("at")))
    gone = gone.groupBy("id", "rid").agg(F.collect_set("no").alias("_gone"))
    gone = materialize(gone.withColumnRenamed("id", "_id").withColumnRenamed("rid", "_rid"), "lines-gone")

    out = docs.withColumn("_own", F.xxhash64(id_column, text_column))
    out = out.join(gone, (F.col("_own") == F.col("_rid")) & F.col(id_column).eqNullSafe(F.col("_id")), "left")
    kept = "array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> get(_lines, i)), '\n')"
    out = out.withColumn("_lines", F.split(text_column, "\n"))
    out = out.withColumns({text_column: F.when(F.col("_gone").isNull(), F.col(text_column)).otherwise(F.expr(kept)), "n_dropped_lines": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})
    kept_columns = [F.col(f"`{x}`").alias(y) for x, y in zip(docs.columns, given.columns, strict=True) if y.lower() != "n_dropped_lines"]
    return out.select(*kept_columns, "n_dropped_lines")
