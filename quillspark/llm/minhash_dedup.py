"""MinHash near-duplicates by a signature-coordinate inverted join.

1. One pass makes, per document, the number of distinct five-word shingles, a
   128-bit hash of the shingle set, and a signature of ``coords`` minima.
2. Documents of equal sets collapse into classes; the least doc_id represents.
3. Each representative is posted under its (coordinate, value) pairs.  Two
   signatures that agree on at least ``matches`` of the coordinates must share one
   of the ``coords - matches + 1`` pairs that are rarest in either (prefix merging),
   so only those are posted, and pairs that no one shares are dropped.
4. Lists are merged in rounds.  A list whose members already are one component is
   skipped (skip merging); in the others one member, which so leads most lists of its
   group, is paired with the members of other components: in the first round the one
   whose own lists are longest, for near copies are edits of one text and nearer to it
   than to each other; then the first in an order drawn anew each round.  Pairs that
   agree on ``matches`` coordinates are confirmed on the full shingle sets.
   Texts whose lists still span components after ``rounds`` rounds are just below the
   threshold or share a passage.  Collisions cannot tell these apart, so they are
   settled by their full sets: they meet by the rarest shingles of their sets, and a
   pair is confirmed only if its sizes, the places of the shingle, a bitmap of each set
   and the shingles shared by both prefixes leave room for the threshold.  Again lists
   are led first by the member whose shingles are the most shared.  No link is lost, and
   a group of near copies around one text is not expanded into pairs.  Texts just below
   the threshold with each other that no leader links are compared pair by pair.
5. Components of the confirmed links, after each round.

``matches`` follows from the threshold: a pair at it agrees on fewer coordinates with
probability below 1e-6 (binomial tail; from 36 percent upwards); no other pair is lost.

Defined cases: a null, empty or wordless text has no shingles and is linked with
nothing; fewer words than a shingle make one shingle of all; rows that repeat a
doc_id share its component; a null doc_id is alone (component null, not kept); a
very long text has the same signature and bitmap sizes as any, and its set is held
once; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, bounded_batches, maybe_broadcast, mix64, released, shingles, space_words, utf8
from .components import components

COORDS = 32
_seed = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, (2, COORDS), dtype=np.uint64)
_SIG = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.list_(pa.int32()))])
_SIG_SQL = "doc_id long, n long, h1 long, h2 long, sig array<int>"


def least_matches(percent: int) -> int:
    """The most coordinates that a pair at the threshold agrees on but for a chance below
    1e-6; one, where even that is less sure (below 36 percent)."""
    p, tail = percent / 100, 0.0
    for m in range(COORDS):
        tail += math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)
        if tail >= 1e-6:
            return max(1, m)
    return COORDS


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(s), 2048):
        part = (s[i : i + 2048, None] ^ _seed[0]) * (_seed[1] | np.uint64(1))
        out = np.minimum(out, part.min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signatures(size: int):
    @released
    def run(batches):
        words = WordHashes()
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingles(words.of(space_words(raw)), size)
                n.append(len(s))
                h1.append(int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix64(s * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(signature(s) if len(s) else np.empty(0, np.int32))
            lens = np.fromiter(map(len, sig), np.int32, len(sig))
            flat = np.concatenate(sig) if len(sig) else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], schema=_SIG)

    return run


#: Longs of a set's bitmap: bit ``h % (64 * BIT_WORDS)`` is set for every shingle hash h.
BIT_WORDS = 16
_SETS_SQL = "rep long, h1 long, bits array<long>, shingles binary"


def bitmap(s: np.ndarray) -> np.ndarray:
    out = np.zeros(BIT_WORDS * 64, np.uint8)
    out[(s % np.uint64(BIT_WORDS * 64)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def _sketched(t: DataFrame) -> DataFrame:
    """The bitmap as one column a word, and ``slack``: shingles beyond one a filled bucket."""
    words = t.withColumns({f"w{i}": F.get("bits", F.lit(i)) for i in range(BIT_WORDS)})
    return words.withColumn("slack", F.expr("n - (" + " + ".join(f"bit_count(w{i})" for i in range(BIT_WORDS)) + ")")).drop("bits")


_SKETCH = (*(f"w{i}" for i in range(BIT_WORDS)), "slack")


def _side(k: str) -> list:
    return [F.col(c).alias(c + k) for c in _SKETCH]


def reachable(percent: int) -> str:
    """SQL condition that two sets (sides a and b) can reach the threshold: a bucket filled in
    one alone holds a shingle that the other lacks."""
    both = " + ".join(f"bit_count(w{i}a & w{i}b)" for i in range(BIT_WORDS))
    return f"(100 + {percent}) * (least(slacka, slackb) + {both}) >= {percent} * (na + nb)"


def _full_sets(size: int):
    schema = pa.schema([("rep", pa.int64()), ("h1", pa.int64()), ("bits", pa.list_(pa.int64())), ("shingles", pa.binary())])

    @released
    def run(batches):
        words = WordHashes()
        for b in batches:
            h1, bits, sets = [], [], []
            for raw in b.column(1).to_pylist():
                s = shingles(words.of(space_words(raw)), size)
                h1.append(int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                bits.append(bitmap(s))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(sets, pa.binary())], schema=schema)

    return run


def _confirm(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    @released
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=schema)

    return run


_TOKEN_SQL = "rep long, h1 long, n long, h long"


@released
def _tokens(batches):
    schema = pa.schema([("rep", pa.int64()), ("h1", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])
    for b in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        for i in range(0, len(sets), 64):
            size = n[i : i + 64]
            cols = [np.repeat(b.column(k).to_numpy()[i : i + 64], size) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, np.repeat(size, size), np.concatenate(sets[i : i + 64]))], schema=schema)


#: Shingles of a prefix that each of its postings carries.
HEAD = 24


def _leading(rep: str, weight: str, turn: int):
    """The order whose last member leads a list: by weight at first, then drawn for each round."""
    drawn = F.xxhash64(rep, F.lit(turn))
    return drawn if turn else F.struct(F.col(weight), drawn)


def prefix_postings(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(h, rep, n, weight, place, top, rest, last, sketch): the prefixes of the members' full sets, without
    the shingles that only one member has.  top: the first ``HEAD`` of the prefix, ``last`` the
    order of its last, ``rest`` the shingles of the set behind that.  weight: members that hold a
    shingle of the set, on average."""
    own = sets.join(members, "rep", "left_semi")
    tokens = own.select("rep", "h1", "shingles").mapInArrow(_tokens, _TOKEN_SQL)
    shared = tokens.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    held = tokens.join(shared, "h").groupBy("rep", "h1", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("hs"))
    # unshared shingles are rarer than all shared ones and fill the first places
    held = held.withColumn("weight", F.expr("aggregate(hs, 0L, (s, x) -> s + x.c) / n"))
    held = held.withColumn("first", F.col("n") - F.size("hs")).withColumn("room", F.expr(f"cast(n - (n * {percent} + 99) div 100 + 1 - first as int)")).where("room > 0")
    held = held.join(own.select("rep", "h1", "bits"), ["rep", "h1"])
    held = held.withColumn("head", F.expr(f"slice(hs, 1, least(room, {HEAD}))")).withColumns({"top": F.expr("head.h"), "rest": F.expr("n - first - size(head)"), "last": F.expr("element_at(head, -1)")})
    held = _sketched(held).select("rep", "n", "weight", "first", "top", "rest", "last", *_SKETCH, F.posexplode(F.expr("slice(hs, 1, room)")).alias("i", "t"))
    return held.select(F.col("t.h").alias("h"), "rep", "n", "weight", (F.col("first") + F.col("i") + 1).alias("place"), "top", "rest", "last", *_SKETCH)


def _heads(k: str) -> list:
    return [F.col(c).alias(c + k) for c in ("top", "rest", "last")]


def prefix_pairs(posted: DataFrame, percent: int, turn: int | None) -> DataFrame:
    """Pairs (a, b) of different components that can reach the threshold by the sizes of their
    sets, the places of a shared shingle and all shingles that the heads of both prefixes share:
    what else they share lies behind the head that ends first.  A pair comes once, from the first
    shingle its heads share.  posted: postings with component.  With a turn, only pairs with a
    member that leads each list, from any of their lists."""
    y = posted.select("h", F.col("rep").alias("b"), F.col("weight").alias("wb"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("place").alias("pb"), *_side("b"), *_heads("b"))
    if turn is not None:
        y = y.groupBy("h").agg(F.max_by(F.struct("b", "nb", "cb", "pb", *(c + "b" for c in (*_SKETCH, "top", "rest", "last"))), _leading("b", "wb", turn)).alias("y")).select("h", "y.*")
    x = posted.select("h", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("place").alias("pa"), *_side("a"), *_heads("a"))
    differ = "ca <> cb"
    if turn is None:
        # a list's members of one component, its leader's, are not compared with each other
        x = x.join(posted.groupBy("h").agg(F.max_by("component", "weight").alias("lead")), "h").where("ca <> lead")
        differ = "ca <> cb and (cb = lead or ca < cb)"
    bound = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and (100 + {percent}) * (1 + least(na - pa, nb - pb)) >= {percent} * (na + nb) and {reachable(percent)}"
    both = "array_intersect(topa, topb)"
    bound += f" and (100 + {percent}) * (size({both}) + if(lasta <= lastb, resta, restb)) >= {percent} * (na + nb)"
    if turn is None:
        bound += f" and coalesce(get({both}, 0) = h, true)"
    return x.join(y, "h").where(f"{differ} and {bound}").select("a", "b")


def near_duplicates(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; links are pairs with
    ``100 * intersection >= percent * union``."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    signed = scratch.keep(docs.mapInArrow(_signatures(size), _SIG_SQL))
    reps = scratch.keep(
        signed.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    )
    posted = reps.select("rep", F.posexplode("sig").alias("j", "v")).select("rep", (F.shiftleft(F.col("j").cast("long"), 32) + F.col("v")).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    matches = least_matches(percent)
    prefix = COORDS - matches + 1
    ranked = posted.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))
    ranked = ranked.withColumn("weight", F.expr("aggregate(keys, 0L, (s, x) -> s + x.c)"))
    ranked = ranked.where(F.size("keys") > COORDS - prefix).select("rep", "weight", F.explode(F.expr(f"slice(keys, 1, {prefix} - {COORDS} + size(keys))")).alias("k"))
    lists = scratch.keep(ranked.select(F.col("k.key").alias("key"), "rep", "weight"))

    wanted = scratch.keep(lists.select(F.col("rep").alias("doc_id")).distinct())
    sets = docs.join(maybe_broadcast(wanted, 64), "doc_id", "left_semi").mapInArrow(_full_sets(size), _SETS_SQL)
    sets = scratch.keep(sets.dropDuplicates(["rep", "h1"]))
    sigs = scratch.keep(reps.select("rep", "n", "sig", "h1").join(sets.select("rep", "h1", "bits"), ["rep", "h1"]).transform(_sketched))
    lists = scratch.keep(lists.join(sigs.groupBy("rep").agg(F.min(F.floor(F.log("n") / math.log(100 / percent))).alias("step")), "rep"))
    agree = F.expr("size(filter(arrays_zip(sa, sb), p -> p.sa = p.sb))")

    def confirmed(pairs: DataFrame, matches: int) -> DataFrame:
        """Links (u, v) among candidate pairs: sizes, then signatures, then full sets."""
        a = sigs.select(F.col("rep").alias("u"), F.col("sig").alias("sa"), F.col("n").alias("na"), F.col("h1").alias("ha"), *_side("a"))
        b = sigs.select(F.col("rep").alias("v"), F.col("sig").alias("sb"), F.col("n").alias("nb"), F.col("h1").alias("hb"), *_side("b"))
        pairs = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
        pairs = pairs.join(a, "u").join(b, "v").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {reachable(percent)}").where(agree >= matches)
        pairs = scratch.keep(pairs.select("u", "ha", "v", "hb"))
        need = scratch.keep(pairs.select(F.col("u").alias("rep")).union(pairs.select("v")).distinct())
        own = sets.join(maybe_broadcast(need, 64), "rep", "left_semi")
        x = own.select(F.col("rep").alias("u"), F.col("h1").alias("ha"), F.col("shingles").alias("x"))
        y = own.select(F.col("rep").alias("v"), F.col("h1").alias("hb"), F.col("shingles").alias("y"))
        return scratch.keep(pairs.join(y, ["v", "hb"]).join(x, ["u", "ha"]).select("u", "v", "x", "y").mapInArrow(_confirm(percent), "u long, v long"))

    final = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))

    def with_component(t: DataFrame) -> DataFrame:
        return t.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def mixed(t: DataFrame, key: str) -> DataFrame:
        """The rows of lists that span components."""
        t = with_component(t)
        some = t.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(key)
        return scratch.keep(t.join(some, key))

    def linked(pairs: DataFrame, matches: int) -> None:
        """Joins components by the links found, on the graph of components alone."""
        nonlocal final
        found = confirmed(pairs, matches)
        for end in ("u", "v"):
            found = found.join(final.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
        moved = scratch.keep(components(found, scratch))
        if moved.isEmpty():
            return
        old = final.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        final = scratch.keep(old.unionByName(moved.join(final, "node", "left_anti")))

    for turn in range(rounds):
        groups = mixed(lists, "key")
        if groups.isEmpty():
            break
        hub = groups.groupBy("key").agg(F.max_by(F.struct("rep", "component", "step"), _leading("rep", "weight", turn)).alias("hub"))
        linked(groups.join(hub, "key").where("component <> hub.component and abs(step - hub.step) <= 1").select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")), matches)
    members = scratch.keep(mixed(lists, "key").select("rep").distinct())
    posted = scratch.keep(prefix_postings(sets, members, percent))
    for turn in (*range(rounds), None):
        groups = mixed(posted, "h")
        if groups.isEmpty():
            break
        linked(prefix_pairs(groups, percent, turn), 0)

    classed = reps.select("n", "h1", "h2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "h1", "h2").join(classed, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose doc_id is their component's least; of rows that repeat a doc_id, one."""
    judged = near_duplicates(df, scratch, id_col, text_col, **options)
    gone = scratch.keep(judged.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__q_gone")).distinct())
    kept = df.join(maybe_broadcast(gone, 64), F.col(id_col).cast("long") == F.col("__q_gone"), "left_anti")
    twice = scratch.keep(judged.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__q_twice")))
    if not twice.limit(1).count():
        return kept
    once = kept.join(twice, F.col(id_col).cast("long") == F.col("__q_twice"), "left_anti")
    again = kept.join(twice, F.col(id_col).cast("long") == F.col("__q_twice"), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col]))
