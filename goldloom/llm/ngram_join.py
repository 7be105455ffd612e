"""N-gram Jaccard join by grouped prefixes.

A text's set of n-word shingles is put in one order for all texts; two sets that are similar enough share a shingle among
their first ones, their prefix. Texts with equal sets are one class, and from here on a class is one member.

1. Sketch: the prefix by hash order, longer by k, of every text. A set that has a partner shares at least 1 + k' of these
   shingles with other sets, k' being the k of its smallest possible partner. Most texts share fewer and are done here.
2. Order: the texts that are left are put in order of frequency, rarest shingles first. The ORDERED most frequent shingles
   are listed; all others come first, by hash. Any order gives the same links, so the bound of the list costs no result.
3. Groups: members with identical prefixes and sizes are collapsed into one group; only groups meet in blocks, one block for
   each shingle that stands in the prefixes of two groups.
4. Group pairs are filtered by size, by position (the first shingle that two similar sets share has enough places behind it in
   both) and by what their prefixes share. Pairs that pass are expanded to members, which are verified by their whole sets.

Components are wanted, not pairs, so blocks aren't expanded into all group pairs at once. In each round every group meets the
leader of one of its blocks, the group that shares most; what is verified becomes one component, and blocks and pairs that lie
within one component are done. After the rounds all pairs of groups of different components that pass the filters are
verified, so no link between components is lost, and a large family of near copies costs a few pairs for each member.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldloom.llm.common import discard, held_in, likely_in, look_up, map_batches, row_hash, without, written
from goldloom.llm.components import components

#: Most entries of the list of frequent shingles (16 bytes each, broadcast), and how often a shingle stands in sets to be listed.
ORDERED, FREQUENT = 500_000, 20
#: Up to so many pairs (of 16 bytes) are sent to all tasks.
FEW_PAIRS = 500_000
#: Most rounds of leaders; what they leave is compared without leaders.
ROUNDS = 4
#: The sketch of a set of n shingles has n // SHARE more than its prefix.
SHARE = 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; a text of fewer words is one shingle, one without words none.

    bytes.lower and bytes.split know ASCII only: A-Z become small, and words end at \\x20 and \\x09-\\x0D.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(n, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = (acc ^ h[k : len(h) - width + 1 + k]) * _M1
        acc ^= acc >> np.uint64(32)
    acc *= _M2
    return np.unique(acc ^ (acc >> np.uint64(29)))


def least_overlap(size: int, num: int, den: int) -> int:
    """So many shingles at least has a set in common with any set of similarity num / den or more."""
    return -(-num * size // den)


def prefix_length(size: int, num: int, den: int) -> int:
    """So many first shingles of a set hold 1 + size // SHARE of those it has in common with a set of similarity num / den or more.

    Let m = ceil(size * num / den), the least overlap. Behind the k-th common shingle there are m - k more common ones, so it is
    among the first size - m + k. 0 where only equal sets are that similar: the most similar other set has one shingle more.
    """
    return 0 if size * den < num * (size + 1) else size - least_overlap(size, num, den) + 1 + size // SHARE


def support(size: int, num: int, den: int) -> int:
    """So many shingles of its sketch a set shares at least with the sketch of a similar one, however small that is."""
    return 1 + least_overlap(size, num, den) // SHARE


class Order:
    """The order of shingles: those not listed by hash, then the listed ones by frequency and hash."""

    def __init__(self, listed: np.ndarray, counts: np.ndarray) -> None:
        by = np.argsort(listed)
        self.listed, self.counts = listed[by], counts[by]

    def first(self, found: np.ndarray, k: int) -> np.ndarray:
        """The first k of a set that is sorted by hash."""
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, found), len(self.listed) - 1)
            heavy = self.listed[at] == found
            if heavy.any():
                last = np.lexsort((found[heavy], self.counts[at[heavy]]))
                found = np.concatenate([found[~heavy], found[heavy][last]])
        return found[:k]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def _digest(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _sketches(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of every row (row, node, row_hash, doc_id, text): n_shingles, digest of the set, the support it needs, and its sketch."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, needs, firsts = [], [], [], []
            for text in batch.column(4):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                digests.append(_digest(s))
                needs.append(support(len(s), num, den))
                firsts.append(s[: prefix_length(len(s), num, den)])
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(needs, pa.int64()), _lists(firsts)]
            return pa.RecordBatch.from_arrays([*batch.columns[:4], *made], ["row", "node", "row_hash", "doc_id", "n_shingles", "digest", "need", "sketch"])

        return step

    return map_batches(rows, "row long, node long, row_hash long, doc_id long, n_shingles long, digest binary, need long, sketch array<long>", make)


def _whole_sets(rows: DataFrame, n: int) -> DataFrame:
    """Whole sets of rows (node, text): node, digest, n, tokens in order of hash."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(text.as_py(), n) for text in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), _lists(sets)], ["node", "digest", "n", "tokens"])

        return step

    return map_batches(rows, "node long, digest binary, n long, tokens array<long>", make).filter("digest is not null")


def _prefixes(sets: DataFrame, order: Order, num: int, den: int) -> DataFrame:
    """(node, n, key, prefix) in the order given; key is a digest of the prefix. Sets that only equal sets are similar to go."""
    given = sets.sparkSession.sparkContext.broadcast(order)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        ranked = given.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            firsts = []
            for found in batch.column(2):
                size = len(found)
                length = prefix_length(size, num, den)
                firsts.append(ranked.first(found.values.to_numpy().view(np.uint64), max(0, length - size // SHARE)))
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(_digest, firsts), pa.binary()), _lists(firsts)], ["node", "n", "key", "prefix"])

        return step

    return map_batches(sets.select("node", "n", "tokens"), "node long, n long, key binary, prefix array<long>", make).filter("key is not null")


def _size_and_place(num: int, den: int, a: str = "", b: str = "_b") -> Column:
    """Whether the first shingle that two sets share can stand at these places: sizes n, positions pos from 1 on.

    Similar sets have m = ceil(num * (n + n_b) / (num + den)) shingles in common, so m - 1 more follow in both.
    """
    n, n_b, pos, pos_b = (F.col(c) for c in (f"n{a}", f"n{b}", f"pos{a}", f"pos{b}"))
    least = F.expr(f"(({num} * (n{a} + n{b}) + {num + den - 1}) div {num + den})")
    return (F.least(n, n_b) * den >= F.greatest(n, n_b) * num) & (pos <= n - least + 1) & (pos_b <= n_b - least + 1)


def _apart(low: str, high: str, low_b: str, high_b: str) -> Column:
    """Whether members of two groups lie in more than one component."""
    return F.least(low, low_b) < F.greatest(high, high_b)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members (a, b) whose whole sets are similar."""
    named = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    # Pairs go to the sets where they are few; sets go to the pairs where not.
    one = named("b").join(F.broadcast(pairs), "b") if pairs.count() <= FEW_PAIRS else held_in(named("b"), "b", pairs.select("b").distinct()).join(pairs, "b")
    both = one.join(held_in(named("a"), "a", pairs.select("a").distinct()), "a").select("a", "b", "n_a", "n_b", common.alias("common"))
    return both.filter(F.col("common") * den >= (F.col("n_a") + F.col("n_b") - F.col("common")) * num).select("a", "b")


class _Join:
    """Groups, their blocks, and what is known of their members' components."""

    def __init__(self, sets: DataFrame, prefixes: DataFrame, num: int, den: int) -> None:
        self.sets, self.prefixes, self.num, self.den = sets, prefixes, num, den
        #: members: gid, node and comp of every member; a group's gid is its smallest node.
        self.blocks, self.members = _blocks(prefixes)
        self.met: DataFrame | None = None

    def _state(self) -> DataFrame:
        return self.members.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))

    def renew(self) -> bool:
        """Leaves blocks out that lie in one component; whether a tenth of the rows went, so that a further round pays."""
        rows = self.blocks.drop("low", "high").join(self._state(), "gid")
        lasting = rows.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("token")
        before, self.blocks = self.blocks, written(rows.join(lasting, "token"), "blocks")
        pays = self.blocks.count() < 0.9 * before.count()
        discard(before)
        return pays

    def led(self, r: int) -> DataFrame:
        """(gid, gid_b, n, n_b): each group that isn't in one component with a leader of its blocks, and the leader it shares most with."""
        rank = F.struct((F.lit(0) if r % 2 else F.col("shares")).alias("s"), F.xxhash64("gid", F.lit(r)).alias("h"), "gid", "n", "pos", "low", "high")
        lead = self.blocks.groupBy("token").agg(F.max(rank).alias("lead"))
        lead = lead.select("token", *(F.col(f"lead.{c}").alias(f"{c}_b") for c in ("gid", "n", "pos", "low", "high")))
        pairs = self.blocks.join(lead, "token").filter((F.col("gid") != F.col("gid_b")) & _apart("low", "high", "low_b", "high_b") & _size_and_place(self.num, self.den))
        pairs = pairs.groupBy("gid", "gid_b", "n", "n_b").agg(F.count("*").alias("shared"))
        if self.met is not None:
            pairs = pairs.join(self.met.select("gid", "gid_b"), ["gid", "gid_b"], "left_anti")
        return pairs.groupBy("gid", "n").agg(F.max(F.struct("shared", "gid_b", "n_b")).alias("best")).select("gid", "best.gid_b", "n", "best.n_b")

    def crossing(self) -> DataFrame:
        """(gid, gid_b, n, n_b) of all groups of different components that pass the filters of size and place."""
        rows = self.blocks.select("token", "gid", "n", "pos", "low", "high")
        other = rows.select("token", *(F.col(c).alias(f"{c}_b") for c in ("gid", "n", "pos", "low", "high")))
        both = rows.join(other, "token").filter((F.col("gid") < F.col("gid_b")) & _apart("low", "high", "low_b", "high_b") & _size_and_place(self.num, self.den))
        return both.select("gid", "gid_b", "n", "n_b").distinct()

    def counted(self, pairs: DataFrame) -> DataFrame:
        """The pairs of groups whose prefixes share enough.

        The prefix that ends first in the order holds c shingles of the other prefix, and no more of the other set; so the sets
        share at most c and what is behind that prefix.
        """
        side = lambda s: held_in(self.prefixes.select(F.col("node").alias(f"gid{s}"), F.col("prefix").alias(f"prefix{s}")), f"gid{s}", pairs.select(f"gid{s}").distinct())
        both = pairs.join(side("_b"), "gid_b").join(side(""), "gid")
        most = F.size(F.array_intersect("prefix", "prefix_b")) + F.greatest(F.col("n") - F.size("prefix"), F.col("n_b") - F.size("prefix_b"))
        return both.filter(most * (self.num + self.den) >= (F.col("n") + F.col("n_b")) * self.num).select(*pairs.columns)

    def within(self) -> DataFrame:
        """(gid, gid_b), the same group twice, of groups whose members lie in several components."""
        return self._state().filter("low < high").select("gid", F.col("gid").alias("gid_b"))

    def expanded(self, pairs: DataFrame, first_only: bool) -> DataFrame:
        """(a, b): members of different components of a pair's groups; first_only: only the first member of gid_b."""
        side = lambda c, s: self.members.select(F.col("gid").alias(f"gid{s}"), F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        led = side("b", "_b").filter("b = gid_b") if first_only else side("b", "_b")
        found = pairs.join(side("a", ""), "gid").join(led, "gid_b").filter("comp_a <> comp_b")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(self, pairs: DataFrame) -> None:
        """Joins the components of members whose sets are similar."""
        links = written(_verified(pairs, self.sets, self.num, self.den), "links")
        if not links.head(1):
            return
        label = lambda c: F.col("comp").alias(c)
        known = self.members.select("node", "comp")
        met = links.join(known.withColumnRenamed("node", "a"), "a").select("b", label("x")).join(known.withColumnRenamed("node", "b"), "b")
        found = components(met.select(F.col("x").alias("a"), label("b"))).select(F.col("id").alias("comp"), F.col("comp").alias("new"))
        fresh = self.members.join(found, "comp", "left").select("gid", "node", F.coalesce("new", "comp").alias("comp"))
        before, self.members = self.members, written(fresh, "members")
        discard(before)

    def solve(self) -> DataFrame:
        """(node, comp) of every member."""
        for r in range(ROUNDS):
            pairs = written(self.led(r), "met")
            self.met = pairs if self.met is None else self.met.unionByName(pairs)
            pairs = pairs.select("gid", "gid_b").unionByName(self.within()) if not r else written(self.counted(pairs), "counted").select("gid", "gid_b")
            tried = written(self.expanded(pairs, first_only=True), "pairs")
            if not tried.head(1):
                break
            self.verify(tried)
            if not self.renew():
                break
        pairs = written(self.counted(written(self.crossing(), "crossing")), "counted").select("gid", "gid_b").unionByName(self.within())
        rest = written(self.expanded(pairs, first_only=False), "pairs")
        if rest.head(1):
            self.verify(rest)
        return self.members.select("node", "comp")


def _partnered(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, digest) of the classes whose sketch shares as much with others as a similar set would."""
    several = classes.filter("group_size > 1").select("digest", "first", "group_size")
    copies = look_up(sets.filter("digest is not null").select("row", "digest"), several, "digest").filter("row <> first.row").select("row")
    firsts = without(sets.filter(F.size("sketch") > 0), "row", written(copies, "copies"))
    rows = firsts.select("row", "need", F.explode("sketch").alias("token"))
    shared = written(rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "shared")
    found = held_in(rows, "token", shared).groupBy("row").agg(F.count("*").alias("c"), F.first("need").alias("need"))
    alive = written(found.filter("c >= need").select("row"), "alive")
    discard(shared)
    return written(held_in(sets.select("row", "node", "digest"), "row", alive).drop("row"), "partnered")


def _order(sets: DataFrame) -> Order:
    """The ORDERED most frequent shingles of whole sets, all above FREQUENT where they are fewer."""
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > FREQUENT)
    listed = counts.orderBy(F.desc("c"), "token").limit(ORDERED).toPandas()
    return Order(listed["token"].to_numpy(np.int64).view(np.uint64), listed["c"].to_numpy(np.int64))


def _blocks(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (token, pos, gid, n, shares, low, high) of groups with a shingle that another group has, and members (gid, node, comp).

    shares is the number of such shingles of a group; low and high are the least and the largest component of its members.
    """
    groups = prefixes.groupBy("n", "key").agg(F.min("node").alias("gid"), F.max("node").alias("high"))
    grouped = prefixes.select("n", "key", "node").join(groups, ["n", "key"])
    members = written(grouped.select("gid", "node", F.col("node").alias("comp"), "high"), "members")
    one = prefixes.join(members.filter("gid = node").select("node", "high"), "node")
    rows = one.select(F.col("node").alias("gid"), "n", F.col("node").alias("low"), "high", F.posexplode("prefix").alias("pos", "token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    # As many entries as the prefix of a group has at most.
    met = held_in(rows, "token", written(shared, "shared")).groupBy("gid", "n", "low", "high").agg(F.collect_list(F.struct("token", (F.col("pos") + 1).alias("pos"))).alias("met"))
    blocks = met.select("gid", "n", "low", "high", F.size("met").alias("shares"), F.explode("met").alias("m")).select("m.token", "m.pos", "gid", "n", "shares", "low", "high")
    return written(blocks, "blocks"), members.drop("high")


def _one_each(whole: DataFrame, chosen: DataFrame) -> DataFrame:
    """whole with one row of each node, the one with the digest it was chosen for; rows may repeat key and text, or share a hash."""
    twice = written(whole.groupBy("node").count().filter("count > 1").select("node"), "twice")
    if not twice.head(1):
        return whole
    rest = held_in(whole, "node", twice)
    true = rest.join(chosen, ["node", "digest"], "left_semi").dropDuplicates(["node"])
    return written(without(whole, "node", twice).unionByName(true.select(*whole.columns)), "whole")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id", salt: int = 0) -> DataFrame:
    """One row per row of docs: key (long), row_hash, n_shingles, group_size (rows with an equal set), component_id and kept.

    Texts link when den * common >= num * union of their shingles; component_id is the smallest key that links reach. kept
    marks the row with that key (of rows that repeat it, those with the least row_hash; of rows that repeat key and text all).
    Null, empty and blank texts have no shingles, link with nothing and are components of their own, and kept. Rows that repeat
    a key are rows of their own, each with the component of its text. A null key comes after all others, so component_id is null
    where all keys of a component are. An empty table gives an empty result; other columns are left out.

    Within, a class is known by node, a hash of one of its rows; salt changes it, should two classes ever share one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.withColumns({"row_hash": row_hash(F.col("text")), "node": F.xxhash64(F.lit(salt), "doc_id", "text")})
    sets = written(_sketches(rows.select(F.monotonically_increasing_id().alias("row"), "node", "row_hash", "doc_id", "text"), n, num, den), "sets")
    name = F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "row_hash")
    classes = sets.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("row", "node")).alias("first"), F.count("*").alias("group_size"), F.min(name).alias("name"))
    classes = written(classes, "classes")

    chosen = _partnered(sets, classes)
    if chosen.groupBy("node").count().filter("count > 1").head(1):
        return jaccard_components(docs, n, num, den, text, key, salt + 1)
    # Sketches are the larger part of that table and done with.
    before, sets = sets, written(sets.select("doc_id", "row_hash", "n_shingles", "digest"), "rows")
    discard(before)
    level = classes.withColumn("comp_name", F.col("name"))
    if chosen.head(1):
        # Texts stay where they are: a few rows that weren't chosen come along, and have no part in any class.
        whole = written(_whole_sets(likely_in(rows.select("node", "text"), "node", chosen), n), "whole")
        whole = _one_each(whole, chosen)
        prefixes = written(_prefixes(whole, _order(whole), num, den), "prefixes")
        labels = _Join(whole, prefixes, num, den).solve()
        nodes = classes.select(F.col("first.node").alias("node"), "digest", "name", "group_size")
        named = labels.join(nodes.join(chosen, ["node", "digest"], "left_semi"), "node")
        named = written(named.select("node", "digest", "comp", "name"), "named")
        least = named.groupBy("comp").agg(F.min("name").alias("comp_name"))
        labels = written(named.join(least, "comp").select("digest", "comp_name"), "labels")
        discard(prefixes)
        discard(whole)
        level = classes.join(labels, "digest", "left").withColumn("comp_name", F.coalesce("comp_name", "name"))
    level = written(level.select("digest", "group_size", "comp_name"), "level")

    found = look_up(sets.filter("digest is not null").select("doc_id", "row_hash", "n_shingles", "digest"), level, "digest")
    linked = found.select("doc_id", "row_hash", "n_shingles", "group_size", F.col("comp_name.doc_id").alias("component_id"), (name == F.col("comp_name")).alias("kept"))
    empty = sets.filter("digest is null").select("doc_id", "row_hash", "n_shingles", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(empty).withColumnRenamed("doc_id", key)
