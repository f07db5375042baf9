"""N-gram Jaccard join by prefix trees.

A document's set of word n-grams is kept in one global order: n-grams that very many documents share come last,
others by hash. Two sets that are similar enough share an n-gram within their first few (the prefix), so n-grams of
prefixes say which sets have to meet. Where they meet, a trie of their ordered sets is traversed with each of them:
overlaps of common beginnings are counted once, subtrees whose remaining lengths can't reach the overlap needed are
pruned, and so are subtrees that hold only sets known to be linked with the probe already.

1. Sets that are equal are one node. Of the n-grams with the smallest hashes, a share of all n-grams as large as prefixes
   are, all occurrences are counted: how many a node has that are in no other set says how large a partner can be, and
   most texts that only quote others can't have any.
2. In two rounds each component (at first each node) goes to one group, that of one n-gram it shares, and one set of each
   component is put into the group's trie. Near copies share nearly all n-grams, so they meet here; a group of any size
   is cut into blocks of bounded size, whose components meet in the next round.
3. N-grams whose nodes are all of one component by then are done. By some of its other n-grams, half of them among those that
   most components share, each node meets all nodes of other components that chose the same; groups of any size meet
   block by block.
4. What shares an n-gram and hasn't met is held against the other components in the n-gram, not against their members: each
   pair of components that could still be linked is one trie and its probes, given up at the first link. So every link
   between different components is found, without pairs of all members.

Defined results: empty and null texts have no n-grams and link with nothing, also where another row of their doc_id does;
texts of fewer words than n have one n-gram, all their words; equal texts link; rows that repeat a doc_id are one document,
so what one of them links with the others do; rows with a null doc_id link like others but never name a component, which is null
if all its rows are such; columns besides doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.components import components
from strataq.llm.textblocks import blocks, flat, mix, ngrams, short_hashes, sums, word_hashes, word_spans
from strataq.tables import discard, written

WORDS, PERCENT = 5, 80
#: Common n-grams that go last in the global order: at most so many (8 bytes each when broadcast).
MOST_COMMON = 1_000_000
#: Set elements (8 bytes each) that one task builds a trie from at a time.
GROUP_ITEMS = 1_000_000
#: Requests for sets (six numbers each) that are broadcast; beyond that they are joined.
MOST_REQUESTS = 100_000
#: Rounds in which each component meets one group; groups in which each node then meets others.
ROUNDS, MEETINGS = 2, 6
_LAST = np.uint64(1 << 63)


def sets_of(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes (63 bits) of all texts, by text and hash, and the n + 1 offsets of the texts."""
    buf, offsets = flat(texts)
    starts, ends, at = word_spans(buf, offsets)
    hashes = word_hashes(buf, starts, ends, lower=True)
    whole, first = ngrams(hashes, at, words)
    short, rows = short_hashes(hashes, at, words)
    owner = np.concatenate([np.searchsorted(at, first, "right") - 1, rows])
    grams = np.concatenate([whole, short]) & ~_LAST
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(at)))


def ordered(grams: np.ndarray, at: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The sets in the global order: common n-grams (a sorted array) last."""
    if not len(common) or not len(grams):
        return grams
    place = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    grams = np.where(common[place] == grams, grams | _LAST, grams)
    return grams[np.lexsort((grams, np.repeat(np.arange(len(at) - 1), np.diff(at))))]


def fingerprints(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set that doesn't depend on its order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams & ~_LAST))])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def common_grams(docs: DataFrame, words: int, most: int = MOST_COMMON) -> np.ndarray:
    """N-grams of at least 1 in 4,000 documents (16 at least), sorted; the most frequent ``most`` of them.

    Every part of some four million n-grams of all documents reports those with a few occurrences; sums of
    these reports can fall short for an n-gram, which then merely isn't put last.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def report() -> pa.RecordBatch:
            grams = np.concatenate(held)
            held.clear()
            grams.sort()
            found = np.unique(grams[3:][grams[3:] == grams[:-3]])  # four times at least
            n = np.searchsorted(grams, found, "right") - np.searchsorted(grams, found, "left")
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["gram", "n"])

        for batch in batches:
            for part in blocks(batch):
                held.append(sets_of(part.column("text"), words)[0])
                if sum(map(len, held)) > 4_000_000:
                    yield report()
        if held:
            yield report()

    least = max(16, docs.count() // 4000)
    sums = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(sums.orderBy(F.desc("n"), "gram").limit(most).toArrow().column("gram").to_numpy().astype(np.int64).view(np.uint64))


def smallest(percent: int) -> int:
    """The hash below which n-grams are counted in all sets: as many as prefixes have on average."""
    return (1 << 63) // 100 * (100 - percent)


def prefix_size(n: Column, percent: int) -> Column:
    """The n-grams of which similar sets share one at least."""
    return n - F.floor((percent * n + 99) / 100) + 1


def sketches(docs: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, key, n (set size), node (fingerprint), and of each document's ordered set the first n-grams.

    These are its prefix, and at least the ``small`` ones, those that have the smallest hashes and aren't common.
    """
    limit = np.uint64(smallest(percent))
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                grams, at = sets_of(part.column("text"), words)
                n, node = np.diff(at), fingerprints(grams, at)
                grams = ordered(grams, at, sent.value)
                keep = n - (percent * n + 99) // 100 + (n > 0)
                small = sums(grams < limit, at)
                keep = np.maximum(keep, small)
                place = np.arange(len(grams)) - np.repeat(at[:-1], n)
                first = grams[place < np.repeat(keep, n)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(first))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(node), pa.array(small, pa.int64()), lists], ["doc_id", "key", "n", "node", "small", "first"])

    return docs.mapInArrow(sketch, "doc_id long, key long, n long, node long, small long, first array<long>")


def sent(small: DataFrame) -> DataFrame:
    """Broadcast ``small`` if it has few rows, all of which are numbers; else leave the join to Spark."""
    return F.broadcast(small) if small.limit(MOST_REQUESTS + 1).count() <= MOST_REQUESTS else small


def sets_for(docs: DataFrame, requests: DataFrame, common: np.ndarray, words: int) -> DataFrame:
    """``requests`` (key, node, component, slot, one, other, side) with ``items``, the ordered set of the node, in place of the key.

    Each set is made once, where its text is, however many requests there are for it.
    """
    common_sent = docs.sparkSession.sparkContext.broadcast(common)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                grams, at = sets_of(part.column("text"), words)
                # another row with this key can have another set than the one that is meant
                meant = pa.array(np.flatnonzero(fingerprints(grams, at) == part.column("node").to_numpy()))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ordered(grams, at, common_sent.value).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node").take(meant), lists.take(meant)], ["node", "items"])

    asked = docs.select("key", "text").join(sent(requests.select("key", "node").distinct()), "key").select("text", "node")
    return asked.mapInArrow(build, "node long, items array<long>").join(sent(requests.drop("key")), "node")


class Trie:
    """A radix tree of ordered sets: each branch holds a run of items that all sets below share at that place."""

    __slots__ = ("below", "ends", "least", "most", "run", "whole")

    def __init__(self, run: np.ndarray, least: int, most: int):
        self.run, self.below, self.ends, self.least, self.most, self.whole = run, {}, [], least, most, None

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Trie:
        root = cls(np.zeros(0, np.uint64), min(map(len, sets)), max(map(len, sets)))
        for k, items in enumerate(sets):
            node, at = root, 0
            while True:
                node.least, node.most = min(node.least, len(items)), max(node.most, len(items))
                if at == len(items):
                    node.ends.append(k)
                    break
                branch = node.below.get(items[at])
                if branch is None:
                    leaf = node.below[items[at]] = cls(items[at:], len(items), len(items))
                    leaf.ends.append(k)
                    break
                m = min(len(branch.run), len(items) - at)
                differ = np.flatnonzero(branch.run[:m] != items[at : at + m])
                m = int(differ[0]) if len(differ) else m
                if m < len(branch.run):  # split the branch where the sets part
                    upper = cls(branch.run[:m], branch.least, branch.most)
                    branch.run = branch.run[m:]
                    upper.below[branch.run[0]] = branch
                    node.below[items[at]] = branch = upper
                node, at = branch, at + m
        return root

    def one_of(self, groups: Groups) -> int | None:
        """The group of all sets below, if it is one; what was one group stays one."""
        found, stack = None, [self]
        while stack:
            node = stack.pop()
            if node.whole is None:
                stack += node.below.values()
            for k in node.ends if node.whole is None else (node.whole,):
                own = groups.of(k)
                if found is not None and found != own:
                    return None
                found = own
        self.whole = found
        return found

    def probe(self, items: np.ndarray, percent: int, own: int = -1, groups: Groups | None = None) -> Iterator[int]:
        """The sets whose intersection with ``items`` is at least ``percent`` of the union; with ``groups`` not those of ``own``'s group."""
        stack = [(self, 0, 0, 0)]
        while stack:
            node, depth, overlap, used = stack.pop()
            if groups and node.one_of(groups) == groups.of(own):
                continue
            if len(node.run):
                # items up to the run's last one; what of them isn't in the run can't come later
                upto = int(np.searchsorted(items[used:], node.run[-1], "right")) + used
                part = items[used:upto]
                if len(part):
                    place = np.minimum(np.searchsorted(part, node.run), len(part) - 1)
                    overlap += int((part[place] == node.run).sum())
                used, depth = upto, depth + len(node.run)
            # 100 * o >= p * (a + b - o), with the smallest b below and the most that may still be shared
            reach = overlap + min(len(items) - used, node.most - depth)
            if (100 + percent) * reach < percent * (len(items) + max(node.least, reach)):
                continue
            if (100 + percent) * overlap >= percent * (len(items) + depth):
                yield from node.ends
            stack += [(b, depth, overlap, used) for b in node.below.values()]


class Groups:
    """Which of k sets are linked, by the smallest place in each group."""

    def __init__(self, k: int):
        self.up = list(range(k))

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.of(x), self.of(y)
        self.up[max(x, y)] = min(x, y)


def grouped(sets: list[np.ndarray], percent: int, known: list[int] | None = None, held: int | None = None) -> Groups:
    """The components of sets that are similar, or whose ``known`` component is the same.

    With ``held`` only the sets behind the first ``held`` ones are compared, and only with these.
    """
    trie, groups, first = Trie.of(sets[:held]), Groups(len(sets)), {}
    for k, own in enumerate(known or ()):
        groups.link(first.setdefault(own, k), k)
    for k in range(held or 0, len(sets)):
        for other in trie.probe(sets[k], percent, k, groups):
            groups.link(k, other)
    return groups


def _by_group(rows: pa.Table) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """((one, other), component, side, sets) of each group of a slot; a set that came twice is there once."""
    columns = [rows.column(c).to_numpy() for c in ("one", "other", "side", "node")]
    component = rows.column("component").to_numpy()
    lists = rows.column("items").combine_chunks()
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    again = np.zeros(len(order), bool)
    again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    order, (one, other, side, _) = order[~again], [c[~again] for c in columns]
    edges = np.flatnonzero((one[1:] != one[:-1]) | (other[1:] != other[:-1])) + 1
    for own in np.split(np.arange(len(order)), edges):
        if len(own):
            yield (int(one[own[0]]), int(other[own[0]])), component[order[own]], side[own], [values[at[k] : at[k + 1]] for k in order[own]]


def largest_partner(n: Column, lone: Column, percent: int) -> Column:
    """The size up to which another set can be similar to one of ``n`` n-grams of which it can't have ``lone``."""
    return F.floor(((n - lone) * (100 + percent) - n * percent) / percent).cast("long")


def least_shared(n: Column, m: Column, percent: int) -> Column:
    """The n-grams that prefixes of similar sets of these sizes share at least.

    Of the set whose prefix ends first, what lies behind its prefix is all that can still be shared.
    """
    return F.ceil(percent * (n + m) / (100 + percent)) - F.floor((percent * F.greatest(n, m) + 99) / 100) + 1


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with their component, at first the node itself."""
    if labels is None:
        return members.withColumn("component", F.col("node"))
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def mixed(at: DataFrame) -> DataFrame:
    """``at`` without n-grams whose nodes are all of one component."""
    ends = at.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("gram")
    return at.join(ends, "gram", "left_semi")


def chosen(turn: int, *before: Column) -> Column:
    """One of a group's n-grams: the same choice among the same n-grams, those that come first by ``before``."""
    return F.min(F.struct(*before, F.xxhash64("gram", F.lit(turn)).alias("h"), "gram"))["gram"]


def meeting_routes(at: DataFrame) -> DataFrame:
    """(node, component, n, r0, r1, ...): the n-grams by which each node meets others."""
    several = at.groupBy("gram", "component").agg(F.count("*")).groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    most = (-F.floor(F.log2("k"))).alias("most")
    return at.join(several, "gram").groupBy("node", "component", "n").agg(*(chosen(ROUNDS + t, *[most] * (2 * t < MEETINGS)).alias(f"r{t}") for t in range(MEETINGS)))


def met_in_groups(docs: DataFrame, at: DataFrame, nodes: DataFrame, common: np.ndarray, words: int, percent: int, turn: int) -> DataFrame:
    """(component, joined): the components that are linked with others of their group, and the smallest of them."""
    routes = written(at.groupBy("component").agg(chosen(turn).alias("one")), "routes")
    rows = routes.join(nodes, routes["component"] == nodes["node"]).select("one", "node", "n", "key")
    loads = rows.groupBy("one").agg(F.count("*").alias("k"), F.sum("n").alias("load")).where("k > 1").select("one", (F.col("load") / GROUP_ITEMS).cast("int").alias("cuts"), "load")
    loads = written(loads, "loads")
    slots = int((loads.agg(F.sum("load")).first()[0] or 0) // GROUP_ITEMS) + 1
    other = F.pmod(F.xxhash64("node"), F.col("cuts") + 1)  # the block
    rows = rows.join(loads.select("one", "cuts"), "one").withColumn("other", other)
    requests = written(rows.select("key", "node", F.col("node").alias("component"), F.pmod(F.xxhash64("one", "other"), F.lit(slots)).cast("int").alias("slot"), "one", "other", F.lit(0).alias("side")), "requests")

    def match(rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        for _, node, _, sets in _by_group(rows):
            groups = grouped(sets, percent)
            roots = [groups.of(k) for k in range(len(sets))]
            out += [(int(node[k]), int(node[r])) for k, r in enumerate(roots) if k != r]
            out += [(int(node[r]), int(node[r])) for r in {r for k, r in enumerate(roots) if k != r}]
        return pa.table({"component": pa.array([a for a, _ in out], pa.int64()), "joined": pa.array([b for _, b in out], pa.int64())})

    found = written(sets_for(docs, requests, common, words).groupBy("slot").applyInArrow(match, "component long, joined long"), "joined")
    discard(routes, loads, requests)
    return found


def met_by_blocks(docs: DataFrame, routes: DataFrame, nodes: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """(a, b): linked components of nodes that have one of ``routes`` (node, component, n, r0, r1, ...) in common.

    Each group's nodes are in blocks, a component too large for one in blocks of its own; all pairs of blocks meet but those of
    one component.
    """
    rows = routes.select("node", "component", "n", F.explode(F.array_distinct(F.array(*(f"r{t}" for t in range(MEETINGS))))).alias("one"))
    several = rows.groupBy("one").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("one")
    rows = written(rows.join(several, "one", "left_semi"), "meeting")
    loads = rows.groupBy("one", "component").agg(F.sum("n").alias("load")).withColumn("cuts", (F.col("load") / GROUP_ITEMS).cast("int"))
    pool = loads.where("cuts = 0").groupBy("one").agg((F.sum("load") / GROUP_ITEMS).cast("int").alias("pool"))
    large = written(loads.where("cuts > 0").select("one", "component", "cuts"), "large")
    at = rows.join(large, ["one", "component"], "left").join(pool, "one", "left")
    # a block: of one component (owner), or of several small ones (no owner)
    at = at.select("one", "node", "component", "n", F.when(F.col("cuts").isNotNull(), F.col("component")).alias("owner"), F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("cuts") + 1)).otherwise(F.pmod(F.xxhash64("component"), F.coalesce("pool", F.lit(0)) + 1)).alias("sub"))
    at = written(at.withColumn("block", F.xxhash64(F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), "sub")), "blocks")
    held = at.groupBy("one", "block").agg(F.first("owner").alias("owner"), F.sum("n").alias("load"))
    a, b = (held.select("one", *(F.col(c).alias(c + x) for c in ("block", "owner", "load"))) for x in "ab")
    pairs = a.join(b, "one").where((F.col("blocka") <= F.col("blockb")) & ~F.coalesce(F.col("ownera") == F.col("ownerb"), F.lit(False)))
    pairs = written(pairs.select("one", "blocka", "blockb", (F.col("loada") + F.col("loadb")).alias("load")), "block_pairs")
    slots = int((pairs.agg(F.sum("load")).first()[0] or 0) // GROUP_ITEMS) + 1
    pair = F.xxhash64("blocka", "blockb").alias("other")
    sides = pairs.select("one", pair, F.col("blocka").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("blocka < blockb").select("one", pair, F.col("blockb").alias("block"), F.lit(1).alias("side")))
    rows = at.join(sides, ["one", "block"]).join(nodes.select("node", "key"), "node")
    requests = written(rows.select("key", "node", "component", F.pmod(F.xxhash64("one", "other"), F.lit(slots)).cast("int").alias("slot"), "one", "other", "side"), "requests")

    def match(rows: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        for _, component, side, sets in _by_group(rows):
            order = np.argsort(-side, kind="stable")  # the second side is held in the trie, if there is one
            known = component[order].tolist()
            groups = grouped([sets[k] for k in order], percent, known, int(side.sum()) or None)
            found = ((own, known[groups.of(k)]) for k, own in enumerate(known))
            out |= {(min(pair), max(pair)) for pair in found if pair[0] != pair[1]}
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    found = written(sets_for(docs, requests, common, words).groupBy("slot").applyInArrow(match, "a long, b long").distinct(), "meetings")
    discard(large, at, pairs, requests)
    return found


def links_between(docs: DataFrame, at: DataFrame, routes: DataFrame, done: DataFrame, nodes: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """(a, b): all pairs of components that are linked, share an n-gram of ``at``, and neither met by ``routes`` nor are ``done``."""
    turns = range(MEETINGS)
    at = at.join(routes.drop("component", "n"), "node", "left")
    # a partner all of whose nodes in the n-gram chose the same has met those that chose it too
    same = (F.when((F.min(f"r{t}") == F.max(f"r{t}")) & (F.count(f"r{t}") == F.count("*")), F.min(f"r{t}")).alias(f"all{t}") for t in turns)
    there = at.groupBy("gram", F.col("component").alias("partner")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("far"), *same)
    sizes = (F.col("least") <= F.col("reach")) & (F.col("far") >= F.col("n")) & (F.col("least") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("most") * 100)
    met = reduce(Column.__or__, (F.coalesce(F.col(f"r{t}") == F.col(f"all{u}"), F.lit(False)) for t in turns for u in turns))
    near = at.join(there, "gram").where((F.col("component") != F.col("partner")) & sizes & ~met)
    near = near.groupBy("node", "n", "component", "partner").agg(F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most"))
    # prefixes share the fewest n-grams with the smallest or the largest partner there can be
    low = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    high = F.least("most", F.floor(F.col("n") * 100 / percent))
    near = near.where((low <= high) & (F.col("shared") >= F.least(least_shared(F.col("n"), low, percent), least_shared(F.col("n"), high, percent))))
    near = near.select("node", "n", F.least("component", "partner").alias("one"), F.greatest("component", "partner").alias("other"), "component", (F.col("component") > F.col("partner")).cast("int").alias("side"))
    near = written(near.join(done.select(F.col("a").alias("one"), F.col("b").alias("other")), ["one", "other"], "left_anti"), "near")
    # a side of any size is cut; each part of one side meets each part of the other
    loads = near.groupBy("one", "other").agg(*(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"load{s}") for s in (0, 1))).where("load0 > 0 and load1 > 0")
    loads = written(loads.select("one", "other", "load0", "load1", *((F.col(f"load{s}") / GROUP_ITEMS).cast("int").alias(f"cuts{s}") for s in (0, 1))), "loads")
    slots = int((loads.agg(F.sum(F.col("load0") * (F.col("cuts1") + 1) + F.col("load1") * (F.col("cuts0") + 1))).first()[0] or 0) // GROUP_ITEMS) + 1
    own, across = (F.when(F.col("side") == s, F.col("cuts0")).otherwise(F.col("cuts1")) for s in (0, 1))
    rows = near.join(loads, ["one", "other"]).withColumns({"own": F.pmod(F.xxhash64("node"), own + 1), "across": F.explode(F.sequence(F.lit(0), across))})
    own, across = F.col("own").cast("long"), F.col("across").cast("long")
    block = F.struct(F.when(F.col("side") == 0, own).otherwise(across).alias("i"), F.when(F.col("side") == 0, across).otherwise(own).alias("j"))
    slot = F.pmod(F.xxhash64("one", "other", block), F.lit(slots)).cast("int")
    rows = rows.join(nodes.select("node", "key"), "node").select("key", "node", "component", slot.alias("slot"), "one", "other", "side")
    requests = written(rows, "requests")

    def match(rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        for pair, _, side, sets in _by_group(rows):
            probes, others = ([s for s, own in zip(sets, side, strict=True) if own == k] for k in (0, 1))
            if probes and others:
                trie = Trie.of(others)
                if any(True for items in probes for _ in trie.probe(items, percent)):
                    out.append(pair)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    found = written(sets_for(docs, requests, common, words).groupBy("slot").applyInArrow(match, "a long, b long"), "links")
    discard(near, loads, requests)
    return found


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), "text", F.when(doc_id.isNull(), F.xxhash64("text")).otherwise(F.xxhash64(doc_id)).alias("key"))
    common = common_grams(docs, words)
    drawn = written(sketches(docs, common, words, percent), "sketches")
    slim = written(drawn.select("doc_id", "n", "node"), "sizes")
    classes = written(drawn.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("key").alias("key"), F.min("doc_id").alias("doc_id"), F.first("small").alias("small"), F.first("first").alias("first")), "classes")
    discard(drawn)
    nodes = written(classes.drop("first"), "nodes")

    # n-grams that several nodes hold, and how large a partner each node can have
    rows = classes.select("node", "n", "small", F.posexplode("first").alias("place", "gram"))
    several = rows.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    held = written(rows.join(several, "gram", "left_semi"), "held")
    discard(classes)
    own = F.count_if((F.col("gram") >= 0) & (F.col("gram") < smallest(percent)))
    reach = held.groupBy("node", "n", "small").agg(own.alias("shared")).select("node", "n", largest_partner(F.col("n"), F.col("small") - F.col("shared"), percent).alias("reach"))
    reach = reach.where(F.col("reach") * 100 >= F.col("n") * percent).select("node", "reach")
    members = written(held.where(F.col("place") < prefix_size(F.col("n"), percent)).select("node", "n", "gram").join(reach, "node"), "members")
    discard(held)

    labels = None
    for turn in range(ROUNDS):
        # sets that look as if they had a partner of their own size; all others wait for the pairs of components
        at = labelled(members.where("reach >= n"), labels)
        found = met_in_groups(docs, mixed(at) if turn else at, nodes, common, words, percent, turn)
        if labels is None:
            labels = found.select(F.col("component").alias("node"), F.col("joined").alias("component"))
        else:
            moved = labels.join(found, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
            alone = found.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("joined").alias("component"))
            labels = written(moved.unionByName(alone), "labels")
    routes = written(meeting_routes(labelled(members.where("reach >= n"), labels)), "routes")
    met = met_by_blocks(docs, routes, nodes, common, words, percent)
    at = written(mixed(labelled(members, labels)), "mixed")
    discard(members)
    links = links_between(docs, at, routes, met, nodes, common, words, percent).unionByName(met)
    discard(at, routes)

    # a doc_id with several sets links them
    named = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    shared = written(slim.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("doc_id", "low"), "shared_ids")
    if shared.count():
        same = slim.where("n > 0").join(shared, "doc_id").where("node != low").select("node", "low").distinct()
        ends = named.select("node", "component")
        same = same.join(ends, "node").select("low", F.col("component").alias("a")).join(ends.withColumnRenamed("node", "low"), "low").select("a", F.col("component").alias("b"))
        links = links.unionByName(same)
    roots = components(links).select(F.col("node").alias("component"), F.col("component").alias("root"))
    own = written(named.join(roots, "component", "left").select("node", "doc_id", F.coalesce("root", "component").alias("root")), "roots")
    names = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = own.join(names, "root").select("node", "component_id")
    # empty sets are no node: they are their own component
    out = slim.join(known, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
