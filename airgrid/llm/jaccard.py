"""Exact Jaccard join of word shingles by vertical partitioning, and its components.

The global order of shingles is (common, hash): the rare ones by hash, then the common ones. Hash ranges cut it into FRAGMENTS. Two
sets can only link if their prefixes in that order share shingles, a number that grows with their size, so prefixes give the
candidates. For a candidate
pair the overlaps are counted fragment by fragment, each on its own, and summed per pair: the first fragment with a bound on the
others drops most pairs, the rest are joined fragment by fragment for those left.

Texts are read three times and never move: for set sizes, signatures and prefixes; again for the shingles that prefixes share,
once it is known which are common and which stand alone; and for the sets of candidates. What the passes need of each other are
bitmaps sized by counts up to a bound, in which a false hit costs time and changes nothing.

No group is expanded into its pairs. Equal sets are one node. A shingle shared by up to SMALL nodes gives its pairs. One shared
by more gives centres, and each member a pair with a few of them, in rounds, as long as members lie in different components; what is
still apart then is compared exactly in blocks of BLOCK nodes that return a spanning forest of their links. A pair already in one
component needs no test, since only components are returned.

Words are runs of non-blank bytes, A-Z lowered; a set is the distinct runs of SIZE words (the whole sequence if shorter) as 64-bit
hashes. Null and wordless texts have the empty set and link with nothing. Repeated rows and equal texts are one node. Null doc_id
takes part, but names a component only if no other does (its component_id is then null). Ties do not arise: links are a threshold.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm import _store, _words

SIZE, NUMERATOR = 4, 85
FRAGMENTS = 8
SMALL, COMMON = 32, 32
ROUNDS, CENTRES, DRAWS = 3, 3, 6
BLOCK = 512
#: Bits of a bitmap for each value, and at most (16 MB).
BITS, MAP_BITS = 8, 1 << 27
#: Links that one task resolves; more are resolved by joins.
EDGES = 1 << 21


# ---- sets ------------------------------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size of each text, all sets' hashes by text and hash, text of each hash)."""
    h, owner = _words.words(texts, _words.NOT_BLANK)
    n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    grams, whose = [], []
    full = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :]) if len(h) >= size else np.zeros(0, np.int64)
    grams.append(_chain([h[full + k] for k in range(size)], size))
    whose.append(owner[full])
    begin = np.cumsum(n) - n
    for m in range(1, size):
        docs = np.flatnonzero(n == m)
        if len(docs):
            grams.append(_chain([h[begin[docs] + k] for k in range(m)], m))
            whose.append(docs)
    g, w = np.concatenate(grams), np.concatenate(whose)
    order = np.lexsort((g, w))
    g, w = g[order], w[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    g, w = g[new], w[new]
    return np.bincount(w, minlength=len(texts)).astype(np.int64), g, w


def _chain(parts: list[np.ndarray], length: int) -> np.ndarray:
    out = np.full(len(parts[0]), length, dtype=np.uint64)
    for p in parts:
        out = _words.mix(out * np.uint64(0xD1342543DE82EF95) + p)
    return out


def signatures(g: np.ndarray, w: np.ndarray, texts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each set: its node, and a check of it."""
    out = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        x = np.zeros(texts, dtype=np.uint64)
        np.add.at(x, w, _words.mix(g ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        out.append(_words.mix(x + np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def hits(n):
    """Shared shingles that prefixes of sets of n must have at least, if the sets share as many; grows with n. Works on arrays and
    on columns alike."""
    return n * 3 // 100 + 1 if isinstance(n, np.ndarray) else F.floor(n * 3 / 100) + 1


def need(n: np.ndarray, numerator: int = NUMERATOR) -> np.ndarray:
    """Length of a prefix: the first hits(n) shingles that a set shares with any it links to lie within."""
    return np.minimum(n, n - -(-numerator * n // 100) + hits(n))


def prefixes(n: np.ndarray, g: np.ndarray, w: np.ndarray, common: np.ndarray | None, numerator: int) -> np.ndarray:
    """Which hashes lie in their set's prefix; common: a flag for each hash."""
    begin = np.cumsum(n) - n
    if common is None:
        return np.arange(len(g)) - begin[w] < need(n, numerator)[w]
    order = np.lexsort((g, common, w))
    out = np.zeros(len(g), dtype=bool)
    out[order] = np.arange(len(g)) - begin[w] < need(n, numerator)[w]
    return out


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


# ---- bitmaps ---------------------------------------------------------------------------------------------------------


class Bitmap:
    """A bit per value, so that few others pass: a filter ahead of joins that are exact without it."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = (_words.mix(x.view(np.uint64)) & self.mask).astype(np.int64)
        return (self.words.view(np.uint64)[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def bitmap(df: DataFrame, column: str) -> Bitmap:
    """Of the values of a stored column: BITS bits for each row, a power of two of at most MAP_BITS, so one value in BITS passes that
    is not there, more only beyond MAP_BITS / BITS values. Tasks make words; at most MAP_BITS / 64 reach the driver."""
    bits = min(MAP_BITS, 1 << max(12, int(BITS * df.count() - 1).bit_length()))

    def run(batches):
        seen = np.zeros(bits, dtype=bool)
        for b in batches:
            seen[(_words.mix(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)] = True
        packed = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(packed[at])], names=["at", "word"])

    rows = df.select(F.col(column).cast("long")).mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return Bitmap(out)


# ---- passes over the texts -------------------------------------------------------------------------------------------


def _pass(docs: DataFrame, each, schema: str, size: int) -> DataFrame:
    """each(texts, n, hashes, owners, ids) gives the columns of a batch."""

    def run(batches):
        for b in _words.small_batches(batches, "text", 2 << 20):
            n, g, w = shingle_sets(b.column(1), size)
            out = each(b, n, g, w)
            if out is not None:
                yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def measure(docs: DataFrame, numerator: int = NUMERATOR, seed: int = 0, size: int = SIZE) -> DataFrame:
    """doc_id, node, chk, n, prefix."""

    def each(b, n, g, w):
        node, chk = signatures(g, w, b.num_rows, seed)
        pre = prefixes(n, g, w, None, numerator)
        return pa.record_batch([b.column(0), pa.array(node), pa.array(chk), pa.array(n.astype(np.int32)), _lists(g[pre], w[pre], b.num_rows)], names=["doc_id", "node", "chk", "n", "prefix"])

    return _pass(docs, each, "doc_id long, node long, chk long, n int, prefix array<long>", size)


def shared_prefixes(docs: DataFrame, shared: Broadcast, common: Broadcast, numerator: int, seed: int, size: int = SIZE) -> DataFrame:
    """token, node, n, fresh: prefixes with common shingles last, without the shingles known to stand alone among prefixes in plain
    hash order; fresh: not in that one."""

    def each(b, n, g, w):
        node, _ = signatures(g, w, b.num_rows, seed)
        old, flag = prefixes(n, g, w, None, numerator), common.value.holds(g)
        new = prefixes(n, g, w, flag, numerator)
        ok = np.flatnonzero(new & (~old | shared.value.holds(g)))
        return pa.record_batch([pa.array(g[ok].view(np.int64)), pa.array(node[w[ok]]), pa.array(n[w[ok]].astype(np.int32)), pa.array(~old[ok])], names=["token", "node", "n", "fresh"])

    return _pass(docs, each, "token long, node long, n int, fresh boolean", size)


def met_by_fresh(found: DataFrame, fresh: Broadcast) -> DataFrame:
    """token, node, n: shingles of the stored plain prefixes that may stand in another set's prefix only since common ones went
    last."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            ok = np.flatnonzero(fresh.value.holds(values))
            yield pa.record_batch([pa.array(values[ok].view(np.int64)), b.column(0).take(pa.array(owner[ok])), b.column(1).take(pa.array(owner[ok]))], names=["token", "node", "n"])

    return found.select("node", "n", "prefix").mapInArrow(run, "token long, node long, n int")


def sets_of(docs: DataFrame, nodes: Broadcast, seed: int, size: int = SIZE) -> DataFrame:
    """node, frag, tokens: the sets of (a superset of) the nodes, one row per fragment that is not empty."""

    def each(b, n, g, w):
        node, _ = signatures(g, w, b.num_rows, seed)
        ok = nodes.value.holds(node)[w]
        g, w = g[ok], w[ok]
        if not len(g):
            return None
        frag = (g >> np.uint64(61)).astype(np.int64)
        key = w * FRAGMENTS + frag  # ascending: hashes are in order within a text
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        return pa.record_batch([pa.array(node[w[first]]), pa.array(frag[first].astype(np.int32)), _lists(g, rank, len(first))], names=["node", "frag", "tokens"])

    return _pass(docs, each, "node long, frag int, tokens array<long>", size).dropDuplicates(["node", "frag"])


def held(sets: DataFrame, nodes: Broadcast) -> DataFrame:
    """The rows of sets of (a superset of) the nodes, so that a join with few nodes does not move all sets."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(nodes.value.holds(b.column(0).to_numpy())))

    return sets.select("node", "frag", "tokens").mapInArrow(run, "node long, frag int, tokens array<long>")


# ---- candidates, overlaps, links -------------------------------------------------------------------------------------


def _fits(a: Column, b: Column, numerator: int) -> Column:
    return (F.least(a, b).cast("long") * 100 >= F.greatest(a, b).cast("long") * numerator)


def pairs_of_small(members: DataFrame, numerator: int) -> DataFrame:
    """a < b with their sizes, from shingles of few members: pairs that meet in as many prefix shingles as linked ones must, if they
    share all shingles of many members (big: how many a node has) that they can."""
    lists = members.groupBy("token").agg(F.collect_list(F.struct("node", "n", "big")).alias("all"))
    one = lists.select(F.explode("all").alias("x"), "all")
    both = one.select("x", F.explode(F.filter("all", lambda y: (y["node"] > F.col("x.node")) & _fits(y["n"], F.col("x.n"), numerator))).alias("y"))
    met = both.groupBy(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb")).agg((F.count(F.lit(1)) + F.max(F.least("x.big", "y.big"))).alias("c"))
    total = F.col("na").cast("long") + F.col("nb")
    enough = (F.col("c") >= hits(F.least("na", "nb"))) | ((100 + numerator) * F.col("c") >= numerator * total)
    return met.where(enough).drop("c")


def links_among(pairs: DataFrame, sets: DataFrame, numerator: int, own: _store.Scratch) -> DataFrame:
    """The stored pairs that link, stored: overlaps counted fragment by fragment, then summed per pair."""
    exact = lambda o: (100 + numerator) * o >= numerator * (F.col("na").cast("long") + F.col("nb"))
    side = lambda s, name: s.select(F.col("node").alias(name), F.col("tokens").alias(f"t{name}"), F.col("frag").alias(f"f{name}"))
    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select("b"))
    low = held(sets.where("frag = 0"), own.send(bitmap(ends(pairs), "node")))
    empty = F.array().cast("array<bigint>")
    first = pairs.join(side(low, "a").drop("fa"), "a", "left").join(side(low, "b").drop("fb"), "b", "left")
    ta, tb = F.coalesce("ta", empty), F.coalesce("tb", empty)
    first = first.withColumns({"o": F.size(F.array_intersect(ta, tb)), "rest": F.least(F.col("na") - F.size(ta), F.col("nb") - F.size(tb))})
    left = own.written(first.where(exact(F.col("o") + F.col("rest"))).select("a", "na", "b", "nb", "o"), "jaccard-left")
    cut = left.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(FRAGMENTS - 1))).alias("frag"))
    high = held(sets.where("frag > 0"), own.send(bitmap(ends(left), "node")))
    cut = cut.join(side(high, "a").withColumnRenamed("fa", "frag"), ["a", "frag"]).join(side(high, "b").withColumnRenamed("fb", "frag"), ["b", "frag"])
    parts = cut.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("o"))
    total = left.select("a", "b", "o").unionByName(parts).groupBy("a", "b").agg(F.sum("o").alias("overlap"))
    out = own.written(left.drop("o").join(total, ["a", "b"]).where(exact(F.col("overlap"))).select("a", "b"), "jaccard-links")
    own.drop(left)
    return out


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node of the links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # roots go under smaller roots
        while not np.array_equal(label, label[label]):
            label = label[label]
    return nodes, nodes[label]


def _shrunk(batches, limit: int):
    """Links as stars, limit of them at a time at least."""
    u, v, n = [], [], 0

    def emit():
        x, root = stars(np.concatenate(u), np.concatenate(v))
        some = np.flatnonzero(x != root)
        return pa.record_batch([pa.array(x[some]), pa.array(root[some])], names=["u", "v"])

    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
        n += b.num_rows
        if n >= limit:
            yield emit()
            u, v, n = [], [], 0
    if u:
        yield emit()


def components(links: DataFrame, own: _store.Scratch) -> DataFrame:
    """node, comp: the smallest node of its component, for all nodes in links, stored. Tasks first shrink what they hold to stars. Up to
    EDGES links that are left are resolved by one task, more by large-star and small-star steps in turn, as aggregates and joins,
    until nothing changes."""
    edges = own.written(links.select("a", "b").mapInArrow(lambda batches: _shrunk(batches, 500_000), "u long, v long"), "links-0")
    if edges.count() <= EDGES:
        flat = edges.coalesce(1).mapInArrow(lambda batches: _shrunk(batches, EDGES + 1), "u long, v long")
        out = own.written(flat, "links")
        own.drop(edges)
        edges = out
    else:
        edges = _settled(edges, own)
    roots = edges.select(F.col("v").alias("node")).distinct()
    out = own.written(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.withColumn("comp", F.col("node"))), "jaccard-labels")
    own.drop(edges)
    return out


def _settled(edges: DataFrame, own: _store.Scratch) -> DataFrame:
    before = None
    for _ in range(60):
        # every node's neighbours v > u go to the smallest of u and all its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = own.written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        own.drop(edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return edges


def _apart(members: DataFrame, labels: DataFrame | None, own: _store.Scratch) -> DataFrame:
    """Members of shingles whose members lie in more than one component, with comp, stored."""
    known = members.withColumn("comp", F.col("node")) if labels is None else _store.bounded_join(members, labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return own.written(known.join(open_, "token"), "jaccard-apart")


def links_in_blocks(apart: DataFrame, sets: DataFrame, numerator: int, own: _store.Scratch) -> DataFrame:
    """Links between components that meet in a shingle, stored, by exact comparison of blocks. Only nodes of one family of shingles and
    of one or two neighbouring bands of size meet: sets of sizes further apart cannot link."""
    hub = apart.groupBy("token").agg(F.min("node").alias("hub"))
    ties = apart.join(hub, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    family = components(ties, own).withColumnRenamed("comp", "family")
    band = F.floor(F.log(F.col("n").cast("double")) * (0.999 / np.log(100 / numerator) if numerator < 100 else 1e6)).cast("long")
    nodes = apart.select("node", "n", "comp").distinct().join(family, "node").withColumn("band", F.explode(F.array(band, band - 1)))
    many = nodes.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi")
    placed = nodes.join(many, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("node", "n", "comp", "family", "band", "block", other).select("node", "n", "comp", "family", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    whole = held(sets, own.send(bitmap(apart, "node"))).groupBy("node").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))

    def compare(table: pa.Table) -> pa.Table:
        node, comp = table["node"].to_numpy(), table["comp"].to_pylist()
        tokens = table["tokens"].combine_chunks()
        n = np.diff(tokens.offsets.to_numpy())
        values = tokens.flatten().to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
        code = np.empty(len(values), dtype=np.int64)
        code[order] = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        begin = np.concatenate([[0], np.cumsum(n)])
        forest, out = Forest(), []
        for k in range(len(n)):
            seen = np.concatenate([owner[cut[c] : cut[c + 1]] for c in code[begin[k] : begin[k + 1]]]) if n[k] else np.zeros(0, np.int64)
            overlap = np.bincount(seen, minlength=len(n))
            near = np.flatnonzero((100 + numerator) * overlap >= numerator * (n + n[k]))
            for x in near[near > k].tolist():
                if forest.join(comp[k], comp[x]):
                    out.append((int(node[k]), int(node[x])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    out = own.written(dealt.join(whole, "node").groupBy("family", "band", "i", "j").applyInArrow(compare, "a long, b long"), "jaccard-links")
    own.drop(family)
    return out


def _link(docs: DataFrame, numerator: int, size: int = SIZE) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, node and n of every document; node and comp of every linked node; the seed of the nodes), stored."""
    own = _store.Scratch(docs.sparkSession)
    _store.text_batches(docs.sparkSession)
    for seed in range(8):
        found = own.written(measure(docs, numerator, seed, size), "jaccard-sets")
        clash = found.groupBy("node").agg((F.min("chk") != F.max("chk")).alias("x")).where("x").limit(1).count()
        if not clash:
            break
        own.drop(found)
    rows = own.written(found.select("doc_id", "node", "n"), "jaccard-rows")
    tokens = found.select("node", F.explode("prefix").alias("token"))
    met = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token", "m")
    met = own.written(met, "jaccard-met")
    shared, common = own.send(bitmap(met, "token")), own.send(bitmap(met.where(F.col("m") > COMMON), "token"))
    plain = own.written(shared_prefixes(docs, shared, common, numerator, seed, size), "jaccard-prefixes")
    own.drop(met)
    more = met_by_fresh(found, own.send(bitmap(plain.where("fresh"), "token")))
    every = own.written(plain.drop("fresh").unionByName(more).groupBy("token", "node").agg(F.max("n").alias("n")), "jaccard-tokens")
    own.drop(plain, found)
    met = every.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = own.written(every.join(met, "token"), "jaccard-buckets")
    own.drop(every)
    big = members.where(F.col("m") > SMALL).drop("m")
    carried = big.groupBy("node").agg(F.count(F.lit(1)).alias("big"))
    few = members.where(F.col("m") <= SMALL).join(carried, "node", "left").withColumn("big", F.coalesce("big", F.lit(0).cast("long")))
    pairs = own.written(pairs_of_small(few, numerator), "jaccard-pairs")
    # a linked pair without a shingle of few members meets in these alone: who holds too few of them for that has no such pair
    least = F.least(hits(F.floor(F.col("n") * numerator / 100)), F.ceil(F.col("n") * numerator / 100))
    big = own.written(big.join(carried.where("big > 0"), "node").where(F.col("big") >= least).drop("big"), "jaccard-big")
    own.drop(members)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).unionByName(big.select("node"))
    sets = own.written(sets_of(docs, own.send(bitmap(wanted, "node")), seed, size), "jaccard-fragments")
    links = links_among(pairs, sets, numerator, own)
    own.drop(pairs)
    labels = components(links, own)
    tested = None
    for r in range(ROUNDS):
        apart = _apart(big, labels, own)
        if apart.isEmpty():
            own.drop(apart, sets, big)
            return rows, labels, seed
        # each node draws a few of its shingles before it meets their centres, and tries one that it may link to of each
        centres = apart.groupBy("token").agg(*[f(x, F.xxhash64("node", "token", F.lit(CENTRES * r + k))).alias(f"{x}{k}") for k in range(CENTRES) for f, x in ((F.min_by, "node"), (F.min_by, "n"), (F.min_by, "comp"))])
        centres = centres.select("token", F.array(*[F.struct(F.col(f"node{k}").alias("node"), F.col(f"n{k}").alias("n"), F.col(f"comp{k}").alias("comp")) for k in range(CENTRES)]).alias("all"))
        draws = [F.min_by("token", F.xxhash64("token", "node", F.lit(100 + DRAWS * r + k))).alias(f"d{k}") for k in range(DRAWS)]
        drawn = apart.groupBy("node", "n", "comp").agg(*draws).select("node", "n", "comp", F.explode(F.array_distinct(F.array(*[f"d{k}" for k in range(DRAWS)]))).alias("token"))
        fit = F.filter("all", lambda c: (c["comp"] != F.col("comp")) & _fits(F.col("n"), c["n"], numerator))
        star = drawn.join(centres, "token").withColumn("fit", fit).where(F.size("fit") > 0)
        star = star.select("node", "n", F.get("fit", F.pmod(F.xxhash64("node", "token"), F.size("fit")).cast("int")).alias("c"))
        star = star.groupBy("node", "n").agg(F.slice(F.collect_set("c"), 1, CENTRES).alias("c")).select("node", "n", F.explode("c").alias("c"))
        order = F.col("node") < F.col("c.node")
        pick = lambda x, y: F.when(order, F.col(x)).otherwise(F.col(y))
        star = star.select(pick("node", "c.node").alias("a"), pick("n", "c.n").alias("na"), pick("c.node", "node").alias("b"), pick("c.n", "n").alias("nb")).distinct()
        if tested is not None:
            star = star.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        star = own.written(star, "jaccard-star")
        own.drop(apart)
        tested = star if tested is None else tested.unionByName(star)
        labels = _joined(labels, links_among(star, sets, numerator, own), own)
    apart = _apart(big, labels, own)
    if not apart.isEmpty():
        labels = _joined(labels, links_in_blocks(apart, sets, numerator, own), own)
    own.drop(apart, sets, big)
    return rows, labels, seed


def _joined(labels: DataFrame, links: DataFrame, own: _store.Scratch) -> DataFrame:
    """labels with further links."""
    out = components(links.unionByName(labels.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))), own)
    own.drop(labels, links)
    return out


def with_node(rows: DataFrame, text: str, seed: int, size: int = SIZE) -> DataFrame:
    """rows with node, that of the text, in one pass that moves nothing."""
    names = rows.columns

    def run(batches):
        for b in _words.small_batches(batches, text, 2 << 20):
            n, g, w = shingle_sets(b.column(names.index(text)), size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signatures(g, w, b.num_rows, seed)[0])], names=[*names, "node"])

    return rows.mapInArrow(run, rows.withColumn("node", F.lit(0).cast("long")).schema)


def representatives(docs: DataFrame, numerator: int = NUMERATOR, size: int = SIZE) -> DataFrame:
    """docs with one row of each component, that whose doc_id names it; rows with the empty set all stay."""
    inner, names = _store.inner(docs)
    doc, text = _store.place(names, "doc_id"), _store.place(names, "text")
    inner = inner.withColumn(text, F.col(text).cast("string"))
    rows, labels, seed = _link(inner.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), numerator, size)
    named = _store.written(_named(rows, labels), "jaccard-classes").where("n > 0")
    stay = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = named.where(~stay).select("doc_id", "node")
    twice = named.where(stay).groupBy("doc_id", "node", "comp").agg(F.count(F.lit(1)).alias("k"))
    many = twice.withColumn("one", F.min("node").over(Window.partitionBy("comp"))).where((F.col("k") > 1) | (F.col("node") != F.col("one"))) if twice.groupBy("comp").agg(F.sum("k").alias("k")).where("k > 1").limit(1).count() else None
    gone = _store.written(gone.distinct().select(F.col("doc_id").alias("id"), F.col("node").alias("gone")), "jaccard-gone")
    noded = with_node(inner, text, seed, size)
    same = F.col(doc).cast("long").eqNullSafe(F.col("id")) & (F.col("node") == F.col("gone"))
    kept = _store.bounded_join(noded, gone, same, "left_anti")
    if many is not None:  # rows repeated under one doc_id: one of them
        many = _store.written(many.select(F.col("doc_id").alias("id"), F.col("node").alias("gone"), "one"), "jaccard-many")
        again = kept.join(many, same, "left")
        kept = again.where("one IS NULL").select(*kept.columns).unionByName(again.where("one = node").dropDuplicates([doc, "node"]).select(*kept.columns))
    return kept.select(*inner.columns).toDF(*names)


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with comp and component_id."""
    rows = rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    full = rows.where("n > 0")
    least = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    least = _store.written(least, "jaccard-least")
    named = _store.bounded_join(full, least, "comp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return named.unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")))


def classes(docs: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """doc_id, node, n_shingles, component_id of every document."""
    rows, labels, _ = _link(docs, numerator)
    return _named(rows, labels).select("doc_id", "node", F.col("n").cast("long").alias("n_shingles"), "component_id")
