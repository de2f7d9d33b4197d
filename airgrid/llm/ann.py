"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Largest inner product becomes nearest in Euclid's distance: a vector v is scaled by the largest norm and gets one more component,
sqrt(1 - |v|^2); a query is scaled to norm 1 and gets 0. Each of TABLES tables hashes a point by m functions
floor((a.x + b) / WIDTH) with Gaussian a; m grows with the logarithm of the rows, so buckets keep their size.

A point at distance d from a query projects to a place that is normal around the query's own, with deviation d. So each bucket has
an estimated success: the chance that such a point lies in it. A query visits its buckets in falling order of that, in all tables
alike, until a point as far as its k-th neighbour would be met with the chance TARGET. How far that neighbour is, a bounded sample
says at first. Once the buckets are searched, the k-th score found bounds it from above: a query that would meet a point so
far with a chance under ENOUGH visits further buckets in a second round. So each query gets its own number of visits, whatever its
neighbours' density and that of others. Queries with fewer than k hits, and those for which all MOVES buckets listed would not be
enough, are compared with all rows in blocks (on vectors without outliers there are none).

Every row is indexed, and candidates of all tables are ranked by exact inner products in double precision on the original
vectors. Buckets are dealt to groups of about GROUP vectors, larger buckets being split over several; a query goes once to each
group that holds a bucket it visits, with the list of those buckets. A task multiplies each bucket with the queries that visit it,
QUERIES of them at a time, and keeps each query's k best.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part; so do rows
without a vec_id. A row repeated under one vec_id counts once, with its best score; a query's own vec_id is never returned. Ties go
to the smaller vec_id. With no queries or no candidates there are no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, product
from math import comb, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm import _store

TABLES, WIDTH = 2, 1.5
TARGET, ENOUGH = 0.9, 0.85
MOVES = 4096
SAMPLE, SAMPLE_QUERIES = 4000, 200
BUCKET, GROUP, QUERIES = 100, 8192, 4096
#: Candidates held before they are ranked, and queries compared with all rows at once.
HELD, CHUNK = 1 << 19, 20_000
_GRID = np.linspace(-8.0, 8.0, 8001)
_CDF = np.array([(1 + erf(x / sqrt(2))) / 2 for x in _GRID])
_NEAR, _MORE, _OPEN = 0, 1, 2


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (as it is if of floats, else array<double>), norm; only vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    if rows.schema["v"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    return rows.where("norm > 0")


def _chances(f: np.ndarray, d: np.ndarray, reach: int = 2) -> np.ndarray:
    """Chance that a point at distance d projects to the slot s of each function, s from -reach to reach around the query's own, in
    which the query lies at f."""
    edges = (np.arange(-reach, reach + 2) - f[..., None]) * WIDTH / d[:, None, None]
    return np.diff(np.interp(edges, _GRID, _CDF), axis=-1)


def moves(m: int, limit: int = MOVES) -> np.ndarray:
    """Changes of m slots by two at most: the kinds (so many by one, so many by two) likeliest on average that make up limit rows."""
    each = _chances(np.linspace(0.01, 0.99, 99)[:, None], np.ones(99)).mean(axis=(0, 1))
    one, two = log(each[3] / each[2]), log(each[4] / each[2])
    kinds = sorted(((c1 * one + c2 * two, c1, c2) for c1 in range(m + 1) for c2 in range(m + 1 - c1)), reverse=True)
    out, n = [], 0
    for _, c1, c2 in kinds:
        n += comb(m, c1) * comb(m - c1, c2) * 2 ** (c1 + c2)
        if n > limit and len(out) > 1:
            break
        for at in combinations(range(m), c1):
            rest = [k for k in range(m) if k not in at]
            for far in combinations(rest, c2):
                for sign in product((-1, 1), repeat=c1 + c2):
                    row = np.zeros(m, dtype=np.int64)
                    row[list(at)] = sign[:c1]
                    row[list(far)] = 2 * np.array(sign[c1:], dtype=np.int64)
                    out.append(row)
    return np.array(out)


class Hashing:
    def __init__(self, dim: int, m: int, top: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.m, self.top = m, top
        self.a = rng.standard_normal((TABLES, dim + 1, m))
        self.b = rng.uniform(0, WIDTH, (TABLES, m))
        self.moves = moves(m)

    def points(self, v: np.ndarray) -> np.ndarray:
        x = v / self.top
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """From queries to the points that score so."""
        return np.sqrt(np.maximum(2 - 2 * score / (np.linalg.norm(q, axis=1) * self.top), 1e-12))

    def slots(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        y = (x @ self.a[t] + self.b[t]) / WIDTH
        s = np.floor(y)
        return s.astype(np.int64), y - s

    def code(self, slots: np.ndarray, t: int) -> np.ndarray:
        out = np.full(slots.shape[:-1], t + 1, dtype=np.uint64)
        for k in range(self.m):
            out = (out ^ (slots[..., k].astype(np.uint64) & np.uint64(0xFFFF))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(1)).astype(np.int64)

    def success(self, f: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Chance that a point at distance d lies in each bucket that a move leads to."""
        logs = np.log(np.maximum(_chances(f, d), 1e-30))
        out = np.zeros((len(f), len(self.moves)))
        for k in range(self.m):
            out += logs[:, k, :][:, self.moves[:, k] + 2]
        return np.exp(out)

    def plan(self, x: np.ndarray, d: np.ndarray, target: float) -> tuple[list, np.ndarray, np.ndarray]:
        """For queries x whose k-th neighbours lie at d: in each table (slots, success, moves in order of success), how many of them
        each query visits, and the chance with all."""
        tables, miss = [], 1.0
        for t in range(TABLES):
            s, f = self.slots(x, t)
            p = self.success(f, d)
            order = np.argsort(-p, axis=1, kind="stable")
            miss = miss * np.maximum(0.0, 1 - np.cumsum(np.take_along_axis(p, order, axis=1), axis=1))
            tables.append((s, p, order))
        return tables, np.minimum((1 - miss < target).sum(axis=1) + 1, len(self.moves)), 1 - miss[:, -1]


def _kth(h: Hashing, sample: tuple[np.ndarray, np.ndarray], ids: np.ndarray, q: np.ndarray, r: int) -> np.ndarray:
    """Distance of each query's r-th neighbour in the sample."""
    names, v = sample
    s = q @ v.T
    s[ids[:, None] == names] = -np.inf
    r = min(r, s.shape[1])
    score = np.partition(s, s.shape[1] - r, axis=1)[:, s.shape[1] - r]
    return h.distance(q, np.maximum(score, -np.linalg.norm(q, axis=1) * h.top))


def fit(sample: tuple[np.ndarray, np.ndarray], rows: int, top: float, r: int, target: float = TARGET) -> Hashing:
    """As many functions a table as keep buckets at BUCKET rows, or fewer if most of the sample's queries could not reach target."""
    m = max(1, round(log(max(rows / BUCKET, 2.0))))
    ids, q = sample[0][:SAMPLE_QUERIES], sample[1][:SAMPLE_QUERIES]
    while True:
        h = Hashing(q.shape[1], m, top)
        if m == 1 or np.mean(h.plan(h.queries(q), _kth(h, sample, ids, q, r), target)[2] >= target) >= 0.9:
            return h
        m -= 1


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of the candidates are the k best of their query, one of each id, by query, falling score and id."""
    order = np.lexsort((-score, ids, q))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], -score[order], q[order]))]
    begin = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


class Block:
    """The k best of some queries among the rows that they are compared with."""

    def __init__(self, names: np.ndarray, q: np.ndarray, low: np.ndarray, slack: np.ndarray, k: int):
        self.names, self.q, self.low, self.slack, self.k = names, q, low.copy(), slack, k
        self.at, self.ids, self.score, self.n = [], [], [], 0

    def compare(self, ids: np.ndarray, v: np.ndarray, some: np.ndarray, single: bool) -> None:
        """The queries some with rows; single: no id stands twice."""
        for at in range(0, len(some), 512):
            j = some[at : at + 512]
            for lo in range(0, len(ids), 2048):
                x, mine = v[lo : lo + 2048], ids[lo : lo + 2048]
                s = self.q[j] @ x.T
                if single and len(mine) > self.k + 1:  # one may be the query itself
                    fresh = np.flatnonzero(np.isneginf(self.low[j]))
                    if len(fresh):
                        self.low[j[fresh]] = np.partition(s[fresh], len(mine) - self.k - 1, axis=1)[:, len(mine) - self.k - 1] - self.slack[j[fresh]]
                a, b = np.nonzero((s >= (self.low[j] - self.slack[j])[:, None]) & (self.names[j][:, None] != mine))
                if len(a):
                    self.at.append(j[a])
                    self.ids.append(mine[b])
                    self.score.append((x[b] * self.q[j[a]]).sum(axis=1))  # the same for equal vectors, whatever their place
                    self.n += len(a)
                    if self.n > HELD:
                        self.shrink()

    def shrink(self) -> None:
        if not self.n:
            return
        at, ids, score = np.concatenate(self.at), np.concatenate(self.ids), np.concatenate(self.score)
        keep = _best(at, ids, score, self.k)
        at, ids, score = at[keep], ids[keep], score[keep]
        self.at, self.ids, self.score, self.n = [at], [ids], [score], len(at)
        full = np.flatnonzero(np.bincount(at, minlength=len(self.names)) == self.k)
        last = np.searchsorted(at, full, "right") - 1
        self.low[full] = np.maximum(self.low[full], score[last])

    def found(self) -> pa.RecordBatch:
        self.shrink()
        none = np.zeros(0)
        at, ids, score = (x[0] if x else none for x in (self.at, self.ids, self.score))
        return pa.record_batch([pa.array(self.names[at.astype(np.int64)], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 20, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every vector whose id is divisible by every."""
    spark = vectors.sparkSession
    schema, hit = "query_id long, rank int, vec_id long, score double", "query_id long, vec_id long, score double"
    rows = valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), "d").first()
    if sizes is None or sizes["n"] < 2:
        return spark.createDataFrame([], schema)
    dim, n, top = sizes["d"], sizes["n"], sizes["top"]
    rows = rows.where(F.size("v") == dim).select("vec_id", "v")
    array = rows.schema["v"].dataType.simpleString()
    share = min(1.0, 2.0 * SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    if len(drawn) < 2:
        drawn = rows.limit(2).collect()
    sample = (np.array([r["vec_id"] for r in drawn], dtype=np.int64), np.array([r["v"] for r in drawn], dtype=np.float64))
    nth = max(1, -(-k * len(drawn) // n))
    own = _store.Scratch(spark)
    h = fit(sample, n, top, nth, target)
    sent, known = spark.sparkContext.broadcast(h), spark.sparkContext.broadcast(sample)
    groups = max(1, -(-n * TABLES // GROUP))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)

    def placed(batches):
        for b in batches:
            x = sent.value.points(matrix(b.column(1)))
            for t in range(TABLES):
                yield pa.record_batch([pa.array(sent.value.code(sent.value.slots(x, t)[0], t))], names=["bucket"])

    # a bucket of more than most rows is split: TABLES * n / most of them at most, that is, 100,000
    most = max(GROUP // 2, TABLES * n // 100_000)
    large = rows.mapInArrow(placed, "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()
    split = spark.sparkContext.broadcast({r["bucket"]: -(-r["n"] // most) for r in large})

    def group_of(bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        z = (bucket.astype(np.uint64) ^ (part.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((z >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)

    def parts_of(bucket: np.ndarray) -> np.ndarray:
        if not split.value:
            return np.ones(len(bucket), dtype=np.int64)
        return np.array([split.value.get(c, 1) for c in bucket.tolist()], dtype=np.int64)

    names = ["grp", "kind", "id", "bucket", "buckets", "v"]

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            x = sent.value.points(matrix(b.column(1)))
            for t in range(TABLES):
                code = sent.value.code(sent.value.slots(x, t)[0], t)
                part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts_of(code)
                yield pa.record_batch([pa.array(group_of(code, part)), pa.array(np.zeros(len(ids), np.int32)), b.column(0), pa.array(code), pa.nulls(len(ids), pa.list_(pa.int64())), b.column(1)], names=names)

    def chosen(h: Hashing, tables: list, visits: np.ndarray) -> list[np.ndarray]:
        """Which moves each query makes, by table."""
        out = []
        for _, p, order in tables:
            made = np.zeros(p.shape, dtype=bool)
            np.put_along_axis(made, order, np.arange(p.shape[1]) < visits[:, None], axis=1)
            out.append(made)
        return out

    def ask(batches):
        """d: the distance that first visits go by; further: that of the k-th score found, if these are the second ones."""
        h = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                x, d, further = h.queries(matrix(piece.column(1))), piece.column(2).to_numpy(), piece.column(3).to_numpy()
                tables, visits, _ = h.plan(x, d, target)
                made = chosen(h, tables, visits)
                if not np.isnan(further).all():
                    again, visits, _ = h.plan(x, further, target)
                    made = [new & ~old for new, old in zip(chosen(h, again, visits), made, strict=True)]
                who, code = [], []
                for t, ((s, _, _), m) in enumerate(zip(tables, made, strict=True)):
                    i, j = np.nonzero(m)
                    who.append(i)
                    code.append(h.code(s[i] + h.moves[j], t))
                who, code = np.concatenate(who), np.concatenate(code)
                many = parts_of(code)
                part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                who, code = np.repeat(who, many), np.repeat(code, many)
                g = group_of(code, part)
                order = np.lexsort((g, who))
                who, code, g = who[order], code[order], g[order]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (who[1:] != who[:-1])])) if len(g) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(g)).astype(np.int32)), pa.array(code))
                same = pa.array(who[first])
                yield pa.record_batch([pa.array(g[first]), pa.array(np.ones(len(first), np.int32)), piece.column(0).take(same), pa.nulls(len(first), pa.int64()), lists, piece.column(1).take(same)], names=names)

    def rank(batches):
        now, ids, buckets, vecs, ready, asked, held = None, [], [], [], None, [], 0

        def answered() -> pa.RecordBatch:
            """The best of the group's rows for the queries that wait."""
            nonlocal ready, asked, held
            if ready is None:
                i, c, v = np.concatenate(ids), np.concatenate(buckets), np.concatenate(vecs)
                order = np.lexsort((i, c))
                i, c, v = i[order], c[order], v[order]
                begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                twice = np.concatenate([[False], (i[1:] == i[:-1]) & (c[1:] == c[:-1])])
                ready = (i, v, c[begin], np.append(begin, len(c)), np.add.reduceat(twice, begin) == 0)
            i, v, codes, begin, single = ready
            who = np.concatenate([b.column(2).to_numpy() for b in asked])
            q = np.concatenate([matrix(b.column(5)) for b in asked])
            lists = pa.concat_arrays([b.column(4) for b in asked])
            owner = np.repeat(np.arange(len(who)), np.diff(lists.offsets.to_numpy()))
            wanted = lists.flatten().to_numpy()
            asked, held = [], 0
            block = Block(who, q, np.full(len(who), -np.inf), 1e-9 * np.maximum(1.0, np.linalg.norm(q, axis=1) * top), k)
            place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            ok = codes[place] == wanted
            place, owner = place[ok], owner[ok]
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(place)).astype(int), strict=True):
                p = place[lo]
                block.compare(i[begin[p] : begin[p + 1]], v[begin[p] : begin[p + 1]], owner[lo:hi], bool(single[p]))
            return block.found()

        for b in batches:
            grp, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (kinds[1:] != kinds[:-1])]))
            for lo, hi in zip(cuts, np.append(cuts[1:], b.num_rows), strict=True):
                part = b.slice(lo, hi - lo)
                if grp[lo] != now:
                    if asked:
                        yield answered()
                    now, ids, buckets, vecs, ready = grp[lo], [], [], [], None
                if kinds[lo] == 0:
                    ids.append(part.column(2).to_numpy().copy())
                    buckets.append(part.column(3).to_numpy(zero_copy_only=False).copy())
                    vecs.append(matrix(part.column(5)))
                elif ids:
                    for at in range(0, part.num_rows, QUERIES):
                        asked.append(part.slice(at, QUERIES))
                        held += asked[-1].num_rows
                        if held >= QUERIES:
                            yield answered()
        if asked:
            yield answered()

    kind = f"grp long, kind int, id long, bucket long, buckets array<long>, v {array}"

    def met(questions: DataFrame) -> DataFrame:
        """query_id, vec_id, score: the best in the buckets that the questions (vec_id, v, d, further) visit."""
        both = rows.mapInArrow(deal, kind).unionByName(questions.mapInArrow(ask, kind))
        return both.repartitionById(n_parts, F.pmod("grp", F.lit(n_parts)).cast("int")).sortWithinPartitions("grp", "kind").mapInArrow(rank, hit)

    def ranked(hits: DataFrame) -> DataFrame:
        merged = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def begun(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                piece = b.slice(lo, 1024)
                d = _kth(sent.value, known.value, piece.column(0).to_numpy(), matrix(piece.column(1)), nth)
                yield pa.record_batch([*piece.columns, pa.array(d), pa.array(np.full(len(d), np.nan))], names=["vec_id", "v", "d", "further"])

    def judged(batches):
        """Whether a query has met enough, should go on, or can't by buckets."""
        h = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                q, d, least = matrix(piece.column(1)), piece.column(2).to_numpy(), piece.column(3).to_numpy()
                x, few = h.queries(q), np.isneginf(least)
                far = h.distance(q, np.where(few, 0.0, least))
                tables, visits, _ = h.plan(x, d, target)
                miss, least_miss = 1.0, 1.0
                for t, made in enumerate(chosen(h, tables, visits)):
                    p = h.success(h.slots(x, t)[1], far)
                    miss = miss * np.maximum(0.0, 1 - (p * made).sum(axis=1))
                    least_miss = least_miss * np.maximum(0.0, 1 - p.sum(axis=1))
                state = np.where(few | (1 - least_miss < ENOUGH), _OPEN, np.where(1 - miss < ENOUGH, _MORE, _NEAR))
                yield pa.record_batch([*piece.columns, pa.array(far), pa.array(1e-9 * np.maximum(1.0, np.linalg.norm(q, axis=1) * top)), pa.array(state.astype(np.int32))], names=["vec_id", "v", "d", "least", "further", "slack", "state"])

    questions = own.written(rows.where(F.col("vec_id") % every == 0).mapInArrow(begun, f"vec_id long, v {array}, d double, further double"), "ann-questions")
    near = own.written(ranked(met(questions)), "ann-near")
    last = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    least = F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf"))
    state = questions.drop("further").join(last, "vec_id", "left").withColumn("least", least).drop("n")
    state = own.written(state.repartition(n_parts).mapInArrow(judged, f"vec_id long, v {array}, d double, least double, further double, slack double, state int").where(f"state > {_NEAR}"), "ann-open")
    own.drop(questions)
    counts = {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    hits = near.select("query_id", "vec_id", "score")
    if counts.get(_MORE):
        hits = hits.unionByName(own.written(ranked(met(state.where(f"state = {_MORE}").select("vec_id", "v", "d", "further"))), "ann-further").select("query_id", "vec_id", "score"))
    chunks = -(-counts.get(_OPEN, 0) // CHUNK)
    for c in range(chunks):
        asked = state.where(f"state = {_OPEN}").where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect()  # about CHUNK
        if not asked:
            continue
        few = own.send((np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked], dtype=np.float64), np.array([r["least"] for r in asked]), np.array([r["slack"] for r in asked])))

        def compare(batches, few=few):
            block = Block(*few.value, k)
            for b in batches:
                block.compare(b.column(0).to_numpy(), matrix(b.column(1)), np.arange(len(block.names)), False)
            yield block.found()

        hits = hits.unionByName(own.written(rows.mapInArrow(compare, hit), "ann-compared"))
    return ranked(hits)
