"""Benchmark decontamination by suffix arrays over the training texts.

Every task keeps a suffix array of the words of a shard, SHARD words of whole texts: all suffixes in order, made by prefix doubling
in which only suffixes that still tie are sorted again. A word that no test item holds can end a match but never lie in one, so it
is a symbol of its own, as is the end of a text; ties therefore end early. Each test suffix that begins a window is binary-searched
in the array; the range found gives every place where its first WINDOW words stand verbatim. For the longest matches, places that
are not continued to the left are extended word by word, over ends of shards as well.

The benchmark is sent to the executors in groups of at most GROUP_BYTES, one pass over the texts for each group; the driver
holds two groups at a time and an executor one. Texts never move.

Words are runs of digits, a-z (A-Z lowered) and characters beyond ASCII, compared by 64-bit hashes. An item of under WINDOW words
is one window; null and wordless items and texts have none. A null doc_id passes through. Repeated rows are judged each; items
with equal texts match alike, rows repeating an item_id count as one item; a null item_id is the string "null". An empty
benchmark hits nothing; an empty table gives no rows. Other columns pass through, those named like an output column (in any case)
are lost to it; ``decontaminate`` gives all columns back as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airgrid.llm import _store, _words

WINDOW = 13
GROUP_BYTES = 16 << 20
SHARD = 1 << 19
_SEARCH = 1 << 15
RANGE = pa.struct([("at", pa.int64()), ("n", pa.int64())])
SPAN = pa.struct([("item_id", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("n_words", pa.int64())])
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<item_id: string, item_at: long, at: long, n_words: long>>, ranges array<struct<at: long, n: long>>"
OUT = ("n_words", "n_hit", "items", "spans")


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Where the suffixes begin, in their order; the last symbol must stand nowhere else."""
    count = np.bincount(symbols)
    rank = (np.cumsum(count) - count)[symbols]  # where the group of suffixes that tie so far begins
    open_ = np.flatnonzero(count[symbols] > 1)
    open_ = open_[np.argsort(rank[open_], kind="stable")]
    known = 1  # words by which groups are told apart
    while len(open_):
        r, further = rank[open_], rank[open_ + known]
        order = np.argsort(r * len(symbols) + further, kind="stable")
        open_, r, further = open_[order], r[order], further[order]
        group = np.concatenate([[True], r[1:] != r[:-1]])
        part = group | np.concatenate([[True], further[1:] != further[:-1]])
        at = np.arange(len(r))
        rank[open_] = r + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        begin = np.flatnonzero(part)
        size = np.diff(np.append(begin, len(r)))
        open_ = open_[np.repeat(size > 1, size)]
        known *= 2
    out = np.empty(len(symbols), dtype=np.int64)
    out[rank] = np.arange(len(symbols))
    return out


class TestSide:
    """The words and windows of a group of items."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        hashes, owner = _words.words(pa.array([t for _, t in items], pa.string()), _words.ALNUM)
        self.window = window
        self.vocabulary = np.unique(hashes)
        self.ids = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int64)
        n = np.bincount(owner, minlength=len(items)).astype(np.int64)
        self.ends = np.cumsum(n)
        self.begins = self.ends - n
        windows = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        self.item = np.repeat(np.arange(len(items)), windows)
        self.start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + self.begins[self.item]
        self.size = np.minimum(window, n)[self.item]
        names = sorted({i for i, _ in items})
        self.names = np.array(names, dtype=object)
        place = {name: k for k, name in enumerate(names)}
        self.name = np.array([place[i] for i, _ in items], dtype=np.int64)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The test word of each hash, 0 if none."""
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i + 1, 0)

    def occurrences(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every window that stands in the texts' words."""
        which, places = [], []
        for lo in range(0, len(ids), SHARD):
            hi = min(lo + SHARD, len(ids))
            end = min(hi + self.window - 1, len(ids))  # windows that begin in the shard end here
            w, p = self._in_shard(ids[lo:end], owner[lo:end])
            own = p < hi - lo
            which.append(w[own])
            places.append(p[own] + lo)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *which]), np.concatenate([none, *places])

    def _in_shard(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(ids) - 1)  # a text's end stands behind these
        at = np.arange(len(ids)) + np.searchsorted(last, np.arange(len(ids)), "left")
        texts, words = len(last), len(self.vocabulary)
        symbols = np.empty(len(ids) + texts, dtype=np.int64)
        symbols[last + np.arange(1, texts + 1)] = np.arange(texts)
        symbols[at] = np.where(ids > 0, texts - 1 + ids, texts + words + at)
        place = np.zeros(len(symbols), dtype=np.int64)
        place[at] = np.arange(len(ids))
        array = suffix_array(symbols)
        first = np.bincount(symbols, minlength=texts + words)
        upto = np.cumsum(first)
        which, places = [], []
        for begin in range(0, len(self.start), _SEARCH):  # some windows at a time
            some = np.arange(begin, min(begin + _SEARCH, len(self.start)))
            head = texts - 1 + self.ids[self.start[some]]
            some, head = some[first[head] > 0], head[first[head] > 0]
            lo, hi = (self._edge(some, head, symbols, array, upto, first, texts, after) for after in (False, True))
            n = hi - lo
            which.append(np.repeat(some, n))
            places.append(place[array[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]])
        return np.concatenate(which), np.concatenate(places)

    def _edge(self, some, head, symbols, array, upto, first, texts, after: bool) -> np.ndarray:
        """By binary search, how many suffixes stand before (or, after, not behind) those that begin with a window."""
        lo, hi = upto[head] - first[head], upto[head].copy()
        steps = np.arange(1, self.window)
        inside = steps < self.size[some][:, None]
        want = texts - 1 + self.ids[np.minimum(self.start[some][:, None] + steps, len(self.ids) - 1)]
        todo = np.arange(len(some))
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            have = symbols[np.minimum(array[mid][:, None] + steps, len(symbols) - 1)]
            differ = (have != want[todo]) & inside[todo]
            k = differ.argmax(axis=1)
            rows = np.arange(len(todo))
            below = np.where(differ[rows, k], have[rows, k] < want[todo, k], after)
            lo[todo] = np.where(below, mid + 1, lo[todo])
            hi[todo] = np.where(below, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def search(self, texts: pa.Array, before: pa.Array | None = None, spans: bool = True) -> dict[str, pa.Array]:
        """For each text its number of words, words hit, ids of items that occur, longest matches, and ranges of words hit, which
        take in the ranges before."""
        hashes, owner = _words.words(texts, _words.ALNUM)
        n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        begin = np.cumsum(n) - n
        none = np.zeros(0, np.int64)
        which, at, ids = none, none, none
        if len(self.start) and len(hashes):
            ids = self.known(hashes)
            which, at = self.occurrences(ids, owner)
        edge = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.size[which], -1)
        if before is not None:
            flat = before.flatten()
            lo = pc.struct_field(flat, "at").to_numpy() + np.repeat(begin, np.diff(before.offsets.to_numpy()))
            np.add.at(edge, lo, 1)
            np.add.at(edge, lo + pc.struct_field(flat, "n").to_numpy(), -1)
        hit = np.cumsum(edge)[:-1] > 0
        # runs of hit words, cut where a text ends
        new = hit & np.concatenate([[True], ~hit[:-1] | (owner[1:] != owner[:-1])]) if len(hit) else hit
        runs = np.flatnonzero(new)
        length = np.add.reduceat(hit.astype(np.int64), runs) if len(runs) else none
        ranges = pa.StructArray.from_arrays([pa.array(runs - begin[owner[runs]]), pa.array(length)], fields=list(RANGE))
        pairs = np.unique(owner[at] * max(1, len(self.names)) + self.name[self.item[which]])
        doc, name = pairs // max(1, len(self.names)), pairs % max(1, len(self.names))
        out = {"n_words": pa.array(n), "n_hit": pa.array(np.bincount(owner[hit], minlength=len(texts)).astype(np.int64)), "items": _lists(doc, pa.array(self.names[name], pa.string()), len(texts))}
        if spans:
            doc, item, item_at, place, size = self._longest(which, at, ids, owner)
            matches = pa.StructArray.from_arrays([pa.array(self.names[self.name[item]], pa.string()), pa.array(item_at), pa.array(place - begin[doc]), pa.array(size)], fields=list(SPAN))
            out["spans"] = _lists(doc, matches, len(texts))
        else:
            out["spans"] = _lists(none, pa.array([], SPAN), len(texts))
        return out | {"ranges": _lists(owner[runs], ranges, len(texts))}

    def _longest(self, which, at, ids, owner):
        """(text, item, place in it, place among the words, words) of the occurrences that nothing continues to the left."""
        item, q = self.item[which], self.start[which]
        inner = (at > 0) & (q > self.begins[item])
        inner[inner] = (owner[at[inner] - 1] == owner[at[inner]]) & (ids[at[inner] - 1] == self.ids[q[inner] - 1])
        item, q, at, size = item[~inner], q[~inner], at[~inner], self.size[which][~inner].copy()
        todo = np.arange(len(at))
        while len(todo):
            p, t = at[todo] + size[todo], q[todo] + size[todo]
            ok = (p < len(ids)) & (t < self.ends[item[todo]])
            todo, p, t = todo[ok], p[ok], t[ok]
            ok = (owner[p] == owner[at[todo]]) & (ids[p] == self.ids[t])
            todo = todo[ok]
            size[todo] += 1
        order = np.lexsort((at, q, item, owner[at]))
        item, q, at, size = item[order], q[order], at[order], size[order]
        return owner[at], item, q - self.begins[item], at, size


def _lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """A list for each of n owners, who stand in order."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def groups(benchmark: DataFrame, limit: int = GROUP_BYTES):
    """The items in groups of at most limit bytes (or one item), read one after another."""
    rows, names = _store.inner(benchmark)
    rows = rows.select(F.coalesce(F.col(_store.place(names, "item_id")).cast("string"), F.lit("null")).alias("i"), F.col(_store.place(names, "text")).cast("string").alias("t"))
    group, size = [], 0
    for r in rows.toLocalIterator():
        more = len((r["t"] or "").encode())
        if group and size + more > limit:
            yield group
            group, size = [], 0
        group.append((r["i"], r["t"]))
        size += more
    yield group


def _matched(rows: DataFrame, text: str, benchmark: DataFrame, window: int, spans: bool) -> DataFrame:
    """rows, which have inner names, with RESULT; what one group of items finds is written before the next is sent."""
    own, names = _store.Scratch(rows.sparkSession), rows.columns
    _store.text_batches(rows.sparkSession)
    sides, out, table = groups(benchmark), rows, None
    side = next(sides)
    while side is not None:
        after = next(sides, None)
        sent, old = own.send(TestSide(side, window)), out.columns

        def run(batches, sent=sent, old=old):
            for b in _words.small_batches(batches, text):
                column = dict(zip(old, b.columns, strict=True))
                new = sent.value.search(column[text].cast(pa.string()), column.get("ranges"), spans)
                if "items" in column:  # of the groups before
                    for c in ("items", "spans"):
                        both = [x + y for x, y in zip(column[c].to_pylist(), new[c].to_pylist(), strict=True)]
                        new[c] = pa.array([sorted(set(x)) for x in both] if c == "items" else both, new[c].type)
                yield pa.RecordBatch.from_arrays([*[column[c] for c in names], *new.values()], names=[*names, *new])

        out = out.withColumn(text, F.col(text).cast("string")) if table is None else out
        out = out.mapInArrow(run, _schema(out.select(*names)))
        if after is not None:
            stored = own.written(out, "decontam-groups")
            own.drop(table)
            out = table = stored
        side = after
    return out.drop("ranges")


def _schema(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, *StructType.fromDDL(RESULT).fields])


def match(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, spans: bool = True) -> DataFrame:
    """The columns keep (all if none are named) of docs, with n_words, n_hit (words inside windows that occur), items (their ids,
    sorted) and spans, the longest matches of every item (none unless asked for)."""
    rows, names = _store.inner(docs)
    kept = [k for k, c in enumerate(names) if c.lower() not in OUT and (keep is None or c in keep)]
    rest = rows.select(*[f"c{k}" for k in kept], F.col(_store.place(names, "text")).alias("read"))
    return _matched(rest, "read", benchmark, window, spans).drop("read").toDF(*[names[k] for k in kept], *OUT)


def judged(matched: DataFrame, share: int = 20) -> DataFrame:
    """With n_items, items_sha256 and contaminated: at least one word in share is hit."""
    out = matched.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """docs without the contaminated ones."""
    rows, names = _store.inner(docs)
    rest = rows.withColumn("read", F.col(_store.place(names, "text")))
    found = judged(_matched(rest, "read", benchmark, WINDOW, False), share)
    return found.where(~F.col("contaminated")).select(*rows.columns).toDF(*names)
