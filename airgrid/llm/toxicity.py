"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A writer's plain word reaches us through a channel that swaps letters for look-alikes (LEET), puts separators between letters
and repeats letters. A disguised stretch becomes a character lattice: each look-alike may be itself or a letter, each separator
may stand or go, between single letters or chunks of a word, each run of one letter may be the run, two or one. Viterbi finds the likeliest path under a character trigram
model whose counts come from all documents, plus the channel's costs. A number with its unit (4th, 10am) has one path; a word with
digits (mp3s) is left as it is if a code of equally likely characters is a cheaper account of it than the best path. Stretches
without marks have one path and are left as they are, so only marked ones are decoded, each distinct one once per process; the
time is linear in the text.

The score knows restored words only. A word's evidence is the largest log odds among its features, which are its byte prefixes of
4 to 8 bytes and the word itself; a text's evidence is the sum over its distinct words; a logistic curve fitted to labelled texts
makes it a probability. Features and curve are learned from at most FIT labelled texts, chosen by a hash of doc_id (a documented
bound); the trigram counts cover every document. Prediction is one pass over whole texts without an exchange.

Null and empty texts have no evidence and get the score of clean text. Labels that are null, or of unknown or null doc_id, teach
nothing. Repeated rows count each. With no labels of one kind every score is the share of toxic labels (0 if none). An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm import _store, _words

FIT = 24_000
MIN_TOXIC = 6
MIN_ODDS = 2.0
PREFIXES = (4, 5, 6, 7, 8)
#: Look-alikes and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATORS = " .-_*,~/"
COST_LEET, COST_KEEP, COST_DROP, COST_STAY, COST_RUN, COST_TWO = 1.0, 6.0, 0.5, 3.0, 6.0, 1.0
#: Rarer acts of the channel: one letter written twice, a separator put between chunks of a word; and marks that end a word anyway.
COST_DOUBLE, COST_CHUNK, ENDS = 3.0, 1.5, "!|+("

#: A word with digits may also be a code (mp3s, h2o): so much, and as much a character as if all were equally likely.
COST_CODE, COST_CHAR = 21.5, math.log(36)

#: Classes of the character model: 0 a break, 1-26 letters, 27 any other letter byte, 28 digits.
CLASSES = np.zeros(256, dtype=np.int64)
for _c in range(26):
    CLASSES[97 + _c] = CLASSES[65 + _c] = _c + 1
CLASSES[128:] = 27
CLASSES[48:58] = 28
N = 29

_LETTER = _words.byte_class(lambda b: chr(b).isalpha() and b < 128)
_LEET = _words.byte_class(lambda b: chr(b) in LEET and b < 128)
_SEP = _words.byte_class(lambda b: chr(b) in SEPARATORS)
_WORD = _words.byte_class(lambda b: 97 <= b <= 122 or b >= 128)
#: Neither blanks nor commas: no disguise but spaced letters reaches over those.
_CHUNK = _words.byte_class(lambda b: b not in b" ,\t\n\r\x0b\x0c")
_L = re.escape("".join(LEET)).encode()
#: A letter, or one character that may stand for it; a word's letters and look-alikes.
_ALPHA = rb"(?:[A-Za-z]|[\xc2-\xf4][\x80-\xbf]+)"
_ANY = rb"(?:[A-Za-z" + _L + rb"]|[\xc2-\xf4][\x80-\xbf]+)"
_EDGE, _END = rb"(?<![A-Za-z0-9\x80-\xff])", rb"(?![A-Za-z0-9\x80-\xff])"
_SPACED = _EDGE + rb"(?:" + _ANY + rb"[ .\-_*,~/]+){2,}" + _ANY + _END
#: Words, with separators other than blanks between chunks of them.
_WORDLIKE = _ANY + rb"++(?:[.\-_*~/]+" + _ANY + rb"++)*+"
_MARKED = re.compile(rb"(" + _SPACED + rb")|" + _WORDLIKE)
_DISGUISED = re.compile(_ALPHA + rb"[" + _L + rb"]|[" + _L + rb"]" + _ALPHA + rb"|([A-Za-z])\1|([\xc2-\xf4][\x80-\xbf]+)\2|" + _ANY + rb"[.\-_*~/]+" + _ANY)


#: A number with its unit or ending is no disguise; a word of letters and digits may be a code.
_NUMBER, _CODE = re.compile(rb"[0-9]+[A-Za-z]{0,2}"), re.compile(rb"(?=.*[0-9])[A-Za-z0-9]+", re.S)
_CLASS = CLASSES.tolist()


def count_trigrams(texts: pa.Array) -> np.ndarray:
    """Counts of class trigrams; a text begins and ends with breaks."""
    offsets, data = _words.buffers(texts)
    out = np.zeros(N**3, dtype=np.int64)
    for at in range(0, len(data), _words.PIECE):
        raw = data[max(0, at - 2) : at + _words.PIECE]
        c = CLASSES[raw]
        if len(c) > 2:
            out += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
    return out


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """Summed over all documents; a task adds up its own first, and at most N**3 sums reach the driver."""
    _store.text_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(N**3, dtype=np.int64)
        for b in batches:
            total += count_trigrams(b.column(0))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N**3, dtype=np.int64)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


@dataclass
class Restorer:
    """Viterbi over character lattices under the trigram model."""

    counts: np.ndarray
    known: dict[bytes, bytes] = field(default_factory=dict)
    stretches: dict[bytes, bytes] = field(default_factory=dict)

    def __post_init__(self):
        tri = self.counts.reshape(N, N, N).astype(float)
        bi, uni = tri.sum(axis=2), tri.sum(axis=(0, 2))
        p1 = (uni + 1) / (uni.sum() + N)
        p2 = (tri.sum(axis=0) + 5 * p1[None, :]) / (tri.sum(axis=(0, 2))[:, None] + 5)
        self.flat = (-np.log((tri + 5 * p2[None, :, :]) / (bi[:, :, None] + 5))).reshape(-1).tolist()

    def lattice(self, raw: bytes):
        """Steps of (text, classes, channel cost) choices."""
        text = raw.decode(errors="surrogateescape").lower()
        spaced = re.fullmatch(_SPACED, raw) is not None
        steps, i, tail = [], 0, len(text.rstrip(ENDS))
        while i < len(text):
            ch, n = text[i], 1
            while ch.isalpha() and i + n < len(text) and text[i + n] == ch:
                n += 1
            if ch.isalpha() and n >= 3:
                steps.append([(ch, COST_TWO * 0), (ch * 2, COST_TWO), (ch * n, COST_RUN + n)])
                i += n
                continue
            if ch.isalpha() and n == 2:
                steps.append([(ch * 2, 0.0), (ch, COST_DOUBLE)])
                i += n
                continue
            if ch in LEET:
                steps.append([(x, COST_LEET) for x in LEET[ch]] + [(ch, 0.0 if i >= tail else COST_KEEP)])
            elif spaced and ch in SEPARATORS:
                steps.append([("", COST_DROP), (" ", COST_STAY)])
            elif ch in SEPARATORS:
                steps.append([(ch, 0.0), ("", COST_CHUNK)])
            else:
                steps.append([(ch, 0.0)])
            i += 1
        return steps

    def path(self, steps: list) -> tuple[float, str]:
        """The cheapest choices, joined, and their cost; the text before and after are breaks."""
        states = {(0, 0): (0.0, None)}
        for choices in steps:
            after: dict[tuple[int, int], tuple] = {}
            for (a, b), (cost, path) in states.items():
                for text, extra in choices:
                    x, y, c = a, b, cost + extra
                    for ch in text.encode(errors="surrogateescape"):
                        z = _CLASS[ch]
                        c += self.flat[(x * N + y) * N + z]
                        x, y = y, z
                    if (x, y) not in after or c < after[x, y][0]:
                        after[x, y] = (c, (path, text))
            states = after
        cost, path = min(((c + self.flat[(a * N + b) * N], p) for (a, b), (c, p) in states.items()), key=lambda s: s[0])
        parts = []
        while path is not None:
            path, text = path
            parts.append(text)
        return cost, "".join(reversed(parts))

    def decode(self, raw: bytes) -> bytes:
        if raw in self.known:
            return self.known[raw]
        if _NUMBER.fullmatch(raw):
            return raw.lower()
        cost, text = self.path(self.lattice(raw))
        out = text.encode(errors="surrogateescape")
        if _CODE.fullmatch(raw) and COST_CODE + COST_CHAR * len(raw) < cost:
            out = raw.lower()
        if len(raw) <= 100:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[raw] = out
        return out

    def restore(self, raw: bytes) -> bytes:
        """raw with its disguised stretches decoded; short ones are kept."""
        out = self.stretches.get(raw)
        if out is None:
            out = self._restore(raw)
            if len(raw) <= 60:
                if len(self.stretches) >= 400_000:
                    self.stretches.clear()
                self.stretches[raw] = out
        return out

    def _restore(self, raw: bytes) -> bytes:
        return _MARKED.sub(lambda m: self.decode(m[0]) if m[1] is not None or _DISGUISED.search(m[0]) else m[0], raw)

    def batch(self, texts: pa.Array) -> pa.Array:
        """The texts, lower-cased, with marked stretches restored: chunks between blanks that hold a mark, each distinct one once, and
        stretches of chunks around spaced letters."""
        low = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
        offsets, data = _words.buffers(low)
        single, spaced = marked(data)
        if not len(single) and not len(spaced):
            return low
        begin, end = _words.spans(offsets, data, 0, len(data), _CHUNK)
        solid = np.concatenate([[0], np.cumsum((_LETTER | _LEET | _WORD)[data])])
        real = solid[end] > solid[begin]  # chunks of separators alone are gaps
        begin, end = begin[real], end[real]
        owner = np.searchsorted(offsets, begin, "right") - 1

        def chunks(at):
            k = np.maximum(np.searchsorted(begin, at, "right") - 1, 0)
            return k[(begin[k] <= at) & (at < end[k])] if len(begin) else k[:0]

        near = np.zeros(len(begin), dtype=bool)
        k = np.unique(chunks(spaced))
        near[k] = True
        before, after = k[k > 0], k[k < len(near) - 1]
        near[before[owner[before - 1] == owner[before]] - 1] = True
        near[after[owner[after + 1] == owner[after]] + 1] = True
        first = np.flatnonzero(near & ~np.concatenate([[False], near[:-1] & (owner[1:] == owner[:-1])])) if len(near) else k
        last = np.flatnonzero(near & ~np.concatenate([near[1:] & (owner[1:] == owner[:-1]), [False]])) if len(near) else k
        alone = np.unique(chunks(single))
        alone = alone[~near[alone]]
        s, e = np.concatenate([begin[first], begin[alone]]), np.concatenate([end[last], end[alone]])
        raw = data.tobytes()
        _, at, back = np.unique(_words.span_hashes(data, s, e), return_index=True, return_inverse=True)
        old = [raw[s[i] : e[i]] for i in at.tolist()]
        new = [self.restore(x) for x in old]
        changed = np.array([x != y for x, y in zip(old, new, strict=True)], dtype=bool)[back]
        if not changed.any():
            return low
        s, e, back = s[changed], e[changed], back[changed]
        order = np.argsort(s)
        s, e, back = s[order], e[order], back[order]
        doc = np.searchsorted(offsets, s, "right") - 1
        mask = np.zeros(len(low), dtype=bool)
        mask[doc] = True
        out, cuts = [], np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            done, parts = int(offsets[doc[lo]]), []
            for a, b, k in zip(s[lo:hi].tolist(), e[lo:hi].tolist(), back[lo:hi].tolist(), strict=True):
                parts += [raw[done:a], new[k]]
                done = b
            out.append(b"".join([*parts, raw[done : int(offsets[doc[lo] + 1])]]).decode())
        return pc.replace_with_mask(low, pa.array(mask), pa.array(out, low.type))


def marked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of letters and look-alikes at which a chunk may be disguised, and those of spaced letters: supersets, found without a
    regular expression."""
    single, spaced = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(data), _words.PIECE):
        d = data[max(0, at - 1) : at + _words.PIECE + 8]
        d = np.concatenate([[10] * (at == 0), d, np.full(6, 10)]).astype(np.uint8)  # one byte before the piece
        letter, leet, sep = _LETTER[d] | (d >= 128), _LEET[d], _SEP[d]
        any_, joint = letter | leet, sep & (d != 32) & (d != 44)
        hits = [letter[:-1] & (d[:-1] == d[1:]), (leet[:-1] & letter[1:]) | (letter[:-1] & leet[1:]), any_[:-2] & joint[1:-1] & (any_ | joint)[2:]]
        hits += [(d[:-w] >= 192) & (d[:-w] == d[w:]) for w in (2, 3, 4)]  # letters of w bytes
        single += [np.flatnonzero(x) + at - 1 for x in hits]
        middle = [any_[1:-1] & sep[:-2] & sep[2:]] + [(d[1:-w] >= 192) & sep[: -w - 1] & sep[w + 1 :] for w in (2, 3, 4)]
        spaced += [np.flatnonzero(x) + at for x in middle]
    return np.unique(np.concatenate(single)), np.unique(np.concatenate(spaced))


def word_spans(texts: pa.Array):
    """(bytes, starts, ends, text of each word) piece by piece."""
    offsets, data = _words.buffers(texts)
    for at, to in _words.pieces(offsets, data, _WORD):
        raw = data[at:to]
        s, e = _words.spans(offsets - at, raw, 0, len(raw), _WORD)
        if len(s):
            yield raw, s, e, np.searchsorted(offsets - at, s, "right") - 1


def features(raw: np.ndarray, s: np.ndarray, e: np.ndarray):
    """(hash, index of the word) of every feature: prefixes, then whole words."""
    for k in PREFIXES:
        long = np.flatnonzero(e - s > k)
        if len(long):
            yield _words.span_hashes(raw, s[long], s[long] + k) ^ np.uint64(k), long
    yield _words.span_hashes(raw, s, e), np.arange(len(s))


def heads(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The hash of a word's first four bytes or fewer: words without a known head have no known feature."""
    return _words.span_hashes(raw, s, np.minimum(e, s + PREFIXES[0]))


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


@dataclass
class Model:
    trigrams: np.ndarray
    hashes: np.ndarray
    odds: np.ndarray
    heads: np.ndarray
    slope: float = 1.0
    bias: float = -3.0

    def evidence(self, restored: pa.Array) -> np.ndarray:
        doc, word, value = [], [], []
        for raw, s, e, owner in word_spans(restored):
            some = np.flatnonzero(_member(heads(raw, s, e), self.heads))
            if not len(some):
                continue
            s, e, owner = s[some], e[some], owner[some]
            best = np.zeros(len(s))
            for h, at in features(raw, s, e):
                i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                best[at] = np.maximum(best[at], np.where(self.hashes[i] == h, self.odds[i], 0.0))
            hit = np.flatnonzero(best > 0)
            doc.append(owner[hit])
            word.append(_words.span_hashes(raw, s[hit], e[hit]))
            value.append(best[hit])
        out = np.zeros(len(restored))
        if doc:
            doc, word, value = np.concatenate(doc), np.concatenate(word), np.concatenate(value)
            order = np.lexsort((word, doc))
            doc, word, value = doc[order], word[order], value[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
            out += np.bincount(doc[new], weights=value[new], minlength=len(out))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -30, 30)))


_current: list[tuple[Model, Restorer]] = []


def _held(sent) -> tuple[Model, Restorer]:
    """The broadcast model and its restorer, kept in the process as long as that model is in use."""
    model = sent.value
    if not _current or _current[0][0] is not model:
        _current[:] = [(model, Restorer(model.trigrams))]
    return _current[0]


def learn(docs: DataFrame, labels: DataFrame, trigrams: np.ndarray, fit: int = FIT) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic). Labels are sampled before they meet texts, so the texts are
    filtered where they lie (no exchange of texts), and what is read again is a table of about fit of them."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    empty = Model(trigrams, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64))
    sent = spark.sparkContext.broadcast(empty)

    def restored(b: pa.RecordBatch) -> pa.Array:
        return _held(sent)[1].batch(b.column(0))

    def distinct(batch, wanted=None):
        """(feature, its head, toxic, texts) of a batch."""
        texts, toxic = restored(batch), np.array(batch.column(1).to_pylist(), dtype=np.int64)
        parts = []
        for raw, s, e, owner in word_spans(texts):
            head = heads(raw, s, e)
            for h, at in features(raw, s, e):
                ok = np.arange(len(at)) if wanted is None else np.flatnonzero(_member(h, wanted))
                parts.append(np.stack([owner[at][ok].astype(np.uint64), h[ok], head[at][ok]], axis=1))
        if not parts:
            return None
        table = np.concatenate(parts)
        order = np.lexsort((table[:, 1], table[:, 0]))
        table = table[order]
        new = np.ones(len(table), dtype=bool)
        new[1:] = (table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1])
        table = table[new]
        kind = toxic[table[:, 0].astype(np.int64)]
        order = np.lexsort((kind, table[:, 1]))
        f, h, kind = table[order, 1], table[order, 2], kind[order]
        first = np.ones(len(f), dtype=bool)
        first[1:] = (f[1:] != f[:-1]) | (kind[1:] != kind[:-1])
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(f)))
        return pa.record_batch([pa.array(f[at].view(np.int64)), pa.array(h[at].view(np.int64)), pa.array(kind[at]), pa.array(n)], names=["f", "head", "toxic", "n"])

    def tables(batches, wanted=None):
        for b in _words.small_batches(batches, "text", 2 << 20):
            out = distinct(b, wanted)
            if out is not None:
                yield out

    schema = "f long, head long, toxic long, n long"
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, bad = sum(sizes.values()), sizes.get(1, 0)
    if not bad or bad == total:
        share = bad / total if total else 0.0
        return Model(trigrams, empty.hashes, empty.odds, empty.heads, 1.0, math.log((share + 1e-4) / (1 - share + 1e-4)))
    drawn = _store.written(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < min(1.0, fit / total)), "toxicity-labels")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _store.written(_store.bounded_join(texts, drawn, "doc_id").select("text", "toxic"), "toxicity-fit")
    seen = rows.where("toxic = 1").mapInArrow(tables, schema).groupBy("f").agg(F.sum("n").alias("n"), F.min("head").alias("head")).where(F.col("n") >= MIN_TOXIC)
    candidates = seen.collect()  # features in MIN_TOXIC of the fitted toxic texts or more: bounded by fit
    order = np.argsort(np.array([r["f"] for r in candidates], dtype=np.int64).view(np.uint64))
    f = np.array([r["f"] for r in candidates], dtype=np.int64).view(np.uint64)[order]
    t = np.array([r["n"] for r in candidates], dtype=float)[order]
    head = np.array([r["head"] for r in candidates], dtype=np.int64).view(np.uint64)[order]
    wanted = spark.sparkContext.broadcast(f)
    clean = rows.where("toxic = 0").mapInArrow(lambda batches: tables(batches, wanted.value), schema).groupBy("f").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(f))
    for r in clean:
        n[np.searchsorted(f, np.uint64(r["f"] & 0xFFFFFFFFFFFFFFFF))] = r["n"]
    each = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    big_t, big_n = each.get(1, 0), each.get(0, 0)
    odds = np.log((t + 0.5) / (big_t + 1)) - np.log((n + 0.5) / (big_n + 1))
    keep = odds >= MIN_ODDS
    model = Model(trigrams, f[keep], odds[keep], np.unique(head[keep]))
    if not keep.any():
        model.bias = math.log((bad + 1) / (total - bad + 1))
        return model
    ready = spark.sparkContext.broadcast(model)

    def weigh(batches):
        m, restorer = _held(ready)
        for b in _words.small_batches(batches, "text"):
            x = np.round(m.evidence(restorer.batch(b.column(0))), 1)
            yield pa.record_batch([pa.array(np.minimum(x, 100.0)), b.column(1)], names=["x", "toxic"])

    curve = rows.mapInArrow(weigh, "x double, toxic int").groupBy("x", "toxic").count().collect()  # 1,001 values at most
    x, y, w = (np.array(v, dtype=float) for v in zip(*[(r["x"], r["toxic"], r["count"]) for r in curve], strict=True))
    a, b = 0.1, -3.0
    for _ in range(200):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r = w * p * (1 - p)
        g = np.array([np.sum(w * (y - p) * x) - 1e-3 * a, np.sum(w * (y - p)) - 1e-3 * b])
        h = np.array([[np.sum(r * x * x) + 1e-3, np.sum(r * x)], [np.sum(r * x), np.sum(r) + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -0.5, 0.5), b + np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.bias = float(max(a, 1e-6)), float(b)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence."""
    _store.text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, restorer = _held(sent)
        for b in _words.small_batches(batches, "text"):
            x = m.evidence(restorer.batch(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(m.score(x)), pa.array(x)], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, evidence double")
