"""Language ID by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (1 to 3 letters, words padded with one blank) in falling order of
count. A language's profile comes from labelled texts; a text goes to the language whose profile is nearest by out-of-place
distance: the sum over its n-grams of how far their ranks lie apart, PROFILE for an n-gram that the language lacks. Ties go to
the language first in order. The score is the share by which the nearest is nearer than the second.

Fit: SAMPLE texts per language in expectation, chosen by a hash of doc_id against a threshold per language (the bound is a
parameter); their n-grams are counted where they lie and summed per language, and PROFILE rows per language come to the driver.
Prediction is one pass over whole texts, without an exchange; n-grams are counted by a sort of PIECE characters at a time.

A text that is null or has no letter gets `und` with score 0, as does any text if nothing could be learned. Rows with null text,
lang or doc_id are not learned from. Repeated rows count each. An empty table gives no rows. Other columns pass through, those
named like an output column are lost.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm import _store, _words

PROFILE = 300
SAMPLE = 1500
FAR = 0.97
OUT = ("lang_pred", "score", "distance")
#: Characters counted at a time, bytes of text of a batch, and counts held before they are summed.
PIECE, BATCH, _MERGE = 1 << 18, 1 << 19, 1 << 21
_BITS = 21
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _table[0]


def _counted(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of the letters code[1:-1], doc naming the text of each; what stands around a letter only says which
    n-grams it is the middle or the end of."""
    letter = _letters()[code]
    at = np.flatnonzero(letter[1:-1]) + 1
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    alphabet = np.concatenate([[1], np.flatnonzero(np.bincount(code[letter]))]).astype(np.int64)
    place = np.zeros(int(alphabet[-1]) + 1, dtype=np.int32)
    place[alphabet] = np.arange(len(alphabet))  # 0: the blank
    width = max(1, int(len(alphabet) - 1).bit_length())
    kind = 3 * width
    small = kind + 2 + int(doc[-1] - doc[0]).bit_length() <= 32
    word = np.uint32 if small else np.int64
    seq = np.where(letter, place[np.where(letter, code, 1)], 0).astype(word)
    a, b, c, own = seq[at - 1], seq[at], seq[at + 1], (doc[at - 1] - doc[0]).astype(word)
    tail = np.flatnonzero(c == 0)  # (letter, blank)
    w, own = word(width), own << word(kind + 2)
    left = (a << w) | b  # (blank or letter, letter)
    parts = [own | b, own | left | word(1 << kind), own[tail] | (b[tail] << w) | word(1 << kind), own | (left << w) | c | word(2 << kind)]
    key = np.concatenate(parts)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    key = key[first].astype(np.int64)
    g = key & ((1 << (kind + 2)) - 1)
    n, mask = g >> kind, (1 << width) - 1
    points = [alphabet[(g >> (width * k)) & mask] for k in range(3)]
    two = (points[1] << _BITS) | points[0]
    full = np.where(n == 0, points[0], np.where(n == 1, two, (points[2] << (2 * _BITS)) | two))
    return (key >> (kind + 2)) + int(doc[0]), full, count


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, g, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((g, d))
    d, g, n = d[order], g[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d[first], g[first], np.add.reduceat(n, first) if len(first) else n


def _lower(text: str) -> str:
    """text.lower(), which would take 12 bytes a letter for a while; only the capital sigma looks at its neighbours."""
    if text.isascii() or len(text) <= PIECE or "\u03a3" in text:
        return text.lower()
    return "".join(text[at : at + PIECE].lower() for at in range(0, len(text), PIECE))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count, rank) of every distinct n-gram of each text, by text and rank. An n-gram is its code points, 21
    bits each, the last lowest, 1 for the blank; equal counts rank by n-gram. PIECE characters are counted at a time, long texts
    in pieces, so that beside the texts memory follows the piece and the distinct n-grams, not the letters."""
    low = [_lower(t) for t in texts]
    parts, held, room = [], 0, _MERGE

    def piece(some: list[str], first: int, before: str = "\n", after: str = "\n") -> None:
        nonlocal held, room, parts
        code = np.frombuffer((before + "\n".join(some) + after).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) + 1 for t in some], dtype=np.int64)
        sizes[-1] -= 1
        parts.append(_counted(code, np.repeat(np.arange(first, first + len(some)), sizes)))
        held += len(parts[-1][0])
        if held > room:  # a very long text: its pieces share most n-grams
            parts = [_summed(parts)]
            held = len(parts[0][0])
            room = max(_MERGE, 2 * held)

    k = 0
    while k < len(low):
        if len(low[k]) > PIECE:
            for at in range(0, len(low[k]), PIECE):
                piece([low[k][at : at + PIECE]], k, low[k][at - 1] if at else "\n", low[k][at + PIECE : at + PIECE + 1] or "\n")
            k += 1
            continue
        end, size = k, 0
        while end < len(low) and len(low[end]) <= PIECE and size + len(low[end]) <= PIECE:
            size += len(low[end]) + 1
            end += 1
        if size > end - k:  # else only empty texts
            piece(low[k:end], k)
        k = end
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    d, g, count = _summed(parts)
    order = np.lexsort((g, -count, d))
    d, g, count = d[order], g[order], count[order]
    begin = np.searchsorted(d, np.arange(len(texts)))
    return d, g, count, np.arange(len(d)) - begin[d]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(ranked), size
        self.known = np.unique(np.array([g for v in ranked.values() for g in v], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.known, np.array(ranked[lang], dtype=np.int64))] = np.arange(len(ranked[lang]))

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(out-of-place distance by language and text, n-grams compared by text)."""
        d, g, _, rank = grams(texts)
        top = rank < self.size
        d, g, rank = d[top], g[top], rank[top]
        n = np.bincount(d, minlength=len(texts))
        i = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
        i = np.where(self.known[i] == g, i, len(self.known))
        out = np.zeros((len(self.langs), len(texts)))
        for k in range(len(self.langs)):
            r = self.ranks[k, i]
            out[k] = np.bincount(d, weights=np.where(r < 0, self.size, np.minimum(np.abs(r - rank), self.size)), minlength=len(texts))
        return out, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, distance as a share of the largest possible)."""
        texts = [t or "" for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        out, n = self.distances(texts)
        best = out.argmin(axis=0)
        near = out.min(axis=0)
        second = np.partition(out, 1, axis=0)[1] if len(self.langs) > 1 else n * self.size
        score = np.where(second > 0, (second - near) / np.maximum(second, 1), 0.0)
        langs = ["und" if not m else self.langs[b] for b, m in zip(best.tolist(), n.tolist(), strict=True)]
        return langs, np.where(n > 0, np.clip(score, 0, 1), 0.0), np.where(n > 0, near / np.maximum(n * self.size, 1), 1.0)


def learn(labelled: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """Profiles from (doc_id, text, lang)."""
    _store.text_batches(labelled.sparkSession)
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(per), "lang").where(draw * F.col("n") < sample).select("lang", "text")  # a row per language

    def count(batches):
        for b in _words.small_batches(batches, "text", BATCH):
            langs = b.column(0).to_pylist()
            names = sorted(set(langs))
            d, g, n, _ = grams(b.column(1).to_pylist())
            if not len(d):
                continue
            lang = np.array([names.index(x) for x in langs])[d]
            order = np.lexsort((g, lang))
            lang, g, n = lang[order], g[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (g[1:] != g[:-1])]))
            yield pa.record_batch([pa.array([names[x] for x in lang[first]]), pa.array(g[first]), pa.array(np.add.reduceat(n, first))], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    ranked: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: r["r"]):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def _scored(rows: DataFrame, text: str, keep: list[str], profiles: Profiles) -> DataFrame:
    """The columns keep, lang_pred, score and distance; rows has inner names."""
    _store.text_batches(rows.sparkSession)
    rest = rows.select(*keep, F.col(text).cast("string").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        p = sent.value
        for b in _words.small_batches(batches, "text", BATCH):
            lang, score, far = p.predict(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=[*keep, *OUT])

    schema = rest.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "distance": F.lit(0.0)}).schema
    return rest.mapInArrow(run, schema)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all if none are named), lang_pred, score and distance."""
    rows, names = _store.inner(docs)
    kept = [k for k, c in enumerate(names) if c.lower() not in OUT and (keep is None or c in keep)]
    return _scored(rows, _store.place(names, "text"), [f"c{k}" for k in kept], profiles).toDF(*[names[k] for k in kept], *OUT)


def accepted(docs: DataFrame, profiles: Profiles, far: float = FAR) -> DataFrame:
    """docs without those in no known language: no letter, or as far from every profile as texts of none are."""
    rows, names = _store.inner(docs)
    found = _scored(rows, _store.place(names, "text"), rows.columns, profiles)
    return found.where((F.col("lang_pred") != "und") & (F.col("distance") < far)).select(*rows.columns).toDF(*names)
