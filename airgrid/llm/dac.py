"""Token ids as directly addressable codes.

An id is cut into chunks of WIDTHS bits, lowest first. Level k holds the k-th chunk of every id that has one, and a bitmap with
a 1 where a further chunk follows; the position of an id's next chunk is the number of ones before it, which a directory of ones
per RANK_BLOCK bits gives at once. So token i is read with one step per level, and no block is decoded.

File, all little-endian: magic b"DAC1", uint32 header length, header (JSON: widths, tokens, documents, section offsets and
lengths), then the sections: document ids (int64), document starts in the file (uint64, one more than documents), and for each
level its chunks (uint8 or uint16), its bitmap (bytes, lowest bit first) and its directory (uint32).

Files are written by tasks in ascending document order, one file per SEGMENT_TOKENS tokens, and listed in a manifest that Spark
commits. A null text counts as empty (its one id is the end id); a null doc_id sorts first; repeated rows are kept as they are,
each with a place of its own; an empty table gives no file and no row. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm import _store, _words

MAGIC = b"DAC1"
WIDTHS = (8, 8)
RANK_BLOCK = 512
SEGMENT_TOKENS = 4_000_000
CACHE_WORDS = 2_000_000


# ---- the code itself -------------------------------------------------------------------------------------------------


class Levels:
    """Ids as chunk levels; from arrays (``encode``) or from a file's sections (``parse``)."""

    def __init__(self, widths, chunks, bitmaps, ranks, n):
        self.widths, self.chunks, self.bitmaps, self.ranks, self.n = widths, chunks, bitmaps, ranks, n

    @classmethod
    def encode(cls, ids: np.ndarray, widths=WIDTHS) -> Levels:
        rest = np.asarray(ids, dtype=np.uint32)
        if len(rest) and int(rest.max()) >> sum(widths):
            raise ValueError(f"an id needs more than {sum(widths)} bits")
        chunks, bitmaps, ranks = [], [], []
        for k, w in enumerate(widths):
            chunks.append((rest & np.uint32((1 << w) - 1)).astype(np.uint8 if w <= 8 else np.uint16))
            rest = rest >> np.uint32(w)
            more = rest > 0
            if k == len(widths) - 1:
                break
            pad = np.zeros(-len(more) % RANK_BLOCK, dtype=bool)
            per_block = np.concatenate([more, pad]).reshape(-1, RANK_BLOCK).sum(axis=1)
            bitmaps.append(np.packbits(more, bitorder="little"))
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32))
            rest = rest[more]
        return cls(tuple(widths), chunks, bitmaps, ranks, len(ids))

    def token(self, i: int) -> int:
        """Random access: one id, by rank steps."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for k, w in enumerate(self.widths):
            value |= int(self.chunks[k][i]) << shift
            shift += w
            if k == len(self.widths) - 1 or not self.bitmaps[k][i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(k, i)
        return value

    def _rank(self, k: int, i: int) -> int:
        block = i // RANK_BLOCK
        ones = np.unpackbits(self.bitmaps[k][block * RANK_BLOCK // 8 : (i >> 3) + 1], bitorder="little")
        return int(self.ranks[k][block]) + int(ones[: i - block * RANK_BLOCK].sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids start to stop, by one rank step per level."""
        out, shift = np.zeros(stop - start, dtype=np.uint32), 0
        where, lo, hi = np.arange(stop - start), start, stop
        for k, w in enumerate(self.widths):
            out[where] |= self.chunks[k][lo:hi].astype(np.uint32) << np.uint32(shift)
            shift += w
            if k == len(self.widths) - 1 or lo == hi:
                break
            bits = np.unpackbits(self.bitmaps[k][lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            nxt = self._rank(k, lo)
            where, lo, hi = where[bits], nxt, nxt + int(bits.sum())
        return out


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, widths=WIDTHS) -> bytes:
    """One file's bytes."""
    lv = Levels.encode(ids, widths)
    parts = [("doc_ids", doc_ids.astype("<i8")), ("starts", starts.astype("<u8"))]
    for k, c in enumerate(lv.chunks):
        parts.append((f"chunks{k}", c.astype(f"<u{c.itemsize}")))
        if k < len(lv.bitmaps):
            parts += [(f"bits{k}", lv.bitmaps[k]), (f"ranks{k}", lv.ranks[k].astype("<u4"))]
    at, sections, blobs = 0, {}, []
    for name, a in parts:
        raw = a.tobytes()
        sections[name] = [at, len(raw), a.dtype.str]
        blobs.append(raw)
        at += len(raw)
    head = json.dumps({"widths": list(widths), "tokens": len(ids), "documents": len(doc_ids), "sections": sections}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *blobs])


class _Column:
    """A section of a file, of which only what is asked for is read."""

    def __init__(self, source, at: int, size: int, kind: str):
        self.source, self.at, self.kind = source, at, np.dtype(kind)
        self.n = size // self.kind.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k):
        lo, hi = (k, k + 1) if not isinstance(k, slice) else k.indices(self.n)[:2]
        lo, hi = max(0, min(lo, self.n)), max(0, min(hi, self.n))
        self.source.seek(self.at + lo * self.kind.itemsize)
        out = np.frombuffer(self.source.read(max(0, hi - lo) * self.kind.itemsize), dtype=self.kind)
        return out if isinstance(k, slice) else out[0]


class DacFile:
    """A file (anything that seeks and reads), read back: ``doc_ids``, ``starts``, ``levels``; ``document(k)`` gives the ids of the
    k-th document, ``documents(lo, hi)`` those of several, each by a seek and a read per section. The header alone is held."""

    def __init__(self, source):
        source = io.BytesIO(source) if isinstance(source, bytes) else source
        source.seek(0)
        start = source.read(8)
        if start[:4] != MAGIC:
            raise ValueError("not a DAC file")
        n = int.from_bytes(start[4:8], "little")
        head, base = json.loads(source.read(n)), 8 + n

        def section(name):
            at, size, kind = head["sections"][name]
            return _Column(source, base + at, size, kind)

        widths = tuple(head["widths"])
        self.doc_ids, self.starts = section("doc_ids"), section("starts")
        last = len(widths) - 1
        self.levels = Levels(widths, [section(f"chunks{k}") for k in range(last + 1)], [section(f"bits{k}") for k in range(last)], [section(f"ranks{k}") for k in range(last)], head["tokens"])

    def document(self, k: int) -> np.ndarray:
        return self.documents(k, k + 1)[0]

    def documents(self, lo: int, hi: int) -> list[np.ndarray]:
        starts = self.starts[lo : hi + 1].astype(np.int64)
        return np.split(self.levels.slice(int(starts[0]), int(starts[-1])), starts[1:-1] - starts[0])


# ---- tokenizing ------------------------------------------------------------------------------------------------------

_STOPS = _words.byte_class(lambda b: chr(b) in ".,;:!?")
_LETTER = _words.byte_class(lambda b: chr(b).isascii() and chr(b).isalpha())


class _Known:
    """Ids of words by hash, in flat arrays: sorted runs that are merged as they grow, and one table of ids."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._table, self.used = np.zeros(1 << 16, np.uint16), 0

    @property
    def table(self):
        return self._table

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in the table, how many ids; -1 if unknown) of each key."""
        begin, sizes = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for k, at, n in self.runs:
            i = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[i] == keys
            begin[hit], sizes[hit] = at[i[hit]], n[i[hit]]
        return begin, sizes

    def add(self, keys: np.ndarray, codes: list, keep: bool = False) -> None:
        """keys: sorted and unknown."""
        if not keep and sum(len(r[0]) for r in self.runs) + len(keys) > CACHE_WORDS:
            self.clear()
        n = np.array([len(c) for c in codes], dtype=np.int64)
        flat = np.fromiter((i for c in codes for i in c), dtype=np.uint32, count=int(n.sum()))
        if len(flat) and int(flat.max()) >> 16 and self._table.dtype == np.uint16:
            self._table = self._table.astype(np.uint32)
        while self.used + len(flat) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        self._table[self.used : self.used + len(flat)] = flat
        self.runs.append((keys, self.used + np.cumsum(n) - n, n))
        self.used += len(flat)
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            a, b = self.runs.pop(), self.runs.pop()
            k = np.concatenate([a[0], b[0]])
            order = np.argsort(k, kind="stable")
            self.runs.append((k[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]))


class WordEncoder:
    """Ids of whole texts by a tokenizers file whose pre-tokenizer drops white space and never joins across it.

    Texts are cut where the library itself always cuts: at ASCII white space, and between an ASCII letter and a following
    stop mark. Each distinct piece goes through the library once and is then kept (CACHE_WORDS at most; the cache is emptied
    when full), so the cost follows distinct words. A-Z is lowered first unless a non-ASCII byte follows, which the file's
    own normalizer would do as well. ``whole`` is the plain way, for tests and for files of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        self.suffix = setup["model"].get("end_of_word_suffix") or ""
        kinds = [x["type"] for x in (setup.get("normalizer") or {}).get("normalizers", [])]
        split = (setup.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True and bool(self.suffix)
        self.special = [t["content"] for t in setup.get("added_tokens", [])]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = bool(self.suffix) and token.endswith(self.suffix)
        self.known = _Known()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, new: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: dict[bytes, np.ndarray] = {}
        one, rest = [], []
        for w in new:
            s = w.decode()
            if s.isascii() and s.isalpha() and s.islower():
                out[w] = [t.id for t in self.tokenizer.model.tokenize(s)]
            elif regex.fullmatch(r"\p{L}+", s):
                one.append((w, s))
            else:
                rest.append((w, s))
        for at in range(0, len(one), 200):
            group = one[at : at + 200]
            ids = np.array(self.tokenizer.encode(" ".join(s for _, s in group), add_special_tokens=False).ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):  # a character on which two Unicode versions differ
                rest += group
                continue
            for (w, _), part in zip(group, np.split(ids, stops[:-1]), strict=True):
                out[w] = part
        for w, s in rest:
            out[w] = self.whole(s)
        return [out[w] for w in new]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text)."""
        offsets, data = _words.buffers(texts)
        raw_all = data.tobytes()
        plain = self.by_word and not any(s.encode() in raw_all for s in self.special)
        if not plain:
            each = [self.whole(t or "") for t in texts.to_pylist()]
            return np.concatenate([*each, np.zeros(0, np.uint32)]).astype(np.uint32), np.array([len(x) for x in each], dtype=np.int64)
        flat, counts = [], np.zeros(len(texts), dtype=np.int64)
        for at, to in _words.pieces(offsets, data, _words.NOT_BLANK):
            raw = data[at:to]
            here = offsets - at
            ascii_next = np.ones(len(raw), dtype=bool)
            ascii_next[:-1] = raw[1:] < 0x80
            raw = np.where(ascii_next, _words.LOWER[raw], raw)
            s, e = _words.spans(here, raw, 0, len(raw), _words.NOT_BLANK)
            if not len(s):
                continue
            cut = np.flatnonzero(_LETTER[raw[:-1]] & _STOPS[raw[1:]]) + 1
            begins = np.zeros(len(raw) + 1, dtype=bool)
            begins[s] = True
            cut = cut[~begins[cut]]  # not where another text begins
            s, e = np.sort(np.concatenate([s, cut]), kind="stable"), np.sort(np.concatenate([e, cut]), kind="stable")
            h = _words.span_hashes(raw, s, e)
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            begin, sizes = self.known.find(keys)
            new = np.flatnonzero(sizes < 0)
            if len(new):
                text = raw.tobytes()
                self.known.add(keys[new], self._learn([text[s[i] : e[i]] for i in first[new].tolist()]))
                begin, sizes = self.known.find(keys)
                if (sizes < 0).any():  # the cache was emptied
                    lost = np.flatnonzero(sizes < 0)
                    self.known.add(keys[lost], self._learn([text[s[i] : e[i]] for i in first[lost].tolist()]), keep=True)
                    begin, sizes = self.known.find(keys)
            table = self.known.table
            n = sizes[back]
            ends = np.cumsum(n)
            flat.append(table[np.repeat(begin[back] - (ends - n), n) + np.arange(ends[-1])])
            counts += np.bincount(np.searchsorted(here, s, "right") - 1, weights=n, minlength=len(texts)).astype(np.int64)[: len(texts)]
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process; its cache lives as long as the process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---- the operator ----------------------------------------------------------------------------------------------------

MANIFEST = "file string, part int, seq int, first_doc long, last_doc long, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 2, partitions: int | None = None, segment_tokens: int = SEGMENT_TOKENS, id_bytes: int = 2) -> DataFrame:
    """Encodes every text and writes the ids, end id last, in ascending doc_id order; returns the committed manifest.

    Encoding goes before the one exchange, so what moves is ids of two bytes, not texts. Parts are ranges of doc_id between
    approximate quantiles, found from that column alone, so no text is encoded twice, and no ids are stored, to sample the ranges; a part holds any
    number of files, each of about segment_tokens ids, so no task holds more than one file's ids.
    """
    spark = docs.sparkSession
    _store.text_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), 10_000).alias("cuts")).first()["cuts"] if n > 1 else None
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def encode(batches):
        enc = encoder(tokenizer_path)
        for b in _words.small_batches(batches, "text"):
            ids, counts = enc.batch(b.column(1))
            ends = np.cumsum(counts)
            if len(ids) and int(ids.max()) >> 8 * id_bytes:
                raise ValueError(f"an id needs more than {id_bytes} bytes")
            ids = np.insert(ids, ends, end_id).astype(f"<u{id_bytes}")
            at = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * ids.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)])
            part = np.searchsorted(bounds, b.column(0).fill_null(-(1 << 63)).to_numpy(), "left").astype(np.int32)
            yield pa.record_batch([pa.array(part), b.column(0), packed.cast(pa.binary())], names=["part", "doc_id", "ids"])

    def write(batches):
        now, seq, docs_, parts, size = None, 0, [], [], 0
        fs, base = _store.filesystem(out)
        fs.create_dir(base, recursive=True)
        schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

        def flush():
            nonlocal seq, docs_, parts, size
            name = f"part-{now:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            known = np.array([-(1 << 63) if d is None else d for d in docs_], dtype=np.int64)
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(pack(known, starts, np.concatenate(parts)))
            row = {"file": [name], "part": [now], "seq": [seq], "first_doc": [docs_[0]], "last_doc": [docs_[-1]], "n_docs": [len(docs_)], "n_tokens": [size]}
            seq, docs_, parts, size = seq + 1, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for b in batches:
            for part, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if docs_ and part != now:
                    yield flush()
                if part != now:
                    now, seq = part, 0
                docs_.append(doc)
                parts.append(np.frombuffer(ids.as_buffer(), dtype=f"<u{id_bytes}").copy())  # the batch's memory may go
                size += len(parts[-1])
                if size >= segment_tokens:
                    yield flush()
        if docs_:
            yield flush()

    coded = docs.mapInArrow(encode, "part int, doc_id long, ids binary").repartitionById(n, F.col("part"))  # a task per part
    rows = coded.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.crc32("ids")).mapInArrow(write, MANIFEST)
    return _store.written(rows, "dac-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the number of ids in all files before. Files are many, but a sum per part is small: the
    running sum over parts takes one row per part, and the one over a part's files stays within the part."""
    per_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    bases = per_part.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("in_part", inner).join(bases, "part").withColumn("start", F.col("part_start") + F.col("in_part")).drop("in_part", "part_start")


def read_tokens(manifest: DataFrame, out: str, digest: bool = False) -> DataFrame:
    """The files read back: doc_id, start, n_tokens and the ids, or their crc32 instead (digest)."""

    def read(batches):
        fs, base = _store.filesystem(out)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    d = DacFile(f)
                    for lo in range(0, len(d.doc_ids), 1000):
                        ids = [x.astype("<u4") for x in d.documents(lo, min(lo + 1000, len(d.doc_ids)))]
                        docs_ = [None if x == -(1 << 63) else x for x in d.doc_ids[lo : lo + 1000].tolist()]
                        last = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                        yield pa.record_batch([pa.array(docs_, pa.int64()), pa.array((d.starts[lo : lo + len(ids)].astype(np.int64) + start)), pa.array([len(x) for x in ids], pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    files = with_starts(manifest).select("file", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
