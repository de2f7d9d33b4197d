"""Byte-level BPE with tiktoken: whole texts to ids by a local rank file, and ids back to raw bytes.

A text over PIECE_CHARS is cut where a match of the split pattern begins whatever stands around it: at a single blank between a
letter, digit 0-9, point or comma and a letter, or between a wide stop mark and a letter. So each match is encoded on its own, as the library would do with the
whole text, and memory follows the piece. A piece without such a place grows to the next one. Decoding joins the bytes of the
ids and so needs no valid UTF-8 at the seams.

Null counts as empty: no ids. Repeated rows are encoded each; an empty table gives no rows; other columns pass through
``encode`` untouched unless they have the name of an output column, which they lose to it.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm import _store, _words

PIECE_CHARS = 100_000
_SAFE = regex.compile(r"(?<=[\p{L}0-9.,]) (?=\p{L})|(?<=[。！？，、；：])(?=\p{L})")
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """One rank file in one process."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str, limit: int = PIECE_CHARS):
        at = 0
        while len(text) - at > limit:
            cut = _SAFE.search(text, at + limit)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str, limit: int = PIECE_CHARS):
        """Arrays of ids, one per piece."""
        for piece in self.pieces(text, limit):
            yield np.array(self.bpe.encode_ordinary(piece), dtype="<u4")

    def decode(self, ids) -> bytes:
        return self.bpe.decode_bytes(np.asarray(ids).tolist())


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _mapped(df: DataFrame, read: str, kind: str, out: list[tuple[str, str, pa.DataType]], each) -> DataFrame:
    """df with the columns out (name, type in SQL and in Arrow), which take the place of those of these names; each(batch, codec
    column) cuts a batch and gives (part, new arrays)."""
    _store.text_batches(df.sparkSession)
    rows, names = _store.inner(df)
    new = [name for name, _, _ in out]
    kept = [k for k, c in enumerate(names) if c.lower() not in new]
    rest = rows.select(*[f"c{k}" for k in kept], F.col(_store.place(names, read)).cast(kind).alias("read"))

    def run(batches):
        for part, made in each(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(x, t) for x, (_, _, t) in zip(made, out, strict=True)]], names=[*part.schema.names[:-1], *new])

    schema = rest.drop("read").withColumns({name: F.lit(None).cast(t) for name, t, _ in out}).schema
    return rest.mapInArrow(run, schema).toDF(*[names[k] for k in kept], *new)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the ids as little-endian uint32 bytes, and n_tokens."""

    def each(batches):
        c = codec(path, pattern)
        for b in _words.small_batches(batches, "read"):
            ids = [b"".join(x.tobytes() for x in c.encode(t or "")) for t in b.column(b.num_columns - 1).to_pylist()]
            yield b, (ids, [len(x) // 4 for x in ids])

    return _mapped(docs, text, "string", [(out, "binary", pa.binary()), ("n_tokens", "long", pa.int64())], each)


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """coded with the raw bytes of its ids; null ids decode to no bytes."""

    def each(batches):
        c = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield part, ([c.decode(np.frombuffer(x or b"", dtype="<u4")) for x in part.column(part.num_columns - 1).to_pylist()],)

    return _mapped(coded, ids, "binary", [(out, "binary", pa.binary())], each)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text piece by piece and keeps the digests only, so that neither ids nor bytes travel."""
    _store.text_batches(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for b in _words.small_batches(batches, "text"):
            n, coded, decoded = [], [], []
            for t in b.column(1).to_pylist():
                a, d, count = hashlib.sha256(), hashlib.sha256(), 0
                for ids in c.encode(t or ""):
                    a.update(ids.tobytes())
                    d.update(c.decode(ids))
                    count += len(ids)
                n.append(count)
                coded.append(a.hexdigest())
                decoded.append(d.hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
