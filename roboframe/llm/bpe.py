"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts each text into chunks wherever the last bytes hash to zero, so that texts with common passages have
common chunks. Chunks that occur more than once in the corpus are encoded once and fetched by their digest; what is
between them is encoded in place. Joins are repaired from the text around them: outside the first and last safe cut
of a piece (a blank between a word and a letter, where no token of the whole text can cross) nothing is kept of its own
encoding; the bytes from the last safe cut of one piece to the first of the next are encoded anew, over as many pieces
as it takes to reach safe cuts on both sides, together with some tokens on both sides. If these come out as they were,
old and new encoding agree; else the window grows into the pieces until they do.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import back, bitmap, joined, prefix_hash, renamed, runs_of, set_aside, slices, span_hash, table, test_bits, written

#: Bytes that decide a cut, one in how many places is a cut, and the shortest chunk.
ROLLING, EVERY, LEAST = 32, 1024, 64
#: log2 of the bits of the bitmap of repeated chunks.
CHUNK_BITS = 24
SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?]) (?=[A-Za-z])")
#: Longer windows without a safe cut go to the library that is built for them.
QUICK_CHARS = 100_000


class Codec:
    """Encodes as the tokenizers library does with the file, and decodes.

    Texts of Latin letters, whose character classes are the same in all versions of Unicode, go through the faster
    encoder of the same merges where the file's merges are in the order of its ids; all others through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        splits = spec["pre_tokenizer"] or {}
        if splits.get("type") != "ByteLevel" or spec["normalizer"] is not None or splits.get("add_prefix_space"):
            raise ValueError(f"{path} is not a byte-level BPE of plain text")
        self.slow = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        size = max([*vocab.values(), *special.values()]) + 1
        self.raw = [b""] * size
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.raw[i] = t
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.special = special
        self.quick = None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        if splits.get("use_regex", True) and all(vocab["".join(m)] == 256 + i for i, m in enumerate(pairs)):
            import tiktoken
            from public_tokenizers import PATTERN

            self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=self.kind)
        if self.quick is not None and len(text) <= QUICK_CHARS and _latin(text):
            return np.array(self.quick.encode(text, allowed_special="all"), dtype=self.kind)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def special_id(self, token: str) -> int:
        return self.special[token]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ODD = re.compile("[\x1c-\x1f\x7f-\xa0\xad]")


def _latin(text: str) -> bool:
    return (text.isascii() or max(text) < "ɐ") and not _ODD.search(text)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


common.KEPT.append(codec)


def chunk_ends(texts: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The joined bytes, the start of each text, and the ends of its chunks (relative to its start)."""
    data, starts = joined(texts)
    n = len(data)
    at = np.zeros(0, dtype=np.int64)
    if n > ROLLING:
        place = np.arange(ROLLING, n)
        h = span_hash(prefix_hash(data), place - ROLLING, place)
        at = place[(h % np.uint64(EVERY) == 0) & (data[place] & 0xC0 != 0x80)]
    first = np.searchsorted(at, starts)
    out = []
    for i in range(len(texts)):
        size, ends, last = int(starts[i + 1] - starts[i] - 1), [], 0
        for p in (at[first[i] : first[i + 1]] - starts[i]).tolist():
            if p - last >= LEAST and p >= ROLLING and p < size:
                ends.append(p)
                last = p
        if size:
            ends.append(size)
        out.append(np.array(ends, dtype=np.int64))
    return data, starts, out


def _digest(raw: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _count_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch):
            data, starts, ends = chunk_ends(part["text"].tolist())
            raw, counts = data.tobytes(), {}
            for s, e in zip(starts, ends, strict=False):
                a = 0
                for b in e.tolist():
                    d = _digest(raw[s + a : s + b])
                    counts[d] = counts.get(d, 0) + 1
                    a = b
            yield pd.DataFrame([(*d, n) for d, n in counts.items()], columns=["h1", "h2", "n"])


class Piece:
    """A piece of text: bytes up to its first safe cut, ids from there to its last safe cut, bytes from there on.
    Without a safe cut all its bytes are in head and ids is None."""

    def __init__(self, head: bytes, ids: bytes | None, tail: bytes):
        self.head, self.ids, self.tail = head, ids, tail

    @staticmethod
    def of(text: str, c: Codec) -> Piece:
        first = SAFE.search(text)
        if first is None:
            return Piece(text.encode("utf-8", "surrogatepass"), None, b"")
        a = b = first.start()
        for at in range(len(text) - 1, a, -1):
            if text[at] == " " and SAFE.match(text, at):
                b = at
                break
        return Piece(text[:a].encode("utf-8", "surrogatepass"), c.encode(text[a:b]).tobytes(), text[b:].encode("utf-8", "surrogatepass"))


#: Tokens on either side of a join that are encoded again at first.
OVERLAP = 4


def _repair(out: list[np.ndarray], middle: bytes, right: np.ndarray, c: Codec) -> None:
    """Add to the ids in out those of the bytes that follow and of right, with a window around the join encoded until
    it agrees with both sides. The window begins and ends where a word begins."""
    n, left = OVERLAP, np.zeros(0, dtype=c.kind)
    while True:
        while out and len(left) < 4 * n:
            left = np.concatenate((out.pop(), left))
        a, b = max(0, len(left) - n), min(n, len(right))
        while a > 0 and not c.raw[left[a]].startswith(b" "):
            a -= 1
        while b < len(right) and not c.raw[right[b]].startswith(b" "):
            b += 1
        raw = b"".join([*map(c.raw.__getitem__, left[a:].tolist()), middle, *map(c.raw.__getitem__, right[:b].tolist())])
        new = c.encode(raw.decode("utf-8", "surrogatepass")) if a or not out else None
        if (
            new is not None
            and (not a or np.array_equal(new[: len(left) - a], left[a:]))
            and (b == len(right) or np.array_equal(new[len(new) - b :], right[:b]))
        ):
            out += [left[:a], new, right[b:]]
            return
        n *= 4


def join_pieces(pieces: list[Piece], c: Codec) -> np.ndarray:
    """The ids of a text from those of its pieces."""
    out, pending = [], b""
    for p in pieces:
        pending += p.head
        if p.ids is not None:
            _repair(out, pending, np.frombuffer(p.ids, dtype=c.kind), c)
            pending = p.tail
    _repair(out, pending, np.zeros(0, dtype=c.kind), c)
    return np.concatenate(out)


def _result(ids: np.ndarray, c: Codec, with_ids: bool) -> dict:
    text = c.decode(ids)
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        "ids": ids.tolist() if with_ids else None,
    }


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
PARTS = "parts array<struct<h1:long, h2:long, head:binary, body:binary, tail:binary>>"

def _encode(path: str, bits: np.ndarray, names: list[str], with_ids: bool):
    """Texts -> kind 0: finished rows, 1: rows that need chunks (parts), 2: chunks, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, told, row = codec(path), set(), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in runs_of(texts):
                part = texts[a:b]
                data, starts, ends = chunk_ends(part)
                raw, out, chunks = data.tobytes(), [], []
                for text, s, e in zip(part, starts.tolist(), ends, strict=False):
                    row += 1
                    cuts = [0, *e.tolist()]
                    spans = [raw[s + x : s + y] for x, y in zip(cuts, cuts[1:], strict=False)]
                    digests = [_digest(x) for x in spans]
                    shared = test_bits(bits, np.array([d[0] for d in digests], dtype=np.int64) & (len(bits) * 8 - 1))
                    if not shared.any():
                        out.append({"kind": 0, "row": row} | _result(c.encode(text or ""), c, with_ids))
                        continue
                    parts, own = [], b""
                    for (h1, h2), span, there in zip(digests, spans, shared, strict=True):
                        if not there:
                            own += span
                            continue
                        if own:
                            parts.append(_own(own, c))
                            own = b""
                        parts.append({"h1": h1, "h2": h2, "head": None, "body": None, "tail": None})
                        if (h1, h2) not in told:
                            told.add((h1, h2))
                            chunks.append({"kind": 2, "h1": h1, "h2": h2, "chunk": span})
                    if own:
                        parts.append(_own(own, c))
                    out.append({"kind": 1, "row": row, "parts": parts})
                yield _batch(out, [batch.column(n).slice(a, b - a) for n in names], names)
                yield _batch(chunks, [pa.nulls(len(chunks), batch.column(n).type) for n in names], names)

    return run


PARTS_TYPE = pa.list_(
    pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("head", pa.binary()), ("body", pa.binary()), ("tail", pa.binary())])
)
TYPES = {
    "kind": pa.int32(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
    "ids": pa.list_(pa.int32()), "parts": PARTS_TYPE, "row": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "chunk": pa.binary(),
}


def _batch(rows: list[dict], carried: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    own = {n: pa.array([r.get(n) for r in rows], type=t) for n, t in TYPES.items()}
    arrays = {"kind": own.pop("kind")} | {f"carried_{n}": x for n, x in zip(names, carried, strict=True)} | own
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=["kind", *names, *own])


def _own(raw: bytes, c: Codec) -> dict:
    p = Piece.of(raw.decode("utf-8", "surrogatepass"), c)
    return {"h1": None, "h2": None, "head": p.head, "body": p.ids, "tail": p.tail}


def _encode_chunks(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            pieces = [Piece.of(x.decode("utf-8", "surrogatepass"), c) for x in batch["chunk"]]
            yield pd.DataFrame(
                {
                    "h1": batch["h1"],
                    "h2": batch["h2"],
                    "head": [p.head for p in pieces],
                    "body": [p.ids for p in pieces],
                    "tail": [p.tail for p in pieces],
                }
            )

    return run


def _assemble(path: str, names: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                parts, fetched = batch.column("parts")[i].as_py(), batch.column("fetched")[i].as_py()
                have = {(x["h1"], x["h2"]): Piece(x["head"], x["body"], x["tail"]) for x in fetched}
                pieces = [
                    Piece(p["head"], p["body"], p["tail"]) if p["h1"] is None else have[p["h1"], p["h2"]] for p in parts
                ]
                out.append({"kind": 0} | _result(join_pieces(pieces, c), c, with_ids))
            yield _batch(out, [batch.column(n) for n in names], names).select(
                [*names, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
            )

    return run


def encode_documents(docs: DataFrame, path: str, carry: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> a row per row of docs: doc_id, the columns in `carry`, n_tokens, ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 (of the text that the ids decode to), and ids where with_ids is set.

    `path` is a byte-level BPE file of the tokenizers library, the same on all executors; no special tokens are added,
    and those whose strings stand in a text are recognized as the library does. Null counts as empty, an empty text
    has no tokens; rows that repeat give a row each; a null doc_id stays null; columns in `carry` pass as they are whatever
    their names, but for those of the result; other columns are ignored; an empty table gives an empty result.
    """
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    inner = set_aside(carry, columns)
    names = ["doc_id", *inner.values()]
    source = docs.select("doc_id", *renamed(inner), F.col("text").cast("string").alias("text"))
    kinds = dict(source.dtypes)
    own = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    counts = source.select("text").mapInPandas(_count_chunks, "h1 long, h2 long, n long")
    shared = counts.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1")
    bits = bitmap(shared.select(F.pmod("h1", F.lit(1 << CHUNK_BITS)).alias("slot")), CHUNK_BITS)
    schema = f"kind int, {own}, {RESULT}, {PARTS}, row long, h1 long, h2 long, chunk binary"
    done = written(source.mapInArrow(_encode(path, bits, names, with_ids), schema), "op8-encoded")
    chunks = done.where("kind = 2").select("h1", "h2", "chunk").dropDuplicates(["h1", "h2"])
    chunks = chunks.mapInPandas(_encode_chunks(path), "h1 long, h2 long, head binary, body binary, tail binary")
    open_ = done.where("kind = 1").select(*names, "row", "parts")
    wanted = open_.select("row", F.explode("parts").alias("p")).where("p.h1 IS NOT NULL")
    wanted = wanted.select("row", F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2")).distinct()
    fetched = wanted.join(chunks, ["h1", "h2"]).groupBy("row")
    fetched = fetched.agg(F.collect_list(F.struct("h1", "h2", "head", "body", "tail")).alias("fetched"))
    repaired = open_.join(fetched, "row").select(*names, "parts", "fetched")
    repaired = repaired.mapInArrow(_assemble(path, names, with_ids), f"{own}, {RESULT}")
    out = done.where("kind = 0").select(*names, *columns).unionByName(repaired.select(*names, *columns))
    return out.select("doc_id", *back(inner), *columns)


def default_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return encode_documents(table(spark, sf_dir, "documents"), default_path())
