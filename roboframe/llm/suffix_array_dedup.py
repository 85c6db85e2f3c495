"""Suffix-array dedup: removal of long byte strings that occur more than once.

The suffix array is a sparse one. In every `length`-byte window the smallest of its `core`-byte strings (by hash) marks
an anchor; equal windows have their anchor at the same place, so it is enough to sort the suffixes that start at
anchors, about one in a hundred bytes, each with the bytes before it that its windows cover. Suffixes whose core occurs
once in the corpus are left out early by a bitmap of fixed size.

Splitters sampled by Spark range-partition the suffixes by their bytes and then by the reversed bytes before them, so that
a passage which very many documents share, each with surroundings of its own, fills several buckets. Each bucket sorts
its suffixes by multikey quicksort, eight bytes a step, and the reversed bytes before them likewise; what neighbours have
in common in both orders tells which windows around an anchor are equal, byte by byte. Windows whose bytes after the
anchor are those of the first or the last suffix of a bucket may go on in the next one: only these are compared across
the boundaries, by an exchange of digests.

A second, shorter length goes through the same array: the anchors of longer windows are among those of shorter ones, so a
suffix has the windows of both lengths, and each length is told by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import (
    KEY_BITS,
    back,
    bitmap,
    bitmap_udf,
    discard,
    few_samples,
    joined,
    key_slot,
    partitions,
    prefix_hash,
    renamed,
    set_aside,
    slices,
    span_hash,
    table,
    test_bits,
    written,
)

#: log2 of the bits of the bitmap of repeated cores.
CORE_BITS = 24
#: A third of the suffixes of a bucket that Spark samples for its splitters; the driver gets these, of 680 bytes at most.
SAMPLED = 8
NONE = np.zeros(0, dtype=np.int64)


class Anchors:
    """The anchors of a batch of texts: place, text number, core fingerprint, and for each of `lengths` (longest first) the
    windows [lo, hi] they stand for (a window starts o bytes before its anchor, lo <= o <= hi; none if hi is -1)."""

    def __init__(self, texts: list, lengths: tuple[int, ...], core: int):
        self.data, self.starts = joined(texts)
        n, w = len(self.data), lengths[-1] - core + 1
        self.at = self.text = NONE
        self.token = np.zeros(0, dtype=np.uint64)
        self.lo = self.hi = np.zeros((len(lengths), 0), dtype=np.int64)
        self.after = self.before = NONE
        if n <= lengths[-1]:
            return
        prefix = prefix_hash(self.data)
        gram = span_hash(prefix, slice(0, n - core + 1), slice(core, n + 1))
        rank = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
        least = _sliding_min(rank, w)
        self.at, self.text, lo, hi = self._found(least, lengths[-1])
        self.token = gram[self.at]
        self.lo = np.repeat(np.array(lengths)[:, None], len(self.at), axis=1)
        self.hi = np.full_like(self.lo, -1)
        self.lo[-1], self.hi[-1] = lo, hi
        for k, length in enumerate(lengths[:-1]):
            more = length - lengths[-1]
            if n <= length:
                continue
            # the least of a longer window is the least of the shorter windows in it
            longer = np.minimum.reduce([least[o : len(least) - more + o] for o in (*range(0, more, w), more)])
            at, _, lo, hi = self._found(longer, length)
            row = np.searchsorted(self.at, at)
            self.lo[k, row], self.hi[k, row] = lo, hi
        # the suffix at an anchor and the bytes before it, as far as its windows reach
        self.after, self.before = (np.array(lengths)[:, None] - self.lo).max(axis=0), self.hi.max(axis=0)

    def _found(self, least: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        step = np.zeros(len(self.data) + 1, dtype=np.int8)
        ends = self.starts[1:] - 1 - length + 1
        some = ends > self.starts[:-1]
        step[self.starts[:-1][some]] += 1
        step[ends[some]] -= 1
        inside = np.cumsum(step[: len(least)], dtype=np.int8) > 0  # starts of windows that lie in one text
        other = least[1:] != least[:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= other | ~inside[:-1]
        last[:-1] &= other | ~inside[1:]
        head, tail = np.flatnonzero(first), np.flatnonzero(last)
        at = (least[head] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return at, np.searchsorted(self.starts, at, side="right") - 1, at - tail, at - head


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :])


def words_of(strings: list[bytes], width: int) -> np.ndarray:
    """Strings of up to `width` bytes, filled up with zeros, as rows of big-endian 64-bit words."""
    size = -(-width // 8) * 8
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in strings), dtype=">u8").reshape(-1, size // 8).astype(np.uint64)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words, and the number of bytes that each row in this order has in common with the one before.

    A multikey quicksort: rows are ordered by their first word, and only runs of equal rows go on to the next one.
    """
    order, common_ = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    open_, run = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    for k in range(words.shape[1]):
        rows = order[open_]
        rows = rows[np.lexsort((words[rows, k], run))]
        order[open_] = rows
        value = words[rows, k]
        together = run[1:] == run[:-1]
        same = together & (value[1:] == value[:-1])
        parted = np.flatnonzero(together & ~same)
        differ = value[parted + 1] ^ value[parted]
        leading = sum((differ < np.uint64(1 << (64 - 8 * t))).astype(np.int64) for t in range(1, 8))
        common_[open_[parted + 1]] = 8 * k + leading
        run = np.cumsum(np.concatenate(([0], ~same)))[: len(open_)]
        more = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, dtype=bool)
        open_, run = open_[more], run[more]
    common_[open_[1:][run[1:] == run[:-1]]] = 8 * words.shape[1]
    return order, common_


def _cores(lengths: tuple[int, ...], core: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for batch in batches:
            for part in slices(batch):
                token, n = np.unique(Anchors(part["text"].tolist(), lengths[-1:], core).token, return_counts=True)
                yield pd.DataFrame({"core": token.astype(np.int64), "n": n})

    return run


def _spans(lengths: tuple[int, ...]) -> list[str]:
    return [f"{x}{k}" for x in ("lo", "hi") for k in range(len(lengths))]


def _found(lengths: tuple[int, ...]) -> str:
    spans = ", ".join(f"{x} int" for x in _spans(lengths))
    return f"kind int, h1 long, h2 long, core long, suffix binary, before binary, {spans}, n int, key long, at long"


def _suffixes(lengths: tuple[int, ...], core: int, bits: np.ndarray):
    """(key, text) -> kind 0: the distinct suffixes of this task (a digest, their bytes, the windows lo..hi of each length,
    and whether they occur once or again); kind 1: occurrences, for each key once."""
    spans, columns = _spans(lengths), [c.split()[0] for c in _found(lengths).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        told, seen = {}, set()
        for batch in batches:
            for part in slices(batch):
                x = Anchors(part["text"].tolist(), lengths, core)
                keep = np.flatnonzero(_repeated(bits, x.token))
                reach = np.concatenate((x.lo, x.hi))[:, keep].T.astype("<i4")
                salt, size = reach.tobytes(), 4 * len(spans)
                raw, tokens, digests, rows = x.data.tobytes(), x.token[keep].astype(np.int64), [], {}
                for i, (at, after, before) in enumerate(np.stack((x.at, x.after, x.before))[:, keep].T.tolist()):
                    suffix, before = raw[at : at + after], raw[at - before : at][::-1]
                    d = hashlib.blake2b(before + suffix, digest_size=16, salt=salt[i * size : i * size + size]).digest()
                    digests.append(d)
                    times = told.get(d, 0)
                    if times < 2:
                        told[d] = times + 1
                        n = rows[d][-1] if d in rows else 0
                        rows[d] = (0, int(tokens[i]), suffix, before, *reach[i].tolist(), n + 1)
                ids = np.frombuffer(b"".join(rows), dtype="<i8").reshape(-1, 2)
                if rows:
                    out = pd.DataFrame(list(rows.values()), columns=["kind", "core", "suffix", "before", *spans, "n"])
                    yield out.assign(h1=ids[:, 0], h2=ids[:, 1], key=0, at=0)[columns]
                keys = part["key"].to_numpy(np.int64)
                fresh = np.array([not (k in seen or seen.add(k)) for k in keys], dtype=bool)
                ids = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                own = fresh[x.text[keep]]
                keep, ids = keep[own], ids[own]
                if len(keep):
                    text = x.text[keep]
                    out = pd.DataFrame({"kind": 1, "h1": ids[:, 0], "h2": ids[:, 1], "key": keys[text], "at": x.at[keep] - x.starts[text]})
                    yield out.assign(core=0, suffix=None, before=None, n=0, **dict.fromkeys(spans, 0))[columns]

    return run


def _repeated(bits: np.ndarray, token: np.ndarray) -> np.ndarray:
    return test_bits(bits, token.astype(np.int64) & (len(bits) * 8 - 1))


RUNS = "h1 long, h2 long, length int, first int, last int, bucket int, entries binary"
ENTRY = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("length", "<i4"), ("offset", "<i4"), ("n", "<i4")])


def _sort_bucket(lengths: tuple[int, ...], core: int, buckets: int):
    """A bucket of suffixes -> runs of repeated windows (offsets first..last) of each, by length. Windows that the first or
    the last suffix may share with the next buckets are also handed on, once each, as digests packed by `buckets`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        f = pd.concat(frames, ignore_index=True)
        del frames
        n = f.groupby(["h1", "h2"])["n"].transform("sum").to_numpy(np.int64)
        f = f.assign(n=n).drop_duplicates(["h1", "h2"])
        order, common_ = multikey_sort(words_of(f["suffix"].tolist(), lengths[0]))
        f = f.iloc[order]
        group = np.cumsum(common_ < core)
        group -= group[:1]
        many = np.bincount(group)[group] > 1
        whole = (f["n"].to_numpy() > 1) & ~many
        reach = _reach(common_, lengths[0])
        open_ = many.copy()
        for k, length in enumerate(lengths):
            hi = f[f"hi{k}"].to_numpy(np.int64)
            some = f[whole & (hi >= 0)]
            yield _runs(some, length, some[f"lo{k}"], some[f"hi{k}"])
            open_ |= reach >= length - hi
        pick = np.flatnonzero(open_)
        yield from _windows(f.iloc[pick], common_[pick], reach[pick], lengths, core, buckets)

    return run


def _reach(common_: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix of a bucket has in common with the first or the last one. Another bucket's suffix that has k
    bytes in common with it has them in common with that end too, for all suffixes between begin with them."""
    least = np.minimum.accumulate
    step = np.concatenate((common_[1:], [length]))
    return np.maximum(least(np.concatenate(([length], common_[1:]))), least(step[::-1])[::-1])


def _runs(ids, length: int, first, last) -> pd.DataFrame:
    out = pd.DataFrame({"h1": ids["h1"].to_numpy(), "h2": ids["h2"].to_numpy(), "length": length, "first": np.asarray(first), "last": np.asarray(last)})
    return out.assign(bucket=-1, entries=b"")


def _windows(f: pd.DataFrame, common_: np.ndarray, reach: np.ndarray, lengths: tuple[int, ...], core: int, buckets: int) -> Iterator[pd.DataFrame]:
    """f in the order of suffixes, with the bytes that neighbours have in common. Window o starts o bytes before its
    anchor: two are equal if the suffixes agree in length - o bytes and the reversed bytes before them in o."""
    if not len(f):
        return
    order, before = multikey_sort(words_of(f["before"].tolist(), lengths[0] - core))
    left, n = np.empty(len(f), dtype=np.int64), f["n"].to_numpy(np.float64)
    for k, length in enumerate(lengths):
        lo, hi = f[f"lo{k}"].to_numpy(), f[f"hi{k}"].to_numpy()
        again, handed = np.zeros((len(f), length - core + 3), dtype=np.int8), []  # a column of zeros at both ends
        for o in range(length - core + 1):
            here = np.flatnonzero((lo <= o) & (o <= hi))
            if not len(here):
                continue
            left[order] = np.cumsum(before < o)
            block = np.cumsum(common_ < length - o)[here] * (len(f) + 1) + left[here]
            _, first, place = np.unique(block, return_index=True, return_inverse=True)
            times = np.bincount(place, weights=n[here])
            again[here, o + 1] = times[place] > 1
            first = first[reach[here[first]] >= length - o]
            handed.append((here[first], np.full(len(first), o), np.minimum(times[place[first]], 2)))
        if not handed:
            continue
        step = np.diff(again, axis=1)
        row, first = np.nonzero(step == 1)
        yield _runs(f.iloc[row], length, first, np.nonzero(step == -1)[1] - 1)
        row, offset, times = (np.concatenate(x) for x in zip(*handed, strict=True))
        yield from _hand_on(f, row, offset, times, length, buckets)


def _hand_on(f: pd.DataFrame, row, offset, times, length: int, buckets: int, most: int = 200_000) -> Iterator[pd.DataFrame]:
    suffix, before = f["suffix"].tolist(), f["before"].tolist()
    h1, h2 = f["h1"].to_numpy(np.int64), f["h2"].to_numpy(np.int64)
    for a in range(0, len(row), most):
        r, o = row[a : a + most], offset[a : a + most]
        digests = [
            hashlib.blake2b(before[i][:k][::-1] + suffix[i][: length - k], digest_size=16, salt=b"%d %d" % (length, k)).digest()
            for i, k in zip(r.tolist(), o.tolist(), strict=True)
        ]
        entry = np.zeros(len(r), dtype=ENTRY)
        digests = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        entry["d1"], entry["d2"], entry["h1"], entry["h2"] = digests[:, 0], digests[:, 1], h1[r], h2[r]
        entry["length"], entry["offset"], entry["n"] = length, o, times[a : a + most]
        bucket = entry["d1"] % buckets
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        packed = [entry[by[x:y]].tobytes() for x, y in zip(cuts, [*cuts[1:], len(by)], strict=True)]
        yield pd.DataFrame({"h1": 0, "h2": 0, "length": length, "first": 0, "last": 0, "bucket": bucket[by[cuts]], "entries": packed})


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows of the ends of all buckets with one range of digests: those that occur once in their own bucket and again
    in another. A window has an entry in each bucket at most, so no digest fills the group."""
    entry = np.frombuffer(b"".join(frame["entries"]), dtype=ENTRY)
    entry = entry[np.lexsort((entry["d2"], entry["d1"]))]
    new = np.concatenate(([True], (np.diff(entry["d1"]) != 0) | (np.diff(entry["d2"]) != 0)))[: len(entry)]
    place = np.cumsum(new) - 1
    hit = entry[(np.bincount(place, weights=entry["n"])[place] > 1) & (entry["n"] == 1)]
    return pd.DataFrame({"h1": hit["h1"], "h2": hit["h2"], "length": hit["length"], "first": hit["offset"], "last": hit["offset"]})


def _without(raw: bytes, cuts) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many are gone, in how many runs."""
    if cuts is None or not len(cuts):
        return raw, 0, 0
    change = np.zeros(len(raw) + 1, dtype=np.int64)
    pairs = np.asarray(cuts, dtype=np.int64)
    np.add.at(change, pairs >> 32, 1)
    np.add.at(change, pairs & 0xFFFFFFFF, -1)
    gone = np.cumsum(change[:-1]) > 0
    left = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
    return left, int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))


def _cut(names: list[str], sets: list[str], with_bytes: bool, with_text: bool, bits: np.ndarray | None = None):
    """Cut the rows' texts by each set of cuts; with a bitmap only those rows whose slot is clear, the others are left out.
    The other columns pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(~test_bits(bits, batch.column("slot").to_numpy(zero_copy_only=False))))
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            raws = [x.encode("utf-8", "surrogatepass") if x is not None else b"" for x in texts]
            kept, removed, spans = zip(*map(_without, raws, batch.column(sets[0]).to_pylist()), strict=True)
            columns = {n: batch.column(n) for n in names} | {
                "n_bytes": pa.array([len(x) for x in raws], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept": pa.array(kept if with_bytes else [None] * len(kept), pa.binary()),
                "kept_text": pa.array([x.decode("utf-8", "ignore") for x in kept] if with_text else [None] * len(kept), pa.string()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
            if len(sets) > 1:
                rest, removed, spans = zip(*map(_without, raws, batch.column(sets[1]).to_pylist()), strict=True)
                rest = [x.decode("utf-8", "ignore") if n else t for x, n, t in zip(rest, removed, texts, strict=True)]
                columns |= {"n_passage_bytes": pa.array(removed, pa.int64()), "n_passages": pa.array(spans, pa.int64()), "rest": pa.array(rest, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


RESULT = ["n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256"]
#: What `shorter` adds.
SHORTER = ["n_passage_bytes", "n_passages", "rest"]


def in_ranges(suffixes: DataFrame, buckets: int) -> DataFrame:
    """Ranges of suffixes, of equal ones by the reversed bytes before them."""
    return suffixes.repartitionByRange(buckets, "suffix", "before")


def remove_repeats(
    docs: DataFrame, length: int = 400, core: int = 200, carry: tuple[str, ...] = (), with_text: bool = False, shorter: int = 0, with_bytes: bool = True
) -> DataFrame:
    """docs(doc_id, text, ...) -> a row per row of docs: doc_id, the columns in `carry`, n_bytes, n_removed, n_spans,
    kept (the remaining bytes; null if with_bytes isn't set), kept_text (these as a text, without characters that a cut
    splits; null unless with_text is set), kept_sha256.

    Each byte covered by a `length`-byte string of UTF-8 bytes that also starts anywhere else (the same text included,
    overlaps count) is removed; strings are judged on the input, and none crosses texts. Null and empty texts have no
    bytes; texts below `length` stay whole; rows that repeat count as places of their own, so they are removed from
    each other; a null doc_id stays null; columns in `carry` pass as they are whatever their names, but for those of the
    result; other columns are ignored. An empty table gives an empty result.

    With `shorter` (core <= shorter < length) strings of that many bytes are told by the same rule beside them:
    n_passage_bytes and n_passages (the bytes they cover, and in how many runs), and rest, the text without these.
    """
    if shorter and not core <= shorter < length:
        raise ValueError("shorter has to be from core to below length")
    spark = docs.sparkSession
    lengths = (length, shorter) if shorter else (length,)
    result = RESULT + SHORTER * bool(shorter)
    inner = set_aside(carry, result)
    names = ["doc_id", *inner.values()]
    source = docs.select("doc_id", *renamed(inner), F.col("text").cast("string").alias("text"))
    source = source.withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), "text"))
    long_ = source.where(F.octet_length("text") >= lengths[-1]).select("key", "text")

    cores = long_.select("text").mapInPandas(_cores(lengths, core), "core long, n long")
    again = cores.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core")
    bits = bitmap(again.select(F.pmod("core", F.lit(1 << CORE_BITS)).alias("slot")), CORE_BITS)
    found = written(long_.mapInPandas(_suffixes(lengths, core, bits), _found(lengths)), "op9-suffixes")

    suffixes = found.where("kind = 0").select("h1", "h2", "suffix", "before", *_spans(lengths), "n")
    sorted_ = in_ranges(suffixes, 2 * partitions(spark)).mapInPandas(_sort_bucket(lengths, core, partitions(spark)), RUNS)
    with few_samples(spark, SAMPLED):
        runs = written(sorted_, "op9-runs")
    across = runs.where("bucket >= 0").select("bucket", "entries").groupBy("bucket")
    across = across.applyInPandas(_across, "h1 long, h2 long, length int, first int, last int")
    told = runs.where("bucket < 0").select("h1", "h2", "length", "first", "last").unionByName(across)

    places = found.where("kind = 1").select("h1", "h2", "key", "at").join(told, ["h1", "h2"])
    cut = F.shiftleft(F.col("at") - F.col("last"), 32) + (F.col("at") - F.col("first") + F.col("length"))
    sets = [f"cuts{k}" for k in range(len(lengths))]
    by_length = [F.collect_set(F.when(F.col("length") == x, cut)).alias(c) for c, x in zip(sets, lengths, strict=True)]
    cuts = written(places.groupBy("key").agg(*by_length), "op9-cuts")
    discard(found, runs)

    bits = bitmap(cuts.select(key_slot("key", KEY_BITS).alias("slot")), KEY_BITS)
    # one Python stage for each row: texts that lose nothing are finished at once, the others meet their cuts first
    marked = source.withColumn("slot", key_slot("key", KEY_BITS))
    none = F.lit(None).cast("array<long>")
    whole = marked.select(*names, "text", "slot", *(none.alias(c) for c in sets))
    part = marked.where(bitmap_udf(bits)("slot")).join(cuts.hint("merge"), "key", "left").select(*names, "text", *sets)
    kinds = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    schema += ", n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string"
    schema += ", n_passage_bytes long, n_passages long, rest string" * bool(shorter)
    cut_whole, cut_part = _cut(names, sets, with_bytes, with_text, bits), _cut(names, sets, with_bytes, with_text)
    out = whole.mapInArrow(cut_whole, schema).unionByName(part.mapInArrow(cut_part, schema))
    return out.select("doc_id", *back(inner), *result)


#: Bytes of the shortest passage that op9 tells beside the contract's 400: less than 51 words of five bytes with their blanks.
PASSAGE = 240


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, by strings of 400 bytes; then passages of over 50 words, by strings of PASSAGE bytes."""
    common.prepare(spark)
    out = remove_repeats(table(spark, sf_dir, "documents"), 400, PASSAGE // 3, shorter=PASSAGE, with_bytes=False)
    return out.drop("kept", "kept_text").withColumnRenamed("rest", "text")
