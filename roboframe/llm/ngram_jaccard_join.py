"""N-gram Jaccard join by PartEnum signatures.

Sets whose sizes lie in one band or in neighbouring bands and whose Jaccard similarity reaches the threshold differ in
at most k elements, k depending on the band alone. A hash cuts the feature domain into k / 2 + 1 first-level parts or
more, so that two such sets differ in at most one element in one of these; each is cut into three second-level parts,
and the content of every subset of two of the three is one signature: at least one subset is the same in both. Where k
is small a part is not cut again: there are more than k parts, one of which is the same in both.

Both sets empty in a subset would agree there without saying anything, so empty subsets give no signature: `spare`
further parts make up for them, and a set in which more parts than that have an empty subset also signs under the next
hash function (at the last one it signs the empty ones too). If one of two sets stops at a level, more good parts than
it has with empty subsets are left, so they meet there; else both go on: no pair is lost.

Candidates are compared exactly. Of every group that shares a signature first the pairs with its smallest member are
compared; where that leaves more than one component in a group, the members of all such groups are split by the rare
elements that similar sets must share and all pairs of different components among these are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import LOWER, bitmap, discard, joined, key_slot, mix, near_keys, partitions, slices, table, test_bits, words, written
from .graph import components

#: Bytes of words: all but blank and \t \n \v \f \r.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that a signature, and an element whose sharing is counted, keep beside their bucket. A chance agreement of two
#: only adds a candidate, or loosens a bound.
SIGNATURE, SHARED = 4, 4
#: From this number of differing elements on, parts are cut again, and subsets of CUTS - 1 of them are enumerated.
LEAST_CUT, CUTS = 8, 3
#: Hash functions tried before empty parts are signed.
LEVELS = 8
#: Bits of a set's sketch: bit i is the parity of its number of elements with that hash. The bits in which two sketches
#: differ are at most the elements in which the sets differ, so a pair that differs in too many bits is refuted.
SKETCH_BITS = 1 << 11
#: Counters of the frequency sketch that orders elements, whatever the number of rows.
COUNTERS = 1 << 20
#: log2 of the bits of the bitmap of documents that share a signature.
NODE_BITS = 23
#: Signatures that a task gathers before it hands them on.
FLUSH = 600_000


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Band of each size up to `largest`; per band the number of parts, of spare ones among them, and of the second-level
    parts of each."""
    last, at = [0], 1
    while at <= largest:
        last.append(at * 100 // percent)
        at = last[-1] + 1
    last.append(at * 100 // percent)
    ends = np.array(last, dtype=np.int64)
    least = np.concatenate(([0, 0], ends[:-2] + 1))  # of the band before, which signs here too
    differ = 2 * ends * (100 - percent) // (100 + percent)
    cuts = np.where(differ >= LEAST_CUT, CUTS, 1)
    parts = np.where(cuts > 1, differ // 2 + 1, differ + 1)
    # parts with an empty subset that are to be expected
    empty = np.where(cuts > 1, CUTS * parts * np.exp(-least * (CUTS - 1) / CUTS / parts), 0.1 * differ)
    spare = np.where(differ > 0, np.ceil(empty + np.sqrt(empty)), 0).astype(np.int64)
    return np.searchsorted(ends, np.arange(largest + 1)), parts + spare, spare, cuts


def signatures(x: np.ndarray, owner: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements x of sets `owner` (0..) of the given sizes (none empty) -> signatures and their owners."""
    band, parts, spare, cuts = bands(percent, int(size.max(initial=1)))
    value, out, whose = mix(x, 50), [], []
    for step in (0, 1):
        tag = band[size] + step
        active, e_x, e_owner, e_value = np.arange(len(size)), x, owner, value
        for level in range(LEVELS):
            cut = cuts[tag[active]]
            n = parts[tag[active]] * cut
            base = np.cumsum(n) - n
            local = np.searchsorted(active, e_owner) if level else e_owner
            second = ((mix(e_x, 100 + level) >> np.uint64(32)) * n[local].astype(np.uint64)) >> np.uint64(32)
            slot = base[local] + second.astype(np.int64)
            total = np.zeros(int(n.sum()), dtype=np.uint64)
            np.add.at(total, slot, e_value)
            count = np.bincount(slot, minlength=len(total))
            set_of = np.repeat(np.arange(len(active)), n)
            number = np.arange(len(total)) - base[set_of]
            first = np.arange(len(total)) - number % cut[set_of]  # place of the part in which a second-level part lies
            whole = cut[set_of] == 1
            # a subset is told by the second-level part that it leaves out
            heads = np.flatnonzero(number % cut[set_of] == 0)
            part = np.searchsorted(heads, first)
            total, count = (np.where(whole, v, np.add.reduceat(v, heads)[part] - v) for v in (total, count))
            sig = mix(total + mix((((tag[active][set_of] * LEVELS + level) << 32) + number).astype(np.uint64), 7), 9)
            filled = count > 0
            keep = filled if level < LEVELS - 1 else np.ones(len(sig), dtype=bool)
            out.append(sig[keep])
            whose.append(active[set_of[keep]])
            lacking = np.unique(first[~filled])
            empty = np.bincount(set_of[lacking], minlength=len(active))
            more = empty > spare[tag[active]]
            if not more.any():
                break
            chosen = more[local]
            active, e_x, e_owner, e_value = active[more], e_x[chosen], e_owner[chosen], e_value[chosen]
    return np.concatenate(out), np.concatenate(whose)


def shingle_sets(texts: list, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, as 64-bit hashes in one array; number of them per text."""
    data, starts = joined(texts)
    _, _, h, text_of = words(LOWER[data], starts, WORD)
    count = np.bincount(text_of, minlength=len(texts))
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        total = np.zeros(len(h), dtype=np.uint64)
        for j in range(min(n_words, len(h))):
            c = np.uint64((0xD1342543DE82EF95 * (2 * j + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
            total[: len(h) - j] += h[j:] * c
        out, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i in np.flatnonzero(count):
            a, k = first[i], count[i]
            if k >= n_words:
                got = np.unique(mix(total[a : a + k - n_words + 1], 21))
            else:
                weights = np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                got = mix(np.array([(mix(h[a : a + k], 31) * weights).sum()], dtype=np.uint64), 40 + int(k))
            out.append(got)
            sizes[i] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), sizes


OUT = "kind int, a long, b long, n long"
PACKED = "bucket int, kind int, x binary, y binary"


def pack(value: np.ndarray, doc: np.ndarray, buckets: int, width: int) -> pd.DataFrame:
    """Values with their documents (in runs) as a row for each bucket of values: the low `width` bytes of each value (the
    bucket comes from the high ones), small steps of ids."""
    zip_ = zstandard.ZstdCompressor(level=1)
    bucket = ((value >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)))
    low = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        at = order[a:b]
        ids = np.diff(doc[at], prepend=0).astype("<i8").tobytes()
        rows.append((int(bucket[at[0]]), 1, low[at].tobytes(), zip_.compress(ids)))
    return pd.DataFrame(rows, columns=["bucket", "kind", "x", "y"])


def unpack(part: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    unzip = zstandard.ZstdDecompressor()
    doc = [np.cumsum(np.frombuffer(unzip.decompress(y), dtype="<i8")) for y in part["y"]]
    return _wide(b"".join(part["x"]), width), np.concatenate(doc)


def _sign(n_words: int, percent: int, buckets: int):
    """(doc_id, text) -> rows (bucket, kind, x, y): packed signatures with their documents, and packed documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        sigs, docs, held, seen, turn = [], [], 0, set(), 0
        for batch in batches:
            for part in slices(batch):
                ids = part["doc_id"].to_numpy(np.int64)
                x, sizes = shingle_sets(part["text"].tolist(), n_words)
                owner = np.repeat(np.arange(len(ids)), sizes)
                total = np.zeros(len(ids), dtype=np.uint64)
                np.add.at(total, owner, mix(x, 5))
                key = mix(total, 6)
                turn += 1
                info = np.stack([ids, sizes, key.astype(np.int64)]).astype("<i8").tobytes()
                at = int(mix(ids[:1].astype(np.uint64), turn)[0] % np.uint64(buckets))
                yield pd.DataFrame([(at, 0, info, b"")], columns=["bucket", "kind", "x", "y"])
                fresh = np.zeros(len(ids), dtype=bool)
                for i in np.flatnonzero(sizes):
                    if (k := (int(key[i]), int(sizes[i]))) not in seen:
                        seen.add(k)
                        fresh[i] = True
                if not fresh.any():
                    continue
                pick = fresh[owner]
                number = np.cumsum(fresh) - 1
                sig, whose = signatures(x[pick], number[owner[pick]], sizes[fresh], percent)
                sigs.append(sig)
                docs.append(ids[fresh][whose])
                held += len(sig)
                if held > FLUSH:
                    yield pack(np.concatenate(sigs), np.concatenate(docs), buckets, SIGNATURE)
                    sigs, docs, held = [], [], 0
        if held:
            yield pack(np.concatenate(sigs), np.concatenate(docs), buckets, SIGNATURE)

    return run


def _collide(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: kind 0 documents (a id, b size, n set hash), 1 groups of two (a, b, n of them), and for larger
    groups 2 memberships (a document, n group)."""
    out = []
    for x in frame.loc[frame["kind"] == 0, "x"]:
        ids, sizes, key = np.frombuffer(x, dtype="<i8").reshape(3, -1)
        out.append(pd.DataFrame({"kind": 0, "a": ids, "b": sizes, "n": key}))
    part = frame[frame["kind"] == 1]
    if len(part):
        sig, doc = unpack(part, SIGNATURE)
        order = np.argsort(sig)
        same = np.concatenate(([False], np.diff(sig[order]) == 0))
        shared = same | np.concatenate((same[1:], [False]))
        order = order[shared]
        sig, doc = sig[order], doc[order]
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        new = np.concatenate(([True], (np.diff(sig) != 0) | (np.diff(doc) != 0)))[: len(sig)]
        sig, doc = sig[new], doc[new]
        head = np.concatenate(([True], np.diff(sig) != 0))[: len(sig)]
        group = np.cumsum(head) - 1
        size = np.bincount(group, minlength=0)
        two = size[group] == 2
        pairs, n = np.unique(doc[two].reshape(-1, 2), axis=0, return_counts=True)
        if len(pairs):
            out.append(pd.DataFrame({"kind": 1, "a": pairs[:, 0], "b": pairs[:, 1], "n": n}))
        large = size[group] > 2 if len(group) else np.zeros(0, dtype=bool)
        if large.any():
            g, d = group[large], doc[large]
            # groups with the same members say the same: one of them is kept
            mark = np.zeros(len(size), dtype=np.uint64)
            np.add.at(mark, g, mix(d.astype(np.uint64), 77))
            first = np.zeros(len(size), dtype=bool)
            first[np.unique(mark, return_index=True)[1]] = True
            keep = first[g]
            out.append(pd.DataFrame({"kind": 2, "a": d[keep], "b": 0, "n": mark[g[keep]].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"kind": [], "a": [], "b": [], "n": []}).astype("int64")


def _sets(bits: np.ndarray, n_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        seen = set()
        for batch in batches:
            hit = batch[test_bits(bits, batch["slot"].to_numpy(np.int64))]
            hit = hit[np.array([not (i in seen or seen.add(i)) for i in hit["doc_id"]], dtype=bool)]
            for part in slices(hit):
                x, sizes = shingle_sets(part["text"].tolist(), n_words)
                ends = np.cumsum(sizes)
                low = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                bit = np.repeat(np.arange(len(sizes)), sizes) * SKETCH_BITS + (x >> np.uint64(53)).astype(np.int64)
                odd = np.bincount(bit, minlength=len(sizes) * SKETCH_BITS).astype(np.uint8).reshape(len(sizes), -1) & 1
                yield pd.DataFrame(
                    {
                        "doc": part["doc_id"].to_numpy(np.int64),
                        "size": sizes,
                        "sketch": [r.tobytes() for r in np.packbits(odd, axis=1)],
                        "items": [low[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)],
                    }
                )

    return run


def _wide(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def _items(raw: bytes) -> np.ndarray:
    """Shingles as their low 48 bits: two sets of 20,000 shingles differ in a chance agreement once in 10**6 pairs."""
    return _wide(raw, 6)


def _compare(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            last, left = None, None
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                if x is not last:
                    last, left = x, _items(x)
                right = _items(y)
                small, large = sorted((len(left), len(right)))
                if 100 * small < percent * large:
                    continue
                both = np.concatenate((left, right))
                both.sort()
                common_ = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * common_ >= percent * (len(left) + len(right) - common_)
            yield batch.loc[keep, ["a", "b"]]

    return run


def _refute(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), dtype=np.uint64).reshape(len(batch), -1) for c in ("x", "y"))
                n, m = batch["n"].to_numpy(np.int64), batch["m"].to_numpy(np.int64)
                differ = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
                keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (
                    differ * (100 + percent) <= (100 - percent) * (n + m)
                )
                yield batch.loc[keep, ["a", "b"]]

    return run


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach the threshold: refuted by the sketches first, then compared whole."""
    left = sets.select(F.col("doc").alias("a"), F.col("size").alias("n"), F.col("sketch").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("size").alias("m"), F.col("sketch").alias("y"))
    near = pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(_refute(percent), "a long, b long")
    near = written(near, "op1-near")
    whole = near_keys(sets.select("doc", "items"), "doc", near.select(F.explode(F.array("a", "b")).alias("doc")))
    left = whole.select(F.col("doc").alias("a"), F.col("items").alias("x"))
    right = whole.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    # merge: the filter and the comparison are in stages of their own, so that a task needs one Python worker at a time
    both = near.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.mapInPandas(_compare(percent), "a long, b long")


def _deal(buckets: int):
    """Sets -> their elements by buckets of elements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, docs, held = [], [], 0
        for batch in batches:
            for doc, raw in zip(batch["doc"], batch["items"], strict=True):
                x = _items(raw)
                items.append(x << np.uint64(16) | x >> np.uint64(32))  # high bits for the bucket, low ones to tell apart
                docs.append(np.full(len(x), doc, dtype=np.int64))
                held += len(x)
                if held > FLUSH:
                    yield pack(np.concatenate(items), np.concatenate(docs), buckets, SHARED)
                    items, docs, held = [], [], 0
        if held:
            yield pack(np.concatenate(items), np.concatenate(docs), buckets, SHARED)

    return run


def _shared(buckets: int):
    """A bucket of elements -> for each document how many of them another document has too, by buckets of documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        item, doc = unpack(frame, SHARED)
        order = np.argsort(item)
        same = np.concatenate(([False], np.diff(item[order]) == 0))
        two = same | np.concatenate((same[1:], [False]))
        doc, n = np.unique(doc[order][two], return_counts=True)
        number = (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        rows = []
        for k in np.unique(number):
            at = number == k
            rows.append((int(k), doc[at].astype("<i8").tobytes(), n[at].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "x", "y"])

    return run


def _add_shared(frame: pd.DataFrame) -> pd.DataFrame:
    doc = np.frombuffer(b"".join(frame["x"]), dtype="<i8")
    n = np.frombuffer(b"".join(frame["y"]), dtype="<u4")
    doc, place = np.unique(doc, return_inverse=True)
    return pd.DataFrame({"doc": doc, "common": np.bincount(place, weights=n).astype(np.int64)})


def _slots(items: np.ndarray) -> np.ndarray:
    return (items % np.uint64(COUNTERS)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counters of a task, those of each block of slots packed: what was not seen takes no room."""
    total = np.zeros(COUNTERS, dtype="<u4")
    for batch in batches:
        for raw in batch["items"]:
            np.add.at(total, _slots(_items(raw)), np.uint32(1))
    rows = total.reshape(-1, 1 << 14)
    seen = np.flatnonzero(rows.any(axis=1))
    zip_ = zstandard.ZstdCompressor(level=1)
    yield pd.DataFrame({"block": seen, "counts": [zip_.compress(rows[k].tobytes()) for k in seen]})


def _sum_counts(frame: pd.DataFrame) -> pd.DataFrame:
    unzip = zstandard.ZstdDecompressor()
    total = sum(np.frombuffer(unzip.decompress(x), dtype="<u4").astype("<i8") for x in frame["counts"])
    return pd.DataFrame({"block": frame["block"].iloc[:1], "counts": [total.tobytes()]})


def _prefixes(counts: np.ndarray, percent: int, bits: np.ndarray):
    """Elements of the sets in the bitmap, rarest first, as far as similar sets must share one of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[test_bits(bits, batch["slot"].to_numpy(np.int64))]
            docs, items, places = [], [], []
            for doc, raw in zip(batch["doc"], batch["items"], strict=True):
                x = _items(raw)
                order = np.lexsort((x, counts[_slots(x)]))
                first = x[order[: len(x) - -(-percent * len(x) // 100) + 1]]
                items.append(first.astype(np.int64))
                docs.append(np.full(len(first), doc, dtype=np.int64))
                places.append(np.arange(len(first)))
            if docs:
                yield pd.DataFrame(
                    {"doc": np.concatenate(docs), "item": np.concatenate(items), "place": np.concatenate(places)}
                )

    return run


def _cross_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members(n group, a document, label component) -> pairs of members, of different components, that can be similar.

    All pairs of one group that can be are among these. Which groups a pair shares isn't looked up: it would be a row for
    each of them, some hundreds for a pair of long texts, to spare few pairs a comparison that tells more.
    The intersection is at most the number of elements that a document shares with anybody (`common`), so a partner's
    size is at most `reach` = common * (100 + percent) / percent - size; of two similar documents at least one has a
    reach of its own size or more (else each would be smaller than the other). Similar sets also share an element that
    is so early in both orders, rarest first, that enough elements follow it. Any order of the elements is exact; frequencies only make the pairs few, so counters of a fixed
    number do (a few MB for the driver at any size)."""
    buckets = partitions(members.sparkSession)
    dealt = sets.select("doc", "items").mapInPandas(_deal(buckets), PACKED).groupBy("bucket")
    common_ = dealt.applyInPandas(_shared(buckets), "bucket int, x binary, y binary").groupBy("bucket")
    common_ = common_.applyInPandas(_add_shared, "doc long, common long")
    labels = members.select(F.col("a").alias("doc"), "label").distinct()
    nodes = sets.select("doc", "size").distinct().join(common_, "doc").join(labels, "doc")
    reach = F.floor(F.col("common") * (100 + percent) / percent).cast("long") - F.col("size")
    nodes = nodes.withColumn("reach", reach).where(100 * F.col("reach") >= percent * F.col("size"))
    nodes = written(nodes, "op1-nodes")

    counts = sets.mapInPandas(_count, "block int, counts binary").groupBy("block")
    counts = counts.applyInPandas(_sum_counts, "block int, counts binary").orderBy("block").collect()
    table_ = np.zeros((COUNTERS >> 14, 1 << 14), dtype=np.int64)
    for r in counts:
        table_[r["block"]] = np.frombuffer(bytes(r["counts"]), dtype="<i8")
    counts = table_.ravel()
    bits = bitmap(nodes.select(key_slot("doc", NODE_BITS).alias("slot")), NODE_BITS)
    slotted = sets.select("doc", "items", key_slot("doc", NODE_BITS).alias("slot"))
    rare = slotted.mapInPandas(_prefixes(counts, percent, bits), "doc long, item long, place long")
    keyed = written(rare.distinct().join(nodes, "doc"), "op1-keyed")
    strong = F.col("reach") >= F.col("size")
    use = keyed.groupBy("item").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(strong).alias("any"))
    use = use.where("low <> high and any").select("item")
    keyed = written(keyed.join(use, "item"), "op1-keyed")
    # y is the smaller set of a pair: it has to have the element in the part that sets of its own size look at
    short = (100 + percent) * (F.col("size") - F.col("place")) >= 2 * percent * F.col("size")
    x, y = keyed.alias("x"), keyed.where(short).alias("y")
    need = F.expr(f"{percent} * (x.size + y.size)")
    on = [
        F.col("x.item") == F.col("y.item"),
        F.col("x.label") != F.col("y.label"),
        F.col("y.size") <= F.col("x.size"),
        F.col("x.size") <= F.col("y.reach"),
        F.col("y.size") <= F.col("x.reach"),
        (100 + percent) * (F.col("x.size") - F.col("x.place")) >= need,
        (100 + percent) * (F.col("y.size") - F.col("y.place")) >= need,
    ]
    ends = [F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")]
    return x.join(y, on).select(*ends).distinct()


def jaccard_components(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id).

    A document's set holds its distinct n-word shingles (fewer words: the whole sequence); documents link when
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id reachable. Null or blank texts have
    an empty set and are linked with nothing; rows without a doc_id are left out; rows that repeat a doc_id are one
    node and give a row each; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.where("doc_id IS NOT NULL")
    buckets = 2 * partitions(spark)
    packed = source.mapInPandas(_sign(n_words, percent, buckets), PACKED)
    found = written(packed.groupBy("bucket").applyInPandas(_collide, OUT), "op1-found")

    info = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("size"), F.col("n").alias("key"))
    some = info.where("size > 0")
    classes = some.groupBy("size", "key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    # read from a table: a join of two plain exchanges, in which Spark can split a class with very many copies
    classes = written(classes.where("n > 1").drop("n"), "op1-copied")
    some = some.join(classes, ["size", "key"], "left").unionByName(info.where("size = 0").withColumn("rep", F.lit(None).cast("long")))
    info = written(some.withColumn("rep", F.coalesce("rep", "doc_id")), "op1-classes")  # with root all that the result reads
    moved = info.where("rep <> doc_id").select("doc_id", "rep").distinct()

    def to_rep(df: DataFrame, column: str) -> DataFrame:
        key = moved.select(F.col("doc_id").alias(column), F.col("rep").alias("_rep"))
        return df.join(key, column, "left").withColumn(column, F.coalesce("_rep", column)).drop("_rep")

    # the member in most groups is nearest to what a group has in common: it is compared with all others first
    groups = written(to_rep(found.where("kind = 2").select("a", "n").distinct(), "a").distinct(), "op1-groups")
    degree = groups.groupBy("a").agg(F.count("*").alias("degree"))
    hub = groups.join(degree, "a").groupBy("n").agg(F.max_by("a", F.struct("degree", -F.col("a"))).alias("hub"))
    spokes = groups.join(hub, "n").select(F.col("hub").alias("a"), F.col("a").alias("b"), F.lit(1).cast("long").alias("n"))
    pairs = found.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n"))  # a pair meets in many buckets
    pairs = to_rep(to_rep(pairs, "a"), "b").unionByName(spokes)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").where("a < b")
    pairs = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "op1-pairs")

    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    bits = bitmap(ends.select(key_slot("doc", NODE_BITS).alias("slot")), NODE_BITS)
    sets = source.withColumn("slot", key_slot("doc_id", NODE_BITS)).mapInPandas(
        _sets(bits, n_words), "doc long, size long, sketch binary, items binary"
    )
    sets = written(sets, "op1-sets")
    links = written(similar_pairs(pairs, sets, percent), "op1-links")
    root = components(links, "op1-components")

    def labelled(df: DataFrame, column: str, out: str) -> DataFrame:
        key = root.select(F.col("node").alias(column), F.col("root").alias("_root"))
        return df.join(key, column, "left").withColumn(out, F.coalesce("_root", column)).drop("_root")

    members = labelled(groups, "a", "label")
    open_ = members.groupBy("n").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    members = written(members.join(open_.select("n"), "n"), "op1-open")
    if not members.isEmpty():
        cross = written(_cross_pairs(members, sets, percent).join(pairs, ["a", "b"], "left_anti"), "op1-cross")
        more = written(similar_pairs(cross, sets, percent), "op1-links")
        if not more.isEmpty():
            last, root = root, components(links.unionByName(more), "op1-components")
            discard(last)
        discard(cross, more)
    discard(found, classes, groups, pairs, sets, links, members)

    key = root.select(F.col("node").alias("rep"), "root")
    return info.join(key, "rep", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id")
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.r)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
