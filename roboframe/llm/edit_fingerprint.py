"""Document fingerprints by a randomised edit embedding.

A text walks along a tape of coins that all texts share: at each place of the tape the current character is written, and
the coin of that place and character says whether the walk goes on to the next character. An edit sets two walks apart,
and the coins bring them together again, so that the edit distance of texts becomes the Hamming distance of what they
wrote. A fingerprint samples places of the tape, as many from each octave, so that it is short for texts of any length
and its likeness to another estimates the share of the tape on which both texts agree.

Near texts are found by bands of sampled places: texts that agree in a band are candidates, whose whole fingerprints are
then compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import discard, mix, partitions, slices, table, written
from .graph import components

#: Independent walks; the likeness of two texts is that of the walk that came together best.
WALKS = 2
#: The tape repeats after so many places.
TAPE = 1 << 13
#: Sampled places of an octave [2^k, 2^(k+1)), all where it has fewer; octaves of the tape.
SAMPLES = 32
OCTAVES = 40
#: Bands of a walk and scale, and the sampled places in each.
BANDS, PLACES = 8, 8
#: Characters of texts that walk in step, about; below so many texts each goes on by itself.
TOGETHER, FEW = 8_000_000, 80
ROWS, PIECE = 4000, 1 << 20
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
LETTER = np.frombuffer(LETTERS.encode(), dtype=np.uint8)


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """The tape's coins know a character by one of 256 classes, a fingerprint by one of 64 letters."""
    points = np.arange(0x110000, dtype=np.uint64)
    return (mix(points, 5) >> np.uint64(56)).astype(np.uint8), LETTER[(mix(points, 6) >> np.uint64(58)).astype(np.int64)]


@cache
def strides() -> np.ndarray:
    """[walk, class * TAPE + place]: places that a character of that class fills from there on, until its coin falls."""
    out = np.empty((WALKS, 256 * TAPE), dtype=np.uint8)
    for w in range(WALKS):
        x = np.arange(256 * TAPE, dtype=np.uint64)
        coin = (mix(x, 100 + w) & np.uint64(1)).astype(bool).reshape(256, TAPE)
        coin[:, :: TAPE // 64] = True  # no stride is longer than that
        place = np.where(np.concatenate([coin, coin], axis=1), np.arange(2 * TAPE), 4 * TAPE)
        ahead = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :TAPE]
        out[w] = (ahead - np.arange(TAPE) + 1).astype(np.uint8).ravel()
    return out


def _places() -> tuple[np.ndarray, np.ndarray]:
    """Sampled places of the tape in order, and how many places each stands for."""
    rng, at, weight = np.random.default_rng(12), [np.arange(1)], [np.ones(1)]
    for k in range(OCTAVES):
        n = min(SAMPLES, 1 << k)
        step = (1 << k) // n
        at.append((1 << k) + np.arange(n) * step + rng.integers(0, step, n))
        weight.append(np.full(n, float(step)))
    return np.concatenate(at), np.concatenate(weight)


AT, WEIGHT = _places()
BAND = np.random.default_rng(13).random((WALKS, BANDS, PLACES))


class Texts:
    """Texts as classes of characters, with the places of the tape at which each walk begins. After walking, `end` holds
    the place after each character. Texts go in step while many are left, the longest then one after another."""

    def __init__(self, texts: list[str], begin: np.ndarray, walk: int):
        self.points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in texts]
        size = np.array([len(x) for x in self.points], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(size)))
        classes = characters()[0][np.concatenate([*self.points, np.zeros(0, dtype="<u4")])]
        self.begin = np.asarray(begin, dtype=np.int64)
        self.end = np.empty(len(classes), dtype=np.int64)
        stride = strides()[walk]
        order = np.argsort(-size, kind="stable")
        start, place, falling = self.start[:-1][order], self.begin[order].copy(), -size[order]
        t, here = 0, int(np.searchsorted(falling, 0, side="left"))
        while here > FEW:
            i = start[:here] + t
            j = place[:here]
            j += stride[(classes[i].astype(np.int64) * TAPE) | (j & (TAPE - 1))]
            self.end[i] = j
            t += 1
            here = int(np.searchsorted(falling, -t, side="left"))
        raw = stride.tobytes()
        for k in range(here):
            a, b = int(start[k]) + t, int(start[k]) - int(falling[k])
            for c in range(a, b, PIECE):
                out, j = [], int(place[k])
                for x in (classes[c : min(b, c + PIECE)].astype(np.int64) * TAPE).tolist():
                    j += raw[x | j & (TAPE - 1)]
                    out.append(j)
                self.end[c : c + len(out)] = out
                place[k] = j

    def reached(self, k: int, n: int) -> int:
        """The place after the first n characters of text k."""
        return int(self.end[self.start[k] + n - 1]) if n else int(self.begin[k])

    def sampled(self, k: int) -> bytes:
        """Letters at the sampled places that text k fills."""
        end = self.end[self.start[k] : self.start[k + 1]]
        if not len(end):
            return b""
        a, b = np.searchsorted(AT, (self.begin[k], end[-1]))
        return characters()[1][self.points[k][np.searchsorted(end, AT[a:b], side="right")]].tobytes()


def walked(texts: list[str]) -> list[list[bytes]]:
    """For each text the sampled letters of each walk."""
    walks = [Texts(texts, np.zeros(len(texts)), w) for w in range(WALKS)]
    return [[x.sampled(k) for x in walks] for k in range(len(texts))]


def named(walks: list[bytes]) -> str:
    return ".".join(x.decode() for x in walks)


def likeness(one: list[bytes], other: list[bytes]) -> float:
    """Share of the tape, up to the end of the longer text, on which both wrote the same; the best of the walks. Two empty
    texts are alike (1), an empty one and another aren't (0)."""
    best = 0.0
    for a, b in zip(one, other, strict=True):
        n, m = max(len(a), len(b)), min(len(a), len(b))
        if not n:
            return 1.0
        same = np.frombuffer(a, dtype=np.uint8, count=m) == np.frombuffer(b, dtype=np.uint8, count=m)
        best = max(best, float(WEIGHT[:m][same].sum() / WEIGHT[:n].sum()))
    return best


def bands(walks: list[bytes]) -> list[int]:
    """Keys of the bands of a fingerprint: for each walk those of the largest octave that the text fills and of the one
    below it, so that texts of about one length have some scale in common. A band's places stand for the tape evenly."""
    keys = []
    for w, x in enumerate(walks):
        if not x:
            continue
        top = int(np.log2(AT[len(x) - 1] + 1))
        for scale in {top, max(top - 1, 0)}:
            upto = min(int(np.searchsorted(AT, 1 << scale)), len(x))
            share = np.cumsum(WEIGHT[:upto])
            pick = np.searchsorted(share, BAND[w] * share[-1], side="right").clip(max=upto - 1)
            letters = np.frombuffer(x, dtype=np.uint8)[pick]
            for b in range(BANDS):
                d = hashlib.blake2b(letters[b].tobytes(), digest_size=8, salt=b"%d.%d.%d" % (w, scale, b))
                keys.append(int.from_bytes(d.digest(), "little", signed=True))
    return keys


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars (code points), fingerprint of each row. A null text is an empty one, whose
    fingerprint has no letters; a null doc_id stays null; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for batch in batches:
            for part in slices(batch, chars=TOGETHER):
                texts = part["text"].tolist()
                out = {"doc_id": part["doc_id"], "n_chars": [len(x) for x in texts]}
                yield pd.DataFrame(out | {"fingerprint": [named(x) for x in walked(texts)]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id string, n_chars long, fingerprint string").withColumn("doc_id", F.col("doc_id").cast("long"))


# Rows in their order: from the largest doc_id to the smallest, those without one last, and by a hash of the text.
ORDER = ["nameless", "k", "h"]


def _packed(rows: pd.DataFrame) -> np.ndarray:
    """The order of rows as that of byte strings."""
    out = np.empty(len(rows), dtype=[("a", ">u8"), ("b", ">u8"), ("c", ">u8")])
    sign = np.uint64(1 << 63)
    out["a"] = rows["nameless"].to_numpy(np.uint64)
    out["b"] = ~(rows["k"].to_numpy(np.int64).astype(np.uint64) ^ sign)
    out["c"] = rows["h"].to_numpy(np.int64).astype(np.uint64) ^ sign
    return out.view("S24")


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in ranges of its order, one to a partition and sorted: id, text, and after the rows of a range,
    marked `extra`, the row that follows in the next range (after the last row comes the first one).

    The order is from the largest doc_id to the smallest, then by a hash of the text; rows without a doc_id come last.
    The driver gets the first key of each range, and only the texts are shuffled, once.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumns({"nameless": F.col("id").isNull().cast("int"), "k": F.coalesce("id", F.lit(0)), "h": F.xxhash64("text")})
    by = [F.asc("nameless"), F.desc("k"), F.asc("h")]
    ranges = rows.select(*ORDER).repartitionByRange(2 * partitions(spark), *by).withColumn("at", F.spark_partition_id())
    first = F.min(F.struct("nameless", F.bitwise_not("k").alias("down"), "h")).alias("x")
    found = ranges.groupBy("at").agg(first).collect()
    firsts = pd.DataFrame(
        [(r["x"]["nameless"], ~r["x"]["down"], r["x"]["h"]) for r in found] or np.zeros((0, 3), dtype=np.int64), columns=ORDER
    )
    heads = np.sort(_packed(firsts))
    n = max(1, len(heads))

    @F.pandas_udf("array<struct<at: int, extra: boolean>>")
    def dealt(nameless: pd.Series, k: pd.Series, h: pd.Series) -> pd.Series:
        keys = _packed(pd.DataFrame({"nameless": nameless, "k": k, "h": h}))
        at = np.searchsorted(heads, keys, side="right") - 1
        lead = keys == heads[at]
        own = [{"at": a, "extra": False} for a in at.tolist()]
        return pd.Series([[x, {"at": (x["at"] - 1) % n, "extra": True}] if y else [x] for x, y in zip(own, lead.tolist(), strict=True)])

    dealt = rows.withColumn("to", F.explode(dealt(*ORDER))).select("*", "to.at", "to.extra").drop("to")
    return dealt.repartitionById(n, "at").sortWithinPartitions("extra", *by).select(F.col("id").cast("string").alias("id"), "text", "extra")


EDITED = (
    "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, bands_edited int, bands_next int"
)


def _edited(rows: list[tuple[str, str]], after: str) -> pd.DataFrame:
    """Consecutive rows (id, text), and the text that follows the last of them."""
    texts = [t for _, t in rows]
    following = [*texts[1:], after]
    cut = [len(t) - len(t) // 3 for t in texts]
    tails = [b[: len(t) // 3] for t, b in zip(texts, following, strict=True)]
    own, edited = ([[] for _ in range(len(x))] for x in ([*texts, after], texts))
    for w in range(WALKS):
        x = Texts([*texts, after], np.zeros(len(texts) + 1), w)
        reached = [x.reached(k, c) for k, c in enumerate(cut)]
        y = Texts(tails, np.array(reached), w)
        for k in range(len(texts) + 1):
            own[k].append(x.sampled(k))
        for k, r in enumerate(reached):
            edited[k].append(own[k][w][: np.searchsorted(AT, r)] + y.sampled(k))
        del x, y
    keys = [set(bands(x)) for x in own]
    return pd.DataFrame(
        {
            "doc_id": [i for i, _ in rows],
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [
                hashlib.sha256((t[:c] + e).encode("utf-8", "surrogatepass")).hexdigest() for t, c, e in zip(texts, cut, tails, strict=True)
            ],
            "fingerprint": [named(x) for x in own[:-1]],
            "edited_fingerprint": [named(x) for x in edited],
            "near_edited": [likeness(a, b) for a, b in zip(own[:-1], edited, strict=True)],
            "near_next": [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
            "bands_edited": [len(a & set(bands(b))) for a, b in zip(keys[:-1], edited, strict=True)],
            "bands_next": [len(a & b) for a, b in zip(keys[:-1], keys[1:], strict=True)],
        }
    )


def _edited_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    common.lean()
    held: list[tuple[str, str]] = []
    chars, last = 0, None
    for batch in batches:
        for id_, text, extra in zip(batch["id"], batch["text"], batch["extra"], strict=True):
            if extra:
                last = text if last is None else last
                continue
            if held and (chars + len(text) > TOGETHER or len(held) >= ROWS):
                yield _edited(held, text)
                held, chars = [], 0
            held.append((id_, text))
            chars += len(text)
    if held:
        yield _edited(held, last)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> for each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and the number of bands that the fingerprint shares with that of the edited text and of the next row.

    The edited text is the text with its last third (code points, rounded down) replaced by as many first ones of the next
    row's text, or all of it, in the order of with_next. Its walk goes on from where the text's own walk was at the cut.
    A null text is an empty one; a single row is its own next; other columns are ignored; an empty table gives an empty
    result. Rows that repeat both doc_id and text follow one another in one range.
    """
    rows = with_next(docs).mapInPandas(_edited_ranges, EDITED)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


#: Likeness from which texts are linked.
NEAR = 0.8


def near_texts(docs: DataFrame, least: float = NEAR) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, class_id (the smallest doc_id reachable by links, itself included) of each row with
    a doc_id. Texts are linked if their fingerprints have a likeness of `least` or more and share a band: of texts with a
    likeness p, about 1 - (1 - p ** PLACES) ** (BANDS * WALKS) do.

    Equal fingerprints are one class from the start, so copies don't meet. The members of a band are compared with its
    smallest one; those that aren't near it go on among themselves, until none is left: no band is paired whole.
    Empty texts are linked with nothing.
    """
    rows = written(fingerprints(docs.where("doc_id IS NOT NULL")), "op12-fingerprints")
    classes = written(rows.where("n_chars > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "op12-classes")

    @F.pandas_udf("array<bigint>")
    def keys(prints: pd.Series) -> pd.Series:
        return pd.Series([bands([x.encode() for x in p.split(".")]) for p in prints])

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b, strict=True)
        return pd.Series([likeness([x.encode() for x in p.split(".")], [x.encode() for x in q.split(".")]) for p, q in pairs])

    one, other = classes.select("id", F.col("fingerprint").alias("f")), classes.select(F.col("id").alias("low"), F.col("fingerprint").alias("g"))
    open_ = written(classes.select(F.explode(keys("fingerprint")).alias("key"), "id"), "op12-open")
    edges = []
    while True:
        low = open_.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
        met = written(open_.join(low, "key").where("id > low"), "op12-met")
        if met.isEmpty():
            break
        judged = met.select("id", "low").distinct().join(one, "id").join(other, "low")
        judged = written(judged.select("id", "low", (alike("f", "g") >= least).alias("near")), "op12-judged")
        edges.append(judged.where("near").select(F.col("id").alias("a"), F.col("low").alias("b")))
        last, open_ = open_, written(met.join(judged.where("not near").drop("near"), ["id", "low"]).select("key", "id"), "op12-open")
        discard(last, met)
    if edges:
        links = edges[0]
        for e in edges[1:]:
            links = links.unionByName(e)
        roots = components(links, "op12-components")
        classes = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("fingerprint", F.coalesce("root", "id").alias("id"))
    found = rows.select("doc_id", "n_chars", "fingerprint").where("n_chars > 0").join(classes, "fingerprint").select("doc_id", F.col("id").alias("class_id"))
    return found.unionByName(rows.where("n_chars = 0").select("doc_id", F.col("doc_id").alias("class_id")))


def op12_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return edited_fingerprints(table(spark, sf_dir, "documents"))
