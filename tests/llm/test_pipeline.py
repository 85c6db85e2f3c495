"""Each stage of the pipeline against brute force: which documents stay, with which texts and lengths."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from roboframe.llm.bpe import default_path
from roboframe.llm.toxicity_chain import label_toxicity

from .test_text_operators import WORD, components, contamination, lower

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted():
    """Documents with exact and near copies, shared passages, benchmark text, nulls and empty texts; benchmark items."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice(["ber", "not", "kal", "é"]) + str(rng.randrange(90)) for _ in range(n))
    texts = [prose(rng.randint(20, 120)) for _ in range(40)]
    words = texts[3].split(" ")
    texts += [texts[0], texts[0], " ".join(words[:-1]), " ".join([*words, "more"]), texts[4] + " " + prose(90)]  # copies; the last is none
    passage = prose(60)
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(3)] + [passage]
    items = [(0, prose(25)), (1, prose(9)), (2, None), (3, "")]
    texts += [prose(30) + " " + " ".join(items[0][1].split(" ")[4:15]) + " " + prose(20), items[1][1].replace("n", "N").replace("b", "B") + ", " + prose(15), " ".join(items[0][1].split(" ")[:9]) + " " + prose(15)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, "s", None), (901, "", "de", None, 0)]
    return rows, items


def kept(frame):
    return sorted(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in frame.collect())


def by_id(rows):
    return sorted(rows, key=lambda r: r[0])


def test_near_duplicates_that_stay(spark, planted):
    rows, _ = planted
    groups = {i: root for i, _, root in components([r[:2] for r in rows])}
    want = [r for r in rows if groups[r[0]] == r[0]]
    assert len(rows) - len(want) == 4
    assert kept(p.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "")) == by_id(want)


def test_repeats_that_are_cut(spark, planted):
    rows, _ = planted
    raws, n, seen = [(r[1] or "").encode() for r in rows], p.REPEATED, {}
    for raw in raws:
        for j in range(len(raw) - n + 1):
            seen[raw[j : j + n]] = seen.get(raw[j : j + n], 0) + 1
    want = []
    for r, raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for j in range(len(raw) - n + 1):
            if seen[raw[j : j + n]] > 1:
                gone[j : j + n] = b"\1" * n
        text = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone):
            want.append((r[0], r[1] or "", *r[2:]))
        elif text:
            want.append((r[0], text, *r[2:4], len(text)))
    assert 0 < len(want) < len(rows) and any(len(r[1]) < len(rows[r[0]][1]) for r in want if r[0] < 900)
    got = [(i, t or "", *rest) for i, t, *rest in kept(p.cut_repeats(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), ""))]
    assert by_id(got) == by_id(want)


def test_contaminated_documents_that_go(spark, planted, tmp_path):
    rows, items = planted
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hit = {x[0]: x[5] for x in contamination([r[:2] for r in rows], items)}
    want = [r for r in rows if not hit[r[0]]]
    assert len(rows) - len(want) == 2 and WORD.findall(lower(rows[-3][1]))[:9] == WORD.findall(lower(items[0][1]))[:9]
    assert kept(p.drop_contaminated(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), str(tmp_path))) == by_id(want)


def test_token_ids_of_all(spark, planted):
    rows, _ = planted
    t = Tokenizer.from_file(default_path())
    got = {r.doc_id: (r.lang, r.source, list(r.ids)) for r in p.encode(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "").collect()}
    assert got == {r[0]: (r[2], r[3], t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}


def test_toxic_documents_that_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = p.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label")))
    toxic = {r.doc_id for r in label_toxicity(docs, model).collect() if r.is_toxic}
    columns = ["doc_id", "text", "n_chars"]
    want = {tuple(r) for r in docs.select(*columns).collect() if r.doc_id not in toxic}
    assert toxic and {tuple(r) for r in p.drop_toxic(spark, docs, sf).select(*columns).collect()} == want


#: Columns that bear names which operators use themselves, with values that pandas would change.
CLASHING = "_hit key slot cuts kept n_bytes n_removed kept_text is_toxic p_toxic label fold all row kind h1 h2 chunk parts component_id core suffix".split()


@pytest.mark.parametrize("stage", [s for _, s in p.STAGES[:-1]])
def test_other_columns_pass_unchanged(spark, planted, tmp_path, stage):
    rows, items = planted
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    odd = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") + 2**60)
    more = {c: odd if k % 3 == 0 else F.array(odd) if k % 3 == 1 else F.struct(odd.alias("x")) for k, c in enumerate(CLASHING)}
    out = stage(spark, docs.withColumns(more), str(tmp_path))
    plain = stage(spark, docs, str(tmp_path))
    assert out.dtypes == docs.withColumns(more).dtypes and plain.dtypes == docs.dtypes
    assert kept(out) == kept(plain) and out.count() > 30
    assert out.where(" AND ".join(f"`{c}` <=> {'(' if k % 3 == 0 else 'array(' if k % 3 == 1 else "named_struct('x', "}CASE WHEN doc_id % 3 > 0 THEN doc_id + {2**60} END)" for k, c in enumerate(CLASHING))).count() == out.count()


def test_carried_columns(spark):
    """Names that an operator uses inside are carried, those of its result are refused."""
    from roboframe.llm.suffix_array_dedup import remove_repeats

    docs = spark.createDataFrame([(i, "word " * 200, i + 2**60, None) for i in range(3)], "doc_id long, text string, kind long, row long")
    for f in (lambda c: p.encode_documents(docs, default_path(), c), lambda c: remove_repeats(docs, carry=c), lambda c: label_toxicity(docs, None, c)):
        assert [r["kind"] for r in f(("kind", "row")).orderBy("doc_id").collect()] == [2**60, 2**60 + 1, 2**60 + 2]
    for f, name in ((lambda c: p.encode_documents(docs, default_path(), c), "n_tokens"), (lambda c: remove_repeats(docs, carry=c), "kept"), (lambda c: label_toxicity(docs, None, c), "p_toxic")):
        with pytest.raises(ValueError, match=name):
            f((name,))


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_empty_documents(spark, name, stage):
    sf = "/root/testdata/sf0.001"
    none = spark.createDataFrame([], COLUMNS)
    assert stage(spark, none, sf).count() == 0
