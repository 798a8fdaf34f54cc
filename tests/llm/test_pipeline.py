"""Each stage of the pipeline against a brute-force version on its own input, then the whole run."""

import corpus_pipeline as P
import test_decontaminate
import test_mixing
import test_near_dedup
import test_token_files
from helpers import edge_docs, empty_docs, split_words
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridspark.llm import catalog, language
from gridspark.llm.common import written

order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))
pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]


def expect_language(rows, items):
    return [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]


def expect_near(rows, items):
    """Components of all rows; of each the row of the smallest id, then of the smallest hash, stays."""
    rows = list({(d, t or "") for d, t in rows})
    return {d for d, _, _, kept in test_near_dedup.brute(rows, P.NEAR_PER_CENT) if kept}


def expect_clean(rows, items):
    return [r for r, b in zip(rows, test_decontaminate.brute(rows, items)) if not b[-1]]


def expect_mix(rows):
    domain = lambda s: "web" if s and len(s) == 4 and s[:3] == "src" and s[3].isdigit() else "curated"
    flat = [(r.doc_id, (domain(r.source), r.lang or "none", r.source or "none"), len(split_words(r.text))) for r in rows]
    weights = [catalog.MIX_WEIGHTS["domain"], catalog.MIX_WEIGHTS["lang"], {}]
    return [x[0] for x in test_mixing.brute(flat, weights, 0.8, 4, 17)]


def chain(spark, docs, sf, items):
    columns = docs.columns
    steps = dict(P.STAGES)
    one = written(steps["language_id"](spark, docs, sf), "t")
    assert one.columns == columns and order(pairs(one)) == order(expect_language(pairs(docs), items))
    two = written(steps["near_dedup"](spark, one, sf), "t")
    assert two.columns == columns and {d for d, _ in pairs(two)} == expect_near(pairs(one), items)
    assert len(set(pairs(two))) == two.count() and set(pairs(two)) <= set(pairs(one))
    three = written(steps["decontamination"](spark, two, sf), "t")
    assert three.columns == columns and order(pairs(three)) == order(expect_clean(pairs(two), items))
    four = written(steps["mixing"](spark, three, sf), "t")
    assert four.columns == columns and order([(d,) for d, _ in pairs(four)]) == order([(d,) for d in expect_mix(three.collect())])
    assert set(four.collect()) <= set(three.collect())
    five = steps["token_files"](spark, four, sf)
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in five.collect()}
    assert got == {(d, n, c) for d, _, n, c in test_token_files.expected(pairs(four), catalog.tokenizer_path())}
    assert five.count() == four.count()
    return five


def test_stages(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    last = chain(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, items)
    assert order(map(tuple, P.run(spark, sf).collect())) == order(map(tuple, last.collect()))
    assert [len(P.STAGES), P.ORACLE_SQL] == [5, None]


def test_hard_rows(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = edge_docs(spark)
    chain(spark, docs, sf, items)
    one = docs.where("doc_id IN (6, 8)")
    assert P.remove_near_duplicates(spark, one, sf).count() == 1
    for _, stage in P.STAGES:
        assert stage(spark, empty_docs(spark), sf).count() == 0
    none = docs.withColumn("text", F.lit(None).cast("string"))
    assert P.identify_language(spark, none, sf).count() == 0
    for _, stage in P.STAGES[1:]:
        stage(spark, none, sf).collect()


def test_near_stage_links_at_80(spark, sf):
    """Copies of 100 words with a run of 0 to 11 of them replaced, so that some are of a similarity from 0.80 to 0.85."""
    docs = []
    for family in range(40):
        words = [f"f{family}w{i}" for i in range(100)]
        for k in (0, family % 12):
            docs.append((2 * family + (k > 0), " ".join([*words[:40], *[f"x{family}y{i}" for i in range(k)], *words[40 + k:]])))
    df = spark.createDataFrame([(d, t, "en", "a") for d, t in docs], "doc_id bigint, text string, lang string, source string")
    kept = sorted(r.doc_id for r in P.remove_near_duplicates(spark, df, sf).collect())
    want = {per_cent: sorted({d for d, _, _, own in test_near_dedup.brute(list(set(docs)), per_cent) if own}) for per_cent in (80, 85)}
    assert kept == want[80] and want[80] != want[85]


def test_language_stage_names_the_unlabelled(spark, sf):
    """Null languages become the predicted ones; given ones stay; without any label texts with letters stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    said = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    got = P.identify_language(spark, docs, sf)
    assert got.columns == docs.columns
    assert {r.doc_id: r for r in got.collect()} == {
        d: Row(**{**r.asDict(), "lang": r.lang or said[d]}) for d, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert any(r.lang is None for r in rows.values())
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = P.identify_language(spark, bare, sf).collect()
    assert order([(r.doc_id, r.text) for r in kept]) == order(expect_language(pairs(bare), None)) and {r.lang for r in kept} == {None}


def test_short_items_count(spark, tmp_path):
    """Items of one to four words remove documents, as the operator decides; a null item and one without words remove none."""
    items = [(1, "zebra"), (2, "one two"), (3, None), (4, "?!"), (5, "a b c d")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["a Zebra runs", "one, two", "two one", "a b c", "x a b c d y", None, "", "a b c d"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    kept = sorted(r.doc_id for r in P.remove_benchmark_passages(spark, docs, str(tmp_path)).collect())
    assert kept == [2, 3, 5, 6]
