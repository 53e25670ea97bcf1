"""The pipeline, and each registered query of this subpackage that has no SQL."""

import brute
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_eleven_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}


def test_stages_keep_columns_and_decide(spark):
    docs = documents(spark)
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS, name
        before, docs = docs.count(), spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= before
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute.near_components(rows)
    assert all(component == doc for doc, (n, component) in groups.items() if n)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.columns == [*COLUMNS, "copy"]
    copies = {r.doc_id: r.n for r in final.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(copies.values()) <= 3 and set(copies) <= {d for d, _ in rows}


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (3, "other words", "en", "s", 2),
            (None, text, "en", "s", 1)]
    df = spark.createDataFrame(rows, documents(spark).schema)
    got = sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, df, SF).collect())
    assert got == ["1", "3", "None"]


def test_near_dedup_takes_every_pair_of_80_percent(spark):
    """Texts of 104 words, 100 shingles; a changed word in the middle takes five of them."""
    rows = []
    for n in range(30):
        words = [f"t{n}w{i}" for i in range(104)]
        rows.append((2 * n, " ".join(words), "en", "s", 1))
        for k in range(n % 3 + 1):
            words[10 + 20 * k] = "other"
        if n % 3 == 1:
            words.append("more")
        if n % 3 == 2:
            words[-4:] = []
        rows.append((2 * n + 1, " ".join(words), "en", "s", 1))
    df = spark.createDataFrame(rows, documents(spark).schema)
    texts = [(r[0], r[1]) for r in rows]
    want = {d for d, (n, component) in brute.near_components(texts, 80).items() if d == component}
    assert want != {d for d, (n, component) in brute.near_components(texts).items() if d == component}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()} == want


def test_near_dedup_equals_brute_force_at_80_percent(spark):
    docs = documents(spark)
    want = {d for d, (n, c) in brute.near_components([(r.doc_id, r.text) for r in docs.collect()], 80).items() if d == c}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want


def test_empty_documents(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_whole_table_queries_without_sql(spark):
    docs = documents(spark).collect()
    rows = [(r.doc_id, r.text) for r in docs]
    queries = entry.queries()
    got = {r[0]: tuple(r)[1:] for r in queries["op8_suffix_array"](spark, SF).collect()}
    assert got == brute.repeated_bytes(rows)
    got = {r[0]: tuple(r)[1:] for r in queries["op9_suffix_tree"](spark, SF).collect()}
    assert got == brute.repeated_words(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries["op10_minhash"](spark, SF).collect()}
    assert got == brute.near_components(rows)
    judged = queries["op1_decontamination"](spark, SF).collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    holds = {(d, i) for d, t in rows for i, x in items.items() if x and x in (t or "")}
    found = {(r.doc_id, i) for r in judged for i in r.item_ids}
    assert holds <= found and len(judged) == len(rows)
    pages = queries["op6_html"](spark, SF).collect()
    assert len(pages) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(p.n_chars == len(p.text) for p in pages)
