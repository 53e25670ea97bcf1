"""Operators 1 and 2 on tables that have the names of their own results and steps."""

from pyspark.sql import functions as F

from vanewatch.llm import benchmark, lines

ITEM = "Which river flows through the old harbour town in the north of the county"


def with_extra(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


def test_decontamination_replaces_columns_of_its_names(spark):
    rows = [(1, f"before {ITEM} after"), (2, "nothing of the kind"), (None, ITEM), (3, None), (1, f"before {ITEM} after")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = with_extra(spark.createDataFrame([(7, ITEM)], "item_id long, text string"), "doc_id", "contaminated")
    extra = with_extra(docs, "contaminated", "item_ids", "_row", "_at", "item", "owner", "n")
    got = benchmark.contamination(extra, items)
    assert got.columns == ["doc_id", "text", "item", "owner", "n", "contaminated", "item_ids"]
    found = sorted(((r.doc_id or 0), r.contaminated, r.item_ids) for r in got.collect())
    assert found == [(0, True, [7]), (1, True, [7]), (1, True, [7]), (2, False, []), (3, False, [])]


def test_line_dedup_replaces_columns_of_its_names(spark):
    shared = "please accept the cookies of this site now"
    rows = [(i, f"own words of page number {i}\n{shared}", f"site{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = lines.drop_shared_lines(docs, min_words=1)
    names = ["n_lines", "n_removed", "_gone", "_gone_key", "_row_key", "_all", "_site", "_first", "_hash"]
    got = lines.drop_shared_lines(with_extra(docs, *names), min_words=1)
    pick = ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.select(pick).collect())) == sorted(map(tuple, plain.select(pick).collect()))
    assert plain.where("n_removed = 1").count() == 29
