"""The pipeline's stages, each against brute force on its own input."""

import re

from test_operators import brute_components, brute_repeats

import corpus_pipeline as pipeline
from tidewatch.llm.common import materialise, table

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = materialise(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        seen[name] = (before, docs.collect())
    before, after = seen["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
    before, after = seen["exact_dedup"]
    first = {}
    for r in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in after} == set(first.values())
    before, after = seen["near_dedup"]
    found = brute_components([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {i for i, (_, c) in found.items() if i == c}
    before, after = seen["repeated_passages"]
    want = brute_repeats([(r.doc_id, r.text.encode()) for r in before])
    assert len(after) == len(before)
    assert sum(len(r.text.encode()) for r in after) == sum(n - gone for n, gone, _, _ in want.values())
    pieces = pipeline.packed(spark, docs, SMALL).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_rows_without_or_with_a_shared_doc_id(spark):
    import test_operators

    other = "a quiet river runs past the old mill where children fly paper kites until the evening bell calls them home again"
    third = "our new engine burns less fuel than any before it and still pulls nine loaded wagons up the long northern slope"
    fourth = "painters mixed ochre with linseed oil then left each board against a southern wall so that it dried before winter"
    own = "she packed two coats three maps and one lamp because nobody could say how long this crossing might take in spring"
    text = test_operators.BASE
    odd = [
        (9001, text), (9005, text), (9005, other), (None, third), (None, third), (None, fourth), (9007, own), (9007, own),
        (9008, "1234 5678"), (9008, other.replace("quiet", "wide")), (9009, " ".join(["zeta", *third.split()[:14], "omega"])),
    ]
    docs = table(spark, SMALL, "documents")
    made = spark.createDataFrame([(i, t, None, "odd", len(t)) for i, t in odd], docs.schema)
    docs = materialise(docs.unionByName(made), "odd").repartition(3)
    for start in (docs, pipeline.keyed(docs)):  # a stage makes its key, or is given one
        seen, at = {}, start
        for name, stage in pipeline.STAGES[:-1]:
            at = materialise(stage(spark, at, SMALL), name)
            assert at.columns == start.columns
            seen[name] = sorted(((r.doc_id, r.text) for r in at.where("source = 'odd'").collect()), key=repr)
        want = [x for x in odd if x[0] != 9008 or x[1] != "1234 5678"]
        assert seen["language_id"] == sorted(want, key=repr)
        want = [x for x in dict.fromkeys(want) if x != (9005, text)]
        assert seen["exact_dedup"] == sorted(want, key=repr)
        want = [x for x in want if x[0] != 9008]  # near 9005's other
        assert seen["near_dedup"] == sorted(want, key=repr)
        shared = " " + " ".join(third.split()[:14]) + " "
        left = {i: t for i, t in seen["repeated_passages"] if i}
        assert left[9009] == odd[-1][1] and (9005, other) in seen["repeated_passages"]
        assert [t for i, t in seen["repeated_passages"] if i is None and t != fourth] == [third.removeprefix(shared[1:-1] + " ") if third.startswith(shared[1:]) else third]
    pieces = pipeline.packed(spark, at, SMALL).where("doc_id is null or doc_id > 9000").collect()
    assert sorted(str(r.doc_id) for r in pieces) == ["9001", "9005", "9007", "9009", "None", "None"]


def test_clashing_columns_nulls_and_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = table(spark, SMALL, "documents").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", None, "x", 0), (9002, None, "en", None, None), (9003, "word " * 40_000, None, "x", None)], docs.schema)
    clash = {c: F.lit("k") for c in ("lang_pred", "kept_text", "keep_id", "component_id", "rep", "batch", "key", "digest", "score", "found", "left")}
    docs = docs.unionByName(odd).withColumns(clash)
    for start in (docs, docs.limit(0)):
        at, full = materialise(start, "odd"), start is docs
        for name, stage in pipeline.STAGES[:-1]:
            at = materialise(stage(spark, at, SMALL), name)
            assert at.columns == docs.columns and bool(at.count()) == full
        assert full == any(r.doc_id == 9003 for r in at.collect())
        assert bool(pipeline.packed(spark, at, SMALL).count()) == full
    for name, stage in pipeline.STAGES[1:]:  # each on odd rows themselves
        assert stage(spark, odd.withColumns(clash), SMALL).count() >= 1, name


def test_columns_named_like_the_key_do_no_harm(spark):
    from pyspark.sql import functions as F

    docs = materialise(table(spark, SMALL, "documents").where("doc_id < 60"), "docs")
    named = docs.withColumns({"row_key": F.lit(1), "row_key_": F.col("doc_id") % 3, "row_key__": F.lit(None).cast("string")})
    shared = named.unionByName(named.where("doc_id < 10").withColumn("text", F.concat(F.lit("another tale "), "doc_id")))
    for start in (named, shared):
        sizes = {}
        for key in (False, True):
            at = pipeline.keyed(materialise(start, "odd")) if key else materialise(start, "odd")
            for name, stage in pipeline.STAGES[:-1]:
                before, at = at, materialise(stage(spark, at, SMALL), name)
                assert at.columns == before.columns and at.count() <= before.count(), name
            sizes[key] = sorted(map(repr, at.select("doc_id", "text", "row_key", "row_key_").collect()))
        assert sizes[False] == sizes[True]


def test_no_folder_is_left_behind(spark):
    import os

    from tidewatch.functions import tables

    base = f"{tables.shared_folder(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    held = lambda: set(os.listdir(base)) if os.path.isdir(base) else set()
    before, stored = held(), set(spark.catalog.listTables())
    assert pipeline.run(spark, SMALL).count() >= 100
    left = held() - before
    assert len(left) == 1 and "packing" in left.pop()
    assert set(spark.catalog.listTables()) == stored
