"""Stored tables that are changed bucket by bucket, against the operators on whole tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from evidex.operators import merge, stores

DOC = "doc_id long, doc_type string, doc_number string, supplier_name string, status string, error_message string, updated_at long"
CHUNK = "doc_id long, section string, chunk_text string, doc_type string, doc_number string, supplier_name string, search_text string, chunk_index int"


def alike(a, b):
    return sorted(map(tuple, a.select(*sorted(a.columns)).collect()), key=repr) == sorted(map(tuple, b.select(*sorted(a.columns)).collect()), key=repr)


def files(root):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/rows/*/*/*.parquet")}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, "invoice", f"INV-{i}", None if i % 3 else "Acme", "processed", None, i % 5) for i in range(60)], DOC)


def test_changes_equal_those_of_whole_tables(spark, docs, tmp_path):
    root = str(tmp_path / "docs")
    table = merge.Kept(spark, root, DOC, buckets=16)
    assert table.rows().count() == 0
    assert alike(table.upsert(docs).rows(), docs)
    new = docs.where("doc_id in (4, 7)").withColumn("updated_at", F.lit(3).cast("long")).withColumn("doc_number", F.lit("N")).unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(700).cast("long")))
    whole = stores.upsert_latest(docs, new)
    before = files(root)
    assert alike(table.upsert(new).rows(), whole)
    assert before.items() <= files(root).items()  # nothing that was there is written again
    _, places = table.state()
    assert sum(v == 2 for v in places.values()) <= 3 and any(v == 1 for v in places.values())
    changes = spark.createDataFrame([(4, "failed", "bad"), (4, "failed", "worse"), (999, "failed", "x")], "doc_id long, status string, error_message string")
    whole = stores.update_documents(whole, changes)
    assert alike(table.update(changes).rows(), whole)
    gone = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(12345,)], "doc_id long")
    whole = stores.delete_documents(whole, gone)
    assert alike(table.delete(gone).rows(), whole)
    again = merge.Kept(spark, root, DOC, buckets=5)  # keeps the buckets that it was begun with
    ids = spark.createDataFrame([(5,), (700,), (2,)], "doc_id long")
    assert alike(again.rows_of(ids), whole.join(ids, "doc_id", "left_semi")) and again.buckets == 16
    assert table.delete(docs.select("doc_id")).delete(spark.createDataFrame([(700,)], "doc_id long")).rows().count() == 0


def test_a_change_that_was_cut_off_is_not_seen_and_one_that_comes_again_is_made_once(spark, docs, tmp_path):
    root = str(tmp_path / "docs")
    table = merge.Kept(spark, root, DOC, buckets=4).upsert(docs, made="batch 0")
    state = table.state()

    def fails(old):
        return old.withColumn("status", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        table.rewrite(docs, fails, "batch 1")
    assert table.state() == state and alike(table.rows(), docs)
    later = docs.withColumn("updated_at", F.lit(9).cast("long"))
    assert alike(table.upsert(later, made="batch 1").rows(), later)
    state = table.state()
    assert table.upsert(later, made="batch 1").state() == state
    with pytest.raises(ValueError, match="untouched"):
        table.rewrite(docs.limit(1), lambda old: later)


def test_chunks_are_replaced_and_take_over_changes_of_documents(spark, docs, tmp_path):
    rows = [(d, "items", f"text {d} {i}", None, None, None, None, i) for d in range(60) for i in range(2)]
    chunks = stores.enrich_chunks(spark.createDataFrame(rows, CHUNK).drop("doc_type", "doc_number", "supplier_name", "search_text"), docs).select(*[c.split()[0] for c in CHUNK.split(", ")])
    table = merge.Kept(spark, str(tmp_path / "chunks"), CHUNK, buckets=8)
    table.rewrite(chunks, lambda old: old.unionByName(chunks))
    new = chunks.where("doc_id = 3 and chunk_index = 1").drop("chunk_index").withColumn("pos", F.lit(9))
    assert alike(table.replace(new).rows(), stores.replace_chunks(chunks, new))
    changed = docs.where("doc_id in (5, 6)").withColumn("doc_number", F.lit("Z-9")).withColumn("supplier_name", F.lit("Nova"))
    held = table.rows()
    want = stores.enrich_chunks(held.drop("doc_type", "doc_number", "supplier_name", "search_text"), docs.join(changed, "doc_id", "left_anti").unionByName(changed))
    assert alike(table.backfill(changed).rows(), want)
