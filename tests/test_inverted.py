"""Inverted lists, computed and stored, against plain Python; versions against one insert after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidex.operators import index, inverted, retrieve, stores
from evidex.plans import router

CHUNK = "doc_id long, chunk_index int, page_number int, section string, chunk_text string, evidence_type string, doc_type string, doc_number string, supplier_name string, search_text string"
BITS = ["seat", "foam", "seat-foam", "nos", "12", "p-00012", "rate", "a", "7", "é/ü", "inv-2026-1", "x.5", "tt"]


def chunk_rows(seed, docs):
    rng = random.Random(seed)
    out = []
    for d in docs:
        for i in range(rng.randint(1, 3)):
            text = " ".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
            out.append((d, i, 1, rng.choice(["items", None]), text, "text_chunk", "invoice", f"INV-{d % 7}", None if d % 5 == 0 else f"Supplier {d % 3}", text if rng.random() < 0.95 else None))
    return out


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """An index after inserts, a replacement, deletions of held and unknown documents, and the rows it must hold."""
    frame = lambda rows: spark.createDataFrame(rows, CHUNK)
    first, again, more = chunk_rows(1, range(40)), chunk_rows(2, range(10, 20)), chunk_rows(3, range(100, 110))
    stored = inverted.Stored(spark, str(tmp_path_factory.mktemp("index")), buckets=8)
    stored.add(frame(first)).add(frame(again + more)).delete(spark.createDataFrame([(3,), (105,), (999,)], "doc_id long"))
    rows = [r for r in first if not 10 <= r[0] < 20] + again + more
    return stored, [r for r in rows if r[0] not in (3, 105)]


QUERIES = [(1, "seat foam"), (2, "p-00012 nos"), (3, "12"), (4, "Supplier 1"), (5, "INV-2"), (6, "foam rate tt"), (7, "the of"), (8, "2026"), (9, "é/ü"), (10, "seat-foam inv-2026-1")]


def alike(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_strings_are_found_as_by_a_scan(spark, kept):
    stored, rows = kept
    terms = ["seat", "oam", "12", "7", "0012", "-2026", "seat foam", "nos 12", "m", "zzz", "é", "ü a", "x.5", ".", "foam-seat"]
    want = sorted((t, r[0], r[1]) for t in terms for r in rows if t in (r[9] or "").lower())
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    for lists in (stored, inverted.Computed(spark.createDataFrame(rows, CHUNK))):
        assert sorted(map(tuple, inverted.containing(lists, asked).collect())) == want


def test_stored_and_computed_lists_answer_alike(spark, kept):
    stored, rows = kept
    chunks = spark.createDataFrame(rows, CHUNK)
    q = router.routed(spark.createDataFrame(QUERIES, "query_id long, text string"))
    allowed, bound = spark.createDataFrame([(1, 5), (1, 12), (6, 100)], "query_id long, doc_id long"), spark.createDataFrame([(1,), (6,), (8,)], "query_id long")
    six = lambda d: d.withColumn("score", F.round("score", 6))
    for extra in ({}, {"allowed": allowed, "bound": bound}):
        assert alike(six(index.bm25(stored, q.select("query_id", "text"), **extra)), six(index.bm25(chunks, q.select("query_id", "text"), **extra)))
        assert alike(retrieve.term_scored(stored, q, **extra), retrieve.term_scored(chunks, q, **extra))
        assert alike(six(index.hashed_search(stored, q, **extra)), six(index.hashed_search(chunks, q, **extra)))
    sizes = lambda x: {r["field"]: (r["n"], round(r["mean"], 9)) for r in x.sizes(inverted.FIELDS).collect()}
    assert sizes(stored) == sizes(inverted.Computed(chunks))


def test_searches_read_the_buckets_of_their_terms(spark, kept):
    stored, _ = kept
    one = stored.postings(("search_text",), spark.createDataFrame([("foam",)], "term string"))
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan)
    read = lambda n: stored._now("postings", inverted.POSTINGS).where(F.col("bucket").isin(stored._asked(spark.createDataFrame([(t,) for t in BITS[:n]], "term string"), "term"))).count()
    assert read(1) < read(4) < stored._now("postings", inverted.POSTINGS).count()
    q = router.routed(spark.createDataFrame(QUERIES, "query_id long, text string"))
    plan = retrieve.term_scored(spark.createDataFrame(chunk_rows(1, range(9)), CHUNK), q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_cut_off_change_is_not_seen_and_compaction_keeps_all(spark, kept, tmp_path):
    _, rows = kept
    stored = inverted.Stored(spark, str(tmp_path / "i"), buckets=4).add(spark.createDataFrame(rows[:30], CHUNK))
    reader = inverted.Stored(spark, stored.root, buckets=9)
    assert sorted(map(tuple, reader.rows().select("doc_id", "chunk_index").collect())) == sorted((r[0], r[1]) for r in rows[:30])
    stored._write(spark.createDataFrame(chunk_rows(9, range(500, 505)), CHUNK).withColumn("part", F.lit(0)), "rows", 2, "part")  # no state names it
    assert stored.refresh().rows().count() == 30 and reader.buckets == 4  # as the index was begun
    stored.add(spark.createDataFrame([r for r in rows if r[0] >= rows[29][0]], CHUNK)).delete(spark.createDataFrame([(rows[0][0],)], "doc_id long"))
    assert reader.rows().count() == 30 and reader.refresh().rows().count() == stored.rows().count()
    terms = spark.createDataFrame([(t,) for t in ("seat", "12", "o")], "term string")
    before, df = sorted(map(tuple, inverted.containing(stored, terms).collect())), sorted(map(tuple, stored.frequencies(("search_text",), terms).collect()))
    stored.compact()
    assert len(stored.state()[1]) == 1
    assert sorted(map(tuple, inverted.containing(stored, terms).collect())) == before and sorted(map(tuple, stored.frequencies(("search_text",), terms).collect())) == df


def brute_covers(seq, words):
    """Minimal stretches of seq that hold all words, by trying all."""
    has = lambda i, j: words <= set(seq[i : j + 1])
    spans = [(i, j) for i in range(len(seq)) for j in range(i, len(seq)) if has(i, j) and not (i < j and has(i + 1, j)) and not (i < j and has(i, j - 1))]
    return sum(0.1 / (1 + sum(x not in words for x in seq[i : j + 1])) for i, j in spans)


def test_cover_density(spark):
    rng = random.Random(4)
    cases = [[rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(150)]
    for words in ({"a"}, {"a", "b"}, {"a", "b", "c"}):
        rows = [(k, [(i + 1, x) for i, x in enumerate(s) if x in words]) for k, s in enumerate(cases) if words <= set(s)]
        df = spark.createDataFrame(rows, "k long, p array<struct<at: int, term: string>>")
        for r in df.select("k", inverted.cover_density(F.col("p"), F.lit(len(words))).alias("d")).collect():
            assert r["d"] == pytest.approx(brute_covers(cases[r["k"]], words))


def test_versions_as_if_inserted_one_after_the_other(spark):
    rng = random.Random(8)
    for size, keys in ((120, 15), (60, 60), (80, 2)):
        row = lambda i: (i, rng.choice([None, *(f"n{k}" for k in range(keys))]), rng.choice([None, *(f"f{k}" for k in range(keys))]))  # noqa: B023, E731
        stored = [(*row(-i), rng.randint(1, 5)) for i in range(1, 20)]
        incoming = [row(i) for i in range(size)]
        held, want = [(n, f, v) for _, n, f, v in stored], {}
        for i, n, f in incoming:
            want[i] = 1 + max([v for hn, hf, v in held if (n is not None and hn == n) or (f is not None and hf == f)], default=0)
            held.append((n, f, want[i]))
        got = stores.next_versions(spark.createDataFrame(stored, "doc_id long, doc_number string, source_filename string, version int"), spark.createDataFrame(incoming, "doc_id long, doc_number string, source_filename string").repartition(3))
        assert {r["doc_id"]: r["version"] for r in got.collect()} == want


def test_updates_with_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "new", None), (2, "new", "x")], "doc_id long, status string, error_message string")
    changes = spark.createDataFrame([(1, "failed", "b", 2), (1, "processed", None, 3), (1, "failed", "a", 1)], "doc_id long, status string, error_message string, at int")
    assert sorted(map(tuple, stores.update_documents(docs, changes, "at").collect())) == [(1, "processed", None), (2, "new", "x")]
    assert stores.update_documents(docs, changes).count() == 2
    old = spark.createDataFrame([(1, 5, "old")], "doc_id long, updated_at int, v string")
    new = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "z")], "doc_id long, updated_at int, v string")
    got = {stores.upsert_latest(old, new.repartition(n)).collect()[0]["v"] for n in (1, 2, 3)}
    assert len(got) == 1 and got <= {"a", "b"}
