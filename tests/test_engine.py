"""The engine's rules on fixtures, and every query against its SQL on the smallest tables."""

import datetime
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evidex import queries as Q
from evidex.functions import parse as P
from evidex.functions import text as X
from evidex.operators import answer, evaluate, fields, index, items, retrieve, stores
from evidex.plans import ingest, router, search
from evidex.sources import corpus
from evidex.streaming import inbox

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f("v").alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [("10-Apr-2026", datetime.date(2026, 4, 10)), ("3/4/2026", datetime.date(2026, 4, 3)), ("7 March, 2026", datetime.date(2026, 3, 7)), ("2026-01-31", datetime.date(2026, 1, 31)), ("31.12.2025", datetime.date(2025, 12, 31)), ("soon", None), ("", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, text, P.parse_date) == want


@pytest.mark.parametrize("text,want", [("Rs. 45,678.90", 45678.9), ("₹ 12", 12.0), ("I98765.40", 98765.4), ("12 of 30", 30.0), ("none", None), (None, None)])
def test_amounts(spark, text, want):
    assert one(spark, text, P.parse_amount) == want


def test_text_functions(spark):
    assert one(spark, " a   b\r\n\n\tc\x0bd ", X.clean_text) == "a b\nc\nd"
    assert one(spark, None, X.clean_text) == ""
    once = one(spark, "  x\t\ty \n z", X.clean_text)
    assert one(spark, once, X.clean_text) == once
    assert one(spark, "Rate 85 000.00, per-item A/12", X.search_text) == "rate 85000.00 per-item a/12 per item peritem a 12 a12 12"
    assert one(spark, "find me the rate of A/12 on it", X.search_terms) == ["rate", "a/12", "a 12", "a12", "12"]
    assert one(spark, "x" * 300, X.snippet) == "x" * 257 + "..."
    assert one(spark, "Part Number Description Qty Unit Rate Amount", lambda c: X.is_table_header(F.col(c))) and not one(spark, "Buyer", lambda c: X.is_table_header(F.col(c)))
    assert one(spark, "a | b || c", lambda c: X.cells(F.col(c))) == ["a", "b", "c"] and one(spark, "a\tb  c", lambda c: X.cells(F.col(c))) == ["a", "b  c"] and one(spark, "a  b c   d", lambda c: X.cells(F.col(c))) == ["a", "b c", "d"]
    slot = spark.createDataFrame([("abc",)], "v string").select(X.hash_slots("v", 384)[0]["slot"].alias("s")).first()["s"]
    assert slot == 54


def test_routes(spark):
    got = {r.query_id: r.route for r in router.routed(spark.createDataFrame(list(enumerate(Q.ROUTE_CASES)), "query_id long, text string")).collect()}
    assert [got[i] for i in range(len(Q.ROUTES))] == Q.ROUTES
    f = router.with_filters(spark.createDataFrame([(1, "which item has the rate of 85000.00?"), (2, "vehicle number for e-way bill FM-GST-2026-2001"), (3, "departed from operations"), (4, None)], "query_id long, text string"))
    f = {r.query_id: r for r in f.collect()}
    assert f[1].f_amount is None and f[2].f_doc_number == "FM-GST-2026-2001" and f[4].f_doc_type is None
    assert router.with_filters(spark.createDataFrame([(3, "reinvendor acme")], "query_id long, text string"), strict_supplier=True).first().f_supplier_name is None


BOM = "BILL OF MATERIAL\nItem  Part Number  Description  Qty  Unit\n1  KR-1001  Steel bracket  1  Nos\nzinc plated\n2  KR-1002  Bolt set  4.5  Nos\nItem  Part Number  Description  Qty  Unit\nGrand Total Cost  120\n3  KR-1003  Late  1  Nos"


def test_items(spark):
    d = spark.createDataFrame([(1, BOM), (2, "no table here\nat all"), (3, None), (4, "Item | Part No | Component | Req Qty | UOM | Rev | Remarks\n10 | A-1 | Seat | 2 | Nos | B | left\n\n20 | A-2 | Foam | 1 | Kg | C | right")], "doc_id long, text string")
    got = {(r.doc_id, r.row_no): r for r in items.line_items(d).collect()}
    assert set(got) == {(1, 1), (1, 2), (4, 1), (4, 2)}
    assert got[1, 1].part_number == "KR-1001" and got[1, 1].description == "Steel bracket zinc plated" and got[1, 1].quantity == 1 and got[1, 2].quantity == 4.5
    assert got[4, 2].revision == "C" and got[4, 2].remarks == "right" and got[4, 1].item_no == "10"


INVOICE = "TAX INVOICE\nBill No: ZX-4451\nVendor Name: Orion Parts\nCustomer Name: Delta Works\nIssue Date: 10-Apr-2026\nAmount Payable: 45,678.90\nPurchase Order No: PO-77881\nPayment Terms: 45 Days\nDispatch Mode: Road"
SPLIT = "TAX INVOICE\nInvoice Number\nINV-SPLIT-9001\nSupplier:\nBlue Mill\nBill To:\nRed Mill\nGrand Total:\nINR 98,765.40"


def test_metadata(spark):
    d = spark.createDataFrame([(1, 1, INVOICE), (2, 1, SPLIT), (3, 1, "notes only"), (4, 1, "TAX INVOICE\nTotal Invoice Value\nTotal 512.50 dated 3/4/2026 27ABCDE1234F1Z5")], "doc_id long, page_number int, text string")
    m = {r.doc_id: r for r in fields.metadata(d).collect()}
    assert (m[1].doc_number, m[1].supplier_name, m[1].buyer_name, m[1].amount, m[1].po_number, m[1].payment_terms) == ("ZX-4451", "Orion Parts", "Delta Works", 45678.9, "PO-77881", "45 Days")
    assert m[1].extra_fields["dispatch mode"] == "Road" and m[1].confidence["amount"] == "high" and m[1].doc_date == datetime.date(2026, 4, 10)
    assert (m[2].doc_number, m[2].supplier_name, m[2].buyer_name, m[2].amount, m[2].currency) == ("INV-SPLIT-9001", "Blue Mill", "Red Mill", 98765.4, "INR") and m[2].confidence["supplier_name"] == "medium"
    assert m[3].doc_type == "unknown" and m[3].field_count == 0
    assert m[4].gstin == "27ABCDE1234F1Z5" and m[4].doc_date == datetime.date(2026, 4, 3)


def pages(spark):
    rows = [(1, 1, INVOICE, "zx.pdf", "s/zx"), (2, 1, BOM.replace("BILL OF MATERIAL", "BILL OF MATERIAL\nBOM No: BOM-77\nSupplier: Kite Metals"), "bom-77.pdf", "s/b"), (3, 1, SPLIT, "split.pdf", "s/sp"), (4, 1, None, "none.pdf", "s/n")]
    return spark.createDataFrame(rows, "doc_id long, page_number int, text string, source_filename string, storage_path string")


def test_search(spark, tmp_path):
    c = ingest.ingest(pages(spark)).write(str(tmp_path / "c"))
    q = spark.createDataFrame([(1, "INV-SPLIT-9001"), (2, "material code for Steel bracket"), (3, "orion payment dispatch road delta"), (4, "zzzz"), (5, "invoice from Blue Mill"), (6, "")], "query_id long, text string")
    plan, hits = search.search(c, q, 5)
    hits = hits.cache()
    top = {r.query_id: r for r in hits.where("rank = 1").collect()}
    assert top[1].doc_id == 3 and "exact" in top[1].sources and top[1].confidence.label == "high" and top[2].doc_id == 2 and top[3].doc_id == 1 and 4 not in top and top[5].doc_id == 3
    a = {r.query_id: r for r in answer.answers(hits, plan).collect()}
    assert a[1].backend == "deterministic" and a[1].answer.startswith("Found INV-SPLIT-9001. File: split.pdf.") and a[2].answer == "The material code is KR-1001 in BOM-77, page 1."
    assert a[3].backend == "extractive"
    r = {x.query_id: x for x in answer.responses(hits, plan).collect()}
    assert r[4].backend == "none" and r[4].result_count == 0 and len(r[1].evidence) <= 3 and r[1].result_count == len(r[1].hits)
    v = {x.query_id: x for x in answer.find_view(answer.responses(hits, plan)).collect()}
    assert v[1].best_match.source_filename == "split.pdf"


def test_stores(spark):
    known = stores.register_suppliers(spark.createDataFrame([], "supplier_id string, name string, normalized_name string"), spark.createDataFrame([("Acme Ltd.",), ("ACME ltd",), ("",), (None,)], "name string"))
    assert known.count() == 1 and stores.register_suppliers(known, spark.createDataFrame([("acme LTD",), ("Bolt",)], "name string")).count() == 2
    m = stores.Memo(ttl=10)
    m.set(" Query ", 5, "a", now=0.0)
    assert m.get("query", 5, now=9.0) == "a" and m.get("query", 5, now=11.0) is None and m.get("query", 6, now=1.0) is None


def test_evaluate_bounds(spark):
    cases = spark.createDataFrame([(1, "a", "f.pdf", 1, None, ["Seat"]), (2, "a", "g.pdf", None, None, [])], "query_id long, query_type string, expected_source_filename string, expected_page int, expected_doc_number string, expected_snippets array<string>")
    hits = spark.createDataFrame([(1, 1, "x.pdf", 1, "n", "no"), (1, 2, "f.pdf", 1, "n", "a seat cover")], "query_id long, rank int, source_filename string, page_number int, doc_number string, snippet string")
    r = {x.query_type: x for x in evaluate.retrieval_metrics(cases, hits).collect()}
    assert r["a"].recall_at_1 == 0 and r["a"].recall_at_3 == 0.5 and r["a"].mrr == 0.25 and r["a"].snippet_at_1 == 0.5 and r[None].queries == 2


def test_files_and_inbox(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.PDF.pdf").write_bytes(b"page one\fpage two")
    (box / "b.pdf").write_bytes(b"page one\fpage two")
    (box / "c.txt").write_bytes(b"other")
    f = corpus.scan_files(spark, str(box))
    assert f.count() == 2 and f.select("checksum").distinct().count() == 1
    p = corpus.extract_pages(f)
    assert p.count() == 4 and ingest.status_of(corpus.extract_pages(f, lambda b: 1 / 0)).where("status = 'failed'").count() == 2
    stored = corpus.store_files(f, str(tmp_path / "st")).collect()
    corpus.store_files(f, str(tmp_path / "st"))
    assert stored[0].storage_path.endswith(".pdf") and spark.read.parquet(str(tmp_path / "st/blobs")).count() == 1
    for _ in range(2):
        inbox.run_inbox(spark, str(box), str(tmp_path / "t"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    (box / "d.pdf").write_bytes(b"new")
    inbox.run_inbox(spark, str(box), str(tmp_path / "t"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "cases.json").write_text(json.dumps([{"name": "x", "query": "q", "expected_page": 1, "expected_snippet_contains": ["a"]}]))
    assert corpus.read_cases(spark, str(tmp_path / "cases.json")).first().expected_snippet_contains == ["a"]
    stores.log_queries(str(tmp_path / "log"), spark.createDataFrame([("q", "lexical", 1.0, 2)], "query_text string, route string, latency_ms double, result_count int"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_vector_limit(spark):
    e = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert index.vector_top_k(e, q, 2).count() == 10
    with pytest.raises(ValueError):
        index.vector_top_k(e, q, 2, most_queries=3)


def plain(rows, columns):
    def show(x):
        if x is None or (isinstance(x, float) and x != x):
            return "~"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) or x.__class__.__name__ == "Decimal" else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in Q.SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(Q.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(want.fetchall(), cols)


def test_vector_blocks(spark):
    e = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>")
    q = e.selectExpr("vec_id AS query_id", "embedding AS q")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    got = key(index.vector_top_k(e, q, 4, block=25))
    assert len(got) == 240 and got == key(index.vector_top_k(e, q, 4))
    assert got == key(index.vector_top_k(e, q, 4, block=7, cell_bytes=3000))  # many cells
    many = spark.range(1100).selectExpr("id AS query_id", "array(1.0F, CAST(id AS FLOAT), 2.0F) AS q")
    assert index.vector_top_k(e, many, 2).count() == 2200


def test_vector_odd_rows(spark):
    """Ties go to the smaller id; null, zero, short and non-finite vectors score 0; pairs can be restricted."""
    nan = float("nan")
    rows = [(7, [1.0, 0.0]), (3, [2.0, 0.0]), (5, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (4, [1.0]), (6, [nan, 1.0]), (8, [None, 1.0]), (9, [-1.0, 0.0]), (None, [1.0, 0.0]), (10, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [3.0, 0.0]), ("b", None), ("c", [5.0])], "query_id string, q array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in index.vector_top_k(e.repartition(3), q, 20).collect()}
    assert [got["a", i] for i in range(1, 11)] == [(3, 1.0), (7, 1.0), (1, 0.0), (2, 0.0), (4, 0.0), (5, 0.0), (6, 0.0), (8, 0.0), (10, 0.0), (9, -1.0)]
    assert {got["b", i] for i in range(1, 11)} == {(v, 0.0) for v in range(1, 11)} and got["c", 1] == (4, 1.0) and len(got) == 30
    assert index.vector_top_k(e.limit(0), q, 2).count() == 0 and index.vector_top_k(e, q.limit(0), 2).count() == 0
    allowed = spark.createDataFrame([("a", 5), ("a", 9), ("a", 9), ("z", 3)], "query_id string, vec_id long")
    assert sorted((r.vec_id, r.score) for r in index.vector_top_k(e, q, 5, allowed=allowed).collect()) == [(5, 0.0), (9, -1.0)]


def test_ingest_states(spark):
    files = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c2"), ("d", "c3"), ("e", "c4"), ("f", None), ("g", None)], "path string, checksum string")
    stored = spark.createDataFrame([(1, "c2", "failed", 1), (2, "c2", "processed", 2), (3, "c3", "processed", 1), (4, "c3", "failed", 2), (5, "c9", "processed", 1)], "doc_id long, checksum string, status string, created_at long")
    results = spark.createDataFrame([("a", False, None, True, True), ("c", False, None, True, False), ("d", True, "bad", None, None), ("f", False, "ignored", True, None)], "path string, failed boolean, error_message string, vector_ready boolean, keyword_ready boolean")
    got = {r.path: (r.action, r.doc_id, r.status, r.error_message) for r in ingest.outcomes(ingest.planned(files, stored), results).collect()}
    assert got == {"a": ("new", None, "processed", None), "b": ("duplicate", None, "duplicate", None), "c": ("duplicate", 2, "duplicate", None), "d": ("new", None, "failed", "bad"), "e": ("new", None, "failed", None), "f": ("new", None, "partial", None), "g": ("new", None, "failed", None)}
    got = {r.path: (r.action, r.doc_id, r.status) for r in ingest.outcomes(ingest.planned(files, stored, force=True), results).collect()}
    assert got["b"] == ("duplicate", None, "duplicate") and got["c"] == ("replace", 2, "partial") and got["d"] == ("replace", 4, "failed")
    assert ingest.planned(files.limit(0), stored).count() == 0 and {r.action for r in ingest.planned(files, stored.limit(0)).collect()} == {"new", "duplicate"}


def test_item_accuracy(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "doc_id long, supplier_name string")
    form = "doc_id long, row_no int, part_number string, quantity double"
    want = spark.createDataFrame([(1, 1, "A-1", 2.0), (1, 2, "A-2", None), (2, 1, "B", 1.0), (3, 1, "C", 1.0)], form)
    got = spark.createDataFrame([(1, 1, "a-1 ", 2.00001), (1, 2, "A-3", 5.0), (2, 1, "B", 1.0), (2, 2, "B", 1.0), (3, 1, "C", 1.0)], form)
    pairs = evaluate.item_pairs(docs, want, got, ["part_number", "quantity"])
    assert sorted((r.doc_id, r.field) for r in pairs.collect()) == [(1, "line_item_count"), (1, "line_items[0].part_number"), (1, "line_items[0].quantity"), (1, "line_items[1].part_number"), (2, "line_item_count"), (3, "line_item_count"), (3, "line_items[0].part_number"), (3, "line_items[0].quantity"), (4, "line_item_count")]
    fields_of = spark.createDataFrame([(1, "x", "doc_type", "bom", "BOM"), (3, None, "doc_type", "bom", "bom"), (3, None, "amount", "1", "2")], "doc_id long, supplier_name string, field string, expected string, actual string")
    r = {r.supplier_name: r for r in evaluate.extraction_report(fields_of, pairs).collect()}
    assert (r[None].documents, r[None].passed_documents, r[None].field_checks, r[None].passed_field_checks, r[None].line_item_checks, r[None].passed_line_item_checks) == (4, 1, 3, 2, 9, 7)
    assert r["unknown"].document_accuracy == 0.5 and r["x"].line_item_accuracy == 0.6 and r["unknown"].field_accuracy == 0.5


def test_structured_filters_against_brute_force(spark):
    """Every combination of filters, parts of names of any length (also none), nulls, amounts equal to the cent."""
    rng = random.Random(3)
    day = [datetime.date(2024, 1, 3), datetime.date(2023, 1, 5), datetime.date(2024, 5, 5), None]
    docs = [(i, rng.choice(["N1", "N2", None]), rng.choice(["G1", "G2", None]), rng.choice(["G1", "G3", None]), rng.choice([1.5, 2.0, None]), rng.choice(day), rng.choice(["invoice", "bom"]),
             rng.choice(["Acme Ltd", "AB", "abab acme", "\u00c4 Co", None, ""])) for i in range(200)]
    asked = [(i, rng.choice(["N1", None, None, None]), rng.choice(["G1", None, None, None]), rng.choice([2.0, None, None, None]), rng.choice(["acme", "A", "ab", "bab a", "", None, None, "zzz"]),
              rng.choice([1, None, 5]), rng.choice([2024, None]), rng.choice(["bom", None])) for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, doc_number string, gstin string, buyer_gstin string, amount double, doc_date date, doc_type string, supplier_name string")
    q = spark.createDataFrame(asked, "query_id long, f_doc_number string, f_gstin string, f_amount double, f_supplier_name string, f_month int, f_year int, f_doc_type string")
    want = []
    for i, number, gst, amount, name, month, year, kind in asked:
        if {number, gst, amount, name, month, year, kind} == {None}:
            continue
        hits = [x for x in docs if number in (None, x[1]) and gst in (None, x[2], x[3]) and amount in (None, x[4]) and (name is None or (x[7] is not None and name.lower() in x[7].lower()))
                and (month is None or (x[5] and x[5].month == month)) and (year is None or (x[5] and x[5].year == year)) and kind in (None, x[6])]
        hits.sort(key=lambda x: (x[5] is None, -x[5].toordinal() if x[5] else 0, x[0]))
        want += [(i, x[0], k) for k, x in enumerate(hits[:20], 1)]
    assert sorted(tuple(r) for r in retrieve.structured(d, q, 20).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["query_filters", "route_queries"])
def test_filters_of_accented_texts(spark, tmp_path, name):
    """Word edges, white space and ends of texts that aren't ASCII mean the same to Spark and to SQL."""
    rng = random.Random(5)
    bits = ["\u00e9auxchleaioielle", "auxchleaioielle", "\u00df29ABCDE1234F1Z5", "29abcde1234f1z5\u00fc", "\u00e9mar 2024", "mar 2024\u00e9", "\u00e92019", "2019", "from Acme", "vendor B & Co", "in May", "for", "?", "\u00fctotal 12.50", "total", "\u00e91,250.00",
            "1,250.00\u00e8", "INV-77", "\u00e9INV-78\u00e9", "BOM-5", "amount", "\n", "\t", "\x0b", "\u2028", "invoice", "12.00"]
    texts = ["\u00c8tion \u00e9auxchleaioielle une", "from Acme\n", "from Acme\u2028", "12.50\u2028", "mar\x0b2024", *["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 6))) for _ in range(400)]]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    for t in ("orders", "customer"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(50).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = Q.QUERIES[name](spark, str(tmp_path))
    want = con.execute(Q.SQL[name])
    cols = [c[0] for c in want.description]
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), cols)


def test_hashed_embeddings_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "Part part no 7, P-001 nos"), (2, None), (3, "a b c"), (4, "\u00e9tion two two TWO")], "doc_id long, text string")
    got = index.hashed(rows, ["doc_id"], "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    v = {}
    for r in rows.select("doc_id", F.explode(X.hash_slots("text", 384)).alias("h")).collect():
        v[r.doc_id, r.h["slot"]] = v.get((r.doc_id, r.h["slot"]), 0.0) + r.h["sign"]
    norm = {d: sum(x * x for (e, _), x in v.items() if e == d) ** 0.5 for d, _ in v}
    assert {(r.doc_id, r.slot): r.value for r in got.collect()} == {k: x / norm[k[0]] for k, x in v.items() if x}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_hits_are_scored_once_and_only_their_documents_are_read(spark, monkeypatch):
    calls, scored = [], retrieve.term_scored
    monkeypatch.setattr(retrieve, "term_scored", lambda *a: calls.append(1) or scored(*a))
    *_, top, docs = Q.row_hits(spark, SF)
    assert docs.count() == top.select("doc_id").distinct().count() and len(calls) == 1
    assert Q.QUERIES["structured_merge"](spark, SF).count() and len(calls) == 2
