"""Files of a folder through the whole ingest: duplicates, failures, force, and batches that come again."""

from evidex.operators import index
from evidex.streaming import inbox

BILL = "TAX INVOICE\nInvoice No: INV-{n}\nSupplier: Acme {n} Ltd\nInvoice Date: 0{n}/02/2026\nGrand Total: {n}00.50\nfoam seat cover {n}"


def state(box):
    docs, chunks = box.table("documents").rows().collect(), box.table("chunks").rows().collect()
    assert {c.doc_id for c in chunks} <= {d.doc_id for d in docs}
    assert sorted((c.doc_id, c.chunk_index) for c in chunks) == sorted((r.doc_id, r.chunk_index) for r in box.corpus().index.rows().collect())
    assert len({(c.doc_id, c.chunk_index) for c in chunks}) == len(chunks)
    return {(d.source_filename, d.doc_number) for d in docs}, {r.path.rsplit("/", 1)[1]: r.status for r in box.registry.rows().collect()}


def reader(content):
    if b"broken" in content:
        raise ValueError("no text layer")
    return content.decode().split("\f")


def test_inbox(spark, tmp_path, monkeypatch):
    folder, root, cp = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    folder.mkdir()
    put = lambda name, text: (folder / name).write_text(text)
    put("a.txt", BILL.format(n=1))
    put("b.txt", BILL.format(n=2))
    put("c.txt", BILL.format(n=1))  # the same content as a.txt
    put("d.txt", "broken")
    box = inbox.Inbox(spark, root, buckets=4)
    box.run(str(folder), cp, reader, "*.txt")
    first = ({("a.txt", "INV-1"), ("b.txt", "INV-2")}, {"a.txt": "processed", "b.txt": "processed", "d.txt": "failed"})
    assert state(box) == first
    # a batch is cut off after documents, chunks and index, before the registry, and comes again
    put("e.txt", BILL.format(n=3))
    put("f.txt", BILL.format(n=2))
    real = inbox.Kept.rewrite
    lost = lambda self, *a: (_ for _ in ()).throw(RuntimeError("lost")) if self.root.endswith("registry") else real(self, *a)
    monkeypatch.setattr(inbox.Kept, "rewrite", lost)
    try:
        box.run(str(folder), cp, reader, "*.txt")
        raise AssertionError("the batch should have failed")
    except AssertionError:
        raise
    except Exception as e:  # the stream wraps the error
        assert "lost" in str(e)
    monkeypatch.setattr(inbox.Kept, "rewrite", real)
    box.run(str(folder), cp, reader, "*.txt")
    second = (first[0] | {("e.txt", "INV-3")}, {**first[1], "e.txt": "processed"})
    assert state(box) == second
    # the last batch again: it is registered, nothing is made; then all files by force: held rows keep their ids
    from evidex.sources.corpus import scan_files

    files, ids = scan_files(spark, str(folder), "*.txt"), {r.doc_id for r in box.table("documents").rows().collect()}
    n = box.registry.state()[0]
    box.take(files, box.registry.last(), reader)
    assert box.registry.state()[0] == n
    box.take(files, "again", lambda content: content.decode().split("\f"), force=True)
    got = state(box)
    assert got[1]["d.txt"] != "failed" and ids < {r.doc_id for r in box.table("documents").rows().collect()} and second[0] <= got[0]
    q = spark.createDataFrame([(1, "seat cover 3")], "query_id long, text string")
    assert index.top_k(index.bm25(box.corpus().index, q), 1).count() == 1
