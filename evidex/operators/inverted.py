"""Inverted lists of chunks: terms by field with their places, and words by their grams; computed from a table or stored and kept up to date.

`Computed` and `Stored` answer the same four questions: postings of terms, document frequencies, sizes of fields, and the words
that contain a string. A string without a space lies in a text exactly if it lies in one of the text's words, so strings are
looked for in the vocabulary, by the rarest of their grams, and texts are reached by the postings of the words found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.settle import settle

KEY = ["doc_id", "chunk_index"]
WHOLE = ("doc_number", "supplier_name")  # fields that match as whole values only
FIELDS = ("search_text", "chunk_text", "section", "doc_number", "supplier_name")
WORD = "word"  # the pseudo field of words between spaces, in which strings are looked for
GRAM = 3


def terms_of(field: str, whole: tuple[str, ...] = WHOLE) -> Column:
    """Terms of a field in order: its words, or `=` and its value; of WORD the space-free pieces of the lower search text."""
    if field == WORD:
        return F.filter(F.split(F.lower(F.coalesce("search_text", F.lit(""))), " "), lambda x: x != "")
    if field in whole:
        return F.when(F.coalesce(field, F.lit("")) != "", F.array(F.concat(F.lit("="), field))).otherwise(F.array().cast("array<string>"))
    return F.regexp_extract_all(F.lower(F.coalesce(field, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def listed(chunks: DataFrame, fields: tuple[str, ...], whole: tuple[str, ...] = WHOLE, places: tuple[str, ...] = ("search_text",)) -> DataFrame:
    """KEY, field, term, tf, len (terms of the field), places (1, 2, ..., of the fields in `places`); nothing is shuffled.

    The terms of a field are sorted with their places; equal ones then stand together.
    """
    keep = [c for c in ("segment", "copies") if c in chunks.columns]
    d = chunks.select(*KEY, *keep, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms_of(f, whole).alias("t")) for f in fields])).alias("x")).select(*KEY, *keep, "x.field", "x.t")
    d = d.withColumn("s", F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("term"), (i + 1).alias("at"))))).drop("t").where(F.size("s") > 0)
    new = lambda i: (i == 1) | (F.get("s", i - 1)["term"] != F.get("s", i - 2)["term"])
    d = d.withColumn("b", F.filter(F.sequence(F.lit(1), F.size("s")), new))
    run = lambda b, j: F.slice("s", b, F.coalesce(F.get("b", j + 1), F.size("s") + 1) - b)
    group = lambda b, j: F.struct(F.get("s", b - 1)["term"].alias("term"), F.transform(run(b, j), lambda x: x["at"]).alias("places"))
    d = d.select(*KEY, *keep, "field", F.size("s").alias("len"), F.explode(F.transform("b", group)).alias("g"))
    at = F.when(F.col("field").isin(*places), F.col("g.places")) if places else F.lit(None).cast("array<int>")
    return d.select(*KEY, *keep, "field", "g.term", F.size("g.places").alias("tf"), "len", at.alias("places"))


def grams_of(c: Column, sizes: tuple[int, ...] = (1, 2, GRAM)) -> Column:
    """Distinct substrings of a string of the given sizes."""
    chars = F.split(c, "")
    of = lambda n: F.filter(F.transform(chars, lambda x, i: F.concat(x, *[F.get(chars, i + k) for k in range(1, n)])), lambda g: g.isNotNull())
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def _slots(size: int, asked: list[int] | None):
    """A mapInArrow function: keys and text to keys, slot, value, for the asked slots (all if None). Tokens are hashed once each while they are remembered."""

    def run(batches):
        known: dict[str, int] = {}  # token: slot, negative (-1 - slot) for a sign of -1

        def code(token):
            h = hashlib.sha1(token.encode()).digest()
            slot = int.from_bytes(h[:4], "big") % size
            return slot if h[4] % 2 == 0 else -1 - slot

        words = re.compile("[a-z0-9]{2,}").findall
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                codes, row = [], []
                for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    found = words(text)
                    row.append(len(found))
                    for w in found:
                        if w not in known:
                            if len(known) >= 1 << 20:
                                known.clear()
                            known[w] = code(w)
                        codes.append(known[w])
                c = np.array(codes, np.int64)
                place = np.repeat(np.arange(b.num_rows), row) * size + np.where(c < 0, -1 - c, c)
                m = np.bincount(place, np.where(c < 0, -1.0, 1.0), b.num_rows * size).reshape(b.num_rows, size)
                norm = np.sqrt((m * m).sum(axis=1))
                if asked is not None:
                    kept = np.zeros_like(m)
                    kept[:, asked] = m[:, asked]
                    m = kept
                r, slot = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(r)) for k in range(b.num_columns - 1)), pa.array(slot.astype(np.int32)), pa.array(m[r, slot] / norm[r])], [*b.schema.names[:-1], "slot", "value"])

    return run


def hashed(rows: DataFrame, keys: list[str], text: str, size: int = 384, asked: list[int] | None = None) -> DataFrame:
    """Sparse hashed embedding: keys, slot, value (of unit length); texts without a token have no rows. Of asked slots only, if given.

    The slots are those of X.hash_slots. A text's row is whole where it is read, so nothing is shuffled.
    """
    d = rows.select(*keys, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    kinds = ", ".join(f"{k} {d.schema[k].dataType.simpleString()}" for k in keys)
    return d.mapInArrow(_slots(size, asked), f"{kinds}, slot int, value double")


def grams_held(words: DataFrame, grams: DataFrame) -> DataFrame:
    """gram, word of words (column word, distinct) for the grams asked for (column gram), each pair once."""
    own = few(grams.select("gram").distinct())
    out = None
    for n in sorted(r[0] for r in own.select(F.length("gram")).distinct().collect()) or [GRAM]:  # at most GRAM numbers
        at = words.where(F.length("word") >= n).select("word", F.explode(F.sequence(F.lit(1), F.length("word") - (n - 1))).alias("i"))
        one = at.select(F.substring("word", F.col("i"), F.lit(n)).alias("gram"), "word").join(own, "gram", "left_semi")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def holding(asked: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """term, word for every row of asked (term, piece; piece not empty) and word that contains its piece. held: grams (column gram) -> gram, word.

    A piece goes to the words of its rarest gram, all of whose words are then tested.
    """
    own = asked.select("term", "piece", F.explode(F.when(F.length("piece") >= GRAM, grams_of(F.col("piece"), (GRAM,))).otherwise(F.array("piece"))).alias("gram"))
    lists = settle(held(own.select("gram").distinct()))  # counted, then joined
    counts = lists.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no word holds is the rarest of all: its term is in no text
    best = own.join(counts, "gram", "left").groupBy("term", "piece").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return best.join(lists, "gram").where(F.contains("word", F.col("piece"))).select("term", "word")


def _words_with(lists, terms: DataFrame) -> DataFrame:
    """term, w for every term (column term) and word of lists that contains its longest piece between spaces."""
    longest = F.aggregate(F.filter(F.split("term", " "), lambda x: x != ""), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    t = terms.select("term", longest.alias("piece")).where("piece <> ''").distinct()
    return settle(holding(t, lists.gram_words)).select("term", F.col("word").alias("w"))  # asked for by its buckets, then by its words


def _word_chunks(lists, found: DataFrame) -> DataFrame:
    return lists.postings((WORD,), found.select(F.col("w").alias("term")).distinct()).select(*KEY, F.col("term").alias("w"))


def containing(lists, terms: DataFrame) -> DataFrame:
    """term, doc_id, chunk_index for every term (column term) and chunk whose lower search text contains it."""
    found = _words_with(lists, terms)
    hits = _word_chunks(lists, found).join(found, "w").select("term", *KEY).distinct()
    phrase = F.contains("term", F.lit(" "))
    checked = hits.where(phrase).join(lists.rows().select(*KEY, F.lower("search_text").alias("body")), KEY).where(F.contains("body", F.col("term")))
    return hits.where(~phrase).unionByName(checked.drop("body"))


def contained(lists, asked: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, doc_id, chunk_index, numeric, textual: how many terms of asked (query_id, term), with a digit and without, a chunk contains. keep: filter of (query_id, KEY, ...).

    A chunk's words stand together where they are read, so the numbers of its terms (negative without a digit) are gathered there as a set for each query,
    and a row for each query and chunk is shuffled, not one for each term. Terms with spaces are verified on texts, by `containing`.
    """
    plain = asked.where(~F.contains("term", F.lit(" ")))
    names = plain.select("term").distinct().withColumn("id", F.xxhash64("term").bitwiseAND(F.lit((1 << 62) - 1)) + 1)
    found = _words_with(lists, plain)
    ids = found.join(plain, "term").join(names, "term").select("w", "query_id", F.when(F.col("term").rlike(r"\d"), F.col("id")).otherwise(-F.col("id")).alias("id"))
    one = keep(_word_chunks(lists, found).join(ids, "w")).groupBy("query_id", *KEY).agg(F.collect_set("id").alias("s"))
    one = one.select("query_id", *KEY, F.size(F.filter("s", lambda x: x > 0)).alias("numeric"), F.size(F.filter("s", lambda x: x < 0)).alias("textual"))
    phrases = settle(asked.where(F.contains("term", F.lit(" "))))
    if phrases.isEmpty():
        return one
    number = F.col("term").rlike(r"\d").cast("int")
    more = keep(containing(lists, phrases).join(phrases, "term")).select("query_id", *KEY, number.alias("numeric"), (1 - number).alias("textual"))
    return one.unionByName(more).groupBy("query_id", *KEY).agg(F.sum("numeric").alias("numeric"), F.sum("textual").alias("textual"))


def cover_density(places: Column, n: Column, weight: float = 0.1) -> Column:
    """Sum over all minimal covers of weight / (1 + words of others inside), for places: array of (at, term) of the asked words in a text, n: number of asked words.

    A cover is a stretch that holds every asked word and no shorter stretch that does. Read from the left, one ends wherever the
    oldest of the words' last places changes; it begins there.
    """
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("last"), F.lit(0).alias("from"), F.lit(0.0).alias("sum"))
    seen = F.sort_array(places)

    def step(acc, i):
        x = F.get(seen, i - 1)
        last = F.map_concat(F.map_filter(acc["last"], lambda k, _: k != x["term"]), F.create_map(x["term"], i))
        oldest = F.when(F.size(last) == n, F.array_min(F.map_values(last))).otherwise(0)
        noise = (x["at"] - F.get(seen, oldest - 1)["at"]) - (i - oldest)
        gain = F.when((oldest > 0) & (oldest != acc["from"]), F.lit(weight) / (1 + F.greatest(noise, F.lit(0)))).otherwise(0.0)
        return F.struct(last.alias("last"), oldest.alias("from"), (acc["sum"] + gain).alias("sum"))

    return F.when(F.size(places) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(places), F.lit(1))), start, step)["sum"]).otherwise(0.0)


def few(terms: DataFrame, most: int = 1_000_000) -> DataFrame:
    """terms, computed once, and sent to all tasks if there are at most `most`."""
    own = settle(terms)
    return F.broadcast(own) if own.count() <= most else own


@dataclass
class Computed:
    """Lists of a table of chunks, made when asked. Columns: KEY and the fields that are asked for; copies, if there, is the number of equal chunks that a row stands for."""

    chunks: DataFrame
    whole: tuple[str, ...] = WHOLE

    def rows(self) -> DataFrame:
        return self.chunks

    def postings(self, fields: tuple[str, ...], terms: DataFrame) -> DataFrame:
        """KEY, field, term, tf, len, places of the terms (column term) in fields; of WORD alone only which chunks hold them."""
        own = few(terms.select("term").distinct())
        if fields == (WORD,):
            none = F.lit(None).cast("int")
            words = F.array_distinct(F.split(F.lower(F.coalesce("search_text", F.lit(""))), " "))
            one = self.chunks.select(*KEY, F.explode(words).alias("term")).join(own, "term", "left_semi")
            return one.select(*KEY, F.lit(WORD).alias("field"), "term", none.alias("tf"), none.alias("len"), F.lit(None).cast("array<int>").alias("places"))
        # a chunk's distinct terms meet the asked ones before anything else is made of them
        keep = [c for c in ("copies",) if c in self.chunks.columns]
        d = self.chunks.select(*KEY, *keep, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms_of(f, self.whole).alias("t")) for f in fields])).alias("x")).select(*KEY, *keep, "x.field", "x.t")
        d = d.select(*KEY, *keep, "field", "t", F.explode(F.array_distinct("t")).alias("term")).join(own, "term", "left_semi")
        at = F.filter(F.transform("t", lambda x, i: F.when(x == F.col("term"), i + 1)), lambda x: x.isNotNull())
        places = F.when(F.col("field") == "search_text", at)
        return d.select(*KEY, *keep, "field", "term", (F.size("t") - F.size(F.array_remove("t", F.col("term")))).alias("tf"), F.size("t").alias("len"), places.alias("places"))

    def frequencies(self, fields: tuple[str, ...], terms: DataFrame) -> DataFrame:
        """field, term, df."""
        return self.postings(fields, terms).groupBy("field", "term").agg(self.number().alias("df"))

    def number(self) -> Column:
        """Chunks that rows stand for, as an aggregate."""
        return F.sum("copies") if "copies" in self.chunks.columns else F.count("*")

    def sizes(self, fields: tuple[str, ...]) -> DataFrame:
        """field, n (all chunks), mean (terms a chunk); one row a field."""
        copies = F.col("copies") if "copies" in self.chunks.columns else F.lit(1)
        lens = self.chunks.agg(self.number().alias("n"), *[(F.sum(F.size(terms_of(f, self.whole)) * copies) / self.number()).alias(f"m_{f}") for f in fields])
        return lens.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"m_{f}").alias("mean")) for f in fields])).alias("s")).select("s.field", "n", "s.mean")

    def vectors(self, slots: DataFrame) -> DataFrame:
        """KEY, slot, value of the hashed embeddings at the slots asked for (column slot)."""
        return hashed(self.chunks, KEY, "search_text", asked=[r[0] for r in slots.select("slot").distinct().collect()])  # at most 384 numbers

    def gram_words(self, grams: DataFrame) -> DataFrame:
        """gram, word for the grams asked for (column gram)."""
        return grams_held(self.chunks.select(F.explode(F.split(F.lower(F.coalesce("search_text", F.lit(""))), " ")).alias("word")).where("word <> ''").distinct(), grams)


ROWS = "doc_id long, chunk_index int, page_number int, section string, chunk_text string, evidence_type string, doc_type string, doc_number string, supplier_name string, search_text string, part int, segment int"
POSTINGS = "doc_id long, chunk_index int, field string, term string, tf int, len int, places array<int>, bucket int, segment int"
COUNTS = "field string, term string, n long, bucket int, segment int"
VECTORS = "doc_id long, chunk_index int, slot int, value double, bucket int, segment int"
GRAMS = "gram string, word string, bucket int, segment int"
SIZES = "field string, chunks long, terms long, segment int"
GONE = "doc_id long, segment int"
STATES = "segments array<int>, buckets int, state int"


class Stored:
    """An inverted index in a folder that all executors share; a search reads the buckets of its terms only.

    A change is a segment with a number of its own, written once: rows (by part of doc_id), postings, counts (changes of document
    frequencies), grams and vectors (by bucket of their term or slot), sizes (changes of totals) and gone (documents whose rows in earlier
    segments are dead). states lists the segments a reader takes; it is written last, so a change that was cut off is never seen and
    is overwritten by the next. One writer at a time. compact() writes all that lives as one segment. An object stays at the state
    that it has read first, or made; refresh() takes the newest. buckets is the number for a new index, to be chosen by its size
    (a bucket's files are sorted, so a read for few terms skips most of a large one); an index that is there keeps its own.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._state: tuple[int, list[int]] | None = None
        self._tables: dict[str, DataFrame] = {}

    # ---- tables ----
    def refresh(self) -> Stored:
        self._state, self._tables = None, {}
        return self

    def state(self) -> tuple[int, list[int]]:
        """Number of the state and its segments; (0, []) of an index that holds nothing yet."""
        if self._state is None:
            self._state = self._newest()
        return self._state

    def _newest(self) -> tuple[int, list[int]]:
        try:
            r = self.spark.read.schema(STATES).parquet(f"{self.root}/states").orderBy(F.desc("state")).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            r = None
        if r is None:
            return 0, []
        self.buckets = r["buckets"]  # what the index was begun with
        return r["state"], list(r["segments"])

    def _table(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/segment={s}" for s in segments])

    def _bucket(self, term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _asked(self, df: DataFrame, column: str) -> list[int]:
        """The buckets of df's terms, by which files are pruned: at most `buckets` numbers come to the driver."""
        return [r[0] for r in df.select(self._bucket(column)).distinct().collect()]

    def _now(self, name: str, schema: str) -> DataFrame:
        """A table in the object's state; its files are listed once."""
        if name not in self._tables:
            self._tables[name] = self._table(name, schema, self.state()[1])
        return self._tables[name]

    def _live(self, df: DataFrame, segments: list[int]) -> DataFrame:
        """Rows (doc_id, segment) that no later segment has replaced or deleted."""
        if len(segments) < 2:
            return df
        gone = self._now("gone", GONE).groupBy(F.col("doc_id").alias("_d")).agg(F.max("segment").alias("_s"))
        return df.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("segment") < F.col("_s")), "left_anti")

    def rows(self) -> DataFrame:
        """The chunks that live."""
        return self._live(self._now("rows", ROWS), self.state()[1])

    # ---- questions ----
    def postings(self, fields: tuple[str, ...], terms: DataFrame) -> DataFrame:
        own = settle(terms.select("term").distinct())
        p = self._now("postings", POSTINGS).where(F.col("bucket").isin(self._asked(own, "term")) & F.col("field").isin(*fields)).join(own, "term", "left_semi")
        return self._live(p, self.state()[1]).select(*KEY, "field", "term", "tf", "len", "places")

    def frequencies(self, fields: tuple[str, ...], terms: DataFrame) -> DataFrame:
        own = settle(terms.select("term").distinct())
        c = self._now("counts", COUNTS).where(F.col("bucket").isin(self._asked(own, "term")) & F.col("field").isin(*fields)).join(own, "term", "left_semi")
        return c.groupBy("field", "term").agg(F.sum("n").alias("df")).where("df > 0")

    def sizes(self, fields: tuple[str, ...]) -> DataFrame:
        s = self._now("sizes", SIZES).where(F.col("field").isin(*fields)).groupBy("field").agg(F.sum("chunks").alias("n"), F.sum("terms").alias("t"))
        return s.select("field", "n", F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(0.0).alias("mean"))

    def vectors(self, slots: DataFrame) -> DataFrame:
        own = settle(slots.select("slot").distinct())
        v = self._now("vectors", VECTORS).where(F.col("bucket").isin(self._asked(own, "slot"))).join(own, "slot", "left_semi")
        return self._live(v, self.state()[1]).select(*KEY, "slot", "value")

    def gram_words(self, grams: DataFrame) -> DataFrame:
        own = settle(grams.select("gram").distinct())
        g = self._now("grams", GRAMS).where(F.col("bucket").isin(self._asked(own, "gram")))
        return g.join(own, "gram", "left_semi").select("gram", "word").distinct()  # words of replaced rows have no postings that live

    # ---- changes ----
    def _write(self, df: DataFrame, name: str, segment: int, by: str | None = None) -> None:
        path = f"{self.root}/{name}/segment={segment}"
        if by is None:
            df.coalesce(1).write.mode("overwrite").parquet(path)
        else:  # large buckets, as those of very frequent terms, are split
            order = [c for c in (by, "field", "term", "gram", "slot") if c in df.columns]  # a read for few terms skips the rest of a file by its statistics
            df.hint("rebalance", by).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(by).parquet(path)

    def _counted(self, df: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
        """Changes of frequencies and sizes by the rows of df."""
        fields = (*FIELDS, WORD)
        counts = listed(df, fields, places=()).groupBy("field", "term").agg((F.count("*") * sign).alias("n"))
        sizes = df.agg(F.count("*").alias("c"), *[F.coalesce(F.sum(F.size(terms_of(f))), F.lit(0)).alias(f) for f in fields])
        sizes = sizes.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col("c") * sign).alias("chunks"), (F.col(f) * sign).cast("long").alias("terms")) for f in fields])).alias("s")).select("s.*")
        return counts, sizes

    def _change(self, new: DataFrame | None, ids: DataFrame) -> None:
        """A segment that holds new (chunks) and ends what earlier segments hold of documents ids (doc_id)."""
        state, segments = self.refresh().state()
        n = state + 1
        part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.buckets)).cast("int")
        columns = [c.split()[0] for c in ROWS.split(", ")][:-2]
        if new is not None:
            have = new.columns
            typed = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in ROWS.split(", ")[:-2])]
            self._write(new.select(*typed, part.alias("part")), "rows", n, "part")
            ids = self._table("rows", ROWS, [n]).select("doc_id").distinct()
        # only the parts of touched documents are read
        touched = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        parts = [r[0] for r in touched.select(part).distinct().collect()]
        old = self._live(self._table("rows", ROWS, segments).where(F.col("part").isin(parts)), segments).join(touched, "doc_id", "left_semi")
        self._write(old.select("doc_id").distinct(), "gone", n)
        counts, sizes = self._counted(old, -1)
        if new is not None:
            rows = self._table("rows", ROWS, [n]).select(*columns)
            p = listed(rows, (*FIELDS, WORD))
            self._write(p.withColumn("bucket", self._bucket("term")), "postings", n, "bucket")
            plus, more = self._counted(rows, 1)
            counts, sizes = counts.unionByName(plus), sizes.unionByName(more)
            words = rows.select(F.explode(terms_of(WORD)).alias("word")).distinct().select("word", F.explode(grams_of(F.col("word"))).alias("gram"))
            self._write(words.withColumn("bucket", self._bucket("gram")), "grams", n, "bucket")
            self._write(hashed(rows, KEY, "search_text").withColumn("bucket", self._bucket("slot")), "vectors", n, "bucket")
        else:
            for name, schema, by in (("rows", ROWS, "part"), ("postings", POSTINGS, "bucket"), ("grams", GRAMS, "bucket"), ("vectors", VECTORS, "bucket")):
                self._write(self.spark.createDataFrame([], schema.replace(", segment int", "")), name, n, by)
        counts = counts.groupBy("field", "term").agg(F.sum("n").alias("n")).where("n <> 0")
        self._write(counts.withColumn("bucket", self._bucket("term")), "counts", n, "bucket")
        self._write(sizes.groupBy("field").agg(F.sum("chunks").alias("chunks"), F.sum("terms").alias("terms")), "sizes", n)
        self._set(n, [*segments, n])

    def _set(self, state: int, segments: list[int]) -> None:
        self.spark.createDataFrame([(segments, self.buckets)], "segments array<int>, buckets int").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/states/state={state}")
        self.refresh()._state = (state, segments)

    def add(self, chunks: DataFrame) -> Stored:
        """Insert documents, or replace those that are held: chunks has all rows of each of its documents."""
        self._change(chunks, chunks.select("doc_id"))
        return self

    def delete(self, ids: DataFrame) -> Stored:
        """Delete documents (doc_id)."""
        self._change(None, ids)
        return self

    def compact(self) -> Stored:
        """All that lives as one segment; earlier files stay for readers that hold an earlier state."""
        state, segments = self.refresh().state()
        n = state + 1
        read = lambda name, schema: self._table(name, schema, segments)
        self._write(self._live(read("rows", ROWS), segments).drop("segment"), "rows", n, "part")
        self._write(self._live(read("postings", POSTINGS), segments).drop("segment"), "postings", n, "bucket")
        self._write(self._live(read("vectors", VECTORS), segments).drop("segment"), "vectors", n, "bucket")
        counts = read("counts", COUNTS).groupBy("field", "term", "bucket").agg(F.sum("n").alias("n")).where("n <> 0")
        self._write(counts, "counts", n, "bucket")
        alive = self._table("counts", COUNTS, [n]).where(F.col("field") == WORD).select(F.col("term").alias("word"))
        self._write(read("grams", GRAMS).drop("segment").distinct().join(alive, "word", "left_semi"), "grams", n, "bucket")
        self._write(read("sizes", SIZES).groupBy("field").agg(F.sum("chunks").alias("chunks"), F.sum("terms").alias("terms")), "sizes", n)
        self._write(self.spark.createDataFrame([], "doc_id long"), "gone", n)
        self._set(n, [n])
        return self
