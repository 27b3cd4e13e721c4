"""Prefix trie, chat formatting and centroid clustering against plain Python, and the totals along keys that they rest on."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import centroids, chat, spread, trie

CONV = "conv_id long, turn long, role string, text string, digest string, depth int"


def talks(seed=3, n=60):
    """Conversations that share heads, exact copies, a long one, and the odd cases."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -10, -3, 10_000]:
        for t in range(rng.randint(1, 9)):
            text = rng.choice(["a", "b", "é \n", "", None, "[INST] x", "\\", "</s", "<s>", "[", "{\\", "a [/INST]", "\\\\[INST]"])
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "system", None, "tool\n[/ROLE] ", "USER"]), text, "x", 1))
    rows += [(n + 1, 1, "user", "same", "", 0)] * 3 + [(n + 2, 5, "user", "tie", None, None), (n + 2, 5, "assistant", "tie", None, None)]
    rows += [(n + 5, i, "user", f"long {i}", None, None) for i in range(300)] + [(n + 6, 0, "user", "é" * 200_000, None, None), (None, 0, "user", "nobody", None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(talks(), CONV).repartition(5).cache()


def by_turn(rows, tie):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        convs[c].append((t is not None, t or 0, tie(r or "", x or ""), r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in convs.items()}


def test_totals_along_keys_of_any_size(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randint(-5, 40), i, rng.randint(0, 9), rng.getrandbits(60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, i long, v long, x long").repartition(6)
    cut = spread.dealt(df, ["k"], ["i"], 9)
    assert cut.where("k = 0").select(spread.PART).distinct().count() > 3
    got = {(r["k"], r["i"]): (r["s"], r["b"]) for r in spread.along(cut, "k", ["i"], {"s": (F.sum, F.col("v")), "b": (F.bit_xor, F.col("x"))}).collect()}
    want, at = {}, defaultdict(lambda: (0, 0))
    for k, i, v, x in sorted(rows):
        want[k, i] = at[k]
        at[k] = (at[k][0] + v, at[k][1] ^ x)
    assert got == want


def test_lookup_of_hot_and_rare_values(spark):
    rows = spark.createDataFrame([(0, i) for i in range(500)] + [(i % 50, i) for i in range(100)], "k long, i long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), (F.first("k") * 2).alias("double"))
    out = spread.looked_up(rows, table, ["k"], "n", most=10).collect()
    assert len(out) == 600 and all(r["double"] == 2 * r["k"] for r in out)


def brute_trie(rows):
    own = by_turn([r for r in rows if r[0] is not None], lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest())
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, sums = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) + (not kids[p]), own_saved + sum(sums[k][1] for k in kids[p]))
        ends = sorted(c for c in members[p] if len(built[c]) == len(p))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *sums[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def test_trie(spark, conversations):
    got = trie.trie(conversations).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r[2:]) for r in got} == brute_trie(talks())
    assert len(got) == len({(r["conv_id"], r["depth"]) for r in got})
    assert trie.trie(spark.createDataFrame([], CONV)).count() == 0


def test_trie_of_many_equal_conversations(spark):
    """A hot node: most conversations are the same, so their ids lie in several partitions."""
    rows = [(c, t, "user", "same" if c % 9 else f"own {c}", None, None) for c in range(0, 1500) for t in range(2)]
    got = {(r["conv_id"], r["depth"]): tuple(r[2:]) for r in trie.trie(spark.createDataFrame(rows, CONV).repartition(7)).collect()}
    assert got == brute_trie(rows)


def test_trie_without_rebuilding(spark):
    rows = [(1, 0, "user", "hi", "", 0), (1, 1, "assistant", "ho", "", 0), (2, 0, "user", "hi", "", 0), (2, 1, "assistant", "he", "", 0)]
    got = {(r["conv_id"], r["depth"]): (r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in trie.trie(spark.createDataFrame(rows, CONV), rebuild=False).collect()}
    assert got == {(1, 0): (2, 1, 2, 2), (1, 1): (2, 2, 2, 2), (1, 2): (1, 0, 1, 0), (2, 2): (1, 0, 1, 0)}


def test_chat_is_read_back(spark, conversations):
    out = chat.formatted(conversations).withColumns({"read": chat.turns_of(F.col("formatted")), "loss": chat.learned(F.col("segments"))}).collect()
    want = by_turn(talks(), lambda r, x: (r, x))
    assert {r["conv_id"]: [tuple(t) for t in r["read"]] for r in out} == want
    for r in out:
        assert r["loss"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        state, n = "begun", 0
        for role, _ in want[r["conv_id"]]:
            state = chat.DEFAULT.moves.get(state, {}).get(role)
            if state is None:
                break
            n += 1
        assert (r["valid"], r["valid_turns"]) == (state == "answered", n)
    assert chat.formatted(spark.createDataFrame([], CONV)).count() == 0


def test_chat_marks_stand_only_where_the_template_puts_them(spark):
    rng = random.Random(5)
    bits = [*chat.DEFAULT.controls, "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "a", "]", ">", "SYS"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "".join(rng.choice(bits) for _ in range(3))]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))), "", 0) for c in range(150) for t in range(4)]
    df = spark.createDataFrame(rows, CONV)
    out = chat.formatted(df).withColumn("read", chat.turns_of(F.col("formatted"))).collect()
    want = by_turn(rows, lambda r, x: (r, x))
    assert {r["conv_id"]: [tuple(t) for t in r["read"]] for r in out} == want
    for r in out:  # marks in the string are as many as the turns ask for
        roles = [role for role, _ in want[r["conv_id"]]]
        assert r["formatted"].count("[INST]") == roles.count("user") and r["formatted"].count("</s>") == roles.count("assistant")
        assert r["formatted"].count("[/TURN]") == sum(x not in chat.DEFAULT.marks for x in roles)


def test_chat_refuses_ambiguous_templates():
    with pytest.raises(ValueError):
        chat.Template("", {"user": chat.Mark("[U]", "<<a<<")}, chat.DEFAULT.other, chat.DEFAULT.named, ("<<a<<",), "s", {}, ())
    with pytest.raises(ValueError):
        chat.Template("", {"user": chat.Mark("[U]", "end")}, chat.DEFAULT.other, chat.DEFAULT.named, chat.DEFAULT.controls, "s", {}, ())


def test_chat_runs_no_python(spark, conversations):
    plan = chat.formatted(conversations).withColumn("read", chat.turns_of(F.col("formatted")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


VEC = "vec_id long, embedding array<float>, label int, q int, n long, distance string"


def vectors(seed=2, n=300):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 64)], 0, 1, 1, "x") for i in range(n)]
    rows += [(1000 + i, rows[i % 7][1], 0, 1, 1, "x") for i in range(200)]  # copies of few
    odd = [None, [], [0.1] * 63, [0.1] * 65, [None] + [0.1] * 63, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [3e38] + [0.0] * 63]
    rows += [(2000 + i, v, None, None, None, None) for i, v in enumerate(odd)] + [(None, rows[0][1], 0, 0, 0, ""), rows[5], (2100, [0.0] * 64, 0, 0, 0, ""), (2101, [-5e5] * 64, 0, 0, 0, ""), (2102, [5e5] * 64, 0, 0, 0, "")]
    return rows


def brute_lloyd(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and abs(x) <= centroids.FAR for x in v)]
    cents = [q for _, q in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for step in range(rounds + 1):
        arr = np.array(cents, dtype=object)
        near = [min((int(((np.array(q, dtype=object) - c) ** 2).sum()), j) for j, c in enumerate(arr)) for _, q in kept]
        if step < rounds:
            for j in range(len(cents)):
                mine = [q for (_, q), (_, a) in zip(kept, near, strict=True) if a == j]
                if mine:
                    cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((i, j, d) for (i, _), (d, j) in zip(kept, near, strict=True)), cents


def test_centroids(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VEC).repartition(4)
    got, cents = centroids.clusters(df, k=12, rounds=3)
    want, final = brute_lloyd(rows, 12, 3)
    assert sorted(map(tuple, got.collect())) == want
    assert cents.tolist() == final


def test_centroids_of_few_and_none(spark):
    few = spark.createDataFrame(vectors()[:3], VEC)
    got, cents = centroids.clusters(few)
    assert len(cents) == 3 and sorted(r["cluster"] for r in got.collect()) == [0, 1, 2]
    none, cents = centroids.clusters(spark.createDataFrame([], VEC))
    assert none.count() == 0 and len(cents) == 0


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    same = [(i, [0.25] * 64, 0, 0, 0, "") for i in range(9)] + [(9, [0.5] * 64, 0, 0, 0, "")]
    got, cents = centroids.clusters(spark.createDataFrame(same, VEC), k=10, rounds=2)
    want, final = brute_lloyd(same, 10, 2)
    assert sorted(map(tuple, got.collect())) == want and cents.tolist() == final


@pytest.mark.parametrize("name", ["op11_trie", "op12_chat", "op13_centroids"])
def test_registered(name):
    from evidex.llm import queries

    assert name in queries.queries() and name in queries.oracle_sql()
