"""Conversation repair, exact search and clustering: brute force, SQL, odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from synteny_spark.llm import clustering, conversations, topk, vectors
from synteny_spark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_topk", "op13_clustering"])
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# Conversation repair


def every_repair(rows):
    """(cost, audit, turns) of all repairs with at most two inserts in a place. rows: role, text, first fault."""
    out = []
    inserts = [(), ("user",), ("assistant",), *itertools.product(("user", "assistant"), repeat=2)]
    for edits in itertools.product("KDUA", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") or e == "K" and not role for e, (role, _, f) in zip(edits, rows)):
            continue
        for puts in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for put, edit, row in zip(puts, [*edits, ""], [*rows, ("", "", None)]):
                cost, audit, turns = cost + 2 * len(put), audit + "I" * len(put), turns + [(r, "") for r in put]
                role, text, found = row
                if edit == "D":
                    cost, audit = cost + 3, audit + "D"
                elif edit:
                    cost += (edit != "K") * 2 + (found == "truncated")
                    audit += "K" if edit == "K" else "R"
                    turns = [*turns, ({"K": role, "U": "user", "A": "assistant"}[edit], text)]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
                out.append((cost, audit, turns))
    return min(out)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append((role, text, conversations.fault(text, (role, text) in seen)))
        seen.add((role, text))
    return out


def repaired(rows):
    r, seen = conversations.Repair(), set()
    for role, text in rows:
        r.add(role, text, (role, text) in seen)
        seen.add((role, text))
    return r


@pytest.mark.parametrize("seed", range(40))
def test_repair_against_all_repairs(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "system", "tool", "s", ""]), rng.choice(["a.", "b", " ", "", "c!\n", "a."])) for _ in range(rng.randint(0, 3))]
    cost, audit, turns = every_repair(faults(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    assert repaired(rows).result() == (cost, audit, digest)


def plain_repair(rows):
    """The same state by state, with (cost, audit, turns) compared as they are."""
    best = {0: (0, "", [])}
    wanted = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def closed(best):
        todo, out = list(best.items()), {}
        for state, way in todo:
            for _ in range(3):
                out[state] = min(out.get(state, way), way)
                role, state = wanted[state]
                way = (way[0] + 2, way[1] + "I", [*way[2], (role, "")])
        return out

    for role, text, found in faults(rows):
        now = {}
        for state, (cost, audit, turns) in closed(best).items():
            ways = [(state, 3, "D", turns)]
            if found not in ("blank", "duplicate"):
                want, after = wanted[state]
                extra = found == "truncated"
                ways.append((after, 2 + extra, "R", [*turns, (want, text)]))
                if role[:1] == want[0] or state == 0 and role[:1] == "s":
                    ways.append((after if role[:1] == want[0] else 1, 0 + extra, "K", [*turns, (role, text)]))
            for to, price, letter, said in ways:
                way = (cost + price, audit + letter, said)
                now[to] = min(now.get(to, way), way)
        best = now
    return min(w for s, w in closed(best).items() if s in (0, 3))


@pytest.mark.parametrize("n", [3, conversations.BLOCK, conversations.BLOCK + 1, 5 * conversations.BLOCK + 7])
def test_long_conversations_are_repaired_by_blocks(n):
    rng = random.Random(n)
    rows = [(rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice([f"t{i}.", f"t{i}", "", "again?"])) for i in range(n)]
    cost, audit, turns = plain_repair(rows)
    assert repaired(rows).result() == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


CONV = "conv_id long, turn long, role string, text string, here int, copies string, duplicate long"


def test_odd_conversations(spark):
    rows = [(1, None, None, None, 1, "", 1), (1, 4, "user", "x " * 40000, 1, "", 1), (None, 2, "user", "hello.", 1, "", 1), (None, 2, "user", "hello.", 1, "", 1), (2, None, "", "", 0, None, None), (3, 10**17, "assistant", "日本語 😀.", 0, None, None), (3, -5, "user", "q?", 0, None, None)]
    got = {r.conv_id: r for r in conversations.damage_and_repair(spark.createDataFrame(rows, CONV)).collect()}
    assert set(got) == {None, 1, 2, 3}
    c = duckdb.connect()
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(map(tuple, got.values()), key=str) == sorted(c.sql(conversations.oracle()).fetchall(), key=str)
    assert conversations.damage_and_repair(spark.createDataFrame([], CONV)).count() == 0


def test_a_conversation_without_rows(spark):
    plain = spark.createDataFrame([(7, None, None, None, False), (8, 3, "user", "a b", True), (8, 5, "user", "a b", True), (8, 5, "user", "a b", True)], "conv_id long, turn long, role string, text string, here boolean")
    got = sorted(map(tuple, conversations.repaired(plain).collect()))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[0] == (7, 0, 0, 0, 0, 0, 0, "", nothing)
    assert got[1][:8] == (8, 1, 0, 2, 1, 2, 9, "DDD")  # keeping the first would cost 1 + 2 besides two deletes; D is less than K


# Vectors


def test_whole_numbers(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [INF]), (6, []), (None, [-0.0, 2.0])]
    got = vectors.whole(vectors.named(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")).collect()
    assert sorted(((r.vec_id, r.v) for r in got), key=str) == sorted([(1, [32, -1]), (6, []), (None, [0, 128])], key=str)


VECS = "vec_id long, embedding array<float>, label int, v int, score string, shard string, cluster int, copies int"
EXTRA = (0, 1, "s", "h", 2, 3)


def odd_vectors(size, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size) / 2]) for i in range(120)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (40, rows[3][1]), (200, rows[3][1]), (None, rows[20][1]), (None, rows[7][1])]
    rows += [(60, None), (80, [None] * size), (100, [NAN] + [1.0] * (size - 1)), (500, [1.0, 2.0]), (520, [2.0, 2.0]), (540, []), (560, [])]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # a hot vector
    return rows


def embeddings(rows):
    c = duckdb.connect()
    c.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    return c


@pytest.mark.parametrize("shards, leaf", [(1, 256), (3, 8), (7, 2)])
def test_search_of_odd_vectors(spark, monkeypatch, shards, leaf):
    monkeypatch.setattr(topk, "LEAF", leaf)
    rows = odd_vectors(6)
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], VECS)
    got = sorted(map(tuple, topk.top(df, shards=shards).collect()), key=str)
    assert got == sorted(embeddings(rows).sql(topk.oracle()).fetchall(), key=str)
    assert topk.top(spark.createDataFrame([], VECS)).count() == 0


def test_search_with_few_rows_and_own_queries(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "id long, e array<double>")
    got = topk.top(df, F.col("vec_id") == 2, 5, "id", "e").collect()
    assert [tuple(r) for r in got] == [(2, 1, 3, 128 * 192), (2, 2, 1, 128 * 64)]


@pytest.mark.parametrize("scale", [1, 10**6, 10**7])
def test_tree_search_against_all_rows(monkeypatch, scale):
    """The largest scale takes Python's numbers."""
    monkeypatch.setattr(topk, "LEAF", 16)
    rng = np.random.default_rng(1)
    x, q = (rng.integers(-40, 40, (n, 5)) * scale for n in (300, 20))
    tree = topk.Tree(list(range(300)), x, int(np.abs(q).max()))
    assert tree.exact == (scale <= 10**6)
    kth = np.array([sorted(int(a) for a in x @ v)[-10] for v in q], object)
    for least in (np.array([tree.lowest] * 20, object), kth):
        got = tree.search(q, least, np.array([i if i % 2 else -1 for i in range(20)]), 10)
        for i, (v, found) in enumerate(zip(q, got)):
            all_ = sorted(((-int(s), j) for j, s in enumerate(x @ v) if j != i or i % 2 == 0))
            want = [(j, -s) for s, j in all_[:10]]
            assert found == [w for w in want if w[1] >= least[i]]


def test_trees_skip_what_cannot_win():
    """Far groups: a query's kth score discards the others' boxes."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, (512, 4)) + np.array(c) * 1000 for c in ([1, 0, 0, 0], [-1, 0, 0, 0], [0, 1, 0, 0], [0, -1, 0, 0])])
    tree = topk.Tree(list(range(len(x))), x, 1005)
    q = np.array([[1000, 0, 0, 0]])
    bounds = tree.bounds(q, np.array([990_000]))
    assert 0 < (bounds > tree.lowest).sum() <= len(tree.leaves) // 4
    assert (np.concatenate([x[tree.place[a:b]] for a, b in (tree.span[i] for i in tree.leaves)]).shape == x.shape) and sorted(tree.place.tolist()) == list(range(len(x)))


@pytest.mark.parametrize("seed", range(6))
def test_trees_keep_far_groups_apart(seed):
    """Whatever the values' order, a group isn't cut where there is a gap beside it: its two leaves alone can win."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(-5, 5, (512, 4)) + np.array(c) * 1000 for c in ([1, 0, 0, 0], [-1, 0, 0, 0], [0, 1, 0, 0], [0, -1, 0, 0])])
    x = x[rng.permutation(len(x))]
    tree = topk.Tree(list(range(len(x))), x, 1005)
    bounds = tree.bounds(np.array([[1000, 0, 0, 0]]), np.array([990_000]))
    assert (bounds > tree.lowest).sum() == 2 and len(tree.leaves) == 8 and sorted(tree.place.tolist()) == list(range(len(x)))


def test_all_tables_against_sql(spark):
    """test_oracles names four tables; these queries read others."""
    from synteny_spark.llm.queries import ORACLES, QUERIES

    c, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op11_conversation_repair", "op12_topk", "op13_clustering"):
        df, want = QUERIES[name](spark, sf), c.sql(ORACLES[name])
        assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_clusters_of_odd_vectors(spark):
    rows = odd_vectors(clustering.SIZE)
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], VECS)
    got = sorted(map(tuple, clustering.cluster(df).collect()), key=str)
    assert got == sorted(embeddings(rows).sql(clustering.oracle()).fetchall(), key=str) and len(got) == 186
    assert clustering.cluster(spark.createDataFrame([], VECS)).count() == 0
    few = spark.createDataFrame([(None, [1.0] * 64), (9, [2.0] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r.distance for r in clustering.cluster(few).collect()) == [0, 0]


@pytest.mark.parametrize("known", [4096, 3])
def test_tables_against_plain_distances(monkeypatch, known):
    monkeypatch.setattr(clustering, "KNOWN", known)
    rng = np.random.default_rng(3)
    centroids = rng.integers(-50, 50, (4, 6))
    tables = clustering.Tables(centroids.tolist())
    for _ in range(3):
        x = rng.integers(-50, 50, (30, 6))
        assert (tables.distances(x) == ((x[:, None] - centroids[None]) ** 2).sum(2)).all()
    with pytest.raises(ValueError):
        tables.distances(np.full((1, 6), 1 << 40))
