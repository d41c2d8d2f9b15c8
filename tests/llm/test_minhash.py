import random
import re

import pytest

from ebbtide.llm import graph, minhash
from ebbtide.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, w):
    """Components by all pairs of exact shingle sets."""
    sets = []
    for _, t in rows:
        x = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(x[i:i + w]) for i in range(len(x) - w + 1)} if len(x) >= w else {tuple(x)} if x else set())
    keys = [k for k, _ in rows]
    root = {k: k for k in keys if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if None not in (keys[i], keys[j]) and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(keys[i]), find(keys[j])
                root[max(a, b)] = min(a, b)
    return sorted((k, len(s), find(k), find(k) == k) if k is not None else (-1, len(s), None, True) for k, s in zip(keys, sets))


def found(df):
    return sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in df.collect())


@pytest.fixture(scope="module")
def rows(prose):
    rnd, out = random.Random(3), []
    for g in range(12):
        base = prose(rnd.choice([5, 30, 120]), g).split()
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 8)):
            x = list(base)
            for _ in range(rnd.randint(0, 4)):
                x[rnd.randrange(len(x))] = "neu%d" % rnd.randrange(99)
            out.append(" ".join(x))
    out += ["", None, "One", "one", "TWO words", "two\twords\n", " \n", "ß é 漢字 wort", "ß é 漢字 wort", prose(6000, 99), prose(6000, 99) + " end"]
    rows = list(enumerate(out))
    rnd.shuffle(rows)
    return rows + [rows[0], (None, "one"), (None, None)]


@pytest.mark.parametrize("w", [4, 5])
def test_components_equal_brute_force(docs, rows, w):
    assert found(minhash.near_duplicates(docs(rows), words=w)) == brute(rows, w)


def test_tiles_and_salts_are_exact(docs, prose, monkeypatch):
    # One base text with up to 20 edits each: similarities on both sides of the limit, chains, one hot key.
    rnd, base = random.Random(8), prose(150, 1).split()
    rows = []
    for i in range(120):
        x = list(base)
        for _ in range(rnd.randint(0, 9)):
            x[rnd.randrange(len(x))] = "neu%d" % rnd.randrange(999)
        rows.append((1000 - i, " ".join(x)))
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "STAR", 8)
    want = brute(rows, 4)
    assert len({r[2] for r in want}) > 3
    assert found(minhash.near_duplicates(docs(rows), words=4)) == want


def test_signature_radius_keeps_similar_sets():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(200):
        u = np.unique(rng.integers(0, 2**63, 90, dtype=np.uint64))
        a, b = u[:-10], u[10:]                                  # 70 of 90: below the limit; 80 of 90: above
        c = u[:-5]
        assert (minhash.signature(u) != minhash.signature(c)).sum() <= minhash.RADIUS
        assert 0 < (minhash.signature(a) != minhash.signature(b)).sum()


def test_keep_one_drops_copies_only(docs, prose):
    a = prose(80, 1)
    rows = [(5, a), (3, a), (3, a), (9, a + " more"), (4, prose(80, 2)), (6, ""), (7, None), (None, a)]
    kept = minhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "6", "7", "None"]
    assert minhash.near_duplicates(docs([])).count() == 0 and minhash.keep_one(docs([])).count() == 0


def test_components_of_a_long_path(spark, docs):
    docs([])
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(900, 901), (5, 5), (None, 3)], "a long, b long")
    got = dict(components(links).collect())
    assert all(got[i] == 0 for i in range(301)) and got[900] == got[901] == 900


def test_few_links_make_few_tasks(spark, docs, monkeypatch):
    docs([])
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 901)], "a long, b long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        few = components(links)
        assert few.rdd.getNumPartitions() <= graph.FEW_TASKS                # each task of each round writes files
        monkeypatch.setattr(graph, "TASK_ROWS", 10)
        many = components(links)
        assert many.rdd.getNumPartitions() == 20
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert dict(few.collect()) == dict(many.collect()) == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


@pytest.fixture
def joins(spark, monkeypatch):
    """Number of joins in the plan of every checkpoint made from now on."""
    seen, kind = [], type(spark.range(1))
    made = kind.checkpoint

    def noted(self, *a, **b):
        seen.append(self._jdf.queryExecution().sparkPlan().toString().count("Join "))
        return made(self, *a, **b)
    monkeypatch.setattr(kind, "checkpoint", noted)
    return seen


def test_a_round_of_the_search_repeats_no_step(spark, docs, joins):
    docs([])
    links = spark.createDataFrame([(i + 1, i) for i in range(20)], "a long, b long")
    assert {r.comp for r in components(links).collect()} == {0}
    assert max(joins) <= 3                          # the driver holds and replans what a plan repeats


def test_near_copies_are_dropped_without_repeated_plans(docs, prose, joins):
    near = [prose(60, 1) + f" end{i}" for i in range(5)]
    kept = minhash.keep_one(docs(near + [prose(60, 2), None]))
    assert kept._jdf.queryExecution().sparkPlan().toString().count("Join ") == 1 and max(joins) <= 4
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5, 6]
