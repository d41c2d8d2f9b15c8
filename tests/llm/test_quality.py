"""Statistics of texts against plain Python, trees against a recursive walk, and held-out documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import quality
from ebbtide.llm.quality import CODES, STATISTICS

ODD = ["", None, " \n\n ", "x", "\n", "é", "漢字 漢字", "ÀÉ ÀÉ àé", "!!! $$$", "a\nb\na\nb\n", "ONE TWO. three 4four!! | |", "a" * 100_000, "w " * 60_000, "0\x000\x0b1"]


def share(a, b):
    return int(np.int16(math.sqrt(min(max(a / max(b, 1), 0), 1)) * (CODES - 1)))


def plain(text):
    """Some statistics by the book."""
    text = text or ""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC3 for c in raw)
    lines = [re.findall(rb"[^\x20\x09-\x0D]+", x) for x in raw.split(b"\n")]
    lines = [[bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in x] for x in lines if x]
    fives = {tuple(low[i:i + 5]) for i in range(len(low) - 4)}
    return {"letters": share(letters, len(raw)), "beyond ascii": share(sum(c >= 128 for c in raw), len(raw)), "share of !": share(raw.count(b"!"), len(raw)),
            "distinct words": share(len(set(low)), len(words)), "commonest word": share(max(Counter(low).values(), default=0), len(words)),
            "words as before": share(sum(a == b for a, b in zip(low, low[1:])), len(words)), "distinct fives": share(len(fives), len(words) - 4),
            "distinct lines": share(len({tuple(x) for x in lines}), len(lines)), "kinds of bytes": share(len(set(raw)), 256),
            "short words": share(sum(len(w) <= 3 for w in words), len(words)), "words with digits": share(sum(any(48 <= c <= 57 for c in w) for w in words), len(words))}


def test_statistics_equal_plain_python(docs, prose):
    rnd = random.Random(2)
    parts = ["one", "Two", "THREE", "é", "!", "$$$", "\n", "4", ".", "漢", "x|y", "\t"]
    texts = ODD + [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(150)] + [prose(300, 1)]
    got = {r.k: r.x for r in quality.statistics(docs(texts)).collect()}
    assert len(STATISTICS) == len(set(STATISTICS)) and all(len(x) == len(STATISTICS) and 0 <= min(x) and max(x) < CODES for x in got.values())
    for i, t in enumerate(texts):
        for name, want in plain(t).items():
            assert got[i][STATISTICS.index(name)] == want, (name, t and t[:60])
    assert got[0] == got[1]


def test_a_text_scores_alike_wherever_it_stands(docs):
    """Slices and batches don't change a document's statistics."""
    texts = ["a b c. " * 700_000, "A short one!", "a b c. " * 700_000, "", "A short one!"]
    got = {r.k: r.x for r in quality.statistics(docs(texts)).collect()}
    assert got[0] == got[2] and got[1] == got[4]


def test_trees_in_arrays_equal_a_recursive_walk():
    rnd = np.random.default_rng(1)
    m = len(STATISTICS)
    trees = quality.Trees(0.25, np.tile(np.arange(CODES) // 64, (m, 1)).astype(np.uint8))
    for _ in range(5):
        trees.add(rnd.integers(0, m, 7), rnd.integers(0, 64, 7), rnd.standard_normal(8))
    x = rnd.integers(0, CODES, (50, m))

    def walk(row, t):
        at = 0
        while at < 7:
            at = 2 * at + 1 + int(row[trees.statistic[t][at]] // 64 > trees.threshold[t][at])
        return trees.value[t][at - 7]
    want = [0.25 + sum(walk(r, t) for t in range(5)) for r in x]
    assert np.allclose(trees.margin(trees.binned(x)), want)
    g, h = rnd.standard_normal((6, 8)), rnd.random((6, 8))
    s, t = quality.best_split(g, h, 1.0, 0.0)
    flat = {(i, j): g[i, :j + 1].sum() ** 2 / (h[i, :j + 1].sum() + 1) + g[i, j + 1:].sum() ** 2 / (h[i, j + 1:].sum() + 1) - g[i].sum() ** 2 / (h[i].sum() + 1)
            for i in range(6) for j in range(8)}
    assert flat[s, t] == pytest.approx(max(flat.values()))
    assert quality.best_split(np.zeros((6, 8)), np.zeros((6, 8))) == (0, 7)


def corpus(prose, n):
    rnd = random.Random(9)
    out = []
    for i in range(n):
        t = prose(rnd.randint(20, 200), i).capitalize() + "."
        if i % 5 == 0:
            w = t.split()
            t = [" ".join(x + "$$$" for x in w), t.upper().replace(" ", "!! "), " ".join([w[0]] * len(w)), " | ".join(w)][i // 5 % 4]
        out.append((i, t, int(i % 5 > 0)))
    return out


def test_held_out_documents(spark, docs, prose):
    rows = corpus(prose, 600)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, quality int")
    table = docs([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r["__score"] for r in quality.score(table, labels).collect()}
    held = [(y, got[i]) for i, _, y in rows if i % 3 == 0]
    assert sum((s >= 0.3) == y for y, s in held) >= 0.97 * len(held)
    # Sums are whole numbers: another partitioning and another run give the same scores.
    again = {r.doc_id: r["__score"] for r in quality.score(table.repartition(7), labels.repartition(5)).collect()}
    assert again == got


def test_labels_and_rows_of_odd_kinds(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, None), (3, "")]
    assert {r["__score"] for r in quality.score(docs(rows), none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert [r["__score"] for r in quality.score(docs(rows), ones).collect()] == [0.75] * 5           # two labelled rows, both good
    assert quality.score(docs([]), ones).count() == 0
    mixed = spark.createDataFrame([(1, 1), (1, 0), (3, 1)], "doc_id long, quality int")                # a key's mean label
    out = quality.score(docs(rows), mixed).collect()
    assert len(out) == 5 and all(0 < r["__score"] < 1 for r in out)
    assert len({r["__score"] for r in out if r.doc_id == 1}) == 1
    assert len({r["__score"] for r in out if r.doc_id in (2, 3)}) == 1                                # a null text is an empty one
