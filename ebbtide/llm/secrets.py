"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key characters with a digit in it or of capitals, any value given to a name
such as password, token or api_key, or the password in a URL. Its features: length and kinds of characters, how often their kind changes, how likely its letters follow each other in the texts
at hand, how much of it dictionary words cover, the document's path, and the words around it.
The forest (Spark ML) learns from labelled findings. Where nobody has labelled any, `seed_labels`
marks the clear cases: published key formats and quoted assignments on one side, card
numbers and words on the other; everything else is left to the forest.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.toxicity import CODES, character_model, code

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|[A-Z]{16})[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_-])")
ASSIGNED = re.compile(r"([A-Za-z_]*(?:pass|secret|token|key|auth)[A-Za-z_]*)$", re.I)
SEPARATOR = re.compile(r"[=:]++>?(?!//)[ \t]*+")
VALUE = re.compile(r"\"([^\"\r\n]{4,})\"|'([^'\r\n]{4,})'|([^\s\"',;<>]{5,}[^\s\"',;<>.)\]}])")
LOGIN = re.compile(r"://[^\s:/@]++:([^\s/@]++)@")
LEAD = " \t\"'=:>"               # between a name and its value
# Published key formats, without their place in a text.
FORMATS = (r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"AIza[A-Za-z0-9_-]{35}",
           r"sk_live_[A-Za-z0-9]{16,}", r"glpat-[A-Za-z0-9_-]{20}")
FORMAT = re.compile("|".join(FORMATS))
NEAR = 3                        # words on either side
SLOTS = 16                      # hash slots of a word or path
DICTIONARY = 1e-5               # share of all words that makes one a dictionary word: at most 100,000 are
TREES, DEPTH = 50, 8
SAMPLE = 20_000                 # labelled findings that the forest is grown on
FIELDS = ("length", "lower", "upper", "digit", "other", "changes", "distinct", "entropy", "letters", "covered", "quoted", "assigned", "login")


def dictionary(docs: DataFrame, text: str = "text", share: float = DICTIONARY) -> frozenset[str]:
    """The words of three letters and more that make up at least `share` of all those words: 1 / share at most."""
    w = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w")).filter(F.length("w") >= 3)
    counts = w.groupBy("w").count().checkpoint()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return frozenset(r[0] for r in counts.filter(F.col("count") >= share * total).select("w").collect())


def proposals(t: str) -> list[tuple[int, int]]:
    """Start and end of every candidate of a text, in order.

    A run of key characters inside an assigned value or a URL's password is no candidate of its own,
    unless that value holds blanks.
    """
    named, reach = set(), 0
    for s in SEPARATOR.finditer(t):
        if s.start() >= reach and ASSIGNED.search(t[max(0, s.start() - 60):s.start()].rstrip(LEAD)):
            v = VALUE.match(t, s.end())
            if v:
                named.add(v.span(v.lastindex))
                reach = v.end()
    named |= {x.span(1) for x in LOGIN.finditer(t)}
    return sorted(named | set(_apart(t, sorted(named))))


def _apart(t: str, named: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters outside the values found by name."""
    whole = [(a, b) for a, b in named if not re.search(r"\s", t[a:b])]
    k, reach = 0, 0
    for x in CANDIDATE.finditer(t):
        while k < len(whole) and whole[k][0] <= x.start():
            reach = max(reach, whole[k][1])
            k += 1
        if x.end() > reach:
            yield x.span()


def _kinds(s: str) -> np.ndarray:
    return np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s])


def covered(s: str, words) -> float:
    """Largest share of characters that words laid side by side can cover."""
    s = s.lower()
    best = [0] * (len(s) + 1)
    for i in range(1, len(s) + 1):
        best[i] = best[i - 1]
        for n in range(3, min(12, i) + 1):
            if s[i - n:i] in words:
                best[i] = max(best[i], best[i - n] + n)
    return best[-1] / len(s)


def likelihood(s: str, logp) -> float:
    """Mean log-probability of the letters after the two before."""
    c = [0, 0, *(code(x) for x in s.lower()), 0]
    return sum(logp[(c[i - 2] * CODES + c[i - 1]) * CODES + c[i]] for i in range(2, len(c))) / (len(c) - 2)


def _login(before: str, after: str) -> bool:
    return after[:1] == "@" and bool(re.search(r"://[^\s:/@]+:$", before))


def describe(value: str, before: str, after: str, logp, words) -> list[float]:
    """The numeric features, in the order of FIELDS."""
    k = _kinds(value)
    share = np.bincount(k, minlength=4) / len(k)
    _, n = np.unique(list(value), return_counts=True)
    p = n / n.sum()
    lead = before.rstrip(LEAD)
    return [float(len(value)), *map(float, share), float((k[1:] != k[:-1]).mean()), len(n) / len(value), float(-(p * np.log2(p)).sum()),
            likelihood(value, logp), covered(value, words), float(before[-1:] in "\"'" and before != "" and after[:1] in "\"'" and after != ""),
            float(before != lead and bool(ASSIGNED.search(lead))), float(_login(before, after))]


def _slot(word: str) -> int:
    h = 0
    for ch in word:
        h = (h * 31 + ord(ch)) % 1_000_003
    return h % SLOTS


def neighbours(before: str, after: str) -> list[float]:
    """Hashed counts of the words before and after."""
    out = [0.0] * (2 * SLOTS)
    for k, words in enumerate((re.findall(r"[^\W\d_]+", before.lower())[-NEAR:], re.findall(r"[^\W\d_]+", after.lower())[:NEAR])):
        for w in words:
            out[k * SLOTS + _slot(w)] += 1
    return out


def seed_label(value: str, before: str, after: str) -> int | None:
    """1 for clear secrets, 0 for clear others, None for the rest."""
    lead = before.rstrip(LEAD)
    named = before != lead and bool(ASSIGNED.search(lead))
    if FORMAT.fullmatch(value) or (named and len(value) >= 16 and not re.search(r"\s", value)) or (_login(before, after) and not value.isalpha()):
        return 1
    if value.isdigit() or value.isalpha():
        return 0
    return 0 if not named and sum(c.isdigit() for c in value) <= 2 else None


_tables: dict = {}


def _find(sent):
    def run(batches):
        m = sent.value
        if m["name"] not in _tables:
            _tables.clear()
            _tables[m["name"]] = m["logp"].tolist()
        logp, words = _tables[m["name"]], m["words"]
        for b in batches:
            out = [[] for _ in range(6)]
            for i, (path, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for start, end in proposals(t or ""):
                    value, before, after = t[start:end], t[max(0, start - 60):start], t[end:end + 60]
                    label = seed_label(value, before, after)
                    where = [0.0] * SLOTS
                    where[_slot(path or "")] = 1.0
                    for col, v in zip(out, (i, start, end, value, label, describe(value, before, after, logp, words)
                                            + where + neighbours(before, after))):
                        col.append(v)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()),
                                              pa.array(out[4], pa.int32()), pa.array(out[5], pa.list_(pa.float64()))],
                                             ["key", "start", "end", "value", "seed", "x"])
    return run


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "source") -> DataFrame:
    """(key, start, end, value, seed, x): every candidate of every whole text, with features and its seed label or null."""
    model = {"name": uuid.uuid4().hex, "logp": character_model(docs, text), "words": dictionary(docs, text)}
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long"), F.col(path).cast("string"), F.col(text))
    return rows.mapInArrow(_find(sent), "key long, start long, end long, value string, seed int, x array<double>")


def grow(labelled: DataFrame, sample: int = SAMPLE, seed: int = 11):
    """A forest from labelled findings (x, label), at most `sample` of them by hash; None if a label is missing."""
    some = labelled.orderBy(F.xxhash64("key", "start", "value")).limit(sample).select(array_to_vector("x").alias("features"), F.col("label").cast("double"))
    some = some.checkpoint()
    if some.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(some)


def scan(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", key: str = "doc_id", path: str = "source",
         train_on: Column | None = None) -> DataFrame:
    """(key, start, end, value, score, secret) for every candidate; positions in code points, the end exclusive.

    `labelled` (key, start, label) are findings with known labels; without it the clear cases of
    the rows where `train_on` holds teach the forest. Null or empty texts have no candidates, null
    keys and paths are allowed, repeated rows give repeated findings, other columns are not
    looked at. If either label is missing there is no forest: clear cases score their seed label, the
    others are null and no secrets. An empty table gives no rows. Keys must be whole numbers.
    """
    found = candidates(docs, text, key, path).checkpoint()
    if labelled is not None:
        taught = found.join(labelled.select(F.col(key).alias("key"), "start", "label").dropDuplicates(["key", "start"]), ["key", "start"])
    else:
        taught = found.withColumn("label", F.col("seed"))
        taught = taught if train_on is None else taught.filter(train_on)
    forest = grow(taught.filter("label IS NOT NULL"))
    if forest is None:
        out = found.withColumn("score", F.col("seed").cast("double"))
    else:
        out = forest.transform(found.withColumn("features", array_to_vector("x"))).withColumn("score", vector_to_array("probability")[1])
    return out.select(F.col("key").alias(key), "start", "end", "value", "score", F.coalesce(F.col("score") >= 0.5, F.lit(False)).alias("secret"))
