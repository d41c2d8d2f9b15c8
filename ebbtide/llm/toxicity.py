"""Toxicity of texts: undo obfuscation by a noisy channel, then score the restored words.

1. A character trigram model is counted over all documents.
2. Words with symbols, digits or stretched letters inside, and letters written apart, become
   lattices: each symbol may stand for letters or noise, each run for one or two letters, each
   gap for a space or nothing. Viterbi finds the reading that the character model likes best.
3. Restored words and word beginnings in significantly more documents labelled toxic weigh the
   logarithm of their rate there over their rate elsewhere. A document's evidence is the sum
   over its words, each by its heaviest feature.
4. A logistic curve over evidence and length, fitted on counts per bin, gives the probability.

Labels enter through `training` rows only. The counts, bins and table are bounded; texts stay
where they are.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that a symbol may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "il", "|": "il", "+": "t", "(": "c", "#": "h", "*": "aeiou"}
SYMBOL, NOISE, DOUBLE, GAP = 1.0, 6.0, 0.5, 0.5        # costs in the channel, as negative log-probabilities
LETTER = 2.0                                           # for each letter that is read, so that short readings don't win by length
CODES = 64                                             # letters a-z, other letters in 32 classes, everything else 0
BEGINNINGS = (3, 4, 5, 6, 7)                              # lengths of word beginnings used as features
MOST_WEIGHTS = 2_000_000                               # the classifier is sent to all tasks; more significant features than that end the job
FILTER_BITS = 22                                       # of the filter by which clean texts skip features no toxic text has
LEVEL = 0.1                                            # expected number of features that are significant by chance
LEAST_WEIGHT = 1.1                                     # features less than three times as frequent don't count
BIN = 0.25                                             # bins of the calibration, in logarithms
CACHE = 400_000                                        # words remembered by a worker
PIECE = 4 << 20                                        # characters counted at once
BROADCAST_LABELS = 2_000_000

APART = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ ._*-](?:[^\W_]|[@$!|+])){3,}(?!\w)")
STRETCHED = re.compile(r"(.)\1\1")
MARKS = ".,;:?\"'"                                      # stripped by EDGES on either side, as is a trailing "!"
EDGES = re.compile(r"^[^\w@$!|+(#*]+|[^\w@$+#*]+$")
NOISY_EDGES = re.compile(r"^[@$!|+(#*%&]{2,}|[@$!|+(#*%&]{2,}$")
HAS_LETTER = re.compile(r"[^\W\d_]")


def code_table() -> np.ndarray:
    """Character code of every 16-bit code point."""
    out = np.zeros(1 << 16, np.int64)
    for i in range(1 << 16):
        if chr(i).isalpha():
            out[i] = i - 96 if 97 <= i <= 122 else 27 + i % 32
    return out


def code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % 32 if ch.isalpha() and ord(ch) < 1 << 16 else 0


def _trigrams(batches):
    """(trigram, count) of a task's texts."""
    table, total = code_table(), np.zeros(CODES ** 3, np.int64)
    for b in batches:
        joined = "\n\n".join(x for x in b.column(0).to_pylist() if x).lower()
        for i in range(0, len(joined), PIECE):
            c = np.frombuffer(joined[max(0, i - 2):i + PIECE].encode("utf-32-le", "replace"), np.uint32)
            c = table[np.where(c < 1 << 16, c, 0)]
            total += np.bincount((c[:-2] * CODES + c[1:-1]) * CODES + c[2:], minlength=CODES ** 3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "k"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probability of a character after two others, counted over all texts; at most 64**3 cells."""
    rows = docs.select(text).mapInArrow(_trigrams, "g long, k long").groupBy("g").agg(F.sum("k").alias("k")).collect()
    three = np.zeros(CODES ** 3)
    if rows:
        three[[r[0] for r in rows]] = [r[1] for r in rows]
    three = three.reshape(CODES, CODES, CODES)
    three[0, 0, 0] = 0                                          # runs of symbols say nothing
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32).ravel()


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the readings and their costs."""
    out = []
    for ch, run in groupby(word):
        n = len(list(run))
        if ch in LEET:
            once = [(x, SYMBOL + DOUBLE * (n > 1)) for x in LEET[ch]] + [("", NOISE)]
            out.append(once + [(x * 2, SYMBOL + DOUBLE * (n > 2)) for x in LEET[ch]] if n > 1 else once)
        elif ch.isalpha():
            out.append([(ch, 0.0)] if n == 1 else [(ch, DOUBLE), (ch * 2, 0.0 if n == 2 else DOUBLE)])
        else:
            out.append([("", GAP), (" ", GAP)])
    return out


def decode(word: str, logp) -> str:
    """The likeliest reading of `word`: Viterbi with the last two characters as state."""
    states = {(0, 0): (0.0, "")}
    for read in lattice(word) + [[(" ", 0.0)]]:
        best: dict = {}
        for (a, b), (score, so_far) in states.items():
            for letters, cost in read:
                s, x, y = score - cost, a, b
                for ch in letters:
                    c = code(ch)
                    s += logp[(x * CODES + y) * CODES + c] + (LETTER if c else 0.0)
                    x, y = y, c
                if (x, y) not in best or s > best[x, y][0]:
                    best[x, y] = (s, so_far + letters)
        states = best
    return max(states.values())[1].strip()


class Restorer:
    """Restored words of texts; a worker keeps one per model."""

    def __init__(self, logp: np.ndarray):
        self.logp, self.seen = logp.tolist(), {}

    def word(self, token: str) -> tuple[str, ...]:
        plain = token.strip(MARKS).rstrip("!")
        if plain.isalpha():                                     # the common case needs none of the patterns below
            return (plain,) if not STRETCHED.search(plain) else tuple(decode(plain, self.logp).split())
        core = NOISY_EDGES.sub("", EDGES.sub("", token))
        if not HAS_LETTER.search(core):
            return ()
        if core.isalpha() and not STRETCHED.search(core):
            return (core,)
        return tuple(decode(core, self.logp).split())

    def words(self, text: str) -> Counter:
        """Restored words of a whole text with their numbers."""
        text, out = text.lower(), Counter()
        for t, k in Counter(text.split()).items():
            w = self.seen.get(t)
            if w is None:
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                w = self.seen[t] = self.word(t)
            for x in w:
                out[x] += k
        for m in APART.finditer(text):
            out.update(decode(m.group(), self.logp).split())
        return out


def features(word: str) -> list[str]:
    """The word, and its beginnings with a mark if it is longer."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


_restorers: dict = {}


def _restorer(model) -> Restorer:
    name = model.value["name"]
    if name not in _restorers:
        _restorers.clear()
        _restorers[name] = Restorer(model.value["logp"])
    return _restorers[name]


def _cell(feature: str) -> int:
    return crc32(feature.encode("utf-8", "replace")) & ((1 << FILTER_BITS) - 1)


def _cells(batches):
    """Filter cells of a task's features."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array([_cell(f) for f in b.column(0).to_pylist()], np.int64)))], ["cell"])


def _count(model, wanted=None):
    """(feature, texts with it, occurrences): of all features, or of those whose cell is set in `wanted`. A feature "" counts all words."""
    def run(batches):
        mine, only, known = _restorer(model), wanted and wanted.value, {}
        texts, times = Counter(), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array([texts[f] for f in times], pa.int64()),
                                              pa.array(list(times.values()), pa.int64())], ["f", "k", "o"])
            texts.clear(), times.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                here, n = Counter(), 0
                for w, k in mine.words(t or "").items():
                    n += k
                    fs = known.get(w)
                    if fs is None:
                        if len(known) >= CACHE:
                            known.clear()
                        fs = known[w] = [f for f in features(w) if only is None or only[_cell(f)]]
                    for f in fs:
                        here[f] += k
                here[""] = n
                times.update(here)
                texts.update(here.keys())
            if len(times) > CACHE:
                yield flush()
        yield flush()
    return run


def gain_of(tox: Column, clean: Column, n_tox: int, n_clean: int) -> Column:
    """G statistic of a feature that is more frequent among toxic texts, else 0."""
    n, has = float(n_tox + n_clean), tox + clean
    term = lambda o, e: F.when(o > 0, o * F.log(F.greatest(o, F.lit(1e-9)) / F.greatest(e, F.lit(1e-9)))).otherwise(0.0)
    g = 2 * (term(tox, has * n_tox / n) + term(clean, has * n_clean / n)
             + term(n_tox - tox, (n - has) * n_tox / n) + term(n_clean - clean, (n - has) * n_clean / n))
    return F.when(tox * n_clean > clean * n_tox, g).otherwise(0.0)


def fit_curve(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Intercept and slopes of a logistic curve on binned counts; a slight prior keeps separable data finite."""
    a = np.column_stack([np.ones(len(x)), x])
    b, m, ridge = np.zeros(a.shape[1]), pos + neg, np.diag([1e-3] + [1e-1] * (a.shape[1] - 1))
    for _ in range(100 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (m * p * (1 - p))[:, None]) + ridge, a.T @ (pos - m * p) - ridge @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return b


def _evidence(model):
    @F.arrow_udf("s double, n double")
    def run(texts: pa.Array) -> pa.Array:
        mine, weights, known = _restorer(model), model.value["weights"], model.value.setdefault("known", {})
        s, n = [], []
        for t in texts.to_pylist():
            total, count = 0.0, 0
            for w, k in mine.words(t or "").items():
                x = known.get(w)
                if x is None:
                    if len(known) >= CACHE:
                        known.clear()
                    x = known[w] = max(weights.get(f, 0.0) for f in features(w))
                total += k * x
                count += k
            s.append(float(np.log1p(total)))
            n.append(float(np.log1p(count)))
        return pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(n, pa.float64())], ["s", "n"])
    return run


def remainder(key) -> Column:
    """crc32 of the key as text, modulo 5; 0 marks held-out rows. A null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def _given(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One label per key."""
    some = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    return some.groupBy(F.col(key).alias("__k")).agg(F.max(F.col(label)).alias("__y"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> dict:
    """{"name", "logp", "weights"}: the character model of all `docs`, and weights from the rows that `labels` (key, label) names.

    A key that is labelled twice is toxic if one label says so; null labels are no labels. Without
    toxic or without clean rows there are no weights.
    """
    spark = docs.sparkSession
    model = {"name": uuid.uuid4().hex, "logp": character_model(docs, text), "weights": {}}
    given = _given(labels, key, label)
    given = F.broadcast(given) if given.count() <= BROADCAST_LABELS else given
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(given, "__k")
    n = {int(r[0]): r[1] for r in rows.groupBy("__y").count().collect()}
    n_tox, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_tox or not n_clean:
        return model
    sent = spark.sparkContext.broadcast(model)
    counted = lambda y, how: (rows.filter(F.col("__y") == y).select("text").mapInArrow(how, "f string, k long, o long")
                              .groupBy("f").agg(F.sum("k").alias("k"), F.sum("o").alias("o")))
    found = counted(1, _count(sent)).checkpoint()
    limit = 2 * np.log(max(1, found.count()) / LEVEL)
    # A feature in fewer toxic texts would not be significant even if no clean text had it.
    least = max(2, int(np.ceil(limit / (2 * np.log((n_tox + n_clean) / n_tox)))))
    tox = found.filter((F.col("k") >= min(least, n_tox)) & (F.col("f") != ""))
    cells = np.zeros(1 << FILTER_BITS, bool)
    cells[_cell("")] = True
    cells[[r[0] for r in tox.select("f").mapInArrow(_cells, "cell long").distinct().collect()]] = True      # a number per cell at most
    clean = counted(0, _count(sent, spark.sparkContext.broadcast(cells))).checkpoint()
    all_tox, all_clean = (d.filter("f = ''").first()[2] for d in (found, clean))
    both = tox.join(clean.select("f", F.col("k").alias("ck"), F.col("o").alias("co")), "f", "left").fillna(0, ["ck", "co"])
    weight = F.log((F.col("o") + 0.5) / (all_tox + 1)) - F.log((F.col("co") + 0.5) / (all_clean + 1))
    both = both.select("f", weight.alias("w"), gain_of(F.col("k"), F.col("ck"), n_tox, n_clean).alias("g"))
    chosen = both.filter((F.col("g") >= limit) & (F.col("w") >= LEAST_WEIGHT)).select("f", "w").limit(MOST_WEIGHTS + 1).collect()
    if len(chosen) > MOST_WEIGHTS:
        raise RuntimeError(f"more than {MOST_WEIGHTS} significant features: raise LEAST_WEIGHT or lower LEVEL")
    model["weights"] = {r[0]: float(r[1]) for r in chosen}
    return model


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, row, __score) for every row: row is the hash of key and text, __score the probability of label 1.

    `labels` (key, label) are the training rows. Null and empty texts have no evidence and get the
    curve's value there, like clean texts. Repeated rows get equal scores; whole texts are read.
    Without training rows every score is 0.5, and with labels of one kind it is near that kind; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text, key, label))
    rows = docs.select(F.col(key), F.xxhash64(F.col(key), F.col(text)).alias("row"), _evidence(sent)(F.col(text)).alias("x"))
    rows = rows.select(key, "row", "x.s", "x.n").checkpoint()
    given = _given(labels, key, label)
    # The curve is fitted on the counts of toxic and clean training rows per bin.
    bins = (rows.select(F.col(key).alias("__k"), *[F.round(F.col(c) / BIN).cast("int").alias(c) for c in ("s", "n")]).join(given, "__k")
            .groupBy("s", "n").agg(F.sum(F.col("__y").cast("double")).alias("pos"), F.sum(1.0 - F.col("__y")).alias("neg"))
            .orderBy("s", "n").collect())
    t = np.array([tuple(r) for r in bins], float).reshape(-1, 4)
    b = fit_curve(t[:, :2] * BIN, t[:, 2], t[:, 3])
    return rows.withColumn("__score", 1 / (1 + F.exp(-(F.lit(b[0]) + F.lit(b[1]) * F.col("s") + F.lit(b[2]) * F.col("n"))))).drop("s", "n")


def reject(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", least: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `least` or more.

    Labels of one kind, or none, tell nothing apart: without both a toxic and a clean labelled document nothing is rejected.
    """
    kinds = docs.select(F.col(key).alias("__k")).join(_given(labels, key, label), "__k").select("__y").distinct().count()
    if kinds < 2:
        return docs
    bad = score(docs, labels, text, key, label).filter(F.col("__score") >= least).select(F.col(key).alias("__k"), F.col("row").alias("__r")).distinct()
    rows = docs.withColumn("__row", F.xxhash64(F.col(key), F.col(text)))
    return rows.join(bad, (F.col("__row") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k")), "left_anti").drop("__row")
