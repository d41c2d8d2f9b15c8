"""Masked pseudo-likelihood of documents.

A small network predicts every token from the two on either side: an embedding for each neighbour
and its distance, one tanh layer, a softmax over token classes. The classes are the most
frequent words of all documents, and for other words 32 classes by their last letters. Trained in
numpy inside the tasks: every task runs over its share of the documents from common weights, and
the results are averaged by the number of tokens seen. A word of an ending class has the
probability of its class times its share of the class in the whole corpus. A document's score is
the sum of the log-probabilities of its tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.words import U, buffers, hashed_spans, slices, word_hashes

WORDS, ENDINGS = 96, 32         # size of the model
CLASSES = WORDS + ENDINGS
EDGE = CLASSES                  # stands outside a document
SIDE, DIM = 2, 16
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
SHAPES = ((len(OFFSETS), CLASSES + 1, DIM), (DIM,), (DIM, CLASSES), (CLASSES,))
EPOCHS, RATE, BATCH = 2, 0.05, 1024                # every epoch trains on all tokens
CHUNK = 1024                    # tokens scored at once; their class scores stay in a core's cache
SLICE = 1 << 19                 # bytes of whole texts split at once
FLUSH = 1_000_000
GROUPS = 16
CARRIED = 65_536                # words whose share of their class is sent to every task; the rest are joined
STEPS = 16                      # of the counts of words, to a power of two
BROADCAST_ROWS = 500_000


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(flat[at:at + n].reshape(s))
        at += n
    return out


def start(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.standard_normal(int(np.prod(s))) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for s in SHAPES])


def endings(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of every word by its last two bytes."""
    low = low.astype(np.int16)
    return WORDS + ((low[end - 1] * 31 + np.where(end - start > 1, low[np.maximum(end - 2, 0)], 32)) % ENDINGS).astype(np.int64)


def _word_counts(batches):
    """(hash, ending class, count) of a task's words."""
    held = []

    def flush():
        v, c, k = (np.concatenate(x) for x in zip(*held))
        u, first, at = np.unique(v, return_index=True, return_inverse=True)
        n = np.bincount(at, weights=k, minlength=len(u)).astype(np.int64)
        held.clear()
        return u, c[first], n

    row = lambda u, c, n: pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c), pa.array(n)], ["h", "c", "k"])
    for b in batches:
        data, offsets = buffers(b.column(0))
        for i, j in slices(offsets):
            d, o = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            h, _, start, end, low = hashed_spans(d, o)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, endings(low, start[first], end[first]), n))
        if sum(len(x[0]) for x in held) > FLUSH:
            x = flush()
            if len(x[0]) > FLUSH // 2:
                yield row(*x)
            else:
                held.append(x)
    if held:
        yield row(*flush())


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c, k): every word of all documents, its ending class and count."""
    return docs.select(text).mapInArrow(_word_counts, "h long, c long, k long").groupBy("h").agg(F.min("c").alias("c"), F.sum("k").alias("k"))


def vocabulary(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> np.ndarray:
    """Hashes of the most frequent words of all documents, sorted; ties by hash."""
    top = (word_counts(docs, text) if counts is None else counts).orderBy(F.desc("k"), "h").limit(WORDS).collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(U))


def shares(counts: DataFrame, vocab: np.ndarray) -> tuple[DataFrame, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Log of every other word's share of its class: as (h, lp), for words never seen by class, and the most frequent as arrays.

    A word that was never seen counts as one more word of its class.
    """
    own = counts.sparkSession.createDataFrame([(int(h),) for h in vocab.view(np.int64)], "h long")
    rest = counts.join(F.broadcast(own), "h", "left_anti")
    total = np.zeros(CLASSES)
    for c, n in rest.groupBy("c").agg(F.sum("k")).collect():                    # a row per class
        total[c] = n
    of = F.element_at(F.array(*[F.lit(float(x)) for x in total]), (F.col("c") + 1).cast("int"))
    table = rest.select("h", "k", F.log(F.col("k") / of).alias("lp"))
    # As many of the highest steps of the counts as CARRIED holds: a row per step reaches the driver, then the words of these steps.
    step, left, least = F.floor(F.log2("k") * STEPS).cast("int"), CARRIED, None
    for b, n in sorted(table.groupBy(step).count().collect(), reverse=True):
        if n > left:
            break
        left, least = left - n, b
    some = table.filter(step >= least).select("h", "lp").collect() if least is not None else []
    h, lp = np.array([r[0] for r in some], np.int64).view(U), np.array([r[1] for r in some], float)
    order = np.argsort(h)
    return table.select("h", "lp"), -np.log(total + 1), (h[order], lp[order])


def _found(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is there, place in the sorted `words`) of every hash."""
    if not len(words):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    k = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return words[k] == h, k


def _tokens(column, vocab: np.ndarray):
    """As token_classes, with the hash and ending class of every token, and the slice's rows."""
    data, offsets = buffers(column)
    for i, j in slices(offsets, SLICE):
        h, at, start, end, low = hashed_spans(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        n = np.diff(at)
        other = endings(low, start, end)
        there, k = _found(h, vocab)
        place = np.arange(len(h)) + SIDE * (np.repeat(np.arange(len(n)), n) + 1)
        out = np.full(len(h) + SIDE * (len(n) + 1), EDGE, np.int16)
        out[place] = np.where(there, k, other)
        yield out, place, at, h, other, (i, j)


def token_classes(column, vocab: np.ndarray):
    """(classes of all tokens with two edges around every row, place of the tokens, first token of every row), slice by slice."""
    for ids, place, at, *_ in _tokens(column, vocab):
        yield ids, place, at


def _wide(p) -> np.ndarray:
    """A row per class: its embeddings at all distances, side by side."""
    return np.ascontiguousarray(p[0].transpose(1, 0, 2)).reshape(CLASSES + 1, -1)


def _hidden(p, wide: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """The layer of all places of a run of classes but the first and last two, and a one."""
    g, n = np.take(wide, seg, axis=0, mode="clip"), len(seg) - 2 * SIDE
    h = g[SIDE + OFFSETS[0]:SIDE + OFFSETS[0] + n, :DIM] + p[1]
    for k, o in enumerate(OFFSETS[1:], 1):
        h += g[SIDE + o:SIDE + o + n, k * DIM:(k + 1) * DIM]
    out = np.ones((n, DIM + 1), np.float32)
    out[:, :DIM] = np.tanh(h, out=h)
    return out


def _run(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the classes from two before the first place to two behind the last, the rows of the places); edges in between are rows too."""
    return ids[place[0] - SIDE:place[-1] + SIDE + 1], place - place[0]


def log_probs(p, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log-probability of every token given its neighbours; `place` are all tokens of a run of `ids`."""
    out, wide, top = np.empty(len(place), np.float32), _wide(p), np.concatenate([p[2], p[3][None]])
    ones = np.ones(CLASSES, np.float32)
    for i in range(0, len(place), CHUNK):
        at = place[i:i + CHUNK]
        seg, row = _run(ids, at)
        z = _hidden(p, wide, seg) @ top
        own = z[row, ids[at]]
        np.exp(np.minimum(z, 60, out=z), out=z)
        out[i:i + CHUNK] = own - np.log((z @ ones)[row])
    return out


def train_step(p, memory, ids, place) -> None:
    """One Adagrad step on a batch of tokens, all those of a run of `ids`.

    The softmax stays unscaled: its sums come out of the product that the gradient needs anyway,
    and the targets' part is added per class.
    """
    seg, row = _run(ids, place)
    h = _hidden(p, _wide(p), seg)
    top = np.concatenate([p[2], p[3][None]])
    e = h @ top
    if np.abs(top).sum(axis=0).max() > 60:              # no score can be larger than this sum
        np.minimum(e, 60, out=e)
    np.exp(e, out=e)
    back = np.zeros((CLASSES + 1, DIM + 1), np.float32)
    back[:CLASSES, :DIM] = p[2].T
    back[:CLASSES, DIM] = 1
    r = e @ back[:CLASSES]
    share = np.zeros((len(e), 1), np.float32)           # 0 for edges
    share[row, 0] = 1 / r[row, DIM]
    dh = r[:, :DIM] * share - np.take(back[:, :DIM], seg[SIDE:-SIDE], axis=0)
    dh *= 1 - h[:, :DIM] ** 2
    # What goes to a class: from its places as a neighbour, and as a target the layer itself.
    m, size = len(e), len(OFFSETS) * DIM
    d = np.zeros((len(seg), size + DIM + 2), np.float32)
    for k, o in enumerate(OFFSETS):
        d[SIDE + o:SIDE + o + m, k * DIM:(k + 1) * DIM] = dh
    d[SIDE:-SIDE, size:size + DIM + 1] = h
    order = np.argsort(seg, kind="stable")
    s = seg[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    sums = np.zeros((CLASSES + 1, d.shape[1]), np.float32)
    sums[s[first]] = np.add.reduceat(np.take(d, order, axis=0).view(np.complex64), first, axis=0).view(np.float32)    # adds two at a time
    dtop = (h * share).T @ e - sums[:CLASSES, size:size + DIM + 1].T
    grads = [sums[:, :size].reshape(CLASSES + 1, len(OFFSETS), DIM).transpose(1, 0, 2), dh.sum(axis=0), dtop[:DIM], dtop[DIM]]
    for x, mem, g in zip(p, memory, grads):
        g = g / np.float32(len(place))
        mem += g * g
        x -= RATE * g / (np.sqrt(mem) + 1e-6)


def _learn(vocab: np.ndarray, weights: np.ndarray):
    def run(batches):
        flat = weights.copy()
        p, memory, seen = unpack(flat), unpack(np.zeros_like(flat)), 0
        for b in batches:
            for ids, place, _ in token_classes(b.column(0), vocab):
                for i in range(0, len(place), BATCH):
                    train_step(p, memory, ids, place[i:i + BATCH])
                seen += len(place)
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(flat.astype(np.float64) * seen).tobytes()], pa.binary())], ["n", "w"])
    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table.column("w").to_pylist())
    return pa.table({"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, text: str = "text", epochs: int = EPOCHS, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary, weights): the tasks' weights are added up in groups before they reach the driver."""
    vocab, weights = vocabulary(docs, text, counts), start()
    for _ in range(epochs):
        parts = docs.select(text).mapInArrow(_learn(vocab, weights), "n long, w binary").filter("n > 0")
        sums = parts.withColumn("g", F.expr(f"pmod(hash(w), {GROUPS})")).groupBy("g").applyInArrow(_added, "n long, w binary").collect()
        n = sum(r["n"] for r in sums)
        if not n:
            break
        weights = (sum(np.frombuffer(r["w"]) for r in sums) / n).astype(np.float32)
    return vocab, weights


def _scores(sent):
    @F.arrow_udf("n long, total double")
    def run(texts: pa.Array) -> pa.Array:
        vocab, flat, words, share, _ = sent.value
        p, n, total = unpack(flat), [], []
        for ids, place, at, h, _, _ in _tokens(texts, vocab):
            each = log_probs(p, ids, place).astype(np.float64)
            if len(words):
                there, k = _found(h, words)
                each += np.where(there, share[k], 0)
            lp = np.concatenate([[0.0], np.cumsum(each)])
            n.append(np.diff(at))
            total.append(lp[at[1:]] - lp[at[:-1]])
        cat = lambda v, kind: pa.array(np.concatenate(v) if v else [], kind)
        return pa.StructArray.from_arrays([cat(n, pa.int64()), cat(total, pa.float64())], ["n", "total"])
    return run


def _rare(sent):
    """(text, hash, unseen share, count, first) of the words of every text that are neither classes nor carried; first is 1 in one row of a text."""
    def run(batches):
        vocab, _, words, _, unseen = sent.value
        for b in batches:
            t = b.column(0).to_numpy(zero_copy_only=False)
            for ids, place, at, h, c, (i, j) in _tokens(b.column(1), vocab):
                keep = (ids[place] >= WORDS) & ~_found(h, words)[0]
                if not keep.any():
                    continue
                of, h, c = np.repeat(np.arange(j - i), np.diff(at))[keep], h[keep], c[keep]
                order = np.lexsort((h, of))
                of, h, c = of[order], h[order], c[order]
                new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])])
                n = np.diff(np.r_[new, len(of)])
                first = np.r_[True, of[new][1:] != of[new][:-1]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t[i + of[new]]), pa.array(h[new].view(np.int64)), pa.array(unseen[c[new]]), pa.array(n), pa.array(first)],
                                                 ["t", "h", "unseen", "k", "first"])
    return run


def score(docs: DataFrame, text: str = "text", model: tuple | None = None, counts: DataFrame | None = None) -> DataFrame:
    """`docs` with __tokens, __log_likelihood (0 without tokens) and __per_token (null without tokens).

    The model (vocabulary, weights) is trained on `docs` unless given; `counts` (of word_counts) are those of `docs`
    unless given. A null text has no tokens; repeated rows get equal scores; whole texts are read;
    other columns pass through; an empty table gives an empty result.
    """
    counts = (word_counts(docs, text) if counts is None else counts).checkpoint()
    vocab, weights = model or train(docs, text, counts=counts)
    table, unseen, (words, share) = shares(counts, vocab)
    sent = docs.sparkSession.sparkContext.broadcast((vocab, weights, words, share, unseen))
    rare = docs.select(F.xxhash64(F.col(text)).alias("t"), F.col(text)).mapInArrow(_rare(sent), "t long, h long, unseen double, k long, first long")
    # Texts that are there several times count each of their words so often.
    more = (rare.join(table, "h", "left").groupBy(F.col("t").alias("__t"))
            .agg((F.sum(F.col("k") * F.coalesce("lp", "unseen")) / F.sum("first")).alias("__more")).checkpoint())
    more = F.broadcast(more) if more.count() <= BROADCAST_ROWS else more
    out = docs.withColumns({"__lm": _scores(sent)(F.col(text)), "__t": F.xxhash64(F.col(text))}).join(more, "__t", "left")
    out = out.withColumns({"__tokens": F.col("__lm.n"), "__log_likelihood": F.col("__lm.total") + F.coalesce("__more", F.lit(0.0))})
    return (out.withColumn("__per_token", F.when(F.col("__tokens") > 0, F.col("__log_likelihood") / F.col("__tokens")))
            .drop("__lm", "__t", "__more"))
