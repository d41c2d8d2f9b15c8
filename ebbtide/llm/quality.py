"""Quality of texts: histogram gradient-boosted trees over statistics of the whole document.

1. A task turns each text into statistics of its bytes, words, lines and repetitions, as whole
   numbers from 0 to CODES - 1: shares by their square root, lengths by their logarithm.
2. The codes of the labelled rows are counted per statistic over all of them, and cut into BINS
   bins of about equal weight. Binned rows are packed into blocks.
3. Trees grow level by level. A job sums gradients and curvatures per node, statistic and bin over
   all blocks; the driver reads these sums, bounded by nodes x statistics x bins, and splits.
   Gradients are whole multiples of 2**-20, so that sums are the same in every order and reruns agree.
4. All trees are flattened into arrays (statistic, threshold, value, children by position). A batch
   walks down a tree at once, by array lookups.

Every labelled row that `labels` names takes part in training; there is no sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.words import buffers, lowered, shingle_hashes, slices, word_hashes, word_spans

CODES = 4096
BINS = 64
TREES = 32
DEPTH = 3
RATE = 0.3
RIDGE = 1.0             # added to the curvature of a leaf
LEAST = 0.05            # curvature on either side of a split
ONE = 1 << 20           # of a gradient
BLOCK = 8192            # rows of a block of binned rows
TASK_ROWS = 65_536      # labelled rows of a training task

PUNCTUATION = b".,;:?'\"()-"
SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
SINGLE = b"!#$%&*|<>{}@_=/-.,?:;\"'()"                  # shares of their own
STATISTICS = (["bytes", "characters", "words", "lines", "letters", "capitals", "digits", "spaces", "punctuation", "symbols", "beyond ascii",
               *("share of " + chr(c) for c in SINGLE), "kinds of bytes", "surprise of bytes", "mean word", "spread of words", "longest word",
               "words without letters", "words in capitals", "words with symbols", "words ending in symbols", "words with digits",
               "short words", "capitalised words", "distinct words", "commonest word", "words as before", "distinct pairs", "distinct fives",
               "distinct lines", "repeated line text", "mean line", "lines ending in a stop", "longest line", "surprise of words"])


def _share(a, b):
    """Code of a share: its square root, finer near 0."""
    return (np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)) * (CODES - 1)).astype(np.int16)


def _length(a):
    """Code of a length: its logarithm up to 2**32."""
    return (np.clip(np.log2(1 + a) / 32, 0, 1) * (CODES - 1)).astype(np.int16)


def _within(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of true bytes in each span."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def _groups(h: np.ndarray, row: np.ndarray, n: int, weight: np.ndarray | None = None):
    """Per row: distinct hashes, occurrences of the commonest, weight of the occurrences after the first, entropy in bits."""
    distinct, most, again, bits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    if len(h) == 0:
        return distinct, most, again, bits
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    size, owner = np.diff(np.append(at, len(h))), row[at]
    distinct += np.bincount(owner, minlength=n)
    np.maximum.at(most, owner, size)
    if weight is not None:
        np.add.at(again, row[~first], weight[order][~first])
    total = np.bincount(row, minlength=n)
    bits += np.bincount(owner, -size * np.log2(size / total[owner]), n)
    return distinct, most, again, bits


def _slice(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Codes of the statistics, a row per document, of a few megabytes of text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    of = lambda chars: counts[:, np.frombuffer(bytes(chars), np.uint8)].sum(axis=1)
    low = lowered(data)
    letter = ((low >= 97) & (low <= 122)) | (data >= 0xC3)              # lead bytes beyond ASCII count as letters
    # Two-byte capitals of Latin-1: C3 followed by 80-9E.
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    capital = ((data >= 65) & (data <= 90)) | accent
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    digit = (data >= 48) & (data <= 57)
    per_row = lambda mask: _within(mask, offsets[:-1], offsets[1:])
    letters, beyond = per_row(letter), counts[:, 128:].sum(axis=1)
    characters = size - counts[:, 0x80:0xC0].sum(axis=1)

    s, e = word_spans(data, offsets)
    owner = np.searchsorted(offsets, s, "right") - 1
    words, length = np.bincount(owner, minlength=n), e - s
    add = lambda mask: np.bincount(owner[mask], minlength=n)
    in_word = lambda mask: _within(mask, s, e)
    wl, wc, ws = in_word(letter), in_word(capital), in_word(symbol)
    mean = np.bincount(owner, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / np.maximum(words, 1) - mean ** 2, 0))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, length)
    h, at = word_hashes(data, offsets)
    kinds, most, _, word_bits = _groups(h, owner, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    runs = {}
    for w in (2, 5):
        x = shingle_hashes(h, w)
        inside = owner[:len(x)] == owner[w - 1:] if len(x) else np.zeros(0, bool)
        runs[w] = _groups(x[inside], owner[:len(x)][inside], n)[0]

    # Lines: runs without a line feed that hold a word. Each is known by the hash of its words.
    feed = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=feed[1:])
    line_of = feed[s]
    new = np.ones(len(s), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(s)) - 1
    line_row, line_len = owner[start], (e[last] - s[start]) if len(start) else np.zeros(0, np.int64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(start, np.diff(np.append(start, len(h)))).astype(np.uint64) + np.uint64(1)), out=total[1:])
    line_hash = total[last + 1] - total[start] if len(start) else np.zeros(0, np.uint64)
    lines = np.bincount(line_row, minlength=n)
    line_kinds, _, again, _ = _groups(line_hash, line_row, n, line_len)
    line_max = np.zeros(n, np.int64)
    np.maximum.at(line_max, line_row, line_len)
    stop = np.isin(data[e[last] - 1], np.frombuffer(b".?!:", np.uint8)) if len(start) else np.zeros(0, bool)

    p = counts / np.maximum(size, 1)[:, None]
    byte_bits = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    cols = [_length(size), _length(characters), _length(words), _length(lines), _share(letters, size), _share(per_row(capital), letters),
            _share(of(b"0123456789"), size), _share(of(b" \t\n\r\x0b\x0c"), size), _share(of(PUNCTUATION), size), _share(of(SYMBOLS), size), _share(beyond, size),
            *(_share(counts[:, c], size) for c in SINGLE), _share((counts > 0).sum(axis=1), 256), _share(byte_bits, 8), _share(mean, 64), _share(spread, 64),
            _length(longest), _share(add(wl == 0), words), _share(add((wl > 1) & (wc == wl)), words), _share(add(ws > 0), words),
            _share(add(symbol[e - 1] if len(e) else np.zeros(0, bool)), words), _share(add(in_word(digit) > 0), words), _share(add(length <= 3), words),
            _share(add(capital[s] if len(s) else np.zeros(0, bool)), words), _share(kinds, words), _share(most, words), _share(np.bincount(owner[same], minlength=n), words),
            _share(runs[2], words - 1), _share(runs[5], words - 4), _share(line_kinds, lines), _share(again, size),
            _length(np.bincount(line_row, line_len, n) / np.maximum(lines, 1)), _share(np.bincount(line_row[stop], minlength=n), lines),
            _length(line_max), _share(word_bits, np.log2(np.maximum(words, 2)))]
    return np.column_stack(cols)


def codes(column) -> np.ndarray:
    """Codes of the statistics of whole texts, a row each. A null text is an empty one."""
    data, offsets = buffers(column)
    parts = [_slice(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.int16)


def _statistics(batches):
    for b in batches:
        x = np.ascontiguousarray(codes(b.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], ["k", "x"])


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, x): the key and the codes of STATISTICS, for every row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(_statistics, f"k {kind}, x array<smallint>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _code_counts(batches):
    """(cell, rows) of a task: how many rows have each code of each statistic."""
    total = np.zeros(len(STATISTICS) * CODES, np.int64)
    for b in batches:
        x = _matrix(b.column(0)).astype(np.int64) + np.arange(len(STATISTICS)) * CODES
        total += np.bincount(x.ravel(), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def bin_table(counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bin of every code of every statistic, of about equal numbers of rows; codes between two bins go to the upper one."""
    before = np.cumsum(counts, axis=1) - counts
    return np.minimum(before * bins // np.maximum(counts.sum(axis=1, keepdims=True), 1), bins - 1).astype(np.uint8)


class Trees:
    """Boosted trees of one depth as arrays: tree t has 2**depth - 1 tests in level order, and 2**depth values."""

    def __init__(self, bias: float, table: np.ndarray, depth: int = DEPTH):
        self.bias, self.table, self.depth = bias, table, depth
        self.statistic = np.zeros((0, 2 ** depth - 1), np.int16)
        self.threshold = np.zeros((0, 2 ** depth - 1), np.int16)      # bins above it go right
        self.value = np.zeros((0, 2 ** depth))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return self.table[np.arange(x.shape[1]), x]

    def leaf(self, bins: np.ndarray, statistic: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
        """Position within the level that `levels` tests lead to, for all rows at once."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            at = 2 * at + 1 + (bins[rows, statistic[at]] > threshold[at])
        return at - (2 ** levels - 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for s, t, v in zip(self.statistic, self.threshold, self.value):
            out += v[self.leaf(bins, s, t, self.depth)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.binned(x)), -30, 30)))

    def add(self, statistic, threshold, value) -> None:
        self.statistic, self.threshold = np.vstack([self.statistic, statistic]), np.vstack([self.threshold, threshold])
        self.value = np.vstack([self.value, value])


def _pack(trees: Trees):
    """Blocks of binned rows: (bins, labels)."""
    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append((trees.binned(_matrix(b.column(0))), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    def block(held):
        bins, y = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([y.astype(np.float32).tobytes()], pa.binary())], ["bins", "y"])
    return run


def _histogram(trees: Trees, statistic: np.ndarray, threshold: np.ndarray, level: int, bins: int):
    """(cell, gradient, curvature) of a task, in whole units; a cell is a node of the level, a statistic and a bin."""
    m = len(STATISTICS)

    def run(batches):
        g, h = (np.zeros(2 ** level * m * bins, np.int64) for _ in range(2))
        for b in batches:
            for raw, label in zip(b.column(0), b.column(1)):
                x = np.frombuffer(raw.as_py(), np.uint8).reshape(-1, m)
                p = 1 / (1 + np.exp(-np.clip(trees.margin(x), -30, 30)))
                grad = np.rint((np.frombuffer(label.as_py(), np.float32) - p) * ONE)
                curve = np.rint(np.maximum(p * (1 - p), 1e-4) * ONE)
                node = trees.leaf(x, statistic, threshold, level) * m
                for j in range(m):                                     # whole numbers: these sums are exact
                    cell = (node + j) * bins + x[:, j]
                    g += np.bincount(cell, grad, len(g)).astype(np.int64)
                    h += np.bincount(cell, curve, len(h)).astype(np.int64)
        at = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(g[at]), pa.array(h[at])], ["cell", "g", "h"])
    return run


def best_split(g: np.ndarray, h: np.ndarray, ridge: float = RIDGE, least: float = LEAST) -> tuple[int, int]:
    """(statistic, threshold) of a node from its sums by statistic and bin; (0, last bin), which sends all rows left, if nothing helps."""
    gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    gt, ht = gl[:, -1:], hl[:, -1:]
    gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
    gain[(hl < least) | (ht - hl < least)] = 0
    i = int(gain.argmax())
    return (i // g.shape[1], i % g.shape[1]) if gain.flat[i] > 1e-9 else (0, g.shape[1] - 1)


def grow(blocks: DataFrame, trees: Trees, count: int = TREES, bins: int = BINS, rate: float = RATE) -> Trees:
    """`trees` with `count` more, each level of each tree from one job over all blocks."""
    m = len(STATISTICS)
    for _ in range(count):
        statistic = np.zeros(2 ** trees.depth - 1, np.int16)
        threshold = np.full(2 ** trees.depth - 1, bins - 1, np.int16)
        value = np.zeros(2 ** trees.depth)
        for level in range(trees.depth):
            run = _histogram(trees, statistic, threshold, level, bins)
            cells = blocks.mapInArrow(run, "cell int, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            g, h = (np.zeros(2 ** level * m * bins) for _ in range(2))
            got = cells.toArrow()                                      # nodes x statistics x bins at most
            at = got.column("cell").to_numpy()
            g[at], h[at] = got.column("g").to_numpy() / ONE, got.column("h").to_numpy() / ONE
            for node, (a, b) in enumerate(zip(g.reshape(-1, m, bins), h.reshape(-1, m, bins))):
                s, t = best_split(a, b)
                i = 2 ** level - 1 + node
                statistic[i], threshold[i] = s, t
                if level == trees.depth - 1:
                    left, right = (slice(0, t + 1), slice(t + 1, None))
                    for side, part in enumerate((left, right)):
                        value[2 * node + side] = rate * a[s, part].sum() / (b[s, part].sum() + RIDGE)
        trees.add(statistic, threshold, value)
    return trees


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Trees:
    """Trees from the rows of `stats` that `labels` (key, label 0 or 1) names.

    A key labelled several times counts once, with the mean of its labels; a document that repeats a
    labelled key counts as often as it occurs. Null labels and keys are no labels. With labels
    of one kind only there are no trees, and the score is the shrunken rate of label 1: (sum + 1) / (rows + 2).
    """
    given = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = stats.join(given, "k").select("x", "y").checkpoint()
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    rate = (good + 1) / (n + 2)
    counts = np.zeros(len(STATISTICS) * CODES, np.int64)
    for cell, k in rows.select("x").mapInArrow(_code_counts, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():   # statistics x codes at most
        counts[cell] = k
    trees = Trees(float(np.log(rate / (1 - rate))), bin_table(counts.reshape(len(STATISTICS), CODES)))
    if good <= 0 or good >= n:
        return trees
    blocks = rows.coalesce(max(1, -(-n // TASK_ROWS))).mapInArrow(_pack(trees), "bins binary, y binary").checkpoint()
    return grow(blocks, trees)


def _score(sent):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.probability(_matrix(b.column(1))))], ["k", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, __score) for every row: the probability of label 1, from statistics of the whole text only.

    `labels` (key, label) are the training rows; see `train` for repeated, null and one-sided ones.
    Null and empty texts have the statistics of an empty text. Rows with equal texts have equal scores,
    whatever their keys; null and repeated keys are scored like others. An empty table gives an empty
    result. Other columns are ignored.
    """
    stats = statistics(docs, key, text).checkpoint()
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(train(stats, labels, key, label))          # a few kilobytes and the bin table
    return stats.mapInArrow(_score(sent), f"k {kind}, score double").select(F.col("k").alias(key), F.col("score").alias("__score"))
