"""Chat transcripts: roles by a hidden Markov model, then canonical turns.

Rows are cut where a line starts with a speaker's name. Each piece shows a speaker marker (or
none), its length, lines, question mark, lists and whether it opens the conversation. The model's
states are the roles; its tables are counts over rows whose role is given for training. Viterbi
finds the likeliest roles.

A conversation may hold any share of the rows: all pieces are range-partitioned by conversation
and position, so a long conversation spans partitions. Each partition sends the transfer matrix
(best score from state to state) of what it shares with its neighbours; the states at the
partition borders follow from those, and each partition decodes on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
# Names that mark a speaker at the start of a line.
NAMES = {"system": ("system", "instruction", "instructions"), "user": ("user", "human", "customer", "question", "q", "me", "client"),
         "assistant": ("assistant", "ai", "bot", "gpt", "answer", "a", "agent", "model"), "tool": ("tool", "function", "output")}
MARKER = r"^[\x20\t>#*\[(<|]*(%s)[\x20\t*\])|]*[:>][\x20\t]*"
ANY = MARKER % "|".join(n for names in NAMES.values() for n in names)
LENGTHS, LINES = 16, 4
NAME_PRIOR = 50.0
FEATURES = (("marker", len(ROLES) + 1), ("length", LENGTHS), ("lines", LINES), ("asks", 2), ("lists", 2), ("opens", 2))


def pieces(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str | None = None) -> DataFrame:
    """(conv, turn, part, text, given, row): rows cut before every line that starts with a speaker's name."""
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"(?im)(?={ANY})", "\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: F.btrim(x, F.lit(" \t\r\n")) != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))
    given = F.lower(F.col(role)) if role else F.lit(None).cast("string")
    return (rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), parts.alias("parts"), given.alias("given"),
                        F.monotonically_increasing_id().alias("row"))
            .select("conv", "turn", F.posexplode("parts").alias("part", "text"), "given", "row"))


def observed(text: str = "text") -> dict[str, Column]:
    """What the model sees of a piece, as small whole numbers (all but `opens`)."""
    t, marker = F.col(text), F.lit(0)
    for i, r in enumerate(ROLES, 1):
        marker = F.when(t.rlike("(?i)" + MARKER % "|".join(NAMES[r])), i).otherwise(marker)
    n = F.size(F.split(t, "\n"))
    return {"marker": marker,
            "length": F.least(F.lit(LENGTHS - 1), F.length(F.bin(F.length(t)))),
            "lines": F.when(n <= 1, 0).when(n == 2, 1).when(n <= 5, 2).otherwise(3),
            "asks": t.rlike(r"\?\s*$").cast("int"),
            "lists": t.rlike(r"(?m)^\s*(?:[-*]|[0-9]+[.)])\s|```").cast("int")}


def in_order(cut: DataFrame) -> DataFrame:
    """The pieces in global order over partitions that are fixed from here on; `p` is the partition."""
    cols = cut.withColumns(observed())
    order = [F.col("conv").isNull(), "conv", F.col("turn").isNull(), "turn", "row", "part"]
    return cols.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id()).checkpoint()


def _runs(batch: pa.RecordBatch, last):
    """(start, end) of equal conversations in a batch; whether the first continues `last`."""
    conv = batch.column("conv").to_pylist()
    at = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return conv, list(zip(at[:-1], at[1:])), last is not None and last[0] == conv[0]


def _matrix(batch, opens: np.ndarray) -> np.ndarray:
    cols = [batch.column(f).to_numpy(zero_copy_only=False) for f, _ in FEATURES[:-1]]
    return np.stack([*cols, opens], 1).astype(np.int64)


class Model:
    """Log-probability tables: first state, state to state, and each feature's value by state."""

    def __init__(self, first: np.ndarray, moves: np.ndarray, seen: dict[str, np.ndarray]):
        norm = lambda x: np.log((x + 0.5) / (x + 0.5).sum(axis=-1, keepdims=True))
        self.first, self.moves = norm(first), norm(moves)
        self.tables = [norm(seen[f]) for f, _ in FEATURES]

    def emitted(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of each row of observations by state."""
        return sum(t[:, x[:, i]].T for i, t in enumerate(self.tables))

    def forward(self, e: np.ndarray, start: np.ndarray, backs: list | None = None) -> np.ndarray:
        """Best scores after the rows of `e`; `start` holds those before, by state (rows of starts allowed)."""
        s = start
        for row in e:
            t = s[..., :, None] + self.moves
            if backs is not None:
                backs.append(t.argmax(axis=-2))
            s = t.max(axis=-2) + row
        return s


def _count_roles(batches):
    """Rows (kind, a, b, n) of first roles, moves and feature values, and the partition's border roles."""
    total, head, last, p = {}, None, None, None
    add = lambda *k: total.__setitem__(k, total.get(k, 0) + 1)
    for b in batches:
        if not b.num_rows:
            continue
        p = b.column("p")[0].as_py()
        conv, given = b.column("conv").to_pylist(), b.column("given").to_pylist()
        x = _matrix(b, np.zeros(b.num_rows))
        for i, (c, g) in enumerate(zip(conv, given)):
            s = ROLES.index(g) if g in ROLES else -1
            opens = last is None or last[0] != c
            if last is None:
                head = (c, s, x[i])
            elif s >= 0:
                if opens:
                    add("first", s, 0)
                elif last[1] >= 0:
                    add("moves", last[1], s)
                add("opens", s, int(opens))
            if s >= 0:
                for k, (f, _) in enumerate(FEATURES[:-1]):
                    add(f, s, int(x[i, k]))
            last = (c, s)
    rows = [(k, a, v, n) for (k, a, v), n in total.items()]
    if head is not None:
        name = lambda c: -1 if c is None else c
        rows += [("head", p, head[1], name(head[0])), ("tail", p, last[1], name(last[0]))]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                     ["kind", "a", "b", "n"])


def train(ordered: DataFrame) -> Model:
    """The model from the pieces whose `given` is a role; a bounded table of counts reaches the driver."""
    rows = ordered.mapInArrow(_count_roles, "kind string, a long, b long, n long")
    borders = "kind IN ('head', 'tail')"
    counts = rows.filter(f"NOT {borders}").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    ends = {(r["kind"], r["a"]): (r["b"], r["n"]) for r in rows.filter(borders).collect()}        # two rows per partition
    k = len(ROLES)
    first, moves = np.zeros(k), np.zeros((k, k))
    seen = {f: np.zeros((k, n)) for f, n in FEATURES}
    for r in counts:
        if r["kind"] == "first":
            first[r["a"]] += r["n"]
        elif r["kind"] == "moves":
            moves[r["a"], r["b"]] += r["n"]
        else:
            seen[r["kind"]][r["a"], r["b"]] += r["n"]
    before = None
    for p in sorted(p for kind, p in ends if kind == "head"):
        s, c = ends["head", p]
        opens = before is None or before[1] != c
        if s >= 0:
            seen["opens"][s, int(opens)] += 1
            if opens:
                first[s] += 1
            elif before[0] >= 0:
                moves[before[0], s] += 1
        before = ends["tail", p]
    for i in range(k):                                                      # a speaker's name means that speaker, even if no training row has one
        seen["marker"][i, 0] += NAME_PRIOR
        seen["marker"][i, i + 1] += NAME_PRIOR
    return Model(first, moves, seen)


def _transfers(model: Model):
    """Per partition: transfer matrix of its first conversation's rows if that may continue, forward scores of its last one."""
    eye = np.where(np.eye(len(ROLES), dtype=bool), 0.0, -np.inf)

    def run(batches):
        last, p, one, head, score, first_x = None, None, True, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column("p")[0].as_py()
            conv, runs, goes_on = _runs(b, last)
            e = model.emitted(_matrix(b, np.zeros(b.num_rows)))
            e_open = model.tables[-1][:, 1] - model.tables[-1][:, 0]
            for i, j in runs:
                if last is None:                                            # may continue the partition before
                    first_x, head = (conv[i], e[i]), model.forward(e[i:j], eye)
                    score = model.forward(e[i + 1:j], model.first + e[i] + e_open)
                elif goes_on and i == 0:
                    score = model.forward(e[i:j], score)
                    head = model.forward(e[i:j], head) if one else head
                else:
                    one, score = False, model.forward(e[i + 1:j], model.first + e[i] + e_open)
                last = (conv[i],)
        if p is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p]), pa.array([first_x[0]], pa.int64()), pa.array([last[0]], pa.int64()), pa.array([one]),
                 pa.array([head.ravel().tolist()], pa.list_(pa.float64())), pa.array([score.tolist()], pa.list_(pa.float64()))],
                ["p", "c0", "c1", "one", "head", "score"])
    return run


def borders(parts: list, k: int) -> dict[int, tuple[int, int]]:
    """Partition -> (state before its first row, or -1; state of its last row, or -1 if free): what neighbours must agree on."""
    parts = sorted(parts, key=lambda r: r["p"])
    joined = [i > 0 and parts[i]["c0"] == parts[i - 1]["c1"] for i in range(len(parts))]
    head = [np.array(r["head"]).reshape(k, k) for r in parts]
    after = [np.zeros(k) for _ in parts]                                    # best score of what follows, by last state
    for i in range(len(parts) - 2, -1, -1):
        if joined[i + 1]:
            rest = after[i + 1] if parts[i + 1]["one"] else np.zeros(k)
            after[i] = (head[i + 1] + rest[None, :]).max(axis=1)
    out, state = {}, -1
    for i, r in enumerate(parts):
        before = state if joined[i] else -1
        if i + 1 < len(parts) and joined[i + 1]:
            score = head[i][before] if r["one"] and before >= 0 else np.array(r["score"])
            state = int((score + after[i]).argmax())
        else:
            state = -1
        out[r["p"]] = (before, state)
    return out


def _decode(model: Model, ends: dict):
    """Roles by Viterbi; a conversation's rows within a partition are held until its end, as codes only."""
    e_open = model.tables[-1][:, 1] - model.tables[-1][:, 0]

    def run(batches):
        held, rows, last, first = [], [], None, True

        def flush(before, after):
            e = np.concatenate(held)
            backs: list = []
            if before >= 0:
                s = model.forward(e[:1], np.where(np.arange(len(ROLES)) == before, 0.0, -np.inf))
            else:
                s = model.first + e[0] + e_open
            s = model.forward(e[1:], s, backs)
            path = [after if after >= 0 else int(s.argmax())]
            for b in reversed(backs):
                path.append(int(b[path[-1]]))
            held.clear()
            return path[::-1]

        roles: list = []
        p = None
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column("p")[0].as_py()
            conv, runs, goes_on = _runs(b, last)
            e = model.emitted(_matrix(b, np.zeros(b.num_rows)))
            rows.append(b)
            for i, j in runs:
                if last is not None and not (goes_on and i == 0):
                    roles += flush(ends[p][0] if first else -1, -1)
                    first = False
                held.append(e[i:j])
                last = (conv[i],)
            # Batches that are decoded to their end leave memory.
            while rows and len(roles) >= rows[0].num_rows:
                x = rows.pop(0)
                yield _with_roles(x, roles[:x.num_rows])
                roles = roles[x.num_rows:]
        if p is not None:
            roles += flush(ends[p][0] if first else -1, ends[p][1])
        for x in rows:
            yield _with_roles(x, roles[:x.num_rows])
            roles = roles[x.num_rows:]
    return run


def _with_roles(b: pa.RecordBatch, roles: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(c) for c in ("conv", "turn", "part", "row", "text")] + [pa.array([ROLES[r] for r in roles])],
                                      ["conv", "turn", "part", "row", "text", "role"])


def format_chats(rows: DataFrame, training: str | None = "role", conv: str = "conv_id", turn: str = "turn", text: str = "text",
                 train_on: Column | None = None) -> DataFrame:
    """(conv, turn, part, role, rendered): every piece with its recovered role, rendered canonically.

    `training` names the column of given roles; only rows where `train_on` holds (all, by
    default) teach the model, and no role enters decoding. Rows of a null conversation form one
    conversation; null turns come last; rows of one turn keep the table's order. Null and empty
    texts are pieces without words. Speaker markers are taken off the text, and marks of our own
    format inside a text are broken up. Without training rows all roles are equally likely. An
    empty table gives an empty result.
    """
    taught = rows if train_on is None else rows.withColumn(training, F.when(train_on, F.col(training)))
    cut = pieces(taught, conv, turn, text, training).withColumn("conv", F.col("conv").cast("long"))
    ordered = in_order(cut)
    model = train(ordered)
    parts = ordered.drop("text").mapInArrow(_transfers(model), "p long, c0 long, c1 long, one boolean, head array<double>, score array<double>").collect()
    ends = borders(parts, len(ROLES))                                       # a row per partition
    found = ordered.mapInArrow(_decode(model, ends), f"conv long, turn {dict(ordered.dtypes)['turn']}, part int, row long, text string, role string")
    body = F.regexp_replace(F.btrim(F.regexp_replace("text", "(?i)" + ANY, ""), F.lit(" \t\r\n")), r"<\|", "< |")
    shown = F.concat(F.lit("<|"), "role", F.lit("|>\n"), body, F.lit("\n<|end|>"))
    return found.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "part", "role", shown.alias("rendered"))
