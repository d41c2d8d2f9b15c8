"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A signature has 64 positions of 16 bits. Texts whose shingle sets have a similarity of 0.8
differ in 12.8 positions on average; the join finds every pair that differs in at most 27, which
misses such a pair with a probability of 1.4e-5, and more similar ones far less often. By the
pigeonhole principle one of 14 chunks of such a pair has at most one error, so a key is made of
each chunk with each of its positions left out: 64 keys, whatever the error's value.

Equal sets are joined first, so copies cost one row. Pairs under a key are not listed: each
document is first compared with one smallest member, confirmed links join documents to
components, and only pairs of different components are looked at after that. Links are
confirmed on whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.graph import components
from ebbtide.llm.words import ODD, U, scramble, shingle_sets

POSITIONS, RADIUS = 64, 27
SIMILAR = (80, 100)             # intersection * 100 >= union * 80
TILE = 1024                     # rows of a key compared at once, and bytes of their sets
TILE_BYTES = 64 << 20
STAR = 256                      # members compared with one centre in one group
BROADCAST_IDS = 2_000_000       # 8 bytes each; more are joined by a shuffle
_SLAB = 1024
_MULTIPLIERS = scramble(np.arange(1, POSITIONS + 1, dtype=U) * ODD) | U(1)


def chunks(positions=POSITIONS, radius: int = RADIUS) -> list[np.ndarray]:
    """Positions dealt to so many chunks that one has at most one of `radius` errors."""
    return np.array_split(np.arange(positions), radius // 2 + 1)


def signature(u: np.ndarray) -> np.ndarray:
    """16 bits of the smallest image of a set under each of 64 permutations."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, U)
    for i in range(0, len(u), _SLAB):
        least = np.minimum(least, (u[i:i + _SLAB, None] * _MULTIPLIERS[None, :]).min(axis=0))
    return (scramble(least) >> U(48)).astype(np.uint16)


def set_id(u: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(scramble(u).sum(dtype=U) ^ scramble(np.array([u.sum(dtype=U) + U(len(u))], U))[0])


def _ids(sets) -> pa.Array:
    return pa.array(np.array([set_id(u) for u in sets], U).view(np.int64))


def _sketch(words: int):
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), words)
            n, v, sig = [], [], []
            for u in sets:
                n.append(len(u))
                v.append(set_id(u))
                sig.append(signature(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.array(v, U).view(np.int64)),
                                              pa.array(sig, pa.binary())], ["id", "n", "v", "sig"])
    return run


def _keys(batches):
    """(key, id) for each chunk of a signature and each position left out of it."""
    cut = chunks()
    for b in batches:
        if b.num_rows == 0:
            continue
        s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS).astype(U)
        out = []
        for c, at in enumerate(cut):
            for left in at:
                k = np.full(len(s), c * POSITIONS + int(left) + 1, U)
                for p in at:
                    if p != left:
                        k = scramble(k * ODD + s[:, p])
                out.append((k & ~U(POSITIONS - 1)) | U(left))               # the low bits name the position left out
        ids = b.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(ids, len(out)))], ["key", "v"])


def _distance(batches):
    """Number of differing positions of two signatures."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, POSITIONS) for k in (2, 3))
        keep = (x != y).sum(axis=1) <= RADIUS
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])


def _first_key(differ: np.ndarray) -> np.ndarray:
    """For rows of differing positions: the position left out of the first key that both signatures share."""
    starts = np.array([c[0] for c in chunks()])
    errors = np.add.reduceat(differ, starts, axis=1, dtype=np.int64)
    c = (errors <= 1).argmax(axis=1)
    width = np.append(starts[1:], POSITIONS) - starts
    inside = (np.arange(POSITIONS)[None, :] >= starts[c][:, None]) & (np.arange(POSITIONS)[None, :] < (starts + width)[c][:, None])
    return np.where(errors[np.arange(len(c)), c] == 0, starts[c], (differ & inside).argmax(axis=1))


def _pairs(rows: pa.Table):
    """For each row of a tile its partners: near enough, of another component, and not met under an earlier key."""
    side, v, comp, n = (rows.column(k).to_numpy() for k in ("side", "v", "comp", "n"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
    i, j = (np.flatnonzero(side == k) for k in (0, 1))
    slot = rows.column("key")[0].as_py() & (POSITIONS - 1)
    same = rows.column("i")[0] == rows.column("j")[0]
    j = i if same else j
    for x in i:
        y = j[comp[j] != comp[x]]
        y = y[v[y] > v[x]] if same else y
        y = y[SIMILAR[1] * np.minimum(n[y], n[x]) >= SIMILAR[0] * np.maximum(n[y], n[x])]
        differ = sig[y] != sig[x]
        near = differ.sum(axis=1) <= RADIUS
        y, differ = y[near], differ[near]
        if len(y):
            y = y[_first_key(differ) == slot]
        if len(y):
            yield x, y


def _tiles(each, fields: list[str]):
    """Calls `each` on every tile; rows come sorted by tile, which has a bounded number of them. The last tile of a batch waits for the next."""
    def done(t, last):
        k = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        at = [0, *cut.tolist(), *([t.num_rows] if last else [])]
        found = [each(t.slice(x, y - x)) for x, y in zip(at[:-1], at[1:])]
        return t.slice(at[-1]), [x.select(fields) for x in found if x.num_rows]

    def run(batches):
        rest = None
        for x in batches:
            t = pa.Table.from_batches([x])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if t.num_rows:
                rest, found = done(t, False)
                for f in found:
                    yield from f.to_batches()
        if rest is not None and rest.num_rows:
            for f in done(rest, True)[1]:
                yield from f.to_batches()
    return run


def _wanted(rows: pa.Table) -> pa.Table:
    """The rows of a tile that have a partner."""
    keep = np.zeros(rows.num_rows, bool)
    for x, y in _pairs(rows):
        keep[x] = True
        keep[y] = True
    return rows.filter(pa.array(keep))


def _joined(rows: pa.Table) -> pa.Table:
    """Links that join components within a tile: whole sets of partners are compared until they are in one component."""
    v, n = rows.column("v").to_numpy(), rows.column("n").to_numpy()
    sets = [np.frombuffer(x, U) for x in rows.column("s").to_pylist()]
    _, own = np.unique(rows.column("comp").to_numpy(), return_inverse=True)
    root, a, b = np.arange(own.max() + 1), [], []
    for x, y in _pairs(rows):
        y = y[root[own[y]] != root[own[x]]]
        if not len(y):
            continue
        length = n[y]
        hit = np.concatenate([[0], np.cumsum(np.isin(np.concatenate([sets[k] for k in y]), sets[x], assume_unique=False))])
        ends = np.cumsum(length)
        both = hit[ends] - hit[ends - length]
        for k in y[SIMILAR[1] * both >= SIMILAR[0] * (length + n[x] - both)]:
            if root[own[k]] != root[own[x]]:
                root[root == root[own[k]]] = root[own[x]]
                a.append(min(v[x], v[k]))
                b.append(max(v[x], v[k]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(words: int):
    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(0), words))
            yield pa.RecordBatch.from_arrays([_ids(sets), pa.array([u.tobytes() for u in sets], pa.binary())], ["v", "s"])
    return run


def _confirm(batches):
    """Rows come sorted: each centre's set, then the sets to compare with it."""
    centre, mine = None, None
    for x in batches:
        a, b = [], []
        for c, salt, own, v, s in zip(*(x.column(k).to_pylist() for k in ("c", "salt", "own", "v", "s"))):
            s = np.frombuffer(s, U)
            if own == 0:
                centre, mine = (c, salt), s
            elif centre == (c, salt):
                union = len(np.union1d(s, mine))
                if SIMILAR[1] * (len(s) + len(mine) - union) >= SIMILAR[0] * union:
                    a.append(c)
                    b.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _built(pairs: DataFrame, vertices: DataFrame, base: DataFrame, words: int) -> DataFrame:
    """(v, s): the whole shingle sets of the vertices in `pairs`, built again from their texts."""
    asked = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct().join(vertices, "v").select("v", "rep").checkpoint()
    ids = asked.select(F.col("rep").alias("id")).distinct()
    ids = F.broadcast(ids) if asked.count() <= BROADCAST_IDS else ids
    sets = base.join(ids, "id", "left_semi").select("text").mapInArrow(_sets(words), "v long, s binary")
    # A key may have several texts, so sets are told apart by what they hold.
    return asked.select("v").join(sets.groupBy("v").agg(F.first("s").alias("s")), "v").checkpoint()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough: a set is sent to each centre that asks for it."""
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).withColumn("salts", F.ceil(F.col("k") / STAR).cast("int"))
    members = pairs.join(per, "a").select(F.col("b").alias("v"), F.col("a").alias("c"), F.lit(1).alias("own"),
                                          F.expr("int(pmod(xxhash64(b), salts))").alias("salt"))
    centres = per.select(F.col("a").alias("v"), F.col("a").alias("c"), F.lit(0).alias("own"),
                         F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    sent = members.unionByName(centres).join(sets, "v").repartition("c", "salt").sortWithinPartitions("c", "salt", "own")
    return sent.select("c", "salt", "own", "v", "s").mapInArrow(_confirm, "a long, b long").checkpoint()


def _near(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    for end in ("a", "b"):
        pairs = pairs.join(vertices.select(F.col("v").alias(end), F.col("n").alias(f"n{end}"), F.col("sig").alias(f"s{end}")), end)
    fits = SIMILAR[1] * F.least("na", "nb") >= SIMILAR[0] * F.greatest("na", "nb")
    return pairs.filter(fits).select("a", "b", "sa", "sb").mapInArrow(_distance, "a long, b long")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = (pairs.join(comp.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
                 .withColumn(f"c{end}", F.coalesce(f"c{end}", end)))
    return pairs.filter("ca <> cb").select("a", "b")


def _links(vertices: DataFrame, base: DataFrame, words: int) -> DataFrame:
    """Confirmed links (a, b) between sets: enough of them to connect whatever is linked."""
    by = W.partitionBy("key")
    keys = (vertices.select("v", "sig").mapInArrow(_keys, "key long, v long")
            .withColumns({"c": F.min("v").over(by), "k": F.count(F.lit(1)).over(by)}).filter("k > 1").checkpoint())
    # A centre per key; each set is first compared with one centre, then with those that it is still apart from.
    stars = _near(keys.filter("v <> c").select(F.col("c").alias("a"), F.col("v").alias("b")).distinct(), vertices).checkpoint()
    sets = _built(stars, vertices, base, words)
    one = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").checkpoint()
    links = _verified(one, sets)
    more = _apart(stars.join(one, ["a", "b"], "left_anti"), components(links)).checkpoint()
    links = links.unionByName(_verified(more, sets))
    comp = components(links)
    # What is left: partners in different components, none of them a centre. A pair belongs to the
    # first key that it shares. Rows without such a partner go first; sets are sent for the rest only,
    # and a tile returns no more links than it has components.
    def told(some, *of):
        named = some.join(comp.withColumnRenamed("id", "v"), "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        return named.join(vertices.select("v", *of), "v")

    shared = keys.filter("k > 2")
    mixed = (told(shared, "n").groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum("n").alias("all"))
             .filter("x <> y").select("key", "all").checkpoint())
    tile = ["key", "i", "j"]
    rows = (told(shared.join(mixed, "key"), "n", "sig")
            .withColumn("t", F.ceil(F.greatest(F.col("k") * 2 / TILE, F.col("all") * 16 / TILE_BYTES)).cast("int"))
            .withColumn("mine", F.expr("int(pmod(xxhash64(v), t))")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
            .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                    (F.col("mine") > F.col("other")).cast("int").alias("side"), "v", "comp", "n", "sig"))
    kind = "key long, i int, j int, side int, v long, comp long, n long, sig binary"
    rows = (rows.repartition(*tile).sortWithinPartitions(*tile)
            .mapInArrow(_tiles(_wanted, ["key", "i", "j", "side", "v", "comp", "n", "sig"]), kind).checkpoint())
    if rows.isEmpty():
        return links
    ends = rows.select("v").distinct().join(sets.select("v"), "v", "left_anti")
    new = _built(ends.select(F.col("v").alias("a"), F.col("v").alias("b")), vertices, base, words)
    rows = rows.join(sets.unionByName(new), "v").repartition(*tile).sortWithinPartitions(*tile)
    return links.unionByName(rows.mapInArrow(_tiles(_joined, ["a", "b"]), "a long, b long").checkpoint())


def near_duplicates(docs: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of `docs`.

    component_id is the smallest key reachable over links; kept marks rows whose key it is.
    A text without words has no set, is linked with nothing and is kept; with fewer than `words`
    words its whole sequence is the only shingle. A null key has a null component, is linked
    with nothing and is kept. Rows that repeat a key are one vertex with all their texts' links.
    `docs` may have any other columns; an empty table gives an empty result.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = base.mapInArrow(_sketch(words), "id long, n long, v long, sig binary").checkpoint()
    full = rows.filter("n > 0 AND id IS NOT NULL")
    vertices = full.groupBy("v").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")).checkpoint()
    links = _links(vertices, base, words)
    # Texts of one key belong together.
    several = full.groupBy("id").agg(F.min("v").alias("a"), F.max("v").alias("z")).filter("a <> z")
    own = full.join(several, "id").select("a", F.col("v").alias("b"))
    comp = components(links.unionByName(own)).withColumnRenamed("id", "v")
    heads = vertices.join(comp, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    least = heads.groupBy("comp").agg(F.min("rep").alias("component_id"))
    heads = heads.select("v", "comp").join(least, "comp").select(F.col("v").alias("in"), "component_id")
    grouped = rows.withColumn("in", F.when(F.expr("n > 0 AND id IS NOT NULL"), F.col("v")))
    out = grouped.join(heads, "in", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest key. Rows without words or key stay."""
    found = near_duplicates(docs, words, text, key).select(F.col(key).alias("__id"), "kept").checkpoint()
    drop = found.filter("NOT kept").select("__id").distinct()
    docs = docs.withColumn("__id", F.col(key))
    left = docs.join(drop, "__id", "left_anti")
    again = found.filter("kept AND __id IS NOT NULL").groupBy("__id").count().filter("count > 1").select("__id").checkpoint()
    if again.isEmpty():
        return left.drop("__id")
    once = left.join(again, "__id", "left_anti")
    return once.unionByName(left.join(again, "__id", "left_semi").dropDuplicates(["__id"])).drop("__id")
