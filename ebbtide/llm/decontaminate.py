"""Benchmark decontamination by template windows, also for re-parameterised questions.

Numbers, names and units become typed placeholders. Five-token windows of the resulting
templates are hashed and joined with the benchmark's. A pair of document and item whose shared
windows cover enough of the item is then checked slot by slot: in one way of laying the item over
the document, each of the item's slot values must stand for one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS = 5
COVER = 0.5             # share of an item's windows that a document must hold
CONSISTENT = 0.8        # share of the item's distinct slot values with one counterpart
MOST_PLACEHOLDERS = 3   # windows with more of them say nothing about an item
SENTENCE = 3            # tokens from which an item shorter than a window is also looked for among sentences and lines
BROADCAST_WINDOWS = 500_000

# Units that may follow a number.
UNITS = ("km", "m", "cm", "mm", "mi", "ft", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "sec", "min", "h", "hr", "hours",
         "hour", "minutes", "seconds", "days", "day", "weeks", "years", "usd", "eur", "dollars", "euros", "cents", "percent",
         "miles", "meters", "metres", "feet", "pounds", "liters", "litres", "kmh", "mph")
NAME, NUMBER, UNIT = "\u0002", "\u0003", "\u0004"


def _tokens(text) -> Column:
    """Tokens in order; placeholders start with their type's mark and keep the value.

    A name is a capitalised word inside a sentence; a capital after a full stop, a mark or a
    line's end is no sign of one.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, f"(?<=[0-9])[\\x20]?((?i:{'|'.join(UNITS)}))(?![\\p{{L}}\\p{{N}}])", f" {UNIT}$1")
    t = F.regexp_replace(t, r"(?<![0-9])[0-9]++(?:[.,][0-9]++)*+", f" {NUMBER}$0 ")
    t = F.regexp_replace(t, r"(?<=[^.!?:\s][\x20])(?=\p{Lu})", NAME)
    sep = f"(?:[^\\p{{L}}\\p{{N}}{NAME}{NUMBER}{UNIT}.,]|[.,](?![0-9])|(?<![0-9])[.,])++"
    return F.filter(F.split(F.lower(t), sep), lambda x: x != "")


def _kind(x) -> Column:
    return F.when(x < "\u0005", F.substring(x, 1, 1)).otherwise(x)


def _windows(tokens: str, n: int, values: bool = False) -> Column:
    """Hash of every window of `n` template tokens, or of the tokens with their values; none if there are fewer."""
    c = f"`{tokens}`" if values else f"transform(`{tokens}`, x -> CASE WHEN x < '\u0005' THEN substr(x, 1, 1) ELSE x END)"
    at = ", ".join(f"c[i + {j}]" for j in range(n))
    return F.expr(f"""CASE WHEN size(`{tokens}`) >= {n} THEN element_at(transform(array({c}), c ->
        transform(sequence(0, size(c) - {n}), i -> xxhash64({at}))), 1) ELSE cast(array() AS array<bigint>) END""")


def _slots(df: DataFrame, keys: list[str], tokens: str, pos: str, value: str) -> DataFrame:
    """(keys, position, value) of every placeholder."""
    out = df.select(*keys, F.posexplode(F.col(tokens)).alias(pos, value))
    return out.filter(F.col(value) < "\u0005")


def _alignments(here: DataFrame) -> DataFrame:
    """(row, item_id, kind, n, h, pos, ipos): ways to lay an item over a document, one kind of way each.

    0: everything shared at once. 1: one shift between document and item. 2: chains, for copies with
    words put in or left out: every document position goes to the item position whose shift holds
    most windows, and a step back in the item starts another chain.
    """
    shift = (F.col("pos") - F.col("ipos")).cast("long")
    by_shift = here.withColumn("n", shift)
    held = by_shift.groupBy("row", "item_id", "n").agg(F.count(F.lit(1)).alias("k"))
    chosen = (by_shift.join(held, ["row", "item_id", "n"]).groupBy("row", "item_id", "h", "pos")
              .agg(F.min(F.struct(-F.col("k"), "n", "ipos")).alias("x")).select("row", "item_id", "h", "pos", "x.ipos"))
    order = W.partitionBy("row", "item_id").orderBy("pos")
    back = (F.col("ipos") <= F.lag("ipos").over(order)).cast("long")
    chains = (chosen.withColumn("back", F.coalesce(back, F.lit(0).cast("long"))).withColumn("n", F.sum("back").over(order)).drop("back"))
    kinds = [here.withColumn("n", F.lit(0).cast("long")), by_shift, chains]
    cols = ["row", "item_id", "n", "h", "pos", "ipos"]
    out = [k.select(F.lit(i).alias("kind"), *cols) for i, k in enumerate(kinds)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _verbatim(d: DataFrame, bare: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, item_id, windows, of, slots, agree): documents that hold the whole token sequence of an item, with its values.

    The item's first `words` tokens say where to look; the rest is compared there.
    """
    heads = bare.select("item_id", F.col("tok").alias("item"), F.xxhash64(*[F.col("tok")[j] for j in range(words)]).alias("h"))
    wanted = heads.select("h").distinct()
    wanted = F.broadcast(wanted) if heads.count() <= BROADCAST_WINDOWS else wanted
    near = (d.select("doc_id", "row", F.posexplode(_windows("tok", words, values=True)).alias("pos", "h")).join(wanted, "h", "left_semi")
            .distinct().checkpoint())
    asked = near.select("row").distinct()
    asked = F.broadcast(asked) if near.count() <= BROADCAST_WINDOWS else asked
    texts = d.select("row", "t").join(asked, "row", "left_semi").dropDuplicates(["row"]).select("row", _tokens(F.col("t")).alias("tok"))
    found = (near.join(heads, "h").groupBy("doc_id", "row", "item_id", "item").agg(F.collect_set("pos").alias("at")).join(texts, "row")
             .filter(F.exists("at", lambda p: F.slice("tok", p + 1, F.size("item")) == F.col("item"))))
    n = (F.size("item") - words + 1).cast("long")
    slots = F.size(F.array_distinct(F.filter("item", lambda x: x < "\u0005"))).cast("long")
    return (found.select("doc_id", "row", "item_id", n.alias("windows"), n.alias("of"), slots.alias("slots"), slots.alias("agree"))
            .dropDuplicates(["row", "item_id"]))


def _short(d: DataFrame, brief: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, item_id, windows, of, slots, agree): documents that are an item shorter than a window, with its values.

    From SENTENCE tokens on, one sentence or line of a document will do. The item counts as one window.
    """
    items = brief.select("item_id", "tok")
    items = F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items
    parts = F.split("t", r"(?<=[.!?])\s++|[\r\n]++")
    whole = d.select("doc_id", "row", "tok", F.lit(True).alias("whole"))
    pieces = d.select("doc_id", "row", F.explode(F.array_distinct(parts)).alias("t")).select(
        "doc_id", "row", _tokens(F.col("t")).alias("tok"), F.lit(False).alias("whole"))
    held = whole.unionByName(pieces).filter(F.size("tok").between(1, words - 1) & (F.col("whole") | (F.size("tok") >= SENTENCE)))
    slots = F.size(F.array_distinct(F.filter("tok", lambda x: x < "\u0005"))).cast("long")
    one = F.lit(1).cast("long")
    return (held.join(items, "tok").select("doc_id", "row", "item_id", one.alias("windows"), one.alias("of"), slots.alias("slots"), slots.alias("agree"))
            .dropDuplicates(["row", "item_id"]))


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, cover: float = COVER, consistent: float = CONSISTENT,
          text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of document and benchmark item: key, row (hash of key and text), item_id, windows, of, slots, agree.

    `of` counts all different windows of an item, those with more than MOST_PLACEHOLDERS placeholders
    too, though these are not looked for. An item of which they leave less than `cover` matches with
    its own values only, as a whole. An item with fewer than `words` tokens matches a text, from SENTENCE
    tokens on also a sentence or line, of the same tokens and values. An item without a token or id
    never matches, nor does a null text. Items of equal text each match, and of texts that
    share an item's id the one covered best is shown. Rows that share a key but not
    their text are told apart by `row`; repeated rows give one pair. Empty tables give no pairs.
    windows, slots and agree are those of the alignment that was kept.

    Steps are cut by checkpoints, so that no plan repeats an earlier one: the driver holds every plan of
    a job and plans it again after each of its stages.
    """
    row = F.xxhash64(F.col(key), F.col(text))
    # Texts that share an item's id are looked for one by one.
    b = (benchmark.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("id"), F.col(item_text).alias("t")).agg(F.lit(1))
         .select("id", F.xxhash64("id", "t").alias("item_id"), _tokens(F.col("t")).alias("tok")).checkpoint())
    names = b.select("id", "item_id")
    windows = b.withColumn("few", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("tok") - words)), lambda i: F.size(
        F.filter(F.slice("tok", i + 1, words), lambda x: x < "\u0005")) <= MOST_PLACEHOLDERS)).withColumn("h", _windows("tok", words))
    every = windows.select("item_id", F.posexplode(F.arrays_zip("h", "few")).alias("ipos", "x")).filter("x.h IS NOT NULL").select("item_id", "ipos", "x.h", "x.few").checkpoint()
    kept, kept_places = F.countDistinct(F.expr("CASE WHEN few THEN h END")), F.sum(F.col("few").cast("long"))
    of = (every.groupBy("item_id").agg(F.countDistinct("h").alias("of"), kept.alias("kept"), (kept_places / F.count(F.lit(1))).alias("places"))
          .filter((F.col("kept") >= F.col("of") * cover) & (F.col("places") >= cover)).select("item_id", "of").checkpoint())
    w = every.filter("few").join(of, "item_id", "left_semi").select("item_id", "ipos", "h").checkpoint()
    n_windows = w.count()                                               # decides on the broadcast, not on the answer
    wanted = w.select("h").distinct()
    wanted = F.broadcast(wanted) if n_windows <= BROADCAST_WINDOWS else wanted

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"), row.alias("row")).withColumn("tok", _tokens(F.col("t")))
    hits = (d.select("doc_id", "row", F.posexplode(_windows("tok", words)).alias("pos", "h")).join(wanted, "h", "left_semi")
            .distinct().checkpoint())                                   # repeated rows end here; a few rows per leak
    # Windows that an item holds twice, or a document, count once.
    pairs = (hits.select("doc_id", "row", "h").distinct().join(w.select("item_id", "h").distinct(), "h")
             .groupBy("doc_id", "row", "item_id").agg(F.count(F.lit(1)).alias("windows")).join(of, "item_id")
             .filter(F.col("windows") >= F.col("of") * cover))
    # Slots of the documents in question only.
    pairs = pairs.checkpoint()
    asked = pairs.select("row").distinct()
    asked = F.broadcast(asked) if pairs.count() <= BROADCAST_WINDOWS else asked
    texts = d.select("row", "t").join(asked, "row", "left_semi").dropDuplicates(["row"])
    dslots = _slots(texts.select("row", _tokens(F.col("t")).alias("tok")), ["row"], "tok", "p", "dv")
    islots = _slots(b, ["item_id"], "tok", "q", "iv")
    spread = F.explode(F.sequence(F.lit(0), F.lit(words - 1)))
    here = hits.join(w, "h").join(pairs.select("row", "item_id"), ["row", "item_id"]).select("row", "item_id", "h", "pos", "ipos").checkpoint()
    at = _alignments(here).checkpoint()
    covered = at.groupBy("row", "item_id", "kind", "n").agg(F.countDistinct("h").alias("windows")).join(of, "item_id").filter(F.col("windows") >= F.col("of") * cover).checkpoint()
    matched = (at.join(covered.select("row", "item_id", "kind", "n"), ["row", "item_id", "kind", "n"]).select("row", "item_id", "kind", "n", "pos", "ipos", spread.alias("j"))
               .select("row", "item_id", "kind", "n", (F.col("pos") + F.col("j")).alias("p"), (F.col("ipos") + F.col("j")).alias("q"))
               .join(islots, ["item_id", "q"]).join(dslots, ["row", "p"])
               .groupBy("row", "item_id", "kind", "n", "iv").agg((F.min("dv") == F.max("dv")).alias("one"))
               .groupBy("row", "item_id", "kind", "n").agg(F.count(F.lit(1)).alias("slots"), F.sum(F.col("one").cast("int")).alias("agree")))
    # The alignment that covers most of the item stands for the pair.
    best = (covered.join(matched, ["row", "item_id", "kind", "n"], "left").fillna(0, ["slots", "agree"])
            .filter(F.col("agree") >= F.col("slots") * consistent)
            .groupBy("row", "item_id").agg(F.max(F.struct("windows", "agree", "slots")).alias("x")))
    out = pairs.select("doc_id", "row", "item_id", "of").join(best, ["row", "item_id"]).select(
        "doc_id", "row", "item_id", "x.windows", "of", "x.slots", "x.agree").checkpoint()
    bare = b.filter(F.size("tok") >= words).join(of, "item_id", "left_anti").checkpoint()
    if not bare.isEmpty():
        out = out.unionByName(_verbatim(d, bare, words).checkpoint())
    brief = b.filter(F.size("tok").between(1, words - 1))
    if not brief.isEmpty():
        out = out.unionByName(_short(d, brief, words).checkpoint())
    names = F.broadcast(names) if names.count() <= BROADCAST_WINDOWS else names
    best = F.max(F.struct((F.col("windows") / F.col("of")).alias("share"), "windows", "of", "slots", "agree")).alias("x")
    out = out.join(names, "item_id").groupBy("doc_id", "row", F.col("id").alias("item_id")).agg(best)
    return out.select(F.col("doc_id").alias(key), "row", "item_id", "x.windows", "x.of", "x.slots", "x.agree")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """`docs` without the rows that hold a benchmark item."""
    found = leaks(docs, benchmark, text=text, key=key, **how).select(F.col("row").alias("__found"), F.col(key).alias("__key")).distinct().checkpoint()
    rows = docs.withColumn("__row", F.xxhash64(F.col(key), F.col(text)))
    return rows.join(found, (F.col("__row") == F.col("__found")) & F.col(key).eqNullSafe(F.col("__key")), "left_anti").drop("__row")
