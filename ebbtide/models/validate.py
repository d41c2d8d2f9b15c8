"""Owner-grouped validation: no owner on both sides of a split."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ebbtide.config import INSTANT_COLUMNS, PanelConfig
from ebbtide.functions import scalars as S
from ebbtide.models.base import Profile
from ebbtide.models.survival import HazardForest, blend, fade_by
from ebbtide.operators.skew import running, split_hot
from ebbtide.operators.survival import average_curve
from ebbtide.operators.tables import model_rows
from ebbtide.session import cut_lineage


def group_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Owner to fold: owners by falling size are dealt out to and fro (0..k-1, k-1..0, …).

    Two folds then differ by the size of the largest owner at most, and the rule is the same at any number of
    owners: ranks come from a distributed running count. With fewer owners than folds there is one fold per owner.
    """
    sizes = df.filter(F.col("owner").isNotNull()).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes.withColumn("_o", F.struct((-F.col("n")).alias("n"), "owner")))
    owners = sizes.count()
    if owners < 2:
        raise ValueError(f"{owners} owner(s): a grouped split needs at least two")
    k = min(k, owners)
    g = running(split_hot(sizes, [], "_o"), ["_o"], {"_i": ("sum", F.lit(1))})
    i = F.col("_i") - 1
    place, back = F.pmod(i, F.lit(k)), F.floor(i / k) % 2 == 1
    return g.df.select("owner", F.when(back, k - 1 - place).otherwise(place).cast("int").alias("fold"))


def assert_no_owner_leakage(folded: DataFrame) -> DataFrame:
    """Raise if any owner lies in more than one fold."""
    bad = (folded.groupBy("owner").agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
           .filter("a <> b").limit(3).collect())
    if bad:
        raise AssertionError(f"owners in several folds: {[r['owner'] for r in bad]}")
    return folded


def grouped_cv(models: list, frame: DataFrame, k: int = 5) -> DataFrame:
    """Stacked out-of-fold predictions of every model.

    `frame` is read once, the folded table once per model and fold. Folds are fitted side by side, for a boosted
    model is a long row of small jobs; models marked `alone` (forests, which hold their rows
    for all trees at once) one at a time. Predictions that are not positive numbers become the training fold's median.
    """
    folded = assert_no_owner_leakage(cut_lineage(frame.join(group_folds(frame, k), "owner")))
    folds = sorted(r[0] for r in folded.select("fold").distinct().collect())       # at most k values
    turn = Lock()

    def fit(f: int) -> list[DataFrame]:
        train, test = folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)
        profile = Profile.of(train, [c for m in models for c in m.features])      # shared by all models
        fallback = profile.median_duration
        out = []
        for m in models:
            with turn if getattr(m, "alone", False) else nullcontext():
                p = m.fit(train, profile).predict(test)
            good = S.finite("predicted")
            out.append(p.select("fold", "entity", "owner", "duration", "event", F.lit(m.name).alias("model"),
                                F.when(good > 0, good).otherwise(F.lit(fallback)).alias("predicted")))
        return out

    with ThreadPoolExecutor(max(len(folds), 1)) as pool:
        parts = [p for fitted in pool.map(inheritable_thread_target(frame.sparkSession)(fit), folds) for p in fitted]
    return reduce(DataFrame.unionByName, parts)


def held_out_owner_predictions(train: DataFrame, test: DataFrame, cfg: PanelConfig = PanelConfig(),
                               b: float = 1.0, trees: int = 300, groups: int = 5) -> DataFrame:
    """Predict every row with a forest that never saw its owner.

    Owners fall into fixed hash groups; each group is predicted by a model of
    the training rows minus the group's owners. Adds raw_h, p_h and avg_h (the
    training rows' average curve) for each horizon.
    """
    test = test.withColumn("_g", S.owner_fold("owner", groups))
    present = sorted(r[0] for r in test.select("_g").distinct().collect())          # at most `groups` values
    out = None
    for g in present:
        te = test.filter(F.col("_g") == g).drop("_g")
        tr = train.join(te.select("owner").distinct(), "owner", "left_anti")
        out_g = instant_predictions(tr, te, cfg, b, trees)
        out = out_g if out is None else out.unionByName(out_g)
    return out


def instant_predictions(train: DataFrame, test: DataFrame, cfg: PanelConfig = PanelConfig(),
                        b: float = 1.0, trees: int = 300) -> DataFrame:
    """One forest on the checkpoint rows of `train`, scored on `test`."""
    rows = model_rows(train, cfg).withColumns({"duration": F.col("fade_h"), "event": F.col("faded")})
    fitted = HazardForest(list(INSTANT_COLUMNS), list(cfg.marks), trees=trees, seed=cfg.seed).fit(rows)
    avg = average_curve(rows, cfg)
    if not hasattr(fitted, "curve"):
        raise ValueError("too few observed ends to train on")
    d = fitted.curve(test, "_raw").crossJoin(F.broadcast(avg))                      # one row
    d = d.withColumn("_p", blend("_raw", "average", b))
    cols = {}
    for h in cfg.horizons:
        for name, curve in (("raw", "_raw"), ("p", "_p"), ("avg", "average")):
            cols[f"{name}_{h:g}"] = fade_by(curve, cfg.marks, h)
    return d.withColumns(cols).drop("_raw", "_p", "average")


def null_outcome(frame: DataFrame, seed: int, horizon: float = 336.0, owner_sd: float = 1.5,
                 row_sd: float = 0.4) -> DataFrame:
    """Replace the outcome by noise that only depends on the owner.

    The owner's size is replaced by an owner fingerprint. A model scoring above
    chance on this table recognises owners across folds: the split leaks.
    Noise is a function of (seed, id), so rows of one owner agree anywhere.
    """
    u = lambda tag, key: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.col(key)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda tag, key: (F.sqrt(-2 * F.ln(u(tag + "r", key))) * F.cos(2 * F.pi() * u(tag + "a", key)))
    t = F.exp(3.0 + owner_sd * normal("owner", "owner") + row_sd * normal("row", "entity"))
    return frame.withColumns({"log_follower_count": normal("print", "owner"), "_t": t}).withColumns({
        "duration": F.least("_t", F.lit(horizon)), "event": F.col("_t") <= horizon}).drop("_t")
