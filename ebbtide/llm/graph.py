"""Connected components of a link table, by repeated joins on small rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_ROWS = 100_000     # links that one task takes
FEW_TASKS = 8           # tasks of a step, however few links there are


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of `links` (a, b): the smallest id that it is linked with, over any distance.

    Each round hooks a tree to the smallest root next to it and then shortens every path, so the
    number of rounds follows the logarithm of a component's size. Nothing is collected but the
    count of labels that changed. Null ends are ignored; no links give no rows.

    Every task of a step writes files for the next shuffle and for its checkpoint, so a step has
    no more tasks than the links need; with many links it has as many as the shuffle. A round is two
    jobs without a repeated step, for the driver holds every plan and plans it again after each stage.
    """
    e = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    tasks = max(FEW_TASKS, ceil(e.count() / TASK_ROWS))
    e = e.coalesce(tasks)
    label = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")).coalesce(tasks).checkpoint()
    while True:
        # The smallest label next to each vertex, told to the vertex and to its root.
        near = (e.join(label.select(F.col("id").alias("b"), F.col("comp").alias("to")), "b").coalesce(tasks)
                .groupBy("a").agg(F.min("to").alias("to")).join(label.select(F.col("id").alias("a"), "comp"), "a").coalesce(tasks))
        best = near.select(F.explode(F.array("a", "comp")).alias("id"), "to").groupBy("id").agg(F.min("to").alias("to"))
        hooked = label.join(best, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "to").alias("comp")).coalesce(tasks).checkpoint()
        new = (hooked.join(hooked.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp", "left")
               .select("id", "old", F.least("comp", "up").alias("comp"))).coalesce(tasks).checkpoint()
        changed = new.filter("comp <> old").limit(1).count()
        label = new.select("id", "comp")
        if not changed:
            return label
