"""Connected components: vertices hook onto the least label near them, and paths of labels are halved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.errors import ConvergenceFailure
from tropica.plans.fixpoint import released, written


def label_round(both: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(id, label, fell) after one round over both directions of the links (u, v).

    The least label of a vertex's neighbours goes to the vertex and to the vertex that it is labelled by; then every
    label is replaced by its own label. Links only send to a pre-aggregated minimum, and nothing of their size is kept."""
    near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
    heard = labels.select("id", "label").join(near, F.col("id") == F.col("u"), "left").select("id", "label", F.least("label", "near").alias("new"))
    sent = heard.select("id", "label", "new").unionByName(heard.where("new < label").select(F.col("label").alias("id"), F.lit(None).cast("long").alias("label"), "new"))
    hooked = sent.groupBy("id").agg(F.max("label").alias("label"), F.min("new").alias("new"))
    over = hooked.select(F.col("id").alias("at"), F.col("new").alias("further"))
    short = hooked.join(over, F.col("new") == F.col("at")).select("id", "label", F.least("new", "further").alias("new"))
    return short.select("id", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("fell"))


def components(links: DataFrame, most: int = 100, symmetric: bool = False) -> DataFrame:
    """(id, component) of every id in links(u, v) that has a smaller one in its component; component is the least id reachable.

    Direction, repeats and self-links don't matter; symmetric says that links holds both directions already. Ids that
    are the least of their component are not listed."""
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    both = written(links if symmetric else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    # Each vertex starts below the least of its neighbours.
    first = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label"))
    labels = written(first.select(F.col("u").alias("id"), "label", F.lit(True).alias("fell")), "labels")
    for _ in range(most):
        if labels.where("fell").isEmpty():
            released(both)
            return labels.where("label < id").select("id", F.col("label").alias("component"))
        last, labels = labels, written(label_round(both, labels), "labels")
        released(last)
    raise ConvergenceFailure(f"components still change after {most} rounds")
