"""Multiple testing, ranking metrics and comparison of edge sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjust(tests: DataFrame, p: str = "p", family: list[str] | None = None, dependent: bool = False) -> DataFrame:
    """Benjamini-Hochberg q values within a family, Benjamini-Yekutieli if `dependent`."""
    family = family or []
    by = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    m = F.count(F.lit(1)).over(by)
    rows = tests.withColumn("_m", m).withColumn("_r", F.row_number().over(by.orderBy(p)))
    scale = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, k: a + 1 / k) if dependent else F.lit(1.0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") * scale / F.col("_r")).over(by.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("q", q).drop("_m", "_r")


def e_bh(tests: DataFrame, e: str = "e", alpha: float = 0.05, ties: list[str] | None = None) -> DataFrame:
    """e-BH: the largest k with the k-th largest e value at least m / (alpha k); `selected` marks the k first, equal ones in the order of `ties`."""
    by = Window.partitionBy(F.lit(0))
    rows = tests.withColumn("_m", F.count(F.lit(1)).over(by)).withColumn("_k", F.row_number().over(by.orderBy(F.desc(e), *(ties or []))))
    last = F.max(F.when(F.col(e) >= F.col("_m") / (alpha * F.col("_k")), F.col("_k")).otherwise(0)).over(by)
    return rows.withColumn("selected", F.col("_k") <= last).drop("_m", "_k")


def roc_auc(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """Area under the ROC curve with average ranks."""
    r = Window.orderBy(score).partitionBy(F.lit(0))
    ties = Window.partitionBy(score)
    ranked = rows.select(truth.cast("int").alias("y"), (F.rank().over(r) + (F.count(F.lit(1)).over(ties) - 1) / 2).alias("rank"))
    a = ranked.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.col("rank") * F.col("y")).alias("s"))
    return a.select("p", "n", ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auroc"))


def score_edges(found: DataFrame, truth: DataFrame) -> DataFrame:
    """True and false positives, misses, precision and recall of edges (source, target)."""
    both = found.select("source", "target", F.lit(1).alias("f")).join(truth.select("source", "target", F.lit(1).alias("g")), ["source", "target"], "full_outer")
    tp, fp, fn = (F.count_if(c) for c in (F.col("f").isNotNull() & F.col("g").isNotNull(), F.col("g").isNull(), F.col("f").isNull()))
    return both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select("*", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))


def closure(arcs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Transitive closure of arcs (keys, source, target): paths are doubled until a round adds none. A round is cut from its history where the context has a checkpoint folder; only numbers of arcs reach the driver."""
    keys = keys or []
    closed = arcs.select(*keys, "source", "target").distinct()
    known = closed.count()
    while True:
        first, then = closed.withColumnRenamed("target", "_by"), closed.withColumnRenamed("source", "_by")
        closed = closed.unionByName(first.join(then, [*keys, "_by"]).select(*keys, "source", "target")).distinct()
        if arcs.sparkSession.sparkContext.getCheckpointDir():
            closed = closed.checkpoint()
        now = closed.count()
        if now == known:
            return closed
        known = now


def confounded(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, driver, a, b): children of one driver without an arc between them."""
    a, b = (arcs.select(*keys, F.col("source").alias("driver"), F.col("target").alias(c)).distinct() for c in "ab")
    pairs = a.join(b, [*keys, "driver"]).where("a != b")
    for x, y in (("a", "b"), ("b", "a")):
        pairs = pairs.join(arcs.select(*keys, F.col("source").alias(x), F.col("target").alias(y)), [*keys, "a", "b"], "left_anti")
    return pairs.select(*keys, "driver", "a", "b")


def relation(triples: DataFrame, ancestors: DataFrame, keys: list[str]) -> DataFrame:
    """How z stands to source and target: `confounded` if an ancestor of both, `mediated` if it lies between, else `explained`. `ancestors` is a transitive closure (keys, source, target)."""
    for name, x, y in (("_zs", "z", "source"), ("_zt", "z", "target"), ("_sz", "source", "z")):
        seen = ancestors.select(*keys, F.col("source").alias("_x"), F.col("target").alias("_y"), F.lit(True).alias(name))
        triples = triples.withColumn("_x", F.col(x)).withColumn("_y", F.col(y)).join(seen, [*keys, "_x", "_y"], "left").drop("_x", "_y")
    out = F.when(F.col("_zs") & F.col("_zt"), "confounded").when(F.col("_sz") & F.col("_zt"), "mediated").otherwise("explained")
    return triples.select(*keys, "z", "source", "target", out.alias("relation"))


def average_precision(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """Average precision, equal scores in the worst order: the false ones first."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), "y")
    ranked = rows.select(score, truth.cast("int").alias("y")).withColumn("k", F.row_number().over(order)).withColumn("hits", F.sum("y").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.agg(F.sum("y").alias("p"), (F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("k"))) / F.sum("y")).alias("ap"))
