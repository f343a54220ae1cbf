"""Precision and recall of rankings against relevance.  rankings: topic, doc, score; qrels: topic, doc, rel (over 0 is relevant), or `SameClass`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sampling import number_of
from tessera.operators.storage import running


class SameClass:
    """Relevance by class, in place of qrels: relevant to a topic are the other docs of its classes.

    classes: doc, class (a doc may have several).  The pairs, as many as the squares of the classes' sizes, are never made: a ranked pair is
    looked up by its two docs, and a topic's relevant docs are its class's size; only topics of several classes count their docs."""

    def __init__(self, classes: DataFrame):
        self.members = classes.where("doc is not null and class is not null").select("doc", "class").distinct()
        self.sets = self.members.groupBy("doc").agg(F.collect_set("class").alias("classes"))

    def marked(self, rankings: DataFrame) -> DataFrame:
        own = self.sets.select(F.col("doc").alias("topic"), F.col("classes").alias("_own"))
        other = self.sets.select("doc", F.col("classes").alias("_other"))
        rel = F.when(F.arrays_overlap("_own", "_other") & (F.col("topic") != F.col("doc")), 1)
        return rankings.join(own, "topic", "left").join(other, "doc", "left").select("topic", "doc", "score", rel.alias("rel"))

    def totals(self) -> DataFrame:
        sizes = self.members.groupBy("class").agg(F.count("*").alias("n"))
        one = self.sets.where(F.size("classes") == 1).select(F.col("doc").alias("topic"), F.col("classes")[0].alias("class"))
        several = self.sets.where(F.size("classes") > 1).select(F.col("doc").alias("topic"), F.explode("classes").alias("class"))
        counted = several.join(self.members, "class").groupBy("topic").agg((F.count_distinct("doc") - 1).alias("relevant"))
        return one.join(sizes, "class").select("topic", (F.col("n") - 1).alias("relevant")).unionAll(counted).where("relevant > 0")


def judged(rankings: DataFrame, qrels: DataFrame | SameClass) -> DataFrame:
    """topic, doc, rank, rel, hits (running), prec, rec, relevant (of the topic): by descending score, then doc."""
    if isinstance(qrels, SameClass):
        marked, total = qrels.marked(rankings), qrels.totals()
    else:
        rel = qrels.where("rel > 0").select("topic", "doc", F.lit(1).alias("rel")).distinct()
        marked, total = rankings.select("topic", "doc", "score").join(rel, ["topic", "doc"], "left"), rel.groupBy("topic").agg(F.count("*").alias("relevant"))
    w = Window.partitionBy("topic").orderBy(F.col("score").desc(), F.col("doc"))
    rows = marked.withColumn("rank", F.row_number().over(w))
    rows = rows.withColumn("hits", F.sum(F.coalesce("rel", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(total, "topic", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    recall = F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(1.0)
    return rows.select("topic", "doc", "rank", F.coalesce("rel", F.lit(0)).alias("rel"), "hits", (F.col("hits") / F.col("rank")).alias("prec"), recall.alias("rec"), "relevant")


def summary(rankings: DataFrame, qrels: DataFrame | SameClass, ignore_missing: bool = True) -> DataFrame:
    """topic, relevant, rel_returned, returned, ap; topics without results have ap 0 and count unless ignore_missing."""
    j = judged(rankings, qrels)
    ap = F.sum(F.when(F.col("rel") == 1, F.col("prec")).otherwise(0.0)) / F.nullif(F.max("relevant"), F.lit(0))
    out = j.groupBy("topic").agg(F.max("relevant").alias("relevant"), F.sum("rel").alias("rel_returned"), F.count("*").alias("returned"), F.coalesce(ap, F.lit(0.0)).alias("ap"))
    if ignore_missing:
        return out
    wanted = qrels.totals() if isinstance(qrels, SameClass) else qrels.where("rel > 0").groupBy("topic").agg(F.count_distinct("doc").alias("relevant"))
    missing = wanted.join(out.select("topic"), "topic", "left_anti")
    return out.unionByName(missing.select("topic", "relevant", F.lit(0).cast("long").alias("rel_returned"), F.lit(0).cast("long").alias("returned"), F.lit(0.0).alias("ap")))


def overall(per_topic: DataFrame) -> DataFrame:
    return per_topic.agg(F.sum("relevant").alias("relevant"), F.sum("rel_returned").alias("rel_returned"), F.sum("returned").alias("returned"), F.avg("ap").alias("map"), F.count("*").alias("topics"))


def interpolated(rankings: DataFrame, qrels: DataFrame | SameClass, points: int = 11) -> DataFrame:
    """topic, recall (i / (points - 1)), prec: the greatest precision at that recall or more, 0 where it isn't reached."""
    j = judged(rankings, qrels)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    topics = j.select("topic").distinct().select("topic", grid)
    # each row serves the grid points up to its recall: its precision goes to the last of them, and a suffix maximum spreads it
    top = j.groupBy("topic", F.floor(F.round(F.col("rec") * (points - 1), 9)).cast("int").alias("i")).agg(F.max("prec").alias("p"))
    w = Window.partitionBy("topic").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    rows = topics.join(top, ["topic", "i"], "left").withColumn("prec", F.coalesce(F.max("p").over(w), F.lit(0.0)))
    return rows.select("topic", (F.col("i") / (points - 1)).alias("recall"), "prec")


def suffix_maximum(j: DataFrame) -> DataFrame:
    """Judged rows with iprec: the greatest precision from here on."""
    return j.withColumn("iprec", F.max("prec").over(Window.partitionBy("topic").orderBy("rank").rowsBetween(0, Window.unboundedFollowing)))


def precision_at(rankings: DataFrame, qrels: DataFrame | SameClass, ranks: list[int]) -> DataFrame:
    """topic, rank, prec; 0 where a topic has fewer results."""
    j = judged(rankings, qrels)
    wanted = j.select("topic").distinct().select("topic", F.explode(F.array(*map(F.lit, ranks))).alias("rank"))
    return wanted.join(j.where(F.col("rank").isin(ranks)).select("topic", "rank", "prec"), ["topic", "rank"], "left").select("topic", "rank", F.coalesce("prec", F.lit(0.0)).alias("prec"))


def stepped(rankings: DataFrame, qrels: DataFrame | SameClass, steps: int = 10) -> DataFrame:
    """topic, ap: mean of interpolated precision over steps + 1 grid points."""
    return interpolated(rankings, qrels, steps + 1).groupBy("topic").agg(F.avg("prec").alias("ap"))


def unanswered(queries: DataFrame, rankings: DataFrame) -> DataFrame:
    """Queries (topic) without any result."""
    return queries.select("topic").join(rankings.select("topic").distinct(), "topic", "left_anti")


def bootstrap(rows: DataFrame, columns: list[str], id_: str = "topic", samples: int = 200, lower: float = 0.05, upper: float = 0.95, seed: int = 0) -> DataFrame:
    """column, mean, lower, upper: of the means of `samples` resamples with replacement; bounds are the sorted means' elements at
    floor(bound * samples).

    A row is drawn a Poisson-free way: each resample's draws are hashed row numbers, so rows are counted, not copied per resample.  They are
    counted as numbered, in the shared folder: what makes them, such as a ranking, is worked out once."""
    numbered = running(rows.select(F.col(id_).alias("_id"), *columns, F.lit(1).alias("_one")), "_id", "_one", "no").select(F.col("no").cast("int").alias("no"), *columns)
    n = numbered.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "column string, mean double, lower double, upper double")
    draws = rows.sparkSession.range(samples * n).select((F.col("id") % samples).alias("b"), (number_of("id", seed) % n + 1).cast("int").alias("no"))
    draws = draws.groupBy("b", "no").agg(F.count("*").alias("times"))
    long = numbered.select("no", F.explode(F.create_map(*[v for c in columns for v in (F.lit(c), F.col(c).cast("double"))])).alias("column", "value"))
    means = draws.join(long, "no").groupBy("b", "column").agg((F.sum(F.col("value") * F.col("times")) / n).alias("m"))
    ranked = means.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("m", "b")) - 1)
    at = lambda p: F.max(F.when(F.col("r") == min(samples - 1, int(p * samples)), F.col("m")))
    bounds = ranked.groupBy("column").agg(at(lower).alias("lower"), at(upper).alias("upper"))
    return long.groupBy("column").agg(F.avg("value").alias("mean")).join(bounds, "column").select("column", "mean", "lower", "upper")
