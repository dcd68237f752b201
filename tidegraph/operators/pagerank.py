"""PageRank: power iteration, personalised, and incremental by residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.links import Links
from tidegraph.plans.storage import cut, watched

DAMPING = 0.85


def _weights(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst, share): a source's rank is dealt evenly over its edges, parallel ones each counting."""
    pairs = edges.groupBy(*by, "src", "dst").agg(F.count("*").alias("n"))
    out = edges.groupBy(*by, "src").agg(F.count("*").alias("out"))
    return pairs.join(out, [*by, "src"]).select(*by, "src", "dst", (F.col("n") / F.col("out")).alias("share"))


def pagerank(edges: DataFrame, vertices: DataFrame, rounds: int = 50, damping: float = DAMPING, sources: list | None = None, tolerance: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """(id, score), scores adding up to 1.

    A vertex without out-edges gives its rank to all other vertices evenly (to itself if it is alone). sources: ranks
    start and jump there only, evenly. tolerance: stop before `rounds` once the summed change is below. by: columns of
    edges and vertices that separate graphs which are solved together (such as a snapshot's id).
    """
    by = by or []
    links = Links(_weights(edges, by), [*by, "src"])
    sinks = links.table.select(*by, F.col("src").alias("id")).distinct().withColumn("_has", F.lit(True))
    target = F.col("id").isin(list(sources)) if sources is not None else F.lit(True)
    sizes = vertices.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(target).alias("k"))
    on = lambda a, b: a.join(F.broadcast(b), by) if by else a.join(F.broadcast(b), F.lit(True))  # noqa: E731  one row for each graph
    base = on(vertices.select(*by, "id"), sizes).join(sinks, [*by, "id"], "left")
    jump = F.when(target, 1.0 / F.greatest(F.col("k"), F.lit(1))).otherwise(F.lit(0.0))
    now = cut(base.select(*by, "id", "n", F.col("_has").isNull().alias("sink"), jump.alias("jump"), jump.alias("score")))
    for _ in range(rounds):
        lost = now.groupBy(*by).agg(F.sum(F.when(F.col("sink"), F.col("score")).otherwise(0.0)).alias("lost"))
        sent = links.send(now.where("not sink").select(*by, F.col("id").alias("src"), "score"), lambda x: x.select(*by, F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("flow")))
        mail = sent.groupBy(*by, "id").agg(F.sum("flow").alias("flow"))
        own = F.when(F.col("sink"), F.col("score")).otherwise(0.0)
        shared = F.when(F.col("n") > 1, (F.col("lost") - own) / (F.col("n") - 1)).otherwise(F.col("lost"))
        new = (1 - damping) * F.col("jump") + damping * (F.coalesce("flow", F.lit(0.0)) + shared)
        met = on(now.join(mail, [*by, "id"], "left"), lost)
        now = cut(met.select(*by, "id", "n", "sink", "jump", new.alias("score"), F.col("score").alias("last")), now, {"moved": F.sum(F.abs(F.col("score") - F.col("last")))} if tolerance else None)
        if tolerance and (watched(now)["moved"] or 0.0) < tolerance:
            break
    links.close()
    return now.select(*by, "id", "score")


def pagerank_from(edges: DataFrame, vertices: DataFrame, before: DataFrame | None = None, epsilon: float = 1e-9, damping: float = DAMPING, max_rounds: int = 1000) -> DataFrame:
    """(id, score) continued from an earlier result: only residuals above epsilon move along edges.

    Whatever edges came or went, the residual of the earlier scores in the new graph is what one step would change;
    pushing it until none exceeds epsilon leaves an error of at most epsilon / (1 - damping) a vertex.
    """
    links = Links(_weights(edges, []), ["src"])
    has = links.table.select(F.col("src").alias("id")).distinct().withColumn("_has", F.lit(True))
    size = vertices.agg(F.count("*").alias("n"))
    state = vertices.select("id").join(has, "id", "left").join(F.broadcast(size), F.lit(True)).select("id", "n", F.col("_has").isNull().alias("sink"))
    if before is not None:
        state = state.join(before.select("id", F.col("score").alias("old")), "id", "left").select("id", "n", "sink", F.coalesce("old", 1 / F.col("n")).alias("score"))
        whole = state.agg(F.sum("score").alias("whole"))  # scores that add up to 1 leave residuals that cancel out
        state = state.join(F.broadcast(whole), F.lit(True)).select("id", "n", "sink", (F.col("score") / F.col("whole")).alias("score"))
    else:
        state = state.withColumn("score", 1 / F.col("n"))
    now = cut(state.withColumn("flow", F.col("score")))  # what a vertex hands on next
    first = True
    for _ in range(max_rounds):
        sends = now.where(F.col("flow") != 0)
        lost = sends.where("sink").agg(F.coalesce(F.sum("flow"), F.lit(0.0)).alias("lost"))
        sent = links.send(sends.where("not sink").select(F.col("id").alias("src"), "flow"), lambda x: x.select(F.col("dst").alias("to"), (F.col("flow") * F.col("share")).alias("got")))
        mail = sent.groupBy("to").agg(F.sum("got").alias("got"))
        own = F.when(F.col("sink"), F.col("flow")).otherwise(0.0)
        shared = F.when(F.col("n") > 1, (F.col("lost") - own) / (F.col("n") - 1)).otherwise(F.col("lost"))
        came = damping * (F.coalesce("got", F.lit(0.0)) + shared)
        met = now.join(mail, F.col("id") == F.col("to"), "left").join(F.broadcast(lost), F.lit(True))
        if first:
            met = met.withColumn("residual", (1 - damping) / F.col("n") + came - F.col("score"))
        else:
            met = met.withColumn("residual", F.col("residual") + came)
        moves = F.abs("residual") > epsilon
        met = met.select("id", "n", "sink", (F.col("score") + F.when(moves, F.col("residual")).otherwise(0.0)).alias("score"), F.when(moves, F.col("residual")).otherwise(0.0).alias("flow"), F.when(moves, F.lit(0.0)).otherwise(F.col("residual")).alias("residual"))
        now = cut(met, now, {"moving": F.count_if(F.col("flow") != 0)})
        first = False
        if not watched(now)["moving"]:
            break
    else:
        raise RuntimeError(f"pagerank: residuals above {epsilon} after {max_rounds} rounds")
    links.close()
    return now.select("id", (F.col("score") + F.col("residual")).alias("score"))


def mass(result: DataFrame) -> DataFrame:
    """One row: how far the scores are from adding up to 1."""
    return result.agg(F.abs(F.sum("score") - 1).alias("off"))
