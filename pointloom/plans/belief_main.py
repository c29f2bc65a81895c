"""Belief propagation on graph files from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import belief
from pointloom.sources import texts


def beliefs(spark: SparkSession, kind: str, vertices: str, edges: str, iterations: int, eps: float, states: int = 2) -> DataFrame:
    """(id, belief) of a graph in files: ``pairwise`` (vertices and edges), ``two_state`` (the same, beliefs divided by the greater one) or ``factors`` (blocks; factors of one variable are priors)."""
    if kind == "factors":
        blocks = texts.factor_blocks(spark, edges)
        own = blocks.where("size(vars) = 1").select(F.col("vars")[0].alias("id"), F.col("values").alias("prior"))
        every = blocks.select(F.explode(F.arrays_zip("vars", "cards")).alias("v")).select(F.col("v.vars").alias("id"), F.col("v.cards").alias("card")).distinct()
        prior = every.join(own, "id", "left").select("id", F.coalesce("prior", F.transform(F.sequence(F.lit(1), "card"), lambda _: F.lit(1.0))).alias("prior"))
        return belief.factor_graph(prior, blocks.where("size(vars) > 1"), iterations, eps)
    prior, links = texts.pairwise_vertices(spark, vertices), texts.pairwise_edges(spark, edges, states)
    if kind == "two_state":
        return belief.two_state(prior, links, iterations, eps).select("id", F.array("p0", "p1").alias("belief"))
    return belief.pairwise(prior, links, states, iterations, eps)


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("kind", choices=("pairwise", "two_state", "factors"))
    a.add_argument("edges")
    a.add_argument("output")
    a.add_argument("--vertices", default="")
    a.add_argument("--states", type=int, default=2)
    a.add_argument("--iterations", type=int, default=50)
    a.add_argument("--eps", type=float, default=1e-3)
    a.add_argument("--local", action="store_true")
    o = a.parse_args(argv)
    build = SparkSession.builder
    spark = (build.master("local[*]") if o.local else build).getOrCreate()
    out = beliefs(spark, o.kind, o.vertices, o.edges, o.iterations, o.eps, o.states)
    out.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.transform("belief", lambda v: v.cast("string")), " ")).alias("value")).write.mode("overwrite").text(o.output)


if __name__ == "__main__":
    main()
