"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tropica.operators import communities, ranking, traversal, triangles
from tropica.sources.tables import co_purchase

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    g = co_purchase(spark, SF_DIR)
    ids = [r["id"] for r in g.vertices.orderBy("id").limit(4).collect()]
    kernels = {
        "triangles": lambda: triangles.triangle_count(g),
        "bfs": lambda: traversal.bfs(g, ids[0]).count(),
        "sssp": lambda: traversal.shortest_paths(g, ids[0]).count(),
        "components": lambda: communities.connected_components(g).select("component").distinct().count(),
        "pagerank": lambda: ranking.pagerank(g, sinks=False)[1],
        "betweenness": lambda: ranking.betweenness(g, ids).count(),
    }
    seconds = {}
    for name, run in kernels.items():
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "graph kernels, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
