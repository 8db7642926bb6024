"""Named queries over the table graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tropica import graph
from tropica.functions import semiring as s
from tropica.operators import communities, cores, dnn, forests, graphlets, ranking, traversal, triangles
from tropica.sources.tables import co_purchase, customer_suppliers, user_transitions


def parts(spark: SparkSession, d: str) -> graph.Graph:
    return co_purchase(spark, d)


def least_ids(g: graph.Graph, k: int) -> list[int]:
    return [r["id"] for r in g.vertices.orderBy("id").limit(k).collect()]


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).cast("double" if isinstance(v, float) else "boolean" if isinstance(v, bool) else "long").alias(k) for k, v in values.items()))


def _on(load: Callable, run: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: run(load(spark, d))


def _vector(g: graph.Graph) -> DataFrame:
    return g.vertices.select("id", (F.col("id") % 7 + 1).alias("x"))


def _rounded(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(F.col(column).cast("double"), digits))


def _mis_report(g: graph.Graph) -> DataFrame:
    spark = g.edges.sparkSession
    from tropica.plans.fixpoint import written

    chosen = written(communities.independent_set(g), "set")
    near = written(g.edges.join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src").distinct(), "near")
    inside = 0
    if not near.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").isEmpty():
        inside = g.edges.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi").count()
    open_ = g.vertices.join(near.select(F.col("src").alias("id")).unionByName(chosen), "id", "left_anti").count()
    return one_row(spark, violations=inside, uncovered=open_)


def _msf_report(g: graph.Graph) -> DataFrame:
    return forests.spanning_forest(g.edges, symmetric=not g.directed).agg(F.sum("w").cast("long").alias("weight"), F.count("*").alias("size"))


def _tc(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: one_row(spark, triangles=triangles.triangle_count(parts(spark, d), method))


def _truss_report(g: graph.Graph) -> DataFrame:
    rows = triangles.all_ktruss(g)
    return g.edges.sparkSession.createDataFrame([(r["k"], r["ntris"], r["nedges"]) for r in rows], "k long, ntris long, nedges long")


def _dnn(spark: SparkSession, d: str) -> DataFrame:
    """Two layers over customers x suppliers: weights and biases are functions of the ids."""
    y = customer_suppliers(spark, d).select("src", "dst", F.col("w").cast("double").alias("w"))
    ids = y.select("dst").distinct()
    layer = lambda k: ids.select(F.col("dst").alias("src"), F.explode(F.array(*(((F.col("dst") * k + i) % 10).cast("long") for i in range(4)))).alias("dst")).groupBy("src", "dst").agg((F.count("*") * 0.25).alias("w"))
    bias = spark.range(10).select("id", F.lit(-0.5).alias("x"))
    first, second = layer(3), layer(7)
    return _rounded(dnn.infer(y, [(first, bias), (second, bias)]), "w", 4)


def _extract(g: graph.Graph) -> DataFrame:
    index = graph.sort_by_degree(g).select("position", "id")
    return s.extract(g.edges, index, index)


def _assigned(g: graph.Graph) -> DataFrame:
    """Entries of vertices with more than 5 neighbours are overwritten by their degree."""
    mask = g.out_degree().where("degree > 5").select("id")
    return s.accumulate(_vector(g), g.out_degree().where("degree > 5").select("id", F.col("degree").alias("x")), ["id"], "x", None, mask)


_ON_PARTS: dict[str, Callable[[graph.Graph], DataFrame]] = {
    "mxm_plus_pair_masked": lambda g: s.mxm(g.edges, g.edges, "plus_pair", mask=g.edges),
    "mxm_plus_times": lambda g: s.mxm(g.edges, g.edges, "plus_times"),
    "extract_gather": _extract,
    "assign_masked": _assigned,
    "bfs": lambda g: traversal.bfs(g, least_ids(g, 1)[0]),
    "cc_min_label": communities.connected_components,
    "sssp_distance": lambda g: traversal.shortest_paths(g, least_ids(g, 1)[0]),
    "pagerank_gap_20": lambda g: _rounded(ranking.pagerank(g, fixed=20, sinks=False)[0], "rank"),
    "betweenness_4": lambda g: _rounded(ranking.betweenness(g, least_ids(g, 4)), "centrality", 4),
    "edge_support": lambda g: triangles.support(g.edges),
    "ktruss_4": lambda g: triangles.ktruss(g, 4),
    "all_ktruss": _truss_report,
    "kcore_all": lambda g: cores.kcore_all(g)[0],
    "kcore_3": lambda g: cores.kcore(g, 3),
    "kcore_subgraph_3": lambda g: cores.kcore_subgraph(g, cores.kcore_all(g)[0], 3),
    "cdlp_10": lambda g: communities.cdlp(g, 10)[0],
    "mis_valid": _mis_report,
    "msf_weight_size": _msf_report,
    "graphlets": graphlets.graphlets,
    "square_clustering": lambda g: _rounded(triangles.square_clustering(g), "c"),
}
_ON_MOVES: dict[str, Callable[[graph.Graph], DataFrame]] = {
    "lcc_directed": lambda g: _rounded(triangles.lcc(g), "lcc"),
    "scc_min_id": communities.strong_components,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t, p = user_transitions, parts
    found = {
        "out_degree": _on(t, lambda g: g.out_degree()),
        "in_degree": _on(t, lambda g: g.in_degree()),
        "edge_min_max": _on(t, lambda g: g.weight_range()),
        "self_edges": _on(t, lambda g: one_row(g.edges.sparkSession, self_edges=g.self_edges)),
        "symmetric_structure": _on(t, lambda g: one_row(g.edges.sparkSession, symmetric=g.symmetric_structure)),
        "delete_self_edges": _on(t, lambda g: g.without_self_edges().edges),
        "transpose": _on(t, lambda g: g.transpose()),
        "structure": _on(t, lambda g: g.structure()),
        "sort_by_degree": _on(p, lambda g: graph.sort_by_degree(g)),
        "mxv_plus_second": _on(t, lambda g: s.mxv(g.edges, _vector(g), "plus_second")),
        "vxm_min_plus": _on(t, lambda g: s.vxm(_vector(g), g.edges, "min_plus")),
        "ewise_add_union": _on(t, lambda g: s.ewise_add(g.edges, g.transpose(), ["src", "dst"], "w", lambda a, b: a + b)),
        "ewise_mult_intersect": _on(t, lambda g: s.ewise_mult(g.edges, g.transpose(), ["src", "dst"], "w", lambda a, b: a * b)),
        "select_tril": _on(t, lambda g: s.select(g.edges, "tril", -1)),
        "reduce_rows": _on(t, lambda g: s.reduce_rows(g.edges)),
        "bellman_ford": _on(t, lambda g: traversal.bellman_ford(g, least_ids(g, 1)[0])),
        "pagerank_20": _on(t, lambda g: _rounded(ranking.pagerank(g, fixed=20)[0], "rank")),
        **{f"tc_{m}": _tc(m) for m in ("auto", *triangles.METHODS)},
        "triangles_per_vertex": _on(p, triangles.triangles_per_vertex),
        "lcc_undirected": _on(p, lambda g: _rounded(triangles.lcc(g), "lcc")),
        "triangle_centrality": _on(p, lambda g: _rounded(triangles.triangle_centrality(g)[0], "centrality")),
        "dnn_2layer": _dnn,
    }
    return found | {name: _on(p, of) for name, of in _ON_PARTS.items()} | {name: _on(t, of) for name, of in _ON_MOVES.items()}


PARTS = "l as (select distinct l_orderkey as o, l_partkey as p from lineitem), e as materialized (select a.p as src, b.p as dst, count(*)::bigint as w from l a join l b on a.o = b.o and a.p <> b.p group by all), v as (select distinct src as id from e)"
MOVES = "x as (select user_id as u, lead(user_id) over (order by ts, event_id) as n from events), e as materialized (select u as src, n as dst, count(*)::bigint as w from x where n is not null and u <> n group by all), v as (select src as id from e union select dst from e), y as (select id, id % 7 + 1 as x from v)"
TRI = "o as (select src, dst from e where src < dst), tri as materialized (select a.src as a, a.dst as b, b.dst as c from o a join o b on a.dst = b.src join o c on c.src = a.src and c.dst = b.dst)"
SUP = TRI + ", corner as (select unnest([{'s': a, 'd': b}, {'s': b, 'd': a}, {'s': a, 'd': c}, {'s': c, 'd': a}, {'s': b, 'd': c}, {'s': c, 'd': b}], recursive := true) from tri), sup as materialized (select s as src, d as dst, count(*)::bigint as w from corner group by all)"


def _pagerank(graph_sql: str, sinks: bool, rounds: int = 20, a: float = 0.85) -> str:
    ctes = ["n as (select count(*)::double as n from v)", "deg as (select src as id, count(*) as d from e group by 1)", "r0 as (select id, 1 / (select n from n) as r from v)"]
    for k in range(1, rounds + 1):
        lost = f" + {a} / (select n from n) * coalesce((select sum(r) from r{k - 1} anti join deg using (id)), 0)" if sinks else ""
        ctes.append(f"r{k} as materialized (select v.id, {1 - a:.17g} / (select n from n){lost} + coalesce(got, 0) as r from v left join (select e.dst as id, sum(r.r * {a} / d) as got from r{k - 1} r join deg using (id) join e on e.src = r.id group by 1) using (id))")
    return f"with {graph_sql}, {', '.join(ctes)} select id, round(r, 6) as rank from r{rounds}"


def _cdlp(rounds: int = 10) -> str:
    ctes = ["l0 as (select id, id as label from v)"]
    for k in range(1, rounds + 1):
        ctes.append(f"l{k} as materialized (select id, label from (select e.src as id, p.label, row_number() over (partition by e.src order by count(*) desc, p.label) as r from e join l{k - 1} p on p.id = e.dst group by 1, 2) where r = 1)")
    return f"with {PARTS}, {', '.join(ctes)} select id, label from l{rounds}"


def _cores(rounds: int = 40) -> str:
    """Core numbers as the fixpoint of the h-index of neighbours' numbers."""
    ctes = ["c0 as (select src as id, count(*) as c from e group by 1)"]
    for k in range(1, rounds + 1):
        ctes.append(f"c{k} as materialized (select id, max(least(r, c)) as c from (select e.src as id, p.c, row_number() over (partition by e.src order by p.c desc) as r from e join c{k - 1} p on p.id = e.dst) group by 1)")
    return f"{PARTS}, {', '.join(ctes)}, core as (select id, c::bigint as core from c{rounds})"


def _truss(k: int, rounds: int = 12) -> str:
    """Edges in too few triangles go, then the triangles that had one of them, and so on."""
    ctes = ["t0 as (select * from tri)"]
    for i in range(1, rounds + 1):
        ctes.append(f"k{i} as materialized (select src, dst, count(*)::bigint as w from (select a as src, b as dst from t{i - 1} union all select a, c from t{i - 1} union all select b, c from t{i - 1}) group by all having count(*) >= {k - 2})")
        ctes.append(f"t{i} as materialized (select t.* from t{i - 1} t semi join k{i} x on x.src = a and x.dst = b semi join k{i} y on y.src = a and y.dst = c semi join k{i} z on z.src = b and z.dst = c)")
    return f"with {PARTS}, {TRI}, {', '.join(ctes)} select * from k{rounds} union all select dst, src, w from k{rounds}"


def _betweenness() -> str:
    return f"""with recursive {PARTS}, s as (select id from v order by id limit 4),
d(s, id, l) using key (s, id) as (select id, id, 0 from s union select c.s, e.dst, min(c.l + 1) from d c join e on e.src = c.id left join recurring.d r on r.s = c.s and r.id = e.dst where r.l is null or c.l + 1 < r.l group by 1, 2),
p(s, id, l, n) as (select id, id, 0, 1::double from s union all select p.s, e.dst, p.l + 1, sum(p.n) from p join e on e.src = p.id join d on d.s = p.s and d.id = e.dst and d.l = p.l + 1 group by 1, 2, 3),
b(s, id, l, n, x) as (select s, id, l, n, 0::double from p where l = (select max(l) from p)
 union all select p.s, p.id, p.l, any_value(p.n), any_value(p.n) * coalesce(sum((1 + w.x) / w.n), 0) from (select max(l) - 1 as k from b) t join p on p.l = t.k left join (select b.s, e.src as id, b.x, b.n from b join e on e.dst = b.id) w on w.s = p.s and w.id = p.id where p.l > 0 group by 1, 2, 3)
select v.id, round(coalesce(c.x, 0), 4) as centrality from v left join (select id, sum(x) as x from b group by 1) c using (id)"""


SQL_NET = ", ".join("(" + " + ".join(f"({c}) * d{i}" for i, c in row.items()) + f")::bigint as f{k}" for k, row in enumerate(graphlets.NET))


def oracle_sql() -> dict[str, str]:
    t, p = (f"with recursive {g}" for g in (MOVES, PARTS))
    labels = "c(v, l) using key (v) as (select id, id from v union select e.dst, min(c.l) from c join e on e.src = c.v join recurring.c r on r.v = e.dst where c.l < r.l group by e.dst)"
    source = "(select min(id) from v)"
    levels = f"d(id, l) using key (id) as (select {source}, 0::bigint union select e.dst, min(c.l + 1) from d c join e on e.src = c.id left join recurring.d r on r.id = e.dst where r.l is null or c.l + 1 < r.l group by 1)"
    lengths = f"d(id, l) using key (id) as (select {source}, 0::bigint union select e.dst, min(c.l + e.w) from d c join e on e.src = c.id left join recurring.d r on r.id = e.dst where r.l is null or c.l + e.w < r.l group by 1)"
    tc = f"{p}, {TRI} select count(*)::bigint as triangles from tri"
    clustering = f"{TRI}, k as (select unnest([a, b, c]) as id from tri), deg as (select src as id, count(*) as d from e group by 1)"
    both = "g as (select src, dst from e union all select dst, src from e), m as materialized (select src, dst, count(*) as m from g group by all)"
    return {
        "out_degree": f"{t} select src as id, count(*)::bigint as degree from e group by 1",
        "in_degree": f"{t} select dst as id, count(*)::bigint as degree from e group by 1",
        "edge_min_max": f"{t} select min(w) as emin, max(w) as emax from e",
        "self_edges": f"{t} select count(*)::bigint as self_edges from e where src = dst",
        "symmetric_structure": f"{t} select count(*) = 0 as symmetric from e anti join (select dst as src, src as dst from e) using (src, dst)",
        "delete_self_edges": f"{t} select src, dst, w from e where src <> dst",
        "transpose": f"{t} select dst as src, src as dst, w from e",
        "structure": f"{t} select src, dst, true as w from e",
        "sort_by_degree": f"{p}, g as (select src as id, count(*)::bigint as degree from e group by 1) select id, degree, row_number() over (order by degree, id) - 1 as position from g",
        "mxv_plus_second": f"{t} select src as id, sum(x)::bigint as x from e join y on y.id = dst group by 1",
        "vxm_min_plus": f"{t} select dst as id, min(x + w)::bigint as x from e join y on y.id = src group by 1",
        "mxm_plus_pair_masked": f"{p} select a.src, b.dst, count(*)::bigint as w from e a join e b on a.dst = b.src semi join e m on m.src = a.src and m.dst = b.dst group by 1, 2",
        "mxm_plus_times": f"{p} select a.src, b.dst, sum(a.w * b.w)::bigint as w from e a join e b on a.dst = b.src group by 1, 2",
        "ewise_add_union": f"{t} select src, dst, sum(w)::bigint as w from (select * from e union all select dst, src, w from e) group by 1, 2",
        "ewise_mult_intersect": f"{t} select a.src, a.dst, (a.w * b.w)::bigint as w from e a join e b on a.src = b.dst and a.dst = b.src",
        "select_tril": f"{t} select src, dst, w from e where dst <= src - 1",
        "reduce_rows": f"{t} select src as id, sum(w)::bigint as x from e group by 1",
        "extract_gather": f"{p}, g as (select src as id, row_number() over (order by count(*), src) - 1 as k from e group by src) select a.k as src, b.k as dst, w from e join g a on a.id = e.src join g b on b.id = e.dst",
        "assign_masked": f"{p}, g as (select src as id, count(*) as d from e group by 1) select id, case when d > 5 then d else id % 7 + 1 end::bigint as x from g",
        "bfs": f"{p}, {levels} select a.id, a.l as level, coalesce((select min(e.src) from e join d b on b.id = e.src where e.dst = a.id and b.l = a.l - 1), a.id) as parent from d a",
        "cc_min_label": f"{p}, {labels} select v as id, l as component from c",
        "sssp_distance": f"{p}, {lengths} select v.id, coalesce(d.l, {2**63 - 1}) as distance from v left join d using (id)",
        "bellman_ford": f"{t}, {lengths}, z as materialized (select e.src, e.dst from e join d a on a.id = e.src join d b on b.id = e.dst where a.l + e.w = b.l), h(id, h) using key (id) as (select {source}, 0::bigint union select z.dst, min(c.h + 1) from h c join z on z.src = c.id left join recurring.h r on r.id = z.dst where r.h is null or c.h + 1 < r.h group by 1) select d.id, d.l::double as d, h.h, coalesce((select min(z.src) + 1 from z join h b on b.id = z.src where z.dst = d.id and b.h = h.h - 1), 0) as pi from d join h using (id)",
        "pagerank_20": _pagerank(MOVES, True),
        "pagerank_gap_20": _pagerank(PARTS, False),
        "betweenness_4": _betweenness(),
        **{f"tc_{m}": tc for m in ("auto", *triangles.METHODS)},
        "triangles_per_vertex": f"{p}, {TRI} select unnest([a, b, c]) as id, count(*)::bigint as triangles from tri group by 1",
        "edge_support": f"{p}, {SUP} select * from sup",
        "ktruss_4": _truss(4),
        "kcore_all": f"with {_cores()} select id, core from core",
        "kcore_3": f"with {_cores()} select id, 3::bigint as core from core where core >= 3",
        "kcore_subgraph_3": f"with {_cores()} select src, dst, 1::bigint as w from e where src in (select id from core where core >= 3) and dst in (select id from core where core >= 3)",
        "cdlp_10": _cdlp(),
        "lcc_undirected": f"{p}, {clustering} select id, round(2.0 * count(*) / (d * (d - 1)), 6) as lcc from k join deg using (id) group by id, d",
        "lcc_directed": f"{t}, {both}, deg as (select src as id, count(*) as d from m group by 1) select a.src as id, round(sum(c.m) / 2.0 / (any_value(d) * (any_value(d) - 1)), 6) as lcc from m a join m b on a.src = b.src and a.dst <> b.dst join m c on c.src = a.dst and c.dst = b.dst join deg on deg.id = a.src group by 1",
        "triangle_centrality": f"{p}, {SUP}, yy as (select src as id, sum(w)::double as y from sup group by 1), na as (select src as id, sum(y) as a from e join yy on yy.id = dst group by 1), nt as (select src as id, sum(y) as a from sup join yy on yy.id = dst group by 1) select v.id, round((3 * coalesce(na.a, 0) - 2 * coalesce(nt.a, 0) + coalesce(y, 0)) / (select sum(y) from yy), 6) as centrality from v left join na using (id) left join nt using (id) left join yy using (id)",
        "mis_valid": "select 0::bigint as violations, 0::bigint as uncovered",
        "msf_weight_size": f"{p}, ts as (select distinct w as t from e union select 0), c(t, v, l) using key (t, v) as (select t, id, id from ts, v union select c.t, e.dst, min(c.l) from c join e on e.src = c.v and e.w <= c.t join recurring.c r on r.t = c.t and r.v = e.dst where c.l < r.l group by 1, 2), k as (select t, count(distinct l) as n from c group by 1), d as (select t, n, lag(n) over (order by t) - n as joined from k) select sum(t * joined)::bigint as weight, sum(joined)::bigint as size from d",
        "scc_min_id": f"{t}, f(a, b) as (select id, id from v union select f.a, e.dst from f join e on e.src = f.b) select x.a as id, min(x.b) as component from f x join f y on x.a = y.b and x.b = y.a group by 1",
        "square_clustering": f"{p}, p2 as materialized (select a.src as u, b.dst as v, count(*) as p from e a join e b on a.dst = b.src where a.src <> b.dst group by 1, 2), sq as (select u as id, sum(p * (p - 1) // 2) as s from p2 group by 1), deg as (select src as id, count(*) as d from e group by 1), na as (select src as id, sum(d) as a from e join deg on deg.id = dst group by 1), tr as (select u as id, sum(p) as t from p2 join e on e.src = u and e.dst = v group by 1) select sq.id, round((s / (a * (d - 1) - d * (d - 1) - coalesce(t, 0) - s))::double, 6) as c from sq join deg using (id) join na using (id) left join tr using (id) where s > 0",
        "graphlets": f"""{p}, {SUP}, p2 as materialized (select a.src as u, b.dst as v, count(*) as c from e a join e b on a.dst = b.src where a.src <> b.dst group by 1, 2), dg as (select src as id, count(*) as p from e group by 1), tv as (select src as id, sum(w) / 2 as t, sum(w * (w - 1)) / 2 as d14 from sup group by 1),
b as materialized (select v.id, p, coalesce(t, 0) as t, coalesce(d14, 0) as d14 from v join dg using (id) left join tv using (id)), n1 as materialized (select e.src as id, sum(p) as ap, sum((p - 1) * (p - 2)) / 2 as d7, sum(t) as nt from e join b on b.id = e.dst group by 1), n2 as (select e.src as id, sum(ap - p) as ad2 from e join b on b.id = e.dst join n1 on n1.id = e.dst group by 1),
x10 as (select sup.src as id, sum(w * (p - 2)) as d10 from sup join b on b.id = sup.dst group by 1), x12 as (select u as id, sum(c * (c - 1)) / 2 as d12 from p2 group by 1), x13 as (select e.src as id, sum(sup.w - 1) / 2 as d13 from e join sup on sup.src = e.dst join e k on k.src = e.src and k.dst = sup.dst group by 1),
k4 as (select t.a, t.b, t.c, x.c as d from tri t join tri x on t.a = x.a and t.b = x.b and t.c < x.c join o on o.src = t.c and o.dst = x.c), x15 as (select id, count(*) as k from (select unnest([a, b, c, d]) as id from k4) group by 1),
raw as (select b.id, 1 as d0, p as d1, ap - p as d2, p * (p - 1) / 2 as d3, t as d4, ad2 - p * (p - 1) - 2 * t as d5, (ap - p) * (p - 1) - 2 * t as d6, d7, p * (p - 1) * (p - 2) / 6 as d8, nt - 2 * t as d9, coalesce(d10, 0) as d10, (p - 2) * t as d11, coalesce(d12, 0) as d12, coalesce(d13, 0) as d13, d14, coalesce(k, 0) as d15
from b join n1 using (id) join n2 using (id) left join x10 using (id) left join x12 using (id) left join x13 using (id) left join x15 using (id)) select id, {SQL_NET} from raw""",
        "dnn_2layer": "with y0 as (select o_custkey as src, l_suppkey as dst, count(*)::double as w from orders join lineitem on o_orderkey = l_orderkey group by 1, 2), ids as (select distinct dst as id from y0), "
        + ", ".join(f"w{k} as (select id as src, d as dst, count(*) * 0.25 as w from (select id, unnest([(id * {k} + i) % 10 for i in [0, 1, 2, 3]]) as d from ids) group by 1, 2)" for k in (3, 7))
        + ", y1 as (select src, dst, least(w, 32.0) as w from (select a.src, b.dst, sum(a.w * b.w) - 0.5 as w from y0 a join w3 b on a.dst = b.src group by 1, 2) where w > 0), y2 as (select src, dst, least(w, 32.0) as w from (select a.src, b.dst, sum(a.w * b.w) - 0.5 as w from y1 a join w7 b on a.dst = b.src group by 1, 2) where w > 0) select src, dst, round(w::double, 4) as w from y2",
    }
