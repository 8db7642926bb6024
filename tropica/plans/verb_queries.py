"""Named queries of verbs, sources, properties and utilities over the table graphs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tropica import graph
from tropica.functions import semiring as s
from tropica.operators import communities, traversal, triangles
from tropica.plans.fixpoint import work_dir, written
from tropica.sources import bundle, mtx, random_graph
from tropica.sources.tables import co_purchase, user_transitions


def _vector(g: graph.Graph) -> DataFrame:
    return g.vertices.select("id", (F.col("id") % 7 + 1).alias("x"))


def _busy(g: graph.Graph) -> DataFrame:
    """Vertices with more than 2 out-neighbours: a mask."""
    return g.out_degree().where("degree > 2").select("id")


def _size(g: graph.Graph) -> int:
    return g.vertices.agg(F.max("id")).first()[0] + 1


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _matrix_market(g: graph.Graph) -> DataFrame:
    """Written as a Matrix Market folder and read again."""
    spark, n = g.edges.sparkSession, _size(g)
    path = work_dir(spark, "matrix-market")
    mtx.write_matrix(mtx.Matrix(g.edges, n, n, "int64_t"), path, "transitions between users")
    return mtx.read_matrix(spark, path).entries


def _collection(g: graph.Graph) -> DataFrame:
    """A matrix, a vector and a text saved as one collection, and what is loaded again."""
    spark, n, path = g.edges.sparkSession, _size(g), work_dir(g.edges.sparkSession, "collection")
    bundle.save(spark, path, {"moves": mtx.Matrix(g.edges, n, n, "int64_t"), "marks": _vector(g), "about": "two items"}, "set")
    found = bundle.load(spark, path)
    matrix = found["moves"].entries.select(F.lit("moves").alias("item"), "src", "dst", "w")
    vector = found["marks"].select(F.lit("marks").alias("item"), F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), F.col("x").alias("w"))
    return matrix.unionByName(vector).unionByName(spark.range(1).select(F.lit(found["about"]).alias("item"), *(F.lit(x).cast("long").alias(c) for x, c in ((-1, "src"), (-1, "dst"), (0, "w")))))


def _triples(g: graph.Graph) -> DataFrame:
    """Tab-separated triples from 1 on, written and read again."""
    spark, n, path = g.edges.sparkSession, _size(g), work_dir(g.edges.sparkSession, "triples")
    g.edges.select(F.col("src") + 1, F.col("dst") + 1, "w").write.csv(path, sep="\t")
    return mtx.read_triples(spark, path, n, n, "int64_t").entries


def _equality(g: graph.Graph) -> DataFrame:
    e, keys = g.edges, ["src", "dst"]
    more, other = e.withColumn("w", F.col("w") + 1), e.withColumn("w", F.col("w").cast("double"))
    x = _vector(g)
    cases = [
        ("itself", graph.equal(e, e, keys, "w")), ("other values", graph.equal(e, more, keys, "w")), ("other type", graph.equal(e, other, keys, "w")), ("fewer entries", graph.equal(e, e.where("w > 1"), keys, "w")),
        ("by comparator", graph.equal(e, more, keys, "w", F.col("_b") == F.col("_a") + 1)), ("types may differ by comparator", graph.equal(e, other, keys, "w", F.col("_b") == F.col("_a"))),
        ("vector itself", graph.equal(x, x, ["id"], "x")), ("vector by comparator", graph.equal(x, x.withColumn("x", -F.col("x")), ["id"], "x", F.col("_a") == -F.col("_b"))), ("vector other values", graph.equal(x, x.withColumn("x", F.col("x") % 3), ["id"], "x")),
        ("not a number", graph.equal(other.withColumn("w", F.lit(float("nan"))), other.withColumn("w", F.lit(float("nan"))), keys, "w")),
    ]
    return _rows(e.sparkSession, cases, "what string, same boolean")


def _raw_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers at suppliers, with repeats: entries to build from."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("w"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), "w")


def _built(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw_pairs(spark, d)
    found = s.build_all(raw, ["src", "dst"], "w", ("plus", "min", "max"))
    return found.select("how", "src", "dst", F.col("w").cast("long").alias("w"))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    """Self-edges and zeros dropped, weights absolute, both directions: from differences of raw entries."""
    raw = _raw_pairs(spark, d).select((F.col("src") % 50).alias("src"), (F.col("dst") % 50).alias("dst"), (F.col("w") - 25).alias("w"))
    return graph.Graph.from_edges(raw, symmetrize=True, drop_self=True, positive=True).edges


def _elements(g: graph.Graph) -> DataFrame:
    first = g.edges.orderBy("src", "dst").select("src", "dst").first()
    at, nowhere = {"src": first["src"], "dst": first["dst"]}, {"src": first["src"], "dst": -5}
    changed = s.set_element(s.set_element(g.edges, at, 99), nowhere, 7)
    found = [("old", s.element(g.edges, at)), ("none", s.element(g.edges, nowhere)), ("over", s.element(changed, at)), ("new", s.element(changed, nowhere)), ("entries more", changed.count() - g.edges.count())]
    return _rows(g.edges.sparkSession, found, "what string, x long")


def _masked_writes(g: graph.Graph) -> DataFrame:
    """Old vector, new degrees, mask of busy vertices, for every mix of accumulator, replace and complement."""
    old, new, mask = _vector(g).where("id % 3 > 0"), g.out_degree().select("id", F.col("degree").alias("x")), written(_busy(g), "mask")
    out = None
    for plus in (False, True):
        for replace in (False, True):
            for complement in (False, True):
                found = s.accumulate(old, new, ["id"], "x", F.sum if plus else None, mask, replace, complement).select(F.lit(plus).alias("plus"), F.lit(replace).alias("replaced"), F.lit(complement).alias("turned"), "id", F.col("x").cast("long").alias("x"))
                out = found if out is None else out.unionByName(found)
    return out


def _masks(g: graph.Graph) -> DataFrame:
    """Products under a structural, a complemented and a valued mask."""
    x, busy = _vector(g), written(_busy(g), "mask")
    valued = g.vertices.select("id", (F.col("id") % 2).alias("m"))
    kinds = {"inside": dict(mask=busy), "outside": dict(mask=busy, complement=True), "valued": dict(mask=valued, valued="m"), "valued outside": dict(mask=valued, valued="m", complement=True)}
    out = None
    for name, how in kinds.items():
        found = s.mxv(g.edges, x, "plus_times", **how).select(F.lit(name).alias("kind"), "id", F.col("x").cast("long").alias("x"))
        out = found if out is None else out.unionByName(found)
    return out


def _gathered(g: graph.Graph) -> DataFrame:
    index = graph.sort_by_degree(g).select("position", "id")
    return s.gather(_vector(g), index)


def _scattered(g: graph.Graph) -> DataFrame:
    index = g.vertices.select(F.col("id").alias("position"), (F.col("id") % 11).alias("id"))
    return s.scatter(g.out_degree().select("id", F.col("degree").alias("x")), index)


def _reduced(g: graph.Graph) -> DataFrame:
    names = {"plus": F.col("w"), "min": F.col("w"), "max": F.col("w"), "lor": F.col("w") > 2, "land": F.col("w") > 0}
    found = [(name, int(s.reduce_all(g.edges.withColumn("w", of), name).first()["w"])) for name, of in names.items()]
    return _rows(g.edges.sparkSession, found, "monoid string, x long")


def _selected(g: graph.Graph) -> DataFrame:
    cases = {"triu": ("triu", 1), "offdiag": ("offdiag", 2), "diag": ("diag", 3), "eq": ("eq", 2), "ne": ("ne", 1), "lt": ("lt", 3), "le": ("le", 2), "gt": ("gt", 1), "ge": ("ge", 3), "user": ((F.col("src") + F.col("dst")) % 5 == F.col("w"), 0)}
    out = None
    for name, (predicate, k) in cases.items():
        found = s.select(g.edges, predicate, k).agg(F.count("*").alias("entries"), F.coalesce(F.sum("w"), F.lit(0)).alias("total")).select(F.lit(name).alias("predicate"), "entries", "total")
        out = found if out is None else out.unionByName(found)
    return out


def _user_semiring(g: graph.Graph) -> DataFrame:
    """The heaviest step into each vertex, and of equals the one from the greatest source value: a struct under a maximum."""
    own = s.Semiring(lambda c: F.max(c), lambda x, w: F.struct(w.alias("w"), (x * 10 + w).alias("mark")))
    return s.vxm(_vector(g), g.edges, own).select("id", F.col("x.w").alias("w"), F.col("x.mark").alias("mark"))


def _random_report(spark: SparkSession) -> DataFrame:
    """What holds for random matrices whatever is drawn: bounds, types, equal seeds, full matrices."""
    found = []
    for kind in ("bool", "int8_t", "uint16_t", "int64_t", "float", "double"):
        a, b, c = (random_graph.random_matrix(spark, kind, 40, 30, 0.25, seed).entries for seed in (3, 3, 4))
        cells = a.agg(F.count("*").alias("n"), F.count(F.when((F.col("src") < 0) | (F.col("src") >= 40) | (F.col("dst") < 0) | (F.col("dst") >= 30), 1)).alias("out"), F.count_distinct("src", "dst").alias("d")).first()
        keys = ["src", "dst"]
        full = random_graph.random_matrix(spark, kind, 6, 7, float("inf"), 1).entries.count()
        found.append((kind, 0 < cells["n"] <= 300 and cells["n"] == cells["d"] and not cells["out"], graph.equal(a, b, keys, "w"), graph.equal(a, c, keys, "w"), full))
    return _rows(spark, found, "kind string, well_formed boolean, same_seed boolean, other_seed boolean, full_entries long")


def _sampled(g: graph.Graph) -> DataFrame:
    found = [(seed, k, *random_graph.sample_degree(g, True, k, seed)) for seed, k in ((1, 15), (42, 50))]
    return _rows(g.edges.sparkSession, [(a, b, round(float(c), 6), int(d)) for a, b, c, d in found], "seed long, samples long, mean double, median long")


def _forest_edges(g: graph.Graph) -> DataFrame:
    return communities.spanning_forest(g.edges.where("w > 1"), symmetric=not g.directed).select("src", "dst", F.col("w").cast("long").alias("w"))


def _type_names(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(kind, mtx.type_size(kind), of.simpleString()) for kind, (of, _) in mtx.KINDS.items()], "kind string, bytes long, stored string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = lambda run: lambda spark, d: run(user_transitions(spark, d))
    p = lambda run: lambda spark, d: run(co_purchase(spark, d))
    least = lambda g: g.vertices.agg(F.min("id")).first()[0]
    return {
        "matrix_market_round_trip": t(_matrix_market),
        "collection_round_trip": t(_collection),
        "triples_round_trip": t(_triples),
        "equality": t(_equality),
        "build_duplicates": _built,
        "prepared_graph": _prepared,
        "set_extract_element": t(_elements),
        "masked_writes": t(_masked_writes),
        "masked_products": t(_masks),
        "gather_vector": p(_gathered),
        "scatter_min": t(_scattered),
        "reduce_all": t(_reduced),
        "reduce_columns_max": t(lambda g: s.reduce_rows(s.transpose(g.edges), "max")),
        "select_predicates": t(_selected),
        "apply_bound": t(lambda g: s.apply(g.edges, lambda w: 3 * w + F.col("src") - F.col("dst"))),
        "extract_tuples": t(lambda g: g.edges.select("src", "dst", "w")),
        "diagonal_scale": t(lambda g: s.mxm(s.diagonal(_vector(g)), g.edges, "plus_times")),
        "diagonal_of_square": t(lambda g: s.diagonal_of(s.mxm(g.edges, g.edges, "plus_times"))),
        "mxv_min_secondi": t(lambda g: s.mxv(g.edges, _vector(g), "min_secondi")),
        "vxm_any_firstj": t(lambda g: s.vxm(_vector(g), g.edges, "max_secondi")),
        "mxm_max_first": t(lambda g: s.mxm(g.edges, g.edges, "max_first", mask=g.edges)),
        "mxv_plus_div": t(lambda g: s.mxv(g.edges, _vector(g), "plus_div").withColumn("x", F.round("x", 6))),
        "mxv_lor_eq": t(lambda g: s.mxv(g.edges, _vector(g), "lor_eq")),
        "vxm_user_semiring": t(_user_semiring),
        "vector_structure": t(lambda g: s.structure_of(_vector(g).where("x > 3"))),
        "copy_directed": t(lambda g: g.copied()),
        "weak_components": t(lambda g: communities.connected_components(g, weak=True)),
        "bellman_ford_dense": t(lambda g: traversal.bellman_ford_dense(graph.Graph(g.edges.where("w > 1"), g.vertices), least(g))),
        "spanning_forest_edges": lambda spark, d: _forest_edges(co_purchase(spark, d)),
        "triangles_presort_asked": p(lambda g: g.edges.sparkSession.range(1).select(F.lit(triangles.triangle_count(g, "sandia_lut", None)).cast("long").alias("triangles"))),
        "sample_degree": p(_sampled),
        "random_matrix_report": lambda spark, d: _random_report(spark),
        "type_names": lambda spark, d: _type_names(spark),
    }


#: The generator of samples, unrolled as a recursion: state, draws so far and the 60 bits put together.
_SAMPLE = """r{k}(i, x, o) as (select 0, {seed}::hugeint, 0::hugeint union all select i + 1, y, case when i % 4 = 0 then 0 else o end * 32767 + (y // 65536) % 32768 from (select i, o, (x * 1103515245 + 12345) % 18446744073709551616::hugeint as y from r{k}) where i < 4 * {samples}),
s{k} as (select {seed}::bigint as seed, {samples}::bigint as samples, coalesce(degree, 0) as degree from (select ((o % 1152921504606846976::hugeint) % (select count(*) from v))::bigint as id from r{k} where i > 0 and i % 4 = 0) left join g using (id))"""


def oracle_sql() -> dict[str, str]:
    from tropica.plans.queries import MOVES, PARTS, TRI

    t, p = f"with recursive {MOVES}", f"with recursive {PARTS}"
    raw = "raw as (select o_custkey as src, l_suppkey as dst, l_quantity::bigint as w from lineitem join orders on o_orderkey = l_orderkey)"
    deg = "g as (select src as id, count(*)::bigint as degree from e group by 1)"
    union = "a as (select id, x from y where id % 3 > 0), z as (select id, x from a union all select id, degree from g), both_ as (select id, sum(x)::bigint as x from z group by 1)"
    parts = []
    for plus in (False, True):
        for replace in (False, True):
            for complement in (False, True):
                mask = "id {}in (select id from g where degree > 2)"
                inside, outside = mask.format("not " if complement else ""), mask.format("" if complement else "not ")
                new = "select id, x from both_" if plus else "select id, degree as x from g"
                rest = "" if replace else f" union all select id, x from a where {outside}"
                parts.append(f"select {plus} as plus, {replace} as replaced, {complement} as turned, id, x from (select * from ({new}) where {inside}{rest})")
    predicates = {"triu": "dst >= src + 1", "offdiag": "dst <> src + 2", "diag": "dst = src + 3", "eq": "w = 2", "ne": "w <> 1", "lt": "w < 3", "le": "w <= 2", "gt": "w > 1", "ge": "w >= 3", "user": "(src + dst) % 5 = w"}
    masks = {"inside": "src in (select id from g where degree > 2)", "outside": "src not in (select id from g where degree > 2)", "valued": "src % 2 = 1", "valued outside": "src % 2 = 0"}
    samples = [(0, 1, 15), (1, 42, 50)]
    kinds = {"bool": (1, "boolean"), "int8_t": (1, "tinyint"), "int16_t": (2, "smallint"), "int32_t": (4, "int"), "int64_t": (8, "bigint"), "uint8_t": (1, "smallint"), "uint16_t": (2, "int"), "uint32_t": (4, "bigint"), "uint64_t": (8, "decimal(20,0)"), "float": (4, "float"), "double": (8, "double")}
    heavy = MOVES.replace("e as materialized (select u", "e0 as materialized (select u").replace("v as (select src as id from e union select dst from e)", "e as materialized (select * from e0 where w > 1), v as (select src as id from e0 union select dst from e0)")
    source = "(select min(id) from v)"
    reach = f"d(id, l) using key (id) as (select {source}, 0::bigint union select e.dst, min(c.l + e.w) from d c join e on e.src = c.id left join recurring.d r on r.id = e.dst where r.l is null or c.l + e.w < r.l group by 1)"
    tight = f"k as materialized (select e.src, e.dst from e join d a on a.id = e.src join d b on b.id = e.dst where a.l + e.w = b.l), h(id, h) using key (id) as (select {source}, 0::bigint union select k.dst, min(c.h + 1) from h c join k on k.src = c.id left join recurring.h r on r.id = k.dst where r.h is null or c.h + 1 < r.h group by 1)"
    parents = "coalesce((select min(k.src) + 1 from k join h b on b.id = k.src where k.dst = d.id and b.h = h.h - 1), 0)"
    return {
        "matrix_market_round_trip": f"{t} select src, dst, w from e",
        "collection_round_trip": f"{t} select 'moves' as item, src, dst, w from e union all select 'marks', id, -1, x from y union all select 'two items', -1, -1, 0",
        "triples_round_trip": f"{t} select src, dst, w from e",
        "equality": "select * from (values ('itself', true), ('other values', false), ('other type', false), ('fewer entries', false), ('by comparator', true), ('types may differ by comparator', true), ('vector itself', true), ('vector by comparator', true), ('vector other values', false), ('not a number', false)) as x(what, same)",
        "build_duplicates": f"with {raw} " + " union all ".join(f"select '{how}' as how, src, dst, {of}(w)::bigint as w from raw group by 2, 3" for how, of in (("plus", "sum"), ("min", "min"), ("max", "max"))),
        "prepared_graph": f"with {raw}, m as (select src % 50 as src, dst % 50 as dst, abs(w - 25)::bigint as w from raw), k as (select * from m where src <> dst and w <> 0) select src, dst, max(w) as w from (select * from k union all select dst, src, w from k) group by 1, 2",
        "set_extract_element": f"{t}, f as (select w from e order by src, dst limit 1) select 'old' as what, (select w from f)::bigint as x union all values ('none', null), ('over', 99), ('new', 7), ('entries more', 1)",
        "masked_writes": f"{t}, {deg}, {union} " + " union all ".join(parts),
        "masked_products": f"{t}, {deg} " + " union all ".join(f"select '{name}' as kind, src as id, sum(w * x)::bigint as x from e join y on y.id = dst where {where} group by src" for name, where in masks.items()),
        "gather_vector": f"{p}, {deg}, k as (select id, row_number() over (order by degree, id) - 1 as position from g) select position as id, id % 7 + 1 as x from k",
        "scatter_min": f"{t}, {deg} select id % 11 as id, min(degree) as x from g group by 1",
        "reduce_all": f"{t} select 'plus' as monoid, sum(w)::bigint as x from e union all select 'min', min(w) from e union all select 'max', max(w) from e union all select 'lor', bool_or(w > 2)::bigint from e union all select 'land', bool_and(w > 0)::bigint from e",
        "reduce_columns_max": f"{t} select dst as id, max(w) as x from e group by 1",
        "select_predicates": f"{t} " + " union all ".join(f"select '{name}' as predicate, count(*)::bigint as entries, coalesce(sum(w), 0)::bigint as total from e where {where}" for name, where in predicates.items()),
        "apply_bound": f"{t} select src, dst, 3 * w + src - dst as w from e",
        "extract_tuples": f"{t} select src, dst, w from e",
        "diagonal_scale": f"{t} select src, dst, w * (src % 7 + 1) as w from e",
        "diagonal_of_square": f"{t} select a.src as id, sum(a.w * b.w)::bigint as x from e a join e b on a.dst = b.src and b.dst = a.src group by 1",
        "mxv_min_secondi": f"{t} select src as id, min(dst) as x from e group by 1",
        "vxm_any_firstj": f"{t} select dst as id, max(src) as x from e group by 1",
        "mxm_max_first": f"{t} select a.src, b.dst, max(a.w) as w from e a join e b on a.dst = b.src semi join e m on m.src = a.src and m.dst = b.dst group by 1, 2",
        "mxv_plus_div": f"{t} select src as id, round(sum(w::double / x), 6) as x from e join y on y.id = dst group by 1",
        "mxv_lor_eq": f"{t} select src as id, bool_or(w = x) as x from e join y on y.id = dst group by 1",
        "vxm_user_semiring": f"{t}, k as (select dst as id, w, x * 10 + w as mark, row_number() over (partition by dst order by w desc, x * 10 + w desc) as r from e join y on y.id = src) select id, w, mark from k where r = 1",
        "vector_structure": f"{t} select id, true as x from y where x > 3",
        "copy_directed": f"{t} select src, dst, w from e",
        "weak_components": f"{t}, l as (select src, dst from e union select dst, src from e), c(v, l) using key (v) as (select id, id from v union select l.dst, min(c.l) from c join l on l.src = c.v join recurring.c r on r.v = l.dst where c.l < r.l group by l.dst) select v as id, l as component from c",
        "bellman_ford_dense": f"with recursive {heavy}, {reach}, {tight} select v.id, coalesce(f.d, 'infinity'::double) as d, coalesce(f.h, {2**63 - 1}) as h, coalesce(f.pi, 0) as pi from v left join (select d.id, d.l::double as d, h.h, {parents} as pi from d join h using (id)) f using (id)",
        "triangles_presort_asked": f"{p}, {TRI} select count(*)::bigint as triangles from tri",
        "sample_degree": f"{p}, {deg}, " + ", ".join(_SAMPLE.format(k=k, seed=seed, samples=n) for k, seed, n in samples) + " " + " union all ".join(f"select any_value(seed) as seed, any_value(samples) as samples, round(sum(degree)::double / {n}, 6) as mean, (list_sort(list(degree)))[{n // 2 + 1}]::bigint as median from s{k}" for k, _, n in samples),
        "random_matrix_report": "select unnest(['bool', 'int8_t', 'uint16_t', 'int64_t', 'float', 'double']) as kind, true as well_formed, true as same_seed, false as other_seed, 42::bigint as full_entries",
        "type_names": "select * from (values " + ", ".join(f"('{kind}', {size}::bigint, '{stored}')" for kind, (size, stored) in kinds.items()) + ") as x(kind, bytes, stored)",
    }
