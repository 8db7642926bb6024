"""Near duplicates: banded MinHash, odd sketches, and confirmation on the full shingle sets.

Documents with equal shingle sets form classes, and only classes are compared. Each class has 128 MinHash samples in 32
bands of 4 (a pair at similarity 0.8 shares no band once in 20 million) and an odd sketch: the samples folded into a
256-bit parity map, so that the bits in which two sketches differ estimate high similarities sharply. A second parity
map, of the whole shingle set, differs in at most as many bits as the sets differ in shingles, and so rules pairs out
without any error. A bucket is not expanded into pairs. First its members are held against its least one; what that links is merged. Where buckets then
still span several components, classes that have too much of their own for any link drop out, the others are held
against the class with most in common with its bucket, and last members outside the largest component against those of
other components. Every pair of a bucket is thus confirmed, ruled out or already connected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.llm.common import settled, text_or_empty, written
from tropica.llm.substrings import _groups, _signed, mix, pair, runs, word_hashes
from tropica.operators.components import components

SHINGLE, THRESHOLD = 5, 80
BANDS, ROWS, SKETCH_BITS, PARITY_BITS = 32, 4, 256, 1024
#: Sketches rule a pair out only where they estimate a similarity this far below the threshold (five deviations).
MARGIN = 0.2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DRAWS = np.random.default_rng(20_161)
_FACTORS = _DRAWS.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _DRAWS.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted hashes; fewer words than a shingle make one of them all."""
    words, sizes = word_hashes([t.translate(_LOWER) for t in texts])
    shingles, at, out = runs(words, size), 0, []
    for n in sizes.tolist():
        whole = shingles[at : at + n - size + 1] if n >= size else runs(words[at : at + n], n) if n else words[:0]
        out.append(np.unique(whole))
        at += n
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a nonempty set: under each random order its least shingle."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (part[:, None] * _FACTORS).min(axis=0), out=least)
    return mix(least ^ _SALTS)


def odd_sketch(found: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    bits = np.bincount((found % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def differing_bits(threshold: float) -> int:
    """Most bits in which sketches differ while their estimate, 1 + n / 4k * ln(1 - 2x / n), reaches the threshold."""
    n, k = SKETCH_BITS, BANDS * ROWS
    return int(np.floor(n / 2 * (1 - np.exp(4 * k / n * (threshold - 1)))))


SIGNATURES = "doc_id long, k1 long, k2 long, n int, c1 long, c2 long, sketch array<long>, parity array<long>, bands array<long>"


def signatures(keyed: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for at, texts in _groups(batch, 3):
                sets = shingle_sets(texts, size)
                found = [samples(s) if len(s) else None for s in sets]
                bands = [None if f is None else reduce(pair, f.reshape(BANDS, ROWS).T) ^ salts for f in found]
                sketches = [None if f is None else odd_sketch(f) for f in found]
                parities = [odd_sketch(s, PARITY_BITS) for s in sets]
                of_class = [(int(mix(s).sum()), int(mix(s ^ _SALTS[0]).sum())) if len(s) else (0, 0) for s in sets]
                rows = slice(at, at + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i)[rows] for i in range(3)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        *(_signed(np.array([c[i] for c in of_class], dtype=np.uint64)) for i in (0, 1)),
                        *(pa.array([None if x is None else x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in (sketches, parities, bands)),
                    ],
                    names=[f.split()[0] for f in SIGNATURES.split(", ")],
                )

    return keyed.mapInArrow(sign, SIGNATURES)


def _fetch(ids: DataFrame, classes: DataFrame, keyed: DataFrame, size: int) -> DataFrame:
    """(c1, shingles) of classes ids(c1), from one text of each."""
    at = classes.join(ids.distinct(), "c1", "left_semi").select("c1", "at.k1", "at.k2")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _groups(batch, 1):
                sets = [s.view(np.int64) for s in shingle_sets(texts, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start : start + len(texts)], pa.array(sets, pa.list_(pa.int64()))], names=["c1", "shingles"])

    return written(keyed.join(at, ["k1", "k2"]).dropDuplicates(["c1"]).select("c1", "text").mapInArrow(fetch, "c1 long, shingles array<long>"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) that the full sets confirm."""
    a = sets.select(F.col("c1").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("c1").alias("v"), F.col("shingles").alias("b"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
    union = F.size("a") + F.size("b") - F.col("shared")
    return written(both.where(100 * F.col("shared") >= threshold * union).select("u", "v"), "links")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id and kept.

    Words are runs without ASCII white space, A-Z in lower case. Two documents are linked if their sets of shingles
    have a Jaccard similarity of at least threshold / 100. component_id is the smallest doc_id that links reach, kept
    marks it. Null, empty and blank texts have an empty set and stay alone. Null doc_id take part, but never name a
    component while a doc_id is there; rows that repeat a doc_id are all kept or all not."""
    placed = _placed(docs, size, threshold)
    return placed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_rows(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The keys (k1, k2) of rows to keep, with linked (null for rows without words, which all stay): of each component
    the row with the smallest doc_id, null last, and of several rows of that doc_id the one with the least k1."""
    placed = settled(lambda: _placed(docs, size, threshold).select("doc_id", "k1", "k2", "component"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "k2", "k1")).alias("first")
    linked = placed.where("component is not null").groupBy("component").agg(first).select("first.k1", "first.k2", F.lit(True).alias("linked"))
    return linked.unionByName(placed.where("component is null").select("k1", "k2", F.lit(None).cast("boolean").alias("linked")).distinct())


def _placed(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Per row doc_id, k1, k2, n, component and component_id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    keyed = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("k2"), "text")
    rows = written(signatures(keyed, size), "signatures")
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"), F.first("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("at"))
    classes = written(classes, "classes")
    bands = classes.select(F.explode("bands").alias("band"), F.col("c1").alias("v"))
    leaders = written(bands.groupBy("band").agg(F.min("v").alias("u"), F.count("*").alias("c")).where("c > 1").drop("c"), "leaders")
    shared = written(bands.join(leaders, "band"), "buckets")  # every class in a bucket of two or more, with its leader
    sketch = classes.select("c1", "n", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_BITS // 64)), *(F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_BITS // 64)))

    def differing(a: str, b: str, name: str, size: int):
        each = [F.bit_count(F.col(f"{a}.{name}{i}").bitwiseXOR(F.col(f"{b}.{name}{i}"))) for i in range(size // 64)]
        return reduce(lambda x, y: x + y, each)

    def similar(a: str, b: str):
        """What sizes and sketches leave possible."""
        sizes = (100 * F.least(f"{a}.n", f"{b}.n")) >= threshold * F.greatest(f"{a}.n", f"{b}.n")
        # Linked sets differ in at most (1 - t) / (1 + t) of their joint size, their parity maps in no more bits.
        apart = (100 + threshold) * differing(a, b, "p", PARITY_BITS) <= (100 - threshold) * (F.col(f"{a}.n") + F.col(f"{b}.n"))
        return sizes & (differing(a, b, "s", SKETCH_BITS) <= differing_bits(threshold / 100 - MARGIN)) & apart

    def in_order(a: str, b: str) -> tuple:
        return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")

    led = shared.where("u <> v").select("u", "v").distinct()
    led = written(led.join(sketch.alias("a"), F.col("u") == F.col("a.c1")).join(sketch.alias("b"), F.col("v") == F.col("b.c1")).where(similar("a", "b")).select("u", "v"), "pairs")
    links = _confirm(led, _fetch(led.select(F.explode(F.array("u", "v")).alias("c1")), classes, keyed, size), threshold)
    part = components(links)

    def mixed(buckets: DataFrame) -> DataFrame:
        """Members of buckets(band, v, ...) that span several components, with their own and the bucket's largest one."""
        inside = buckets.join(part.select(F.col("id").alias("v"), "component"), "v", "left").withColumn("component", F.coalesce("component", "v"))
        inside = written(inside, "inside")
        sizes = inside.groupBy("band", "component").agg(F.count("*").alias("c"))
        several = sizes.groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        return written(inside.join(written(several, "several"), "band"), "mixed")

    open_ = mixed(shared.select("band", "v"))
    if not open_.isEmpty():
        # A shingle that no other open class has is in no intersection: classes with too few others have no links left.
        sets = _fetch(open_.select(F.col("v").alias("c1")), classes, keyed, size)
        alone = sets.select("c1", F.explode("shingles").alias("g")).groupBy("g").agg(F.count("*").alias("c"), F.min("c1").alias("c1")).where("c = 1").groupBy("c1").agg(F.count("*").alias("alone"))
        alive = sketch.join(sets.select("c1"), "c1", "left_semi").join(alone, "c1", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
        alive = written(alive.where(100 * F.col("common") >= threshold * F.col("n")).drop("alone"), "alive")

        def possible(a: str, b: str):
            both = F.least(f"{a}.common", f"{b}.common")
            return similar(a, b) & (100 * both >= threshold * (F.col(f"{a}.n") + F.col(f"{b}.n") - both))

        # Next every other component is held against the class that has most in common with the rest of its bucket.
        rest = open_.select("band", "v", "component").join(alive, F.col("v") == F.col("c1")).drop("c1")
        centre = rest.groupBy("band").agg(F.max_by(F.struct("v", "component"), F.struct(F.col("common") / F.col("n"), "n", "v")).alias("m"))
        to_centre = rest.select("band", "v", "component").join(written(centre, "centres"), "band").where("component <> m.component").select(*in_order("v", "m.v")).distinct()
        to_centre = to_centre.join(alive.alias("a"), F.col("u") == F.col("a.c1")).join(alive.alias("b"), F.col("v") == F.col("b.c1")).where(possible("a", "b")).select("u", "v")
        to_centre = written(to_centre.join(led, ["u", "v"], "left_anti"), "to-centre")
        links = written(links.unionByName(_confirm(to_centre, sets, threshold)), "links")
        part = components(links)
        # What is still apart: members outside a bucket's largest component against all members of other components.
        last = mixed(rest.select("band", "v")).join(alive, F.col("v") == F.col("c1")).drop("c1")
        a, b = last.where("component <> largest").alias("a"), last.alias("b")
        across = (F.col("a.band") == F.col("b.band")) & (F.col("a.component") != F.col("b.component")) & ((F.col("a.v") < F.col("b.v")) | (F.col("b.component") == F.col("b.largest")))
        more = a.join(b, across & possible("a", "b")).select(*in_order("a.v", "b.v")).distinct()
        more = written(more.join(led, ["u", "v"], "left_anti").join(to_centre, ["u", "v"], "left_anti"), "across")
        part = components(links.unionByName(_confirm(more, sets, threshold)))
    placed = rows.select("doc_id", "k1", "k2", "n", F.when(F.col("n") > 0, F.col("c1")).alias("v"))
    placed = placed.join(part.select(F.col("id").alias("v"), "component"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    least = placed.where("v is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    least = written(least, "least")
    return placed.join(least, "component", "left").withColumn("component_id", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("least")))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, size=4)


OP5_SQL = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
c(v, l) using key (v) as (select doc_id, doc_id from n union select e.b, min(c.l) from c join e on e.a = c.v join recurring.c r on r.v = e.b where c.l < r.l group by e.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.l, d.doc_id) as component_id, coalesce(c.l, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join c on c.v = d.doc_id
"""
