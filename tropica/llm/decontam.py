"""Benchmark decontamination by templates, in DataFrame functions alone.

Words become template tokens: numbers, units after numbers and capitalised words inside sentences turn into typed
placeholders, others into lower case. Capitals tell no names where a text is in capitals or title case, so every window
is also compared without names, its words folded. Windows of 13 template tokens of the benchmark are hash-joined with the documents
through an anchor, the longest literal word of the window, so that only places that hold an anchor are compared. A match
then has to fill the placeholders of its window consistently: one value of the question stands for one value of the
document. Windows that have the words of the question itself count whatever values others have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropica.llm.common import written

#: Template tokens of a window; shorter items count whole, below SHORTEST only word for word.
WINDOW, SHORTEST = 13, 8
#: Literal tokens that a template needs, so that placeholders alone never match; windows with fewer count word for word.
LITERALS = 6
#: Up to this many benchmark windows (some 200 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
#: Up to this many different anchors are listed in the plan.
LISTED_ANCHORS = 20_000
UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent meter meters metre metres mile miles gram grams liter liters litre litres degree degrees".split()
_NUMBER, _NAME, _UNIT = "<num>", "<name>", "<unit>"


def words(text: Column) -> Column:
    """Words with their sentence ends: digits joined over separators, punctuation that follows no word dropped."""
    text = F.concat(F.lit(" "), text)
    for _ in range(2):
        text = F.regexp_replace(text, r"(\p{N})[.,](\p{N})", "$1$2")
    text = F.regexp_replace(text, r"([^\p{L}\p{N}%$€£])[.!?']+", "$1 ")
    return F.filter(F.split(text, r"[^\p{L}\p{N}%$€£.!?']+"), lambda w: w != "")


def literal(word: Column) -> Column:
    return F.translate(F.lower(word), ".!?'", "")


def token(word: Column, before: Column, names: bool = True) -> Column:
    """The template token of a word, given the word before it (null at the start); without names capitals say nothing."""
    number = lambda w: w.rlike(r"^[$€£]?\p{N}+[%$€£]?[.!?']*$")
    found = F.when(number(word), _NUMBER).when(number(before) & literal(word).isin(UNITS), _UNIT)
    if names:
        found = found.when(word.rlike(r"^\p{Lu}") & before.rlike(r"[^.!?]$"), _NAME)
    return found.otherwise(literal(word))


def template(of: Column, start: Column, size: Column, names: bool = True) -> Column:
    """The template tokens of the words from place start (from 0) on."""
    return F.transform(F.sequence(start, start + size - 1), lambda i: token(F.get(of, i), F.get(of, i - 1), names))


def benchmark_windows(benchmark: DataFrame, window: int, shortest: int) -> DataFrame:
    """One row for each window of benchmark(item_id, text): item_id, q, size, win, bare, own (folded words), anchor, off and the item's words iw.

    win has names as placeholders, bare has none; they are null where too few literal words are left."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", words(F.col("text")).alias("iw"))
    items = items.where(F.size("iw") > 0).withColumn("size", F.least(F.lit(window), F.size("iw")))
    items = items.withColumn("q", F.explode(F.sequence(F.lit(0), F.size("iw") - F.col("size"))))
    items = items.withColumns({"win": template(F.col("iw"), F.col("q"), F.col("size")), "bare": template(F.col("iw"), F.col("q"), F.col("size"), names=False)})
    plain = lambda of: F.filter(of, lambda w: ~w.isin(_NUMBER, _NAME, _UNIT))
    enough = lambda of: F.when((F.size("iw") >= shortest) & (F.size(plain(of)) >= F.least(F.lit(LITERALS), F.col("size"))), F.col(of))
    items = items.withColumns({"win": enough("win"), "bare": enough("bare"), "own": F.transform(F.slice("iw", F.col("q") + 1, F.col("size")), literal)})
    items = items.withColumn("plain", F.coalesce(plain("win"), plain("bare"), "own"))  # what is literal in one is so in the next
    longest = F.array_max(F.transform("plain", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    items = items.withColumn("anchor", longest["w"]).withColumn("off", (F.array_position(F.coalesce("win", "bare", "own"), F.col("anchor")) - 1).cast("int"))
    return items.select("item_id", "q", "size", "win", "bare", "own", "anchor", "off", F.slice("iw", F.col("q") + 1, F.col("size")).alias("iw"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """Consistent window matches (k, item_id, p, q) of docs(k, text): window q of the item stands at word p."""
    found = written(benchmark_windows(benchmark, window, shortest), "benchmark")
    texts = docs.where(F.col("text").isNotNull()).select("k", words(F.col("text")).alias("w"))
    anchors = [r["anchor"] for r in found.select("anchor").distinct().limit(LISTED_ANCHORS + 1).collect()]
    if len(anchors) <= LISTED_ANCHORS:
        places = F.array_compact(F.transform("w", lambda x, i: F.when(literal(x).isin(anchors), i)))
        texts = texts.withColumn("places", places).where(F.size("places") > 0)
    else:  # too many to list in the plan: places that hold an anchor are found by a join of hashes
        each = texts.select("k", F.posexplode("w").alias("at", "x")).select("k", "at", literal(F.col("x")).alias("anchor"))
        held = each.join(found.select("anchor").distinct(), "anchor", "left_semi").groupBy("k").agg(F.collect_set("at").alias("places"))
        texts = texts.dropDuplicates(["k"]).join(held, "k")
    # Only the neighbourhood of a place travels on, however long the text is.
    base = lambda i: F.greatest(i - window, F.lit(0))
    around = F.transform("places", lambda i: F.struct(base(i).alias("shift"), (i - base(i)).alias("at"), F.slice("w", base(i) + 1, 2 * window + 1).alias("w"), literal(F.get("w", i)).alias("anchor")))
    placed = texts.select("k", F.explode(around).alias("x")).select("k", "x.*")
    small = found.count() <= BROADCAST_WINDOWS
    joined = placed.join(F.broadcast(found) if small else found, "anchor")
    joined = joined.withColumn("start", F.col("at") - F.col("off")).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.size("w")))
    # Literal words of both templates first: they cost least and rule most places out.
    same = lambda t, i: t.isin(_NUMBER, _NAME, _UNIT) | (literal(F.get("w", F.col("start") + i)) == t)
    joined = joined.where(F.forall(F.transform(F.coalesce("win", "bare", "own"), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: same(x["t"], x["i"])))
    of = lambda names: template(F.col("w"), F.col("start"), F.col("size"), names)
    joined = joined.withColumn("win", F.when(of(True) == F.col("win"), F.col("win")).when(of(False) == F.col("bare"), F.col("bare")).when(F.transform(F.slice("w", F.col("start") + 1, F.col("size")), literal) == F.col("own"), F.col("own"))).where("win is not null")
    joined = joined.select("k", "item_id", (F.col("start") + F.col("shift")).alias("p"), "q", "win", "iw", F.slice("w", F.col("start") + 1, F.col("size")).alias("dw"))
    # Slots are judged inside the window: one value of the item stands for one value of the document. An edited value
    # elsewhere says nothing against it, and windows that are the item's own words count whatever they hold.
    folded = lambda of: F.transform(of, literal)
    filled = F.filter(F.arrays_zip(F.col("win").alias("t"), folded("iw").alias("i"), folded("dw").alias("d")), lambda x: x["t"].isin(_NUMBER, _NAME, _UNIT))
    values = lambda *names: F.size(F.array_distinct(F.transform("filled", lambda x: F.struct(*(x[n] for n in names)))))
    joined = joined.withColumns({"filled": filled, "own": folded("iw") == folded("dw")})
    return joined.where(F.col("own") | (values("t", "i") == values("t", "i", "d"))).select("k", "item_id", "p", "q")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """docs with contaminated, n_windows and item_ids (the items found, ascending; empty where none).

    Null and empty texts, an empty table and an empty benchmark give no matches, nor do items without words. Items with
    fewer than 8 words count where they occur whole, word for word but for case, as do windows with hardly a literal word. Rows that repeat are judged alike; other columns pass through,
    those named like the result are replaced."""
    docs = docs.drop("contaminated", "n_windows", "item_ids")
    key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("b"))
    rows = docs.select(key.alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # names of the caller stay apart from those used here
    found = matches(docs.select(key.alias("k"), "text").where("text is not null"), benchmark, window, shortest)
    hits = found.distinct().groupBy("k").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("item_id")).alias("ids"))
    n, ids = F.coalesce("n", F.lit(0)).alias("n_windows"), F.coalesce("ids", F.array().cast("array<long>")).alias("item_ids")
    return rows.join(hits, "k", "left").select("row.*", F.col("n").isNotNull().alias("contaminated"), n, ids)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, benchmark)
    return found.select("doc_id", "contaminated", F.col("n_windows").cast("long").alias("n_windows"), F.array_join("item_ids", ",").alias("item_ids"))


def _sql_words(table: str, key: str) -> str:
    """Of every text its words w, template tokens with names t and without b, and folded words o, for brute force in SQL."""
    text = "' ' || text"
    for _ in range(2):
        text = rf"regexp_replace({text}, '(\p{{N}})[.,](\p{{N}})', '\1\2', 'g')"
    text = rf"regexp_replace({text}, '([^\p{{L}}\p{{N}}%$€£])[.!?'']+', '\1 ', 'g')"
    split = rf"list_filter(string_split_regex({text}, '[^\p{{L}}\p{{N}}%$€£.!?'']+'), lambda x: x <> '')"
    plain = "translate(lower({0}), '.!?''', '')"
    number = r"regexp_matches({0}, '^[$€£]?\p{{N}}+[%$€£]?[.!?'']*$')"
    units = ", ".join(f"'{u}'" for u in UNITS)
    word, before = "w[i]", "coalesce(case when i > 1 then w[i - 1] end, '.')"
    typed = f"case when {number.format(word)} then '<num>' when {number.format(before)} and {plain.format(word)} in ({units}) then '<unit>'"
    name = rf"when regexp_matches({word}, '^\p{{Lu}}') and regexp_matches({before}, '[^.!?]$') then '<name>'"
    each = lambda value: f"list_transform(range(1, len(w) + 1), lambda i: {value})"
    return f"select id, w, {each(f'{typed} {name} else {plain.format(word)} end')} as t, {each(f'{typed} else {plain.format(word)} end')} as b, {each(plain.format(word))} as o from (select {key} as id, {split} as w from {table} where text is not null)"


def oracle() -> str:
    """Every window of every item held against every window of every document: equal with names as placeholders, equal
    without, or equal word for word; the first two only where enough literal words are left and placeholders are filled
    consistently inside the window."""
    part = lambda c: f"{c}[p:p + n - 1]"
    slots = "('<num>', '<name>', '<unit>')"
    enough = lambda c: f"case when long and len(list_filter({part(c)}, lambda x: x not in {slots})) >= least({LITERALS}, n) then array_to_string({part(c)}, ' ') end"
    pairs = lambda c, extra: f"len(list_distinct(list_transform(list_filter(range(1, n + 1), lambda i: {c}[i] in {slots}), lambda i: {c}[i] || ' ' || iv[i]{extra})))"
    fits = lambda c: pairs(c, "") + " = " + pairs(c, " || ' ' || dv[i]")
    by = lambda key, c: f"select dw.id as doc_id, bw.id as item_id, dw.p, bw.p as q, dw.n, {c} as c, bw.iv, dw.dv from dw join bw on dw.n = bw.n and dw.{key} = bw.{key}"
    return f"""
with d as materialized ({_sql_words("documents", "doc_id")}), i as materialized ({_sql_words("benchmark", "item_id")}),
iw as (select id, unnest(range(1, len(w) - n + 2)) as p, n, t, b, o, len(w) >= {SHORTEST} as long from (select *, least({WINDOW}, len(w)) as n from i) where n > 0),
bw as materialized (select id, p, n, {part('t')} as t, {part('b')} as b, {part('o')} as iv, {enough('t')} as kt, {enough('b')} as kb, array_to_string({part('o')}, ' ') as ko from iw),
sizes as (select distinct n from bw),
dp as (select id, n, unnest(range(1, len(w) - n + 2)) as p, t, b, o from d, sizes where len(w) >= n),
dw as materialized (select id, p, n, {part('o')} as dv, array_to_string({part('t')}, ' ') as kt, array_to_string({part('b')}, ' ') as kb, array_to_string({part('o')}, ' ') as ko from dp),
m as (select * from ({by('kt', 'bw.t')}) where {fits('c')} union all select * from ({by('kb', 'bw.b')}) where {fits('c')} union all {by('ko', 'bw.t')}),
h as (select doc_id, count(distinct (item_id, p, q)) as n, array_to_string(list_sort(list(distinct item_id)), ',') as ids from m group by doc_id)
select x.doc_id, h.n is not null as contaminated, coalesce(h.n, 0)::bigint as n_windows, coalesce(h.ids, '') as item_ids from documents x left join h using (doc_id)
"""
