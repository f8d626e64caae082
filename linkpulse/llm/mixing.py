"""Mixing sources to target weights, by exact block quotas and a splitting tree over output shards.

DataFrame functions only. The steps:

1. Every source gets a target number of words: its weight's part of `share` times all words, at most `most_copies` times its own,
   the excess given to the others by weight (water filling).
2. A source's documents are dealt into blocks by a hash: a random permutation of them, cut into about
   `BLOCK_WORDS` words each. Block numbers need no ranking, so a source with a third of all rows stays spread out.
3. The target fixes how many passes over all blocks and how many blocks of one more pass are drawn. Prefix sums over
   block sizes, first by groups of blocks, then inside one group, find the block in which the target falls; from this one
   the documents that fill the rest best are taken, longest first.
4. A tree over the output shards splits the drawn blocks: at each node the number of blocks of each source that go
   left is a draw from the multivariate hypergeometric distribution, so that the shards are what cutting a
   random order of all drawn blocks would give, while every quota stays exact.
5. A shard takes the next blocks of each source's permutation, and shuffles its documents by another hash. How often a
   document is taken is how many of its blocks' places the shards got.

Reruns agree: all randomness comes from hashes of the seed and of `doc_id` and text.

Defined results: null and empty texts have size 0, are never taken and change nothing. A null source is one more source, the last.
Repeated rows are documents of their own; rows equal in id and text share a block. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_WORDS = 65_536
GROUP_BLOCKS = 1_024
SHARD_WORDS = 1 << 22
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """`docs` with a struct `__mix` of source, size and hash."""
    text = text_of(docs)
    order = F.xxhash64(F.lit(seed), docs["doc_id"], text)
    return docs.withColumn("__mix", F.struct(docs["source"].alias("source"), size_of(text).alias("size"), order.alias("h")))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: its words, weight and target. One row a source goes through a window, no documents do."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    weighted = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_COPIES)
    up = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.col("all_words") * SHARE - F.col("full")) / F.col("open_weight")
    filled = weighted.withColumns(
        {
            "all_words": F.sum("source_size").over(W.partitionBy()),
            "full": F.sum("cap").over(up) - F.col("cap"),
            "open_weight": F.sum("weight").over(W.partitionBy()) - F.sum("weight").over(up) + F.col("weight"),
        }
    ).withColumn("level", F.when(F.col("cap") >= F.col("weight") * level, level))
    found = F.max("level").over(W.partitionBy())
    return filled.select(
        "source", "source_size", "weight",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * found, F.lit(0.0))).alias("target"),
    )


def plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quotas of every source, and the documents taken from its last block.

    `sizes` has source, size and h of every document and is read several times: give a stored table.
    """
    goal = stored(targets(sizes), "targets")
    blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1)).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumns({"blocks": blocks, "passes": passes}).withColumn(
        "rest", (F.col("target") - F.col("passes") * F.col("source_size")).cast("double")
    )
    in_block = join_source(sizes, goal, "blocks", "rest").withColumn("block", block_of("h", "blocks"))
    per_block = stored(
        in_block.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "blocks"
    )
    cut = _cut_block(per_block)
    goal = join_source(goal, cut, "cut", "missing", how="left").withColumns(
        {"cut": F.coalesce("cut", F.lit(0)), "missing": F.coalesce("missing", F.lit(0.0))}
    )
    goal = stored(goal, "goal")
    last = join_source(sizes, goal.filter("missing > 0"), "blocks", "cut", "missing").filter("size > 0")
    last = last.filter(block_of("h", "blocks") == F.col("cut"))
    picks = stored(_best_fill(last), "picks")
    return goal, picks


def shards_for(quotas: DataFrame, shard_words: int = SHARD_WORDS) -> int:
    """A power of two, so that a shard holds at most about `shard_words` words."""
    words = quotas.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    shards = 1
    while shards * shard_words < words:
        shards *= 2
    return shards


def join_source(left: DataFrame, right: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """`left` with columns of the right row of the same source, null equal to null."""
    other = right.select(F.col("source").alias("__source"), *columns)
    kept = left.drop(*columns)
    return kept.join(other, kept["source"].eqNullSafe(F.col("__source")), how).drop("__source")


def block_of(h: str, blocks: str) -> Column:
    return F.pmod(F.col(h), F.col(blocks))


def _cut_block(per_block: DataFrame) -> DataFrame:
    """Per source, the block in which its rest runs out and the words missing before it.

    Sums over groups of blocks come first, so that no window holds more than a source's groups or one group's blocks.
    """
    grouped = per_block.withColumn("g", F.floor(F.col("block") / GROUP_BLOCKS))
    sums = grouped.groupBy("source", "g").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("g")) - F.col("words")
    hit = sums.withColumn("before", before).filter("before <= rest AND before + words > rest")
    hit = hit.select(F.col("source").alias("__s"), F.col("g").alias("__g"), F.col("before").alias("ahead"))
    inside = grouped.join(hit, F.col("source").eqNullSafe(F.col("__s")) & (F.col("g") == F.col("__g"))).drop("__s", "__g")
    upto = F.sum("words").over(W.partitionBy("source").orderBy("block")) + F.col("ahead")
    found = inside.withColumn("upto", upto).filter("upto - words <= rest AND upto > rest")
    return found.select("source", F.col("block").alias("cut"), (F.col("rest") - F.col("upto") + F.col("words")).alias("missing"))


def _best_fill(last: DataFrame) -> DataFrame:
    """From each source's cut block, documents whose sizes add up to what is missing: longest first, each that still
    fits, then one more if that comes nearer. Rows equal in source, size and hash are taken together.

    A block holds about BLOCK_WORDS words, so its list is bounded by that number.
    """
    twins = last.groupBy("source", "h", "size").agg(F.count("*").alias("n"), F.first("missing").alias("missing"))
    item = F.struct((F.col("size") * F.col("n")).alias("words"), "h", "size")
    rows = twins.groupBy("source").agg(
        F.first("missing").alias("missing"), F.reverse(F.array_sort(F.collect_list(item))).alias("docs")
    )
    kind = "array<struct<words:bigint,h:bigint,size:bigint>>"
    start = F.struct(F.col("missing").alias("left"), F.array().cast(kind).alias("got"))
    step = lambda acc, d: F.when(
        d["words"] <= acc["left"],
        F.struct((acc["left"] - d["words"]).alias("left"), F.concat(acc["got"], F.array(d)).alias("got")),
    ).otherwise(acc)
    filled = rows.withColumn("f", F.aggregate("docs", start, step))
    extra = F.filter(
        F.array_except("docs", F.col("f.got")), lambda d: d["words"] - F.col("f.left") < F.col("f.left")
    )
    chosen = F.concat(F.col("f.got"), F.slice(F.array_sort(extra), 1, 1))
    return filled.select("source", F.explode(chosen).alias("d")).select("source", "d.h", "d.size")


def split_tree(goal: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """`(key, shard, k, start)`: how many of a source's drawn blocks each shard takes, and after how many.

    One row holds the quotas of all sources at a node; a level makes two rows of each. The parts of all
    shards add up to every source's quota.
    """
    drawn = F.col("passes") * F.col("blocks") + F.col("cut") + F.when(F.col("missing") > 0, 1).otherwise(0)
    drawn = F.when(F.col("source_size") > 0, drawn).otherwise(0).cast("long")
    quotas = F.array_sort(F.collect_list(F.struct(source_key().alias("key"), drawn.alias("k"))))
    nodes = goal.agg(quotas.alias("q")).select(F.lit(0).cast("long").alias("node"), F.lit(shards).alias("width"), "q")
    while shards > 1:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, s: a + s["k"])
        half = F.col("width") / 2
        first = F.struct(
            total.alias("population"), F.floor(total / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("x")
        )

        def draw(acc, s):
            u = (F.pmod(F.xxhash64(F.lit(seed), "node", "width", s["key"]), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
            x = hypergeometric(acc["population"], s["k"], acc["draws"], u)
            return let(
                x,
                lambda v: F.struct(
                    (acc["population"] - s["k"]).alias("population"), (acc["draws"] - v).alias("draws"),
                    F.concat(acc["x"], F.array(v)).alias("x"),
                ),
            )

        drawn = nodes.withColumn("x", F.aggregate("q", first, draw)["x"])
        left = F.transform("q", lambda s, i: F.struct(s["key"].alias("key"), F.col("x")[i].alias("k")))
        right = F.transform("q", lambda s, i: F.struct(s["key"].alias("key"), (s["k"] - F.col("x")[i]).alias("k")))
        sides = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")),
        )
        nodes = drawn.select(F.explode(sides).alias("s"), half.cast("int").alias("width")).select("s.node", "width", "s.q")
        shards //= 2
    parts = nodes.select("node", F.explode("q").alias("s")).select("s.key", F.col("node").alias("shard"), "s.k")
    upto = F.sum("k").over(W.partitionBy("key").orderBy("shard"))
    return parts.withColumn("start", upto - F.col("k"))


def places(quotas: DataFrame, parts: DataFrame) -> DataFrame:
    """`(source, place, shard)` of every drawn block: a source's places count through its passes and blocks."""
    own = parts.filter("k > 0").select("key", "shard", F.explode(F.expr("sequence(start, start + k - 1)")).alias("place"))
    return quotas.select("source", source_key().alias("key")).join(own, "key").drop("key")


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """A draw from the hypergeometric distribution, by inversion of `u` in (0, 1).

    Weights relative to the mode follow from the ratio of neighbours; beyond 9 standard deviations (and 12 steps)
    they are below 1e-16 and left out. The work is that many steps, whatever the numbers.
    """
    lo = F.greatest(F.lit(0), draws - (population - marked)).cast("long")
    hi = F.least(marked, draws).cast("long")
    mean = draws * marked / F.greatest(population, F.lit(1))
    spread = F.sqrt(mean * (1 - marked / F.greatest(population, F.lit(1)))) * 9 + 12
    a = F.greatest(lo, F.floor(mean - spread)).cast("long")
    b = F.least(hi, F.ceil(mean + spread)).cast("long")

    def ratio(k):
        """ln P(k) - ln P(k - 1)"""
        return F.log((marked - k + 1) * (draws - k + 1) / (k * (population - marked - draws + k)))

    steps = F.when(b > a, F.sequence(a + 1, b)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("top"))

    def higher(acc, k):
        log = acc["log"] + ratio(k)
        return F.struct(log.alias("log"), F.greatest(acc["top"], log).alias("top"))

    def inverted(top):
        """The place where the running sum of weights, scaled by the largest, reaches u times their sum."""
        first = F.struct(F.lit(0.0).alias("log"), F.exp(-top).alias("sum"))
        total = F.aggregate(
            steps, first,
            lambda acc, k: F.struct(
                (acc["log"] + ratio(k)).alias("log"), (acc["sum"] + F.exp(acc["log"] + ratio(k) - top)).alias("sum")
            ),
        )["sum"]
        begin = F.struct(F.lit(0.0).alias("log"), (u * total - F.exp(-top)).alias("left"), a.alias("k"))
        return F.aggregate(
            steps, begin,
            lambda acc, k: F.struct(
                (acc["log"] + ratio(k)).alias("log"),
                (acc["left"] - F.exp(acc["log"] + ratio(k) - top)).alias("left"),
                F.when(acc["left"] > 0, k).otherwise(acc["k"]).alias("k"),
            ),
        )["k"]

    return let(F.aggregate(steps, start, higher)["top"], inverted).cast("long")


def let(value: Column, then) -> Column:
    """`then(value)`, with the value computed once."""
    return F.transform(F.array(value), then)[0]


def source_key() -> Column:
    """A source as text that is never null, in code point order with null last."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~"))


def taken(rows: DataFrame, quotas: DataFrame, picks: DataFrame) -> DataFrame:
    """`rows` (with source, size, h) plus source_size, target, blocks, block, and `copies`: how often the mix takes each."""
    r = join_source(rows, quotas, "source_size", "target", "blocks", "passes", "cut")
    r = r.withColumn("block", block_of("h", "blocks"))
    p = picks.select(F.col("source").alias("__s"), F.col("h").alias("__h"), F.col("size").alias("__z"))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("h") == F.col("__h")) & (F.col("size") == F.col("__z"))
    r = r.join(p, same, "left")
    extra = (F.col("block") < F.col("cut")) | F.col("__h").isNotNull()
    copies = F.when(F.col("size") > 0, F.col("passes") + extra.cast("int")).otherwise(0).cast("int")
    return r.withColumn("copies", copies).drop("__s", "__h", "__z", "passes", "cut")


def block_shards(quotas: DataFrame, where: DataFrame) -> DataFrame:
    """`(source, block, got)`: in which pass and by which shard each block is drawn, a list of MOST_COPIES at most."""
    of = join_source(where, quotas, "blocks")
    drawn = F.struct(F.floor(F.col("place") / F.col("blocks")).cast("long").alias("copy"), "shard")
    return of.groupBy("source", F.pmod("place", "blocks").alias("block")).agg(F.array_sort(F.collect_list(drawn)).alias("got"))


def mix_sizes(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), and the shards that take it as text.

    A document is taken as often as the tree has given its block to shards.
    """
    slim = stored(sized(docs.select("doc_id", "source", "text"), seed).select("doc_id", "__mix.*"), "sizes")
    quotas, picks = plan(slim)
    where = places(quotas, split_tree(quotas, shards or shards_for(quotas), seed))
    blocks = stored(block_shards(quotas, where), "block-shards").select(F.col("source").alias("__s"), F.col("block").alias("__b"), "got")
    rows = taken(slim, quotas, picks)
    rows = rows.join(blocks, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    own = F.filter(F.coalesce("got", F.array().cast("array<struct<copy:bigint,shard:bigint>>")), lambda x: x["copy"] < F.col("copies"))
    rows = rows.withColumn("own", own)
    text = F.concat_ws(",", F.transform("own", lambda x: x["shard"].cast("string")))
    return rows.select("doc_id", "size", "source_size", "target", (F.size("own") * F.col("size")).alias("taken"), text.alias("shards"))


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed documents, with the shard each copy belongs to in `__shard`, in shuffled order within it."""
    slim = stored(sized(docs.select("doc_id", "source", "text"), seed).select("__mix.*"), "sizes")
    quotas, picks = plan(slim)
    shards = shards or shards_for(quotas)
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    where = stored(places(quotas, split_tree(quotas, shards, seed)), "places")
    columns = docs.columns
    rows = sized(docs.select(F.struct(*[docs[c] for c in columns]).alias("__row"), "doc_id", "source", "text"), seed)
    chosen = taken(rows.select("__row", "__mix.*"), quotas, picks).filter("copies > 0")
    copies = chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copies = copies.withColumn("place", F.col("copy") * F.col("blocks") + F.col("block"))
    at = where.select(F.col("source").alias("__s"), F.col("place").alias("__p"), F.col("shard").alias("__shard"))
    placed = copies.join(at, F.col("source").eqNullSafe(F.col("__s")) & (F.col("place") == F.col("__p")))
    return (
        placed.repartition(F.col("__shard"))
        .sortWithinPartitions("__shard", F.xxhash64(F.lit(seed + 1), "copy", "h"))
        .select("__row.*", "__shard")
    )
