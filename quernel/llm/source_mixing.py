"""Mixing sources to target weights, with DataFrame functions only.

The words of a source stand end to end, in a pseudorandom order of documents, and are cut into blocks of fixed length.
The mix is a row of slots in output shards; every shard draws multinomial counts of its slots over the sources, in
proportion to the targets. The k-th slot of a source takes the block that a pseudorandom permutation of the source's
block numbers gives for k (a new permutation for each pass over the source), and blocks are joined to slots by number.
Draws of a source beyond its share of slots, by chance, go to sources that chance left short, so targets are met within
a block and nothing is taken more often than twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import FEW, WORD, cut, fresh, numbered

#: How often weights repeat over the sources in code point order.
WEIGHTS = (5, 2, 1)
ROUNDS = 12


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap or not, ROUNDS rounds) applied to index."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(*seed, r) - x, n)
        return F.when(F.xxhash64(*seed, r, F.greatest(x, other)) % 2 == 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, few: bool = False) -> DataFrame:
    """source, sid (0, 1, .. by code point, null last), source_size, target from rows (source, size).

    Targets are min(most * source_size, level * weight), where the level spends share * all sizes: what sources that
    stop at their cap cannot take is shared again by weight until none is above. The level is found by repeated sums
    over the sources; only those sums reach the driver.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, [F.col("source").isNull(), F.col("source")], "sid", label="mix-sources", few=few)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    sources = cut(sources.withColumn("cap", F.col("source_size") * F.lit(most)), "mix-weights")
    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (first[0] or 0)
    level, stopped = (budget / first[1] if first[1] else 0.0), -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("cap")
        n, spent, open_ = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not open_:
            break
        stopped, level = n, max(level, (budget - spent) / open_)
    return sources.select("source", "sid", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def draws(sources: DataFrame, block: int, shard_slots: int, seed: int, few: bool = False) -> DataFrame:
    """out_shard, slot, sid, pass, block_no: one row per slot of the mix. sources: sid, source_size, target.

    few: see numbered; there is one row a source.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.when(F.col("source_size") > 0, F.least(2 * blocks, F.round(F.col("target") * blocks / F.col("source_size")))).otherwise(0).cast("long")
    shares = numbered(sources.select("sid", blocks.cast("long").alias("blocks"), quota.alias("quota")), [F.col("sid")], "low", F.col("quota"), "mix-shares", few)
    shares = cut(shares, "mix-quota")
    slots = shares.agg(F.sum("quota")).first()[0] or 0
    wide = max(1, -(-slots // 4096))  # a guide table: numbers of slots that a cell covers
    guide = shares.where("quota > 0").select("sid", "low", (F.col("low") + F.col("quota")).alias("high"))
    guide = guide.select("*", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide))).alias("cell"))
    drawn = spark.range(slots).withColumnRenamed("id", "slot").withColumn("r", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(1, slots))))
    drawn = drawn.withColumn("cell", F.floor(F.col("r") / wide)).join(guide, "cell").where("low <= r and r < high")
    drawn = cut(drawn.select("slot", F.floor(F.col("slot") / shard_slots).alias("out_shard"), "sid"), "mix-drawn")
    counts = drawn.groupBy("sid", "out_shard").agg(F.count("*").alias("n"))
    counts = cut(numbered(counts, [F.col("sid"), F.col("out_shard")], "before", F.col("n"), "mix-counts"), "mix-before")
    got = counts.groupBy("sid").agg(F.min("before").alias("start"), F.sum("n").alias("got"))
    state = shares.join(got, "sid", "left").na.fill(0, ["got", "start"])
    state = state.select("sid", "blocks", "quota", "start", "got", F.greatest(F.col("got") - F.col("quota"), F.lit(0)).alias("over"), F.greatest(F.col("quota") - F.col("got"), F.lit(0)).alias("short"))
    state = numbered(numbered(state, [F.col("sid")], "over_low", F.col("over"), "mix-over", few), [F.col("sid")], "short_low", F.col("short"), "mix-short", few)
    state = cut(state, "mix-state")
    within = F.row_number().over(Window.partitionBy("sid", "out_shard").orderBy("slot")) - 1
    ranked = drawn.join(counts.select("sid", "out_shard", "before"), ["sid", "out_shard"]).withColumn("rank", F.col("before") + within).drop("before")
    ranked = ranked.join(state.select("sid", "start", "quota", "over_low"), "sid").withColumn("k", F.col("rank") - F.col("start"))
    ranked = cut(ranked.select("out_shard", "slot", "sid", "k", "quota", (F.col("over_low") + F.col("k") - F.col("quota")).alias("moved")), "mix-ranked")
    fits = ranked.where("k < quota").select("out_shard", "slot", "sid", "k")
    free = state.where("short > 0").select("sid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)).alias("i"), "got", "short_low")
    free = free.select("sid", (F.col("got") + F.col("i")).alias("k"), (F.col("short_low") + F.col("i")).alias("moved"))
    moved = ranked.where("k >= quota").select("out_shard", "slot", "moved").join(free, "moved").select("out_shard", "slot", "sid", "k")
    out = fits.unionByName(moved).join(state.select("sid", "blocks"), "sid")
    lap = F.floor(F.col("k") / F.col("blocks"))
    number = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), lap)
    return out.select("out_shard", "slot", "sid", lap.alias("pass"), number.alias("block_no"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, shard_slots: int = 4096, seed: int = 42, share: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: row_id, doc_id, key_a, key_b, source, size, source_size, target for each row of docs.

    pieces: row_id, out_shard, slot, pass, first, words: which words of a row stand in which slot. key_a, key_b: hashes of
    id and text. block: words of a block; out_shard has shard_slots slots.
    Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, last; repeated
    rows are rows of their own; a null id passes through; sources without words have target 0; an empty table gives no
    rows; other columns are not read. The result depends on the rows alone, not on their order or partitions.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *_keys(id_col, text_col), word_count(text_col).alias("size"))
    sized = cut(sized.withColumn("row_id", F.monotonically_increasing_id()), "mix-sizes")
    few = sized.select("source").distinct().limit(FEW + 1).count() <= FEW
    sources = cut(source_targets(sized, share, few=few), "mix-targets")
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    order = [F.col("sid"), F.xxhash64(F.lit(seed), "key_a", "key_b"), F.col("key_a"), F.col("key_b"), F.col("row_id")]
    rows = numbered(rows, order, "offset", F.col("size"), "mix-offsets")
    starts = numbered(sources, [F.col("sid")], "source_start", F.col("source_size"), "mix-starts", few).select("sid", "source_start")
    rows = cut(rows.join(starts, "sid").withColumn("offset", F.col("offset") - F.col("source_start")).drop("source_start"), "mix-rows")
    end = F.col("offset") + F.col("size")
    parts = rows.where("size > 0").select("row_id", "sid", "offset", end.alias("end"), F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((end - 1) / block))).alias("block_no"))
    low, high = F.greatest("offset", F.col("block_no") * block), F.least("end", (F.col("block_no") + 1) * block)
    parts = parts.select("row_id", "sid", "block_no", (low - F.col("offset")).alias("first"), (high - low).alias("words"))
    pieces = parts.join(draws(sources, block, shard_slots, seed, few), ["sid", "block_no"])
    return rows.drop("sid", "offset"), pieces.select("row_id", "out_shard", "slot", "pass", "first", "words")


def mix_digest(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    rows, pieces = mix(docs, **params)
    taken = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"))
    out = rows.join(taken, "row_id", "left")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The mix as documents with the columns of docs: per row and pass one document with the words taken from it.

    A document taken whole keeps its text as it is; otherwise the taken words are joined by single spaces, in order.
    """
    rows, pieces = mix(docs, id_col, text_col, **params)
    parts = F.sort_array(F.collect_list(F.struct("first", "words")))
    taken = pieces.groupBy("row_id", "pass").agg(parts.alias("parts"), F.sum("words").alias("n"))
    taken = taken.join(rows.select("row_id", "key_a", "key_b", "size"), "row_id")
    a, b, nth, takes, take, words = (fresh(docs, x) for x in ("key_a", "key_b", "nth_", "takes_", "take_", "words_"))
    taken = taken.groupBy(F.col("key_a").alias(a), F.col("key_b").alias(b)).agg(F.collect_list(F.struct("parts", "n", "size")).alias(takes))
    keyed = docs.withColumns(dict(zip((a, b), _keys(id_col, text_col), strict=True)))
    joined = keyed.join(taken, [a, b])  # equal rows share their takes; the first of them is given all
    joined = joined.withColumn(nth, F.row_number().over(Window.partitionBy(a, b).orderBy(a))).where(F.col(nth) == 1)
    joined = joined.withColumn(words, F.when(F.exists(takes, lambda t: t["n"] < t["size"]), F.regexp_extract_all(text_col, F.lit(f"({WORD})"), F.lit(1))))
    joined = joined.select("*", F.explode(takes).alias(take))
    some = F.array_join(F.flatten(F.transform(F.col(take)["parts"], lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")
    text = F.when(F.col(take)["n"] < F.col(take)["size"], some).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of id and text, never null: rows with equal keys are equal rows."""
    return [F.xxhash64(id_col, text_col).alias("key_a"), F.xxhash64(text_col, id_col, F.lit(1)).alias("key_b")]
