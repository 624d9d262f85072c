"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquery.llm.common import materialize, unused

WORD = "[^\\x20\\x09-\\x0D]+"
#: More rows than this of a table of sources or shards are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 50_000


def number(seed: int, *parts: Column) -> Column:
    """A seeded number from 0 to 2**32 - 1; SQL can compute it too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, at_most: int = 3) -> DataFrame:
    """``source, source_size, rank, target`` for ``source, size`` rows.

    Sources in order of code points, null last, weigh 1, 2, .. ``cycle``, repeating. Targets share the sum of all
    sizes by weight and stop at ``at_most`` times their source's size; the excess is shared anew by weight until
    none is above. That fixed point is found in one pass: in order of cap/weight the capped sources come first, so
    running sums give the level at each place, and the first place whose level is within its cap fixes it.
    One row per source goes through the global windows.
    """
    every = Window.partitionBy(F.lit(0))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", ((F.col("rank") - 1) % cycle + 1).cast("long")).withColumn("cap", F.col("source_size") * at_most)
    level = every.orderBy((F.col("cap").cast("double") / F.col("weight")), "rank")
    total, rows = F.sum("source_size").over(every), Window.unboundedPreceding
    s = s.select("*", F.row_number().over(level).alias("place"), (total - F.sum("cap").over(level.rowsBetween(rows, 0)) + F.col("cap")).alias("rest"), F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)).alias("weights"))
    within = F.col("rest").cast("decimal(38,0)") * F.col("weight") <= F.col("cap").cast("decimal(38,0)") * F.col("weights")
    s = s.withColumn("first", F.min(F.when(within, F.struct("place", "rest", "weights"))).over(every))
    shared = (F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.weights")
    return s.select("source", "source_size", "rank", F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def sainte_lague(claims: DataFrame, group: list[str], weight: str, seats: str, order: str) -> DataFrame:
    """Add ``quota``: the seats of a group that go to each row by highest quotients weight/1, weight/3, weight/5, ..

    Only the quotients near the end can be in doubt. With S rows in the group, the i-th row's quota differs from its
    rounded share by at most share of S + 1, so each row starts ``margin`` below that and only the next 2 * margin
    quotients compete: about 6 rows per row, whatever the number of seats. Ties go to the smaller ``order``.
    """
    g = Window.partitionBy(*group)
    share = F.col(weight) / F.nullif(F.sum(weight).over(g), F.lit(0))
    c = claims.withColumn("__share", F.coalesce(share, F.lit(0.0))).withColumn("__margin", F.ceil(F.col("__share") * (F.count("*").over(g) + 1)) + 2)
    c = c.withColumn("__low", F.greatest(F.floor(F.col("__share") * F.col(seats) + 0.5) - F.col("__margin"), F.lit(0))).withColumn("__left", F.col(seats) - F.sum("__low").over(g))
    q = c.filter(f"{weight} > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), 2 * F.col("__margin")))).withColumn("__q", F.col(weight) / (2 * (F.col("__low") + F.col("__i")) - 1))
    won = q.withColumn("__place", F.row_number().over(g.orderBy(F.col("__q").desc(), order))).filter("__place <= __left").groupBy(*group, order).agg(F.count("*").alias("__won"))
    return c.join(won, [*group, order], "left").withColumn("quota", F.col("__low") + F.coalesce("__won", F.lit(0))).drop("__share", "__margin", "__low", "__left", "__won")


def small(df: DataFrame) -> DataFrame:
    """Mark a materialized table for broadcast if its counted rows allow that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 32, shard_words: int = 4_000_000, at_most: int = 3, seed: int = 42) -> DataFrame:
    """How many words of each document a mix takes, so that sources come near their targets.

    1. Sizes (words of the text) are counted once and written to a table; everything after reads that table.
    2. ``source_targets`` gives each source's target.
    3. Blocks of ``block`` words, as many as all words make, go to sources by Sainte-Laguë's quotients. Documents
       are dealt to shards by a seeded hash, about ``shard_words`` words in each, so a hot source has many shards.
    4. In a shard, documents stand in seeded order. The shards of a source follow one another, each from the sum of
       words before it, and form one stream of n blocks (the last block takes the remainder), so a small source
       loses nothing at borders of shards. The words of a source's seats take the whole stream as often as they
       hold it, and blocks for the rest once more, spread evenly from a seeded start. Numbers of chosen blocks are
       closed forms, so no block becomes a row.

    Returns ``id_col, size, source_size, target, taken``. Null texts have size 0, null sources are a source of
    their own, the last. No document is taken more than ``at_most`` times. Repeated rows are separate documents.
    The result depends on the rows alone, not on their partitions. An empty table gives an empty result.
    """
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size")), "mix-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards, blocks = max(1, -(-total // shard_words)), -(-total // block)
    sources = materialize(sainte_lague(source_targets(sizes, at_most=at_most).withColumn("__all", F.lit(0)).withColumn("__seats", F.lit(blocks).cast("long")), ["__all"], "target", "__seats", "rank").select("source", "source_size", "rank", "target", F.col("quota").alias("blocks")), "mix-sources")

    d = sizes.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit(""))).withColumn("shard", number(seed, F.lit("shard"), F.col("key")) % shards)
    of, src = d.alias("d"), small(sources).alias("s")
    d = of.join(src, F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.id", "d.size", "d.key", "d.shard", "s.source_size", "s.rank", "s.target", "s.blocks")
    cells = materialize(d.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks")), "mix-cells")
    # One row per shard that a source is in goes through these windows.
    source, n, all_words = Window.partitionBy("rank"), F.col("n"), F.col("all_words")
    cells = cells.withColumn("all_words", F.sum("words").over(source)).withColumn("offset", F.sum("words").over(source.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    cells = cells.withColumn("n", F.greatest(F.expr(f"all_words div {block}"), F.least("all_words", F.lit(1)))).withColumn("seats", F.col("blocks") * block)
    times = F.when(all_words > 0, F.expr("seats div all_words")).otherwise(0)
    rest = F.least(F.floor((F.col("seats") - times * all_words) / block + 0.5), n)
    cells = cells.select("rank", "shard", "offset", "n", F.least(times * n + rest, n * at_most).cast("long").alias("q"), F.when(n > 0, number(seed, F.lit("start"), F.col("rank").cast("string")) % n).otherwise(0).alias("start"))

    w = Window.partitionBy("rank", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), "key")), "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum("size").over(w)).join(small(cells), ["rank", "shard"]).withColumn("end", F.col("end") + F.col("offset"))

    def before(x: str) -> str:
        """Words that the mix takes from the first x words of the stream."""
        i = f"least({x} div {block}, n - 1)"
        return f"(q div n) * {x} + {block} * ({chosen(i)}) + ({x} - {block} * {i}) * ({chosen(f'({i} + 1)')} - ({chosen(i)}))"

    def chosen(i: str) -> str:
        return f"(({i} + start) * (q % n)) div n - (start * (q % n)) div n"

    taken = F.expr(f"case when size = 0 then 0L else ({before('end')}) - ({before('(end - size)')}) end")
    return d.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The documents as often as :func:`mix` takes them, all columns as they were.

    A document of which the mix takes k whole sizes and a part more comes k times, and once more with that part's
    seeded chance; so no text is cut and sources keep their targets on average. Documents without words have
    nothing that a mix could weigh and stay once.
    """
    key, words, nth, of, taken, times, copy = unused(docs, "__id", "__size", "__turn", "__of", "__taken", "__times", "__copy")
    m = mix(docs, id_col, text_col, source_col, seed=seed).select(F.col(id_col).alias(of), F.col("size"), F.col("taken").alias(taken))
    # Repeated ids: the k-th row of an id in docs gets the k-th row of the mix.
    turn = lambda by, *o: F.row_number().over(Window.partitionBy(by).orderBy(*o))
    m = m.select(of, taken, turn(of, "size", taken).alias(copy))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    d = docs.withColumn(key, F.col(id_col)).withColumn(words, size).withColumn(nth, turn(key, words))
    joined = d.join(m, F.col(key).eqNullSafe(F.col(of)) & (F.col(nth) == F.col(copy)))
    part = (F.col(taken) % F.col(words)) / F.nullif(F.col(words), F.lit(0))
    chance = number(seed, F.lit("copy"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(nth).cast("string")) / F.lit(2.0**32)
    n = F.when(F.col(words) == 0, 1).otherwise(F.expr(f"{taken} div {words}") + (chance < part).cast("int")).cast("int")
    return joined.withColumn(times, n).filter(F.col(times) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(f"{copy}s")).drop(f"{copy}s")
