"""Mixing sources to target weights by Sainte-Lague apportionment.

Documents are dealt to shards of about ``SHARD_TOKENS`` tokens by a seeded hash; within a shard each source's documents,
in seeded order, are one stream of tokens that is cut into blocks of ``BLOCK_TOKENS`` (a stream's last block may be
shorter). Each shard has ``SHARE`` of its blocks as seats. Seat by seat the source of highest quotient ``weight / (2 *
seats so far + 1)`` gets the next one, as long as it has blocks left there; that gives integer quotas by shard. A source's
quota is filled with its first blocks: as documents stand in seeded order, those are a seeded choice. Target weights
are those given, or the square roots of the sources' tokens over all documents.

Tokens are runs of anything but space, tab, line feed, carriage return and form feed.

Defined results: documents without tokens (null and empty texts) are never chosen; a null source is the source ''; a
source without a given weight, or of weight 0, gets no seat; equal quotients go to the lesser source name; the order is by
a hash of ``doc_id`` and text, so rows that share a ``doc_id``, or have none, are dealt out like any others; rows equal in
both stand side by side and as many of them are kept as have their first token in a chosen block; a null ``doc_id``
counts as ''; empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcgraph.llm import common as C

BLOCK_TOKENS, SHARD_TOKENS, SHARE, SEED = 2048, 1 << 26, 0.75, "mix-1"


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")


def _hash(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), C.text_key(text)).cast("binary"))


def _shard(h: Column, n: int) -> Column:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n


class Mix:
    """The apportionment of one table: every document's place, and the quotas."""

    def __init__(self, docs: DataFrame, weights: dict[str, float] | None = None, share: float = SHARE, seed: str = SEED, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS):
        self.seed, self.block = seed, block
        light = docs.select(F.col("doc_id").alias("_sg_id"), F.coalesce("source", F.lit("")).alias("_sg_source"), _tokens(F.col("text")).alias("_sg_n"), _hash(F.col("doc_id"), F.col("text"), seed).alias("_sg_hash"))
        self.light = C.cut(light.filter("_sg_n > 0"))
        total = self.light.agg(F.coalesce(F.sum("_sg_n"), F.lit(0))).first()[0]
        self.shards = max(1, -(-int(total) // shard_tokens))
        placed = self.light.withColumn("_sg_shard", _shard(F.col("_sg_hash"), self.shards))
        order = Window.partitionBy("_sg_source", "_sg_shard").orderBy("_sg_hash").rowsBetween(Window.unboundedPreceding, 0)
        self.placed = placed.withColumn("_sg_first", F.sum("_sg_n").over(order) - F.col("_sg_n"))
        streams = placed.groupBy("_sg_source", "_sg_shard").agg(F.sum("_sg_n").alias("n")).withColumn("cap", F.ceil(F.col("n") / F.lit(block)).cast("long"))
        if weights is None:
            w = self.light.groupBy("_sg_source").agg(F.sqrt(F.sum("_sg_n").cast("double")).alias("w"))
        else:
            w = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_sg_source string, w double")
        seats = streams.groupBy("_sg_shard").agg(F.floor(F.sum("cap") * F.lit(share)).cast("long").alias("seats"))
        quotients = streams.join(w.filter("w > 0"), "_sg_source").select("_sg_source", "_sg_shard", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cap") - 1)).alias("j"))
        rank = F.row_number().over(Window.partitionBy("_sg_shard").orderBy(F.desc(F.col("w") / (2 * F.col("j") + 1)), "_sg_source", "j"))
        given = quotients.withColumn("rank", rank).join(seats, "_sg_shard").filter("rank <= seats")
        self.quotas = C.cut(given.groupBy("_sg_source", "_sg_shard").agg(F.count("*").alias("_sg_quota")))

    def sized(self, small: DataFrame, width: int = 128) -> DataFrame:
        """``small``, to be broadcast if its rows take at most ``common.BROADCAST_BYTES``."""
        return F.broadcast(small) if small.count() * width <= C.BROADCAST_BYTES else small

    def pieces(self) -> DataFrame:
        """(doc_id, source, shard, block, first_token, n_tokens): what each chosen block takes of each document."""
        p = self.placed.join(self.sized(self.quotas), ["_sg_source", "_sg_shard"])
        b = F.lit(self.block)
        p = p.filter(F.col("_sg_first") < F.col("_sg_quota") * b)
        last = F.least(F.col("_sg_quota") - 1, F.floor((F.col("_sg_first") + F.col("_sg_n") - 1) / b).cast("long"))
        p = p.withColumn("block", F.explode(F.sequence(F.floor(F.col("_sg_first") / b).cast("long"), last)))
        start = F.greatest(F.col("_sg_first"), F.col("block") * b)
        end = F.least(F.col("_sg_first") + F.col("_sg_n"), (F.col("block") + 1) * b)
        return p.select(F.col("_sg_id").alias("doc_id"), F.col("_sg_source").alias("source"), F.col("_sg_shard").alias("shard"), "block", (start - F.col("_sg_first")).alias("first_token"), (end - start).alias("n_tokens"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """``docs`` whose first token is in a chosen block. As streams are in order of the hash, one hash for each stream tells; documents aren't shuffled.

        Rows that share a stream's last chosen hash are equal in ``doc_id`` and text: where not all of them are chosen, they alone are counted out.
        """
        stream = ["_sg_source", "_sg_shard"]
        p = self.placed.join(self.sized(self.quotas), stream).select(*stream, "_sg_hash", (F.col("_sg_first") < F.col("_sg_quota") * self.block).alias("_sg_in"))
        p = C.cut(p)
        upto = p.filter("_sg_in").groupBy(*stream).agg(F.max("_sg_hash").alias("_sg_upto"))
        last = p.join(self.sized(upto), stream).filter("_sg_hash = _sg_upto")
        upto = C.cut(last.groupBy(*stream, "_sg_upto").agg(F.count("*").alias("_sg_all"), F.count_if("_sg_in").alias("_sg_some")))
        row = docs.select(F.struct("*").alias("_sg_row"), F.coalesce("source", F.lit("")).alias("_sg_source"), _hash(F.col("doc_id"), F.col("text"), self.seed).alias("_sg_hash"))
        row = row.filter(F.regexp_like("_sg_row.text", F.lit("[^ \\t\\n\\r\\f]"))).withColumn("_sg_shard", _shard(F.col("_sg_hash"), self.shards)).join(self.sized(upto), stream)
        whole = row.filter("_sg_hash < _sg_upto OR _sg_hash = _sg_upto AND _sg_some = _sg_all").select("_sg_row.*")
        if upto.filter("_sg_some < _sg_all").isEmpty():
            return whole
        tied = C.placed(row.filter("_sg_hash = _sg_upto AND _sg_some < _sg_all"), ["_sg_hash"])
        return whole.unionByName(tied.filter("_sg_n < _sg_some").select("_sg_row.*"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(C.table(spark, sf_dir, "documents")).pieces()


OP10_SQL = f"""
WITH light AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS n,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents),
full_ AS (SELECT * FROM light WHERE n > 0),
shards AS (SELECT greatest(1, CAST(ceil(sum(n) / {SHARD_TOKENS}.0) AS BIGINT)) AS k FROM full_),
placed AS (SELECT doc_id, source, n, h, CAST('0x' || substr(h, 1, 8) AS BIGINT) % k AS shard FROM full_, shards),
firsts AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY source, shard ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS f FROM placed),
streams AS (SELECT source, shard, CAST(ceil(CAST(sum(n) AS DOUBLE) / {BLOCK_TOKENS}) AS BIGINT) AS cap FROM placed GROUP BY ALL),
weights AS (SELECT source, sqrt(CAST(sum(n) AS DOUBLE)) AS w FROM placed GROUP BY ALL),
seats AS (SELECT shard, CAST(floor(sum(cap) * {SHARE}) AS BIGINT) AS seats FROM streams GROUP BY ALL),
quotients AS (SELECT source, shard, w, unnest(range(cap)) AS j FROM streams JOIN weights USING (source)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY w / (2 * j + 1) DESC, source, j) AS r FROM quotients),
quotas AS (SELECT source, shard, count(*) AS q FROM ranked JOIN seats USING (shard) WHERE r <= seats GROUP BY ALL),
cut AS (
  SELECT doc_id, source, shard, f, n, unnest(range(f // {BLOCK_TOKENS}, least(q - 1, (f + n - 1) // {BLOCK_TOKENS}) + 1)) AS block
  FROM firsts JOIN quotas USING (source, shard) WHERE f < q * {BLOCK_TOKENS})
SELECT doc_id, source, shard, block, greatest(f, block * {BLOCK_TOKENS}) - f AS first_token,
       least(f + n, (block + 1) * {BLOCK_TOKENS}) - greatest(f, block * {BLOCK_TOKENS}) AS n_tokens
FROM cut
"""
