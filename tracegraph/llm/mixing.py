"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source's share of the mixture is its target weight; a document's expected number of copies is that share of all
characters over the source's own (a document counts as its characters plus one). The number itself comes from inverting
the Poisson distribution of that mean at a uniform number hashed from the seed and the doc_id, so that a rerun repeats
it; the document is exploded by it, and the copies are dealt to partitions and sorted by a hash of the copy. A mean of
more than MOST is the sum of equal parts of at most MOST, each drawn by inversion from a hash of its own: such a sum is
Poisson again, and no table is longer than one for MOST, however large a mean is.

Without given weights a source weighs its characters to the power TEMPERATURE, which raises small sources. A source
without a given weight gets none and goes. A null source is a source of its own, apart from an empty one; a null text has
no characters; repeated rows get equal numbers, as do rows of one source with null ids and equal texts. The column
``copy`` (from 1) is added, or replaced if there is one; other names of ``docs`` are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracegraph.store import saved

SEED, TEMPERATURE = "mix-1", 0.5
#: Largest mean that is inverted at once.
MOST = 500.0
#: Sources up to which their table is broadcast (a distribution function of at most 800 numbers each); beyond, the join
#: is shuffled.
BROADCAST_SOURCES = 2_000

#: Copies of a document that are exploded at once; a larger number is exploded in two steps.
BLOCK = 10_000


def _key() -> Column:
    """``n`` for the null source, else ``s`` and the source."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))


def repetition_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(_tg_source, rate): each source's expected number of copies of a document."""
    sizes = docs.groupBy(_key().alias("_tg_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit("n" if k is None else "s" + k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("_tg_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = saved(sizes.withColumn("weight", weight), "sizes")
    all_size, all_weight = sizes.agg(F.sum("size").cast("double"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(all_weight) if all_weight else F.lit(0.0)
    return sizes.select("_tg_source", (share * F.lit(all_size or 0.0) / F.col("size")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(_tg_source, parts, cdf): a mean is drawn as a sum of ``parts`` equal parts of at most MOST; ``cdf`` is the
    distribution function of one part at 0, 1, ..., as far as double precision tells it from 1."""
    parts = F.greatest(F.ceil(F.col("rate") / MOST), F.lit(1)).cast("long")
    each = rates.where("rate > 0").select("_tg_source", parts.alias("parts"), (F.col("rate") / parts).alias("mean"))
    most = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int")
    steps = each.withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    upto = W.partitionBy("_tg_source").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    log_p = F.sum(F.when(F.col("k") == 0, -F.col("mean")).otherwise(F.log(F.col("mean") / F.col("k")))).over(upto)
    steps = steps.withColumn("p", F.exp(log_p)).withColumn("c", F.sum("p").over(upto))
    lists = steps.groupBy("_tg_source").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("k", "c"))).alias("kc"))
    return lists.select("_tg_source", "parts", F.transform("kc", lambda x: x["c"]).alias("cdf"))


def _uniform(name: Column) -> Column:
    """A number in (0, 1) hashed from a string."""
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The mixture: the columns of ``docs`` (doc_id, source, text and others) and ``copy``, shuffled."""
    docs = docs.drop("copy")
    tables = saved(poisson_tables(repetition_rates(docs, weights, temperature)), "rates")
    few = tables.count() <= BROADCAST_SOURCES
    tables = tables.select("_tg_source", F.struct("parts", "cdf").alias("_tg_table"))
    name = F.coalesce(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")), F.lit(seed))
    name = F.when(F.col("doc_id").isNull(), F.concat(F.lit(seed + "::"), F.md5(F.coalesce("text", F.lit(""))))).otherwise(name)
    found = docs.withColumns({"_tg_source": _key(), "_tg_name": name}).join(F.broadcast(tables) if few else tables, "_tg_source")
    drawn = lambda u: F.size(F.filter(F.col("_tg_table.cdf"), lambda c: c < u)).cast("long")
    part = lambda i: drawn(_uniform(F.concat_ws(":", F.col("_tg_name"), i.cast("string"))))
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_tg_table.parts") - 1), F.lit(0).cast("long"), lambda n, i: n + part(i))
    times = drawn(_uniform(F.col("_tg_name"))) + F.when(F.col("_tg_table.parts") > 1, more).otherwise(F.lit(0))
    found = found.withColumn("_tg_times", times).where("_tg_times > 0")
    found = found.withColumn("_tg_first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_tg_times"), F.lit(BLOCK).cast("long"))))
    last = F.least(F.col("_tg_first") + (BLOCK - 1), F.col("_tg_times"))
    copies = found.withColumn("copy", F.explode(F.sequence(F.col("_tg_first").cast("int"), last.cast("int"))))
    copies = copies.drop("_tg_times", "_tg_first", "_tg_table", "_tg_source")
    place = F.xxhash64(F.lit(seed), F.col("_tg_name"), F.col("copy"))
    return copies.withColumn("_tg_place", place).repartition(F.col("_tg_place")).sortWithinPartitions("_tg_place").drop("_tg_place", "_tg_name")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The mixture of all documents' sources."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = f"""
with s as (select source, sum(coalesce(length(text), 0) + 1) size from documents group by 1),
w as (select source, size, pow(cast(size as double), {TEMPERATURE}) weight from s),
r as (select source, weight / (select sum(weight) from w) * (select sum(size) from w) / size rate from w),
m as (select source, greatest(cast(ceil(rate / {MOST}) as bigint), 1) parts, rate / greatest(cast(ceil(rate / {MOST}) as bigint), 1) mean from r where rate > 0),
k as (select source, mean, unnest(generate_series(0, cast(ceil(mean + 12 * sqrt(mean) + 24) as bigint))) k from m),
p as (select source, k, exp(sum(case when k = 0 then -mean else ln(mean / k) end) over (partition by source order by k)) p from k),
c as (select source, k, sum(p) over (partition by source order by k) c from p),
i as (select d.*, case when doc_id is null then '{SEED}::' || md5(coalesce(text, '')) else '{SEED}:' || doc_id end as name from documents d),
q as (select distinct source, name from i),
t as (select q.source, name, unnest(generate_series(0, parts - 1)) j from q join m on q.source is not distinct from m.source),
u as (select source, name, j, (cast(concat('0x', substr(md5(case when j = 0 then name else name || ':' || j end), 1, 13)) as bigint) + 0.5) / {float(1 << 52)} u from t),
n as (select u.source, u.name, count(*) times from u join c on c.source is not distinct from u.source and c.c < u.u group by 1, 2)
select i.doc_id, i.text, i.lang, i.source, i.n_chars, cast(unnest(generate_series(1, n.times)) as integer) copy
from i join n on i.name = n.name and i.source is not distinct from n.source
"""
