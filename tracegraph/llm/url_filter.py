"""URL filters: listed rules first, then a character language-model ratio. DataFrame functions only.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with its own, and the
longest fitting rule decides. The urls that rules accept and reject are the examples of two smoothed Markov models of
variable order over the characters of the url after its scheme (the host lower-cased; the whole url, where it has no
scheme): the next character's probability given up to ORDER - 1 characters
is its count drawn towards the probability given one character less (PRIOR pseudo-counts); a context seen fewer than
LEAST times in a model's examples adds nothing. A url without a rule is accepted if the mean log-likelihood
difference over its characters and its end reaches the threshold at which both models' examples err alike, taking their
scores as normal. With examples of one kind only, that kind is the verdict; without any, every url is accepted.

A null url, or one without ``://``, has an empty host and path, and is judged like any other; a null url is an empty one.
Equal urls are scored once. Columns of the names that ``judge`` adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.store import saved

ORDER, PRIOR, LEAST, ALPHABET = 5, 2.0, 4, 128
#: Rules (verdict, host, path) of the query; a list of at most some hundreds.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Distinct n-grams up to which their table is broadcast (about 100 bytes each); beyond, the join is shuffled.
BROADCAST_GRAMS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BEGIN, _END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(url: Column) -> Column:
    """What the models read: the url from the host on, the query and fragment included."""
    rest = F.regexp_extract(url, r"://[^/?#]*([\s\S]*)", 1)
    return F.coalesce(F.when(url.contains("://"), F.concat(host_of(url), rest)).otherwise(url), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (size, rule, verdict) of the longest fitting rule, or null."""
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.greatest(*fits, none) if fits else none


def gram_scores(urls: DataFrame) -> DataFrame:
    """(gram, score) for every n-gram in ``urls`` (name, label): the log-ratio of its last character's probabilities."""
    grams = _positions(urls).groupBy("gram").agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("r"))
    grams = saved(grams, "grams")
    below = None
    ends = []
    for size in range(1, ORDER + 1):
        level = grams.where(F.length("gram") >= size).groupBy(F.right("gram", F.lit(size)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        level = level.withColumn("ctx", F.left("gram", F.lit(size - 1)))
        totals = level.groupBy("ctx").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        level = level.join(totals, "ctx")
        if below is None:
            level = level.withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pr", F.lit(1.0 / ALPHABET))
        else:
            level = level.withColumn("tail", F.right("gram", F.lit(size - 1))).join(below.select(F.col("gram").alias("tail"), "pa", "pr"), "tail")
        drawn = lambda n, t, p: F.when(F.col(t) >= LEAST, (F.col(n) + PRIOR * F.col(p)) / (F.col(t) + PRIOR)).otherwise(F.col(p))
        below = saved(level.select("gram", drawn("a", "ta", "pa").alias("pa"), drawn("r", "tr", "pr").alias("pr")), f"order{size}")
        if size > 1:
            ends.append(below if size == ORDER else below.where(F.col("gram").startswith(_BEGIN)))
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("score"))


def _positions(urls: DataFrame) -> DataFrame:
    """``urls`` with the n-gram that ends at each character after the first of the name between its marks."""
    marked = urls.withColumn("_s", F.concat(F.lit(_BEGIN), "name", F.lit(_END)))
    gram = F.expr(f"transform(sequence(2, length(_s)), i -> substring(_s, greatest(1, i - {ORDER - 1}), least({ORDER}, i)))")
    return marked.withColumn("gram", F.explode(gram)).drop("_s")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (with ``url``), all columns, and host, path, rule, verdict, llr (the mean log-likelihood difference)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.drop("llr", "rule", "verdict").withColumns({"host": host, "path": path, "_tg_name": name_of(F.col("url"))})
    named = named.withColumn("_tg_rule", best_rule(F.col("host"), F.col("path"), rules))
    urls = named.groupBy(F.col("_tg_name").alias("name")).agg(F.max("_tg_rule.verdict").alias("label"))
    urls = saved(urls.repartition("name"), "urls")
    scores = gram_scores(urls)
    if scores.count() <= BROADCAST_GRAMS:
        scores = F.broadcast(scores)
    scored = _positions(urls).join(scores, "gram").groupBy("name").agg(F.round(F.avg("score"), 9).alias("llr"), F.first("label").alias("label"))
    scored = saved(scored, "scored")
    kinds = {r.label: r for r in scored.where("label is not null").groupBy("label").agg(F.avg("llr").alias("mean"), F.stddev_pop("llr").alias("dev")).collect()}
    if len(kinds) == 2:
        a, r = kinds["allow"], kinds["block"]
        spread = a.dev + r.dev
        at = (a["mean"] * r.dev + r["mean"] * a.dev) / spread if spread else (a["mean"] + r["mean"]) / 2
        model = F.when(F.col("llr") >= at, "allow").otherwise("block")
    else:
        model = F.lit(next(iter(kinds), "allow"))
    out = named.join(scored.select(F.col("name").alias("_tg_name"), "llr"), "_tg_name")
    return out.withColumn("rule", F.col("_tg_rule.rule")).withColumn("verdict", F.coalesce(F.col("_tg_rule.verdict"), model)).drop("_tg_rule", "_tg_name")


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    levels = []
    for k in range(1, ORDER + 1):
        lower = f"join l{k - 1} b on b.gram = right(g.gram, {k - 1})" if k > 1 else ""
        pa, pr = ("b.pa", "b.pr") if k > 1 else (f"{1 / ALPHABET}", f"{1 / ALPHABET}")
        levels.append(f"""
c{k} as (select right(gram, {k}) gram, left(right(gram, {k}), {k - 1}) ctx, sum(a) a, sum(r) r from grams where length(gram) >= {k} group by 1, 2),
t{k} as (select ctx, sum(a) ta, sum(r) tr from c{k} group by 1),
l{k} as (select g.gram, case when ta >= {LEAST} then (a + {PRIOR} * {pa}) / (ta + {PRIOR}) else {pa} end pa,
                case when tr >= {LEAST} then (r + {PRIOR} * {pr}) / (tr + {PRIOR}) else {pr} end pr
         from c{k} g join t{k} using (ctx) {lower})""")
    ends = " union all ".join(f"select gram, ln(pa) - ln(pr) score from l{k}" + ("" if k == ORDER else " where left(gram, 1) = chr(2)") for k in range(2, ORDER + 1))
    return f"""
with rules(verdict, h, p) as (values {rules}),
n as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path,
             coalesce(case when contains(url, '://') then translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') || regexp_extract(url, '://[^/?#]*([\\s\\S]*)', 1)
                      else url end, '') name from pages),
hp as (select distinct host, path from n),
fit as (select host, path, arg_max(h || rules.p, length(h || rules.p)) rule, arg_max(verdict, length(h || rules.p)) verdict
        from hp join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, rules.p) group by 1, 2),
urls as (select name, max(verdict) label from n left join fit using (host, path) group by 1),
pos as (select name, label, substring(s, greatest(1, i - {ORDER - 1}), least({ORDER}, i)) gram
        from (select name, label, chr(2) || name || chr(3) s, unnest(generate_series(2, length(name) + 2)) i from urls)),
grams as (select gram, count(*) filter (label = 'allow') a, count(*) filter (label = 'block') r from pos group by 1),
{",".join(levels)},
sc as ({ends}),
llr as (select name, any_value(label) label, round(avg(score), 9) llr from pos join sc using (gram) group by 1),
k as (select avg(llr) filter (label = 'allow') ma, stddev_pop(llr) filter (label = 'allow') sa,
             avg(llr) filter (label = 'block') mr, stddev_pop(llr) filter (label = 'block') sr from llr)
select page_id, n.host, n.path, rule, coalesce(fit.verdict, case
         when ma is null and mr is null then 'allow' when ma is null then 'block' when mr is null then 'allow'
         when llr.llr >= case when sa + sr > 0 then (ma * sr + mr * sa) / (sa + sr) else (ma + mr) / 2 end then 'allow' else 'block' end) verdict
from n join llr on llr.name = n.name left join fit using (host, path), k
"""


OP8_SQL = _sql()
