"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (action, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A filter of up to this many blocks of 4 x 64 bits, under 3 MB, is broadcast; candidates join a larger one by their block.
BROADCAST_BLOCKS = 1 << 16
#: Rules' paths of up to so many different lengths are listed; with more, a url's path is tried at every length.
LISTED_LENGTHS = 1_000
#: Rule lists up to this many rows are broadcast to the exact join; longer ones are joined by a shuffle.
BROADCAST_RULES = 100_000


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.translate(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _words(key: Column) -> list[Column]:
    """The key's bits in its block: one bit in each of four 64-bit words, from one second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    at = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), i) for i in at]


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """listed(key) -> (block, w0..w3): the filter's blocks, OR-ed together from the keys' bits."""
    bits = listed.select(_block(F.col("key"), n_blocks).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(_words(F.col("key")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url).

    host is what stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; path goes on to
    `?`, `#` or the end; a NULL url or one without `://` has both empty. A url's candidates are each suffix of its
    host at a label with each prefix of its path that is as long as some rule's path: `host + path` is the canonical
    form that the rules are listed under. A page's candidates go through the blocked Bloom filter; the few that pass
    are joined by equality with the rules, which removes false positives; of the rules that fit the longest wins (by
    host and path together; equal lengths: the smaller text, then `block` before `allow`). Where none fits, rule is
    NULL and the verdict is `default`: an unlisted url passes. The filter grows with the rules, 8 to a block.
    Repeated page rows each get their row; NULL page ids stay NULL; an empty rule list gives `default` everywhere;
    other columns of the input are not used and do no harm.
    """
    n_rules = rules.count()
    listed = rules.where("rule_host is not null and rule_path is not null").select(
        "action", F.concat(F.translate("rule_host", UPPER, LOWER), "rule_path").alias("key"), F.length("rule_path").alias("path_len")
    )
    n_blocks = max(1, n_rules // 8)
    lengths = sorted(r[0] for r in listed.select("path_len").distinct().limit(LISTED_LENGTHS + 1).collect())
    urls = pages.select(F.col("page_id"), F.col("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    # A host of n labels has n suffixes; rules depend on nothing else, so each distinct (host, path start) is judged once.
    longest = listed.agg(F.coalesce(F.max("path_len"), F.lit(0))).first()[0]
    urls = urls.withColumn("start", F.substring("path", 1, longest))
    distinct = urls.select("host", "start").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("start"))
    if len(lengths) > LISTED_LENGTHS:
        starts = F.sequence(F.lit(0), F.length("start"))
    candidates = (
        distinct.select("host", "start", F.explode(suffix).alias("suffix"))
        .select("host", "start", "suffix", F.explode(F.transform(starts, lambda n: F.substring(F.col("start"), F.lit(1), n))).alias("lead"))
        .select("host", "start", F.concat("suffix", "lead").alias("key"))
        .withColumn("block", _block(F.col("key"), n_blocks))
    )
    filter_ = bloom(listed, n_blocks)
    possible = candidates.join(F.broadcast(filter_) if n_blocks <= BROADCAST_BLOCKS else filter_, "block")
    for i, w in enumerate(_words(F.col("key"))):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(w) == w)
    exact = F.broadcast(listed) if n_rules <= BROADCAST_RULES else listed
    fits = possible.select("host", "start", "key").join(exact.select("key", "action"), "key")
    best = fits.groupBy("host", "start").agg(
        F.min(F.struct((-F.length("key")).alias("n"), F.col("key"), F.when(F.col("action") == "block", 0).otherwise(1).alias("o"), F.col("action"))).alias("b")
    )
    return urls.join(best, ["host", "start"], "left").select(
        "page_id", "host", "path", F.col("b.key").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict")
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages`, under RULES. NULL urls and those without `://` have an
    empty host and path, which no rule fits; repeated rows each get their row; an empty table gives no rows."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, url, coalesce(instr(url, '://'), 0) AS mark FROM pages
), p AS (
  SELECT page_id,
         CASE WHEN mark > 0 THEN translate(regexp_extract(substr(url, mark + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM p LEFT JOIN LATERAL (
  SELECT r.rule_host || r.rule_path AS rule, r.action FROM rules r
  WHERE (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  ORDER BY length(r.rule_host || r.rule_path) DESC LIMIT 1
) b ON true
"""
