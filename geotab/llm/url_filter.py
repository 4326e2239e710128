"""URL filter rules by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A rule is a host and a path, like `example.com/en/`. It fits a URL whose host is the rule's or a subdomain of
it and whose path starts with the rule's. Each URL is expanded into its host suffixes (at dots) times its
path prefixes (at slashes), no deeper than any rule goes; a rule is filed under its host and its path up to
the last slash. Both sides meet on the first 32 bits of a digest; then the full digests and the path are
confirmed, and the longest rule wins, a longer host first, then `block`.

Defined cases: a null URL, or one without `://`, has empty host and path, and no rule; pages that no rule fits
get the default verdict; repeated rows are judged each; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
DEFAULT = "allow"
#: Rules and their characters up to which the rule side is broadcast; beyond, the join shuffles.
MOST_RULES, MOST_CHARS = 50_000, 4_000_000
SALTS = 32


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _slashes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """rules (verdict, rule) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def keyed(rules: DataFrame) -> DataFrame:
    """Rules with host, path and the digest they are filed under."""
    at = F.instr(F.concat("rule", F.lit("/")), "/")
    r = rules.where("rule is not null").select("verdict", "rule", F.substring("rule", F.lit(1), at - 1).alias("r_host"), F.substring("rule", at, F.length("rule")).alias("r_path"))
    folder = F.regexp_extract("r_path", r"^(.*/)?", 0)
    r = r.withColumn("r_dirs", _slashes(F.col("r_path"))).withColumn("r_labels", F.size(F.split("r_host", r"\.")))
    r = r.withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), folder), 256))
    return r.withColumn("r_short", F.substring("r_digest", 1, 8))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of each of pages (page_id, url)."""
    rules = keyed(rules)
    size = rules.agg(F.count(F.lit(1)), F.sum(F.length("rule")), F.max("r_labels"), F.max("r_dirs")).first()
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", F.monotonically_increasing_id().alias("_row"), host.alias("host"), path.alias("path"))
    if not size[0]:
        return p.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - F.lit(int(size[2]) - 1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    deep = F.least(_slashes(F.col("path")), F.lit(int(size[3])))
    prefixes = F.transform(
        F.sequence(F.lit(0), deep), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/")))
    )
    e = p.withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
    e = e.withColumn("_digest", F.sha2(F.concat("_suffix", F.lit("\n"), "_prefix"), 256))
    e = e.withColumn("_short", F.substring("_digest", 1, 8)).drop("_suffix", "_prefix")
    small = size[0] <= MOST_RULES and size[1] <= MOST_CHARS
    if small:
        met = e.join(F.broadcast(rules), F.col("_short") == F.col("r_short"), "left")
    else:  # a common host would gather in one task: its rows are spread, the rules repeated
        e = e.withColumn("_salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
        salted = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = e.join(salted, (F.col("_short") == F.col("r_short")) & (F.col("_salt") == F.col("r_salt")), "left")
    sure = (F.col("_digest") == F.col("r_digest")) & F.startswith("path", "r_path") & (F.col("host") != "")
    rank = F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))
    best = met.groupBy("_row", "page_id", "host", "path").agg(F.max(F.when(sure, rank)).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH rules(verdict, rule) AS (VALUES {rules}),
r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS r_host, substr(rule, strpos(rule, '/')) AS r_path FROM rules),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), '{default}') AS verdict
FROM p LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
GROUP BY n, page_id, host, path
""".format(rules=", ".join(f"('{v}', '{r}')" for v, r in RULES), default=DEFAULT)
