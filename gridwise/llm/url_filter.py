"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

A rule is a host and a path; it fits the host itself and its subdomains when the URL's path starts with
the rule's. Every distinct (host, path) is expanded into the suffixes of the host with as many labels as some rule has,
each with the prefixes of the path whose length some rule has (both are of the rules' number, whatever the URL's length); expressions and rules meet by the first characters of their SHA-256,
then the whole digests must agree. The longest rule that fits wins; of equal rules, block wins. Without a
rule the verdict is allow.

Null URLs and those without `://` have an empty host and path and fit no rule; repeated rows are judged
alike, once, and each keep a row; a URL of any length is judged whole; empty tables (of pages or of rules) give an empty result or allow all; other columns of pages
stay out of the way and are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwise.llm.common import lower_ascii, read

#: (verdict, host, path) of the production rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; both empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def with_digest(df: DataFrame, expression: Column) -> DataFrame:
    return df.withColumn("digest", F.sha2(expression, 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."))) + 1


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(page_id, url) by rules(verdict, host, path): page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url").cast("string"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = with_digest(rules.select(F.col("verdict").alias("rule_verdict"), F.concat("host", "path").alias("rule"), F.concat_ws("\n", "host", "path").alias("expression"), F.length("path").alias("size"), _labels("host").alias("labels")), F.col("expression"))
    sizes = sorted(r[0] for r in rules.select("size").distinct().collect())  # as many as a rule's path has characters
    labels = sorted(r[0] for r in rules.select("labels").distinct().collect())  # as many as a rule's host has labels
    suffixes = F.array(*(F.when(_labels("host") >= k, F.substring_index("host", ".", -k)) for k in labels)).cast("array<string>")
    expanded = (
        judged.filter("host != ''").select("host", "path").distinct()
        .withColumn("suffix", F.explode(F.array_compact(suffixes)))
        .withColumn("n", F.explode(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("path"))))
    )
    expanded = with_digest(expanded, F.concat_ws("\n", "suffix", F.expr("substring(path, 1, n)")))
    found = (
        expanded.join(rules.select("prefix", F.col("digest").alias("rule_digest"), "rule", "rule_verdict"), "prefix")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict")).alias("best"))
    )
    with_host = judged.filter("host != ''").join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict")
    )
    # all that have no host, however many, are one key: they need no join
    return with_host.unionByName(judged.filter("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(list(RULES), "verdict string, host string, path string"))


_PARTS = """
    SELECT page_id,
           coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path
    FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)
"""
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP10_SQL = f"""
    WITH parts AS ({_PARTS}), rules(verdict, host, path) AS (VALUES {_RULES}),
    hits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
             FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""
