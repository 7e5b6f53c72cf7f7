"""URL filters by host-suffix and path-prefix expressions, in DataFrame and SQL functions only.

Every URL is expanded into the expressions that a rule could have: suffixes of its host by labels, prefixes of its
path by segments.  Expressions meet rules in an equi-join on a short prefix of their digests; the full digests
confirm a match, and the longest matching rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load

#: Rules of up to this many characters in total are broadcast; more are joined by a shuffle.
BROADCAST_CHARS = 8 << 20
_SHORT = 8


def split_url(frame: DataFrame, url: str = "_url") -> DataFrame:
    """Add ``host`` and ``path``; both empty where the url is null or has no ``://``."""
    u = url
    after = f"if(coalesce(instr({u}, '://'), 0) = 0, '', substring({u}, instr({u}, '://') + 3))"
    frame = frame.withColumn("_after", F.expr(after))
    frame = frame.withColumn("_host", F.expr("regexp_extract(_after, '^[^/?#]*', 0)"))
    path = "regexp_extract(substring(_after, length(_host) + 1), '^[^?#]*', 0)"
    host = "translate(_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return frame.withColumn("path", F.expr(path)).withColumn("host", F.expr(host)).drop("_after", "_host")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns with ``host``, ``path``, ``rule`` (host and path of the deciding rule) and ``verdict``.

    ``rules`` has ``host`` (lower case), ``path`` and ``verdict``.  A rule fits its host and all subdomains if the
    path starts with the rule's; the longest fitting rule wins, ``block`` before others among equals; without one
    the verdict is ``default`` and rule is null.  Only suffixes of as many labels, and prefixes of as many segments
    (or, for paths that end inside a segment, characters), as some rule has are formed, which the rules' own shapes
    bound.  Expressions are formed once for each different host and path, so frequent URLs cost one row.  Rules
    with a null host or path are left out.  A null url, or one without ``://``, has an empty host and path, which
    a rule fits only if its own are empty too.  Repeated rows are judged alike; empty tables give no rows.
    Columns may have any names but those that are added.
    """
    if taken := {"host", "path", "rule", "verdict"} & set(pages.columns):
        raise ValueError(f"columns {sorted(taken)} are used by this operator")
    rules = rules.where("host is not null and path is not null").select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    rules = rules.withColumn("digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)).withColumn("short", F.substring("digest", 1, _SHORT))
    shape = rules.agg(
        F.collect_set(F.size(F.split("r_host", "[.]"))).alias("labels"),
        F.collect_set(F.when(F.col("r_path").endswith("/"), F.length("r_path") - F.length(F.replace("r_path", F.lit("/"), F.lit(""))))).alias("segments"),
        F.collect_set(F.when(~F.col("r_path").endswith("/"), F.length("r_path"))).alias("chars"),
        F.sum(F.length("r_host") + F.length("r_path") + 100).alias("size"),
    ).first()
    split = split_url(pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_in"), F.col(f"`{url}`").alias("_url")))
    ints = lambda values: f"array({', '.join(map(str, sorted(values)))})" if values else "cast(array() AS array<int>)"
    hosts = f"transform(filter({ints(shape['labels'])}, n -> n <= size(_l)), n -> array_join(slice(_l, size(_l) - n + 1, n), '.'))"
    deep = f"transform(filter({ints(shape['segments'])}, n -> n < size(_s)), n -> concat(substring_index(path, '/', n), '/'))"
    part = f"transform(filter({ints(shape['chars'])}, n -> n <= length(path)), n -> left(path, n))"
    urls = split.select("host", "path").distinct().withColumn("_l", F.split("host", "[.]")).withColumn("_s", F.split("path", "/"))
    urls = urls.withColumn("_p", F.expr(f"concat({deep}, {part})")).select("host", "path", F.explode(F.expr(hosts)).alias("h"), "_p")
    urls = urls.select("host", "path", F.explode("_p").alias("p"), "h")
    expressions = urls.withColumn("full", F.sha2(F.concat("h", F.lit("\n"), "p"), 256)).withColumn("short", F.substring("full", 1, _SHORT))
    small = (shape["size"] or 0) <= BROADCAST_CHARS
    met = expressions.join(F.broadcast(rules) if small else rules, "short").where("full = digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), (F.col("r_verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = split.join(best, ["host", "path"], "left")
    return out.select("_in.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_rules(spark: SparkSession) -> DataFrame:
    return spark.sql("""SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
      ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS t(host, path, verdict)""")


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, op9_rules(spark)).drop("url")


OP9_SQL = """
WITH a AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS s FROM pages),
b AS (SELECT page_id, s, regexp_extract(s, '^[^/?#]*', 0) AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(s, length(h) + 1), '^[^?#]*', 0) AS path FROM b),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM c) u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, c.host, c.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM c LEFT JOIN m ON m.host = c.host AND m.path = c.path
"""
