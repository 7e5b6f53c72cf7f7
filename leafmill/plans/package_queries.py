"""Queries over packages and corrections, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import package as P
from ..operators import review as R
from ..sources import derived as D
from .checkpoints import keep
from .text_queries import s_fold

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


_FILES = "files AS (SELECT path FROM items WHERE item_id % 9 <> 4)"


@query(f"WITH {D.ITEMS}, {_FILES} SELECT item_id FROM items ANTI JOIN files USING (path)")
def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a file, every ninth being taken away."""
    items = D.items(spark, sf_dir)
    return P.missing(items, items.where("item_id % 9 <> 4").select("path"))


@query(f"WITH {D.ITEMS} SELECT item_id FROM items WHERE fallback IS NOT NULL AND fallback NOT IN (SELECT item_id FROM items)")
def fallback_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose fallback does not exist."""
    return P.unknown_fallbacks(D.items(spark, sf_dir))


@query(f"""WITH RECURSIVE {D.ITEMS}, walk AS (SELECT item_id AS root, item_id AS at, 0 AS hop FROM items
  UNION ALL SELECT root, b.item_id, hop + 1 FROM walk JOIN items a ON a.item_id = walk.at JOIN items b ON b.item_id = a.fallback WHERE hop <= 200)
SELECT root AS item_id, max(hop) > 200 AS cyclic FROM walk GROUP BY root""")
def fallback_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose fallbacks run in a circle."""
    return P.fallback_ends(D.items(spark, sf_dir), keep)


_CHAIN = f"""{D.ITEMS}, walk AS (SELECT item_id AS root, CAST(0 AS BIGINT) AS hop, item_id, [item_id] AS seen FROM items
  UNION ALL SELECT root, hop + 1, b.item_id, list_append(seen, b.item_id) FROM walk JOIN items a ON a.item_id = walk.item_id JOIN items b ON b.item_id = a.fallback WHERE NOT list_contains(seen, b.item_id))"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT root, hop, item_id FROM walk")
def spine_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback chains of all items until they end or meet an item again."""
    items = D.items(spark, sf_dir)
    return P.whole_chains(items, items, keep)


@query(f"WITH RECURSIVE {_CHAIN} SELECT root AS item_id FROM walk JOIN items USING (item_id) GROUP BY root HAVING NOT bool_or(media_type IN ('application/xhtml+xml'))")
def spine_no_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose whole chain has no content document."""
    items = D.items(spark, sf_dir)
    return P.without_supported(P.whole_chains(items, items, keep), items, ["application/xhtml+xml"])


_NAV = "nav AS (SELECT item_id, path, '#f' || item_id % 3 AS tail, 'f' || item_id % 3 AS fragment, path || '#f' || item_id % 3 AS href FROM items WHERE item_id % 2 = 0)"


def _nav(items: DataFrame) -> DataFrame:
    nav = items.where("item_id % 2 = 0").select("item_id", F.concat("path", F.lit("#f"), F.col("item_id") % 3).alias("href"))
    return nav.select("href", U.navigation_target(F.col("href")).alias("t")).select("href", "t.path", "t.fragment")


@query(f"WITH {D.ITEMS}, {_NAV} SELECT href FROM nav WHERE path NOT IN (SELECT path FROM items WHERE item_id % 3 <> 0)")
def nav_outside_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation targets that are not in the spine."""
    items = D.items(spark, sf_dir)
    return P.outside(_nav(items), items.where("item_id % 3 <> 0"), "path").select("href")


@query(f"""WITH {D.ITEMS}, {_NAV} SELECT href FROM nav WHERE item_id % 8 <> 0 AND fragment <> 'f' || item_id % 4""")
def missing_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation fragments that their targets lack."""
    items = D.items(spark, sf_dir)
    ids = items.select("path", F.concat(F.lit("f"), F.col("item_id") % 4).alias("fragment"))
    return P.missing_fragments(_nav(items), ids, items.where("item_id % 8 <> 0")).select("href")


_REFS = """refs AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'https://cdn.example.com/' || item_id % 3 ELSE 'text/' || (item_id * 2) || '.xhtml' END AS target, item_id % 5 = 0 AS remote,
  CASE WHEN item_id % 2 = 0 THEN 'embedded' ELSE 'script' END AS kind FROM items)"""


def _references(items: DataFrame) -> DataFrame:
    i = F.col("item_id")
    target = F.when(i % 5 == 0, F.concat(F.lit("https://cdn.example.com/"), i % 3)).otherwise(F.concat(F.lit("text/"), i * 2, F.lit(".xhtml")))
    return items.select("item_id", target.alias("target"), (i % 5 == 0).alias("remote"), F.when(i % 2 == 0, "embedded").otherwise("script").alias("kind"))


@query(f"WITH {D.ITEMS}, {_REFS} SELECT item_id, target, CASE WHEN remote THEN 'remote' ELSE 'local' END AS location FROM refs WHERE target NOT IN (SELECT path FROM items)")
def undeclared_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to what no item declares."""
    items = D.items(spark, sf_dir)
    return P.undeclared(_references(items), items)


_OWNERS = "owners AS (SELECT item_id, item_id % 30 <> 5 AS declares, item_id % 4 <> 3 AS scripted FROM items)"


@query(f"""WITH {D.ITEMS}, {_REFS}, {_OWNERS}, remote(item_id, target, media_type) AS (VALUES (1, 'https://cdn.example.com/0', 'video/mp4'), (2, 'https://cdn.example.com/1', 'image/png'), (3, 'https://cdn.example.com/2', 'font/woff2'), (4, 'https://cdn.example.com/9', 'audio/mpeg')),
j AS (SELECT target, declares, kind, kind = 'script' AND scripted AS script FROM refs JOIN owners USING (item_id)),
a AS (SELECT target, bool_and(declares) AS declares, bool_and(script) AS script, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM j GROUP BY target)
SELECT CAST(item_id AS BIGINT) AS item_id, coalesce(kinds, '') AS kinds, coalesce(declares AND (regexp_matches(media_type, '^(audio|video|font)/') OR script), false) AS permitted FROM remote LEFT JOIN a USING (target)""")
def remote_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which remote items their referrers permit."""
    items = D.items(spark, sf_dir)
    remote = spark.sql("""SELECT cast(item_id AS bigint) AS item_id, target, media_type FROM VALUES (1, 'https://cdn.example.com/0', 'video/mp4'), (2, 'https://cdn.example.com/1', 'image/png'),
      (3, 'https://cdn.example.com/2', 'font/woff2'), (4, 'https://cdn.example.com/9', 'audio/mpeg') AS t(item_id, target, media_type)""")
    owners = items.select("item_id", (F.col("item_id") % 30 != 5).alias("declares"), (F.col("item_id") % 4 != 3).alias("scripted"))
    return P.remote_permissions(remote, _references(items), owners)


_IDS = "SELECT page_id AS doc, regexp_extract(unnest(regexp_extract_all(html, 'href=\"[^\"]*\"')), '\"(.*)\"', 1) AS id FROM pages"


@query(f"WITH i AS ({_IDS}) SELECT doc, id, count(*) AS n FROM i GROUP BY doc, id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that a page has twice."""
    ids = D.load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("id"))
    return P.repeated(ids, "doc", "id")


@query(f"WITH {D.BLOCKS}, n AS (SELECT {s_fold('block')} AS canonical FROM blocks WHERE block IS NOT NULL) SELECT canonical, count(*) AS n FROM n GROUP BY canonical HAVING count(*) > 1")
def zip_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are the same name once case is folded."""
    return P.repeated(D.blocks(spark, sf_dir).where("block is not null").select(X.casefold(F.col("block")).alias("canonical")), "canonical")


def _types() -> F.Column:
    k = F.col("item_id") % 4
    return F.when(k == 0, "toc").when(k == 1, "page-list x").when(k == 2, "landmarks").otherwise("other")


@query(f"""WITH {D.ITEMS}, n AS (SELECT item_id // 5 AS pkg, CASE item_id % 4 WHEN 0 THEN 'toc' WHEN 1 THEN 'page-list x' WHEN 2 THEN 'landmarks' ELSE 'other' END AS types FROM items)
SELECT pkg, count(*) FILTER (WHERE types = 'toc') AS n_toc, count(*) FILTER (WHERE types = 'page-list x') AS n_pages, count(*) FILTER (WHERE types = 'landmarks') AS n_landmarks,
  n_toc = 1 AND n_pages <= 1 AND n_landmarks <= 1 AS ok FROM n GROUP BY pkg""")
def nav_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation elements of packages of five items each, all items included."""
    return P.navigation_counts(D.items(spark, sf_dir).select(F.expr("item_id div 5").alias("pkg"), _types().alias("types")))


@query("""WITH r AS (SELECT doc_id % 50 AS pkg, doc_id % 400 AS path, max(strlen(text)) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT pkg, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) > 20000 OR max(bytes) > 10000 AS over FROM r GROUP BY pkg""")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed bytes of packages against small limits."""
    docs = D.load(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select((F.col("doc_id") % 50).alias("pkg"), (F.col("doc_id") % 400).alias("path"), F.octet_length("text").cast("long").alias("bytes"))
    return P.budgets(rows, 10_000, 20_000)


_ELEMENTS = r"""(?i)<([a-z]+) ([a-z]+)="[^"]*\""""


@query(f"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '{_ELEMENTS}')) AS x FROM pages), p AS (SELECT page_id AS node, lower(regexp_extract(x, '{_ELEMENTS}', 1)) AS element, lower(regexp_extract(x, '{_ELEMENTS}', 2)) AS attribute FROM e)
SELECT node, element, attribute, count(*) AS n FROM p WHERE (element || ' ' || attribute) IN ({", ".join(f"'{e} {a}'" for e, names in P.RESOURCE_ATTRIBUTES.items() for a in names)}, 'a href') GROUP BY ALL""")
def reference_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of elements that refer to resources, links included."""
    found = D.load(spark, sf_dir, "pages").select(F.col("page_id").alias("node"), F.explode(F.regexp_extract_all("html", F.lit(_ELEMENTS), F.lit(0))).alias("x"))
    part = lambda k: F.lower(F.regexp_extract("x", _ELEMENTS, k))
    rules = P.resource_rules(spark).unionByName(spark.sql("SELECT 'a' AS element, 'href' AS attribute"))
    named = found.select("node", part(1).alias("element"), part(2).alias("attribute"))
    return named.join(F.broadcast(rules), ["element", "attribute"]).groupBy("node", "element", "attribute").agg(F.count("*").alias("n"))


_SAID = r"""CASE WHEN confidence < 0.3 THEN 'confidence' WHEN CASE WHEN original = '' THEN length(text) + 1 ELSE (length(text) - length(replace(text, original, ''))) / length(original) END <> 1 THEN 'occurrence count'
  WHEN contains(original, '![') OR contains(replacement, '![') OR contains(replacement, 'ASSET_PATH_REDACTED') THEN 'image reference'
  WHEN regexp_extract_all(original, 'https?://[^\s)>]+') <> regexp_extract_all(replacement, 'https?://[^\s)>]+') THEN 'external link'
  WHEN length(replacement) > length(original) * 1.5 + 20 THEN 'expansion' ELSE 'applied' END"""


@query(f"WITH {D.PATCHES} SELECT doc_id, seq, {_SAID} AS verdict FROM patches")
def patch_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on proposed corrections."""
    p = D.patches(spark, sf_dir)
    return p.select("doc_id", "seq", R.verdict(F.col("text"), F.col("original"), F.col("replacement"), F.col("confidence"), 0.3).alias("verdict"))


@query(f"""WITH {D.PATCHES}, v AS (SELECT *, {_SAID} AS said FROM patches)
SELECT doc_id, sha256(CASE WHEN said = 'applied' THEN replace(text, original, replacement) ELSE text END) AS corrected_sha, CAST(said = 'applied' AS BIGINT) AS n_applied, CAST(said <> 'applied' AS BIGINT) AS n_rejected FROM v""")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their corrections applied."""
    p = D.patches(spark, sf_dir)
    done = p.select("doc_id", R.apply_patches(F.col("text"), F.array(F.struct("original", "replacement", "confidence")), 0.3).alias("r"))
    n = F.size(F.filter("r.verdicts", lambda v: v == "applied")).cast("long")
    return done.select("doc_id", F.sha2("r.text", 256).alias("corrected_sha"), n.alias("n_applied"), (F.size("r.verdicts") - n).alias("n_rejected"))


_PLAN = """plan AS (SELECT conv_id AS doc_id, turn // 3 + 1 AS batch, min(turn) + 1 AS start_page, max(turn) + 1 AS end_page,
  sha256(trim(string_agg(text, chr(10) || chr(10) ORDER BY turn)) || chr(10)) AS input_sha FROM conversations GROUP BY conv_id, turn // 3)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plan_batches(D.load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text"), 3)


@query(f"WITH {_PLAN} SELECT doc_id, batch, start_page, end_page, input_sha FROM plan")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of three pages."""
    return _plan(spark, sf_dir)


@query(f"WITH {_PLAN} SELECT doc_id, batch FROM plan WHERE NOT (doc_id % 2 = 0 AND batch = 1)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches still to do where the first ones of even documents are done and those of odd ones failed or changed."""
    plan = _plan(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    results = plan.where("batch = 1").withColumn("status", F.when(even | (F.col("doc_id") % 3 == 0), "completed").otherwise("paused"))
    results = results.withColumn("input_sha", F.when(even, F.col("input_sha")).otherwise(F.lit("other")))
    return R.remaining(plan, results).select("doc_id", "batch")


@query(f"""WITH {_PLAN} SELECT doc_id, CAST(sum(batch % 3) AS BIGINT) AS applied, CAST(sum(end_page - start_page) AS BIGINT) AS rejected, nullif(sum(CASE WHEN doc_id % 2 = 0 THEN 0.0 ELSE 0.5 * batch END)::DOUBLE, 0) AS cost FROM plan GROUP BY doc_id""")
def batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of batch results."""
    cost = F.when(F.col("doc_id") % 2 == 0, 0.0).otherwise(0.5 * F.col("batch"))
    return R.audit(_plan(spark, sf_dir).select("doc_id", (F.col("batch") % 3).alias("applied"), (F.col("end_page") - F.col("start_page")).alias("rejected"), cost.alias("cost")))


@query("""WITH a AS (SELECT page_id AS ord, 'dir' || page_id || '/img' || page_id % 40 || '.png' AS asset, sha256('c' || page_id % 60) AS sha FROM pages),
f AS (SELECT ord % 40 AS k, arg_min(sha, ord) AS first FROM a GROUP BY ord % 40)
SELECT asset, CASE WHEN sha = first THEN 'img' || k || '.png' ELSE 'img' || k || '-' || substr(sha, 1, 12) || '.png' END AS destination FROM a JOIN f ON f.k = ord % 40""")
def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of localised assets where base names collide."""
    i = F.col("page_id")
    asset = F.concat(F.lit("dir"), i, F.lit("/img"), i % 40, F.lit(".png"))
    return P.asset_names(D.load(spark, sf_dir, "pages").select(i.alias("ord"), asset.alias("asset"), F.sha2(F.concat(F.lit("c"), i % 60), 256).alias("sha")))


@query("""SELECT page_id AS id, unnest(CASE page_id % 3 WHEN 0 THEN ['/a' || page_id || '.js', '/b.js', '/c.js'] WHEN 1 THEN ['/p' || page_id] ELSE [] END) AS ref FROM pages""")
def importmap_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of import maps, some broken, and of speculation rules."""
    i = F.col("page_id")
    maps = F.concat(F.lit('{"imports":{"x":"/a'), i, F.lit('.js"},"scopes":{"/s/":{"y":"/b.js"}},"integrity":{"/c.js":"sha"}}'))
    rules = F.concat(F.lit('{"prefetch":[{"urls":["/p'), i, F.lit('"]}]}'))
    refs = F.when(i % 3 == 0, P.importmap_references(maps)).when(i % 3 == 1, P.speculation_references(rules)).otherwise(P.importmap_references(F.lit("{broken")))
    return D.load(spark, sf_dir, "pages").select(i.alias("id"), F.explode(refs).alias("ref"))


@query(f"""WITH {D.PAGE_BLOCKS}, m AS (SELECT doc_id, CAST(count(DISTINCT page) AS BIGINT) AS pages, count(*) AS blocks, CAST(sum(length(block)) AS BIGINT) AS chars FROM page_blocks GROUP BY doc_id)
SELECT doc_id, metric, value FROM m UNPIVOT (value FOR metric IN (pages, blocks, chars))""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics of documents as rows."""
    m = D.page_blocks(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("blocks"), F.sum(F.length("block")).cast("long").alias("chars"))
    return m.unpivot("doc_id", ["pages", "blocks", "chars"], "metric", "value")
