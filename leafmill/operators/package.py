"""Constraints on a package of items, as tables of violations.

An item is ``(item_id, path, media_type, fallback)``; references, navigation entries and element ids are rows too.
Every check gives the rows that break it, so all violations are found in one pass instead of the first only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Media types that may be remote by themselves.
REMOTE_PREFIXES = ("audio/", "video/", "font/")
REMOTE_TYPES = ("application/font-sfnt", "application/font-woff", "application/vnd.ms-opentype", "application/x-font-ttf")


def missing(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items whose file is not in the package."""
    return items.join(files, "path", "left_anti").select("item_id")


def unknown_fallbacks(items: DataFrame) -> DataFrame:
    """Items whose fallback is no item."""
    known = items.select(F.col("item_id").alias("fallback")).distinct()
    return items.where("fallback is not null").join(known, "fallback", "left_anti").select("item_id")


def fallback_ends(items: DataFrame, checkpoint=lambda f: f.checkpoint()) -> DataFrame:
    """item_id, cyclic: whether the fallbacks from an item run into a circle, by pointer doubling.

    After ``k`` rounds a pointer has jumped ``2**k`` fallbacks; an item that still points on after more jumps than
    there are items is on the way into a circle.  The rounds grow with the logarithm of the longest chain.
    """
    known = items.select(F.col("item_id").alias("fallback")).distinct()
    edges = items.where("fallback is not null").join(known, "fallback", "left_semi").select("item_id", F.col("fallback").alias("at"))
    total = edges.count()
    jumps = 1
    while jumps <= total:
        step = edges.select(F.col("item_id").alias("at"), F.col("at").alias("next"))
        edges = checkpoint(edges.join(step, "at").select("item_id", F.col("next").alias("at")))
        jumps *= 2
        if not edges.limit(1).count():
            break
    circling = edges.select("item_id").distinct().withColumn("cyclic", F.lit(True))
    return items.select("item_id").join(circling, "item_id", "left").select("item_id", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def chains(items: DataFrame, roots: DataFrame, most_hops: int, checkpoint=lambda f: f.checkpoint()) -> DataFrame:
    """root, hop, item_id: the fallbacks from each root, hop by hop, at most ``most_hops``."""
    step = items.select(F.col("item_id").alias("at"), "fallback")
    front = roots.select(F.col("item_id").alias("root"), F.lit(0).cast("long").alias("hop"), "item_id")
    out = front
    for _ in range(most_hops):
        front = front.join(step, F.col("item_id") == F.col("at")).where("fallback is not null").select("root", (F.col("hop") + 1).alias("hop"), F.col("fallback").alias("item_id"))
        front = checkpoint(front.join(items.select("item_id"), "item_id", "left_semi").select("root", "hop", "item_id"))
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    return out


def whole_chains(items: DataFrame, roots: DataFrame, checkpoint=lambda f: f.checkpoint(), most_steps: int | None = None) -> DataFrame:
    """root, hop, item_id: the fallbacks from each root until none follows or an item comes again, by pointer doubling.

    After ``k`` rounds a chain has its first ``2**k`` items; the next as many are those that the pointers of
    ``2**k`` jumps reach from them.  An item met again keeps its least hop; a round without new items is the last.
    More than ``most_steps`` rows are an error.
    """
    known = items.select(F.col("item_id").alias("next")).distinct()
    jump = items.where("fallback is not null").select(F.col("item_id").alias("at"), F.col("fallback").alias("next")).join(known, "next", "left_semi").select("at", "next")
    out = roots.select(F.col("item_id").alias("root"), F.lit(0).cast("long").alias("hop"), "item_id").distinct()
    total, jumps = out.count(), 1
    while True:
        if most_steps is not None and total > most_steps:
            raise RuntimeError(f"fallback chains take {total} steps, more than {most_steps}")
        more = out.join(jump, F.col("item_id") == F.col("at")).select("root", (F.col("hop") + jumps).alias("hop"), F.col("next").alias("item_id"))
        out = checkpoint(out.unionByName(more).groupBy("root", "item_id").agg(F.min("hop").alias("hop")).select("root", "hop", "item_id"))
        now = out.count()
        if now == total:
            return out
        total, jumps = now, jumps * 2
        further = jump.select(F.col("at").alias("next"), F.col("next").alias("last"))
        jump = checkpoint(jump.join(further, "next").select("at", F.col("last").alias("next")))


def without_supported(chain: DataFrame, items: DataFrame, supported: list[str]) -> DataFrame:
    """Roots of chains in which no item has a supported media type."""
    typed = chain.join(items.select("item_id", "media_type"), "item_id")
    return typed.groupBy("root").agg(F.bool_or(F.col("media_type").isin(*supported)).alias("ok")).where("not ok").select(F.col("root").alias("item_id"))


def outside(targets: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """Rows of ``targets`` whose ``column`` is not among ``allowed``."""
    return targets.join(allowed.select(column).distinct(), column, "left_anti")


def missing_fragments(links: DataFrame, ids: DataFrame, collected: DataFrame) -> DataFrame:
    """Links with a fragment that their target does not have; targets whose ids were not collected are not judged."""
    asked = links.where("fragment <> ''").join(collected.select("path").distinct(), "path", "left_semi")
    return asked.join(ids, ["path", "fragment"], "left_anti")


def undeclared(references: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, target, location of references that no item declares."""
    lost = references.join(items.select(F.col("path").alias("target")).distinct(), "target", "left_anti")
    return lost.select("item_id", "target", F.when(F.col("remote"), "remote").otherwise("local").alias("location")).distinct()


def directly_remote(media_type: Column) -> Column:
    """Media types that may be remote whatever refers to them."""
    out = media_type.isin(*REMOTE_TYPES)
    for prefix in REMOTE_PREFIXES:
        out = out | media_type.startswith(prefix)
    return out


def remote_permissions(remote: DataFrame, references: DataFrame, owners: DataFrame) -> DataFrame:
    """item_id, kinds, permitted for remote items.

    ``remote`` has item_id, target, media_type; ``references`` item_id (of the referrer), target, kind; ``owners``
    item_id, declares, scripted.  Every referrer must declare remote resources; the media type must allow it, or all
    referrers must refer by scripts alone and be scripted.  An item that nothing refers to is not permitted.
    """
    by = references.select(F.col("item_id").alias("owner"), "target", "kind").join(owners.withColumnRenamed("item_id", "owner"), "owner")
    each = by.groupBy("target", "owner").agg(F.bool_and("declares").alias("declares"), F.bool_and((F.col("kind") == "script") & F.col("scripted")).alias("script"))
    all_ = each.groupBy("target").agg(F.bool_and("declares").alias("declares"), F.bool_and("script").alias("script"))
    kinds = by.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    found = remote.join(all_, "target", "left").join(kinds, "target", "left")
    permitted = F.coalesce(F.col("declares") & (directly_remote(F.col("media_type")) | F.col("script")), F.lit(False))
    return found.select("item_id", F.coalesce("kinds", F.lit("")).alias("kinds"), permitted.alias("permitted"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def navigation_counts(nav: DataFrame) -> DataFrame:
    """pkg, n_toc, n_pages, n_landmarks, ok: exactly one table of contents, at most one page list and landmarks."""
    n = lambda kind: F.count_if(F.array_contains(F.split("types", r"\s+"), kind))
    out = nav.groupBy("pkg").agg(n("toc").alias("n_toc"), n("page-list").alias("n_pages"), n("landmarks").alias("n_landmarks"))
    return out.withColumn("ok", (F.col("n_toc") == 1) & (F.col("n_pages") <= 1) & (F.col("n_landmarks") <= 1))


def budgets(resources: DataFrame, each: int, total: int) -> DataFrame:
    """pkg, n, bytes, over: parsed bytes of a package, every path once, against both limits."""
    once = resources.groupBy("pkg", "path").agg(F.max("bytes").alias("bytes"))
    out = once.groupBy("pkg").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
    return out.select("pkg", "n", "bytes", ((F.col("bytes") > total) | (F.col("largest") > each)).alias("over"))


def unsafe_members(entries: DataFrame) -> DataFrame:
    """Archive members with a reason: an unsafe name or an unknown compression."""
    name = F.col("name")
    bad = name.startswith("/") | F.contains(name, F.lit("\\")) | F.array_contains(F.split(name, "/"), "..")
    reason = F.when(bad, "unsafe path").when(~F.col("compress_type").isin(0, 8), "unsupported compression")
    return entries.withColumn("reason", reason).where("reason is not null")


def versions_agree(rootfiles: DataFrame) -> DataFrame:
    """pkg, agree: whether all package documents of a publication have one version."""
    return rootfiles.groupBy("pkg").agg((F.countDistinct("version") == 1).alias("agree"))


def asset_names(assets: DataFrame) -> DataFrame:
    """asset, destination: base names; if other contents have the name already, 12 hash characters are added, then all.

    The first asset of a name, by ``ord``, keeps it, and so do all with its contents.
    """
    base = F.substring_index("asset", "/", -1)
    stem, suffix = F.regexp_extract(base, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(base, r"^.+?(\.[^.]*)?$", 1)
    named = assets.select("asset", "ord", "sha", base.alias("base"), stem.alias("stem"), suffix.alias("suffix"))
    first = named.groupBy("base").agg(F.min_by("sha", "ord").alias("first"))
    short = F.concat("stem", F.lit("-"), F.substring("sha", 1, 12), "suffix")
    seen = named.join(first, "base").withColumn("short", F.when(F.col("sha") != F.col("first"), short))
    owner = seen.where("short is not null").groupBy("short").agg(F.min_by("sha", "ord").alias("owner"))
    out = seen.join(owner, "short", "left")
    full = F.concat("stem", F.lit("-"), "sha", "suffix")
    return out.select("asset", F.when(F.col("short").isNull(), F.col("base")).when(F.col("owner") == F.col("sha"), F.col("short")).otherwise(full).alias("destination"))


# Attributes that refer to resources, by element, as far as pages use them.
RESOURCE_ATTRIBUTES = {
    "audio": ("src",), "embed": ("src",), "iframe": ("src",), "image": ("href",), "img": ("src",), "input": ("src",), "link": ("href",),
    "object": ("data",), "script": ("src",), "source": ("src",), "track": ("src",), "use": ("href",), "video": ("poster", "src"),
}


def resource_rules(spark) -> DataFrame:
    rows = ", ".join(f"('{e}', '{a}')" for e, names in RESOURCE_ATTRIBUTES.items() for a in names)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(element, attribute)")


def importmap_references(value: Column) -> Column:
    """Distinct references of import maps: the values of imports and scopes, and the keys of integrity."""
    parsed = F.from_json(value, "imports MAP<STRING, STRING>, scopes MAP<STRING, MAP<STRING, STRING>>, integrity MAP<STRING, STRING>")
    none = F.array().cast("array<string>")
    imports = F.coalesce(F.map_values(parsed["imports"]), none)
    scopes = F.coalesce(F.flatten(F.transform(F.map_values(parsed["scopes"]), F.map_values)), none)
    integrity = F.coalesce(F.map_keys(parsed["integrity"]), none)
    return F.array_sort(F.array_distinct(F.filter(F.concat(imports, scopes, integrity), lambda x: x.isNotNull())))


def speculation_references(value: Column) -> Column:
    """Distinct urls of prefetch and prerender rules."""
    parsed = F.from_json(value, "prefetch ARRAY<STRUCT<urls: ARRAY<STRING>>>, prerender ARRAY<STRUCT<urls: ARRAY<STRING>>>")
    none = F.array().cast("array<string>")
    urls = lambda k: F.coalesce(F.flatten(F.filter(F.transform(parsed[k], lambda r: r["urls"]), lambda u: u.isNotNull())), none)
    return F.array_sort(F.array_distinct(F.concat(urls("prefetch"), urls("prerender"))))


def alias_closure(edges: DataFrame, seeds: DataFrame, checkpoint=lambda f: f.checkpoint()) -> DataFrame:
    """name, root: names that stand for a seed by way of aliases (``edges`` of name and target).

    Each round extends only what the last one found; a name is found once, so the rounds end.
    """
    known = seeds.select("name", F.col("name").alias("root")).distinct()
    front = known
    step = edges.select(F.col("name").alias("next"), F.col("target").alias("name"))
    while front.limit(1).count():
        more = front.join(step, "name").select(F.col("next").alias("name"), "root").distinct()
        front = checkpoint(more.join(known, ["name", "root"], "left_anti"))
        known = known.unionByName(front)
    return known


def nearest_bindings(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """use, name, scope: the innermost enclosing scope that binds a name.

    ``uses`` has use, name and ``path`` (array of scopes, outermost first); ``bindings`` has scope and name.
    """
    steps = uses.select("use", "name", F.posexplode("path").alias("depth", "scope"))
    met = steps.join(bindings.distinct(), ["scope", "name"])
    return met.groupBy("use", "name").agg(F.max_by("scope", "depth").alias("scope"))


def root_mismatches(resources: DataFrame, expected: DataFrame) -> DataFrame:
    """item_id, root, expected: resources whose root element is not the one of their media type."""
    return resources.join(F.broadcast(expected), "media_type").where("root <> expected").select("item_id", "root", "expected")
