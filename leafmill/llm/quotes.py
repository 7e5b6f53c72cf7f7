"""Chat formatting by quotation linking, in DataFrame and SQL functions only.

Lines are parsed for their quote level and runs of lines of one level joined to passages.  Normalised quoted
passages are hashed and joined to the messages that first said them; where a passage was quoted in part, its lines
and sentences are.  The message that most of a reply's outermost quotes come from becomes its parent, and
conversations are put in reply order without their quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, load

# Possessive, so that a line of very many marks takes no stack.
_MARKS = r"^(?:[ \t]*+>)++"
#: A line that introduces a quote.
_INTRO = r"^.{0,200}(?:wrote|writes|schrieb|écrit|escribió) ?:[ \t]*$"
_ADDED = ("parent_turn", "quote_depth", "n_quoted", "n_linked", "thread_turn", "position", "said")


def parse(frame: DataFrame, text: str = "_x") -> DataFrame:
    """Add ``_lines``: array of (level, said, norm), ``_passages``: array of (level, lines), and ``_own``: the text
    without quotes, their introductions, and blank lines around it."""
    frame = frame.withColumn("_raw", F.expr(rf"split(coalesce({text}, ''), r'\r?\n', -1)"))
    level = rf"length(regexp_replace(regexp_extract(x, r'{_MARKS}', 0), r'[ \t]', ''))"
    frame = frame.withColumn("_lv", F.expr(rf"transform(_raw, x -> struct({level} AS level, regexp_replace(x, r'{_MARKS}[ \t]?', '') AS said))"))
    norm = r"trim(regexp_replace(lower(x.said), r'[\s\x{A0}\x01\x02]+', ' '))"
    intro = rf"(x.level = 0 AND i + 1 < size(_lv) AND _lv[i + 1].level > 0 AND x.said rlike r'{_INTRO}')"
    frame = frame.withColumn("_lines", F.expr(f"transform(_lv, (x, i) -> struct(if({intro}, -1, x.level) AS level, x.said AS said, {norm} AS norm))"))
    # One pass over the lines: a mark where a passage begins, a line feed where it goes on.
    goes_on = "i > 0 AND x.level = _lines[i - 1].level AND x.norm <> '' AND _lines[i - 1].norm <> ''"
    marked = f"transform(_lines, (x, i) -> if({goes_on}, concat('\n', x.norm), concat(char(1), x.level, char(2), x.norm)))"
    frame = frame.withColumn("_runs", F.expr(f"filter(split(array_join({marked}, ''), char(1)), x -> x <> '' AND NOT endswith(x, char(2)))"))
    passage = "struct(int(substring_index(x, char(2), 1)) AS level, split(substring_index(x, char(2), -1), '\n') AS lines)"
    frame = frame.withColumn("_passages", F.expr(f"transform(_runs, x -> {passage})"))
    frame = frame.withColumn("_zero", F.expr("transform(filter(_lines, x -> x.level = 0), x -> x.said)"))
    frame = frame.withColumn("_full", F.expr(r"transform(_zero, x -> x rlike r'[^ \t]')"))
    count = "size(_full) + 2 - array_position(_full, true) - array_position(reverse(_full), true)"
    frame = frame.withColumn("_own", F.expr(f"if(array_contains(_full, true), array_join(slice(_zero, int(array_position(_full, true)), int({count})), '\n'), '')"))
    return frame.drop("_raw", "_lv", "_runs", "_zero", "_full")


def _units(keyed: DataFrame) -> DataFrame:
    """Rows (_c, _t, _pos, _v, _whole, _h): the hash of each passage, and of its lines and sentences."""
    # Outer, or the optimiser would infer a filter that parses the text anew for every line.
    rows = keyed.select("_c", "_t", F.posexplode_outer("_passages").alias("_pos", "p")).where("p.level >= 0")
    rows = rows.select("_c", "_t", "_pos", F.col("p.level").alias("_v"), F.expr("array_join(p.lines, ' ')").alias("_all"), F.col("p.lines").alias("_l"))
    parts = r"filter(array_distinct(concat(_l, split(_all, r'(?<=[.!?]) '))), x -> x <> '' AND x <> _all)"
    rows = rows.select("_c", "_t", "_pos", "_v", F.explode(F.expr(f"concat(array(struct(true AS whole, _all AS norm)), transform({parts}, x -> struct(false AS whole, x AS norm)))")).alias("u"))
    return rows.select("_c", "_t", "_pos", "_v", F.col("u.whole").alias("_whole"), F.substring(F.sha2("u.norm", 256), 1, 32).alias("_h"))


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """All rows and columns with ``parent_turn, quote_depth, n_quoted, n_linked, thread_turn, position, said``.

    A passage is a run of lines of one quote level without a blank line between.  After lower-casing and collapsing
    white space, line ends included, a quoted passage (or a line or sentence of it) is linked to the earliest message
    of its conversation that has it among its own, unquoted passages, lines and sentences, if that is an earlier
    turn.  The parent is the message that most outermost passages come from, then most parts, then the later one.
    ``n_quoted`` and ``n_linked`` count passages.  ``thread_turn`` is the first message of the thread and ``position``
    the place in it in reply order (each message before its replies, replies by turn), so conversations ordered by
    both are in reply order; both are found by doubling, so long threads take few rounds and one row per message.
    ``said`` is the text without quotes.

    Hashes are aggregated map-side before they are joined, so a line that very many messages repeat, or a very long
    conversation, is no hot task, and nothing is gathered by conversation; the replies to one message are put in
    order in one sort.  Null or empty text: an empty text.  Texts and lines of any length take time in proportion.  A
    row with a null conversation or turn is not linked and a thread of its own.  Rows that repeat a conversation and
    turn are linked as one message.  Empty tables give no rows.  Columns may have any names but those that are added.
    """
    if taken := set(_ADDED) & set(messages.columns):
        raise ValueError(f"columns {sorted(taken)} are used by this operator")
    scratch = Scratch(messages.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in messages.columns])
    own = [F.col(f"`{c}`").alias(a) for c, a in ((conversation, "_c"), (turn, "_t"), (text, "_x"))]
    units = _units(parse(messages.select(*own).where(F.col("_c").isNotNull() & F.col("_t").isNotNull())))
    quoted = units.where("_v > 0")
    first = units.where("_v = 0").join(quoted.select("_c", "_h").distinct(), ["_c", "_h"], "left_semi").groupBy("_c", "_h").agg(F.min("_t").alias("_from"))
    hits = scratch.keep(quoted.join(first, ["_c", "_h"]).where("_from < _t").select("_c", "_t", "_pos", "_v", "_whole", "_from"))
    votes = hits.groupBy("_c", "_t", "_v", "_from").agg(F.count_if("_whole").alias("_w"), F.count("*").alias("_k"))
    best = votes.groupBy("_c", "_t").agg(F.max(F.struct((-F.col("_v")).alias("v"), "_w", "_k", "_from"))["_from"].alias("_p"))
    linked = hits.groupBy("_c", "_t").agg(F.count_distinct("_pos").alias("_n"))
    parents = scratch.keep(best.join(linked, ["_c", "_t"]))
    places = reply_order(parents.select("_c", "_t", "_p"), scratch)
    found = places.join(parents.select("_c", "_t", "_p", "_n"), ["_c", "_t"], "left").withColumnsRenamed({"_c": "_c1", "_t": "_t1"})
    whole = parse(messages.select(row.alias("_in"), *own))
    out = whole.join(found, (F.col("_c") == F.col("_c1")) & (F.col("_t") == F.col("_t1")), "left")
    return out.select(
        "_in.*",
        F.col("_p").alias("parent_turn"),
        F.expr("cast(greatest(0, array_max(transform(_lines, x -> x.level))) AS long)").alias("quote_depth"),
        F.expr("cast(size(filter(_passages, x -> x.level > 0)) AS long)").alias("n_quoted"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("_root", "_t").cast("long").alias("thread_turn"),
        F.coalesce("_at", F.lit(0)).cast("long").alias("position"),
        F.col("_own").alias("said"),
    )


def _doubled(chain: DataFrame, scratch: Scratch) -> DataFrame:
    """Follows ``_next`` of rows (_c, _t, _next, _far) to its end, adding up ``_far``; ``_end`` is the last one met."""
    frame = scratch.keep(chain.select("_c", "_t", "_next", "_far", F.coalesce("_next", "_t").alias("_end")))
    while frame.where("_next is not null").limit(1).count():
        up = frame.select("_c", F.col("_t").alias("_next"), F.col("_next").alias("_then"), F.col("_far").alias("_more"), F.col("_end").alias("_last"))
        joined = frame.join(up, ["_c", "_next"], "left")
        far = F.col("_far") + F.coalesce("_more", F.lit(0))
        frame = scratch.keep(joined.select("_c", "_t", F.col("_then").alias("_next"), far.alias("_far"), F.coalesce("_last", "_end").alias("_end")), frame)
    return frame


def reply_order(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``_root`` and ``_at``, the place in the thread, for all messages that ``(_c, _t, _p)`` names; _p is before _t.

    The message after one in reply order is its first reply, else the next reply to its parent, else that of the
    nearest message above that has one.  Both chains, upwards and along this order, are followed by doubling.
    """
    by_turn = "row_number() OVER (PARTITION BY _c, _p ORDER BY _t)"
    replies = parents.selectExpr("_c", "_t", "_p", "lead(_t) OVER (PARTITION BY _c, _p ORDER BY _t) AS _beside", f"{by_turn} AS _k")
    tops = parents.select("_c", F.col("_p").alias("_t")).distinct().join(parents.select("_c", "_t"), ["_c", "_t"], "left_anti")
    none = F.lit(None).cast("long")
    all_ = replies.select("_c", "_t", "_p", "_beside").unionByName(tops.select("_c", "_t", none.alias("_p"), none.alias("_beside")))
    downs = replies.where("_k = 1").select("_c", F.col("_p").alias("_t"), F.col("_t").alias("_down"))
    tree = scratch.keep(all_.join(downs, ["_c", "_t"], "left"))
    roots = _doubled(tree.select("_c", "_t", F.col("_p").alias("_next"), F.lit(1).cast("long").alias("_far")), scratch)
    # The nearest message at or above with a reply beside it: those stop the chain upwards.
    turned = _doubled(tree.select("_c", "_t", F.when(F.col("_beside").isNull(), F.col("_p")).alias("_next"), F.lit(0).cast("long").alias("_far")), scratch)
    beside = tree.select("_c", F.col("_t").alias("_end"), F.col("_beside").alias("_aside"))
    after = tree.join(turned.select("_c", "_t", "_end"), ["_c", "_t"]).join(beside, ["_c", "_end"])
    steps = after.select("_c", "_t", F.coalesce("_down", "_aside").alias("_next"))
    # Counted from the end of the thread, then turned round.
    left = _doubled(steps.select("_c", "_t", "_next", F.when(F.col("_next").isNotNull(), 1).otherwise(0).cast("long").alias("_far")), scratch)
    placed = left.select("_c", "_t", "_far").join(roots.select("_c", "_t", F.col("_end").alias("_root")), ["_c", "_t"])
    total = placed.where("_t = _root").select("_c", "_root", F.col("_far").alias("_total"))
    return placed.join(total, ["_c", "_root"]).select("_c", "_t", "_root", (F.col("_total") - F.col("_far")).alias("_at"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order without quotes."""
    out = link_quotes(load(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", *_ADDED)


_NORM = r"trim(regexp_replace(lower(s), '[\s\x{A0}\x01\x02]+', ' ', 'g'))"
OP8_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, role, i, regexp_extract(x, '^(?:[ \t]*>)+', 0) AS marks, regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') AS s
  FROM (SELECT conv_id, turn, role, generate_subscripts(a, 1) AS i, unnest(a) AS x
        FROM (SELECT conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS a FROM conversations))),
v AS (SELECT *, length(replace(replace(marks, ' ', ''), chr(9), '')) AS lv, {_NORM} AS norm FROM l),
w AS (SELECT *, CASE WHEN lv = 0 AND coalesce(lead(lv) OVER (PARTITION BY conv_id, turn, role ORDER BY i), 0) > 0
        AND regexp_matches(s, '^.{{0,200}}(?:wrote|writes|schrieb|écrit|escribió) ?:[ \t]*$') THEN -1 ELSE lv END AS level FROM v),
b AS (SELECT *, CASE WHEN lag(level) OVER o = level AND lag(norm) OVER o <> '' AND norm <> '' THEN 0 ELSE 1 END AS new FROM w WINDOW o AS (PARTITION BY conv_id, turn, role ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, role ORDER BY i) AS pos FROM b),
pass AS (SELECT conv_id, turn, role, pos, level, string_agg(norm, ' ' ORDER BY i) AS whole, list(norm ORDER BY i) AS lines FROM g WHERE norm <> '' AND level >= 0 GROUP BY ALL),
unit AS (SELECT conv_id, turn, pos, level, true AS is_whole, whole AS norm FROM pass
  UNION ALL SELECT conv_id, turn, pos, level, false, x FROM (
    SELECT DISTINCT conv_id, turn, role, pos, level, whole, unnest(list_concat(lines, string_split(regexp_replace(whole, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)))) AS x FROM pass)
  WHERE x <> '' AND x <> whole),
first_said AS (SELECT conv_id, norm, min(turn) AS src FROM unit WHERE level = 0 GROUP BY ALL),
hits AS (SELECT u.*, src FROM unit u JOIN first_said f ON f.conv_id = u.conv_id AND f.norm = u.norm WHERE level > 0 AND src < u.turn),
votes AS (SELECT conv_id, turn, level, src, count(*) FILTER (WHERE is_whole) AS k, count(*) AS n FROM hits GROUP BY ALL),
linked AS (SELECT conv_id, turn, count(DISTINCT pos) AS n FROM hits GROUP BY ALL),
p AS (SELECT conv_id, turn, arg_max(src, (-level, k, n, src)) AS parent FROM votes GROUP BY ALL),
path AS (
  SELECT m.conv_id, m.turn, [m.turn] AS path FROM (SELECT DISTINCT conv_id, turn FROM conversations) m ANTI JOIN p USING (conv_id, turn)
  UNION ALL SELECT p.conv_id, p.turn, list_append(path.path, p.turn) FROM p JOIN path ON path.conv_id = p.conv_id AND path.turn = p.parent),
placed AS (SELECT conv_id, turn, path[1] AS root, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS place FROM path),
edge AS (SELECT conv_id, turn, role, min(i) FILTER (WHERE regexp_matches(s, '[^ \t]')) AS lo, max(i) FILTER (WHERE regexp_matches(s, '[^ \t]')) AS hi FROM w WHERE level = 0 GROUP BY ALL),
said AS (SELECT w.conv_id, w.turn, w.role, string_agg(s, chr(10) ORDER BY i) AS said FROM w JOIN edge e ON e.conv_id = w.conv_id AND e.turn = w.turn AND e.role = w.role
  WHERE level = 0 AND i BETWEEN lo AND hi GROUP BY ALL),
m AS (SELECT conv_id, turn, role, greatest(0, max(level)) AS depth FROM w GROUP BY ALL),
q AS (SELECT conv_id, turn, role, count(*) AS n FROM pass WHERE level > 0 GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, p.parent AS parent_turn, CAST(depth AS BIGINT) AS quote_depth, CAST(coalesce(q.n, 0) AS BIGINT) AS n_quoted,
  CAST(coalesce(linked.n, 0) AS BIGINT) AS n_linked, CAST(root AS BIGINT) AS thread_turn, CAST(place AS BIGINT) AS position, coalesce(said.said, '') AS said
FROM m LEFT JOIN q USING (conv_id, turn, role) LEFT JOIN p USING (conv_id, turn) LEFT JOIN linked USING (conv_id, turn)
  LEFT JOIN placed USING (conv_id, turn) LEFT JOIN said USING (conv_id, turn, role)
"""
