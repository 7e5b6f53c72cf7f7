"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Fixed patterns give the base spans.  High-recall generators propose further, overlapping candidates; boosted trees
score each candidate from its format and its context; a threshold calibrated on held-out candidates selects which
are added.  The trees are fitted on the driver from the counted features of all candidates and applied as a CASE
expression, so the texts never leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, load

KINDS = ("email", "ip", "card", "phone")

# Linear forms of the base patterns.  A match can only begin where a run of its first character class begins or
# where the last match ended (\G), and possessive repeats never give back: both change no match, but a long run
# without a match costs one pass and no stack.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GENERATORS = {
    "mail": r"(?:\G|(?<![^\s@<>()\[\],;\"]))[^\s@<>()\[\],;\"]++@[^\s@<>()\[\],;\"]++",
    "number": r"(?<![0-9])[+(]?[0-9](?:[\x20().\/-]{0,2}[0-9]){6,}+",
    "dotted": r"(?:\G|(?<![0-9]))[0-9]++(?:[.:][0-9]++){3,}+",
    "token": r"(?:\G|(?<![A-Za-z0-9_+\/=-]))[A-Za-z0-9_+\/=-]{12,}+",
}
#: The kind of an added span by its generator.
_ADDED = {"mail": "email", "number": "number", "dotted": "ip", "token": "secret"}
_NEEDS = {"email": "contains(_t, '@')", "mail": "contains(_t, '@')"}
_RANK = {k: i for i, k in enumerate((*KINDS, "number", "secret"))}


def _running(values: str, step: str) -> str:
    """SQL for running results of ``step`` (of ``a`` and ``y``) over an array of longs.

    Arrays are cut to blocks once, as a slice copies all of its array, so many matches in one text stay cheap.
    """
    return f"""transform(array(transform(sequence(0, size({values}) div 128), c -> slice({values}, c * 128 + 1, 128))), blocks ->
      transform(array(transform(blocks, b -> aggregate(b, 0L, (a, y) -> {step}))), totals ->
        flatten(transform(blocks, (b, c) -> transform(array(aggregate(slice(totals, 1, c), 0L, (a, y) -> {step})), base ->
          transform(b, (x, i) -> aggregate(slice(b, 1, i + 1), base, (a, y) -> {step})))[0])))[0])[0]"""


def _cells(value: str) -> str:
    """SQL that cuts a text into cells of 256 characters, so that a piece of it is not looked for from its beginning."""
    return f"regexp_extract_all({value}, '(?s).{{1,256}}', 0)"


def _piece(cells: str, a: str, b: str) -> str:
    """SQL for the characters from ``a`` up to ``b`` of a text in cells."""
    two = f"concat(coalesce(get({cells}, int({a} div 256)), ''), coalesce(get({cells}, int({a} div 256) + 1), ''))"
    many = f"array_join(slice({cells}, int({a} div 256 + 1), int(({b} - 1) div 256 - {a} div 256 + 1)), '')"
    return f"if({a} >= {b}, '', substring(if({b} - {a} <= 256, {two}, {many}), int({a} % 256 + 1), int({b} - {a})))"


def _meets(x: str, test: str = "y.s < x.e AND x.s < y.e") -> str:
    """SQL for whether a span of ``_spread`` passes ``test`` with a candidate; only blocks of spans near it are searched."""
    return f"exists(_spread, b -> b.lo < {x}.e AND {x}.s < b.hi AND exists(b.own, y -> {test}))"


#: Base spans in blocks with the range that each block covers.
_SPREAD = """transform(if(size(_base) = 0, cast(array() AS array<int>), sequence(0, (size(_base) - 1) div 512)), c -> struct(
  _base[c * 512].s AS lo, array_max(transform(slice(_base, c * 512 + 1, 512), y -> y.e)) AS hi, slice(_base, c * 512 + 1, 512) AS own))"""


def _located(frame: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add ``_s_<name>``: array of (s, e, m) for the leftmost non-overlapping matches in ``_t``; code points."""
    needs = _NEEDS.get(name, "_t rlike '[0-9]'")
    frame = frame.withColumn("_m", F.expr(f"if({needs}, regexp_extract_all(_t, r'{pattern}', 0), array())"))
    frame = frame.withColumn("_g", F.expr(f"if(size(_m) > 0, split(_t, r'{pattern}', -1), array())"))
    frame = frame.withColumn("_l", F.expr("transform(slice(arrays_zip(_g, _m), 1, size(_m)), x -> cast(length(x._g) + length(x._m) AS long))"))
    frame = frame.withColumn("_e", F.expr(_running("_l", "a + y")))
    return frame.withColumn(f"_s_{name}", F.expr("transform(_m, (x, i) -> struct(_e[i] - length(x) AS s, _e[i] AS e, x AS m))")).drop("_m", "_g", "_l", "_e")


_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = """(aggregate(transform(sequence(1, length({d})), i ->
  int(substr({d}, length({d}) + 1 - i, 1)) * if(i % 2 = 0, 2, 1)), 0, (a, y) -> a + y - if(y > 9, 9, 0)) % 10 = 0)"""
_VALID = {
    "ip": "forall(transform(split(x.m, '[.]'), p -> regexp_replace(p, '^0+', '')), p -> length(p) < 3 OR (length(p) = 3 AND p <= '255'))",
    "card": f"length({_DIGITS.format(m='x.m')}) BETWEEN 14 AND 19 AND {_LUHN.format(d=_DIGITS.format(m='x.m'))}",
    "phone": f"length({_DIGITS.format(m='x.m')}) BETWEEN 10 AND 15",
}


def base_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """``_in`` (a struct of all columns), ``_t`` (the text, empty for null) and ``_base``: array of (s, r, e, k, m) in
    order of start and kind."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    frame = documents.select(row.alias("_in"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    parts = []
    for kind in KINDS:
        frame = _located(frame, kind, _BASE[kind])
        if kind in _VALID:
            frame = frame.withColumn(f"_s_{kind}", F.expr(f"filter(_s_{kind}, x -> {_VALID[kind]})"))
        parts.append(f"transform(_s_{kind}, x -> struct(x.s AS s, {_RANK[kind]} AS r, x.e AS e, '{kind}' AS k, x.m AS m))")
    frame = frame.withColumn("_base", F.expr(f"array_sort(concat({', '.join(parts)}))"))
    return frame.drop(*[f"_s_{kind}" for kind in KINDS])


#: Format and context features of a candidate ``x`` (m: its text, p and n: the 24 characters before and after).
FEATURES = {
    "chars": "length(x.m)",
    "digits": "length(regexp_replace(x.m, '[^0-9]', ''))",
    "letters": "length(regexp_replace(x.m, '[^A-Za-z]', ''))",
    "lower": "length(regexp_replace(x.m, '[^a-z]', ''))",
    "dots": "length(regexp_replace(x.m, '[^.]', ''))",
    "dashes": "length(regexp_replace(x.m, '[^_-]', ''))",
    "spaces": r"length(regexp_replace(x.m, r'[^\x20()]', ''))",
    "changes": "size(regexp_extract_all(x.m, '[0-9]+|[A-Za-z]+', 0))",
    "at": "int(contains(x.m, '@'))",
    "plus": "int(startswith(x.m, '+'))",
    "host": r"int(x.m rlike r'@[^@]+\.[A-Za-z]{2,}$')",
    "starts_digit": "int(x.m rlike '^[0-9]')",
    "quoted": r"int(x.p rlike r'[\"\x27]$')",
    "assigned": r"int(x.p rlike r'[=:]\s*[\"\x27]?$')",
    "named": r"int(x.p rlike r'(?i)(?:key|token|secret|passw|pwd|auth|mail|tel|phone|fax|call|card|visa|iban|ssn)[^\p{L}]*$')",
    "after_word": r"int(x.p rlike r'\p{L}$')",
    "before_word": r"int(x.n rlike r'^\p{L}')",
    "before_digit": "int(x.n rlike '^[0-9]')",
    "line_start": r"int(x.p rlike r'(?:^|\n)\s*$')",
}


_SEEN = list(FEATURES)
#: Features that make labels, which the model does not see.
_HIDDEN = ("assigned", "named")
#: Bits of a count that are kept when no count is rounded.
EXACT = 53


def _rounded(x: str, bits: int) -> str:
    """SQL for a count of which only the ``bits`` leading bits are kept."""
    return x if bits >= EXACT else f"({x} - {x} % shiftleft(1L, greatest(0, length(bin(bigint({x}))) - {bits})))"


def candidates(frame: DataFrame) -> DataFrame:
    """Add ``_cand``: array of (s, e, g, m, f) proposed by the generators, f being the features; and ``_spread``."""
    parts = []
    for name, pattern in _GENERATORS.items():
        frame = _located(frame, name, pattern)
        keep = f"filter(_s_{name}, x -> x.m rlike '[0-9]')" if name == "token" else f"_s_{name}"
        parts.append(f"transform({keep}, x -> struct(x.s AS s, x.e AS e, '{name}' AS g, x.m AS m))")
    frame = frame.withColumn("_raw", F.expr(f"concat({', '.join(parts)})"))
    frame = frame.withColumn("_pieces", F.expr(f"if(size(_raw) = 0, cast(array() AS array<string>), {_cells('_t')})"))
    before, after = _piece("_pieces", "greatest(x.s - 24, 0L)", "x.s"), _piece("_pieces", "x.e", "(x.e + 24)")
    frame = frame.withColumn("_near", F.expr(f"transform(_raw, x -> struct(x.s AS s, x.e AS e, x.g AS g, x.m AS m, {before} AS p, {after} AS n))"))
    features = ", ".join(f"double({x})" for x in FEATURES.values())
    frame = frame.withColumn("_cand", F.expr(f"transform(_near, x -> struct(x.s AS s, x.e AS e, x.g AS g, x.m AS m, array({features}) AS f))"))
    return frame.withColumn("_spread", F.expr(_SPREAD)).drop("_raw", "_near", "_pieces", *[f"_s_{name}" for name in _GENERATORS])


@dataclass
class Tree:
    """A node: a leaf if ``feature`` is negative."""

    feature: int
    cut: float
    value: float
    low: Tree | None = None
    high: Tree | None = None

    def sql(self) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"CASE WHEN x.f[{self.feature}] <= {self.cut!r}D THEN {self.low.sql()} ELSE {self.high.sql()} END"

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.predict(x), self.high.predict(x))


def _tops(values: np.ndarray, bits: int) -> np.ndarray:
    """The greatest count that :func:`_rounded` makes each of these values of."""
    spare = np.maximum(np.frexp(values)[1] - bits, 0)
    return values + 2.0**spare - 1


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, ridge: float = 1.0, bits: int = EXACT) -> Tree:
    score = lambda g, h: g * g / (h + ridge)
    g, h = grad.sum(), hess.sum()
    leaf = Tree(-1, 0.0, float(rate * g / (h + ridge)))
    best = (1e-6, -1, 0.0)
    for j in range(x.shape[1] if depth else 0):
        order = np.argsort(x[:, j], kind="stable")
        values = x[order, j]
        last = np.flatnonzero(values[1:] > values[:-1])
        if not len(last):
            continue
        gl, hl = np.cumsum(grad[order])[last], np.cumsum(hess[order])[last]
        gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float((_tops(values[last[k]], bits) + values[last[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], 0.0, _grow(x[low], grad[low], hess[low], depth - 1, rate, ridge, bits), _grow(x[~low], grad[~low], hess[~low], depth - 1, rate, ridge, bits))


@dataclass
class Boosted:
    """Trees, base score, and for each generator the least score that selects (None: nothing)."""

    trees: list[Tree]
    bias: float
    least: dict[str, float | None]

    def sql(self) -> str:
        """SQL for the score of candidate ``x``."""
        return " + ".join([f"{self.bias!r}D", *(f"({t.sql()})" for t in self.trees)])


#: Examples of formats that the base patterns leave out; (generator, text before, text, text after, wanted).
_TAUGHT = [
    *[("number", b, m, a, 1.0) for b in ("tel ", "phone: ", "Fax ", "call me: ") for m in ("(030) 901820-44", "017-555-7713", "017 555 7713", "0049 30 901820") for a in (" ", ", ", "\n")],
    *[("token", b, m, a, 1.0) for b in ('token = "', "secret: ", "api_key=", "password = '") for m in ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "sk-9f8A7c6E5d4B3a2F1e0D", "A1b2C3d4E5f6G7h8") for a in ('" ', " ", "\n")],
    *[("mail", b, m, a, 1.0) for b in ("mail ", "<", " an: ") for m in ("jörg.müller@mail8.example.com", "a.b@postfach.de") for a in (" ", ">", ".")],
    *[("number", b, m, a, 0.0) for b in ("in ", "page ", " von ") for m in ("2019-2020 100", "1000000", "12 345 678") for a in (" ", ".", " euro")],
    *[("token", b, m, a, 0.0) for b in (" the ", "/", "see ") for m in ("well-known-2nd-edition", "chapter_12_section_4", "a/b/c/2020/index") for a in (" ", ".", ", ")],
    *[("mail", b, m, a, 0.0) for b in (" ", "x ") for m in ("@", "a@b", "5@3") for a in (" ", ".")],
    *[("dotted", b, m, a, 0.0) for b in ("version ", "section ", " v") for m in ("1.2.3.4.5", "12.300.400.500", "10:20:30:40") for a in (" ", ".")],
]


#: The fixed examples together weigh this share of the candidates, so that they count alike however long a table is.
_TAUGHT_SHARE = 0.04


def vectors_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """``g, f, y, free, n``: how many candidates of all documents have these features, label and clearness of base spans."""
    sample = documents.select(F.col(f"`{text}`").alias("text"))
    marked = candidates(base_spans(sample)).select(F.expr(f"""explode(transform(_cand, x -> struct(x.g, x.f,
      {_meets('x', 'y.s < x.e AND x.s < y.e AND (y.e - y.s) * 2 > x.e - x.s')} AS base,
      NOT {_meets('x')} AS free,
      x.f[{_SEEN.index('assigned')}] + x.f[{_SEEN.index('quoted')}] > 0 AND x.f[{_SEEN.index('named')}] > 0 AS given))) AS c""")).select("c.*")
    wanted = (F.col("base") | ((F.col("g") == "token") & F.col("given"))).cast("double")
    seen = F.array(*[F.lit(0.0) if name in _HIDDEN else F.col("f")[j] for j, name in enumerate(_SEEN)])
    return marked.groupBy("g", seen.alias("f"), wanted.alias("y"), "free").agg(F.count("*").alias("n"))


def fit(documents: DataFrame, text: str = "text", trees: int = 40, depth: int = 3, precision: float = 0.95, vectors: int = 100_000) -> Boosted:
    """Fit on the candidates of all documents, each counted.

    Positives are candidates that a base span covers, tokens that an assignment to a name such as ``token``
    introduces, and fixed examples of further formats; any other candidate is a negative.  As the assignment makes
    labels, the model does not see it: it learns formats and the rest of the context.  Two thirds of the candidates
    train the trees.  The rest sets the thresholds, by those candidates alone that can be added, being clear of base
    spans: each generator gets the least score at which at least ``precision`` of them are positive, or none.

    Candidates of the same features are one vector with their number, so the driver sees as many rows as there are
    formats.  If these are more than ``vectors``, counts of characters keep 4, else 3, 2 or 1 leading bits; all
    candidates still count.  The fit does not depend on partitions.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    whole = table = scratch.keep(vectors_of(documents, text))
    for bits in (EXACT, 4, 3, 2, 1):
        if bits < EXACT:
            shorter = F.expr(f"transform(f, v -> {_rounded('v', bits)})")
            table = whole.groupBy("g", shorter.alias("f"), "y", "free").agg(F.sum("n").alias("n"))
        if table.count() <= vectors:
            break
    found = table.select("g", "f", "y", "free", "n").toArrow().combine_chunks()
    scratch.drop(whole)
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {quoted(b)}, {quoted(m)}, {quoted(a)})" for i, (_, b, m, a, _) in enumerate(_TAUGHT))
    features = ", ".join(_rounded(f"double({x})", bits) for x in FEATURES.values())
    taught = spark.sql(f"SELECT i, array({features}) AS f FROM (SELECT i, struct(p, m, n) AS x FROM VALUES {values} AS t(i, p, m, n))").collect()
    names = list(_GENERATORS)
    g = np.append(pc.index_in(found.column(0), pa.array(names)).to_numpy(), [names.index(_TAUGHT[r["i"]][0]) for r in taught])
    flat = [pc.list_flatten(found.column(1)).to_numpy().reshape(-1, len(FEATURES)), np.array([r["f"] for r in taught], float)]
    x = np.concatenate(flat)
    x[:, [_SEEN.index(name) for name in _HIDDEN]] = 0
    y = np.append(found.column(2).to_numpy(), [_TAUGHT[r["i"]][4] for r in taught])
    free = np.append(found.column(3).to_numpy(zero_copy_only=False).astype(bool), np.ones(len(taught), bool))
    n = found.column(4).to_numpy().astype(np.int64)
    n = np.append(n, np.full(len(taught), max(1, round(_TAUGHT_SHARE * int(n.sum()) / len(taught)))))
    order = np.lexsort((free, y, *x.T, g))
    g, x, y, free, n = g[order], x[order], y[order], free[order], n[order]
    # Every third candidate in this order is held out.
    after = n.cumsum()
    held = after // 3 - (after - n) // 3
    kept = n - held
    mean = min(max(float((y * kept).sum() / kept.sum()), 1e-3), 1 - 1e-3)
    model = Boosted([], float(np.log(mean / (1 - mean))), {})
    raw = np.full(len(y), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, (y - p) * kept, p * (1 - p) * kept, depth, 0.3, bits=bits)
        model.trees.append(tree)
        raw += tree.predict(x)
    for name in _GENERATORS:
        own = free & (held > 0) & (g == names.index(name))
        down = np.argsort(-raw[own], kind="stable")
        s, many, hits = raw[own][down], held[own][down].cumsum(), (y * held)[own][down].cumsum()
        last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)
        good = np.flatnonzero(last & (hits >= precision * many))
        model.least[name] = float(s[good[-1]]) if len(good) else None
    return model


def detect(documents: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """All rows and columns with ``pii_base`` and ``pii_spans``: arrays of struct(start, rank, end, kind).

    Base spans always stay; a candidate is added if its score reaches its generator's threshold and no base span
    overlaps it.  Added spans may overlap each other.  Offsets are code points, end exclusive.  Row by row, whole
    texts, no shuffle, no Python.  Null or empty text: no spans.  Texts without digits and ``@`` are not searched.
    Repeated rows are searched alike; empty tables give no rows.  Columns may have any names but the two added ones.
    """
    if taken := {"pii_base", "pii_spans"} & set(documents.columns):
        raise ValueError(f"columns {sorted(taken)} are used by this operator")
    frame = candidates(base_spans(documents, text))
    chosen = " OR ".join(f"(x.g = '{g}' AND {model.sql()} >= {least!r}D)" for g, least in model.least.items() if least is not None) or "false"
    chosen = f"({chosen}) AND NOT {_meets('x')}"
    kind = " ".join(f"WHEN '{g}' THEN '{k}'" for g, k in _ADDED.items())
    rank = " ".join(f"WHEN '{g}' THEN {_RANK[k]}" for g, k in _ADDED.items())
    shaped = "struct(x.s AS start, x.r AS rank, x.e AS end, x.k AS kind)"
    frame = frame.withColumn("_more", F.expr(f"transform(filter(_cand, x -> {chosen}), x -> struct(x.s AS s, CASE x.g {rank} END AS r, x.e AS e, CASE x.g {kind} END AS k))"))
    frame = frame.withColumn("pii_base", F.expr(f"transform(_base, x -> {shaped})"))
    frame = frame.withColumn("pii_spans", F.expr(f"array_sort(concat(pii_base, transform(_more, x -> {shaped})))"))
    return frame.select("_in.*", "pii_base", "pii_spans")


def joined(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def redact(documents: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """Documents with every span replaced by ``[KIND]``; spans that overlap become one, named by the first.

    A null text stays null, a text without spans as it is; repeated rows are cleaned alike, empty tables give no rows
    and columns may have any names.  Texts are read whole, in memory one at a time.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    found = detect(documents.select(whole.alias("_row"), F.col(f"`{text}`").alias("_text")), model, "_text")
    found = found.withColumn("_ends", F.expr(_running("transform(pii_spans, x -> x.end)", "greatest(a, y)")))
    found = found.withColumn("_firsts", F.expr("filter(if(size(pii_spans) = 0, cast(array() AS array<int>), sequence(0, size(pii_spans) - 1)), i -> i = 0 OR pii_spans[i].start >= _ends[i - 1])"))
    found = found.withColumn("_merged", F.expr("""transform(_firsts, (i, k) -> struct(
      pii_spans[i].start AS start, _ends[if(k + 1 < size(_firsts), _firsts[k + 1], size(pii_spans)) - 1] AS end, pii_spans[i].kind AS kind))"""))
    found = found.withColumn("_cells", F.expr(f"if(size(_merged) = 0, cast(array() AS array<string>), {_cells('_text')})"))
    between = _piece("_cells", "if(i = 0, 0L, _merged[i - 1].end)", "x.start")
    clean = F.expr(f"""if(size(_merged) = 0, _text, concat(
      array_join(transform(_merged, (x, i) -> concat({between}, '[', upper(x.kind), ']')), ''),
      {_piece('_cells', 'element_at(_merged, -1).end', 'length(_text)')}))""")
    out = found.withColumn("_clean", clean)
    return out.select(*[F.col("_clean").alias(c) if c == text else F.col(f"_row.`{c}`") for c in documents.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(docs))
    count = lambda kind: F.expr(f"cast(size(filter(pii_base, x -> x.kind = '{kind}')) AS long)").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
