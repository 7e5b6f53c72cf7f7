"""Operators that SQL cannot express: exact round trips, brute force and held-out accuracy."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import language, packing, pii, toxicity
from leafmill.llm.tables import load

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        odd = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in odd) % 10 == 0
    return True


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


HARD = [
    "a@b.com_x@y.org, a@b a@.b é@x.de 😀 c.d@e-f.co.uk@g.h",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.0.0.1 1.2.3 99999999999999999999.1.1.1",
    "4041 8949 7460 8795, 4041894974608795 40418949746087951 4-0-4-1-8-9-4-9-7-4-6-0-8-7-9-5 12",
    "+1 (017) 555-7713 +1 +12 +123456789 +1234567890123456 ++49 30 901820-44.",
    "9" * 3000 + " " + "a" * 5000 + " " + "1 " * 2000,
    "", None, "\n", "x" * 10,
]


def test_base_spans_equal_brute_force(spark):
    stored = [(r["doc_id"], r["text"]) for r in load(spark, SF, "documents").collect()]
    rows = stored + [(10_000 + i, t) for i, t in enumerate(HARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    model = pii.fit(docs)
    out = pii.detect(docs, model).select("doc_id", pii.joined("pii_base").alias("base"), pii.joined("pii_spans").alias("all"), "spans").collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r["base"] == base_spans(texts[r["doc_id"]])
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["all"].split(",")))


def test_trees_in_sql_score_as_in_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (300, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 4).astype(float)
    tree = pii._grow(x, y - 0.5, np.full(300, 0.25), 3, 0.3)
    frame = spark.createDataFrame([(v,) for v in x.tolist()], "f array<double>")
    got = [r["s"] for r in frame.select(F.expr(f"struct(f AS f) AS x")).select(F.expr(tree.sql()).alias("s")).collect()]
    assert np.allclose(got, tree.predict(x))


def test_redaction_replaces_every_base_span(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de or +1 (017) 555-7713", 3), (2, None, 4), (3, "clean", 5)], "doc_id long, text string, kind int")
    model = pii.Boosted([], -9.0, {})
    got = {r["doc_id"]: r for r in pii.redact(docs, model).collect()}
    assert got[1]["text"] == "mail [EMAIL] or [PHONE]" and got[2]["text"] is None and got[3]["text"] == "clean" and got[3]["kind"] == 5


def test_redaction_of_long_texts_and_wide_characters(spark):
    """Against the same replacement in Python, over cells of 256 characters and characters beyond 16 bits."""
    rng = np.random.default_rng(3)
    texts = []
    for n in (3, 40, 900):
        parts = [str(x) for x in rng.choice(["😀", "a.b@c.de", "1.2.3.4", "word", "é" * 300, "+1 (017) 555-7713", "\n"], n)]
        texts.append(" ".join(parts))
    out = pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pii.Boosted([], -9.0, {})).orderBy("doc_id").collect()
    for text, r in zip(texts, out, strict=True):
        want, at = "", 0
        for span in filter(None, base_spans(text).split(",")):
            kind, a, b = span.split(":")
            want = want if int(a) < at else f"{want}{text[at : int(a)]}[{kind.upper()}]"
            at = max(at, int(b))
        assert r["text"] == want + text[at:]


def test_added_spans_of_planted_documents(spark):
    """Secrets and telephone numbers that the base leaves out, among years, prices and words with numbers."""
    rng = np.random.default_rng(4)
    secret = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows, wanted = [], {}
    for i in range(400):
        filler = " ".join(rng.choice(["house", "1999", "12 345", "chapter_12_section", "river", "2019-2020"], 30))
        if i % 4 == 0:
            own = secret()
            rows.append((i, f'{filler} token = "{own}" {filler}'))
            wanted[i] = f"secret:{len(filler) + 10}:{len(filler) + 50}"
        else:
            rows.append((i, filler))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    assert model.least == pii.fit(docs.repartition(7)).least
    got = {r["doc_id"]: r["spans"] for r in pii.detect(docs, model).select("doc_id", pii.joined("pii_spans").alias("spans")).collect()}
    hits = sum(wanted[i] in got[i].split(",") for i in wanted)
    wrong = sum(len([x for x in s.split(",") if x and x != wanted.get(i)]) for i, s in got.items())
    assert hits >= 0.9 * len(wanted) and wrong <= 0.1 * max(1, hits)


def test_language_accuracy_on_held_out_documents(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = language.op4_language(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(out) > 100
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in out) / len(out) >= 0.98


def test_hashes_tell_orders_of_words_apart():
    import itertools

    from leafmill.llm import words as W

    pool = W.mix(np.arange(1, 4, dtype=np.uint64))
    rows = list(itertools.product(range(3), repeat=7))
    assert len({W.combine(pool[list(r)], 7)[0] for r in rows}) == len(rows)


def by_words(train, texts, orders=4):
    """Word-first backoff in plain Python: (language, posterior) of each text."""
    import math
    from collections import Counter

    words = lambda text: "".join(c if c.isalpha() else " " for c in text.lower()).split()

    def parts(word, k):
        marked = f"<{word}>" if k > 1 else word
        return [word] if k == 0 else [marked[i : i + k] for i in range(len(marked) - k + 1)]

    langs = sorted({lang for lang, _ in train})
    counts = [{lang: Counter() for lang in langs} for _ in range(orders + 1)]
    for lang, text in train:
        for word in words(text):
            for k in range(orders + 1):
                counts[k][lang].update(parts(word, k))
    names = [set().union(*c.values()) for c in counts]
    log = lambda k, x, lang: math.log((counts[k][lang][x] + 0.5) / (sum(counts[k][lang].values()) + 0.5 * len(names[k])))
    out = []
    for text in texts:
        total = dict.fromkeys(langs, 0.0)
        for word in words(text or ""):
            for k in (0, *range(orders, 0, -1)):
                known = [x for x in parts(word, k) if x in names[k]]
                if known:
                    for lang in langs:
                        total[lang] += sum(log(k, x, lang) for x in known) / len(known)
                    break
        best = max(langs, key=lambda lang: total[lang])
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values())) if words(text or "") else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark, monkeypatch):
    docs = [r for r in load(spark, SF, "documents").collect() if r["text"] is not None]
    train = [(r["lang"], r["text"]) for r in docs[:60] if r["lang"]]
    texts = [r["text"] for r in docs[60:110]] + ["baumhaus ǅungla ΣΑΣ İx", "x" * 70 + " " + "the " * 3, "123 !?", "²³ Ⅷ", "", None, "日本語 the"]
    want = by_words(train, texts)
    model = language.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, lang string, text string"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (language.CHUNK, 40):
        batch = rows.orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
        monkeypatch.setattr(language, "CHUNK", size)
        got = pa.Table.from_batches(language._predict([batch], model, 1))
        assert got.column("lang_pred").to_pylist() == [w[0] for w in want]
        assert np.allclose(got.column("lang_score").to_numpy(), [w[1] for w in want])


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "en", "the house the tree"), (2, "de", "das haus der baum"), (3, None, "zz"), (4, "en", None), (None, "fr", "le la")], "doc_id long, lang string, text string")
    model = language.fit(train)
    assert model.languages == ["de", "en"]
    rows = spark.createDataFrame([(1, "the", "x"), (2, "baumhaus", "y"), (3, None, None), (4, "", "z"), (5, "123 !?", "z"), (6, "the tree " * 300_000, "z")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(rows, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["lang_score"] <= 1 for r in got.values()) and got[1]["lang"] == "x"
    assert language.identify(rows, language.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_toxicity_chain_on_planted_documents(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        text = list(rng.choice(words, 40))
        toxic = int(i % 5 == 0)
        if toxic:
            text[5] = "vile" + rng.choice(["a", "b", "c", "ness", "ly"])
            text[25] = "rotten"
        rows.append((i, " ".join(text), 1 - toxic, toxic))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    chain = toxicity.fit(labelled, labelled, {"low_quality": (F.col("quality") == 0).cast("int"), "toxic": F.col("toxic")})
    assert chain[1].earlier.shape == (1,)
    fresh = spark.createDataFrame([(1, "so VILEish and rotten"), (2, " ".join(words[:50])), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.classify(fresh, chain).collect()}
    assert got[1]["is_toxic"] and not got[2]["is_toxic"] and not got[3]["is_toxic"] and got[4]["p_toxic"] == 0


def test_toxicity_of_stored_documents(spark):
    out = {r["doc_id"]: r["toxic"] for r in toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = load(spark, "/root/testdata/sf0.1", "labels").collect()
    hits = sum(out[r["doc_id"]] for r in labels if r["toxic"])
    wrong = sum(out[r["doc_id"]] for r in labels if not r["toxic"])
    assert hits >= 0.85 * sum(r["toxic"] for r in labels) and wrong <= 0.01 * len(labels)


def test_words_encode_as_whole_texts(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, encoder = Tokenizer.from_file(path), packing.WordEncoder(path, known=500)
    texts = ["", " ", "it's  <|endoftext|>x", "ÀÉß İΣσ ﬁ 3.14 --", "a\u00a0b\u2028c\x1cd", "e\u0301 \u0301x", "don't 'll\tX_y", "日本語 text 😀!"]
    texts += [r["text"] or "" for r in load(spark, SF, "documents").limit(60).collect()]
    for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def check_packing(spark, docs, capacity=4096):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs, packing.tokenizer_path(), capacity).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(w[3] for w in want)


def test_packing_is_exact_and_tight(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    sequences, tokens = check_packing(spark, docs)
    assert sequences <= -(-tokens // 4096) + 1


def test_packing_edges(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "a b", 1), (2, "x " * 40, 2), (2, "x " * 40, 2), (3, "x " * 15, 3)]
    check_packing(spark, spark.createDataFrame(rows, "doc_id long, text string, length int"), 16)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("counts", [{4: 3, 6: 3}, {3: 1, 5: 1, 2: 1}, {10: 7}, {1: 95}, {7: 4, 4: 2, 2: 9}, {6: 1000, 3: 999, 1: 5}])
def test_plan_uses_every_piece_once(counts):
    plan = packing.make_plan(counts, 10)
    seen = {}
    for length, rank, n in zip(plan.length, plan.rank, plan.count, strict=True):
        seen.setdefault(length, []).extend(range(rank, rank + n))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    fill = np.zeros(plan.sequences, int)
    for length, n, s in zip(plan.length, plan.count, plan.sequence, strict=True):
        fill[s : s + n] += length
    assert fill.max() <= 10


def test_exact_complements_come_first():
    plan = packing.make_plan({7: 1, 5: 2, 3: 1, 4: 1, 1: 1, 6: 1, 2: 1}, 10)
    assert plan.sequences == 4  # 33 tokens: 7+3, 6+4, 5+5, 2+1


def test_sum_index_equals_brute_force():
    """Whatever is used up in between, a gap is filled if and only if one, two or three available lengths fill it."""
    import itertools

    rng = np.random.default_rng(6)
    left = rng.integers(0, 3, 31)
    left[0] = 0
    index = packing.SumIndex(left)
    while left.sum():
        gap, beside = int(rng.integers(1, 31)), int(rng.choice(np.flatnonzero(left)))
        free = left.copy()
        free[beside] -= 1
        pool = np.repeat(np.arange(31), free).tolist()
        want = {sum(c) for k in (1, 2, 3) for c in itertools.combinations(pool, k)}
        got = index.fill(gap, (beside,))
        assert (got is not None) == (gap in want) and (got is None or sum(got) == gap)
        for part in (beside, *(got or ())):
            left[part] -= 1
        assert left.min() >= 0
