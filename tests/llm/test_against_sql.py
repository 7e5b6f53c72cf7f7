"""Operators that SQL can express, on stored tables and on planted hard cases."""

import random

import pytest
from oracle import compare, rows_by_sql, rows_of

from leafmill.llm import catalogue, decontaminate, embeddings, neardup, quotes, substrings, urlfilter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE[name], SF) == ""


def stored(spark, folder, **tables):
    for name, frame in tables.items():
        frame.coalesce(1).write.parquet(str(folder / f"{name}.dir"))
        part = next((folder / f"{name}.dir").glob("*.parquet"))
        part.rename(folder / f"{name}.parquet")
    return str(folder)


def texts(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    return [[rng.choice(vocabulary) for _ in range(rng.randint(1, words))] for _ in range(n)]


def hard_documents():
    """Copies, edited copies, chains of near copies, short texts, repeats of one word, nulls and empty texts."""
    rng = random.Random(3)
    base = texts(1, 40, 200)
    rows = [" ".join(b) for b in base]
    for b in base[:12]:
        now = list(b)
        for _ in range(6):
            now[rng.randrange(len(now))] = f"e{rng.random():.6f}"
            rows.append(" ".join(now))
    rows += rows[:10] + ["a", "A", "a b", "x x x x x x", "x " * 300, "X " * 200, None, "", " \n\t", "ß " * 60, "é\u00a0f g h i j"]
    return [(i * 3 + 1, t, "extra") for i, t in enumerate(rows)]


def test_near_duplicates_on_hard_documents(spark, tmp_path):
    frame = spark.createDataFrame(hard_documents(), "doc_id long, text string, bucket string")
    folder = stored(spark, tmp_path, documents=frame)
    assert compare(neardup.op2_neardup(spark, folder), neardup.OP2_SQL, folder) == ""


def test_pairs_missed_by_stars_are_found(spark, tmp_path):
    """With no star rounds at all, everything is left to the exact pass."""
    frame = spark.createDataFrame(hard_documents(), "doc_id long, text string, bucket string")
    folder = stored(spark, tmp_path, documents=frame)
    got = rows_of(neardup.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), shingle=4, star_rounds=0))
    assert got == rows_by_sql(neardup.OP2_SQL, folder)[1]


def test_repeats_on_hard_documents(spark, tmp_path):
    frame = spark.createDataFrame(hard_documents(), "doc_id long, text string, ref string")
    folder = stored(spark, tmp_path, documents=frame)
    assert compare(substrings.op5_substrings(spark, folder), substrings.OP5_SQL, folder) == ""


def test_decontamination_on_hard_documents_in_many_blocks(spark, tmp_path):
    base = [" ".join(t) for t in texts(5, 30, 40)]
    items = [(i, t) for i, t in enumerate(base)] + [(90, "one"), (91, "Two-Words"), (92, ""), (93, None), (7, base[0]), (94, "x " * 30)]
    docs = [(i, f"before, {t.upper()}! after") for i, t in enumerate(base)] + [(100, "one two words"), (101, "x" * 5), (102, "X-" * 40), (103, None), (104, "")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    folder = stored(spark, tmp_path, documents=documents, benchmark=benchmark)
    assert compare(decontaminate.op1_decontaminate(spark, folder), decontaminate.OP1_SQL, folder) == ""
    once = decontaminate.decontaminate(documents, benchmark)
    many = decontaminate.decontaminate(documents, benchmark, block_bytes=400)
    assert rows_of(once) == rows_of(many)


def test_url_rules_and_hard_urls(spark, tmp_path):
    urls = ["http://NET/", "https://a.b.example.net/en/x?y", "http://example.net/en", "http://badexample.net/en/", "http://x.example.com/de/#f", "http://fr.org/fr/", "http://org/fr/", None, "", "no-scheme/", "http://", "http://net", "http://a.net?x/", "x://y://z/"]
    folder = stored(spark, tmp_path, pages=spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert compare(urlfilter.op9_urlfilter(spark, folder), urlfilter.OP9_SQL, folder) == ""


def test_nested_quotes(spark, tmp_path):
    rows = [
        (1, 0, "user", "Hello there\nhow are you"),
        (1, 1, "assistant", "On Monday user wrote:\n> Hello  there\n> how are you\n\nFine"),
        (1, 2, "user", "> > hello there\n> fine\nGood"),
        (1, 3, "assistant", "> good\n>> Fine\nBye"),
        (1, 4, "user", "> never said\nx"),
        (1, 5, "user", "> Hello there how\n> are you\nagain"),
        (1, 6, "user", ">again\n"),
        (2, 0, "user", None),
        (2, 1, "user", "> hello there"),
        (3, 0, "user", "The quick brown fox jumps\nover the dog. Then it sleeps.\n\n \nEnd"),
        (3, 1, "a", "> the quick brown fox\n> jumps over the dog.\n\n \t\n yes \n\n"),
        (3, 2, "a", "> then it sleeps.\n> end\n"),
        (3, 3, "a", "> yes\n> end\n"),
    ]
    folder = stored(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = quotes.op8_quotes(spark, folder)
    assert compare(got, quotes.OP8_SQL, folder) == ""
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert [by[1, t]["parent_turn"] for t in range(7)] == [None, 0, 1, 2, None, 0, 5]
    assert [by[1, t]["position"] for t in range(7)] == [0, 1, 2, 3, 0, 4, 5] and by[1, 4]["thread_turn"] == 4
    assert by[1, 1]["said"] == "Fine" and by[1, 2]["quote_depth"] == 2 and by[2, 1]["n_linked"] == 0
    assert by[3, 1]["parent_turn"] == 0 and by[3, 2]["parent_turn"] == 0 and by[3, 1]["said"] == " yes "


def test_threads_of_many_shapes(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for conv in range(6):
        rows += [(conv, 0, "u", f"m{conv} 0")]
        for turn in range(1, 40):
            parents = rng.sample(range(turn), k=min(turn, rng.randint(0, 2)))
            rows.append((conv, turn, "u", "\n".join([*[f"> m{conv} {p}" for p in parents], f"m{conv} {turn}"])))
    folder = stored(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert compare(quotes.op8_quotes(spark, folder), quotes.OP8_SQL, folder) == ""


def test_vectors_with_faults_copies_and_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    unit = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = list(unit)
    for v in unit[:6]:
        rows += [[x + rng.gauss(0, 0.1) for x in v] for _ in range(20)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 16, None, [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    folder = stored(spark, tmp_path, embeddings=table)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    want = rows_by_sql(embeddings.OP10_SQL, folder)[1]
    got = rows_of(embeddings.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), recall=0.99999))
    assert got == want


def test_recall_of_vectors_at_the_threshold(spark):
    """Pairs at a cosine of just over 0.9 among unrelated vectors: at least 0.9 of them are found."""
    import numpy as np

    rng = np.random.default_rng(8)
    a = embeddings.unit(rng.standard_normal((1500, 64)))
    b = rng.standard_normal((1500, 64))
    b = embeddings.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    both = np.concatenate([a, 0.905 * a + np.sqrt(1 - 0.905**2) * b])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(both.tolist())], "vec_id long, embedding array<double>")
    found = embeddings.near_vectors(table).where("n_links > 0").count()
    assert found >= 0.9 * 3000
