"""The pipeline's stages on stored and planted documents."""

import corpus_pipeline
from oracle import rows_of
from pyspark.sql import functions as F

from leafmill.llm import tables
from leafmill.llm.tables import load, trim

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pack_what_is_left(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[2] < kept[1] and kept[3] < kept[2] and kept[4] == kept[3]
    packed = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in packed.where("piece = 0").collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_decisions_of_stages(spark):
    item = load(spark, SF, "benchmark").first()["text"]
    clean = " ".join(f"the {w}" for w in ("house", "tree", "river", "cloud", "stone", "field"))
    rows = [(1, clean, "en"), (2, clean, "en"), (3, "123", "en"), (4, None, "en"), (5, f"and then {item}", "en"), (6, "write to a.b@c.de about the garden wall and gate", "en"), (6, "write to a.b@c.de about the garden wall and gate", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    stage = dict(corpus_pipeline.STAGES)
    assert sorted(r["doc_id"] for r in stage["language"](spark, docs, SF).collect()) == [1, 2, 5, 6, 6]
    assert sorted(r["doc_id"] for r in stage["near_duplicates"](spark, docs, SF).collect()) == [1, 3, 4, 5, 6]
    assert sorted(r["doc_id"] for r in stage["decontaminate"](spark, docs, SF).collect()) == [1, 2, 3, 4, 6, 6]
    redacted = {r["doc_id"]: r for r in stage["personal_data"](spark, docs, SF).collect()}
    assert redacted[6]["text"].startswith("write to [EMAIL] about") and redacted[6]["n_chars"] == len(redacted[6]["text"])
    assert redacted[1]["text"] == clean and rows_of(stage["personal_data"](spark, docs, SF))


def test_near_duplicates_let_the_driver_collect_its_garbage(spark):
    """The driver's heap is collected in full while the steps run, not only when it is full."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"), "")
    assert full() > before + 3


def test_every_stage_lets_the_driver_collect_its_garbage_first(spark):
    """Each stage begins with a full collection, so its predecessors' plans do not stay in the driver."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "house tree river cloud stone field", "en")], "doc_id long, text string, lang string")
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, SF)
        assert full() > before, name


def test_free_gives_native_memory_back(spark, monkeypatch):
    """What the JVM freed outside its heap is handed back; this JVM has the command for it."""
    asked = []
    monkeypatch.setattr(tables, "trim", lambda session: asked.append(trim(session)))
    tables.free(spark)
    assert asked == [True]
