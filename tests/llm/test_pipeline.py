import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import columns

pipeline = pytest.importorskip("corpus_pipeline")


def plant(tmp_path, spark):
    """Documents of which it's known what each stage has to do with them."""
    r = random.Random(9)
    vocabulary = {"en": "the of and house river tree stone light water road hand word green over under night".split(), "fr": "le la des maison rivière arbre pierre été eau route main mot vert très sous nuit où".split()}
    prose = lambda lang, n: " ".join(r.choice(vocabulary[lang]) + r.choice(["", "", "x" + str(r.randrange(400))]) for _ in range(n))
    items = [(i, prose("en", 20)) for i in range(5)]
    rows, labels, fate = [], [], {}

    def add(text, what, lang="en", toxic=0):
        i = len(rows)
        rows.append((i, text, lang, "s", len(text or "")))
        labels.append((i, 1, toxic))
        fate[i] = what
        return i

    for k in range(300):
        lang = ["en", "fr"][k % 2]
        add(prose(lang, 60), "kept", lang)
    for _ in range(100):
        ws = prose("en", 60).split()
        for _ in range(4):
            ws[r.randrange(60)] = r.choice(["idiot", "moron", "scum"])
        add(" ".join(ws), "toxic", toxic=1)
    for k in range(20):
        ws = rows[k][1].split()
        ws[30] = "changed"
        add(" ".join(ws).upper() if k % 2 else " ".join(ws), "copy", rows[k][2])
    for k in range(10):
        add(prose("en", 30) + " " + items[k % 5][1] + " " + prose("en", 30), "leak")
    add(None, "unknown")
    add("", "unknown")
    add("123 !! 456", "unknown")
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, fate


def test_every_stage_does_its_work(tmp_path, spark):
    d, fate = plant(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, gone = docs.columns, ["unknown", "toxic", "copy", "leak"]
    before = set(fate)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, d)
        path = f"{d}/{k}-{name}.parquet"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        after = {x.doc_id for x in out.select("doc_id").collect()}
        if k < 4:
            assert out.columns == columns
            lost = {i: fate[i] for i in before - after}
            assert set(lost.values()) <= {gone[k]} | ({"kept"} if gone[k] == "copy" else set()), (name, lost)
            if gone[k] == "copy":
                # one of each pair stays, whichever
                assert len(lost) == 20
            else:
                assert not [i for i in after if fate[i] == gone[k]], name
        docs, before = out, after
    assert docs.where("not round_trip").count() == 0
    ran = pipeline.run(spark, d)
    assert sorted(x.doc_id for x in ran.collect()) == sorted(before)
    assert [name for name, _ in pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "sentencepiece"]
    assert all(re.fullmatch(r"\w+", n) for n, _ in pipeline.STAGES)


CLASHING = "rid long, rid_ long, label string, key string, weight string, score string, n_words string, segment string, token string"


def odd(spark, base):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    rows = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 !! 45", None, None, 8), (None, "the house and the river and the trees", "en", "s", 38), (9004, "the river and light " * 20000, "en", "s", 1), (9005, "the house and water under the river", "en", "s", 26), (9005, "the house and water under the river", "en", "s", 26)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(spark.read.parquet(f"{base}/documents.parquet"))
    for column in CLASHING.split(", "):
        name, kind = column.split()
        out = out.withColumn(name, F.lit("7").cast(kind))
    return out


def test_stages_take_odd_tables(tmp_path, spark):
    d, _ = plant(tmp_path, spark)
    docs = odd(spark, d)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        rows = [r for r in out.collect() if r.doc_id is None or r.doc_id > 9000]
        if name == "sentencepiece":
            assert len(rows) == 7
            continue
        assert out.columns == docs.columns, name
        ids = sorted(str(r.doc_id) for r in rows)
        assert all(r.rid == 7 and r.key == "7" for r in rows)
        if name == "language":
            assert ids == ["9004", "9005", "9005", "None"]
        elif name in ("toxicity", "decontamination"):
            assert len(rows) == 7
        else:  # texts without words or digits are copies of one another and of planted ones; of equal rows one stays
            assert ids == ["9003", "9004", "9005", "None"]


def test_stages_take_empty_tables(tmp_path, spark):
    d, _ = plant(tmp_path, spark)
    docs = odd(spark, d).where("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0, name


def test_language_stage_rejects_noise(spark):
    r = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = [(10**9 + k, " ".join("".join(chr(r.randrange(97, 123)) for _ in range(7)) for _ in range(60)), None, "junk", 0) for k in range(20)]
    own = docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns), allowMissingColumns=True)
    kept = {x.doc_id for x in pipeline.identify_language(spark, own, "/root/testdata/sf0.01").select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**9]
    lettered = [x.doc_id for x in docs.where("text rlike '[a-zA-Z]'").select("doc_id").collect()]
    assert sum(i in kept for i in lettered) > 0.998 * len(lettered)


def test_stages_move_bounded_batches(tmp_path, spark):
    """Long texts reach the workers in batches of a block's size, not in 10,000 rows at once."""
    d, _ = plant(tmp_path, spark)
    keys = list(columns.BATCHES)
    docs = spark.range(0, 2000, 1, 1).selectExpr("id doc_id", "repeat(concat('word', id, ' '), 1000) text", "'en' lang", "'s' source", "0 n_chars")
    docs.write.parquet(f"{tmp_path}/long.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [sum(len(t) for t in b.column("text").to_pylist())]})

    try:
        pipeline.identify_language(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
        found = spark.read.parquet(f"{tmp_path}/long.parquet").mapInArrow(sizes, "rows long, size long").collect()
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert sum(r.rows for r in found) == 2000
    assert max(r.size for r in found) <= columns.BLOCK_BYTES + 10_000  # and a row


def test_session_keeps_its_own_batches(tmp_path, spark):
    d, _ = plant(tmp_path, spark)
    arrow, parquet = columns.BATCHES
    spark.conf.set(arrow, "1000000")
    try:
        assert columns.small_batches(spark) == [parquet]
        assert spark.conf.get(arrow) == "1000000"
        spark.conf.unset(parquet)
        pipeline.run(spark, d)
        assert spark.conf.get(arrow) == "1000000" and spark.conf.get(parquet, None) is None
    finally:
        for key in columns.BATCHES:
            spark.conf.unset(key)
