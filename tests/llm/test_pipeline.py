import random

from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing


def test_stages_against_plain_versions(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        text = [rnd.choice(words) for _ in range(rnd.randrange(15, 40))]
        toxic = k % 5 == 0
        if toxic:
            text[3] = rnd.choice(["idiot", "moron"])
        rows.append((k, " ".join(text), rnd.choice(["en", "de"]), rnd.choice(["a", "b"]), len(text)))
        labels.append((k, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    rows.append((2000, clean[0][1].upper(), "en", "a", 1))  # an exact copy, the larger id
    rows.append((2001, clean[1][1] + " tail", "en", "a", 1))  # a near copy
    rows.append((2002, None, None, None, None))
    rows.append(rows[7])  # a repeated row
    base = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    after = stages["toxicity"](spark, docs, base)
    assert after.columns == columns
    assert ids(after) == sorted(r[0] for r in rows if r[0] >= 2000 or r[0] % 5)
    then = stages["exact_dedup"](spark, after, base)
    assert then.columns == columns
    kept = [r for r in rows if r[0] >= 2000 or r[0] % 5]
    best = {}
    for r in kept:
        key = (r[1] or "").lower()
        best[key] = max(best.get(key, -1), r[0])
    assert ids(then) == sorted(best.values())
    near = stages["ngram_jaccard_join"](spark, then, base)
    assert near.columns == columns and ids(near) == sorted(set(best.values()) - {2001})
    mixed = stages["mixing"](spark, near, base)
    assert mixed.columns == columns and set(ids(mixed)) <= set(ids(near))
    drawn = mixing.mix(spark, mixing.describe(near, mixing.fit_topics(near)), corpus_pipeline.MIX_TARGETS)
    assert ids(mixed) == ids(drawn.where("kept"))
    packed = stages["packing"](spark, mixed, base)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert sorted(r["doc_id"] for r in tokens) == ids(mixed) and all(r["n"] == r["all"] for r in tokens)
    # where documents are cut depends on the partitions, what is packed does not
    whole = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    assert whole(corpus_pipeline.run(spark, base)) == whole(packed)


def test_edge_cases_go_through_all_stages(spark, tmp_path):
    """Nulls in any column, clashing extra columns, one id with two texts, a very long text, an empty table."""
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(k, text(30), "en", "a", 1) for k in range(60)]
    rows += [(100, rows[0][1], None, None, None), (100, text(40), "en", "a", 1), (101, None, "en", None, 1), (102, "", None, "a", 1), (103, text(150_000), "en", "a", 1), (None, text(30), "en", "a", 1), (104, rows[5][1].upper(), "en", "a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = frame.selectExpr("*", "1 AS kept", "'x' AS component_id", "2 AS tokens", "'s' AS score", "3 AS id", "4 AS text_sha256")
    labels = spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    for name, docs in (("full", clash), ("empty", clash.limit(0))):
        base = f"{tmp_path}/{name}"
        docs.write.parquet(f"{base}/documents.parquet")
        labels.write.parquet(f"{base}/labels.parquet")
        docs = spark.read.parquet(f"{base}/documents.parquet")
        then = docs
        for stage, run in corpus_pipeline.STAGES[:-1]:
            then = run(spark, then, base)
            assert then.columns == docs.columns, stage
            if stage == "exact_dedup" and name == "full":
                left = [(r["doc_id"], r["text"]) for r in then.collect()]
                assert (100, rows[61][1]) in left and (0, rows[0][1]) not in left and (5, rows[5][1]) not in left
                assert (100, rows[60][1]) in left and (102, "") in left and (101, None) not in left and len([1 for i, _ in left if i is None]) == 1
        assert corpus_pipeline.run(spark, base).count() >= 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
