import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_over_planted_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    rng = random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    word = lambda: "".join(rng.choice(["an", "th", "er", "re", "in", "on"]) for _ in range(rng.randint(2, 4)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    passage, base = prose(70), prose(180)
    edited = base.split()
    edited[50] = "other"
    planted = {5000: base, 5001: base, 5002: " ".join(edited), 5003: f"{prose(60)} {passage} {prose(60)}", 5004: f"{prose(60)} {passage} {prose(60)}", 5005: f"{prose(60)}\n{item}\n{prose(60)}", 5006: prose(150)}
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted.items()], COLUMNS)
    current, kept = docs.unionByName(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        current = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in current.select("doc_id").collect()}
        if name != "packing":
            assert current.columns == docs.columns
        if name == "suffix_array_dedup":
            texts = {r.doc_id: (r.text, r.n_chars) for r in current.where("doc_id >= 5000").collect()}
    assert {5000, 5003, 5004, 5005, 5006} <= kept["quality_classifier"]
    assert kept["simhash_near_dedup"] & set(planted) == {5000, 5003, 5004, 5005, 5006}
    assert texts[5006][0] == planted[5006] and texts[5000][0] == base and all(passage[10:-10] not in t for t, _ in texts.values()) and all(n == len(t) for t, n in texts.values())
    assert kept["benchmark_decontamination"] & set(planted) == {5000, 5003, 5004, 5006}
    assert kept["packing"] == kept["benchmark_decontamination"]


def test_run_over_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
