import corpus_pipeline as cp
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.decontaminate import matches

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage's decisions hold on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(cp.STAGES)
    kept = cp.stage(steps["quality_classifier"](spark, docs, SF))
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs, "doc_id").select("doc_id")
    assert kept.join(bad, "doc_id", "left_semi").count() > 0.9 * bad.count()  # clean ones stay

    lines = cp.stage(steps["line_dedup"](spark, kept, SF))
    assert lines.columns == columns
    assert 0.9 * kept.count() < lines.count() <= kept.count()

    once = cp.stage(steps["near_dedup"](spark, lines, SF))
    assert once.columns == columns and once.count() == near_duplicates(lines).where("kept").count()
    assert near_duplicates(once).where("not kept").count() == 0

    clean = cp.stage(steps["benchmark_decontamination"](spark, once, SF))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {r.id for r in matches(once, bench).collect()}
    assert clean.columns == columns and matches(clean, bench).count() == 0
    assert clean.count() == once.count() - len(found)

    mixed = steps["mixing"](spark, clean, SF).collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean.collect()}
    assert len({(r.doc_id, r.copy) for r in mixed}) == len(mixed) and max(r.copy for r in mixed) <= 2


def test_near_dedup_stage_keeps_one_of_each(spark):
    t = "one two three four five six seven eight"
    rows = [(7, t), (7, t), (7, "quite another text of seven words"), (9, t), (None, t), (None, "alone here"), (None, "alone here"),
            (3, None), (3, None), (4, "")]
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, "
                                                                       "source string, n_chars long")
    got = sorted((str(r.doc_id), str(r.text)) for r in cp.near_dedup(spark, df, SF).collect())
    assert got == [("3", "None"), ("4", ""), ("7", t), ("7", "quite another text of seven words"), ("None", "alone here")]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in cp.STAGES:
        docs = cp.stage(step(spark, docs, SF))
    assert docs.count() == 0


def test_line_dedup_keeps_the_inputs_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", 99, 77), (2, "x\na\nb\nc", 5, 6), (3, None, None, 1)],
                               "doc_id long, text string, n_lines int, n_removed long")
    got = sorted(tuple(r) for r in cp.line_dedup(spark, df, SF).collect())
    assert got == [(1, "a\nb\nc\nd", 99, 77), (2, "x", 5, 6), (3, None, None, 1)]
