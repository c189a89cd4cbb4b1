import random

import pyarrow as pa

import corpus_pipeline as pipeline
from lodestone.llm import langid
from tests.llm import test_jaccard, test_quality, test_substring


def corpus():
    rng = random.Random(12)
    voices = {"en": "the of and tion ing her shed".split(), "de": "der sch ich ung zu ver".split()}

    def line(lang, n=12):
        return " ".join("".join(rng.choices(voices[lang], k=rng.randint(1, 4))) + str(rng.randint(0, 99)) for _ in range(n)) + "."

    rows, passage = [], " ".join(f"p{i}" for i in range(55)) + "."
    for i in range(60):
        lang = rng.choice(list(voices))
        text = "\n".join(line(lang) for _ in range(rng.randint(1, 12)))
        if i % 7 == 0:
            text += "\nHome | News | About | More |\nAll rights reserved."
        if i % 5 == 0:
            text += "\n" + passage
        rows.append((i, text, lang, "s", len(text)))
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(10)]
    rows += [(200 + i, rows[i][1] + " tail.", "de", "s", 1) for i in range(10, 20)]
    rows += [(300, None, "en", None, None), (301, "", None, "s", 0), (302, "12 34", "en", "s", 5), (5, rows[5][1], rows[5][2], "s", 9), (304, "a | b | c\n" * 60, "en", "s", 3)]
    return rows


def one_of_each(rows, groups):
    """The ids of the rows that stay: of each group one row with its least id."""
    return {component for _, _, component in groups}


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(*r, "x", 1) for r in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, words int").repartition(3)
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, ""), "t").withColumn("row", pipeline.F.lit("y")).withColumn("kept", pipeline.F.lit(1))
    assert docs.count() > 20 and docs.columns[:5] == list(pipeline.COLUMNS)


def test_stages_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    one = pipeline.written(pipeline.language_id(spark, docs, ""), "t")
    assert one.columns == docs.columns and ids(one) == sorted(r[0] for r in rows if langid.has_letter(r[1]))
    two = pipeline.written(pipeline.quality_rules(spark, one, ""), "t")
    expected = {}
    for r in one.collect():
        *_, cleaned, _, _, kept = test_quality.brute(r.text)
        if kept:
            expected[r.doc_id] = cleaned
    assert {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == {k: (v, len(v)) for k, v in expected.items()}
    assert 304 not in expected and len(expected) > 30
    three = pipeline.written(pipeline.near_duplicates(spark, two, ""), "t")
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in two.collect()])
    assert ids(three) == sorted(one_of_each(two.collect(), groups)) and three.columns == docs.columns
    four = pipeline.written(pipeline.repeated_passages(spark, three, ""), "t")
    before = three.collect()
    for r, (_, removed, kept) in zip(before, test_substring.brute([r.text for r in before], 35), strict=True):
        assert [x.text for x in four.collect() if x.doc_id == r.doc_id] == [kept if removed else r.text]
    five = pipeline.packing_stage(spark, four, "").collect()
    assert sorted({r.doc_id for r in five}) == ids(four)


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame(corpus()[:0], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
    assert langid.label_spans(langid.Model([], langid.np.zeros((langid.BUCKETS, 0), "f4"), langid.np.zeros(0, "u4"), 1.0), pa.array(["x"])) == [[]]
