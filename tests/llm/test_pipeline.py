"""The pipeline's stages over a small folder of tables."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(3)
    at = tmp_path_factory.mktemp("tables")
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item = sentence(20)
    rows = [[i, sentence(60)] for i in range(300)]
    for i in range(0, 300, 5):
        rows[i][1] += " scum idiot vile"
    rows[7][1] = rows[6][1]  # a copy
    rows[8][1] += " " + item  # contaminated
    passage = sentence(80)
    for i in (11, 12):
        rows[i][1] += " " + passage
    rows += [[300, None], [301, ""], [302, ""], [None, "no id"]]
    docs = [(i, t, "en", "s", len(t or ""), 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, block long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, text = docs.columns, [], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in docs.collect()})
        if name != "bpe":
            assert docs.columns == columns
            text[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic, near, repeats, clean, coded = kept
    assert toxic == {i for i in range(300) if i % 5} | {300, 301, 302, None}
    assert toxic - near == {7, 301, 302}
    assert repeats == near and len(text["repeats"][11]) < 60 * 7 + 5 and text["repeats"][11][:400] == text["near_duplicates"][11][:400]
    assert repeats - clean == {8} and coded == clean
    assert corpus_pipeline.run(spark, sf_dir).count() == len(clean)


def test_rows_with_null_or_repeated_ids_are_judged_by_themselves(spark, tmp_path):
    rng = random.Random(5)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item, clean = sentence(20), [sentence(60) for _ in range(8)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = lambda stage, rows: sorted(((r["doc_id"] or -1, r["text"]) for r in stage(spark, frame(rows), str(tmp_path)).collect()))
    rows = [(None, clean[0]), (None, clean[1] + " " + item), (5, clean[2]), (5, clean[3] + " " + item), (6, clean[4])]
    assert left(corpus_pipeline.drop_contaminated, rows) == sorted([(-1, clean[0]), (5, clean[2]), (6, clean[4])])
    rows = [(5, clean[0]), (5, clean[1]), (7, clean[1]), (3, clean[2]), (5, clean[2]), (8, clean[5]), (8, clean[5]), (None, clean[6]), (None, clean[7])]
    want = [(5, clean[0]), (5, clean[1]), (3, clean[2]), (8, clean[5]), (-1, clean[6]), (-1, clean[7])]
    assert left(corpus_pipeline.drop_near_duplicates, rows) == sorted(want)


def test_other_columns_of_any_name_and_null_ids_stay_whole(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row long, nth long, row string, `a.b` int"
    text = "one two three four five six seven eight"
    rows = [(None, text, None, None, None, 777, 1, "x", 4), (None, text, "en", "s", 39, 888, 2, "y", 5), (1, text, "en", "s", 39, 999, 3, "z", 6)]
    rows += [(None, "quite other words stand here and nowhere else", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[2:], key=str)
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect()), key=str) == sorted(rows, key=str)
    only_null = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id is null"), str(tmp_path))
    assert only_null.where("text like 'one%'").count() == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
