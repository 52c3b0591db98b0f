"""The pipeline, stage by stage against the operators' brute-force meaning."""

import pytest

import corpus_pipeline
from synteny_spark.llm import decontam, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(9999, "This one keeps a secret: token = abcdef0123456789abcdef01 and more words than that.", "en", "own", 80)], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{SF}/documents.parquet").union(own)


def test_stages(spark, docs, tmp_path):
    now, read = docs, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, SF)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert now.columns == docs.columns
        rows = {r.doc_id: r for r in read.collect()}
        if name == "toxicity":
            machine = toxicity.learned(read, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(now) == sorted(i for i, r in rows.items() if machine.scores([r.text or ""])[0] < toxicity.THRESHOLD)
        if name == "simhash":
            assert ids(now) == sorted({r.component_id for r in simhash.near_duplicates(read).collect()})
            assert now.count() == len(set(ids(now)))
        if name == "decontamination":
            leaking = {r.doc_id for r in decontam.leaks(read, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert leaking and ids(now) == sorted(set(rows) - leaking)
        if name == "secrets":
            after = {r.doc_id: r for r in now.collect()}
            assert set(after) == set(rows) and any(after[i].text != rows[i].text for i in rows)
            assert all((after[i].text == rows[i].text) == (not secrets.spans(rows[i].text)) and not secrets.spans(after[i].text) for i in rows)
        if name == "bpe":
            assert ids(now) == sorted(rows)
        read = now
    assert set(ids(now)) - {9999} == set(ids(corpus_pipeline.run(spark, SF)))


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__blob` string, `__spans` string, component_id long, row_key string, blob string, spans string, who string, fp long, root long, salt int, `a.b` map<string,int>"
    more = ("x", "y", 1, "k", "b", "s", "w", 1, 2, 3, {"m": 1})
    rows = [(None, "a b", None, None, None, *more), (1, None, None, None, 0, *more), (2, "", None, None, 0, *more), (3, "c d", None, None, 3, *more), (3, "c d", None, None, 3, *more)]
    docs = spark.createDataFrame(rows, schema)
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(map(str, (r.doc_id for r in near.collect()))) == ["1", "3", "None"] and near.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.drop_leaks(spark, docs, SF).count() == 5 and corpus_pipeline.drop_toxic(spark, docs, SF).count() == 5
    masked = corpus_pipeline.mask_secrets(spark, spark.createDataFrame([(9, "token = abcdef1234", None, None, 0, *more), *rows], schema), SF).collect()
    assert len(masked) == 6 and {(r["__blob"], r["__spans"], r.blob, r.spans) for r in masked} == {("x", "y", "b", "s")}
    assert {r.doc_id: r.text for r in masked}[9] == secrets.MASK


def test_rows_of_one_id_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one text about the sea and ships that sail on it", "b"), (1, "quite another one: mountains, snow, goats and a hut", "b"), (2, "one text about the sea and ships that sail on it", "a"), (None, "no id at all but some words to tell it by", "c"), (None, "no id at all but some words to tell it by", "c"), (3, "Quite another one: mountains, snow, goats and a hut", "a"), (1, "one text about the sea and ships that sail on it", "a")], "doc_id long, text string, lang string")
    for _ in range(2):
        got = sorted(map(str, map(tuple, corpus_pipeline.drop_near_copies(spark, docs, SF).collect())))
        assert [x[:22] for x in got] == ["(1, 'one text about th", "(1, 'quite another one", "(None, 'no id at all b"]
        docs = docs.orderBy("lang").repartition(3)
