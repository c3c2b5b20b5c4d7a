"""The corpus queries against their SQL, and the pipeline stage by stage."""

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from aislecast.llm.queries import ORACLES, QUERIES

from .test_operators import plain_components, plain_leaks

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    expected = normal([d[0] for d in cursor.description], cursor.fetchall())
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == expected


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_disclosure", "op7_line_dedup"])
def test_native_queries_run_no_python(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_lines(docs):
    """Line dedup by hand: of each long line in five documents, only the largest id's stays."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc_id, text in docs.items():
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    return {
        doc_id: "\n".join(
            line
            for line in text.split("\n")
            if len(key(line)) < 40 or len(holders[key(line)]) < 5 or max(holders[key(line)]) == doc_id
        )
        for doc_id, text in docs.items()
    }


def test_pipeline_equals_its_stages_by_hand(spark):
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    first = corpus_pipeline.keep_quality(spark, docs, FOLDER)
    assert first.columns == columns
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    assert 0 < len(texts) < docs.count()
    texts = plain_lines(texts)
    ids = sorted(texts)
    kept = [ids[i] for i, (_, c) in enumerate(plain_components([texts[i] for i in ids], 5)) if c == i]
    left = {i: texts[i] for i in kept if plain_leaks(texts[i], benchmark)[1] == 0}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert rows.keys() == left.keys()
    for doc_id, text in left.items():
        assert rows[doc_id]["ids"] == tokenizer.encode(text, add_special_tokens=False).ids


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "plain words here", None, None, 5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
