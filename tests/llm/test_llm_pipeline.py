"""The pipeline: every stage on its own input against a plain version, and the registration."""

from test_llm_operators import plain_groups, plain_removal

import __spark_entry__ as contract
import corpus_pipeline
from lattica.llm import pulearning
from lattica.llm.queries import LLM_QUERIES
from lattica.llm.tables import staged

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_their_contracts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    inputs, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = staged(stage(spark, docs, SMALL), "stage")
        assert name and (docs.columns == columns or name == corpus_pipeline.STAGES[-1][0])
    rows = [[tuple(r) for r in d.orderBy("doc_id").collect()] for d in inputs]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in pulearning.classify(inputs[0], labels).collect()}
    assert [r[0] for r in rows[1]] == [r[0] for r in rows[0] if scores[r[0]] == 1]
    assert [r[0] for r in rows[2]] == [i for i, _, c in plain_groups(rows[1], 5, 80) if i == c]
    removed = {i: gone for i, _, gone, *_ in plain_removal(rows[2])}
    assert all(len((a[1] or "").encode()) - removed[a[0]] - len((b[1] or "").encode()) in range(4) for a, b in zip(rows[2], rows[3], strict=True))
    assert {r[0] for r in rows[4]} <= {r[0] for r in rows[3]} and len(rows[4]) < len(rows[3])
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows[4]}
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES)
    assert numbers == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(contract.queries())


def test_queries_run_over_whole_tables(spark):
    count = {t: spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, make in LLM_QUERIES.items():
        df = make(spark, SMALL)
        if df.columns[0] not in ("doc_id", "page_id"):
            continue  # op11 and op13 return ranked lists; SQL over the whole tables holds them
        got = df.select(df.columns[0]).distinct().count()
        assert got == count["pages" if df.columns[0] == "page_id" else "documents"], name
