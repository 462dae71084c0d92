from collections import Counter

import duckdb
import pyarrow.parquet as pq

import corpus_pipeline
from clickspark.llm import mixing, toxicity
from clickspark.llm.queries import ORACLES
from clickspark.llm.storage import materialise
from tests.conftest import SF_SMALL
from tests.llm.test_mixing import check
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_tokens import expected


def contaminated(rows):
    """doc_ids by the SQL of the decontamination query."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in rows])
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF_SMALL}/benchmark.parquet')")
    return {r[0] for r in con.execute(ORACLES["op4_decontamination"]).fetchall()}


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], SF_SMALL), name))
        if name != names[-1]:
            assert kept[-1].columns == docs.columns and kept[-1].dtypes == docs.dtypes
    raw, clean, unique, sound, mixed, tokens = ([*k.collect()] for k in kept)

    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    assert Counter(clean) == Counter(r for r in raw if not model.toxic([model.score(r.text)])[0])
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF_SMALL}/labels.parquet").to_pylist()}
    left = {r.doc_id for r in clean}
    assert sum(t == 0 and d not in left for d, t in labels.items()) == 0  # no clean document is lost

    fps = {r.doc_id: plain_fingerprint(r.text) for r in clean}
    root = plain_components(fps.values())
    first = {}
    for d, f in fps.items():
        first[root[f]] = min(d, first.get(root[f], d))
    assert Counter(unique) == Counter(r for r in clean if r.doc_id in first.values())

    leaks = contaminated(unique)
    assert Counter(sound) == Counter(r for r in unique if r.doc_id not in leaks)

    copies = Counter(r.doc_id for r in mixed)
    assert set(mixed) <= set(sound) and max(copies.values()) <= 2

    mix = {r.doc_id: r for r in mixing.mix(kept[3]).collect()}
    assert {d: r.copies for d, r in mix.items() if r.copies} == dict(copies)
    check(mix.values(), [(r.doc_id, r.text, r.source) for r in sound])

    assert sorted(map(tuple, tokens)) == expected(sorted((r.doc_id, r.text) for r in mixed))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == sorted(map(tuple, tokens))


def test_an_empty_table_runs_through(spark, scratch):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").limit(0).write.parquet(f"{scratch}/{name}.parquet")
    assert corpus_pipeline.run(spark, scratch).collect() == []
