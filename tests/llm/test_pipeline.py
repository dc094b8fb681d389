"""The pipeline's stages against plain Python over the smallest tables, and the queries against their SQL."""

import os
import re
import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tallymark.llm import catalog, decontam, toxicity  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_all(docs, labels, "doc_id", "text").collect()}
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect() if scores[r["doc_id"]] < 0.5}
    by_text = {}
    for key, text in left.items():
        by_text[text] = max(key, by_text.get(text, key))
    left = {k: left[k] for k in sorted(by_text.values())}
    sets = {}
    for key, text in left.items():
        words = re.split("[ \t-\r]+", text.lower().strip(" \t\n\x0b\x0c\r")) if text.strip(" \t\n\x0b\x0c\r") else []
        n = min(5, len(words))
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    component = {}
    for key in left:
        if key not in component:
            todo, component[key] = [key], key
            while todo:
                a = todo.pop()
                for b in left:
                    if b not in component and near(a, b):
                        component[b] = key
                        todo.append(b)
    left = {k: t for k, t in left.items() if component[k] == k}
    items = tuple((r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    look = decontam.Index(items)
    left = {k: t for k, t in left.items() if not look.matches(t)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: (r["ids"], r["n_tokens"]) for r in rows} == {
        k: (ids := library.encode(t, add_special_tokens=False).ids, len(ids)) for k, t in left.items()
    }
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, sf)
        assert stages.columns == docs.columns


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duck.execute(catalog.ORACLE[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    frame = catalog.QUERIES[name](spark, sf)
    assert sorted(frame.columns) == names
    assert sorted([tuple(r[n] for n in names) for r in frame.collect()], key=repr) == sorted([tuple(r[i] for i in order) for r in want.fetchall()], key=repr)
