"""Every stage against a plain restatement of its decision, on the small table."""

import numpy as np

import corpus_pipeline
from routeloom.llm import bpe, decontaminate, ngram_join, pii, quality_rules
from routeloom.llm.common import prepare


def test_stages(spark, sf):
    docs = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "decontamination", "pii", "bpe"]
    good = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    one = docs.where(docs.doc_id.isin(list(good)))
    keep = {r.doc_id for r in ngram_join.link(one, width=5, percent=80).where("doc_id = component_id").collect()}
    items = [(r.item_id, decontaminate.normal(r.text.encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    clean = {d for d in keep if not any(t in decontaminate.normal(text[d].encode()) for _, t in items)}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == clean and len(clean) > 100
    t = bpe.transducer(open(bpe.default_path(), "rb").read())
    for d, r in out.items():
        after = t.decode(np.array(r.ids, "<u4").tobytes())
        assert r.round_trip and r.n_tokens == len(r.ids) and not pii.base_spans(after)
        assert pii.base_spans(text[d]) or after == text[d]


EDGE = "doc_id long, text string, lang string, source string, n_chars long, component_id long, node string, kept boolean, ids string"


def stages(spark, docs, sf):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf))
    return out


def test_unusual_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows, and columns named like the operators' own: the defined results, all columns kept."""
    prepare(spark)
    plain = " ".join(f"word{k} goes on" for k in range(40))
    long = " ".join(f"term{k}" for k in range(30_000))
    row = lambda k, text: (k, text, None, None, None, 7, "x", False, None)
    rows = [row(1, None), row(2, ""), row(3, "too short"), row(4, plain), row(4, plain), row(5, plain.replace("word7 ", "word_7 ")), row(6, long), row(None, plain + " and more of it" * 2), row(8, "again and again it says so. " * 40), row(9, f"{plain[::-1]} mail me at jane.doe@example.com today")]
    frames = stages(spark, spark.createDataFrame(rows, EDGE), sf)
    assert all(x.dtypes == frames[0].dtypes for x in frames[:-1])
    got = [[(r.doc_id, r.text) for r in x.collect()] for x in frames[:-1]]
    assert {k for k, _ in got[1]} == {None, 4, 5, 6, 9}  # short and repetitive documents go
    assert sorted(str(k) for k, _ in got[2]) == ["4", "6", "9", "None"]  # of near and exact copies one stays; a row without an id cannot be named and stays
    assert set(got[3]) <= set(got[2]) and {6, 9} <= {k for k, _ in got[3]}
    assert all("jane.doe@example.com" not in t for _, t in got[4]) and dict(got[4])[6] == long
    assert all(r.round_trip for r in frames[5].collect())


def test_empty_table(spark, sf):
    prepare(spark)
    frames = stages(spark, spark.createDataFrame([], EDGE), sf)
    assert all(x.dtypes == frames[0].dtypes for x in frames[:-1]) and frames[-1].count() == 0
