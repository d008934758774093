"""Registered SQL against the Spark queries, on the small table and on one of unusual texts."""

import random
from collections import Counter

import duckdb
import pytest

from routeloom.llm import queries


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("ab cd Éfg h$ <x> longer".split()) for _ in range(n))
    passage = "".join(r.choice("abcdef gh") for _ in range(230))
    texts = [None, "", " \n\t", "one", "One", "two words", "w " * 3000, "é" * 300, passage, "x" + passage[:200], passage[:199] + "?", "\n".join(["a line", "", "a line", "b"] * 9)]
    texts += [say(r.randrange(1, 60)) for _ in range(60)] + [f"{s} {s}" for s in (say(k) for k in (5, 8, 12, 17, 30))]
    texts += [" ".join(f"t{k if k < 20 - n else k + 100 * n}" for k in range(60)) for n in range(3)]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op6_ngram_jaccard", "op7_suffix_dedup", "op8_quality_rules"])
@pytest.mark.parametrize("table", ["sf", "odd"])
def test_sql(spark, request, name, table):
    where = request.getfixturevalue(table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet{'' if table == 'sf' else '/*.parquet'}'")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, where)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(x) for x in got.select(columns).collect()) == Counter(want.fetchall())
