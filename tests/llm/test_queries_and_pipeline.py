"""The registered queries on the small tables, against SQL where there is some, and the pipeline stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netquill.llm import decontam, queries, toxicity
from netquill.llm.common import materialize, prepare, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def duck(sql):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    names, want = duck(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op8_decontamination"}))
def test_a_row_for_each_row(spark, name):
    got = queries.QUERIES[name](spark, SF)
    kind = "page_id" if "page_id" in got.columns else "doc_id"
    src = table(spark, SF, "pages" if kind == "page_id" else "documents").select(kind)
    assert got.select(kind).distinct().count() == src.distinct().count()
    if name != "op7_packing":
        assert got.count() == src.count()


def test_pipeline(spark):
    prepare(spark)
    docs = table(spark, SF, "documents")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    before, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF), "test-stage")
        assert after.schema.names == docs.schema.names
        gone = before.select("doc_id").exceptAll(after.select("doc_id"))
        assert after.exceptAll(before).count() == 0
        if name == "toxicity":
            model = toxicity.train(before, table(spark, SF, "labels"))
            want = toxicity.score(before, model).where("predicted = 1").select("doc_id")
            assert sorted(gone.collect()) == sorted(want.collect())
        if name == "exact_dedup":
            norm = {r["doc_id"]: (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in before.collect()}
            last = {}
            for i in sorted(norm):
                last[norm[i]] = i
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(last.values())
        if name == "simhash_near_dedup":
            docs_ = [(r["doc_id"], r["text"] or "") for r in before.collect()]
            sets = {}
            for i, text in docs_:
                words = text.encode().lower().split()
                sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
            root = {i: i for i in sets}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for i in sets:
                for j in sets:
                    if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({find(i) for i in sets})
        if name == "benchmark_decontamination":
            hit = decontam.hits(before, table(spark, SF, "benchmark")).select("doc_id").distinct()
            assert sorted(gone.collect()) == sorted(hit.collect())
        seen.append(after.count())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == seen[-1]
    whole = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = lambda d: d.agg(F.sum("length")).first()[0]
    assert whole.columns == packed.columns and total(whole) == total(packed) and set(key) <= set(whole.columns)
