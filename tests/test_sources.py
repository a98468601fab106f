import pytest
from pyspark.sql import functions as F

from netquill.operators import observations, relational
from netquill.sources import readers, writers


@pytest.fixture
def file(tmp_path):
    def make(text, name="f.txt"):
        p = tmp_path / name
        p.write_text(text)
        return f"file://{p}"

    return make


def got(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_matrix(spark, rows, file):
    p = file("gene\ts1\ts2\nTP53\t1.5\tNA\nMYC\t\t-2\nX\tna\t0.1\n")
    assert got(readers.matrix(spark, p, "CNV"), "gene", "sample_id") == [("s2", "MYC", "CNV", -2.0), ("s1", "TP53", "CNV", 1.5), ("s2", "X", "CNV", 0.1)]
    assert readers.matrix(spark, p, "CNV", rows([("MYC",)], "gene string")).count() == 1
    single = readers.matrix(spark, p, "CNV", single=True).where("gene = 'X'").first()["value"]
    assert single == pytest.approx(0.1) and single != 0.1


MAF = """Hugo\tc1\tc2\tc3\tTumor_Sample_Barcode\tVariant_Classification\tc6\tc7\tScore
A\tx\ty\tz\ts1\tMissense_Mutation\tp\tq\t2.0
A\tx\ty\tw\ts1\tMissense_Mutation\tp\tq\t4.0
B\tx\ty\tz\ts2\tMissense_Mutation\tp\tq\t1.0
B\tx\ty\tv\tUnknown\tMissense_Mutation\tp\tq\t9.0
C\tx\ty\tu\ts2\tSilent\tp\tq\t7.0
C\tx\ty\tt\ts2\tMissense_Mutation\tp\tq\t.
"""


def test_mutations(spark, rows, file):
    p = file(MAF)
    m = readers.mutations(spark, p, "Score")
    assert got(readers.mean_scores(m), "gene") == [("s1", "A", 3.0), ("s2", "B", 1.0)]
    full = got(readers.filled_scores(m, rows([("A",), ("Z",)], "gene string")), "sample_id", "gene")
    assert full == [("s1", "A", 3.0), ("s1", "Z", 1.0), ("s2", "A", 1.0), ("s2", "Z", 1.0)]
    assert got(readers.mutation_scores(spark, p, "Score"), "score") == [(2.0,), (4.0,), (7.0,), (9.0,)]  # row 3 names row 1's mutation again


def test_lists(spark, rows, file):
    assert got(readers.scores(spark, file("1\n x\n2.5\n")), "score") == [(1.0,), (2.5,)]
    assert got(readers.pairs(spark, file("a\tb\na\tb\n", "p1"), file("c\td\n", "p2")), "gene1") == [("a", "b"), ("c", "d")]
    assert got(readers.toy_network(spark, file("A=B\n!C = D\n\n")), "input") == [("A", False, "B"), ("C", True, "D")]
    assert got(readers.ids(spark, file("12\tx\nid\n7\n")), "id") == [(7,), (12,)]
    assert got(readers.first_column(spark, file("a\t1\nb\n\na\t2\n")), "drug") == [("a",), ("b",)]
    assert got(readers.drug_targets(spark, file("d\tg\t0.5\n"))) == [("d", "g", 0.5)]


def test_clusters(spark, rows, file):
    p = file("a\tb\nc\nd\te\tf\n")
    assert got(readers.cluster_lines(spark, p), "member") == [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "e"), (3, "f")]
    assert got(readers.cluster_lines(spark, p, rows([("e",)], "member string"))) == [(3, "e")]
    assert got(readers.consensus_clusters(spark, file('"x y",3\n'))) == [("x y", 3)]
    assert got(readers.node_clusters(spark, file("n\t2\nm\t1\n")), "member") == [("m", 1), ("n", 2)]
    text = "Nr of module: 1\nRownames:\na\tb\nColnames:\nc\n\nNr of module: 2\nDepth: 3\nd\n__\n"
    assert got(readers.module_clusters(spark, file(text)), "member") == [(1, "a"), (1, "b"), (1, "c"), (2, "d")]


def test_drug_files(spark, rows, file):
    assert got(readers.drug_names(spark, file("h1\th2\th3\th4\n12\ta\tb\tAspirin\n13\ta\tb\n"))) == [("Drug_12_IC50", "Aspirin")]
    w = got(readers.ic50(spark, file("cell,Drug_1_IC50,Drug_2_IC50\nc1,2,\nc2,-1,0\n")), "sample_id", "drug")
    assert w == [("c1", "Drug_1_IC50", 0.25), ("c2", "Drug_1_IC50", 2.0), ("c2", "Drug_2_IC50", 1.0)]
    assert got(readers.impact_results(spark, file("drug\tid\tpathway\tsum\taverage\nd\t1\tp\t3\t0.5\ne\t1\tp\t3\t\n")), "drug") == [("d", "p", 0.5), ("e", "p", None)]


def test_samples(spark, rows, file):
    s = readers.sampled_states(spark, file("sample\tll\ta_mRNA\tb_CNV\tc\ns1\t-1\t0\t2\t1\ns2\t-1\t2\t2\t0\n"))
    assert got(s, "sample_id", "variable") == [("s1", "a_mRNA", 0), ("s1", "b_CNV", 2), ("s2", "a_mRNA", 2), ("s2", "b_CNV", 2)]
    assert got(readers.sample_types(s, ["a_mRNA", "b_CNV"])) == [("s2", 2)]
    many = rows([(f"s{k}", "o", 2 * (k % 2)) for k in range(10)], "sample_id string, variable string, state int")
    mixed = readers.sample_types(many, ["o"], shuffle_seed=3)
    assert sorted(r["type"] for r in mixed.collect()) == [0] * 5 + [2] * 5
    blocks = "Sample: s1\nGene\tScore\nA\t1.5\nB\t2\nSample: s2\nGene\tScore\nA\t3\n"
    assert got(readers.sample_blocks(spark, file(blocks), 1), "sample_id", "gene") == [("s1", "A", 1.5), ("s1", "B", 2.0), ("s2", "A", 3.0)]
    assert got(readers.log_seconds(spark, file("x: 2.5 seconds\ny: 10 seconds\nother\n"))) == [("y", 10.0), ("x", 2.5)]
    assert got(readers.log_parameters(spark, file("p: [0.1, 0.9]\n"))) == [("p", [0.1, 0.9])]


def test_graph_round_trip(spark, rows, tmp_path):
    f, li = rows([("f", [1.0, 2.0])], "factor_id string, values array<double>"), rows([("f", 0, 1, 2)], "factor_id string, pos int, var_id long, states int")
    for form in ("parquet", "xml"):
        writers.factor_graph(f, li, f"file://{tmp_path}/{form}", form)
    assert got(spark.read.parquet(f"file://{tmp_path}/parquet/factors")) == [("f", [1.0, 2.0])]
    back = spark.read.format("xml").option("rowTag", "factor").schema(f.schema).load(f"file://{tmp_path}/xml/factors")
    assert got(back) == [("f", [1.0, 2.0])]


def test_writers(spark, rows):
    s = rows([("g", "s1", 1.0), ("g", "s2", 2.0), ("h", "s1", 5.0)], "gene string, sample_id string, score double")
    assert got(writers.sample_matrix(s, ["s1", "s2"]), "Gene") == [("g", 3.0, 1.0, 2.0), ("h", 5.0, 5.0, None)]
    d = rows([("b", "p", 0.5), ("a", "q", 0.1)], "drug string, pathway string, value double")
    assert got(writers.drug_matrix(d, ["q", "p"])) == [("a", 0.0, 0.1), ("b", 0.5, 0.0)]
    assert got(writers.edge_list(d, 0.2)) == [("b", "p", 0.5)]
    o = rows([("s", "x", 1.0)], "sample_id string, variable string, value double")
    assert got(writers.observation_table(o, ["x", "y"])) == [("s", "1.0", "na")]


def test_observations(spark, rows):
    o = rows([("s1", "A", "CNV", -2.0), ("s2", "A", "CNV", 0.0), ("s1", "B", "CNV", 3.0), ("s1", "A", "Mutation", 2.5), ("s2", "A", "Mutation", 0.5)], "sample_id string, gene string, data_type string, value double")
    st = {(r["sample_id"], r["gene"], r["data_type"]): r["state"] for r in observations.discretized(o).collect()}
    assert st[("s1", "A", "CNV")] == 0 and st[("s2", "A", "CNV")] == 1 and st[("s1", "B", "CNV")] == 2 and st[("s1", "A", "Mutation")] == 1
    base = {r["data_type"]: r["value"] for r in observations.base_values(o).collect()}
    assert base == {"CNV": 0.0, "Mutation": 0.5}
    m = {(r["sample_id"], r["gene"]): r["marginal"] for r in observations.empirical(o).where("data_type = 'CNV'").collect()}
    assert m[("s1", "A")] == pytest.approx([1 / 3, 2 / 3, 0])
    kept = observations.empirical(o, rows([("B",)], "gene string"), whole_matrix=False).first()["marginal"]
    assert kept == pytest.approx([0, 0, 1])
    assert {r["anchor"] for r in observations.anchors(o).collect()} == {"A_DNA", "B_DNA", "A_protein"}
    chain = sorted(map(tuple, observations.dogma(rows([("A", "t")], "gene string, target string")).collect()))
    assert chain == [("A_DNA", "A_mRNA"), ("A_mRNA", "A_protein"), ("A_protein", "t")]
    r1 = observations.randomised(o, 20, seed=5)
    assert got(r1, "sample_id", "gene", "data_type") == got(observations.randomised(o.repartition(3), 20, seed=5), "sample_id", "gene", "data_type")
    assert r1.select("sample_id").distinct().count() == 20
    pairs = r1.groupBy("sample_id").agg(F.collect_set(F.struct("data_type", "value")).alias("v")).collect()
    assert {frozenset(map(tuple, p["v"])) for p in pairs} <= {frozenset({("CNV", -2.0), ("Mutation", 2.5)}), frozenset({("CNV", 0.0), ("Mutation", 0.5)})}


def test_relational(spark, rows):
    d = rows([("k", 2, "b"), ("k", 1, "a"), ("m", 5, "c")], "key string, o int, v string")
    assert got(relational.first_of(d, ["key"], ["o"]), "key") == [("k", 1, "a"), ("m", 5, "c")]
    u = rows([("g", 0, 0.2), ("g", 1, 0.3), ("g", 2, 0.5)], "grp string, state int, p double").withColumn("u", F.lit(0.4))
    assert got(relational.drawn(u, ["grp"], "state", "p", "u")) == [("g", 1)]
    assert relational.rising_steps(rows([(1, 0.5), (2, 0.7), (3, 0.6), (4, 0.9)], "i int, v double"), "i", "v").first()[0] == 2
    a = relational.auc(rows([("x", 1, 4.0)], "k string, t int, value double"), "k", "t").first()["auc"]
    assert a == 2.0
    t = relational.averaged_triples(rows([([1.0, 1.0, 2.0],), ([3.0, 1.0, 0.0],)], "values array<double>"))
    assert [r["value"] for r in t.orderBy("pos").collect()] == pytest.approx([0.5, 0.25, 0.25])
    assert got(relational.without_currency(rows([(1, ["ATP", "x"]), (2, ["y"]), (3, None)], "id int, names array<string>")), "id") == [(2, ["y"]), (3, None)]
    assert got(relational.sampled(rows([(k,) for k in range(50)], "k long"), "k", 5, 1)) == got(relational.sampled(rows([(k,) for k in range(50)], "k long").repartition(7), "k", 5, 1))
    assert got(relational.by_numeric_suffix(rows([("s_10",), ("s_9",)], "n string"), "n")) == [("s_9",), ("s_10",)]
    assert got(relational.subset_columns(rows([("r", 1, 2)], "id string, a int, b int"), {"b": "c"})) == [("r", 2)]
    assert relational.good_parameters(rows([([0.9, 0.0, 0.0, 0.5, 0.0, 0.0, 0.1],)], "v array<double>"), "v", 0.2).count() == 1
    assert relational.adjusted_rand(rows([(1, 1), (1, 1), (2, 2), (2, 2)], "a int, b int"), "a", "b").first()["ari"] == 1.0


def test_row_numbers(spark, rows):
    from netquill.plans.checkpoint import row_numbers

    d = spark.range(1000).withColumn("x", F.xxhash64("id"))
    n = row_numbers(d.repartition(5), "x")
    assert [r["rn"] for r in n.orderBy("x").collect()] == list(range(1, 1001))


def test_stream(spark, rows, tmp_path):
    from netquill.streaming.incremental import score_arrivals

    src = f"file://{tmp_path}/in"
    d = rows([("s1", "A", "CNV", -2.0)], "sample_id string, gene string, data_type string, value double")
    d.write.parquet(src)
    for _ in range(2):
        score_arrivals(spark, src, d.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/ckpt").awaitTermination()
        d.write.mode("append").parquet(src)
    assert [r["state"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [0, 0]


def test_formats_in_which_order_matters_across_blocks(spark, file):
    """Files that are read in many splits: lines are numbered, and headers carried, from block to block."""
    modules = "".join(f"Nr of module: {m}\nRownames 3\n" + "".join(f"g{m}_{k}\n" for k in range(m % 40)) + "\n" for m in range(1, 80))
    blocks = "".join(f"Sample:s{m}\nGenes\tx\n" + "".join(f"g{k}\t{m}.5\n" for k in range(m % 40)) for m in range(1, 80))
    clusters = "".join("\t".join(f"c{m}_{k}" for k in range(1 + m % 30)) + "\n" for m in range(1, 80))
    names = "id\ta\tb\tname\n" + "".join(f"{m}\ta\tb\tdrug{m}\n" for m in range(300))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert readers.lines(spark, file(modules, "m")).select("block").distinct().count() > 10
        assert sorted(got(readers.module_clusters(spark, file(modules, "m")))) == sorted((m, f"g{m}_{k}") for m in range(1, 80) for k in range(m % 40))
        assert sorted(got(readers.sample_blocks(spark, file(blocks, "b"), 1))) == sorted((f"s{m}", f"g{k}", m + 0.5) for m in range(1, 80) for k in range(m % 40))
        assert sorted(got(readers.cluster_lines(spark, file(clusters, "c")))) == sorted((m, f"c{m}_{k}") for m in range(1, 80) for k in range(1 + m % 30))
        assert sorted(got(readers.drug_names(spark, file(names, "n")))) == sorted((f"Drug_{m}_IC50", f"drug{m}") for m in range(300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
