"""Readers. Each returns a DataFrame of the engine's long tables; nothing is collected but headers.

A matrix cell that is empty or ``na`` in any case is missing. Lines keep their order through (file, block, line)
keys, so formats in which order matters work over files that are read in splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netquill.operators.relational import first_of
from netquill.plans.checkpoint import row_numbers

MUTATION_KEY = (1, 2, 3, 6, 7)  # fixed values: positions of the columns that identify a mutation


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_order, value) of a text file; sorting by the first three gives the file's order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_order"), "value")


ORDER = ["file", "block", "line_order"]


def numbered(rows: DataFrame, name: str = "rn") -> DataFrame:
    """``rows`` (of :func:`lines`) with their numbers from 1 in their file. A file's blocks are counted, then numbered each."""
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"))  # a row for each block
    before = F.coalesce(F.sum("__n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("file", "block").orderBy("line_order"))
    return rows.withColumn("__in", within).join(counts.select("file", "block", before.alias("__before")), ["file", "block"]).withColumn(name, F.col("__in") + F.col("__before")).drop("__in", "__before")


def carried(rows: DataFrame, header: Column, name: str) -> DataFrame:
    """``rows`` (of :func:`lines`) with the last value of ``header`` that isn't null up to each line of the file: looked for in the
    line's block, and where that has none before it, in the blocks before."""
    marked = rows.withColumn("__h", header)
    ends = marked.where("__h IS NOT NULL").groupBy("file", "block").agg(F.max_by("__h", "line_order").alias("__e"))  # a row for each block
    blocks = rows.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    before = F.last("__e", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    within = F.last("__h", ignorenulls=True).over(W.partitionBy("file", "block").orderBy("line_order"))
    return marked.withColumn("__in", within).join(blocks.select("file", "block", before.alias("__before")), ["file", "block"]).withColumn(name, F.coalesce("__in", "__before")).drop("__h", "__in", "__before")


def _table(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header, inferSchema=False)


def present(cell: Column) -> Column:
    return cell.isNotNull() & (F.trim(cell) != "") & (F.lower(F.trim(cell)) != "na")


def matrix(spark: SparkSession, path: str, data_type: str, genes: DataFrame | None = None, single: bool = False) -> DataFrame:
    """(sample_id, gene, data_type, value) of a wide gene-by-sample file. ``genes`` (column gene) restricts it; ``single``
    keeps single precision."""
    return cells_of(_table(spark, path), data_type, genes, single)


def cells_of(wide: DataFrame, data_type: str, genes: DataFrame | None = None, single: bool = False) -> DataFrame:
    """The same of a wide table of text cells, the gene in its first column."""
    gene, *samples = wide.columns
    cells = wide.select(F.col(gene).alias("gene"), *(F.col(f"`{s}`") for s in samples)).unpivot("gene", [f"`{s}`" for s in samples], "sample_id", "cell")
    cells = cells if genes is None else cells.join(genes.select("gene").distinct(), "gene", "left_semi")
    value = F.expr("try_cast(cell AS FLOAT)").cast("double") if single else F.expr("try_cast(cell AS DOUBLE)")
    return cells.where(present(F.col("cell"))).select(F.trim("sample_id").alias("sample_id"), "gene", F.lit(data_type).alias("data_type"), value.alias("value"))


def mutations(spark: SparkSession, path: str, score: str) -> DataFrame:
    """(gene, sample_id, score) of the missense mutations of known samples with a numeric score."""
    return missense(_table(spark, path), score)


def missense(t: DataFrame, score: str) -> DataFrame:
    """The same of a mutation table, the gene in its first column."""
    return t.where((F.col("Tumor_Sample_Barcode") != "Unknown") & (F.col("Variant_Classification") == "Missense_Mutation")).select(
        F.col(t.columns[0]).alias("gene"), F.col("Tumor_Sample_Barcode").alias("sample_id"), F.expr(f"try_cast(`{score}` AS DOUBLE)").alias("score")
    ).where("score IS NOT NULL")


def mean_scores(m: DataFrame) -> DataFrame:
    return m.groupBy("sample_id", "gene").agg(F.avg("score").alias("score"))


def filled_scores(m: DataFrame, genes: DataFrame) -> DataFrame:
    """Mean score of every sample and gene; without a mutation the smallest score of all mutations, also of other genes."""
    means = mean_scores(m)
    grid = m.select("sample_id").distinct().crossJoin(genes.select("gene").distinct()).crossJoin(means.agg(F.min("score").alias("least")))
    return grid.join(means, ["sample_id", "gene"], "left").select("sample_id", "gene", F.coalesce("score", "least").alias("score"))


def mutation_scores(spark: SparkSession, path: str, score: str) -> DataFrame:
    """(score): of rows that name the same mutation the first counts."""
    rows = lines(spark, path).withColumn("t", F.split("value", "\t"))
    head = rows.orderBy(*ORDER).first()
    at = head["t"].index(score)
    key = F.concat_ws(":", *(F.get("t", F.lit(i)) for i in MUTATION_KEY))
    body = rows.where((F.col("file") != head["file"]) | (F.col("block") != head["block"]) | (F.col("line_order") != head["line_order"]))
    cells = body.select(*ORDER, key.alias("key"), F.get("t", F.lit(at)).alias("cell")).where("cell IS NOT NULL AND cell != ''")
    return first_of(cells, ["key"], ORDER).select(F.expr("try_cast(cell AS DOUBLE)").alias("score")).where("score IS NOT NULL")


def scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS DOUBLE)").alias("score")).where("score IS NOT NULL")


def pairs(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """Distinct (gene1, gene2) of one or more pair files."""
    return distinct_pairs(*(spark.read.csv(p, sep="\t", schema="gene1 string, gene2 string") for p in (path, *more)))


def distinct_pairs(*tables: DataFrame) -> DataFrame:
    """Distinct (gene1, gene2) without null of tables with these two columns in order."""
    named = [t.toDF("gene1", "gene2").where("gene1 IS NOT NULL AND gene2 IS NOT NULL") for t in tables]
    return reduce(DataFrame.union, named).distinct()


def toy_network(spark: SparkSession, path: str) -> DataFrame:
    """(input, negated, output) of lines ``[!]A=B``."""
    return toy_edges(spark.read.text(path))


def toy_edges(text: DataFrame) -> DataFrame:
    """The same of a table of lines (column value)."""
    value = F.trim("value")
    parts = text.where(value.contains("=")).select(F.regexp_extract(value, r"^(!?)\s*([^=]+?)\s*=\s*(.+)$", 2).alias("input"), (F.regexp_extract(value, r"^(!?)", 1) == "!").alias("negated"), F.regexp_extract(value, r"^(!?)\s*([^=]+?)\s*=\s*(.+)$", 3).alias("output"))
    return parts.where("input != ''")


def ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.expr("try_cast(split(value, '\t')[0] AS BIGINT)").alias("id")).where("id IS NOT NULL")


def cluster_lines(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame:
    """(cluster, member): the number of the line, from 1, is the cluster. ``keep``: column member."""
    out = numbered(lines(spark, path)).select(F.col("rn").alias("cluster"), F.explode(F.split("value", "\t")).alias("member")).where("member != ''")
    return out if keep is None else out.join(keep.select("member").distinct(), "member", "left_semi").select("cluster", "member")


def consensus_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=",", quote='"', schema="member string, cluster int")


def node_clusters(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame:
    out = spark.read.csv(path, sep="\t", schema="member string, cluster int").where("cluster IS NOT NULL")
    return out if keep is None else out.join(keep.select("member").distinct(), "member", "left_semi")


def module_clusters(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame:
    """(cluster, member) of module text: a line ``Nr of module: k`` names the cluster of the lines after it."""
    rows = lines(spark, path)
    cluster = F.expr("try_cast(regexp_extract(value, 'Nr of module:\\\\s*(\\\\d+)', 1) AS INT)")
    filled = carried(rows, cluster, "cluster")
    skip = F.col("value").rlike(r"^(Rownames|Colnames|Depth|__)|Nr of module:|^\s*$")
    out = filled.where(~skip & F.col("cluster").isNotNull()).select("cluster", F.explode(F.split(F.trim("value"), r"\t")).alias("member"))
    return out if keep is None else out.join(keep.select("member").distinct(), "member", "left_semi").select("cluster", "member")


def drug_names(spark: SparkSession, path: str) -> DataFrame:
    """(key, name): rows after the header with exactly four fields; the key is ``Drug_<id>_IC50``."""
    t = numbered(lines(spark, path)).withColumn("t", F.split("value", "\t")).where("rn > 1 AND size(t) = 4")
    return t.select(F.concat(F.lit("Drug_"), F.get("t", F.lit(0)), F.lit("_IC50")).alias("key"), F.get("t", F.lit(3)).alias("name"))


def drug_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="drug string, target string, weight double")


def impact_results(spark: SparkSession, path: str) -> DataFrame:
    """(drug, pathway, value) of an impact file: columns 0, 2 and the optional 4."""
    t = _table(spark, path)
    c = t.columns
    value = F.expr(f"try_cast(`{c[4]}` AS DOUBLE)") if len(c) > 4 else F.lit(None).cast("double")
    return t.where(F.col(f"`{c[2]}`").isNotNull()).select(F.col(f"`{c[0]}`").alias("drug"), F.col(f"`{c[2]}`").alias("pathway"), value.alias("value"))


def first_column(spark: SparkSession, path: str, name: str = "drug") -> DataFrame:
    return spark.read.text(path).select(F.trim(F.get(F.split("value", "\t"), F.lit(0))).alias(name)).where(f"`{name}` != ''").distinct()


def ic50(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, drug, weight) with weight 2^-x of every cell that isn't empty."""
    return drug_weights(_table(spark, path, ","))


def drug_weights(wide: DataFrame) -> DataFrame:
    """The same of a wide table of text cells, the sample in its first column."""
    sample, *drugs = wide.columns
    cells = wide.withColumnRenamed(sample, "sample_id").unpivot("sample_id", [f"`{d}`" for d in drugs], "drug", "cell").where(present(F.col("cell")))
    return cells.select("sample_id", "drug", F.pow(F.lit(2.0), -F.expr("try_cast(cell AS DOUBLE)")).alias("weight"))


def sampled_states(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("_mRNA", "_CNV")) -> DataFrame:
    """(sample_id, variable, state) of a sampled-states table; only the columns from the third on with one of the suffixes."""
    wide = _table(spark, path)
    use = [c for c in wide.columns[2:] if c.endswith(suffixes)]
    cells = wide.withColumnRenamed(wide.columns[0], "sample_id").unpivot("sample_id", [f"`{c}`" for c in use], "variable", "cell").where(present(F.col("cell")))
    return cells.select("sample_id", "variable", F.expr("CAST(try_cast(cell AS DOUBLE) AS INT)").alias("state"))


def sample_types(states: DataFrame, outputs: list[str], shuffle_seed: int | None = None) -> DataFrame:
    """(sample_id, type): 0 or 2 if all of the output variables have this state. With a seed the types are dealt anew."""
    t = states.where(F.col("variable").isin(*outputs)).groupBy("sample_id").agg(F.min("state").alias("a"), F.max("state").alias("b"), F.count_distinct("variable").alias("n"))
    t = t.where(f"a = b AND a IN (0, 2) AND n = {len(set(outputs))}").select("sample_id", F.col("a").alias("type"))
    if shuffle_seed is None:
        return t
    left = row_numbers(t.select("sample_id"), "sample_id")
    right = row_numbers(t.select("type", F.xxhash64("sample_id", F.lit(shuffle_seed)).alias("h"), "sample_id"), "h", "sample_id").select("type", "rn")
    return left.join(right, "rn").select("sample_id", "type")


def log_seconds(spark: SparkSession, path: str) -> DataFrame:
    """(name, seconds) of log lines like ``... name: 12.5 seconds``, slowest first."""
    return seconds_of(spark.read.text(path))


def seconds_of(text: DataFrame) -> DataFrame:
    """The same of a table of lines (column value)."""
    value = F.col("value")
    return text.select(F.regexp_extract(value, r"([^:]+):\s*([0-9.]+)\s*seconds", 1).alias("name"), F.expr(r"try_cast(regexp_extract(value, '([^:]+):\\s*([0-9.]+)\\s*seconds', 2) AS DOUBLE)").alias("seconds")).where("seconds IS NOT NULL").orderBy(F.desc("seconds"))


def log_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(name, values) of log lines like ``name: [0.1, 0.2]``."""
    body = F.regexp_extract("value", r"^\s*([^:]+):\s*\[([^\]]+)\]", 2)
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*([^:]+):\s*\[([^\]]+)\]", 1).alias("name"), F.transform(F.split(body, r"\s*,\s*"), lambda x: x.try_cast("double")).alias("values")).where("name != ''")


def sample_blocks(spark: SparkSession, path: str, score_column: int) -> DataFrame:
    """(sample_id, gene, value) of ``Sample:`` blocks: after each such line a header line, then rows."""
    rows = numbered(lines(spark, path))
    head = F.when(F.col("value").startswith("Sample:"), F.struct(F.trim(F.substring("value", 8, 1_000_000)).alias("name"), F.col("rn").alias("at")))
    named = carried(rows, head, "head").where(F.col("head").isNotNull() & (F.col("rn") > F.col("head.at") + 1) & (F.trim("value") != ""))
    body = named.select(F.col("head.name").alias("sample_id"), F.split("value", "\t").alias("t"))
    return body.select("sample_id", F.get("t", F.lit(0)).alias("gene"), F.expr(f"try_cast(get(t, {score_column}) AS DOUBLE)").alias("value"))


def pathways(diagrams: DataFrame, pathway: DataFrame, drawn: DataFrame, species: int) -> DataFrame:
    """Pathways with a diagram, of the species, with drawn reactions, neither a shell nor a disease pathway, by name."""
    keep = pathway.where((F.col("species_id") == species) & ~F.coalesce("is_shell", F.lit(False)) & ~F.coalesce("is_disease", F.lit(False)))
    return keep.join(diagrams.select("pathway_id").distinct(), "pathway_id", "left_semi").join(drawn.select("pathway_id").distinct(), "pathway_id", "left_semi").orderBy("name", "pathway_id")


def entities(spark: SparkSession, source: str, **jdbc: str) -> DataFrame:
    """A whole entity table: a parquet path, or (with ``url`` among the options) a table over JDBC."""
    return spark.read.format("jdbc").options(dbtable=source, **jdbc).load() if "url" in jdbc else spark.read.parquet(source)


def factor_graph(spark: SparkSession, path: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(factors, links) as :func:`netquill.sources.writers.factor_graph` wrote them."""
    kinds = {"factors": "factor_id string, values array<double>", "links": "factor_id string, pos int, var_id long, states int"}
    if form == "xml":
        return tuple(spark.read.format("xml").option("rowTag", name[:-1]).schema(kind).load(f"{path}/{name}") for name, kind in kinds.items())
    return tuple(spark.read.parquet(f"{path}/{name}") for name in kinds)


def factor_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Kernel rows of many graphs from one file (or folder of files) as :func:`netquill.sources.writers.factor_graphs` wrote."""
    kind = "graph_id string, factor_id string, states array<int>, values array<double>, var_ids array<long>"
    return spark.read.format("xml").option("rowTag", "factor").schema(kind).load(path).select("graph_id", "factor_id", "var_ids", "states", "values")


def boolean_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variables, inputs) of a Boolean network in XML."""
    kinds = {"variables": "var_id long, identical boolean", "inputs": "rel_id long, output_var long, input_var long, negated boolean"}
    return tuple(spark.read.format("xml").option("rowTag", name[:-1]).schema(kind).load(f"{path}/{name}") for name, kind in kinds.items())
