"""Writers. Each takes long tables and writes the file format's columns; callers name the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.operators.relational import matrix


def factor_graph(factors: DataFrame, links: DataFrame, path: str, form: str = "parquet") -> None:
    """Two tables below ``path``, as Parquet or XML (one element a row)."""
    for name, df in (("factors", factors), ("links", links)):
        if form == "xml":
            df.write.format("xml").option("rootTag", name).option("rowTag", name[:-1]).save(f"{path}/{name}")
        else:
            df.write.parquet(f"{path}/{name}")


def sample_matrix(scores: DataFrame, samples: list[str]) -> DataFrame:
    """Gene, SUM, a column for each sample."""
    out = matrix(scores, "gene", "sample_id", "score", samples, fill=None, total="SUM")
    return out.select(F.col("gene").alias("Gene"), "SUM", *(F.col(f"`{s}`") for s in samples))


def drug_matrix(results: DataFrame, pathways: list[str], value: str = "value") -> DataFrame:
    """A row for each drug in order, a column for each pathway, missing ones 0."""
    return matrix(results, "drug", "pathway", value, sorted(pathways)).orderBy("drug")


def sample_rows(beliefs: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    return beliefs.groupBy("sample_id").pivot("name", names).agg(F.first(value)).orderBy("sample_id")


def observation_table(obs: DataFrame, variables: list[str]) -> DataFrame:
    """A row for each sample; missing cells are ``na``."""
    wide = obs.groupBy("sample_id").pivot("variable", sorted(variables)).agg(F.first(F.col("value").cast("string")))
    return wide.fillna("na").orderBy("sample_id")


def sampled_states(samples: DataFrame, loglik: DataFrame, variables: list[str]) -> DataFrame:
    wide = samples.groupBy("sample_id").pivot("variable", sorted(variables)).agg(F.first("state"))
    return wide.join(loglik, "sample_id", "left").orderBy("sample_id")


def edge_list(results: DataFrame, least: float | None = None, value: str | None = "value") -> DataFrame:
    out = results if least is None else results.where(F.col(value) > least)
    return out.select("drug", "pathway", *([value] if value else []))


def attributes(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.col("member").alias("node"), F.col("cluster").alias("module"))


def attractor_text(track: DataFrame) -> DataFrame:
    """(scenario_id, line): each variable's attractor values in order, tab-separated."""
    a = track.where("in_attractor").groupBy("scenario_id", "var_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("v"))
    return a.select("scenario_id", F.concat_ws("\t", F.col("var_id").cast("string"), F.array_join(F.transform("v", lambda x: x["value"].cast("string")), "\t")).alias("line"))


def result_text(results: DataFrame) -> DataFrame:
    return results.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("db_id", "name", "sum", "average")), F.array_join("targets", ",")).alias("line"))


def summary(factors: DataFrame, links: DataFrame) -> DataFrame:
    """One row: n_factors, n_variables, n_links."""
    return factors.agg(F.count(F.lit(1)).alias("n_factors")).crossJoin(links.agg(F.count_distinct("var_id").alias("n_variables"), F.count(F.lit(1)).alias("n_links")))


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header, emptyValue="")


def factor_graphs(factors: DataFrame, path: str, files: int | None = None) -> None:
    """Kernel rows of many graphs as XML, an element for each factor with its graph's identifier; ``files`` = 1 makes one file,
    which is for graphs of a moderate number."""
    rows = factors.select(F.col("graph_id").cast("string").alias("graph_id"), F.col("factor_id").cast("string").alias("factor_id"), "states", "values", "var_ids")
    rows = rows if files is None else rows.repartition(files)
    rows.write.format("xml").option("rootTag", "factors").option("rowTag", "factor").save(path)


def boolean_network(variables: DataFrame, inputs: DataFrame, path: str) -> None:
    """Two XML tables below ``path``."""
    for name, df in (("variables", variables), ("inputs", inputs)):
        df.write.format("xml").option("rootTag", name).option("rowTag", name[:-1]).save(f"{path}/{name}")
