"""Writers of function and class rows, their manifest, archive and report."""

from __future__ import annotations

import json
import os
import zipfile
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "0.1"


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line with every field, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(rows: DataFrame, path: str, lists_as_json: bool = False) -> None:
    """Lists stay lists, or become JSON text; maps stay maps."""
    (json_lists(rows) if lists_as_json else rows).write.mode("overwrite").parquet(path)


def json_lists(rows: DataFrame) -> DataFrame:
    """rows with every list as JSON text."""
    return rows.withColumns({f.name: F.to_json(f.name) for f in rows.schema if isinstance(f.dataType, T.ArrayType)})


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Blank lines give no rows."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """With a header; cells may hold line breaks."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file through Spark's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def manifest(config: dict, repos: list[dict], functions: dict, classes: dict, discovery: dict | None = None, extraction: dict | None = None) -> dict:
    """functions and classes: n, scored and truncated of each."""
    out = {
        "engine_version": VERSION,
        "generated_at": datetime.now(UTC).isoformat(),
        "config": config,
        "summary": {"total_repos": len(repos), "total_functions": functions["n"], "total_classes": classes["n"], "total_llm_scored": functions["scored"] + classes["scored"], "total_llm_score_truncated": functions["truncated"] + classes["truncated"]},
        "repos": repos,
    }
    return out | ({"discovery": discovery} if discovery is not None else {}) | ({"extraction": extraction} if extraction is not None else {})


def _plain(value):
    if isinstance(value, date | datetime):
        return value.isoformat()
    raise TypeError(type(value).__name__)


def score_totals(rows: DataFrame) -> DataFrame:
    """One row: the rows, those with a score, those whose score covers only a first part."""
    scored = "llm_score" in rows.columns
    return rows.agg(F.count("*").alias("n"), (F.count("llm_score") if scored else F.lit(0)).alias("scored"), (F.count_if("llm_score_truncated") if scored else F.lit(0)).alias("truncated"))


def score_counts(rows: DataFrame) -> dict:
    return score_totals(rows).first().asDict()


def export(functions: DataFrame, classes: DataFrame, output_dir: str, export_format: str, config: dict, repos: list[dict], discovery: dict | None = None, extraction: dict | None = None) -> dict[str, str]:
    """Label to path of what was written; a data file only where there are rows, the manifest always."""
    spark, paths, counts = functions.sparkSession, {}, {}
    for name, rows in (("functions", functions), ("classes", classes)):
        counts[name] = score_counts(rows)
        if counts[name]["n"] == 0:
            continue
        for kind, write in (("jsonl", write_jsonl), ("parquet", write_parquet)):
            if export_format in (kind, "both"):
                paths[f"{name}_{kind}"] = f"{output_dir}/{name}.{kind}"
                write(rows, paths[f"{name}_{kind}"])
    paths["manifest"] = f"{output_dir}/manifest.json"
    _put_text(spark, paths["manifest"], json.dumps(manifest(config, repos, counts["functions"], counts["classes"], discovery, extraction), indent=2, ensure_ascii=False, default=_plain))
    return paths


def archive(paths: list[str], target: str) -> None:
    """Files and part files of local paths in one ZIP archive with flat names."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in paths:
            if os.path.isdir(path):
                for part in sorted(x for x in os.listdir(path) if x.startswith("part-")):
                    z.write(f"{path}/{part}", f"{os.path.basename(path)}-{part}")
            else:
                z.write(path, os.path.basename(path))


def side_by_side(pairs: DataFrame, section: str, title: str, left: str, right: str, order: str) -> DataFrame:
    """section, report: the pairs of a section as one text, in order; for samples, which are small."""
    block = F.concat_ws("\n", F.concat(F.lit("--- "), F.col(title)), F.lit("[left]"), F.col(left), F.lit("[right]"), F.col(right))
    return pairs.groupBy(section).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, block.alias("b")))), lambda x: x["b"]), "\n\n").alias("report"))
