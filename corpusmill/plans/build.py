"""A corpus build over local relations: discover, filter, extract under caps, refill, de-duplicate, score, export.

repos: full_name, stars, contributors, created, license_spdx, language and more.
tree: repo, path, content. quality: full_name with the counts of the engineered
filter, or None. All of it is one lineage per relation; the driver holds caps,
one row a repository, and counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill import sinks
from corpusmill.config import Config
from corpusmill.operators import allocation, dedup, discovery, extraction, manifests, quality, scoring, testsuite
from corpusmill.sources import files
from corpusmill.sources.scratch import shared_dir

KEYS = ("repo", "file_path", "start_line")


def _kept(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discovered(repos: DataFrame, config: Config) -> DataFrame:
    """full_name, place and the repository's columns, in discovery order, under the cap."""
    found = discovery.qualify(repos, config.start_date, config.end_date, config.min_stars)
    if "language" in repos.columns:
        found = found.filter(F.lower("language") == config.language.lower())
    found = found.filter(discovery.enough_contributors(F.col("contributors"), config.min_contributors)).dropDuplicates(["full_name"])
    if config.max_repos is not None:
        found = found.orderBy(F.desc("stars"), F.asc("full_name")).limit(config.max_repos)
    # One row a repository; their number is the search's, not the files'.
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("stars"), F.asc("full_name"))))


def under_cap(rows: DataFrame, counts: DataFrame, count: str, cap: int | None, places: DataFrame) -> DataFrame:
    """rows with each repository's share of the cap, short ones made up from the others' surplus."""
    rows = rows.join(places.select(F.col("full_name").alias("repo"), "place"), "repo")
    if cap is None:
        return rows
    caps = allocation.stratified_caps(counts.select("repo", F.col(count).alias("cnt")), cap)
    pos = F.row_number().over(Window.partitionBy("repo").orderBy(files.order_key(F.col("file_path")), "position"))
    placed = rows.withColumn("pos", pos).join(caps, "repo", "left").withColumn("cap_rows", F.coalesce("cap_rows", F.lit(0)))
    taken = placed.filter("pos <= cap_rows")
    short = cap - taken.count()
    if short <= 0:
        return taken.drop("pos", "cap_rows", "cnt")
    got = taken.groupBy("repo").agg(F.count("*").alias("got"))
    spare = placed.filter("pos > cap_rows").join(got, "repo", "left").withColumn("tier", F.when(F.col("pos") <= allocation.buffered_cap(F.col("cap_rows")), 0).otherwise(1))
    room = F.when(F.col("tier") == 1, F.col("cnt") - F.coalesce("got", F.lit(0))).otherwise(0)
    more = spare.withColumn("room", room).filter(~((F.col("tier") == 1) & (F.col("cap_rows") > 0) & F.col("got").isNull()))  # those that gave nothing are known to be empty
    extra = allocation.refill(more, taken, short, KEYS, [F.asc("tier"), F.desc("room"), F.asc("place"), F.asc("pos")])
    return taken.select(*rows.columns).unionByName(extra.select(*rows.columns))


def _deduplicated(rows: DataFrame, threshold: float) -> DataFrame:
    key = F.struct("place", files.order_key(F.col("file_path")).alias("o"), "position")
    return dedup.deduplicate(rows.withColumn("_key", key), "_key", "source_code", round(100 * threshold)).drop("_key")


def repo_stats(places: DataFrame, functions: DataFrame, classes: DataFrame, tests: DataFrame) -> DataFrame:
    """A row for each repository: counts, test signals, licence."""
    n = lambda rows, name: rows.groupBy("repo").agg(F.count("*").alias(name))
    base = places.select(F.col("full_name").alias("repo"), "place", "stars", "contributors", F.coalesce("license_spdx", F.lit("Unknown")).alias("license"))
    out = base.join(n(functions, "functions"), "repo", "left").join(n(classes, "classes"), "repo", "left").join(tests.select("repo", "test_suite_present", "confidence"), "repo", "left")
    return out.na.fill({"functions": 0, "classes": 0, "test_suite_present": False, "confidence": "none"})


def run(repos: DataFrame, tree: DataFrame, config: Config, metrics: DataFrame | None = None, scorer: PipelineModel | None = None, progress: Callable[[str], None] = lambda _: None) -> dict:
    """The build; returns its summary."""
    began = time.time()
    places = _kept(discovered(repos, config), "build-repos")
    total = places.count()
    progress(f"{total} repositories discovered")
    if config.engineered_only:
        if metrics is None:
            raise ValueError("the engineered filter needs the repositories' metrics")
        passing = quality.apply_filters(metrics.join(places.select("full_name"), "full_name", "left_semi")).filter("passes_all")
        places = _kept(places.join(passing.select("full_name"), "full_name", "left_semi"), "build-engineered")
    tree = tree.join(places.select(F.col("full_name").alias("repo")), "repo", "left_semi")
    here = tree.select(F.col("repo").alias("full_name")).distinct()
    missing = _kept(places.join(here, "full_name", "left_anti").select("full_name"), "build-missing")
    failed = [r[0] for r in missing.orderBy("full_name").collect()]  # one name a repository, for the summary
    rows = _kept(extraction.definitions(tree, config.language, config.export_ast, config.granularity), "build-rows")
    counts = rows.groupBy("repo").agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    functions = under_cap(extraction.functions(rows), counts, "functions", config.max_functions, places)
    classes = under_cap(extraction.classes(rows), counts, "classes", config.max_classes, places)
    progress("extracted")
    parts = {}
    for name, part, cap in (("functions", functions, config.max_functions), ("classes", classes, config.max_classes)):
        part = _kept(part, f"build-{name}")
        if config.deduplicate:
            part = _kept(_deduplicated(part, config.dedup_threshold), f"build-{name}-distinct")
        if cap is not None and part.count() > cap:
            keyed = part.withColumn("_k", F.concat_ws("|", "repo", "file_path", F.col("start_line").cast("string"), F.col("position").cast("string")))
            part = allocation.proportional_sample(keyed, cap, "repo", "_k", "cap").drop("_k")
        if config.annotate_llm_score and scorer is not None:
            part = scoring.apply_scorer(scorer, part, "source_code")
        else:
            part = part.withColumn("llm_score", F.lit(None).cast("double")).withColumn("llm_score_truncated", F.lit(None).cast("boolean"))
        parts[name] = _kept(part, f"build-{name}-final")
    tests = testsuite.detect(tree, config.language)
    deps = manifests.dependencies(tree, config.language).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("position", "name", "version", "kind"))).alias("dependencies"))
    skipped = files.skipped_counts(tree, config.language)
    stats = _kept(repo_stats(places.join(missing, "full_name", "left_anti"), parts["functions"], parts["classes"], tests), "build-stats")
    meta = stats.join(tests.drop("test_suite_present", "confidence"), "repo", "left").join(deps, "repo", "left").join(skipped, "repo", "left").orderBy("place")
    described = [r.asDict(recursive=True) for r in meta.collect()]  # one row a repository
    n_skipped = sum(r["skipped_files"] or 0 for r in described)
    out_rows = {k: v.orderBy("place", files.order_key(F.col("file_path")), "position").drop("place", "position") for k, v in parts.items()}
    paths = sinks.export(out_rows["functions"], out_rows["classes"], config.output_dir, config.export_format, config.shown(), described, {"complete": True, "total_matching": total}, {"skip_dirs": sorted(files.SKIP_DIRS), "files_skipped": n_skipped})
    took = time.time() - began
    n = {k: sinks.score_counts(v) for k, v in parts.items()}
    return {
        "total_repos_discovered": total,
        "total_repos_processed": len(described),
        "total_repos_failed": len(failed),
        "failed_repos": failed,
        "total_functions": n["functions"]["n"],
        "total_classes": n["classes"]["n"],
        "total_llm_scored": n["functions"]["scored"] + n["classes"]["scored"],
        "total_llm_score_truncated": n["functions"]["truncated"] + n["classes"]["truncated"],
        "elapsed_seconds": round(took, 1),
        "pipeline_summary": f"{len(described)} repos mined in {elapsed(took)}. Average: {len(described) / max(took / 60, 1e-9):.1f} repos/min.",
        "output_paths": paths,
        "output_dir": config.output_dir,
        "repo_stats": [{k: r[k] for k in ("repo", "stars", "contributors", "functions", "classes", "test_suite_present", "confidence", "license")} for r in described],
    }


def elapsed(seconds: float) -> str:
    return f"{seconds:.1f}s" if seconds < 60 else f"{seconds / 60:.1f}min" if seconds < 3600 else f"{seconds / 3600:.1f}h"
