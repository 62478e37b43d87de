"""Benchmark analytics over run rows: tool, dataset, status (ok, skipped, failed), seconds, archive_size."""

from __future__ import annotations

import os
import subprocess
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapack.functions.classify import SKIP_NOTE
from stratapack.functions.hashing import megabytes

TIMEOUT_S = 600
LOG_EPS = 1e-12


def matrix(datasets: DataFrame, tools: DataFrame) -> DataFrame:
    """Every dataset with every tool, dataset first. Both are configuration tables of a few rows."""
    return datasets.crossJoin(tools)


def resolve_tools(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """tool, command: an override replaces its tool's default."""
    o = overrides.select("tool", F.col("command").alias("_o"))
    return defaults.join(o, "tool", "left").select("tool", F.coalesce("_o", "command").alias("command"))


def _status(ok: Column, failed: Column, skipped: Column) -> Column:
    return F.when(failed > 0, F.when(ok > 0, "partial").otherwise("failed")).when(ok > 0, F.when(skipped > 0, "partial").otherwise("ok")).otherwise("skipped")


def _counts() -> list[Column]:
    n = lambda s: F.count_if(F.col("status") == s)
    ok = F.col("status") == "ok"
    return [n("ok").alias("n_ok"), n("failed").alias("n_failed"), n("skipped").alias("n_skipped"), F.coalesce(F.sum(F.when(ok, F.col("seconds"))), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum(F.when(ok, F.col("archive_size"))), F.lit(0)).cast("long").alias("archive_size")]


def aggregate(runs: DataFrame) -> DataFrame:
    """Per tool: sums over its ok runs, the datasets it was run on, and a status over all of them."""
    g = runs.groupBy("tool").agg(*_counts(), F.array_join(F.sort_array(F.collect_set("dataset")), ",").alias("datasets"))
    return g.select("tool", _status(F.col("n_ok"), F.col("n_failed"), F.col("n_skipped")).alias("status"), "seconds", "archive_size", "datasets")


def aggregate_baselines(baselines: DataFrame) -> DataFrame:
    """The same over all baselines as one row; no baselines at all are ok."""
    g = baselines.agg(*_counts(), F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("n") == 0, "ok").otherwise(_status(F.col("n_ok"), F.col("n_failed"), F.col("n_skipped"))).alias("status"), "seconds", "archive_size")


def weissman(size: Column, seconds: Column, base_size: Column, base_seconds: Column, alpha: float = 1.0) -> Column:
    """alpha * (base size / size) * (ln base time / ln time); null where it isn't defined."""
    good = (size > 0) & (seconds > 0) & (base_size > 0) & (base_seconds > 0)
    t = F.ln(seconds)
    return F.when(good & (F.abs(t) > LOG_EPS), alpha * (base_size / size) * (F.ln(base_seconds) / t))


def score_runs(runs: DataFrame, baselines: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Every run with its score against its dataset's baseline; null unless both are ok."""
    b = baselines.where("status = 'ok'").select("dataset", F.col("seconds").alias("b_seconds"), F.col("archive_size").alias("b_size"))
    score = F.when(F.col("status") == "ok", weissman(F.col("archive_size"), F.col("seconds"), F.col("b_size"), F.col("b_seconds"), alpha))
    return runs.join(b, "dataset", "left").select("tool", "dataset", "status", score.alias("score"))


def score_tools(runs: DataFrame, baselines: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Per tool a score over the sums, only where the tool and every baseline are ok."""
    b = aggregate_baselines(baselines).select(F.col("status").alias("b_status"), F.col("seconds").alias("b_seconds"), F.col("archive_size").alias("b_size"))
    score = F.when((F.col("status") == "ok") & (F.col("b_status") == "ok"), weissman(F.col("archive_size"), F.col("seconds"), F.col("b_size"), F.col("b_seconds"), alpha))
    return aggregate(runs).crossJoin(b).select("tool", "status", score.alias("score"))


def delta(totals: DataFrame, baseline_tool: str) -> DataFrame:
    """Size change in percent against one tool's total; null where either is 0."""
    b = totals.where(F.col("tool") == baseline_tool).agg(F.max("archive_size").alias("b"))
    pct = F.when((F.col("archive_size") > 0) & (F.col("b") > 0), (F.col("archive_size") - F.col("b")) * 100.0 / F.col("b"))
    return totals.crossJoin(b).select("tool", "status", "seconds", "archive_size", pct.alias("delta_percent"))


def gate(totals: DataFrame, tool: str, baseline_tool: str, goal_percent: float | None) -> DataFrame:
    """One row: win_percent and verdict. Both tools must be ok; without a goal there is no verdict."""
    pick = lambda t, c: F.max(F.when((F.col("tool") == t) & (F.col("status") == "ok") & (F.col("archive_size") > 0), F.col(c)))
    r = totals.agg(pick(tool, "archive_size").alias("s"), pick(baseline_tool, "archive_size").alias("b"))
    win = (F.col("b") - F.col("s")) * 100.0 / F.col("b")
    verdict = F.lit("no goal") if goal_percent is None else F.when(win.isNull(), "incomplete").when(win >= goal_percent, "pass").otherwise("fail")
    return r.select(win.alias("win_percent"), verdict.alias("verdict"))


def best_rival(runs: DataFrame, tool: str, rivals: list[str]) -> DataFrame:
    """Per dataset the smallest rival, and the tool's win over it in percent."""
    ok = runs.where("status = 'ok'")
    g = ok.groupBy("dataset").agg(F.min(F.when(F.col("tool").isin(rivals), F.col("archive_size"))).alias("best"), F.max(F.when(F.col("tool") == tool, F.col("archive_size"))).alias("own"))
    return g.select("dataset", "best", "own", ((F.col("best") - F.col("own")) * 100.0 / F.col("best")).alias("win_percent"))


def combine(manifests: list[DataFrame]) -> DataFrame:
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def run_tool(command: list[str], dataset: str, output: str, timeout_s: int = TIMEOUT_S) -> tuple[str, float | None, int | None, str]:
    """status, seconds, archive_size, note of one external run; for the driver, a few tools at a time."""
    if not os.path.exists(dataset):
        return "skipped", None, None, "missing input"
    if os.path.isfile(output) and not os.path.samefile(output, dataset):
        os.unlink(output)  # an earlier run's output must not pass for this one's
    began = time.perf_counter()
    try:
        r = subprocess.run(command, capture_output=True, text=True, timeout=timeout_s)
    except FileNotFoundError:
        return "skipped", None, None, "missing tool"
    except (subprocess.TimeoutExpired, OSError) as e:
        return "failed", None, None, str(e)
    if r.returncode:
        for line in (r.stderr + "\n" + r.stdout).splitlines():
            if line.startswith("BENCHMARK_SKIP:"):
                return "skipped", None, None, line.split(":", 1)[1].strip() or SKIP_NOTE
        return "failed", None, None, f"exit code {r.returncode}"
    if not os.path.exists(output):
        return "failed", None, None, "no output"
    return "ok", time.perf_counter() - began, os.path.getsize(output), ""


def render(totals: DataFrame) -> str:
    """The totals as a Markdown table, by tool name; one row per tool comes to the driver."""
    rows = totals.withColumn("mb", megabytes(F.col("archive_size"))).orderBy("tool").collect()
    lines = ["| tool | status | seconds | MB | delta |", "| --- | --- | --- | --- | --- |"]
    for r in rows:
        d = "n/a" if r["delta_percent"] is None else f"{r['delta_percent']:+.2f}%"
        lines.append(f"| {r['tool']} | {r['status']} | {r['seconds']:.2f} | {r['mb']:.2f} | {d} |")
    return "\n".join(lines) + "\n"
