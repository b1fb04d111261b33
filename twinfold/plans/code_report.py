"""The code engine end to end: files to clusters, folder summary, warnings and report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.text import directory, is_test_path, markdown_cell, preview, role_hint, yes_no
from twinfold.operators import clusters as C
from twinfold.operators import pairs as P
from twinfold.operators.chunking import chunk_code
from twinfold.operators.components import components, shared_checkpoint
from twinfold.operators.review import merge_plans, notes, review
from twinfold.plans.profiles import Profile, profile_for
from twinfold.sources import files as S

# What a report says of itself.
SCHEMA_VERSION = "1.1"
TOOL = {"name": "code-dedup", "version": "0.2.0", "mode": "read_only_analysis", "language": "zh-CN"}


@dataclass
class CodeReport:
    """chunks, pairs, members and clusters of a run; counters of its near step, where it has one."""

    chunks: DataFrame
    pairs: DataFrame
    members: DataFrame
    clusters: DataFrame
    counters: DataFrame | None
    profile: Profile = Profile()


def analyse_code(files: DataFrame, mode: str = "standard", base: Profile = Profile()) -> CodeReport:
    """files: (path, ext, text). Pairs are compared whole; counters say by ``capped`` whether they are more than ``max_comparisons``, where the original engine stops."""
    profile = profile_for(mode, base)
    chunks = shared_checkpoint(chunk_code(files, profile))
    pairs = P.code_exact_pairs(chunks)
    counters = None
    if profile.near:
        some = chunks.where(F.col("kind").isin("function", "class", "window", "config") & (F.col("line_count") >= profile.min_lines))
        counters = P.pair_counters(some, "chunk_id", "path", ["ext", "kind"], "line_count").withColumn("capped", F.col("jaccard_comparisons") > profile.max_comparisons)
        near = P.near_pairs(some, "chunk_id", "path", ["ext", "kind"], "line_count", "normalized_text", profile.threshold)
        kinds = some.select(F.col("chunk_id").alias("left"), "kind")
        kind = F.when(F.col("kind").isin("function", "class"), "symbol_near").when(F.col("kind") == "config", "config_duplicate").otherwise("window_near")
        pairs = pairs.unionByName(near.join(kinds, "left").select("left", "right", F.bround("similarity", 4).alias("similarity"), kind.alias("duplicate_type")))
    pairs = shared_checkpoint(P.best_pairs(pairs, P.CODE_RANK))
    comp = components(pairs)
    facts = C.cluster_pairs(pairs, P.CODE_RANK, comp).withColumn("similarity", F.bround("similarity", 4))
    names = comp.select(F.col("node").alias("chunk_id"), F.col("component").alias("cluster"))
    members = names.join(facts, "cluster").join(chunks.select("chunk_id", "path", "ext", "language", "kind", "symbol", "line_start", "line_end", "line_count", preview(F.col("raw_text")).alias("preview")), "chunk_id")
    members = members.withColumn("folder", directory(F.col("path"))).withColumn("role", role_hint(F.col("path"), F.col("ext")))
    scored = C.score_members(members)
    clusters = C.numbered(scored.join(facts, "cluster"), "cluster").orderBy(F.desc("score"), "cluster_id")
    return CodeReport(chunks, pairs, members, clusters, counters, profile)


def evidence(report: CodeReport) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence of the clusters, as rows in order: members (cluster_id, ...), pairs (cluster_id, left, right, similarity, type) and folders (cluster_id, folder)."""
    ids = report.clusters.select("cluster", "cluster_id")
    members = report.members.join(ids, "cluster").select("cluster_id", "chunk_id", "path", "language", "kind", "symbol", "line_start", "line_end", "line_count", "preview", F.col("role").alias("role_hint")).orderBy("cluster_id", "path", "line_start")
    own = report.members.select(F.col("chunk_id").alias("left"), "cluster").join(ids, "cluster").drop("cluster")
    pairs = report.pairs.join(own, "left").select("cluster_id", "left", "right", "similarity", F.col("duplicate_type").alias("type")).orderBy("cluster_id", "type", "left", "right")
    folders = report.members.join(ids, "cluster").select("cluster_id", "folder").distinct().orderBy("cluster_id", "folder")
    return members, pairs, folders


def run_facts(scanned: DataFrame, report: CodeReport) -> DataFrame:
    """One row: files, ignored, unsupported, chunks, clusters, high, comparisons, capped, only_tests."""
    files = scanned.agg(
        F.count_if(F.col("status") == "ok").alias("files"), F.count_if(F.col("status") == "unsupported").alias("unsupported"),
        F.coalesce(F.bool_and(F.when(F.col("status") == "ok", is_test_path(F.col("path")))), F.lit(False)).alias("only_tests"),
    )
    ignored = S.ignored_files(scanned).agg(F.count(F.lit(1)).alias("ignored"))
    chunks = report.chunks.agg(F.count(F.lit(1)).alias("chunks"))
    found = report.clusters.agg(F.count(F.lit(1)).alias("clusters"), *[F.count_if(F.col("priority") == p).alias(p) for p in ("high", "medium", "low")])
    none = report.chunks.sparkSession.range(1).select(F.lit(0).cast("long").alias("jaccard_comparisons"), F.lit(False).alias("capped"))
    near = report.counters.select("jaccard_comparisons", "capped") if report.counters is not None else none
    out = files
    for one in (ignored, chunks, found, near):  # single rows
        out = out.join(F.broadcast(one), F.lit(True))
    return out


def run_metadata(spark: SparkSession, root: str, report: CodeReport, base: Profile = Profile(), include: list[str] = (), exclude: list[str] = (), max_kb: int = 1024, at: datetime | None = None) -> DataFrame:  # type: ignore[assignment]
    """One row: the parameters of a run as given and as its mode makes them."""
    p = report.profile
    row = {
        "root": root, "include": list(include), "exclude": list(exclude), "mode": p.mode, "cost_level": p.cost, "near_duplicate_enabled": p.near, "window_near_enabled": p.near,
        "threshold": base.threshold, "effective_threshold": p.threshold, "min_lines": base.min_lines, "effective_min_lines": p.min_lines, "window_lines": base.window_lines, "effective_window_lines": p.window_lines,
        "window_step": base.window_step, "effective_window_step": p.window_step, "max_file_size_kb": max_kb, "max_comparisons": base.max_comparisons, "effective_max_comparisons": p.max_comparisons,
        "top_k": p.top_k, "generated_at": (at or datetime.now().astimezone()).isoformat(),
    }
    text = {"root", "mode", "cost_level", "generated_at"}
    kind = {"include": "array<string>", "exclude": "array<string>", "near_duplicate_enabled": "boolean", "window_near_enabled": "boolean", "threshold": "double", "effective_threshold": "double"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k in text else kind.get(k, 'int')}" for k in row))


def folders(scanned: DataFrame, report: CodeReport) -> tuple[DataFrame, DataFrame]:
    """Folder summary and folder pairs, in the order of a report."""
    files = scanned.where("status = 'ok'").select(directory(F.col("path")).alias("folder"), "path")
    members = report.members.join(report.clusters.select("cluster", "score"), "cluster")
    return C.by_weight(C.folder_summary(files, members), "folder"), C.by_weight(C.folder_pairs(members), "left", "right")


def full_clusters(report: CodeReport) -> DataFrame:
    """Clusters with review hints, merge plan and notes, by score."""
    hints = review(report.members)
    rows = report.clusters.join(hints.drop("risk"), "cluster").join(merge_plans(hints).select("cluster", F.struct("target", "steps", "blockers", "validation", "requires_manual_review", "dry_run_only").alias("merge_plan")), "cluster")
    return rows.join(notes(report.members, hints), "cluster").withColumn("requires_ai_review", F.lit(True)).orderBy(F.desc("score"), "cluster_id")


# Headings, tables and sentences of the Markdown report.
TITLE = "# 代码重复检测报告"
OVERVIEW = ["## 1. 扫描概览", "", "| 指标 | 数值 |", "|---|---:|"]
FACTS = [
    ("运行模式", "mode"), ("成本等级", "cost_level"), ("是否检测近重复", "near_duplicate_enabled"), ("是否检测窗口级片段", "window_near_enabled"), ("有效相似度阈值", "effective_threshold"), ("有效最小行数", "effective_min_lines"),
    ("有效最大比较次数", "effective_max_comparisons"), ("展示上限", "top_k"), ("扫描根目录", "root"), ("include", "include"), ("exclude", "exclude"), ("扫描文件数", "files"), ("忽略文件数", "ignored"), ("分析代码块数", "chunks"),
    ("重复簇数量", "clusters"), ("高优先级重复簇", "high"), ("Jaccard 比对次数", "jaccard_comparisons"),
]
WARNING_HEAD = ["", "## 2. 质量预警", "", "| 预警码 | 说明 | 建议 |", "|---|---|---|"]
NO_WARNING = "| 无 | 未发现质量预警。 | 可继续复核重复簇证据。 |"
COVERAGE_HEAD = ["", "## 3. 扫描覆盖", "", "| 目录 | 可分析文件数 |", "|---|---:|"]
UNSUPPORTED_HEAD = ["", "| 未支持扩展名 | 文件数 |", "|---|---:|"]
CLUSTER_HEAD = ["", "## 4. 重复项汇总", "", "| 簇ID | 类型 | 优先级 | 证据强度 | 相似度 | 涉及文件数 | 需要 AI 复核 |", "|---|---|---|---|---:|---:|---|"]
NO_CLUSTER = "| 无 | 无 | 无 | 无 | 0 | 0 | 否 |"
FOLDER_HEAD = ["", "## 5. 目录级重复", "", "| 目录 | 扫描文件 | 受影响文件 | 重复簇 | 重复行数 | 密度 |", "|---|---:|---:|---:|---:|---:|"]
DETAIL_HEAD = ["", "## 6. 高/中优先级重复项详情", ""]
NO_DETAIL = "- 本次扫描未发现需要默认展开的高/中优先级重复簇。"
LOW_HEAD = ["## 7. 低优先级重复项", ""]
LOW_COUNT = "- 低优先级重复簇数量：%d"
LOW_NOTE = ["- 默认不展开低优先级重复项详情；如需复核，请指定具体重复簇编号或使用更大的 `--top-k` 重新生成报告。", "", "| 类型 | 数量 |", "|---|---:|"]
NONE_ROW = "| 无 | 0 |"
NEXT_HEAD = ["", "## 8. 下一步复核建议", ""]
NEXT_COUNTS = [("- 高优先级重复簇：%d 个。", "high"), ("- 中优先级重复簇：%d 个。", "medium"), ("- 低优先级重复簇：%d 个。", "low")]
NEXT_NOTES = ["- 若用户关注某个重复簇，优先读取已有 JSON 报告并只复核该重复簇涉及的源码和引用。", "- 脚本不判断是否合并；AI 需要读取源码、调用关系和测试后再给出建议。", "- 若用户批准修改，进入单独补丁/重构工作流，重新读取源码并生成最小补丁计划。", "", "## 9. 当前操作状态", "", "- 本报告仅由只读扫描生成；当前未修改任何文件。"]
#: Unsupported extensions that a report shows.
SHOWN_EXTENSIONS = 20


def report_lines(scanned: DataFrame, report: CodeReport, run: DataFrame) -> DataFrame:
    """The Markdown report of nine sections as rows (s, t, x, y, z, u, line); ordered by the first six they are the file. Nothing is collected."""
    spark = scanned.sparkSession
    facts = shared_checkpoint(run_facts(scanned, report))
    top_k = report.profile.top_k
    nil = {"x": F.lit(0.0), "y": F.lit(0.0), "z": F.lit(""), "u": F.lit(0)}

    def at(rows: DataFrame, s: int, t: int | Column, line: Column, **keys: Column) -> DataFrame:
        k = nil | keys
        return rows.select(F.lit(s).alias("s"), (F.lit(t) if isinstance(t, int) else t).cast("int").alias("t"), k["x"].cast("double").alias("x"), k["y"].cast("double").alias("y"), k["z"].alias("z"), k["u"].cast("int").alias("u"), line.alias("line"))

    def fixed(s: int, t: int, lines: list[str]) -> DataFrame:
        return spark.createDataFrame([(s, t, float(k), 0.0, "", 0, x) for k, x in enumerate(lines)], "s int, t int, x double, y double, z string, u int, line string")

    def row(*cells: Column | str) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("N/A")) if isinstance(c, Column) else F.lit(c) for c in cells]), F.lit(" |"))

    def code(c: Column) -> Column:
        return F.concat(F.lit("`"), markdown_cell(c, "<br>"), F.lit("`"))

    def unless(rows: DataFrame, s: int, t: int, line: str) -> DataFrame:
        """A line where there are no rows."""
        return at(rows.limit(1).groupBy().agg(F.count(F.lit(1)).alias("n")).where("n = 0"), s, t, F.lit(line))

    one = facts.join(F.broadcast(run), F.lit(True))
    shown = {
        "near_duplicate_enabled": yes_no(F.col("near_duplicate_enabled")), "window_near_enabled": yes_no(F.col("window_near_enabled")), "root": code(F.col("root")),
        "include": F.when(F.size("include") > 0, markdown_cell(F.array_join("include", ", "), "<br>")).otherwise("all"), "exclude": F.when(F.size("exclude") > 0, markdown_cell(F.array_join("exclude", ", "), "<br>")).otherwise("defaults only"),
    }
    about = [("schema_version", F.lit(SCHEMA_VERSION)), ("工具", F.lit(f"{TOOL['name']} {TOOL['version']}")), ("模式", F.lit(TOOL["mode"])), ("语言", F.lit(TOOL["language"])), *[(name, shown.get(k, F.col(k))) for name, k in FACTS]]
    overview = one.select(F.posexplode(F.array(*[row(name, value) for name, value in about])).alias("k", "l"))
    out = [fixed(1, 0, [TITLE, "", *OVERVIEW]), at(overview, 1, 1, F.col("l"), x=F.col("k"))]

    warnings = C.quality_warnings(facts, report.profile.mode)
    out += [fixed(2, 0, WARNING_HEAD), at(warnings, 2, 1, row(code(F.col("code")), markdown_cell(F.col("message"), "<br>"), markdown_cell(F.col("suggested_action"), "<br>")), z=F.col("code")), unless(warnings, 2, 1, NO_WARNING)]
    covered = S.coverage(scanned, directory(F.col("path"))).groupBy("folder").agg(F.sum("files").alias("files"))
    out += [fixed(3, 0, COVERAGE_HEAD), at(covered, 3, 1, row(code(F.col("folder")), F.col("files")), z=F.col("folder")), unless(covered, 3, 1, "| N/A | 0 |"), fixed(3, 2, UNSUPPORTED_HEAD)]
    others = S.unsupported(scanned).limit(SHOWN_EXTENSIONS)
    out += [at(others, 3, 3, row(code(F.col("extension")), F.col("files")), x=-F.col("files"), z=F.col("extension")), unless(others, 3, 3, NONE_ROW)]

    top = report.clusters.limit(top_k)
    line = row(F.concat(F.lit("`"), "cluster_id", F.lit("`")), F.col("duplicate_type"), F.col("priority"), F.col("evidence"), F.col("similarity"), F.col("members"), "是")
    out += [fixed(4, 0, CLUSTER_HEAD), at(top, 4, 1, line, x=-F.col("score"), z=F.col("cluster_id")), unless(top, 4, 1, NO_CLUSTER)]
    summary, _ = folders(scanned, report)
    line = row(code(F.col("folder")), F.col("files_scanned"), F.col("affected_files"), F.col("duplicate_clusters"), F.col("duplicate_lines"), F.format_string("%.2f", "duplicate_density"))
    out += [fixed(5, 0, FOLDER_HEAD), at(summary, 5, 1, line, x=-F.col("duplicate_clusters"), y=-F.col("duplicate_lines"), z=F.col("folder"))]

    detail = shared_checkpoint(C.to_detail(report.clusters, top_k))
    hints = review(report.members.join(F.broadcast(detail.select("cluster")), "cluster"))
    shown_members = report.members.join(F.broadcast(detail.select("cluster", "cluster_id", "score")), "cluster")
    full = detail.join(hints.select("cluster", "flags", "must_check", "not_checked"), "cluster")
    item = lambda xs, text: F.transform(xs, lambda i: F.concat(F.lit(f"- {text}`"), i, F.lit("`")))
    head = F.array(
        F.concat(F.lit("### "), "cluster_id"), *map(F.lit, ["", "#### 6.1 基本判断", "", "| 字段 | 内容 |", "|---|---|"]), row("重复类型", F.col("duplicate_type")), row("相似度", F.col("similarity")), row("证据强度", F.col("evidence")),
        row("优先级", F.concat("priority", F.lit(" ("), F.col("score").cast("string"), F.lit(")"))), row("需要 AI 复核", "是"), *map(F.lit, ["", "#### 6.2 证据表", "", "| 文件 | 符号/代码块 | 行号 | 角色 | 预览 |", "|---|---|---:|---|---|"]),
    )
    tail = F.concat(F.array(*map(F.lit, ["", "#### 6.3 复核提示", ""])), item("flags", "标记："), F.array(*map(F.lit, ["", "必须继续检查："])), item("must_check", ""), F.array(*map(F.lit, ["", "脚本未检查内容："])), item("not_checked", ""), F.array(F.lit("")))
    member = row(code(F.col("path")), markdown_cell(F.coalesce("symbol", "kind"), "<br>"), F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")), F.col("role"), markdown_cell(F.col("preview"), "<br>"))
    # Clusters come by score and id; in one, head, members and tail.
    names = lambda part, more=F.lit(""): F.concat_ws("\x01", "cluster_id", F.lit(part), more)
    out += [fixed(6, 0, DETAIL_HEAD), unless(detail, 6, 1, NO_DETAIL)]
    out.append(at(full.select("cluster_id", "score", F.posexplode(head).alias("k", "l")), 6, 2, F.col("l"), x=-F.col("score"), z=names("1"), u=F.col("k")))
    out.append(at(shown_members, 6, 2, member, x=-F.col("score"), z=names("2", F.col("path")), u=F.col("line_start")))
    out.append(at(full.select("cluster_id", "score", F.posexplode(tail).alias("k", "l")), 6, 2, F.col("l"), x=-F.col("score"), z=names("3"), u=F.col("k")))

    low = C.low_by_type(report.clusters)
    out += [fixed(7, 0, LOW_HEAD), at(facts, 7, 1, F.format_string(LOW_COUNT, "low")), fixed(7, 2, LOW_NOTE), at(low, 7, 3, row(F.col("type"), F.col("clusters")), z=F.col("type")), unless(low, 7, 3, NONE_ROW)]
    counts = facts.select(F.posexplode(F.array(*[F.format_string(text, k) for text, k in NEXT_COUNTS])).alias("k", "l"))
    out += [fixed(8, 0, NEXT_HEAD), at(counts, 8, 1, F.col("l"), x=F.col("k")), fixed(8, 2, NEXT_NOTES)]
    lines = out[0]
    for part in out[1:]:
        lines = lines.unionByName(part)
    return lines


def write_reports(scanned: DataFrame, report: CodeReport, run: DataFrame, path: str) -> None:
    """The folder of a run: report.json with a subfolder for each part, all clusters included, and report.md."""
    summary, pairs = folders(scanned, report)
    members, links, where = evidence(report)
    facts = run_facts(scanned, report)
    parts = {
        "run": run.withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("tool", F.struct(*[F.lit(v).alias(k) for k, v in TOOL.items()])),
        "summary": facts.select(F.col("files").alias("files_scanned"), F.col("ignored").alias("files_ignored"), F.col("chunks").alias("chunks_scanned"), F.col("clusters").alias("duplicate_clusters"), F.col("high").alias("high_priority_clusters")),
        "quality_warnings": C.quality_warnings(facts, report.profile.mode), "supported_files": S.coverage(scanned, directory(F.col("path"))).groupBy("folder").agg(F.sum("files").alias("files")).orderBy("folder"),
        "unsupported_files": S.unsupported(scanned), "ignored_files": S.ignored_files(scanned).orderBy("path"), "ignored_folders": S.ignored_folders(scanned).orderBy("path"), "folders": summary, "folder_pairs": pairs,
        "clusters": full_clusters(report), "members": members, "pairs": links, "directories": where,
    }
    if report.counters is not None:
        parts["performance"] = report.counters
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/report.json/{name}", ignoreNullFields=False)
    lines = report_lines(scanned, report, run).orderBy("s", "t", "x", "y", "z", "u")
    lines.select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/report.md")
