"""Clusters of duplicates: roll-up, scores, preferred copies, folder summaries, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.text import directory, is_prod_path, is_test_path, version_score
from twinfold.operators.components import components, shared_checkpoint
from twinfold.operators.pairs import CODE_RANK

# Words of paths that speak for or against a copy, and suggested actions.
POSITIVE = ["official", "current", "latest", "规范", "标准", "正式", "发布"]
NEGATIVE = ["old", "backup", "archive", "deprecated", "历史", "旧版", "备份"]
FORMAT_SCORE = {".md": 1.5, ".docx": 1.2, ".pdf": 0.5}
ACTIONS = {"file": "归档重复文件", "text": "保留主版本，归档正文重复文件", "extract": "抽取公共章节", "merge": "合并近重复章节", "review": "人工复核或保留观察"}


def cluster_pairs(pairs: DataFrame, rank: dict[str, int] = CODE_RANK, comp: DataFrame | None = None) -> DataFrame:
    """(cluster, n_pairs, duplicate_type, similarity) over the components of (left, right, similarity, duplicate_type); comp: the components, if known."""
    comp = components(pairs) if comp is None else comp
    strength = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("duplicate_type")]
    own = pairs.join(comp.select(F.col("node").alias("left"), F.col("component").alias("cluster")), "left")
    return own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_pairs"), F.max_by("duplicate_type", strength).alias("duplicate_type"), F.avg("similarity").alias("similarity"))


def numbered(clusters: DataFrame, order: str) -> DataFrame:
    """Positional ids: cluster_001 and so on. Rows are sorted by ranges and numbered range by range, so no task holds all clusters."""
    ranged = shared_checkpoint(clusters.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # one row a range
    n = (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("string")
    name = F.concat(F.lit("cluster_"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))
    return ranged.join(F.broadcast(before), "_part").withColumn("cluster_id", name).drop("_part", "_at", "_first", "_before")


def cluster_score(lines: Column, members: Column, similarity: Column, kind: Column, any_prod: Column, all_test: Column) -> Column:
    """Priority score from 0 to 100: size, copies, similarity, evidence, and the role of the paths."""
    bonus = F.when(kind.isin("file_exact", "symbol_exact"), 18).when(kind.isin("file_normalized_exact", "config_duplicate"), 12).when(kind == "symbol_near", 10).otherwise(0)
    total = F.least(F.lit(30.0), lines / 3) + F.least(F.lit(20.0), (members - 1) * 8) + similarity * 20 + bonus + F.when(any_prod, 12).otherwise(0) - F.when(all_test, 20).otherwise(0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 1)


def score_members(members: DataFrame) -> DataFrame:
    """(cluster, score, priority, evidence) from members (cluster, path, line_count) with duplicate_type and similarity."""
    g = members.groupBy("cluster", "duplicate_type", "similarity").agg(
        F.sum("line_count").alias("lines"), F.count(F.lit(1)).alias("members"), F.bool_or(is_prod_path(F.col("path"))).alias("prod"), F.bool_and(is_test_path(F.col("path"))).alias("test"), F.count_distinct(directory(F.col("path"))).alias("dirs")
    )
    score = cluster_score(F.col("lines"), F.col("members"), F.col("similarity"), F.col("duplicate_type"), F.col("prod"), F.col("test"))
    return g.select("cluster", "members", "lines", score.alias("score"), evidence(F.col("duplicate_type"), F.col("similarity")).alias("evidence"), risk(F.col("duplicate_type"), F.col("dirs") > 1).alias("risk")).withColumn("priority", priority(F.col("score")))


def priority(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 45, "medium").otherwise("low")


def evidence(kind: Column, similarity: Column) -> Column:
    by_score = F.when(similarity >= 0.93, "strong").when(similarity >= 0.86, "moderate").otherwise("weak")
    return F.when(kind.isin("file_exact", "symbol_exact"), "strong").when(kind == "file_normalized_exact", F.when(similarity >= 0.99, "strong").otherwise("moderate")).when(kind == "config_duplicate", "moderate").otherwise(by_score)


def risk(kind: Column, cross: Column) -> Column:
    return F.when(kind == "config_duplicate", "high").when(kind.isin("symbol_near", "window_near"), F.when(cross, "high").otherwise("medium")).otherwise(F.when(cross, "medium").otherwise("low"))


def action_for(kind: Column, all_test: Column) -> Column:
    return (
        F.when(kind == "file_exact", "review_canonical_candidate")
        .when(kind == "symbol_exact", F.when(all_test, "keep_separate_with_note").otherwise("extract_shared_function"))
        .when(kind == "config_duplicate", "consolidate_config")
        .when(kind == "window_near", "extract_helper")
        .otherwise("manual_review_required")
    )


def suggest_action(kind: Column, members: Column, similarity: Column) -> tuple[Column, Column]:
    """Action and risk of a document cluster."""
    case = F.when(kind == "file_exact", "file").when(kind == "text_exact", "text").when((kind == "chunk_exact") & (members >= 3), "extract").when((kind == "chunk_near") & (similarity >= 0.9), "merge").otherwise("review")
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[case]
    return action, F.when(case.isin("file", "text"), "high").when(case.isin("extract", "merge"), "medium").otherwise("low")


def canonical_score(path: Column, filename: Column, ext: Column, epoch: Column, text: Column) -> Column:
    return length_score(path, filename, ext, epoch, F.length(text))


def length_score(path: Column, filename: Column, ext: Column, epoch: Column, length: Column) -> Column:
    """``canonical_score`` where only the text's length is at hand."""
    low = F.lower(path)
    out = sum((F.when(low.contains(t), 5.0).otherwise(0.0) for t in POSITIVE), F.lit(0.0)) - sum((F.when(low.contains(t), 5.0).otherwise(0.0) for t in NEGATIVE), F.lit(0.0))
    kinds = F.coalesce(F.create_map(*[F.lit(x) for kv in FORMAT_SCORE.items() for x in kv])[ext], F.lit(0.0))
    return out + epoch / 1_000_000_000 + version_score(filename) + F.least(length / 1000.0, F.lit(2.0)) + kinds


def canonical(members: DataFrame, cluster: str, item: str, score: str) -> DataFrame:
    """The best member of each cluster, ties to the smallest id, by a partial aggregate."""
    return members.groupBy(cluster).agg(F.max(score).alias(score), F.count(F.lit(1)).alias("members"), F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))).alias("x")).select(cluster, F.col("x.i").alias(f"canonical_{item}"), score, "members")


def folder_summary(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files, affected files, clusters, lines and density by folder. files: (folder, path); members: (folder, path, cluster, line_count, score)."""
    scanned = files.groupBy("folder").agg(F.count(F.lit(1)).alias("files_scanned"))
    hit = members.groupBy("folder").agg(F.count_distinct("path").alias("affected_files"), F.count_distinct("cluster").alias("duplicate_clusters"), F.sum("line_count").alias("duplicate_lines"), F.max("score").alias("max_priority_score"))
    j = scanned.join(hit, "folder", "full_outer").na.fill(0)
    return j.withColumn("duplicate_density", F.when(F.col("files_scanned") > 0, F.round(F.col("affected_files") / F.col("files_scanned"), 4)).otherwise(0.0))


def by_weight(rows: DataFrame, *names: str) -> DataFrame:
    """Folders, or pairs of folders, with most clusters first, then most lines, then by name."""
    return rows.orderBy(F.desc("duplicate_clusters"), F.desc("duplicate_lines"), *names)


def low_by_type(clusters: DataFrame) -> DataFrame:
    """(type, clusters): clusters of low priority by type."""
    return clusters.where("priority = 'low'").groupBy(F.col("duplicate_type").alias("type")).agg(F.count(F.lit(1)).alias("clusters"))


def to_detail(clusters: DataFrame, top_k: int, others: int = 5) -> DataFrame:
    """Clusters that a report shows whole: those of high priority, or else the first of medium priority, top_k at most."""
    high = clusters.where("priority = 'high'")
    none = high.limit(1).groupBy().agg((F.count(F.lit(1)) == 0).alias("none"))
    some = clusters.where("priority = 'medium'").orderBy(F.desc("score"), "cluster_id").limit(others).join(F.broadcast(none), F.col("none")).drop("none")
    return high.unionByName(some).orderBy(F.desc("score"), "cluster_id").limit(top_k)


def folder_pairs(members: DataFrame) -> DataFrame:
    """Pairs of folders, a folder with itself included, that share clusters. members: (folder, cluster, line_count, similarity)."""
    per = members.groupBy("cluster", "folder").agg(F.sum("line_count").alias("lines"), F.max("similarity").alias("similarity"))
    a, b = per.select("cluster", F.col("folder").alias("left"), F.col("lines").alias("la"), "similarity"), per.select("cluster", F.col("folder").alias("right"), F.col("lines").alias("lb"))
    j = a.join(b, "cluster").where("left <= right").withColumn("lines", F.when(F.col("left") == F.col("right"), F.col("la")).otherwise(F.col("la") + F.col("lb")))
    g = j.groupBy("left", "right").agg(F.count(F.lit(1)).alias("duplicate_clusters"), F.sum("lines").alias("duplicate_lines"), F.round(F.max("similarity"), 4).alias("max_similarity"))
    return g.withColumn("scope", F.when(F.col("left") == F.col("right"), "internal").otherwise("cross_directory"))


# What a warning says and advises; {n} is a count of the run.
WARNINGS = {
    "EXACT_MODE_SKIPPED_NEAR_DUPLICATES": ("当前为 exact 快速模式，仅检测完全重复和规范化完全重复，未执行近重复分析。", "如需分析近重复函数、近重复配置或复制粘贴式逻辑，请使用 --mode standard 或 --mode deep。"),
    "NO_SUPPORTED_FILES": ("没有扫描到受支持的源码或配置文件。", "先检查 run.include、coverage.unsupported_files_by_extension 和支持的扩展名，再判断是否需要重跑。"),
    "LOW_SUPPORTED_FILE_COUNT": ("本次只扫描到 {n} 个受支持文件。", "检查 coverage.supported_files_by_directory；必要时扩大 --include 或增加受支持扩展名后重跑。"),
    "NO_DUPLICATES_WITH_MANY_UNSUPPORTED_FILES": ("没有发现重复簇，但有 {n} 个文件因扩展名不受支持而跳过。", "在把零结果视为完整结论前，先复核 coverage.unsupported_files_by_extension。"),
    "MAX_COMPARISONS_REACHED": ("近重复候选尚未全部比对完就达到了比较上限。", "提高 --max-comparisons，或缩小 --include 范围后重跑。"),
    "DEEP_MODE_MAX_COMPARISONS_REACHED": ("深度模式仍达到近重复比较上限，结果可能不完整。", "缩小 --include 范围，或提高 --max-comparisons 后重跑。"),
    "ONLY_LOW_PRIORITY_PATHS_SCANNED": ("本次只扫描到 tests、fixtures 或 examples 等低优先级路径。", "如果目标是生产代码去重，请 include 生产源码目录后重跑。"),
    "MANY_IGNORED_FILES": ("有 {n} 个文件因排除规则、大小限制、二进制检测或路径缺失被忽略。", "复核 ignored.files；必要时调整 --exclude 或 --max-file-size-kb 后重跑。"),
}


def quality_warnings(stats: DataFrame, mode: str) -> DataFrame:
    """(code, message, suggested_action) of a run, from rows (files, clusters, unsupported, ignored, capped, only_tests); other columns of stats stay."""
    c = F.col
    rules = {
        "EXACT_MODE_SKIPPED_NEAR_DUPLICATES": (F.lit(mode == "exact"), F.lit(0)),
        "NO_SUPPORTED_FILES": (c("files") == 0, F.lit(0)),
        "LOW_SUPPORTED_FILE_COUNT": ((c("files") > 0) & (c("files") < 3), c("files")),
        "NO_DUPLICATES_WITH_MANY_UNSUPPORTED_FILES": ((c("clusters") == 0) & (c("unsupported") >= F.greatest(F.lit(10), c("files") * 3)), c("unsupported")),
        "MAX_COMPARISONS_REACHED": (c("capped"), F.lit(0)),
        "DEEP_MODE_MAX_COMPARISONS_REACHED": (c("capped") & F.lit(mode == "deep"), F.lit(0)),
        "ONLY_LOW_PRIORITY_PATHS_SCANNED": ((c("files") > 0) & c("only_tests"), F.lit(0)),
        "MANY_IGNORED_FILES": (c("ignored") >= F.greatest(F.lit(10), c("files") * 2), c("ignored")),
    }
    said = [F.when(w, F.struct(F.lit(k).alias("code"), F.replace(F.lit(WARNINGS[k][0]), F.lit("{n}"), n.cast("string")).alias("message"), F.lit(WARNINGS[k][1]).alias("suggested_action"))) for k, (w, n) in rules.items()]
    known = ("files", "clusters", "unsupported", "ignored", "capped", "only_tests")
    return stats.select(*[x for x in stats.columns if x not in known], F.explode(F.array_compact(F.array(*said))).alias("w")).select("*", "w.*").drop("w")
