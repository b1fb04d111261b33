"""What a reviewer of a code cluster has to look at: flags, checks, doubts, a plan; all from aggregates of its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.text import directory, is_test_path, role_hint
from twinfold.operators.clusters import action_for, risk

# Names of checks, and sentences by type of duplicate or action.
ALWAYS_CHECK = ["callers", "imports", "module_boundary", "references", "semantic_equivalence", "tests"]
CONFIG_CHECK = ["deployment_overrides", "environment_differences", "load_order"]
FILE_CHECK = ["file_ownership", "published_path"]
NOT_CHECKED = ["semantic_equivalence", "runtime_behavior", "import_reference_callers", "public_api_impact", "test_coverage", "security_permission_deployment_impact"]
REASONS = {
    "file_exact": "文件内容完全相同，但删除前必须确认引用关系和所有权。",
    "file_normalized_exact": "规范化后相同，但注释或格式可能包含意图。",
    "symbol_exact": "符号级实现相同，可考虑抽取共享实现。",
    "symbol_near": "符号级近重复，可能存在边界或领域差异。",
    "window_near": "连续逻辑片段相似，可评估是否抽辅助逻辑。",
    "config_duplicate": "配置或脚本片段重复，但环境差异需要人工确认。",
}
DOUBTS = {
    "near": "近重复只能说明文本/结构相似，不能证明语义等价。",
    "config": "配置重复可能代表不同环境、部署目标或覆盖顺序。",
    "cross": "跨目录或跨模块重复可能存在业务域边界。",
    "minor": "测试、fixture 或 example 中的重复通常优先级较低。",
    "file": "文件级重复仍需检查导入、引用、发布路径和所有权。",
    "none": "未发现明显误报信号，但仍需源码复核。",
}
BLOCKERS = {
    "extract_shared_function": "合并前仍需人工确认调用方和行为契约。",
    "consolidate_config": "配置重复可能代表不同部署环境，不能自动合并。",
    "review_canonical_candidate": "即使文件完全相同，也不能直接删除；必须先确认引用关系和发布影响。",
    "extract_helper": "窗口近重复不能证明语义等价。",
    "manual_review_required": "近重复或跨目录重复需要人工审核。",
}
HIGH_RISK = "风险为 high，禁止直接合并。"
STEPS = {
    "extract_shared_function": ["确认输入输出、副作用和边界条件一致。", "抽取公共实现到 `{target}`。", "原函数保留领域入口并调用共享实现。", "补充或保留回归测试。"],
    "consolidate_config": ["确认重复配置不是环境分叉。", "抽公共配置模板。", "环境差异保留为 override。", "验证最终展开配置。"],
    "review_canonical_candidate": ["确认文件引用、调用方、发布路径和所有权。", "选择候选 canonical 文件。", "拟定引用更新或归档方案。", "运行测试和构建。"],
    "extract_helper": ["确认重复窗口不是偶然流程相似。", "抽取最小公共辅助逻辑到 `{target}`。", "保留原模块差异逻辑。", "运行相关测试。"],
    "manual_review_required": ["逐行比较相同逻辑和差异逻辑。", "只抽取确认等价的最小公共逻辑。", "保留领域差异。", "补充差异测试。"],
}
VALIDATION = ["运行相关单元测试和集成测试。", "检查导入、引用和调用方。", "检查公共 API、配置加载顺序和调用方行为。"]
SIMILAR = "脚本已提供文本、hash 或 Jaccard 相似度证据。"
UNKNOWN = ["脚本不会判断业务语义等价。", "需要执行者读取源码确认输入输出、副作用、异常处理、边界条件和领域差异。"]
REVIEW_DIMENSIONS = ["输入输出契约", "副作用和状态修改", "异常处理", "权限/安全/支付/部署影响", "配置环境差异", "测试覆盖"]
CALL_CHECKS = [
    ("导入/引用检查", "执行者需要使用搜索或语言工具检查引用。"),
    ("调用方影响", "执行者需要确认调用方参数、返回值和异常契约。"),
    ("公共 API 影响", "涉及导出符号、路由、命令行入口、配置入口时需谨慎。"),
    ("测试覆盖", "执行者需要定位并运行相关测试。"),
]
READ_FILES = "读取重复簇涉及文件：%s。"
AGENT_STEPS = ["搜索符号名、文件路径和导入路径，确认导入、引用和调用方。", "比较输入输出、副作用、异常处理、权限/配置/环境差异。", "检查是否有相关单元测试、集成测试或配置验证命令。"]
CONFIG_STEP = "确认配置重复是否代表不同环境或部署覆盖规则。"
RISKY_STEP = "若进入补丁/重构阶段，先向用户确认最小改动计划。"
#: Paths that the first agent step names.
SHOWN_PATHS = 4


def _kept(*some: Column) -> Column:
    return F.array_compact(F.array(*some))


def _words(names: list[str]) -> Column:
    return F.array(*map(F.lit, names))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def review(members: DataFrame) -> DataFrame:
    """(cluster, flags, must_check, not_checked, doubts, reason, action, target, blockers, risk).

    members: (cluster, duplicate_type, path, ext, kind, language). One partial aggregate
    per cluster; its paths are rows of their own (``paths_to_review``).
    """
    role = role_hint(F.col("path"), F.col("ext"))
    has = lambda *names: F.coalesce(F.bool_or(role.isin(*names)), F.lit(False))
    g = members.groupBy("cluster", "duplicate_type").agg(
        (F.min(directory(F.col("path"))) != F.max(directory(F.col("path")))).alias("cross"), has("config").alias("config"), has("test", "fixture", "example").alias("minor"), has("production").alias("prod"),
        F.bool_or(F.col("kind") == "file").alias("file"), F.bool_and(is_test_path(F.col("path"))).alias("test"), F.min("language").alias("language"),
    )
    c, kind = F.col, F.col("duplicate_type")
    near, config = kind.isin("symbol_near", "window_near"), kind == "config_duplicate"
    flags = _kept(kind, F.when(near, "near_duplicate"), F.when(c("cross"), "cross_directory"), F.when(config | c("config"), "config_candidate"), F.when(c("minor"), "low_priority_path"), F.when(c("prod"), "production_path"), F.when(c("file"), "file_level_candidate"))
    none = F.array().cast("array<string>")
    checks = F.concat(_words(ALWAYS_CHECK), F.when(config | c("config"), _words(CONFIG_CHECK)).otherwise(none), F.when(c("file"), _words(FILE_CHECK)).otherwise(none))
    doubts = _kept(F.when(near, DOUBTS["near"]), F.when(config, DOUBTS["config"]), F.when(c("cross"), DOUBTS["cross"]), F.when(c("minor"), DOUBTS["minor"]), F.when(c("file"), DOUBTS["file"]))
    out = g.withColumn("action", action_for(kind, c("test"))).withColumn("risk", risk(kind, c("cross")))
    target = (
        F.when(c("action") == "extract_shared_function", F.concat(F.lit("src/shared/"), "language", F.lit("_shared")))
        .when(c("action") == "extract_helper", F.concat(F.lit("src/shared/"), "language", F.lit("_helper")))
        .when(c("action") == "consolidate_config", "shared config/template reviewed by maintainers")
        .when(c("action") == "review_canonical_candidate", "canonical candidate after import/reference review")
    )
    blockers = _kept(F.coalesce(_lookup(BLOCKERS, c("action")), F.lit(BLOCKERS["manual_review_required"])), F.when(c("risk") == "high", HIGH_RISK))
    return out.select(
        "cluster", F.sort_array(F.array_distinct(flags)).alias("flags"), F.sort_array(checks).alias("must_check"), _words(NOT_CHECKED).alias("not_checked"), F.when(F.size(doubts) > 0, doubts).otherwise(F.array(F.lit(DOUBTS["none"]))).alias("doubts"),
        F.coalesce(_lookup(REASONS, kind), F.lit("重复证据需要人工审核。")).alias("reason"), "action", target.alias("target"), blockers.alias("blockers"), "risk",
    )


def paths_to_review(members: DataFrame) -> DataFrame:
    """(cluster, path): every path of a cluster once, as rows, for a cluster may have any number."""
    return members.select("cluster", "path").distinct()


def merge_plans(reviewed: DataFrame) -> DataFrame:
    """(cluster, target, steps, blockers, validation, requires_manual_review, dry_run_only) of ``review`` rows."""
    steps = F.create_map(*[x for k, some in STEPS.items() for x in (F.lit(k), _words(some))])[F.col("action")]
    named = F.transform(F.coalesce(steps, _words(STEPS["manual_review_required"])), lambda x: F.replace(x, F.lit("{target}"), F.coalesce("target", F.lit(""))))
    return reviewed.select("cluster", "target", named.alias("steps"), "blockers", _words(VALIDATION).alias("validation"), F.lit(True).alias("requires_manual_review"), F.lit(True).alias("dry_run_only"))


def first_paths(members: DataFrame, most: int = SHOWN_PATHS) -> DataFrame:
    """(cluster, paths): the first paths of each cluster in order, by ranks and not by gathering all."""
    ranked = members.select("cluster", "path").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("path"))).where(F.col("rank") <= most)
    return ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def notes(members: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(cluster, difference, calls, agent_steps): what is alike and unknown, which calls nobody has checked, and what to do next."""
    facts = members.groupBy("cluster", "duplicate_type").agg((F.min(directory(F.col("path"))) != F.max(directory(F.col("path")))).alias("cross"))
    rows = reviewed.join(facts, "cluster").join(first_paths(members), "cluster")
    difference = F.struct(F.lit("needs_agent_source_review").alias("status"), F.array(F.col("reason"), F.lit(SIMILAR)).alias("similarities"), _words(UNKNOWN).alias("differences_or_unknowns"), _words(REVIEW_DIMENSIONS).alias("review_dimensions"), F.col("cross").alias("cross_directory"))
    checks = F.array(*[F.struct(F.lit(item).alias("item"), F.lit("not_checked_by_script").alias("result"), F.lit(note).alias("note")) for item, note in CALL_CHECKS])
    calls = F.struct(F.lit("not_checked_by_script").alias("status"), checks.alias("checks"))
    steps = _kept(F.format_string(READ_FILES, F.array_join("paths", ", ")), *map(F.lit, AGENT_STEPS), F.when(F.col("duplicate_type") == "config_duplicate", CONFIG_STEP), F.when(F.col("risk").isin("medium", "high"), RISKY_STEP))
    return rows.select("cluster", difference.alias("difference"), calls.alias("calls"), steps.alias("agent_steps"))
