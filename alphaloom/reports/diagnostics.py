"""Diagnosis of errors, models and media tools by ordered rules, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What messages hold, by what they mean.
INPUT_INVALID = ("input not found", "cannot open video", "cannot open image", "cannot read first frame", "no supported images found", "failed to load any frames", "unsupported input", "unsupported image format")
UNWRITABLE = ("permission denied", "access is denied", "read-only file system")
OUT_OF_MEMORY = ("cuda out of memory", "outofmemory")
#: Title, summary and actions of each code.
TEXTS = {
    "PROGRESS_CALLBACK_FAILED": ("进度回调失败", "进度更新通道发生异常，当前任务已停止。", ("检查 UI/队列进度回调实现", "查看日志输出")),
    "INPUT_INVALID": ("输入素材无效", "输入文件不存在、无法读取，或素材格式不受支持。", ("检查输入路径", "确认素材文件存在且格式受支持", "重新选择输入素材")),
    "OUTPUT_DIR_UNWRITABLE": ("输出目录不可写", "当前输出目录没有写入权限，无法保存处理结果。", ("更换输出目录", "检查目录权限", "关闭占用目标文件的程序")),
    "GPU_OUT_OF_MEMORY": ("GPU 显存不足", "当前任务执行时显存不足，无法继续处理。", ("关闭其他 GPU 程序", "降低质量或分辨率", "切换到更轻量模型")),
    "UNKNOWN_PROCESSING_ERROR": ("处理失败", "处理任务时发生未分类错误。", ("查看日志输出", "检查输入素材和模型状态")),
    "FFMPEG_NOT_FOUND": ("未找到 FFmpeg", "未检测到可用的 ffmpeg/ffprobe 工具链。", ("运行 configure_ffmpeg.ps1", "检查 PATH 中的 ffmpeg 安装")),
    "FFPROBE_NOT_FOUND": ("FFprobe 缺失", "已找到 ffmpeg，但缺少 ffprobe，当前工具链不完整。", ("下载完整 FFmpeg 套件", "重新运行 FFmpeg bootstrap")),
}
MODEL_ACTIONS = ("检查模型目录", "确认依赖是否已安装")
#: Fixed value: what a report without items says.
NOTHING = "未检测到阻断问题。"


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def exception_code(kind: Column, messages: Column) -> Column:
    """The code of an error: its type's name and the messages of its chain, joined by ' | '."""
    low = F.lower(F.array_join(F.filter(messages, lambda m: m != ""), " | "))
    return (F.when(kind == "ProgressCallbackError", "PROGRESS_CALLBACK_FAILED").when((kind == "FileNotFoundError") | _any(low, INPUT_INVALID), "INPUT_INVALID")
            .when((kind == "PermissionError") | _any(low, UNWRITABLE), "OUTPUT_DIR_UNWRITABLE").when(_any(low, OUT_OF_MEMORY), "GPU_OUT_OF_MEMORY").otherwise("UNKNOWN_PROCESSING_ERROR"))


def media_code(ffmpeg: Column, ffprobe: Column) -> Column:
    """The code of missing media tools, null if both are there."""
    return F.when(ffmpeg.isNull(), "FFMPEG_NOT_FOUND").when(ffprobe.isNull(), "FFPROBE_NOT_FOUND")


def text_of(code: Column, part: int) -> Column:
    """Title (0), summary (1) or actions (2) of a code."""
    values = {k: (F.array(*[F.lit(a) for a in v[part]]) if part == 2 else F.lit(v[part])) for k, v in TEXTS.items()}
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def model_items(status: DataFrame) -> DataFrame:
    """Items of models that aren't available: status with (model_key, display_name, available, reason, auto_download)."""
    reason, name = F.coalesce("reason", F.lit("")), F.coalesce("display_name", "model_key")
    code = F.when(reason.contains("不可导入"), "MODEL_RUNTIME_IMPORT_FAILED").when(reason.contains("仅支持 CUDA"), "MODEL_GPU_REQUIRED").otherwise("MODEL_MISSING")
    title = F.when(code == "MODEL_RUNTIME_IMPORT_FAILED", F.concat(name, F.lit(" runtime 不可用"))).when(code == "MODEL_GPU_REQUIRED", F.concat(name, F.lit(" 需要 CUDA"))).otherwise(F.concat(name, F.lit(" 不可用")))
    told = F.when(code == "MODEL_RUNTIME_IMPORT_FAILED", F.concat(name, F.lit(" 已安装，但运行时依赖无法导入。"))).when(code == "MODEL_GPU_REQUIRED", F.concat(name, F.lit(" 仅支持 CUDA GPU。"))).otherwise(F.concat(name, F.lit(" 当前不可用，通常是模型文件缺失。")))
    auto = F.coalesce("auto_download", F.lit(False))
    other = [c for c in status.columns if c not in ("display_name", "available", "reason", "auto_download")]
    return status.where(~F.coalesce("available", F.lit(False))).select(*other, code.alias("code"), F.when(auto, "warning").otherwise("error").alias("severity"), title.alias("title"), told.alias("summary"),
                                                                       F.array(*[F.lit(a) for a in MODEL_ACTIONS]).alias("actions"), (~auto).alias("blocking"))


def counts(items: DataFrame, *keys: str) -> DataFrame:
    """Blocking, warning and info items by key, and whether nothing blocks."""
    return items.groupBy(*keys).agg(F.count_if("blocking").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count_if(F.col("severity") == "info").alias("info"), F.every(~F.col("blocking")).alias("ok"))


def item_text(severity: Column, title: Column, summary: Column, actions: Column) -> Column:
    """An item's lines: at most three actions."""
    head = F.concat(F.lit("["), severity, F.lit("] "), title, F.lit(": "), summary)
    return F.array_join(F.concat(F.array(head), F.transform(F.slice(actions, 1, 3), lambda a: F.concat(F.lit("- "), a))), "\n")


def user_text(items: DataFrame, *keys: str, order: str) -> DataFrame:
    """One text a key: its items in order, each (code, summary) once."""
    from pyspark.sql import Window

    first = items.withColumn("k_", F.row_number().over(Window.partitionBy(*keys, "code", "summary").orderBy(order))).where("k_ = 1")
    lines = first.withColumn("t_", item_text(F.col("severity"), F.col("title"), F.col("summary"), F.col("actions")))
    joined = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t_"))), lambda x: x["t_"]), "\n").alias("text"))
    return joined.withColumn("text", F.when(F.col("text") == "", NOTHING).otherwise(F.col("text")))
