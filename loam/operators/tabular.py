"""Small tabular operators: rates, sizes, de-duplication of result rows, chat links, file categories and filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import in_units

# Suffixes of files read as text, names without a suffix among them.
TEXT_SUFFIXES = (
    ".txt", ".text", ".log", ".md", ".markdown",
    ".json", ".xml", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".csv", ".tsv", ".psv",
    ".py", ".pyx", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".html", ".htm", ".css", ".scss", ".sass", ".less",
    ".c", ".cpp", ".cxx", ".h", ".hpp", ".java", ".kt", ".ktm", ".kts", ".cs", ".fs", ".vb", ".go", ".rs", ".rb", ".erb",
    ".php", ".swift", ".scala", ".groovy", ".pl", ".pm", ".sh", ".bash", ".zsh", ".lua", ".r", ".R", ".m", ".sql",
    ".rst", ".tex", ".latex", ".adoc", ".asciidoc",
    ".properties", ".third_party", ".gitignore", ".dockerignore", ".gradle", ".cmake", "CMakeLists.txt", "Makefile", ".mk", "Dockerfile", ".htaccess",
    ".svg", ".graphql", ".gql", ".proto", ".plist", ".wsdl", ".xsd",
    "package.json", "Gemfile", "requirements.txt", "Cargo.toml", "pom.xml",
    "Jenkinsfile", "Vagrantfile", ".babelrc", ".eslintrc",
)
# Quantisation names that a result row may have.
QUANT_TYPES = ("F16", "Q8_0", "Q4_0", "IQ4_XS", "Q4_K_M", "Q4_K_S", "Q6_K", "Q5_K_M", "Q5_K_S", "IQ4_NL", "Q3_K_L", "Q3_K_M", "Q3_K_S", "Q2_K")
# Patterns of the source files that are analysed, and of those that are not: tests and compiled files, then what isn't project code.
SOURCE_INCLUDES = (r"\.py$",)
SOURCE_EXCLUDES = (r"test_", r"_test", r"\.pyc$", r"__pycache__", r"/\.", r"__init__\.py$")
OTHER_EXCLUDES = (
    r"site-packages", r"env/", r"venv/", r"\.venv/", r"conda", r"anaconda", r"miniconda", r"\.eggs",
    r"build/", r"dist/", r"\.egg-info",
    r"python\d+\.\d+", r"lib/python\d+\.\d+", r"Lib/site-packages", r"lib64/python\d+\.\d+",
    r"/usr/lib", r"/usr/local/lib", r"/opt/", r"\.tox/", r"\.mypy_cache", r"\.pytest_cache",
)
# The measures of a benchmark row.
MEASURES = ("ttq", "size", "percent", "runs", "load", "encode", "prompt", "response", "quality")


def success_rate(rows: DataFrame, ok: Column) -> DataFrame:
    """(total, succeeded, rate); the rate of no rows is 0."""
    counts = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"))
    return counts.withColumn("rate", F.round(F.coalesce(F.try_divide("succeeded", "total"), F.lit(0.0)), 9))


def size_percent(rows: DataFrame) -> DataFrame:
    """(key, size_text in GB, percent of the base size); no percent without a base."""
    percent = F.format_string("%.2f%%", F.round(F.lit(100.0) * F.col("size") / F.nullif("base", F.lit(0)), 2))
    return rows.select("key", in_units(F.col("size"), 1 << 30, "GB").alias("size_text"), F.when(F.col("base") != 0, percent).alias("percent"))


def keep_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of each key with the largest seq; rows combine before they are dealt."""
    rest = [c for c in rows.columns if c not in keys and c != seq]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, seq), seq).alias("r")).select(*keys, "r.*")


def benchmark_rows(rows: DataFrame) -> DataFrame:
    """Result rows (path, type, MEASURES as text) of rows (path, type, failed and measures, where there are any): what was not measured is N/A, and all of a failed row is ERROR."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c in rows.columns else F.lit("N/A")
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in rows.columns else F.lit(False)
    return rows.select("path", "type", *(F.when(failed, "ERROR").otherwise(told(c)).alias(c) for c in MEASURES))


def valid_quant(kind: Column) -> Column:
    return kind.isin(*QUANT_TYPES)


def chat_links(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, msg_id, parent_id, child_id, role): each message linked to the one before and after."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    msg = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select("conv_id", "turn", msg.alias("msg_id"), F.lag(msg).over(order).alias("parent_id"), F.lead(msg).over(order).alias("child_id"), "role")


def chat_filled(turns: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text): each with its parent, its child as a list, and its content; an answer that is missing is an empty one."""
    links = chat_links(turns.select("conv_id", "turn", "role"))
    said = links.join(turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("content")), ["conv_id", "turn"])
    return said.select("conv_id", "msg_id", "parent_id", F.filter(F.array("child_id"), lambda c: c.isNotNull()).alias("children"), "role", "content")


def chat_current(turns: DataFrame) -> DataFrame:
    """The message a conversation stands at, and its number of messages."""
    msg = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.groupBy("conv_id").agg(F.max_by(msg, "turn").alias("current_id"), F.count("*").alias("messages"))


def category(size: Column, threshold: int = 512 << 20) -> Column:
    return F.when(size > threshold, "large").otherwise("small")


def valid_file(path: Column, include: Iterable[str] = SOURCE_INCLUDES, exclude: Iterable[str] = SOURCE_EXCLUDES + OTHER_EXCLUDES) -> Column:
    """Whether a path matches none of the excluded patterns and, if there are any, one of the included."""
    ok = F.lit(True)
    for p in exclude:
        ok = ok & ~path.rlike(p)
    wanted = F.lit(False)
    for p in include:
        wanted = wanted | path.rlike(p)
    return ok & (wanted if list(include) else F.lit(True))


def supported(path: Column, suffixes: Iterable[str] = TEXT_SUFFIXES) -> Column:
    """Whether a path ends in one of the suffixes (case counts)."""
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | path.endswith(s)
    return ok


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2)) + F.pow(y1 - y2, F.lit(2)))


def throughput(rows: DataFrame, seconds: float) -> DataFrame:
    """(items, mb_per_s, items_per_s) of rows with a column bytes."""
    sums = rows.agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"))
    return sums.select("items", F.round(F.col("bytes") / float(1 << 20) / seconds, 6).alias("mb_per_s"), F.round(F.col("items") / seconds, 6).alias("items_per_s"))


def todo(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have not been processed yet."""
    return rows.join(done, keys, "left_anti")


def lookup(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(cache, keys, "left")
