"""S1 and path work: reading a source tree, tagging languages, selecting paths, splitting lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.severity import literal_map
from riskloom.functions.text import ascii_lower, base_name, contains_any, lines_of
from riskloom.sources.files import as_uri, list_files, read_texts
from riskloom.sources.tree import BUDGET

# Directory names that are not entered.
SKIP_DIRS = (".git", "target", "node_modules", ".next", "dist")

# Language per extension.
EXTENSIONS = {
    "python": ["py"], "javascript": ["js", "jsx", "ts", "tsx", "mjs", "cjs"], "go": ["go"],
    "rust": ["rs"], "java": ["java"], "csharp": ["cs"], "ruby": ["rb"], "php": ["php", "phtml"],
    "kotlin": ["kt", "kts"], "swift": ["swift"], "terraform": ["tf", "hcl"],
}
K8S_HINTS = ["k8s", "kube", "kubernetes", "deployment", "daemonset", "statefulset", "service",
             "ingress", "pod", "cronjob", "helm", "manifest"]
WORKFLOW_HINTS = [".github/workflows", ".github\\workflows"]


def language_of(path: Column) -> Column:
    """Language of a path, NULL when the file is not scanned."""
    lower = ascii_lower(path)
    name = base_name(lower)
    ext = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    by_extension = literal_map({e: lang for lang, group in EXTENSIONS.items() for e in group})
    return F.coalesce(
        F.when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile"),
        F.try_element_at(by_extension, ext),
        F.when(ext.isin("yaml", "yml"), F.when(
            contains_any(lower, WORKFLOW_HINTS), "github-actions").when(
            contains_any(lower, K8S_HINTS), "kubernetes")))


def with_language(df: DataFrame, path: str = "path") -> DataFrame:
    """Tag and keep the files that are scanned."""
    return df.withColumn("language", language_of(F.col(path))).where(F.col("language").isNotNull())


def relative_path(path: Column, root: str) -> Column:
    """Path below the root; the bare name when the root is the file itself."""
    prefix = root.rstrip("/") + "/"
    return (F.when(path == root, base_name(path))
            .when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1))
            .otherwise(path))


def with_relative_path(df: DataFrame, root: str, path: str = "path", out: str = "file") -> DataFrame:
    return df.withColumn(out, relative_path(F.col(path), root))


def exclude_paths(df: DataFrame, patterns: list[str], cols: tuple[str, ...] = ("path", "file")
                  ) -> DataFrame:
    """Drop paths that contain a pattern, ignoring case."""
    needles = [p.lower() for p in patterns if p]
    if not needles:
        return df
    present = [c for c in cols if c in df.columns]
    hit = F.lit(False)
    for c in present:
        hit = hit | contains_any(ascii_lower(c), needles)
    return df.where(~hit)


def explode_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with its number and its lower-cased twin."""
    keep = [c for c in df.columns if c != content]
    rows = df.select(*keep, F.posexplode(lines_of(content)).alias("_pos", "text"))
    return rows.select(*keep, (F.col("_pos") + 1).alias("line"), "text",
                       ascii_lower("text").alias("text_lower"))


def read_corpus(spark: SparkSession, root: str, budget: int = BUDGET) -> DataFrame:
    """The scanned files of a tree as ``path, file, language, content``. The listing is stored once;
    texts are read by every action."""
    uri = as_uri(root)
    files = with_language(list_files(spark, uri, SKIP_DIRS, budget))
    texts = read_texts(files, uri)
    base = uri.split("://", 1)[1].rstrip("/") if uri.startswith("file://") else uri
    return with_relative_path(texts.withColumn("language", language_of(F.col("path"))), base
                              ).select("path", "file", "language", "content")


def spread(corpus: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal a corpus that comes in fewer partitions than there are task slots. Text work is heavy
    per row, so one big input split must not hold back the rest; larger inputs stay as they are. With
    ``rows``, for small rows with much work each, there are so many partitions that none holds more:
    a split of stored bytes may hold millions of them. A table's rows are counted from its footers."""
    parts = corpus.sparkSession.sparkContext.defaultParallelism
    if rows:
        parts = max(parts, -(-corpus.count() // rows))
    return corpus.repartition(parts) if corpus.rdd.getNumPartitions() < parts else corpus


def only_changed(corpus: DataFrame, paths: DataFrame, target: str = ".", path: str = "path"
                 ) -> DataFrame:
    """The files named in a list of changed paths that lie under the target."""
    wanted = paths.select(F.trim(F.col("path")).alias(path)).where(F.col(path) != "")
    if target != ".":
        base = target.rstrip("/")
        wanted = wanted.where((F.col(path) == base) | F.col(path).startswith(base + "/"))
    return corpus.join(wanted.distinct(), path, "left_semi")
