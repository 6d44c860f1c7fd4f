"""Queries over file trees: documents and rules are written as files and read back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import views as v
from riskloom.session import apply_settings, scratch
from riskloom.sources.corpus import read_corpus
from riskloom.sources.files import as_uri
from riskloom.sources.rules import load_rules

QUERIES: dict = {}
SQL: dict = {}

#: One branch, 20 levels deep, holds all files.
_BRANCH = "/".join(f"level{i}" for i in range(20))


def written(files: DataFrame, root: str) -> int:
    """Write the files of ``path, content`` below a folder that all tasks share; their number."""
    uri = as_uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            done, made = 0, set()
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                full = f"{base}/{path}"
                folder = os.path.dirname(full)
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                with fs.open_output_stream(full) as out:
                    out.write(text.encode())
                done += 1
            yield pa.RecordBatch.from_pydict({"n": [done]})

    spread = files.select("path", "content").repartition(16)
    return spread.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def _name(suffix: str) -> str:
    return f"'{_BRANCH}/part' || CAST(doc_id % 40 AS STRING) || '/doc' || CAST(doc_id AS STRING) || {suffix}"


_SUFFIX = ("CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.test.ts' WHEN 3 THEN '.txt' "
           "ELSE '.rs' END")


def _read_tree(spark, sf) -> DataFrame:
    """The documents as files of a deep tree, among them vendored copies and files of no language."""
    apply_settings(spark)
    docs = v.load(spark, sf, "documents").where("text IS NOT NULL")
    root = scratch(spark)
    kept = docs.select(F.expr(_name(_SUFFIX)).alias("path"), F.col("text").alias("content"))
    vendored = docs.where("doc_id % 7 = 0").select(
        F.expr("'node_modules/' || " + _name("'.py'")).alias("path"), F.col("text").alias("content"))
    written(kept.unionByName(vendored), root)
    return read_corpus(spark, root, budget=16).select(
        "file", "language", F.octet_length("content").cast("long").alias("size"),
        F.sha2("content", 256).alias("digest"))


QUERIES["read_tree"] = _read_tree
SQL["read_tree"] = f"""SELECT {_name(_SUFFIX).replace('STRING', 'VARCHAR')} AS file,
  CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'javascript' ELSE 'rust' END AS language,
  strlen(text) AS size, sha256(text) AS digest
FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 3"""

# A rule file per part, with every section of the format, comments, quotes and both list forms.
_RULE_FILE = r"""
'# part ' || p_partkey || '\nid: "PART-' || p_partkey || '"\ntitle: ' || p_name || '\nseverity: '
|| CASE WHEN p_size % 5 = 0 THEN 'Critical' WHEN p_size % 5 = 1 THEN 'high' ELSE 'LOW' END
|| CASE WHEN p_size % 4 = 0 THEN '' ELSE '\nconfidence_that_ai_generated: 0.' || (p_size % 10) END
|| '\nlanguages: [Python, "go"]\ncwe: cwe-' || p_size || '\ntags: [' || lower(p_brand) || ', , x]'
|| '\npattern:\n' || CASE WHEN p_size % 2 = 0 THEN '  any:\n    - "' || p_type || '"\n    - ' || p_brand
   ELSE '  contains: [' || p_type || ', Eval(]\n  not:\n    - safe' END
|| '\nnegative_patterns:\n  - ' || p_brand || '\nfix:\n  suggestion: "Use ' || p_size || '"\n'
"""


def _rule_files(spark, sf) -> DataFrame:
    """S2, 2.14: rule files written from the parts, loaded and parsed."""
    apply_settings(spark)
    text = F.expr(_RULE_FILE)
    root = scratch(spark)
    written(v.load(spark, sf, "part").select(
        F.expr("'rules/set' || CAST(p_partkey % 9 AS STRING) || '/r' || CAST(p_partkey AS STRING) || "
               "CASE WHEN p_partkey % 2 = 0 THEN '.yaml' ELSE '.YML' END").alias("path"),
        text.alias("content")), root)
    return load_rules(spark, root).select(
        "id", "title", "severity", F.round(F.col("confidence").cast("double"), 4).alias("confidence"),
        F.array_join("languages", "|").alias("languages"), "category", "cwe_id",
        F.array_join("tags", "|").alias("tags"), F.array_join("pattern_any", "|").alias("pattern_any"),
        F.array_join("pattern_not", "|").alias("pattern_not"),
        F.array_join("negative_patterns", "|").alias("negative_patterns"), "fix_suggestion")


QUERIES["load_rules"] = _rule_files
SQL["load_rules"] = """SELECT 'PART-' || p_partkey AS id, p_name AS title,
  CASE WHEN p_size % 5 = 0 THEN 'critical' WHEN p_size % 5 = 1 THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN p_size % 4 = 0 THEN 0.7 ELSE round((p_size % 10) / 10.0, 4) END::DOUBLE AS confidence,
  'python|go' AS languages, NULL::VARCHAR AS category, 'CWE-' || p_size AS cwe_id,
  lower(p_brand) || '|x' AS tags,
  CASE WHEN p_size % 2 = 0 THEN lower(p_type) || '|' || lower(p_brand) ELSE lower(p_type) || '|eval(' END
    AS pattern_any,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE 'safe' END AS pattern_not, lower(p_brand) AS negative_patterns,
  'Use ' || p_size AS fix_suggestion
FROM part"""
