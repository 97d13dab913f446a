"""Source trees as tables: listing, module names, notebooks, distributions."""

from __future__ import annotations

import glob
import json
import os
import sys
import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.names import canonical_dist

FILES = "path string, content string"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, sha) of all .py, .pyi and .ipynb files below root."""
    # The names are matched before any content is read.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,pyi,ipynb}").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha"))


def from_dict(spark: SparkSession, files: dict[str, str], root: str = "/w") -> DataFrame:
    rows = [(f"{root}/{k}", v) for k, v in files.items()]
    return spark.createDataFrame(rows, FILES).withColumn("sha", F.sha2("content", 256))


def search_paths(root: str, venv: str | None = None) -> list[str]:
    """The root, and the folders that the .pth files of a virtual environment name."""
    out = [root.rstrip("/")]
    for base, _, names in os.walk(os.path.join(venv, "lib")) if venv else ():
        if base.endswith("site-packages"):
            for name in sorted(names):
                if name.endswith(".pth"):
                    with open(os.path.join(base, name)) as f:
                        out += [x.strip().rstrip("/") for x in f if x.strip().startswith("/")]
    return list(dict.fromkeys(out))


def named_modules(files: DataFrame, paths: list[str]) -> DataFrame:
    """files with module (the dotted name below the deepest search path above the file), package and stub."""
    roots = F.array(*[F.lit(p.rstrip("/")) for p in paths])
    held = F.filter(roots, lambda r: F.col("path").startswith(F.concat(r, F.lit("/"))))
    deepest = F.element_at(F.array_sort(F.transform(held, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), 1)["r"]
    rel = F.regexp_replace(F.expr("substr(path, length(_root) + 2)"), r"[.](py|pyi|ipynb)$", "")
    d = files.where(F.size(held) > 0).withColumn("_root", deepest).withColumn("_rel", rel)
    package = F.col("_rel").rlike("(^|/)__init__$")
    name = F.regexp_replace(F.regexp_replace("_rel", "/?__init__$", ""), "/", ".")
    return d.withColumn("package", package).withColumn("module", F.when(name == "", F.element_at(F.split("_root", "/"), -1)).otherwise(name)).withColumn("stub", F.col("path").endswith(".pyi")).drop("_root", "_rel")


NOTEBOOK = T.StructType([T.StructField("cells", T.ArrayType(T.StructType([T.StructField("cell_type", T.StringType()), T.StructField("source", T.StringType())])))])


def python_text(files: DataFrame) -> DataFrame:
    """files with the code of notebooks in place of their JSON; lines of magics become pass."""
    cells = F.filter(F.from_json("content", NOTEBOOK)["cells"], lambda c: c["cell_type"] == "code")
    lines = F.transform(cells, lambda c: F.when(c["source"].startswith("["), F.concat_ws("", F.from_json(c["source"], "array<string>"))).otherwise(c["source"]))
    code = F.regexp_replace(F.concat_ws("\n", lines), r"(?m)^([ \t]*)[%!?].*$", "$1pass")
    book = F.col("path").endswith(".ipynb")
    return files.withColumn("content", F.when(book, code).otherwise(F.col("content"))).withColumn("notebook", book)


def stub_pairs(files: DataFrame) -> DataFrame:
    """(stub, twin): .pyi files with the .py file of their stem, null where there is none."""
    stem = F.regexp_replace("path", "[.]pyi?$", "")
    stubs = files.where(F.col("path").endswith(".pyi")).select(F.col("path").alias("stub"), stem.alias("stem"))
    return stubs.join(files.where(F.col("path").endswith(".py")).select(F.col("path").alias("twin"), stem.alias("stem")), "stem", "left").select("stub", "twin")


def distributions(spark: SparkSession, site_packages: str) -> DataFrame:
    """(top, dist): the top-level modules that installed distributions record."""
    records = spark.read.text(f"{site_packages}/*.dist-info/RECORD").select(F.regexp_extract(F.input_file_name(), r"([^/]+)[.]dist-info/RECORD$", 1).alias("folder"), F.split("value", ",")[0].alias("file"))
    names = spark.read.text(f"{site_packages}/*.dist-info/METADATA").where("value LIKE 'Name: %'").select(F.regexp_extract(F.input_file_name(), r"([^/]+)[.]dist-info/METADATA$", 1).alias("folder"), canonical_dist(F.expr("substr(value, 7)")).alias("dist"))
    top = F.regexp_replace(F.split("file", "/")[0], r"[.]py$", "")
    return records.where(F.col("file").endswith(".py")).join(names, "folder").groupBy(top.alias("top")).agg(F.min("dist").alias("dist"))


def installed(spark: SparkSession, venv: str | None) -> DataFrame | None:
    """(top, dist) of all distributions in a virtual environment; None without any."""
    found = [x for x in glob.glob(os.path.join(venv, "lib", "*", "site-packages")) if glob.glob(os.path.join(x, "*.dist-info", "RECORD"))] if venv else []
    if not found:
        return None
    return reduce(DataFrame.unionByName, [distributions(spark, x) for x in found]).groupBy("top").agg(F.min("dist").alias("dist"))


def project_scripts(root: str) -> list[str]:
    """Dotted names of [project.scripts] in pyproject.toml; none without the file."""
    try:
        with open(os.path.join(root, "pyproject.toml"), "rb") as f:
            found = tomllib.load(f).get("project", {}).get("scripts", {})
    except FileNotFoundError:
        return []
    return [".".join(x for x in v.split(":", 1) if x) for v in found.values()]


def stdlib() -> list[str]:
    return sorted(sys.stdlib_module_names)


def events_between(old: DataFrame, new: DataFrame) -> DataFrame:
    from ..streaming.incremental import dirty_files

    return dirty_files(old.select("path", "sha"), new.select("path", "sha"))



def report_json(rows, dead) -> str:
    """The JSON report of totals by kind and dead symbols."""
    return json.dumps({"summary": {r["kind"]: {"total": r["total"], "dead": r["dead"]} for r in rows}, "dead_symbols": [{"fqname": r["fqname"], "type": r["kind"], "path": r["path"]} for r in dead]}, indent=2)
