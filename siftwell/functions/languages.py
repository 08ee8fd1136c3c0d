"""Languages by file name, as a Python rule and as a small table to join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A language's id, its grammar (None for none) and its file extensions.
ROWS = [
    ("typescript", "typescript", [".ts", ".mts", ".cts"]),
    ("tsx", "tsx", [".tsx"]),
    ("javascript", "javascript", [".js", ".mjs", ".cjs"]),
    ("jsx", "javascript", [".jsx"]),
    ("python", "python", [".py", ".pyw"]),
    ("rust", "rust", [".rs"]),
    ("go", "go", [".go"]),
    ("java", "java", [".java"]),
    ("c", "c", [".c", ".h"]),
    ("cpp", "cpp", [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"]),
    ("csharp", "c_sharp", [".cs"]),
    ("ruby", "ruby", [".rb"]),
    ("php", "php", [".php"]),
    ("swift", "swift", [".swift"]),
    ("kotlin", "kotlin", [".kt", ".kts"]),
    ("scala", "scala", [".scala"]),
    ("html", "html", [".html", ".htm"]),
    ("css", "css", [".css"]),
    ("scss", None, [".scss"]),
    ("json", "json", [".json"]),
    ("yaml", None, [".yml", ".yaml"]),
    ("toml", None, [".toml"]),
    ("markdown", None, [".md", ".mdx"]),
    ("sql", None, [".sql"]),
    ("shell", "bash", [".sh", ".bash", ".zsh"]),
    ("dockerfile", None, [".dockerfile"]),
    ("lua", "lua", [".lua"]),
    ("zig", None, [".zig"]),
    ("elixir", None, [".ex", ".exs"]),
    ("haskell", None, [".hs"]),
]
BY_EXTENSION = {ext: (lang, grammar) for lang, grammar, exts in ROWS for ext in exts}
BY_NAME = {"Dockerfile": ("dockerfile", None), "Makefile": ("makefile", None)}
LANGUAGE_IDS = [row[0] for row in ROWS] + ["makefile"]

#: Symbol types that a search can ask for.
SYMBOL_TYPES = ("function", "class", "method", "interface", "type", "variable", "import", "module", "enum")


def language_of(path: str) -> tuple[str, str | None] | None:
    """(id, grammar) of a path: by whole file name, then by its last extension in lower case."""
    name = path.rsplit("/", 1)[-1]
    if name in BY_NAME:
        return BY_NAME[name]
    stem, dot, ext = name.rpartition(".")
    return BY_EXTENSION.get(f".{ext.lower()}") if dot else None


def language_table(spark: SparkSession) -> DataFrame:
    """(kind, key, language, grammar): 48 extensions and 2 file names."""
    rows = [("extension", k, *v) for k, v in BY_EXTENSION.items()] + [("name", k, *v) for k, v in BY_NAME.items()]
    return spark.createDataFrame(rows, "kind string, key string, language string, grammar string")


def with_language(files: DataFrame, path: str = "filePath") -> DataFrame:
    """files with language and grammar, both null for unsupported ones; the table of languages has a fixed size."""
    names = F.broadcast(language_table(files.sparkSession))
    name = F.substring_index(F.col(path), "/", -1)
    key: Column = F.when(name.isin(*BY_NAME), name).otherwise(F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1)))
    return files.withColumn("_key", key).join(names.select(F.col("key").alias("_key"), "language", "grammar"), "_key", "left").drop("_key")
