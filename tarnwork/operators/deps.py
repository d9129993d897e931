"""Import dependencies of Python sources, and the cards made of them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

IMPORTS = "file_id string, pos int, kind string, level int, module string, error string"


def modules_of(src: str) -> list[tuple[str, int, str]]:
    """(kind, level, module) of every import in a source, nested ones too; raises if it can't be parsed.

    ``from M import ...`` gives M once, without its dots; ``from . import x`` gives nothing; ``import a, b as c`` gives a and b.
    """
    found = []
    for node in sorted((n for n in ast.walk(ast.parse(src)) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Import):
            found += [("import", 0, a.name) for a in node.names]
        elif node.module:
            found.append(("from", node.level, node.module))
    return found


def extract_imports(files: DataFrame) -> DataFrame:
    """files (file_id, src) as (file_id, pos, kind, level, module, error), in source order, duplicates kept.

    A file without imports, or with a null source, keeps one row with a null module. A file that can't be parsed has one row
    that says why, and the job goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for file_id, src in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = [(file_id, i, *m, None) for i, m in enumerate(modules_of(src or ""))]
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    found = [(file_id, None, None, None, None, type(e).__name__)]
                rows += found or [(file_id, None, None, None, None, None)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in IMPORTS.split(", ")])

    ship(files.sparkSession)
    return files.select("file_id", "src").mapInArrow(run, IMPORTS)


def cards_of(imports: DataFrame) -> DataFrame:
    """(file_id, modules, card): a card's text names the file and what it imports, in order. A file without imports, or one that can't be parsed, has a card that only names it; of a null file the card is null."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("module").isNotNull(), F.struct("pos", "module"))))
    listed = imports.groupBy("file_id").agg(F.transform(ordered, lambda s: s["module"]).alias("modules"))
    text = F.concat(F.lit("File "), F.col("file_id"), F.when(F.size("modules") > 0, F.concat(F.lit(" Imports "), F.concat_ws(" ", "modules"))).otherwise(""))
    return listed.withColumn("card", text)


def holds(modules: Column, *expected: str) -> Column:
    """Whether a card isn't empty and has all the expected modules; null for null modules."""
    out = F.size(modules) > 0
    for m in expected:
        out = out & F.array_contains(modules, m)
    return out


def extract_links(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) as (page_id, pos, href): what a page refers to, in order, repeats included.

    Only lower-case, double-quoted ``href`` counts. Defined cases: pages without links, empty or null ones included, give no row.
    """
    return pages.select("page_id", F.posexplode(F.expr("""regexp_extract_all(html, 'href="([^"]*)"', 1)""")).alias("pos", "href"))


def register_imports(spark: SparkSession, name: str = "imports_of") -> None:
    """Makes import extraction a table function of SQL: ``imports_of(src)`` gives (pos, kind, level, module, error), nothing for a source without imports.

    With ``LEFT JOIN LATERAL imports_of(src) i ON true`` a file without imports keeps its row.
    """

    @F.udtf(returnType="pos int, kind string, level int, module string, error string")
    class ImportsOf:
        def eval(self, src: str):
            try:
                for i, (kind, level, module) in enumerate(modules_of(src or "")):
                    yield i, kind, level, module, None
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                yield None, None, None, None, type(e).__name__

    ship(spark)
    spark.udtf.register(name, ImportsOf)
