from tarnwork.operators import deps
from tarnwork.sources import sources


def modules(spark, *files):
    rows = deps.extract_imports(sources(spark, list(files))).orderBy("file_id", "pos").collect()
    return [(r.file_id, r.module) for r in rows]


def test_each_rule(spark):
    src = "import a.b as z, c\nfrom . import q\nfrom .util import x\nfrom ..up.er import y\nimport c\ndef f():\n    import nested\n"
    assert [m for _, m in modules(spark, ("f", src))] == ["a.b", "c", "util", "up.er", "c", "nested"]


def test_relative_level_is_kept_beside_the_module(spark):
    row = deps.extract_imports(sources(spark, [("f", "from ..up import y\n")])).first()
    assert (row.kind, row.level, row.module) == ("from", 2, "up")


def test_empty_null_and_broken_files_keep_a_row(spark):
    rows = {r.file_id: r for r in deps.extract_imports(sources(spark, [("empty", ""), ("null", None), ("broken", "def (:"), ("zero", "x = '\0'")])).collect()}
    assert rows["empty"].module is None and rows["empty"].error is None
    assert rows["null"].module is None and rows["null"].error is None
    assert rows["broken"].error == "SyntaxError" and rows["zero"].error in ("SyntaxError", "ValueError")


def test_cards_keep_order_and_duplicates(spark):
    made = deps.cards_of(deps.extract_imports(sources(spark, [("b.py", "import z\nimport a\nimport z\n"), ("e.py", "")])))
    got = {r.file_id: (r.modules, r.card) for r in made.collect()}
    assert got == {"b.py": (["z", "a", "z"], "File b.py Imports z a z"), "e.py": ([], "File e.py")}


def test_holds(spark):
    made = deps.cards_of(deps.extract_imports(sources(spark, [("x", "import zlib\nfrom ..shed import tool\n"), ("y", "import zlib\n")])))
    got = {r.file_id: r.ok for r in made.select("file_id", deps.holds(made.modules, "shed", "zlib").alias("ok")).collect()}
    assert got == {"x": True, "y": False}


def test_links(spark):
    pages = spark.createDataFrame([(1, '<a href="/x">x</a><a href="">y</a>'), (2, "none")], "page_id long, html string")
    assert sorted((r.page_id, r.pos, r.href) for r in deps.extract_links(pages).collect()) == [(1, 0, "/x"), (1, 1, "")]


def test_imports_in_sql(spark):
    deps.register_imports(spark)
    files = sources(spark, [("a", "import x, y\nfrom . import z\n"), ("e", ""), ("n", None), ("b", "def (:")])
    got = spark.sql("SELECT f.file_id, i.module, i.error FROM {files} f LEFT JOIN LATERAL imports_of(f.src) i ON true", files=files).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", "x", None), ("a", "y", None), ("e", None, None), ("n", None, None), ("b", None, "SyntaxError")]))
