"""Sources, configurations, cards and score rows rendered from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source files, one for each part. {b} is a package named by the brand, {t} one by the type, {n} one by the part's own name; None: no source.
LAYOUTS = [
    "import {b}, {t}.{n} as other\n",
    "from .{n} import first\nfrom {t} import second, third\n",
    "def work():\n    if True:\n        from {n}.{b} import x\n    return x\nimport {t}\n",
    "from . import near\nx = '{n}'\n",
    "# {n}\n",
    "class {n}(:\n",
    "import {n}\nimport {n}\nfrom ..{t}.{b} import y\n",
    None,
]
#: What each layout imports: layout, pos, kind, level, the parts of the module's name, error.
IMPORTED = [
    (0, 0, "import", 0, "b", None), (0, 1, "import", 0, "tn", None), (1, 0, "from", 1, "n", None), (1, 1, "from", 0, "t", None),
    (2, 0, "from", 0, "nb", None), (2, 1, "import", 0, "t", None), (3, None, None, None, None, None), (4, None, None, None, None, None),
    (5, None, None, None, None, "SyntaxError"), (6, 0, "import", 0, "n", None), (6, 1, "import", 0, "n", None), (6, 2, "from", 2, "tb", None), (7, None, None, None, None, None),
]

#: Configuration texts, one for each supplier; {n} is its nation, {k} its key; None: not found.
SETTINGS = [
    None, "dim: {k}\n", "model_name: {n}-En\n", "model_name: {n}-zh\n", "model_name: {n}-ZH-ft\n", "model_name: {n}/zh-ft-code\n", "model_name: {n}\n",
    "# model_name: {n}-zh\nmodel_name: x-en\n", "llm_model_name: {n}-MiniLM\n", 'model_name: "{n}-code"\n', "model_name:\n  dim: {k}\n", "model_name: # none yet\n",
]
OUTER = "model_name: outer-{n}-en\n"
LETTERS, VOWELS = "abcdefghijklmnopqrstuvwxyz", "aeiou"


def _filled(layout: str | None, **columns: Column) -> Column:
    if layout is None:
        return F.lit(None).cast("string")
    out = F.lit(layout)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _one_of(number: Column, choices: list[Column]) -> Column:
    out = F.when(number == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(number == i, c)
    return out


def source_files(part: DataFrame) -> DataFrame:
    """(file_id, src)"""
    names = {"b": F.concat(F.lit("b"), F.regexp_extract("p_brand", "[0-9]+", 0)), "t": F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), "n": F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))}
    src = _one_of(F.col("p_partkey") % len(LAYOUTS), [_filled(x, **names) for x in LAYOUTS])
    return part.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_id"), src.alias("src"))


def settings(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """(key, n_name, path, value)"""
    both = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_suppkey").alias("key"), "n_name")
    value = _one_of(F.col("key") % len(SETTINGS), [_filled(x, n=F.col("n_name"), k=F.col("key").cast("string")) for x in SETTINGS])
    return both.select("key", "n_name", F.concat(F.lit("supplier_"), F.col("key").cast("string")).alias("path"), value.alias("value"))


def placed(configs: DataFrame) -> DataFrame:
    """(case, place, value): where configurations lie. Keys that 3 divides have one at place 0, and all but one in three another at place 1."""
    inner = configs.filter("key % 3 = 0 AND value IS NOT NULL").select(F.col("key").alias("case"), F.lit(0).alias("place"), "value")
    return inner.unionByName(configs.filter("key % 3 < 2").select(F.col("key").alias("case"), F.lit(1).alias("place"), _filled(OUTER, n=F.col("n_name")).alias("value")))


def letter_counts(text: Column, letters: str = LETTERS) -> Column:
    """How often each letter occurs, in the same case."""
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))).cast("double") for x in letters])


def count_letters(letters: str = LETTERS):
    """The same as an encoder."""
    return lambda: lambda texts: [[x.count(c) for c in letters] for x in texts]


def first_half(text: Column) -> Column:
    words = F.split(text, " ")
    return F.array_join(F.slice(words, 1, F.expr("cast((size(split(text, ' ')) + 1) div 2 as int)")), " ")


# ---------------------------------------------------------------- the same in SQL


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def _text(layout: str | None, **columns: str) -> str:
    if layout is None:
        return "NULL"
    out = _quoted(layout.replace("\n", "~"))
    for name, value in columns.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return f"replace({out}, '~', chr(10))"


def _case(number: str, choices: list[str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


_FILES = "(SELECT 'part_' || p_partkey || '.py' AS file_id, p_partkey % 8 AS layout, 'b' || regexp_extract(p_brand, '[0-9]+') AS b, replace(lower(p_type), ' ', '_') AS t, replace(p_name, ' ', '_') AS n FROM part)"
IMPORTS_SQL = f"""
    SELECT file_id, pos::INTEGER AS pos, kind, level::INTEGER AS level,
           CASE parts WHEN 'b' THEN b WHEN 'n' THEN n WHEN 't' THEN t WHEN 'tn' THEN t || '.' || n WHEN 'nb' THEN n || '.' || b WHEN 'tb' THEN t || '.' || b END AS module, error
    FROM {_FILES} f JOIN (VALUES {", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in IMPORTED)}) v(number, pos, kind, level, parts, error) ON f.layout = v.number"""
CARDS_SQL = f"""
    SELECT file_id, count(module)::INTEGER AS n_modules, 'File ' || file_id || CASE WHEN count(module) > 0 THEN ' Imports ' || string_agg(module, ' ' ORDER BY pos) ELSE '' END AS card,
           coalesce(bool_or(module = 'economy'), false) AS holds_known
    FROM ({IMPORTS_SQL}) i GROUP BY file_id"""
_SETTINGS = f"(SELECT s_suppkey AS key, n_name, 'supplier_' || s_suppkey AS path, {_case('s_suppkey % 12', [_text(x, n='n_name', k='s_suppkey::VARCHAR') for x in SETTINGS])} AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_CHECK = """
    SELECT path, name AS model_name,
           CASE WHEN value IS NULL THEN 'SKIP' WHEN name IS NULL THEN 'FAIL'
                WHEN contains(low, 'zh') AND NOT contains(low, '-ft') THEN 'FAIL'
                WHEN contains(low, 'en') OR contains(low, 'code') OR contains(low, 'minilm') THEN 'PASS' ELSE 'FAIL' END AS status,
           CASE WHEN value IS NULL THEN 'no config found' WHEN name IS NULL THEN 'no model_name'
                WHEN contains(low, 'zh') AND NOT contains(low, '-ft') THEN 'model for Chinese: ' || name
                WHEN contains(low, 'en') OR contains(low, 'code') OR contains(low, 'minilm') THEN 'model: ' || name
                ELSE 'unknown kind of model: ' || name END AS reason
    FROM (SELECT path, value, name, lower(name) AS low FROM (
            SELECT path, value, nullif(regexp_extract(value, 'model_name:\\s*([^\\s#]+)', 1), '') AS name FROM {rows} r) n) c"""
CONFIG_SQL = _CHECK.replace("{rows}", _SETTINGS)
PROBE_SQL = _CHECK.replace("{rows}", f"(SELECT path, CASE WHEN key % 3 = 0 AND value IS NOT NULL THEN value WHEN key % 3 < 2 THEN {_text(OUTER, n='n_name')} END AS value FROM {_SETTINGS} s)")


def _vector_sql(text: str, letters: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{x}', '')))::DOUBLE" for x in letters) + "]"


def unit_sql(vector: str) -> str:
    """A list of doubles at length one, as floats."""
    return f"list_transform({vector}, lambda x: coalesce(x / nullif(sqrt(list_sum(list_transform({vector}, lambda y: y * y))), 0), 0)::FLOAT)"


def _encoder_sql(variant: int, letters: str) -> str:
    half = "array_to_string(list_slice(string_split(text, ' '), 1, (len(string_split(text, ' ')) + 1) // 2), ' ')"
    return f"""
    SELECT q.item_id AS query_id, {variant}::INTEGER AS variant, q.item_id AS gold, c.item_id AS card_id,
           row_number() OVER (PARTITION BY q.item_id ORDER BY list_dot_product({unit_sql('q.v')}::DOUBLE[], {unit_sql('c.v')}::DOUBLE[]) DESC, c.item_id) AS rk
    FROM (SELECT item_id, {_vector_sql('half', letters)} AS v FROM (SELECT item_id, {half} AS half FROM benchmark) h) q, (SELECT item_id, {_vector_sql('text', letters)} AS v FROM benchmark) c"""


ENCODERS_SQL = f"""
    SELECT query_id, variant, rk AS first_rank, 1.0E0 / rk AS rr, rk = 1 AS top1
    FROM ({_encoder_sql(0, LETTERS)} UNION ALL {_encoder_sql(1, VOWELS)}) r WHERE card_id = gold"""
COMPARED_SQL = f"""
    SELECT a.query_id, a.rr AS rr_a, a.top1 AS top1_a, b.rr AS rr_b, b.top1 AS top1_b, a.top1 AND a.rr > b.rr AS passes
    FROM ({ENCODERS_SQL}) a JOIN ({ENCODERS_SQL}) b ON a.query_id = b.query_id AND a.variant = 0 AND b.variant = 1"""
REPLICATE_SQL = f"""
    SELECT count(*) AS n, coalesce(sum((there AND off <= 1e-6)::INT), 0)::BIGINT AS n_same, coalesce(sum((NOT there)::INT), 0)::BIGINT AS n_missing
    FROM (SELECT there, list_max(list_transform(list_zip({unit_sql('v')}, {unit_sql('stored')}), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) AS off
          FROM (SELECT doc_id % 10 <> 0 AS there, v, CASE WHEN doc_id % 7 = 0 THEN list_transform(v, lambda x, i: CASE WHEN i = 1 THEN x + 1 ELSE x END) ELSE v END AS stored
                FROM (SELECT doc_id, {_vector_sql('text', LETTERS)} AS v FROM documents) d) s) o"""
