"""Queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, terms, unit
from ..operators import config, dense, deps, lexical, report, stats
from ..sources import first_of_places, parameter, placed_texts, table, write_placed
from ..written import new_path
from . import extended, rendered

TOP, WEAK_DIMS = 5, 8
QUERY = "tion the"
KNOWN_MODULE = "economy"

METRICS = ["high", "low"]


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set, each row whose id is divisible by 100, and all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), rows


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = _queries(spark, sf_dir)
    return dense.top_k(q, rows, TOP).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rk")


def _ranks(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    q, rows = _queries(spark, sf_dir)
    return dense.reciprocal_ranks(q, rows, dims)


def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir)


def mean_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.summarise(_ranks(spark, sf_dir))


def _both_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant 0 with all components, variant 1 with the first few."""
    q, rows = _queries(spark, sf_dir)
    return dense.rank_variants(q, rows, [None, WEAK_DIMS])


def variant_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.compare_variants(_both_ranks(spark, sf_dir))


def evaluate_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which item the first half of each benchmark item's words finds, by counts of all letters and of vowels alone."""
    items = table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), rendered.first_half(F.col("text")).alias("text"), F.col("item_id").alias("gold"))
    models = [rendered.count_letters(), rendered.count_letters(rendered.VOWELS)]
    return dense.evaluate(asked, items.select(F.col("item_id").alias("card_id"), "text"), models)


def compare_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.compare_variants(evaluate_encoders(spark, sf_dir))


def replicate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored by a column expression, a tenth missing and a seventh off in one letter, against the encoder's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = rendered.letter_counts(F.col("text"))
    stored = F.when(F.col("doc_id") % 7 == 0, F.transform(counts, lambda x, i: F.when(i == 0, x + 1).otherwise(x))).otherwise(counts)
    return dense.replicate(docs, docs.filter("doc_id % 10 <> 0").select("doc_id", unit(stored).alias("embedding")), rendered.count_letters(), "doc_id")


def first_hit_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.first_hit(lexical.any_term(table(spark, sf_dir, "documents"), QUERY), "doc_id", "doc_id", 0)


def any_term_of_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("tion  "), F.col("lang"))
    return lexical.any_term(table(spark, sf_dir, "documents"), asked).select("doc_id")


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select("item_id", terms(F.col("text")).alias("words"))
    return found.select("item_id", F.size("words").alias("n_terms"), F.size(F.array_distinct("words")).alias("n_distinct"))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.settings(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))


def probe_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations in files, at two places for each supplier: the first that has one wins, and none at all skips."""
    configs = _settings(spark, sf_dir)
    base = f"{new_path(spark, 'probe')}/{parameter(spark, 'tarnwork.configs', 'configs')}"
    write_placed(rendered.placed(configs), base)
    chosen = first_of_places(placed_texts(spark, base), configs.select(F.col("key").alias("case")))
    return config.check_configs(chosen.select(F.concat(F.lit("supplier_"), F.col("case").cast("string")).alias("path"), "value"))


def guard_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards of every kind over the documents, run in order, and the status that the process would end with."""
    docs = table(spark, sf_dir, "documents")

    def has(column: str) -> str:
        row = lexical.check_schema(docs, column).first()
        if not row.ok:
            raise KeyError(column)
        return f"{row.n_rows} rows with {column}"

    def no_model() -> str:
        raise OSError("no weights")

    guards = [
        ("text", lambda: has("text")),
        ("optional", lambda: report.require("no_such_module_anywhere")),
        ("encoder", lambda: report.or_skip(no_model, "model not loaded")),
        ("title", lambda: has("title")),
        ("long", lambda: str(docs.filter("n_chars >= 1000").count())),
    ]
    seen = report.run_guards(spark, guards)
    return seen.withColumn("exit_status", F.lit(report.exit_status(seen)))


def score_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores held as JSON: each event type is a configuration, the object's number tells the metric."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("config"), "value", F.from_json("props", "k int")["k"].alias("k"))
    return stats.scores_by_config(rows.withColumn("metric", F.when(F.col("k") >= 50, "high").otherwise("low")), METRICS)


def position_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.position_gap(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"))


def lexical_any_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.any_term(table(spark, sf_dir, "documents"), QUERY).select("doc_id")


def lexical_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.summarise(lexical.any_term(table(spark, sf_dir, "documents"), QUERY), "doc_id")


def lexical_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.count_hits(asked, table(spark, sf_dir, "documents"))


def config_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.check_configs(_settings(spark, sf_dir))


def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.extract_imports(rendered.source_files(table(spark, sf_dir, "part")))


def dependency_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = deps.cards_of(import_extract(spark, sf_dir))
    return made.select("file_id", F.size("modules").alias("n_modules"), "card", deps.holds(F.col("modules"), KNOWN_MODULE).alias("holds_known"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.extract_links(table(spark, sf_dir, "pages"))


def hit_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.check_schema(table(spark, sf_dir, "documents"), "doc_id", "text")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.any_term(table(spark, sf_dir, "documents"), QUERY)
    schema = lexical.check_schema(hits, "doc_id", "text")
    means = _both_ranks(spark, sf_dir).agg(*(F.avg(F.when(F.col("variant") == v, F.col("rr"))).alias(c) for v, c in enumerate(("mrr", "weak"))))
    checked = config_classify(spark, sf_dir)
    made = dependency_card(spark, sf_dir).agg(F.count_if("holds_known").alias("n"))
    guards = [
        made.select(*report.outcome(F.col("n") > 0, "cards_hold_known", F.concat(F.col("n").cast("string"), F.lit(" cards")))),
        schema.select(*report.outcome(F.col("ok") & (F.col("n_rows") > 0), "hits_have_schema", F.concat(F.col("n_rows").cast("string"), F.lit(" hits")))),
        checked.select(F.concat(F.lit("config_"), F.col("path")).alias("guard"), "status", "reason"),
        means.select(*report.outcome(F.col("mrr") > F.col("weak"), "full_beats_weak", F.concat_ws(" ", fixed(F.col("mrr")), fixed(F.col("weak"))))),
    ]
    out = guards[0]
    for g in guards[1:]:
        out = out.unionByName(g)
    return out


def guard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


def guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_statuses(_outcomes(spark, sf_dir))


def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cochange_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mcnemar(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.linear_fit(table(spark, sf_dir, "documents"), "doc_id", "n_chars")


def position_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.position_effect(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.digests(table(spark, sf_dir, "documents"), "doc_id")


def group_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.by_group(joined, "lang", "quality")


def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in an event's props as its score, views before clicks."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.from_json("props", "k int")["k"].cast("double").alias("value"))
    return stats.pivot_scores(rows, ["view", "click"])


def scorer_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return stats.paired_difference(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, reciprocal_rank, mean_reciprocal_rank, variant_compare, lexical_any_filter, lexical_first_hit, lexical_multi_query,
        config_classify, import_extract, dependency_card, link_extract, hit_schema_check, guard_report, guard_counts, cochange_pairs,
        mcnemar_counts, linear_fit, position_effect, content_digest, group_by_language, score_pivot, scorer_difference,
        evaluate_encoders, compare_encoders, replicate_embeddings, first_hit_expected, any_term_of_row, term_counts, probe_config, guard_run,
        score_configs, position_gap,
    )
}

# ---------------------------------------------------------------- the same in SQL

_DOT = "list_dot_product(q.embedding[1:{d}]::DOUBLE[], e.embedding[1:{d}]::DOUBLE[])"


def _rank_sql(dims: int) -> str:
    return f"""
    SELECT query_id, first_rank, 1.0E0 / first_rank AS rr, first_rank = 1 AS top1 FROM (
      SELECT query_id, min(CASE WHEN gold THEN rk END) AS first_rank FROM (
        SELECT q.vec_id AS query_id, q.label = e.label AS gold,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT.format(d=dims)} DESC, e.vec_id) AS rk
        FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) r
      GROUP BY query_id) s
    WHERE first_rank IS NOT NULL"""


_HAS = "(contains(text, 'tion') OR contains(text, 'the'))"
_MEAN = "SELECT count(*) AS n_queries, round(avg(rr), 9) AS mrr, round(avg(top1::INT::DOUBLE), 9) AS hit1 FROM ({ranks}) x"
_GUARDS = f"""
    SELECT 'cards_hold_known' AS guard, CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status, n::VARCHAR || ' cards' AS reason
    FROM (SELECT coalesce(sum(holds_known::INT), 0)::BIGINT AS n FROM ({rendered.CARDS_SQL}) k) c
    UNION ALL
    SELECT 'hits_have_schema', CASE WHEN n > 0 AND bad = 0 THEN 'PASS' ELSE 'FAIL' END, n::VARCHAR || ' hits'
    FROM (SELECT count(*) AS n, coalesce(sum((doc_id IS NULL OR text IS NULL)::INT), 0) AS bad FROM documents WHERE {_HAS}) h
    UNION ALL
    SELECT 'config_' || path, status, reason FROM ({rendered.CONFIG_SQL}) c
    UNION ALL
    SELECT 'full_beats_weak', CASE WHEN a.mrr > b.mrr THEN 'PASS' ELSE 'FAIL' END, printf('%.2f', a.mrr) || ' ' || printf('%.2f', b.mrr)
    FROM ({_MEAN.format(ranks=_rank_sql(64))}) a, ({_MEAN.format(ranks=_rank_sql(WEAK_DIMS))}) b"""

ORACLE_SQL = {
    "vector_topk": f"""
    SELECT query_id, vec_id, round(score, 6) AS score, rk::INTEGER AS rk FROM (
      SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM (
        SELECT q.vec_id AS query_id, e.vec_id, {_DOT.format(d=64)} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) s) r
    WHERE rk <= {TOP}""",
    "reciprocal_rank": _rank_sql(64),
    "mean_reciprocal_rank": _MEAN.format(ranks=_rank_sql(64)),
    "variant_compare": f"""
    SELECT a.query_id, a.rr AS rr_a, a.top1 AS top1_a, b.rr AS rr_b, b.top1 AS top1_b, a.top1 AND a.rr > b.rr AS passes
    FROM ({_rank_sql(64)}) a JOIN ({_rank_sql(WEAK_DIMS)}) b ON a.query_id = b.query_id""",
    "lexical_any_filter": f"SELECT doc_id FROM documents WHERE {_HAS}",
    "lexical_first_hit": f"SELECT count(*) > 0 AS any_hit, count(*) AS n_hits, min(doc_id) AS first_id FROM documents WHERE {_HAS}",
    "lexical_multi_query": r"""
    SELECT b.item_id AS query_id, sum((len(list_filter(list_filter(string_split_regex(b.text, '\s+'), lambda w: w <> ''), lambda w: contains(d.text, w))) > 0)::INT)::BIGINT AS n_hits
    FROM benchmark b, documents d GROUP BY b.item_id""",
    "config_classify": rendered.CONFIG_SQL,
    "import_extract": rendered.IMPORTS_SQL,
    "dependency_card": rendered.CARDS_SQL,
    "link_extract": """
    SELECT page_id, (i - 1)::INTEGER AS pos, links[i] AS href
    FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages) p) x""",
    "hit_schema_check": """
    SELECT coalesce(sum((doc_id IS NULL OR text IS NULL)::INT), 0) = 0 AS ok, coalesce(sum((doc_id IS NULL OR text IS NULL)::INT), 0)::BIGINT AS n_bad, count(*) AS n_rows FROM documents""",
    "guard_report": _GUARDS,
    "guard_counts": f"""
    SELECT s.status, count(g.guard) AS n FROM (VALUES ('PASS'), ('SKIP'), ('FAIL')) s(status) LEFT JOIN ({_GUARDS}) g ON g.status = s.status GROUP BY s.status""",
    "cochange_pairs": """
    WITH c AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem)
    SELECT x.i AS a, y.i AS b, count(*) AS n FROM c x JOIN c y ON x.g = y.g AND x.i < y.i GROUP BY x.i, y.i HAVING count(*) >= 2""",
    "mcnemar_counts": """
    SELECT b, c, round((b - c) * (b - c)::DOUBLE / nullif(b + c, 0), 9) AS chi2 FROM (
      SELECT coalesce(sum((quality = 1 AND toxic <> 1)::INT), 0)::BIGINT AS b, coalesce(sum((quality <> 1 AND toxic = 1)::INT), 0)::BIGINT AS c FROM labels) x""",
    "linear_fit": "SELECT round(regr_slope(n_chars, doc_id), 6) AS slope, round(regr_intercept(n_chars, doc_id), 6) AS intercept, round(regr_r2(n_chars, doc_id), 6) AS r2 FROM documents",
    "position_effect": """
    SELECT bin, count(*) AS n, round(avg(m), 6) AS mean FROM (
      SELECT CASE WHEN place < 1.0E0 / 3 THEN 'head' WHEN place < 2.0E0 / 3 THEN 'middle' ELSE 'tail' END AS bin, m FROM (
        SELECT percent_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS place, length(text)::DOUBLE AS m FROM conversations) p) b GROUP BY bin""",
    "content_digest": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "group_by_language": "SELECT lang, count(*) AS n, round(avg(quality), 9) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "score_pivot": """
    SELECT sum_view, sum_click, mean_view, mean_click, sum_view - sum_click AS "drop", round(factor, 6) AS factor FROM (
      SELECT coalesce(sum(CASE WHEN arm = 'view' THEN value END), 0) AS sum_view, coalesce(sum(CASE WHEN arm = 'click' THEN value END), 0) AS sum_click,
             round(avg(CASE WHEN arm = 'view' THEN value END), 6) AS mean_view, round(avg(CASE WHEN arm = 'click' THEN value END), 6) AS mean_click, mean_view / nullif(mean_click, 0) AS factor
      FROM (SELECT event_type AS arm, json_extract(props, '$.k')::DOUBLE AS value FROM events) v) x""",
    "evaluate_encoders": rendered.ENCODERS_SQL,
    "compare_encoders": rendered.COMPARED_SQL,
    "replicate_embeddings": rendered.REPLICATE_SQL,
    "first_hit_expected": f"SELECT count(*) AS n_hits, min(doc_id) AS first_id, coalesce(min(doc_id) = 0, false) AS as_expected FROM documents WHERE {_HAS}",
    "any_term_of_row": "SELECT doc_id FROM documents WHERE contains(text, 'tion') OR contains(text, lang)",
    "term_counts": r"""
    SELECT item_id, len(words)::INTEGER AS n_terms, len(list_distinct(words))::INTEGER AS n_distinct
    FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS words FROM benchmark) x""",
    "probe_config": rendered.PROBE_SQL,
    "guard_run": """
    SELECT guard, status, reason, place::INTEGER AS place, 1::INTEGER AS exit_status FROM (
      SELECT 'text' AS guard, 'PASS' AS status, (SELECT count(*) FROM documents)::VARCHAR || ' rows with text' AS reason, 0 AS place
      UNION ALL SELECT 'long', 'PASS', (SELECT count(*) FROM documents WHERE n_chars >= 1000)::VARCHAR, 4
      UNION ALL FROM (VALUES ('optional', 'SKIP', 'No module named ''no_such_module_anywhere', 1), ('encoder', 'SKIP', 'model not loaded: no weights', 2), ('title', 'FAIL', 'KeyError: ''title''', 3)) v) g""",
    "score_configs": """
    SELECT event_type AS config, round(avg(CASE WHEN k >= 50 THEN value END), 6) AS high, round(avg(CASE WHEN k < 50 THEN value END), 6) AS low
    FROM (SELECT event_type, value, json_extract(props, '$.k')::INTEGER AS k FROM events) e GROUP BY event_type""",
    "position_gap": """
    SELECT head, tail, round(tail - head, 6) AS gap FROM (
      SELECT round(avg(CASE WHEN place < 1.0E0 / 3 THEN m END), 6) AS head, round(avg(CASE WHEN place >= 2.0E0 / 3 THEN m END), 6) AS tail FROM (
        SELECT percent_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS place, length(text)::DOUBLE AS m FROM conversations) p) b""",
    "scorer_difference": "SELECT count(*) AS n, round(avg(quality - toxic), 9) AS mean_difference FROM labels",
}

QUERIES |= extended.QUERIES
ORACLE_SQL |= extended.ORACLE_SQL | {"vector_topk_pruned": ORACLE_SQL["vector_topk"], "trigram_multi_query": ORACLE_SQL["lexical_multi_query"]}
