"""Queries and oracle SQL of the training-data operators; ``__spark_entry__`` adds them if this imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import balls, components, mixing, mojibake, packing, provenance, secrets, sizes, spans, streams, syntax, topn
from codelode.session import cut, load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    packed = cut(streams.file_streams(load(spark, d, "tokens")), "streams")
    return spans.shared_spans(packed, 50)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("file_id")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)


def _p2(spark: SparkSession, d: str) -> DataFrame:
    measured = cut(provenance.measure_files(load(spark, d, "files")), "measured")
    return provenance.find_not_handwritten(measured, provenance.train(measured))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    functions = topn.top_n_per_group(load(spark, d, "functions"), "scan_id", "function_id", "complexity", 10)
    offenders = topn.top_n_per_group(
        load(spark, d, "files").where("shared_fingerprints > 0"), "scan_id", "file_id", "shared_fingerprints", 10
    )
    lists = (("top_functions", functions, "function_id"), ("top_offenders", offenders, "file_id"))
    one, two = (
        x.select(F.lit(name).alias("list_name"), "scan_id", "pos", F.col(item).alias("item_id"))
        for name, x, item in lists
    )
    return one.unionByName(two)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.advisory_groups(load(spark, d, "advisories"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parse_files(load(spark, d, "files")).where("error_line > 0").select("file_id").distinct()


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first error of each invalid file."""
    return syntax.parse_files(load(spark, d, "files")).where("error_line > 0").select("file_id", F.col("claimed").alias("language"), "error_line").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(load(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return balls.similar_pairs(cut(streams.file_streams(load(spark, d, "tokens")), "streams"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return balls.near_duplicate_groups(cut(streams.file_streams(load(spark, d, "tokens")), "streams"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(load(spark, d, "files")).select("file_id", "line").distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_files(load(spark, d, "files"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(cut(sizes.token_sizes(load(spark, d, "documents")), "sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(cut(sizes.token_sizes(load(spark, d, "documents")), "sizes"), load(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mixture(spark, d), load(spark, d, "mix_targets"))


def _p10(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    model = mojibake.count_bigrams(documents)
    explained = cut(mojibake.explanations(documents, model), "explained")
    return mojibake.settle(explained, documents, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d)


def queries() -> dict[str, Query]:
    found = (
        p1_found, p2_found, p2_scores, p3_found, p4_found, p5_found, p5_errors, p5_rates, p6_found, p6_groups, p7_found, p7_redacted,
        p8_containers, p8_report, p9_mixture, p9_shares, p10_found, p10_restored,
    )
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p4_found": P4_SQL}


P3_SQL = """
WITH i AS (
  SELECT DISTINCT 'top_functions' AS list_name, scan_id, function_id AS item_id, complexity AS score
  FROM functions WHERE complexity IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'top_offenders', scan_id, file_id, shared_fingerprints FROM files WHERE shared_fingerprints > 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY list_name, scan_id ORDER BY score DESC, item_id) AS pos
  FROM i WHERE scan_id IS NOT NULL AND item_id IS NOT NULL
)
SELECT list_name, scan_id, CAST(pos AS INTEGER) AS pos, item_id FROM r WHERE pos <= 10
"""

P4_SQL = r"""
WITH RECURSIVE blanks AS (
  SELECT chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(65279) || chr(8203)
    || string_agg(chr(CAST(c AS INTEGER)), '') AS w FROM range(8192, 8203) t(c)
), spelled AS (
  SELECT upper(trim(translate(osv_id, '‐‑‒–—―⁃−﹘﹣－', '-----------'), w)) AS a, upper(trim(translate(x, '‐‑‒–—―⁃−﹘﹣－', '-----------'), w)) AS b
  FROM (SELECT osv_id, unnest(list_append(coalesce(aliases, []), osv_id)) AS x FROM advisories), blanks
), named AS (
  -- A series and its parts, with a digit other than zero or a part of letters among them.
  SELECT DISTINCT b AS id FROM spelled
  WHERE len(string_split(b, '-')) >= 2 AND NOT list_contains(string_split(b, '-'), '') AND NOT regexp_matches(b, '\s')
    AND replace(array_to_string(string_split(b, '-')[2:], ''), '0', '') <> ''
    AND (len(string_split(b, '-')) > 2 OR length(translate(b, '0123456789', '')) < length(b))
), e AS (
  SELECT DISTINCT a, b FROM spelled WHERE a <> b AND a IN (SELECT id FROM named) AND b IN (SELECT id FROM named)
), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT a AS s, a AS n FROM g UNION SELECT r.s, g.b FROM reach r JOIN g ON r.n = g.a
), comp AS (SELECT s, min(n) AS group_id FROM reach GROUP BY s)
SELECT DISTINCT a AS osv_id, group_id FROM spelled JOIN comp ON a = s
"""
