"""Registered queries of search planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning
from .fixtures import view
from .queries import ORACLES, query

BUDGET, LIMIT = 3, 50
LIST = "SELECT profile_id, company, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY rank, pos) AS INTEGER) AS place FROM (SELECT profile_id, trim(company) AS company, pos, CASE kind WHEN 'required' THEN 0 ELSE 1 END AS rank FROM wishes w WHERE trim(company) <> '' AND kind <> 'excluded' AND NOT EXISTS (SELECT 1 FROM wishes x WHERE x.profile_id = w.profile_id AND x.kind = 'excluded' AND trim(lower(x.company)) = trim(lower(w.company))) QUALIFY row_number() OVER (PARTITION BY profile_id, lower(trim(company)) ORDER BY CASE kind WHEN 'required' THEN 0 ELSE 1 END, pos) = 1)"
COVERED = f"SELECT *, lower(company) IN (SELECT lower(company) FROM boards UNION SELECT lower(slug) FROM boards) AS has_board FROM ({LIST})"


@query("company_search_list", LIST)
def company_search_list(spark, d):
    return planning.company_search_list(view(spark, d, "wishes"))


@query("board_coverage", COVERED)
def board_coverage(spark, d):
    return planning.board_coverage(company_search_list(spark, d), view(spark, d, "boards"))


@query("budgeted_queries", f"SELECT profile_id, CAST(n // size AS INTEGER) AS bucket, concat('Data Engineer at ', string_agg(company, ' OR ' ORDER BY n), CASE WHEN profile_id % 3 = 0 THEN ' remote' ELSE '' END) AS query FROM (SELECT profile_id, company, row_number() OVER (PARTITION BY profile_id ORDER BY place) - 1 AS n, (count(*) OVER (PARTITION BY profile_id) + {BUDGET - 1}) // {BUDGET} AS size FROM ({COVERED}) WHERE NOT has_board) GROUP BY profile_id, n // size")
def budgeted_queries(spark, d):
    open_ones = board_coverage(spark, d).where("not has_board")
    return planning.budgeted_queries(open_ones, BUDGET, F.lit("Data Engineer"), F.when(F.col("profile_id") % 3 == 0, "remote").otherwise(""))


_OWN_TITLES = "CASE WHEN profile_id % 3 = 0 THEN 'A OR B OR C' WHEN profile_id % 3 = 1 THEN 'Clerk OR Analyst' ELSE 'Software Engineer' END"


@query("budgeted_profile_queries", f"SELECT profile_id, CAST(n // size AS INTEGER) AS bucket, concat({_OWN_TITLES}, ' at ', string_agg(company, ' OR ' ORDER BY n), CASE profile_id % 4 WHEN 0 THEN ' remote' WHEN 1 THEN ' hybrid' ELSE '' END) AS query FROM (SELECT profile_id, company, row_number() OVER (PARTITION BY profile_id ORDER BY place) - 1 AS n, (count(*) OVER (PARTITION BY profile_id) + {BUDGET - 1}) // {BUDGET} AS size FROM ({COVERED}) WHERE NOT has_board) GROUP BY profile_id, n // size")
def budgeted_profile_queries(spark, d):
    """Titles from each profile: hard ones first, three at most; the kinds of work remote and hybrid are named."""
    k = F.col("profile_id")
    hard = F.when(k % 3 == 0, F.array(*map(F.lit, "ABCD"))).otherwise(F.array().cast("array<string>"))
    soft = F.when(k % 3 == 1, F.array(F.lit("Clerk"), F.lit("Analyst")))
    kind = F.when(k % 4 == 0, "remote").when(k % 4 == 1, "hybrid").otherwise("on-site")
    suffix = F.when(kind.isin("remote", "hybrid"), kind).otherwise("")
    return planning.budgeted_queries(board_coverage(spark, d).where("not has_board"), BUDGET, planning.query_titles(hard, soft), suffix)


@query("keyword_queries", "SELECT profile_id, unnest(list_filter([p, CASE WHEN profile_id % 5 > 0 THEN concat('Analyst ', CASE WHEN contains(p, 'Data') THEN 'spark' ELSE 'DATA' END) END], lambda q: q IS NOT NULL)) AS query FROM (SELECT DISTINCT profile_id, CASE profile_id % 3 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Nurse' ELSE 'Clerk' END AS p FROM wishes)")
def keyword_queries(spark, d):
    k = F.col("profile_id")
    hard = F.when(k % 3 == 0, F.array(F.lit("Data Engineer"))).when(k % 3 == 1, F.array(F.lit("Nurse"))).otherwise(F.array().cast("array<string>"))
    soft = F.when(k % 5 > 0, F.array(F.lit("Clerk"), F.lit("Analyst"))).otherwise(F.array(F.lit("Clerk")))
    rows = view(spark, d, "wishes").select("profile_id").distinct()
    return planning.keyword_queries(rows.select("profile_id", hard.alias("hard_titles"), soft.alias("soft_titles"), F.array(F.lit("DATA"), F.lit("spark")).alias("keywords")))


_PRIMARY = "CASE profile_id % 3 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Nurse' ELSE 'Clerk' END"
_PLACE = "CASE profile_id % 4 WHEN 0 THEN 'Bonn' WHEN 1 THEN 'remote' ELSE '' END"
_GENERAL = "SELECT profile_id, unnest(" + ORACLES["keyword_queries"].split(") SELECT profile_id, unnest(", 1)[1]


@query("keyword_plan", f"SELECT profile_id, query, {_PLACE} AS location FROM ({_GENERAL}) UNION ALL SELECT profile_id, concat({_PRIMARY}, ' at ', company), {_PLACE} FROM ({COVERED}) WHERE NOT has_board")
def keyword_plan(spark, d):
    """The plan of a run whose budget is used up."""
    k = F.col("profile_id")
    hard = F.when(k % 3 == 0, F.array(F.lit("Data Engineer"))).when(k % 3 == 1, F.array(F.lit("Nurse"))).otherwise(F.array().cast("array<string>"))
    soft = F.when(k % 5 > 0, F.array(F.lit("Clerk"), F.lit("Analyst"))).otherwise(F.array(F.lit("Clerk")))
    places = F.when(k % 4 == 0, F.array(F.lit("Bonn"), F.lit("Ulm"))).otherwise(F.array().cast("array<string>"))
    rows = view(spark, d, "wishes").select("profile_id").distinct()
    profiles = rows.select("profile_id", hard.alias("hard_titles"), soft.alias("soft_titles"), F.array(F.lit("DATA"), F.lit("spark")).alias("keywords"), places.alias("locations"), F.when(k % 4 < 2, "remote").otherwise("hybrid").alias("remote_type"))
    return planning.keyword_plan(profiles, planning.uncovered(board_coverage(spark, d).where("not has_board"), 0))


@query("quota_ledger", f"SELECT service, concat('', day) AS day, used, greatest({LIMIT} - used, 0) AS remaining, used >= {LIMIT} AS exhausted FROM (SELECT service, day, CAST(sum(n) OVER (PARTITION BY service ORDER BY day) AS BIGINT) AS used FROM usage)")
def quota_ledger(spark, d):
    return planning.quota_ledger(view(spark, d, "usage"), LIMIT).withColumn("day", F.col("day").cast("string"))
