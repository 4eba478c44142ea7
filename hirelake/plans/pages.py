"""Registered queries of pages: the first two and the last of found jobs, matches and hidden rows in every order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paging, reports
from ..sources.folders import shared_folder
from .fixtures import view
from .queries import OLDEST, query
from .reports import _JOINED, _ORDERS, _TABS, jobs_of

SIZE, WANTED = 50, [1, 2, -1]
_FOUND = {
    "date_found": "date_found DESC",
    "date_posted": "CASE WHEN regexp_full_match(date_posted, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN date_posted ELSE concat('', date_found) END DESC",
    "company": "company, title",
    "title": "title",
}


def _oracle(rows: str, orders: dict[str, str], by: str, shown: str) -> str:
    group = f"PARTITION BY {by}" if by else ""
    ranked = lambda sort, order: f"SELECT *, '{sort}' AS sort, row_number() OVER ({group} ORDER BY {order}, job_key) AS position, count(*) OVER ({group}) AS total FROM {rows}"
    return " UNION ALL ".join(f"SELECT {shown} FROM (SELECT *, (position + {SIZE - 1}) // {SIZE} AS page FROM ({ranked(s, o)})) WHERE page IN (1, 2, (total + {SIZE - 1}) // {SIZE})" for s, o in orders.items())


def _pages(spark, rows: DataFrame, sorts: list[str], keys, by: tuple[str, ...] = ()) -> DataFrame:
    """The wanted pages of rows in each of the orders, from one index for each."""
    folder, found = shared_folder(spark, "pages"), []
    for sort in sorts:
        index = paging.build_index(rows, f"{folder}/{sort}", keys(sort), by)
        found.append(paging.read_pages(index, keys(sort), WANTED, SIZE, by).withColumn("sort", F.lit(sort)))
    return reduce(DataFrame.unionByName, found)


@query("search_jobs_pages", f"SELECT j.*, 'Seeker ' || p.profile_id AS fetched_for FROM ({_oracle("(SELECT seq AS job_key, title, company, date_found, date_posted, profile_id FROM postings WHERE contains(lower(title), 'e') OR contains(lower(company), 'e'))", _FOUND, '', 'sort, page, position, total, job_key, title, profile_id')}) j LEFT JOIN (SELECT profile_id FROM profiles WHERE profile_id < 8) p USING (profile_id)")
def search_jobs_pages(spark, d):
    """Names are joined with the pages' rows alone; one profile's name is missing."""
    jobs = view(spark, d, "postings").withColumnRenamed("seq", "job_key")
    found = reports.found_jobs(jobs, view(spark, d, "verdicts"), text="E").select("job_key", "title", "company", "date_found", "date_posted", "profile_id")
    names = view(spark, d, "profiles").where("profile_id < 8").select("profile_id", F.concat(F.lit("Seeker "), "profile_id").alias("fetched_for"))
    pages = _pages(spark, found, list(_FOUND), reports.search_keys).join(names, "profile_id", "left")
    return pages.select("sort", "page", "position", "total", "job_key", "title", "profile_id", "fetched_for")


@query("list_matches_pages", _oracle(f"(SELECT * FROM {_JOINED} WHERE {_TABS["'all'"]})", _ORDERS, "profile_id", "sort, page, position, total, profile_id, job_key"))
def list_matches_pages(spark, d):
    rows = reports.matches_by_tab(view(spark, d, "shared_verdicts"), jobs_of(spark, d), OLDEST).where("tab = 'all'")
    kept = rows.select("profile_id", "job_key", "manager_score", "candidate_score", "date_posted", "date_found", "company", "title", "status")
    return _pages(spark, kept, list(_ORDERS), reports.sort_keys, ("profile_id",)).select("sort", "page", "position", "total", "profile_id", "job_key")


_HIDDEN = {sort: order for sort, order in _ORDERS.items() if sort != "status"}


@query("list_hidden_pages", _oracle("(SELECT v.*, title, company, date_posted, date_found FROM verdicts v JOIN (SELECT * EXCLUDE (profile_id) FROM postings) p ON p.seq = v.job_key WHERE hidden AND manager_score IS NOT NULL)", _HIDDEN, "profile_id", "sort, page, position, total, profile_id, job_key"))
def list_hidden_pages(spark, d):
    hidden = view(spark, d, "verdicts").where("hidden and manager_score is not null").select("profile_id", "job_key", "manager_score", "candidate_score")
    jobs = jobs_of(spark, d).select("job_key", "title", "company", "date_posted", "date_found")
    return _pages(spark, hidden.join(jobs, "job_key"), list(_HIDDEN), reports.sort_keys, ("profile_id",)).select("sort", "page", "position", "total", "profile_id", "job_key")
