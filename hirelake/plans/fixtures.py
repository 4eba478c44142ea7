"""Derived input views: postings, profiles, verdicts and runs built from the shared tables.

The SQL keeps to what Spark and DuckDB both understand, so that a query and its oracle read the same rows.
The clock is fixed at 2024-01-31, retention is 30 days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31"
RETENTION_DAYS = 30
TITLES = "Senior Data Engineer|Lead Engineer|Product Manager|Data Scientist|Sales Director|Staff Software Engineer|Nurse|Account Executive|Machine-Learning Engineer|QA Analyst|Site Reliability Engineer|Office Manager"
LOCATIONS = "McLean, VA|Savannah, GA|Seattle, Washington|Remote|Remote, Mexico|Toronto, Canada|Santa Fe, New Mexico|Indianapolis, Indiana|London, UK|Charleston, West Virginia||Anywhere|Austin, Texas|Chicago, IL"
FILLER = "repeat('Deliver steady results with care. ', 6)"
STATUSES = "new|applied|phone_screen|interview_1|interview_2|interview_3|offer|rejected|withdrawn|missing_info|new"


def _item(values: str, key: str) -> str:
    return f"split_part('{values}', '|', CAST({key} % {values.count('|') + 1} + 1 AS INT))"


VIEWS = {
    "postings": f"""
SELECT o_orderkey AS seq, o_custkey % 8 + 1 AS profile_id, o_orderkey % 4 AS source_rank,
  CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN upper({_item(TITLES, "o_orderkey")}) WHEN o_orderkey % 5 = 2 THEN concat('  ', {_item(TITLES, "o_orderkey")}, '!') ELSE {_item(TITLES, "o_orderkey")} END AS title,
  CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE concat('Company ', o_custkey % 211) END AS company,
  {_item(LOCATIONS, "o_orderkey")} AS location,
  {_item("remote|hybrid|on-site|unknown", "o_orderkey")} AS remote_type,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 60000 + (o_orderkey % 90) * 1000 END AS salary_min,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN NULL ELSE 90000 + (o_orderkey % 90) * 1000 END AS salary_max,
  {_item("greenhouse|lever|jsearch|jobspy_site", "o_orderkey")} AS source,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE concat('', DATE '{AS_OF}' - CAST(o_orderkey % 60 AS INT)) END AS date_posted,
  DATE '{AS_OF}' - CAST(o_orderkey % 60 AS INT) AS date_found,
  {_item("3 days ago|today|2 weeks ago|1 month ago|5 hours ago|2024-01-05T10:00:00|3+ days ago|", "o_orderkey")} AS posted_text,
  {_item("hourly|monthly|yearly|weekly", "o_orderkey")} AS pay_period, o_orderkey % 50 + 20 AS pay_low, o_orderkey % 7 * 10 AS pay_high
FROM orders""",
    "profiles": """
SELECT * FROM (VALUES
  (1, 'company 1', '', 'flexible', 0, 'manager', 'Data Engineer|Site Reliability Engineer'), (2, '', 'data', 'remote', 0, '', 'Software Engineer'),
  (3, '', '', 'hybrid', 100000, 'director|nurse', ''), (4, 'company 20|company 3', 'company 7', '', 120000, '', 'Product Manager'),
  (5, '', '', 'flexible', 80000, 'lead', 'Lead Engineer|QA Analyst'), (6, '', '', '', 0, '', ''), (7, '', 'nurse', 'on-site', 0, 'senior', 'Data Scientist'), (8, 'company 9', '', 'remote', 90000, 'qa', 'Account Executive')
) AS p(profile_id, company_exclude, exclude_types, remote_pref, salary_floor, exclude_titles, job_titles)""",
    "verdicts": f"""
SELECT o_custkey % 8 + 1 AS profile_id, o_orderkey AS job_key, {_item(STATUSES, "o_orderkey")} AS status, o_orderkey % 3 = 0 AS hidden,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 10 = 0 END AS saved,
  CASE WHEN o_orderkey % 5 = 0 THEN DATE '{AS_OF}' - CAST(o_orderkey % 30 AS INT) ELSE NULL END AS status_updated,
  CASE WHEN o_orderkey % 9 = 0 THEN '[Hard filter] company' WHEN o_orderkey % 9 = 1 THEN '[Title filter] no match' WHEN o_orderkey % 9 = 2 THEN '[Missing info] short' WHEN o_orderkey % 9 = 3 THEN NULL ELSE 'fits' END AS match_notes,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey * 7 % 201 END AS manager_score,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey * 11 % 201 END AS candidate_score,
  o_orderkey * 13 % 101 / CAST(100 AS DOUBLE) AS match_score
FROM orders""",
    "recorded": "SELECT o_custkey % 8 + 1 AS profile_id, o_orderkey AS job_key, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey * 7 % 201 END AS manager_score FROM orders WHERE o_orderkey % 4 <> 1",
    "pairs": """
SELECT l_orderkey AS job_key, CASE l_partkey % 8 WHEN 0 THEN 'Skill' WHEN 1 THEN ' experience' WHEN 2 THEN 'domain' WHEN 3 THEN 'compensation' WHEN 4 THEN 'EQUITY' WHEN 5 THEN 'benefits ' WHEN 6 THEN 'work_arrangement' ELSE 'culture_growth' END AS category,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN 'Salary not disclosed' ELSE 'job side' END AS job_side,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'candidate side' END AS candidate_side,
  CASE WHEN l_returnflag = 'R' THEN 'required' WHEN l_returnflag = 'A' THEN 'preferred' WHEN l_linestatus = 'F' THEN 'nice_to_have' ELSE 'unknown' END AS job_importance,
  CASE WHEN l_linestatus = 'F' THEN 'must_have' WHEN l_linenumber % 2 = 0 THEN 'nice_to_have' ELSE 'unknown' END AS candidate_priority
FROM lineitem""",
    "runs": f"""
SELECT o_custkey % 8 + 1 AS profile_id, o_orderkey AS run_id, (o_orderkey % 90) * 24 + o_orderkey % 24 AS hours_ago, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'success' END AS status, o_orderkey % 40 AS jobs_added FROM orders""",
    "wishes": """
SELECT o_custkey AS profile_id, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 4 THEN 'excluded' WHEN o_orderkey % 5 > 1 THEN 'preferred' ELSE 'required' END AS kind,
  CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN concat('COMPANY ', o_orderkey * 7 % 23) WHEN o_orderkey % 3 = 1 THEN concat(' Company ', o_orderkey * 7 % 23, ' ') ELSE concat('Company ', o_orderkey * 7 % 23) END AS company
FROM orders""",
    "boards": "SELECT concat('Company ', s_suppkey) AS company, concat('company ', s_suppkey + 1) AS slug FROM supplier WHERE s_suppkey % 5 = 0",
    "actions": f"""
SELECT event_id, ts, event_id % 1500 AS job_key, CASE event_type WHEN 'view' THEN 'notes' WHEN 'click' THEN 'save' WHEN 'signup' THEN 'status' WHEN 'purchase' THEN 'promote' ELSE 'hide' END AS action,
  {_item(STATUSES + "|bogus", "event_id")} AS value FROM events""",
    "described": f"""
SELECT o_orderkey AS seq, o_custkey % 8 + 1 AS profile_id, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE {_item(TITLES, "o_orderkey")} END AS title, CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN '' ELSE concat('Company ', o_custkey % 211) END AS company,
  CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE {_item(LOCATIONS + "|Paris, France|New York, NY|Remote, US: all|Bangalore|Toronto, Ontario", "o_orderkey")} END AS location, CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE {_item("remote|hybrid|on-site|unknown", "o_orderkey")} END AS remote_type,
  CASE WHEN o_orderkey % 3 < 2 THEN NULL ELSE 60000 + (o_orderkey % 90) * 1000 END AS salary_min, CASE WHEN o_orderkey % 3 < 2 OR o_orderkey % 4 = 0 THEN NULL ELSE 90000 + (o_orderkey % 90) * 1000 END AS salary_max,
  {_item("greenhouse|lever|jsearch", "o_orderkey")} AS source, o_orderkey % 20 AS page_id, DATE '{AS_OF}' - CAST(o_orderkey % 60 AS INT) AS date_found, CAST(NULL AS STRING) AS date_posted,
  CASE o_orderkey % 8
   WHEN 0 THEN concat('<h2>About us</h2><br><br><p>We make things ', o_orderkey, '</p><br><br><h3>Responsibilities</h3><ul><li>Build &amp;amp; run unit ', o_orderkey, '</li><li>', {FILLER}, '</li></ul><br><br><p>Salary range</p><p>$', 60 + o_orderkey % 90, ',000 &mdash; $', 80 + o_orderkey % 90, ',000</p>')
   WHEN 1 THEN concat('Join a small team. Unit ', o_orderkey, ' pays $', 60 + o_orderkey % 90, 'k per year.')
   WHEN 2 THEN concat('**About the role**', chr(10), 'Some words ', o_orderkey, chr(10), '**Required Qualifications**', chr(10), {FILLER}, chr(10), chr(10), '**Benefits**', chr(10), 'Pay of $', 60 + o_orderkey % 30, ',000 to $', 80 + o_orderkey % 30, ',000 in Boston ', repeat('z', 450), ' $', 90 + o_orderkey % 9, ',000 to $', 110 + o_orderkey % 9, ',000 in Austin')
   WHEN 3 THEN '' WHEN 4 THEN concat('<p>Please sign in to view this job ', o_orderkey, '</p><h2>Requirements</h2>')
   WHEN 5 THEN concat('What you will do', chr(10), 'Plan unit ', o_orderkey, '. ', {FILLER}, chr(10), CASE WHEN o_orderkey % 16 = 5 THEN 'A security clearance is a plus.' ELSE 'A secret clearance is needed for all of the work we do here.' END)
   WHEN 6 THEN NULL ELSE concat('Requirements', chr(10), 'Short ', o_orderkey) END AS description
FROM orders""",
    "seekers": """
SELECT * FROM (VALUES
  (1, 'company 1', false, 'flexible', 0, '', '', 'manager', 'us', '', 'Data Engineer|Site Reliability Engineer', 'Austin, Texas', 'Fair pay|Remote work', 'Tea', 'remote', 90000),
  (2, '', true, 'Remote', 0, 'steady', '', '', 'canada|uk', '', 'Software Engineer', '', '', 'Bikes|Books', 'hybrid', 0),
  (3, '', CAST(NULL AS BOOLEAN), 'hybrid', 100000, '', 'data', 'director|nurse', '', 'Virginia|md', '', 'Remote', 'Good team', '', 'flexible', 80000),
  (4, 'company 20|company 3', false, '', 120000, 'company 7', '', '', 'Mexico', '', 'Product Manager', 'Austin, Texas|Boston', 'Salary over 100k', '', 'on-site', 100000),
  (5, '', false, 'flexible', 80000, '', 'nurse', 'lead', 'germany', 'tx|dc|wa', 'Lead Engineer|QA Analyst', '', '', '', '', 0),
  (6, '', CAST(NULL AS BOOLEAN), '', 0, '', '', '', '', '', '', '', '', '', '', 0),
  (7, '', true, 'on-site', 0, '', 'sign in', 'senior', 'usa|france', 'new mexico|london', 'Data Scientist', '', 'a|b|c', 'd', 'unknown', 0),
  (8, 'company 9', false, 'remote', 90000, '', '', 'qa', 'india', '', 'Account Executive', 'Austin, Texas', 'No office', 'x|y', 'remote', 1)
) AS p(profile_id, company_exclude, has_clearance, hard_remote, hard_salary_min, exclude_industries, exclude_company_types, exclude_titles, countries, areas, job_titles, preferred_locations, must_haves, nice_to_haves, work_style, pay_wish)""",
    "linked": f"SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN concat('<h2>Requirements</h2><p>', {FILLER}, page_id, '</p>') ELSE '<p>Gone</p>' END AS html FROM pages",
    "own_matches": """
SELECT l_suppkey % 8 + 1 AS profile_id, l_orderkey % 3000 AS job_key, CASE l_partkey % 8 WHEN 0 THEN 'Skill' WHEN 1 THEN ' experience' WHEN 2 THEN 'domain' WHEN 3 THEN 'compensation' WHEN 4 THEN 'EQUITY' WHEN 5 THEN 'benefits ' WHEN 6 THEN 'work_arrangement' ELSE NULL END AS category,
  CASE l_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Salary not disclosed' WHEN 2 THEN 'N/A' WHEN 3 THEN 'TBD' WHEN 4 THEN '' WHEN 5 THEN 'Pay is confidential' WHEN 6 THEN 'Not  stated' ELSE 'job side' END AS job_side,
  CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN '' ELSE 'candidate side' END AS candidate_side,
  CASE WHEN l_returnflag = 'R' THEN 'required' WHEN l_returnflag = 'A' THEN 'preferred' WHEN l_linestatus = 'F' THEN 'nice_to_have' ELSE NULL END AS job_importance,
  CASE WHEN l_linestatus = 'F' THEN 'must_have' WHEN l_linenumber % 2 = 0 THEN 'nice_to_have' ELSE NULL END AS candidate_priority
FROM lineitem""",
    "shared_verdicts": f"""
SELECT p AS profile_id, o_orderkey AS job_key, {_item(STATUSES, "(o_orderkey + p)")} AS status, (o_orderkey + p) % 3 = 0 AS hidden, CASE WHEN (o_orderkey + p) % 19 = 0 THEN NULL ELSE (o_orderkey + p) % 10 = 0 END AS saved,
  CASE WHEN (o_orderkey + p) % 5 = 0 THEN DATE '{AS_OF}' - CAST(o_orderkey % 30 AS INT) ELSE NULL END AS status_updated,
  CASE (o_orderkey * 5 + p) % 9 WHEN 0 THEN '[Hard filter] company' WHEN 1 THEN '[Title filter] no match' WHEN 2 THEN '[Missing info] short' WHEN 3 THEN NULL ELSE 'fits' END AS match_notes,
  CASE WHEN (o_orderkey + p) % 8 = 0 THEN NULL ELSE (o_orderkey * 7 + p) % 201 END AS manager_score, CASE WHEN (o_orderkey + p) % 8 < 2 THEN NULL ELSE (o_orderkey * 11 + p) % 201 END AS candidate_score, (o_orderkey * 13 + p) % 101 / CAST(100 AS DOUBLE) AS match_score
FROM (SELECT o_orderkey, p FROM orders, (SELECT * FROM (VALUES (1), (2), (3)) AS v(p)) v WHERE o_orderkey % 5 = 0)""",
    "own_actions": f"""
SELECT event_id, ts, user_id % 3 + 1 AS profile_id, event_id % 300 * 5 AS job_key, CASE event_type WHEN 'view' THEN 'notes' WHEN 'click' THEN 'save' WHEN 'signup' THEN 'status' WHEN 'purchase' THEN 'promote' ELSE 'hide' END AS action,
  {_item(STATUSES + "|bogus", "event_id")} AS value FROM events""",
    "edits": """
SELECT user_id AS profile_id, event_id, CASE event_type WHEN 'view' THEN 'skills' WHEN 'click' THEN 'skills' WHEN 'signup' THEN 'salary_min' WHEN 'purchase' THEN 'hard_requirements.has_clearance' ELSE 'work_style' END AS field,
  CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'remove' ELSE 'set' END AS action, CASE event_type WHEN 'view' THEN concat('s', event_id % 3) WHEN 'click' THEN concat('s', event_id % 3) WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'much' ELSE concat('', event_id) END WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '' WHEN 2 THEN 'true' ELSE 'no' END ELSE CASE event_id % 3 WHEN 0 THEN 'null' ELSE 'remote' END END AS value
FROM events""",
    "openings": f"""
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE concat('Company ', o_custkey % 211) END AS company,
  CASE WHEN o_orderkey % 997 = 0 THEN '' ELSE concat('Craft', o_orderkey % 97, ' Trade', o_custkey % 89, CASE WHEN o_orderkey % 5 = 0 THEN ' Lead' ELSE '' END) END AS title,
  {_item(LOCATIONS, "o_orderkey")} AS location, {_item("remote|hybrid|on-site|unknown", "(o_orderkey + o_custkey)")} AS remote_type, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 60000 + (o_orderkey % 90) * 1000 END AS salary_min,
  concat('Field', o_orderkey % 53, ' work in area', o_custkey % 61, CASE WHEN o_orderkey % 16 = 13 THEN '. A secret clearance is needed.' WHEN o_orderkey % 7 = 0 THEN concat('. Pay: $', 60 + o_orderkey % 90, ',000 to $', 80 + o_orderkey % 90, ',000.') ELSE '. Steady.' END) AS description
FROM orders""",
    "applicants": f"""
SELECT c_custkey AS profile_id, concat('company ', c_custkey % 211, ' of the north|', CASE WHEN c_custkey % 9 = 0 THEN 'company 20' ELSE 'no such firm' END) AS company_exclude,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 4 = 1 END AS has_clearance, {_item("remote|hybrid|flexible||", "c_custkey")} AS hard_remote, c_custkey % 3 * 40000 AS hard_salary_min,
  concat('field', c_custkey % 53) AS exclude_industries, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('area', c_custkey % 61, '|trade', c_custkey % 13) END AS exclude_company_types,
  CASE WHEN c_custkey % 3 = 0 THEN 'lead' ELSE concat('trade', c_custkey % 89) END AS exclude_titles, {_item("us|canada|uk||", "c_custkey")} AS countries, {_item("tx|toronto|new mexico|||", "c_custkey")} AS areas,
  CASE WHEN c_custkey % 500 = 7 THEN '' ELSE concat('Craft', c_custkey % 97, ' Trade', c_custkey * 7 % 89, '|Trade', c_custkey * 3 % 89, ' Lead') END AS job_titles, '' AS preferred_locations,
  {_item("Fair pay|Good team|Remote work|Salary over 100k||", "c_custkey")} AS must_haves, {_item("Tea|Bikes|Books||", "c_custkey")} AS nice_to_haves, {_item("remote|hybrid|flexible|unknown|on-site|", "c_custkey")} AS work_style, c_custkey % 2 * 90000 AS pay_wish
FROM customer""",
    "stored_verdicts": f"""
SELECT o_custkey AS profile_id, o_orderkey AS job_key, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '[Hard filter] x' WHEN o_orderkey % 11 = 0 THEN '[Title filter] y' ELSE 'fits' END AS match_notes,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('', DATE '{AS_OF}' - CAST(o_orderkey % 60 AS INT)) END AS date_posted, DATE '{AS_OF}' - CAST(o_orderkey % 45 AS INT) AS date_found,
  CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'no json {{' WHEN 2 THEN '{{"category":"skill","job_side":"x"}}' WHEN 3 THEN '[]' WHEN 4 THEN '[1, "skill", null, {{"category":"Domain","job_side":"5 years","job_importance":"required"}}]'
   ELSE concat('[{{"category":"', {_item("skill|Experience|domain", "o_orderkey")}, '","job_side":"', {_item("SQL|  |Rust|", "o_custkey")}, '","candidate_side":', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"knows it"' END, ',"job_importance":"', {_item("required|preferred|nice_to_have|odd|", "(o_orderkey + o_custkey)")}, '"}},',
     '{{"category":"', {_item("compensation|equity|benefits|work_arrangement|culture_growth|weather", "o_custkey")}, '","job_side":"', {_item("Not disclosed|Free tea|120k", "(o_orderkey + o_custkey)")}, '"', CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE ',"candidate_side":"wants it"' END, ',"candidate_priority":"', {_item("must_have|nice_to_have|", "o_orderkey")}, '"}}, {{"category":"skill","job_side":"Go","candidate_side":"Go","job_importance":"required"}}]') END AS pairs_json
FROM orders""",
    "usage": "SELECT event_type AS service, CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 15 ELSE 31 END AS reset_day, count(*) AS n FROM events GROUP BY 1, 2, 3",
}


def derive(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The derived view over the given tables."""
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}") if tables else VIEWS[name]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view over the tables of sf_dir."""
    used = [t for t in ("orders", "lineitem", "supplier", "events", "pages", "customer") if f"FROM {t}" in VIEWS[name]]
    return derive(spark, name, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str) -> str:
    """Oracle text: sql behind the definitions of the views it names."""
    used = [n for n in VIEWS if n in sql]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + " " + sql
