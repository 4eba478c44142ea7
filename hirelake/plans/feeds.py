"""Registered queries of the feed shapes. Boards come in pages of BATCH ids, so that no body grows with its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..sources import feeds, normalize
from ..sources.folders import shared_folder
from .fixtures import AS_OF, view
from .queries import query

BATCH = 500
DATED = "regexp_matches(date_posted, '^[0-9]{4}')"
KIND = lambda text: f"CASE WHEN contains(lower({text}), 'remote') THEN 'remote' WHEN contains(lower({text}), 'hybrid') THEN 'hybrid' WHEN regexp_matches(lower({text}), 'on-site|onsite|in office|in-office') THEN 'on-site' ELSE 'unknown' END"

BOARD = f"SELECT title, CASE WHEN company = '' THEN 'page' ELSE company END AS company, place AS location, {KIND("concat(title, ' ', place)")} AS remote_type, concat('About ', title) AS description, concat('https://a/', seq) AS apply_url, 'greenhouse' AS source, CASE WHEN {DATED} THEN date_posted END AS date_posted FROM (SELECT *, CASE WHEN seq % 8 = 0 THEN '' ELSE location END AS place FROM postings WHERE source = 'greenhouse')"
LIST = f"SELECT title, 'page' AS company, place AS location, {KIND("concat(place, ' ', body)")} AS remote_type, body AS description, concat('https://b/', seq) AS apply_url, 'lever' AS source, concat('', date_found) AS date_posted FROM (SELECT *, CASE WHEN seq % 8 = 1 THEN 'Paris, Rome' ELSE location END AS place, CASE seq % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'an onsite role' ELSE concat('Tasks', chr(10), 'do', chr(10), 'more') END AS body FROM postings WHERE source = 'lever')"
SEARCH = f"SELECT title, company, place AS location, {KIND("concat(kind, ' ', title, ' ', place)")} AS remote_type, '' AS description, concat('https://c/', seq) AS apply_url, 'jsearch' AS source, CASE WHEN {DATED} THEN date_posted ELSE CASE posted_text WHEN '3 days ago' THEN '2024-01-28' WHEN 'today' THEN '{AS_OF}' WHEN '2 weeks ago' THEN '2024-01-17' WHEN '1 month ago' THEN '2024-01-01' WHEN '5 hours ago' THEN '{AS_OF}' WHEN '2024-01-05T10:00:00' THEN '2024-01-05' END END AS date_posted FROM (SELECT *, CASE seq % 3 WHEN 0 THEN 'Bonn, NW' WHEN 1 THEN 'Bonn, DE' ELSE 'Bonn' END AS place, CASE WHEN seq % 5 = 0 THEN 'Hybrid' ELSE '' END AS kind FROM postings WHERE source = 'jsearch')"
SCRAPED = f"SELECT title, company, location, {KIND("concat(kind, ' ', title, ' ', location)")} AS remote_type, CASE WHEN seq % 3 = 0 THEN '' ELSE 'text' END AS description, concat(CASE WHEN seq % 5 = 0 THEN 'https://d/' ELSE 'https://e/' END, seq) AS apply_url, 'jobspy_site' AS source, left(date_posted, 10) AS date_posted FROM (SELECT *, CASE WHEN seq % 7 = 0 THEN 'Onsite' ELSE '' END AS kind FROM postings WHERE source = 'jobspy_site')"


def bodies(rows, item, wrap):
    """(slug, body): JSON pages of the items."""
    page = rows.groupBy((F.col("seq") / BATCH).cast("long").alias("page")).agg(F.to_json(wrap(F.collect_list(item))).alias("body"))
    return page.select(F.lit("page").alias("slug"), "body")


@query("normalize_board_dump", BOARD)
def normalize_board_dump(spark, d):
    rows = view(spark, d, "postings").where("source = 'greenhouse'")
    place = F.when(F.col("seq") % 8 == 0, F.col("location")).otherwise(F.to_json(F.struct(F.col("location").alias("name"))))
    stamp = F.concat("date_posted", F.lit("T10:00:00-05:00"))
    item = F.struct("title", place.alias("location"), F.concat(F.lit("https://a/"), "seq").alias("absolute_url"), F.concat(F.lit("About "), "title").alias("content"), F.col("company").alias("company_name"), stamp.alias("updated_at"))
    return feeds.board_dump(bodies(rows, item, lambda x: F.struct(x.alias("jobs")))).select(feeds.COMMON)


@query("normalize_postings_list", LIST)
def normalize_postings_list(spark, d):
    rows, k = view(spark, d, "postings").where("source = 'lever'"), F.col("seq")
    where = F.when(k % 8 == 1, F.struct(F.lit("").alias("location"), F.array(F.lit("Paris"), F.lit("Rome")).alias("allLocations"))).otherwise(F.struct("location", F.array().cast("array<string>").alias("allLocations")))
    lists = F.array(F.struct(F.lit("Tasks").alias("text"), F.lit("do").alias("content")), F.struct(F.lit("").alias("text"), F.lit("more").alias("content")))
    url = F.concat(F.lit("https://b/"), "seq")
    item = F.struct(F.col("title").alias("text"), where.alias("categories"), F.when(k % 16 == 1, url).alias("applyUrl"), url.alias("hostedUrl"), F.when(k % 3 == 0, "plain").alias("descriptionPlain"), F.when(k % 3 == 1, "an onsite role").alias("description"), lists.alias("lists"), (F.unix_date("date_found") * F.lit(86_400_000).cast("long") + 43_200_000).alias("createdAt"))
    return feeds.postings_list(bodies(rows, item, lambda x: x)).select(feeds.COMMON)


@query("normalize_search_api", SEARCH)
def normalize_search_api(spark, d):
    k = F.col("seq")
    rows = view(spark, d, "postings").where("source = 'jsearch'")
    raw = rows.select(F.col("title").alias("job_title"), F.col("company").alias("employer_name"), F.lit("Bonn").alias("job_city"), F.when(k % 3 == 0, "NW").alias("job_state"), F.when(k % 3 == 2, "US").otherwise("DE").alias("job_country"), F.when(k % 5 == 0, "Hybrid").alias("job_employment_type"), F.lit(None).cast("string").alias("job_description"), F.concat(F.lit("https://c/"), "seq").alias("job_apply_link"), F.concat("date_posted", F.lit("T08:00:00Z")).alias("job_posted_at_datetime_utc"), F.col("posted_text").alias("job_posted_at"))
    return feeds.search_api(raw, F.lit(AS_OF).cast("date"))


@query("normalize_scraped_rows", SCRAPED)
def normalize_scraped_rows(spark, d):
    k = F.col("seq")
    rows = view(spark, d, "postings").where("source = 'jobspy_site'")
    return feeds.scraped(rows.select("title", "company", "location", F.when(k % 7 == 0, "Onsite").alias("job_type"), F.when(k % 3 == 0, "nan").otherwise("text").alias("description"), F.when(k % 5 != 0, F.concat(F.lit("https://e/"), "seq")).alias("job_url"), F.concat(F.lit("https://d/"), "seq").alias("job_url_direct"), F.lit("site").alias("site"), "date_posted"))


@query("union_sources", " UNION ALL ".join(f"(SELECT *, {i} AS source_rank FROM ({s}))" for i, s in enumerate((BOARD, LIST, SEARCH, SCRAPED))))
def union_sources(spark, d):
    return feeds.union_sources(normalize_board_dump(spark, d), normalize_postings_list(spark, d), normalize_search_api(spark, d), normalize_scraped_rows(spark, d))


@query("board_raw_jobs", "SELECT seq, concat('{\"seq\":', seq, ',\"title\":\"', title, '\",\"more\":[1,2]}') AS raw_data FROM postings WHERE source = 'greenhouse'")
def board_raw_jobs(spark, d):
    rows = view(spark, d, "postings").where("source = 'greenhouse'")
    item = F.struct("seq", "title", F.array(F.lit(1), F.lit(2)).alias("more"))
    raw = feeds.raw_jobs(bodies(rows, item, lambda x: F.struct(x.alias("jobs"))))
    return raw.select(F.get_json_object("raw_data", "$.seq").cast("long").alias("seq"), "raw_data")


_FACTOR = "CASE pay_period WHEN 'hourly' THEN 2080 WHEN 'monthly' THEN 12 ELSE 1 END"
_COIN = "CASE seq % 3 WHEN 0 THEN 'EUR' ELSE 'USD' END"


@query("search_api_pay", f"SELECT seq, low * {_FACTOR} AS salary_min, nullif(pay_high * {_FACTOR}, 0) AS salary_max, CASE WHEN low IS NOT NULL OR pay_high > 0 THEN concat(CASE WHEN low IS NULL THEN 'None' ELSE concat('', low) END, '-', pay_high, ' ', {_COIN}, ' ', pay_period) END AS salary_raw FROM (SELECT *, CASE WHEN seq % 5 > 0 THEN pay_low END AS low FROM postings)")
def search_api_pay(spark, d):
    k = F.col("seq")
    low, high, raw = normalize.stated_pay(F.when(k % 5 > 0, F.col("pay_low")), F.col("pay_high"), F.upper("pay_period"), F.when(k % 3 == 0, "EUR").when(k % 3 == 1, ""))
    return view(spark, d, "postings").select("seq", low.alias("salary_min"), high.alias("salary_max"), raw.alias("salary_raw"))


@query("scraped_rows_pay", f"SELECT seq, low AS salary_min, pay_high * {_FACTOR} AS salary_max, CASE WHEN low > 0 OR pay_high > 0 THEN concat(CASE WHEN low IS NULL THEN 'None' ELSE concat('', low) END, '-', pay_high * {_FACTOR}, ' ', {_COIN}, ' ', pay_period) END AS salary_raw FROM (SELECT *, CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN pay_low * 1000 * {_FACTOR} ELSE pay_low * {_FACTOR} END AS low FROM postings)")
def scraped_rows_pay(spark, d):
    """Amounts as texts: nan, with comma and dollar sign, or plain."""
    k = F.col("seq")
    text = F.when(k % 5 == 0, "nan").when(k % 5 == 1, F.concat(F.lit("$ "), "pay_low", F.lit(",000"))).otherwise(F.col("pay_low").cast("string"))
    low, high, raw = normalize.scraped_amounts(text, F.col("pay_high").cast("string"), F.col("pay_period"), F.when(k % 3 == 0, "EUR"))
    return view(spark, d, "postings").select("seq", low.alias("salary_min"), high.alias("salary_max"), raw.alias("salary_raw"))


@query("discover_board_slugs", "SELECT DISTINCT ats, slug FROM (SELECT CASE WHEN seq % 2 = 0 THEN 'greenhouse' ELSE 'lever' END AS ats, concat('co', seq % 211) AS slug FROM postings WHERE seq % 3 < 2) WHERE slug NOT IN ('co0', 'co7')")
def discover_board_slugs(spark, d):
    k = F.col("seq")
    url = F.concat(F.when(k % 2 == 0, "https://boards.greenhouse.io/Co").otherwise("https://jobs.lever.co/cO"), k % 211, F.lit("/apply?x=1"))
    option = F.struct(F.when(k % 3 == 0, url).alias("link"), F.when(k % 3 == 1, url).otherwise("https://example.org/").alias("url"))
    known = spark.createDataFrame([(a, s) for a in ("greenhouse", "lever") for s in ("co0", "co7")], "ats string, slug string")
    return feeds.discover_board_slugs(view(spark, d, "postings").select(F.array(option).alias("apply_options")), known)


@query("new_boards", "SELECT DISTINCT slug AS company, ats, slug, false AS verified FROM (SELECT CASE WHEN seq % 2 = 0 THEN 'greenhouse' ELSE 'lever' END AS ats, concat('co', seq % 211) AS slug FROM postings WHERE seq % 3 < 2) WHERE slug NOT IN ('co0', 'co7')")
def new_boards(spark, d):
    url = F.concat(F.when(F.col("seq") % 2 == 0, "https://boards.greenhouse.io/Co").otherwise("https://jobs.lever.co/cO"), F.col("seq") % 211)
    option = F.struct(F.when(F.col("seq") % 3 == 0, url).alias("link"), F.when(F.col("seq") % 3 == 1, url).alias("url"))
    known = spark.createDataFrame([(a, s) for a in ("greenhouse", "lever") for s in ("co0", "co7")], "ats string, slug string")
    return feeds.new_boards(view(spark, d, "postings").select(F.array(option).alias("apply_options")), known)


BOARDS = 16


def land(spark, d, path: str) -> None:
    """Lands every posting of the fixture, the columns' odd cases included, as its feed would send it."""
    rows = view(spark, d, "postings")
    k, board = F.col("seq"), F.concat(F.lit("board"), F.floor(F.col("seq") / BATCH) % BOARDS).alias("slug")
    of = lambda source: rows.where(F.col("source") == source)
    link = lambda host: F.concat(F.lit(f"https://{host}/"), "seq")

    def pages(source, item, wrap):
        page = of(source).groupBy(board, F.floor(k / BATCH).alias("page")).agg(F.collect_list(item).alias("items"))
        return page.select(F.lit(source).alias("feed"), "slug", F.to_json(wrap("items")).alias("body"))

    def lines(source, feed, *fields):
        return of(source).select(F.lit(feed).alias("feed"), F.lit("all").alias("slug"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))

    dumps = [
        pages("greenhouse", F.struct("title", F.struct(F.col("location").alias("name")).alias("location"), link("a").alias("absolute_url"), F.concat("date_posted", F.lit("T10:00:00-05:00")).alias("updated_at")), lambda x: F.struct(F.col(x).alias("jobs"))),
        pages("lever", F.struct(F.col("title").alias("text"), F.struct("location").alias("categories"), link("b").alias("hostedUrl"), F.when(k % 3 == 0, "a hybrid job").alias("descriptionPlain"), (F.unix_date("date_found") * F.lit(86_400_000).cast("long")).alias("createdAt")), F.col),
        lines("jsearch", "jsearch", F.col("title").alias("job_title"), F.col("company").alias("employer_name"), F.lit("Bonn").alias("job_city"), F.when(k % 3 == 1, "DE").otherwise("US").alias("job_country"), link("c").alias("job_apply_link"), F.col("posted_text").alias("job_posted_at"), F.when(k % 5 > 0, F.col("pay_low")).alias("job_min_salary"), F.col("pay_high").alias("job_max_salary"), F.upper("pay_period").alias("job_salary_period"), F.when(k % 3 == 0, "EUR").when(k % 3 == 1, "").alias("job_salary_currency")),
        lines("jobspy_site", "jobspy", "title", "company", "location", F.when(k % 7 == 0, "in-office").when(k % 7 == 1, "Onsite").alias("job_type"), link("d").alias("job_url"), F.when(k % 3 == 0, " NaN").otherwise("text").alias("description"), F.when(k % 3 > 0, "site").alias("site"), "date_posted", F.when(k % 5 == 0, "nan").otherwise(F.concat(F.lit("$"), "pay_low", F.lit(",000"))).alias("min_amount"), F.col("pay_high").alias("max_amount"), F.col("pay_period").alias("interval")),
    ]
    broken = spark.createDataFrame([(f, "odd", b) for f in ("greenhouse", "lever", "jsearch", "jobspy") for b in ("", "no json", "[", "{}" if f in ("greenhouse", "lever") else "[1]")], "feed string, slug string, body string")
    union = broken
    for dump in dumps:
        union = union.unionByName(dump)
    union.write.mode("overwrite").partitionBy("feed", "slug").text(path)


def _common(rank: int, company: str, place: str, kind: str, text: str, host: str, source: str, posted: str, pay: str, slug: str, raw: str, origin: str) -> str:
    return f"SELECT title, {company} AS company, {place} AS location, {kind} AS remote_type, {text} AS description, concat('https://{host}/', seq) AS apply_url, {source} AS source, {posted} AS date_posted, {pay}, {slug} AS source_company_slug, {raw} AS raw_data, {rank} AS source_rank FROM (SELECT *, concat('board', seq // {BATCH} % {BOARDS}) AS board FROM postings) WHERE source = '{origin}'"


_FREE = "NULL AS salary_min, NULL AS salary_max, 'USD' AS salary_currency, 'annual' AS salary_period, NULL AS salary_raw"
_POSTED = f"CASE posted_text WHEN '3 days ago' THEN '2024-01-28' WHEN 'today' THEN '{AS_OF}' WHEN '2 weeks ago' THEN '2024-01-17' WHEN '1 month ago' THEN '2024-01-01' WHEN '5 hours ago' THEN '{AS_OF}' WHEN '2024-01-05T10:00:00' THEN '2024-01-05' END"
_STATED_LOW, _SCRAPED_LOW = "CASE WHEN seq % 5 > 0 THEN pay_low END", f"CASE WHEN seq % 5 > 0 THEN pay_low * 1000 * {_FACTOR} END"
_COINS = "CASE seq % 3 WHEN 0 THEN 'EUR' ELSE 'USD' END"
_TYPE = "CASE seq % 7 WHEN 0 THEN 'in-office' WHEN 1 THEN 'Onsite' END"
_NONE = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'None')"
_SITE = "CASE WHEN seq % 3 > 0 THEN 'site' END"
_WORDS = "lower(concat(coalesce(job_type, ''), ' ', title, ' ', location))"
_ROWS = [
    _common(0, "board", "location", KIND("concat(title, ' ', location)"), "''", "a", "'greenhouse'", f"CASE WHEN {DATED} THEN date_posted END", _FREE, "board", "concat('{\"title\":\"', title, '\",\"location\":{\"name\":\"', location, '\"},\"absolute_url\":\"https://a/', seq, '\"', CASE WHEN date_posted IS NULL THEN '' ELSE concat(',\"updated_at\":\"', date_posted, 'T10:00:00-05:00\"') END, '}')", "greenhouse"),
    _common(1, "board", "location", KIND("concat(location, ' ', CASE WHEN seq % 3 = 0 THEN 'hybrid' ELSE '' END)"), "CASE WHEN seq % 3 = 0 THEN 'a hybrid job' ELSE '' END", "b", "'lever'", "concat('', date_found)", _FREE, "board", "concat('{\"text\":\"', title, '\",\"categories\":{\"location\":\"', location, '\"},\"hostedUrl\":\"https://b/', seq, CASE WHEN seq % 3 = 0 THEN '\",\"descriptionPlain\":\"a hybrid job' ELSE '' END, '\",\"createdAt\":', epoch_ms(CAST(date_found AS TIMESTAMP)), '}')", "lever"),
    _common(2, "company", "CASE WHEN seq % 3 = 1 THEN 'Bonn, DE' ELSE 'Bonn' END", KIND("title"), "''", "c", "'jsearch'", _POSTED, f"nullif({_STATED_LOW} * {_FACTOR}, 0) AS salary_min, nullif(pay_high * {_FACTOR}, 0) AS salary_max, {_COINS} AS salary_currency, CASE pay_period WHEN 'weekly' THEN 'weekly' ELSE 'annual' END AS salary_period, CASE WHEN seq % 5 > 0 OR pay_high > 0 THEN concat({_NONE(_STATED_LOW)}, '-', pay_high, ' ', {_COINS}, ' ', pay_period) END AS salary_raw", "NULL", f"to_json({{'job_title': title, 'employer_name': company, 'job_city': 'Bonn', 'job_country': CASE WHEN seq % 3 = 1 THEN 'DE' ELSE 'US' END, 'job_apply_link': concat('https://c/', seq), 'job_posted_at': posted_text, 'job_min_salary': {_STATED_LOW}, 'job_max_salary': pay_high, 'job_salary_period': upper(pay_period), 'job_salary_currency': CASE seq % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN '' END}})::VARCHAR", "jsearch"),
    "SELECT * EXCLUDE (job_type) FROM (" + _common(3, "company", "location", f"CASE WHEN contains({_WORDS}, 'remote') THEN 'remote' WHEN contains({_WORDS}, 'hybrid') THEN 'hybrid' WHEN contains({_WORDS}, 'onsite') THEN 'on-site' ELSE 'unknown' END", "CASE WHEN seq % 3 = 0 THEN '' ELSE 'text' END", "d", "CASE WHEN seq % 3 > 0 THEN 'jobspy_site' ELSE 'jobspy_jobspy' END", "left(date_posted, 10)", f"{_SCRAPED_LOW} AS salary_min, pay_high * {_FACTOR} AS salary_max, 'USD' AS salary_currency, 'annual' AS salary_period, CASE WHEN seq % 5 > 0 OR pay_high > 0 THEN concat({_NONE(_SCRAPED_LOW)}, '-', pay_high * {_FACTOR}, ' USD ', pay_period) END AS salary_raw", "NULL", f"to_json({{'title': title, 'company': company, 'location': location, 'job_type': {_TYPE}, 'job_url': concat('https://d/', seq), 'description': CASE WHEN seq % 3 = 0 THEN ' NaN' ELSE 'text' END, 'site': {_SITE}, 'date_posted': date_posted, 'min_amount': CASE WHEN seq % 5 = 0 THEN 'nan' ELSE concat('$', pay_low, ',000') END, 'max_amount': pay_high, 'interval': pay_period}})::VARCHAR", "jobspy_site").replace("SELECT title,", f"SELECT {_TYPE} AS job_type, title,", 1) + ")",
]
_UNION = " UNION ALL ".join(f"({r})" for r in _ROWS)


def landed(spark, d):
    folder = shared_folder(spark, "feeds")
    land(spark, d, folder)
    return feeds.read_landed(spark, folder, F.lit(AS_OF).cast("date"))


@query("landed_feeds", _UNION)
def landed_feeds(spark, d):
    """Every posting landed as its feed sends it, among lines that are broken, and read as whole common rows."""
    return landed(spark, d)


@query("landed_feeds_paid", f"SELECT source, salary_period, salary_currency, count(*) AS n, count(*) FILTER (coalesce(salary_max, salary_min) < 80000) AS below FROM ({_UNION}) WHERE coalesce(salary_min, salary_max) IS NOT NULL OR salary_raw IS NOT NULL GROUP BY ALL")
def landed_feeds_paid(spark, d):
    """The search for stated pay on the union of feeds, and how many of those rows a floor would stop."""
    jobs = landed(spark, d).withColumn("job_key", F.col("apply_url"))
    paid = reports.found_jobs(jobs, jobs.select("job_key"), paid=True)
    return paid.groupBy("source", "salary_period", "salary_currency").agg(F.count("*").alias("n"), F.count_if(F.coalesce("salary_max", "salary_min") < 80_000).alias("below"))
