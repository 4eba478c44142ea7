"""Feeds of four shapes, each mapped to the common posting columns; no feed needs a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import normalize

#: Columns of every feed's rows; the pay and the origin of those that keep them.
COMMON = ["title", "company", "location", "remote_type", "description", "apply_url", "source", "date_posted"]
PAY = ["salary_min", "salary_max", "salary_currency", "salary_period", "salary_raw"]
WHOLE = [*COMMON, *PAY, "source_company_slug", "raw_data"]
#: Fields read of one entry of each feed.
BOARD = "title string, location string, absolute_url string, content string, company_name string, updated_at string"
LISTING = "text string, categories struct<location:string,allLocations:array<string>>, applyUrl string, hostedUrl string, descriptionPlain string, description string, lists array<struct<text:string,content:string>>, createdAt bigint"
SEARCHED = "job_title string, employer_name string, job_city string, job_state string, job_country string, job_employment_type string, job_apply_link string, job_description string, job_posted_at_datetime_utc string, job_posted_at string, job_min_salary string, job_max_salary string, job_salary_period string, job_salary_currency string"
SCRAPED = "title string, company string, location string, job_type string, job_url string, job_url_direct string, description string, site string, date_posted string, min_amount string, max_amount string, interval string, currency string"


def filled(*choices: Column) -> Column:
    """First choice that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices), F.lit(""))


def day(text: Column) -> Column:
    """First ten characters if they are a date, else null."""
    return F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))).cast("string")


def raw_jobs(dumps: DataFrame) -> DataFrame:
    """(slug, place, raw_data) of company boards (slug, body): each job's own JSON text, with all its fields, by its place in the list."""
    jobs = F.from_json("body", "jobs array<string>")["jobs"]
    return dumps.select("slug", F.posexplode(jobs).alias("place", "raw_data"))


def _no_pay() -> list[Column]:
    kinds = {"salary_min": "long", "salary_max": "long", "salary_raw": "string"}
    return [F.lit(None).cast(kinds[c]).alias(c) if c in kinds else F.lit({"salary_currency": "USD", "salary_period": "annual"}[c]).alias(c) for c in PAY]


def board_dump(dumps: DataFrame) -> DataFrame:
    """Company boards (slug, body), body being an object with a list of jobs; a broken body gives no rows."""
    j = raw_jobs(dumps).select("slug", "raw_data", F.from_json("raw_data", BOARD).alias("j")).select("slug", "raw_data", "j.*")
    place = F.coalesce(F.get_json_object("location", "$.name"), F.lit(""))
    return j.select(
        filled(F.col("title")).alias("title"),
        filled(F.col("company_name"), F.col("slug")).alias("company"),
        place.alias("location"),
        normalize.infer_remote_type(F.col("title"), place).alias("remote_type"),
        filled(F.col("content")).alias("description"),
        filled(F.col("absolute_url")).alias("apply_url"),
        F.lit("greenhouse").alias("source"),
        day(F.col("updated_at")).alias("date_posted"),
        *_no_pay(),
        F.col("slug").alias("source_company_slug"),
        "raw_data",
    )


def postings_list(dumps: DataFrame) -> DataFrame:
    """Bare arrays of postings (slug, body); the time of creation in milliseconds becomes its UTC date."""
    raw = dumps.select("slug", F.explode(F.from_json("body", "array<string>")).alias("raw_data"))
    p = raw.select("slug", "raw_data", F.from_json("raw_data", LISTING).alias("p")).select("slug", "raw_data", "p.*")
    place = filled(F.col("categories.location"), F.array_join(F.col("categories.allLocations"), ", "))
    parts = F.filter(F.flatten(F.transform("lists", lambda x: F.array(x["text"], x["content"]))), lambda x: F.coalesce(x, F.lit("")) != "")
    text = filled(F.col("descriptionPlain"), F.col("description"), F.array_join(parts, "\n"))
    return p.select(
        filled(F.col("text")).alias("title"),
        F.col("slug").alias("company"),
        place.alias("location"),
        normalize.infer_remote_type(place, F.substring(text, 1, 500)).alias("remote_type"),
        text.alias("description"),
        filled(F.col("applyUrl"), F.col("hostedUrl")).alias("apply_url"),
        F.lit("lever").alias("source"),
        F.date_from_unix_date(F.floor(F.col("createdAt") / 86_400_000).cast("int")).cast("string").alias("date_posted"),
        *_no_pay(),
        F.col("slug").alias("source_company_slug"),
        "raw_data",
    )


def _common_search(as_of: Column) -> dict[str, Column]:
    tail = filled(F.col("job_state"), F.when(F.col("job_country") != "US", F.col("job_country")))
    place = F.btrim(F.concat(filled(F.col("job_city")), F.lit(", "), tail), F.lit(", "))
    return {
        "title": filled(F.col("job_title")),
        "company": filled(F.col("employer_name")),
        "location": place,
        "remote_type": normalize.infer_remote_type(F.col("job_employment_type"), F.col("job_title"), place),
        "description": filled(F.col("job_description")),
        "apply_url": filled(F.col("job_apply_link")),
        "source": F.lit("jsearch"),
        "date_posted": F.coalesce(day(F.col("job_posted_at_datetime_utc")), normalize.parse_relative_date(F.col("job_posted_at"), as_of)),
    }


def search_api(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows of a search service: city with state, or with a country other than US; the exact date before the relative one."""
    return rows.select(*(c.alias(n) for n, c in _common_search(as_of).items()))


def _common_scraped() -> dict[str, Column]:
    return {
        "title": filled(F.col("title")),
        "company": filled(F.col("company")),
        "location": filled(F.col("location")),
        "remote_type": normalize.infer_remote_type(F.col("job_type"), F.col("title"), F.col("location"), words=normalize.SCRAPED_WORDS),
        "description": F.when(F.lower(F.btrim("description")) == "nan", "").otherwise(filled(F.col("description"))),
        "apply_url": filled(F.col("job_url"), F.col("job_url_direct")),
        "source": F.concat(F.lit("jobspy_"), filled(F.col("site"), F.lit("jobspy"))),
        "date_posted": F.substring("date_posted", 1, 10),
    }


def scraped(rows: DataFrame) -> DataFrame:
    """Scraped rows; the text nan is no description."""
    return rows.select(*(c.alias(n) for n, c in _common_scraped().items()))


def _paid(lines: DataFrame, fields: str, common: dict[str, Column], pay: dict[str, Column]) -> DataFrame:
    """WHOLE of lines (body, one JSON object each); a body that is no object gives no row."""
    objects = lines.where(F.startswith(F.ltrim("body"), F.lit("{")) & F.try_parse_json("body").isNotNull())
    read = objects.select("body", F.from_json("body", fields).alias("r"))
    columns = common | pay | {"source_company_slug": F.lit(None).cast("string"), "raw_data": F.col("body")}
    return read.select("body", "r.*").select(*(columns[c].alias(c) for c in WHOLE))


def search_lines(lines: DataFrame, as_of: Column) -> DataFrame:
    """search_api's rows of landed lines (body), with pay as stated and the line itself; a line that is no JSON object goes."""
    low, high, raw = normalize.stated_pay(F.col("job_min_salary"), F.col("job_max_salary"), F.col("job_salary_period"), F.col("job_salary_currency"))
    pay = [low, high, normalize.stated_currency(F.col("job_salary_currency")), normalize.stated_period(F.col("job_salary_period")), raw]
    return _paid(lines, SEARCHED, _common_search(as_of), dict(zip(PAY, pay, strict=True)))


def scraped_lines(lines: DataFrame) -> DataFrame:
    """scraped's rows of landed lines (body), with pay and the line itself; a line that is no JSON object goes. The pay is
    yearly, and as elsewhere its currency stands in the text alone."""
    low, high, raw = normalize.scraped_amounts(F.col("min_amount"), F.col("max_amount"), F.col("interval"), F.col("currency"))
    return _paid(lines, SCRAPED, _common_scraped(), dict(zip(PAY, [low, high, F.lit("USD"), F.lit("annual"), raw], strict=True)))


def union_sources(*feeds: DataFrame, columns: list[str] = COMMON) -> DataFrame:
    """All feeds in the order given, with source_rank, which settles who comes first among equal keys."""
    return reduce(DataFrame.unionByName, (f.select(*columns, F.lit(i).alias("source_rank")) for i, f in enumerate(feeds)))


def discover_board_slugs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(ats, slug) found in apply links (column apply_options, array of link and url) and not known yet."""
    url = filled(F.col("o.link"), F.col("o.url"))
    links = rows.select(F.explode("apply_options").alias("o")).select(url.alias("url"))
    slug = lambda host: F.lower(F.regexp_extract("url", rf"{host}/([^/?#]+)", 1))
    pair = lambda ats, host: F.struct(F.lit(ats).alias("ats"), slug(host).alias("slug"))
    found = links.select(F.inline(F.array(pair("greenhouse", r"boards\.greenhouse\.io"), pair("lever", r"jobs\.lever\.co"))))
    return found.where("slug <> ''").distinct().join(known.select("ats", "slug"), ["ats", "slug"], "left_anti")


def new_boards(rows: DataFrame, known: DataFrame) -> DataFrame:
    """discover_board_slugs' boards as rows of the table of boards: company (the slug, until someone knows better), ats,
    slug, and verified, which is false."""
    return discover_board_slugs(rows, known).select(F.col("slug").alias("company"), "ats", "slug", F.lit(False).alias("verified"))


def read_landed(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """WHOLE, with source_rank, of all feeds landed under path as text, one dump or row a line, in feed=<name>/slug=<board>.

    Files are read where they lie, by whatever file system holds them, and each feed's reader is given its folder alone.
    A feed of another kind joins in as one more function from lines (slug, body) to WHOLE.
    """
    lines = spark.read.schema("body string, feed string, slug string").text(path)
    of = lambda feed: lines.where(F.col("feed") == feed)
    feeds = [board_dump(of("greenhouse")), postings_list(of("lever")), search_lines(of("jsearch"), as_of), scraped_lines(of("jobspy"))]
    return union_sources(*feeds, columns=WHOLE)
