"""Hard requirements of profiles against postings; each rule is a predicate, the first that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pay
from . import country, location

#: Words of titles that carry no meaning.
TITLE_STOPWORDS = "senior junior lead staff principal associate head director vice president level with from this that will have been some more than".split()


def items(joined: Column) -> Column:
    """Array of a profile's bar-separated list."""
    return F.filter(F.split(F.lower(joined), r"\|"), lambda x: x != "")


def excluded_company(company: Column, names: Column) -> Column:
    """An excluded name holds the company or stands in it; a null company counts as empty, which every name holds."""
    low = F.lower(F.coalesce(company, F.lit("")))
    return F.exists(names, lambda x: F.contains(low, x) | F.contains(x, low))


def wrong_remote_type(kind: Column, wanted: Column) -> Column:
    """A known type other than the wanted one; a null type is unknown, a null wish is none."""
    kind, wanted = F.lower(F.coalesce(kind, F.lit("unknown"))), F.lower(F.coalesce(wanted, F.lit("")))
    return ~wanted.isin("", "flexible") & (kind != "unknown") & (kind != wanted)


def below_floor(low: Column, floor: Column) -> Column:
    """A known, non-zero lower bound under the floor."""
    return F.coalesce((low != 0) & (floor > 0) & (low < floor), F.lit(False))


def first_contained(text: Column, needles: Column) -> Column:
    """First needle that the text holds, else null."""
    low = F.lower(text)
    return F.get(F.filter(needles, lambda x: F.contains(low, x)), F.lit(0))


def stands_in(low: Column, phrase: Column) -> Column:
    """The phrase stands in the text between word bounds (both in lower case); a pattern is built only where the text holds it."""
    return F.contains(low, phrase) & F.rlike(low, F.concat(F.lit("\\b\\Q"), phrase, F.lit("\\E\\b")))


def excluded_title(title: Column, phrases: Column) -> Column:
    """First phrase (in lower case) that stands in the title between word bounds, else null."""
    low = F.lower(title)
    return F.get(F.filter(phrases, lambda x: stands_in(low, x)), F.lit(0))


def significant(text: Column) -> Column:
    """Words of four characters or more without stopwords."""
    parts = F.transform(F.split(F.lower(text), r"[\s/,\-]+"), lambda w: F.btrim(w, F.lit("().,")))
    return F.filter(parts, lambda w: (F.char_length(w) >= 4) & ~w.isin(TITLE_STOPWORDS))


def title_matches(title: Column, wanted: Column, words: Column | None = None, wanted_words: Column | None = None) -> Column:
    """No wanted titles, no title, a wanted phrase in the title, or a significant word in common; words and wanted_words
    are the significant ones of both, where they have been read."""
    title = F.coalesce(title, F.lit(""))
    low = F.lower(title)
    words = significant(low) if words is None else words
    wanted_words = significant(F.array_join(wanted, " ")) if wanted_words is None else wanted_words
    return (F.size(wanted) == 0) | (title == "") | F.exists(wanted, lambda x: F.contains(low, x)) | F.arrays_overlap(words, wanted_words)


def first_reason() -> Column:
    """Reason of the first failing rule over the columns of postings and profiles; null if all pass."""
    kind, title = first_contained(F.concat_ws(" ", "company", "title"), items(F.col("exclude_types"))), excluded_title(F.col("title"), items(F.col("exclude_titles")))
    return F.coalesce(
        F.when(excluded_company(F.col("company"), items(F.col("company_exclude"))), "company"),
        F.when(wrong_remote_type(F.col("remote_type"), F.col("remote_pref")), F.concat(F.lit("remote: "), "remote_type")),
        F.when(below_floor(F.col("salary_min"), F.col("salary_floor")), "salary"),
        F.concat(F.lit("type: "), kind),
        F.concat(F.lit("title: "), title),
    )


#: Characters of a description that the industry and company-type rules read.
SNIPPET = 300


def _low(c: str) -> Column:
    return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x))


def read_postings(postings: DataFrame) -> DataFrame:
    """postings with _place and _site, what their location tells of countries and areas, and _words, the significant ones
    of the title, for judge; all are read once for each posting, before it meets profiles, and no pair travels for them."""
    return postings.withColumns({"_place": country.place_read(F.col("location")), "_site": location.place_read(F.col("location")), "_words": significant(F.coalesce("title", F.lit("")))})


def read_profiles(profiles: DataFrame) -> DataFrame:
    """profiles with _wishes, _areas, _zones and _wanted, their countries, areas, zones of pay and the significant words of
    their titles as judge reads them."""
    return profiles.withColumns({"_wishes": country.wishes_read(F.col("countries")), "_areas": location.areas_read(F.col("areas")), "_zones": pay.zones_of(F.col("preferred_locations")), "_wanted": significant(F.array_join(_low("job_titles"), " "))})


def judge(pairs: DataFrame) -> DataFrame:
    """pairs of postings and profiles with reason, the text of the first hard requirement that fails (null: none does),
    and title_ok, the looser rule on wanted titles.

    Postings: company, title, location, remote_type, salary_min, description, needs_clearance, pay (candidates).
    Profiles: company_exclude, has_clearance, hard_remote, hard_salary_min, exclude_industries, exclude_company_types,
    exclude_titles, countries, areas, job_titles, preferred_locations (arrays but for has_clearance, hard_remote and
    hard_salary_min). Nulls count as empty, a null has_clearance as unsaid. Pairs whose sides went through read_postings
    and read_profiles have their places read already.
    """
    own = pairs.columns
    pairs = pairs if "_site" in own else read_postings(pairs)
    pairs = pairs if "_areas" in own else read_profiles(pairs)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    start = F.substring(text("description"), 1, SNIPPET)
    floor = F.coalesce("hard_salary_min", F.lit(0))
    least = F.coalesce("salary_min", F.when(F.size("pay") > 0, pay.choose_in(F.col("pay"), F.col("_zones"))["lo"]))
    reason = reason_text(
        company=excluded_company(F.col("company"), F.transform(_low("company_exclude"), lambda x: F.btrim(x))),
        remote=wrong_remote_type(F.col("remote_type"), F.col("hard_remote")),
        kind=F.lower(F.coalesce("remote_type", F.lit("unknown"))),
        wish=F.lower("hard_remote"),
        salary=below_floor(least, floor),
        least=F.format_number(least, 0),
        floor=F.format_number(floor, 0),
        phrase=F.coalesce(
            exclusion("Industry", first_contained(F.concat_ws(" ", text("company"), start), _low("exclude_industries"))),
            exclusion("Company type", first_contained(F.concat_ws(" ", text("company"), text("title"), start), _low("exclude_company_types"))),
            exclusion("Title", excluded_title(text("title"), F.transform(_low("exclude_titles"), lambda x: F.btrim(x)))),
        ),
        abroad=country.conflicts(F.col("_place"), F.col("_wishes")),
        far=location.far(F.col("_site"), F.col("remote_type"), F.col("_areas")),
    )
    return pairs.withColumns({"reason": reason, "title_ok": title_matches(F.col("title"), _low("job_titles"), F.col("_words"), F.col("_wanted"))}).drop("_place", "_site", "_words", "_wishes", "_areas", "_zones", "_wanted")


def exclusion(rule: str, phrase: Column) -> Column:
    """Reason of the industry, company-type and title rules."""
    return F.concat(F.lit(f"{rule} exclusion matched: '"), phrase, F.lit("'"))


def reason_text(*, company: Column, remote: Column, kind: Column, wish: Column, salary: Column, least: Column, floor: Column, phrase: Column, abroad: Column, far: Column) -> Column:
    """Text of the first rule that fails over the columns of the pair (company, location, has_clearance, needs_clearance)
    and what the other rules found: whether the company, the remote type (kind, not the wish), the salary (least, under the
    floor, both as text), the country and the area fail, and the exclusion by the first phrase."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.coalesce(
        F.when(company, F.concat(F.lit("Company '"), text("company"), F.lit("' is on the exclude list"))),
        F.when((F.col("has_clearance") == F.lit(False)) & F.col("needs_clearance"), "Job requires federal security clearance but candidate has none"),
        F.when(remote, F.concat(F.lit("Remote type '"), kind, F.lit("' does not match required '"), wish, F.lit("'"))),
        F.when(salary, F.concat(F.lit("Salary $"), least, F.lit(" is below required minimum $"), floor)),
        phrase,
        F.when(abroad, F.concat(F.lit("Location '"), text("location"), F.lit("' is outside required country"))),
        F.when(far, F.concat(F.lit("Job in '"), text("location"), F.lit("' is outside allowed locations and does not offer remote"))),
    )


def filter_verdicts(judged: DataFrame) -> DataFrame:
    """Hidden verdict rows (profile_id, seq, match_notes, hidden, match_score) of the pairs that a hard requirement or
    the title rule rejects."""
    notes = F.coalesce(F.concat(F.lit("[Hard filter] "), "reason"), F.when(~F.col("title_ok"), F.concat(F.lit("[Title filter] Title '"), F.coalesce("title", F.lit("")), F.lit("' contains no target-role keywords"))))
    return judged.select("profile_id", "seq", notes.alias("match_notes"), F.lit(True).alias("hidden"), F.lit(0.0).alias("match_score")).where("match_notes is not null")


def unjudged_pairs(jobs: DataFrame, profiles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each of jobs (seq) beside each of profiles (profile_id), without the pairs that any of verdicts records.

    The profiles are few and broadcast; the profile that fetched a posting plays no part.
    """
    pairs = jobs.drop("profile_id").crossJoin(F.broadcast(profiles))
    return pairs.join(verdicts.select("profile_id", "seq"), ["profile_id", "seq"], "left_anti")
