"""Fields read from listing text (FN-18..22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_END, SPACES, WHITE_CHARS, blank

# Field labels and section headings of listings.
TITLE_LABELS = ("job title", "position title", "role title", "position")
COMPANY_LABELS = ("company", "employer", "organization", "organisation")
LOCATION_LABELS = ("location", "job location", "work location")

SECTION_HEADINGS = {
    "responsibilities": (
        "responsibilities",
        "what you will do",
        "what you'll do",
        "the role",
        "your responsibilities",
        "key responsibilities",
    ),
    "required_skills": (
        "requirements",
        "required qualifications",
        "qualifications",
        "what you bring",
        "minimum qualifications",
    ),
    "preferred_skills": (
        "preferred qualifications",
        "preferred skills",
        "nice to have",
        "nice-to-have",
        "bonus qualifications",
    ),
}
OTHER_HEADINGS = (
    "about us",
    "about the company",
    "benefits",
    "compensation",
    "salary",
    "equal opportunity",
    "how to apply",
    "application process",
)
ALL_HEADINGS = tuple(h for group in SECTION_HEADINGS.values() for h in group) + OTHER_HEADINGS
SECTION_LINES = 20
AUTHORIZATION_LINES = 8

EMPLOYMENT_PATTERNS = (
    ("\\bintern(ship)?\\b", "internship"),
    ("\\bpart[ -]?time\\b", "part_time"),
    ("\\bcontract(or)?\\b", "contract"),
    ("\\btemporary\\b|\\btemp\\b", "temporary"),
    ("\\bfull[ -]?time\\b", "full_time"),
)
ARRANGEMENT_PATTERNS = (
    ("\\bhybrid\\b", "hybrid"),
    ("\\bremote\\b|work from home", "remote"),
    ("\\bon[ -]?site\\b|\\bin office\\b", "onsite"),
)
SENIORITY_PATTERNS = (
    ("\\bintern(ship)?\\b|\\bco-op\\b", "internship"),
    ("\\bprincipal\\b|\\bstaff\\b|\\bsenior\\b|\\bsr\\.?\\b", "senior"),
    ("\\blead\\b|\\bmanager\\b|\\bdirector\\b", "lead_manager"),
    ("\\bentry[ -]?level\\b|\\bnew grad\\b|\\bgraduate\\b", "entry_level"),
    ("\\bjunior\\b|\\bassociate\\b|\\bearly career\\b", "early_career"),
)
SENIORITY_SAMPLE = 1200

ROLLING = "(?i)open until filled|rolling applications?|applications? accepted on a rolling basis"
NO_DEADLINE = "(?i)no application deadline|deadline not stated|no deadline"
LABELED_DEADLINE = (
    "(?i)(?:application deadline|apply by|closing date|applications? close)"
    "\\s*[:\\-]?\\s*([^\\n.;]{4,40})"
)
DEADLINE_FORMATS = (
    ("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "yyyy-M-d"),
    ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
    ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "M-d-yyyy"),
    ("[A-Za-z]+ [0-9]{1,2}, [0-9]{4}", "MMMM d, yyyy"),
    ("[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}", "MMM d, yyyy"),
    ("[A-Za-z]+ [0-9]{1,2} [0-9]{4}", "MMMM d yyyy"),
    ("[A-Za-z]{3} [0-9]{1,2} [0-9]{4}", "MMM d yyyy"),
)

EDUCATION_LINE = "(?i)\\b(bachelor|master|ph\\.?d|degree|b\\.?s\\.?|m\\.?s\\.?)\\b"
AUTHORIZATION_LINE = (
    "(?i)sponsor|work authorization|authorized to work|visa|citizen|permanent resident"
)
HARD_DISQUALIFIER = "(?i)no sponsorship|cannot sponsor|must be (?:a )?u\\.?s\\.? citizen"


def first_of(patterns, text: Column, default: str = "unknown") -> Column:
    """Value of the first pattern that occurs."""
    result = F.when(F.lit(False), F.lit(default))
    for pattern, value in patterns:
        result = result.when(text.rlike(pattern), F.lit(value))
    return result.otherwise(F.lit(default))


def clean_line(line: Column) -> Column:
    bare = F.ltrim(line, F.lit(WHITE_CHARS + "-–—•*▪◦"))
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def clean_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(blank(text), LINE_END), clean_line), lambda x: x != "")


def heading_key(line: Column) -> Column:
    bare = F.regexp_replace(F.lower(line), ":+$", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9' -]+", ""))


def labeled_value(lines: Column, labels) -> Column:
    """FN-18: value of the first line that starts with one of the labels."""
    pattern = "(?i)^(?:" + "|".join(labels) + ")\\s*[:\\-]\\s*(.+)$"
    hit = F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))
    return F.coalesce(F.trim(F.regexp_extract(hit, pattern, 1)), F.lit(""))


def first_title(lines: Column) -> Column:
    """FN-18: first of six lines that is neither a heading nor a link and of fair length."""
    fair = F.filter(
        F.slice(lines, 1, 6),
        lambda x: ~heading_key(x).isin(*ALL_HEADINGS)
        & ~F.lower(x).rlike("^https?://")
        & F.length(x).between(3, 120),
    )
    return F.coalesce(F.get(fair, F.lit(0)), F.lit(""))


def section(lines: Column, keys: Column, headings) -> Column:
    """WIN-11: lines after the first of `headings` up to the next heading, 20 at most. One pass."""
    zero = F.lit(0)

    def step(acc: Column, key: Column) -> Column:
        at = acc["at"] + 1
        opens = (acc["start"] == 0) & key.isin(*headings)
        closes = (acc["start"] > 0) & (acc["stop"] == 0) & key.isin(*ALL_HEADINGS)
        return F.struct(
            at.alias("at"), F.when(opens, at).otherwise(acc["start"]).alias("start"),
            F.when(closes, at).otherwise(acc["stop"]).alias("stop"),
        )

    span = F.aggregate(
        keys, F.struct(zero.alias("at"), zero.alias("start"), zero.alias("stop")), step,
        lambda acc: F.struct(
            acc["start"], (F.when(acc["stop"] > 0, acc["stop"]).otherwise(acc["at"] + 1) - acc["start"] - 1).alias("size")
        ),
    )
    found = F.slice(lines, span["start"] + 1, F.least(span["size"], F.lit(SECTION_LINES)))
    return F.when(span["start"] == 0, F.slice(lines, 1, 0)).otherwise(found)


def employment_type(text: Column) -> Column:
    return first_of(EMPLOYMENT_PATTERNS, F.lower(blank(text)))


def work_arrangement(text: Column) -> Column:
    return first_of(ARRANGEMENT_PATTERNS, F.lower(blank(text)))


def seniority(title: Column, text: Column) -> Column:
    """The rule itself looks at the title and the opening of the listing only."""
    sample = F.lower(F.concat(blank(title), F.lit(" "), F.substring(blank(text), 1, SENIORITY_SAMPLE)))
    return first_of(SENIORITY_PATTERNS, sample)


def parse_date(value: Column, formats) -> Column:
    """First format that fits, NULL when none does. Shapes are checked before parsing."""
    # Month names are matched in any case, as written dates vary.
    tidy = F.initcap(value)
    attempts = [F.when(tidy.rlike(f"^{shape}$"), F.try_to_date(tidy, fmt)) for shape, fmt in formats]
    return F.coalesce(*attempts)


def deadline(text: Column) -> Column:
    """FN-20: struct<status, date>."""
    text = blank(text)
    stated = F.trim(F.regexp_extract(text, LABELED_DEADLINE, 1))
    parsed = parse_date(stated, DEADLINE_FORMATS)
    status = (
        F.when(text.rlike(ROLLING), "rolling")
        .when(text.rlike(LABELED_DEADLINE), F.when(parsed.isNotNull(), "confirmed").otherwise("unknown"))
        .when(text.rlike(NO_DEADLINE), "not_stated")
        .otherwise("unknown")
    )
    return F.struct(status.alias("status"), F.when(status == "confirmed", parsed).alias("date"))


def education_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(EDUCATION_LINE))


def authorization_lines(lines: Column) -> Column:
    """FN-22: the first eight lines on sponsorship, visas or citizenship."""
    return F.slice(F.filter(lines, lambda x: x.rlike(AUTHORIZATION_LINE)), 1, AUTHORIZATION_LINES)


# ---------------------------------------------------------------- FN-21
# What a listing page says about its state.
CLOSED_PHRASES = (
    "applications are closed",
    "application window has closed",
    "job has been closed",
    "job is no longer available",
    "job posting is no longer available",
    "no longer accepting applications",
    "position has been filled",
    "position is no longer available",
    "posting has closed",
    "role has been filled",
    "this job is no longer available",
    "this opportunity is no longer available",
    "this position is no longer available",
    "vacancy has been filled",
)
EXPIRED_PHRASES = (
    "application deadline has passed",
    "job has expired",
    "job posting has expired",
    "opportunity has expired",
    "posting has expired",
    "this job has expired",
)
GENERIC_PAGE_PHRASES = (
    "browse all jobs",
    "career opportunities",
    "explore careers",
    "find jobs",
    "job search",
    "join our talent community",
    "search all jobs",
    "search jobs",
    "view all jobs",
)
PAGE_ROLLING_PHRASES = (
    "applications accepted on a rolling basis",
    "applications are reviewed on a rolling basis",
    "open until filled",
    "rolling applications",
    "rolling basis",
)
PAGE_NO_DEADLINE_PHRASES = (
    "deadline not specified",
    "no application deadline",
    "no deadline is specified",
    "no deadline specified",
)
APPLY_PATTERN = (
    "(?i)^apply$|\\bapply now\\b|\\bapply for (?:this|the) (?:job|role|position)\\b"
    "|\\bstart (?:an |your )?application\\b|\\bsubmit (?:an |your )?application\\b"
)
APPLY_HREF = "(?:^|[/_-])(apply|application)(?:[/_?=&-]|$)"
DEADLINE_CUE = (
    "(?i)(?:application deadline|apply by|closing date"
    "|applications? (?:close|closes|must be received by)|deadline)\\s*(?:is|on|:|-)?\\s*(.{0,90})"
)
LONG_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
PAGE_DATE_PATTERNS = (
    "\\b(20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2})\\b",
    f"(?i)\\b((?:{LONG_MONTHS})\\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\\s+20[0-9]{{2}})\\b",
    f"(?i)\\b((?:{SHORT_MONTHS})\\.?\\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\\s+20[0-9]{{2}})\\b",
    f"(?i)\\b([0-9]{{1,2}}\\s+(?:{LONG_MONTHS})\\s+20[0-9]{{2}})\\b",
    "\\b([0-9]{1,2}/[0-9]{1,2}/20[0-9]{2})\\b",
    "\\b([0-9]{1,2}-[0-9]{1,2}-20[0-9]{2})\\b",
)
PAGE_DATE_FORMATS = (
    ("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "yyyy-M-d"),
    ("[A-Za-z]+ [0-9]{1,2} [0-9]{4}", "MMMM d yyyy"),
    ("[A-Za-z]{3} [0-9]{1,2} [0-9]{4}", "MMM d yyyy"),
    ("[0-9]{1,2} [A-Za-z]+ [0-9]{4}", "d MMMM yyyy"),
    ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
    ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "M-d-yyyy"),
)


def page_date(raw: Column) -> Column:
    """A date as written on a page: ISO start, or one of six written forms."""
    value = F.trim(F.regexp_replace(blank(raw), SPACES, " "))
    iso = F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"))
    plain = F.regexp_replace(value, "(?i)(?<=[0-9])(st|nd|rd|th)\\b", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "[,.]", ""), "(?i)\\bSept ", "Sep ")
    return F.coalesce(iso, parse_date(plain, PAGE_DATE_FORMATS))


def phrases_in(text: Column, phrases) -> Column:
    """The phrases that occur, in their listed order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]))


def cued_date(text: Column) -> Column:
    """First date that follows a deadline cue."""
    fragments = F.regexp_extract_all(text, F.lit(DEADLINE_CUE), F.lit(1))

    def in_fragment(fragment: Column) -> Column:
        return F.coalesce(*[page_date(F.regexp_extract(fragment, p, 1)) for p in PAGE_DATE_PATTERNS])

    return F.get(F.filter(F.transform(fragments, in_fragment), lambda d: d.isNotNull()), F.lit(0))
