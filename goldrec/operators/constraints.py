"""What every canonical record must keep, wherever it comes from: mapped, reloaded or merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldrec.functions.text import normal_url, strip
from goldrec.operators.validation import EMAIL

#: How many items a list may have, and the skills of one experience.
MOST_ITEMS = {"experiences": 200, "education": 50, "skills": 500, "certifications": 100, "languages": 50}
MOST_OWN_SKILLS = 500

#: A field, the test that finds it at fault (null is no fault), and why.
Fault = tuple[str, Column, str]


def blank(c: Column) -> Column:
    return strip(c) == ""


def too_many(field: str, size: Column) -> Fault:
    return field, size > MOST_ITEMS[field], f"has more than {MOST_ITEMS[field]} items"


def sizes(get: Callable[[str], Column]) -> list[Fault]:
    return [too_many(f, F.size(get(f))) for f in MOST_ITEMS]


def contact_faults(get: Callable[[str], Column]) -> list[Fault]:
    return [
        ("contact.email", ~get("email").rlike(EMAIL), "is not an e-mail address"), ("contact.phone", blank(get("phone")), "is blank"), ("contact.location", blank(get("location")), "is blank"),
        *((f"contact.{f}", get(f).isNotNull() & normal_url(get(f)).isNull(), "is not an http address") for f in ("linkedin_url", "github_url")),
    ]


def _some(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(items, lambda x: F.coalesce(test(x), F.lit(False)))


def experience_faults(items: Column, today: Column) -> list[Fault]:
    return [
        ("experiences", _some(items, lambda x: x.start_date > today), "starts in the future"),
        ("experiences", _some(items, lambda x: x.end_date < x.start_date), "ends before it starts"),
        ("experiences", _some(items, lambda x: blank(x.description)), "description is blank"),
        ("experiences", _some(items, lambda x: F.size(x.skills) > MOST_OWN_SKILLS), f"has more than {MOST_OWN_SKILLS} skills"),
    ]


def education_faults(items: Column) -> list[Fault]:
    return [
        ("education", _some(items, lambda x: x.end_date < x.start_date), "ends before it starts"),
        ("education", _some(items, lambda x: ~x.gpa.between(0, 4)), "gpa is outside 0 to 4"),
        ("education", _some(items, lambda x: blank(x.field_of_study)), "field_of_study is blank"),
    ]


def certification_faults(items: Column) -> list[Fault]:
    return [
        ("certifications", _some(items, lambda x: x.expiry_date < x.issued_date), "expires before it is issued"),
        ("certifications", _some(items, lambda x: blank(x.issuer)), "issuer is blank"),
    ]


def record_faults(today: Column | None = None) -> list[Fault]:
    """Of a canonical record's columns: required values, blanks, limits, dates. today bounds the start of an experience."""
    today = F.current_date() if today is None else today
    needed = lambda items, *names: F.exists(items, lambda x: F.greatest(*(F.coalesce(blank(x[n]), F.lit(True)) for n in names)) if len(names) > 1 else F.coalesce(blank(x[names[0]]), F.lit(True)))
    return [
        *((f, F.coalesce(blank(F.col(f)), F.lit(True)), "is missing or blank") for f in ("first_name", "last_name")), ("external_id", blank(F.col("external_id")), "is blank"),
        *contact_faults(lambda f: F.col(f"contact.{f}")), *sizes(F.col),
        ("experiences", needed("experiences", "company", "title"), "lacks a company or title"), ("experiences", F.exists("experiences", lambda x: x.start_date.isNull()), "lacks a start date"), *experience_faults(F.col("experiences"), today),
        ("education", needed("education", "institution", "degree"), "lacks an institution or degree"), *education_faults(F.col("education")),
        ("certifications", needed("certifications", "name"), "lacks a name"), *certification_faults(F.col("certifications")),
    ]


def told(faults: list[Fault]) -> Column:
    """All faults of a record as one text, empty if there are none."""
    return F.concat_ws("; ", *(F.when(F.coalesce(test, F.lit(False)), F.lit(f"{field}: {why}")) for field, test, why in faults))
