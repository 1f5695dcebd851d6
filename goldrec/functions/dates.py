"""Dates: strict ISO for structured documents, the few loose shapes of resumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldrec.functions.text import bind, strip

#: Fixed value: two dates with a dash or `to` between them.
RANGE = r"(?i)((?:[A-Za-z]{3,9}\.?[\s\-]+\d{4})|(?:\d{1,2}/\d{4})|(?:\d{4}))\s*(?:-|–|—|to)\s*((?:[A-Za-z]{3,9}\.?[\s\-]+\d{4})|(?:\d{1,2}/\d{4})|(?:\d{4})|(?:present|current))"


def strict_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}(T00:00:00(Z|\+00:00)?)?$"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def loose_date(c: Column) -> Column:
    """A month and year, or a year, as its first day; null for blank, present, current, now and anything else."""
    plain = F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^sept\b", "Sep"), r"[.\-\s]+", " ")
    # A format is tried only on its own shape: a failed parse costs far more than a pattern.
    shapes = {r"^[A-Za-z]{3} \d{4}$": "MMM yyyy", r"^[A-Za-z]{4,9} \d{4}$": "MMMM yyyy", r"^\d{1,2}/\d{4}$": "M/yyyy", r"^\d{4}$": "yyyy", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$": "MMMM d, yyyy"}
    return F.coalesce(strict_date(strip(c)), *(F.when(plain.rlike(shape), F.try_to_date(plain, f)) for shape, f in shapes.items()))


def date_ranges(c: Column) -> Column:
    """All (start, end) texts, in order."""
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(RANGE), F.lit(1)).alias("start"), F.regexp_extract_all(c, F.lit(RANGE), F.lit(2)).alias("end"))


def has_range(c: Column) -> Column:
    return c.rlike(RANGE)


#: What the words of a written date may be, by their first three letters or whole.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH = r"^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
#: Weekdays and words that say nothing.
IDLE = r"^(mon(day)?|tue(s|sday)?|wed(nesday)?|thu(rs|rsday|r)?|fri(day)?|sat(urday)?|sun(day)?|st|nd|rd|th|of|and|at|on|ad)$"
CLOCK = r"(?i)(?:[T ,]|\bat\b)\s*\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]\.?m\.?)?\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?$"

#: What two or three numbers are, by the place of a month's name among them (0 for none) and what they exceed: the first
#: row that holds counts. Each names the parts in order: y, m, d.
ORDERS = {
    3: [(1, "b > 31", "myd"), (1, "true", "mdy"), (2, "a > 31", "ymd"), (2, "true", "dmy"), (3, "b > 31", "dym"), (3, "true", "ydm"), (0, "a > 31 OR a4", "ymd"), (0, "a > 12", "dmy"), (0, "true", "mdy")],
    2: [(1, "b > 31 OR b4", "my"), (1, "true", "md"), (2, "a > 31 OR a4", "ym"), (2, "true", "dm"), (0, "a > 31 OR a4", "ym"), (0, "b > 31 OR b4", "my"), (0, "a > 12", "dm"), (0, "true", "md")],
    1: [(1, "true", "m"), (0, "a > 31 OR a4", "y"), (0, "true", "d")],
}


def lenient_date(c: Column, today: Column | None = None) -> Column:
    """A date in nearly any spelling: words and numbers in any order that ORDERS resolves, month before day where both
    could be meant; YYYYMMDD; a time and zone after it are passed over. What is not said comes from today (the run's date
    if not given), a day beyond its month's end is that end. Years of two digits lie within fifty years of today. Null if
    it can't be one; a weekday or a time alone is none."""
    today = F.current_date() if today is None else today
    plain = F.regexp_replace(F.regexp_replace(strip(c), CLOCK, ""), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z]+|\d+|[^a-z\d\s,./\-']"), F.lit(0))

    def resolve(kept: Column) -> Column:
        n = F.size(kept)
        named = lambda w: w.rlike(MONTH)
        place = F.array_position(F.transform(kept, named), F.lit(True)).cast("int")
        number = lambda w: F.when(named(w), F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(w, 1, 3)).cast("int")).otherwise(w.try_cast("int"))
        shaped = F.forall(kept, lambda w: named(w) | w.rlike(r"^\d{1,2}$|^\d{4}$")) & n.between(1, 3) & (F.size(F.filter(kept, named)) <= 1)
        tests = []
        for size, rows in ORDERS.items():
            for at, test, order in rows:
                a, b = (number(F.get(kept, F.lit(i))) for i in (0, 1))
                holds = F.lit(False)
                for part in test.split(" OR "):
                    if part == "true":
                        holds = F.lit(True)
                    elif part.endswith("4"):
                        holds = holds | (F.length(F.get(kept, F.lit("ab".index(part[0])))) == 4)
                    else:
                        holds = holds | ({"a": a, "b": b}[part[0]] > int(part.split("> ")[1]))
                tests.append(F.when((n == size) & (place == at) & F.coalesce(holds, F.lit(False)), F.lit(order)))
        return F.when(shaped, bind(F.coalesce(*tests), lambda order: _of_parts(kept, order, number, today)))

    clean = F.filter(words, lambda w: ~w.rlike(IDLE))
    return F.coalesce(strict_date(strip(c)), bind(clean, resolve))


def _of_parts(kept: Column, order: Column, number, today: Column) -> Column:
    said = lambda part: F.when(F.instr(order, part) > 0, F.get(kept, F.instr(order, part) - 1))
    short = lambda w: F.length(w) <= 2
    year = bind(said("y"), lambda w: bind(F.when(short(w), number(w) + F.floor(F.year(today) / 100) * 100).otherwise(number(w)), lambda y: F.when(short(w) & (y >= F.year(today) + 50), y - 100).when(short(w) & (y < F.year(today) - 50), y + 100).otherwise(y)))
    month, day = bind(said("m"), number), bind(said("d"), number)
    first = bind(F.concat_ws("-", F.lpad(F.coalesce(year, F.year(today)).cast("string"), 4, "0"), F.lpad(F.coalesce(month, F.month(today)).cast("string"), 2, "0")), lambda ym: F.try_to_date(F.concat(ym, F.lit("-01")), "yyyy-MM-dd"))
    end = lambda f: F.day(F.last_day(f))
    return bind(first, lambda f: F.when(day.isNull(), F.date_add(f, F.least(F.day(today), end(f)) - 1)).when(day.between(1, end(f)), F.date_add(f, day - 1)))


def date_error(c: Column, today: Column | None = None) -> Column:
    """What is wrong with a text that should be a date: null where it is one, blank or null."""
    lost = (strip(c) != "") & lenient_date(c, today).isNull()
    return F.when(lost, F.concat(F.lit("not a date: "), c))
