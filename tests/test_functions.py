import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from goldrec.functions import dates, phones, text
from goldrec.plans.config import SKILL_ALIASES


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "expr, value, want",
    [
        (text.strip, "\t a b　\n", "a b"),
        (text.clean, "  a \n\t b ", "a b"),
        (text.title_case, "JOHN mc-DONALD", "John Mc-Donald"),
        (text.title_case, "jean McDonald", "Jean McDonald"),
        (text.normal_email, "  A@B.Com ", "a@b.com"),
        (text.key_norm, "  Acme, Inc.  ", "acme inc"),
        (text.nfkc, "Ａﬁ", "Afi"),
        (text.normal_url, "HTTP://Example.COM", "http://example.com/"),
        (text.normal_url, "https://Example.com/A", "https://example.com/A"),
        (text.normal_url, "ftp://x.com", None),
        (phones.normal_phone, "4155552671", "+14155552671"),
        (phones.normal_phone, "(415) 555-2671", "+14155552671"),
        (phones.normal_phone, "+442079460958", "+442079460958"),
        (phones.normal_phone, "  not-a-phone  ", "not-a-phone"),
        (phones.e164, "123", None),
        (lambda c: phones.normal_phone(c, "GB"), "020 7946 0958", "+442079460958"),
        (lambda c: dates.loose_date(c).cast("string"), "Sept 2021", "2021-09-01"),
        (lambda c: dates.loose_date(c).cast("string"), "Dec-2027", "2027-12-01"),
        (lambda c: dates.loose_date(c).cast("string"), "3/2020", "2020-03-01"),
        (lambda c: dates.loose_date(c).cast("string"), "2019", "2019-01-01"),
        (lambda c: dates.loose_date(c).cast("string"), "January 15, 2020", "2020-01-15"),
        (lambda c: dates.loose_date(c).cast("string"), "Present", None),
        (lambda c: dates.strict_date(c).cast("string"), "2020-01-15", "2020-01-15"),
        (lambda c: dates.strict_date(c).cast("string"), "2020-1-5", None),
        (lambda c: F.to_json(dates.date_ranges(c)), "2021 - Present and Jan 2020 to Dec 2022", '[{"start":"2021","end":"Present"},{"start":"Jan 2020","end":"Dec 2022"}]'),
    ],
)
def test_text(spark, expr, value, want):
    assert one(spark, value, expr) == want


def test_lists(spark):
    skills = lambda c: text.normal_skills(c, SKILL_ALIASES)
    assert one(spark, ["js", "JavaScript", "Python "], skills, "array<string>") == ["JavaScript", "Python"]
    assert one(spark, ["a", " A", "", "b"], text.dedup_ci, "array<string>") == ["a", "b"]
    assert one(spark, [" a", "a", "A", " "], text.dedup_exact, "array<string>") == ["a", "A"]
    assert one(spark, None, text.dedup_ci, "array<string>") is None


def brute_phone(raw, region):
    """Digits one by one down the codes, then lengths and shapes."""
    raw = raw.strip()
    digits = re.sub(r"\D", "", raw)
    codes = {"1", "7", *phones.TWO, *(str(n) for a, b in phones.THREE for n in range(a, b + 1))}

    def whole(d, code):
        least, most = phones.LENGTHS.get(code, phones.REST)
        rest = d[len(code) :]
        good = least <= len(rest) <= most and len(d) <= 15 and re.fullmatch(phones.SHAPES.get(code, ".*"), rest)
        return "+" + d if good else None

    def foreign(d):
        for n in (1, 2, 3):
            if d[:n] in codes and len(d) >= n:
                return whole(d, d[:n])
        return None

    if not re.fullmatch(r"\+?[\d ().\-/]+", raw):
        return None
    if raw.startswith("+"):
        return foreign(digits)
    code, trunk, abroad = phones.REGIONS[region]
    least, most = phones.LENGTHS.get(code, phones.REST)
    if trunk and digits.startswith(trunk) and least <= len(digits) - len(trunk) <= most and (found := whole(code + digits[len(trunk) :], code)):
        return found
    return whole(code + digits, code) or (foreign(digits[len(abroad) :]) if digits.startswith(abroad) else None)


@pytest.mark.parametrize("region", ["US", "GB", "FR", "HU", "IT", "AU"])
def test_phones_of_all_plans(spark, region):
    rng = random.Random(region)
    codes = ["1", "7", *phones.TWO, *(str(n) for a, b in phones.THREE for n in range(a, b + 1)), "999", "0", "210"]
    raw = ["+33 1 23 45 67 89", "+353 86 123 4567", "00 49 30 123456", "+", "+1", "", "+33x123456789", "(0) 123"]
    for _ in range(800):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(3, 13)))
        raw.append(rng.choice(["+" + rng.choice(codes), "+" + rng.choice(codes) + " ", "00", "011", "0011", "0", "06", ""]) + digits)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    for r in rows.select("v", phones.e164(F.col("v"), region).alias("p")).collect():
        assert r["p"] == brute_phone(r["v"], region), r["v"]


def test_lenient_dates(spark):
    """Against a public parser of dates, over spellings made up at random."""
    parser = pytest.importorskip("dateutil.parser")
    today, rng = datetime.datetime(2026, 11, 30), random.Random(11)
    texts = "January 15, 2020|15 January 2020|2020|2020-01-15|1/2/2020|3/4/05|99-Jan-01|Apr-2003-25|20200115|2020-01-15T10:30:00Z|Mon, 5 Oct 2020 10:20:30 +0000|5th of March 2019|not a date|Sept 5 2019|February 2021|31/04/2020|2020-13-01|12|May|5.6.2020|0/0/2000|13/13/13|12 1999|Jan 32|foo 2020|Jan 5 2020 at 5:30 pm| |Feb".split("|")
    shapes = ["{y}-{m:02}-{d:02}", "{d}/{m}/{y}", "{m}/{d}/{y}", "{n} {d}, {y}", "{d} {n} {y}", "{n} {y}", "{m}/{y}", "{d}-{n}-{s:02}", "{m}-{d}-{s:02}", "{y} {n} {d}", "{d}.{m}.{y}", "{n} {d}", "{y}/{m}", "{y}{m:02}{d:02}", "{d} {n}", "{s:02}-{n}-{d}", "{n}-{s:02}-{d}"]
    for _ in range(500):
        y = rng.randint(1950, 2049)
        texts.append(rng.choice(shapes).format(y=y, s=y % 100, m=rng.randint(1, 12), d=rng.randint(1, 31), n=rng.choice(["Jan", "February", "mar", "Sept", "DEC", "October"])))

    def want(text):
        try:
            return parser.parse(text, default=today).date()
        except (ValueError, OverflowError):
            return None

    day = F.lit("2026-11-30").cast("date")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", dates.lenient_date(F.col("t"), day).alias("d"), dates.date_error(F.col("t"), day).alias("e")).collect():
        assert r["d"] == want(r["t"]), r["t"]
        assert r["e"] == (None if r["d"] or not r["t"].strip() else f"not a date: {r['t']}")
