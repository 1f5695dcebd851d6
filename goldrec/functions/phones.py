"""Phone numbers to E.164 by the public numbering plan; anything else stays as it is, stripped.

Calling codes are free of prefixes: one digit (1, 7), else two of a fixed set, else three. A number counts if its national
part has a length that its code allows; four regions also have the shape of their numbers. Lengths are those of the
public plans; what is allotted inside them is not known here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldrec.functions.text import strip

#: Calling codes of two digits, and of three as (first, last).
TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
THREE = [
    (211, 213), (216, 216), (218, 218), (220, 258), (260, 269), (290, 291), (297, 299), (350, 359), (370, 378), (380, 383), (385, 387), (389, 389), (420, 421), (423, 423), (500, 509),
    (590, 599), (670, 670), (672, 683), (685, 692), (850, 850), (852, 853), (855, 856), (880, 880), (886, 886), (960, 968), (970, 977), (992, 996), (998, 998),
]
#: Fewest and most national digits of a calling code; other codes have REST.
LENGTHS = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9),
    "43": (4, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 11), "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10),
    "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10),
    "92": (9, 10), "94": (9, 9), "98": (10, 10), "212": (9, 9), "234": (8, 10), "254": (9, 9), "351": (9, 9), "352": (4, 11), "353": (7, 9), "354": (7, 7), "358": (5, 12), "359": (8, 9), "370": (8, 8),
    "371": (8, 8), "372": (7, 8), "380": (9, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "880": (10, 10), "886": (8, 9), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
REST = (5, 12)
MOST_DIGITS = 15
#: Shapes of the national numbers of four codes.
SHAPES = {"1": r"[2-9]\d{2}[2-9]\d{6}", "44": r"[1-9]\d{8,9}", "91": r"[6-9]\d{9}", "49": r"[1-9]\d{5,10}"}
#: Fixed values, by region: calling code, the digits before a national number, those before a foreign one.
REGIONS = {
    "US": ("1", "1", "011"), "CA": ("1", "1", "011"), "GB": ("44", "0", "00"), "IN": ("91", "0", "00"), "DE": ("49", "0", "00"), "FR": ("33", "0", "00"), "IT": ("39", "", "00"), "ES": ("34", "", "00"),
    "PT": ("351", "", "00"), "NL": ("31", "0", "00"), "BE": ("32", "0", "00"), "CH": ("41", "0", "00"), "AT": ("43", "0", "00"), "IE": ("353", "0", "00"), "SE": ("46", "0", "00"), "NO": ("47", "", "00"),
    "DK": ("45", "", "00"), "FI": ("358", "0", "00"), "PL": ("48", "", "00"), "CZ": ("420", "", "00"), "SK": ("421", "0", "00"), "HU": ("36", "06", "00"), "RO": ("40", "0", "00"), "BG": ("359", "0", "00"),
    "GR": ("30", "", "00"), "TR": ("90", "0", "00"), "UA": ("380", "0", "00"), "RU": ("7", "8", "810"), "IL": ("972", "0", "00"), "AE": ("971", "0", "00"), "SA": ("966", "0", "00"), "EG": ("20", "0", "00"),
    "ZA": ("27", "0", "00"), "NG": ("234", "0", "009"), "KE": ("254", "0", "000"), "PK": ("92", "0", "00"), "BD": ("880", "0", "00"), "LK": ("94", "0", "00"), "CN": ("86", "0", "00"), "HK": ("852", "", "001"),
    "TW": ("886", "0", "002"), "JP": ("81", "0", "010"), "KR": ("82", "0", "00"), "SG": ("65", "", "000"), "MY": ("60", "0", "00"), "TH": ("66", "0", "00"), "VN": ("84", "0", "00"), "PH": ("63", "0", "00"),
    "ID": ("62", "0", "001"), "AU": ("61", "0", "0011"), "NZ": ("64", "0", "00"), "BR": ("55", "0", "00"), "MX": ("52", "", "00"), "AR": ("54", "0", "00"), "CL": ("56", "", "00"), "CO": ("57", "0", "009"), "PE": ("51", "0", "00"),
}


def _international() -> str:
    """Codes and what may follow each, as one alternation: free of prefixes, so that at most one way through it fits."""
    codes = ["1", "7", *TWO, *(str(n) for first, last in THREE for n in range(first, last + 1))]
    ways = {code: SHAPES.get(code) or r"\d{%d,%d}" % LENGTHS[code] for code in codes if code in LENGTHS}
    rest = "|".join(code for code in codes if code not in ways)
    return "^(?=.{1,%d}$)(?:%s|(?:%s)%s)$" % (MOST_DIGITS, "|".join(code + way for code, way in ways.items()), rest, r"\d{%d,%d}" % REST)


INTERNATIONAL = _international()


def e164(c: Column, region: str = "US") -> Column:
    """Null where the number fits no plan. A leading plus, or the region's prefix of foreign numbers, overrides the region."""
    code, trunk, abroad = REGIONS[region]
    least, most = LENGTHS.get(code, REST)
    raw = strip(c)
    digits = F.when(raw.rlike(r"^\+?[\d ().\-/]+$"), F.regexp_replace(raw, r"\D", ""))
    # What the digits may stand for, the first that fits a plan.
    bare, own, foreign = F.regexp_replace(digits, f"^{trunk}(?=\\d{{{least},{most}}}$)", code), F.concat(F.lit(code), digits), F.regexp_replace(digits, f"^{abroad}", "")
    trunked = digits.rlike(f"^{trunk}\\d{{{least},{most}}}$") if trunk else F.lit(False)
    ways = [(raw.startswith("+"), digits), (~raw.startswith("+") & trunked, bare), (~raw.startswith("+"), own), (~raw.startswith("+") & digits.startswith(abroad), foreign)]
    return F.coalesce(*(F.when(test & number.rlike(INTERNATIONAL), F.concat(F.lit("+"), number)) for test, number in ways))


def normal_phone(c: Column, region: str = "US") -> Column:
    return F.coalesce(e164(c, region), strip(c))
