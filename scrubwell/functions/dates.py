"""Dates in placeholders: keyword rules, range bands, and shifting all of a note's years by one interval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubwell.functions.rules import Rule, substitute

DAY = r"\[\*\*([0-9]+)-([0-9]+)\*\*\]"
GAP = r"[^\\.A-Z\n]*"


def _before(words: str) -> Rule:
    """The keyword, then a month-day placeholder."""
    return ("sub", f"({words}){DAY}", r"\1\2/\3")


def _after(words: str) -> Rule:
    """A month-day placeholder, then the keyword."""
    return ("sub", f"{DAY}({words})", r"\1/\2\3")


def _any(words: str, gap: str) -> str:
    """Alternatives; as the placeholder must follow, their order doesn't matter."""
    return "|".join(f"{w}{gap}" for w in words.split())


#: Weekdays (Thursday's capitals are spelled as in the notes' rules), examinations, prepositions.
WEEKDAYS = [("SUNDAY", "[Ss]unday"), ("MONDAY", "[Mm]onday"), ("TUESDAY", "[Tt]uesday"), ("WEDNESDAY", "[Ww]ednesday"), ("THURDSAY", "[Tt]hursday"), ("FRIDAY", "[Ff]riday"), ("SATURDAY", "[Ss]aturday")]
EXAMS_LOWER = "bal graphy? xr kub echo e[cek]g t[te]e"
EXAMS_UPPER = "BAL GRAPHY? [Cc]ulture CSF EGD E[CEK]G"
IMAGING = "CTAP CT[AU]? MR[ACI]P? XR"
PORTABLE = "[Pp][Oo][Rr][Tt][Aa][Bb][Ll][Ee]"
IMAGING_2 = "S?PEC?T KUB ECHO US T[TE]E"
ENDINGS = "[A-Za-z]+opy [A-Za-z]+omy [A-Za-z]+opsy"
PREPOSITIONS = "[Ff]rom [Ss]ince [Tt]hrough [Tt]hru [Tt]rough [Tt]o [Uu]ntil"
PREPOSITIONS_UPPER = "DATED ON FROM SINCE THROUGH THRU TROUGH TO UNTIL"
DAY_PARTS = "[Mm]orning [Aa]fternoon [Ee]vening [Nn]ight"
DAY_PARTS_UPPER = "MORNING AFTERNOON EVENING NIGHT"

KEYWORD_RULES: list[Rule] = [
    *[_before(f"{upper},? *|{lower},? *") for upper, lower in WEEKDAYS],
    _before(_any(EXAMS_LOWER, GAP)),
    _before(_any(EXAMS_UPPER, GAP)),
    _before(f"{_any(IMAGING, GAP)}|{PORTABLE}[A-Za-z ]*|{_any(IMAGING_2, GAP)}"),
    _before(f"Echo{GAP}"),
    _before(_any(ENDINGS, " +")),
    _after(" +xr| +kub| +echo| +e[ck]g| +t[te]e"),
    _after(" +BAL| +CSF?| +EGD| +E[ECK]G"),
    ("sub", rf"{DAY}([:,]? [a ]?[the ]?[A-Za-z]+ *)([Cc]ulture|graph)", r"\1/\2\3\4"),
    _after(rf" +CT[AU]?| +MR[ACI]P?| +C?XR|[^.,\n]*{PORTABLE}| +S?PEC?T| +KUB| +ECHO| +US| +T[TE]E"),
    _after(" +[A-Za-z]+opy| +[A-Za-z]+omy| +[A-Za-z]+opsy"),
    _before(_any("[Dd]ated [Oo]n", " +") + "|[Oo]n +the |" + _any(PREPOSITIONS, " +")),
    _before(_any(PREPOSITIONS_UPPER, " +")),
    ("sub", f"({_any(DAY_PARTS, ' +')})([Oo][Ff] +){DAY}", r"\1\2\3/\4"),
    ("sub", f"({_any(DAY_PARTS_UPPER, ' +')})([Oo][Ff] +){DAY}", r"\1\2\3/\4"),
    _after(" +[Aa][Tt] +[0-9]+"),
    _before(r"[Ee][Nn][Dd] [Dd][Aa][Tt][Ee][^.,\n]*"),
    _before(r"[Ss][Tt][Aa][Rr][Tt] [Dd][Aa][Tt][Ee][^.,\n]*"),
    _before("[0-9]+/[0-9]+ and "),
    ("sub", f"(?m)^{DAY}", r"\1/\2"),
]
LATE_RULES: list[Rule] = [("sub", r"(Completed by:)\[\*\*0-0-0\*\*\]", r"\1"), ("sub", r"\[\*\*[0-9]+\*\*\]-9 ", "19-9 ")]

_RANGE = r"in \[\*\*([0-9]+)-([0-9]+)\*\*\] (day|week|month)"


def band(x: Column, y: Column, unit: Column) -> Column:
    """The number that stands for the range x to y of a unit, or null where no rule covers it."""
    both = lambda a, b: ((x == a) & (y == b)) | ((x == b) & (y == a))
    small = F.when(both(1, 2) | ((x == 2) & (y == 2)), 2).when((x == 1) & (y == 1), 1)
    day = (
        F.when((x <= 12) & y.between(14, 39), 14)
        .when(((x <= 9) & y.between(10, 13)) | (x.between(10, 12) & (y <= 13)), 10)
        .when(((x <= 6) & y.between(7, 9)) | (x.between(7, 9) & (y <= 9)), 7)
        .when(((x <= 2) & y.between(3, 4)) | (x.between(3, 4) & (y <= 2)), 3)
        .otherwise(small)
    )
    week = (
        F.when(x.between(1, 12) & y.between(24, 39), 24)
        .when(((x == 12) & (y <= 23)) | (x.between(1, 11) & y.between(12, 23)), 12)
        .when((x.between(1, 9) & y.between(8, 11)) | (x.between(8, 9) & (y <= 7)), 8)
        .when(x.between(1, 7) & y.between(1, 7), F.greatest(x, y))
    )
    month = (
        F.when((x <= 11) & y.between(12, 39), 12)
        .when(((x <= 5) & y.between(6, 11)) | x.between(6, 11), 6)
        .when((x.between(1, 3) & y.between(3, 5)) | (x.between(3, 5) & y.between(1, 3)), 3)
        .otherwise(small)
    )
    return F.when(unit == "day", day).when(unit == "week", week).otherwise(month)


def resolve_bands(text: Column) -> Column:
    """``in [**x-y**] day`` and so on, wherever a band covers the range."""

    def one(part: Column) -> Column:
        x, y, unit = (F.regexp_extract(part, f"^{_RANGE}", k) for k in (1, 2, 3))
        n = band(x.try_cast("int"), y.try_cast("int"), unit)
        # numbers written with a leading zero are in no band, but for what follows six to eleven months
        plain = (~x.rlike("^0[0-9]")) & ((~y.rlike("^0[0-9]")) | ((unit == "month") & x.try_cast("int").between(6, 11)))
        return F.when((unit != "") & plain & n.isNotNull(), F.concat(F.lit("in "), n.cast("string"), F.regexp_replace(part, r"^in \[\*\*[0-9]+-[0-9]+\*\*\]", ""))).otherwise(part)

    return F.array_join(F.transform(F.split(text, rf"(?={_RANGE.replace('(', '(?:')})"), one), "")


def by_line(text: Column, f: Callable[[Column], Column], guard: str) -> Column:
    """``f``, which never reaches over a line's end, on the lines that match ``guard``; the others are left at once."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(guard), f(x)).otherwise(x)), "\n")


def keyword_rules(text: Column) -> Column:
    """The keyword rules and the late ones, without the bands."""
    return by_line(text, lambda x: substitute(x, [*KEYWORD_RULES, *LATE_RULES]), r"\[\*\*[-0-9]+\*\*\]")


def resolve(text: Column) -> Column:
    """All rules that need no surrogate map; all of them take placeholders of digits."""
    return by_line(text, lambda x: substitute(resolve_bands(substitute(x, KEYWORD_RULES)), LATE_RULES), r"\[\*\*[-0-9]+\*\*\]")


#: What counts as a year in range, and the forms of dates in placeholders.
IN_RANGE = "22[01][0-9]|2[01][0-9][0-9]"
YMD = rf"\[\*\*({IN_RANGE})-([0-9]+)-([0-9]+)\*\*\]"
YM = rf"\[\*\*(1[0-2]-?|-?[1-9]-?)/({IN_RANGE})\*\*\]"
Y = r"\[\*\*([12][0-9][0-9][0-9])\*\*\]"
YMD_OUT = r"\[\*\*(22[2-9][0-9]|2[3-9][0-9]+|[13456789][0-9]+)-([0-9]+)-([0-9]+)\*\*\]"
YM_OUT = r"\[\*\*(1[0-2]-?|-?[1-9]-?)/(22[2-9][0-9]|2[3-9][0-9]+|[3-9][0-9]+)\*\*\]"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
MARK = "\x01"


def segments(text: Column) -> Column:
    """Placeholders and what lies between them, in order."""
    marked = F.replace(F.replace(text, F.lit("[**"), F.lit(MARK + "[**")), F.lit("**]"), F.lit("**]" + MARK))
    return F.split(marked, MARK)


def year_shift(text: Column) -> Column:
    """How many years a note's dates move: its latest year lands in 2000-2019.  Null without a full date in range.

    The text is searched once, for placeholders of digits; their forms are then told apart.
    """
    found = F.regexp_extract_all(text, F.lit(r"\[\*\*[-0-9/]+\*\*\]"), F.lit(0))
    year = lambda p, pattern, k: F.when(p.rlike(f"^{pattern}$"), F.regexp_extract(p, f"^{pattern}$", k).try_cast("int"))
    of = lambda p: F.struct(F.coalesce(year(p, YMD, 1), year(p, YM, 2), year(p, Y, 1)).alias("y"), p.rlike(f"^{YMD}$").alias("full"))
    told = F.aggregate(F.transform(found, of), F.struct(F.lit(0).alias("y"), F.lit(False).alias("full")), lambda a, p: F.struct(F.greatest(a["y"], F.coalesce(p["y"], F.lit(0))).alias("y"), (a["full"] | p["full"]).alias("full")))
    return F.when(told["full"], told["y"] - (2000 + told["y"] % 20))


def backdate(text: Column, shift: Column) -> Column:
    """Shifts every date of a note by ``shift`` (a column, so that it is computed once); null shift: unchanged."""
    parts, none = segments(text), F.array(F.lit(""))
    # neighbours are zipped to each segment: inside a lambda, the split would be done again for each of them
    near = F.arrays_zip(parts.alias("s"), F.concat(none, F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("before"), F.concat(F.slice(parts, F.lit(2), F.size(parts)), none).alias("after"))

    def one(x: Column) -> Column:
        s, previous, following = x["s"], x["before"], x["after"]
        get = lambda p, k: F.regexp_extract(s, f"^{p}$", k)
        number = lambda c: c.try_cast("int")
        month = lambda p: F.replace(get(p, 1), F.lit("-"), F.lit(""))
        short = r"\[\*\*([0-9]+)\*\*\]"
        return (
            F.when(~(s.startswith("[**") & s.rlike(r"^\[\*\*[-0-9/]+\*\*\]$")), s)
            .when(s.rlike(f"^{YMD}$"), F.concat(get(YMD, 2), F.lit("/"), get(YMD, 3), F.lit("/"), (number(get(YMD, 1)) - shift).cast("string")))
            .when(s.rlike(f"^{YM}$"), F.concat(month(YM), F.lit("/"), (number(get(YM, 2)) - shift).cast("string")))
            .when(s.rlike(f"^{Y}$"), (number(get(Y, 1)) - shift).cast("string"))
            .when(s.rlike(f"^{short}$") & previous.endswith("'") & (following != "") & ~following.startswith('"'), F.lpad(F.pmod(number(get(short, 1)) - shift, F.lit(100)).cast("string"), 2, "0"))
            .when(s.rlike(f"^{YMD_OUT}$"), F.concat(get(YMD_OUT, 2), F.lit("/"), get(YMD_OUT, 3)))
            .when(s.rlike(f"^{YM_OUT}$"), F.get(F.array(*[F.lit(m) for m in MONTHS]), number(month(YM_OUT)) - 1))
            .when(s.rlike(f"^{DAY}$") & following.startswith(":"), F.concat(get(DAY, 1), F.lit("-"), get(DAY, 2)))
            .otherwise(s)
        )

    return F.when(shift.isNull(), text).otherwise(F.array_join(F.transform(near, one), ""))
