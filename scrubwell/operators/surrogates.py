"""Surrogates by rule: which placeholders get what kind of synthetic value.

Values depend on key and seed alone, so any task can make them anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.operators.placeholders import NO_ID, searched
from scrubwell.operators.ranking import draw

SEEDS = {"hospital": 42, "shadow": 12345}

POOLS = {
    "female": "Ada Bea Cleo Dora Edith Flora Greta Hilda Iris June Kate Lena Maud Nora Olga Petra".split(),
    "male": "Abel Boris Carl Dario Emil Felix Gus Hugo Ivan Jonas Karl Lars Milo Nils Otto Paul".split(),
    "last": "Archer Brook Carver Dale Ellis Frost Grove Hill Irving Joyner Keller Lowe Marsh Noble Orchard Parr Quill Reed Stone Thorn".split(),
    "prefix": "Mr. Mrs. Ms. Dr.".split(),
    "doctor": "Almond Birch Cedar Dogwood Elm Fir Gorse Hazel".split(),
    "hospital": ["Lakeside Hospital", "Hillcrest Clinic", "Riverbend Medical Center", "Northfield Hospital", "Harbor Clinic"],
    "city": "Ashford Brixton Calder Dunmore Eastham Fairview Glenwood Hartley".split(),
    "state": "Northland Southmark Westvale Eastmoor".split(),
    "country": "Arvenia Belmora Castova Dorland".split(),
    "company": ["Amber Works", "Blue Anchor Ltd", "Cobalt Group", "Delta Mills"],
    "street": ["Oak Street", "Pine Avenue", "Mill Lane", "Station Road", "Park Drive"],
    "month": "January February March April May June July August September October November December".split(),
}
POOLS["first"] = [n for pair in zip(POOLS["female"], POOLS["male"], strict=True) for n in pair]

#: Days of the months as the rules draw them.
DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

#: Selectors over placeholders in order; the last that fits gives the value.  (order, pattern, generator)
RULES: list[tuple[int, str, str]] = [
    (1, r"\[\*\* \*\*\]", "const:Admission"),
    (2, r"Age over 90", "int:90:115"),
    (3, r"Attending", "pool:doctor"),
    (4, r"CC Contact Info", "const:"),
    (5, r"Apartment Address\(|Street Address\(", "address"),
    (6, r"Company", "pool:company"),
    (7, r"Country", "pool:country"),
    (8, r"E-mail", "email"),
    (10, r"Doctor First Name|\[\*\*First Name|\[\*\* First Name|Known firstname|Name6 \(MD\)|Name10 \(NameIs\)", "pool:first"),
    (11, r"Dictator Info|Doctor Last Name|\[\*\*Last Name|Known lastname|Name \(STitle\)|Name5 \(PTitle\) [0-9]|Name[78] \(MD\)|Name11 \(NameIs\)|Name13|Name14", "pool:last"),
    (12, r"Female First Name", "pool:female"),
    (13, r"Male First Name", "pool:male"),
    (14, r"Name Prefix \(Prefixes\)", "pool:prefix"),
    (15, r"Name12|Initial \(|Initials \(", "initial"),
    (16, r"Hospital[ 0-9][ *0-9]", "pool:hospital"),
    (18, r"Clip Number|Job Number|MD Number|Medical Record Number|Serial Number", "int:1:99999999"),
    *[(19 + k, POOLS["month"][k], f"int:1:{d}:{k + 1}/") for k, d in enumerate(DAYS)],
    (31, r"Month \(only\)", "pool:month"),
    (32, r"Month/Day \(|Month Day|Day Month", "date:md"),
    (33, r"Month Year|Year/Month |Month/Year", "date:my"),
    (34, r"Month/Day/Year|Year/Month/Day", "date:mdy"),
    (35, r"Telephone/Fax", "phone"),
    (36, r"PO Box", "int:0:9999:PO Box "),
    (37, r"Social Security Number", "ssn"),
    (38, r"Medical record number", "int:0:999999999"),
    (39, r"State ", "pool:state"),
    (41, r"University", "pool:city:: University"),
    (42, r"URL", "url"),
    (43, r"State/Zipcode", "zip"),
]
#: Selectors that find keys by what stands before them in a note: (order, pattern with the key as group 1, generator).
CONTEXT_RULES = [
    (9, r"(?m)^(Email:[^\n]*)", "email:Email: "),
    (11, r"Dr.[ ]?(\[\*\*Name2? \(NI\) [0-9]+\*\*\])", "pool:last"),
    (17, r"- (\[\*\*Location[^\]]+[0-9]+\*\*\])", "pool:city"),
    (40, r"Unit No: +(\[\*\*Numeric Identifier [0-9]+\*\*\])", "int:0:2000"),
]


def generate(key: Column, seed: int, how: str) -> Column:
    """The value of one generator."""
    kind, *args = how.split(":", 3)
    pick = lambda pool: F.get(F.array(*[F.lit(x) for x in POOLS[pool]]), draw(key, seed, len(POOLS[pool])).cast("int"))
    number = lambda low, high, salt=0: (draw(key, seed + salt, high - low + 1) + low).cast("string")
    two = lambda low, high, salt=0: F.lpad(number(low, high, salt), 2, "0")
    if kind == "const":
        return F.lit(args[0])
    if kind == "pool":
        return F.concat(pick(args[0]), F.lit(args[2])) if len(args) == 3 else pick(args[0])
    if kind == "int":
        return F.concat(F.lit(args[2] if len(args) > 2 else ""), number(int(args[0]), int(args[1])))
    if kind == "initial":
        return F.concat(F.substring(pick("first"), 1, 1), F.lit("."))
    if kind == "address":
        return F.concat(number(1, 999), F.lit(" "), pick("street"))
    if kind == "email":
        return F.concat(F.lit(how[6:]), F.lower(pick("first")), number(10, 99), F.lit("@example.org"))
    if kind == "url":
        return F.concat(F.lit("www."), F.lower(pick("city")), F.lit(".example.org"))
    if kind == "phone":
        return F.concat(F.lit("555-"), F.lpad(number(0, 9999), 4, "0"))
    if kind == "zip":
        return F.lpad(number(0, 99999), 5, "0")
    if kind == "ssn":
        n = F.lpad(number(0, 999999999), 9, "0")
        return F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 2), F.lit("-"), F.substring(n, 6, 4))
    month, day, year = two(1, 12), two(1, 28, 1), two(0, 99, 2)
    return F.concat_ws("/", *{"md": [month, day], "my": [month, year], "mdy": [month, day, year]}[args[0]])


def value(key: Column, seed: int) -> Column:
    """ord and value (a struct) by the last rule that selects a placeholder, or null: one CASE from the last rule on, no join."""
    out = None
    for o, pattern, how in reversed(RULES):
        made = F.struct(F.lit(o).alias("ord"), generate(key, seed, how).alias("dummy_phi"))
        out = F.when(key.rlike(pattern), made) if out is None else out.when(key.rlike(pattern), made)
    return out


def rule_map(keys: DataFrame, seed: int, contexts: DataFrame | None = None, key: str = "placeholder") -> DataFrame:
    """placeholder, dummy_phi for each selected key.  ``contexts``: keys found by context, with their ``ord``."""
    base = keys.select(key, value(F.col(key), seed).alias("_v")).filter("_v is not null").select(key, "_v.*")
    if contexts is None:
        return base.select(key, "dummy_phi")
    made = F.lit(None).cast("string")
    for o, _, how in CONTEXT_RULES:
        made = F.when(F.col("ord") == o, generate(F.col(key), seed, how)).otherwise(made)
    # equal orders: the context selector comes after the plain one
    both = base.withColumn("late", F.lit(0)).unionByName(contexts.select(key, "ord", made.alias("dummy_phi"), F.lit(1).alias("late")))
    return both.groupBy(key).agg(F.max_by("dummy_phi", F.struct("ord", "late")).alias("dummy_phi"))


#: What a line must hold for each context rule to be tried on it; a plain search, unlike the rule.
_TOLD = {9: lambda x: x.startswith("Email:"), 11: lambda x: x.contains(" (NI) "), 17: lambda x: x.contains("- [**Location"), 40: lambda x: x.contains("Unit No:")}


def told_lines(text: str | Column) -> Column:
    """The lines of a text that hold a telling word; no context rule reaches over a line."""
    whole = F.col(text) if isinstance(text, str) else text
    told = lambda x: _TOLD[9](x) | _TOLD[11](x) | _TOLD[17](x) | _TOLD[40](x)
    return F.filter(F.split(F.when(whole.contains("Email:"), whole).otherwise(searched(whole)), "\n"), told)


def context_keys(notes: DataFrame, text: str) -> DataFrame:
    """placeholder, ord: keys that stand behind a telling word; only lines with such a word are searched."""
    return keys_in_lines(notes.select(told_lines(text).alias("_told")), "_told")


def keys_in_lines(notes: DataFrame, told: str) -> DataFrame:
    """As :func:`context_keys`, of a column with the :func:`told_lines`."""
    lines = notes.select(F.explode(told).alias("_s"))
    none = F.array().cast("array<struct<placeholder: string, ord: int>>")
    of = lambda o, p: F.when(_TOLD[o](F.col("_s")), F.transform(F.regexp_extract_all(F.col("_s"), F.lit(p), F.lit(1)), lambda x: F.struct(x.alias("placeholder"), F.lit(o).alias("ord")))).otherwise(none)
    return lines.select(F.inline(F.concat(*[of(o, p) for o, p, _ in CONTEXT_RULES]))).distinct()


def with_ids(mapping: DataFrame, key: str = "placeholder") -> DataFrame:
    """Without the placeholders that carry no identifier."""
    return mapping.filter(~F.col(key).isin(NO_ID))


def zipped(keys: DataFrame, values: DataFrame, key: str, value_: str, cyclic: bool = False) -> DataFrame:
    """Keys beside values by position (both have ``rn`` from 1); missing values are empty, or start over if ``cyclic``."""
    if cyclic:
        n = values.agg(F.count(F.lit(1)).alias("_size"))
        keys = keys.crossJoin(F.broadcast(n)).withColumn("_at", F.pmod(F.col("rn") - 1, F.col("_size")) + 1)
    else:
        keys = keys.withColumn("_at", F.col("rn"))
    return keys.join(values.select(F.col("rn").alias("_at"), value_), "_at", "left").select(key, F.coalesce(value_, F.lit("")).alias(value_))
