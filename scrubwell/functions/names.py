"""Name placeholders: patterns, mentions, prompts, masks, predicted names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of name placeholders; # stands for the identifier.
FORMS = {
    "first": [
        r"Doctor First Name #?",
        r"Female First Name \(\w+\) #?",
        r" First Name ",
        r"First Name \(S?Titles?\) #?",
        r"First Name\d+ \(Name Pattern\d\) #?",
        r"First Name3 \(LF\) #?",
        r"Known firstname #?",
        r"Male First Name \(\w+\) #?",
        r"Name10 \(NameIs\) #?",
        r"Name6 \(MD\) #?",
    ],
    "last": [
        r"Doctor Last Name #?",
        r"Known lastname #?",
        r"Last Name\d*? \(\S+?\) #?",
        r"Last Name #?",
        r"Name11 \(NameIs\) #?",
        r"Name1?[345]? \([SP]?Titles?\) #?",
        r"Name[78] \(MD\) #?",
        r"Name2? \(NI\) #?",
    ],
    "prefix": [r"Name Prefix \(Prefixes\) #?"],
    "initial": [r"Initials? \(NamePattern\d\) #?", r"Name Initial \(\w+?\) #?", r"Name12 \(\w+?\) #?"],
    "not_name": [
        r"Age over 90 #?",
        r"Apartment Address\(1\) #?",
        r"April #?",
        r"A[tu][ A-Za-z]+ #?",
        r"Date range \([1-3]\) #?",
        r"D[aei][ A-Za-z()-]+ #?",
        r"[CEHJOPSTUWY][ A-Za-z()-/]+ #?",
        r"Hospital[1-6] #?",
        r"February #?",
        r"Lo[ A-Za-z()-]+ #?",
        r"MD Number\([1-4]\) #?",
        r"March #?",
        r"May #?",
        r"M[eo][ A-Za-z()-]+ #?",
        r"Month Day Year \(2\) #?",
        r"Month/Day #?",
        r"Month/Day [1-4()]* #?",
        r"Month/Day/Year #?",
        r"Month/Year [1-2()]+ #?",
        r"N[ou][ A-Za-z()-]+ #?",
        r"Street Address\([1-2]\) #?",
        r"Telephone/Fax \([1-5]\) #?",
        r"Year \([24] digits\) #?",
        r"[ 0-9/-]+",
    ],
}


#: Kinds whose listed patterns never ask for the identifier.
LISTED_WITHOUT_ID = ("initial",)


def _forms(kind: str, id_required: bool) -> list[str]:
    # one digit at least, or none; as few as do, so nothing else changes
    return [rf"\[\*\*{form.replace('#?', chr(92) + ('d+?' if id_required else 'd*?'))}\*\*\]" for form in FORMS[kind]]


def patterns(kind: str, id_required: bool = True) -> list[str]:
    """The patterns of a kind one by one; with ``id_required`` a placeholder without identifier doesn't match, but for LISTED_WITHOUT_ID."""
    return _forms(kind, id_required and kind not in LISTED_WITHOUT_ID)


def pattern(kind: str, id_required: bool = True, group: str = "(") -> str:
    """One pattern for a kind, in a group; with ``id_required`` a placeholder without identifier doesn't match."""
    return group + "|".join(_forms(kind, id_required)) + ")"


def full_name(id_required: bool = True) -> str:
    """First, last, "is a", an age, then y and o: groups first, last, age."""
    return pattern("first", id_required) + r"\s*" + pattern("last", id_required) + r"\s*is\s+an?\s*(\d+|\[\*\*Age over 90 \*\*\]).*?[Yy].*?[Oo].*?"


def mention(n_sentences: int = 5, id_required: bool = True) -> str:
    """A full name and what follows up to the n-th full stop: groups mention, first, last, age."""
    return f"({full_name(id_required)}{'[^.]*.' * n_sentences})"


def patient_info(text: Column, n_sentences: int = 5) -> Column:
    """Struct of the first mention, its placeholders and the age; nulls without one."""
    p = mention(n_sentences)
    found = F.regexp_extract(text, p, 1)  # the parts are then read from the mention alone
    return F.struct(*[F.when(found != "", F.regexp_extract(found, p, k) if k > 1 else found).alias(n) for k, n in enumerate(("full_name_mention", "first_name_placeholder", "last_name_placeholder", "patient_age"), 1)])


def quoted(literal: Column) -> Column:
    """A pattern that matches the literal itself."""
    return F.concat(F.lit(r"\Q"), literal, F.lit(r"\E"))


def name_frequency(text: Column, first: Column, last: Column) -> Column:
    return F.when(first.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.concat(quoted(first), F.lit(r"\s*"), quoted(last))))


def masks(n: Column) -> Column:
    return F.array_join(F.array_repeat(F.lit("[MASK]"), n), " ")


def prompt_of_mention(text: Column) -> Column:
    flat = F.replace(text, F.lit("\n"), F.lit(""))
    named = F.regexp_replace(flat, "^" + pattern("first", False, "(?:") + " " + pattern("last", False, "(?:"), "[MASK] [MASK]")
    return F.regexp_replace(named, r"\[\*\*.+?\*\*\]", "")


def prompt(name: Column | None = None) -> Column:
    head = F.coalesce(name, F.lit("[MASK] [MASK]")) if name is not None else F.lit("[MASK] [MASK]")
    return F.concat(head, F.lit(" is a [MASK] year-old [MASK] presented with"))


def mask_names(text: Column) -> Column:
    """One mask for each name placeholder."""
    return F.regexp_replace(F.regexp_replace(text, pattern("first", False, "(?:"), "[MASK]"), pattern("last", False, "(?:"), "[MASK]")


def mask_names_by_tokens(text: Column, n_tokens: Column) -> Column:
    """As many masks as the name has tokens; ``n_tokens`` maps a placeholder to them."""
    from scrubwell.functions.dates import segments

    either = "^" + pattern("first", False, "(?:") + "$|^" + pattern("last", False, "(?:") + "$"
    return F.array_join(F.transform(segments(text), lambda s: F.when(s.rlike(either) & n_tokens[s].isNotNull(), masks(n_tokens[s])).otherwise(s)), "")


def predicted_name(sample: Column) -> Column:
    """What stands between ``[CLS] `` and `` is a``; null without it."""
    p = r"^\[CLS\] (.+?) is a.+$"
    return F.when(sample.rlike(p), F.regexp_extract(sample, p, 1))


def titled(name: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"\s+", " "), "^ | $", ""))
