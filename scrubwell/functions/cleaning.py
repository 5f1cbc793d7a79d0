"""Cleaning of note text, line by line, in fixed order."""

from pyspark.sql import Column

from scrubwell.functions.rules import Rule, rewrite_lines

#: What is rewritten and in which order.
CLEANING: list[Rule] = [
    ("sub", r" *!+", "."),
    ("sub", r"([0-9] *)\?\?\?\?\?\?", r"\1"),
    ("sub", r"\t", ""),
    ("sub", r"^\?+", ""),
    ("sub", r"Dr\. *\.+", ""),
    ("sub", r"([a-zA-Z]\.)\.+", r"\1"),
    ("sub", r'"\.\.+', '"'),
    ("drop", r"^\.\.+$"),
    ("sub", r"([a-zA-Z]\.)\.+", r"\1"),
    ("drop", r"^ *_+ *$"),
    ("sub", r"(grade|Edema \[.?\]) _+", r"\1"),
    ("sub", r"(Edema|Murmur)([^_]+)_*([^_]*)_+", r"\1\2\3"),
    ("sub", r"(last cigarette )_____", r"\1"),
    ("sub", r"_+([0-9]+)_+ *", r"\1 "),
    ("drop", r"^~+$"),
    ("sub", r"~~+", ""),
    ("drop", r"@@@"),
]


#: What a line must hold for a rule to change it.
GUARD = r"[!?\t_~@]|\.\.|Dr\. *\."


def clean(text: Column) -> Column:
    return rewrite_lines(text, CLEANING, GUARD)
