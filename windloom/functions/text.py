"""Text expressions: numbers, durations, cleaning, keywords."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components by keywords in a sensor's description, first match wins; the text is padded with spaces.
COMPONENT_RULES = [
    ("transformer", ("transformer", "transformator", "hv ")),
    ("hydraulic", ("hydraul",)),
    ("gearbox", ("gear", "planetary")),
    ("generator bearing", ("generator bearing",)),
    ("generator", ("generator", "stator", "slip ring", "split ring", "winding")),
    ("rotor or main bearing", ("rotor bearing", "main bearing", "bearing")),
    ("pitch system", ("pitch", "axis", "blade", "hub", "battery")),
    ("converter", ("converter", "inverter", "igbt", "vcs", "vcp", "choke", "dc link", "dc-link", "busbar")),
    ("yaw system", ("yaw",)),
    ("cooling", ("cooling", "cooler", "water", "fan", "aerat")),
    ("brake", ("brake",)),
    ("operating conditions", ("wind", "ambient", "outside", "speed", "rpm", "direction")),
    ("nacelle and controllers", ("cabinet", "controller", "nacelle", "tower", "top", "board")),
    ("power and grid", ("power", "voltage", "current", "grid", "reactive", "frequency", "phase")),
]

#: Subsystems by keywords in an operator's cause, first match wins.
SUBSYSTEM_RULES = [
    ("transformer", ("transformer",)),
    ("hydraulic", ("hydraul",)),
    ("generator bearing", ("generator bearing",)),
    ("rotor or main bearing", ("rotor bearing", "rotorbearing", "main bearing")),
    ("gearbox", ("gear",)),
    ("pitch system", ("pitch", "axis", "beckhoff", "blade", "battery")),
    ("converter", ("converter", "dc-link", "dc link")),
    ("yaw system", ("yaw",)),
    ("cooling", ("cooling",)),
    ("communication", ("communication",)),
    ("brake", ("brake", "bremse")),
]


def by_keywords(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str = "other") -> Column:
    """The first rule of which some keyword occurs; NULL text: NULL."""
    low = F.lower(text)
    out = None
    for name, keys in rules:
        found = None
        for k in keys:
            found = low.contains(k) if found is None else found | low.contains(k)
        out = F.when(found, name) if out is None else out.when(found, name)
    return F.when(text.isNotNull(), out.otherwise(default))


def component(description: Column) -> Column:
    return by_keywords(F.concat(F.lit(" "), description, F.lit(" ")), COMPONENT_RULES)


def subsystem(cause: Column) -> Column:
    return F.when(F.length(cause) > 0, by_keywords(cause, SUBSYSTEM_RULES))


def numbers(text: Column) -> Column:
    """Distinct numbers printed in a text, thousands separators removed, ascending."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))))


def printed(values: Column, digits: int = 3) -> Column:
    """Numbers with so many digits, space-joined, as C prints them: of the exact binary value, ties to even (Java's formatter
    rounds the shortest decimal form half up and pads it with zeros).  NULL stays NULL."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda own: None if own is None else " ".join(f"{v:.{digits}f}" for v in own))

    return run(values)


def squashed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def duration_seconds(text: Column) -> Column:
    """``H:MM:SS`` as seconds; anything else is 0."""
    p = F.split(text, ":")
    total = p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double")
    return F.coalesce(F.when(F.size(p) == 3, total), F.lit(0.0))


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), (F.floor(s / 60) % 60), s % 60)


def any_timestamp(text: Column, formats: list[str]) -> Column:
    """The first format that parses; none: NULL."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def clean(text: Column, drop_lines: list[str] | None = None) -> Column:
    """Blanks inside lines collapsed, lines of a list dropped, paragraph breaks kept to one empty line."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t ]+", " ")))
    kept = F.filter(lines, lambda x: ~x.isin(*(drop_lines or ["\u0000"])))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"\A\s+|\s+\z", "")


def without_reasoning(text: Column) -> Column:
    """Model output without its reasoning tags."""
    return F.trim(F.regexp_replace(text, r"(?is)<(thinking|reasoning)>.*?</\1>", ""))


def embedded_json(text: Column, schema: str) -> Column:
    """The JSON object inside a model's output, fences or not."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def fingerprint(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]), 256)


def turbine_name(text: Column) -> Column:
    """A turbine name without case, blanks and leading zeros in its numbers, for comparing."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]", ""), r"(?<![0-9])0+(?=[0-9])", "")


def last_number(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+)[^0-9]*$", 1).try_cast("int")
