"""Scalar functions on labels and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of transmitters and of functional types; what else is written gets the prefix other:.
TRANSMITTERS = {"ach": "ACh", "glu": "Glu", "gaba": "GABA", "da": "dopamine", "dopamine": "dopamine", "5-ht": "serotonin", "serotonin": "serotonin", "octopamine": "octopamine", "tyramine": "tyramine", "betaine": "betaine"}
FUNCTIONS = {"motor neuron": "motor", "interneuron": "interneuron", "sensory neuron": "sensory", "unknown": "unknown", "pharyngeal motor neuron": "motor", "pharyngeal interneuron": "interneuron"}
#: Transmitters that are none.
NO_TRANSMITTER = ("unknown_orphan", "unknown_monoamine")
#: Fixed value: what may follow a stem, a number, a dorsal or ventral letter, a side.
STEM_SUFFIX = r"^(\d+)?([DV])?([LR])?$"
#: Licence names and, of those that demand the same licence, prefixes.
PERMISSIVE = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC-BY-4.0", "CC0-1.0", "Unlicense")
COPYLEFT = ("GPL-", "LGPL-", "AGPL-", "MPL-", "CC-BY-SA-", "EUPL-")


def label_status(label: Column) -> Column:
    """blank, numeric, name (a capital, then letters and digits) or other."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.when(text == "", "blank").when(text.rlike(r"^[0-9]+$"), "numeric").when(text.rlike(r"^[A-Z][A-Za-z0-9]*$"), "name").otherwise("other")


def _lookup(key: Column, table: dict[str, str], other: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(other)


def transmitters(raw: Column) -> Column:
    """Names in a comma-separated entry (commas in brackets don't count), normalised; marks of novelty are dropped."""

    def one(part: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(part, r"(?i)\s*-\s*NEW\b", ""), r"(?i)\(new\)", "")
        s = F.lower(F.trim(F.replace(s, F.lit("*"), F.lit(""))))
        base = F.trim(F.regexp_replace(s, r"\(.*?\)", ""))
        taken = F.concat(_lookup(base, TRANSMITTERS, base), F.lit("_uptake"))
        unknown = F.when(s.contains("amine"), "unknown_monoamine").otherwise("unknown_orphan")
        return F.when(s == "", F.lit(None)).when(s.startswith("unknown"), unknown).when(s.contains("uptake"), taken).otherwise(_lookup(s, TRANSMITTERS, F.concat(F.lit("other:"), s)))

    return F.array_compact(F.transform(F.split(raw, r",(?![^()]*\))"), one))


def function_types(raw: Column) -> Column:
    """Functional types in a comma-separated entry, lower case."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return F.transform(parts, lambda p: _lookup(p, FUNCTIONS, F.concat(F.lit("other:"), p)))


def reason_key(reason: Column) -> Column:
    """What is before the first ; : or (, with numbers as N."""
    return F.regexp_replace(F.trim(F.split(reason, "[;:(]")[0]), r"\b\d+\b", "N")


def muscle_name(label: Column) -> Column:
    """BWM-DL01 and the like as MDL01, else null."""
    pattern = r"^BWM-?([DV])([LR])(\d{2})$"
    return F.when(label.rlike(pattern), F.concat(F.lit("M"), *[F.regexp_extract(label, pattern, i) for i in (1, 2, 3)]))


def wallclock(name: Column, hhmmss: Column) -> Column:
    """ISO date and time from a name that begins with YYYYMMDD and a time of six digits; null where either isn't one."""
    good = hhmmss.rlike(r"^\d{6}$") & name.rlike(r"^\d{8}")
    return F.when(good, F.date_format(F.try_to_timestamp(F.concat(F.substring(name, 1, 8), hhmmss), F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss"))


def acquisition_date(name: Column) -> Column:
    return F.when(name.rlike(r"^\d{8}"), F.concat_ws("-", F.substring(name, 1, 4), F.substring(name, 5, 2), F.substring(name, 7, 2)))


def has_transmitter(values: Column) -> Column:
    """Whether a list names a transmitter, of whatever spelling, that isn't said to be unknown or only taken up."""
    return F.exists(values, lambda v: ~v.isin(*NO_TRANSMITTER) & ~v.endswith("_uptake"))


def sign_for(loader: Column, kind: Column, raws: Column) -> Column:
    """Sign of an edge from what its dataset says: null for gap, mapped where one sign is given, else unknown."""
    mapped = F.array_distinct(F.transform(raws, lambda s: F.when(s == "+", "excitatory").when(s == "-", "inhibitory").otherwise("unknown")))
    one = F.when(F.size(mapped) == 1, mapped[0]).otherwise("unknown")
    return F.when(kind == "gap", F.lit(None)).when((loader == "predicted") & (kind == "chem"), one).otherwise("unknown")


def license_category(spdx: Column, status: Column) -> Column:
    """permissive, copyleft, other, unlicensed or unknown."""
    left = F.lit(False)
    for p in COPYLEFT:
        left = left | spdx.startswith(p)
    return F.when(status == "none_declared", "unlicensed").when((status != "declared") | F.coalesce(spdx == "", F.lit(True)), "unknown").when(spdx.isin(*PERMISSIVE), "permissive").when(left, "copyleft").otherwise("other")
