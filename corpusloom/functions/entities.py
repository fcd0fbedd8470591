"""Token fields and entity properties of annotated text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a token row, in order.
FIELDS = ["position", "token", "tag", "lemma", "parpos", "function", "parword", "parlemma", "paroffset", "link", "length", "docuri", "lower", "nerid", "nertag", *[f"param{i}" for i in range(10)], "nertype", "nerlength"]

# Properties of each entity tag and the param that keeps each.
MAPPING = {
    "person": {"url": "param0", "image": "param1", "name": "param2", "gender": "param3", "birthplace": "param4", "birthdate": "param5", "deathplace": "param6", "deathdate": "param7", "profession": "param8", "nationality": "param9"},
    "artist": {"url": "param0", "image": "param1", "name": "param2", "gender": "param3", "birthplace": "param4", "birthdate": "param5", "deathplace": "param6", "deathdate": "param7", "role": "param8", "nationality": "param9"},
    "location": {"url": "param0", "image": "param1", "name": "param2", "country": "param3"},
    "artwork": {"url": "param0", "image": "param1", "name": "param2", "form": "param3", "datebegun": "param4", "datecompleted": "param5", "movement": "param6", "genre": "param7", "author": "param8"},
    "event": {"url": "param0", "image": "param1", "name": "param2", "startdate": "param3", "enddate": "param4", "location": "param5"},
    "museum": {"url": "param0", "image": "param1", "name": "param2", "type": "param3", "estabilished": "param4", "director": "param5", "location": "param6"},
    "family": {"url": "param0", "image": "param1", "name": "param2", "role": "param3", "nationality": "param4", "members": "param5"},
    "group": {"url": "param0", "image": "param1", "name": "param2", "role": "param3", "nationality": "param4"},
    "nationality": {"url": "param0", "image": "param1", "name": "param2", "country": "param3"},
    "form": {"url": "param0", "image": "param1", "name": "param2"},
    "mythology": {"url": "param0", "image": "param1", "name": "param2"},
    "medium": {"url": "param0", "image": "param1", "name": "param2"},
    "movement": {"url": "param0", "image": "param1", "name": "param2"},
    "genre": {"url": "param0", "image": "param1", "name": "param2"},
    "date": {"year": "param2", "month": "param3", "date": "param4"},
    "interval": {"fromyear": "param2", "frommonth": "param3", "fromday": "param4", "toyear": "param5", "tomonth": "param6", "today": "param7"},
}

# Terminal colours of the tags.
DYE = {"person": "Blue", "artist": "Blue", "location": "Dark gray", "artwork": "Magenta", "event": "Light magenta", "museum": "Light gray", "family": "Light green", "group": "Green", "nationality": "Light cyan", "form": "Light red", "mythology": "Cyan", "medium": "Light yellow", "movement": "Yellow", "genre": "Red", "date": "Light blue", "interval": "Light blue"}
CODES = {"Black": 30, "Red": 31, "Green": 32, "Yellow": 33, "Blue": 34, "Magenta": 35, "Cyan": 36, "Light gray": 37, "Dark gray": 90, "Light red": 91, "Light green": 92, "Light yellow": 93, "Light blue": 94, "Light magenta": 95, "Light cyan": 96, "White": 97, "Default": 39}

# Attributes of every entity and the properties that are shown with blanks, dashes or commas.
COMMON = {f"data-{x}": x for x in ("position", "tag", "lemma", "function", "parpos", "parlemma", "parword", "paroffset")} | {"target": '"_blank"', "href": "(if param0 param0 param0)"}
ENTITY = {f"data-{x}": x for x in ("nertag", "link", "length", "docuri", "nertype", "nerlength")} | {"data-image": "param1"}
#: Attributes of an entity that come from its last token alone.
LAST_ONLY = ("href", "style", "data-nertag")
DATED = {"birthdate", "deathdate", "datebegun", "datecompleted", "startdate", "enddate", "estabilished"}
LISTED = {"role", "profession", "nationality", "form", "genre", "author", "type", "director", "members"}
DATE = '(concatenate (or param2 "0") "-" (or param3 "0") "-" (or param4 "0"))'
TO = '(concatenate (or param5 "0") "-" (or param6 "0") "-" (or param7 "0"))'


def expressions(tag: str) -> dict[str, str]:
    """Attribute expressions of an entity tag, besides the common ones."""
    if tag == "date":
        return {"data-date": DATE}
    if tag == "interval":
        return {"data-from": DATE, "data-to": TO}
    out = {}
    for name, param in MAPPING[tag].items():
        if name == "gender":
            out["data-gender"] = f'(if (eq {param} "M") "male" "female")'
        elif name not in ("url", "image"):
            inner = f'(replace "|" ", " {param})' if name in LISTED else param
            out[f"data-{name}"] = f"(subst #\\_ #\\{'-' if name in DATED else ' '} {inner})"
    return out


def missing_as_null(value: Column) -> Column:
    return F.when((value != "0") & (value != ""), value)


@dataclass(frozen=True)
class Entities:
    """How entities are read and shown: the params that keep a tag's properties, the expressions of its attributes, those of all
    tokens' and all entities', attributes that aren't merged, and colours.
    """

    mapping: dict[str, dict[str, str]] = field(default_factory=lambda: MAPPING)
    expressions: dict[str, dict[str, str]] = field(default_factory=lambda: {tag: expressions(tag) for tag in MAPPING})
    common: dict[str, str] = field(default_factory=lambda: COMMON)
    entity: dict[str, str] = field(default_factory=lambda: ENTITY)
    last_only: tuple[str, ...] = LAST_ONLY
    dye: dict[str, str] = field(default_factory=lambda: DYE)


USUAL = Entities()
