"""Settings of collections and clients, read from files or taken as they come; a copy for each request is never changed."""

from __future__ import annotations

import dataclasses
import json
import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from corpusloom.functions.entities import COMMON, DYE, ENTITY, FIELDS, LAST_ONLY, MAPPING, Entities, expressions

PORT = 12000


@dataclass(frozen=True)
class Settings:
    """Fields of token rows, the field shown, style, properties of tags, colours, attributes that aren't merged, fields to index,
    and expressions: of a tag's attributes, in place of the usual ones (tag: attribute: expression), of all tokens and of all entities.
    """

    fields: tuple[str, ...] = tuple(FIELDS)
    field: str = "token"
    style: str = "html"
    mapping: dict[str, dict[str, str]] = dataclasses.field(default_factory=lambda: MAPPING)
    dye: dict[str, str] = dataclasses.field(default_factory=lambda: DYE)
    nonDuplicateFields: tuple[str, ...] = tuple(x.removeprefix("data-") for x in LAST_ONLY)
    indexed: tuple[str, ...] = ("token", "lemma", "lower", "tag", "nerid", "nertag", *(f"param{i}" for i in range(10)))
    expressions: dict[str, dict[str, str]] = dataclasses.field(default_factory=dict)
    tokenExpressions: dict[str, str] = dataclasses.field(default_factory=lambda: COMMON)
    entityExpressions: dict[str, str] = dataclasses.field(default_factory=lambda: ENTITY)

    def entities(self) -> Entities:
        """How queries and snippets take entities."""
        own = {tag: self.expressions.get(tag, expressions(tag) if self.mapping[tag] == MAPPING.get(tag) else {f"data-{x}": p for x, p in self.mapping[tag].items()}) for tag in self.mapping}
        last = tuple(x if x in ("href", "style") else f"data-{x}" for x in self.nonDuplicateFields)
        return Entities(self.mapping, own, self.tokenExpressions, self.entityExpressions, last, self.dye)


def settings_of(found: dict) -> Settings:
    """Settings by name; unknown names are left out."""
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in Settings.__dataclass_fields__}
    return replace(Settings(), **known)


def read_settings(path: str) -> Settings:
    """Settings of a JSON file, or of a YAML file where a reader for it is installed; unknown names are left out."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("a YAML file needs the module yaml; JSON needs none") from e
        found = yaml.safe_load(text)
    return settings_of(found)


def write_settings(path: str, settings: Settings | None = None) -> None:
    """The given settings, or those that hold where there are none, as JSON."""
    Path(path).write_text(json.dumps(asdict(settings or Settings()), indent=1), encoding="utf-8")


def client_settings(path: str) -> dict:
    """Settings of a client's XML file: ``head`` and ``dye``, ``format`` as in a request, and the text of all other settings by name."""
    out: dict = {"head": [], "dye": {}, "format": {"attributes": [], "nertags": {}}}
    for section in ET.parse(path).getroot():
        if section.tag == "head":
            out["head"] = [x.tag for x in section]
        elif section.tag == "dye":
            out["dye"] = {x.tag: (x.text or "").strip() for x in section}
        elif section.tag == "format":
            attributes, tags = section.find("attributes"), section.find("nertags")
            out["format"] = {"attributes": [x.tag for x in attributes] if attributes is not None else [], "nertags": {x.tag: [y.tag for y in x] or ["all"] for x in tags} if tags is not None else {}}
        else:
            out |= {x.tag: (x.text or "").strip() for x in section}
    return out


def read_hosts(path: str, port: int = PORT) -> list[str]:
    """Hosts of a file, one a line, each with its port or the given one."""
    lines = [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines()]
    return [x if ":" in x else f"{x}:{port}" for x in lines if x]


def read_cursor(path: str) -> dict[str, int]:
    """The cursor that the last answer left, or none."""
    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}


def write_cursor(path: str, cursor: dict[str, int]) -> None:
    Path(path).write_text(json.dumps(cursor), encoding="utf-8")
