"""DDLm dictionaries: text to definitions, imports resolved. Driver-side metadata of some thousand items at most."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from ..sources.model import Block, CifFile, Frame, Namespace, build, fold

Resolver = Callable[[str], "str | None"]

#: Older names of attributes and what they are called now. Fixed values.
ATTRIBUTE_ALIASES = {
    "_enumeration.def_index_id": "_enumeration.def_index_ids",
    "_enumeration_default.index": "_enumeration_defaults.index",
    "_enumeration_default.value": "_enumeration_defaults.value",
}
#: What an imported frame doesn't overwrite: who the importing frame is.
IDENTITY = {"_definition.id", "_definition.scope", "_definition.class", "_name.category_id", "_name.object_id", "_import.get"}


@dataclass
class Item:
    """One definition: of a category (scope Category) or an item."""

    definition_id: str
    scope: str = "Item"
    definition_class: str | None = None
    category_id: str | None = None
    object_id: str | None = None
    category_keys: list[str] = field(default_factory=list)
    type_contents: str | None = None
    type_container: str | None = None
    type_purpose: str | None = None
    type_source: str | None = None
    type_dimension: str | None = None
    linked_item_id: str | None = None
    units_code: str | None = None
    description: str | None = None
    aliases: list[str] = field(default_factory=list)
    enumeration_states: list[str] = field(default_factory=list)
    enumeration_range: str | None = None
    enumeration_default: str | None = None
    enumeration_def_index_ids: list[str] = field(default_factory=list)
    enumeration_defaults: list[list[str]] = field(default_factory=list)  # index values ..., default
    is_deprecated: bool = False
    replaced_by: list[str] = field(default_factory=list)


@dataclass
class Dictionary:
    name: str = ""
    title: str = ""
    version: str = ""
    uri: str = ""
    categories: dict[str, Item] = field(default_factory=dict)
    items: dict[str, Item] = field(default_factory=dict)
    tag_to_item: dict[str, Item] = field(default_factory=dict)
    alias_to_definition_id: dict[str, str] = field(default_factory=dict)
    deprecated_ids: set[str] = field(default_factory=set)
    warnings: list[str] = field(default_factory=list)
    source_files: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class ResolvedTag:
    definition_id: str
    category_id: str | None
    object_id: str | None
    was_alias: bool
    is_deprecated: bool


def directory_resolver(path: str) -> Resolver:
    """URI -> text of the file of that base name in a folder."""
    find = directory_path_resolver(path)

    def resolve(uri: str) -> str | None:
        found = find(uri)
        if found is None:
            return None
        with open(found, encoding="utf-8") as f:
            return f.read()

    return resolve


def directory_path_resolver(path: str) -> Resolver:
    def resolve(uri: str) -> str | None:
        found = os.path.join(os.path.abspath(path), uri.rstrip("/").rpartition("/")[2])
        return found if os.path.isfile(found) else None

    return resolve


def _one(space: Namespace, tag: str) -> str | None:
    values = space.get(tag)
    text = str(values[0]) if values and isinstance(values[0], str) else None
    return None if text in (None, ".", "?") else text


def _many(space: Namespace, tag: str) -> list[str]:
    return [str(v) for v in space.get(tag) or [] if isinstance(v, str) and v not in (".", "?")]


def _renamed(space: Namespace) -> None:
    for old, new in ATTRIBUTE_ALIASES.items():
        if old in space.values and new not in space.values:
            space.values[new] = space.values.pop(old)
            space.order = [new if t == old else t for t in space.order]
            space.loops = [[new if t == old else t for t in x] for x in space.loops]


def extract_item(frame: Namespace) -> Item | None:
    """The definition of a frame; None without an id."""
    name = _one(frame, "_definition.id")
    if not name:
        return None
    scope = _one(frame, "_definition.scope") or "Item"
    kind = _one(frame, "_definition.class")
    defaults = []
    for index, value in zip(frame.get("_enumeration_defaults.index") or [], frame.get("_enumeration_defaults.value") or [], strict=False):
        key = [str(x) for x in (index if isinstance(index, list) else [index]) if str(x) not in (".", "?")]
        if key:
            defaults.append([*key, json.dumps(value, separators=(",", ":"), ensure_ascii=False) if isinstance(value, (list, dict)) else str(value)])
    replaced = _many(frame, "_definition_replaced.by")
    one = lambda tag: _one(frame, tag)
    low = lambda x: fold(x) if x else None
    return Item(
        definition_id=fold(name), scope="Category" if scope.lower() == "category" else scope, definition_class=kind,
        category_id=low(one("_name.category_id")), object_id=low(one("_name.object_id")),
        category_keys=[fold(k) for k in _many(frame, "_category_key.name")],
        type_contents=one("_type.contents"), type_container=one("_type.container"), type_purpose=one("_type.purpose"), type_source=one("_type.source"),
        type_dimension=one("_type.dimension") or _list_text(frame.get("_type.dimension")), linked_item_id=low(one("_name.linked_item_id")), units_code=one("_units.code"),
        description=one("_description.text"), aliases=[fold(a) for a in _many(frame, "_alias.definition_id")],
        enumeration_states=[str(v) for v in frame.get("_enumeration_set.state") or [] if isinstance(v, str)], enumeration_range=one("_enumeration.range"),
        enumeration_default=one("_enumeration.default"),
        enumeration_def_index_ids=[fold(str(x)) for v in frame.get("_enumeration.def_index_ids") or [] for x in (v if isinstance(v, list) else [v]) if str(x) not in (".", "?")],
        enumeration_defaults=defaults, is_deprecated="_definition_replaced.id" in frame or "_definition_replaced.by" in frame, replaced_by=[fold(r) for r in replaced],
    )


def _list_text(values: object) -> str | None:
    if values and isinstance(values[0], list):
        return "[" + ",".join(str(x) for x in values[0]) + "]"
    return None


class DictionaryLoader:
    """Loads a dictionary and what it imports. resolver: URI -> text; path_resolver: URI -> path, for provenance."""

    def __init__(self, resolver: Resolver | None = None, *, path_resolver: Resolver | None = None, on_warning: Callable[[str], None] | None = None):
        self.resolver, self.path_resolver, self.on_warning = resolver, path_resolver, on_warning
        self._parsed: dict[str, CifFile | None] = {}

    def load(self, source: str, *, base_uri: str = "") -> Dictionary:
        self.warnings: list[str] = []
        self.files: list[str] = [base_uri] if base_uri else []
        cif, errors = build(source)
        for e in errors:
            self._warn(f"{base_uri or 'dictionary'}: line {e.line}: {e.message}")
        if not cif.blocks:
            self._warn("dictionary has no data block")
            return Dictionary(warnings=self.warnings)
        block = cif.blocks[0]
        items = [x for f in self._frames(block, [base_uri]) if (x := extract_item(f))]
        out = _indexed(items, self._warn)
        out.name, out.title, out.version, out.uri = (_one(block, t) or "" for t in ("_dictionary.title", "_dictionary.title", "_dictionary.version", "_dictionary.uri"))
        out.warnings, out.source_files = self.warnings, self.files
        return out

    def _warn(self, text: str) -> None:
        self.warnings.append(text)
        if self.on_warning:
            self.on_warning(text)

    def _file(self, uri: str) -> CifFile | None:
        if uri not in self._parsed:
            text = self.resolver(uri) if self.resolver else None
            self._parsed[uri] = build(text)[0] if text is not None else None
            if text is not None:
                self.files.append((self.path_resolver(uri) if self.path_resolver else None) or uri)
        return self._parsed[uri]

    def _frames(self, block: Block, trail: list[str]) -> list[Frame]:
        """The block's frames with imports carried out; imported definitions come before those that import them."""
        out: dict[str, Frame] = {}
        for frame in block.save_frames:
            _renamed(frame)
            for directive in self._directives(frame):
                self._import(frame, directive, out, trail)
            key = fold(_one(frame, "_definition.id") or frame.name)
            if key in out and out[key] is not frame:
                self._warn(f"definition {key} is repeated; the last one stays")
            out[key] = frame
        return list(out.values())

    def _directives(self, frame: Frame) -> list[dict]:
        found = []
        for value in frame.get("_import.get") or []:
            found += [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
        return sorted(found, key=lambda x: int(x.get("order", 0)) if str(x.get("order", 0)).isdigit() else 0)

    def _import(self, frame: Frame, directive: dict, pool: dict[str, Frame], trail: list[str]) -> None:
        uri, wanted = str(directive.get("file", "")), str(directive.get("save", ""))
        mode, dupl, miss = (str(directive.get(k, d)).lower() for k, d in (("mode", "Contents"), ("dupl", "Ignore"), ("miss", "Ignore")))

        def lacking(what: str) -> None:
            if miss == "exit":
                raise ValueError(what)
            self._warn(f"{what} -- import left out")

        if uri in trail:
            self._warn(f"{uri} imports itself -- import left out")
            return
        cif = self._file(uri)
        if cif is None or not cif.blocks:
            return lacking(f"import of {uri}: no such file")
        frames = self._frames(cif.blocks[0].__class__(cif.blocks[0].name, save_frames=[_copied(f) for f in cif.blocks[0].save_frames]), [*trail, uri])
        found = next((f for f in frames if fold(_one(f, "_definition.id") or "") == fold(wanted)), None) or next((f for f in frames if fold(f.name) == fold(wanted)), None)
        if found is None:
            return lacking(f"import of {wanted} from {uri}: no such frame")
        if mode == "contents":
            _merge(frame, found, dupl)
            return
        head = (_one(found, "_definition.class") or "").lower() == "head"
        for f in frames if head else _family(frames, found):
            if head and f is found:
                continue
            key = fold(_one(f, "_definition.id") or f.name)
            if key in pool:
                if dupl == "exit":
                    raise ValueError(f"import of {uri}: {key} is there already")
                if dupl != "replace":
                    continue
            if head and fold(_one(f, "_name.category_id") or "") == fold(_one(found, "_definition.id") or ""):
                f.values["_name.category_id"] = [_one(frame, "_definition.id") or frame.name]  # children of the head move under the importer
            pool[key] = f


def _copied(frame: Frame) -> Frame:
    return Frame(frame.name, {t: list(v) for t, v in frame.values.items()}, list(frame.order), [list(x) for x in frame.loops])


def _family(frames: list[Frame], top: Frame) -> list[Frame]:
    """A frame and all definitions under it."""
    out, names = [top], {fold(_one(top, "_definition.id") or top.name)}
    grown = True
    while grown:
        grown = False
        for f in frames:
            if f not in out and fold(_one(f, "_name.category_id") or "") in names:
                out.append(f)
                names.add(fold(_one(f, "_definition.id") or f.name))
                grown = True
    return out


def _merge(into: Frame, other: Frame, dupl: str) -> None:
    """Attributes of another frame. Replace takes whole loops, so that columns of two sources never mix."""
    for tags in [*([t] for t in other.scalars()), *other.loops]:
        tags = [t for t in tags if t not in IDENTITY]
        there = [t for t in tags if t in into.values]
        if not tags or there and dupl == "ignore":
            continue
        if there and dupl == "exit":
            raise ValueError(f"import: {there[0]} is there already")
        if there:
            gone = {t for x in into.loops if set(x) & set(there) for t in x} | set(there)
            into.loops = [x for x in into.loops if not set(x) & set(there)]
            into.order = [t for t in into.order if t not in gone]
            for t in gone:
                into.values.pop(t, None)
        for t in tags:
            into.values[t] = list(other.values[t])
            into.order.append(t)
        if other.loop_of(tags[0]):
            into.loops.append(list(tags))


def _indexed(items: list[Item], warn: Callable[[str], None]) -> Dictionary:
    out = Dictionary()
    for x in items:
        if x.scope == "Dictionary":
            continue
        out.tag_to_item[x.definition_id] = x
        (out.categories if x.scope == "Category" else out.items)[x.definition_id] = x
        if x.is_deprecated:
            out.deprecated_ids.add(x.definition_id)
    for x in items:
        for alias in x.aliases:
            known = out.alias_to_definition_id.get(alias)
            if alias in out.tag_to_item and out.tag_to_item[alias] is not x or known not in (None, x.definition_id):
                warn(f"alias {alias} of {x.definition_id} is taken -- alias left out")
                continue
            out.alias_to_definition_id[alias] = x.definition_id
    return out


def resolve_tag(tag: str, dictionary: Dictionary) -> ResolvedTag | None:
    name = fold(tag)
    was_alias = name in dictionary.alias_to_definition_id and name not in dictionary.tag_to_item
    item = dictionary.tag_to_item.get(dictionary.alias_to_definition_id[name] if was_alias else name)
    if item is None:
        return None
    return ResolvedTag(item.definition_id, item.category_id, item.object_id, was_alias, item.definition_id in dictionary.deprecated_ids)


FORMAT = 1


def save_dictionary(dictionary: Dictionary, path: str) -> None:
    """As JSON. Each definition once; the indexes are made anew on loading."""
    head = {k: getattr(dictionary, k) for k in ("name", "title", "version", "uri", "warnings", "source_files")}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"format": FORMAT, **head, "definitions": [asdict(x) for x in dictionary.tag_to_item.values()]}, f, ensure_ascii=False)


def load_dictionary(path: str) -> Dictionary:
    """ValueError on anything but a file of save_dictionary()."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data["format"] != FORMAT:
            raise ValueError(f"format {data['format']!r}")
        names = {x.name for x in fields(Item)}
        out = _indexed([Item(**{k: v for k, v in x.items() if k in names}) for x in data["definitions"]], lambda _: None)
        for k in ("name", "title", "version", "uri", "warnings", "source_files"):
            setattr(out, k, data[k])
        return out
    except (OSError, KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
        raise ValueError(f"{path}: not a saved dictionary: {e}") from e
