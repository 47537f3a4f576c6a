"""Columns found, renamed and described by what they mean.

Specifications give each physical quantity a generic name, and with it other names, standard names, units
and an axis. A column is matched by its own name and by the attributes in its field's metadata. All of it
looks at the schema alone; renaming is one select, and runs no job.
"""

from __future__ import annotations

import copy
import warnings
import fnmatch
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from gyre.errors import MetaError
from gyre.meta.locator import Locator

CATEGORIES = ("coords", "data_vars")
#: Letters of a search order: name, standard name, units, axis.
_ORDER = {"data_vars": "sn", "coords": "ns"}
NAMES_KEY = "meta_specs"


@dataclass(frozen=True)
class Item:
    """What is known of one quantity."""

    name: str
    alt_names: tuple[str, ...] = ()
    standard_names: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    axis: str = ""
    order: str = ""
    inherit: str = ""
    own_name: str = ""

    def names(self) -> list[str]:
        """Own name, other names, and the generic name last."""
        return list(dict.fromkeys([*([self.own_name] if self.own_name else []), *self.alt_names, self.name]))


def _split(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def parse(text: str) -> dict[str, dict[str, Item]]:
    """Items by category from lines ``name | alternative names | inherits | standard names | units | axis | order``."""
    out: dict[str, dict[str, Item]] = {c: {} for c in CATEGORIES}
    category = "data_vars"
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] == "#":
            continue
        if line[0] == "[":
            category = line.strip("[]")
            continue
        cells = [c.strip() for c in line.split("|")] + [""] * 7
        name, alt, inherit, standard, units, axis, order = cells[:7]
        out[category][name] = Item(name, _split(alt), _split(standard), _split(units), axis, order, inherit)
    return out


@dataclass
class MetaSpecs:
    """Specifications: the default ones with changes on top of them."""

    name: str = "default"
    items: dict[str, dict[str, Item]] = field(default_factory=dict)
    attrs: dict[str, list[str]] = field(default_factory=dict)
    locator: Locator = field(default_factory=Locator)
    positive: str = "up"

    @classmethod
    def default(cls) -> MetaSpecs:
        specs = cls(items=parse(resources.files("gyre.meta").joinpath("vocabulary.txt").read_text()))
        specs._inherit()
        return specs

    @classmethod
    def from_dict(cls, name: str, changes: dict[str, dict[str, dict]], attrs: dict[str, list[str]] | None = None, **options) -> MetaSpecs:
        """Default specifications with changed or new items: ``{category: {generic name: {"name": ..., "alt_names": ...}}}``."""
        specs = cls.default()
        specs.name, specs.attrs = name, attrs or {}
        for category, entries in changes.items():
            for generic, entry in entries.items():
                entry = {k: tuple([v] if isinstance(v, str) else v) if k in ("alt_names", "standard_names", "units") else v for k, v in entry.items()}
                if "name" in entry:
                    entry["own_name"] = entry.pop("name")
                base = specs.items[category].get(generic, Item(generic))
                specs.items[category][generic] = replace(base, **entry)
        for k, v in options.items():
            setattr(specs, k, v)
        specs._inherit()
        return specs

    def _inherit(self) -> None:
        for category in CATEGORIES:
            for name in list(self.items[category]):
                self.items[category][name] = self._resolved(category, name, ())

    def _resolved(self, category: str, name: str, seen: tuple) -> Item:
        item = self.items[category][name]
        if not item.inherit or (category, name) in seen:
            return item
        there, _, other = item.inherit.rpartition(":")
        base = self._resolved(there or category, other or item.inherit, (*seen, (category, name)))
        return replace(
            base, name=item.name, alt_names=item.alt_names or base.alt_names, standard_names=item.standard_names or base.standard_names,
            units=item.units or base.units, axis=item.axis or base.axis, order=item.order or base.order, inherit="", own_name=item.own_name,
        )

    def copy(self) -> MetaSpecs:
        return copy.deepcopy(self)

    def match_item(self, f: StructField, item: Item, category: str, loc: str | bool | None = None) -> bool:
        """Whether a field is this quantity, by the first of name, standard name, units or axis that decides."""
        meta = f.metadata or {}
        for letter in item.order or _ORDER[category]:
            if letter == "n" and any(self.locator.matches("name", f.name, n, loc) for n in item.names()):
                return True
            if letter == "s" and meta.get("standard_name") and any(self.locator.matches("standard_name", meta["standard_name"], s, loc) for s in item.standard_names):
                return True
            if letter == "u" and meta.get("units") and meta["units"].strip().lower() in [u.lower() for u in item.units]:
                return True
            if letter == "a" and meta.get("axis") and meta["axis"].upper() == item.axis:
                return True
        return False

    def match(self, f: StructField, category: str | None = None) -> tuple[str, str] | None:
        """Category and generic name of a field: by standard name, then its own generic name, then any item in order."""
        found = [(c, n) for c in ([category] if category else CATEGORIES) for n, item in self.items[c].items() if self.match_item(f, item, c)]
        if not found:
            return None
        root = self.locator.parse("name", f.name)[0].lower()
        return min(found, key=lambda x: (root != x[1].lower(), root not in [n.lower() for n in self.items[x[0]][x[1]].names()], found.index(x)))

    def search_all(self, df: DataFrame, generic: str, category: str | None = None, loc: str | bool | None = None) -> list[str]:
        """The columns that are the quantity: those of that very name first, then in the order of the columns."""
        hits = []
        for c in [category] if category else [c for c in CATEGORIES if generic in self.items[c]]:
            item = self.items[c].get(generic)
            if item:
                hits += [f.name for f in df.schema.fields if self.match_item(f, item, c, loc) and f.name not in hits]
        exact = [h for h in hits if self.locator.parse("name", h)[0].lower() == generic.lower()]
        return exact + [h for h in hits if h not in exact]

    def search(self, df: DataFrame, generic: str, category: str | None = None, loc: str | bool | None = None, errors: str = "ignore") -> str | None:
        """The column that is the quantity, the first of several.

        Unless there is one and no more, ``errors="warn"`` says so, and ``errors="raise"`` makes it an error.
        """
        if errors not in ("ignore", "warn", "raise"):
            raise ValueError(f"errors: {errors!r}")
        hits = self.search_all(df, generic, category, loc)
        if errors != "ignore" and len(hits) != 1:
            said = f"{generic}: {len(hits)} columns match" + (f", {', '.join(hits)}" if hits else "")
            if errors == "raise":
                raise MetaError(said)
            warnings.warn(said + ("; the first is taken" if hits else ""), stacklevel=2)
        return (hits or [None])[0]

    def attributes(self, category: str, generic: str, loc: str | None = None) -> dict[str, str]:
        """Attributes that the specifications give a quantity."""
        item, out = self.items[category][generic], {}
        if item.standard_names:
            out["standard_name"] = self.locator.format("standard_name", item.standard_names[0], loc)
            out["long_name"] = item.standard_names[0].replace("_", " ").capitalize()
        if item.units:
            out["units"] = item.units[0]
        if item.axis:
            out["axis"] = item.axis
        return out

    def _renamed(self, df: DataFrame, own: bool, rename: bool = True) -> DataFrame:
        taken, out = set(), []
        plan = []
        for f in df.schema.fields:
            hit = self.match(f)
            loc = self.locator.location({"name": f.name, **{k: v for k, v in (f.metadata or {}).items() if k in ("standard_name", "long_name")}}) if hit else None
            if not hit:
                plan.append((f, None, f.name, {}))
                continue
            item = self.items[hit[0]][hit[1]]
            name = item.own_name if own and item.own_name else item.name
            # A location in the name stays; one in the attributes alone does not enter it.
            _, named = self.locator.parse("name", f.name)
            plan.append((f, hit, self.locator.format("name", name, named) if rename else f.name, self.attributes(*hit, loc)))
        kept = {f.name for f, hit, name, _ in plan if name == f.name}
        for f, hit, name, attrs in plan:
            if name != f.name and (name in taken or name in kept):
                name = f.name  # the second claimant of a name keeps its own
            taken.add(name)
            meta = {**attrs, **(f.metadata or {}), **({NAMES_KEY: self.name} if hit else {})}
            out.append(F.col(f"`{f.name}`").alias(name, metadata=meta))
        return df.select(*out)

    def decode(self, df: DataFrame) -> DataFrame:
        """Rename what is known to generic names and fill in attributes."""
        return self._renamed(df, own=False)

    def encode(self, df: DataFrame) -> DataFrame:
        """Rename what is known to the specifications' own names."""
        return self._renamed(df, own=True)

    def fill_attrs(self, df: DataFrame) -> DataFrame:
        """Attributes only; those that are there stay."""
        return self._renamed(df, own=False, rename=False)

    def to_loc(self, df: DataFrame, **locs: str | None) -> DataFrame:
        """Set the location of the columns with these roots."""
        return df.withColumnsRenamed({c: self.locator.format("name", c, locs[r]) for c in df.columns if (r := self.locator.parse("name", c)[0]) in locs})

    def reloc(self, df: DataFrame, **locs: str | None) -> DataFrame:
        """Move all columns from one location to another."""
        return df.withColumnsRenamed({c: self.locator.format("name", c, locs[x]) for c in df.columns if (x := self.locator.parse("name", c)[1]) in locs})

    def add_loc(self, df: DataFrame, column: str, loc: str | None, name: bool = True, attrs: bool = True) -> DataFrame:
        """Give one column a location, in its name, its standard and long name, or both; None takes it away."""
        out = []
        for f in df.schema.fields:
            meta = dict(f.metadata or {})
            if f.name == column and attrs:
                meta.update({k: self.locator.format(k, meta[k], loc) for k in ("standard_name", "long_name") if meta.get(k)})
            to = self.locator.format("name", column, loc) if f.name == column and name else f.name
            out.append(F.col(f"`{f.name}`").alias(to, metadata=meta))
        return df.select(*out)

    def score(self, df: DataFrame) -> float:
        """Share of the columns, in percent, whose name is an own name of these specifications."""
        own = {n.lower() for c in CATEGORIES for i in self.items[c].values() for n in ([i.own_name] if i.own_name else [i.name])}
        names = {self.locator.parse("name", c)[0].lower() for c in df.columns}
        return 100.0 * len(names & own) / len(names) if names else 0.0

    def matches_attrs(self, attrs: dict[str, str]) -> bool:
        """Whether a source's global attributes fit the patterns of these specifications."""
        return any(fnmatch.fnmatch(str(attrs.get(k, "")).lower(), p.lower()) for k, patterns in self.attrs.items() for p in patterns if k in attrs)

    def axis_of(self, f: StructField) -> str | None:
        """Type of dimension of a field: x, y, z, t or f."""
        if (f.metadata or {}).get("axis"):
            return f.metadata["axis"].lower()
        hit = self.match(f, "coords")
        return self.items["coords"][hit[1]].axis.lower() or None if hit else None


    def locations(self, df: DataFrame) -> dict[str, str | None]:
        """The location of each known column, by its name or else its attributes."""
        out = {}
        for f in df.schema.fields:
            if self.match(f):
                named = self.locator.parse("name", f.name)[1]
                out[f.name] = named or self.locator.location({k: v for k, v in (f.metadata or {}).items() if k in ("standard_name", "long_name")})
        return out

    def match_dim(self, dim: str, generic: str | None = None) -> str | None:
        """The coordinate that a dimension's name names, if it is ``generic`` or that is not given."""
        field_ = StructField(dim, IntegerType())
        hit = self.match(field_, "coords")
        return hit[1] if hit and generic in (None, hit[1]) else None

    def search_dim(self, dims: tuple[str, ...], kind: str) -> str | None:
        """The dimension of a type (x, y, z, t, f), by its name without location."""
        for d in dims:
            root = self.locator.parse("name", d)[0].lower()
            if root == kind or (item := self.items["coords"].get(self.match_dim(root) or "")) and item.axis.lower() == kind:
                return d
        return None

    def dims(self, dims: tuple[str, ...], kinds: str, errors: str = "ignore") -> list[str | None]:
        """The dimensions of several types."""
        found = [self.search_dim(dims, k) for k in kinds]
        if errors == "raise" and None in found:
            raise MetaError(f"no dimension of type {kinds[found.index(None)]}")
        return found

    def parse_dims(self, dims: tuple[str, ...], wanted: list[str]) -> list[str]:
        """Dimensions given by name, by type or by generic name."""
        out = []
        for w in wanted:
            hit = w if w in dims else self.search_dim(dims, w.lower()) or next((d for d in dims if self.match_dim(d) == w), None)
            if hit is None:
                raise MetaError(w)
            out.append(hit)
        return out

    def category(self, generic: str) -> str | None:
        """Where a generic name is specified: coords or data_vars."""
        return next((c for c in CATEGORIES if generic in self.items[c]), None)

    def assign(self, df: DataFrame) -> DataFrame:
        """Note these specifications in the metadata of every column, and register them."""
        register(self)
        return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata={**(f.metadata or {}), NAMES_KEY: self.name}) for f in df.schema.fields])

    def to_dict(self) -> dict[str, dict[str, dict]]:
        """The items by category and generic name."""
        return {c: {n: asdict(i) for n, i in items.items()} for c, items in self.items.items()}


def variant(df: DataFrame, generics: tuple[str, ...], errors: str = "ignore") -> str | None:
    """The first column that is one of several quantities, by their order."""
    s = infer(df)
    for generic in generics:
        found = s.search(df, generic)
        if found and (s.match(df.schema[found]) or (None, None))[1] in generics:
            return found
    if errors == "raise":
        raise MetaError(f"no column is one of {', '.join(generics)}")
    return None


def search_similar(df: DataFrame, other: StructField) -> str | None:
    """The first column that is the same quantity as another field."""
    return next((f.name for f in df.schema.fields if similar(f, other)), None)


def from_name(name: str, errors: str = "raise") -> MetaSpecs | None:
    """Registered specifications by name, or the default ones."""
    if name in _registered:
        return _registered[name]
    if name == "default":
        return MetaSpecs.default()
    if errors == "raise":
        raise MetaError(name)
    return None


def from_file(path: str, name: str | None = None) -> MetaSpecs:
    """Default specifications with the items of a file in the format of the vocabulary."""
    with open(path) as f:
        changes = parse(f.read())
    specs = MetaSpecs.default()
    specs.name = name or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for category, items in changes.items():
        specs.items[category].update(items)
    specs._inherit()
    return specs


_registered: dict[str, MetaSpecs] = {}
_current: list[MetaSpecs] = []


def register(*specs: MetaSpecs) -> None:
    """Add specifications, the latest first; one of the same name gives way."""
    for s in specs:
        _registered.pop(s.name, None)
        _registered[s.name] = s


def registered() -> list[MetaSpecs]:
    return list(_registered.values())[::-1]


def reset() -> None:
    _registered.clear()


def current() -> MetaSpecs:
    return _current[-1] if _current else MetaSpecs.default()


@contextmanager
def set_specs(specs: MetaSpecs | str) -> Iterator[MetaSpecs]:
    _current.append(_registered[specs] if isinstance(specs, str) else specs)
    try:
        yield _current[-1]
    finally:
        _current.pop()


def infer(df: DataFrame, attrs: dict[str, str] | None = None) -> MetaSpecs:
    """Specifications of a frame: those named in its metadata, then by attributes, then of best score, then the current ones."""
    for f in df.schema.fields:
        if (f.metadata or {}).get(NAMES_KEY) in _registered:
            return _registered[f.metadata[NAMES_KEY]]
    for s in registered():
        if attrs and s.matches_attrs(attrs):
            return s
    best = max(registered(), key=lambda s: s.score(df), default=None)
    return best if best and best.score(df) > 0 else current()


def similar(a: StructField, b: StructField) -> bool:
    """Whether two fields are the same quantity: by standard name, generic name, name, or long name."""
    specs = current()
    ma, mb = a.metadata or {}, b.metadata or {}
    if ma.get("standard_name") and mb.get("standard_name"):
        return specs.locator.parse("standard_name", ma["standard_name"])[0] == specs.locator.parse("standard_name", mb["standard_name"])[0]
    ha, hb = specs.match(a), specs.match(b)
    if ha and hb:
        return ha[1] == hb[1]
    return a.name == b.name or bool(ma.get("long_name") and ma.get("long_name") == mb.get("long_name"))
