"""Places on a staggered grid in names and attributes: ``temp_t``, ``sea_water_temperature_at_t_location``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from gyre.errors import LocationError

FORMATS = {"name": "{root}_{loc}", "standard_name": "{root}_at_{loc}_location", "long_name": "{root} at {loc} location"}
LOCATIONS = ("t", "u", "v", "w", "f", "r", "p", "x", "y", "z")


class Locator:
    """Parses and formats locations; ``locations`` are the valid ones, of one or several letters.

    Formats may do without a separator; the longest location at the end of a value then counts.
    """

    def __init__(self, locations: tuple[str, ...] = LOCATIONS, formats: dict[str, str] | None = None):
        self.locations = tuple(x.lower() for x in locations)
        self.formats = {**FORMATS, **(formats or {})}

    def parse(self, attr: str, value: str) -> tuple[str, str | None]:
        """Root and location of a name, standard_name or long_name; the location is None where there is none."""
        pattern = re.escape(self.formats[attr]).replace(r"\{root\}", "(?P<root>.+?)").replace(r"\{loc\}", f"(?P<loc>{'|'.join(map(re.escape, self.locations))})")
        m = re.fullmatch(pattern, value, re.IGNORECASE)
        return (m["root"], m["loc"].lower()) if m else (value, None)

    def format(self, attr: str, value: str, loc: str | None) -> str:
        """``value`` at another location, or at none (None or an empty one)."""
        root, _ = self.parse(attr, value)
        if not loc:
            return root
        if loc.lower() not in self.locations:
            raise LocationError(f"no such location: {loc}")
        return self.formats[attr].format(root=root, loc=loc.upper() if attr == "long_name" else loc.lower())

    def matches(self, attr: str, value: str, root: str, loc: str | Iterable[str] | bool | None = None) -> bool:
        """Whether a value has this root, at any location (None, True, "any"), at none (False, ""), or at one of ``loc``.

        A string is one location if it is a valid one, else its letters are.
        """
        found_root, found = self.parse(attr, value)
        if found_root.strip().lower() != root.strip().lower():
            return False
        if loc is None or loc is True or loc == "any":
            return True
        if not loc:
            return found is None
        wanted = [loc] if isinstance(loc, str) and loc.lower() in self.locations else loc
        return found in [x.lower() for x in wanted]

    def location(self, attrs: dict[str, str]) -> str | None:
        """The one location that the attributes name; different ones are an error."""
        found = {loc for a, v in attrs.items() if a in self.formats and isinstance(v, str) for loc in [self.parse(a, v)[1]] if loc}
        if len(found) > 1:
            raise LocationError(f"conflicting locations: {sorted(found)}")
        return found.pop() if found else None

    def merge(self, attr: str, values: list[str], loc: str | None) -> list[str]:
        """Different values at one location, in order."""
        return list(dict.fromkeys(self.format(attr, v, loc) for v in values))

    def patch(self, attrs: dict[str, str], more: dict[str, str], loc: str | None = None, replace: bool = False) -> dict[str, str]:
        """Attributes with more of them, at ``loc`` or the location that they name; those that are there stay unless ``replace``."""
        loc = loc or self.location(attrs)
        out = {**attrs, **more} if replace else {**more, **attrs}
        return {k: self.format(k, v, loc) if loc and k in self.formats else v for k, v in out.items()}
