"""A frame of grid cells with named dimensions and coordinates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions import sigma
from gyre.meta import specs as meta
from gyre.meta.locator import Locator
from gyre.operators.ranks import following


@dataclass(frozen=True)
class GridFrame:
    """Cells as rows: ``dims`` are index columns in order, ``coords`` columns that place the cells, the rest data.

    ``types`` gives the types of dimensions where names do not tell them, ``spans`` the dimensions along which a
    column varies where that is not all of them. Reordering dimensions changes the list only; no data moves.
    """

    df: DataFrame
    dims: tuple[str, ...]
    coords: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    spans: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def along(self, column: str) -> tuple[str, ...]:
        """The dimensions along which a column varies."""
        return (column,) if column in self.dims else self.spans.get(column, self.dims)

    @property
    def data_vars(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.dims and c not in self.coords]

    def get(self, generic: str, errors: str = "ignore") -> str | None:
        return meta.infer(self.df).search(self.df, generic, errors=errors)

    def infer_coords(self) -> GridFrame:
        """Make data columns that match a coordinate coordinates."""
        s = meta.infer(self.df)
        more = [f.name for f in self.df.schema.fields if f.name in self.data_vars and s.match(f, "coords")]
        return replace(self, coords=(*self.coords, *more))

    def _with(self, df: DataFrame) -> GridFrame:
        new = dict(zip(self.df.columns, df.columns))
        named = lambda names: tuple(new[n] for n in names)
        return replace(self, df=df, dims=named(self.dims), coords=named(self.coords), types={new[k]: v for k, v in self.types.items()}, spans={new[k]: named(v) for k, v in self.spans.items() if k in new})

    def decode(self) -> GridFrame:
        return self._with(meta.infer(self.df).decode(self.df)).infer_coords()

    def encode(self, specs: meta.MetaSpecs | None = None) -> GridFrame:
        return self._with((specs or meta.infer(self.df)).encode(self.df))

    def order(self) -> str:
        """Types of the dimensions in order, ``-`` where unknown, as in "tzyx"."""
        s = meta.infer(self.df)
        return "".join(self.types.get(d) or s.axis_of(self.df.schema[d]) or "-" for d in self.dims)

    def transpose(self, dims: list[str], mode: str = "classic", sizes: dict[str, int] | None = None) -> GridFrame:
        """Dimensions in this order, the others to the left.

        Those that are missing are an error (classic), skipped (compat), added with size 1 (insert), or with
        their size (resize), which repeats the cells.
        """
        df, want = self.df, []
        for d in dims:
            if d in self.dims:
                want.append(d)
            elif mode == "classic":
                raise ValueError(f"no such dimension: {d}")
            elif mode in ("insert", "resize"):
                n = (sizes or {}).get(d, 1) if mode == "resize" else 1
                df = df.withColumn(d, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
                want.append(d)
        return replace(self, df=df, dims=(*[d for d in self.dims if d not in want], *want))

    def reorder(self, order: str) -> GridFrame:
        """Dimensions in the order of their types."""
        by_type = dict(zip(self.order(), self.dims))
        return self.transpose([by_type[t] for t in order if t in by_type])

    def drop_dim_coords(self, names: list[str]) -> GridFrame:
        """Without these coordinates."""
        return replace(self, df=self.df.drop(*names), coords=tuple(c for c in self.coords if c not in names))

    def sigma_terms(self, hlocs: list[str | None] = (None,)) -> dict[tuple[str | None, str | None], tuple[str, dict[str, str]]]:
        """What terrain-following levels are made of, by vertical and horizontal location: the kind, and the columns of its terms.

        A vertical location is that of a column with formula terms. Sea level and sea floor are looked up at each
        horizontal one: a term ``h`` at ``u`` is the column ``h_u``.
        """
        locator, out = Locator(), {}
        for f in self.df.schema.fields:
            m = f.metadata or {}
            kind, vloc = locator.parse("standard_name", m.get("standard_name", ""))
            if kind not in _CONVERTERS or "formula_terms" not in m:
                continue
            for hloc in hlocs:
                terms = decode_formula_terms(m["formula_terms"])
                out[vloc, hloc or None] = (kind, {k: locator.format("name", c, hloc) if hloc and k in _HORIZONTAL else c for k, c in terms.items()})
        return out

    def decode_sigma(self, name: str = "depth", hlocs: list[str | None] | None = None, average: dict[str, str] | None = None) -> GridFrame:
        """Add the heights of terrain-following levels, from the formula terms in columns' metadata.

        ``hlocs`` asks for them at several horizontal locations (None is that without a name), and vertical ones come with
        several columns of levels: ``depth_u``, ``depth_ur``, all in one pass. ``average`` gives the dimension along which
        a location lies half a cell on; where a sea level or floor has no column there, it is the mean of this cell's and
        the next one's, at the last one its own.
        """
        found = self.sigma_terms(hlocs or [None])
        out, many = self, len(found) > 1 or bool(hlocs)
        for (vloc, hloc), (kind, terms) in found.items():
            self._check_dims(terms)
            columns = {k: self._term(c, k, hloc, average or {}) for k, c in terms.items()}
            loc = (hloc or "") + (vloc or "")
            own = f"{name}_{loc}" if many and loc else name
            df = out.df.withColumn(own, _CONVERTERS[kind](columns).alias(own, metadata={"units": "m"}))
            out = replace(out, df=df, coords=(*out.coords, own))
        return out

    def averaged(self, columns: list[str], hloc: str, dim: str) -> GridFrame:
        """Add columns at a location half a cell on along ``dim``, the means of this cell's and the next one's, at the last its own.

        For a frame of few or no other dimensions, before levels are added: cells meet by their ranks, and no task holds them all.
        """
        names = [self._name(c) for c in columns]
        df = following(self.df, dim, names, [d for d in self.dims if d != dim])
        means = {Locator().format("name", c, hloc): (F.col(c) + F.coalesce(F.col(f"next_{c}"), F.col(c))) / 2 for c in names}
        return replace(self, df=df.withColumns(means).drop(*[f"next_{c}" for c in names]))

    def _term(self, column: str, term: str, hloc: str | None, average: dict[str, str]):
        """A term's column; at a location that has none of its own, the mean over the two cells around it."""
        there = {c.lower() for c in self.df.columns}
        if column.lower() in there or hloc not in average or term not in _HORIZONTAL:
            return self._column(column)
        dim, own = average[hloc], self._column(Locator().parse("name", column)[0])
        after = F.lead(own).over(Window.partitionBy(*[d for d in self.dims if d != dim]).orderBy(dim))
        return (own + F.coalesce(after, own)) / 2

    def _check_dims(self, terms: dict[str, str]) -> None:
        """The sea floor must not vary along a dimension that the sea level lacks, and the critical depth varies as the floor does, if at all."""
        span = {k: set(self.spans[c]) for k, v in terms.items() for c in self.df.columns if c.lower() == v.lower() and c in self.spans}
        if "depth" in span and "eta" in span and not span["depth"] <= span["eta"]:
            raise ValueError(f"{terms['depth']} varies along {sorted(span['depth'] - span['eta'])}, {terms['eta']} does not")
        if "depth" in span and span.get("depth_c") and span["depth_c"] != span["depth"]:
            raise ValueError(f"{terms['depth_c']} and {terms['depth']} vary along different dimensions")

    def _column(self, name: str):
        return F.col(self._name(name))

    def _name(self, name: str) -> str:
        found = next((c for c in self.df.columns if c.lower() == name.lower()), None)
        if found is None:
            raise KeyError(name)
        return found


#: Terms that a grid has at its horizontal locations.
_HORIZONTAL = ("eta", "depth", "ps")
_CONVERTERS = {
    "atmosphere_sigma_coordinate": lambda t: sigma.atmosphere_sigma(t["sigma"], t["ps"], t["ptop"]),
    "ocean_sigma_coordinate": lambda t: sigma.ocean_sigma(t["sigma"], t["eta"], t["depth"]),
    "ocean_s_coordinate": lambda t: sigma.ocean_s(t["s"], t["eta"], t["depth"], t["depth_c"], _stretched(t)),
    "ocean_s_coordinate_g1": lambda t: sigma.ocean_s_g1(t["s"], t["eta"], t["depth"], t["depth_c"], _stretched(t)),
    "ocean_s_coordinate_g2": lambda t: sigma.ocean_s_g2(t["s"], t["eta"], t["depth"], t["depth_c"], _stretched(t)),
}


def _stretched(terms: dict):
    return terms["C"] if "C" in terms else sigma.stretching(terms["s"], terms["a"], terms["b"])


def decode_formula_terms(text: str) -> dict[str, str]:
    """``"s: sc_r C: Cs_r"`` as a dictionary; anything else is an error."""
    words = text.split()
    if not words or len(words) % 2 or any(not w.endswith(":") for w in words[::2]) or any(w.endswith(":") for w in words[1::2]):
        raise ValueError(f"malformed formula terms: {text!r}")
    return {k[:-1]: v for k, v in zip(words[::2], words[1::2])}
