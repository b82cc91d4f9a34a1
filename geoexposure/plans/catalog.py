"""The variables of each component, and their evaluation in one pass over the cells or features."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Variable:
    """A variable: an operator over a source layer (and a class of it), or a formula over other variables."""

    name: str
    operator: str | None = None
    source: str | None = None
    cls: str | int | None = None
    formula: str | None = None
    percentage: bool = False

    @property
    def depends(self) -> set[str]:
        return set(re.findall(r"[A-Za-z_]\w*", self.formula or ""))


# Fixed values here and below: names of variables, and formulas of their ratios.
SEXES, GROUPS = ("male", "female"), ("child", "active", "elderly")
# The six road classes, and land-use classes by number.
ROAD_CLASSES = ("Highways", "Local roads", "Primary roads", "Secondary roads", "Tertiary roads", "Others")
LAND = {"crops": 4, "built": 6}


def _population() -> list[Variable]:
    base = [Variable(f"{s}_{g}", "sum", f"{s}_{g}") for s in SEXES for g in GROUPS]
    sums = [Variable(f"{s}_total", formula="+".join(f"{s}_{g}" for g in GROUPS)) for s in SEXES]
    sums += [Variable(f"{g}_total", formula="+".join(f"{s}_{g}" for s in SEXES)) for g in GROUPS]
    total = Variable("total", formula="male_total+female_total")
    ratios = {"dependency": "((child_total+elderly_total)/active_total)*100", "child_dependency": "(child_total/active_total)*100", "elderly_dependency": "(elderly_total/active_total)*100"}
    return [*base, *sums, total, *[Variable(n, formula=f) for n, f in ratios.items()]]


CATALOG: dict[str, list[Variable]] = {
    "population": _population(),
    "buildings": [Variable("nbuildings", "count", "buildings", percentage=True), Variable("buildings_area", "area", "buildings", percentage=True)],
    "roads": [Variable("roads_length", "sum", "roads", percentage=True), Variable("roads_density", "density", "roads")]
    + [Variable(f"{c.replace(' ', '').lower()}_{k}", o, "roads", c, percentage=o == "sum") for c in ROAD_CLASSES for k, o in (("length", "sum"), ("density", "density"))],
    "rwi": [Variable(f"rwi_{o}", o, "rwi") for o in ("mean", "min", "max")],
    "deprivation": [Variable(f"depriv_{o}", o, "deprivation") for o in ("mean", "min", "max")],
    "elegrid": [Variable("elegrid_length", "sum", "grid", percentage=True), Variable("elegrid_density", "density", "grid")],
    "landuse": [Variable(f"{n}_area", "class_area", "landuse", k, percentage=True) for n, k in LAND.items()],
    "gdp": [Variable(f"gdp_{o}", o, "gdp", percentage=o == "sum") for o in ("sum", "mean", "min", "max")],
    "ntl": [Variable(n, "sum", n, percentage=True) for n in ("noaa_outage", "nasa_nrt_outage", "nasa_outage")],
}


def in_order(variables: list[Variable]) -> list[Variable]:
    """The formula variables so that each comes after those that it needs; a circle raises."""
    known = {v.name for v in variables if not v.formula}
    left, out = [v for v in variables if v.formula], []
    names = {v.name for v in variables}
    while left:
        ready = [v for v in left if v.depends & names <= known]
        if not ready:
            raise ValueError(f"formulas depend on each other: {[v.name for v in left]}")
        out += ready
        known |= {v.name for v in ready}
        left = [v for v in left if v not in ready]
    return out
