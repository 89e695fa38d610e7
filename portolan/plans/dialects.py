"""Database families: told by an address, and choices made by driver, family or default."""

from __future__ import annotations

# Drivers and their families.
FAMILY_OF = {
    "cockroach": "pgsql", "cockroachdb": "pgsql", "mariadb": "mysql", "matrixone": "matrixone", "mysql": "mysql", "pgsql": "pgsql", "postgresql": "pgsql",
    "spark": "spark", "sqlite": "sqlite",
}


def driver_of(address: str) -> str:
    """The driver that an address such as jdbc:postgresql://host/db names; a folder or store is Spark's own."""
    scheme, found, _ = address.removeprefix("jdbc:").partition(":")
    return scheme if found and scheme in FAMILY_OF else "spark"


def family_of(driver: str) -> str:
    if driver not in FAMILY_OF:
        raise ValueError(f"unknown driver {driver!r}")
    return FAMILY_OF[driver]


def pick(choices: dict, driver: str = "spark"):
    """The choice for the driver, else for its family, else the default; a key may list several names, with commas."""
    named = {n.strip(): v for names, v in choices.items() for n in names.split(",")}
    for name in (driver, family_of(driver), "default"):
        if name in named:
            return named[name]
    raise LookupError(f"no choice for {driver}, its family or default")
