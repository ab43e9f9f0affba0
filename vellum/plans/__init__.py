"""Queries over the driver tables; importing this package registers them all."""

from vellum.plans import (  # noqa: F401
    facts,
    inventory,
    kinship,
    language,
    pages,
    recognition,
    rules,
    streams,
    vectors,
)
