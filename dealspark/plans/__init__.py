"""The registered queries; importing the package registers all of them."""

from . import details, flows, landing, profiles, registry

__all__ = ["details", "flows", "landing", "profiles", "registry"]
