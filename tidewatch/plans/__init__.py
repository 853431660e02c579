"""The registered queries of the stress analytics: importing this package registers all of them."""

from . import queries, training  # noqa: F401
