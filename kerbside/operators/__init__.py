"""Operators over the road-safety relations; importing this package registers its queries."""

from . import answers, arguments, facilities, filters, forecasts, images, integrity, kept, loading, merging, questions, replays, response, risk, safe_routes, snapshots, spatial, statistics, views  # noqa: F401
