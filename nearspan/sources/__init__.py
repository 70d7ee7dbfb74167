"""Readers, parsers and generators of vector and word streams."""

from nearspan.sources.registry import create

__all__ = ["create"]
