"""Projections: their tree, and the DataFrame plan that each becomes."""

from .compile import State, find_many
from .select import Select, parse_select

__all__ = ["Select", "State", "find_many", "parse_select"]
