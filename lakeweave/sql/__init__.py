"""The dialect: text to syntax tree."""

from .parser import parse, parse_script

__all__ = ["parse", "parse_script"]
