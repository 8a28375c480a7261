"""The dialect: text to tokens to syntax trees."""

from .parser import parse

__all__ = ["parse"]
