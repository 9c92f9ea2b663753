"""Parsing and validation of request parameters, in plain Python."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from twinmesh.errors import Invalid
from twinmesh.schema import SCOPES

DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 20, 100


def _leading(pattern: str, raw: str) -> str | None:
    m = re.match(rf"\s*({pattern})", raw)
    return m[1] if m else None


def positive_int(raw: str | None, default: int | None, field: str) -> int | None:
    """A positive integer, of which leading digits are enough; the default where nothing is given."""
    if raw is None:
        return default
    digits = _leading(r"[+-]?\d+", raw)
    if digits is None or int(digits) <= 0:
        raise Invalid(f"{field} must be a positive integer")
    return int(digits)


def percentage(raw: str | None, fallback: float) -> float:
    if raw is None:
        return fallback
    number = _leading(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", raw)
    value = float(number) if number is not None else math.nan
    if not is_percentage(value):
        raise Invalid("threshold must be between 0 and 100")
    return value


def strict_threshold(raw: str | None, fallback: float) -> float:
    """As ``percentage``, for at most three digits and two decimals."""
    if raw is not None and not re.fullmatch(r"\d{1,3}(\.\d{1,2})?", raw):
        raise Invalid("threshold must be a number with at most two decimals")
    return percentage(raw, fallback)


def is_percentage(value: float) -> bool:
    return math.isfinite(value) and 0 <= value <= 100


def page_of(page: str | None, size: str | None, size_field: str = "page_size") -> tuple[int, int]:
    p, s = positive_int(page, 1, "page"), positive_int(size, DEFAULT_PAGE_SIZE, size_field)
    if s > MAX_PAGE_SIZE:
        raise Invalid(f"{size_field} must not exceed {MAX_PAGE_SIZE}")
    return p, s


def valid_recipes(recipes: list[str]) -> list[str]:
    """Recipes without repeats; at least one, and at least one of binary.*"""
    out = list(dict.fromkeys(recipes))
    if not out:
        raise Invalid("a project needs at least one recipe")
    if not any(r.startswith("binary.") for r in out):
        raise Invalid("a project needs at least one binary.* recipe")
    return out


def valid_threshold(value: float | None) -> float | None:
    if value is not None and not is_percentage(float(value)):
        raise Invalid("hamming_threshold must be between 0 and 100")
    return value


def valid_rate_limit(value: int | None) -> int | None:
    if value is not None and (not isinstance(value, int) or value <= 0):
        raise Invalid("rate_limit_per_minute must be a positive integer")
    return value


def has_scope(scopes: list[str], required: str) -> bool:
    if required not in SCOPES:
        raise Invalid(f"unknown scope {required}")
    return "*" in scopes or required in scopes


@dataclass(frozen=True)
class PageInfo:
    """The numbers of a page envelope; an empty result has no pages."""

    total_count: int
    current_count: int
    current_page: int
    page_size: int

    @property
    def page_count(self) -> int:
        return -(-self.total_count // self.page_size)

    @property
    def has_next_page(self) -> bool:
        return self.current_page < self.page_count

    @property
    def has_previous_page(self) -> bool:
        return self.current_page > 1 and self.total_count > 0
