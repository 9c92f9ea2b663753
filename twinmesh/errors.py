"""Errors of the registry, with the HTTP status a service would answer with."""

from __future__ import annotations


class RegistryError(Exception):
    """Base of all errors below."""

    status = 500


class Unauthorized(RegistryError):
    status = 401


class Forbidden(RegistryError):
    status = 403


class Invalid(RegistryError, ValueError):
    """A parameter or a row breaks a rule."""

    status = 400


class NotFound(RegistryError, LookupError):
    status = 404


class AlreadyExists(RegistryError):
    """A unique key is taken, or id and path of an identity belong to different assets."""

    status = 409


class Conflict(RegistryError):
    """Another writer published a version first; the change can be tried again."""

    status = 409


class ConfigError(RegistryError):
    """The configuration is missing or breaks a rule."""


class AssetProcessing(RegistryError):
    """A file can't be hashed."""

    status = 422


class HasherUnavailable(RegistryError):
    status = 502


class AlgorithmContract(RegistryError):
    """A recipe is unknown to the catalogue, or is stored with another comparison."""

    status = 502


class UnsupportedRecipe(RegistryError):
    """No comparison is implemented for the recipe (cosine, in the registry's own edge list)."""

    status = 501
