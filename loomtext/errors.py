"""The errors that the library raises where an argument or input can't be used."""

from __future__ import annotations


class LoomError(Exception):
    """Base of all."""


class ValidationError(LoomError, ValueError):
    """An argument or input that can't be used."""


class ParsingError(LoomError, ValueError):
    """A text that isn't in the format it is said to be in."""


class ProviderError(LoomError, ValueError):
    """A provider that isn't known."""


class NormalizationError(LoomError):
    """A record that can't be normalised."""


class SegmentationError(LoomError):
    """A text that can't be cut."""


class FidelityError(LoomError):
    """A text that lost more than it may."""


class ConfigurationError(LoomError, ValueError):
    """Settings that don't fit together."""
