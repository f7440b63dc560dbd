"""Errors that callers can catch."""


class VariantError(Exception):
    """Anything that an operator refuses."""


class ExpressionError(VariantError):
    """A filter expression that doesn't parse."""


class FormatError(VariantError):
    """Input or output in a form that isn't supported."""
