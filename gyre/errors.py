"""What goes wrong, by the part of the library; each is also the built-in error of its kind."""


class GyreError(Exception):
    """Any error of this library."""


class MetaError(GyreError, KeyError):
    """A quantity, dimension or set of specifications that is not there."""

    __str__ = Exception.__str__


class CoordsError(MetaError):
    """A coordinate or dimension of a grid frame that is not there."""


class LocationError(GyreError, ValueError):
    """A place on the staggered grid that is unknown, or named differently in two attributes."""


class TimeStepError(GyreError, ValueError):
    """Rows that are not as far apart as a filter needs them."""
