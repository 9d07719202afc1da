"""Plain versions that several tests share."""

from test_packing import ids_of
from test_simhash import plain_components

__all__ = ["ids_of", "plain_components"]
