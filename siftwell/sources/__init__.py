"""Readers of trees and tables."""

from siftwell.sources.tables import table

__all__ = ["table"]
