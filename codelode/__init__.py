"""Spark-first analytics over source trees and text corpora."""

from codelode.session import cut, load, scratch_dir

__all__ = ["cut", "load", "scratch_dir"]
