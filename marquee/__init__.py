"""Marquee: recommendation and data-quality analytics as Spark DataFrame operators."""
