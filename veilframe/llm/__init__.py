"""Operators that a training-data pipeline needs beside the span engine."""
