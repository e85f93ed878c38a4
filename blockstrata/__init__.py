"""Data-reduction analytics as Spark DataFrame operators."""
