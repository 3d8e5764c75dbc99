"""millrace: product-data mining and corpus analytics as Spark DataFrame transforms."""

__version__ = "0.1.0"
