"""larkspur: relational analytics and change processing, declared as Spark plans."""

__version__ = "0.1.0"
