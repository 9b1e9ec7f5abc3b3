"""leakscope: privacy-audit analytics for trained classifiers, written as Spark plans."""

__version__ = "0.1.0"
