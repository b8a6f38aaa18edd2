"""loomspar: knowledge-graph building, analytics and evaluation as pure DataFrame functions on PySpark."""

__version__ = "0.1.0"
