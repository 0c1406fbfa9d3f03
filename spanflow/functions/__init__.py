from . import hashing, lexing, scalars

__all__ = ["hashing", "lexing", "scalars"]
