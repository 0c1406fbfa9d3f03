from .features import stream_code_flags

__all__ = ["stream_code_flags"]
