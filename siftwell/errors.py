"""Failures by stage, under one root."""


class SiftError(Exception):
    """Root of all errors of this library."""


class ConfigError(SiftError):
    pass


class UnknownComponent(ConfigError):
    pass


class DuplicateComponent(ConfigError):
    pass


class UnsupportedFormat(SiftError):
    pass


class ParseError(SiftError):
    pass


class OcrError(ParseError):
    pass


class StorageError(SiftError):
    pass


class EmbeddingError(SiftError):
    pass


class EnrichmentError(SiftError):
    pass


class GenerationError(SiftError):
    pass


class EvaluationError(SiftError):
    pass
