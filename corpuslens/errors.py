"""Error classes, one family per concern; bulk operators report the same conditions as row-level codes."""


class CorpusLensError(Exception):
    """Base of all errors of this package."""


class RecognitionError(CorpusLensError, RuntimeError):
    """Recognition of a page failed."""


class EngineNotFoundError(RecognitionError):
    """The engine's executable is absent."""


class EngineExecutionError(RecognitionError):
    """The engine or its files failed."""


class RecognitionDataError(RecognitionError):
    """The engine returned malformed data."""


class PageResultError(RecognitionDataError):
    """A polygon-style page result is malformed."""


class EngineNotInstalledError(CorpusLensError, ImportError):
    """An optional engine runtime is missing; there is no fallback."""


class ConfigurationError(CorpusLensError, ValueError):
    """A setting is unknown or of the wrong type."""


class UnsupportedEngineError(ConfigurationError):
    """No engine of that name is registered."""


class InvalidThresholdError(CorpusLensError, ValueError):
    """A confidence threshold is not a finite number from 0 to 100."""


class ImageError(CorpusLensError, RuntimeError):
    """Image preprocessing failed."""


class ImageLoadError(ImageError):
    """An image is missing, not a file or can't be decoded."""


class InvalidImageError(ImageError):
    """An image has an unsupported shape or type."""


class EvaluationError(CorpusLensError):
    """Evaluation failed."""


class EvaluationInputError(EvaluationError, ValueError):
    """Evaluation input is unreadable or malformed."""


class ProfileError(CorpusLensError):
    """The profile experiment failed."""


class ProfileInputError(ProfileError, ValueError):
    """Bad input of the profile experiment."""


class ProfileExecutionError(ProfileError):
    """An engine or file failed during the profile experiment."""


class ClassificationError(CorpusLensError):
    """Sentence classification failed."""


class ModelValidationError(ClassificationError, ValueError):
    """A record or container has the wrong type or content."""


class InvalidSentenceError(ModelValidationError):
    """A sentence is empty or not a string."""


class ResponseContractError(ModelValidationError):
    """A client's response breaks its contract with the input."""


class RateLimitError(ClassificationError):
    """The client was told to slow down; the only error that is retried."""
