"""What can go wrong, by phase."""


class FabrelError(Exception):
    """Base of all errors of the package."""


class ParseError(FabrelError):
    """A document, type, decorator or expression that cannot be read."""


class ValidationError(FabrelError):
    """A document that reads but does not hold together: unknown entities, bad volumes."""


class CycleError(ValidationError):
    """Entities whose required references form a cycle."""


class GenerationError(FabrelError):
    """A value that cannot be made."""


class UniquenessExhausted(GenerationError):
    """A unique field whose domain is too small."""


class ConstraintViolation(GenerationError):
    """A strict rule that still fails after all attempts."""


class OutputError(FabrelError):
    """An unknown format or dialect."""
