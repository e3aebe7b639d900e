"""Error classes: what each stage rejects."""


class NaiveTimestampError(Exception):
    """A time without an offset, a date, or something that is no instant."""


class InvalidChronologyError(Exception):
    """Instants out of order."""


class FutureInformationError(Exception):
    """Information used before it was available."""


class MissingAvailabilityError(Exception):
    """No availability where one is required."""


class AmbiguousObservationError(Exception):
    """Repeated identities, or several series where one is expected."""


class FeatureLineageError(Exception):
    """A feature available before its inputs."""


#: The errors that the leakage battery recognises.
LEAKAGE_ERRORS = (
    NaiveTimestampError,
    InvalidChronologyError,
    FutureInformationError,
    MissingAvailabilityError,
    AmbiguousObservationError,
    FeatureLineageError,
)


class UnknownSeriesError(ValueError):
    """A requested series that the store doesn't hold."""


class GridDeclarationError(ValueError):
    """A malformed grid of instants or requests."""


class WindowDeclarationError(ValueError):
    """A bad parameter of a transform."""


class InsufficientWindowError(ValueError):
    """Too few rows, or rows without spread."""


class UnqualifiedDataError(TypeError):
    """Data without availability used at a decision."""


class UnknownDatasetError(ValueError):
    """A provider's dataset that isn't in the catalog."""


class ProviderResponseError(ValueError):
    """A payload that isn't what the provider documents."""


class UnknownProviderSeriesError(ProviderResponseError):
    """A series that the provider doesn't know."""


class UnsupportedFrequencyError(ValueError):
    """A frequency the decoder doesn't know."""


class PseudoVintageError(ValueError):
    """A current snapshot presented as a past vintage."""


class PlanStructureError(ValueError):
    """A malformed fitting plan."""


class ScheduleStructureError(ValueError):
    """A malformed refit schedule."""


class ProvenanceStructureError(ValueError):
    """Malformed provenance."""


class ProtocolVocabularyError(ValueError):
    """A token outside a closed vocabulary."""


class ProtocolStructureError(ValueError):
    """A malformed temporal protocol."""


class ConfigurationError(ValueError):
    """A malformed experiment declaration."""


class ExecutionError(ValueError):
    """A run whose inputs don't fit its declaration."""


class ResultStructureError(ValueError):
    """A malformed result record."""


class ComparisonError(ValueError):
    """A malformed comparison."""


class OptimizationFailureError(ValueError):
    """A solver that found no acceptable vector."""


class StorageError(RuntimeError):
    """No folder that the whole cluster shares."""
