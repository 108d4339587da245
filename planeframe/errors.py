"""Error taxonomy: what went wrong decides whether a caller may retry, replan or must give up."""


class KernelError(Exception):
    """Root of all errors raised here."""


class KernelValidationError(KernelError, ValueError):
    """A value breaks an invariant of the data model."""


class EffectPolicyError(KernelError, PermissionError):
    """An operation's effect isn't allowed in its context."""

    def __init__(self, violations):
        self.violations = tuple(violations)
        super().__init__("; ".join(self.violations))


class ScopePolicyError(KernelError, PermissionError):
    """A memory scope isn't readable or writable in its context."""


class BudgetExceeded(KernelError):
    """Usage is above the budget."""


class PlanValidationError(KernelError, ValueError):
    """A plan has issues; ``issues`` lists them."""

    def __init__(self, issues):
        self.issues = tuple(issues)
        super().__init__("; ".join(f"{i.code}: {i.message}" for i in self.issues))


class PlanCompilationError(KernelError, ValueError):
    """No valid plan came out of the allowed model calls."""


class SerializationError(KernelError, ValueError):
    """A document isn't a valid encoding."""


class UnsupportedPlanningError(KernelError):
    """There is no compiler."""


class ExecutionError(KernelError):
    """An operation failed while it ran."""


class DeadlineExceeded(ExecutionError):
    """The deadline of the context has passed."""


class DuplicateSourceError(ExecutionError):
    """The catalog has a source of this id."""


class SourceExecutionError(ExecutionError):
    """A source failed: the one kind of failure a plan may be replaced for."""


class SnapshotUnavailableError(ExecutionError):
    """The pinned version of a source can't be served."""


class MemoryMutationError(ExecutionError):
    """A memory mutation isn't valid."""


class MemoryVersionConflictError(MemoryMutationError):
    """The memory moved on after the proposal."""


class MemoryIdempotencyConflictError(MemoryMutationError):
    """One idempotency key, two different mutations."""


class TraceError(KernelError):
    """A trace is malformed."""


class TraceConflictError(TraceError):
    """The trace exists already."""


class TraceNotFoundError(TraceError, LookupError):
    """No such trace."""


class ReplayError(TraceError):
    """A recorded run can't be reproduced."""


class OutcomeError(KernelError):
    """An outcome record is malformed."""


class OutcomeConflictError(OutcomeError):
    """One idempotency key, two different outcomes."""


class OutcomeNotFoundError(OutcomeError, LookupError):
    """No such outcome."""


class UnsupportedOutcomeError(OutcomeError):
    """There is no outcome store."""


class SyncError(KernelError):
    """A change set can't be applied."""


class VersionConflictError(SyncError):
    """The change set's base isn't the source's version."""


class ArtifactIntegrityError(SyncError):
    """An artifact's bytes don't have the checksum they should."""


class ArtifactNotFoundError(SyncError, LookupError):
    """No such artifact."""


class IdempotencyConflictError(SyncError):
    """One idempotency key, two different change sets."""


class UnsupportedSyncError(SyncError):
    """The source takes no change sets."""
