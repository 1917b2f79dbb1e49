"""The one exception type of the engine: operators fail closed."""


class AuditError(ValueError):
    """Input or state that an operator must not accept."""
