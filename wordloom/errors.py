"""Typed errors."""


class FilterError(ValueError):
    """A filter that can't be bound; the message starts with ``filter:``."""


class OrderError(ValueError):
    """An order that can't be bound; the message starts with ``order_by:``."""


class NotFound(LookupError):
    """No row where one is asked for."""


class NotSingular(LookupError):
    """Several rows where one is asked for."""


class ConstraintError(ValueError):
    """A unique key or check is violated."""


class BackupError(ValueError):
    """A backup stream that can't be imported."""


class InvalidInput(ValueError):
    """A request that lacks something or says something impossible."""


class Rejected(PermissionError):
    """A mutation that a hook doesn't let through."""
