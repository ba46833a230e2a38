"""Calls of user-supplied models inside a task."""

from collections.abc import Callable

# So many calls of a task, from its first on, that all fail in one way are no longer an outage of single calls.
SAME_FAILURES = 16


class Calls:
    """Calls a model for one task. A call that raises costs its own rows; what it raised is kept as text. When the first
    SAME_FAILURES calls of the task all raise the same, the callable itself is at fault and its exception ends the task."""

    def __init__(self, model: Callable):
        self.model = model
        self.failed, self.cause, self.worked = 0, None, False

    def __call__(self, *arguments):
        """(what the model returned, None), or (None, the class and message of what it raised)."""
        try:
            found = self.model(*arguments)
        except Exception as error:
            cause = f"{type(error).__name__}: {error}"
            self.failed = self.failed + 1 if cause == self.cause else 1
            self.cause = cause
            if not self.worked and self.failed >= SAME_FAILURES:
                raise RuntimeError(f"the first {self.failed} calls of the model all failed: {cause}") from error
            return None, cause
        self.worked = True
        return found, None
