"""Errors that a request can meet before it runs."""

from __future__ import annotations


class Invalid(Exception):
    """One or more (error, context) problems; all that were found are reported together."""

    def __init__(self, *problems: tuple[str, str]):
        super().__init__("; ".join(e for e, _ in problems))
        self.problems = list(problems)

    def report(self) -> dict:
        return {"problems": [{"error": e} | ({"context": c} if c else {}) for e, c in self.problems]}


class Collector:
    """Gathers the problems of independent parts."""

    def __init__(self):
        self.problems: list[tuple[str, str]] = []

    def of(self, make, *args):
        """make(*args), or None if it is invalid; its problems are kept."""
        try:
            return make(*args)
        except Invalid as e:
            self.problems += e.problems
            return None

    def add(self, error: str, context: str = "") -> None:
        self.problems.append((error, context))

    def check(self) -> None:
        if self.problems:
            raise Invalid(*self.problems)


class Malformed(Exception):
    """A request body that isn't of the grammar: bad JSON, unknown or missing fields."""
