"""What can be named in settings: parsers, graders, condensers and reflectors."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Callables by name. Another one under a name that is taken is an error, and so is an unknown name, which is told the known ones."""

    def __init__(self, kind: str, **known: Callable):
        self.kind, self._known = kind, dict(known)

    def register(self, name: str, f: Callable) -> Callable:
        if self._known.get(name, f) is not f:
            raise ValueError(f"{self.kind} {name!r} is taken")
        self._known[name] = f
        return f

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"no {self.kind} {name!r}; there are {self.names()}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


def tool_parsers() -> Registry:
    from runloom.operators import toolcalls

    return Registry("tool-call parser", **toolcalls.PARSERS)


def log_parsers() -> Registry:
    from runloom.operators import grading

    return Registry("log parser", **grading.LOG_PARSERS)


def graders() -> Registry:
    """By what an evaluation compares: test sets, tests that were seen, listed tests, whole maps, reward files, answers."""
    from runloom.operators import evaluation, grading

    return Registry("grader", strict=grading.grade_strict, lenient=grading.grade_lenient, listed=evaluation.grade_listed, exact=grading.grade_exact, exact_names=evaluation.grade_exact_names, reward_file=evaluation.reward, answer=grading.search_score)


def condensers() -> Registry:
    from runloom.operators import sequence

    return Registry("condenser", truncate_mask=sequence.condense, compact=sequence.compact)


def reflectors() -> Registry:
    """By how they find the turn to give a hint for; what a model writes is only read here."""
    from runloom.operators import reflection, sequence

    return Registry("reflector", diagnosis=reflection.first_failed_edit, correction=reflection.select_edits, loop=sequence.first_loop, pipeline=reflection.adopt, single=reflection.keep_hints)
