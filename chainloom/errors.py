"""Errors, each with a code that stays."""

from __future__ import annotations


class ChainloomError(Exception):
    code = "E0000"

    def __init__(self, message: str) -> None:
        super().__init__(f"[{self.code}] {message}")


class RangeError(ChainloomError):
    """A range that is no range."""

    code = "E0001"


class AbiError(ChainloomError):
    """A description of events or instructions that cannot be compiled, or data that does not follow it."""

    code = "E0002"


class DiscriminatorError(ChainloomError):
    """Instructions of one program that cannot be told apart."""

    code = "E0003"


class ForkError(ChainloomError):
    """The chain was rewritten: the source knows other blocks than the cursor."""

    code = "E1000"

    def __init__(self, canonical: list[tuple[int, str]]) -> None:
        super().__init__(f"the chain was rewritten; canonical blocks: {canonical[:5]}")
        self.canonical = canonical


class DeepForkError(ChainloomError):
    """No common block is known, or it lies below the finalized one."""

    code = "E1001"


class StaleCanonicalError(ChainloomError):
    """The canonical blocks given end before the cursor."""

    code = "E1004"


class SinkError(ChainloomError):
    """A sink's state and data disagree."""

    code = "E2000"


class CoverageError(SinkError):
    """A file straddles the cursor or its range is inverted."""

    code = "E2317"


class FinalizedOnlyError(SinkError):
    """The sink takes finalized rows only."""

    code = "E2427"


class RelationCycleError(SinkError):
    """Tables refer to each other in a circle, so none can be cleared first."""

    code = "E2106"


class CanonicalError(ChainloomError):
    """A value or type without a canonical text, with its path."""

    code = "E2501"

    def __init__(self, path: str, why: str) -> None:
        super().__init__(f"at {path}: {why}")
        self.path = path

    def __reduce__(self):
        return ChainloomError, (str(self),)


class RowError(SinkError):
    """A row that does not fit its declared columns, with the path of the first value that does not."""

    code = "E2316"
