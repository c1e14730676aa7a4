"""Rules: each gives the notices of one check over a feed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..feed import Feed, RunOptions

Result = DataFrame | list[DataFrame] | None


@dataclass(frozen=True)
class Rule:
    """needs: tables without which there is nothing to check; gated: tables whose load errors stop the rule."""

    name: str
    run: Callable[[Feed, RunOptions], Result]
    needs: tuple[str, ...] = ()
    gated: tuple[str, ...] = ()
    thorough: bool = False
    google: bool = False

    def notices(self, feed: Feed, options: RunOptions) -> list[DataFrame]:
        if self.thorough and not options.thorough or self.google and not options.google or not feed.has(*self.needs) or feed.errors(*self.gated):
            return []
        found = self.run(feed, options)
        return [] if found is None else [x for x in found if x is not None] if isinstance(found, list) else [found]


RULES: dict[str, Rule] = {}


def rule(name: str, needs: str = "", gated: str = "", thorough: bool = False, google: bool = False) -> Callable:
    def register(run: Callable[[Feed, RunOptions], Result]) -> Callable:
        RULES[name] = Rule(name, run, tuple(needs.split()), tuple(gated.split()), thorough, google)
        return run

    return register


def all_rules() -> dict[str, Rule]:
    from . import calendar, keys, rows, sequences, shapes, space, stations, transfers  # noqa: F401

    return RULES
