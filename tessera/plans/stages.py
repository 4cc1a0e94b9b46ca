"""Stage schedules: functions with declared reads and writes, run in an order that satisfies them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.sql import Refused


@dataclass(frozen=True)
class Stage:
    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] = field(compare=False)


def schedule(stages: list[Stage], given: set[str]) -> list[list[Stage]]:
    """Waves of stages whose inputs are there; a relation written twice, one never written and cycles are refused."""
    writer: dict[str, str] = {}
    for s in stages:
        for w in s.writes:
            if w in writer or w in given:
                raise Refused(f"{w} is written twice")
            writer[w] = s.name
    known, todo, waves = set(given), sorted(stages, key=lambda s: s.name), []
    for s in todo:
        for r in s.reads:
            if r not in known and r not in writer:
                raise Refused(f"{s.name} reads {r}, which nothing writes")
    while todo:
        wave = [s for s in todo if set(s.reads) <= known]
        if not wave:
            raise Refused("the stages form a cycle: " + ", ".join(s.name for s in todo))
        waves.append(wave)
        known |= {w for s in wave for w in s.writes}
        todo = [s for s in todo if s not in wave]
    return waves


def ready(stage: Stage, stages: list[Stage], completed: set[str]) -> bool:
    """All stages that write what this one reads are done."""
    return all(s.name in completed for s in stages if set(s.writes) & set(stage.reads))


def execute(stages: list[Stage], relations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Build the plans of all stages; nothing runs until a relation is used. A stage must write what it declares."""
    have = dict(relations)
    for wave in schedule(stages, set(relations)):
        for s in wave:
            out = s.run({r: have[r] for r in s.reads})
            if set(out) != set(s.writes):
                raise Refused(f"{s.name} wrote {sorted(out)}, not {sorted(s.writes)}")
            have |= out
    return have


def frontier(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Availability of each planned (scope, definition): available, failed, not_requested. results: scope, definition, ok."""
    j = planned.join(results, ["scope", "definition"], "left")
    state = F.when(F.col("ok").isNull(), "not_requested").when(F.col("ok"), "available").otherwise("failed")
    return j.select("scope", "definition", state.alias("availability"))


def refuse_rows(df: DataFrame, message: str) -> None:
    """Any row fails the admission."""
    if not df.isEmpty():
        raise Refused(message)
