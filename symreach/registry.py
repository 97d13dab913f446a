"""Flag and topic registries: names to bits, seeds of the default closure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import schema as S


@dataclass(frozen=True)
class Flag:
    name: str
    bit: int
    seed: bool = False
    default_on: bool = False
    description: str = ""


class FlagSpace:
    """The flags of nodes or of edges. New bits start above the highest of the engine's and double."""

    def __init__(self, space: str, engine: list[Flag], first: int, width: int):
        self.space, self.width, self._next = space, width, first
        self.flags: dict[str, Flag] = {f.name: f for f in engine}
        self._reserved = {f.name for f in engine}

    def declare(self, name: str, seed: bool = False, default_on: bool = False, description: str = "") -> int:
        """The flag's bit; the same declaration again gives it again, another one of the same name is an error."""
        if "/" not in name:
            raise ValueError(f"flag name {name!r} is not of the form owner/name")
        if name.startswith("engine/"):
            raise ValueError(f"flag name {name!r} is reserved")
        if (old := self.flags.get(name)) is not None:
            if (old.seed, old.default_on, old.description) != (seed, default_on, description):
                raise ValueError(f"flag {name!r} is declared otherwise already")
            return old.bit
        if self._next >= 1 << self.width:
            raise ValueError(f"no bit is left for {self.space} flag {name!r}")
        self.flags[name] = Flag(name, self._next, seed, default_on, description)
        self._next <<= 1
        return self.flags[name].bit

    def bit(self, name: str) -> int:
        return self.flags[name].bit

    def sorted(self) -> list[Flag]:
        return sorted(self.flags.values(), key=lambda f: f.bit)


class FlagRegistry:
    def __init__(self) -> None:
        self.nodes = FlagSpace(
            "node",
            [
                Flag("engine/unresolved", S.UNRESOLVED),
                Flag("engine/entrypoint", S.ENTRYPOINT, True, True),
                Flag("engine/noqa", S.NOQA, True, True),
                Flag("engine/notebook", S.NOTEBOOK, True, True),
                Flag("engine/dead_branch", S.DEAD_BRANCH),
                Flag("engine/star_reexport", S.STAR_REEXPORT),
            ],
            S.FIRST_NODE_BIT,
            S.NODE_BITS,
        )
        self.edges = FlagSpace("edge", [Flag("engine/dead_branch", S.EDGE_DEAD_BRANCH), Flag("engine/dynamic_import", S.EDGE_DYNAMIC_IMPORT), Flag("engine/init_subclass", S.EDGE_INIT_SUBCLASS)], S.FIRST_EDGE_BIT, S.EDGE_BITS)

    def default_seed_mask(self) -> int:
        """All bits of node flags that seed by default."""
        out = 0
        for f in self.nodes.flags.values():
            out |= f.bit if f.seed and f.default_on else 0
        return out

    def to_rows(self) -> list[tuple]:
        return [(space.space, f.name, f.bit, f.seed, f.default_on, f.description) for space in (self.nodes, self.edges) for f in space.sorted()]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.to_rows(), "space string, name string, bit long, seed boolean, default_on boolean, description string")

    @classmethod
    def from_rows(cls, rows) -> FlagRegistry:
        """A registry with the rows' flags and bits, whoever declared them."""
        out = cls()
        for space, name, bit, seed, default_on, description in rows:
            own = out.nodes if space == "node" else out.edges
            own.flags[name] = Flag(name, bit, seed, default_on, description)
            own._next = max(own._next, bit << 1)
        return out


class TopicRegistry:
    """Named channels of facts, with handles in order of declaration."""

    def __init__(self) -> None:
        self.topics: dict[str, int] = {}

    def declare(self, name: str) -> int:
        return self.topics.setdefault(name, len(self.topics))
