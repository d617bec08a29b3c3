"""Blocks: immutable nodes that are stacked into a view, and the view's JSON form."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta
from typing import Any, ClassVar

REGISTRY: dict[str, type[Block]] = {}
VERSION = 2


class Block:
    """A node of a view. Its arguments are blocks or constants; equal class and arguments give an equal token. Classes are found by name in a registry, never imported from a path in a file."""

    kind: ClassVar[str] = "block"

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        REGISTRY[f"{cls.kind}.{cls.__name__}"] = cls

    def __init__(self, *args):
        object.__setattr__(self, "args", tuple(args))

    def __setattr__(self, name, value):
        raise AttributeError(f"{type(self).__name__} is immutable")

    @property
    def path(self) -> str:
        return f"{self.kind}.{type(self).__name__}"

    @property
    def token(self) -> str:
        if "_token" not in self.__dict__:
            object.__setattr__(self, "_token", tokenise([self.path, *self.args]))
        return self._token

    def __eq__(self, other):
        return isinstance(other, Block) and self.token == other.token

    def __hash__(self):
        return hash(self.token)

    def __repr__(self):
        return f"<{self.path} {self.token[:7]}>"

    def __reduce__(self):
        return type(self), self.args

    def get_graph(self, serialize: bool = False) -> dict[str, Any]:
        """A flat dict of the view: name and token -> [class or its path, arguments], with blocks by name."""
        out: dict[str, Any] = {}

        def put(x):
            if isinstance(x, Block):
                name = f"{type(x).__name__.lower()}_{x.token}"
                if name not in out:
                    out[name] = None
                    out[name] = [x.path if serialize else type(x), *map(put, x.args)]
                return name if not serialize else {"block": name}
            if isinstance(x, (list, tuple)):
                return [put(y) for y in x]
            return encode(x) if serialize else x

        put(self)
        return out

    def serialize(self) -> dict:
        return {"version": VERSION, "graph": self.get_graph(serialize=True), "name": f"{type(self).__name__.lower()}_{self.token}"}

    def to_json(self, **kw) -> str:
        return json.dumps(self.serialize(), **kw)

    @staticmethod
    def deserialize(found: dict) -> Block:
        if found.get("version") != VERSION:
            raise NotImplementedError(f"version {found.get('version')} can't be read")
        return construct(found["graph"], found["name"])

    @staticmethod
    def from_json(text: str) -> Block:
        return Block.deserialize(json.loads(text))


class DummyBlock(Block):
    """A placeholder with a given name."""


def tokenise(x) -> str:
    return hashlib.sha256(json.dumps(_plain(x), sort_keys=True).encode()).hexdigest()[:32]


def _plain(x):
    if isinstance(x, Block):
        return {"token": x.token}
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return encode(x)


def encode(x):
    if isinstance(x, datetime):
        return {"datetime": x.isoformat()}
    if isinstance(x, timedelta):
        return {"seconds": x.total_seconds()}
    if hasattr(x, "tolist"):
        return encode(x.tolist())
    if hasattr(x, "semanticHash"):  # a DataFrame: its plan stands for it, in this session only
        return {"frame": x.semanticHash(), "columns": x.columns}
    if isinstance(x, (list, tuple)):
        return [encode(y) for y in x]
    if isinstance(x, dict) and not {"datetime", "seconds", "block"} & set(x):
        return {k: encode(v) for k, v in x.items()}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise TypeError(f"{type(x).__name__} can't be an argument of a block")


def decode(x):
    if isinstance(x, dict):
        if set(x) == {"datetime"}:
            return datetime.fromisoformat(x["datetime"])
        if set(x) == {"seconds"}:
            return timedelta(seconds=x["seconds"])
        if "frame" in x:
            raise ValueError("a view over a DataFrame has no JSON form that can be read back; use a file source")
        return {k: decode(v) for k, v in x.items()}
    return [decode(y) for y in x] if isinstance(x, list) else x


def construct(graph: dict, name: str) -> Block:
    return construct_multiple(graph, [name])[0]


def construct_multiple(graph: dict, names: list[str]) -> list[Block]:
    """Blocks by name from a graph as get_graph gives it. An entry that fails is named in the message."""
    made: dict[str, Block] = {}

    def make(name: str, above: tuple = ()) -> Block:
        if name in above:
            raise ValueError(f"{name} stands on itself")
        if name not in made:
            cls, *args = graph[name]
            if isinstance(cls, str):
                if cls not in REGISTRY:
                    raise ValueError(f"unknown block class {cls!r} in {name}")
                cls = REGISTRY[cls]
            if not (isinstance(cls, type) and issubclass(cls, Block)):
                raise TypeError(f"{name} isn't made of a block class")
            args = [arg(x, (*above, name)) for x in args]
            try:
                made[name] = cls(*args)
            except Exception as e:
                e.args = (f"{e.args[0] if e.args else ''} (in {name})", *e.args[1:])
                raise
        return made[name]

    def arg(x, above):
        if isinstance(x, dict) and set(x) == {"block"}:
            return make(x["block"], above)
        if isinstance(x, str) and x in graph:
            return make(x, above)
        if isinstance(x, list):
            return [arg(y, above) for y in x]
        return decode(x)

    return [make(n) for n in names]


def compute(graph: dict, name: str) -> list:
    """The rows of one entry of a compute graph; Spark runs what it stands on."""
    return graph[name].collect()


#: Settings and their defaults; read from the session as cellframe.<name>.
CONFIG = {"root": "/", "strict-file-paths": "false", "raster-limit": str(12 * 1024**2), "raster-limit-timesteps": "65536", "geometry-limit": "10000"}


def setting(spark, name: str) -> str:
    return spark.conf.get(f"cellframe.{name}", CONFIG[name])
